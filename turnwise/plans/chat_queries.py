"""Queries on conversations, prompts and responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.operators import chat, prompts
from turnwise.plans import fixtures as fx
from turnwise.plans.registry import query
from turnwise.sources import readers, schemas, writers
from turnwise.session import scratch_path

SYSTEM = "Answer briefly."
OPEN_, CLOSE_ = chat.OPEN, "<|im_end|>' || chr(10)"


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def piece(role: str, text: str) -> str:
    return f"('{OPEN_}' || {role} || chr(10) || {text} || '{CLOSE_})"


ROLE = "CASE speaker WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE 'system' END"
DOC_CHAT = (
    "SELECT CAST(doc_id AS VARCHAR) AS id, 0::BIGINT AS j, 'human' AS speaker, instruction || chr(10) || input AS value FROM z_doc "
    "UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, 'gpt', output FROM z_doc"
)


# --- sources and sinks ---------------------------------------------------------


@query("src_conversations", DOC_CHAT)
def src_conversations(spark, sf_dir):
    path = scratch_path(spark, "conversations")
    writers.write_jsonl(fx.document_chats(spark, sf_dir), path)
    return chat.unnest(readers.read_conversations(spark, path))


@query("src_json_array", "SELECT instruction, input, output FROM z_doc")
def src_json_array(spark, sf_dir):
    rows = fx.instructions(spark, sf_dir).select(
        "doc_id", F.to_json(F.struct("instruction", "input", "output")).alias("row")
    )
    # One document per file, each an array of its rows: about a thousand rows a file.
    path = scratch_path(spark, "json-array")
    docs = rows.groupBy(F.floor(F.col("doc_id") / 1000).alias("part")).agg(
        F.concat(F.lit("[\n"), F.array_join(F.collect_list("row"), ",\n"), F.lit("\n]")).alias("value")
    )
    docs.repartition("part").write.partitionBy("part").text(path)
    return readers.read_json_array(spark, path + "/*", schemas.INSTRUCTION)


@query(
    "src_prompts_tolerant",
    "SELECT 'ok' AS status, id, prompt_key, CASE WHEN prompt_key IS NOT NULL THEN text END AS prompt FROM z_loaded "
    "UNION ALL SELECT 'bad JSON', id, NULL, NULL FROM z_line WHERE cut AND NOT blank",
)
def src_prompts_tolerant(spark, sf_dir):
    path = scratch_path(spark, "prompts")
    fx.prompt_lines(spark, sf_dir).select("line").write.text(path)
    good, rejects = readers.read_prompts(spark, path)
    picked = prompts.pick_prompt(good).select(F.lit("ok").alias("status"), "id", "prompt_key", "prompt")
    named = F.nullif(F.regexp_extract("line", r'"id":"(doc-\d+)"', 1), F.lit(""))
    missing = F.lit(None).cast("string")
    return picked.unionByName(
        rejects.select(
            F.col("reason").alias("status"), named.alias("id"), missing.alias("prompt_key"), missing.alias("prompt")
        )
    )


@query(
    "src_questions_slice",
    "SELECT item_id AS question_id, text AS turn FROM benchmark ORDER BY item_id OFFSET 5",
)
def src_questions_slice(spark, sf_dir):
    path = scratch_path(spark, "questions")
    rows = fx.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"), F.lit("qa").alias("category"), F.array("text").alias("turns")
    )
    # Sorted part files: file name, then line, gives the order of the questions.
    writers.write_jsonl(rows.repartitionByRange("question_id").sortWithinPartitions("question_id"), path)
    return readers.read_questions(spark, path, begin=5).select("question_id", F.explode("turns").alias("turn"))


@query("sink_training_jsonl", DOC_CHAT)
def sink_training_jsonl(spark, sf_dir):
    path = scratch_path(spark, "training")
    writers.write_jsonl(fx.document_chats(spark, sf_dir), path)
    lines = spark.read.text(path).select(F.from_json("value", schemas.CONVERSATION).alias("r")).select("r.*")
    return chat.unnest(lines)


@query("sink_verify_nonempty", "SELECT count(*) AS n_written, count(*) AS n_read FROM documents")
def sink_verify_nonempty(spark, sf_dir):
    path = scratch_path(spark, "verified")
    n = writers.write_verified(fx.document_chats(spark, sf_dir), path)
    back = readers.read_conversations(spark, path)
    return back.agg(F.lit(n).cast("bigint").alias("n_written"), F.count("*").alias("n_read"))


# --- conversion ----------------------------------------------------------------


@query("conv_from_instruction", DOC_CHAT)
def conv_from_instruction(spark, sf_dir):
    return chat.unnest(fx.document_chats(spark, sf_dir))


@query(
    "conv_fold_system",
    """SELECT c.conv_id, c.turn, c.role, CASE WHEN s.text IS NOT NULL THEN s.text || c.text ELSE c.text END AS text
       FROM conversations c LEFT JOIN conversations s
         ON s.conv_id = c.conv_id AND s.turn = 0 AND s.role = 'system' AND c.turn = 1""",
)
def conv_fold_system(spark, sf_dir):
    return chat.fold_system(fx.messages(spark, sf_dir))


@query(
    "conv_drop_leading_nonuser",
    """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS j, role, text
       FROM conversations WHERE NOT (turn = 0 AND role <> 'user')""",
)
def conv_drop_leading_nonuser(spark, sf_dir):
    return chat.drop_leading_nonuser(fx.messages(spark, sf_dir)).select(
        "conv_id", "turn", "j", "role", "text"
    )


@query("conv_map_roles", "SELECT conv_id, j, speaker, value FROM z_norm")
def conv_map_roles(spark, sf_dir):
    return fx.normal(spark, sf_dir)


@query(
    "conv_drop_empty",
    "SELECT doc_id, count(*) AS n_turns FROM z_docconv GROUP BY doc_id",
)
def conv_drop_empty(spark, sf_dir):
    good, _ = chat.from_messages(fx.document_messages(spark, sf_dir))
    return good.select("doc_id", F.size("conversations").cast("bigint").alias("n_turns"))


@query(
    "conv_assign_ids",
    """SELECT CAST(i + 7 AS VARCHAR) AS id, j, speaker, value FROM z_docconv
       JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) USING (doc_id)""",
)
def conv_assign_ids(spark, sf_dir):
    numbered = chat.assign_ids(fx.document_messages(spark, sf_dir), ["doc_id"], offset=7)
    good, _ = chat.from_messages(numbered.drop("doc_id"))
    return chat.unnest(good)


@query(
    "conv_union_sources",
    """SELECT CAST(i AS VARCHAR) AS id, j, speaker, value FROM z_docconv
         JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) USING (doc_id)
       UNION ALL
       SELECT CAST(doc_id AS BIGINT) + (SELECT count(*) FROM documents) || '', j, speaker, value
       FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, 0 AS j, 'human' AS speaker,
                    instruction || chr(10) || input AS value FROM z_doc
             UNION ALL SELECT row_number() OVER (ORDER BY doc_id) - 1, 1, 'gpt', output FROM z_doc)""",
)
def conv_union_sources(spark, sf_dir):
    first = fx.document_messages(spark, sf_dir)
    second = fx.instructions(spark, sf_dir)
    converted, _ = chat.from_messages(chat.assign_ids(first, ["doc_id"]).drop("doc_id"))
    more = chat.from_instructions(chat.assign_ids(second, ["doc_id"], offset=first.count()).drop("doc_id"))
    return chat.unnest(converted.unionByName(more))


# --- prompts and responses -----------------------------------------------------


@query(
    "prompt_pick_field",
    "SELECT doc_id, prompt_key, text AS prompt FROM z_loaded WHERE prompt_key IS NOT NULL",
)
def prompt_pick_field(spark, sf_dir):
    lines = fx.prompt_lines(spark, sf_dir)
    loaded = lines.filter((F.trim("line") != "") & F.try_parse_json("line").isNotNull())
    return prompts.pick_prompt(loaded).filter("prompt_key is not null").select("doc_id", "prompt_key", "prompt")


@query(
    "prompt_default_id",
    "SELECT doc_id, coalesce(id, 'prompt_' || (row_number() OVER (ORDER BY doc_id) - 1)) AS id FROM z_loaded",
)
def prompt_default_id(spark, sf_dir):
    lines = fx.prompt_lines(spark, sf_dir)
    loaded = lines.filter((F.trim("line") != "") & F.try_parse_json("line").isNotNull())
    named = loaded.select("doc_id", F.get_json_object("line", "$.id").alias("id"))
    return prompts.default_ids(named, ["doc_id"])


@query(
    "prompt_system_by_language",
    f"""SELECT doc_id, 0::BIGINT AS j, 'system' AS role, CASE WHEN lang = 'en' THEN {sql_text(prompts.SYSTEM_MESSAGES['english'])}
          ELSE {sql_text(prompts.SYSTEM_MESSAGES['chinese'])} END AS content FROM documents
        UNION ALL SELECT doc_id, 1, 'user', text FROM documents""",
)
def prompt_system_by_language(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("lang") == "en", "english").otherwise("chinese").alias("language"),
        F.col("text").alias("prompt"),
    )
    shaped = prompts.to_messages(docs, "language")
    return shaped.select("doc_id", F.posexplode("messages").alias("j", "m")).select(
        "doc_id", F.col("j").cast("bigint").alias("j"), "m.role", "m.content"
    )


RESPONSES = """SELECT 'doc-' || doc_id || '_' || k AS id, k, r AS response FROM (
    SELECT doc_id, 0::BIGINT AS k, '  ' || input || chr(10) AS r FROM z_doc
    UNION ALL SELECT doc_id, 1, CASE WHEN doc_id % 4 = 0 THEN ' ' || chr(10) || ' ' ELSE output END FROM z_doc)"""
TRIMMED = f"SELECT id, k, regexp_replace(response, '^\\s+|\\s+$', '', 'g') AS response FROM ({RESPONSES})"


@query("resp_explode_samples", RESPONSES)
def resp_explode_samples(spark, sf_dir):
    return prompts.explode_samples(fx.responses(spark, sf_dir))


@query("resp_drop_blank", f"SELECT * FROM ({TRIMMED}) WHERE response <> ''")
def resp_drop_blank(spark, sf_dir):
    return prompts.drop_blank(prompts.explode_samples(fx.responses(spark, sf_dir)))


@query(
    "join_prompt_response",
    f"""SELECT r.id, r.k, d.instruction AS prompt, r.response FROM ({TRIMMED}) r
        JOIN z_doc d ON 'doc-' || d.doc_id || '_' || r.k = r.id WHERE response <> ''""",
)
def join_prompt_response(spark, sf_dir):
    joined = prompts.join_responses(fx.document_prompts(spark, sf_dir), fx.responses(spark, sf_dir))
    return prompts.drop_blank(prompts.explode_samples(joined)).select("id", "k", "prompt", "response")


@query(
    "resp_to_conversation",
    f"""SELECT r.id || '_' || (1000 + ('0x' || substr(md5(r.id), 1, 8))::BIGINT % 9000) AS id, m.j::BIGINT AS j, m.speaker AS speaker, m.value AS value
        FROM (SELECT r.id, unnest([{{'j': 0, 'speaker': 'human', 'value': d.instruction}}, {{'j': 1, 'speaker': 'gpt', 'value': r.response}}]) AS m
              FROM ({TRIMMED}) r JOIN z_doc d ON 'doc-' || d.doc_id || '_' || r.k = r.id WHERE response <> '') r""",
)
def resp_to_conversation(spark, sf_dir):
    joined = prompts.join_responses(fx.document_prompts(spark, sf_dir), fx.responses(spark, sf_dir))
    rows = prompts.drop_blank(prompts.explode_samples(joined))
    return chat.unnest(prompts.to_conversation(rows))


# --- validation and rendering --------------------------------------------------


@query(
    "conv_validate_alternation",
    """SELECT conv_id, coalesce(min(turn) FILTER (bad), -1) AS first_fault_at, count(*) FILTER (bad) AS n_faults, count(*) AS n_messages,
              CASE WHEN count(*) FILTER (bad) = 0 THEN 'ok'
                   ELSE arg_min(CASE WHEN role = 'system' THEN 'unknown role' ELSE 'out of turn' END, turn) FILTER (bad) END AS status
       FROM (SELECT *, role <> CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS bad FROM conversations)
       GROUP BY conv_id""",
)
def conv_validate_alternation(spark, sf_dir):
    raw = fx.messages(spark, sf_dir)
    ok, rejects = chat.split_valid(raw, "role", "turn", ("user", "assistant"))
    sizes = raw.groupBy("conv_id").agg(F.count("*").alias("n_messages"))
    good = ok.groupBy("conv_id").agg(F.count("*").alias("n_messages")).select(
        "conv_id", F.lit(-1).cast("bigint").alias("first_fault_at"), F.lit(0).cast("bigint").alias("n_faults"),
        "n_messages", F.lit("ok").alias("status"),
    )
    bad = rejects.join(sizes, "conv_id").select(
        "conv_id", "first_fault_at", "n_faults", "n_messages", F.col("reason").alias("status")
    )
    return good.unionByName(bad)


@query(
    "chat_inject_system",
    f"""SELECT conv_id, j + 1 AS j, speaker, value FROM z_norm
        UNION ALL SELECT DISTINCT conv_id, 0, 'system', {sql_text(SYSTEM)} FROM z_norm""",
)
def chat_inject_system(spark, sf_dir):
    return chat.inject_system(fx.normal(spark, sf_dir), SYSTEM)


@query(
    "chat_render",
    f"""SELECT conv_id, j, speaker, {piece(ROLE, 'value')} AS piece,
               CASE WHEN speaker = 'human' THEN '{OPEN_}assistant' || chr(10) ELSE '' END AS generation_header FROM z_norm""",
)
def chat_render(spark, sf_dir):
    return chat.render(fx.normal(spark, sf_dir), add_generation_prompt=True)


@query(
    "chat_split_turns",
    f"""SELECT CAST(doc_id AS VARCHAR) AS id, 0::BIGINT AS round, '{OPEN_}user' || chr(10) || instruction || chr(10) || input AS asked,
               output || '{CLOSE_} AS answered FROM z_doc""",
)
def chat_split_turns(spark, sf_dir):
    chats = fx.document_chats(spark, sf_dir)
    return chat.split_turns(chats.select("id", chat.render_nested().alias("rendered")))


@query(
    "chat_context_prefix",
    f"""SELECT conv_id, j, piece AS question, j AS context_turns, CAST(upto - length(piece) AS BIGINT) AS context_chars,
               CAST(upto AS BIGINT) AS prompt_chars
        FROM (SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id ORDER BY j) AS upto
              FROM (SELECT conv_id, j, speaker, {piece(ROLE, 'value')} AS piece FROM z_norm))
        WHERE speaker = 'human'""",
)
def chat_context_prefix(spark, sf_dir):
    return chat.contexts(fx.normal(spark, sf_dir))
