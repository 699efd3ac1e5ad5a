"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions.columns import tokens_of
from turnwise.operators import chat, paths, tokens, vocab
from turnwise.operators.scale import lookup
from turnwise.operators.sharding import split_by_hash
from turnwise.plans.ctes import BEAM_DEPTH, BEAM_WIDTH
from turnwise.session import scratch_path, written

DRAFT_SIZE = 500
TURNS_PER_QUESTION = 4
STEPS = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- conversations -------------------------------------------------------------


def messages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def normal(spark, sf_dir) -> DataFrame:
    return chat.normalize(messages(spark, sf_dir))


def counts(spark, sf_dir) -> DataFrame:
    return tokens.token_counts(normal(spark, sf_dir))


def vocabulary(spark, sf_dir) -> DataFrame:
    return tokens.vocabulary(counts(spark, sf_dir))


def draft_top(spark, sf_dir) -> DataFrame:
    return vocab.top_n(vocab.target_frequency(counts(spark, sf_dir)), DRAFT_SIZE)


def draft_map(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, draft map)."""
    full = vocabulary(spark, sf_dir)
    return full, vocab.draft_map(vocab.top_n(vocab.target_frequency(full), DRAFT_SIZE), full)


def sequences(spark, sf_dir, max_len: int = tokens.MAX_LEN) -> DataFrame:
    return tokens.sequences(normal(spark, sf_dir), vocabulary(spark, sf_dir), max_len)


# --- documents as instructions and prompts -------------------------------------


def instructions(spark, sf_dir) -> DataFrame:
    """First line, second line and the rest of each document."""
    lines = F.split("text", "\n", 3)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.get(lines, F.lit(0)).alias("instruction"),
        F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("input"),
        F.coalesce(F.get(lines, F.lit(2)), F.lit("")).alias("output"),
    )


def document_chats(spark, sf_dir) -> DataFrame:
    rows = chat.from_instructions(instructions(spark, sf_dir))
    return rows.select(F.col("doc_id").cast("string").alias("id"), "conversations")


def document_messages(spark, sf_dir) -> DataFrame:
    """Documents as message arrays: some start with a system message, some with an
    assistant message."""
    def m(role: str, text: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), text.alias("content"))

    rows = instructions(spark, sf_dir)
    asked, said = m("user", F.col("instruction")), m("assistant", F.col("output"))
    kind = F.pmod("doc_id", F.lit(5))
    shaped = (
        F.when(kind == 0, F.array(m("system", F.col("input")), asked, said))
        .when(kind == 1, F.array(m("assistant", F.col("input")), asked, said))
        .when(kind == 2, F.array(m("assistant", F.col("output"))))
        .otherwise(F.array(asked, said))
    )
    return rows.select("doc_id", shaped.alias("messages"))


def prompt_lines(spark, sf_dir) -> DataFrame:
    """(doc_id, line): JSON prompt lines with mixed keys; some have no id, some no
    prompt key, some are cut short, some are blank."""
    docs = table(spark, sf_dir, "documents")
    third = F.pmod("doc_id", F.lit(3))
    keyless = F.pmod("doc_id", F.lit(19)) == 7

    def under(key: int) -> Column:
        return F.when((third == key) & ~keyless, F.col("text"))

    line = F.to_json(
        F.struct(
            F.when(F.pmod("doc_id", F.lit(11)) != 0, F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("id"),
            under(0).alias("prompt"),
            under(1).alias("instruction"),
            under(2).alias("question"),
            F.when(keyless, F.col("text")).alias("text"),
        )
    )
    cut = F.left(line, F.length(line) - 1)
    return docs.select(
        "doc_id",
        "lang",
        F.when(F.pmod("doc_id", F.lit(17)) == 3, F.lit(" "))
        .when(F.pmod("doc_id", F.lit(13)) == 5, cut)
        .otherwise(line)
        .alias("line"),
    )


def responses(spark, sf_dir) -> DataFrame:
    """Sampled responses to the documents: two samples, of which some are blank."""
    rows = instructions(spark, sf_dir)
    return rows.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        F.array(
            F.concat(F.lit("  "), "input", F.lit("\n")),
            F.when(F.pmod("doc_id", F.lit(4)) == 0, F.lit(" \n ")).otherwise(F.col("output")),
        ).alias("samples"),
    )


def document_prompts(spark, sf_dir) -> DataFrame:
    return instructions(spark, sf_dir).select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        F.col("instruction").alias("prompt"),
    )


# --- answer logs ---------------------------------------------------------------


def question_id() -> Column:
    """Four consecutive messages of a conversation form one question of at most two
    answers, so a record stays small however long the conversation is."""
    return F.col("conv_id") * 1000000000 + F.floor(F.col("turn") / TURNS_PER_QUESTION)


def answers(spark, sf_dir) -> DataFrame:
    """Nested answer log of a baseline and a draft model; every tenth conversation has
    a later draft record in which generation failed."""
    said = messages(spark, sf_dir).filter("role = 'assistant'").select(
        "conv_id", "turn", "text", question_id().alias("question_id"),
        F.size(tokens_of("text")).cast("bigint").alias("n"),
    )
    passes = F.ceil(F.col("n") / (1 + F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))))

    def record(model: str, run: str, text, n, idx, seconds) -> Column:
        return F.struct(
            F.lit(model).alias("model_id"),
            F.concat(F.lit(f"{model}{run}-"), F.col("question_id").cast("string")).alias("answer_id"),
            (F.col("question_id") + (1000000 if run else 0)).cast("double").alias("tstamp"),
            text.alias("text"),
            n.cast("int").alias("n"),
            idx.cast("int").alias("idx"),
            seconds.alias("seconds"),
        )

    n = F.col("n")
    runs = F.array(
        record("base", "", F.col("text"), n, n - 1, n * 0.025),
        record("draft", "", F.col("text"), n, passes - 1, passes * 0.03),
    )
    failed = F.array(record("draft", "-retry", F.lit("ERROR"), F.lit(1), F.lit(0), F.lit(0.03)))
    runs = F.when(F.pmod("conv_id", F.lit(10)) == 0, F.concat(runs, failed)).otherwise(runs)
    rows = said.select("question_id", "turn", F.col("n").alias("n_said"), F.inline(runs))
    packed = rows.groupBy("question_id", "answer_id", "model_id", "tstamp").agg(
        F.sort_array(F.collect_list(F.struct("turn", "text", "n", "idx", "seconds", "n_said"))).alias("s")
    )
    last = F.element_at("s", -1)["n_said"]
    depths = F.sequence(F.lit(0), F.lit(4))

    def choice(index: int, texts) -> Column:
        return F.struct(
            F.lit(index).alias("index"),
            texts.alias("turns"),
            F.col("s.idx").alias("idxs"),
            F.col("s.n").alias("new_tokens"),
            F.col("s.seconds").alias("wall_time"),
            F.transform(depths, lambda d: F.floor(last / (d + 2)).cast("double")).alias("alpha"),
            F.transform(depths, lambda d: last.cast("double")).alias("alpha_num"),
        )

    first = choice(0, F.col("s.text"))
    second = choice(1, F.transform("s.text", lambda x: F.concat(F.lit("> "), x)))
    choices = F.when(F.col("model_id") == "draft", F.array(first, second)).otherwise(F.array(first))
    return packed.select("question_id", "answer_id", "model_id", choices.alias("choices"), "tstamp")


def latest(spark, sf_dir) -> DataFrame:
    from turnwise.operators.answers import dedup_last

    return dedup_last(answers(spark, sf_dir))


def questions(spark, sf_dir) -> DataFrame:
    """(question_id, conv_id, q): the user texts of each question, one per answer."""
    said = messages(spark, sf_dir)
    asked = said.filter("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked")
    )
    heard = said.filter("role = 'assistant'").select("conv_id", "turn", question_id().alias("question_id"))
    both = heard.join(asked, ["conv_id", "turn"], "left")
    return both.groupBy("question_id", "conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", F.coalesce("asked", F.lit("")).alias("asked")))).alias("s")
    ).select("question_id", "conv_id", F.col("s.asked").alias("q"))


def judge_rows(spark, sf_dir) -> DataFrame:
    """One row per question: the questions asked, both models' answers, and the keys by
    which a template is chosen."""
    log = latest(spark, sf_dir).select("question_id", "model_id", F.get("choices", F.lit(0))["turns"].alias("turns"))
    a = log.filter("model_id = 'base'").select("question_id", F.col("turns").alias("a"))
    b = log.filter("model_id = 'draft'").select("question_id", F.col("turns").alias("b"))
    return questions(spark, sf_dir).join(a, "question_id").join(b, "question_id").select(
        "question_id",
        F.lit("pairwise").alias("type"),
        F.when(F.pmod("conv_id", F.lit(3)) == 0, "math").otherwise("general").alias("category"),
        (F.size("q") > 1).alias("multi_turn"),
        "q",
        "a",
        "b",
    )


# Template names, types, categories and answer formats of a judge file.
# The wording is our own.
_PAIR = "Question:\n{question}\n\nAnswer A:\n{answer_a}\n\nAnswer B:\n{answer_b}"
_PAIR_REF = "Question:\n{question}\n\nReference:\n{ref_answer_1}\n\nAnswer A:\n{answer_a}\n\nAnswer B:\n{answer_b}"
_TALK = "Q1: {question_1}\n%s1: {answer_%s1}\nQ2: {question_2}\n%s2: {answer_%s2}"
_TALK_A, _TALK_B = _TALK % ("A", "a_", "A", "a_"), _TALK % ("B", "b_", "B", "b_")
_TALK_ONE = _TALK % ("A", "", "A", "")
_REFS = "Q1: {question_1}\nR1: {ref_answer_1}\nQ2: {question_2}\nR2: {ref_answer_2}\n\n"
_ONE = "Question:\n{question}\n\nAnswer:\n{answer}"
_ONE_REF = "Question:\n{question}\n\nReference:\n{ref_answer_1}\n\nAnswer:\n{answer}"
JUDGE_TEMPLATES = [
    ("pair-v2", "pairwise", "general", _PAIR, "[[A]]"),
    ("pair-v2-multi-turn", "pairwise", "general", _TALK_A + "\n\n" + _TALK_B, "[[A]]"),
    ("pair-math-v1", "pairwise", "math", _PAIR_REF, "[[A]]"),
    ("pair-math-v1-multi-turn", "pairwise", "math", _REFS + _TALK_A + "\n\n" + _TALK_B, "[[A]]"),
    ("single-v1", "single", "general", _ONE, "[[rating]]"),
    ("single-math-v1", "single", "math", _ONE_REF, "[[rating]]"),
    ("single-v1-multi-turn", "single", "general", _TALK_ONE, "[[rating]]"),
    ("single-math-v1-multi-turn", "single", "math", _REFS + _TALK_ONE, "[[rating]]"),
]


def judge_template_file(spark) -> str:
    path = scratch_path(spark, "judge-templates")
    spark.createDataFrame(
        [(n, t, "You are a judge.", p, n, c, o) for n, t, c, p, o in JUDGE_TEMPLATES],
        "name string, type string, system_prompt string, prompt_template string, "
        "description string, category string, output_format string",
    ).write.json(path)
    return path


# --- predictions ---------------------------------------------------------------


def positions(spark, sf_dir) -> DataFrame:
    """Assistant positions that have a next token: (conv_id, split, turn, pos, token, next)."""
    said = split_by_hash(messages(spark, sf_dir).filter("role = 'assistant'"), "conv_id")
    toks = said.select("conv_id", "split", "turn", tokens_of("text").alias("toks"))
    n = F.greatest(F.size("toks") - 1, F.lit(0))
    pair = F.arrays_zip(
        F.slice("toks", F.lit(1), n).alias("token"), F.slice("toks", F.lit(2), n).alias("next")
    )
    return toks.select("conv_id", "split", "turn", F.posexplode(pair).alias("pos", "e")).select(
        "conv_id", "split", "turn", F.col("pos").cast("bigint").alias("pos"), "e.token", "e.next"
    )


def starts(spark, sf_dir, ahead: int) -> DataFrame:
    """Every assistant position with the ``ahead`` tokens that follow it, null past the
    end of the answer."""
    said = split_by_hash(messages(spark, sf_dir).filter("role = 'assistant'"), "conv_id")
    toks = said.select("conv_id", "split", "turn", tokens_of("text").alias("toks"))
    # Shifted copies side by side: no row carries the whole text along, and no lambda
    # keeps the scan out of generated code.
    n = F.greatest(F.size("toks"), F.lit(1))
    shifts = [F.slice("toks", F.lit(k + 1), n).alias(f"a{k}") for k in range(1, ahead + 1)]
    at = toks.select(
        "conv_id", "split", "turn", F.posexplode(F.arrays_zip(F.col("toks").alias("token"), *shifts)).alias("pos", "e")
    )
    return at.select(
        "conv_id", "split", "turn", F.col("pos").cast("bigint").alias("pos"), "e.token",
        F.array(*[F.col(f"e.a{k}") for k in range(1, ahead + 1)]).alias("ahead"),
    )


def pair_counts(spark, sf_dir, *by: str) -> DataFrame:
    """Counted (token, next) pairs, kept as a table: every later step works on the
    distinct pairs and the corpus is read once. ``position`` is the place in the answer,
    counted up to the last draft step."""
    at = positions(spark, sf_dir).withColumn("position", F.least("pos", F.lit(STEPS - 1).cast("bigint")))
    return written(at.groupBy(*by, "token", "next").agg(F.count("*").alias("c")), "pairs")


def all_pairs(spark, sf_dir) -> DataFrame:
    return pair_counts(spark, sf_dir)


def trained(pairs: DataFrame) -> DataFrame:
    return pairs.filter("split = 'train'").groupBy("token", "next").agg(F.sum("c").alias("c"))


def scored_pairs(pairs: DataFrame, k: int, *by: str) -> DataFrame:
    """Counted pairs with the k best trained predictions for their first token:
    (by, token, next, n, ranked)."""
    best = paths.successors(trained(pairs), k).select("token", F.col("best.token").alias("ranked"))
    return lookup(pairs.withColumnRenamed("c", "n"), best, ["token"], [*by, "token", "next"])


def answer_places(spark, sf_dir) -> DataFrame:
    """(places): the number of token positions in all answers, as one row."""
    said = messages(spark, sf_dir).filter("role = 'assistant'")
    return said.agg(F.sum(F.size(tokens_of("text"))).alias("places"))


def train_successors(spark, sf_dir, k: int, within: DataFrame | None = None) -> DataFrame:
    """The best followers of each token; only tokens of ``within``, if it is given."""
    pairs = trained(pair_counts(spark, sf_dir, "split"))
    if within is not None:
        pairs = pairs.join(within.select(F.col("token").alias("next")), "next", "left_semi")
    return written(paths.successors(pairs.select("token", "next", "c"), k), "train-successors")


def chains(firsts: DataFrame, steps: int) -> DataFrame:
    """(token, chain, total): greedy chains and how often their first token occurs."""
    return paths.greedy_chains(firsts, steps).join(firsts.select("token", "total"), "token")


def chain_log(spark, sf_dir, steps: int = 5, within: DataFrame | None = None) -> DataFrame:
    """(split, hits, masks) per start position, one slot per draft step."""
    at = starts(spark, sf_dir, steps)
    drafts = chains(train_successors(spark, sf_dir, 1, within), steps)
    found = lookup(at, drafts, ["token"], ["conv_id", "turn", "pos"], weight="total")
    drafted = F.coalesce("chain", F.array().cast("array<string>"))
    ks = [F.lit(k) for k in range(steps)]
    hits = F.array(*[F.when(F.get(drafted, k) == F.get("ahead", k), 1).otherwise(0) for k in ks])
    masks = F.array(*[F.when(F.get("ahead", k).isNotNull(), 1).otherwise(0) for k in ks])
    return found.select("conv_id", "split", "turn", "pos", hits.alias("hits"), masks.alias("masks"))


def candidates(spark, sf_dir) -> DataFrame:
    """Every start with two drafts of up to four tokens and the tokens that follow:
    (conv_id, turn, pos, drafts, ahead)."""
    firsts = train_successors(spark, sf_dir, 2)
    step = chains(firsts, 3).select(F.col("token").alias("head"), "chain")
    at = firsts.select("token", "total", F.explode("best").alias("b")).select(
        "token", "total", F.col("b.rank").alias("rank"), F.col("b.token").alias("head")
    )
    grown = lookup(at, step, ["head"], ["token", "rank"])
    draft = F.concat(F.array("head"), F.coalesce("chain", F.array().cast("array<string>")))
    drafts = grown.groupBy("token", "total").agg(
        F.sort_array(F.collect_list(F.struct("rank", draft.alias("d")))).alias("s")
    )
    drafts = drafts.select("token", "total", F.col("s.d").alias("drafts"))
    return lookup(
        starts(spark, sf_dir, 4), drafts, ["token"], ["conv_id", "turn", "pos"], weight="total", how="inner"
    )


def path_nodes(spark, sf_dir, best: int | None = None, scored: bool = True) -> DataFrame:
    firsts = written(paths.successors(all_pairs(spark, sf_dir), BEAM_WIDTH), "path-successors")
    return paths.expand_top_k(firsts.select("token"), firsts, BEAM_DEPTH, BEAM_WIDTH, best, scored)


# --- metric log ----------------------------------------------------------------


def metric_log(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("run"), F.pmod("user_id", F.lit(4)).cast("string")).alias("run"),
        F.dayofmonth("ts").cast("bigint").alias("epoch"),
        F.when(F.pmod("event_id", F.lit(5)) == 0, "eval").otherwise("train").alias("split"),
        F.pmod("event_id", F.lit(3)).alias("worker"),
        F.col("event_id").alias("batch"),
        F.col("event_type").alias("position"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("acc"),
        F.col("value").alias("loss"),
        (F.col("value") >= 1.0).alias("ok"),
        F.expr("CAST(convert_timezone('UTC', current_timezone(), ts) AS timestamp)").alias("ts"),
    )
