"""Queries on answer logs, speed and acceptance, judge prompts and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions import columns as C
from turnwise.operators import answers as A
from turnwise.operators import chat, judge, metrics
from turnwise.plans import fixtures as fx
from turnwise.plans.registry import query
from turnwise.session import scratch_path
from turnwise.sources import readers, schemas, writers
from turnwise.streaming import flows

TURN = "CAST(t AS BIGINT) AS t, text, CAST(idx AS BIGINT) AS idx, CAST(new_tokens AS BIGINT) AS new_tokens, round(wall_time, 6) AS wall_time"


def turns_of(answers):
    return A.explode_turns(A.first_choice(answers).drop("choices"))


def rounded(df, *names, nudge=0.0):
    """Round for comparison. Means of values with two decimals often lie exactly half
    way; ``nudge`` moves them off it, so that the order of a sum does not show."""
    return df.withColumns({n: F.round(F.col(n) + nudge if nudge else F.col(n), 6) for n in names})


def answer_files(spark, sf_dir) -> str:
    path = scratch_path(spark, "answers")
    writers.append_answers(fx.answers(spark, sf_dir), path)
    return path


# --- log shape -----------------------------------------------------------------


@query("src_answer_logs", f"SELECT model_id, question_id, answer_id, tstamp, {TURN} FROM z_log")
def src_answer_logs(spark, sf_dir):
    path = scratch_path(spark, "answer-log")
    writers.write_jsonl(fx.answers(spark, sf_dir), path)
    log = readers.read_answers(spark, [path]).drop("file")
    return rounded(turns_of(log), "wall_time")


@query(
    "sink_answers_append",
    "SELECT model_id, question_id, answer_id, tstamp, count(*) AS n_turns FROM z_log GROUP BY ALL",
)
def sink_answers_append(spark, sf_dir):
    log = fx.answers(spark, sf_dir)
    path = scratch_path(spark, "appended")
    writers.append_answers(log.filter("answer_id not like '%retry%'"), path)
    writers.append_answers(log.filter("answer_id like '%retry%'"), path)
    back = spark.read.schema(schemas.ANSWER).json(path)
    return back.select(
        "model_id", "question_id", "answer_id", "tstamp",
        F.size(F.get("choices", F.lit(0))["turns"]).cast("bigint").alias("n_turns"),
    )


@query("ans_first_choice", f"SELECT model_id, question_id, answer_id, tstamp, {TURN} FROM z_log")
def ans_first_choice(spark, sf_dir):
    return rounded(turns_of(fx.answers(spark, sf_dir)), "wall_time")


@query("ans_explode_turns", f"SELECT model_id, question_id, answer_id, tstamp, {TURN} FROM z_latest")
def ans_explode_turns(spark, sf_dir):
    return rounded(turns_of(fx.latest(spark, sf_dir)), "wall_time")


@query(
    "ans_explode_choices",
    """SELECT model_id, question_id, answer_id, tstamp, index::BIGINT AS index, t, CASE index WHEN 0 THEN text ELSE '> ' || text END AS text
       FROM (SELECT *, unnest(CASE model_id WHEN 'draft' THEN [0, 1] ELSE [0] END) AS index FROM z_log)""",
)
def ans_explode_choices(spark, sf_dir):
    each = A.explode_turns(A.explode_choices(fx.answers(spark, sf_dir)))
    return each.select("model_id", "question_id", "answer_id", "tstamp", "index", "t", "text")


@query(
    "ans_dedup_last",
    "SELECT DISTINCT model_id, question_id, answer_id, tstamp FROM z_latest",
)
def ans_dedup_last(spark, sf_dir):
    return fx.latest(spark, sf_dir).select("model_id", "question_id", "answer_id", "tstamp")


@query("ans_sorted", "SELECT DISTINCT model_id, question_id, answer_id, tstamp FROM z_latest ORDER BY question_id, model_id")
def ans_sorted(spark, sf_dir):
    return A.sort_answers(fx.latest(spark, sf_dir).select("model_id", "question_id", "answer_id", "tstamp"))


@query(
    "ans_tag_run",
    """SELECT DISTINCT question_id, model_id || '-temperature-0.0' AS model_id, model_id AS name, '0.0' AS temperature FROM z_log""",
)
def ans_tag_run(spark, sf_dir):
    tagged = A.tag_run(fx.answers(spark, sf_dir).select("model_id", "question_id").distinct(), "0.0")
    name, temperature = A.run_of("model_id")
    return tagged.select("question_id", "model_id", name.alias("name"), temperature.alias("temperature"))


@query(
    "ans_error_rows",
    """SELECT model_id, count(*) FILTER (text = 'ERROR') AS n_errors, count(*) AS n_turns,
              round(count(*) FILTER (text = 'ERROR') / count(*), 6) AS error_rate FROM z_latest GROUP BY model_id""",
)
def ans_error_rows(spark, sf_dir):
    return rounded(A.error_rate(turns_of(fx.latest(spark, sf_dir))), "error_rate")


# --- text clean-up -------------------------------------------------------------

LENGTHS = "SELECT conv_id, turn, list_transform(regexp_extract_all(text, '[^ \\n]+'), lambda x: length(x)) AS ids FROM conversations WHERE role = 'assistant'"


def _lengths(spark, sf_dir):
    """Token lengths stand in for token ids."""
    said = fx.messages(spark, sf_dir).filter("role = 'assistant'")
    return said.select("conv_id", "turn", F.transform(C.tokens_of("text"), F.length).alias("ids"))


def _as_text(df):
    return df.select(
        "conv_id", "turn", F.size("ids").cast("bigint").alias("n"),
        F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"),
    )


@query(
    "ans_cut_stop_token",
    f"""SELECT conv_id, turn, CAST(len(kept) AS BIGINT) AS n, array_to_string(kept, ' ') AS ids FROM (
          SELECT *, CASE WHEN hit IS NULL THEN ids ELSE ids[:hit - 1] END AS kept FROM (
            SELECT *, least(nullif(list_position(ids, 13), 0), nullif(list_position(ids, 14), 0)) AS hit FROM ({LENGTHS})))""",
)
def ans_cut_stop_token(spark, sf_dir):
    rows = _lengths(spark, sf_dir)
    return _as_text(rows.withColumn("ids", C.cut_before_stop("ids", [13, 14])))


@query(
    "ans_cut_eos_inclusive",
    f"""SELECT conv_id, turn, CAST(len(kept) AS BIGINT) AS n, array_to_string(kept, ' ') AS ids FROM (
          SELECT *, CASE WHEN hit IS NULL THEN ids ELSE ids[:hit] END AS kept FROM (
            SELECT *, nullif(list_position(ids, 13), 0) AS hit FROM ({LENGTHS})))""",
)
def ans_cut_eos_inclusive(spark, sf_dir):
    rows = _lengths(spark, sf_dir)
    return _as_text(rows.withColumn("ids", C.cut_after_eos("ids", 13)))


@query(
    "ans_cut_stop_string",
    """SELECT conv_id, turn, CASE WHEN instr(text, '. ') > 1 THEN left(text, instr(text, '. ') - 1) ELSE text END AS text
       FROM conversations WHERE role = 'assistant'""",
)
def ans_cut_stop_string(spark, sf_dir):
    said = fx.messages(spark, sf_dir).filter("role = 'assistant'")
    return said.select("conv_id", "turn", C.cut_stop_string("text", ". ").alias("text"))


@query(
    "ans_strip_special",
    """SELECT conv_id, turn, regexp_replace(role || chr(10) || text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations""",
)
def ans_strip_special(spark, sf_dir):
    marked = fx.messages(spark, sf_dir).select("conv_id", "turn", chat.turn_text(F.col("role"), F.col("text")).alias("text"))
    return marked.withColumn("text", C.strip_special("text", ["<|im_start|>", "<|im_end|>"]))


@query(
    "ans_strip_prefix",
    "SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE role = 'assistant'",
)
def ans_strip_prefix(spark, sf_dir):
    said = fx.messages(spark, sf_dir).filter("role = 'assistant'")
    marked = said.select("conv_id", "turn", F.concat(F.lit("Assistant: "), "text").alias("text"))
    return marked.withColumn("text", C.strip_prefix("text", "Assistant:"))


# --- speed and acceptance ------------------------------------------------------


@query(
    "alpha_by_depth",
    """SELECT model_id, depth, sum(floor(n_said / (depth + 2))) AS accepted, CAST(sum(n_said) AS DOUBLE) AS tried,
              round_even(sum(floor(n_said / (depth + 2))) / sum(n_said), 2) AS alpha
       FROM (SELECT *, unnest(range(0, 5)) AS depth FROM z_latest WHERE is_last) GROUP BY model_id, depth""",
)
def alpha_by_depth(spark, sf_dir):
    return metrics.alpha_by_depth(fx.latest(spark, sf_dir))


@query(
    "alpha_by_turn",
    """SELECT model_id, t AS turn, depth, sum(floor(new_tokens / (depth + 2))) AS accepted, CAST(sum(new_tokens) AS DOUBLE) AS tried,
              round_even(sum(floor(new_tokens / (depth + 2))) / nullif(sum(new_tokens), 0), 2) AS alpha
       FROM (SELECT *, unnest(range(0, 5)) AS depth FROM z_latest) GROUP BY model_id, t, depth""",
)
def alpha_by_turn(spark, sf_dir):
    """A log that keeps the counters of every turn: five slots a turn, one turn behind the other."""
    answers = A.first_choice(fx.latest(spark, sf_dir))

    def slots(one):
        depths = F.sequence(F.lit(0), F.lit(4))
        return F.flatten(F.transform("choice.new_tokens", lambda n: F.transform(depths, lambda d: one(n, d).cast("double"))))

    counted = F.col("choice").withField("alpha", slots(lambda n, d: F.floor(n / (d + 2)))).withField(
        "alpha_num", slots(lambda n, d: n)
    )
    return metrics.alpha_by_depth(answers.withColumn("choices", F.array(counted)), depths=5, by_turn=True)


@query("speed_per_question", "SELECT model_id, question_id, tokens, round(seconds, 6) AS seconds, round(rate, 6) AS rate FROM z_speed")
def speed_per_question(spark, sf_dir):
    return rounded(metrics.question_speeds(fx.latest(spark, sf_dir)), "seconds", "rate")


@query(
    "speed_baseline_tokens",
    """SELECT question_id, CAST(sum(len(regexp_extract_all(text, '[^ \\n]+'))) AS BIGINT) AS tokens
       FROM z_latest WHERE model_id = 'base' GROUP BY question_id""",
)
def speed_baseline_tokens(spark, sf_dir):
    base = fx.latest(spark, sf_dir).filter("model_id = 'base'")
    return metrics.question_speeds(base, metrics.recounted_tokens()).select("question_id", "tokens")


@query(
    "speed_ratio",
    """SELECT round(d, 6) AS draft_rate, round(b, 6) AS baseline_rate, round(d / b, 6) AS ratio FROM (
         SELECT avg(rate) FILTER (model_id = 'draft') AS d, avg(rate) FILTER (model_id = 'base') AS b FROM z_speed)""",
)
def speed_ratio(spark, sf_dir):
    speeds = metrics.question_speeds(fx.latest(spark, sf_dir))
    return rounded(metrics.speed_ratio(speeds, "draft", "base"), "draft_rate", "baseline_rate", "ratio")


@query(
    "speed_totals",
    "SELECT model_id, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(seconds), 6) AS seconds, count(*) AS questions FROM z_speed GROUP BY model_id",
)
def speed_totals(spark, sf_dir):
    return rounded(metrics.speed_totals(metrics.question_speeds(fx.latest(spark, sf_dir))), "seconds")


@query(
    "speed_compare_keyed",
    """SELECT question_id, round(d.rate, 6) AS draft_rate, round(b.rate, 6) AS baseline_rate, round(d.rate / b.rate, 6) AS ratio
       FROM z_speed d JOIN z_speed b USING (question_id) WHERE d.model_id = 'draft' AND b.model_id = 'base'""",
)
def speed_compare_keyed(spark, sf_dir):
    speeds = metrics.question_speeds(fx.latest(spark, sf_dir))
    return rounded(metrics.speed_by_question(speeds, "draft", "base"), "draft_rate", "baseline_rate", "ratio")


@query(
    "compression_ratio",
    """SELECT model_id, CAST(sum(new_tokens) AS BIGINT) AS new_tokens, CAST(sum(idx + 1) AS BIGINT) AS passes,
              round(sum(new_tokens) / sum(idx + 1), 6) AS compression
       FROM z_log WHERE text <> 'ERROR' GROUP BY model_id""",
)
def compression_ratio(spark, sf_dir):
    turns = turns_of(fx.answers(spark, sf_dir)).filter("text <> 'ERROR'")
    return rounded(metrics.compression_ratio(turns), "compression")


@query(
    "join_question_answer",
    """SELECT question_id, model_id, t, u.text AS question, l.text AS answer FROM z_latest l JOIN z_said s USING (question_id, turn)
       JOIN conversations u ON u.conv_id = s.conv_id AND u.turn = s.turn - 1""",
)
def join_question_answer(spark, sf_dir):
    log = A.first_choice(fx.latest(spark, sf_dir)).select("question_id", "model_id", F.col("choice.turns").alias("answers"))
    both = A.join_questions(fx.questions(spark, sf_dir), log)
    turns = F.arrays_zip(F.col("q").alias("question"), F.col("answers").alias("answer"))
    return both.select("question_id", "model_id", F.posexplode(turns).alias("t", "e")).select(
        "question_id", "model_id", F.col("t").cast("bigint").alias("t"), "e.question", "e.answer"
    )


# --- judge ---------------------------------------------------------------------


@query(
    "src_judge_templates",
    "SELECT name, type, category, CAST(coalesce(n, 0) AS BIGINT) AS n_questions FROM ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS name, '{t}' AS type, '{c}' AS category, {t == 'pairwise'} AS pairwise, {c == 'math'} AS math, {n.endswith('-multi-turn')} AS multi"
        for n, t, c, _, _ in fx.JUDGE_TEMPLATES
    )
    + ") x LEFT JOIN (SELECT math, multi, true AS pairwise, count(*) AS n FROM z_judge GROUP BY 1, 2) USING (math, multi, pairwise)",
)
def src_judge_templates(spark, sf_dir):
    templates = readers.read_judge_templates(spark, fx.judge_template_file(spark))
    used = judge.select_template(fx.judge_rows(spark, sf_dir), templates).groupBy("name").agg(F.count("*").alias("n"))
    return templates.join(used, "name", "left").select(
        "name", "type", "category", F.coalesce("n", F.lit(0)).alias("n_questions")
    )


@query(
    "judge_select_template",
    """SELECT question_id, CASE WHEN math THEN 'pair-math-v1' ELSE 'pair-v2' END || CASE WHEN multi THEN '-multi-turn' ELSE '' END AS name
       FROM z_judge""",
)
def judge_select_template(spark, sf_dir):
    templates = readers.read_judge_templates(spark, fx.judge_template_file(spark))
    return judge.select_template(fx.judge_rows(spark, sf_dir), templates).select("question_id", "name")


_A = "'Q1: ' || q[1] || chr(10) || 'A1: ' || a[1] || chr(10) || 'Q2: ' || q[2] || chr(10) || 'A2: ' || a[2]"
_B = "'Q1: ' || q[1] || chr(10) || 'B1: ' || b[1] || chr(10) || 'Q2: ' || q[2] || chr(10) || 'B2: ' || b[2]"
_R = "'Q1: ' || q[1] || chr(10) || 'R1: ' || a[1] || chr(10) || 'Q2: ' || q[2] || chr(10) || 'R2: ' || a[2]"
_NN = "chr(10) || chr(10)"
_Q = f"'Question:' || chr(10) || q[1] || {_NN}"
_AB = f"'Answer A:' || chr(10) || a[1] || {_NN} || 'Answer B:' || chr(10) || b[1]"


@query(
    "judge_render",
    f"""SELECT question_id, CASE
          WHEN multi THEN CASE WHEN math THEN {_R} || {_NN} ELSE '' END || {_A} || {_NN} || {_B}
          ELSE {_Q} || CASE WHEN math THEN 'Reference:' || chr(10) || a[1] || {_NN} ELSE '' END || {_AB} END AS prompt
        FROM z_judge""",
)
def judge_render(spark, sf_dir):
    """The baseline's answer doubles as the reference answer."""
    templates = readers.read_judge_templates(spark, fx.judge_template_file(spark))
    rows = judge.select_template(fx.judge_rows(spark, sf_dir), templates)

    def at(name, i):
        return F.coalesce(F.get(name, F.lit(i)), F.lit(""))

    values = {"question": at("q", 0), "answer_a": at("a", 0), "answer_b": at("b", 0), "answer": at("b", 0)}
    for i in (1, 2):
        values |= {
            f"question_{i}": at("q", i - 1),
            f"ref_answer_{i}": at("a", i - 1),
            f"answer_a_{i}": at("a", i - 1),
            f"answer_b_{i}": at("b", i - 1),
            f"answer_{i}": at("b", i - 1),
        }
    return rows.select("question_id", judge.fill_template(F.col("prompt_template"), values).alias("prompt"))


@query(
    "judge_pairs",
    """SELECT a.question_id, a.t, a.model_id AS model_a, b.model_id AS model_b, a.text AS answer_a, b.text AS answer_b
       FROM z_latest a JOIN z_latest b ON b.question_id = a.question_id AND b.t = a.t AND a.model_id < b.model_id""",
)
def judge_pairs(spark, sf_dir):
    return judge.judge_pairs(turns_of(fx.latest(spark, sf_dir)), "base")


def _verdicts(spark, sf_dir):
    pairs = judge.judge_pairs(turns_of(fx.latest(spark, sf_dir)), "base")
    kind = F.pmod(F.col("question_id") + F.col("t"), F.lit(4))
    letter = F.when(kind == 0, "[[A]]").when(kind == 1, "[[B]]").when(kind == 2, "[[C]]").otherwise("none")
    rating = F.concat(F.lit("Rating: [["), (F.lit(1) + F.pmod("question_id", F.lit(10))).cast("string"), F.lit("]]"))
    said = pairs.withColumn("judgment", F.concat_ws("\n", "answer_b", letter, rating))
    verdict, score = judge.parse_verdict("judgment")
    return said.select("question_id", "t", "model_a", "model_b", verdict.alias("verdict"), score.alias("rating"))


@query("judge_verdict_parse", "SELECT question_id, t, verdict, rating FROM z_verdict")
def judge_verdict_parse(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("question_id", "t", "verdict", "rating")


@query(
    "judge_verdict_counts",
    """SELECT 'base' AS model_a, 'draft' AS model_b, count(*) FILTER (verdict = 'A') AS a_wins, count(*) FILTER (verdict = 'B') AS b_wins,
              count(*) FILTER (verdict = 'C') AS ties, count(*) FILTER (verdict IS NULL) AS no_verdict,
              round(avg(rating), 6) AS mean_rating FROM z_verdict""",
)
def judge_verdict_counts(spark, sf_dir):
    return rounded(judge.verdict_counts(_verdicts(spark, sf_dir)), "mean_rating")


# --- streams -------------------------------------------------------------------


@query("stream_answers_upsert", f"SELECT model_id, question_id, answer_id, tstamp, {TURN} FROM z_latest")
def stream_answers_upsert(spark, sf_dir):
    source = scratch_path(spark, "stream-in")
    out = scratch_path(spark, "stream-out")
    writers.write_jsonl(fx.answers(spark, sf_dir), source)
    flows.upsert_answers(flows.answer_stream(spark, source), out, scratch_path(spark, "stream-state")).awaitTermination()
    return rounded(turns_of(flows.latest_answers(spark, out)), "wall_time")


@query(
    "stream_running_speed",
    """SELECT model_id AS session, CAST(sum(new_tokens) AS BIGINT) AS new_tokens, round(sum(wall_time), 6) AS seconds,
              CAST(sum(idx + 1) AS BIGINT) AS passes, round(sum(new_tokens) / sum(wall_time), 6) AS tokens_per_second,
              round(sum(new_tokens) / sum(idx + 1), 6) AS tokens_per_pass FROM z_log GROUP BY model_id""",
)
def stream_running_speed(spark, sf_dir):
    source, out = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    writers.write_jsonl(fx.answers(spark, sf_dir), source)
    stream = flows.answer_stream(spark, source)
    flows.running_speed(stream, "model_id", out, scratch_path(spark, "stream-state")).awaitTermination()
    return rounded(flows.session_speeds(spark, out), "seconds", "tokens_per_second", "tokens_per_pass")


@query(
    "stream_metric_rollup",
    """SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, run, position, round(avg(acc) + 1e-9, 6) AS acc, round(avg(loss) + 1e-9, 6) AS loss,
              round(stddev_pop(acc) + 1e-9, 6) AS acc_std, round(stddev_pop(loss) + 1e-9, 6) AS loss_std,
              count(*) AS n FROM z_metric GROUP BY ALL""",
)
def stream_metric_rollup(spark, sf_dir):
    """Events arrive in files by a hash, so in no order of time, and in several batches: most
    rows are late for windows that have closed by then."""
    source, out = scratch_path(spark, "metric-in"), scratch_path(spark, "metric-out")
    log = fx.metric_log(spark, sf_dir)
    log.repartition(8, F.xxhash64("batch")).write.parquet(source)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(source)
    flows.rollup_metrics(stream, out, scratch_path(spark, "metric-state"), delay=86400.0).awaitTermination()
    back = flows.rolled_up(spark, out)
    day = F.floor(F.unix_seconds("start") / 86400).alias("day")
    return rounded(
        back.select(day, "run", "position", "acc", "loss", "acc_std", "loss_std", "n"),
        "acc", "loss", "acc_std", "loss_std", nudge=1e-9,
    )


@query(
    "stream_closed_sessions",
    """WITH l AS (SELECT *, question_id // 1000000000 AS conv, (question_id // 1000000000) * 4 + question_id % 1000000000 + 1.0::DOUBLE AS second
                  FROM z_log WHERE answer_id NOT LIKE '%retry%'),
            s AS (SELECT model_id || '-' || conv AS session, sum(new_tokens)::BIGINT AS new_tokens, sum(wall_time) AS seconds,
                         sum(idx + 1)::BIGINT AS passes, min(second) AS started, max(second) AS ended FROM l GROUP BY ALL)
       SELECT session, new_tokens, round(seconds, 6) AS seconds, passes, started, ended,
              round(new_tokens / seconds, 6) AS tokens_per_second, round(new_tokens / passes, 6) AS tokens_per_pass
       FROM s WHERE ended + 8 <= (SELECT max(ended) - 1 FROM s)""",
)
def stream_closed_sessions(spark, sf_dir):
    """A conversation is a session, its questions a second apart; after eight idle seconds it is over."""
    source, out = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    conversation = F.floor(F.col("question_id") / 1000000000)
    at = conversation * 4 + F.pmod("question_id", F.lit(1000000000)) + F.lit(1.0)
    log = fx.answers(spark, sf_dir).filter("answer_id not like '%retry%'").withColumn("tstamp", at.cast("double"))
    writers.write_jsonl(log, source)
    stream = flows.answer_stream(spark, source, files_per_trigger=100_000)
    named = stream.withColumn("session", F.concat_ws("-", "model_id", conversation.cast("string")))
    closed = flows.closed_sessions(named, "session", idle=8, late=1)
    flows.write_closed(closed, out, scratch_path(spark, "stream-state")).awaitTermination()
    back = spark.read.schema(closed.schema).parquet(out)
    return rounded(back, "seconds", "tokens_per_second", "tokens_per_pass")
