"""Nested answer logs: one record per question, choices holding parallel per-turn arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("model_id", "question_id", "answer_id", "tstamp")


def dedup_last(answers: DataFrame) -> DataFrame:
    """The latest record of each (model, question). Time replaces file order; equal
    times fall back to the answer id."""
    latest = answers.groupBy("model_id", "question_id").agg(
        F.max(F.struct("tstamp", "answer_id")).alias("_last")
    )
    # Only keys are compared; of records equal in all keys one is taken at the end.
    winners = latest.select("model_id", "question_id", "_last.tstamp", "_last.answer_id")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"w.{k}")) for k in KEYS]
    kept = answers.alias("a").join(winners.alias("w"), on, "left_semi")
    return kept.dropDuplicates(list(KEYS))


def sort_answers(answers: DataFrame) -> DataFrame:
    return answers.orderBy("question_id", "model_id", "tstamp", "answer_id")


def first_choice(answers: DataFrame) -> DataFrame:
    return answers.withColumn("choice", F.get("choices", F.lit(0)))


def explode_choices(answers: DataFrame) -> DataFrame:
    """One row per sampled choice; ``index`` is the seed it was drawn with."""
    rest = [c for c in answers.columns if c != "choices"]
    return answers.select(*rest, F.explode("choices").alias("choice")).withColumn(
        "index", F.col("choice.index").cast("bigint")
    )


def explode_turns(with_choice: DataFrame) -> DataFrame:
    """One row per turn of a choice; where the arrays differ in length the shorter
    ones give null."""
    rest = [c for c in with_choice.columns if c != "choice"]
    fields = ("turns", "idxs", "new_tokens", "wall_time")
    zipped = F.arrays_zip(*[F.col(f"choice.{f}").alias(f) for f in fields])
    at = with_choice.select(*rest, F.posexplode(zipped).alias("t", "e"))
    return at.select(
        *rest,
        F.col("t").cast("bigint").alias("t"),
        F.col("e.turns").alias("text"),
        F.col("e.idxs").cast("bigint").alias("idx"),
        F.col("e.new_tokens").cast("bigint").alias("new_tokens"),
        F.col("e.wall_time").alias("wall_time"),
    )


def tag_run(answers: DataFrame, temperature: str) -> DataFrame:
    return answers.withColumn("model_id", F.concat("model_id", F.lit(f"-temperature-{temperature}")))


def run_of(model_id) -> tuple[Column, Column]:
    """Read model name and temperature back from a tagged model id."""
    pattern = r"^(.*)-temperature-([0-9.]+)$"
    return F.regexp_extract(model_id, pattern, 1), F.regexp_extract(model_id, pattern, 2)


def error_rate(turns: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Turns whose generation failed are logged as the text ERROR."""
    failed = F.count_if(F.col("text") == "ERROR")
    return turns.groupBy(*by).agg(
        failed.alias("n_errors"), F.count("*").alias("n_turns"), (failed / F.count("*")).alias("error_rate")
    )


def join_questions(questions: DataFrame, answers: DataFrame, how: str = "inner") -> DataFrame:
    return questions.join(answers, "question_id", how)
