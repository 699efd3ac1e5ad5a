"""Judge prompts: choose a template, fill it, read the verdict. No judge model is called."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATE_FIELDS = ("name", "type", "system_prompt", "prompt_template", "description", "category", "output_format")


def select_template(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """Join on type, category and whether the question has several turns.

    A template is for several turns when its name ends in ``-multi-turn``. The
    template file is a handful of rows, so Spark broadcasts it by its size.
    """
    keyed = templates.select(
        "name", "type", "category", "prompt_template", "output_format",
        F.endswith("name", F.lit("-multi-turn")).alias("multi_turn"),
    )
    return rows.join(keyed, ["type", "category", "multi_turn"])


def fill_template(template, values: dict[str, Column]) -> Column:
    """Put the values in place of their ``{name}`` marks in one pass, so that marks
    inside a value are left alone."""
    names = "|".join(values)
    parts = F.split(template, rf"(?=\{{(?:{names})\}})|(?<=\{{(?:{names})\}})")
    marks = F.create_map(*[x for n, v in values.items() for x in (F.lit("{" + n + "}"), v)])
    return F.array_join(
        F.transform(parts, lambda p: F.coalesce(F.try_element_at(marks, p), p)), ""
    )


def parse_verdict(text) -> tuple[Column, Column]:
    """([[A]], [[B]] or [[C]] as a letter; [[1]]..[[10]] as a number); null if absent."""
    letter = F.nullif(F.regexp_extract(text, r"\[\[([ABC])\]\]", 1), F.lit(""))
    rating = F.nullif(F.regexp_extract(text, r"\[\[(10|[1-9])\]\]", 1), F.lit(""))
    return letter, rating.cast("bigint")


def judge_pairs(turns: DataFrame, baseline: str, on: Sequence[str] = ("question_id", "t")) -> DataFrame:
    """Each model's answer next to the baseline model's answer to the same question.

    One row per challenger answer: the output grows with the answers, not with the
    square of the models.
    """
    a = turns.filter(F.col("model_id") == baseline).select(
        *on, F.col("model_id").alias("model_a"), F.col("text").alias("answer_a")
    )
    b = turns.filter(F.col("model_id") != baseline).select(
        *on, F.col("model_id").alias("model_b"), F.col("text").alias("answer_b")
    )
    return a.join(b, list(on))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """Wins, ties and unreadable verdicts per pair, and the mean rating."""
    letter = F.col("verdict")
    return verdicts.groupBy("model_a", "model_b").agg(
        F.count_if(letter == "A").alias("a_wins"),
        F.count_if(letter == "B").alias("b_wins"),
        F.count_if(letter == "C").alias("ties"),
        F.count_if(letter.isNull()).alias("no_verdict"),
        F.avg("rating").alias("mean_rating"),
    )
