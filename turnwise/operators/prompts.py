"""Prompts for synthetic data, and model responses back into training rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnwise.functions.columns import hash32, strip
from turnwise.operators.scale import number_rows

# The keys that may hold the prompt, in order of preference.
PROMPT_KEYS = ("prompt", "instruction", "question")

# The system message of each language.
SYSTEM_MESSAGES = {
    "chinese": (
        "你是一个有用、尊重和诚实的助手。请始终尽可能有帮助地回答，同时保持安全。"
        "你的回答不应包含任何有害、不道德、种族主义、性别歧视、有毒、危险或非法内容。"
        "请确保你的回答在社会上是公正和积极的。\n\n"
        "如果一个问题没有任何意义，或者在事实上不连贯，请解释为什么，而不是回答不正确的内容。"
        "如果你不知道问题的答案，请不要分享虚假信息。"
    ),
    "english": (
        "You are a helpful, respectful and honest assistant. Always answer as helpfully as possible, "
        "while being safe. Your answers should not include any harmful, unethical, racist, sexist, toxic, "
        "dangerous, or illegal content. Please ensure that your responses are socially unbiased and "
        "positive in nature.\n\n"
        "If a question does not make any sense, or is not factually coherent, explain why instead of "
        "answering something not correct. If you don't know the answer to a question, please don't share "
        "false information."
    ),
}


def pick_prompt(df: DataFrame, line: str = "line") -> DataFrame:
    """Add ``prompt_key`` and ``prompt`` from a JSON object text.

    The first key that is *present* wins, even when its value is null; rows with
    none of the keys get a null ``prompt_key``.
    """
    keys = F.json_object_keys(line)
    chosen = F.coalesce(*[F.when(F.array_contains(keys, k), F.lit(k)) for k in PROMPT_KEYS])
    text = F.coalesce(
        *[F.when(F.col("prompt_key") == k, F.get_json_object(line, f"$.{k}")) for k in PROMPT_KEYS]
    )
    return df.withColumn("prompt_key", chosen).withColumn("prompt", text)


def default_ids(df: DataFrame, order: list[str], id_col: str = "id") -> DataFrame:
    """A missing id becomes ``prompt_{i}``, i being the position among loaded prompts."""
    return number_rows(df, order, "_i").withColumn(
        id_col, F.coalesce(F.col(id_col), F.concat(F.lit("prompt_"), F.col("_i").cast("string")))
    ).drop("_i")


def system_message(language) -> Column:
    language = F.col(language) if isinstance(language, str) else language
    return F.when(language == "chinese", SYSTEM_MESSAGES["chinese"]).otherwise(SYSTEM_MESSAGES["english"])


def to_messages(df: DataFrame, language) -> DataFrame:
    """prompt -> messages: the system message of the language, then the user's prompt."""
    return df.withColumn(
        "messages",
        F.array(
            F.struct(F.lit("system").alias("role"), system_message(language).alias("content")),
            F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")),
        ),
    )


def explode_samples(responses: DataFrame, samples: str = "samples", n: int | None = None) -> DataFrame:
    """One row per sampled response. The id gets ``_{k}`` when several samples were asked
    for: ``n``, or as many as the row holds."""
    rest = [c for c in responses.columns if c not in (samples, "id")]
    several = F.size(samples) > 1 if n is None else F.lit(n > 1)
    at = responses.select("id", several.alias("_many"), *rest, F.posexplode(samples).alias("k", "response"))
    named = F.when(F.col("_many"), F.concat_ws("_", "id", F.col("k").cast("string"))).otherwise(F.col("id"))
    return at.withColumn("id", named).withColumn("k", F.col("k").cast("bigint")).drop("_many")


def drop_blank(rows: DataFrame, text: str = "response") -> DataFrame:
    return rows.withColumn(text, strip(text)).filter(F.col(text) != "")


def join_responses(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses meet their prompt by id, so a skipped prompt moves nothing."""
    return prompts.join(responses, "id", "inner")


def to_conversation(rows: DataFrame) -> DataFrame:
    """(id, prompt, response) -> training row. The 4-digit id suffix is drawn from
    the id itself, so that a re-run gives the same ids."""
    suffix = (F.lit(1000) + F.pmod(hash32(F.col("id")), F.lit(9000))).cast("string")
    turns = F.array(
        F.struct(F.lit("human").alias("from"), F.col("prompt").alias("value")),
        F.struct(F.lit("gpt").alias("from"), F.col("response").alias("value")),
    )
    return rows.select(F.concat_ws("_", "id", suffix).alias("id"), turns.alias("conversations"))


def generate(
    prompts: DataFrame, model: Callable, schema: str, max_rows_per_batch: int = 32
) -> DataFrame:
    """Run a user-supplied batched model over the prompts.

    ``model`` maps one pandas frame to another of ``schema``, which must have
    ``id`` and ``error`` columns. If a batch fails, each of its prompts comes back
    with the error text instead of vanishing.
    """
    import pandas as pd

    def run(batches):
        for frame in batches:
            for start in range(0, len(frame), max_rows_per_batch):
                part = frame.iloc[start : start + max_rows_per_batch]
                try:
                    yield model(part)
                except Exception as failure:  # noqa: BLE001 - reported per prompt
                    yield pd.DataFrame({"id": part["id"], "error": str(failure)})

    def shaped(batches):
        for out in run(batches):
            out = out.reindex(columns=names).astype(object)
            yield out.where(out.notna(), None)

    names = StructType.fromDDL(schema).names
    return prompts.mapInPandas(shaped, schema)
