"""Draft vocabulary: the most frequent target tokens, their ids and their coverage.

The draft vocabulary has at most N rows, N being a parameter of the model; Spark
broadcasts it while it is small. The full vocabulary grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.sources.store import Store
from turnwise.sources.writers import publish


def target_frequency(counts: DataFrame) -> DataFrame:
    return counts.filter("n_target > 0").select("token", F.col("n_target").alias("freq"))


def top_n(freq: DataFrame, n: int) -> DataFrame:
    """The N most frequent tokens; ties go to the smaller token in byte order."""
    return freq.orderBy(F.desc("freq"), "token").limit(n)


def draft_map(top: DataFrame, vocab: DataFrame) -> DataFrame:
    """(draft_id, token, token_id, offset): draft ids follow the order of token ids."""
    kept = vocab.join(top.select("token", "freq"), "token")
    rank = F.row_number().over(Window.orderBy("token_id")) - 1
    return kept.select(
        rank.cast("bigint").alias("draft_id"), "token", "token_id", "freq"
    ).withColumn("offset", F.col("token_id") - F.col("draft_id"))


def coverage(freq: DataFrame, top: DataFrame) -> DataFrame:
    """Share of target tokens that the top N cover; no target token at all is an error."""
    marked = freq.join(top.select("token", F.lit(1).alias("_in")), "token", "left")
    sums = marked.agg(
        F.coalesce(F.sum(F.when(F.col("_in") == 1, F.col("freq"))), F.lit(0)).alias("covered"),
        F.coalesce(F.sum("freq"), F.lit(0)).alias("total"),
    )
    checked = F.when(F.col("total") == 0, F.raise_error(F.lit("no target tokens"))).otherwise(F.col("total"))
    return sums.select("covered", checked.alias("total")).withColumn(
        "coverage", F.col("covered") / F.col("total")
    )


def membership(vocab: DataFrame, mapping: DataFrame) -> DataFrame:
    """One flag per token id: is it in the draft vocabulary."""
    inside = mapping.select("token_id", F.lit(True).alias("_in"))
    return vocab.join(inside, "token_id", "left").select(
        "token_id", F.col("_in").isNotNull().alias("in_draft")
    )


def keep_known(tokens: DataFrame, mapping: DataFrame, key: str = "token") -> DataFrame:
    return tokens.join(mapping.select(key), key, "left_semi")


def drop_known(tokens: DataFrame, mapping: DataFrame, key: str = "token") -> DataFrame:
    return tokens.join(mapping.select(key), key, "left_anti")


def encode_draft(tokens: DataFrame, mapping: DataFrame) -> DataFrame:
    """token_id -> draft_id; tokens outside the draft vocabulary are dropped."""
    return tokens.join(mapping.select("token_id", "draft_id"), "token_id")


def decode_draft(drafts: DataFrame, mapping: DataFrame) -> DataFrame:
    """draft_id -> token_id by adding the stored offset."""
    return drafts.join(mapping.select("draft_id", "offset"), "draft_id").select(
        *drafts.columns, (F.col("draft_id") + F.col("offset")).alias("token_id")
    )


def saved_table(vocab: DataFrame, build, n: int, folder: str) -> DataFrame:
    """Keep the draft table on disk under a digest of its input and N, and reuse it.

    ``vocab`` has ``token, token_id, n_target``: the ids depend on all tokens, so all of
    them are in the digest, not only the counted ones. ``build`` makes the table; it runs
    only when none for the same vocabulary and the same N is there yet.
    """
    digest = vocab.agg(
        F.expr("bit_xor(xxhash64(token, token_id, n_target))").alias("x"), F.count("*").alias("n")
    ).first()
    name = f"vocab-{digest['n']}-{(digest['x'] or 0) & (2**64 - 1):016x}-top{n}"
    spark = vocab.sparkSession
    if not Store(spark, folder).exists(name):
        # Of two builders one gives the folder its name, whole; the other one's is thrown away.
        publish(build(), folder, name)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}")
