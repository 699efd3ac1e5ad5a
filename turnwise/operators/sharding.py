"""Shuffles, splits, shards and batches. All are functions of a row's key or of its
ordinal, so they give the same answer on any number of machines."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.columns import hash32
from turnwise.operators.scale import dense_index
from turnwise.session import written


def shuffle_seeded(df: DataFrame, key: str, seed: int = 42, epoch: int | None = None) -> DataFrame:
    """Add ``position`` in a repeatable permutation; another epoch gives another one."""
    parts = [F.col(key), F.lit(seed)] + ([F.lit(epoch)] if epoch is not None else [])
    keyed = df.withColumn("_h", F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])))
    return dense_index(keyed, ["_h", key], "position").drop("_h")


#: Rounds of ``permuted`` per bit of the row count, and at least.
ROUNDS_PER_BIT, LEAST_ROUNDS = 4, 24
_PRIME = (1 << 31) - 1


def permutation_rounds(n: int, *key) -> list[tuple[int, int, int, int]]:
    """The round keys (k, a, b, c) of ``permuted`` for ``n`` rows under a key."""
    rounds = max(LEAST_ROUNDS, ROUNDS_PER_BIT * max(n, 1).bit_length())
    out = []
    for i in range(rounds):
        digest = hashlib.sha256(":".join(map(str, (*key, i))).encode()).digest()
        k, a, b, c = (int.from_bytes(digest[j : j + 8], "big") for j in (0, 8, 16, 24))
        out.append((k % max(n, 1), 1 + a % (_PRIME - 1), b % _PRIME, c % _PRIME))
    return out


def permuted(position, n: int, *key) -> Column:
    """The place of row ``position`` (0 to n - 1) in a permutation that ``key`` draws.

    Swap-or-not rounds: a round pairs x with (k - x) mod n and both change places if a keyed
    bit of the larger one is set. That is its own inverse for every n, so no places beyond n
    have to be walked back from. Only whole numbers are used; nothing is shuffled or joined.
    """
    position = F.col(position) if isinstance(position, str) else position
    if n < 2:
        return position.cast("bigint")
    rounds = F.array(*[
        F.struct(*[F.lit(v).cast("bigint").alias(name) for name, v in zip("kabc", r, strict=True)])
        for r in permutation_rounds(n, *key)
    ])
    size, prime = F.lit(n).cast("bigint"), F.lit(_PRIME).cast("bigint")

    def turn(x: Column, r: Column) -> Column:
        other = F.pmod(r["k"] - x, size)
        larger = F.greatest(x, other)
        mixed = F.pmod(F.pmod(larger, prime) * r["a"] + r["b"], prime)
        mixed = F.pmod(mixed + F.pmod(F.floor(larger / prime), prime) * F.lit(65_537) + r["c"], prime)
        mixed = F.pmod(mixed * mixed, prime)
        return F.when(F.shiftright(mixed, 15).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(rounds, position.cast("bigint"), turn)


def epochs(df: DataFrame, order: list[str], count: int, seed: int = 42) -> DataFrame:
    """One row per row and epoch, with its ``position`` in that epoch's permutation.

    Rows are numbered once; an epoch more is one expression more, without another exchange.
    """
    at = written(dense_index(df, order, "_ordinal"), "ordinals")
    n = at.count()
    places = F.array(*[permuted("_ordinal", n, seed, e) for e in range(count)])
    out = at.select(*df.columns, F.posexplode(places).alias("epoch", "position"))
    return out.withColumn("epoch", F.col("epoch").cast("bigint"))


def in_train(key, percent: int = 95, seed: int = 42) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(hash32(key, F.lit(seed)), F.lit(100)) < percent


def split_by_hash(df: DataFrame, key: str, percent: int = 95) -> DataFrame:
    """Add ``split``: a row's side depends on its key only, whatever else is there."""
    return df.withColumn("split", F.when(in_train(key, percent), "train").otherwise("test"))


def split_by_position(df: DataFrame, order: list[str], percent: int = 95) -> DataFrame:
    """The first ``percent`` of the rows train, the rest test."""
    at = dense_index(df, order, "position")
    border = (at.count() * percent) // 100
    return at.withColumn("split", F.when(F.col("position") < border, "train").otherwise("test"))


def first_samples(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def positional_slice(df: DataFrame, order: list[str], begin: int | None = None, end: int | None = None) -> DataFrame:
    """Rows ``[begin:end)`` with list-slice rules: open ends and negative bounds work."""
    at = dense_index(df, order, "position")
    if (begin or 0) < 0 or (end or 0) < 0:
        n = at.count()
        begin = max(n + begin, 0) if begin is not None and begin < 0 else begin
        end = max(n + end, 0) if end is not None and end < 0 else end
    if begin is not None:
        at = at.filter(F.col("position") >= begin)
    if end is not None:
        at = at.filter(F.col("position") < end)
    return at


def shard_contiguous(df: DataFrame, order: list[str], workers: int) -> DataFrame:
    """Chunks of n // workers rows; a remainder makes one more, shorter shard."""
    at = dense_index(df, order, "position")
    chunk = max(at.count() // workers, 1)
    return at.withColumn("shard", F.floor(F.col("position") / chunk).cast("bigint"))


def shard_ceil(df: DataFrame, order: list[str], workers: int) -> DataFrame:
    at = dense_index(df, order, "position")
    chunk = max(math.ceil(at.count() / workers), 1)
    return at.withColumn("shard", F.floor(F.col("position") / chunk).cast("bigint"))


def shard_strided(df: DataFrame, order: list[str], workers: int, even: bool = False) -> DataFrame:
    """Worker r takes rows r, r + W, ... With ``even`` the list is filled up from its
    start so that all workers get the same number of rows."""
    at = dense_index(df, order, "position")
    if even:
        n = at.count()
        missing = -n % workers
        if n:
            # How often a row comes round again before the list is full.
            again = (F.lit(n + missing - 1) - F.col("position")) / F.lit(n)
            at = at.withColumn("_r", F.explode(F.sequence(F.lit(0), F.floor(again).cast("int"))))
            at = at.withColumn("position", F.col("position") + F.col("_r") * F.lit(n)).drop("_r")
    return at.withColumn("shard", F.pmod(F.col("position"), F.lit(workers)).cast("bigint"))


def batch_ranges(df: DataFrame, order: list[str], size: int) -> DataFrame:
    at = dense_index(df, order, "position")
    return at.withColumn("batch_id", F.floor(F.col("position") / size).cast("bigint"))
