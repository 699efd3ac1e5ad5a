"""Ordinals, running sums and lookups that hold up when one key owns a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.session import written

#: At least so many of the most frequent keys are served by broadcast.
HOT_KEYS = 10_000
_LOW33 = (1 << 33) - 1


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df``, a stored table of a few short columns, broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def dense_index(df: DataFrame, order: Sequence[str], name: str = "idx") -> DataFrame:
    """Add a gap-free 0-based ordinal over the whole frame, in ``order``.

    ``order`` must identify a row. Rows are range-partitioned and sorted, numbered
    inside their partition, and shifted by the size of all earlier partitions; the
    only global step runs over one row per partition.
    """
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_m", F.monotonically_increasing_id())
    )
    kept = written(ranged, "dense-index")
    kept = kept.select(
        *df.columns,
        F.shiftright("_m", 33).alias("_part"),
        F.col("_m").bitwiseAND(F.lit(_LOW33)).alias("_local"),
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        kept.groupBy("_part")
        .agg((F.max("_local") + 1).alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    )
    return kept.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("_start") + F.col("_local")).cast("bigint").alias(name)
    )


def number_rows(df: DataFrame, order: Sequence[str], name: str = "idx") -> DataFrame:
    """``dense_index`` for wide rows: only the columns of ``order``, which must identify a
    row, are sorted and stored; the numbers then meet the rows by them."""
    keys = {c: f"_o{i}" for i, c in enumerate(order)}
    numbers = dense_index(df.select(*order), order, name).withColumnsRenamed(keys)
    on = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]
    return df.join(numbers, on).drop(*keys.values())


def running_sums(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    inclusive: bool = False,
) -> DataFrame:
    """Prefix sums inside each group, without gathering a group in one task.

    Rows are range-partitioned by (group, order), so a hot group is cut into many
    partitions. Each piece is summed on its own; pieces of a group that crosses a
    partition border receive the total of the pieces before them. At most two
    groups cross any border, so the carried table has at most two rows per
    partition and is broadcast.
    """
    group, order = list(group), list(order)
    values = {f"_v_{name}": expr for name, expr in sums.items()}
    pieces = written(
        df.withColumns(values)
        .repartitionByRange(*group, *order)
        .withColumn("_part", F.spark_partition_id()),
        "running-sums",
    )
    last = 0 if inclusive else -1
    inside = (
        Window.partitionBy("_part", *group)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, last)
    )
    totals = pieces.groupBy("_part", *group).agg(
        *[F.sum(v).alias(f"_t{v}") for v in values]
    )
    crossing = totals.groupBy(*group).agg(F.count("*").alias("_c")).filter("_c > 1")
    earlier = (
        Window.partitionBy(*group)
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.join(F.broadcast(crossing.select(*group)), group, "left_semi").select(
        "_part", *group, *[F.sum(f"_t{v}").over(earlier).alias(f"_c{v}") for v in values]
    )
    local = pieces.select(
        "_part", *df.columns, *[F.sum(v).over(inside).alias(f"_l{v}") for v in values]
    )
    zero = F.lit(0)
    return local.join(F.broadcast(carried), ["_part", *group], "left").select(
        *df.columns,
        *[
            (F.coalesce(f"_l_v_{n}", zero) + F.coalesce(f"_c_v_{n}", zero)).alias(n)
            for n in sums
        ],
    )


def served_keys(spark: SparkSession) -> int:
    """How many keys to serve by broadcast, so that any other owns at most a quarter of a
    shuffle partition: a key outside the first n owns less than one row in n."""
    return max(HOT_KEYS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def lookup(
    fact: DataFrame,
    table: DataFrame,
    key: Sequence[str],
    spread: Sequence[str],
    weight: str | None = None,
    how: str = "left",
) -> DataFrame:
    """Join ``fact`` to ``table`` (unique on ``key``) when some keys are very frequent.

    The ``served_keys`` most frequent keys are joined by broadcast, whatever the input
    size; all others own less than a quarter of a partition and are joined by shuffle. ``weight`` names a column of
    ``table`` that holds how often the key occurs in ``fact``; without it the keys are
    counted in a pass of their own, so ``fact`` should then be a stored table.
    ``spread`` are columns that vary inside a hot key; they scatter the rows already
    served so that these do not meet again in the shuffle.
    """
    key = list(key)
    # Null keys are dropped and the weight travels along unused, so that both uses of
    # ``table`` have one plan and Spark computes it once.
    for k in key:
        table = table.filter(F.col(k).isNotNull())
    carried = [c for c in table.columns if c not in key]
    payload = [c for c in carried if c != weight]
    if clash := set(payload) & set(fact.columns):
        raise ValueError(f"both sides have {sorted(clash)}")
    if weight is None:
        counts = fact.groupBy(*key).agg(F.count("*").alias("_n"))
        hot_keys = counts.orderBy(F.desc("_n"), *key).limit(served_keys(fact.sparkSession)).select(*key)
        hot = table.join(F.broadcast(hot_keys), key, "left_semi")
    else:
        hot = table.orderBy(F.desc(weight), *key).limit(served_keys(fact.sparkSession))
    hot = hot.select(
        *key, F.struct(*carried, F.lit(True).alias("_seen")).alias("_hot")
    )
    served = F.col("_hot").isNotNull()
    # Served rows get a null key, which matches nothing, and a place drawn from their
    # own columns; the others go where the hash of their key sends them.
    left = (
        fact.join(F.broadcast(hot), key, "left")
        .withColumns({f"_k{i}": F.when(~served, F.col(k)) for i, k in enumerate(key)})
        .withColumn("_place", F.when(served, F.xxhash64(*spread)).otherwise(F.xxhash64(*key)))
    )
    cold = table.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)],
        F.xxhash64(*key).alias("_place"),
        F.struct(*carried, F.lit(True).alias("_seen")).alias("_cold"),
    )
    on = [f"_k{i}" for i in range(len(key))] + ["_place"]
    both = left.join(cold, on, "left").withColumn("_hit", F.coalesce("_hot", "_cold"))
    if how == "inner":
        both = both.filter("_hit is not null")
    elif how == "anti":
        return both.filter("_hit is null").select(*fact.columns)
    elif how == "semi":
        return both.filter("_hit is not null").select(*fact.columns)
    elif how != "left":
        raise ValueError(f"unknown join type {how}")
    return both.select(*fact.columns, *[F.col(f"_hit.{c}").alias(c) for c in payload])


def matches(fact: DataFrame, table: DataFrame, key: Sequence[str]) -> DataFrame:
    """Inner join of a narrow ``fact``, computed twice, to a wide ``table`` (unique on ``key``).

    Rows with one of the ``served_keys`` most frequent keys meet the table by broadcast and are not
    shuffled; the others are shuffled before they get the table's columns.
    """
    key = list(key)
    counts = fact.groupBy(*key).agg(F.count("*").alias("_n"))
    hot_keys = counts.orderBy(F.desc("_n"), *key).limit(served_keys(fact.sparkSession)).select(*key)
    hot_keys = written(hot_keys, "hot-keys")
    hot = table.join(F.broadcast(hot_keys), key, "left_semi")
    served = fact.join(F.broadcast(hot), key)
    others = fact.join(F.broadcast(hot_keys), key, "left_anti").join(table, key)
    return served.unionByName(others)


def best_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each group with their 0-based rank.

    Spark limits each group on the map side before the shuffle, so a hot group
    sends at most ``k`` rows per task.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn(rank, F.row_number().over(w))
        .filter(F.col(rank) <= k)
        .withColumn(rank, (F.col(rank) - 1).cast("bigint"))
    )
