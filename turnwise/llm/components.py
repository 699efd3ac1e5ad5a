"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.session import written


#: Links that a task of a round works on; small tables get few tasks, whatever the session's setting.
ROWS = 50_000


def parts_for(rows: int, each: int = ROWS) -> int:
    """How many tasks ``rows`` rows are worth."""
    return max(1, -(-rows // each))


def _large_star(links: DataFrame, parts: int) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    return joined.coalesce(parts).distinct().coalesce(parts)


def _small_star(links: DataFrame, parts: int) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. ``links`` has u > v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    others = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    every = others.coalesce(parts).union(least.select("u", F.col("m").alias("v")).coalesce(parts))
    return every.distinct().coalesce(parts)


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``links`` (u, v of an ordered type): the least node it reaches.

    Links to itself, repeated ones and those with nulls do no harm. Each round is a stored
    table, so a lost executor repeats no earlier round; rounds grow with the logarithm of a
    component's size. Nodes with very many links are only ever grouped by partial minima and
    joined on their number.
    """
    oriented = (
        links.filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    now = written(oriented, "links")
    state = None
    while True:
        digest = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if digest == state or digest[0] == 0:
            break
        state = digest
        parts = parts_for(digest[0])
        now = written(_small_star(_large_star(now, parts), parts), "links")
    parts = parts_for(digest[0])
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    every = roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")))
    return written(every.distinct().coalesce(parts), "roots")


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root`` (stored) after ``links`` (u, v) have joined some of the components of ``roots``.

    Links become links of roots first, so that the rounds work on what is new. The root of a
    component is the least node, as in ``components``.
    """
    if not links.limit(1).count():
        return roots
    parts = parts_for(roots.count())
    ends = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    fresh = ends.join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    every = written(roots.unionByName(fresh.coalesce(parts)), "nodes")
    between = links
    for end in ("u", "v"):
        named = every.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        between = between.join(named, end)
    moved = components(between.coalesce(parts).select(F.col("root_u").alias("u"), F.col("root_v").alias("v")))
    moved = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
    joined = every.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return written(joined.coalesce(parts), "roots")
