"""Candidate paths: successor tables, top-k expansion, prefix trees and acceptance.

A path carries its whole ancestry, so tree relations are joins and array steps; no
recursion. Scores are log-probabilities from corpus counts (no neural model).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.columns import leading_run
from turnwise.operators.scale import best_per_group, lookup, matches
from turnwise.session import written


def successors(pairs: DataFrame, k: int) -> DataFrame:
    """(token, next, c) -> (token, total, best): per token its k most frequent next
    tokens as an array of (rank, token, log_p). Ties go to the smaller token."""
    totals = pairs.groupBy("token").agg(F.sum("c").alias("total"))
    best = best_per_group(pairs, ["token"], [F.desc("c"), F.col("next")], k)
    scored = best.join(totals, "token").withColumn("log_p", F.ln(F.col("c") / F.col("total")))
    return scored.groupBy("token", "total").agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col("next").alias("token"), "log_p"))).alias("best")
    )


def expand_top_k(
    roots: DataFrame, table: DataFrame, depth: int, k: int, best: int | None = None, scored: bool = True
) -> DataFrame:
    """Grow each root for ``depth`` steps; after each step its best k paths live on.

    Result: one row per node ever scored (root, depth, parent_rank, child_rank, rank,
    kept, ranks, tokens, score). ``ranks`` is the path as child ranks, ``score`` the
    summed log-probability, ``rank`` the place among the root's nodes of that depth, and
    ``kept`` tells whether the node lived on. Each step is written to the shared folder,
    which cuts the lineage of the loop; a root has at most k paths going in and k * k
    coming out. ``table`` is read once per step, so pass a stored one.

    A step holds a root's paths in one row, so what is shuffled are the tails that a root asks for,
    the successors of each, and at most k paths a root; its k * k nodes are made, ordered and limited
    inside the row, and stored as the place of their parent, a token and a score.

    With ``best`` only nodes that ``rerank_top_n`` may choose for that many nodes are sought:
    a step never raises a score and at equal scores the shorter path wins, so a path that
    is not above the ``best``-th node of its root so far has no descendant among them and is
    not grown, and a node that is not above the ``best``-th of the steps before is left out. What is
    chosen is the same as without. With ``best``, or without ``scored``, nodes that neither live on
    nor can be chosen are dropped.
    """
    held = k if not scored and best is None else max(k, best) if best is not None else None
    table = table.select(F.col("token").alias("tail"), "best")
    start = F.struct(
        F.array().cast("array<bigint>").alias("ranks"), F.array().cast("array<string>").alias("tokens"), F.lit(0.0).alias("score")
    )
    live = roots.groupBy(F.col("token").alias("root")).agg(
        F.collect_list(start).alias("paths"), F.array().cast("array<double>").alias("top")
    )

    def tail(path: Column) -> Column:
        return F.when(F.size(path["tokens"]) == 0, F.col("root")).otherwise(F.get(path["tokens"], F.size(path["tokens"]) - 1))

    def grown(path: Column, place: Column) -> Column:
        """The nodes behind a path, whose first fields give their order."""
        mine = F.filter("found", lambda f: f["tail"] == tail(path))
        each = F.transform(
            mine,
            lambda f: F.transform(
                f["best"],
                lambda b: F.struct(
                    (-F.round(path["score"] + b["log_p"], 9)).alias("loss"),
                    F.concat(path["ranks"], F.array(b["rank"])).alias("ranks"),
                    place.cast("bigint").alias("parent_rank"),
                    b["rank"].alias("child_rank"),
                    b["token"].alias("token"),
                    (path["score"] + b["log_p"]).alias("score"),
                ),
            ),
        )
        return F.flatten(each)

    def above(node: Column) -> Column:
        return F.coalesce(F.round(node["score"], 9) > F.get("top", F.lit(best - 1)), F.lit(True))

    def joined(node: Column) -> tuple[Column, Column]:
        """The ranks and tokens of a node; a path's rank is its place."""
        parent = F.get("paths", node["parent_rank"].cast("int"))
        return F.concat(parent["ranks"], F.array(node["child_rank"])), F.concat(parent["tokens"], F.array(node["token"]))

    levels = None
    for d in range(1, depth + 1):
        asked = live.select("root", F.explode(F.array_distinct(F.transform("paths", tail))).alias("tail"))
        answers = matches(asked, table, ["tail"]).repartition("root").groupBy("root")
        answers = answers.agg(F.collect_list(F.struct("tail", "best")).alias("found"))
        nodes = F.array_sort(F.flatten(F.transform("paths", grown)))
        if best is not None:
            nodes = F.filter(nodes, above)
        if held is not None:
            nodes = F.slice(nodes, 1, held)
        slim = F.transform(nodes, lambda n: F.struct(*[n[c].alias(c) for c in ("parent_rank", "child_rank", "token", "score")]))
        level = written(live.join(answers, "root").select("root", "paths", "top", slim.alias("nodes")), f"paths-{d}")
        ranks, tokens = joined(F.col("n"))
        rows = level.select("root", "paths", F.posexplode("nodes").alias("_place", "n")).select(
            "root",
            F.lit(d).cast("bigint").alias("depth"),
            F.col("n.parent_rank").alias("parent_rank"),
            F.col("n.child_rank").alias("child_rank"),
            ranks.alias("ranks"),
            tokens.alias("tokens"),
            F.col("n.score").alias("score"),
            F.col("_place").cast("bigint").alias("rank"),
            (F.col("_place") < k).alias("kept"),
        )
        levels = rows if levels is None else levels.unionByName(rows)
        if d == depth:
            break
        live = level
        if best is not None:
            here = F.concat(F.transform("nodes", lambda n: F.round(n["score"], 9)), F.col("top"))
            live = live.withColumn("top", F.slice(F.sort_array(here, asc=False), 1, best))
        kept = F.slice("nodes", 1, k)
        if best is not None:
            # Nodes stand by score, so those above the bar come first and keep their places.
            kept = F.filter(kept, above)
        paths = F.transform(
            kept, lambda n: F.struct(joined(n)[0].alias("ranks"), joined(n)[1].alias("tokens"), n["score"].alias("score"))
        )
        live = live.select("root", paths.alias("paths"), "top")
    return levels


def greedy_chains(table: DataFrame, steps: int) -> DataFrame:
    """(token, chain): the best next token applied up to ``steps`` times; a chain ends early
    at a token without successors.

    A chain of 2m is a chain of m followed by the chain of m of its last token, so
    the length doubles with every pass. ``table`` is a stored successor table.
    """
    first = F.get("best", F.lit(0))["token"]
    chains = table.select("token", F.array(first).alias("chain"))
    reached = 1
    while reached < steps:
        more = chains.select(F.col("token").alias("tail"), F.col("chain").alias("more"))
        ends = chains.withColumn("tail", F.element_at("chain", -1))
        joined = lookup(ends, more, ["tail"], ["token"])
        longer = F.concat("chain", F.coalesce("more", F.array().cast("array<string>")))
        reached *= 2
        chains = written(joined.select("token", F.slice(longer, 1, steps).alias("chain")), f"chains-{reached}")
    return chains


def rerank_top_n(nodes: DataFrame, n: int) -> DataFrame:
    """The n best of all nodes scored for a root, whether or not they lived on, numbered
    in creation order: by depth, then parent, then child.

    A node never scores above its parent, and at equal score the shorter path wins,
    so every chosen node has its parent with it.
    """
    order = [F.desc(F.round("score", 9)), F.col("depth"), F.col("ranks")]
    best = best_per_group(nodes, ["root"], order, n, "_r").drop("_r")
    created = Window.partitionBy("root").orderBy("depth", "parent_rank", "child_rank")
    return best.withColumn("node", F.row_number().over(created).cast("bigint"))


def prefix_tree(paths: DataFrame, group: str = "root", path: str = "ranks") -> DataFrame:
    """All prefixes of a group's paths, once each, with node number (by length, then
    path), depth and parent node; node 0 is the root of the tree.

    A group holds a handful of paths (the n best of a root), so its tree is built inside
    one row by array steps.
    """
    def begins(p: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.struct(i.alias("d"), F.slice(p, F.lit(1), i).alias("p")))
        return F.when(F.size(p) > 0, cut).otherwise(F.slice(cut, F.lit(1), F.lit(0)))

    held = paths.groupBy(group).agg(F.collect_set(path).alias("_paths"))
    sorted_ = held.select(group, F.array_sort(F.array_distinct(F.flatten(F.transform("_paths", begins)))).alias("_all"))
    nodes = sorted_.select(group, F.transform("_all", lambda n: n["p"]).alias("_known"), F.posexplode("_all").alias("_i", "n"))
    parent = F.array_position("_known", F.slice(F.col("n.p"), F.lit(1), F.col("n.d") - 1))
    return nodes.select(
        group,
        F.col("n.p").alias("prefix"),
        F.col("n.d").cast("bigint").alias("depth"),
        (F.col("_i") + 1).cast("bigint").alias("node"),
        parent.alias("parent"),
    )


def distinct_prefixes(paths: DataFrame, group: str = "root", path: str = "ranks") -> DataFrame:
    steps = F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.slice(path, F.lit(1), i))
    return (
        paths.select(group, F.explode(steps).alias("prefix"))
        .distinct()
        .withColumn("depth", F.size("prefix").cast("bigint"))
    )


# --- acceptance ----------------------------------------------------------------


def accept_length(candidate, target) -> Column:
    """Length of the leading run on which a candidate agrees with the target."""
    return leading_run(F.zip_with(candidate, target, lambda a, b: a.eqNullSafe(b) & a.isNotNull()))


def best_candidate(lengths) -> Column:
    """(cand, length) of the longest accepted candidate, from the lengths of one start;
    ties, and none accepted, give the lowest index."""
    lengths = F.col(lengths) if isinstance(lengths, str) else lengths
    keyed = F.transform(lengths, lambda n, i: F.struct((-n).alias("l"), i.alias("c")))
    best = F.array_min(keyed)
    return F.struct(best["c"].cast("bigint").alias("cand"), (-best["l"]).alias("length"))
