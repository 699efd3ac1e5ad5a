"""Distributions in long form (group, token, score) and the processors that reshape them.

Scores come from counts learned from the corpus: no neural draft model is built here.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.operators.scale import best_per_group, lookup, running_sums

Processor = Callable[[DataFrame], DataFrame]

# Scores are summed as exp(score - band * _BAND): one band spans a range whose
# exponentials fit a double, so a single grouped pass gives a safe log-sum-exp.
_BAND = 256.0


def group_mass(df: DataFrame, group: str, score: str = "score") -> DataFrame:
    """log(sum(exp(score))) and the row count of each group, in one aggregation."""
    band = F.floor(F.col(score) / _BAND)
    per_band = df.groupBy(group, band.alias("_b")).agg(
        F.sum(F.exp(F.col(score) - band * _BAND)).alias("_s"), F.count("*").alias("_c")
    )
    per_group = per_band.groupBy(group).agg(
        F.max("_b").alias("_top"), F.sum("_c").alias("n_group"),
        F.collect_list(F.struct("_b", "_s")).alias("_bands"),
    )
    mass = F.aggregate(
        "_bands", F.lit(0.0), lambda acc, x: acc + x["_s"] * F.exp((x["_b"] - F.col("_top")) * _BAND)
    )
    return per_group.select(group, (F.col("_top") * _BAND + F.ln(mass)).alias("log_mass"), "n_group")


def softmax(df: DataFrame, group: str, token: str = "token", score: str = "score") -> DataFrame:
    """Add ``log_p`` and ``p``."""
    mass = group_mass(df, group, score)
    joined = lookup(df, mass, [group], [group, token], weight="n_group")
    return (
        joined.withColumn("log_p", F.col(score) - F.col("log_mass"))
        .withColumn("p", F.exp("log_p"))
        .drop("log_mass")
    )


def temperature(t: float, score: str = "score") -> Processor:
    """Divide scores by T; T = 1 changes nothing."""
    return lambda df: df if t == 1.0 else df.withColumn(score, F.col(score) / t)


def repetition_penalty(r: float, seen: DataFrame, group: str, token: str = "token", score: str = "score") -> Processor:
    """Tokens in ``seen`` (one row per token): positive scores / r, negative ones * r."""

    def apply(df):
        if r <= 1.0:
            return df
        marked = lookup(df, seen.select(token, F.lit(True).alias("_was")), [token], [group, token])
        worse = F.when(F.col(score) < 0, F.col(score) * r).otherwise(F.col(score) / r)
        return marked.withColumn(score, F.when(F.col("_was"), worse).otherwise(F.col(score))).drop("_was")

    return apply


def top_k(k: int, group: str, token: str = "token", score: str = "score") -> Processor:
    def apply(df):
        if k <= 0:
            return df
        order = [F.desc(F.round(score, 9)), F.col(token)]
        return best_per_group(df, [group], order, k, "_rank").drop("_rank")

    return apply


def top_p_mass(df: DataFrame, group: str, token: str, weight: str, total: str, p: float) -> DataFrame:
    """Smallest prefix, largest weight first, whose mass reaches ``p``; the token that
    crosses the border stays."""
    at = running_sums(
        df.withColumn("_down", -F.col(weight)), [group], ["_down", token], {"_before": F.col(weight)}
    )
    return at.filter(F.col("_before") < F.lit(p) * F.col(total)).drop("_down", "_before")


def top_p(p: float, group: str, token: str = "token", score: str = "score") -> Processor:
    def apply(df):
        if not 1e-8 <= p < 1.0:
            return df
        weighted = softmax(df, group, token, score).withColumn("_w", F.round("p", 12)).withColumn("_one", F.lit(1.0))
        return top_p_mass(weighted, group, token, "_w", "_one", p).select(*df.columns)

    return apply


def argmax(df: DataFrame, group: str, token: str = "token", score: str = "score") -> DataFrame:
    """Best token of each group; ties go to the smaller token."""
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col(token).alias("t"))).alias("b")
    return df.groupBy(group).agg(best).select(group, F.col("b.t").alias(token), (-F.col("b.s")).alias(score))


def processors(temp: float, group: str, penalty: float = 0.0, seen: DataFrame | None = None,
               p: float = 0.0, k: int = 0) -> list[Processor]:
    """The processor list of a sampling set-up; empty when T is so small that decoding
    is greedy. Order: temperature, repetition, top-p, top-k."""
    if temp <= 1e-5:
        return []
    chain: list[Processor] = [temperature(temp)]
    if penalty > 1.0 and seen is not None:
        chain.append(repetition_penalty(penalty, seen, group))
    chain += [top_p(p, group), top_k(k, group)]
    return chain


def apply_all(df: DataFrame, chain: Sequence[Processor]) -> DataFrame:
    for step in chain:
        df = df.transform(step)
    return df
