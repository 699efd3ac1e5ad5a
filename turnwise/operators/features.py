"""Feature vectors: layer concatenation and training-time noise."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.columns import uniform


def uniform_noise(vector: str, draw: Callable[[Column], Column], std: float, seq_len) -> Column:
    """x + (U - 0.5) * std * 512 / seq_len; ``draw`` maps a position to U in [0, 1)."""
    width = F.lit(std * 512) / F.lit(seq_len) if isinstance(seq_len, int) else F.lit(std * 512) / seq_len
    return F.transform(vector, lambda x, i: x.cast("double") + (draw(i) - 0.5) * width)


def keyed_uniform(key: str, seed: int) -> Callable[[Column], Column]:
    """Draws that depend on the row's key, so that a retried task repeats them."""
    return lambda i: uniform(F.col(key), i, F.lit(seed))


# Records hold one vector per position: hidden_state is an array of arrays.


def concat_layers(early, middle, late) -> Column:
    """The vectors of three layers side by side, position by position."""
    early, middle, late = (F.col(c) if isinstance(c, str) else c for c in (early, middle, late))
    return F.transform(early, lambda v, i: F.concat(v, F.get(middle, i), F.get(late, i)))


def noise_uniform(df: DataFrame, states: str, key: str, std: float = 0.2, seed: int = 42,
                  train: Column | None = None) -> DataFrame:
    """Uniform noise on the training records; other records stay as they are. Its width
    goes with the length of the sequence."""
    width = F.lit(std * 512) / F.size(states)

    def moved(v, i):
        return F.transform(
            v, lambda x, j: x.cast("double") + (uniform(F.col(key), i, j, F.lit(seed)) - 0.5) * width
        )

    plain = F.col(states).cast("array<array<double>>")
    train = F.lit(True) if train is None else train
    return df.withColumn(states, F.when(train, F.transform(states, moved)).otherwise(plain))


def noise_gaussian(df: DataFrame, states: str, key: str, mean: float = 0.0, std: float = 0.2,
                   seed: int = 42) -> DataFrame:
    """x + N(mean, std), from two keyed uniforms by the Box-Muller rule."""

    def moved(v, i):
        def one(x, j):
            u = F.greatest(uniform(F.col(key), i, j, F.lit(seed), F.lit("r")), F.lit(1e-12))
            w = uniform(F.col(key), i, j, F.lit(seed), F.lit("a"))
            normal = F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(6.283185307179586) * w)
            return x.cast("double") + normal * std + mean

        return F.transform(v, one)

    return df.withColumn(states, F.transform(states, moved))


def next_states(states: str) -> Column:
    """Each position's target: the vector of the next one, zeros at the end."""
    blank = F.transform(F.get(states, F.lit(0)), lambda x: x * 0)
    shifted = F.concat(F.slice(states, F.lit(2), F.greatest(F.size(states) - 1, F.lit(0))), F.array(blank))
    return F.when(F.size(states) > 0, shifted).otherwise(F.col(states))


def long_states(df: DataFrame, key: Sequence[str] | str, states: str, value: str = "x") -> DataFrame:
    """One row per position and dimension."""
    key = [key] if isinstance(key, str) else list(key)
    at = df.select(*key, F.posexplode(states).alias("pos", "_v"))
    return at.select(*key, F.col("pos").cast("bigint").alias("pos"), F.posexplode("_v").alias("dim", value)).withColumn(
        "dim", F.col("dim").cast("bigint")
    )
