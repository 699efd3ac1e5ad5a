"""Sinks. A write is checked by counting rows as they pass, without a second read."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from turnwise.sources.store import Store


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line in plain UTF-8."""
    df.write.mode(mode).json(path)


def write_verified(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Write JSON lines and return the row count; an empty result is an error."""
    seen = Observation()
    write_jsonl(df.observe(seen, F.count(F.lit(1)).alias("n")), path, mode)
    n = seen.get["n"]
    if not n:
        raise ValueError(f"nothing was written to {path}")
    return n


def digest(df: DataFrame) -> str:
    """A name for the rows of ``df`` in any order: their number and the sum of their hashes."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).alias("s")
    ).first()
    return f"{row['n']}-{int(row['s']) & (1 << 128) - 1:032x}"


def publish(df: DataFrame, path: str, name: str, form: str = "parquet", partition_by: Sequence[str] = ()) -> bool:
    """Write ``df`` as the folder ``name`` below ``path``, all of it or nothing; False if it is there.

    Rows go to a folder that readers pass over and get their name by one rename. A job that is
    killed leaves nothing that counts, one that is repeated finds the name taken.
    """
    store = Store(df.sparkSession, path)
    if store.exists(name):
        return False
    staged = f"_staged-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).format(form).save(f"{store.root}/{staged}")
    if store.move(staged, name):
        return True
    store.delete(staged)
    return False


def append_answers(df: DataFrame, path: str, run: str | None = None) -> bool:
    """Append one nested record per question; a folder per run and model.

    ``run`` names what is appended, by default the digest of the rows: the same run is
    appended once, however often the job is repeated. Returns whether it was appended now.
    """
    return publish(df, path, f"run={run or digest(df)}", "json", ["model_id"])


def write_summary(summary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    summary.write.mode(mode).json(path)
