"""What several operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a lookup table that may be broadcast; its rows have a fixed width of a few numbers.
BROADCAST_ROWS = 1_000_000


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the library to Python workers that do not have it installed, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="ship-"), "library.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted`` with as many marks in front as no column of ``df`` has, in any case of letters."""
    taken = [c.lower() for c in df.columns]
    mark = "_"
    while any(c.startswith(mark) for c in taken):
        mark += "_"
    return [mark + name for name in wanted]


def quoted(name: str) -> str:
    """A column name that may hold dots, blanks and signs."""
    return "`" + name.replace("`", "``") + "`"


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to be small; else Spark joins by shuffle.

    Only for tables of a few numeric columns, so that the count bounds the bytes.
    """
    return F.broadcast(df) if df.count() <= rows else df


def rows_of(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Arrow batches as tuples of Python values, in column order."""
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in columns], strict=True)


def in_chunks(rows: Iterable[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )
