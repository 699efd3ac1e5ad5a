"""Readers for the JSON, text and Parquet inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnwise.functions.columns import strip
from turnwise.sources import ranges, schemas


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CONVERSATION).json(path)


def read_json_array(spark: SparkSession, path: str | Sequence[str], schema: str, block: int = ranges.BLOCK) -> DataFrame:
    """The rows of JSON documents that each hold an array of rows, read in blocks of ``block`` bytes.

    One large document is many tasks; a task reads its block and the rest of the last element
    that begins there. Compressed files and documents that are no array are read whole, a task each.
    """
    found, others = ranges.array_elements(spark, path, block)
    rows = None
    if found is not None:
        rows = found.select(F.from_json("value", schema).alias("r")).select("r.*")
    if others or rows is None:
        whole = spark.read.schema(schema).option("multiLine", True).json(others or path)
        rows = whole if rows is None else rows.unionByName(whole)
    return rows


def numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, line_no, line), line_no counting from 1 inside each file.

    The byte ranges and the number of their first lines are stored when this is called, and
    exactly these ranges are read afterwards, whatever the session's split sizes and cores are
    by then.
    """
    manifest, _ = ranges.line_manifest(spark, path)
    return ranges.read_lines(spark, manifest).drop("position")


def read_prompts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(prompts, rejects) from JSON lines: blank lines are skipped, lines that are not
    JSON become reject rows with their line number."""
    lines = numbered_lines(spark, path).withColumn("line", strip("line")).filter("line <> ''")
    parsed = F.try_parse_json("line")
    good = lines.filter(parsed.isNotNull()).select(
        "file", "line_no", "line", F.get_json_object("line", "$.id").alias("id")
    )
    rejects = lines.filter(parsed.isNull()).select("file", "line_no", "line", F.lit("bad JSON").alias("reason"))
    return good, rejects


def read_questions(spark: SparkSession, path: str, begin: int | None = None, end: int | None = None) -> DataFrame:
    """Questions ``[begin:end)`` in file order, by list-slice rules. Only ranges that hold lines of
    the slice are opened."""
    manifest, total = ranges.line_manifest(spark, path)
    first, last, _ = slice(begin, end).indices(total)
    rows = ranges.read_lines(spark, manifest, first, max(first, last))
    return rows.select("position", F.from_json("line", schemas.QUESTION).alias("q")).select("position", "q.*")


def read_answers(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Answer logs of one or more runs; ``file`` tells them apart."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    rows = spark.read.schema(schemas.ANSWER).json(paths)
    fields = [f.name for f in StructType.fromDDL(schemas.ANSWER)]
    return rows.select(*fields, F.col("_metadata.file_path").alias("file"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature records from all folders below ``path``."""
    return spark.read.schema(schemas.FEATURE).option("recursiveFileLookup", True).parquet(path)


def read_judge_templates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.JUDGE_TEMPLATE).json(path)
