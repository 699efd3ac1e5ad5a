"""Session defaults and the shared scratch area."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}
_made: dict[str, list[str]] = {}
_shipped: set[str] = set()


def local_session(cores: str = "*", app: str = "turnwise", **conf) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, bring your own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may run without it; there a temporary folder is made and
    kept for the session. A cluster must name a folder that every executor can reach.
    """
    named = spark.conf.get(_CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_DIR} to a folder shared by the cluster")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="turnwise-")
    return _local_dirs[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder; ``release`` deletes what was put there."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete all scratch tables that this application has made so far.

    Call it when the results that rest on them have been read or written. Returns the
    number of places deleted.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    for path in _made.pop(spark.sparkContext.applicationId, []):
        where = jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(where.getFileSystem(conf).delete(where, True))
    return gone


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are deleted at the end."""
    before = _made.pop(spark.sparkContext.applicationId, [])
    try:
        yield
    finally:
        release(spark)
        _made[spark.sparkContext.applicationId] = before


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has a short lineage, keeps its physical layout when executors are
    lost, and still prunes columns and pushes filters because it is Parquet.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give the library to Python workers that do not have it installed, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="ship-"), "library.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
