"""Keyed tables that micro-batches merge into, as numbered snapshots.

Rows lie in buckets by a hash of their key. A merge reads and writes only the buckets that the
batch touches; a snapshot, one small file, names the folder of every bucket. A reader opens the
newest snapshot, so it reads a number of folders that does not grow with the number of batches,
and never sees half a merge. A batch that is repeated after a failure is found in the snapshot
and passed over.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from turnwise.sources.store import Store

_BUCKET = "__bucket"


class SnapshotTable:
    """``keys`` name a row for ``combine``, which makes one table of the old and new rows of some buckets."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], buckets: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.keys, self.buckets = keys, buckets
        self.store = Store(spark, path)

    def newest(self) -> dict:
        """The newest snapshot: its number, the folder of each bucket, the last batch of each writer, notes."""
        found = [n for n in self.store.names("snapshots") if n.endswith(".json")]
        if not found:
            return {"number": 0, "buckets": {}, "applied": {}, "notes": {}}
        return json.loads(self.store.read(f"snapshots/{found[-1]}"))

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self) -> DataFrame:
        return self._rows(sorted(self.newest()["buckets"].values()))

    def done(self, writer: str, batch: int) -> bool:
        return self.newest()["applied"].get(writer, -1) >= batch

    def merge(
        self,
        rows: DataFrame,
        combine: Callable[[DataFrame], DataFrame],
        writer: str,
        batch: int,
        notes: dict | None = None,
    ) -> bool:
        """Merge ``rows`` as ``batch`` of ``writer``; False if that has been done before.

        Of two writers that merge at the same time one fails and can repeat its batch.
        """
        old = self.newest()
        if old["applied"].get(writer, -1) >= batch:
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast(LongType())
        rows = rows.select(*self.schema.names)
        touched = [str(r[0]) for r in rows.select(bucket).distinct().collect()]
        folder = f"data/{old['number'] + 1:012d}-{uuid.uuid4().hex}"
        if touched:
            before = self._rows([old["buckets"][b] for b in touched if b in old["buckets"]])
            merged = combine(before.unionByName(rows)).select(*self.schema.names).withColumn(_BUCKET, bucket)
            merged.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        written = {n.split("=")[1] for n in self.store.names(folder) if n.startswith(_BUCKET)}
        now = {b: f for b, f in old["buckets"].items() if b not in touched}
        now |= {b: f"{folder}/{_BUCKET}={b}" for b in written}
        snapshot = {
            "number": old["number"] + 1,
            "buckets": now,
            "applied": old["applied"] | {writer: batch},
            "notes": old["notes"] | (notes or {}),
        }
        name = f"{snapshot['number']:012d}.json"
        if not self.store.put(f"snapshots/{name}", json.dumps(snapshot), f"staged/{uuid.uuid4().hex}"):
            raise RuntimeError(f"another writer has made snapshot {name} of {self.path}; repeat the batch")
        return True

    def vacuum(self, keep: int = 1) -> int:
        """Delete all snapshots but the newest ``keep``, and folders that none of these names."""
        found = [n for n in self.store.names("snapshots") if n.endswith(".json")]
        kept = [json.loads(self.store.read(f"snapshots/{n}")) for n in found[-keep:]]
        newest = max((s["number"] for s in kept), default=0)
        used = {f.split("/")[1] for s in kept for f in s["buckets"].values()}
        gone = 0
        for name in found[:-keep]:
            self.store.delete(f"snapshots/{name}")
        for name in self.store.names("data"):
            # A folder with a later number belongs to a merge under way.
            if name not in used and int(name.split("-")[0]) <= newest:
                self.store.delete(f"data/{name}")
                gone += 1
        return gone
