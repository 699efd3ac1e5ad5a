"""Quality by importance resampling: hashed n-gram models of good and raw text, Gumbel top-k.

Both models are bags of hashed words and word pairs; the weight of a document is the ratio of
its probabilities under them. Adding Gumbel noise to the log weights and keeping the largest
k draws k documents without replacement in proportion to their weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import small
from turnwise.operators.scale import dense_index
from turnwise.session import written

#: Buckets of hashed n-grams: the models' size, whatever the corpus' size.
BUCKETS = 10_000
ADDED = 0.5
REMEMBERED = 400_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class Hashed:
    """Buckets of a text's words and word pairs; the words' hashes are remembered."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = np.uint64(buckets)
        self.known: dict[str, int] = {}

    def of(self, text: str) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, tokens = self.known, _TOKEN.findall(text)
        for t in tokens:
            if t not in known:
                known[t] = zlib.crc32(t.encode())
        h = np.array([known[t] for t in tokens], np.uint64)
        pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:]) * np.uint64(0x85EBCA6B) >> np.uint64(16)
        return (np.concatenate([h, pairs]) % self.buckets).astype(np.int64)


def marked(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, good``: whether a document is labelled good; nulls are not. Of several labels one suffices."""
    good = (
        labels.filter("quality = 1")
        .select(F.col("doc_id").cast("long"))
        .dropna()
        .distinct()
        .withColumn("good", F.lit(True))
    )
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    return rows.join(small(good), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))


def log_ratios(documents: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of a bucket's probability in good and in all text; one row per bucket is fetched."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed(buckets)
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for text, good in zip(batch.column("text"), batch.column("good").to_pylist(), strict=True):
                n = np.bincount(hashed.of(text.as_py() or ""), minlength=buckets)
                total[0] += n
                if good:
                    total[1] += n
        seen = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(total[0, seen]), pa.array(total[1, seen])], ["bucket", "raw", "good"]
        )

    rows = (
        marked(documents, labels)
        .mapInArrow(count, "bucket long, raw long, good long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
        .collect()
    )
    counts = np.zeros((2, buckets))
    for r in rows:
        counts[:, r["bucket"]] = r["good"], r["raw"]
    share = (counts + ADDED) / (counts + ADDED).sum(1, keepdims=True)
    return np.log(share[0]) - np.log(share[1])


def weights(documents: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``doc_id, log_weight`` per row: 0 for texts without words, null ones among them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed(len(ratios))
        for batch in batches:
            w = [float(ratios[hashed.of(t.as_py() or "")].sum()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(w, pa.float64())], ["doc_id", "log_weight"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, log_weight double")


def gumbel_top_k(scored: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """The ``k`` rows with the largest ``log_weight`` plus noise, with their ``rank`` from 0.

    The noise is a function of doc_id and seed, so a repeated task draws the same. Rows are
    ranked over ranges; no task sees all of them.
    """
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    noisy = scored.withColumn("key", F.col("log_weight") - F.log(-F.log(u)))
    ranked = dense_index(noisy.withColumn("_down", -F.col("key")), ["_down", "doc_id"], "rank")
    return ranked.filter(F.col("rank") < k).drop("_down")


def resample(documents: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 42) -> DataFrame:
    """``doc_id, log_weight, key, rank`` of the sampled documents.

    ``share`` of all rows is drawn; by default the share of good ones among the labelled rows
    (all rows if there are no labels). Repeated rows are drawn together.
    """
    scored = written(weights(documents, log_ratios(documents, labels)), "weights")
    if share is None:
        share = labels.agg(F.avg((F.col("quality") == 1).cast("int"))).first()[0]
    rows = scored.count()
    return gumbel_top_k(scored, round(rows * (1.0 if share is None else share)), seed)
