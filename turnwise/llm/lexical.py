"""Ranked lexical search of many queries at once, with sums that queries share.

Queries are dealt into blocks of bounded size. For a block, terms that occur in exactly the same
queries (equally often) are one shared set, and each query is a list of such sets, the most
shared ones first. The lists make a tree of common beginnings: a node's accumulator is that of
its parent plus the one of a set, so what queries have in common is added up once per document.
Documents pass through tasks in portions; a portion's accumulators are a matrix, made level by
level down the tree. Each task keeps the best documents per query and sends only these.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import in_chunks
from turnwise.operators.scale import best_per_group
from turnwise.session import scratch_path, written

#: Bytes of query text in a block, give or take its last rows; what the driver and a task hold of the queries.
BLOCK_BYTES = 1_000_000
#: Numbers in the accumulator matrix of a portion of documents.
CELLS = 6_000_000
_DELIMITERS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes.maketrans(
    bytes(range(0x41, 0x5B)) + _DELIMITERS, bytes(range(0x61, 0x7B)) + b" " * len(_DELIMITERS)
)
_PLAN_DDL = (
    "item_ids array<long>, terms array<binary>, symbol_term array<int>, symbol_times array<long>, "
    "set_start array<int>, node_parent array<int>, node_set array<int>, level_start array<int>, item_node array<int>"
)
_DOC_DDL = "doc_id long, n long, terms binary, tf binary"


def terms(text: str | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII; only A-Z lower-cased."""
    return text.encode().translate(_FOLD).split() if text else []


def plan(item_ids: list, texts: list) -> dict:
    """The shared sets of a block of queries and the tree that adds them up."""
    numbers: dict[bytes, int] = {}
    extents: dict[tuple[int, int], list[int]] = {}  # (term, times) -> queries
    for i, text in enumerate(texts):
        times: dict[int, int] = {}
        for term in terms(text):
            t = numbers.setdefault(term, len(numbers))
            times[t] = times.get(t, 0) + 1
        for symbol in times.items():
            extents.setdefault(symbol, []).append(i)
    sets: dict[tuple, list[tuple[int, int]]] = {}
    for symbol, items in extents.items():
        sets.setdefault(tuple(items), []).append(symbol)
    # The most shared sets first; equal ones by their queries.
    ordered = sorted(sets.items(), key=lambda e: (-len(e[0]), e[0]))
    lists: list[list[int]] = [[] for _ in texts]
    for s, (items, _) in enumerate(ordered):
        for i in items:
            lists[i].append(s)
    # Node 0 is the empty sum; nodes stand level by level, so parents come first.
    parent, of_set, level_start = [0], [-1], [0, 1]
    at = [0] * len(texts)
    for depth in range(max(map(len, lists), default=0)):
        made: dict[tuple[int, int], int] = {}
        for i, sets_of in enumerate(lists):
            if depth < len(sets_of):
                key = (at[i], sets_of[depth])
                if key not in made:
                    made[key] = len(parent)
                    parent.append(key[0])
                    of_set.append(key[1])
                at[i] = made[key]
        level_start.append(len(parent))
    symbols = [symbol for _, members in ordered for symbol in members]
    starts = np.cumsum([0] + [len(members) for _, members in ordered])[:-1]
    return {
        "item_ids": item_ids,
        "terms": list(numbers),
        "symbol_term": [t for t, _ in symbols],
        "symbol_times": [n for _, n in symbols],
        "set_start": starts.tolist(),
        "node_parent": parent,
        "node_set": of_set,
        "level_start": level_start,
        "item_node": at,
    }


def plans(items: DataFrame) -> DataFrame:
    """One row per block of ``items`` (item_id, text): its queries and how to add them up."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + 64 * F.count(F.lit(1))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    dealt = items.select(F.col("item_id").cast("long"), "text").withColumn(
        "block", F.pmod(F.xxhash64("item_id", F.monotonically_increasing_id()), F.lit(blocks))
    )

    def mine(rows: pa.Table) -> pa.Table:
        found = plan(rows.column("item_id").to_pylist(), rows.column("text").to_pylist())
        schema = pa.schema(
            [
                ("item_ids", pa.list_(pa.int64())),
                ("terms", pa.list_(pa.binary())),
                ("symbol_term", pa.list_(pa.int32())),
                ("symbol_times", pa.list_(pa.int64())),
                *[(c, pa.list_(pa.int32())) for c in ("set_start", "node_parent", "node_set", "level_start", "item_node")],
            ]
        )
        return pa.Table.from_pylist([found], schema)

    return dealt.groupBy("block").applyInArrow(mine, _PLAN_DDL)


def occurrences(documents: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id, n, terms, tf`` per document: its length and the terms of ``vocabulary`` in it (packed int32)."""
    shared = documents.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get

        def rows():
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    words = terms(text.as_py())
                    known = [t for t in map(get, words) if t is not None]
                    ids, tf = np.unique(np.array(known, np.int32), return_counts=True)
                    yield doc_id, len(words), ids.tobytes(), tf.astype(np.int32).tobytes()

        yield from in_chunks(rows(), _DOC_SCHEMA)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _DOC_DDL)


_DOC_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("tf", pa.binary())])


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        ids = np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32)
        found = np.bincount(ids, minlength=len(total))
        found[: len(total)] += total
        total = found
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])


class Scorer:
    """A block's plan with its weights; scores of portions of documents."""

    def __init__(self, row: dict, df: dict[int, int], n_docs: int, n_words: int):
        self.n_docs, self.n_words = n_docs, n_words
        self.weight = np.array(
            [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(row["terms"]))],
            np.int64,
        )
        arrays = {k: np.array(row[k], np.int64) for k in row if k not in ("terms", "item_ids")}
        self.term, self.times, self.set_start = (arrays[k] for k in ("symbol_term", "symbol_times", "set_start"))
        self.parent, self.of_set, self.levels = (arrays[k] for k in ("node_parent", "node_set", "level_start"))
        self.item_node = arrays["item_node"]
        self.item_ids = pa.array(row["item_ids"], pa.int64())
        rows = len(self.weight) + len(self.term) + len(self.set_start) + len(self.parent)
        self.portion = max(8, min(2048, CELLS // max(1, rows)))

    def scores(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """One row per query, one column per document. ``sizes`` cuts ``terms`` and ``tf`` into documents."""
        if len(n) and int(n.max()) * 75 * self.n_docs >= 1 << 63:
            m = np.array([25 + 75 * int(x) * self.n_docs // self.n_words for x in n], np.int64)
        else:
            m = 25 + 75 * n * self.n_docs // max(1, self.n_words)
        doc = np.repeat(np.arange(len(n)), sizes)
        single = np.zeros((len(self.weight), len(n)), np.int64)
        tf = tf.astype(np.int64)
        single[terms, doc] = self.weight[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        if not len(self.term):
            return np.zeros((len(self.item_node), len(n)), np.int64)
        shared = np.add.reduceat(single[self.term] * self.times[:, None], self.set_start, axis=0)
        sums = np.zeros((len(self.parent), len(n)), np.int64)
        for a, b in zip(self.levels[1:-1].tolist(), self.levels[2:].tolist(), strict=True):
            sums[a:b] = sums[self.parent[a:b]] + shared[self.of_set[a:b]]
        return sums[self.item_node]


class Best:
    """The best documents of each query so far: score, then doc_id, those without one last."""

    def __init__(self, items: int, keep: int):
        self.keep = keep
        self.least = np.ones(items, np.int64)
        self.rows = [np.zeros(0, np.int64)] * 4  # query, score, doc_id, doc_id missing

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[:, None])
        if not len(item):
            return
        new = (item, scores[item, doc], ids[doc], missing[doc])
        columns = [np.concatenate(c) for c in zip(self.rows, new, strict=True)]
        item, score, doc_id, without = columns
        order = np.lexsort((doc_id, without, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.keep - 1
        self.least[item[last]] = score[order[last]]
        self.rows = [c[order[place < self.keep]] for c in columns]


def _search(scorer, keep: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer.value
        best = Best(len(of.item_node), keep)
        for batch in batches:
            for at in range(0, batch.num_rows, of.portion):
                part = batch.slice(at, of.portion)
                packed = part.column("terms").to_pylist()
                sizes = np.array([len(p) // 4 for p in packed], np.int64)
                terms = np.frombuffer(b"".join(packed), np.int32)
                tf = np.frombuffer(b"".join(part.column("tf").to_pylist()), np.int32)
                ids = part.column("doc_id")
                missing = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                n = part.column("n").to_numpy(zero_copy_only=False)
                best.add(of.scores(n, sizes, terms, tf), ids.fill_null(0).to_numpy(zero_copy_only=False), missing)
        item, score, doc_id, missing = best.rows
        columns = [item, of.item_ids.take(pa.array(item)), pa.array(doc_id, mask=missing.astype(bool)), score]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["item", "item_id", "doc_id", "score"])

    return run


def search(documents: DataFrame, items: DataFrame, keep: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``keep`` best documents with a score above 0 for each row of ``items``.

    A term's weight times its damped frequency is summed over a query's terms, repeats included;
    equal scores go by doc_id, rows without one last. Null texts have no terms; a query without
    known terms has no rows. Repeated documents take a place each, repeated queries are answered
    each. Queries are taken block by block, every block against all documents.
    """
    spark = documents.sparkSession
    path = scratch_path(spark, "ranked")
    blocks = written(plans(items), "query-plans")
    number = -1
    for number, row in enumerate(blocks.toLocalIterator()):
        row = row.asDict()
        found = written(occurrences(documents, row["terms"]), "query-terms")
        sums = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        counted = found.mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df"))
        scorer = spark.sparkContext.broadcast(Scorer(row, dict(map(tuple, counted.collect())), *sums))
        best = found.mapInArrow(_search(scorer, keep), "item long, item_id long, doc_id long, score long")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        best_per_group(best, ["item"], order, keep).select(
            "item_id", (F.col("rank") + 1).cast("int").alias("rank"), "doc_id", "score"
        ).write.parquet(f"{path}/block={number}")
        scorer.unpersist()
    shape = "item_id long, rank int, doc_id long, score long"
    if number < 0:
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).parquet(f"{path}/block=*")
