"""SimHash near-duplicates by anchor-point covering.

64 bits are two halves of 31 and two bits more. Fingerprints that differ in ``bits`` places
differ in at most ``bits // 2`` in one of the halves. The anchors of a half are the words of
the perfect Hamming code of length 31: every pattern is within radius 1 of an anchor. Two
halves at distance t have a middle pattern at distance ceil(t / 2) from both, and the anchor
that covers the middle is within 1 + ceil(t / 2) of both. So each fingerprint is copied to all
anchors within the covering radius plus that threshold (16 a half for 4 bits), and compared
with its whole 64 bits to the others there. No pair in reach is missed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import free_names, small
from turnwise.llm.components import components
from turnwise.operators.scale import lookup
from turnwise.session import written

HALF = 31
_MASK = (1 << HALF) - 1
#: Fingerprints of an anchor that are compared in one piece; larger anchors are cut into blocks.
BLOCK = 2000
_LANES = np.uint64(0x0001000100010001)


def _hashes(words: list[bytes], shingle: int, seed: int) -> list[int]:
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(b" ".join(words), seed)] if words else []
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    return [digest(text[a:b], seed) for a, b in zip(starts, stops, strict=True)]


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The SimHash of each group of consecutive hashes; an empty group's is zero.

    Four counters of 16 bits share a word, so a group is counted in parts of under 2^16.
    """
    part = 65_535
    pieces = -(-sizes // part)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    if not len(owner):
        return np.zeros(len(sizes), np.uint64)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = (np.cumsum(sizes) - sizes)[owner] + at * part
    out = np.zeros(len(sizes), np.uint64)
    for j in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(j)) & _LANES, starts)
        for lane in range(4):
            count = np.bincount(
                owner, (sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF), minlength=len(sizes)
            )
            out |= (2 * count > sizes).astype(np.uint64) << np.uint64(16 * lane + j)
    return out


def fingerprints(documents: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, text_key, fingerprint`` (a long that holds the 64 bits) of every row.

    Words are runs without ASCII white space, A-Z lower-cased; shingles are hashed with XXH64
    as often as they occur. Fewer words than a shingle are one shingle; null and blank texts
    have fingerprint zero.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[int] = []
            sizes, found, waiting = [], [], 0

            def flush():
                nonlocal held, sizes, waiting
                found.append(majority_bits(np.array(held, np.uint64), np.array(sizes, np.int64)))
                held, sizes, waiting = [], [], 0

            for text in batch.column("text"):
                words = (text.as_py() or "").encode().lower().split()
                hashes = _hashes(words, shingle, seed)
                held += hashes
                sizes.append(len(hashes))
                if len(held) > 500_000:
                    flush()
            flush()
            bits = np.concatenate(found).view(np.int64)
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(bits)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "fingerprint"])

    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, fingerprint long")


def _patterns(radius: int) -> np.ndarray:
    """For each syndrome, the flips of at most ``radius`` places that lead to an anchor; -1 fills up."""
    by: list[list[int]] = [[] for _ in range(HALF + 1)]
    for weight in range(radius + 1):
        for places in combinations(range(1, HALF + 1), weight):
            syndrome = 0
            for p in places:
                syndrome ^= p
            by[syndrome].append(sum(1 << (p - 1) for p in places))
    widest = max(map(len, by))
    return np.array([b + [-1] * (widest - len(b)) for b in by], np.int64)


def _syndrome(half: np.ndarray) -> np.ndarray:
    out = np.zeros(len(half), np.int64)
    for b in range(5):
        places = sum(1 << (p - 1) for p in range(1, HALF + 1) if p >> b & 1)
        out |= (np.bitwise_count(half & places).astype(np.int64) & 1) << b
    return out


def anchors(nodes: DataFrame, bits: int) -> DataFrame:
    """``anchor, fingerprint``: each fingerprint with all anchors in reach of its halves."""
    flips = _patterns(1 + -(-(bits // 2) // 2))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("fingerprint").to_numpy(zero_copy_only=False)
            for at in range(0, len(every), 4096):
                prints = every[at : at + 4096]
                for side in (0, 1):
                    half = prints >> (HALF * side) & _MASK
                    flip = flips[_syndrome(half)]
                    row, k = np.nonzero(flip >= 0)
                    anchor = (half[row] ^ flip[row, k]) | side << HALF
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor), pa.array(prints[row])], ["anchor", "fingerprint"]
                    )

    return nodes.select("fingerprint").mapInArrow(run, "anchor long, fingerprint long")


def forest(group: np.ndarray, prints: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links within ``bits`` that join what no earlier link of the same group has joined.

    Rows of a group stand together. All pairs are compared, one distance in the table at a
    time; at most one link per row comes out.
    """
    label = np.arange(len(prints))
    out: list[tuple[int, int]] = []
    for step in range(1, len(prints)):
        same = np.flatnonzero(group[step:] == group[:-step])
        if not len(same):
            break
        near = same[np.bitwise_count(prints[same] ^ prints[same + step]) <= bits]
        near = near[label[near] != label[near + step]]
        for i in near.tolist():
            a, b = i, i + step
            while label[a] != a:
                a = label[a]
            while label[b] != b:
                b = label[b]
            if a != b:
                label[max(a, b)] = min(a, b)
                out.append((int(prints[i]), int(prints[i + step])))
        if len(near):
            while (label[label] != label).any():
                label = label[label]
    return out


def links(nodes: DataFrame, bits: int = 4) -> DataFrame:
    """``u, v``: links that join all fingerprints within ``bits`` of each other.

    ``nodes`` has distinct fingerprints and is read twice. An anchor with more than ``BLOCK``
    of them is cut into blocks by a hash, and every two blocks meet in a task of their own.
    """
    rows = anchors(nodes, bits)
    crowded = (
        rows.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    ).select("anchor", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    crowded = written(crowded, "crowded-anchors")
    spread = rows.join(small(crowded), "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")

    def meeting(k: Column) -> Column:
        return F.least(k, block) * F.col("blocks") + F.greatest(k, block)

    dealt = spread.select(
        "anchor", "fingerprint", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), meeting)).alias("meeting")
    )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 3
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

        def found(columns: list[np.ndarray]) -> pa.RecordBatch:
            anchor, meet, prints = columns
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (meet[1:] != meet[:-1])
            group = np.cumsum(new)
            many = np.bincount(group)[group] > 1
            pairs = forest(group[many], prints[many].view(np.uint64), bits)
            ends = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], schema=schema)

        for batch in batches:
            names = ("anchor", "meeting", "fingerprint")
            kept = [
                np.concatenate([a, batch.column(n).to_numpy(zero_copy_only=False)])
                for a, n in zip(kept, names, strict=True)
            ]
            anchor, meet, _ = kept
            last = np.flatnonzero((anchor != anchor[-1]) | (meet != meet[-1])) if len(anchor) else []
            if len(last):  # all but the group that may go on in the next batch
                cut = last[-1] + 1
                yield found([c[:cut] for c in kept])
                kept = [c[cut:] for c in kept]
        yield found(kept)

    return (
        dealt.repartition("anchor", "meeting")
        .sortWithinPartitions("anchor", "meeting", "fingerprint")
        .mapInArrow(compare, "u long, v long")
        .distinct()
    )


def _grouped(documents: DataFrame, shingle: int, bits: int) -> DataFrame:
    """``doc_id, text_key, fingerprint, first`` per row: ``first`` is the least (doc_id, text_key) of its group.

    Equal fingerprints are one node, so a group of copies costs one comparison; the rows of a
    frequent one are served without meeting in one task.
    """
    prints = written(fingerprints(documents, shingle), "fingerprints")
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))
    nodes = written(prints.groupBy("fingerprint").agg(F.min(named).alias("first"), F.count("*").alias("rows")), "nodes")
    roots = components(links(nodes, bits))
    rooted = nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "first", "rows", F.coalesce("root", "fingerprint").alias("root")
    )
    rooted = written(rooted, "rooted-nodes")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("nodes"))
    by_print = lookup(rooted.drop("first"), written(firsts, "firsts"), ["root"], ["fingerprint"], weight="nodes")
    by_print = written(by_print.select("fingerprint", "rows", "first"), "first-by-node")
    return lookup(prints, by_print, ["fingerprint"], ["doc_id", "text_key"], weight="rows")


def near_duplicates(documents: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row: the smallest doc_id reachable by links.

    Nulls among doc_ids are passed over; a group without any doc_id has a null component.
    Repeated rows come out as often as they go in.
    """
    return _grouped(documents, shingle, bits).select("doc_id", "fingerprint", F.col("first.doc_id").alias("component_id"))


def one_per_group(documents: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """``documents`` with one document of each group of near-duplicates.

    Rows are told apart by doc_id and text. The least of a group by these stays, and rows that
    repeat it are one row afterwards. Rows without a doc_id cannot be told from each other: all
    of them stay, and none makes another row go.
    """
    doc, key = free_names(documents, "doc", "key")
    later = _grouped(documents, shingle, bits).filter("doc_id is not null and struct(doc_id, text_key) <> first")
    gone = later.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct()
    gone = written(gone, "near-duplicates")
    on = (documents["doc_id"].cast("long") == F.col(doc)) & (F.xxhash64(documents["text"]) == F.col(key))
    left = documents.join(small(gone), on, "left_anti")
    sizes = documents.agg(F.count("doc_id"), F.countDistinct("doc_id")).first()
    if sizes[0] == sizes[1]:
        return left
    return left.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(left.filter("doc_id is null"))
