"""Sequence packing: tokens of whole documents into as few fixed-length sequences as best fit finds.

``tokenize`` cuts documents into pieces of at most ``max_tokens`` ids. ``pack`` then runs
best fit, longest first, in bulk-synchronous steps. Pieces are range-sorted by length and
numbered; so equal lengths are one run of numbers, however many rows they are. A step takes
the longest run left, sweeps over the gaps from the successor of that length upwards, and
matches k-th piece with k-th gap (the rank settles who gets which); gaps shrink, and the
next run follows. There are at most ``max_tokens`` runs and as many gap sizes, so the
plan of all steps is a table whose size depends on ``max_tokens`` alone. Every range of the
sorted pieces sweeps that table on its own to find its sequences; no task sees all pieces.
"""

from __future__ import annotations

import bisect
import os
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnwise.llm.common import free_names, in_chunks, rows_of
from turnwise.operators.scale import dense_index
from turnwise.session import written

MAX_TOKENS = 2048
#: Words whose ids a Python worker remembers; beyond it starts anew.
REMEMBERED = 400_000
#: Marks that are a token run of their own after a letter or digit.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Fixed: how the vocabulary file splits a chunk without white space into words.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
_PIECES = [
    ("doc_id", pa.int64()),
    ("piece", pa.int32()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("ids", pa.binary()),
]
_loaded: dict[str, WordIds] = {}


class WordIds:
    """Ids of texts, remembered by chunk between white space.

    The vocabulary's splitting never joins across white space and lowers the case, so a
    text's ids are those of its chunks; a chunk's letters and closing marks part likewise.
    Each task keeps what it has met, up to ``REMEMBERED`` chunks.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(_SPLIT)
        self.known: dict[bytes, bytes] = {}

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        chunks = [
            None if any(s in text for s in self.special) else text.encode().lower().split()
            for text in texts
        ]
        known = self.known
        self._learn({c for cs in chunks if cs for c in cs if c not in known})
        return [
            self.direct(text) if cs is None else b"".join(map(known.__getitem__, cs))
            for text, cs in zip(texts, chunks, strict=True)
        ]

    def _learn(self, missing: set[bytes]) -> None:
        whole, parted = set(), []
        for chunk in missing:
            word = chunk.decode()
            stem = word.rstrip(_MARKS)
            last = stem[-1:].lower()
            if len(stem) < len(word) and len(last) == 1 and (last.isalpha() or last.isdigit()):
                parted.append((chunk, stem.encode(), word[len(stem) :].encode()))
                whole.update(parted[-1][1:])
            else:
                whole.add(chunk)
        self._encode([c.decode() for c in whole if c not in self.known])
        for chunk, stem, marks in parted:
            self.known[chunk] = self.known[stem] + self.known[marks]

    def _encode(self, words: list[str], at_once: int = 500) -> None:
        sizes = {w: self._parts(w) for w in words}
        self.known.update((w.encode(), b"") for w in words if not sizes[w])  # white space beyond ASCII
        words = [w for w in words if sizes[w]]
        groups = [words[i : i + at_once] for i in range(0, len(words), at_once)]
        joined = [" ".join(g) for g in groups]
        for group, found in zip(
            groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True
        ):
            ids = np.array(found.ids, "<u4")
            parts = np.cumsum([sizes[w] for w in group])
            last = np.flatnonzero(self.ends[ids])
            if len(last) != parts[-1]:
                for word in group:
                    self.known[word.encode()] = self.direct(word)
                continue
            cuts = [0, *(last[parts - 1] + 1).tolist()]
            for word, a, b in zip(group, cuts[:-1], cuts[1:], strict=True):
                self.known[word.encode()] = ids[a:b].tobytes()

    def _parts(self, word: str) -> int:
        low = word.lower()
        if low.isalpha():
            return 1
        return len(self.split.findall(unicodedata.normalize("NFC", low)))


def tokenize(
    documents: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` (32-bit, little-endian).

    A document's ids and ``end_id`` after them; null text is empty and has ``end_id`` alone.
    ``tokenizer`` is the path of a vocabulary file that every executor can read.
    """
    schema = pa.schema(_PIECES if with_ids else _PIECES[:-1])
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * max_tokens

    def pieces(texts: list[tuple]) -> Iterator[tuple]:
        if tokenizer not in _loaded:
            _loaded[tokenizer] = WordIds(tokenizer)
        found = _loaded[tokenizer].of([text or "" for _, text in texts])
        for (doc_id, _), ids in zip(texts, found, strict=True):
            ids += end
            for i, at in enumerate(range(0, len(ids), width)):
                part = ids[at : at + width]
                yield (doc_id, i, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(schema)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[tuple]:
            held, size = [], 0
            for row in rows_of(batches, "doc_id", "text"):
                held.append(row)
                size += len(row[1] or "")
                if size > 1_000_000:
                    yield from pieces(held)
                    held, size = [], 0
            yield from pieces(held)

        yield from in_chunks(every(), schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return documents.select("doc_id", "text").mapInArrow(run, ddl + ", ids binary" * with_ids)


@dataclass
class Plan:
    """Where each run of numbered pieces goes: ``each`` of them to a sequence, side by side."""

    first: np.ndarray  # number of the run's first piece
    sequence: np.ndarray  # of the first piece
    each: np.ndarray
    offset: np.ndarray  # of the first piece in a sequence
    length: np.ndarray
    sequences: int


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit, longest first, over runs of equal length.

    Numbers go up with length in the sorted pieces, so the longest run has the last ones.
    The smallest gap that holds a piece takes as many as fit, for after one its rest is
    smaller than any other gap that still holds the piece.
    """
    first, at = {}, 0
    for length in sorted(counts):
        first[length] = at
        at += counts[length]
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges of sequences (first, how many)
    sizes: list[int] = []
    runs: list[tuple] = []
    opened = 0

    def leave(gap: int, start: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((start, n))

    for length in sorted(counts, reverse=True):
        number, left = first[length], counts[length]
        filled: list[tuple[int, int, int]] = []  # what this step leaves is of use to shorter pieces only
        while left:
            i = bisect.bisect_left(sizes, length)
            if i < len(sizes):
                gap = sizes[i]
                start, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[i]
            else:
                gap, start = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            each = gap // length
            full = min(n, left // each)
            over = left - full * each if full < n else 0
            offset = capacity - gap
            if full:
                runs.append((number, start, each, offset, length))
                filled.append((gap - each * length, start, full))
                number, left = number + full * each, left - full * each
            if full < n:
                if over:
                    runs.append((number, start + full, over, offset, length))
                    filled.append((gap - over * length, start + full, 1))
                    number, left = number + over, 0
                untouched = full + bool(over)
                filled.append((gap, start + untouched, n - untouched))
        for gap, start, n in filled:
            leave(gap, start, n)
    runs.sort()
    columns = np.array(runs, np.int64).reshape(-1, 5).T
    return Plan(*[np.ascontiguousarray(c) for c in columns], opened)


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``pieces`` (with ``doc_id, piece, length``) and the ``sequence_id`` and ``offset`` of each.

    Lengths lie in 1..``max_tokens``. ``pieces`` is read several times and so should be a
    stored table. Equal lengths are ordered by doc_id and piece; repeated rows each get a place.
    """
    spark = pieces.sparkSession
    part = F.col("length") < max_tokens
    counts = {r["length"]: r["n"] for r in pieces.filter(part).groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_fit(counts, max_tokens)
    shared = spark.sparkContext.broadcast(plan)  # at most a few runs per pair of lengths, at any input size
    (name,) = free_names(pieces, "number")
    numbered = dense_index(pieces.filter(part), ["length", "doc_id", "piece"], name)
    added = StructType.fromDDL("sequence_id long, offset long")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            number = batch.column(name).to_numpy(zero_copy_only=False)
            run = np.searchsorted(p.first, number, side="right") - 1
            inside = number - p.first[run]
            sequence = p.sequence[run] + inside // p.each[run]
            offset = p.offset[run] + inside % p.each[run] * p.length[run]
            kept = batch.drop_columns([name])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=[*kept.schema.names, "sequence_id", "offset"],
            )

    placed = numbered.mapInArrow(place, StructType([*pieces.schema.fields, *added.fields]))
    alone = pieces.filter(~part).select(
        *pieces.columns,
        (F.lit(plan.sequences) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return placed.unionByName(alone)


def pack_documents(documents: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Tokenise, store the narrow piece table, pack."""
    return pack(written(tokenize(documents, tokenizer, max_tokens), "pieces"), max_tokens)
