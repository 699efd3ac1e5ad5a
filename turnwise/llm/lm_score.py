"""Language-model scores: marginal probability of a text over all segmentations into subwords.

The pieces are those of an existing vocabulary; their probabilities are learned from the
training documents of the corpus. Words are counted in blocks of documents first, so a frequent
word leaves a task once a block; a block keeps its documents as numbers of its own words.
Every distinct word of the corpus is summed up and scored once, by the forward recursion over
its lattice of pieces, and goes back to the blocks in which it occurs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.session import written

#: A block of documents is closed at so many tokens or distinct words; a longer document is one alone.
BLOCK_TOKENS, BLOCK_WORDS = 2_000_000, 250_000
#: Added to every count of a piece.
ADDED = 0.1
_SPACE = "▁"
_BLOCK = pa.schema(
    [
        ("block", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("held_out", pa.list_(pa.bool_())),
        ("tokens", pa.list_(pa.int64())),
        ("distinct", pa.list_(pa.int32())),
        ("numbers", pa.binary()),
        ("times", pa.binary()),
        ("words", pa.list_(pa.binary())),
        ("trained", pa.list_(pa.int64())),
    ]
)
_BLOCK_DDL = (
    "block long, doc_ids array<long>, held_out array<boolean>, tokens array<long>, distinct array<int>, "
    "numbers binary, times binary, words array<binary>, trained array<long>"
)
_SCORED_DDL = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base, done, size = TaskContext.get().partitionId() << 32, 0, 0
    known: dict[bytes, int] = {}
    doc_ids, held_out, tokens, numbers, times = [], [], [], [], []

    def close() -> pa.RecordBatch:
        nonlocal known, doc_ids, held_out, tokens, numbers, times, done
        trained = np.zeros(len(known), np.int64)
        for held, n, t in zip(held_out, numbers, times, strict=True):
            if not held:
                trained[n] += t
        values = [
            [base + done], [doc_ids], [held_out], [tokens], [[len(n) for n in numbers]],
            [np.concatenate(numbers).astype("<i4").tobytes()], [np.concatenate(times).astype("<i4").tobytes()],
            [list(known)], [trained],
        ]
        done += 1
        known, doc_ids, held_out, tokens, numbers, times = {}, [], [], [], [], []
        return pa.RecordBatch.from_arrays(
            [pa.array(v, f.type) for v, f in zip(values, _BLOCK, strict=True)], schema=_BLOCK
        )

    for batch in batches:
        for doc_id, text, held in zip(*(batch.column(c) for c in ("doc_id", "text", "held_out")), strict=True):
            words = (text.as_py() or "").encode().lower().split()
            if doc_ids and (size + len(words) > BLOCK_TOKENS or len(known) > BLOCK_WORDS):
                yield close()
                size = 0
            size += len(words)
            number = known.setdefault
            n, t = np.unique(np.array([number(w, len(known)) for w in words], np.int32), return_counts=True)
            doc_ids.append(doc_id.as_py())
            held_out.append(held.as_py())
            tokens.append(len(words))
            numbers.append(n)
            times.append(t.astype(np.int32))
    if doc_ids:
        yield close()


def vocabulary_pieces(path: str) -> dict[str, int]:
    """The pieces of a vocabulary file that stand for text, with their ids; bytes are named <0x..>."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return {
        model.id_to_piece(i): i
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    }


class Lattice:
    """Log probabilities of pieces, and the forward recursion over them."""

    def __init__(self, pieces: dict[str, int], counts: dict[int, float], ends: float):
        total = sum(counts.get(i, 0.0) for i in pieces.values()) + ends + ADDED * (len(pieces) + 1)
        self.log = {p: math.log((counts.get(i, 0.0) + ADDED) / total) for p, i in pieces.items()}
        self.end = math.log((ends + ADDED) / total)
        self.least = math.log(ADDED / total)
        self.bytes = [self.log.pop(f"<0x{b:02X}>", self.least) for b in range(256)]
        self.longest = max(map(len, self.log), default=1)

    def spelled(self, char: str) -> float:
        """A character that is no piece, byte by byte."""
        return sum(self.bytes[b] for b in char.encode())

    def word(self, word: str) -> float:
        """Log of the summed probability of all segmentations of a word."""
        text = _SPACE + word
        get, longest = self.log.get, self.longest
        forward = [0.0]
        for i in range(1, len(text) + 1):
            terms = [
                forward[j] + p for j in range(max(0, i - longest), i) if (p := get(text[j:i])) is not None
            ]
            if get(text[i - 1]) is None:
                terms.append(forward[i - 1] + self.spelled(text[i - 1]))
            top = max(terms)
            forward.append(top if len(terms) == 1 else top + math.log(sum(math.exp(t - top) for t in terms)))
        return forward[-1]


def _piece_counts(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        total = np.zeros(model.get_piece_size())
        for batch in batches:
            words = [w.decode() for w in batch.column("word").to_pylist()]
            found = model.encode(words, num_threads=1)
            sizes = [len(f) for f in found]
            ids = np.fromiter((i for f in found for i in f), np.int64, sum(sizes))
            times = batch.column("c").to_numpy(zero_copy_only=False)
            total += np.bincount(ids, np.repeat(times, sizes), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["piece", "n"])

    return run


def score(documents: DataFrame, vocabulary: str, held_parts: int = 10) -> DataFrame:
    """Per row ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learned from rows whose crc32 of the doc_id as text is no multiple of ``held_parts``; a row
    without a doc_id teaches nothing either and counts as held out. Tokens are words (runs
    without ASCII white space, A-Z lower-cased) and one end. ``score`` is the log10 probability
    of all words and the end, ``base_score`` that of single words with 0.1 added to each count.
    Null texts are empty. Repeated rows are learned and scored as often as they come.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    held = F.coalesce(F.pmod(crc, F.lit(held_parts)) == 0, F.lit(True))
    rows = documents.select(F.col("doc_id").cast("long"), "text", held.alias("held_out"))
    blocks = written(rows.mapInArrow(_blocks, _BLOCK_DDL), "blocks")
    words = blocks.select("block", F.posexplode(F.arrays_zip("words", "trained")).alias("number", "w")).select(
        "block", "number", F.col("w.words").alias("word"), F.col("w.trained").alias("trained")
    )
    counted = written(words.groupBy("word").agg(F.sum("trained").alias("c")), "words")
    ends = blocks.select(F.explode("held_out").alias("held")).filter("not held").count()
    known = counted.filter("c > 0")
    sums = known.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = sums["n"] + ends, sums["v"] + (ends > 0)
    # At most one number per piece of the vocabulary is fetched.
    pieces = known.mapInArrow(_piece_counts(vocabulary), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    lattice = Lattice(vocabulary_pieces(vocabulary), {r["piece"]: r["n"] for r in pieces.collect()}, ends)
    shared = documents.sparkSession.sparkContext.broadcast(lattice)

    def marginal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.word
        for batch in batches:
            logs = [of(w.decode()) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("word", "c")), pa.array(logs, pa.float64())], ["word", "c", "log"]
            )

    scored = counted.mapInArrow(marginal, "word binary, c long, log double")
    back = words.select("block", "number", "word").join(scored, "word").select(
        F.col("block").alias("of_block"), "number", "c", "log"
    )
    floor = math.log10(n + 0.1 * (v + 1))
    end_base = math.log10(ends + 0.1) - floor
    end_log = lattice.end

    def gather(block: pa.Table, found: pa.Table) -> pa.Table:
        number = found.column("number").to_numpy()
        c, log = np.zeros(len(number)), np.zeros(len(number))
        c[number], log[number] = found.column("c").to_numpy(), found.column("log").to_numpy()
        base = np.log10(c + 0.1) - floor
        parts = []
        for i in range(block.num_rows):
            row = {name: block.column(name)[i] for name in ("doc_ids", "held_out", "tokens", "distinct")}
            ids = np.frombuffer(block.column("numbers")[i].as_buffer(), "<i4")
            times = np.frombuffer(block.column("times")[i].as_buffer(), "<i4")
            doc = np.repeat(np.arange(len(row["distinct"])), row["distinct"].values.to_numpy())

            def total(values):
                return np.bincount(doc, times * values[ids], minlength=len(row["distinct"]))

            tokens = row["tokens"].values.to_numpy() + 1
            parts.append(
                pa.Table.from_arrays(
                    [
                        row["doc_ids"].values,
                        row["held_out"].values,
                        pa.array(tokens),
                        pa.array((total((c > 0).astype(np.float64)) + (ends > 0)).astype(np.int64)),
                        pa.array(np.full(len(tokens), n, np.int64)),
                        pa.array(total(base) + end_base),
                        pa.array((total(log) + end_log) / math.log(10)),
                    ],
                    names=[part.split()[0] for part in _SCORED_DDL.split(", ")],
                )
            )
        return pa.concat_tables(parts)

    kept = blocks.drop("words", "trained")
    return kept.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(gather, _SCORED_DDL)
