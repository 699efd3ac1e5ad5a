"""Collocations per language, counted by direct-address tiles and merged recursively.

Words get ranks by frequency. A pair of neighbours is an address (rank, rank); addresses are cut
into square tiles. Tiles in which many pairs fall are counted at the address itself with a dense
``bincount``, the others, and pairs with a word beyond the ranked ones, as sorted coordinate
lists. Pairs that occur often enough are ranked again and are the units of the next level: a
phrase of k + 1 words is a pair of neighbouring phrases of k words that overlap in k - 1. A
phrase cannot be more frequent than its parts, so units that are too rare are gaps.

Names of units are 64-bit hashes (of language and words), counts and ratios are exact. Tasks
count what they read and send sums, so a frequent phrase comes once a task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.hashing import WordHashes, joined, passes, spread_filter
from turnwise.operators.scale import best_per_group, lookup
from turnwise.session import written

#: Units that have a rank (a power of two); rarer ones are counted in coordinate lists.
RANKED = 1 << 17
SIDE = 1 << 10
#: A tile is dense from so many pairs in one portion on; so many dense tiles a task holds.
CROWDED, TILES = SIDE * SIDE // 32, 24
#: Pairs that are counted in one portion, and entries of a list before it is sent on.
PORTION, SENT = 1_500_000, 2_000_000
#: Words that a task counts before it sends their sums.
COUNTED = 300_000

_BYTES = 4_000_000

_BREAKS = bytes.maketrans(b".,;:!?\n\v\f\r", b"\xff" * 10)
_GAP = b"\xff"
_UNIT_DDL = "unit long, left long, right long, n long"


def _words(texts: list[bytes]) -> list[bytes]:
    """The words of all texts in order; a gap mark stands between pieces and between texts."""
    return _GAP.join(texts).translate(_BREAKS).lower().replace(_GAP, b" \xff ").split()


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """Words by language, some megabytes of text at a time."""
    held: dict[str, list[bytes]] = {}
    waiting = 0
    for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
        text = text.as_py().encode()
        held.setdefault(lang.as_py(), []).append(text)
        waiting += len(text) + 1
        if waiting > _BYTES:
            for lang, texts in held.items():
                yield lang, _words(texts)
            held, waiting = {}, 0
    for lang, texts in held.items():
        yield lang, _words(texts)


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def sent():
        for lang, words in counts.items():
            words.pop(_GAP, None)
            names = list(words)
            of = WordHashes(_seed(lang)).of(names).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(names), pa.string()),
                    pa.array([w.decode() for w in names], pa.string()),
                    pa.array(of),
                    pa.array(list(words.values()), pa.int64()),
                ],
                ["lang", "word", "unit", "n"],
            )
        counts.clear()

    for batch in batches:
        for lang, words in _by_language(batch):
            counts.setdefault(lang, Counter()).update(words)
            if sum(map(len, counts.values())) > COUNTED:
                yield from sent()
    yield from sent()


class Units:
    """What tasks know of the frequent units of one level: a filter, and the ranks of the first ones."""

    def __init__(self, units: DataFrame):
        self.bits = spread_filter(units, "unit")
        # Fixed number of fixed-width rows.
        first = units.orderBy(F.desc("n"), "unit").limit(RANKED).select("unit").toArrow()
        self.by_rank = first.column("unit").to_numpy().view(np.uint64)
        self.rank = np.argsort(self.by_rank).astype(np.int64)
        self.sorted = self.by_rank[self.rank]

    def kept(self, names: np.ndarray) -> np.ndarray:
        return np.where(passes(self.bits, names), names, np.uint64(0))

    def ranks(self, names: np.ndarray) -> np.ndarray:
        """The rank of each name, -1 for those that have none."""
        if not len(self.sorted):
            return np.full(len(names), -1)
        at = np.minimum(np.searchsorted(self.sorted, names), len(self.sorted) - 1)
        return np.where(self.sorted[at] == names, self.rank[at], -1)


class TileCounts:
    """Counts of unit pairs of one task: dense tiles and coordinate lists."""

    def __init__(self, units: Units):
        self.units = units
        self.dense: dict[int, np.ndarray] = {}
        self.codes: list[tuple[np.ndarray, np.ndarray]] = []
        self.names: list[tuple[np.ndarray, ...]] = []
        self.listed = 0

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        a, b = self.units.ranks(left), self.units.ranks(right)
        ranked = (a >= 0) & (b >= 0)
        self._ranked(a[ranked], b[ranked])
        left, right = left[~ranked], right[~ranked]
        if len(left):
            unit, first, n = np.unique(joined(left, right), return_index=True, return_counts=True)
            self.names.append((unit, left[first], right[first], n))
            self.listed += len(unit)

    def _ranked(self, a: np.ndarray, b: np.ndarray) -> None:
        across = RANKED // SIDE
        tile = (a // SIDE * across + b // SIDE).astype(np.uint16)
        order = np.argsort(tile, kind="stable")
        sizes = np.bincount(tile, minlength=across * across)
        stops = np.cumsum(sizes)
        listed = []
        for t in np.flatnonzero(sizes).tolist():
            if t not in self.dense and (sizes[t] < CROWDED or len(self.dense) >= TILES):
                listed.append(t)
                continue
            of = order[stops[t] - sizes[t] : stops[t]]
            found = np.bincount(a[of] % SIDE * SIDE + b[of] % SIDE, minlength=SIDE * SIDE).astype(np.int32)
            self.dense[t] = self.dense[t] + found if t in self.dense else found
        rest = np.zeros(len(sizes), bool)
        rest[listed] = True
        rest = rest[tile]
        if rest.any():
            code, n = np.unique(a[rest] * RANKED + b[rest], return_counts=True)
            self.codes.append((code, n))
            self.listed += len(code)

    def _rows(self, left, right, n) -> pa.RecordBatch:
        columns = (joined(left, right), left, right, n)
        return pa.RecordBatch.from_arrays(
            [pa.array(c.view(np.int64)) for c in columns], ["unit", "left", "right", "n"]
        )

    def listed_rows(self) -> Iterator[pa.RecordBatch]:
        """The sums of the lists, which start anew."""
        by_rank = self.units.by_rank
        if self.codes:
            code = np.concatenate([c for c, _ in self.codes])
            n = np.concatenate([n for _, n in self.codes])
            order = np.argsort(code)
            code, n = code[order], n[order]
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            code = code[starts]
            yield self._rows(by_rank[code // RANKED], by_rank[code % RANKED], np.add.reduceat(n, starts))
        if self.names:
            unit, left, right, n = (np.concatenate(c) for c in zip(*self.names, strict=True))
            order = np.argsort(unit)
            unit, left, right, n = unit[order], left[order], right[order], n[order]
            starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            yield self._rows(left[starts], right[starts], np.add.reduceat(n, starts))
        self.codes, self.names, self.listed = [], [], 0

    def dense_rows(self) -> Iterator[pa.RecordBatch]:
        across = RANKED // SIDE
        for t, counts in self.dense.items():
            at = np.flatnonzero(counts)
            left = self.units.by_rank[t // across * SIDE + at // SIDE]
            right = self.units.by_rank[t % across * SIDE + at % SIDE]
            yield self._rows(left, right, counts[at].astype(np.int64))


def _count_pairs(levels: list):
    """Count neighbours among the units of the last of ``levels`` (broadcast ``Units``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = [level.value for level in levels]
        counts = TileCounts(units[-1])
        hashes: dict[str, WordHashes] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def portion():
            nonlocal held, waiting
            if held:
                counts.add(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held, waiting = [], 0

        for batch in batches:
            for lang, words in _by_language(batch):
                known = hashes.setdefault(lang, WordHashes(_seed(lang)))
                known[_GAP] = 0
                names = units[0].kept(known.of(words))
                for level in units[1:]:
                    names = level.kept(joined(names[:-1], names[1:]))
                at = np.flatnonzero((names[:-1] != 0) & (names[1:] != 0))
                held.append((names[at], names[at + 1]))
                waiting += len(at)
                if waiting >= PORTION:
                    portion()
                    if counts.listed > SENT:
                        yield from counts.listed_rows()
            if sum(map(len, hashes.values())) > 1_000_000:
                hashes.clear()
        portion()
        yield from counts.listed_rows()
        yield from counts.dense_rows()

    return run


def collocations(documents: DataFrame, least: int = 30, longest: int = 4, first: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of 2 to ``longest`` words of each language.

    Texts are cut at ``.,;:!?`` and line ends, words at blanks and tabs; A-Z are lower-cased. A
    phrase with at least ``least`` occurrences is scored by its weakest cut; phrases inside a
    longer one with four fifths of their occurrences or more are left out. Null texts are empty,
    a null language is ``und``; repeated rows count as often as they come, and a language
    without any candidate has no rows.
    """
    context = documents.sparkSession.sparkContext
    texts = documents.select(
        F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )
    words = texts.mapInArrow(_count_words, "lang string, word string, unit long, n long")
    words = words.groupBy("lang", "unit").agg(F.min("word").alias("word"), F.sum("n").alias("n"))
    words = written(words, "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    words = words.filter(F.col("n") >= least)

    levels = [words.select("unit", "n")]
    shared = []
    for _ in range(longest - 1):
        shared.append(context.broadcast(Units(levels[-1])))
        pairs = texts.mapInArrow(_count_pairs(shared), _UNIT_DDL)
        pairs = pairs.groupBy("unit").agg(
            F.min("left").alias("left"), F.min("right").alias("right"), F.sum("n").alias("n")
        )
        levels.append(written(pairs.filter(F.col("n") >= least), f"phrases-{len(levels) + 1}"))

    kept = written(_open(_scored(levels), levels), "scored-phrases")
    for one in shared:
        one.unpersist()
    named = lookup(kept, words.select("unit", "lang").withColumnRenamed("unit", "w1"), ["w1"], ["unit"], how="inner")
    # Ties at the last place stay until the phrases are spelled out.
    place = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    spelled = written(named.withColumn("place", place).filter(F.col("place") <= first).drop("place"), "best-phrases")
    for k in range(1, longest + 1):
        of = words.select(F.col("unit").alias(f"w{k}"), F.col("word").alias(f"s{k}"))
        spelled = lookup(spelled, of, [f"w{k}"], ["unit"])
    spelled = spelled.withColumn("phrase", F.concat_ws(" ", *[f"s{k}" for k in range(1, longest + 1)]))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = best_per_group(spelled, ["lang"], order, first, "rank").withColumn("rank", F.col("rank") + 1)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _scored(levels: list[DataFrame]) -> DataFrame:
    """``unit, size, a, l, r, score, w1 ... wk``: every candidate with its weakest cut.

    ``part_i_j``, the unit of words i to j of a phrase, is found by going down left and right
    halves; counts come along. A unit's halves are at least as frequent as the unit, so each
    is in its table.
    """
    longest = len(levels)
    words = levels[0]
    done = []
    # A phrase of k words carries the (unit, n) of each of its stretches of words i..j.
    below = words.select("unit", F.struct("unit", "n").alias("p_1_1"))
    for size in range(2, longest + 1):
        of = levels[size - 1]
        stretches = [(i, j) for i in range(1, size) for j in range(i, size)]
        lefts = below.select(F.col("unit").alias("left"), *[F.col(f"p_{i}_{j}") for i, j in stretches])
        rights = below.select(
            F.col("unit").alias("right"),
            *[F.col(f"p_{i}_{j}").alias(f"p_{i + 1}_{j + 1}") for i, j in stretches if j == size - 1],
        )
        of = lookup(of, lefts, ["left"], ["unit"], how="inner")
        of = lookup(of, rights, ["right"], ["unit"], how="inner")
        of = of.withColumn(f"p_1_{size}", F.struct("unit", "n"))
        below = written(of, f"parts-{size}")
        cuts = []
        for k in range(1, size):
            l, r = F.col(f"p_1_{k}.n"), F.col(f"p_{k + 1}_{size}.n")
            exact = F.expr(
                f"(CAST(2000000 AS DECIMAL(18,0)) * CAST(n AS DECIMAL(20,0))) div CAST(p_1_{k}.n + p_{k + 1}_{size}.n AS DECIMAL(20,0))"
            )
            cuts.append(F.struct(exact.cast("long").alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
        weakest = F.least(*cuts, cuts[0])
        spelled = [F.col(f"p_{i}_{i}.unit") if i <= size else F.lit(None).cast("long") for i in range(1, longest + 1)]
        done.append(
            below.withColumn("cut", weakest).select(
                "unit",
                F.lit(size).alias("size"),
                F.col("n").alias("a"),
                "cut.l",
                "cut.r",
                "cut.score",
                *[c.alias(f"w{i}") for i, c in enumerate(spelled, 1)],
            )
        )
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _open(candidates: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Candidates that no longer candidate covers to four fifths or more.

    A longer candidate around a phrase holds one that is a single word longer and at least as
    frequent, so looking at those whose left or right half the phrase is suffices.
    """
    covers = None
    for of in levels[2:]:
        halves = of.select(F.explode(F.array("left", "right")).alias("unit"), "n")
        above = halves.groupBy("unit").agg(F.max("n").alias("cover"))
        covers = above if covers is None else covers.union(above)
    if covers is None:
        return candidates
    return candidates.join(covers, "unit", "left").filter("cover is null or 100 * cover < 80 * a").drop("cover")
