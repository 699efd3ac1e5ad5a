"""Documents whose sets of word shingles overlap, by a grouped prefix join.

Shingles stand in one order for all documents: those known to be frequent last, the others by
hash. Two sets of Jaccard similarity 0.8 share a shingle among the first fifth (and one) of
each. Sets with the same prefix and size are one group; each group posts its prefix once. Lists
with one group are dropped, the groups of the others are spread out to their sets, and pairs
that pass the bounds on size and position are verified on the whole texts, after a bound by
parity sketches that never rejects a link.

The result is classes, so pairs inside one class need no second look. A first round compares
each set with its neighbours in every list; later rounds look at pairs between different
classes only, a growing slice of them by a hash of the pair, until all have been looked at.
So a large group of near copies costs a few comparisons per copy, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.components import components, extended, parts_for
from turnwise.llm.hashing import WordNames, mixed
from turnwise.operators.scale import lookup
from turnwise.session import written

#: Per cent of the union that the intersection must reach.
SIMILAR = 80
#: Shingles that are put last in the order: the most frequent ones, so many at most, from this count on.
FREQUENT, OFTEN = 1 << 20, 8
#: Shingles that one counting task holds, and that a map task holds before it sends them.
COUNTED, SENT = 4_000_000, 2_000_000
#: Groups of a list that are compared in one place; longer lists are cut.
BLOCK = 4000
#: Bytes of text, and pairs of texts, that a task works on at once.
BYTES, PAIRS = 2_000_000, 200
#: Pairs of texts that a task compares.
COMPARED = 2000
#: Followers in a list that a set meets in the first round; set names a task remembers.
FOLLOWERS, REMEMBERED = 2, 500_000
#: Lists of so many sets show all their pairs in the second round.
SHORT = 64
_SKETCH = 1024
_ODD = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


class Shingled:
    """The sets of some texts: their sizes, and their distinct shingle hashes text by text, each sorted."""

    def __init__(self, sizes: np.ndarray, hashes: np.ndarray):
        self.sizes, self.hashes = sizes, hashes
        self.starts = np.cumsum(sizes) - sizes

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The wrapping sum of one value per hash, for each text."""
        total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
        return total[self.starts + self.sizes] - total[self.starts]

    def names(self) -> np.ndarray:
        """64 bits that name a set; empty sets get one as well."""
        return mixed(self.sums(mixed(self.hashes ^ np.uint64(0x5851F42D4C957F2D))) + self.sizes.astype(np.uint64))

    def kept(self, texts: np.ndarray) -> Shingled:
        return Shingled(self.sizes[texts], self.hashes[np.repeat(texts, self.sizes)])


class Shingles:
    """Hashes of the distinct shingles of texts."""

    def __init__(self, width: int):
        self.width, self.words = width, WordNames()

    def of(self, texts: list[str | None]) -> Shingled:
        counts, names = self.words.by_text(texts)
        last = max(0, len(names) - self.width + 1)
        sums = np.zeros(last, np.uint64)
        for k in range(self.width):
            sums += names[k : k + last] * _ODD[k % 64]
        sums = mixed(sums)
        parts, at = [], 0
        for n in counts.tolist():
            if n >= self.width:
                found = np.sort(sums[at : at + n - self.width + 1])
                new = np.empty(len(found), bool)
                new[0] = True
                np.not_equal(found[1:], found[:-1], out=new[1:])
                parts.append(found[new])
            elif n:
                # A short text is one shingle, told from those of full width by its length.
                whole = np.add.reduce(names[at : at + n] * _ODD[:n]) ^ np.uint64(n)
                parts.append(mixed(np.array([whole], np.uint64)))
            else:
                parts.append(sums[:0])
            at += n
        sizes = np.array([len(p) for p in parts], np.int64)
        return Shingled(sizes, np.concatenate(parts) if parts else sums[:0])


def _portions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with some megabytes of text each; one long text is a batch of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        portion = np.cumsum(sizes) // BYTES
        cuts = [0, *(np.flatnonzero(np.diff(portion)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                yield batch.slice(a, b - a)


def _pairs_in_portions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PAIRS):
            yield batch.slice(at, PAIRS)


def sets(documents: DataFrame, width: int = 5) -> DataFrame:
    """``doc_id, text_key, n, node, sketch`` per row: size, name and parity sketch of its shingle set.

    Equal sets have one name (64 bits); rows without words have none and size 0.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in _portions(batches):
            found = shingles.of(batch.column("text").to_pylist())
            row = np.repeat(np.arange(batch.num_rows), found.sizes)
            place = row * _SKETCH + (found.hashes >> np.uint64(54)).astype(np.int64)
            odd = (np.bincount(place, minlength=batch.num_rows * _SKETCH) & 1).astype(np.uint8)
            sketches = np.packbits(odd).reshape(batch.num_rows, _SKETCH // 8)
            empty = found.sizes == 0
            columns = [
                pa.array(found.sizes),
                pa.array(found.names().view(np.int64), mask=empty),
                pa.array([None if e else s.tobytes() for e, s in zip(empty.tolist(), sketches, strict=True)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), *columns], ["doc_id", "text_key", "n", "node", "sketch"]
            )

    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, n long, node long, sketch binary")


class Once:
    """Which names this task has not met lately."""

    def __init__(self):
        self.met: set[int] = set()

    def of(self, names: np.ndarray) -> np.ndarray:
        if len(self.met) >= REMEMBERED:
            self.met.clear()
        out = np.zeros(len(names), bool)
        for i, name in enumerate(names.tolist()):
            if name not in self.met:
                self.met.add(name)
                out[i] = True
        return out


class Order:
    """The order of shingles: 8 bits of frequency class, then 56 bits of hash."""

    def __init__(self, keys: np.ndarray, df: np.ndarray, shift: int):
        order = np.argsort(keys)
        self.keys, self.shift = keys[order], shift
        self.df = df[order]
        self.rank = (1 + np.minimum(253, 8 * np.log2(np.maximum(self.df, 1)))).astype(np.uint64) << np.uint64(56)

    def prefix(self, found: Shingled) -> tuple[np.ndarray, np.ndarray, Shingled]:
        """The first places of each set, of which any partner shares one.

        Returned are, place by place, the number of the set and how frequent the shingle is (0:
        rare), and the places as sets of their own.
        """
        sizes = found.sizes
        row = np.repeat(np.arange(len(sizes)), sizes)
        places = found.hashes >> np.uint64(8)
        df = np.zeros(len(places), np.int64)
        if len(self.keys) and len(places):
            key = found.hashes >> np.uint64(self.shift)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            places = np.where(known, places | self.rank[at], places)
            df[known] = self.df[at[known]]
            # Sets of rare shingles are in order already.
            mixed_up = np.zeros(len(sizes), bool)
            mixed_up[row[known]] = True
            where = np.flatnonzero(mixed_up[row])
            order = where[np.lexsort((places[where], row[where]))]
            places[where], df[where] = places[order], df[order]
        first = sizes - (SIMILAR * sizes + 99) // 100 + 1
        first = np.minimum(first, sizes)
        kept = np.arange(len(places)) - np.repeat(found.starts, sizes) < first[row]
        return row[kept], df[kept], Shingled(first, places[kept])


def frequent(documents: DataFrame, nodes: DataFrame, width: int) -> Order:
    """The shingles that most sets share. It only decides the order, any order gives all links.

    Tasks send what they have counted cut into buckets by hash; a bucket holds some millions of
    different shingles, whatever the input. What is fetched is bounded by ``FREQUENT`` pairs of numbers.
    """
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(24, max(4, (int(total) // COUNTED).bit_length()))
    shift = 32 - bits

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, once = Shingles(width), Once()
        held: list[np.ndarray] = []
        waiting = 0

        def sent():
            keys, n = np.unique(np.concatenate(held) >> np.uint64(shift), return_counts=True)
            bucket = (keys >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
            keys, single = keys.astype(np.uint32), n == 1
            rows = []
            for b, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if i < j:
                    part, one = keys[i:j], single[i:j]
                    rows.append((b, part[one].tobytes(), part[~one].tobytes(), n[i:j][~one].astype(np.uint32).tobytes()))
            columns = zip(*rows, strict=True)
            types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "single", "several", "times"]
            )

        for batch in _portions(batches):
            found = shingles.of(batch.column("text").to_pylist())
            new = found.kept(once.of(found.names())).hashes
            held.append(new)
            waiting += len(new)
            if waiting >= SENT:
                yield from sent()
                held, waiting = [], 0
        if waiting:
            yield from sent()

    def count(rows: pa.Table) -> pa.Table:
        single, several, times = (
            np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint32) for c in ("single", "several", "times")
        )
        keys, at = np.unique(np.concatenate([single, several]), return_inverse=True)
        df = np.bincount(at, np.concatenate([np.ones(len(single)), times]), minlength=len(keys)).astype(np.int64)
        often = np.flatnonzero(df >= OFTEN)
        if len(often) > FREQUENT:
            often = often[np.argpartition(-df[often], FREQUENT)[:FREQUENT]]
        bucket = rows.column("bucket")[0].as_py()
        return pa.table({"key": keys[often].astype(np.int64) + (bucket << 32), "df": df[often]})

    counted = (
        documents.select("text")
        .mapInArrow(run, "bucket int, single binary, several binary, times binary")
        .groupBy("bucket")
        .applyInArrow(count, "key long, df long")
    )
    first = counted.orderBy(F.desc("df"), "key").limit(FREQUENT).toArrow()
    return Order(first.column("key").to_numpy().astype(np.uint64), first.column("df").to_numpy(), shift)


_POSTING = ("token", "piece", "group", "n", "pos", "node")


def postings(documents: DataFrame, width: int, order) -> DataFrame:
    """``token, piece, group, n, pos, node``: the prefix of each group, and the group of each set.

    Sets with the same prefix and size are one group, whose places are posted once a task; node
    is 0 there. A row with piece -1 says that ``node``, then also its token, is of a group. Piece 0 is a whole
    list. That of a token that is known to be long is cut into pieces, from 1 on, by the group's name; groups
    near a border stand in both pieces, so that neighbours still meet.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, of, nodes, groups = Shingles(width), order.value, Once(), Once()
        for batch in _portions(batches):
            found = shingles.of(batch.column("text").to_pylist())
            found = found.kept(found.sizes > 0)
            name = found.names()
            fresh = nodes.of(name)
            found, name = found.kept(fresh), name[fresh].view(np.int64)
            row, df, prefix = of.prefix(found)
            n = found.sizes
            group = mixed(prefix.names() ^ n.astype(np.uint64)).view(np.int64)
            zero = np.zeros(len(n), np.int64)
            yield _batch(name, zero - 1, group, n, zero, name)
            # The places of groups that this task has not posted yet.
            new = groups.of(group)[row]
            pos = (np.arange(len(row)) - np.repeat(prefix.starts, prefix.sizes))[new]
            row, df, token = row[new], df[new], prefix.hashes[new].view(np.int64)
            pieces = 1 + df // BLOCK
            at = group[row].view(np.uint64).astype(np.float64) / 2.0**64 * pieces
            piece = np.minimum(at.astype(np.int64), pieces - 1)
            over = np.minimum((at + 0.01).astype(np.int64), pieces - 1)
            piece, over = (np.where(pieces > 1, 1 + p, 0) for p in (piece, over))
            for where, part in ((slice(None), piece), (over != piece, over)):
                g = group[row[where]]
                yield _batch(token[where], part[where], g, n[row[where]], pos[where], np.zeros(len(g), np.int64))

    return documents.select("text").mapInArrow(run, ", ".join(f"{c} long" for c in _POSTING))


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], list(_POSTING))


def _runs(batches: Iterable[pa.RecordBatch], names: tuple, key: int) -> Iterator[list[np.ndarray]]:
    """Sorted columns, some whole runs of equal first ``key`` columns at a time."""
    held = [np.zeros(0, np.int64)] * len(names)
    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        held = [np.concatenate(c) for c in zip(held, new, strict=True)]
        if not len(held[0]):
            continue
        last = np.zeros(len(held[0]), bool)
        for c in held[:key]:
            last |= c != c[-1]
        cut = np.flatnonzero(last)
        if len(cut):
            yield [c[: cut[-1] + 1] for c in held]
            held = [c[cut[-1] + 1 :] for c in held]
    if len(held[0]):
        yield held


def _sketched_runs(batches, names, key) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """As ``_runs``, with the sketches of the rows, if there are any."""
    kept: list[np.ndarray] = []

    def noted():
        for batch in batches:
            column = batch.column("sketch")
            kept.append(_sketches(column) if not column.null_count else np.zeros((batch.num_rows, 0), np.uint64))
            yield batch

    rest = None
    for columns in _runs(noted(), names, key):
        every = [rest, *kept] if rest is not None else list(kept)
        kept.clear()
        held = np.concatenate(every)
        size = len(columns[0])
        yield columns, held[:size]
        rest = held[size:]


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def shared_lists(rows: DataFrame) -> DataFrame:
    """Of ``postings`` the lists with two groups or more, each group once, and the groups of all sets.

    A piece of a cut list is kept with one group as well, for its partners may stand in other pieces.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _runs(batches, _POSTING, 2):
            fresh = _starts(columns[:3])
            columns = [c[fresh] for c in columns]
            of = np.cumsum(_starts(columns[:2])) - 1
            wanted = (np.bincount(of)[of] > 1) | (columns[1] != 0)
            yield _batch(*[c[wanted] for c in columns])

    return (
        rows.repartition("token", "piece")
        .sortWithinPartitions("token", "piece", "group")
        .mapInArrow(run, ", ".join(f"{c} long" for c in _POSTING))
    )


def _possible(n1, p1, n2, p2) -> np.ndarray:
    """Can sets of these sizes that share what stands at these places reach the similarity?"""
    least, most = np.minimum(n1, n2), np.maximum(n1, n2)
    common = np.minimum(p1, p2) + 1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1)
    return (100 * least >= SIMILAR * most) & ((100 + SIMILAR) * common >= SIMILAR * (n1 + n2))


def _pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    low, high = np.minimum(u, v), np.maximum(u, v)
    both = np.unique(np.stack([low, high]), axis=1) if len(low) else np.zeros((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["u", "v"])


def neighbours(entries: DataFrame) -> DataFrame:
    """``u, v``: sets that follow each other closely in a list, by name, and may be similar."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, piece, node, n, pos in _runs(batches, ("token", "piece", "node", "n", "pos"), 2):
            of = np.cumsum(_starts([token, piece]))
            found = []
            for step in range(1, FOLLOWERS + 1):
                i = np.flatnonzero(of[step:] == of[:-step])
                j = i + step
                near = (node[i] != node[j]) & _possible(n[i], pos[i], n[j], pos[j])
                found.append((node[i[near]], node[j[near]]))
            yield _pairs(*(np.concatenate(c) for c in zip(*found, strict=True)))

    return (
        entries.repartition("token", "piece")
        .sortWithinPartitions("token", "piece", "node")
        .mapInArrow(run, "u long, v long")
        .distinct()
    )


def _alike(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether parity sketches allow sets of together ``n`` shingles to be similar.

    Each shingle of one set alone turns one bit at most, and similar sets have few such:
    |x| + |y| - 2 |x and y|, where the intersection is at least 80 / 180 of |x| + |y|.
    """
    differ = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return (100 + SIMILAR) * differ <= (100 - SIMILAR) * n


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, _SKETCH // 64)


def across(entries: DataFrame, sizes: DataFrame, nodes: DataFrame, low: int, high: int, sketched: bool) -> DataFrame:
    """``u, v``: possible pairs between different classes of a list whose turn has come.

    ``entries`` has ``token, node, n, pos, root``, ``sizes`` the lists that hold several roots.
    A list of s sets shows the pairs whose hash falls between low / s and high / s. Long lists
    are cut into blocks that meet in pairs. If ``sketched``, parity sketches come along, so
    that a pair that cannot be similar is not listed.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    spread = entries.join(sizes.withColumn("blocks", blocks), "token")
    if sketched:
        spread = spread.join(nodes.select("node", "sketch"), "node")
    else:
        spread = spread.withColumn("sketch", F.lit(None).cast("binary"))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("long"))
    meeting = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.least(k, F.col("block")) * F.col("blocks") + F.greatest(k, F.col("block")),
    )
    names = ("token", "meeting", "node", "n", "pos", "root", "size", "block")
    dealt = spread.withColumn("meeting", F.explode(meeting)).select(*names, "sketch")

    def turns(columns: list[np.ndarray], sketches: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        token, meeting, node, n, pos, root, size, block = columns
        of = np.cumsum(_starts([token, meeting]))
        # Two sets of one block meet where this block meets itself.
        first = np.r_[True, of[1:] != of[:-1]]
        mixed_ = np.maximum.reduceat(block, np.flatnonzero(first)) != np.minimum.reduceat(block, np.flatnonzero(first))
        mixed_ = np.repeat(mixed_, np.diff(np.r_[np.flatnonzero(first), len(of)]))
        i = np.arange(len(of))
        found, waiting, step = [], 0, 0
        while len(i):
            step += 1
            i = i[i + step < len(of)]
            i = i[of[i] == of[i + step]]
            a = i[(root[i] != root[i + step]) & (node[i] != node[i + step])]
            b = a + step
            turn = mixed((node[a] ^ node[b]).view(np.uint64)).astype(np.float64) / 2.0**64 * size[a]
            ok = (turn >= low) & (turn < high) & _possible(n[a], pos[a], n[b], pos[b])
            ok &= ~mixed_[a] | (block[a] != block[b])
            a, b = a[ok], b[ok]
            if sketches is not None and len(a):
                near = _alike(sketches[a], sketches[b], n[a] + n[b])
                a, b = a[near], b[near]
            found.append((node[a], node[b]))
            waiting += len(a)
            if waiting > 200_000:
                yield _pairs(*(np.concatenate(c) for c in zip(*found, strict=True)))
                found, waiting = [], 0
        if waiting:
            yield _pairs(*(np.concatenate(c) for c in zip(*found, strict=True)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, sketches in _sketched_runs(batches, names, 2):
            yield from turns(columns, sketches if sketched else None)

    return (
        dealt.repartition("token", "meeting")
        .sortWithinPartitions("token", "meeting", "node")
        .mapInArrow(run, "u long, v long")
        .distinct()
    )


def verified(documents: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """The ``pairs`` (stored, u and v of ``nodes``) whose sets are similar, by their whole texts."""

    def maybe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = sum(batch.column(c).to_numpy(zero_copy_only=False) for c in ("nu", "nv"))
            may = _alike(_sketches(batch.column("su")), _sketches(batch.column("sv")), n)
            yield batch.select(["u", "v"]).filter(pa.array(may))

    def side(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col("sketch").alias(f"s{name}"))

    met = pairs.join(side("u"), "u").join(side("v"), "v").coalesce(parts_for(pairs.count()))
    close = written(met.mapInArrow(maybe, "u long, v long"), "close-pairs")
    ends = close.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    missing = F.lit(-(1 << 63))
    wanted = nodes.join(ends, "node").select("node", F.coalesce("first.doc_id", missing).alias("id"), "first.text_key")
    texts = (
        documents.select(
            F.coalesce(F.col("doc_id").cast("long"), missing).alias("id"), F.xxhash64("text").alias("text_key"), "text"
        )
        .join(wanted, ["id", "text_key"])
        .groupBy("node")
        .agg(F.first("text").alias("text"))
    )
    with_u = close.join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u")
    both = with_u.join(texts.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in _pairs_in_portions(batches):
            left, right = (shingles.of(batch.column(c).to_pylist()) for c in ("tu", "tv"))
            row = np.concatenate([np.repeat(np.arange(batch.num_rows), side.sizes) for side in (left, right)])
            both = np.concatenate([left.hashes, right.hashes])
            order = np.lexsort((both, row))
            row, both = row[order], both[order]
            twice = (both[1:] == both[:-1]) & (row[1:] == row[:-1])
            common = np.bincount(row[1:][twice], minlength=batch.num_rows)
            same = (100 + SIMILAR) * common >= SIMILAR * (left.sizes + right.sizes)
            yield batch.select(["u", "v"]).filter(pa.array(same))

    return both.coalesce(parts_for(close.count(), COMPARED)).mapInArrow(compare, "u long, v long")


def classes(documents: DataFrame, width: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row: the smallest doc_id that links lead to.

    Words are runs without ASCII white space, A-Z lower-cased. Texts with fewer words than a
    shingle are one shingle; null and blank texts have none, link with nothing and are their own
    class. Rows with equal texts or sets are in one class; a class without any doc_id has null.
    """
    context = documents.sparkSession.sparkContext
    rows = written(sets(documents, width), "shingle-sets")
    nodes = rows.filter("n > 0").groupBy("node").agg(
        F.min(F.struct("doc_id", "text_key")).alias("first"),
        F.min("doc_id").alias("least"),
        F.min("n").alias("n"),
        F.min("sketch").alias("sketch"),
    )
    nodes = written(nodes, "shingle-nodes")
    order = context.broadcast(frequent(documents, nodes, width))
    posted = written(shared_lists(postings(documents, width, order)), "prefix-lists")
    groups = posted.filter("piece < 0").select("node", "group", "n")
    several = groups.groupBy("group").agg(F.count("*").alias("k"), F.min("n").alias("n")).filter("k > 1")
    # A group of several sets is a list of its own.
    own = several.select(F.col("group").alias("token"), F.lit(0).cast("long").alias("piece"), "group", "n", F.lit(0).cast("long").alias("pos"))
    lists = posted.filter("piece >= 0").drop("node").unionByName(own)
    entries = written(lists.join(groups.select("group", "node"), "group").drop("group"), "prefix-lists")

    tried = written(neighbours(entries), "pairs")
    links = written(verified(documents, nodes, tried, width), "links")
    roots = components(links)
    # Short lists show all pairs at once; of long ones a growing slice, with sketches.
    turns = [(0, SHORT, False), *((0 if k == 0 else SHORT * 16**k, SHORT * 16 ** (k + 1), True) for k in range(16))]
    for low, high, long in turns:
        placed = entries.select("token", "node", "n", "pos").distinct().join(
            roots.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_"), "left"
        )
        placed = placed.select("token", "node", "n", "pos", F.coalesce("root", "node").alias("root"))
        sizes = placed.groupBy("token").agg(F.count("*").alias("size"), F.min("root").alias("a"), F.max("root").alias("b"))
        open_ = sizes.filter("a < b").filter(F.col("size") > max(low, SHORT) if long else F.col("size") <= SHORT)
        sizes = written(open_.select("token", "size"), "open-lists")
        largest = sizes.agg(F.max("size")).first()[0]
        if largest is None:
            if long:
                break
            continue
        new = across(placed, sizes, nodes, low, high, long).join(tried, ["u", "v"], "left_anti")
        new = written(new, "pairs")
        roots = extended(roots, written(verified(documents, nodes, new, width), "links"))
        tried = tried.union(new)
        if long and largest <= high:
            break
    order.unpersist()

    rooted = nodes.select("node", "least").join(roots, "node", "left").select(
        "node", "least", F.coalesce("root", "node").alias("root")
    )
    rooted = written(rooted, "rooted")
    named = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "classes")
    by_node = written(lookup(rooted.select("node", "root"), named, ["root"], ["node"]).select("node", "component_id"), "by-node")
    found = lookup(rows.select("doc_id", "n", "node", "text_key"), by_node, ["node"], ["doc_id", "text_key"])
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
