"""Benchmark decontamination over a positional inverted index.

``build`` stores postings of all training words: the corpus is cut into segments, and each
segment row holds its words and, word after word, the places where it stands. Segments are
made from whole documents where these are read, so a frequent word is many short lists
and never one long one, and nothing is shuffled. Each window of a benchmark text is led by its
rarest word to the segments that hold it; there the places of the window's rarest word, moved
back by its offset, are narrowed by the moved lists of the next rarer words until none or
the window's places are left.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.common import free_names, in_chunks, rows_of, small
from turnwise.session import written

WINDOW = 13
#: Words after which a segment is closed; a longer document is a segment of its own.
SEGMENT_WORDS = 250_000
#: Bytes of benchmark text that are looked for in a segment at once; more comes in several parts.
PASS_BYTES = 8_000_000
#: Bytes of texts for all segments that may be broadcast; more meet the segments by a shuffle.
SENT_BYTES = 64_000_000
#: Fixed: bytes outside words become blanks, A-Z become a-z.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
_SEGMENT = pa.schema(
    [
        ("segment", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int32())),
        ("words", pa.list_(pa.binary())),
        ("counts", pa.list_(pa.int32())),
        ("places", pa.binary()),
    ]
)
_SEGMENT_DDL = (
    "segment long, doc_ids array<long>, sizes array<int>, words array<binary>, counts array<int>, places binary"
)
_TEXT_MATCH = pa.schema(
    [
        ("segment", pa.int64()),
        ("ordinal", pa.int32()),
        ("doc_id", pa.int64()),
        ("text_key", pa.int64()),
        ("first", pa.int32()),
        ("stop", pa.int32()),
    ]
)
_MATCH = pa.schema(
    [
        ("segment", pa.int64()),
        ("ordinal", pa.int32()),
        ("doc_id", pa.int64()),
        ("item", pa.string()),
        ("first", pa.int32()),
        ("stop", pa.int32()),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z after lower-casing A-Z, and all characters beyond ASCII."""
    return (text or "").encode().translate(_WORD_BYTES).split()


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 32
    done = 0
    doc_ids, sizes, numbers, known = [], [], [], {}

    def close() -> pa.RecordBatch:
        nonlocal doc_ids, sizes, numbers, known, done
        of = np.array(numbers, np.int32)
        counts = np.bincount(of, minlength=len(known))
        places = np.argsort(of, kind="stable").astype("<i4")
        values = [base + done], [doc_ids], [sizes], [list(known)], [counts.astype(np.int32)], [places.tobytes()]
        done += 1
        doc_ids, sizes, numbers, known = [], [], [], {}
        return pa.RecordBatch.from_arrays(
            [pa.array(v, f.type) for v, f in zip(values, _SEGMENT, strict=True)], schema=_SEGMENT
        )

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            words = words_of(text.as_py())
            if numbers and len(numbers) + len(words) > SEGMENT_WORDS:
                yield close()
            number = known.setdefault
            numbers += [number(w, len(known)) for w in words]
            doc_ids.append(doc_id.as_py())
            sizes.append(len(words))
    if doc_ids:
        yield close()


def build(documents: DataFrame) -> DataFrame:
    """The stored index: a row per segment. Null text has no words, but its row is indexed too."""
    rows = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_segments, _SEGMENT_DDL)
    return written(rows, "postings")


def documents_of(index: DataFrame) -> DataFrame:
    """``segment, ordinal, doc_id, n_words`` of every indexed row."""
    return index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "sizes")).alias("ordinal", "d")).select(
        "segment", "ordinal", F.col("d.doc_ids").alias("doc_id"), F.col("d.sizes").cast("long").alias("n_words")
    )


def windows(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All runs of ``size`` words; a shorter, but not empty, list is one run."""
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def exact_places(lists: dict[bytes, np.ndarray], phrase: tuple[bytes, ...]) -> np.ndarray:
    """Where ``phrase`` begins: the moved list of its rarest word, narrowed by those of the next rarer ones."""
    found = [lists.get(w) for w in phrase]
    if any(f is None for f in found):
        return np.zeros(0, np.int64)
    start = None
    for offset in sorted(range(len(phrase)), key=lambda i: len(found[i])):
        places = found[offset]
        if start is None:
            start = places.astype(np.int64) - offset
            continue
        wanted = start + offset
        at = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
        start = start[places[at] == wanted]
        if not len(start):
            break
    return start


def near_places(
    lists: dict[bytes, np.ndarray], phrase: tuple[bytes, ...], slop: int, starts: np.ndarray
) -> list[tuple[int, int]]:
    """First and last place of proximity matches of ``phrase`` inside single documents.

    A match is a start s and a place of its own for each word, in one document, that lies at
    most ``slop`` from s plus the word's offset. Each start around the places of the rarest word is
    tried; the words then take the first free places in reach, which is right because words
    that compete for places are equal and their reaches move on together.
    """
    found = [lists.get(w) for w in phrase]
    if any(f is None for f in found):
        return []
    rarest = min(range(len(phrase)), key=lambda i: len(found[i]))
    out = set()
    for place in found[rarest].tolist():
        doc = int(np.searchsorted(starts, place, side="right")) - 1
        low, high = int(starts[doc]), int(starts[doc + 1])
        for s in range(place - rarest - slop, place - rarest + slop + 1):
            used: dict[bytes, int] = {}  # of each word the first place that is free
            taken = []
            for offset, word in enumerate(phrase):
                places = found[offset]
                least = max(low, s + offset - slop, used.get(word, 0))
                at = int(np.searchsorted(places, least))
                if at == len(places) or places[at] >= high or places[at] > s + offset + slop:
                    break
                taken.append(int(places[at]))
                used[word] = taken[-1] + 1
            else:
                out.add((min(taken), max(taken)))
    return sorted(out)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, stop in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((first, stop))
    return out


def _found_in(row: dict, phrases: dict[tuple[bytes, ...], list], slop: int) -> Iterator[tuple]:
    """Matches (segment, ordinal, doc_id, item, first, stop) in one row of the index."""
    starts = np.concatenate([[0], np.cumsum(row["sizes"].values.to_numpy())]).astype(np.int64)
    stops = np.cumsum(row["counts"].values.to_numpy())
    places = np.frombuffer(row["places"].as_buffer(), "<i4")
    needed = sorted({w for phrase in phrases for w in phrase})
    known = pc.index_in(pa.array(needed, pa.binary()), value_set=row["words"].values) if len(stops) else None
    lists = {}
    for word, at in zip(needed, known.to_pylist() if known is not None else [None] * len(needed), strict=True):
        if at is not None:
            lists[word] = places[stops[at - 1] if at else 0 : stops[at]]
    spans: dict[tuple[int, object], list[tuple[int, int]]] = {}
    for phrase, items in phrases.items():
        if slop:
            ends = near_places(lists, phrase, slop, starts)
            first, last = (np.array(c, np.int64) for c in (zip(*ends, strict=True) if ends else ((), ())))
        else:
            first = exact_places(lists, phrase)
            last = first + len(phrase) - 1
        if not len(first):
            continue
        owner = np.searchsorted(starts, first, side="right") - 1
        inside = last < starts[owner + 1]
        for o, a, b in zip(owner[inside].tolist(), first[inside].tolist(), last[inside].tolist(), strict=True):
            for item in items:
                spans.setdefault((o, item), []).append((a - int(starts[o]), b + 1 - int(starts[o])))
    for (o, item), held in spans.items():
        for a, b in _merged(held):
            yield row["segment"].as_py(), o, row["doc_ids"][o].as_py(), item, a, b


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield {name: batch.column(name)[row] for name in batch.schema.names}


def search(index: DataFrame, phrases: dict[tuple[bytes, ...], list[str]], slop: int = 0) -> DataFrame:
    """``segment, ordinal, doc_id, item, first, stop``: where a few given phrases stand, in words of the document.

    ``phrases`` maps a phrase to the items that hold it. Overlapping matches of one item are
    one row. With ``slop`` a word may stand up to that many places from where the phrase has it.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_chunks((m for row in _rows(batches) for m in _found_in(row, phrases, slop)), _MATCH)

    return index.mapInArrow(
        run, "segment long, ordinal int, doc_id long, item string, first int, stop int"
    )


def _item_words(texts: DataFrame, window: int) -> DataFrame:
    """``text_key, pos, word, size``: the words of each text and how many make one of its windows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("text_key", pa.int64()), ("pos", pa.int32()), ("word", pa.binary()), ("size", pa.int32()), ("n", pa.int32())])

        def every():
            for key, text in rows_of(batches, "text_key", "text"):
                words = words_of(text)
                for pos, word in enumerate(words):
                    yield key, pos, word, min(window, len(words)), len(words)

        yield from in_chunks(every(), schema, 10_000)

    return texts.mapInArrow(run, "text_key long, pos int, word binary, size int, n int")


def _where_to_look(index: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """``segment, text_key``: segments that hold the rarest word of some window of a text.

    A window with a word that the corpus lacks is nowhere. Only the benchmark's words are
    taken from the index, a row per word and segment.
    """
    words = written(_item_words(texts, window), "benchmark-words")
    listed = index.select("segment", F.explode(F.arrays_zip("words", "counts")).alias("w")).select(
        "segment", F.col("w.words").alias("word"), F.col("w.counts").alias("count")
    )
    listed = written(listed.join(words.select("word").distinct(), "word", "left_semi"), "benchmark-postings")
    df = listed.groupBy("word").agg(F.sum("count").alias("df"))
    ahead = Window.partitionBy("text_key").orderBy("pos").rowsBetween(Window.currentRow, window - 1)
    of = words.join(df, "word", "left").withColumn("rarest", F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).over(ahead))
    begins = of.filter("pos <= n - size and rarest.df > 0")
    rarest = begins.select("text_key", F.col("rarest.word").alias("word")).distinct()
    return listed.join(rarest, "word").select("segment", "text_key").distinct()


def search_items(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """``segment, ordinal, doc_id, text_key, first, stop``: where windows of the items' texts stand.

    ``index`` is a stored one. Texts are looked for once, however many items have them, and only in
    segments with the rarest word of one of their windows; they travel to these in parts
    of at most some ``PASS_BYTES``, and none passes through the driver. Null texts have no windows.
    """
    texts = items.select(F.xxhash64("text").alias("text_key"), "text").dropna().dropDuplicates(["text_key"])
    texts = written(texts, "benchmark-texts")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // PASS_BYTES))
    pairs = _where_to_look(index, texts, window)
    packed = (
        pairs.join(texts, "text_key")
        .groupBy("segment", F.pmod(F.xxhash64("text_key"), F.lit(parts)).alias("part"))
        .agg(F.collect_list(F.struct("text_key", "text")).alias("texts"))
    )
    packed = written(packed.select("segment", "texts"), "segment-texts")
    # The longer side stays where it is if the texts that it meets are counted to be few bytes.
    sent = packed.agg(F.coalesce(F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t["text"]))), F.lit(0))).first()[0]
    met = index.join(F.broadcast(packed) if sent <= SENT_BYTES else packed, "segment")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def matches():
            for row in _rows(batches):
                phrases: dict[tuple[bytes, ...], list[int]] = {}
                for one in row["texts"].as_py():
                    for phrase in windows(words_of(one["text"]), window):
                        held = phrases.setdefault(phrase, [])
                        if one["text_key"] not in held:
                            held.append(one["text_key"])
                yield from _found_in(row, phrases, slop)

        yield from in_chunks(matches(), _TEXT_MATCH)

    return met.mapInArrow(run, "segment long, ordinal int, doc_id long, text_key long, first int, stop int")


def contamination(documents: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """Per row ``doc_id, n_words, n_hit, items, contaminated``.

    A word inside any occurrence of a window is hit; ``items`` are the sorted ids of items
    with occurring windows; a document is contaminated if it has hits and these are at least
    one in ``share`` of its words. Rows without words are clean, repeated rows are judged each.
    """
    index = build(documents)
    matches = written(search_items(index, items, window), "benchmark-matches")
    names = items.select(
        F.xxhash64("text").alias("text_key"), F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    ).distinct()
    # A document's matches are few: spans are merged per text, and a row is one document.
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("reach")),
        lambda done, span: F.struct(
            (done["hit"] + F.greatest(F.lit(0), span["stop"] - F.greatest(span["first"], done["reach"]))).alias("hit"),
            F.greatest(done["reach"], span["stop"]).alias("reach"),
        ),
        lambda done: done["hit"],
    )
    by = ["segment", "ordinal"]
    spans = matches.groupBy(*by).agg(F.collect_set(F.struct("first", "stop")).alias("spans"))
    held = matches.select(*by, "text_key").distinct().join(names, "text_key").groupBy(*by).agg(F.collect_set("item").alias("items"))
    hits = spans.join(held, by).select(*by, covered.alias("n_hit"), F.array_sort("items").alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return documents_of(index).join(hits, ["segment", "ordinal"], "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def clean(documents: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """``documents`` without the contaminated rows; each row is judged by its own text."""
    key = F.xxhash64("doc_id", "text")
    (bad,) = free_names(documents, "bad")
    found = contamination(documents.select(key.alias("doc_id"), "text"), items, window, share)
    gone = written(found.filter("contaminated").select(F.col("doc_id").alias(bad)).distinct(), "contaminated")
    return documents.join(small(gone), key == F.col(bad), "left_anti")
