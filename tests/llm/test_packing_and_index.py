"""Packing against the plain tokenizer and a plain best fit; the index against plain search."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import odd_documents, prose
from turnwise.llm import decontam, packing
from turnwise.llm.common import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_equal_the_tokenizer(tokenizer):
    words = packing.WordIds(PATH)
    rnd = random.Random(7)
    alphabet = "aAzZéÉßİıſ'.,!?-_…™½²٣ك中🎉0123456789<|>\n\tsSm   " + "".join(map(chr, (0x1C, 0x85, 0xA0, 0x301, 0x200D, 0x2003, 0x212A)))
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(80))) for _ in range(1500)]
    texts += [t or "" for _, t in odd_documents()]
    assert words.of(texts) == [words.direct(t) for t in texts]


def test_packed_documents(spark, documents, tokenizer):
    rows = packing.pack_documents(documents, PATH, 64).collect()
    want = []
    for doc_id, text in odd_documents():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want.append((doc_id, piece, at, len(part), zlib.crc32(part.tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        reach = 0
        for offset, length in sorted(places):
            assert offset == reach
            reach += length
        assert reach <= 64
    assert len(held) == plain_best_fit([r["length"] for r in rows], 64)


def plain_best_fit(lengths, capacity):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - length)
        else:
            gaps.append(capacity - length)
    return len(gaps)


@pytest.mark.parametrize("seed", range(30))
def test_runs_pack_like_single_pieces(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([1, 2, 7, 32, 100])
    counts = {n: rnd.choice([1, 2, 5, 40]) for n in range(1, capacity + 1) if rnd.random() < 0.5 and n < capacity}
    plan = packing.best_fit(counts, capacity)
    lengths = [n for n in sorted(counts) for _ in range(counts[n])]
    used, places = {}, 0
    for number, length in enumerate(lengths):
        run = np.searchsorted(plan.first, number, side="right") - 1
        inside = number - plan.first[run]
        assert plan.length[run] == length
        sequence = plan.sequence[run] + inside // plan.each[run]
        offset = plan.offset[run] + inside % plan.each[run] * length
        for t in range(offset, offset + length):
            assert 0 <= t < capacity and used.setdefault((sequence, t), number) == number
        places += length
    assert places == len(used)
    assert plan.sequences == plain_best_fit(lengths, capacity)


def test_nothing_to_pack(no_documents):
    assert packing.pack_documents(no_documents, PATH).count() == 0


def test_ids_are_given_out(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = packing.tokenize(df, PATH, with_ids=True).first()
    assert zlib.crc32(bytes(row["ids"])) == row["ids_crc32"] and len(row["ids"]) == 4 * row["length"]


ITEMS = [
    (1, prose(50, 30)), (2, prose(51, 13)), (3, "tiny item"), (4, None), (5, " ,.! "), (None, prose(52, 20)),
    (6, prose(50, 30)), (10, "one"),
]


def planted():
    rows = list(odd_documents())
    rows.append((201, prose(60, 30) + "\n" + prose(50, 30).upper().replace(" ", ", ") + "\n" + prose(61, 40)))
    rows.append((202, " ".join(prose(50, 30).split()[5:18]) + " " + prose(62, 400)))
    rows.append((203, " ".join(prose(50, 30).split()[5:17])))
    rows.append((204, prose(51, 13)))
    rows.append((205, " ".join(prose(52, 20).split()[:10])))
    rows.append((206, " ".join(prose(52, 20).split()[10:])))
    rows.append((207, "a tiny item of a tiny item"))
    return rows


def plain_contamination(text, items, share=20):
    words = decontam.words_of(text)
    hit, found = set(), set()
    for item, body in items:
        for window in decontam.windows(decontam.words_of(body)):
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found), bool(hit) and share * len(hit) >= len(words)


@pytest.mark.parametrize("passes", [1, 5])
def test_contamination_equals_plain_search(spark, monkeypatch, passes):
    if passes > 1:
        monkeypatch.setattr(decontam, "PASS_BYTES", 300)
    rows = [r for r in planted() if r[0] != 10]  # the long text takes the plain search too long
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, items string").repartition(3)
    items = spark.createDataFrame([(*r, "y") for r in ITEMS], "item_id long, text string, doc_id string")
    got = [
        (r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"])
        for r in decontam.contamination(docs, items).collect()
    ]
    want = [(i, *plain_contamination(t, ITEMS)) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[0] for r in got if r[4]} >= {7, 201, 204}


def test_phrases_do_not_cross_documents(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta")], "doc_id long, text string").coalesce(1)
    index = decontam.build(docs)
    assert decontam.search(index, {(b"beta", b"gamma"): ["x"]}).count() == 0
    assert decontam.search(index, {(b"alpha", b"beta"): ["x"]}).count() == 1


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha very beta gamma"), (2, "alpha so very much beta gamma")], "doc_id long, text string")
    index = decontam.build(docs)
    phrase = {(b"alpha", b"beta", b"gamma"): ["x"]}
    assert decontam.search(index, phrase).count() == 0
    near = decontam.search(index, phrase, slop=1).collect()
    assert [(r["doc_id"], r["first"], r["stop"]) for r in near] == [(1, 0, 4)]


def plain_near(words, phrase, slop):
    """Spans of all starts for which some choice of different places is in reach."""
    out = set()
    for s in range(-len(phrase) - slop, len(words) + slop):
        reach = [[p for p in range(max(0, s + i - slop), min(len(words), s + i + slop + 1)) if words[p] == w] for i, w in enumerate(phrase)]
        if any(len(set(c)) == len(phrase) for c in itertools.product(*reach)):
            out.add(s)
    return out


def test_proximity_equals_plain_search(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice("aabcx") for _ in range(rnd.randrange(12)))) for i in range(60)]
    # One word is not two, and a neighbouring document neither helps nor hides a match.
    rows += [(100, "a"), (101, "b x a"), (102, "b"), (103, "a"), (104, "a a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    index = decontam.build(docs)
    for phrase in ("a a", "b a", "a b c", "c a a", "a b a b"):
        words = tuple(w.encode() for w in phrase.split())
        for slop in (0, 1, 2):
            got = {r["doc_id"] for r in decontam.search(index, {words: ["x"]}, slop).collect()}
            assert got == {i for i, t in rows if plain_near([w.encode() for w in t.split()], words, slop)}
    pairs = spark.createDataFrame([(7, "b a"), (8, "a a"), (9, "b a")], "item_id long, text string")
    near = decontam.search_items(index, pairs, slop=1).collect()
    keys = {decontam_key(spark, t): t.split() for t in ("b a", "a a")}
    assert {(r["doc_id"], " ".join(keys[r["text_key"]])) for r in near} == {
        (i, " ".join(p)) for i, t in rows for p in keys.values() if plain_near(t.split(), tuple(p), 1)
    }


def decontam_key(spark, text):
    return spark.createDataFrame([(text,)], "text string").select(F.xxhash64("text")).first()[0]


def test_items_that_share_a_text_and_large_benchmarks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SENT_BYTES", 0)
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", 50)
    rows = [r for r in planted() if r[0] != 10]
    items = [*ITEMS, *[(1000 + i, t) for i, t in ITEMS if i is not None]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = decontam.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = [(i, *plain_contamination(t, items)) for i, t in rows]
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got), key=str) == sorted(want, key=str)


def test_long_documents_and_small_segments(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", 100)
    docs = spark.createDataFrame([r for r in planted()], "doc_id long, text string").coalesce(1)
    index = decontam.build(docs)
    listed = decontam.documents_of(index).collect()
    assert sorted(r["n_words"] for r in listed) == sorted(len(decontam.words_of(t)) for _, t in planted())


def test_empty_sides(spark, documents, no_documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.contamination(no_documents, items).count() == 0
    clean = decontam.contamination(documents, items.limit(0))
    assert clean.filter("contaminated or n_hit > 0").count() == 0 and clean.count() == documents.count()


def test_clean_keeps_columns_and_clean_rows(spark, documents):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    left = decontam.clean(documents, items)
    assert left.columns == documents.columns
    gone = {r["doc_id"] for r in documents.collect()} - {r["doc_id"] for r in left.collect()}
    assert gone == {7, 8}
