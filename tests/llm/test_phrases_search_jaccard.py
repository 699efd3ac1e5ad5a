"""Collocations, ranked search and the similarity join against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import CLASHING, odd_documents, prose
from tests.llm.test_near_duplicates import groups
from turnwise.llm import hashing, jaccard, lexical, phrases


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- names and filters ---------------------------------------------------------


def test_names_of_pairs_and_the_filter(spark):
    rnd = np.random.default_rng(1)
    names = rnd.integers(1, 2**63, 3000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    a, b = names[:1500], names[1500:]
    both = hashing.joined(a, b)
    assert len(set(both.tolist())) == 1500 and not set(both.tolist()) & set(hashing.joined(b, a).tolist())
    assert not hashing.joined(np.array([0, 5], np.uint64), np.array([5, 0], np.uint64)).any()
    df = spark.createDataFrame([(int(x),) for x in np.r_[a, [np.uint64(1)]].view(np.int64)], "unit long")
    bits = hashing.spread_filter(df, "unit")
    assert hashing.passes(bits, a).all() and hashing.passes(bits, b).sum() < 5
    assert not hashing.passes(bits, np.zeros(3, np.uint64)).any()
    assert not hashing.spread_filter(df.limit(0), "unit").any()
    words = hashing.WordHashes()
    assert words.of([b"a", b"b", b"a"]).tolist() == [words[b"a"], words[b"b"], words[b"a"]]


# --- phrases -------------------------------------------------------------------


def plain_collocations(rows, least, first):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        open_ = []
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            open_.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]], p))
        covers = Counter()
        for _, a, *_, p in open_:
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    covers[p[i : i + size]] = max(covers[p[i : i + size]], -a)
        kept = sorted(o for o in open_ if not 100 * covers[o[5]] >= 80 * -o[1])
        out += [(lang, i, o[2].decode(), -o[1], o[3], o[4], n[lang], -o[0]) for i, o in enumerate(kept[:first], 1)]
    return sorted(out)


def text_rows():
    rnd = random.Random(8)
    words = ["Alpha", "beta", "gamma", "δelta", "東京", "e-f", "g h", "I", "j\x00", "\x1ck", "l'm"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", ";\n", "\r\n", "\x0b", "\x0c", "? "]
    rows = [
        (rnd.choice(["en", "de", None, "und"]), "".join(rnd.choice(words[: 4 + i % 8]) + rnd.choice(marks) for _ in range(rnd.randrange(60))))
        for i in range(300)
    ]
    rows += [("en", None), (None, ""), ("fr", "x " * 4000), ("it", "rare one here"), ("en", "alpha beta gamma δelta " * 400)]
    return rows + rows[:20]


@pytest.fixture(scope="module")
def texts(spark):
    extra = ("word", "unit", "n", "left", "place", "my col")
    rows = [(i, t, lang, *["x"] * len(extra)) for i, (lang, t) in enumerate(text_rows())]
    shape = ", ".join(f"`{c}` string" for c in extra)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, {shape}").repartition(5)


@pytest.mark.parametrize("least, first", [(30, 2000), (3, 7)])
def test_collocations(texts, least, first):
    got = phrases.collocations(texts, least=least, first=first)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain_collocations(text_rows(), least, first)
    assert sorted(map(tuple, got.collect())) == want and len({w[0] for w in want}) >= 4


def test_dense_and_listed_tiles_count_alike(texts, monkeypatch):
    want = sorted(map(tuple, phrases.collocations(texts, least=5).collect()))
    # Dense from the first pair on, lists that are sent at once, and hardly any ranked word.
    rnd = np.random.default_rng(3)
    names = np.unique(rnd.integers(1, 2**63, 50, dtype=np.uint64))

    class Ranked:
        by_rank = names[rnd.permutation(len(names))][:40]

        def ranks(self, x):
            order = {int(v): i for i, v in enumerate(self.by_rank)}
            return np.array([order.get(int(v), -1) for v in x])

    left, right = rnd.choice(names, 5000), rnd.choice(names, 5000)
    plain = Counter(zip(left.tolist(), right.tolist()))
    for crowded in (1, 10**9):
        monkeypatch.setattr(phrases, "CROWDED", crowded)
        counts = phrases.TileCounts(Ranked())
        for at in range(0, 5000, 700):
            counts.add(left[at : at + 700], right[at : at + 700])
        found = Counter()
        for batch in [*counts.listed_rows(), *counts.dense_rows()]:
            for u, a, b, n in zip(*(batch.column(i).to_numpy().view(np.uint64).tolist() for i in range(4))):
                assert u == int(hashing.joined(np.array([a], np.uint64), np.array([b], np.uint64))[0])
                found[a, b] += n
        assert found == plain and bool(counts.dense) == (crowded == 1)
    assert want


def test_collocations_of_nothing(texts):
    assert phrases.collocations(texts.limit(0)).count() == 0
    assert phrases.collocations(texts.withColumn("text", F.lit(None).cast("string"))).count() == 0


# --- search --------------------------------------------------------------------


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def plain_search(documents, items, keep):
    docs = [(d, Counter(t), len(t)) for d, t in ((d, plain_terms(t)) for d, t in documents)]
    n_docs, n_words = sum(n > 0 for *_, n in docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in docs:
            m = 100 - 75 + 75 * n * n_docs // n_words if n_words else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in plain_terms(text)
                if c[t]
            )
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, i, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scored)[:keep], 1)]
    return sorted(out, key=str)


def queries_of(rnd):
    base = [(i, t) for i, t in odd_documents() if t][:14]
    items = [(i, " ".join(rnd.sample(t.split(), min(9, len(t.split()))))) for i, t in base]
    items += [(50, None), (51, ""), (52, "nothing of these zzz"), (53, "one one ONE two"), (None, "one"), (53, "one one ONE two")]
    return items + [(60 + i, items[0][1] + " " + items[1][1][: 9 * i]) for i in range(5)]


@pytest.mark.parametrize("block_bytes, cells", [(1_000_000, 6_000_000), (900, 3000)])
def test_search(spark, documents, monkeypatch, block_bytes, cells):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(lexical, "CELLS", cells)
    items = queries_of(random.Random(4))
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, score string, `my col` string")
    for keep in (10, 3):
        got = lexical.search(documents, frame, keep)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == plain_search(odd_documents(), items, keep)


def test_search_of_nothing(spark, documents, no_documents):
    items = spark.createDataFrame(queries_of(random.Random(4)), "item_id long, text string")
    assert lexical.search(no_documents, items).count() == 0
    assert lexical.search(documents, items.limit(0)).count() == 0


def test_plan_shares_sets_and_beginnings():
    texts = ["a b c d", "a b c e", "a b", "c d d", "", "a b c d", "x"]
    row = lexical.plan(list(range(7)), texts)
    # a and b are in the same queries, so they are one set; equal queries end in one node.
    assert row["item_node"][0] == row["item_node"][5] and row["item_node"][4] == 0
    assert len(row["set_start"]) < len(row["symbol_term"])
    scorer = lexical.Scorer(row | {"item_ids": list(range(7))}, {}, 10, 50)
    single = dict(zip(row["terms"], range(1, 100)))
    scorer.weight = np.array([single[t] for t in row["terms"]], np.int64)
    tf = np.ones(len(row["terms"]), np.int32)
    got = scorer.scores(np.array([4]), np.array([len(tf)]), np.arange(len(tf), dtype=np.int32), tf)[:, 0]
    m = 25 + 75 * 4 * 10 // 50
    value = 10**9 // (1000 + 8 * m)
    assert got.tolist() == [sum(single[t] * value for t in lexical.terms(text)) for text in texts]


# --- similarity join -----------------------------------------------------------


def plain_sets(rows):
    out = []
    for _, text in rows:
        words = lower(text).encode().split()
        shingles = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}
        out.append(shingles if words else set())
    return out


def plain_classes(rows):
    sets = plain_sets(rows)
    pairs = []
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                pairs.append((i, j))
    root = groups(len(rows), pairs)
    first = {}
    for (doc_id, _), g in zip(rows, root):
        if doc_id is not None:
            first[g] = min(doc_id, first.get(g, doc_id))
    return sorted([(d, len(s), first.get(g) if s else d) for (d, _), s, g in zip(rows, sets, root)], key=str), pairs


def edited(rnd, words, changes):
    words = list(words)
    for _ in range(changes):
        kind, at = rnd.randrange(3), rnd.randrange(len(words))
        if kind == 0:
            words[at] = f"new{rnd.randrange(10**6)}"
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, rnd.choice(words))
    return words


def near_rows(seed):
    """Copies with up to a few edits around the border of 0.8, a shared passage, a chain of edits."""
    rnd = random.Random(seed)
    rows, passage = [], prose(seed + 900, 30)
    for g in range(25):
        base = prose(seed * 100 + g, rnd.choice([5, 8, 20, 60, 200, 400])).split()
        rows.append(" ".join(base))
        rows += [" ".join(edited(rnd, base, rnd.randrange(0, 1 + len(base) // 30))) for _ in range(rnd.randrange(6))]
    rows += [prose(seed + 500 + i, 25) + " " + passage + " " + prose(seed + 700 + i, 25) for i in range(40)]
    chain = prose(seed + 50, 150).split()
    for _ in range(25):
        chain = edited(rnd, chain, 2)
        rows.append(" ".join(chain))
    crowd = prose(seed + 60, 80).split()
    rows += [" ".join(edited(rnd, crowd, 1 + i % 3)) for i in range(60)]
    rnd.shuffle(rows)
    return list(enumerate(rows, 1)) + odd_documents()


@pytest.mark.parametrize("seed, block, often, followers", [(1, 4000, 8, 2), (2, 7, 2, 1)])
def test_similarity_classes(spark, monkeypatch, seed, block, often, followers):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "OFTEN", often)
    monkeypatch.setattr(jaccard, "FOLLOWERS", followers)
    rows = near_rows(seed)
    extra = ("node", "text_key", "token", "group", "root", "my col")
    frame = spark.createDataFrame([(d, t, *["x"] * len(extra)) for d, t in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in extra))
    want, pairs = plain_classes(rows)
    got = jaccard.classes(frame.repartition(6))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == want and len(pairs) > 150


def test_links_between_pieces_of_a_cut_list(spark, monkeypatch):
    """Short pairs share one prefix shingle alone; long texts make its list long, but post other shingles."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "OFTEN", 2)
    passages = [" ".join(f"p{p}w{i}" for i in range(8)) for p in range(10)]
    rows = [t for p in passages for t in (p, p + " more")]
    rows += [" ".join(f"{p} " + " ".join(f"d{d}x{k}y{i}" for i in range(40)) for k, p in enumerate(passages)) for d in range(20)]
    rows = list(enumerate(rows, 1))
    want, pairs = plain_classes(rows)
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == want and len(pairs) == 10


def test_classes_of_nothing(no_documents, documents):
    assert jaccard.classes(no_documents).count() == 0
    rows = jaccard.classes(documents.withColumn("text", F.lit(" "))).collect()
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id for r in rows)


def test_bounds_never_reject_a_link():
    rnd = random.Random(2)
    order = jaccard.Order(np.zeros(0, np.uint64), np.zeros(0, np.int64), 20)
    hits = 0
    for _ in range(400):
        universe = np.array([rnd.getrandbits(64) for _ in range(rnd.randrange(1, 60))], np.uint64)
        a = np.unique(universe[[rnd.random() < 0.95 for _ in universe]])
        b = np.unique(universe[[rnd.random() < 0.95 for _ in universe]])
        common = len(np.intersect1d(a, b))
        if not len(a) or not len(b) or 100 * common < 80 * (len(a) + len(b) - common):
            continue
        hits += 1
        pa_, pb = (order.prefix(jaccard.Shingled(np.array([len(x)]), x))[2].hashes for x in (a, b))
        shared = np.intersect1d(pa_, pb)
        assert len(shared)
        for token in shared:
            i, j = (np.array([np.flatnonzero(p == token)[0]]) for p in (pa_, pb))
            assert jaccard._possible(np.array([len(a)]), i, np.array([len(b)]), j).all()
    assert hits > 100


def test_clashing_columns(documents):
    assert set(CLASHING) <= set(documents.columns)
    assert jaccard.classes(documents).count() == documents.count()
