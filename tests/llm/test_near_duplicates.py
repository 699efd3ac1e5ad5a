"""SimHash, line groups, components and MinHash against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import odd_documents, prose
from turnwise.llm import fingerprints, line_dedup, simhash
from turnwise.llm.components import components, extended


def groups(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rnd = random.Random(seed)
    n = 60
    pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    pairs += [(0, i) for i in range(200, 260)] + pairs[:5] + [(3, 3)]
    df = spark.createDataFrame([*pairs, (None, 1), (2, None)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    want = groups(300, pairs)
    assert got == {x: want[x] for p in pairs for x in p if p[0] != p[1]} | {k: v for k, v in got.items() if want[k] == v}
    assert components(df.limit(0)).count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_of_odd_documents(documents):
    rows = odd_documents()
    prints = [plain_fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = groups(len(rows), pairs)
    first = {}
    for (doc_id, _), g in zip(rows, root):
        if doc_id is not None:
            first[g] = min(doc_id, first.get(g, doc_id))
    want = [(d, p - (1 << 64) if p >> 63 else p, first.get(g)) for (d, _), p, g in zip(rows, prints, root)]
    got = [tuple(r) for r in simhash.near_duplicates(documents).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_long_texts_are_counted_in_parts():
    rnd = np.random.default_rng(1)
    sizes = np.array([0, 3, 200_000, 1, 65_535, 65_536, 0])
    hashes = rnd.integers(0, 2**64, sizes.sum(), dtype=np.uint64)
    got = simhash.majority_bits(hashes, sizes)
    at = 0
    for size, value in zip(sizes, got):
        bits = np.unpackbits(hashes[at : at + size].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
        assert int(value) == sum(1 << b for b in range(64) if 2 * int(bits[b]) > size)
        at += size


@pytest.mark.parametrize("bits", [0, 1, 3, 4, 6])
def test_every_pair_in_reach_is_connected(spark, monkeypatch, bits):
    """Chains, a crowded group beyond one block, and far ones."""
    monkeypatch.setattr(simhash, "BLOCK", 40)
    rnd = random.Random(bits)
    prints = {rnd.getrandbits(64) for _ in range(200)}
    for base in [0, rnd.getrandbits(64), (1 << 64) - 1]:
        for _ in range(120):
            flipped = base
            for b in rnd.sample(range(64), rnd.randrange(bits + 3)):
                flipped ^= 1 << b
            prints.add(flipped)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(s,) for s in signed], "fingerprint long").repartition(3)
    links = simhash.links(nodes, bits).collect()
    place = {s: i for i, s in enumerate(signed)}
    got = groups(len(prints), [(place[r["u"]], place[r["v"]]) for r in links])
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= bits]
    assert got == groups(len(prints), pairs)
    assert all(((r["u"] ^ r["v"]) & (2**64 - 1)).bit_count() <= bits for r in links)


def test_one_document_of_each_group_stays(documents, no_documents):
    left = simhash.one_per_group(documents)
    assert left.columns == documents.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert ids.count(9) == 1 and ids.count(None) == 2 and 2 not in ids and 13 not in ids and {1, 4} <= set(ids)
    assert simhash.one_per_group(no_documents).count() == 0


def test_rows_are_told_apart_by_id_and_text(spark):
    a, b, c = prose(40, 60), prose(41, 60), prose(42, 60)
    shape = "doc_id long, text string, `_gone` string, `my col` int"

    def left(*rows):
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], shape).repartition(2)
        out = simhash.one_per_group(df)
        assert out.columns == df.columns
        return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)

    assert left((1, a), (2, a), (2, b)) == sorted([(1, a), (2, b)], key=str)
    assert left((1, a), (1, a), (2, b)) == sorted([(1, a), (2, b)], key=str)
    # Rows without an id stay, whether or not another id repeats.
    for more in ((), ((3, c), (3, c))):
        got = left((None, a), (None, a), (2, b), *more)
        assert got.count((None, a)) == 2 and got.count((2, b)) == 1 and got.count((3, c)) == min(1, len(more))
    assert left((5, a), (7, a), (None, a)) == sorted([(5, a), (None, a)], key=str)


def test_odd_names_of_columns(spark):
    rows = [(1, prose(1, 30), "x"), (2, prose(1, 30), "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `_lost` string").withColumn("_doc", F.lit(1)).withColumn("my col", F.lit(2))
    assert line_dedup.dedup(df).columns == df.columns and line_dedup.dedup(df).count() == 1


def test_components_grow_with_new_links(spark):
    rnd = random.Random(3)
    first = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(20)]
    second = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(25)]
    one, two, none = (spark.createDataFrame(p, "u long, v long") for p in (first, second, [(0, 0)]))
    roots = extended(components(one), two)
    want = groups(60, first + second)
    touched = {x for p in first if p[0] != p[1] for x in p} | {x for p in second for x in p}
    assert {r["node"]: r["root"] for r in roots.collect()} == {x: want[x] for x in touched}
    assert extended(components(one), none.limit(0)).count() == components(one).count()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_classes(rows):
    seen = [(d, n, line.lower().split()) for d, t in rows for n, line in enumerate((t or "").split("\n")) if line.split()]
    norms = sorted({" ".join(w) for _, _, w in seen})
    words = [n.split(" ") for n in norms]

    def print_of(line):
        hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in set(line)]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [print_of(w) for w in words]
    pairs = [
        (i, j)
        for i in range(len(norms))
        for j in range(i)
        if (prints[i] ^ prints[j]).bit_count() <= 4
        and edits(words[i], words[j]) <= int(0.2 * max(len(words[i]), len(words[j])) + 1e-9)
    ]
    root = dict(zip(norms, groups(len(norms), pairs)))
    first = {}
    for d, n, w in seen:
        g = root[" ".join(w)]
        key = (d is not None, d or 0, n)
        first[g] = min(key, first.get(g, key))
    return sorted(((d, n, *[x for x in first[root[" ".join(w)]][1:]]) for d, n, w in seen), key=str)


def variants(n):
    """Lines that differ in a word or two, many of which share keys."""
    rnd = random.Random(5)
    base = prose(70, 60).replace("\n", " ").split()
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rnd.randrange(3)):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(500)}"
        out.append((500 + i, " ".join(words) + ("\n" + prose(71, 24) if i % 3 else "")))
    return out


@pytest.mark.parametrize("crowd", [32, 3])
def test_line_classes_equal_plain_search(spark, monkeypatch, crowd):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    rows = [r for r in odd_documents() if r[0] not in (9, 10, None)] + variants(60)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, norm string").repartition(3)
    got = line_dedup.classes(docs).collect()
    assert sorted(((r["doc_id"], r["line_no"], r["class_doc"], r["class_line"]) for r in got), key=str) == plain_classes(rows)
    assert all(r["kept"] == ((r["doc_id"], r["line_no"]) == (r["class_doc"], r["class_line"])) for r in got)


def test_deduplicated_documents(documents, no_documents):
    left = line_dedup.dedup(documents)
    assert left.columns == documents.columns
    rows = left.collect()
    texts = {r["doc_id"]: r for r in rows}
    assert 2 not in texts and 13 not in texts  # nothing but repeated lines
    assert {4, 5, 6, 10, 11, 12} <= set(texts)  # without lines, or with their own
    assert sum(r["doc_id"] == 9 for r in rows) == 2  # repeated rows share one fate
    long = texts[14]["text"].split("\n")
    assert len([x for x in long if x]) == len(set(long) - {""}) and "" in long
    assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
    assert line_dedup.dedup(no_documents).count() == 0


def test_lines_of_very_many_words(spark):
    """More different words than the shared counters hold."""
    rnd = random.Random(8)
    texts = [" ".join({f"w{rnd.randrange(10**7)}" for _ in range(n)}) for n in (40_000, 33_000, 32_000, 5)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["line"]: r["simhash"] for r in line_dedup.simhashes(line_dedup.lines(rows)).collect()}
    for text in texts:
        hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in set(text.split())], np.uint64)
        ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
        want = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0]
        key = np.uint64(xxhash.xxh64_intdigest(text, 42)).astype(np.int64)
        assert got[int(key)] == want


def test_bits_of_lines_up_to_the_bound_and_beyond(spark):
    """Even and odd numbers of words, with repeats, on both sides of the bound."""
    rnd = random.Random(9)
    sizes = [*range(1, 40), 63, 64, 127, 128, 200, 253, 254, 255, 256, 257, 300, 511, 512, 600]
    texts = [" ".join([f"v{i}x{n}" for i in range(n)] + [f"v{rnd.randrange(n)}x{n}" for _ in range(n % 5)]) for n in sizes]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.hashed_lines(line_dedup.lines(rows)).collect()}
    for i, text in enumerate(texts):
        hashes = [xxhash.xxh64_intdigest(w, 42) for w in set(text.split())]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert got[i]["simhash"] & (1 << 64) - 1 == want and got[i]["n_words"] == len(text.split())


def test_a_text_is_hashed_before_it_is_cut(spark):
    """Not once for each of its lines; and lines of white space alone are none."""
    rows = spark.createDataFrame([(1, "A b\n \t\n\n\x0b\r\n c  D ")], "doc_id long, text string")
    found = line_dedup.lines(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("xxhash64(text")
    assert sorted((r["line_no"], r["norm"]) for r in found.collect()) == [(0, "a b"), (4, "c d")]


def test_more_blocks_for_more_lines():
    for n in (0, 10, 10**6, 10**8, 10**11):
        blocks = line_dedup._blocks(n, 4)
        assert 2 ** (64 * (blocks - 4) / blocks) >= n / 2 or blocks == 12


def test_few_masks_find_all_hashes_in_reach():
    """Fewer keys than all choices of blocks, and no four places touch every mask."""
    rnd = random.Random(12)
    for n in (0, 10**5, 2 * 10**6, 10**8, 10**9, 10**12):
        masks = line_dedup.choices(n, 4)
        blocks = line_dedup._blocks(n, 4)
        assert len(masks) <= math.comb(blocks, 4)
        for _ in range(20_000):
            flips = sum(1 << b for b in rnd.sample(range(64), 4))
            assert any(not flips & m for m in masks)
    assert len(line_dedup.choices(2 * 10**6, 4)) == 9 and len(line_dedup.choices(12 * 10**7, 4)) == 27
    for bits in (1, 2, 3, 5):
        for flips in ([1 << b for b in range(64)] if bits == 1 else [sum(1 << b for b in rnd.sample(range(64), bits)) for _ in range(5000)]):
            assert any(not flips & m for m in line_dedup.choices(10**6, bits))


@pytest.mark.parametrize("crowd, broadcast", [(32, 0), (1, 10**6)])
def test_classes_when_some_hashes_tell_the_crowded_keys(spark, monkeypatch, crowd, broadcast):
    """Which keys are taken for crowded, and whether texts are shuffled, changes no class."""
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    monkeypatch.setattr(line_dedup, "FEW", 0)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", broadcast)
    rows = [r for r in odd_documents() if r[0] not in (9, 10, None)] + variants(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = line_dedup.classes(docs).collect()
    assert sorted(((r["doc_id"], r["line_no"], r["class_doc"], r["class_line"]) for r in got), key=str) == plain_classes(rows)


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_fingerprints_and_neighbours(spark, documents):
    rows = [(d, t or "") for d, t in dict.fromkeys(odd_documents())]
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    got = fingerprints.with_neighbours(documents).collect()
    assert len(got) == len(odd_documents())
    known = {r["doc_id"]: r for r in got}
    errors = []
    for (doc_id, text), (_, following) in zip(order, order[1:]):
        row, cut = known[doc_id], len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(text), shingles(edited), shingles(following)
        errors += [row["near_edited"] - len(a & b) / len(a | b), row["near_next"] - len(a & c) / len(a | c)]
    assert np.abs(errors).max() < 0.2 and abs(np.mean(errors)) < 0.02
    assert known[1]["fingerprint"] == known[2]["fingerprint"] == known[13]["fingerprint"]
    assert known[4]["fingerprint"] == known[5]["fingerprint"] == known[6]["fingerprint"]
    assert all(len(r["fingerprint"]) == 128 for r in got)


def test_the_last_is_followed_by_the_first(spark):
    df = spark.createDataFrame([(1, "abcdef"), (2, "ghi"), (3, "uvwxyz")], "doc_id long, text string")
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.with_neighbours(df).collect()}
    want = {3: "uvwxgh", 2: "gha", 1: "abcduv"}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}
    one = fingerprints.with_neighbours(df.filter("doc_id = 1")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0
    assert fingerprints.with_neighbours(df.limit(0)).count() == 0


def test_likeness_is_unbiased_for_many_pairs(spark):
    rows = []
    for i in range(200):
        words = prose(900 + i, 150).split()
        rows.append((i, " ".join(words), " ".join(words[: 150 - i // 2] + prose(2000 + i, 150).split()[: i // 2])))
    df = spark.createDataFrame(rows, "doc_id long, a string, b string")
    both = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "a", "x"), "b", "y")
    got = {r["doc_id"]: r["l"] for r in both.select("doc_id", fingerprints.likeness("x", "y").alias("l")).collect()}
    errors = [got[i] - len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for i, a, b in rows]
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


def test_recall_of_fuzzy_lines_by_edit_similarity_alone(spark):
    """Of pairs that word edits alone call alike, how many share a class: what the README states."""
    rnd = random.Random(11)
    rows, pairs = [], []
    for g in range(60):
        words = prose(3000 + g, 80).split()
        other = list(words)
        for _ in range(1 + g % 4):  # 0.99 to 0.95
            other[rnd.randrange(80)] = f"new{rnd.randrange(10**6)}"
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
        pairs.append((2 * g, 2 * g + 1, edits(words, other)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    of = {r["doc_id"]: r["class_doc"] for r in line_dedup.classes(df).collect()}
    one_word = [of[a] == of[b] for a, b, n in pairs if n == 1]
    assert all(n <= 4 for _, _, n in pairs) and np.mean(one_word) > 0.5
    assert np.mean([of[a] == of[b] for a, b, _ in pairs]) > 0.25
