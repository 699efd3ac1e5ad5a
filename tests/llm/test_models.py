"""Language model, quality and toxicity against plain Python and held-out labels; the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import odd_documents, prose
from turnwise.llm import lm_score, quality, toxicity
from turnwise.llm.common import tokenizer_path

PIECES = tokenizer_path("piece_bpe_32k.model")


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def test_base_scores_and_counts(documents):
    rows = odd_documents()
    count = Counter(t for d, text in rows if not held(d) for t in tokens(text))
    n, v = sum(count.values()), len(count)
    want = sorted(
        ((d, held(d), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n) for d, t in rows), key=str
    )
    got = lm_score.score(documents, PIECES).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == want
    base = sorted(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)) for _, t in rows)
    assert np.allclose(sorted(r["base_score"] for r in got), base)
    assert all(r["score"] < 0 for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[1] == pytest.approx(by_id[2]) == pytest.approx(by_id[13])
    assert by_id[4] == by_id[5] == by_id[6]


def test_blocks_do_not_change_scores(documents, monkeypatch):
    def found():
        return sorted((tuple(r) for r in lm_score.score(documents.repartition(4), PIECES).collect()), key=str)

    whole = found()
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 50)
    for a, b in zip(whole, found()):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:])


def test_marginal_equals_all_segmentations():
    pieces = {p: i for i, p in enumerate(["▁", "▁a", "▁ab", "a", "b", "ab", "ba", "c", "bc", "abc", "<0xC3>", "<0xA9>"])}
    lattice = lm_score.Lattice(pieces, {i: i + 1.0 for i in pieces.values()}, 3)
    total = sum(math.exp(p) for p in lattice.log.values()) + math.exp(lattice.end)
    total += math.exp(lattice.bytes[0xC3]) + math.exp(lattice.bytes[0xA9])
    assert total == pytest.approx(1.0)

    def every(text):
        if not text:
            return 1.0
        return sum(math.exp(p) * every(text[len(s) :]) for s, p in lattice.log.items() if text.startswith(s))

    for word in ("a", "ab", "abc", "abab", "cabba", "bbb"):
        assert lattice.word(word) == pytest.approx(math.log(every("▁" + word)))
    spelled = lattice.bytes[0xC3] + lattice.bytes[0xA9]
    assert lattice.word("é") == pytest.approx(lattice.log["▁"] + spelled)
    assert math.isfinite(lattice.word("é東" * 20_000))


def test_held_out_rows_teach_nothing(spark):
    ids = [i for i in range(40) if not held(i)][:20]
    out = next(i for i in range(40) if held(i))
    rows = [(i, prose(i, 30)) for i in ids]

    def found(text):
        df = spark.createDataFrame([*rows, (out, text)], "doc_id long, text string")
        return {r["doc_id"]: tuple(r) for r in lm_score.score(df, PIECES).collect()}

    a, b = found("entirely different"), found("words nobody has read")
    assert all(np.allclose(a[i], b[i]) for i in ids)


def test_no_documents_to_score(no_documents):
    assert lm_score.score(no_documents, PIECES).count() == 0


def labelled(n=400):
    """Every seventh text is junk, every eighth toxic, at times in disguise."""
    rnd = random.Random(3)
    slurs = ["grumblex", "snorkfid", "blathen"]
    masks = {"grumblex": ["gruuumblex", "g r u m b l e x", "grum8lex"], "snorkfid": ["sn0rkfid", "snorkf1d"], "blathen": ["bl@then", "b.l.a.t.h.e.n", "blath3n"]}
    rows, labels = [], []
    for i in range(n):
        words = prose(3000 + i, 60).split()
        toxic, junk = i % 8 == 0, i % 7 == 0
        if toxic:
            for slur in rnd.sample(slurs, 2):
                held_out = zlib.crc32(str(i).encode()) % 4 == 2
                words.insert(rnd.randrange(len(words)), rnd.choice(masks[slur]) if held_out else slur)
        if junk:
            words = [w + "***" for w in words[:8]] * 6
        rows.append((i, " ".join(words)))
        labels.append((i, int(not junk), int(toxic and not junk)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_disguised_words_are_found_in_held_out_texts(spark):
    rows, labels = labelled()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    odd = [*labels, (None, 1, 1), (5, None, None), (9999, 1, 1), (1, 1, 0)]
    model = toxicity.learn(df, spark.createDataFrame(odd, LABELS))
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    held_out = [(i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    hits = [got[i]["toxic"] for i, t in held_out if t]
    alarms = [got[i]["toxic"] for i, t in held_out if not t]
    assert np.mean(hits) > 0.8 and np.mean(alarms) < 0.05
    assert all(0 <= r["toxicity"] <= 1 for r in got.values())


def test_labels_of_held_out_rows_are_not_read(spark):
    rows, labels = labelled(160)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    found = []
    for known in (labels, turned):
        model = toxicity.learn(df, spark.createDataFrame(known, LABELS))
        found.append(sorted((r["doc_id"], r["toxicity"]) for r in toxicity.score(df, model).collect()))
    assert np.allclose(found[0], found[1])


@pytest.mark.parametrize(
    "token, word",
    [("1diot", "idiot"), ("id1ot", "idiot"), ("idiooooot", "idiot"), ("i.d.i.o.t", "idiot"), ("stup1d", "stupid"), ("plain", "plain")],
)
def test_decoding(token, word):
    model = toxicity.log_model(_counts(["the idiot said stupid and plain things"] * 50))
    assert word in toxicity.restored(token, model)


@pytest.mark.parametrize("token", ["stu.pid", "stup-id", "st*pid", "s#upid", "stu2id", "st_upid", "stu'pid"])
def test_signs_inside_words(token):
    model = toxicity.log_model(_counts(["the idiot said stupid and plain things"] * 50))
    assert "stupid" in toxicity.restored(token, model)
    assert set(toxicity._LETTERS.findall(token)) <= toxicity.restored(token, model)


def all_paths(token, model):
    """Every reading of a token with its score, one after the other."""
    masked = toxicity.is_masked(token)
    states = [((0, 0, ""), 0.0, "")]
    for ch in token:
        after = []
        for (a, b, last), score, text in states:
            for out, c, cost in toxicity.readings(ch, masked):
                after.append(((b, c, out), score + cost + float(model[a, b, c]), text + out))
                if out == last:
                    after.append(((a, b, last), score + cost + toxicity.REPEATED, text))
            if not ch.isalpha() and text:
                after.append(((a, b, last), score + toxicity.DROPPED, text))
        states = after
    ends = [(score + float(model[a, b, 0]), text) for (a, b, _), score, text in states]
    top = max(score for score, _ in ends)
    return top, {text for score, text in ends if score > top - 1e-6}


def test_decoding_finds_the_best_of_all_paths():
    model = toxicity.log_model(_counts(["the idiot said stupid and plain things, 15 of 70 times!"] * 50))
    rnd = random.Random(6)
    tokens = ["1d10t", "st**id", "2#ab", "s.t.u", "aaa", "7h3", "|d|ot", "x-y", "!!", "i1l|", "@$$", "b00k", "(a(", "2b2"]
    tokens += ["".join(rnd.choice("aist01!|@$*#2.-") for _ in range(rnd.randrange(1, 7))) for _ in range(150)]
    for token in tokens:
        assert toxicity.decode(token, model) in all_paths(token, model)[1]


def test_long_tokens_are_one_lattice():
    model = toxicity.log_model(_counts(["the idiot said stupid and plain things"] * 50))
    for n in range(40, 50):
        assert "stupid" in toxicity.decode("-" * n + "stup1d", model)
    assert len(toxicity.decode("ab1" * 20_000, model)) >= 40_000


def test_words_cut_by_blanks(spark):
    model = toxicity.log_model(_counts(["the idiot said stupid and plain things"] * 50))
    scorer = toxicity.Scorer({"^stupid$": 0.9}, model)
    for text in ("so stu pid, he", "(st up id)", "s tupid", "stupi d!"):
        assert scorer.levels(text)[0] == scorer.levels("stupid")[0] > 0
    assert scorer.levels("stu he pid")[0] == scorer.levels("stu")[0] == 0


def test_letters_set_apart_are_searched_for_only_where_they_may_be(monkeypatch):
    rnd = random.Random(3)
    for _ in range(3000):
        text = "".join(rnd.choice("ab c.d_e*-@$!|+\n\té") for _ in range(rnd.randrange(40)))
        every = [re.sub(r"[ ._*-]", "", m[0]) for m in toxicity._APART.finditer(text)]
        assert list(toxicity._set_apart(text)) == every
    model = toxicity.log_model(_counts(["the idiot said stupid and plain things"] * 50))
    scorer = toxicity.Scorer({"^stupid$": 0.9, "^idio": 0.8, "tupid": 0.7}, model)
    assert scorer.levels("s t u p i d")[0] == scorer.levels("stupid")[0] > scorer.levels("idiots")[0] > scorer.levels("xtupidy")[0] > 0
    monkeypatch.setattr(toxicity, "_APART", None)  # a plain text needs no such search
    assert scorer.levels("this is a plain text - with a sign, so it is")[0] == 0


def _counts(texts):
    tri = np.zeros(toxicity.CLASSES**3)
    for text in texts:
        c = toxicity.classes(f"  {text}  ").astype(int)
        np.add.at(tri, (c[:-2] * 64 + c[1:-1]) * 64 + c[2:], 1)
    return tri.reshape(64, 64, 64)


def test_pieces_are_the_same_in_tasks_and_columns(spark):
    words = ["a", "abcd", "abcde", "abcdef", "abcdefg", "aaaaaaaaaa", "größenwahn"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for r in df.select("word", toxicity.pieces_of(df["word"]).alias("p")).collect():
        assert set(r["p"]) == set(toxicity._pieces(r["word"]))


def test_toxicity_of_odd_documents(spark, documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 1), (3, 1, 0), (9, 0, 0), (None, None, None)], LABELS)
    model = toxicity.learn(documents, labels)
    scored = toxicity.score(documents, model)
    assert scored.count() == documents.count() and scored.filter("toxicity is null").count() == 0
    left = toxicity.acceptable(documents, labels)
    assert left.columns == documents.columns
    assert toxicity.acceptable(no_documents, labels).count() == 0
    for nothing in (labels.limit(0), labels.filter("toxic = 0"), labels.filter("toxic = 1"), labels.filter("doc_id is null")):
        kept = toxicity.acceptable(documents, nothing)
        assert kept.columns == documents.columns and kept.count() == documents.count()
    odd = documents.withColumn("my col", F.lit(1)).withColumn("_row", F.struct(F.lit(1).alias("a b")))
    assert toxicity.acceptable(odd, labels).columns == odd.columns
    assert toxicity.score(odd, model).count() == odd.count()


def test_labelled_rows_are_drawn_by_a_hash(spark):
    rows, labels = labelled(160)
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    assert toxicity.training(df, known).count() > 100
    some = [r["text"] for r in toxicity.training(df, known, most=40).collect()]
    again = [r["text"] for r in toxicity.training(df.repartition(7), known, most=40).collect()]
    assert len(some) == 40 and sorted(some) == sorted(again)


def test_good_texts_are_drawn(spark):
    rows, labels = labelled()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    drawn = quality.resample(df, spark.createDataFrame([*labels, (None, 1, 1)], LABELS)).collect()
    kept = {r["doc_id"] for r in drawn}
    good, junk = [i for i, q, _ in labels if q], [i for i, q, _ in labels if not q]
    assert len(drawn) == round(len(rows) * (len(good) + 1) / (len(labels) + 1))
    assert np.mean([i in kept for i in good]) > 0.97 and np.mean([i in kept for i in junk]) < 0.1
    assert sorted(r["rank"] for r in drawn) == list(range(len(drawn)))


def test_weights_are_ratios_of_models(spark):
    rows, labels = labelled(80)
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    hashed = quality.Hashed(500)
    counts = np.full((2, 500), quality.ADDED)
    good = {i for i, q, _ in labels if q}
    for i, t in rows:
        n = np.bincount(hashed.of(t), minlength=500)
        counts[1] += n
        counts[0] += n * (i in good)
    want = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    assert np.allclose(quality.log_ratios(df, known, 500), want)
    got = {r["doc_id"]: r["log_weight"] for r in quality.weights(df, want).collect()}
    assert all(got[i] == pytest.approx(want[hashed.of(t)].sum()) for i, t in rows)


def test_noise_draws_in_proportion(spark):
    """Of rows weighing 1 and 3, the first drawn is a heavy one in three of four cases."""
    df = spark.range(4000).selectExpr("id as doc_id", "if(id % 2 = 0, 0.0D, ln(3.0D)) as log_weight")
    first = quality.gumbel_top_k(df, 400).collect()
    assert 0.7 < np.mean([r["doc_id"] % 2 for r in first]) < 0.8


def test_quality_of_odd_documents(spark, documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], LABELS)
    assert quality.resample(documents, labels, share=1.0).count() == documents.count()
    assert quality.resample(documents, labels.limit(0)).count() == documents.count()
    assert quality.resample(no_documents, labels).count() == 0


def test_pipeline(spark, documents, tmp_path):
    import corpus_pipeline
    from turnwise.session import written

    rows, labels = labelled(200)
    benchmark = [(1, prose(9000, 40)), (2, None)]
    texts = [(1000 + i, t) for i, (_, t) in enumerate(odd_documents()[:3])]
    texts += [(2000, prose(9000, 40)), (2001, prose(9001, 300) + " " + prose(9000, 40)), (2002, None), (2003, "")]
    docs = [(i, t, "en", "s", 0, "x") for i, t in rows + texts]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, line string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = now.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, folder), "test-stage")
        assert now.columns == columns, name
        left.append({r["doc_id"]: r["text"] for r in now.collect()})
    toxic = {i for i, q, t in labels if t}
    assert len(toxic & set(left[0])) < 0.3 * len(toxic) and {1000, 2000, 2002} <= set(left[0])
    assert 1001 not in left[1] and {1000, 2000} <= set(left[1])
    assert left[2].keys() & {2002, 2003} == {2002}
    assert 2000 not in left[3] and {1000, 2002} <= set(left[3])
    clean = {i for i, q, t in labels if q and not t}
    assert len(clean - set(left[3])) < 0.05 * len(clean)
    packed = corpus_pipeline.STAGES[-1][1](spark, now, folder).collect()
    assert {r["doc_id"] for r in packed} == set(left[3])
    whole = corpus_pipeline.run(spark, folder).collect()
    key = [(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed]
    assert sorted(key) == sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in whole)
