"""Operators against plain Python on many random inputs, one Spark job per operator."""

import math
import random

import pytest
from pyspark.sql import functions as F

from turnwise.functions import columns as C
from turnwise.operators import chat, dist, metrics, paths, tokens

rng = random.Random(11)


def arrays(n, top=4, longest=8):
    return [[rng.randrange(top) for _ in range(rng.randrange(longest))] for _ in range(n)]


def test_cuts_and_runs(spark):
    rows = [(i, a) for i, a in enumerate(arrays(300))]
    df = spark.createDataFrame(rows, "id int, a array<int>")
    got = df.select(
        "id",
        C.cut_before_stop("a", [2, 3]).alias("stop"),
        C.cut_after_eos("a", 1).alias("eos"),
        C.leading_run(F.transform("a", lambda x: x > 0)).alias("run"),
        C.leading_ones(F.transform("a", lambda x: F.when(x > 0, 1).otherwise(0))).alias("ones"),
        C.padded("a", 5, 9).alias("pad"),
    ).collect()
    for r in got:
        a = rows[r.id][1]
        stop = next((i for i, x in enumerate(a) if x in (2, 3)), len(a))
        run = next((i for i, x in enumerate(a) if x == 0), len(a))
        assert r.stop == a[:stop]
        assert r.eos == (a[: a.index(1) + 1] if 1 in a else a)
        assert r.run == r.ones == run
        assert r.pad == a + [9] * max(5 - len(a), 0)


def test_accept_lengths(spark):
    rows = [(i, list(map(str, a)), list(map(str, b))) for i, (a, b) in enumerate(zip(arrays(300, 2), arrays(300, 2)))]
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>")
    for r in df.select("id", paths.accept_length("a", "b").alias("n")).collect():
        _, a, b = rows[r.id]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert r.n == n


def test_losses(spark):
    rows = [(i, [rng.gauss(0, 3) for _ in range(6)], [rng.gauss(0, 3) for _ in range(6)]) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>")
    got = df.select("id", C.mean_smooth_l1("a", "b").alias("h"), C.vector_log_softmax("a").alias("s")).collect()
    for r in got:
        _, a, b = rows[r.id]
        gaps = [abs(x - y) for x, y in zip(a, b)]
        assert r.h == pytest.approx(sum(0.5 * g * g if g < 1 else g - 0.5 for g in gaps) / 6)
        mass = math.log(sum(math.exp(x) for x in a))
        assert r.s == pytest.approx([x - mass for x in a])


def test_distribution_processors_with_a_hot_group(spark):
    rows = [("hot" if i % 3 == 0 else f"g{i % 40}", f"t{i:05d}", rng.gauss(0, 4)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, token string, score double").repartition(6)
    by = {}
    for g, t, s in rows:
        by.setdefault(g, []).append((t, s))
    got = {(r.g, r.token): r.p for r in dist.softmax(df, "g").collect()}
    kept_p = {(r.g, r.token) for r in dist.top_p(0.8, "g")(df).collect()}
    kept_k = {(r.g, r.token) for r in dist.top_k(7, "g")(df).collect()}
    best = {r.g: r.token for r in dist.argmax(df, "g").collect()}
    for g, items in by.items():
        mass = sum(math.exp(s) for _, s in items)
        p = {t: math.exp(s) / mass for t, s in items}
        assert all(got[g, t] == pytest.approx(p[t]) for t in p)
        ranked = sorted(p, key=lambda t: (-p[t], t))
        want, before = set(), 0.0
        for t in ranked:
            if before < 0.8:
                want.add((g, t))
            before += p[t]
        assert {x for x in kept_p if x[0] == g} == want
        assert {x for x in kept_k if x[0] == g} == {(g, t) for t in ranked[:7]}
        assert best[g] == ranked[0]


def test_sequences_of_a_conversation_with_a_third_of_all_messages(spark):
    rows = []
    for conv, n in [(0, 900)] + [(c, 18) for c in range(1, 101)]:
        rows += [(conv, j, ("human", "gpt")[j % 2], " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(6))))
                 for j in range(n)]
    talk = spark.createDataFrame(rows, "conv_id bigint, j bigint, speaker string, value string").repartition(5)
    full = tokens.vocabulary(tokens.token_counts(talk))
    ids = {r.token: r.token_id for r in full.collect()}
    assert [t for t, _ in sorted(ids.items(), key=lambda kv: kv[1])] == sorted(ids)
    want = {}
    for conv, j, who, text in sorted(rows):
        for w in text.split():
            seq = want.setdefault(conv, [])
            seq.append((ids[w], int(who == "gpt" and len(seq) > 0)))
    got = {(r.conv_id, r.window): list(zip(r.input_ids, r.loss_mask)) for r in tokens.sequences(talk, full, 700).collect()}
    assert got == {
        (conv, at // 700): [(t, m if i else 0) for i, (t, m) in enumerate(seq[at : at + 700])]
        for conv, seq in want.items()
        for at in range(0, len(seq), 700)
    }
    spans = chat.contexts(talk).agg(F.count("*").alias("n"), F.max("context_turns").alias("m")).first()
    assert (spans.n, spans.m) == (450 + 900, 898)


def test_running_mean_per_run(spark):
    rows = [("r%d" % (i % 2 if i % 3 else 0), i, float(rng.randrange(100))) for i in range(2000)]
    df = spark.createDataFrame(rows, "run string, batch bigint, v double").repartition(7)
    got = {(r.run, r.batch): r.mean_so_far for r in metrics.running_mean(df, "v", "run", "batch", 10).collect()}
    want, sums = {}, {}
    for run, batch, v in rows:
        s, n = sums.get(run, (0.0, 0))
        sums[run] = (s + v, n + 1)
        if (n + 1) % 10 == 0:
            want[run, batch] = pytest.approx((s + v) / (n + 1))
    assert got == want
