"""Permutations, length buckets, subword masks, publishing and acceptance by turn against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from turnwise.operators import chat, metrics, paths, sharding, tokens, vocab
from turnwise.session import written
from turnwise.sources import readers, schemas, writers
from turnwise.sources.store import Store

# --- permutations --------------------------------------------------------------


def plain_permutation(n, *key):
    out = []
    for x in range(n):
        for k, a, b, c in sharding.permutation_rounds(n, *key):
            y = (k - x) % n
            m = max(x, y)
            p = 2**31 - 1
            m = ((m % p * a + b) % p + (m // p) % p * 65537 + c) % p
            if m * m % p >> 15 & 1:
                x = y
        out.append(x)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 97, 1000])
def test_permuted_is_a_bijection_on_every_n(spark, n):
    rows = spark.range(n).select("id", sharding.permuted("id", n, 42, 0).alias("a"), sharding.permuted("id", n, 42, 1).alias("b"))
    got = sorted(map(tuple, rows.collect()))
    assert sorted(r[1] for r in got) == sorted(r[2] for r in got) == list(range(n))
    if n > 1:
        assert [r[1] for r in got] == plain_permutation(n, 42, 0)
    if n > 50:
        moved = [abs(r[1] - r[0]) for r in got]
        assert n / 4 < sum(moved) / n < n / 2.2  # a random one moves by n / 3
        follow = sum(abs(p[1] - q[1]) == 1 for p, q in zip(got, got[1:]))
        assert follow < 12 and sum(r[1] == r[2] for r in got) < 8


def test_large_places_stay_inside(spark):
    n = 10**12 + 39
    ids = [0, 1, n // 2, n - 2, n - 1, 123_456_789_012]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint").select(sharding.permuted("id", n, "s").alias("p"))
    got = [r.p for r in df.collect()]
    assert len(set(got)) == len(ids) and all(0 <= p < n for p in got)


def test_epochs_number_once_and_add_no_exchange(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(50)], "k bigint")
    many = sharding.epochs(df, ["k"], 5, seed=7)
    by = {}
    for r in many.collect():
        by.setdefault(r.epoch, {})[r.k] = r.position
    assert sorted(by) == list(range(5)) and all(sorted(p.values()) == list(range(50)) for p in by.values())
    assert len({tuple(sorted(p.items())) for p in by.values()}) == 5
    plan = many._jdf.queryExecution().executedPlan().toString()
    one = sharding.epochs(df, ["k"], 1, seed=7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == one.count("Exchange")


# --- length buckets ------------------------------------------------------------


def test_bucketed_batches_waste_less_and_hold_each_sequence_once(spark):
    rnd = random.Random(3)
    rows = [(i, 0, [1] * (1 + int(rnd.expovariate(1 / 60)))) for i in range(700)] + [(1000, 0, []), (1000, 1, [1] * 500)]
    seqs = spark.createDataFrame(rows, "conv_id bigint, window bigint, input_ids array<bigint>")
    got = tokens.bucketed_batches(seqs, ["conv_id", "window"], 8)
    out = got.collect()
    assert sorted((r.conv_id, r.window) for r in out) == sorted(r[:2] for r in rows)
    sizes = {}
    for r in out:
        sizes.setdefault(r.batch_id, []).append(r.size)
    assert sorted(map(len, sizes.values()))[1:] == [8] * (len(sizes) - 1)
    assert {r.bucket for r in out} <= set(range(16))
    edges = sorted({(r.size, r.bucket) for r in out})
    assert [b for _, b in edges] == sorted(b for _, b in edges) and len(edges) == len({s for s, _ in edges})
    one = tokens.padding_share(got).first()
    assert one.sequences == 702 and one.tokens == sum(len(r[2]) for r in rows)
    assert one.padding == sum(len(b) * max(b) - sum(b) for b in sizes.values())
    plain = sharding.batch_ranges(seqs.select("conv_id", "window", F.size("input_ids").alias("size")), ["conv_id", "window"], 8)
    assert one.share < tokens.padding_share(plain).first().share / 2
    other = tokens.bucketed_batches(seqs, ["conv_id", "window"], 8, epoch=1).collect()
    assert {(r.conv_id, r.window): r.batch_id for r in other} != {(r.conv_id, r.window): r.batch_id for r in out}
    padded = tokens.pad_batches(seqs, ["conv_id", "window"], 8, batches=got)
    lengths = {}
    for r in padded.collect():
        lengths.setdefault(r.batch_id, set()).add(len(r.input_ids))
    assert all(lengths[b] == {max(s)} for b, s in sizes.items())
    assert tokens.padding_share(tokens.bucketed_batches(seqs.limit(0), ["conv_id", "window"], 8)).first().share is None


# --- subword masks -------------------------------------------------------------


def test_subword_masks_equal_those_by_character(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    texts = ["Hello world", "", None, "naïve 東京 🎉 e.g.", " leading", "trailing \n", "<|im_end|>", "x" * 300, "a\n\nb"]
    rows = [(1, j, "gpt" if j % 2 else "human", t) for j, t in enumerate(texts)] + [(2, 0, "gpt", "first"), (2, 1, "robot", "?")]
    messages = spark.createDataFrame(rows, "conv_id bigint, j bigint, speaker string, value string").withColumn("my col", F.lit(1))
    library = Tokenizer.from_file(path)
    for r in tokens.subword_tokens(messages, path).collect():
        head = f"{chat.OPEN}{chat.ROLE_OF_SPEAKER.get(r.speaker, r.speaker)}\n"
        text = r.value or ""
        whole = head + text + chat.CLOSE
        want = library.encode(whole, add_special_tokens=False)
        assert (r.ids, list(zip(r.starts, r.stops))) == (want.ids, want.offsets) and r.header == len(head)
        content = set(range(len(head), len(head) + len(text))) if r.speaker == "gpt" else set()
        by_character = [int(a < b and set(range(a, b)) <= content) for a, b in want.offsets]
        assert r.masks == by_character
        assert r["my col"] == 1
    # A token that reaches over the border is masked, an empty one as well.
    assert tokens.target_spans([(0, 3), (3, 5), (4, 6), (5, 5), (6, 9)], 3, 7) == [0, 1, 1, 0, 0]


def test_subword_tokens_hold_a_portion_of_texts(spark):
    """A batch of any size is encoded in portions, with what its rows give one by one."""
    public = pytest.importorskip("public_tokenizers")
    import pyarrow as pa
    from tokenizers import Tokenizer

    class Messages:
        schema = spark.createDataFrame([], "speaker string, value string").schema

        def mapInArrow(self, run, shape):
            return run

    path = public.path("word_bpe_49k.json")
    texts = ["word " * 400, "", None, "naïve 東京"] * 20 + ["some words " * 30_000] + ["some text of a line\n" * 20] * 2000
    batch = pa.RecordBatch.from_arrays([pa.array(["gpt"] * len(texts)), pa.array(texts, pa.string())], ["speaker", "value"])
    found = list(tokens.subword_tokens(Messages(), path)(iter([batch, batch.slice(0, 0)])))
    held = [sum(len((t or "").encode()) for t in b.column("value").to_pylist()) for b in found]
    assert len(found) > 3 and max(held) < tokens.PORTION + len(texts[80])
    assert [t for b in found for t in b.column("value").to_pylist()] == texts
    library = Tokenizer.from_file(path)
    want = [f.ids for f in library.encode_batch([f"{chat.OPEN}{chat.ROLE_OF_SPEAKER['gpt']}\n{t or ''}{chat.CLOSE}" for t in texts], add_special_tokens=False)]
    assert [ids for b in found for ids in b.column("ids").to_pylist()] == want


def test_plugged_in_tokenizer_keeps_odd_columns(spark):
    df = spark.createDataFrame([(1, 0, "human", "a b", {"x y": 1})], "conv_id int, j int, speaker string, value string, m struct<`x y`:int>")
    row = tokens.tokenize_with(df, lambda texts: [t.split() for t in texts]).first()
    assert row.tokens == ["a", "b"] and row.m["x y"] == 1


# --- publishing ----------------------------------------------------------------


def answers(spark, *ids):
    return spark.createDataFrame(
        [(i, f"a{i}", "m", [(0, ["x"], [1], [2], [0.5], None, None)], 1.0 * i) for i in ids], schemas.ANSWER
    )


def test_a_repeated_append_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    assert writers.append_answers(answers(spark, 1, 2), path)
    assert not writers.append_answers(answers(spark, 2, 1), path)
    assert writers.append_answers(answers(spark, 1, 2), path, run="again on purpose")
    assert writers.append_answers(answers(spark, 3), path)
    rows = readers.read_answers(spark, path).collect()
    assert sorted(r.question_id for r in rows) == [1, 1, 2, 2, 3] and {r.model_id for r in rows} == {"m"}
    assert writers.digest(answers(spark, 1, 2)) != writers.digest(answers(spark, 1, 2, 2))


def test_a_killed_append_leaves_nothing_that_counts(spark, tmp_path):
    path = str(tmp_path / "log")
    boom = F.udf(lambda i: 1 / (i - 7), "double")
    bad = answers(spark, *range(20)).repartition(5).withColumn("tstamp", boom("question_id"))
    with pytest.raises(Exception):
        writers.append_answers(bad, path, run="r")
    # A job that died before its rename.
    answers(spark, 1).write.partitionBy("model_id").json(f"{path}/_staged-dead")
    assert writers.append_answers(answers(spark, *range(20)), path, run="r")
    assert readers.read_answers(spark, path).count() == 20


def test_of_two_builders_of_a_vocabulary_one_wins(spark, tmp_path):
    full = spark.createDataFrame([("a", 0, 3), ("b", 1, 2)], "token string, token_id bigint, n_target bigint")
    built = []

    def build(inner=False):
        built.append(1)
        if len(built) == 1:  # while the first builds, another one finishes
            vocab.saved_table(full, lambda: build(True), 1, str(tmp_path))
        return vocab.draft_map(vocab.top_n(vocab.target_frequency(full), 1), full)

    rows = vocab.saved_table(full, build, 1, str(tmp_path)).collect()
    assert len(built) == 2 and len(rows) == 1
    assert vocab.saved_table(full, build, 1, str(tmp_path)).collect() == rows and len(built) == 2
    assert [n for n in Store(spark, str(tmp_path)).names() if not n.startswith("_")] == [
        n for n in Store(spark, str(tmp_path)).names()
    ]


# --- acceptance ----------------------------------------------------------------


def test_alpha_by_turn_and_of_the_last_turn(spark):
    rows = [
        ("m", [(0, ["x", "y"], [1, 1], [2, 2], [0.5, 0.5], [1.0, 0.0, 4.0, 2.0], [2.0, 2.0, 8.0, 8.0])]),
        ("m", [(0, ["x"], [1], [2], [0.5], [2.0, 1.0], [2.0, 0.0])]),
        ("m", [(0, ["x"], [1], [2], [0.5], None, None)]),
    ]
    kind = "struct<index:int,turns:array<string>,idxs:array<int>,new_tokens:array<int>,wall_time:array<double>,alpha:array<double>,alpha_num:array<double>>"
    df = spark.createDataFrame(rows, f"model_id string, choices array<{kind}>")

    def got(**how):
        out = metrics.alpha_by_depth(df, depths=2, **how)
        return {(r.turn if "by_turn" in how else None, r.depth): (r.accepted, r.tried, r.alpha) for r in out.collect()}

    assert got(by_turn=True) == {
        (0, 0): (3.0, 4.0, 0.75), (0, 1): (1.0, 2.0, 0.5), (1, 0): (4.0, 8.0, 0.5), (1, 1): (2.0, 8.0, 0.25),
    }
    assert got() == {(None, 0): (7.0, 12.0, 0.58), (None, 1): (3.0, 10.0, 0.3)}
    assert got(last_turn_only=True) == {(None, 0): (6.0, 10.0, 0.6), (None, 1): (3.0, 8.0, 0.38)}


# --- beam ----------------------------------------------------------------------


def plain_beam(table, root, depth, k):
    """All nodes (ranks, score, depth, kept) of a beam, best first by rounded score and ranks."""
    live, out = [((), root, 0.0)], []
    for d in range(1, depth + 1):
        grown = [(ranks + (r,), t, score + lp) for ranks, tail, score in live for r, t, lp in table.get(tail, [])]
        grown.sort(key=lambda n: (-round(n[2], 9), n[0]))
        out += [(n[0], round(n[2], 9), d, i < k) for i, n in enumerate(grown)]
        live = grown[:k]
    return out


@pytest.mark.parametrize("depth, k, best", [(5, 10, 24), (3, 2, 100)])
def test_a_threshold_finds_the_nodes_of_exhaustive_search(spark, depth, k, best):
    rnd = random.Random(depth)
    pairs = [(f"t{i}", f"t{rnd.randrange(30)}", rnd.choice([1, 1, 2, 5, 9])) for i in range(30) for _ in range(rnd.randrange(6))]
    df = spark.createDataFrame(pairs, "token string, next string, c bigint").groupBy("token", "next").agg(F.sum("c").alias("c"))
    table = written(paths.successors(df, k), "test-successors")
    plain = {r.token: [(b.rank, b.token, b.log_p) for b in r.best] for r in table.collect()}
    roots = table.select("token")
    every = paths.expand_top_k(roots, table, depth, k)
    got = {}
    for r in every.collect():
        got.setdefault(r.root, []).append((tuple(r.ranks), round(r.score, 9), r.depth, r.kept))
    assert {x: sorted(v) for x, v in got.items()} == {t: sorted(plain_beam(plain, t, depth, k)) for t in plain}
    some = paths.expand_top_k(roots, table, depth, k, best)

    def chosen(nodes):
        return {(r.root, tuple(r.ranks), r.node) for r in paths.rerank_top_n(nodes, best).collect()}

    assert chosen(some) == chosen(every)
    assert some.count() < every.count() or best >= 100
    kept = paths.expand_top_k(roots, table, depth, k, scored=False)
    assert sorted((r.root, tuple(r.ranks)) for r in kept.collect()) == sorted((r.root, tuple(r.ranks)) for r in every.filter("kept").collect())


def test_two_leading_system_messages_do_not_double_a_conversation(spark):
    rows = [(1, 0, "system", "B"), (1, 0, "system", "A"), (1, 1, "user", "u"), (1, 2, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert chat.heads_with_system(df).count() == 1
    folded = [r.text for r in chat.fold_system(df).filter("turn = 1").collect()]
    assert folded == ["Au"]
