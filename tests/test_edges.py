"""Rules that the given tables never trigger, on hand-made rows."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from turnwise.functions import columns as C
from turnwise.operators import answers, chat, dist, features, judge, metrics, paths, prompts, sharding, tokens, vocab
from turnwise.sources import readers, schemas, writers


def one(spark, **values):
    """A single row of literal columns given as SQL."""
    return spark.range(1).select(*[F.expr(v).alias(k) for k, v in values.items()])


# --- answer text ---------------------------------------------------------------


@pytest.mark.parametrize(
    "text, want",
    [("#abc", "#abc"), ("a#bc", "a"), ("abc", "abc"), ("##a#", "##a#"), ("", "")],
)
def test_stop_string_at_the_start_is_kept(spark, text, want):
    row = one(spark, t=f"'{text}'").select(C.cut_stop_string("t", "#").alias("r")).first()
    assert row.r == want


@pytest.mark.parametrize(
    "ids, stops, want",
    [("array(1,2,3)", [9], [1, 2, 3]), ("array(1,2,3,2)", [2], [1]), ("array(5,4,3)", [3, 4], [5]),
     ("array(7,1)", [7], []), ("array(1,2)", [], [1, 2])],
)
def test_cut_before_stop(spark, ids, stops, want):
    assert one(spark, i=ids).select(C.cut_before_stop("i", stops).alias("r")).first().r == want


@pytest.mark.parametrize("ids, want", [("array(1,2,3,2)", [1, 2]), ("array(1,3)", [1, 3]), ("array(2)", [2])])
def test_cut_after_eos(spark, ids, want):
    assert one(spark, i=ids).select(C.cut_after_eos("i", 2).alias("r")).first().r == want


def test_special_tokens_and_all_white_space_go(spark):
    row = one(spark, t="concat('\\t<s> a <s>b </s>\\n', char(160), char(133), char(28))")
    assert row.select(C.strip_special("t", ["<s>", "</s>"]).alias("r")).first().r == "a b"


@pytest.mark.parametrize("text, want", [("Assistant: Assistant: x", "Assistant: x"), (" Assistant: x", " Assistant: x")])
def test_prefix_is_removed_once(spark, text, want):
    assert one(spark, t=f"'{text}'").select(C.strip_prefix("t", "Assistant:").alias("r")).first().r == want


# --- answer logs ---------------------------------------------------------------


def answer(qid, aid, tstamp, turns, new_tokens=None, seconds=None, alpha=None, tried=None, idxs=None):
    new_tokens = new_tokens or [1] * len(turns)
    choice = (0, turns, idxs or [0] * len(turns), new_tokens, seconds or [1.0] * len(turns), alpha or [], tried or [])
    return (qid, aid, "m", [choice], tstamp)


def test_later_record_wins_wherever_it_stands(spark):
    log = spark.createDataFrame(
        [answer(1, "b", 9.0, ["new"]), answer(1, "a", 3.0, ["old"]), answer(2, "x", 5.0, ["s"]), answer(2, "y", 5.0, ["t"])],
        schemas.ANSWER,
    )
    kept = answers.dedup_last(log)
    got = {r.question_id: r.answer_id for r in kept.collect()}
    assert got == {1: "b", 2: "y"}
    again = answers.dedup_last(kept)
    assert {r.question_id: r.answer_id for r in again.collect()} == got


def test_ragged_arrays_give_null(spark):
    log = spark.createDataFrame([answer(1, "a", 1.0, ["x", "y"], [3], [0.5, 0.5], idxs=[0, 1])], schemas.ANSWER)
    rows = answers.explode_turns(answers.first_choice(log).drop("choices")).orderBy("t").collect()
    assert [(r.text, r.new_tokens) for r in rows] == [("x", 3), ("y", None)]


def test_alpha_without_tries_is_null_and_rounding_is_half_even(spark):
    log = spark.createDataFrame(
        [answer(1, "a", 1.0, ["x"], alpha=[1.0, 0.0, 9.0], tried=[8.0, 0.0, 200.0])], schemas.ANSWER
    )
    got = {r.depth: r.alpha for r in metrics.alpha_by_depth(log).collect()}
    assert got == {0: 0.12, 1: None, 2: 0.04}


def test_speed_is_a_mean_of_rates(spark):
    rows = [answer(1, "a", 1.0, ["x"], [10], [1.0]), answer(2, "b", 1.0, ["y"], [10], [10.0])]
    speeds = metrics.question_speeds(spark.createDataFrame(rows, schemas.ANSWER))
    ratio = metrics.speed_ratio(speeds.unionByName(speeds.withColumn("model_id", F.lit("b")).withColumn("rate", F.lit(1.0))), "m", "b")
    assert ratio.first().ratio == pytest.approx(5.5)


def test_recount_subtracts_the_marker_in_front(spark):
    log = spark.createDataFrame([answer(1, "a", 1.0, ["x y", "z"])], schemas.ANSWER)
    assert metrics.question_speeds(log, metrics.recounted_tokens()).first().tokens == 3
    assert metrics.question_speeds(log, metrics.recounted_tokens(bos=1)).first().tokens == 1


# --- conversations -------------------------------------------------------------


def nested(spark, *lists):
    return spark.createDataFrame([(str(i), m) for i, m in enumerate(lists)], "id string, " + schemas.MESSAGES)


def test_message_conversion_rules(spark):
    s, u, a, t = ("system", "S"), ("user", "u"), ("assistant", "a"), ("tool", "t")
    good, bad = chat.from_messages(
        nested(spark, [s, u, a], [a, u, a], [s], [], [a], [u, t], [s, a, u], [u, a])
    )
    got = {r.id: [tuple(m) for m in r.conversations] for r in good.collect()}
    assert got == {
        "0": [("human", "Su"), ("gpt", "a")],
        "1": [("human", "u"), ("gpt", "a")],
        "5": [("human", "u"), ("gpt", "t")],
        "6": [("gpt", "Sa"), ("human", "u")],
        "7": [("human", "u"), ("gpt", "a")],
    }
    assert {r.id for r in bad.collect()} == {"2", "3"}


def test_long_and_nested_conversion_agree(spark):
    s, u, a = ("system", "S"), ("user", "u"), ("assistant", "a")
    lists = [[s, u, a, u], [u, a], [a, u], [u], [s, a, u]]
    good, _ = chat.from_messages(nested(spark, *lists))
    long = spark.createDataFrame(
        [(i, j, r, c) for i, m in enumerate(lists) for j, (r, c) in enumerate(m)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    flat = chat.normalize(long).select(F.col("conv_id").cast("string"), "j", "speaker", "value")
    assert sorted(map(tuple, chat.unnest(good).collect())) == sorted(map(tuple, flat.collect()))


def test_turns_are_numbered_from_any_order(spark):
    rows = [(1, 30, "user", "c"), (1, 10, "system", "a"), (2, 7, "user", "d"), (1, 20, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat.number_turns(df, ["turn"]).select("conv_id", "turn", "role", "text").collect()
    assert sorted((r.conv_id, r.turn, r.text) for r in got) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "d")]


def test_empty_input_keeps_the_line_break(spark):
    row = chat.from_instructions(one(spark, instruction="'do'", input="''", output="'done'")).first()
    assert [tuple(m) for m in row.conversations] == [("human", "do\n"), ("gpt", "done")]


def test_ids_keep_gaps_and_start_at_the_offset(spark):
    u, s = [("user", "u")], [("system", "S")]
    rows = spark.createDataFrame([(i, m) for i, m in enumerate([u, s, u])], "n bigint, " + schemas.MESSAGES)
    good, _ = chat.from_messages(chat.assign_ids(rows, ["n"], offset=88))
    assert sorted(r.id for r in good.collect()) == ["88", "90"]


def test_faulty_conversations_are_rejected_whole(spark):
    rows = [(1, 0, "human", "a"), (1, 1, "gpt", "b"), (2, 0, "human", "a"), (2, 1, "human", "b"),
            (3, 0, "robot", "a"), (4, 0, "gpt", "a"), (4, 1, None, "b")]
    long = spark.createDataFrame(rows, "conv_id bigint, j bigint, speaker string, value string")
    ok, rejects = chat.split_valid(long)
    assert {r.conv_id for r in ok.collect()} == {1}
    got = {r.conv_id: (r.first_fault_at, r.reason, r.n_faults) for r in rejects.collect()}
    assert got == {2: (1, "out of turn", 1), 3: (0, "unknown role", 1), 4: (0, "out of turn", 2)}
    strict, _ = chat.split_valid(long, strict=True)
    with pytest.raises(PySparkException):
        strict.collect()


def test_rendered_text_splits_back_and_stops_at_a_bad_round(spark):
    u, g = "human", "gpt"
    turns = [[(u, "q1"), (g, "a1"), (u, "q2"), (g, "a2")], [(u, "q1"), (g, "a1"), (u, "q2")], [(u, "q1")]]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(turns)], schemas.CONVERSATION)
    parts = chat.split_turns(df.select("id", chat.render_nested().alias("rendered"))).collect()
    assert sorted((r.id, r.round) for r in parts) == [("0", 0), ("0", 1), ("1", 0)]
    assert [r.answered for r in parts if (r.id, r.round) == ("0", 0)] == ["a1"]


def test_context_spans_point_into_the_rendered_text(spark):
    u, g = "human", "gpt"
    turns = [[(u, "q1"), (g, "a1"), (u, "q2"), (g, "a2"), (u, "q3")], [(u, "only")]]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(turns)], schemas.CONVERSATION)
    text = {r.id: r.t for r in df.select("id", chat.render_nested().alias("t")).collect()}
    full = {(r.id, r.j): r.prompt for r in chat.contexts_nested(df).collect()}
    spans = chat.contexts(chat.unnest(df).withColumnRenamed("id", "conv_id")).collect()
    assert len(spans) == len(full) == 4
    for r in spans:
        assert text[r.conv_id][: r.prompt_chars] + chat.OPEN + "assistant\n" == full[r.conv_id, r.j]
        assert text[r.conv_id][r.context_chars : r.prompt_chars] == r.question
        assert r.context_turns == r.j


# --- prompts and files ---------------------------------------------------------


def test_tolerant_prompt_file(spark, tmp_path):
    lines = ['{"id":"a","prompt":null,"question":"q"}', "", '{"id": broken', '{"instruction":"i","question":"q"}', "  ",
             '{"other":1}', '{"question":"Ä{x}"}']
    (tmp_path / "p.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    good, rejects = readers.read_prompts(spark, str(tmp_path / "p.jsonl"))
    assert [(r.line_no, r.reason) for r in rejects.collect()] == [(3, "bad JSON")]
    named = prompts.default_ids(prompts.pick_prompt(good), ["file", "line_no"])
    got = {r.line_no: (r.id, r.prompt_key, r.prompt) for r in named.collect()}
    assert got == {1: ("a", "prompt", None), 4: ("prompt_1", "instruction", "i"), 6: ("prompt_2", None, None),
                   7: ("prompt_3", "question", "Ä{x}")}


def test_line_numbers_across_file_blocks(spark, tmp_path):
    text = "\n".join(f"{i} {'x' * (i % 50)}" for i in range(1, 5001))
    (tmp_path / "lines.txt").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = readers.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 5000
    assert all(r.line.split()[0] == str(r.line_no) for r in rows)


@pytest.mark.parametrize("begin, end, want", [(None, None, 6), (2, None, 4), (None, 2, 2), (1, 3, 2), (-2, None, 2), (4, 99, 2)])
def test_question_slices(spark, tmp_path, begin, end, want):
    path = str(tmp_path / "q.jsonl")
    (tmp_path / "q.jsonl").write_text("\n".join('{"question_id":%d,"turns":["t"]}' % i for i in (9, 3, 7, 1, 5, 2)))
    got = [r.question_id for r in readers.read_questions(spark, path, begin, end).orderBy("position").collect()]
    assert got == [9, 3, 7, 1, 5, 2][slice(begin, end)] and len(got) == want


def test_empty_output_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        writers.write_verified(spark.range(0), str(tmp_path / "none"))
    assert writers.write_verified(spark.range(3), str(tmp_path / "some")) == 3


def test_json_lines_are_plain_utf8(spark, tmp_path):
    writers.write_jsonl(one(spark, t="'é中'").coalesce(1), str(tmp_path / "o"))
    text = next((tmp_path / "o").glob("part-*")).read_text(encoding="utf-8")
    assert text == '{"t":"é中"}\n'


def test_samples_get_a_suffix_only_when_there_are_several(spark):
    rows = spark.createDataFrame([("a", ["x", " \t"]), ("b", [" y "])], "id string, samples array<string>")
    got = prompts.drop_blank(prompts.explode_samples(rows)).collect()
    assert sorted((r.id, r.response) for r in got) == [("a_0", "x"), ("b", "y")]


def test_failed_batches_come_back_as_errors(spark):
    def model(frame):
        if "boom" in set(frame["prompt"]):
            raise RuntimeError("no answer")
        return frame.assign(response=frame["prompt"].str.upper(), error=None)

    rows = spark.createDataFrame([("1", "a"), ("2", "boom"), ("3", "c")], "id string, prompt string").coalesce(1)
    out = prompts.generate(rows, model, "id string, response string, error string", max_rows_per_batch=1).collect()
    assert {r.id: (r.response, r.error) for r in out} == {"1": ("A", None), "2": (None, "no answer"), "3": ("C", None)}


# --- shards --------------------------------------------------------------------


def sizes(df):
    return [r["count"] for r in df.groupBy("shard").count().orderBy("shard").collect()]


def test_shards(spark):
    eighty = spark.range(80)
    assert sizes(sharding.shard_contiguous(eighty, ["id"], 3)) == [26, 26, 26, 2]
    assert sizes(sharding.shard_contiguous(spark.range(2), ["id"], 5)) == [1, 1]
    assert sizes(sharding.shard_ceil(eighty, ["id"], 3)) == [27, 27, 26]
    assert sizes(sharding.shard_strided(eighty, ["id"], 3)) == [27, 27, 26]
    assert sizes(sharding.shard_strided(eighty, ["id"], 3, even=True)) == [27, 27, 27]
    few = sharding.shard_strided(spark.range(2), ["id"], 5, even=True).orderBy("position").collect()
    assert [r.id for r in few] == [0, 1, 0, 1, 0]


def test_epochs_are_different_permutations(spark):
    def order(epoch):
        return [r.id for r in sharding.shuffle_seeded(spark.range(50), "id", epoch=epoch).orderBy("position").collect()]

    assert sorted(order(0)) == list(range(50)) and order(0) != order(1) and order(0) == order(0)


# --- tokens and vocabulary -----------------------------------------------------


def talk(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, j bigint, speaker string, value string")


def test_sequences_window_mask_shift_and_pad(spark):
    rows = talk(spark, [(1, 0, "human", "a b"), (1, 1, "gpt", " ".join(["c"] * 4998)), (2, 0, "gpt", "x y")])
    full = tokens.vocabulary(tokens.token_counts(rows))
    seqs = tokens.sequences(rows, full)
    found = seqs.collect()
    windows = {r.window: r for r in found if r.conv_id == 1}
    assert [len(windows[w].input_ids) for w in range(3)] == [2048, 2048, 904]  # none of 5,000 is lost
    assert windows[0].loss_mask[:3] == [0, 0, 1] and windows[1].loss_mask[:2] == [0, 1]
    assert tokens.truncated(tokens.sequence_tokens(rows, 100)).groupBy("conv_id").count().orderBy("conv_id").collect()[0][1] == 100
    seqs = seqs.filter("window = 0")
    by = {r.conv_id: r for r in seqs.collect()}
    assert by[2].loss_mask == [0, 1]
    shifted = {r.conv_id: r.target for r in tokens.with_targets(seqs).collect()}
    assert shifted[2] == [by[2].input_ids[1], 0]
    assert {r.conv_id: r.loss_mask for r in tokens.mask_last(seqs).collect()}[2] == [0, 0]
    padded = {r.conv_id: r for r in tokens.pad_batches(seqs, ["conv_id", "window"], 2).collect()}
    assert len(padded[2].input_ids) == 2048 and sum(padded[2].attention_mask) == 2


@pytest.mark.parametrize("k", [1, 2, 5])
def test_array_shifts_keep_the_length(spark, k):
    for n in (0, 1, 3):
        items = list(range(1, n + 1))
        arr = f"array({','.join(map(str, items))})" if n else "cast(array() as array<int>)"
        row = one(spark, a=arr).select(C.shifted_left("a", k).alias("l"), C.shifted_right("a", k).alias("r")).first()
        assert row.l == (items[k:] + [0] * min(n, k)) and row.r == ([0] * min(n, k) + items[: max(n - k, 0)])


def test_vocabulary_ties_coverage_and_round_trip(spark):
    rows = talk(spark, [(1, 0, "human", "q"), (1, 1, "gpt", "b b a a c d")])
    full = tokens.vocabulary(tokens.token_counts(rows))
    freq = vocab.target_frequency(full)
    assert [r.token for r in vocab.top_n(freq, 3).collect()] == ["a", "b", "c"]
    covered = [vocab.coverage(freq, vocab.top_n(freq, n)).first().coverage for n in (0, 1, 2, 3, 9)]
    assert covered == sorted(covered) and covered[0] == 0 and covered[-1] == 1
    mapping = vocab.draft_map(vocab.top_n(freq, 3), full)
    ids = full.select("token_id")
    back = vocab.decode_draft(vocab.encode_draft(ids, mapping).select("draft_id"), mapping)
    assert sorted(r.token_id for r in back.collect()) == sorted(r.token_id for r in mapping.collect())
    with pytest.raises(PySparkException):
        vocab.coverage(freq.filter("false"), vocab.top_n(freq, 3)).collect()


def test_stored_vocabulary_follows_its_input(spark, tmp_path):
    calls = []

    def rows_of(text, n=2, asked="q"):
        full = tokens.vocabulary(tokens.token_counts(talk(spark, [(1, 0, "human", asked), (1, 1, "gpt", text)])))

        def build():
            calls.append(text)
            return vocab.draft_map(vocab.top_n(vocab.target_frequency(full), n), full)

        return vocab.saved_table(full, build, n, str(tmp_path)).collect()

    def table(text, n=2):
        return sorted(r.token for r in rows_of(text, n))

    assert table("a a b") == table("a a b") == ["a", "b"]
    assert table("a c c") == ["a", "c"]
    assert table("a a b", 1) == ["a"]
    assert calls == ["a a b", "a c c", "a a b"]
    # The same answers after another question: other ids, so another table.
    assert [r.token_id for r in rows_of("m n n")] != [r.token_id for r in rows_of("m n n", asked="a b")]


def test_own_tokenizer_runs_in_batches(spark):
    rows = talk(spark, [(1, 0, "human", "abc"), (2, 0, "human", None)])
    out = tokens.tokenize_with(rows, lambda texts: [[ord(c) for c in t] for t in texts], "ids", "array<bigint>")
    found = {r.conv_id: r for r in out.collect()}
    assert found[1].ids == [97, 98, 99] and found[1].value == "abc" and found[2].ids == []


def test_own_tokenizer_through_vocabulary_and_batches(spark):
    """Letters as tokens, text keys instead of numbers."""
    rows = spark.createDataFrame(
        [("x", 0, "human", "ab"), ("x", 1, "gpt", "bba"), ("y", 0, "human", "c")],
        "conv_id string, j bigint, speaker string, value string",
    )
    cut = tokens.tokenize_with(rows, lambda texts: [list(t) for t in texts])
    full = tokens.vocabulary(tokens.token_counts(cut, "tokens"))
    assert [r.token for r in full.orderBy("token_id").collect()] == ["a", "b", "c"]
    mapping = vocab.draft_map(vocab.top_n(vocab.target_frequency(full), 1), full)
    assert [(r.draft_id, r.token, r.token_id) for r in mapping.collect()] == [(0, "b", 1)]
    seqs = tokens.sequences(cut, full, tokens="tokens")
    padded = {r.conv_id: r for r in tokens.pad_batches(seqs, ["conv_id", "window"], 2).collect()}
    assert padded["x"].input_ids == [0, 1, 1, 1, 0] and padded["y"].input_ids == [2, 0, 0, 0, 0]


def test_feature_records(spark):
    rows = spark.createDataFrame(
        [(1, [[1.0, 2.0], [3.0, 4.0]], [5, 6]), (2, [[7.0, 8.0]], [9])],
        "vec_id bigint, hidden_state array<array<float>>, input_ids array<int>",
    )
    wide = rows.select("vec_id", features.concat_layers("hidden_state", "hidden_state", "hidden_state").alias("a"))
    assert {r.vec_id: r.a for r in wide.collect()}[1] == [[1.0, 2.0] * 3, [3.0, 4.0] * 3]
    target = {r.vec_id: r.t for r in rows.select("vec_id", features.next_states("hidden_state").alias("t")).collect()}
    assert target == {1: [[3.0, 4.0], [0.0, 0.0]], 2: [[0.0, 0.0]]}
    padded = {r.vec_id: r for r in tokens.pad_batches(rows, ["vec_id"], 2, "hidden_state").collect()}
    assert padded[2].hidden_state == [[7.0, 8.0], [0.0, 0.0]] and padded[2].input_ids == [9, 0]
    for noisy in (features.noise_uniform(rows, "hidden_state", "vec_id"), features.noise_gaussian(rows, "hidden_state", "vec_id")):
        assert [len(v) for r in noisy.collect() for v in r.hidden_state] == [2, 2, 2]


def test_unknown_speakers_stop_the_rendering(spark):
    rows = talk(spark, [(1, 0, "human", "a"), (1, 1, "tool", "b")])
    with pytest.raises(PySparkException):
        chat.render(rows).collect()
    nested = spark.createDataFrame([([("tool", "x")],)], "conversations array<struct<from:string,value:string>>")
    with pytest.raises(PySparkException):
        nested.select(chat.render_nested()).collect()


def test_strict_validation_gives_empty_rejects(spark):
    good = talk(spark, [(1, 0, "human", "a"), (1, 1, "gpt", "b")])
    rows, rejects = chat.split_valid(good, strict=True)
    assert rows.count() == 2 and rejects.count() == 0
    assert rejects.columns == chat.split_valid(good)[1].columns


def test_generated_schema_may_hold_commas(spark):
    asked = spark.createDataFrame([("a", "x")], "id string, prompt string")

    def model(frame):
        return frame.assign(out=[{"a": 1, "b": 2}] * len(frame), error=None)[["id", "out", "error"]]

    found = prompts.generate(asked, model, "id string, out struct<a:int,b:int>, error string").first()
    assert (found.out.a, found.out.b) == (1, 2)


def test_summary_counts_batches_once(spark):
    rows = [(b, p, 1.0 * b, 2.0, not (b == 2 and p == "p1")) for b in range(3) for p in ("p0", "p1", "p2")]
    log = spark.createDataFrame(rows, "batch bigint, position string, acc double, loss double, ok boolean")
    one = metrics.summary(log, 2, "test").first()
    assert (one.successful_batches, one.total_batches, one.total_samples) == (2, 3, 4)
    assert [(r.position, r.accuracy.mean) for r in one.results] == [("p0", 0.5), ("p1", 0.5), ("p2", 0.5)]


def test_unlisted_configurations_take_no_part(spark):
    df = spark.createDataFrame([(40, 100.0), (99, 500.0), (41, 1.0)], "config bigint, seconds double")
    assert metrics.best_config(df, {40: 1.0, 41: 0.0}).first() == (40, 100.0)


def test_chain_epochs_take_batches_before_untried_steps_drop_out(spark):
    rows = [(1, [1], [0]), (2, [1], [1]), (3, [0], [1])]
    log = spark.createDataFrame(rows, "b bigint, hits array<int>, masks array<int>")
    worker = F.lit(0)
    assert metrics.chain_epoch_accuracy(log, worker, ["b"], 1).first().accuracy == 0.5
    assert metrics.chain_epoch_accuracy(log, worker, ["b"], 1, 2).first().accuracy == 1.0


# --- metrics -------------------------------------------------------------------


def brute_chain(hits, masks):
    tried, right = [0] * 5, [0] * 5
    for k in range(5):
        if not masks[k]:
            break
        tried[k] += 1
        if hits[k]:
            right[k] += 1
        else:
            for later in range(k + 1, 5):
                tried[later] += 1
            break
    return tried, right


def test_chain_accuracy_equals_brute_force_on_all_cases(spark):
    cases = [(h * 32 + m, [h >> i & 1 for i in range(5)], [m >> i & 1 for i in range(5)]) for h in range(32) for m in range(32)]
    df = spark.createDataFrame(cases, "case int, hits array<int>, masks array<int>")
    got = {(r.case, r.k): (r.total, r.correct) for r in metrics.chain_accuracy(df, ["case"], 5).collect()}
    for case, hits, masks in cases:
        tried, right = brute_chain(hits, masks)
        assert [got[case, k] for k in range(1, 6)] == list(zip(tried, right))
    whole = {r.k: (r.total, r.correct) for r in metrics.chain_accuracy(df, [], 5).collect()}
    for k in range(1, 6):
        assert whole[k] == tuple(sum(got[c[0], k][i] for c in cases) for i in (0, 1))


def test_soft_cross_entropy_joins_two_distributions(spark):
    p = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5)], "g int, token string, p double")
    q = spark.createDataFrame([(1, "a", math.log(0.25)), (1, "b", math.log(0.75))], "g int, token string, log_q double")
    want = -0.5 * (math.log(0.25) + math.log(0.75))
    assert metrics.soft_cross_entropy(p, q, ["g"]).first().loss == pytest.approx(want)


def test_histogram_lists_empty_bins(spark):
    draws = spark.createDataFrame([(0, 0), (0, 0), (0, 2)], "position bigint, bin bigint")
    got = {r.bin: r.share for r in metrics.histogram(draws, 3).collect()}
    assert got == {0: pytest.approx(2 / 3), 1: 0.0, 2: pytest.approx(1 / 3)}


# --- distributions -------------------------------------------------------------


def scores(spark, rows):
    return spark.createDataFrame(rows, "g string, token string, score double")


def test_softmax_sums_to_one_and_bears_large_scores(spark):
    rows = [("x", str(i), s) for i, s in enumerate([1000.0, 999.0, -2000.0])] + [("y", "0", -5000.0)]
    got = dist.softmax(scores(spark, rows), "g").collect()
    total = {g: sum(r.p for r in got if r.g == g) for g in "xy"}
    assert total == {"x": pytest.approx(1), "y": pytest.approx(1)}
    assert {r.token: r.p for r in got if r.g == "x"}["0"] == pytest.approx(1 / (1 + math.exp(-1)))


def test_top_p_keeps_the_crossing_token_and_a_single_one(spark):
    rows = [("x", t, math.log(p)) for t, p in zip("abc", (0.5, 0.3, 0.2))] + [("y", "a", 0.0)]
    kept = dist.top_p(0.6, "g")(scores(spark, rows)).collect()
    assert sorted((r.g, r.token) for r in kept) == [("x", "a"), ("x", "b"), ("y", "a")]
    assert dist.top_p(1.0, "g")(scores(spark, rows)).count() == 4


def test_processor_list(spark):
    rows = scores(spark, [("x", "a", 2.0), ("x", "b", -1.0), ("x", "c", 1.5)])
    seen = spark.createDataFrame([("a",), ("b",)], "token string")
    assert dist.processors(1e-6, "g") == []
    chain = dist.processors(0.5, "g", penalty=2.0, seen=seen, k=2)
    got = {r.token: r.score for r in dist.apply_all(rows, chain).collect()}
    assert got == {"c": 3.0, "a": 2.0}
    assert dist.argmax(rows, "g").first().token == "a"


# --- paths ---------------------------------------------------------------------


def test_pad_path_example(spark):
    row = one(spark, p="array(1,2,3)").select(C.padded("p", 5, -2).alias("a"), C.padded("p", 2, -2).alias("b")).first()
    assert (row.a, row.b) == ([1, 2, 3, -2, -2], [1, 2, 3])


def test_tree_relations(spark):
    listed = [[0], [1], [0, 0], [0, 1], [0, 0, 0]]
    df = spark.createDataFrame([("r", p) for p in listed], "root string, ranks array<bigint>")
    tree = paths.prefix_tree(df)
    got = {tuple(r.prefix): (r.node, r.depth, r.parent) for r in tree.collect()}
    assert got == {(0,): (1, 1, 0), (1,): (2, 1, 0), (0, 0): (3, 2, 1), (0, 1): (4, 2, 1), (0, 0, 0): (5, 3, 3)}


@pytest.mark.parametrize(
    "candidate, target, want",
    [("array('a','b')", "array('a','b','c')", 2), ("array('a','x')", "array('a','b')", 1), ("array('x')", "array('a')", 0),
     ("array('a','b')", "array('a')", 1)],
)
def test_accept_length(spark, candidate, target, want):
    row = one(spark, c=candidate, t=target).select(paths.accept_length("c", "t").alias("n")).first()
    assert row.n == want


def test_best_candidate_prefers_the_lowest_index(spark):
    for lengths, want in [([0, 0], (0, 0)), ([1, 3, 3], (1, 3)), ([2], (0, 2))]:
        arr = f"array({','.join(f'{n}L' for n in lengths)})"
        row = one(spark, n=arr).select(paths.best_candidate("n").alias("b")).first()
        assert (row.b["cand"], row.b["length"]) == want


def test_path_expansion_equals_brute_force(spark):
    pairs = [("a", "b", 6), ("a", "c", 4), ("b", "a", 5), ("b", "c", 5), ("c", "a", 9), ("c", "b", 1)]
    df = spark.createDataFrame(pairs, "token string, next string, c bigint")
    table = paths.successors(df, 2)
    nodes = paths.expand_top_k(table.select("token"), table, 3, 2).filter("root = 'a'")
    got = nodes.filter("kept").collect()
    total, best = {}, {}
    for t, _, c in pairs:
        total[t] = total.get(t, 0) + c
    for t in total:
        best[t] = sorted([(-c, n) for a, n, c in pairs if a == t])[:2]
    live, want, scored = [(0.0, (), (), "a")], [], []
    for depth in (1, 2, 3):
        grown = [
            (score + math.log(-c / total[tail]), ranks + (i,), names + (n,), n)
            for score, ranks, names, tail in live
            for i, (c, n) in enumerate(best[tail])
        ]
        scored += grown
        live = sorted(grown, key=lambda x: (-round(x[0], 9), x[1]))[:2]
        want += [(depth, i, x[2]) for i, x in enumerate(live)]
    assert sorted((r.depth, r["rank"], tuple(r.tokens)) for r in got) == sorted(want)
    assert nodes.count() == len(scored) == 2 + 4 + 4
    best = sorted(scored, key=lambda x: (-round(x[0], 9), len(x[1]), x[1]))[:5]
    chosen = paths.rerank_top_n(nodes, 5).collect()
    assert {tuple(r.ranks) for r in chosen} == {x[1] for x in best}
    assert all(r.depth == 1 or tuple(r.ranks[:-1]) in {x[1] for x in best} for r in chosen)


@pytest.mark.parametrize("steps", [1, 2, 3, 5, 8])
def test_greedy_chains_equal_following_one_by_one(spark, steps):
    follow = {"a": "b", "b": "c", "c": "a", "d": "x", "e": "d", "f": "f"}
    df = spark.createDataFrame([(t, n, 2) for t, n in follow.items()] + [("a", "z", 1)], "token string, next string, c bigint")
    got = {r.token: r.chain for r in paths.greedy_chains(paths.successors(df, 2), steps).collect()}
    for token in follow:
        want, at = [], token
        while at in follow and len(want) < steps:
            at = follow[at]
            want.append(at)
        assert got[token] == want


# --- judge ---------------------------------------------------------------------


def test_marks_inside_an_answer_are_not_filled(spark):
    df = one(spark, t="'Q {question} A {answer_a} {other}'", q="'what {answer_a}?'", a="'{question} $1 \\\\\\\\'")
    out = df.select(judge.fill_template(F.col("t"), {"question": F.col("q"), "answer_a": F.col("a")}).alias("r")).first().r
    assert out.startswith("Q what {answer_a}? A {question} $1 ") and out.endswith(" {other}")


@pytest.mark.parametrize(
    "text, want",
    [("so [[A]] wins", ("A", None)), ("[[D]]", (None, None)), ("Rating: [[10]]", (None, 10)), ("[[0]]", (None, None)),
     ("[[C]] [[7]]", ("C", 7))],
)
def test_verdicts(spark, text, want):
    letter, rating = judge.parse_verdict("t")
    row = one(spark, t=f"'{text}'").select(letter.alias("l"), rating.alias("r")).first()
    assert (row.l, row.r) == want
