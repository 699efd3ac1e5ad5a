"""Streams that stop and go on give what one batch gives."""

import pytest
from pyspark.sql import functions as F

from turnwise.operators import answers, metrics
from turnwise.sources import schemas
from turnwise.sources.snapshots import SnapshotTable
from turnwise.streaming import flows


def log(spark, first, last):
    return spark.range(first, last).select(
        (F.col("id") % 5).alias("question_id"),
        F.concat(F.lit("a"), F.col("id").cast("string")).alias("answer_id"),
        F.concat(F.lit("m"), (F.col("id") % 2).cast("string")).alias("model_id"),
        F.expr(
            "array(named_struct('index', 0, 'turns', array('x','y'), 'idxs', array(1, 2), 'new_tokens', array(3, 4),"
            " 'wall_time', array(0.5D, 0.25D), 'alpha', array(1.0D), 'alpha_num', array(2.0D)))"
        ).alias("choices"),
        F.col("id").cast("double").alias("tstamp"),
    )


def newest(rows):
    return {(r.model_id, r.question_id): r.answer_id for r in rows.collect()}


def test_log_keeps_every_answer(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    log(spark, 0, 20).write.json(source)
    flows.log_answers(flows.answer_stream(spark, source, 2), out, state).awaitTermination()
    assert spark.read.schema(schemas.ANSWER).parquet(out).count() == 20


def test_upsert_across_restarts(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for first, last in ((0, 20), (20, 45)):
        log(spark, first, last).repartition(3).write.mode("append").json(source)
        flows.upsert_answers(flows.answer_stream(spark, source, 1), out, state, buckets=4).awaitTermination()
        assert newest(flows.latest_answers(spark, out, 4)) == newest(answers.dedup_last(log(spark, 0, last)))
        # One folder a bucket, whatever the number of micro-batches.
        assert len(flows.answer_table(spark, out, 4).newest()["buckets"]) <= 4
    assert flows.latest_answers(spark, out, 4).count() == 10


def test_an_older_answer_that_comes_late_changes_nothing(spark, tmp_path):
    table = flows.answer_table(spark, str(tmp_path), 4)
    assert table.merge(log(spark, 10, 20), answers.dedup_last, "w", 0)
    before = newest(table.read())
    assert table.merge(log(spark, 0, 10), answers.dedup_last, "w", 1)
    assert newest(table.read()) == before


def test_repeated_batches_and_other_writers(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path), "k string, n bigint", ["k"], 4)

    def rows(*pairs):
        return spark.createDataFrame(pairs, "k string, n bigint")

    def added(df):
        return df.groupBy("k").agg(F.sum("n").alias("n"))

    assert table.read().count() == 0 and table.vacuum() == 0
    assert table.merge(rows(("a", 1), ("b", 2), (None, 5)), added, "one", 0)
    assert not table.merge(rows(("a", 1), ("b", 2)), added, "one", 0)
    assert table.merge(rows(("a", 10)), added, "two", 0)
    assert table.merge(rows(), added, "one", 1)
    assert sorted(map(tuple, table.read().collect()), key=str) == [("a", 11), ("b", 2), (None, 5)]
    # The buckets of b and null were not written again.
    folders = {f.split("/")[1] for f in table.newest()["buckets"].values()}
    assert len(folders) == 2 and table.newest()["number"] == 3
    held = table.read()
    table.vacuum(keep=1)
    assert sorted(map(tuple, held.collect()), key=str) == [("a", 11), ("b", 2), (None, 5)]
    assert len(table.store.names("snapshots")) == 1


def test_a_merge_that_is_overtaken_fails_and_leaves_the_table_whole(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path), "k string, n bigint", ["k"], 2)
    row = spark.createDataFrame([("a", 1)], "k string, n bigint")

    def meanwhile(df):
        table.merge(row, lambda d: d, "other", 0)
        return df

    with pytest.raises(RuntimeError):
        table.merge(row, meanwhile, "one", 0)
    assert [tuple(r) for r in table.read().collect()] == [("a", 1)] and not table.done("one", 0)


def test_running_speed_across_restarts(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for first, last, n in ((0, 10, 5), (10, 40, 20)):
        log(spark, first, last).write.mode("append").json(source)
        flows.running_speed(flows.answer_stream(spark, source, 3), "model_id", out, state).awaitTermination()
        rows = flows.session_speeds(spark, out).collect()
        assert {r.session: (r.new_tokens, r.seconds, r.passes) for r in rows} == {
            f"m{i}": (n * 7, n * 0.75, n * 5) for i in range(2)
        }
        assert all(r.tokens_per_pass == 7 / 5 for r in rows)


def test_sessions_leave_the_state_when_their_timer_passes(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def add(*rows):
        """(model, second) of answers with seven tokens each."""
        ids = spark.createDataFrame([(m, 1000 + t) for m, t in rows], "model_id string, tstamp double")
        log(spark, 0, 1).drop("model_id", "tstamp").crossJoin(ids).select(*log(spark, 0, 1).columns).coalesce(1).write.mode(
            "append"
        ).json(source)
        closed = flows.closed_sessions(flows.answer_stream(spark, source), "model_id", idle=10)
        query = flows.write_closed(closed, out, state)
        query.awaitTermination()
        held = sum(o["numRowsTotal"] for o in query.recentProgress[-1]["stateOperators"])
        schema = closed.schema
        rows = spark.read.schema(schema).parquet(out).collect()
        return held, sorted((r.session, r.new_tokens, r.started - 1000, r.ended - 1000) for r in rows)

    held, rows = add(("a", 0.0), ("a", 5.0), ("b", 1.0))
    assert (held, rows) == (2, [])
    held, rows = add(("b", 12.0), ("c", 14.0), ("d", 18.0))
    assert (held, rows) == (3, [("a", 14, 0.0, 5.0)])
    held, rows = add(("e", 100.0))
    assert held == 1
    assert rows == [("a", 14, 0.0, 5.0), ("b", 14, 1.0, 12.0), ("c", 7, 14.0, 14.0), ("d", 7, 18.0, 18.0)]


DAY = 86400


@pytest.mark.parametrize("delay", [None, DAY / 2])
def test_rollup_has_open_windows_and_late_rows(spark, tmp_path, delay):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    every = []

    def add(rows):
        every.extend(rows)
        df = spark.createDataFrame(rows, "day int, acc double").select(
            F.timestamp_seconds(F.lit(1_700_006_400 + 43_200) + F.col("day") * DAY).alias("ts"),
            F.lit("r").alias("run"), F.lit("p").alias("position"), "acc", F.lit(1.0).alias("loss"),
        )
        schema = df.schema
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        flows.rollup_metrics(stream, out, state, delay=delay).awaitTermination()
        got = [(r.acc, r.n, round(r.acc_std, 9)) for r in flows.rolled_up(spark, out).orderBy("start").collect()]
        want = []
        for day in sorted({d for d, _ in every}):
            values = [a for d, a in every if d == day]
            mean = sum(values) / len(values)
            want.append((mean, len(values), round((sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5, 9)))
        assert got == want
        tables = flows.window_tables(spark, out)
        return {n: t.read().count() for n, t in tables.items()}

    sizes = add([(0, 0.5), (0, 1.5), (1, 3.0)])
    assert sizes == ({"open": 2, "closed": 0, "late": 0} if delay is None else {"open": 1, "closed": 1, "late": 0})
    sizes = add([(0, 7.0), (3, 5.0)])
    # The row of day 0 came when the watermark stood at the end of day 0.
    assert sizes == ({"open": 3, "closed": 0, "late": 0} if delay is None else {"open": 1, "closed": 2, "late": 1})
    sizes = add([(1, 4.0), (3, 6.0)])
    assert sizes == ({"open": 3, "closed": 0, "late": 0} if delay is None else {"open": 1, "closed": 2, "late": 2})
    closed = flows.closed_windows(spark, out).count()
    assert closed == (0 if delay is None else 2)


def test_moment_records_merge_to_those_of_all_rows(spark):
    rows = [(i % 3, i % 7, 1e6 + (i * 37 % 101) / 7 if i % 11 else None) for i in range(500)] + [(9, 0, None)]
    df = spark.createDataFrame(rows, "g int, part int, x double")
    whole = {r.g: r for r in df.groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()}
    merged = metrics.merged_moments(metrics.moments(df, ["g", "part"], ["x"]), ["g"], ["x"])
    got = merged.select("g", "x.n", metrics.moment_mean("x").alias("m"), metrics.deviation("x").alias("s")).collect()
    assert len(got) == 4
    for r in got:
        w = whole[r.g]
        assert r.n == w.n
        if r.n:
            assert abs(r.m - w.m) < 1e-9 * abs(w.m) and abs(r.s - w.s) < 1e-9
        else:
            assert r.m is None and r.s is None


def test_answer_schema_reads_logs_without_acceptance(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(
        '{"question_id":1,"answer_id":"a","model_id":"m","choices":[{"index":0,"turns":["x"],"idxs":[1],'
        '"new_tokens":[2],"wall_time":[0.5]}],"tstamp":1.5}\n'
    )
    row = spark.read.schema(schemas.ANSWER).json(str(tmp_path)).first()
    assert row.choices[0].alpha is None and row.choices[0].turns == ["x"]
