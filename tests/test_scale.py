"""Ordinals, prefix sums and lookups against brute force, with one group owning a third
of the rows, and proof that the hot group is spread."""

import itertools
import os

import pytest
from pyspark.sql import functions as F

from turnwise.operators import scale
from turnwise.session import scratch_dir

N = 30000


def skewed(spark):
    """A third of the rows belong to group 0, the rest to 200 other groups."""
    row = F.col("id")
    return (
        spark.range(N, numPartitions=7)
        .withColumn("g", F.when(row % 3 == 0, 0).otherwise(1 + row % 200).cast("bigint"))
        .withColumn("o", (row * 7919) % N)
        .withColumn("v", row % 11)
    )


class Session:
    """Stands in for a session with the given settings."""

    def __init__(self, master, **conf):
        self.conf = conf
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})


def test_scratch_dir_is_the_one_the_session_names():
    named = {"spark.checkpoint.dir": "s3://shared/folder/"}
    assert scratch_dir(Session("yarn", **named)) == "s3://shared/folder"
    with pytest.raises(ValueError):
        scratch_dir(Session("yarn"))
    assert scratch_dir(Session("local[2]")) == scratch_dir(Session("local[2]"))


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Keep small inputs in several partitions, as large ones are."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def test_dense_index_counts_without_gaps(spark):
    rows = scale.dense_index(skewed(spark), ["o"]).collect()
    assert sorted((r.idx, r.o) for r in rows) == list(zip(range(N), range(N)))


def test_dense_index_of_nothing(spark):
    assert scale.dense_index(spark.range(0), ["id"]).collect() == []


@pytest.mark.parametrize("inclusive", [False, True])
def test_running_sums_equal_brute_force(spark, inclusive):
    df = skewed(spark)
    got = scale.running_sums(df, ["g"], ["o"], {"s": F.col("v"), "n": F.lit(1)}, inclusive).collect()
    want = {}
    for g, rows in itertools.groupby(sorted(df.collect(), key=lambda r: (r.g, r.o)), key=lambda r: r.g):
        s = n = 0
        for r in rows:
            if inclusive:
                s, n = s + r.v, n + 1
            want[r.id] = (s, n)
            if not inclusive:
                s, n = s + r.v, n + 1
    assert {r.id: (r.s, r.n) for r in got} == want


def test_running_sums_cut_the_hot_group(spark):
    df = skewed(spark).repartitionByRange("g", "o").withColumn("p", F.spark_partition_id())
    pieces = df.filter("g = 0").groupBy("p").count().collect()
    assert len(pieces) >= 2
    assert max(r["count"] for r in pieces) < N / 4


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("how", ["left", "inner", "semi", "anti"])
def test_lookup_equals_plain_join(spark, weighted, how):
    df = skewed(spark).select("id", "g")
    table = df.groupBy("g").agg(F.count("*").alias("w")).filter("g % 5 <> 1").withColumn("name", F.col("g") * 10)
    got = scale.lookup(df, table if weighted else table.drop("w"), ["g"], ["id"], "w" if weighted else None, how)
    plain = df.join(table.drop("w"), "g", {"semi": "left_semi", "anti": "left_anti"}.get(how, how))
    assert sorted(map(tuple, got.select(plain.columns).collect()), key=str) == sorted(
        map(tuple, plain.collect()), key=str
    )


def test_lookup_works_beyond_the_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(scale, "HOT_KEYS", 3)
    df = skewed(spark).select("id", "g")
    table = df.groupBy("g").agg(F.count("*").alias("w")).withColumn("name", F.col("g") * 10)
    got = scale.lookup(df, table, ["g"], ["id"], "w")
    assert got.filter("name = g * 10").count() == N


def test_lookup_spreads_the_hot_key(spark, monkeypatch):
    monkeypatch.setattr(scale, "HOT_KEYS", 3)
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        df = skewed(spark).select("id", "g")
        table = df.groupBy("g").agg(F.count("*").alias("w")).withColumn("name", F.col("g") * 10)
        sizes = scale.lookup(df, table, ["g"], ["id"], "w").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in sizes) == N
    assert max(r["count"] for r in sizes) < N / 8 * 1.5


def test_best_per_group_is_limited_before_the_shuffle(spark):
    best = scale.best_per_group(skewed(spark), ["g"], [F.desc("o")], 2)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert best.filter("g = 0").count() == 2


def test_scratch_tables_go_when_released(spark, tmp_path):
    from turnwise.session import release, scratch, scratch_dir, written

    release(spark)
    with scratch(spark):
        kept = written(spark.range(5), "probe")
        where = scratch_dir(spark).removeprefix("file:")
        assert kept.count() == 5 and any(n.startswith("probe-") for n in os.listdir(where))
    assert not any(n.startswith("probe-") for n in os.listdir(where))
