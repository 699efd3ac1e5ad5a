"""The append-style flows as Structured Streaming jobs on file sources.

Micro-batches merge into keyed tables in numbered snapshots (``sources.snapshots``): a reader
opens one snapshot, a repeated batch is passed over, and a batch rewrites only the buckets that
its keys fall in. Nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnwise.operators.answers import dedup_last, explode_turns
from turnwise.operators.metrics import deviation, merged_moments, moment_mean, moments
from turnwise.sources import schemas
from turnwise.sources.snapshots import SnapshotTable

#: Buckets of the tables that streams merge into; more of them for tables of many gigabytes.
BUCKETS = 8
_SPEED = "session string, new_tokens bigint, seconds double, passes bigint"
_RECORD = "struct<n:bigint,mean:double,m2:double>"
_WINDOW = f"start timestamp, end timestamp, run string, position string, acc {_RECORD}, loss {_RECORD}"
_WINDOW_KEYS = ["start", "end", "run", "position"]


def answer_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schemas.ANSWER).option("maxFilesPerTrigger", files_per_trigger).json(path)


def _each_batch(stream: DataFrame, checkpoint: str, take: Callable[[DataFrame, int, str], None]) -> StreamingQuery:
    """Hand every micro-batch to ``take`` with its number and the name of the query, which
    stays the same when the query is started again on its checkpoint."""

    def run(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        take(batch, number, query or checkpoint)

    return (
        stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


# --- latest answers ------------------------------------------------------------


def log_answers(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append arriving answers to a Parquet log, exactly once, in a folder per model."""
    return (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .partitionBy("model_id")
        .trigger(availableNow=True)
        .start()
    )


def answer_table(spark: SparkSession, out: str, buckets: int = BUCKETS) -> SnapshotTable:
    return SnapshotTable(spark, out, schemas.ANSWER, ["model_id", "question_id"], buckets)


def upsert_answers(stream: DataFrame, out: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the newest answer per (model, question): each micro-batch replaces the rows of its
    buckets that it outdates. Old snapshots are removed as it goes, all but the last two."""

    def take(batch: DataFrame, number: int, query: str) -> None:
        table = answer_table(batch.sparkSession, out, buckets)
        table.merge(batch, dedup_last, query, number)
        table.vacuum(keep=2)

    return _each_batch(stream, checkpoint, take)


def latest_answers(spark: SparkSession, out: str, buckets: int = BUCKETS) -> DataFrame:
    """The newest answer per (model, question), as of the last snapshot."""
    return answer_table(spark, out, buckets).read()


# --- running speed -------------------------------------------------------------


def _turn_sums(stream: DataFrame, session: str) -> DataFrame:
    choice = stream.withColumn("choice", F.get("choices", F.lit(0))).drop("choices")
    turns = explode_turns(choice)
    return turns.select(
        F.col(session).cast("string").alias("session"),
        F.col("tstamp"),
        F.col("new_tokens").cast("bigint").alias("new_tokens"),
        F.col("wall_time").alias("seconds"),
        (F.col("idx") + 1).cast("bigint").alias("passes"),
    )


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session").agg(*[F.sum(c).alias(c) for c in ("new_tokens", "seconds", "passes")])


def running_speed(stream: DataFrame, session: str, out: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Tokens, seconds and passes of each session so far, kept below ``out``; read them at any
    time with ``session_speeds``. Rows may come in any order."""
    turns = _turn_sums(stream, session)

    def take(batch: DataFrame, number: int, query: str) -> None:
        table = SnapshotTable(batch.sparkSession, out, _SPEED, ["session"], buckets)
        table.merge(_added(batch), _added, query, number)
        table.vacuum(keep=2)

    return _each_batch(turns, checkpoint, take)


def _rates(sums: DataFrame) -> DataFrame:
    return sums.select(
        "*",
        F.try_divide("new_tokens", "seconds").alias("tokens_per_second"),
        F.try_divide("new_tokens", "passes").alias("tokens_per_pass"),
    )


def session_speeds(spark: SparkSession, out: str, buckets: int = BUCKETS) -> DataFrame:
    """The sums so far, with tokens per second and per pass."""
    return _rates(SnapshotTable(spark, out, _SPEED, ["session"], buckets).read())


def closed_sessions(stream: DataFrame, session: str, idle: float, late: float = 0.0) -> DataFrame:
    """A stream of sessions that are over: none of their rows came for ``idle`` seconds of event time.

    Each session has a timer in the state store; when the watermark (``late`` seconds behind the
    newest row) passes it, the session's sums come out once and its state is removed. Rows
    older than the watermark are not counted here; ``running_speed`` has them.
    """
    turns = _turn_sums(stream, session).withColumn("at", F.timestamp_seconds("tstamp"))
    timed = turns.withWatermark("at", f"{late} seconds")
    out = f"{_SPEED}, started double, ended double"
    state = "new_tokens bigint, seconds double, passes bigint, started double, ended double"

    def keep(key: tuple, parts: Iterator, kept) -> Iterator:
        import pandas as pd

        if kept.hasTimedOut:
            row = kept.get
            kept.remove()
            yield pd.DataFrame([(key[0], *row)], columns=["session", "new_tokens", "seconds", "passes", "started", "ended"])
            return
        tokens, seconds, passes, started, ended = kept.get if kept.exists else (0, 0.0, 0, float("inf"), float("-inf"))
        for part in parts:
            tokens += int(part["new_tokens"].sum())
            seconds += float(part["seconds"].sum())
            passes += int(part["passes"].sum())
            started, ended = min(started, float(part["tstamp"].min())), max(ended, float(part["tstamp"].max()))
        kept.update((tokens, seconds, passes, started, ended))
        # A timer may not lie behind the watermark, and goes off only when this has passed it: a millisecond less, so
        # that a session is over when the watermark stands at its last second of waiting.
        kept.setTimeoutTimestamp(max(int((ended + idle) * 1000) - 1, kept.getCurrentWatermarkMs() + 1))

    return _rates(timed.groupBy("session").applyInPandasWithState(keep, out, state, "append", "EventTimeTimeout"))


def write_closed(closed: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return (
        closed.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


# --- metric roll-up ------------------------------------------------------------


def _window_records(rows: DataFrame) -> DataFrame:
    return merged_moments(rows, _WINDOW_KEYS, ["acc", "loss"])


def window_tables(spark: SparkSession, out: str, buckets: int = BUCKETS) -> dict[str, SnapshotTable]:
    """Open windows, closed ones, and what came for a window after it was closed."""
    names = ("open", "closed", "late")
    return {n: SnapshotTable(spark, f"{out.rstrip('/')}/{n}", _WINDOW, _WINDOW_KEYS, buckets) for n in names}


def rollup_metrics(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    at: str = "ts",
    width: str = "1 day",
    delay: float | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Moment records (n, mean, m2) per (window, run, position) below ``out``.

    The watermark is ``delay`` seconds behind the newest event time of earlier batches; without
    a delay no window closes. Windows that it passes leave the open table for the closed one,
    and rows for such windows go to the late table, so what a batch rewrites is bounded by
    the open windows. ``rolled_up`` merges all three, ``closed_windows`` shows what is final.
    """
    window = stream.withColumn("w", F.window(at, width)).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "run", "position", "acc", "loss",
        F.unix_micros(F.col(at).cast("timestamp")).alias("micros"),
    )

    def take(batch: DataFrame, number: int, query: str) -> None:
        tables = window_tables(batch.sparkSession, out, buckets)
        if tables["open"].done(query, number):
            return
        seen = tables["open"].newest()["notes"].get("newest")
        newest = max([m for m in (seen, batch.agg(F.max("micros")).first()[0]) if m is not None], default=None)

        def passed(micros: int | None) -> Column:
            if micros is None or delay is None:
                return F.lit(False)
            return F.unix_micros("end") <= F.lit(micros - int(delay * 1e6))

        part = moments(batch, _WINDOW_KEYS, ["acc", "loss"]).persist()
        try:
            fresh = part.filter(~passed(seen))
            held = tables["open"].read()
            if delay is not None:
                # A repeated batch finds the open table as it was, so the same windows close.
                tables["late"].merge(part.filter(passed(seen)), _window_records, query, number)
                closing = _window_records(held.unionByName(fresh)).filter(passed(newest))
                tables["closed"].merge(closing, _window_records, query, number)
            # Closing windows are passed in with no rows, so that their buckets are rewritten without them.
            none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
            touched = held.filter(passed(newest)).select(*_WINDOW_KEYS, none.alias("acc"), none.alias("loss"))
            tables["open"].merge(
                fresh.unionByName(touched),
                lambda rows: _window_records(rows).filter(~passed(newest)),
                query,
                number,
                {"newest": newest},
            )
        finally:
            part.unpersist()
        for table in tables.values():
            table.vacuum(keep=2)

    return _each_batch(window, checkpoint, take)


def _means(records: DataFrame) -> DataFrame:
    return records.select(
        *_WINDOW_KEYS,
        moment_mean("acc").alias("acc"),
        moment_mean("loss").alias("loss"),
        deviation("acc").alias("acc_std"),
        deviation("loss").alias("loss_std"),
        F.col("loss.n").alias("n"),
    )


def rolled_up(spark: SparkSession, out: str, buckets: int = BUCKETS) -> DataFrame:
    """Mean and deviation of accuracy and loss of every window so far: closed, open and late rows merged."""
    tables = window_tables(spark, out, buckets)
    every = tables["closed"].read().unionByName(tables["open"].read()).unionByName(tables["late"].read())
    return _means(_window_records(every))


def closed_windows(spark: SparkSession, out: str, buckets: int = BUCKETS) -> DataFrame:
    """The same for closed windows, each with the late rows that came for it."""
    tables = window_tables(spark, out, buckets)
    return _means(_window_records(tables["closed"].read().unionByName(tables["late"].read())))
