"""Acceptance, speed, accuracy and loss metrics.

Metrics that depend on a (context, target) token pair only are computed on counted
pairs, not on positions, so the shuffled data shrinks to the distinct pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.columns import leading_ones, total
from turnwise.operators.scale import best_per_group, running_sums

# --- answer logs ---------------------------------------------------------------


def alpha_by_depth(
    answers: DataFrame, depths: int | None = None, by_turn: bool = False, last_turn_only: bool = False
) -> DataFrame:
    """Accepted / tried per draft depth over all questions, rounded half-even.

    A log keeps the counters of a question's last turn, one slot per depth. With ``depths``
    the counters of all turns follow each other, so many slots a turn: they are added up,
    listed ``by_turn``, or those of the last turn are counted alone.
    """
    choice = F.get("choices", F.lit(0))
    slots = F.arrays_zip(choice["alpha"].alias("alpha"), choice["alpha_num"].alias("alpha_num"))
    at = answers.select("model_id", F.size(slots).alias("n"), F.posexplode(slots).alias("slot", "s"))
    width = F.lit(depths) if depths else F.col("n")
    turn = F.floor(F.col("slot") / width).cast("bigint")
    at = at.select("model_id", turn.alias("turn"), F.floor((F.col("n") - 1) / width).alias("last"),
                   F.pmod(F.col("slot"), width).cast("bigint").alias("depth"), "s")
    if last_turn_only:
        at = at.filter("turn = last")
    by = ["model_id", *(["turn"] if by_turn else []), "depth"]
    sums = at.groupBy(*by).agg(F.sum("s.alpha").alias("accepted"), F.sum("s.alpha_num").alias("tried"))
    return sums.withColumn("alpha", F.bround(F.try_divide("accepted", "tried"), 2))


def question_speeds(answers: DataFrame, tokens: Column | None = None) -> DataFrame:
    """Tokens, seconds and tokens per second of each question's first choice."""
    choice = F.get("choices", F.lit(0))
    made = total(choice["new_tokens"]) if tokens is None else tokens
    return answers.select(
        "model_id", "question_id", made.cast("bigint").alias("tokens"),
        total(choice["wall_time"]).alias("seconds"),
    ).withColumn("rate", F.try_divide("tokens", "seconds"))


def recounted_tokens(tokenizer_size=None, bos: int = 0) -> Column:
    """Tokens of the answer texts counted afresh; ``bos`` is what the tokenizer adds
    in front of each text."""
    from turnwise.functions.columns import tokens_of

    size = tokenizer_size or (lambda text: F.size(tokens_of(text)))
    turns = F.get("choices", F.lit(0))["turns"]
    return F.aggregate(turns, F.lit(0), lambda acc, t: acc + size(t) - F.lit(bos))


def speed_ratio(speeds: DataFrame, draft: str, baseline: str) -> DataFrame:
    """Mean rate per question of one model over that of another; not total over total."""
    def mean_of(model):
        return F.avg(F.when(F.col("model_id") == model, F.col("rate")))

    return speeds.agg(
        mean_of(draft).alias("draft_rate"), mean_of(baseline).alias("baseline_rate")
    ).withColumn("ratio", F.try_divide("draft_rate", "baseline_rate"))


def speed_totals(speeds: DataFrame) -> DataFrame:
    return speeds.groupBy("model_id").agg(
        F.sum("tokens").alias("tokens"), F.sum("seconds").alias("seconds"), F.count("*").alias("questions")
    )


def speed_by_question(speeds: DataFrame, draft: str, baseline: str) -> DataFrame:
    """Both models side by side on the questions that both answered. A question has one
    row per model, so grouping by question needs no second pass over the log."""

    def rate_of(model):
        return F.max(F.when(F.col("model_id") == model, F.struct("rate")))

    both = speeds.filter(F.col("model_id").isin(draft, baseline)).groupBy("question_id").agg(
        rate_of(draft).alias("d"), rate_of(baseline).alias("b")
    )
    return both.filter("d is not null and b is not null").select(
        "question_id", F.col("d.rate").alias("draft_rate"), F.col("b.rate").alias("baseline_rate")
    ).withColumn("ratio", F.try_divide("draft_rate", "baseline_rate"))


def compression_ratio(turns: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """New tokens per target pass; the logged pass index counts from zero."""
    return turns.groupBy(*by).agg(
        F.sum("new_tokens").alias("new_tokens"), F.sum(F.col("idx") + 1).alias("passes")
    ).withColumn("compression", F.try_divide("new_tokens", "passes"))


# --- metric logs: (run, epoch, split, worker, batch, position, acc, loss) -------


def mean_std(log: DataFrame, by: Sequence[str] = ("position",)) -> DataFrame:
    """Mean and population deviation over batches."""
    return log.groupBy(*by).agg(
        F.avg("acc").alias("acc_mean"),
        F.stddev_pop("acc").alias("acc_std"),
        F.avg("loss").alias("loss_mean"),
        F.stddev_pop("loss").alias("loss_std"),
        F.count("*").alias("n_batches"),
    )


def moments(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One record (n, mean, m2) per value column and group; m2 is the sum of squared gaps to the mean.

    Records of parts, from other workers or micro-batches, combine with ``merged_moments``.
    Nulls are not counted; a group without values has n = 0.
    """
    found = {}
    for v in values:
        n = F.count(v)
        mean = F.coalesce(F.avg(F.col(v).cast("double")), F.lit(0.0))
        m2 = F.coalesce(F.var_pop(F.col(v).cast("double")), F.lit(0.0)) * n
        found[v] = F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))
    return df.groupBy(*by).agg(*[c.alias(v) for v, c in found.items()])


def merged_moments(records: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Combine records of ``moments``: the result is that of all their rows together.

    The common mean is found first, and every record then adds its own squares and the gap of
    its mean to the common one, so nothing large is subtracted from something large.
    """
    group = Window.partitionBy(*by)
    at = records
    for v in values:
        n, mean = F.col(f"{v}.n"), F.col(f"{v}.mean")
        at = at.withColumn(f"_mean_{v}", F.coalesce(F.try_divide(F.sum(n * mean).over(group), F.sum(n).over(group)), F.lit(0.0)))
    sums = []
    for v in values:
        n, gap = F.col(f"{v}.n"), F.col(f"{v}.mean") - F.col(f"_mean_{v}")
        record = F.struct(
            F.sum(n).alias("n"), F.first(f"_mean_{v}").alias("mean"), F.sum(F.col(f"{v}.m2") + n * gap * gap).alias("m2")
        )
        sums.append(record.alias(v))
    return at.groupBy(*by).agg(*sums)


def deviation(record) -> Column:
    """Population deviation of a record; null without values."""
    record = F.col(record) if isinstance(record, str) else record
    return F.sqrt(F.try_divide(record["m2"], record["n"]))


def moment_mean(record) -> Column:
    record = F.col(record) if isinstance(record, str) else record
    return F.when(record["n"] > 0, record["mean"])


def summary(log: DataFrame, samples_per_batch: int, data_type: str, batch: Sequence[str] = ("batch",)) -> DataFrame:
    """The nested one-row summary of an evaluation. It has one entry per position.

    A batch counts once, however many positions it has. It is successful if all its rows
    are ``ok``; batches that failed are in no mean.
    """
    whole = log.groupBy(*batch).agg(
        F.bool_and("ok").alias("ok"), F.collect_list(F.struct("position", "acc", "loss")).alias("rows")
    )
    batches = whole.agg(F.count_if("ok").alias("successful_batches"), F.count("*").alias("total_batches"))
    per = mean_std(whole.filter("ok").select(F.inline("rows")))
    entries = F.struct(
        "position",
        F.struct(F.col("acc_mean").alias("mean"), F.col("acc_std").alias("std")).alias("accuracy"),
        F.struct(F.col("loss_mean").alias("mean"), F.col("loss_std").alias("std")).alias("loss"),
    )
    results = per.agg(F.sort_array(F.collect_list(entries)).alias("results"))
    return batches.join(results).select(
        (F.col("successful_batches") * samples_per_batch).alias("total_samples"),
        "successful_batches",
        "total_batches",
        F.lit(data_type).alias("data_type"),
        "results",
    )


def macro_mean(log: DataFrame) -> DataFrame:
    """Mean per worker, then the plain mean over workers."""
    keys = ["run", "epoch", "split", "position"]
    per_worker = log.groupBy(*keys, "worker").agg(F.avg("acc").alias("acc"), F.avg("loss").alias("loss"))
    return per_worker.groupBy(*keys).agg(F.avg("acc").alias("acc"), F.avg("loss").alias("loss"))


def batches_ok(log: DataFrame, by: Sequence[str], samples_per_batch: int = 1) -> DataFrame:
    done = F.count_if("ok")
    return log.groupBy(*by).agg(
        done.alias("successful_batches"),
        F.count("*").alias("total_batches"),
        (done * samples_per_batch).alias("samples_seen"),
    )


def running_mean(log: DataFrame, value: str, run: str, batch: str, every: int) -> DataFrame:
    """The mean so far, at every ``every``-th batch of a run."""
    at = running_sums(
        log.select(run, batch, value), [run], [batch],
        {"_sum": F.col(value), "n": F.lit(1).cast("bigint")}, inclusive=True,
    )
    return at.filter(F.pmod(F.col("n"), F.lit(every)) == 0).select(
        run, batch, "n", (F.col("_sum") / F.col("n")).alias("mean_so_far")
    )


def best_config(timings: DataFrame, penalty: dict[int, float]) -> DataFrame:
    """The configuration with the least time per penalty weight.

    Configurations without a weight, or with weight zero, take no part.
    """
    weights = F.create_map(*[F.lit(x) for kv in penalty.items() for x in kv])
    cost = F.try_divide(F.col("seconds"), F.try_element_at(weights, F.col("config")))
    return timings.withColumn("cost", cost).filter("cost is not null").agg(
        F.min_by("config", F.struct("cost", "config")).alias("config"), F.min("cost").alias("cost")
    )


# --- predictions ---------------------------------------------------------------


def accuracy(pairs: DataFrame, by: Sequence[str], correct: Column, weight: str = "n") -> DataFrame:
    """Right / all over counted positions, across all batches and workers."""
    return pairs.groupBy(*by).agg(
        F.sum(F.when(correct, F.col(weight)).otherwise(0)).alias("correct"), F.sum(weight).alias("total")
    ).withColumn("accuracy", F.try_divide("correct", "total"))


def accuracy_by_step(log: DataFrame, steps: int, hits: str = "hits", masks: str = "masks") -> DataFrame:
    """(position, correct, total, accuracy) of each draft step, from arrays of 0 and 1.

    Step k is right where the k-th drafted token is the token k ahead; positions without
    such a token are masked. The total is raised by 1e-6.
    """
    def number(name: str, k: int) -> Column:
        return F.coalesce(F.sum(F.get(name, F.lit(k))), F.lit(0)).cast("bigint")

    both = F.zip_with(hits, masks, lambda h, m: h * m)
    sums = log.select(both.alias("_right"), F.col(masks).alias("_open")).agg(
        F.array(
            *[
                F.struct(F.lit(k).cast("bigint").alias("position"), number("_right", k).alias("correct"), number("_open", k).alias("total"))
                for k in range(steps)
            ]
        ).alias("s")
    )
    return sums.select(F.inline("s")).withColumn("accuracy", F.col("correct") / (F.col("total") + 1e-6))


def accuracy_top_k(pairs: DataFrame, by: Sequence[str], ranked: str, target: str, ks: Sequence[int],
                   weight: str = "n") -> DataFrame:
    """Credit when the target is among the first k ranked predictions."""
    at = F.array_position(F.coalesce(F.col(ranked), F.array().cast("array<string>")), F.col(target))
    hits = [
        F.sum(F.when(at.between(1, k), F.col(weight)).otherwise(0)).alias(f"top{k}") for k in ks
    ]
    sums = pairs.groupBy(*by).agg(*hits, F.sum(weight).alias("total"))
    return sums.withColumns({f"acc{k}": F.try_divide(f"top{k}", "total") for k in ks})


def chain_runs(hits: str, masks: str) -> tuple[Column, Column]:
    """(steps before the first masked one, right steps before the first miss) of one
    draft chain, given its arrays of 0 and 1."""
    open_steps = leading_ones(masks)
    return open_steps, F.least(leading_ones(hits), open_steps)


def chain_accuracy(log: DataFrame, by: Sequence[str], steps: int, hits="hits", masks="masks") -> DataFrame:
    """Accuracy of each draft step over all start positions.

    The chain ends at the first masked step. A miss before that makes all later steps
    count as tried and wrong, masked or not. A chain's part is settled by two small
    numbers, so chains are counted by these before the steps are listed.
    """
    open_steps, right = chain_runs(hits, masks)
    alike = log.groupBy(*by, open_steps.alias("open"), right.alias("right")).agg(F.count("*").alias("n"))
    ks = F.sequence(F.lit(1).cast("bigint"), F.lit(steps).cast("bigint"))
    at = alike.withColumn("k", F.explode(ks))
    tried = (F.col("right") < F.col("open")) | (F.col("k") <= F.col("open"))
    return at.groupBy(*by, "k").agg(
        F.sum(F.when(F.col("k") <= F.col("right"), F.col("n")).otherwise(0)).alias("correct"),
        F.sum(F.when(tried, F.col("n")).otherwise(0)).alias("total"),
    ).withColumn("accuracy", F.try_divide("correct", "total"))


def chain_epoch_accuracy(
    log: DataFrame, worker: Column, batch: Sequence[str], steps: int, batches: int | None = None
) -> DataFrame:
    """Mean over workers of the mean over their batches, per draft step.

    ``batches`` takes the first so many batches of each worker, in the order of their
    keys, before batches in which a step was never tried drop out of that step's mean;
    None takes all.
    """
    kept = log.withColumn("worker", worker)
    if batches is not None:
        keys = kept.select("worker", *batch).distinct()
        first = best_per_group(keys, ["worker"], [F.col(b) for b in batch], batches, "_b").drop("_b")
        kept = kept.join(first, ["worker", *batch], "left_semi")
    per_batch = chain_accuracy(kept, ["worker", *batch], steps).filter("total > 0")
    per_worker = per_batch.groupBy("worker", "k").agg(F.avg("accuracy").alias("accuracy"))
    return per_worker.groupBy("k").agg(F.avg("accuracy").alias("accuracy"))


# --- losses --------------------------------------------------------------------


def soft_cross_entropy(target: DataFrame, draft: DataFrame, group: Sequence[str]) -> DataFrame:
    """-sum p log q per group, from two long distributions (group, token, p) and
    (group, token, log_q)."""
    both = target.join(draft, [*group, "token"])
    return both.groupBy(*group).agg((-F.sum(F.col("p") * F.col("log_q"))).alias("loss"))


def decayed(losses: DataFrame, step: str, loss: str, factor: float = 0.8) -> DataFrame:
    return losses.agg(F.sum(F.pow(F.lit(factor), F.col(step)) * F.col(loss)).alias("loss"))


def combined_loss(rows: DataFrame, value_loss: str, prob_loss: str, mask: str,
                  value_weight: float = 1.0, prob_weight: float = 0.1) -> DataFrame:
    """Weighted sum of two masked losses, each over the mask total plus 1e-5."""
    kept = F.sum(mask) + 1e-5
    return rows.agg(
        (F.sum(F.col(value_loss) * F.col(mask)) / kept).alias("vloss"),
        (F.sum(F.col(prob_loss) * F.col(mask)) / kept).alias("ploss"),
    ).withColumn("loss", F.col("vloss") * value_weight + F.col("ploss") * prob_weight)


# --- empirical against expected ------------------------------------------------


def histogram(draws: DataFrame, bins: int, by: str = "position", bin_col: str = "bin") -> DataFrame:
    """Share of each bin per position; bins never drawn are listed with share 0."""
    counts = draws.groupBy(by, bin_col).agg(F.count("*").alias("n"))
    drawn = counts.groupBy(by).agg(
        F.sum("n").alias("_total"), F.map_from_entries(F.collect_list(F.struct(bin_col, "n"))).alias("_m")
    )
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))
    return drawn.select(by, "_total", "_m", F.explode(every).alias(bin_col)).select(
        by, bin_col,
        (F.coalesce(F.try_element_at("_m", F.col(bin_col)), F.lit(0)) / F.col("_total")).alias("share"),
    )


def total_variation(hist: DataFrame, expected: DataFrame, by: str = "position", bin_col: str = "bin") -> DataFrame:
    return hist.join(expected, [by, bin_col] if by in expected.columns else [bin_col]).groupBy(by).agg(
        (F.sum(F.abs(F.col("share") - F.col("expected"))) / 2).alias("distance")
    )
