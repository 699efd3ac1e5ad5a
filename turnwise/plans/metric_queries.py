"""Queries on predictions, losses, metric logs, distributions and candidate paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions import columns as C
from turnwise.operators import dist, metrics, paths
from turnwise.operators.scale import lookup
from turnwise.plans import fixtures as fx
from turnwise.plans.answer_queries import rounded
from turnwise.plans.ctes import BEAM_BEST, BEAM_WIDTH
from turnwise.plans.registry import query
from turnwise.session import scratch_path, written
from turnwise.sources import writers

# --- accuracy ------------------------------------------------------------------


@query(
    "acc_topk",
    """SELECT split, CAST(sum(h1) AS BIGINT) AS top1, CAST(sum(h2) AS BIGINT) AS top2, CAST(sum(h3) AS BIGINT) AS top3, count(*) AS total,
              round(sum(h1) / count(*), 6) AS acc1, round(sum(h2) / count(*), 6) AS acc2, round(sum(h3) / count(*), 6) AS acc3
       FROM (SELECT p.split, CAST(coalesce(r <= 0, false) AS INT) AS h1, CAST(coalesce(r <= 1, false) AS INT) AS h2,
                    CAST(coalesce(r <= 2, false) AS INT) AS h3
             FROM z_pos p LEFT JOIN z_rank k ON k.token = p.token AND k.nxt = p.nxt) GROUP BY split""",
)
def acc_topk(spark, sf_dir):
    pairs = fx.scored_pairs(fx.pair_counts(spark, sf_dir, "split"), 3, "split")
    out = metrics.accuracy_top_k(pairs, ["split"], "ranked", "next", (1, 2, 3))
    return rounded(out, "acc1", "acc2", "acc3")


@query(
    "acc_micro",
    """SELECT split, CAST(sum(CAST(coalesce(b.nxt = p.nxt, false) AS INT)) AS BIGINT) AS correct, count(*) AS total,
              round(sum(CAST(coalesce(b.nxt = p.nxt, false) AS INT)) / count(*), 6) AS accuracy
       FROM z_pos p LEFT JOIN z_best b USING (token) GROUP BY split""",
)
def acc_micro(spark, sf_dir):
    pairs = fx.scored_pairs(fx.pair_counts(spark, sf_dir, "split"), 1, "split")
    return rounded(metrics.accuracy(pairs, ["split"], F.get("ranked", F.lit(0)) == F.col("next")), "accuracy")


@query(
    "acc_by_position",
    """SELECT CAST(k - 1 AS BIGINT) AS position, CAST(sum(mask * hit) AS BIGINT) AS correct, CAST(sum(mask) AS BIGINT) AS total,
              round(sum(mask * hit) / (sum(mask) + 1e-6), 6) AS accuracy FROM z_vhits GROUP BY k""",
)
def acc_by_position(spark, sf_dir):
    """Drafts may only hold tokens of the draft vocabulary."""
    log = fx.chain_log(spark, sf_dir, fx.STEPS, within=fx.draft_top(spark, sf_dir))
    return rounded(metrics.accuracy_by_step(log, fx.STEPS), "accuracy")


CHAIN = """SELECT split, CAST(k AS BIGINT) AS k, CAST(sum(live * mask * hit) AS BIGINT) AS correct,
       count(*) FILTER (live * mask = 1 OR missed = 1) AS total FROM z_missed GROUP BY split, k"""


@query("acc_chain_k", f"SELECT *, round(correct / total, 6) AS accuracy FROM ({CHAIN})")
def acc_chain_k(spark, sf_dir):
    return rounded(metrics.chain_accuracy(fx.chain_log(spark, sf_dir), ["split"], 5), "accuracy")


@query(
    "acc_chain_epoch",
    """WITH batch AS (SELECT conv_id, turn, k, conv_id % 4 AS worker, sum(live * mask * hit) / count(*) FILTER (live * mask = 1 OR missed = 1) AS acc,
                   count(*) FILTER (live * mask = 1 OR missed = 1) AS total FROM z_missed GROUP BY conv_id, turn, k)
       SELECT CAST(k AS BIGINT) AS k, round(avg(acc) + 1e-9, 6) AS accuracy
       FROM (SELECT worker, k, avg(acc) AS acc FROM batch WHERE total > 0 GROUP BY worker, k) GROUP BY k""",
)
def acc_chain_epoch(spark, sf_dir):
    """A batch is one answer; each worker reports all of its batches."""
    log = fx.chain_log(spark, sf_dir)
    out = metrics.chain_epoch_accuracy(log, F.pmod("conv_id", F.lit(4)), ["conv_id", "turn"], 5)
    return rounded(out.withColumn("accuracy", F.col("accuracy") + 1e-9), "accuracy")


# --- losses --------------------------------------------------------------------


def _step_losses(spark, sf_dir):
    """Soft cross-entropy per draft step: counts over the draft vocabulary against
    smoothed training counts, over all answer positions.

    At step k every position looks k places on, so the last k have no target and count as
    0, and so does a context whose most frequent follower of all is outside the draft
    vocabulary. With p = c / sum(c) and q = t / sum(t), -sum(p log q) is
    log(sum(t)) - sum(c log t) / sum(c), so one grouping gives each context's loss.
    """
    pairs = fx.pair_counts(spark, sf_dir, "position", "split")
    known = fx.draft_top(spark, sf_dir).select(F.col("token").alias("next"), F.lit(True).alias("known"))
    summed = pairs.groupBy("token", "next").agg(
        F.sum("c").alias("c"), (F.sum(F.when(F.col("split") == "train", F.col("c")).otherwise(0)) + 1).alias("t")
    )
    inside = F.coalesce("known", F.lit(False))
    losses = summed.join(known, "next", "left").groupBy("token").agg(
        F.min_by(inside, F.struct(-F.col("c"), "next")).alias("best_known"),
        (
            F.ln(F.sum(F.when(inside, F.col("t"))))
            - F.sum(F.when(inside, F.col("c") * F.ln("t"))) / F.sum(F.when(inside, F.col("c")))
        ).alias("loss"),
    )
    at = pairs.groupBy("position", "token").agg(F.sum("c").alias("n"))
    met = at.join(losses, "token")
    by_place = met.groupBy("position").agg(
        F.sum(F.when(F.col("best_known"), F.coalesce("loss", F.lit(0.0)) * F.col("n")).otherwise(0.0)).alias("loss"),
        F.sum("n").alias("n"),
    )
    # A position serves the steps 0 to its own place; its row stands for one place or the last.
    steps = by_place.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("position"))).alias("position"), "loss", "n")
    places = fx.answer_places(spark, sf_dir)
    return steps.groupBy("position").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).join(places).select(
        "position", (F.col("loss") / F.col("places")).alias("loss"), "n"
    )


@query("loss_by_position", "SELECT position, round(loss, 6) AS loss, n FROM z_steploss")
def loss_by_position(spark, sf_dir):
    return rounded(_step_losses(spark, sf_dir), "loss")


@query("loss_decayed", "SELECT round(sum(pow(0.8, position) * loss), 6) AS loss FROM z_steploss")
def loss_decayed(spark, sf_dir):
    return rounded(metrics.decayed(_step_losses(spark, sf_dir), "position", "loss"), "loss")


EMB = """SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"""
GUESS = f"""SELECT vec_id, label, x AS y, x + (('0x' || substr(md5(vec_id || ':' || pos || ':42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE - 0.5) * 10.0 * 512 / 64 AS g FROM ({EMB})"""
HUBER = f"SELECT vec_id, label, avg(CASE WHEN abs(g - y) < 1 THEN 0.5 * (g - y) * (g - y) ELSE abs(g - y) - 0.5 END) AS huber FROM ({GUESS}) GROUP BY vec_id, label"


def _guesses(spark, sf_dir):
    """Embeddings and a noisy guess of each."""
    from turnwise.operators.features import keyed_uniform, uniform_noise

    e = fx.table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("target"),
        uniform_noise("embedding", keyed_uniform("vec_id", 42), 10.0, F.size("embedding")).alias("guess"),
    )


@query("smooth_l1", f"SELECT vec_id, round(huber, 6) AS loss FROM ({HUBER})")
def smooth_l1(spark, sf_dir):
    rows = _guesses(spark, sf_dir).select("vec_id", C.mean_smooth_l1("guess", "target").alias("loss"))
    return rounded(rows, "loss")


@query(
    "loss_combined",
    f"""WITH g AS ({GUESS}), h AS ({HUBER}),
            s AS (SELECT vec_id, exp(y) / sum(exp(y)) OVER w AS p, g - ln(sum(exp(g)) OVER w) AS lq FROM g WINDOW w AS (PARTITION BY vec_id)),
            c AS (SELECT vec_id, -sum(p * lq) AS ce FROM s GROUP BY vec_id),
            m AS (SELECT huber, ce, CAST(label % 2 AS INT) AS mask FROM h JOIN c USING (vec_id)),
            r AS (SELECT sum(huber * mask) / (sum(mask) + 1e-5) AS v, sum(ce * mask) / (sum(mask) + 1e-5) AS p FROM m)
       SELECT round(v, 6) AS vloss, round(p, 6) AS ploss, round(v + 0.1 * p, 6) AS loss FROM r""",
)
def loss_combined(spark, sf_dir):
    rows = _guesses(spark, sf_dir)
    target_p = F.transform(C.vector_log_softmax("target"), F.exp)
    cross = F.zip_with(target_p, C.vector_log_softmax("guess"), lambda p, q: -p * q)
    rows = rows.select(
        C.mean_smooth_l1("guess", "target").alias("v"), C.total(cross).alias("p"), F.pmod("label", F.lit(2)).alias("mask")
    )
    return rounded(metrics.combined_loss(rows, "v", "p", "mask"), "vloss", "ploss", "loss")


# --- metric logs ---------------------------------------------------------------


@query(
    "metric_mean_std",
    """SELECT position, round(avg(acc) + 1e-9, 6) AS acc_mean, round(stddev_pop(acc) + 1e-9, 6) AS acc_std, round(avg(loss) + 1e-9, 6) AS loss_mean,
              round(stddev_pop(loss) + 1e-9, 6) AS loss_std, count(*) AS n_batches FROM z_metric GROUP BY position""",
)
def metric_mean_std(spark, sf_dir):
    return rounded(metrics.mean_std(fx.metric_log(spark, sf_dir)), "acc_mean", "acc_std", "loss_mean", "loss_std", nudge=1e-9)


@query(
    "metric_merged_moments",
    """SELECT run, position, count(*) AS n, round(avg(acc) + 1e-9, 6) AS acc_mean, round(stddev_pop(acc) + 1e-9, 6) AS acc_std,
              round(avg(loss) + 1e-9, 6) AS loss_mean, round(stddev_pop(loss) + 1e-9, 6) AS loss_std FROM z_metric GROUP BY run, position""",
)
def metric_merged_moments(spark, sf_dir):
    """Every worker keeps a record per epoch; the records are merged."""
    by = ["run", "position"]
    records = metrics.moments(fx.metric_log(spark, sf_dir), [*by, "worker", "epoch"], ["acc", "loss"])
    merged = metrics.merged_moments(records, by, ["acc", "loss"]).select(
        *by, "acc.n",
        *[c for v in ("acc", "loss") for c in (metrics.moment_mean(v).alias(f"{v}_mean"), metrics.deviation(v).alias(f"{v}_std"))],
    )
    return rounded(merged, "acc_mean", "acc_std", "loss_mean", "loss_std", nudge=1e-9)


@query(
    "sink_metric_summary",
    """WITH l AS (SELECT * REPLACE (batch // 4 AS batch) FROM z_metric), b AS (SELECT batch, bool_and(ok) AS good FROM l GROUP BY batch)
       SELECT position, (SELECT count(*) FROM b WHERE good) * 2 AS total_samples, (SELECT count(*) FROM b WHERE good) AS successful_batches,
              (SELECT count(*) FROM b) AS total_batches, 'events' AS data_type, round(avg(acc) + 1e-9, 6) AS acc_mean,
              round(stddev_pop(acc) + 1e-9, 6) AS acc_std, round(avg(loss) + 1e-9, 6) AS loss_mean, round(stddev_pop(loss) + 1e-9, 6) AS loss_std
       FROM l JOIN b USING (batch) WHERE good GROUP BY position""",
)
def sink_metric_summary(spark, sf_dir):
    """Four events are a batch; one that is not ok fails it."""
    path = scratch_path(spark, "summary")
    log = fx.metric_log(spark, sf_dir).withColumn("batch", F.floor(F.col("batch") / 4))
    one = metrics.summary(log, 2, "events")
    writers.write_summary(one, path)
    back = spark.read.schema(one.schema).json(path)
    counts = ("total_samples", "successful_batches", "total_batches", "data_type")
    rows = back.select(*counts, F.explode("results").alias("r")).select(
        "r.position", *counts, F.col("r.accuracy.mean").alias("acc_mean"),
        F.col("r.accuracy.std").alias("acc_std"), F.col("r.loss.mean").alias("loss_mean"), F.col("r.loss.std").alias("loss_std"),
    )
    return rounded(rows, "acc_mean", "acc_std", "loss_mean", "loss_std", nudge=1e-9)


@query(
    "epoch_macro_mean",
    """SELECT run, epoch, split, position, round(avg(acc) + 1e-9, 6) AS acc, round(avg(loss) + 1e-9, 6) AS loss FROM (
         SELECT run, epoch, split, position, worker, avg(acc) AS acc, avg(loss) AS loss FROM z_metric GROUP BY ALL) GROUP BY ALL""",
)
def epoch_macro_mean(spark, sf_dir):
    return rounded(metrics.macro_mean(fx.metric_log(spark, sf_dir)), "acc", "loss", nudge=1e-9)


@query(
    "batches_ok",
    """SELECT run, count(*) FILTER (ok) AS successful_batches, count(*) AS total_batches, count(*) FILTER (ok) * 2 AS samples_seen
       FROM z_metric GROUP BY run""",
)
def batches_ok(spark, sf_dir):
    return metrics.batches_ok(fx.metric_log(spark, sf_dir), ["run"], 2)


@query(
    "running_mean",
    """SELECT run, batch, n, round(m + 1e-9, 6) AS mean_so_far FROM (
         SELECT run, batch, row_number() OVER w AS n, sum(CAST(round(loss * 100) AS BIGINT)) OVER w / row_number() OVER w / 100 AS m FROM z_metric WINDOW w AS (PARTITION BY run ORDER BY batch))
       WHERE n % 10 = 0""",
)
def running_mean(spark, sf_dir):
    # Whole cents, so that the sums are exact in any order.
    log = fx.metric_log(spark, sf_dir).withColumn("loss", F.round(F.col("loss") * 100).cast("bigint"))
    means = metrics.running_mean(log, "loss", "run", "batch", 10)
    return rounded(means.withColumn("mean_so_far", F.col("mean_so_far") / 100), "mean_so_far", nudge=1e-9)


# Draft sizes that are tried and their penalty weights.
DRAFT_SIZES = {40: 1.0, 48: 1.05, 50: 1.07, 56: 1.1, 60: 1.13}


@query(
    "best_config",
    """SELECT arg_min(config, cost) AS config, round(min(cost), 6) AS cost FROM (
         SELECT config, sum(value) / weight AS cost FROM (
           SELECT value, CAST([40, 48, 50, 56, 60][user_id % 5 + 1] AS BIGINT) AS config,
                  [1.0, 1.05, 1.07, 1.1, 1.13][user_id % 5 + 1]::DOUBLE AS weight FROM events) GROUP BY config, weight)""",
)
def best_config(spark, sf_dir):
    sizes = F.array(*[F.lit(s).cast("bigint") for s in DRAFT_SIZES])
    timed = fx.table(spark, sf_dir, "events").select(
        F.get(sizes, F.pmod("user_id", F.lit(5)).cast("int")).alias("config"), "value"
    )
    sums = timed.groupBy("config").agg(F.sum("value").alias("seconds"))
    return rounded(metrics.best_config(sums, DRAFT_SIZES), "cost")


# --- empirical against expected ------------------------------------------------


def _draws(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select(
        F.pmod("user_id", F.lit(15)).alias("position"), F.least(F.floor(F.col("value") / 4), F.lit(24)).alias("bin")
    )


def _pooled(draws):
    """The expected share of each bin is its share over all positions."""
    counts = draws.groupBy("bin").agg(F.count("*").alias("n"))
    pooled = counts.agg(
        F.sum("n").alias("_all"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_m")
    )
    bins = F.sequence(F.lit(0).cast("bigint"), F.lit(24).cast("bigint"))
    return pooled.select("_all", "_m", F.explode(bins).alias("bin")).select(
        "bin", (F.coalesce(F.try_element_at("_m", F.col("bin")), F.lit(0)) / F.col("_all")).alias("expected")
    )


@query(
    "hist_by_position",
    "SELECT position, bin, round(share, 6) AS share, round(coalesce(expected, 0), 6) AS expected FROM z_hist LEFT JOIN z_pool USING (bin)",
)
def hist_by_position(spark, sf_dir):
    draws = _draws(spark, sf_dir)
    return rounded(metrics.histogram(draws, 25).join(F.broadcast(_pooled(draws)), "bin"), "share", "expected")


@query(
    "hist_distance",
    "SELECT position, round(sum(abs(share - coalesce(expected, 0))) / 2, 6) AS distance FROM z_hist LEFT JOIN z_pool USING (bin) GROUP BY position",
)
def hist_distance(spark, sf_dir):
    draws = _draws(spark, sf_dir)
    return rounded(metrics.total_variation(metrics.histogram(draws, 25), _pooled(draws)), "distance")


# --- distributions -------------------------------------------------------------


def _scores(spark, sf_dir):
    """Score of a follower = log of its count, per context token."""
    return fx.all_pairs(spark, sf_dir).select(
        F.col("token").alias("context"), F.col("next").alias("token"), F.ln("c").alias("score"), "c"
    )


@query("dist_softmax", "SELECT token AS context, nxt AS token, round(c / total + 1e-9, 6) AS p, round(ln(c / total) + 1e-9, 6) AS log_p FROM z_mass")
def dist_softmax(spark, sf_dir):
    out = dist.softmax(_scores(spark, sf_dir), "context")
    return rounded(out.select("context", "token", "p", "log_p"), "p", "log_p", nudge=1e-9)


@query(
    "dist_temperature",
    """SELECT token AS context, nxt AS token, round(pow(c, 2.0) / sum(pow(c, 2.0)) OVER (PARTITION BY token) + 1e-9, 6) AS p FROM z_all""",
)
def dist_temperature(spark, sf_dir):
    warm = _scores(spark, sf_dir).transform(dist.temperature(0.5))
    return rounded(dist.softmax(warm, "context").select("context", "token", "p"), "p", nudge=1e-9)


@query(
    "dist_top_k",
    """SELECT context, token, round(c / sum(c) OVER (PARTITION BY context) + 1e-9, 6) AS p FROM (
         SELECT token AS context, nxt AS token, c, row_number() OVER (PARTITION BY token ORDER BY c DESC, nxt) AS r FROM z_all) WHERE r <= 10""",
)
def dist_top_k(spark, sf_dir):
    kept = _scores(spark, sf_dir).transform(dist.top_k(10, "context"))
    return rounded(dist.softmax(kept, "context").select("context", "token", "p"), "p", nudge=1e-9)


@query(
    "dist_top_p",
    """SELECT context, token, round(c / sum(c) OVER (PARTITION BY context) + 1e-9, 6) AS p FROM (
         SELECT token AS context, nxt AS token, c, total,
                sum(c) OVER (PARTITION BY token ORDER BY c DESC, nxt ROWS UNBOUNDED PRECEDING) - c AS before FROM z_mass)
       WHERE before < 0.9::DOUBLE * total""",
)
def dist_top_p(spark, sf_dir):
    pairs = fx.all_pairs(spark, sf_dir)
    totals = pairs.groupBy("token").agg(F.sum("c").alias("total"), F.count("*").alias("_n"))
    massed = lookup(pairs, totals, ["token"], ["token", "next"], weight="_n")
    kept = dist.top_p_mass(massed, "token", "next", "c", "total", 0.9)
    scored = kept.select(F.col("token").alias("context"), F.col("next").alias("token"), F.ln("c").alias("score"))
    return rounded(dist.softmax(scored, "context").select("context", "token", "p"), "p", nudge=1e-9)


@query(
    "dist_repetition_penalty",
    """SELECT a.token AS context, a.nxt AS token, round(CASE WHEN s.token IS NULL THEN ln(c) - 1 WHEN ln(c) - 1 < 0 THEN (ln(c) - 1) * 1.3
              ELSE (ln(c) - 1) / 1.3 END, 6) AS score
       FROM z_all a LEFT JOIN (SELECT DISTINCT token FROM z_tok WHERE speaker = 'human') s ON s.token = a.nxt""",
)
def dist_repetition_penalty(spark, sf_dir):
    """Tokens that users have written count as already seen."""
    asked = fx.normal(spark, sf_dir).filter("speaker = 'human'")
    seen = asked.select(F.explode(C.tokens_of("value")).alias("token")).distinct()
    scores = _scores(spark, sf_dir).withColumn("score", F.col("score") - 1)
    out = scores.transform(dist.repetition_penalty(1.3, seen, "context"))
    return rounded(out.select("context", "token", "score"), "score")


@query("dist_argmax", "SELECT token AS context, arg_min(nxt, (-c, nxt)) AS token, round(ln(max(c)), 6) AS score FROM z_all GROUP BY token")
def dist_argmax(spark, sf_dir):
    return rounded(dist.argmax(_scores(spark, sf_dir), "context"), "score")


# --- acceptance ----------------------------------------------------------------


def _lengths(spark, sf_dir):
    at = fx.candidates(spark, sf_dir)
    each = F.transform("drafts", lambda d: paths.accept_length(d, F.col("ahead")))
    return at.select("conv_id", "turn", "pos", each.alias("lengths"))


@query("accept_length", "SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, cand, CAST(length AS BIGINT) AS length FROM z_len")
def accept_length(spark, sf_dir):
    return _lengths(spark, sf_dir).select("conv_id", "turn", "pos", F.posexplode("lengths").alias("cand", "length")).withColumn(
        "cand", F.col("cand").cast("bigint")
    )


@query(
    "best_candidate",
    """SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, arg_min(cand, (-length, cand)) AS cand, CAST(max(length) AS BIGINT) AS length
       FROM z_len GROUP BY conv_id, turn, pos""",
)
def best_candidate(spark, sf_dir):
    return _lengths(spark, sf_dir).select("conv_id", "turn", "pos", paths.best_candidate("lengths").alias("b")).select(
        "conv_id", "turn", "pos", "b.cand", "b.length"
    )


# --- paths ---------------------------------------------------------------------


def _text(*names):
    return lambda df: df.withColumns({n: F.array_join(F.col(n).cast("array<string>"), " ") for n in names})


def _chosen(spark, sf_dir):
    nodes = fx.path_nodes(spark, sf_dir, best=BEAM_BEST).drop("tokens", "rank", "kept")
    return written(paths.rerank_top_n(nodes, BEAM_BEST), "chosen-nodes")


@query(
    "path_expand_topk",
    f"""SELECT root, CAST(depth AS BIGINT) AS depth, CAST(rank AS BIGINT) AS rank, array_to_string(ranks, ' ') AS ranks,
              array_to_string(tokens, ' ') AS tokens, round(score, 6) AS score FROM z_nodes WHERE rank < {BEAM_WIDTH}""",
)
def path_expand_topk(spark, sf_dir):
    live = fx.path_nodes(spark, sf_dir, scored=False).select("root", "depth", "rank", "ranks", "tokens", "score")
    return rounded(live.transform(_text("ranks", "tokens")), "score")


@query(
    "path_level_sizes",
    """SELECT d AS depth, count(*) AS scored, count(*) FILTER (rank < """
    + str(BEAM_WIDTH)
    + ") AS kept FROM (SELECT CAST(depth AS BIGINT) AS d, rank FROM z_nodes) GROUP BY d",
)
def path_level_sizes(spark, sf_dir):
    """Rows of each step of the beam."""
    nodes = fx.path_nodes(spark, sf_dir)
    return nodes.groupBy("depth").agg(F.count("*").alias("scored"), F.count_if("kept").alias("kept"))


@query(
    "path_rerank_topn",
    "SELECT root, CAST(node AS BIGINT) AS node, array_to_string(ranks, ' ') AS ranks, round(score, 6) AS score FROM z_tree",
)
def path_rerank_topn(spark, sf_dir):
    kept = _chosen(spark, sf_dir).select("root", "node", "ranks", "score")
    return rounded(kept.transform(_text("ranks")), "score")


@query(
    "path_distinct_prefixes",
    "SELECT root, array_to_string(prefix, ' ') AS prefix, CAST(depth AS BIGINT) AS depth FROM z_prefix",
)
def path_distinct_prefixes(spark, sf_dir):
    return paths.distinct_prefixes(_chosen(spark, sf_dir)).transform(_text("prefix"))


@query(
    "path_prefix_tree",
    """SELECT a.root, array_to_string(a.prefix, ' ') AS prefix, CAST(a.depth AS BIGINT) AS depth, a.node, coalesce(b.node, 0) AS parent
       FROM z_num a LEFT JOIN z_num b ON b.root = a.root AND b.prefix = a.prefix[:len(a.prefix) - 1] AND a.depth > 1""",
)
def path_prefix_tree(spark, sf_dir):
    return paths.prefix_tree(_chosen(spark, sf_dir)).transform(_text("prefix"))
