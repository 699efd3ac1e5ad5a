"""Queries on tokens, training sequences, the draft vocabulary, shards and features."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from turnwise.functions.columns import tokens_of
from turnwise.operators import features, sharding, tokens, vocab
from turnwise.plans import fixtures as fx
from turnwise.plans.registry import query
from turnwise.session import scratch_path, ship
from turnwise.sources import readers

# --- tokens and sequences ------------------------------------------------------


@query("tok_tokenize", "SELECT conv_id, j, speaker, CAST(pos AS BIGINT) AS pos, token FROM z_tok")
def tok_tokenize(spark, sf_dir):
    return tokens.tokenize(fx.normal(spark, sf_dir))


@query("join_token_ids", "SELECT conv_id, j, CAST(pos AS BIGINT) AS pos, token_id FROM z_tok JOIN z_ids USING (token)")
def join_token_ids(spark, sf_dir):
    rows = tokens.tokenize(fx.normal(spark, sf_dir))
    ids = tokens.encode(rows, fx.vocabulary(spark, sf_dir), ("conv_id", "j", "pos"))
    return ids.select("conv_id", "j", "pos", "token_id")


@query("tok_truncate", "SELECT conv_id, p AS pos, token FROM z_seq WHERE p < 256")
def tok_truncate(spark, sf_dir):
    rows = tokens.truncated(tokens.sequence_tokens(fx.normal(spark, sf_dir), 256))
    return rows.select("conv_id", "pos", "token")


@query("tok_loss_mask", 'SELECT conv_id, "window", p AS pos, token_id, loss_mask FROM z_ids_seq')
def tok_loss_mask(spark, sf_dir):
    rows = tokens.sequence_tokens(fx.normal(spark, sf_dir))
    ids = tokens.encode(rows, fx.vocabulary(spark, sf_dir), ("conv_id", "window", "pos"))
    return ids.select("conv_id", "window", "pos", "token_id", "loss_mask")


@query("tok_attention_mask", 'SELECT conv_id, "window", p AS pos, CAST(1 AS BIGINT) AS attention_mask FROM z_ids_seq')
def tok_attention_mask(spark, sf_dir):
    return tokens.long_sequences(fx.sequences(spark, sf_dir), "attention_mask")


@query(
    "tok_shift_next",
    """SELECT conv_id, "window", p AS pos, token_id AS input_ids,
              coalesce(lead(token_id) OVER (PARTITION BY conv_id, "window" ORDER BY p), 0) AS target FROM z_ids_seq""",
)
def tok_shift_next(spark, sf_dir):
    return tokens.long_sequences(tokens.with_targets(fx.sequences(spark, sf_dir)), "input_ids", "target")


@query(
    "tok_mask_last",
    'SELECT conv_id, "window", p AS pos, CASE WHEN p = n - 1 THEN 0 ELSE loss_mask END AS loss_mask FROM z_ids_seq',
)
def tok_mask_last(spark, sf_dir):
    return tokens.long_sequences(tokens.mask_last(fx.sequences(spark, sf_dir)), "loss_mask")


@query(
    "batch_pad",
    """WITH one AS (SELECT DISTINCT conv_id, "window", n FROM z_ids_seq),
            b AS (SELECT *, (row_number() OVER (ORDER BY conv_id, "window") - 1) // 4 AS batch_id FROM one),
            w AS (SELECT batch_id, max(n) AS w FROM b GROUP BY batch_id),
            g AS (SELECT batch_id, conv_id, "window", unnest(range(0, w)) AS p FROM b JOIN w USING (batch_id))
       SELECT batch_id, conv_id, "window", p AS pos, coalesce(token_id, 0) AS input_ids, coalesce(loss_mask, 0) AS loss_mask,
              CAST(token_id IS NOT NULL AS BIGINT) AS attention_mask
       FROM g LEFT JOIN z_ids_seq USING (conv_id, "window", p)""",
)
def batch_pad(spark, sf_dir):
    padded_ = tokens.pad_batches(fx.sequences(spark, sf_dir), ["conv_id", "window"], 4)
    return tokens.long_sequences(padded_, "input_ids", "loss_mask", "attention_mask")


BUCKETED = """WITH one AS (SELECT DISTINCT conv_id, "window", n FROM z_ids_seq),
    h AS (SELECT n, count(*) AS c FROM one GROUP BY n),
    l AS (SELECT n, coalesce(sum(c) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 16 // sum(c) OVER () AS bucket FROM h),
    b AS (SELECT conv_id, "window", n, bucket::BIGINT AS bucket,
            (row_number() OVER (ORDER BY bucket, md5(conv_id || ':' || "window" || ':42:0'), conv_id, "window") - 1) // 4 AS batch_id
          FROM one JOIN l USING (n))"""


@query("batch_bucketed", f'{BUCKETED} SELECT conv_id, "window", n AS size, bucket, batch_id FROM b')
def batch_bucketed(spark, sf_dir):
    return tokens.bucketed_batches(fx.sequences(spark, sf_dir), ["conv_id", "window"], 4)


@query(
    "batch_padding",
    BUCKETED
    + """, c AS (SELECT conv_id, n, (row_number() OVER (ORDER BY conv_id, "window") - 1) // 4 AS batch_id FROM one),
    r AS (SELECT 'bucketed' AS dealt, batch_id, n FROM b UNION ALL SELECT 'consecutive', batch_id, n FROM c),
    g AS (SELECT dealt, batch_id, count(*) AS k, sum(n) AS t, max(n) AS m FROM r GROUP BY ALL)
    SELECT dealt, sum(k)::BIGINT AS sequences, sum(t)::BIGINT AS tokens, sum(k * m - t)::BIGINT AS padding,
           round(sum(k * m - t) / sum(k * m), 6) AS share FROM g GROUP BY dealt""",
)
def batch_padding(spark, sf_dir):
    """What the rectangular batches of both kinds would waste."""
    seqs = fx.sequences(spark, sf_dir)
    order = ["conv_id", "window"]
    bucketed = tokens.bucketed_batches(seqs, order, 4)
    consecutive = sharding.batch_ranges(seqs.select(*order, F.size("input_ids").alias("size")), order, 4)
    shares = [
        tokens.padding_share(b).select(F.lit(name).alias("dealt"), "sequences", "tokens", "padding", F.round("share", 6).alias("share"))
        for name, b in (("bucketed", bucketed), ("consecutive", consecutive))
    ]
    return shares[0].unionByName(shares[1])


@query("tok_subword_mask")
def tok_subword_mask(spark, sf_dir):
    """Ids of an installed vocabulary with masks by character offsets."""
    import public_tokenizers

    ship(spark)
    found = tokens.subword_tokens(fx.normal(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    zipped = F.arrays_zip("ids", "starts", "stops", "masks")
    return found.select("conv_id", "j", F.posexplode(zipped).alias("pos", "t")).select(
        "conv_id", "j", F.col("pos").cast("bigint").alias("pos"), F.col("t.ids").alias("token_id"),
        F.col("t.starts").alias("start"), F.col("t.stops").alias("stop"), F.col("t.masks").alias("loss_mask"),
    )


# --- vocabulary ----------------------------------------------------------------


@query("vocab_freq", "SELECT token, n_target AS freq FROM z_count WHERE n_target > 0")
def vocab_freq(spark, sf_dir):
    return vocab.target_frequency(fx.counts(spark, sf_dir))


@query(
    "vocab_freq_partial_final",
    "SELECT token, sum(c)::BIGINT AS freq FROM (SELECT conv_id, token, count(*) AS c FROM z_tok "
    "WHERE speaker = 'gpt' GROUP BY conv_id, token) GROUP BY token",
)
def vocab_freq_partial_final(spark, sf_dir):
    """Counters per message are counted where the text is read, then merged."""
    said = fx.normal(spark, sf_dir).filter("speaker = 'gpt'")
    at = said.select(F.explode(tokens_of("value")).alias("token"))
    return at.groupBy("token").agg(F.count("*").alias("freq"))


@query("vocab_top_n", "SELECT token, n_target AS freq FROM z_top")
def vocab_top_n(spark, sf_dir):
    return fx.draft_top(spark, sf_dir)


@query("vocab_map", 'SELECT draft_id, token, token_id, n_target AS freq, token_id - draft_id AS "offset" FROM z_map')
def vocab_map(spark, sf_dir):
    return fx.draft_map(spark, sf_dir)[1]


@query(
    "vocab_coverage",
    """SELECT covered, total, round(covered / total, 6) AS coverage FROM (
         SELECT (SELECT sum(n_target)::BIGINT FROM z_top) AS covered, (SELECT sum(n_target)::BIGINT FROM z_ids) AS total)""",
)
def vocab_coverage(spark, sf_dir):
    freq = vocab.target_frequency(fx.counts(spark, sf_dir))
    return vocab.coverage(freq, vocab.top_n(freq, fx.DRAFT_SIZE)).withColumn("coverage", F.round("coverage", 6))


@query("vocab_membership", "SELECT token_id, token IN (SELECT token FROM z_top) AS in_draft FROM z_ids")
def vocab_membership(spark, sf_dir):
    full, mapping = fx.draft_map(spark, sf_dir)
    return vocab.membership(full, mapping)


def _targets(spark, sf_dir):
    return tokens.tokenize(fx.normal(spark, sf_dir)).filter(tokens.is_target())


@query(
    "vocab_semi_filter",
    "SELECT conv_id, j, CAST(pos AS BIGINT) AS pos, token FROM z_tok WHERE speaker = 'gpt' AND token IN (SELECT token FROM z_top)",
)
def vocab_semi_filter(spark, sf_dir):
    kept = vocab.keep_known(_targets(spark, sf_dir), fx.draft_top(spark, sf_dir))
    return kept.select("conv_id", "j", "pos", "token")


@query(
    "vocab_oov",
    "SELECT token, count(*) AS n FROM z_tok WHERE speaker = 'gpt' AND token NOT IN (SELECT token FROM z_top) GROUP BY token",
)
def vocab_oov(spark, sf_dir):
    out = vocab.drop_known(_targets(spark, sf_dir), fx.draft_top(spark, sf_dir))
    return out.groupBy("token").agg(F.count("*").alias("n"))


def _target_ids(spark, sf_dir, full):
    return tokens.encode(_targets(spark, sf_dir), full, ("conv_id", "j", "pos")).select("conv_id", "j", "pos", "token_id")


@query(
    "vocab_encode",
    "SELECT conv_id, j, CAST(pos AS BIGINT) AS pos, draft_id FROM z_tok JOIN z_map USING (token) WHERE speaker = 'gpt'",
)
def vocab_encode(spark, sf_dir):
    full, mapping = fx.draft_map(spark, sf_dir)
    ids = _target_ids(spark, sf_dir, full)
    return vocab.encode_draft(ids, mapping).select("conv_id", "j", "pos", "draft_id")


@query(
    "vocab_decode",
    "SELECT conv_id, j, CAST(pos AS BIGINT) AS pos, draft_id, token_id FROM z_tok JOIN z_map USING (token) WHERE speaker = 'gpt'",
)
def vocab_decode(spark, sf_dir):
    full, mapping = fx.draft_map(spark, sf_dir)
    drafts = vocab.encode_draft(_target_ids(spark, sf_dir, full), mapping).drop("token_id")
    return vocab.decode_draft(drafts, mapping)


@query("sink_vocab_table", 'SELECT draft_id, token, token_id, n_target AS freq, token_id - draft_id AS "offset" FROM z_map')
def sink_vocab_table(spark, sf_dir):
    full = fx.vocabulary(spark, sf_dir)
    folder = scratch_path(spark, "vocabularies")

    def build():
        return vocab.draft_map(vocab.top_n(vocab.target_frequency(full), fx.DRAFT_SIZE), full)

    vocab.saved_table(full, build, fx.DRAFT_SIZE, folder)
    return vocab.saved_table(full, build, fx.DRAFT_SIZE, folder)


# --- shuffles, splits, shards, batches -----------------------------------------

IDX = "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS n FROM documents"


def _ids(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id")


@query(
    "shuffle_seeded",
    "SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) - 1 AS position FROM documents",
)
def shuffle_seeded(spark, sf_dir):
    return sharding.shuffle_seeded(_ids(spark, sf_dir), "doc_id")


def _epoch_sql(epoch: int) -> str:
    # The pairing key of a round is drawn modulo n, which SQL knows only when it runs.
    digests = [hashlib.sha256(f"42:{epoch}:{i}".encode()).digest() for i in range(200)]
    keys = ", ".join(
        f"({i}, {int.from_bytes(d[:8], 'big')}::HUGEINT, {1 + int.from_bytes(d[8:16], 'big') % (2**31 - 2)}::BIGINT, "
        f"{int.from_bytes(d[16:24], 'big') % (2**31 - 1)}::BIGINT, {int.from_bytes(d[24:], 'big') % (2**31 - 1)}::BIGINT)"
        for i, d in enumerate(digests)
    )
    m = "((greatest(x, y) % 2147483647 * a + b) % 2147483647 + (greatest(x, y) // 2147483647) * 65537 + c) % 2147483647"
    return f"""SELECT doc_id, {epoch} AS epoch, x AS position FROM (
        WITH RECURSIVE r(i, k, a, b, c) AS (VALUES {keys}), s(doc_id, n, i, x) AS (
            SELECT doc_id, n, 0, position FROM ({IDX})
            UNION ALL
            SELECT doc_id, n, i + 1, CASE WHEN ((m * m % 2147483647) >> 15) & 1 = 1 THEN y ELSE x END FROM (
              SELECT *, {m} AS m FROM (
                SELECT s.doc_id, s.n, s.i, s.x, (((r.k % s.n) - s.x + s.n) % s.n)::BIGINT AS y, r.a, r.b, r.c FROM s JOIN r USING (i)
                WHERE s.i < greatest(24, 4 * ceil(log2(s.n + 1))))))
        SELECT doc_id, x FROM s WHERE i = greatest(24, 4 * ceil(log2(n + 1))))"""


@query("epoch_reshuffle", " UNION ALL ".join(_epoch_sql(e) for e in range(2)))
def epoch_reshuffle(spark, sf_dir):
    return sharding.epochs(_ids(spark, sf_dir), ["doc_id"], 2)


@query(
    "split_95_5",
    """SELECT doc_id, CASE WHEN ('0x' || substr(md5(doc_id || ':42'), 1, 8))::BIGINT % 100 < 95 THEN 'train' ELSE 'test' END AS split_by_key,
              CASE WHEN position < n * 95 // 100 THEN 'train' ELSE 'test' END AS split_by_position FROM (""" + IDX + ")",
)
def split_95_5(spark, sf_dir):
    at = sharding.split_by_position(_ids(spark, sf_dir), ["doc_id"]).withColumnRenamed("split", "split_by_position")
    return sharding.split_by_hash(at, "doc_id").select(
        "doc_id", F.col("split").alias("split_by_key"), "split_by_position"
    )


@query("limit_samples", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def limit_samples(spark, sf_dir):
    return sharding.first_samples(_ids(spark, sf_dir), ["doc_id"], 100)


@query("shard_contiguous", f"SELECT doc_id, position, position // (n // 48) AS shard FROM ({IDX})")
def shard_contiguous(spark, sf_dir):
    return sharding.shard_contiguous(_ids(spark, sf_dir), ["doc_id"], 48)


@query("shard_ceil", f"SELECT doc_id, position, position // CAST(ceil(n / 48) AS BIGINT) AS shard FROM ({IDX})")
def shard_ceil(spark, sf_dir):
    return sharding.shard_ceil(_ids(spark, sf_dir), ["doc_id"], 48)


@query(
    "shard_strided",
    f"""SELECT doc_id, position, position % 48 AS shard FROM ({IDX})
        UNION ALL SELECT doc_id, position + n, (position + n) % 48 FROM ({IDX}) WHERE position < (48 - n % 48) % 48""",
)
def shard_strided(spark, sf_dir):
    return sharding.shard_strided(_ids(spark, sf_dir), ["doc_id"], 48, even=True)


@query("batch_ranges", f"SELECT doc_id, position, position // 32 AS batch_id FROM ({IDX})")
def batch_ranges(spark, sf_dir):
    return sharding.batch_ranges(_ids(spark, sf_dir), ["doc_id"], 32)


# --- features ------------------------------------------------------------------

EMB = "SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"


@query("src_features", f"SELECT vec_id, CAST(pos AS BIGINT) AS pos, round(x, 5) AS x, pos AS input_id, CAST(pos % 2 AS BIGINT) AS mask FROM ({EMB})")
def src_features(spark, sf_dir):
    path = scratch_path(spark, "features")
    ids = F.sequence(F.lit(0), F.size("embedding") - 1)
    rows = fx.table(spark, sf_dir, "embeddings").select(
        F.transform("embedding", lambda x: F.array(x, F.col("vec_id").cast("float"))).alias("hidden_state"),
        ids.alias("input_ids"),
        F.transform(ids, lambda i: F.pmod(i, F.lit(2))).alias("loss_mask"),
        F.pmod("vec_id", F.lit(4)).alias("part"),
        F.pmod("vec_id", F.lit(3)).alias("sub"),
    )
    rows.write.partitionBy("part", "sub").parquet(path)
    back = readers.read_features(spark, path)
    at = back.select(F.posexplode(F.arrays_zip("hidden_state", "input_ids", "loss_mask")).alias("pos", "e"))
    return at.select(
        F.get("e.hidden_state", F.lit(1)).cast("bigint").alias("vec_id"),
        F.col("pos").cast("bigint").alias("pos"),
        F.round(F.get("e.hidden_state", F.lit(0)).cast("double"), 5).alias("x"),
        F.col("e.input_ids").cast("bigint").alias("input_id"),
        F.col("e.loss_mask").cast("bigint").alias("mask"),
    )


STATES = f"SELECT vec_id, pos // 8 AS p, pos % 8 AS d, x FROM ({EMB})"


def _records(spark, sf_dir):
    """Feature records of eight positions and eight dimensions, written and read back."""
    path = scratch_path(spark, "records")
    at = F.sequence(F.lit(0), F.lit(7))
    fx.table(spark, sf_dir, "embeddings").select(
        F.transform(at, lambda i: F.slice("embedding", i * 8 + 1, 8)).alias("hidden_state"),
        F.transform(at, lambda i: F.col("vec_id").cast("int")).alias("input_ids"),
        F.transform(at, lambda i: F.lit(1)).alias("loss_mask"),
    ).write.parquet(path)
    back = readers.read_features(spark, path)
    return back.withColumn("vec_id", F.get("input_ids", F.lit(0)).cast("bigint"))


@query(
    "feat_concat_layers",
    f"""WITH e AS ({STATES}) SELECT vec_id, CAST(p AS BIGINT) AS pos, CAST(d + 8 * layer AS BIGINT) AS dim,
               round(CASE layer WHEN 0 THEN x WHEN 1 THEN x * 2 ELSE -x END, 5) AS x
        FROM (SELECT *, unnest([0, 1, 2]) AS layer FROM e)""",
)
def feat_concat_layers(spark, sf_dir):
    early = F.col("hidden_state").cast("array<array<double>>")
    rows = _records(spark, sf_dir).select("vec_id", early.alias("early"))
    rows = rows.withColumns(
        {
            "middle": F.transform("early", lambda v: F.transform(v, lambda x: x * 2)),
            "late": F.transform("early", lambda v: F.transform(v, lambda x: -x)),
        }
    )
    layers = rows.withColumn("all", features.concat_layers("early", "middle", "late"))
    return features.long_states(layers, "vec_id", "all").withColumn("x", F.round("x", 5))


@query(
    "feat_noise_uniform",
    f"""SELECT vec_id, CAST(p AS BIGINT) AS pos, CAST(d AS BIGINT) AS dim, round(x + CASE WHEN ('0x' || substr(md5(vec_id || ':42'), 1, 8))::BIGINT % 100 < 95
          THEN (('0x' || substr(md5(vec_id || ':' || p || ':' || d || ':42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE - 0.5) * 0.2 * 512 / 8 ELSE 0 END, 5) AS x
        FROM ({STATES})""",
)
def feat_noise_uniform(spark, sf_dir):
    rows = _records(spark, sf_dir)
    noisy = features.noise_uniform(rows, "hidden_state", "vec_id", train=sharding.in_train("vec_id"))
    return features.long_states(noisy, "vec_id", "hidden_state").withColumn("x", F.round("x", 5))


@query(
    "feat_noise_gaussian",
    f"""SELECT vec_id, CAST(p AS BIGINT) AS pos, CAST(d AS BIGINT) AS dim, round(x + 0.2 * sqrt(-2 * ln(greatest(
            ('0x' || substr(md5(vec_id || ':' || p || ':' || d || ':42:r'), 1, 8))::BIGINT / 4294967296.0::DOUBLE, 1e-12)))
          * cos(2 * pi() * (('0x' || substr(md5(vec_id || ':' || p || ':' || d || ':42:a'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)), 5) AS x
        FROM ({STATES})""",
)
def feat_noise_gaussian(spark, sf_dir):
    noisy = features.noise_gaussian(_records(spark, sf_dir), "hidden_state", "vec_id")
    return features.long_states(noisy, "vec_id", "hidden_state").withColumn("x", F.round("x", 5))
