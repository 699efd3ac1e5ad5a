"""Tokens, masks and training sequences.

A token is a run of characters without blanks or line breaks. Another tokenizer
can be plugged in with ``tokenize_with``, which adds a column of tokens; all functions
here take the name of such a column as ``tokens``. Positions inside a conversation come
from message offsets, computed on one narrow row per message.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnwise.functions.columns import shifted_left, tokens_of
from turnwise.operators.chat import CLOSE, OPEN, ROLE_OF_SPEAKER
from turnwise.operators.scale import dense_index, lookup, running_sums
from turnwise.session import written

MAX_LEN = 2048
#: Bytes of text that a subword tokenizer gets at once; what it finds takes some hundred times as much.
PORTION = 256_000


def _tokens(column: str | None) -> Column:
    return tokens_of("value") if column is None else F.col(column)


def tokenize(messages: DataFrame, tokens: str | None = None) -> DataFrame:
    """(conv_id, j, speaker, value) -> (conv_id, j, speaker, pos, token)."""
    return messages.select(
        "conv_id", "j", "speaker", F.posexplode(_tokens(tokens)).alias("pos", "token")
    ).withColumn("pos", F.col("pos").cast("bigint"))


def tokenize_with(
    messages: DataFrame,
    encode: Callable[[list[str]], list[list]],
    name: str = "tokens",
    kind: str = "array<string>",
) -> DataFrame:
    """``messages`` and a column of tokens by a tokenizer of your own.

    ``encode`` maps a list of texts to lists of tokens, or of ids with another ``kind``.
    All columns are kept, of whatever type; null texts are passed on as empty ones.
    """
    added = StructType.fromDDL(f"`{name}` {kind}")
    shape = StructType([*messages.schema.fields, *added.fields])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = encode([text or "" for text in batch.column("value").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, name])

    return messages.mapInArrow(run, shape)


def is_target(speaker="speaker", j="j", pos="pos") -> Column:
    """Assistant content, except that a sequence never starts with a target."""
    return (F.col(speaker) == "gpt") & ~((F.col(j) == 0) & (F.col(pos) == 0))


def token_counts(messages: DataFrame, tokens: str | None = None) -> DataFrame:
    """How often each token occurs, over all and as a training target."""
    return tokenize(messages, tokens).groupBy("token").agg(
        F.count("*").alias("n_all"), F.count_if(is_target()).alias("n_target")
    )


def vocabulary(counts: DataFrame) -> DataFrame:
    """token_id = rank of the token in byte order."""
    return dense_index(counts, ["token"], "token_id")


def encode(tokens: DataFrame, vocab: DataFrame, spread=("conv_id", "pos")) -> DataFrame:
    return lookup(
        tokens, vocab.select("token", "token_id", "n_all"), ["token"], list(spread), weight="n_all"
    )


def with_offsets(messages: DataFrame, tokens: str | None = None) -> DataFrame:
    """Add the token array of each message and its offset in the conversation.

    Only the lengths are summed up; the offsets then meet the messages by their key.
    """
    cut = messages.select("conv_id", "j", "speaker", _tokens(tokens).alias("tokens"))
    sizes = cut.select("conv_id", "j", F.size("tokens").cast("bigint").alias("_size"))
    offsets = running_sums(sizes, ["conv_id"], ["j"], {"offset": F.col("_size")}).drop("_size")
    return cut.join(offsets, ["conv_id", "j"])


def sequence_tokens(messages: DataFrame, max_len: int = MAX_LEN, tokens: str | None = None) -> DataFrame:
    """(conv_id, window, pos, token, loss_mask): a conversation as windows of ``max_len`` tokens.

    No token is lost; ``pos`` counts inside the window, whose first token is no target.
    """
    rows = with_offsets(messages, tokens).select(
        "conv_id", "speaker", "offset", F.posexplode("tokens").alias("i", "token")
    )
    at = F.col("offset") + F.col("i")
    pos = F.pmod(at, F.lit(max_len))
    return rows.select(
        "conv_id",
        F.floor(at / max_len).cast("bigint").alias("window"),
        pos.alias("pos"),
        "token",
        F.when((F.col("speaker") == "gpt") & (pos > 0), 1).otherwise(0).cast("bigint").alias("loss_mask"),
    )


def truncated(rows: DataFrame) -> DataFrame:
    """The first window of each conversation alone."""
    return rows.filter("window = 0").drop("window")


def sequences(
    messages: DataFrame, vocab: DataFrame, max_len: int = MAX_LEN, tokens: str | None = None
) -> DataFrame:
    """One row per window of a conversation: input_ids, loss_mask, attention_mask.

    A row holds at most ``max_len`` tokens, however long the conversation is.
    """
    rows = encode(sequence_tokens(messages, max_len, tokens), vocab, ("conv_id", "window", "pos"))
    packed = rows.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("pos", "token_id", "loss_mask"))).alias("s")
    )
    return packed.select(
        "conv_id",
        "window",
        F.col("s.token_id").alias("input_ids"),
        F.col("s.loss_mask").alias("loss_mask"),
    ).withColumn("attention_mask", F.array_repeat(F.lit(1).cast("bigint"), F.size("input_ids")))


def with_targets(seqs: DataFrame, k: int = 1) -> DataFrame:
    """target = the ids moved ``k`` places to the left, zeros at the end."""
    return seqs.withColumn("target", shifted_left("input_ids", k, 0).cast("array<bigint>"))


def mask_last(seqs: DataFrame) -> DataFrame:
    n = F.size("loss_mask")
    return seqs.withColumn(
        "loss_mask", F.transform("loss_mask", lambda m, i: F.when(i == n - 1, 0).otherwise(m))
    )


def long_sequences(seqs: DataFrame, *arrays: str) -> DataFrame:
    """One row per position, for sequences held as parallel arrays."""
    zipped = F.arrays_zip(*arrays)
    at = seqs.select(
        *[c for c in seqs.columns if c not in ("input_ids", "loss_mask", "attention_mask", "target")],
        F.posexplode(zipped).alias("pos", "e"),
    )
    rest = [c for c in at.columns if c not in ("pos", "e")]
    return at.select(
        *rest, F.col("pos").cast("bigint").alias("pos"), *[F.col(f"e.{a}").alias(a) for a in arrays]
    )


def pad_batches(
    seqs: DataFrame, order: list[str], batch_size: int, features: str | None = None, batches: DataFrame | None = None
) -> DataFrame:
    """Consecutive sequences form a batch; all are zero-padded to the batch's longest.

    ``batches`` (order, batch_id), such as ``bucketed_batches``, deals them out in another way.

    ``order`` names a row. The sequences are stored once and numbered by their narrow
    keys. ``features`` names an array of vectors, one per position, that is padded with
    zero vectors.
    """
    seqs = written(seqs, "sequences")
    if batches is None:
        numbered = dense_index(seqs.select(*order), order, "row")
        batches = numbered.withColumn("batch_id", F.floor(F.col("row") / batch_size).cast("bigint"))
    keyed = seqs.join(batches.select(*order, "batch_id"), order)
    longest = F.max(F.size("input_ids")).over(Window.partitionBy("batch_id"))
    out = keyed.withColumn("_longest", longest)
    for name in [c for c in ("input_ids", "loss_mask", "attention_mask") if c in seqs.columns]:
        zero = F.lit(0).cast(seqs.schema[name].dataType.elementType)
        out = out.withColumn(name, F.concat(name, F.array_repeat(zero, F.col("_longest") - F.size(name))))
    if features:
        blank = F.transform(F.get(features, F.lit(0)), lambda x: x * 0)
        out = out.withColumn(
            features, F.concat(features, F.array_repeat(blank, F.col("_longest") - F.size(features)))
        )
    return out.drop("_longest")


def length_buckets(sizes: DataFrame, buckets: int, size: str = "size") -> DataFrame:
    """(size, bucket): lengths cut into ``buckets`` ranges with about equally many sequences each.

    The summary is the count of every length, which merges exactly across tasks and has at most
    one row per length up to the window size. A length lies in one bucket as a whole.
    """
    counted = sizes.groupBy(F.col(size).alias("size")).agg(F.count("*").alias("n"))
    order = Window.orderBy("size")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy())
    return counted.select("size", F.floor(before * buckets / total).cast("bigint").alias("bucket"))


def bucketed_batches(
    seqs: DataFrame, order: list[str], batch_size: int, buckets: int = 16, seed: int = 42, epoch: int = 0
) -> DataFrame:
    """``order``, size, bucket, batch_id: batches of sequences of similar length.

    Inside a bucket the order is drawn by seed and epoch; each sequence is in one batch. The
    result holds keys and lengths only, ``pad_batches`` takes it as ``batches``.
    """
    sizes = written(seqs.select(*order, F.size("input_ids").alias("size")), "sequence-sizes")
    drawn = sizes.join(F.broadcast(length_buckets(sizes, buckets)), "size").withColumn(
        "_drawn", F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in order], F.lit(seed), F.lit(epoch)))
    )
    at = dense_index(drawn, ["bucket", "_drawn", *order], "_row")
    return at.select(*order, "size", "bucket", F.floor(F.col("_row") / batch_size).cast("bigint").alias("batch_id"))


def padding_share(batches: DataFrame) -> DataFrame:
    """(sequences, tokens, padding, share) of a table with ``batch_id`` and ``size``: how much of
    the rectangular batches would be padding."""
    per = batches.groupBy("batch_id").agg(F.count("*").alias("k"), F.sum("size").alias("t"), F.max("size").alias("m"))
    sums = per.agg(F.sum("k").alias("sequences"), F.sum("t").alias("tokens"), F.sum(F.col("k") * F.col("m")).alias("cells"))
    return sums.select(
        "sequences",
        "tokens",
        (F.col("cells") - F.col("tokens")).alias("padding"),
        F.try_divide(F.col("cells") - F.col("tokens"), F.col("cells")).alias("share"),
    )


def target_spans(offsets: list[tuple[int, int]], begin: int, end: int) -> list[int]:
    """1 for each token that lies within ``[begin, end)`` as a whole and is not empty, else 0."""
    return [int(begin <= a < b <= end) for a, b in offsets]


def text_portions(batch, column: str = "value", most: int = PORTION):
    """Slices of an Arrow batch with less than ``most`` bytes of text each, and one text more."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    # Rows without text count as well: their markers are encoded, too.
    portion = np.cumsum(sizes.astype(np.int64) + 64) // most
    cuts = [0, *(np.flatnonzero(np.diff(portion)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            yield batch.slice(a, b - a)


def subword_tokens(messages: DataFrame, vocabulary: str) -> DataFrame:
    """Rendered messages as ids of a tokenizer file, with places and loss masks.

    ``messages`` (conv_id, j, speaker, value) gains ``header`` (its characters before the
    content), ``ids``, ``starts``, ``stops`` (code points of the rendered message) and ``masks``.
    A message is encoded as it is rendered, markers included, one by one, so a long
    conversation is many rows. A token is a target if all of it is assistant content: one
    that reaches over the border to a marker is masked. The file is read where tasks run.
    A task holds what was found in one portion of texts.
    """
    added = StructType.fromDDL("ids array<int>, starts array<int>, stops array<int>, masks array<int>, header int")
    shape = StructType([*messages.schema.fields, *added.fields])

    def run(batches):
        import pyarrow as pa
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        for batch in (part for whole in batches for part in text_portions(whole)):
            who, texts = batch.column("speaker").to_pylist(), [t or "" for t in batch.column("value").to_pylist()]
            heads = [f"{OPEN}{ROLE_OF_SPEAKER.get(w, w)}\n" for w in who]
            found = tokenizer.encode_batch(
                [h + t + CLOSE for h, t in zip(heads, texts, strict=True)], add_special_tokens=False
            )
            masks = [
                target_spans(f.offsets, len(h), len(h) + len(t)) if w == "gpt" else [0] * len(f.ids)
                for w, h, t, f in zip(who, heads, texts, found, strict=True)
            ]
            kind = pa.list_(pa.int32())
            columns = [
                pa.array([f.ids for f in found], kind),
                pa.array([[a for a, _ in f.offsets] for f in found], kind),
                pa.array([[b for _, b in f.offsets] for f in found], kind),
                pa.array(masks, kind),
                pa.array([len(h) for h in heads], pa.int32()),
            ]
            names = [*batch.schema.names, "ids", "starts", "stops", "masks", "header"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names)

    return messages.mapInArrow(run, shape)
