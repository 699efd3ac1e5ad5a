"""Document fingerprints by one-permutation MinHash, in Spark's own functions.

Every five-word shingle of a text is hashed once. The hash's upper bits name its bin, the
least hash of a bin is its value. An empty bin takes the value of the full bin that comes
first in an order drawn for that bin, the same for every text (optimal densification). Of each value the
lowest 8 bits are kept; likeness corrects the share of equal bytes for chance matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import text_or_empty
from turnwise.operators.scale import dense_index
from turnwise.session import written

BINS, BITS, SHINGLE = 128, 8, 5
_BIN_SHIFT = 64 - 7  # the upper 7 bits, signed: -64 to 63
_FIRST_BIN = -BINS // 2
#: The bins that an empty bin b asks first: b * step + start.
_ASKED = [(2 * (t * 29 % 64) + 1, t * 53 % BINS) for t in range(1, 9)]


def _bin(h: Column) -> Column:
    return F.shiftright(h, _BIN_SHIFT)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: ``BINS`` small numbers for ``text``. Texts without words share one fingerprint.

    The steps are columns of their own so that no lambda computes one again per element.
    """
    w, s, o, m, p, f = (f"_{name}_{k}" for k in "wsompf")
    df = df.withColumn(
        w, F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != ""), lambda x: F.xxhash64(x))
    )
    n = F.size(w)
    shingles = F.transform(
        F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(SHINGLE)])
    )
    df = df.withColumn(s, F.when(n >= SHINGLE, shingles).otherwise(F.array(F.xxhash64(F.concat_ws(",", w)))))
    df = df.withColumn(o, F.sort_array(s))
    df = df.withColumn(
        m,
        F.filter(o, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(F.col(o), i - 1)))),
    )
    df = df.withColumn(p, F.transform(m, _bin))
    at = F.sequence(F.lit(_FIRST_BIN), F.lit(_FIRST_BIN + BINS - 1))
    df = df.withColumn(f, F.transform(at, lambda b: F.get(F.col(m), (F.array_position(F.col(p), b) - 1).cast("int"))))
    values, bins, full = F.col(m), F.col(p), F.col(f)

    def filled(own: Column, b: Column) -> Column:
        asked = [F.get(full, (b * step + start).bitwiseAND(BINS - 1)) for step, start in _ASKED]
        # All full bins in an order of the empty bin's own; the place of the value rides in the low bits.
        drawn = F.array_min(
            F.transform(bins, lambda x, i: F.xxhash64(b, x).bitwiseAND(F.lit(-BINS)).bitwiseOR(i.cast("long")))
        ).bitwiseAND(F.lit(BINS - 1))
        borrowed = F.coalesce(*asked, F.get(values, drawn.cast("int")))
        # Hashed with its new bin: else bins that share a source would agree by chance together.
        return F.when(own.isNotNull(), own).otherwise(F.xxhash64(borrowed, b))

    every = F.when(F.size(m) == BINS, values).otherwise(F.transform(full, filled))
    low = F.transform(every, lambda v: v.bitwiseAND(F.lit((1 << BITS) - 1)).cast("short"))
    return df.withColumn(name, low).drop(w, s, o, m, p, f)


def packed(numbers: str) -> Column:
    """A fingerprint's bytes."""
    return F.unhex(F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x), BITS // 4, "0")), ""))


def _corrected(equal: Column) -> Column:
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of the shingles behind two unpacked fingerprints."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return _corrected(F.aggregate(same, F.lit(0), lambda n, x: n + x))


def packed_likeness(a: str, b: str) -> Column:
    """``likeness`` of two packed fingerprints."""
    at = F.sequence(F.lit(1), F.lit(BINS))
    same = F.filter(at, lambda i: F.substring(F.col(a), i, F.lit(1)) == F.substring(F.col(b), i, F.lit(1)))
    return _corrected(F.size(same))


def fingerprint(documents: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (packed) of every row; null text is empty."""
    rows = documents.select("doc_id", text_or_empty().alias("text"))
    return with_fingerprint(rows, "text", "bins").select("doc_id", packed("bins").alias("fingerprint"))


def with_neighbours(documents: DataFrame) -> DataFrame:
    """Each text, its edited text and the next one, by descending doc_id, round the table.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. The edited text has its last third replaced by as many characters of the next
    document. Documents are ordered in a narrow table; a text then travels once to meet its
    place in the order, and only the wanted beginning of it goes on to its neighbour. Rows
    without doc_id come last, rows of one doc_id are ordered by their hash; rows that repeat
    both are one document with as many equal results.
    """
    key = ["_k", "_k2"]
    docs = documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).withColumns(
        {"_k": F.xxhash64("doc_id", "text"), "_k2": F.hash("text", "doc_id")}
    )
    narrow = docs.select("doc_id", *key, F.length("text").cast("long").alias("n_chars")).distinct()
    order = written(dense_index(narrow, ["doc_id", *key], "idx"), "order")
    total = order.count()
    # Ascending numbers: the next document by descending doc_id has the number before.
    asking = order.select(
        F.pmod(F.col("idx") - 1, F.lit(max(total, 1))).alias("idx"),
        F.col("_k").alias("_to"),
        F.col("_k2").alias("_to2"),
        F.floor(F.col("n_chars") / 3).cast("int").alias("_need"),
    )
    # Both sides of the second join take the same columns of ``docs``, so its texts travel once.
    placed = docs.select(*key, "text").join(order.join(asking, "idx"), key)
    begins = placed.select(
        F.col("_to").alias("_k"), F.col("_to2").alias("_k2"), F.substring(F.col("text"), F.lit(1), F.col("_need")).alias("_begin")
    ).dropDuplicates(key)
    kept = F.col("n_chars") - F.floor(F.col("n_chars") / 3)
    both = placed.select(*key, "doc_id", "text", "n_chars", "idx").join(begins, key).select(
        "doc_id",
        "idx",
        "n_chars",
        "text",
        F.concat(F.substring(F.col("text"), F.lit(1), kept.cast("int")), "_begin").alias("edited"),
    )
    prints = with_fingerprint(with_fingerprint(both, "text", "_own"), "edited", "_other")
    stored = written(
        prints.select(
            "doc_id",
            "idx",
            "n_chars",
            F.sha2("edited", 256).alias("edited_sha256"),
            packed("_own").alias("fingerprint"),
            packed("_other").alias("edited_fingerprint"),
            likeness("_own", "_other").alias("near_edited"),
        ),
        "fingerprints",
    )
    following = stored.select(
        F.pmod(F.col("idx") + 1, F.lit(max(total, 1))).alias("idx"), F.col("fingerprint").alias("_next")
    ).dropDuplicates(["idx"])
    return stored.join(following, "idx").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        packed_likeness("fingerprint", "_next").alias("near_next"),
    )
