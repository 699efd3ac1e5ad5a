"""The registered queries of this subpackage: thin calls of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import (
    decontam,
    fingerprints,
    jaccard,
    lexical,
    line_dedup,
    lm_score,
    packing,
    phrases,
    quality,
    secret_scan,
    simhash,
    toxicity,
    warc,
)
from turnwise.llm.common import ship, table, tokenizer_path
from turnwise.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(key: str, sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark, sf_dir):
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


#: SHA-1 in base 32: every five hex digits are four letters of the alphabet.
_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((
    ('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1)), '')"""


@_query(
    "op1_warc",
    f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
    held AS (SELECT hex, max(page_id) AS holder FROM p GROUP BY hex)
    SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
           CASE WHEN page_id IS DISTINCT FROM holder AND holder IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id IS DISTINCT FROM holder THEN holder END AS refers_to, true AS verified
    FROM p JOIN held USING (hex)""",
)
def op1_warc(spark, sf_dir):
    path = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"
    )


@_query("op3_packing")
def op3_packing(spark, sf_dir):
    path = tokenizer_path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), path).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@_query("op7_simhash")
def op7_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""


@_query(
    "op4_decontamination",
    f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    bw AS (SELECT item_id, w, least(len(w), 13) AS size, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
    bk AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase FROM bw),
    dw AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bk) WHERE len(w) >= size),
    dk AS (SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase FROM dw),
    m AS (SELECT doc_id, item_id, i, size FROM dk JOIN bk USING (size, phrase)),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id),
    its AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
)
def op4_decontamination(spark, sf_dir):
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@_query("op2_secrets")
def op2_secrets(spark, sf_dir):
    def listed(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
        )

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    vocabularies = [tokenizer_path(name) for name in secret_scan.VOCABULARIES]
    found = secret_scan.find(table(spark, sf_dir, "documents"), vocabularies)
    return found.select(
        "doc_id",
        *[number(kind) for kind in ("assign", "access", "hex")],
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


@_query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = toxicity.learn(documents, table(spark, sf_dir, "labels"))
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return toxicity.score(documents.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(F.pmod(crc, F.lit(4)) == 2, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        F.col("toxic").cast("int").alias("predicted"),
    )


@_query("op6_lm_score")
def op6_lm_score(spark, sf_dir):
    return lm_score.score(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@_query("op8_fingerprints")
def op8_fingerprints(spark, sf_dir):
    found = fingerprints.with_neighbours(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


@_query("op9_quality")
def op9_quality(spark, sf_dir):
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op5_line_dedup")
def op5_line_dedup(spark, sf_dir):
    return line_dedup.classes(table(spark, sf_dir, "documents")).drop("text_key")


@_query(
    "op11_collocations",
    """WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM t),
    o AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) AS s(k) WHERE len(w) >= k),
    g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS f FROM o GROUP BY ALL),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
    c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f FROM g WHERE k > 1 AND f >= 30),
    cut AS (SELECT c.lang, c.phrase, j, c.f AS a, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.f) // (x.f + y.f))::BIGINT AS score
            FROM (SELECT *, unnest(range(1, k)) AS j FROM c) AS c
            JOIN g AS x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(w, 1, j), ' ')
            JOIN g AS y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(w, j + 1, c.k), ' ')),
    weak AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    sub AS (SELECT lang, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase, max(f) AS cover FROM (
              SELECT *, unnest(range(1, k - size + 2)) AS i FROM c, (VALUES (2), (3)) AS s(size) WHERE size < k) GROUP BY ALL)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM weak JOIN n USING (lang) LEFT JOIN sub USING (lang, phrase)
    WHERE cover IS NULL OR 100 * cover < 80 * a
    QUALIFY rank <= 2000""",
)
def op11_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


_TERMS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""


@_query(
    "op12_search",
    f"""WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
    s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_words FROM d),
    q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
    o AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d)
          WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM o GROUP BY term),
    v AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS weight FROM f, s),
    c AS (SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_words))) AS score
          FROM o JOIN v USING (term), s),
    r AS (SELECT item_id, doc_id, sum(times * score)::BIGINT AS score FROM q JOIN c USING (term) GROUP BY ALL)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM r WHERE score > 0 QUALIFY rank <= 10""",
)
def op12_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query(
    "op13_jaccard",
    """WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    link AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 80 * (p.n + q.n - common)),
    reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
    FROM (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) LEFT JOIN n USING (doc_id)""",
)
def op13_jaccard(spark, sf_dir):
    return jaccard.classes(table(spark, sf_dir, "documents"))
