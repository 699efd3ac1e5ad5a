"""Fuzzy line dedup in Spark's own functions: SimHash, pigeonhole blocks, edit similarity, groups.

Lines are lower-cased with single blanks; equal ones are one line from then on. A line's 64-bit
SimHash is cut into blocks. Two lines whose hashes differ in ``BITS`` places have all but
``BITS`` of the blocks in common, so each choice of that many blocks is a key, and such lines
meet under one of them. Blocks are dealt to groups, as then fewer choices do, and there are so many that a
key is nearly as wide as the number of lines; this moves the work only, the pairs in reach are the same. Pairs in reach whose word
sequences are alike enough are links, and a connected group keeps one occurrence.

A crowded group is not compared in pairs, for only its connected parts matter. Each line is compared
with those that follow it, in the order of the hashes; then lines outside the largest part of a
group meet the lines of other parts, a growing slice of these pairs by a hash, until none is left.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.common import BROADCAST_ROWS, free_names, quoted, small
from turnwise.llm.components import components, extended
from turnwise.operators.scale import lookup
from turnwise.session import written

BITS = 4
SIMILAR = 0.8
#: Hashes under a key, or lines of a group, that are compared in pairs.
CROWD = 32
#: Lines of a crowded group that each line is compared with first, and lines of such a group in one task.
FOLLOWERS, PIECE = 4, 4000
#: Different words of a line whose bits are added up digit by digit; one less than a power of two.
UNROLLED = 255
#: Hashes that share a key on average, at most, and one hash in how many tells which keys are crowded.
SHARED, TOLD = 8, 8
#: Hashes up to this number all tell.
FEW = 100_000


def _words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), r"\s+"), lambda w: w != "")


def _normal(line: Column) -> Column:
    """Lower case, single blanks; only lines with other white space are cut into words for that."""
    odd = reduce(lambda x, y: x | y, [F.contains(line, F.lit(c)) for c in ("  ", "\t", "\r", "\f", "\x0b")])
    odd = odd | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    return F.when(odd, F.array_join(_words(line), " ")).otherwise(F.lower(line))


def lines(documents: DataFrame) -> DataFrame:
    """``doc_id, text_key, line_no, line, norm`` of every line that is not blank; null texts have none.

    ``line`` is a hash of the normalised line and its number from then on; ``text_key`` tells
    apart rows that share a doc_id but not the text.
    """
    # Each text is hashed and cut once, not for each of its lines.
    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.split("text", "\n").alias("cut"))
    split = rows.select("doc_id", "text_key", F.posexplode("cut").alias("line_no", "raw"))
    split = split.filter(F.ltrim("raw", F.lit(" \t\r\f\x0b")) != "")
    normal = split.select("doc_id", "text_key", "line_no", _normal(F.col("raw")).alias("norm"))
    return normal.select("doc_id", "text_key", "line_no", F.xxhash64("norm").alias("line"), "norm")


def _counted(words: Column, shift: int, lanes: int) -> Column:
    """Of all ``words`` (hashes) the bits that ``lanes`` picks after a shift, added up lane by lane."""
    return F.aggregate(
        words, F.lit(0).cast("long"), lambda n, h: n + F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(lanes))
    )


def _majority(counts: list[tuple[int, Column]], of: Column) -> Column:
    zero = F.lit(0).cast("long")
    bits = [F.when(2 * n > of, F.lit(1 << place if place < 63 else -(1 << 63))).otherwise(zero) for place, n in counts]
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def _added(places: list[list[str]]) -> tuple[list[str], list[list[str]]]:
    """SQL that adds up numbers bit by bit, and the places of what is left.

    ``places[k]`` names numbers whose every bit counts 2 ** k. Seven of them become three, three become
    two, and others stay as they are.
    """

    def total(x: str, y: str, z: str) -> tuple[str, str]:
        return f"({x} ^ {y} ^ {z})", f"(({x} & {y}) | ({z} & ({x} ^ {y})))"

    left: list[list[str]] = [[] for _ in range(len(places) + 2)]
    for k, names in enumerate(places):
        at = 0
        while len(names) - at >= 3:
            if len(names) - at >= 7:
                a, b, c, d, e, f, g = names[at : at + 7]
                (one, x), (two, y) = total(a, b, c), total(d, e, f)
                one, z = total(one, two, g)
                two, four = total(x, y, z)
                left[k].append(one)
                left[k + 1].append(two)
                left[k + 2].append(four)
                at += 7
            else:
                one, two = total(*names[at : at + 3])
                left[k].append(one)
                left[k + 1].append(two)
                at += 3
        left[k] += names[at:]
    while not left[-1]:
        left.pop()
    named = [[f"p{k}_{i}" for i in range(len(column))] for k, column in enumerate(left)]
    made = [f"{sql} AS {name}" for sqls, names in zip(left, named, strict=True) for sql, name in zip(sqls, names, strict=True)]
    return made, named


def _most_bits(rows: DataFrame, names: list[str]) -> DataFrame:
    """``names`` and ``bits``: the bits set in more than half of the numbers in ``h``, of which there are at most ``UNROLLED``.

    Bits are added up as in a circuit: a number holds the same digit of all 64 counts. So a word costs
    a few operations on whole numbers in generated code, where a lambda is interpreted for every word and lane.
    """
    kept = [*names, "half"]
    places = [[f"p0_{i}" for i in range(UNROLLED)]]
    leaves = [f"coalesce(get(h, {i}), 0L) AS {name}" for i, name in enumerate(places[0])]
    rows = rows.selectExpr(*names, "size(h) div 2 AS half", *leaves)
    while max(map(len, places)) > 1:
        if max(map(len, places)) == 2:
            # A carry may go on to the highest place; a zero makes two numbers three.
            places = [[*column, "0L"] if len(column) == 2 else column for column in places]
        made, places = _added(places)
        rows = rows.selectExpr(*kept, *made)
    more = "0L"
    for k, column in enumerate(places):
        digit, limit = column[0], f"(-((half >> {k}) & 1L))"
        more = f"(({digit} & ~{limit}) | ({more} & ~({digit} ^ {limit})))"
    return rows.selectExpr(*names, f"{more} AS bits")


def hashed_lines(rows: DataFrame) -> DataFrame:
    """``rows`` of ``lines`` with ``n_words, simhash`` instead of the text.

    Each different word of a line counts once: by their mere number the frequent words of a
    language would make all its long lines alike. A line's bits are counted inside its row, so
    neither its text nor counters are shuffled: digit by digit for up to ``UNROLLED`` words; in longer
    lines four counters of 16 bits share a number, and a line with more words than these
    can count has each bit counted alone.
    """
    names = ["doc_id", "text_key", "line_no", "line"]
    cut = rows.select(*names, F.split("norm", " ").alias("cut"))
    hashed = cut.select(*names, F.size("cut").alias("n_words"), F.array_distinct(F.transform("cut", lambda w: F.xxhash64(w))).alias("h"))
    size = F.size("h")
    middle = (size > UNROLLED) & (size < 1 << 15)
    by16 = sum(1 << 16 * lane for lane in range(4))
    h = F.col("h")
    counted = hashed.select(
        *names, "n_words", "h", *[F.when(middle, _counted(h, j, by16)).alias(f"b{j}") for j in range(16)]
    )

    def lane(name: str, shift: int, width: int) -> Column:
        return F.shiftrightunsigned(name, shift).bitwiseAND(F.lit((1 << width) - 1))

    sixteens = [(j + 16 * k, lane(f"b{j}", 16 * k, 16)) for j in range(16) for k in range(4)]
    zero = F.lit(0).cast("long")

    def one_by_one(done: Column, place: Column) -> Column:
        n = F.aggregate("h", zero, lambda n, x: n + F.call_function("getbit", x, place).cast("long"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
        return done.bitwiseOR(F.when(2 * n > size, bit).otherwise(zero))

    many = F.aggregate(F.sequence(F.lit(0), F.lit(63)), zero, one_by_one)
    long = F.when(middle, _majority(sixteens, size)).when(size > UNROLLED, many)
    most = _most_bits(counted.select(*names, "n_words", "h", long.alias("long")), [*names, "n_words", "long"])
    return most.select(*names, "n_words", F.coalesce("long", "bits").alias("simhash"))


def simhashes(rows: DataFrame) -> DataFrame:
    """``line, n_words, simhash`` of the different lines among ``rows`` of ``lines``."""
    return different_lines(hashed_lines(rows)).select("line", "n_words", "simhash")


def different_lines(found: DataFrame) -> DataFrame:
    """``line, n_words, simhash, n, first``: how often each line occurs and its first place."""
    return found.groupBy("line").agg(
        F.min("n_words").alias("n_words"),
        F.min("simhash").alias("simhash"),
        F.count("*").alias("n"),
        F.min(F.struct("doc_id", "text_key", "line_no")).alias("first"),
    )


def _blocks(n_lines: int, bits: int) -> int:
    """The fewest blocks whose keys have about as many values as there are lines."""
    for blocks in range(bits + 2, 3 * bits + 1):
        if 2 ** (64 * (blocks - bits) / blocks) >= n_lines / 2:
            return blocks
    return 3 * bits


def _masks(blocks: int, groups: int, kept: int) -> list[int]:
    """Places of a hash, for each choice of ``kept`` blocks of one group, when the blocks are dealt to ``groups`` groups."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [
        sum(((1 << edges[b + 1]) - 1) ^ ((1 << edges[b]) - 1) for b in choice)
        for g in range(groups)
        for choice in combinations(range(g, blocks, groups), kept)
    ]


def choices(n_hashes: int, bits: int) -> list[int]:
    """The fewest masks such that hashes within ``bits`` of each other are equal under one of them,
    and about ``SHARED`` hashes or fewer are equal under a mask by chance.

    ``bits`` places spare all but ``bits`` of the blocks. If these are more than ``kept - 1`` for each
    group, ``kept`` of them lie in one group. With a single group that is every choice of blocks.
    """
    plain = _blocks(n_hashes, bits)
    best = _masks(plain, 1, plain - bits)
    for blocks in range(bits + 1, 4 * bits + 1):
        for groups in range(1, blocks - bits + 1):
            kept = 1 + (blocks - bits - 1) // groups
            number = sum(comb(len(range(g, blocks, groups)), kept) for g in range(groups))
            if number < len(best):
                masks = _masks(blocks, groups, kept)
                if SHARED << min(m.bit_count() for m in masks) >= n_hashes:
                    best = masks
    return best


def keys(hashes: DataFrame, masks: list[int]) -> DataFrame:
    """``key, simhash``: a row for each of the ``masks``."""
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    each = F.array(
        *[F.xxhash64(F.lit(i), F.col("simhash").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)]
    )
    return hashes.select(F.explode(each).alias("key"), "simhash")


def _in_reach(bits: int, similar: float) -> str:
    """Of two rows a and b: hashes within ``bits``, and lengths that can be alike enough."""
    return (
        f"bit_count(a.simhash ^ b.simhash) <= {bits} "
        f"and least(a.n_words, b.n_words) >= {similar} * greatest(a.n_words, b.n_words)"
    )


def _coded(norm: Column) -> Column:
    """A line with one character beyond the first plane for each word."""
    code = F.transform(
        F.split(norm, " "),
        lambda w: F.lpad(F.hex(F.lit(0x10000) + F.pmod(F.xxhash64(w), F.lit(0x100000))), 8, "0"),
    )
    return F.decode(F.unhex(F.array_join(code, "")), "UTF-32")


def alike(pairs: DataFrame, texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The ``pairs`` (u, v) whose word sequences have an edit similarity of ``similar`` or more.

    That is one less the words to insert, delete and replace, over the words of the longer line.
    ``texts`` has ``line, coded, n_words``.
    """
    def side(end: str) -> DataFrame:
        return texts.select(F.col("line").alias(end), F.col("coded").alias(f"{end}_coded"), F.col("n_words").alias(f"{end}_words"))

    both = pairs.distinct().join(side("u"), "u").join(side("v"), "v")
    most = f"cast(floor((1 - {similar}) * greatest(u_words, v_words) + 1e-9) as int)"
    return both.withColumn("most", F.expr(most)).filter(F.expr("levenshtein(u_coded, v_coded, most) >= 0")).select("u", "v")


def meetings(table: DataFrame, bits: int = BITS) -> DataFrame:
    """``key, line, n_words, simhash``: groups of lines such that lines in reach share one.

    The search is for hashes, each once, so rows are short: hashes within ``bits`` of each
    other that share a key, then the lines that have them. Lines of one hash are a group
    too, and a key with many times ``CROWD`` hashes is a group as it is. Both ways find the same lines and
    differ in time only, so in a large table some of the hashes tell which keys these are.
    """
    hashes = written(table.select("simhash").distinct(), "line-hashes")
    n = hashes.count()
    masks = choices(n, bits)
    rows = keys(hashes, masks)
    told = TOLD if n > FEW else 1
    some = keys(hashes.filter(F.pmod(F.xxhash64("simhash"), F.lit(told)) == 0), masks)
    sizes = some.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") * told > 4 * CROWD)
    crowded = written(sizes.select("key"), "crowded-keys")
    few = rows.join(small(crowded), "key", "left_anti")
    found = few.alias("a").join(
        few.alias("b"),
        F.expr(f"a.key = b.key and a.simhash < b.simhash and bit_count(a.simhash ^ b.simhash) <= {bits}"),
    )
    pairs = written(found.select(F.col("a.simhash").alias("x"), F.col("b.simhash").alias("y")).distinct(), "near-hashes")
    grouped = pairs.select(F.xxhash64("x", "y").alias("key"), F.explode(F.array("x", "y")).alias("simhash"))
    same = table.groupBy("simhash").agg(F.count("*").alias("n")).filter("n > 1")
    grouped = grouped.union(same.select(F.xxhash64(F.lit("same"), "simhash").alias("key"), "simhash"))
    grouped = grouped.union(rows.join(small(crowded), "key", "left_semi"))
    return grouped.join(table.select("line", "n_words", "simhash"), "simhash").select("key", "line", "n_words", "simhash")


def followers(crowd: DataFrame, in_reach: str) -> DataFrame:
    """``u, v``: lines in reach that follow each other closely in a group, by hash.

    Groups are cut by ranges, so a large one is many tasks; neighbours across a cut are left
    to the later rounds.
    """
    order = ["key", "simhash", "line"]
    pieces = written(crowd.repartitionByRange(*order).withColumn("piece", F.spark_partition_id()), "crowd-pieces")
    window = Window.partitionBy("piece", "key").orderBy("simhash", "line")
    names = ("line", "n_words", "simhash")
    found = None
    for step in range(1, FOLLOWERS + 1):
        ahead = F.struct(*[F.lead(c, step).over(window).alias(c) for c in names])
        both = pieces.select(F.struct(*names).alias("a"), ahead.alias("b")).filter("b.line is not null").filter(F.expr(in_reach))
        found = both if found is None else found.union(both)
    return found.select(F.expr("least(a.line, b.line)").alias("u"), F.expr("greatest(a.line, b.line)").alias("v"))


def across(crowd: DataFrame, roots: DataFrame, in_reach: str, low: int, high: int) -> tuple[DataFrame, int]:
    """``u, v``: lines in reach of different parts of a group whose turn has come, and the size of
    the largest group with several parts.

    Lines of the largest part do not meet each other. A group of s lines shows the pairs whose
    hash lies between low / s and high / s; groups up to ``low`` lines have had all their turns.
    """
    placed = crowd.join(roots.withColumnRenamed("node", "line"), "line", "left").select(
        "key", "line", "n_words", "simhash", F.coalesce("root", "line").alias("root")
    )
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    groups = parts.groupBy("key").agg(
        F.sum("n").alias("size"), F.count("*").alias("parts"), F.max(F.struct("n", "root"))["root"].alias("largest")
    )
    groups = written(groups.filter("parts > 1").filter(F.col("size") > low).select("key", "size", "largest"), "open-groups")
    most = groups.agg(F.max("size")).first()[0] or 0
    pieces = F.ceil(F.col("size") / PIECE).cast("int")
    every = placed.join(small(groups), "key").withColumn("piece", F.pmod(F.xxhash64("line"), pieces).cast("int"))
    some = placed.join(small(groups), "key").filter("root <> largest").withColumn(
        "piece", F.explode(F.sequence(F.lit(0), pieces - 1))
    )
    turn = "shiftrightunsigned(xxhash64(a.line ^ b.line), 11) / 9007199254740992D * a.size"
    found = some.alias("a").join(
        every.alias("b"),
        F.expr("a.key = b.key and a.piece = b.piece and a.root <> b.root and (b.root = b.largest or a.line < b.line)")
        & F.expr(in_reach)
        & F.expr(f"{turn} >= {low} and {turn} < {high}"),
    )
    pairs = found.select(F.expr("least(a.line, b.line)").alias("u"), F.expr("greatest(a.line, b.line)").alias("v"))
    return pairs.distinct(), most


def texts_of(documents: DataFrame, table: DataFrame, wanted: DataFrame) -> DataFrame:
    """``line, coded, n_words`` of the ``wanted`` lines, read at their first places."""
    n = wanted.count()
    places = table.select("line", "first.*").join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, "line")
    places = places.groupBy(F.col("doc_id").alias("at_doc"), F.col("text_key").alias("at_key")).agg(
        F.collect_set(F.struct("line", "line_no")).alias("places")
    )
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    on = F.col("doc_id").eqNullSafe(F.col("at_doc")) & (F.col("text_key") == F.col("at_key"))
    # Texts stay where they are while the places are few.
    found = rows.join(F.broadcast(places) if n <= BROADCAST_ROWS // 2 else places, on)
    found = found.select(F.split("text", "\n").alias("cut"), F.explode("places").alias("p"))
    norm = found.select(F.col("p.line").alias("line"), _normal(F.get("cut", F.col("p.line_no"))).alias("norm")).dropDuplicates(["line"])
    return norm.select("line", _coded(F.col("norm")).alias("coded"), F.size(F.split("norm", " ")).alias("n_words"))


def connected(documents: DataFrame, table: DataFrame, bits: int = BITS, similar: float = SIMILAR) -> DataFrame:
    """``node, root`` of all lines of ``table`` (a stored one) that are within reach of one another and alike."""
    members = written(meetings(table, bits), "line-meetings")
    wanted = written(members.select("line").distinct(), "wanted-lines")
    texts = written(texts_of(documents, table, wanted), "line-texts")
    crowds = members.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("key")
    crowds = written(crowds, "crowds")
    in_reach = _in_reach(bits, similar)
    few = members.join(small(crowds), "key", "left_anti")
    near = few.alias("a").join(few.alias("b"), F.expr("a.key = b.key and a.line < b.line") & F.expr(in_reach))
    close = alike(near.select(F.col("a.line").alias("u"), F.col("b.line").alias("v")), texts, similar)
    found = written(close, "line-links")
    if not crowds.limit(1).count():
        return components(found)

    crowd = written(members.join(small(crowds), "key"), "crowded-lines")
    tried = written(followers(crowd, in_reach).distinct(), "line-pairs")
    roots = components(found.union(written(alike(tried, texts, similar), "line-links")))
    low, high = 0, 64
    while True:
        pairs, most = across(crowd, roots, in_reach, low, high)
        if not most:
            return roots
        new = written(pairs.join(tried, ["u", "v"], "left_anti"), "line-pairs")
        roots = extended(roots, written(alike(new, texts, similar), "line-links"))
        if most <= high:
            return roots
        tried = tried.union(new)
        low, high = high, 16 * high


def classes(documents: DataFrame, bits: int = BITS, similar: float = SIMILAR) -> DataFrame:
    """``doc_id, text_key, line_no, class_doc, class_line, kept`` of every line that is not blank.

    The class is named by its first occurrence by doc_id and line, which alone is kept. Rows
    that repeat a document keep or lose the same lines; lines of rows without doc_id come first.
    """
    found = written(hashed_lines(lines(documents)), "line-places")
    table = written(different_lines(found), "lines")
    roots = connected(documents, table, bits, similar)
    rooted = table.join(roots.withColumnRenamed("node", "line"), "line", "left").select(
        "line", "n", "first", F.coalesce("root", "line").alias("root")
    )
    rooted = written(rooted, "rooted-lines")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("class"), F.count("*").alias("lines"))
    named = lookup(rooted.select("line", "n", "root"), written(firsts, "line-classes"), ["root"], ["line"], weight="lines")
    named = written(named.select("line", "n", "class"), "named-lines")
    places = ["doc_id", "text_key", "line_no"]
    return lookup(found.select(*places, "line"), named, ["line"], places, weight="n").select(
        *places,
        F.col("class.doc_id").alias("class_doc"),
        F.col("class.line_no").alias("class_line"),
        F.struct(*places).eqNullSafe(F.col("class")).alias("kept"),
    )


def dedup(documents: DataFrame, bits: int = BITS, similar: float = SIMILAR) -> DataFrame:
    """``documents`` without the lines that are not kept; ``n_chars``, if there, counts the rest.

    Blank lines stay. A document that loses all its lines goes; one without lines stays.
    """
    doc, key, lost, rest = free_names(documents, "doc", "key", "lost", "rest")
    gone = (
        classes(documents, bits, similar)
        .filter("not kept")
        .groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(key))
        .agg(F.collect_set("line_no").alias(lost))
    )
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key))
    left = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(lost, i))
    whole = F.col(lost).isNull()
    out = documents.join(gone, on, "left").withColumn(rest, F.when(whole, F.col("text")).otherwise(F.array_join(left, "\n")))
    out = out.filter(whole | (F.trim(rest) != ""))
    changed = {"text": F.col(rest)}
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        changed["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.length(rest).cast(kind))
    return out.withColumns(changed).select(*[quoted(c) for c in documents.columns])
