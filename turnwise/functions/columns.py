"""Column expressions shared by the operators. Everything here stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[^ \n]+"


def tokens_of(text) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def hash32(*parts) -> Column:
    """First 32 bits of the md5 of the parts joined by ':'; the same on every engine."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """A repeatable number in [0, 1) drawn from the parts."""
    return hash32(*parts) / F.lit(4294967296.0)


def strip(text) -> Column:
    """Trim every kind of white space at both ends."""
    space = r"[\s\p{Z}\x1c-\x1f\x85]+"
    return F.regexp_replace(text, f"^{space}|{space}$", "")


# --- cutting generated answers -------------------------------------------------


def cut_before_stop(ids, stops: Sequence[int]) -> Column:
    """Cut just before the first id that belongs to ``stops``."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    if not stops:
        return ids
    wanted = F.array(*[F.lit(s) for s in stops])
    first = F.array_position(F.transform(ids, lambda x: F.array_contains(wanted, x)), True)
    return F.when(first > 0, F.slice(ids, 1, (first - 1).cast("int"))).otherwise(ids)


def cut_after_eos(ids, eos) -> Column:
    """Cut just after the first ``eos``; unchanged when there is none."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    first = F.array_position(ids, eos)
    return F.when(first > 0, F.slice(ids, 1, first.cast("int"))).otherwise(ids)


def cut_stop_string(text, stop: str) -> Column:
    """Cut at the stop string, except that one at the very start is left alone."""
    text = F.col(text) if isinstance(text, str) else text
    at = F.instr(text, F.lit(stop))
    return F.when(at > 1, F.left(text, at - 1)).otherwise(text)


def strip_special(text, literals: Sequence[str]) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    for literal in literals:
        text = F.replace(text, F.lit(literal), F.lit(""))
    return strip(text)


def strip_prefix(text, prefix: str) -> Column:
    """Remove one leading ``prefix`` and the white space around what is left."""
    text = F.col(text) if isinstance(text, str) else text
    rest = F.substring(text, len(prefix) + 1, 2147483647)
    return F.when(F.startswith(text, F.lit(prefix)), strip(rest)).otherwise(text)


# --- arrays --------------------------------------------------------------------


def padded(arr, length, value) -> Column:
    """Right-pad to ``length``; a longer array is returned unchanged."""
    arr = F.col(arr) if isinstance(arr, str) else arr
    length = F.lit(length) if isinstance(length, int) else length
    missing = F.greatest(length - F.size(arr), F.lit(0)).cast("int")
    return F.concat(arr, F.array_repeat(F.lit(value), missing))


def shifted_left(arr, k: int = 1, fill=0) -> Column:
    """Drop ``k`` items from the front and fill the end, keeping the length."""
    arr = F.col(arr) if isinstance(arr, str) else arr
    n = F.size(arr)
    fills = F.array_repeat(F.lit(fill), F.least(n, F.lit(k)))
    return F.concat(F.slice(arr, k + 1, F.greatest(n, F.lit(1))), fills)


def shifted_right(arr, k: int = 1, fill=0) -> Column:
    arr = F.col(arr) if isinstance(arr, str) else arr
    n = F.size(arr)
    fills = F.array_repeat(F.lit(fill), F.least(n, F.lit(k)))
    return F.concat(fills, F.slice(arr, 1, F.greatest(n - k, F.lit(0))))


def leading_run(flags) -> Column:
    """How many items are true before the first that is not."""
    flags = F.col(flags) if isinstance(flags, str) else flags
    first_miss = F.array_position(F.transform(flags, lambda f: F.coalesce(f, F.lit(False))), False)
    return F.coalesce(F.nullif(first_miss, F.lit(0)) - 1, F.size(flags)).cast("bigint")


def leading_ones(flags) -> Column:
    """The same for an array of 0 and 1, without a lambda."""
    first_miss = F.array_position(flags, 0)
    return F.coalesce(F.nullif(first_miss, F.lit(0)) - 1, F.size(flags)).cast("bigint")


def total(arr) -> Column:
    arr = F.col(arr) if isinstance(arr, str) else arr
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def mean_smooth_l1(predicted, target, beta: float = 1.0) -> Column:
    """Huber loss between two vectors, averaged over their dimensions."""

    def one(a, b):
        gap = F.abs(a.cast("double") - b.cast("double"))
        return F.when(gap < beta, gap * gap * (0.5 / beta)).otherwise(gap - 0.5 * beta)

    return total(F.zip_with(predicted, target, one)) / F.size(predicted)


def bound(value, use) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use``; inside a lambda over an
    array it would be evaluated once per item."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def vector_log_softmax(scores) -> Column:
    """log-softmax of an array of scores, shifted by its largest item."""
    scores = F.col(scores) if isinstance(scores, str) else scores

    def shifted(top):
        mass = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - top))
        return bound(F.ln(mass), lambda m: F.transform(scores, lambda x: x.cast("double") - top - m))

    return bound(F.array_max(scores).cast("double"), shifted)
