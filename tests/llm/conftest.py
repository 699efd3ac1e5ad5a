"""Small tables with everything that may go wrong in a column."""

import random

import pytest

# Names that operators use inside or give out themselves.
CLASHING = ("norm", "line", "key", "toxic", "toxicity", "_row", "segment", "fingerprint", "rank", "idx", "sequence_id")
WORDS = [a + b for a in ("ba", "co", "di", "fu", "le", "mo", "na", "pi") for b in ("r", "st", "nd", "lo", "me", "ti")]


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    words = [rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) for i in range(0, n, 12))


def odd_documents() -> list[tuple]:
    """(doc_id, text): nulls, empty and blank texts, copies, repeated rows, one long text, marks."""
    base = prose(1, 120)
    edited = base.replace(base.split()[30], "changed", 1)
    rows = [
        (1, base), (2, base), (3, edited), (4, None), (5, ""), (6, " \n\t\n "), (7, "one"), (8, "one two three"),
        (9, prose(2, 60)), (9, prose(2, 60)), (10, prose(3, 30_000)), (11, "Ünïcode ſtraße İstanbul 東京 🎉 naïve"),
        (12, "x" * 5000), (13, base.upper()), (14, prose(4, 40) + "\n\n" + prose(4, 40)), (None, "no id at all"),
        (None, None), (15, "<|endoftext|> within a text <|startoftext|>"), (16, "don't can't we've it's 1.000,00 e.g."),
    ]
    return rows + [(100 + i, prose(100 + i, 40 + i)) for i in range(20)]


@pytest.fixture(scope="session")
def documents(spark):
    """The odd documents with all columns of the table and clashing ones besides."""
    rows = [(i, t, "en", "src0", None if t is None else len(t), *["x"] * len(CLASHING)) for i, t in odd_documents()]
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.limit(0)
