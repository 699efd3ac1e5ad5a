"""Toxicity of noisy texts: restore disguised words under a character model, then score words.

Channel. A token with digits or signs among its letters, a letter three times in a row, or
letters set apart is a lattice: a sign may stand for letters, hide one, be itself, or be dropped,
and a repeated letter may be dropped. Words cut by blanks are met by their pieces in scoring. Viterbi finds the path that a trigram character model of the
whole corpus and the channel's costs like best. All other tokens have one path, themselves.

Score. Every restored word takes the surest of its pieces: the whole word, its beginnings and
its inner five-letter strings, each with a lower bound of the share of toxic lines among the
distinct lines that hold it. A logistic model over a document's three surest words and its
length gives the probability. It is fitted on labelled documents whose words were weighed
without their fold.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnwise.llm.common import in_chunks, rows_of, text_or_empty
from turnwise.session import written

#: Classes of characters in the model: 0 blank, a-z, U+00DF to U+00FF, other letters, digits, signs.
CLASSES = 64
_OTHER, _DIGIT, _SIGN = 60, 61, 62
#: Labelled documents that the model is fitted on, drawn by a hash of their ids; all sure pieces of their words count.
LABELLED = 50_000
#: Least lower bound of a piece that counts, and the bound's width in standard errors.
SURE, WIDTH = 0.25, 3.0
LEVELS = 16
REMEMBERED = 400_000
#: Rows that are judged at once when rows pass through a task.
ROWS = 1000
TOXIC = 0.3

# Fixed: letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
#: Characters that hide a letter without being like one.
HIDING = "*#26"
#: Costs of the channel in nats: a sign for a letter, a dropped repetition, a dropped sign, a hidden letter.
AS_LETTER, REPEATED, DROPPED, HIDDEN = -2.0, -1.0, -3.0, -3.0
_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
_EDGES = ".,;:?\"'`()[]{}<>«»“”„…*#%&=~^/\\-_"
_ENDS = _EDGES + "!"
_TRIPLE = re.compile(r"(.)\1\1")
_RUN = re.compile(r"(.)\1+")
_APART = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+])(?:[ ._*-](?:[^\W_]|[@$!|+])){2,}(?!\S)")
#: Found in every text with letters set apart; it begins with a set of characters, so a search passes over the rest.
_MAYBE_APART = re.compile(r"[ ._*-][\w@$!|+][ ._*-][\w@$!|+](?![^\s._*-])")
_LETTERS = re.compile(r"[^\W\d_]+")


def _class_table() -> np.ndarray:
    table = np.full(0x110000, _OTHER, np.uint8)
    table[:128] = _SIGN
    table[[ord(c) for c in " \t\n\r\x0b\x0c\xa0"]] = 0
    table[ord("0") : ord("9") + 1] = _DIGIT
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[0x80:0xDF] = _SIGN
    table[0xDF:0x100] = np.arange(27, 60)
    table[0x2000:0x2070] = _SIGN
    return table


_TABLE = _class_table()


def classes(text: str) -> np.ndarray:
    return _TABLE[np.frombuffer(text.encode("utf-32-le"), "<u4")]


def _count_trigrams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES**3, np.int64)
    for (text,) in rows_of(batches, "text"):
        c = classes(f"  {text.lower()}  ").astype(np.int32)
        total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["trigram", "n"])


def character_model(documents: DataFrame) -> np.ndarray:
    """Log probabilities [before last, last, next] from all texts; at most 64^3 counts are fetched."""
    texts = documents.select(text_or_empty().alias("text"))
    # One row per trigram and task reaches the sums.
    counted = texts.mapInArrow(_count_trigrams_by_block, "trigram long, n long")
    summed = counted.groupBy("trigram").agg(F.sum("n").alias("n")).collect()
    tri = np.zeros(CLASSES**3)
    tri[[r["trigram"] for r in summed]] = [r["n"] for r in summed]
    return log_model(tri.reshape(CLASSES, CLASSES, CLASSES))


def _count_trigrams_by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_count_trigrams``; texts are joined into blocks so that short ones cost no table each."""

    def joined() -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for (text,) in rows_of(batches, "text"):
            held.append(text)
            size += len(text)
            if size > 2_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(["  ".join(held)])], ["text"])
                held, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(["  ".join(held)])], ["text"])

    yield from _count_trigrams(joined())


def log_model(tri: np.ndarray) -> np.ndarray:
    """Trigrams, bigrams, single characters and a uniform share, mixed."""
    bi, uni = tri.sum(0), tri.sum((0, 1))

    def share(counts):
        return counts / np.maximum(counts.sum(-1, keepdims=True), 1)

    mixed = 0.7 * share(tri) + 0.2 * share(bi)[None] + 0.09 * share(uni)[None, None] + 0.01 / CLASSES
    return np.log(mixed).astype(np.float32)


def _flat(model) -> list[float]:
    """The character model as a list, in which a number is found faster."""
    return model if isinstance(model, list) else model.ravel().tolist()


@lru_cache(maxsize=10_000)
def readings(ch: str, masked: bool) -> list[tuple[str, int, float]]:
    """What a character of a disguised token may stand for: (character, its class, cost)."""
    letters = [(x, AS_LETTER) for x in LEET.get(ch, "")]
    if masked and ch in HIDING:
        letters += [(x, HIDDEN) for x in _ALPHABET]
    letters.append((ch, 0.0))
    return [(x, int(_TABLE[ord(x)]), cost) for x, cost in letters]


def is_masked(token: str) -> bool:
    """A character that hides a letter may be any one if the token has as many letters as such characters."""
    return 0 < sum(ch in HIDING for ch in token) <= sum(ch.isalpha() for ch in token)


def decode(token: str, model) -> str:
    """The likeliest plain form of a lower-case token, in time that grows with its length.

    Paths are linked from their ends, so they share what they have in common.
    """
    flat, masked = _flat(model), is_masked(token)
    best: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
    for ch in token:
        letters = readings(ch, masked)
        droppable = not ch.isalpha()
        after: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
        get = after.get
        for (a, b, last), (score, path) in best.items():
            row = (a * CLASSES + b) * CLASSES
            for out, c, cost in letters:
                value = score + cost + flat[row + c]
                held = get((b, c, out))
                if held is None or value > held[0]:
                    after[b, c, out] = (value, (path, out))
                if out == last:
                    value = score + cost + REPEATED
                    held = get((a, b, last))
                    if held is None or value > held[0]:
                        after[a, b, last] = (value, path)
            if droppable and path:
                value = score + DROPPED
                held = get((a, b, last))
                if held is None or value > held[0]:
                    after[a, b, last] = (value, path)
        best = after
    ends = [(score + flat[(a * CLASSES + b) * CLASSES], path) for (a, b, _), (score, path) in best.items()]
    top = max(score for score, _ in ends)
    return max(_text(path) for score, path in ends if score == top)


def _text(path: tuple | None) -> str:
    out = []
    while path:
        path, ch = path
        out.append(ch)
    return "".join(reversed(out))


def restored(token: str, model) -> set[str]:
    """The words that a lower-case token may be: itself, and its decoded form if it is disguised."""
    bare = token.strip(_EDGES)
    if not bare:
        return set()
    if bare.isalpha():
        words = {bare}
        if not _repeats(bare):
            return words
        if _TRIPLE.search(bare):
            words.add(decode(bare, model))
    else:
        parts = _LETTERS.findall(bare)
        if not parts and not any(c in LEET for c in bare):
            return set()
        words = set(parts)
        words.update(_LETTERS.findall(decode(bare.rstrip("!"), model)))
    return words | {_RUN.sub(r"\1", w) for w in words if _repeats(w)}


def _repeats(word: str) -> bool:
    """Whether a character follows itself."""
    return True in map(eq, word, word[1:])


def _set_apart(low: str) -> Iterator[str]:
    """Words of a lower-case text whose letters are set apart, without what stands between these."""
    if _MAYBE_APART.search(low):
        for apart in _APART.finditer(low):
            yield re.sub(r"[ ._*-]", "", apart[0])


class Words:
    """Restored words of tokens, remembered while a task goes on."""

    def __init__(self, model):
        self.model = _flat(model)
        self.known: dict[str, frozenset[str]] = {}

    def of(self, text: str) -> set[str]:
        low = text.lower()
        tokens = set(low.split())
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for token in tokens:
            if token not in self.known:
                self.known[token] = frozenset(restored(token, self.model))
        words = set().union(*map(self.known.__getitem__, tokens)) if tokens else set()
        for letters in _set_apart(low):
            words |= restored(decode(letters, self.model), self.model)
        return words


def pieces_of(word: Column) -> Column:
    """A word's marked whole, its marked beginnings of four to six letters, its inner strings of five."""
    starts = [
        F.when(F.length(word) > k, F.concat(F.lit("^"), F.substring(word, 1, k))) for k in (4, 5, 6)
    ]
    inner = F.when(
        F.length(word) > 5,
        F.transform(F.sequence(F.lit(2), F.length(word) - 4), lambda i: F.substring(word, i, F.lit(5))),
    ).otherwise(F.array().cast("array<string>"))
    whole = F.concat(F.lit("^"), word, F.lit("$"))
    return F.array_compact(F.array_distinct(F.concat(F.array(whole, *starts), inner)))


def _pieces(word: str) -> list[str]:
    """``pieces_of`` for one word in a task."""
    return [
        f"^{word}$",
        *[f"^{word[:k]}" for k in (4, 5, 6) if len(word) > k],
        *[word[i : i + 5] for i in range(1, len(word) - 4)],
    ]


def training(documents: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """``text, toxic, fold`` of the labelled documents that are learned from, ``most`` of them.

    These are rows whose crc32 of the doc_id as text leaves no 2 modulo 4. A doc_id with
    several labels is toxic if one of them says so; null ids and labels teach nothing.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
        .dropna()
        .filter(F.pmod(crc, F.lit(4)) != 2)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))
    )
    drawn = known.orderBy(F.xxhash64("doc_id", F.lit("drawn")), "doc_id").limit(most)
    rows = documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return rows.join(F.broadcast(drawn), "doc_id").select("text", "toxic", "fold")


def weigh(train: DataFrame, model: np.ndarray) -> list[dict[str, float]]:
    """Pieces and their lower bounds: without fold 0, without fold 1, and of all.

    The unit is a distinct line, so that copies of a document do not make its words sure.
    """
    lines = train.select("toxic", "fold", F.explode(F.split("text", "\n")).alias("line")).distinct()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model)
        schema = pa.schema([("word", pa.string()), *[(c, pa.int64()) for c in ("c0", "t0", "c1", "t1")]])
        counts = [Counter() for _ in range(4)]

        def rows() -> Iterator[tuple]:
            for word in set().union(*counts):
                yield (word, *[c[word] for c in counts])

        for toxic, fold, line in rows_of(batches, "toxic", "fold", "line"):
            counts[2 * fold + (toxic > 0)].update(words.of(line))
            if sum(map(len, counts)) > REMEMBERED:
                yield from in_chunks(rows(), schema, 10_000)
                counts = [Counter() for _ in range(4)]
        yield from in_chunks(rows(), schema, 10_000)

    sums = [F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")]
    by_word = lines.mapInArrow(count, "word string, c0 long, t0 long, c1 long, t1 long").groupBy("word").agg(*sums)
    by_piece = (
        by_word.select(F.explode(pieces_of(F.col("word"))).alias("piece"), "c0", "t0", "c1", "t1")
        .groupBy("piece")
        .agg(*sums)
        .filter("t0 + t1 > 1")
    )

    def bound(toxic: Column, clean: Column) -> Column:
        n, z2 = toxic + clean, WIDTH**2
        share = toxic / n
        middle = share + z2 / (2 * n)
        width = WIDTH * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))
        return F.when(n > 0, (middle - width) / (1 + z2 / n)).otherwise(0.0)

    c0, t0, c1, t1 = (F.col(c) for c in ("c0", "t0", "c1", "t1"))
    bounds = {"without0": bound(t1, c1), "without1": bound(t0, c0), "every": bound(t0 + t1, c0 + c1)}
    sure = written(
        by_piece.select("piece", *[b.alias(k) for k, b in bounds.items()]).filter(
            F.greatest(*bounds) >= SURE
        ),
        "pieces",
    )
    # Their number is bounded by that of the labelled documents, not by the corpus.
    rows = sure.collect()
    return [{r["piece"]: r[k] for r in rows if r[k] >= SURE} for k in bounds]


class _Judged(dict):
    """The value of a token by look-up, 0 if it is not sure."""

    def __init__(self, judge):
        super().__init__()
        self.judge = judge

    def __missing__(self, token: str) -> float:
        value = self[token] = self.judge(token)
        return value


class Scorer:
    """A document's three surest words and its length as levels 0 to ``LEVELS`` - 1.

    The more words a text has, the likelier one of them looks sure by chance.
    """

    def __init__(self, sure: dict[str, float], model):
        self.model = _flat(model)
        # Pieces by their kind: whole words, beginnings, inner strings.
        self.words = {p[1:-1]: v for p, v in sure.items() if p[0] == "^" and p[-1] == "$"}
        self.starts = {p[1:]: v for p, v in sure.items() if p[0] == "^" and p[-1] != "$"}
        self.inner = {p: v for p, v in sure.items() if p[0] != "^"}
        # What most words are passed over by.
        self.fours = {p[:4] for p in self.starts}
        self.inside = self.inner.keys()
        # Words that count as a whole, and what they may begin with when they are cut by blanks.
        self.whole = {w: v for w, v in self.words.items() if len(w) > 3}
        self.heads = {w[:k] for w in self.whole for k in range(1, len(w))}
        # Tokens that were judged, and those of them that may begin a cut word.
        self.known = _Judged(self._judge)
        self.begin: set[str] = set()

    def _cut(self, tokens: list[str]) -> Iterator[float]:
        """Of words in several tokens, at least one of them longer than a letter."""
        for i in [i for i, token in enumerate(tokens) if token in self.begin]:
            head = tokens[i].lstrip(_EDGES)
            longest, at = len(head), i + 1
            while head in self.heads and at < len(tokens):
                bare = tokens[at].rstrip(_ENDS)
                longest = max(longest, len(bare))
                if longest > 1 and head + bare in self.whole:
                    yield self.whole[head + bare]
                head, at = head + tokens[at], at + 1

    def _word(self, word: str) -> float:
        size, starts, inner = len(word), self.starts, self.inner
        best = self.words.get(word, 0.0)
        if size > 4 and word[:4] in self.fours:
            for k in (4, 5, 6)[: size - 4]:
                best = max(best, starts.get(word[:k], 0.0))
        if size > 5 and inner:
            parts = [word[i : i + 5] for i in range(1, size - 4)]
            if not self.inside.isdisjoint(parts):
                best = max(best, *[inner.get(p, 0.0) for p in parts])
        return best

    def _token(self, token: str) -> float:
        return max(map(self._word, restored(token, self.model)), default=0.0)

    def _judge(self, token: str) -> float:
        if token.lstrip(_EDGES) in self.heads:
            self.begin.add(token)
        return self._token(token)

    def levels(self, text: str) -> tuple[int, ...]:
        low = text.lower()
        in_order = low.split()
        tokens = set(in_order)
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.begin.clear()
        found = [v for v in map(self.known.__getitem__, tokens) if v]
        if not self.begin.isdisjoint(tokens):
            found += self._cut(in_order)
        for letters in _set_apart(low):
            found.append(self._token(decode(letters, self.model)))
        top = [*heapq.nlargest(3, found), 0.0, 0.0, 0.0][:3]
        return (*(min(LEVELS - 1, int(v * LEVELS)) for v in top), min(LEVELS - 1, len(tokens).bit_length()))


def _inputs(levels: np.ndarray) -> np.ndarray:
    x = levels / (LEVELS - 1)
    return np.column_stack([np.ones(len(x)), x, x**2, x[:, :1] * x[:, 3:]])


def fit(levels: np.ndarray, toxic: np.ndarray, n: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression on counted levels by Newton steps; the intercept is not shrunk."""
    x = _inputs(levels)
    w = np.zeros(x.shape[1])
    shrink = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (toxic - p)) - shrink @ w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + shrink, slope)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """What scoring needs: character model, sure pieces, weights. Its size has fixed bounds."""

    def __init__(self, characters: np.ndarray, sure: dict[str, float], weights: np.ndarray, fitted: bool = True):
        self.characters, self.sure, self.weights, self.fitted = characters, sure, weights, fitted

    def score(self, levels: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_inputs(levels) @ self.weights, -30, 30)))


def learn(documents: DataFrame, labels: DataFrame) -> Model:
    """Fit on all labelled rows that may be learned from; without any, every score is 0.5."""
    characters = character_model(documents)
    train = training(documents, labels)
    without0, without1, every = weigh(train, characters)

    shared = documents.sparkSession.sparkContext.broadcast((without0, without1, characters))

    def levels(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *folds, model = shared.value
        flat = _flat(model)
        scorers = [Scorer(sure, flat) for sure in folds]
        cells = Counter(
            (*scorers[fold].levels(text), int(toxic > 0))
            for text, toxic, fold in rows_of(batches, "text", "toxic", "fold")
        )
        schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "c", "length", "toxic", "n")])
        yield from in_chunks(((*cell, n) for cell, n in cells.items()), schema)

    cells = (
        train.mapInArrow(levels, "a long, b long, c long, length long, toxic long, n long")
        .groupBy("a", "b", "c", "length", "toxic")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    table = np.array([tuple(r) for r in cells], np.float64).reshape(-1, 6)
    fitted = len(set(table[:, 4].tolist())) == 2
    return Model(characters, every, fit(table[:, :4], table[:, 4], table[:, 5]), fitted)


def score(documents: DataFrame, model: Model, threshold: float = TOXIC) -> DataFrame:
    """``documents`` with ``toxicity`` (0 to 1) and ``toxic``; from the text alone. Null text is empty.

    Columns of these names are replaced.
    """
    rows = documents.drop("toxicity", "toxic")
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m.sure, m.characters)
        for batch in batches:
            levels = [scorer.levels(t.as_py() or "") for t in batch.column("text")]
            p = m.score(np.array(levels, np.float64).reshape(-1, 4))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p, pa.float64()), pa.array(p >= threshold)], [*names, "toxicity", "toxic"]
            )

    added = StructType.fromDDL("toxicity double, toxic boolean")
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *added.fields]))


def acceptable(documents: DataFrame, labels: DataFrame, threshold: float = TOXIC) -> DataFrame:
    """``documents`` without those that a model fitted on them and ``labels`` calls toxic.

    If the labels that may be learned from are not of both kinds, nothing can be told and all stay.
    """
    model = learn(documents, labels)
    if not model.fitted:
        return documents
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m.sure, m.characters)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                levels = [scorer.levels(t.as_py() or "") for t in part.column("text")]
                yield part.filter(pa.array(m.score(np.array(levels, np.float64).reshape(-1, 4)) < threshold))
        # The worker waits for its next task; what it does not need goes back to the machine.
        del scorer
        pa.default_memory_pool().release_unused()

    return documents.mapInArrow(run, documents.schema)
