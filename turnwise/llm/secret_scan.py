"""Secrets: fixed forms, and strings in sensitive places that a primed compressor cannot shorten.

One scan over the texts finds the fixed forms and the candidates: strings around a sensitive word.
A zstandard dictionary holds the words of installed vocabularies and the most frequent
identifiers of all whole texts. A candidate's novelty is the number of bytes that it adds to its
compressed surroundings; it is reported if it adds about as many as random strings of the
same length and kinds of characters do. Names, paths and compounds of known words add far fewer.
Strings of letters may be words that the dictionary lacks; they must be new to a letter model of
the corpus too. Dates, numbers, addresses and ids of plain forms are no secrets.
"""

from __future__ import annotations

import bisect
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import in_chunks, rows_of, tokenizer_path
from turnwise.session import written

#: In the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "novel")
#: Bytes that a secret adds, as a share of what random strings like it add; how many are drawn.
NOVELTY, DRAWN = 0.85, 8
#: Bytes of the corpus' identifiers in the dictionary: a parameter of the model, whatever the corpus' size.
IDENTIFIER_BYTES = 400_000
#: Installed vocabularies whose words are in the dictionary.
VOCABULARIES = ("piece_bpe_32k.model", "word_bpe_49k.json")
AROUND = 64
#: Characters from a sensitive word to the strings that are judged for it; one line break may be among them.
REACH = 96
#: Characters from a string to a sensitive word behind it, on the same line.
AHEAD = 40
#: Bytes per letter under the letter model from which a string is no word: of 12 random letters 99.5
#: in 100 have 0.73 or more, the long words of the test tables 0.58 or less.
UNLIKE_WORDS = 0.72

# Fixed patterns of the base forms. Letters of the names count in either case, ASCII only.
_ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
# Sensitive words, and the strings that are judged within their reach.
_WORDS = ("passw", "passphrase", "passcode", "pwd", "secret", "token", "apikey", "api_key", "api-key", "auth", "bearer",
          "credential", "private", "access", "signature", "client", "cookie", "login", "encryption", "pin")
_SENSITIVE = re.compile(
    r"(?ai)passw|passphrase|passcode|pwd|secret|token|api[_-]?key|auth|bearer|credential|private|access|signature"
    r"|client|cookie|login|encryption|\bpin\b"
)
_STRING = re.compile(r"[A-Za-z0-9+/_=.~!#$%&*@^?-]{12,}")
_ALNUM = re.compile(r"[A-Za-z0-9]")
_PART = re.compile(r"[A-Za-z0-9+/_.~!#$%&*@^?-]+=*")
_END = "!?.&#"
LEAST = 12
# Fixed: plain forms that are no secrets. Numbers with signs (dates, telephones, versions, addresses of hosts),
# times, ids of five groups, a word with a number.
_PLAIN = re.compile(
    r"""(?ai)[\d+./_#:~-]+|\d{4}-\d\d-\d\d[t_][\d.+-]*z?|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}
    |[a-z]{2,12}[-_/#.]?\d[\d_/#.-]*""".replace("\n    ", "")
)
# Paths and addresses, and names of hosts and mail boxes: judged part by part.
_PATH = re.compile(r"(?ai)(?:[a-z][a-z0-9+]*:)?//|~?/|\.{1,2}/|[a-z0-9.-]+\.[a-z]{2,6}/|(?-i:[a-z0-9_.-]+/[a-z0-9_.-]+/)")
_HOST = re.compile(r"(?a)[\w-]+(?:[.@][\w-]+)+")
_BETWEEN = re.compile(r"[^/.?&#@]+")
# What may stand between the strings of a list, or the lines of a key.
_GOES_ON = re.compile(r"[\s\"',;:|()\[\]{}<>\\]{1,8}")
#: Lengths of identifiers that are counted, and words that a task counts before it sends their sums.
_SHORT, _LONG, COUNTED = 4, 24, 300_000
_NAMES = bytes(c if chr(c).isalpha() and c < 128 or c == 0x5F else 0x20 for c in range(256))
_LETTER = np.zeros(256, np.uint8)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = np.arange(1, 27)
# Letters in one case, with signs; names made of words that begin with a capital.
_WORDLIKE = re.compile(r"(?=.*[A-Za-z])(?:[^A-Z0-9]*|[^a-z0-9]*|(?:[A-Z]{0,3}[a-z]{3,}[^A-Za-z0-9]?)+)")
_ALPHABET, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
_CANDIDATE = pa.struct(
    [("start", pa.int64()), ("stop", pa.int64()), ("value", pa.string()), ("before", pa.string()), ("after", pa.string())]
)
_SCAN = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(_SPAN)), ("candidates", pa.list_(_CANDIDATE))])
_SPAN_DDL = "array<struct<kind:string,start:long,stop:long>>"
_SCAN_DDL = (
    f"doc_id long, base {_SPAN_DDL}, "
    "candidates array<struct<start:long,stop:long,value:string,before:string,after:string>>"
)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed forms, by start and then kind; whole matches, in code points."""
    low = text.lower()
    out = []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def parts(start: int, run: str) -> list[tuple[int, str]]:
    """What is judged of an unbroken string: what stands between its ``=`` signs, which may end a part.

    If all of that is short, the string behind the first sign, or else all of it. Paths,
    addresses and names of hosts are judged between their separators.
    """
    found = [(start + m.start(), m[0]) for m in _PART.finditer(run)]
    long = [(at, part) for at, part in found if len(part) >= LEAST]
    if not long and found:
        stop = start + len(run)
        long = [(at, run[at - start :]) for at, _ in found[1::-1] if stop - at >= LEAST][:1]
    out = []
    for at, part in long:
        if _PATH.match(part) or _HOST.fullmatch(part):
            inner = [(at + m.start(), m[0]) for m in _BETWEEN.finditer(part)]
        else:
            inner = [(at + len(part) - len(part.lstrip(_END)), part.strip(_END))]
        out += [(a, p) for a, p in inner if len(p) >= LEAST]
    return out


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int, str, str, str]]:
    """Strings with letters or digits around a sensitive word, outside ``taken`` spans.

    Every string within reach of a sensitive word before it, or on its line soon behind it, is
    judged, whatever stands between them, and so are those that follow one without words
    between: the rest of a list or of a key's lines. Plain forms are passed over.
    """
    low = text.lower()
    if not any(w in low for w in _WORDS):
        return []
    words = [m.span() for m in _SENSITIVE.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    out, last = [], None
    for run in _STRING.finditer(text):
        for start, value in parts(run.start(), run[0]):
            stop = start + len(value)
            at = bisect.bisect_right(ends, start)
            reached = at and start - ends[at - 1] <= REACH and text.count("\n", ends[at - 1], start) <= 1
            if not reached:
                after = bisect.bisect_left(starts, stop)
                reached = after < len(starts) and starts[after] - stop <= AHEAD and "\n" not in text[stop : starts[after]]
            if not reached:
                between = last is not None and start - last <= 8 and text[last:start]
                if not between or not _GOES_ON.fullmatch(between) or between.count("\n") > 1:
                    continue
            last = stop
            if _ALNUM.search(value) and not _PLAIN.fullmatch(value) and not any(a < stop and start < b for _, a, b in taken):
                out.append((start, stop, value, text[max(0, start - AROUND) : start], text[stop : stop + AROUND]))
    return out


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            base = base_spans(text or "")
            yield (
                doc_id,
                [dict(zip(("kind", "start", "stop"), s, strict=True)) for s in base],
                [
                    dict(zip(("start", "stop", "value", "before", "after"), c, strict=True))
                    for c in candidates(text or "", base)
                ],
            )

    yield from in_chunks(rows(), _SCAN)


def _letters(text: str) -> np.ndarray:
    """1 to 26 for letters in either case, and 0 twice for what stands between words, before and after them."""
    c = _LETTER[np.frombuffer(f" {text} ".encode(errors="replace"), np.uint8)]
    c = c[(c > 0) | np.append(True, c[:-1] > 0)]
    return np.repeat(c, np.where(c == 0, 2, 1)).astype(np.int64)


def _trigrams(text: str) -> np.ndarray:
    c = _letters(text)
    return (c[:-2] * 27 + c[1:-1]) * 27 + c[2:]


def _count_letters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(27**3, np.int64)
    held, size = [], 0
    for (text,) in rows_of(batches, "text"):
        held.append(_STRING.sub(" ", text or ""))
        size += len(held[-1])
        if size > 1_000_000:
            total += np.bincount(_trigrams(" ".join(held)), minlength=27**3)
            held, size = [], 0
    total += np.bincount(_trigrams(" ".join(held)), minlength=27**3)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["trigram", "n"])


def letter_counts(documents: DataFrame, known: list[str]) -> np.ndarray:
    """Letter trigrams of all texts and of the ``known`` words; at most 27^3 sums are fetched.

    Strings that may be judged are left out: a key that stands in many texts is no word for that.
    """
    counted = documents.select("text").mapInArrow(_count_letters, "trigram long, n long")
    counts = np.bincount(_trigrams(" ".join(known)), minlength=27**3)
    for row in counted.groupBy("trigram").agg(F.sum("n").alias("n")).collect():
        counts[row["trigram"]] += row["n"]
    return counts


def vocabulary_words(paths: Sequence[str]) -> list[str]:
    """Words of four letters or more in installed vocabulary files, the most frequent last."""
    out: dict[str, None] = {}
    for path in paths:
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            found = [model.id_to_piece(i).lstrip("\u2581") for i in range(model.get_piece_size())]
        else:
            from tokenizers import Tokenizer

            listed = Tokenizer.from_file(path).get_vocab()
            found = [t.removesuffix("</w>") for t in sorted(listed, key=listed.get)]
        out |= dict.fromkeys(w.lower() for w in found[::-1] if len(w) >= _SHORT and w.isascii() and w.isalpha())
    return list(out)


class Letters:
    """How unlike words a string is, in bytes per letter."""

    def __init__(self, counts: np.ndarray):
        p = np.full(27**3, 0.01 / 27)
        for n, share in ((counts, 0.7), (counts.reshape(27, -1).sum(0), 0.2), (counts.reshape(-1, 27).sum(0), 0.09)):
            given = n.reshape(-1, 27)
            p += np.resize(share * given / np.maximum(given.sum(1, keepdims=True), 1), 27**3)
        self.bits = -np.log2(p)

    def is_key(self, value: str) -> bool:
        """No words by their letters; letters in both cases are left to the compressor's dictionary."""
        return bool(_WORDLIKE.fullmatch(value)) and self.unlike_words(value) >= UNLIKE_WORDS

    def unlike_words(self, value: str) -> float:
        return float(self.bits[_trigrams(value)].sum()) / 8 / sum(c.isalpha() for c in value)


def _count_names(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def sent() -> pa.RecordBatch:
        kept = [(w.decode(), n) for w, n in counts.items() if _SHORT <= len(w) <= _LONG]
        counts.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["name", "n"]
        )

    for (text,) in rows_of(batches, "text"):
        counts.update((text or "").encode().translate(_NAMES).lower().split())
        if len(counts) > COUNTED:
            yield sent()
    yield sent()


def identifiers(documents: DataFrame, size: int = IDENTIFIER_BYTES) -> list[str]:
    """The names met most often in all whole texts, ``size`` bytes of them, the most frequent last."""
    counted = documents.select("text").mapInArrow(_count_names, "name string, n long")
    names = counted.groupBy("name").agg(F.sum("n").alias("n")).filter("n > 1")
    top = names.orderBy(F.desc("n"), "name").limit(size // (_SHORT + 1)).select("name").collect()
    out, left = [], size
    for (name,) in top:
        left -= len(name) + 1
        if left < 0:
            break
        out.append(name)
    return out[::-1]


def novelty(primed: zstandard.ZstdCompressor, before: str, value: str, after: str) -> float:
    """Bytes that ``value`` adds to its compressed surroundings, per byte of its own; case does not count.

    A value with digits or in one case is measured without its own copies nearby: a key named twice is a key.
    """
    if any(c.isdigit() for c in value) or not value.isalpha() or value in (value.lower(), value.upper()):
        before, after = before.replace(value, ""), after.replace(value, "")
    before, value, after = before.lower(), value.lower(), after.lower()
    with_it = len(primed.compress(f"{before}{value}{after}".encode()))
    without = len(primed.compress(f"{before}{after}".encode()))
    return max(0, with_it - without) / len(value.encode())


def random_novelty(primed: zstandard.ZstdCompressor, before: str, value: str, after: str) -> float:
    """The mean novelty of random strings with letters, digits and signs where ``value`` has them."""
    rnd = random.Random(value)
    total = 0.0
    for _ in range(DRAWN):
        drawn = (rnd.choice(_ALPHABET) if c.isalpha() else rnd.choice(_DIGITS) if c.isdigit() else c for c in value)
        total += novelty(primed, before, "".join(drawn), after)
    return total / DRAWN


def compressor(names: list[str]) -> zstandard.ZstdCompressor:
    content = " ".join([*names, *_WORDS]).lower().encode()
    primer = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primer.precompute_compress(level=9)
    return zstandard.ZstdCompressor(level=9, dict_data=primer, write_content_size=False, write_dict_id=False)


def find(documents: DataFrame, vocabularies: Sequence[str] | None = None, threshold: float = NOVELTY) -> DataFrame:
    """Per row ``doc_id, base, spans``: spans (kind, start, stop) of the fixed forms, and all spans.

    ``vocabularies`` are paths of vocabulary files (by default the installed ``VOCABULARIES``),
    read on the driver alone. Null text is empty. Rows are judged each; repeated rows come
    out as often as they go in.
    """
    if vocabularies is None:
        vocabularies = [tokenizer_path(name) for name in VOCABULARIES]
    scanned = written(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, _SCAN_DDL), "scanned")
    known = vocabulary_words(vocabularies)
    letters = Letters(letter_counts(documents, known))
    # A key that stands in many texts is no name for that.
    names = [name for name in identifiers(documents) if len(name) < LEAST or letters.unlike_words(name) < UNLIKE_WORDS]
    shared = documents.sparkSession.sparkContext.broadcast([*known, *names])

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        primed = compressor(shared.value)
        schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(_SPAN)), ("spans", pa.list_(_SPAN))])

        def secret(c: dict) -> bool:
            if _WORDLIKE.fullmatch(c["value"]) and not letters.is_key(c["value"]):
                return False
            around = c["before"], c["value"], c["after"]
            return novelty(primed, *around) >= threshold * random_novelty(primed, *around)

        def rows() -> Iterator[tuple]:
            for doc_id, base, found in rows_of(batches, "doc_id", "base", "candidates"):
                novel = [{"kind": "novel", "start": c["start"], "stop": c["stop"]} for c in found if secret(c)]
                spans = sorted([*base, *novel], key=lambda s: (s["start"], KINDS.index(s["kind"])))
                yield doc_id, base, spans

        yield from in_chunks(rows(), schema)

    return scanned.mapInArrow(judge, f"doc_id long, base {_SPAN_DDL}, spans {_SPAN_DDL}")
