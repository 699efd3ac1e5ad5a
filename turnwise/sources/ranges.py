"""Files in fixed byte ranges: numbered lines, and the elements of one large JSON array.

Spark cuts files anew whenever cores or split sizes change, so nothing that is counted per split
can be used in a later job. Here the ranges are written down first, with what is known about
each (its first line number; the depth and the string state at its first byte), and a data
source reads exactly these ranges: one task takes one range, or several short ones.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from turnwise.session import scratch_path, ship

#: Bytes of a range.
BLOCK = 32 << 20
_CHUNK = 4 << 20
_WHOLE = 1 << 62
_CODECS = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd", ".lz4": "lz4"}
_LF, _CR, _QUOTE, _BACKSLASH = b"\n", 13, 34, 92

_SHAPES = {
    "counts": "file string, begin bigint, end bigint, lines bigint",
    "lines": "file string, line_no bigint, position bigint, line string",
    "states": "file string, begin bigint, end bigint, first int, inside array<boolean>, escaped array<boolean>, depth array<bigint>",
    "elements": "file string, at bigint, value string",
}


def _local(uri: str) -> str | None:
    if "://" not in uri and not uri.startswith("file:"):
        return uri
    if uri.startswith("file:"):
        path = "/" + uri[5:].lstrip("/")
        return path if os.path.exists(path) else unquote(path)
    return None


def _codec(uri: str) -> str | None:
    return _CODECS.get(os.path.splitext(uri)[1])


def open_stream(uri: str, packed: bool = False):
    """A binary stream of a file in a local or remote store; compressed files are unpacked unless they stay ``packed``."""
    path = _local(uri)
    if path is not None:
        raw = pa.OSFile(path)
    else:
        from pyarrow.fs import FileSystem

        store, path = FileSystem.from_uri(uri)
        raw = store.open_input_file(path)
    codec = None if packed else _codec(uri)
    return pa.CompressedInputStream(raw, codec) if codec else raw


def can_open(uri: str) -> bool:
    """Whether ``open_stream`` knows the store of ``uri``."""
    if _local(uri) is not None:
        return True
    from pyarrow.fs import FileSystem

    try:
        FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, OSError):
        return False
    return True


def _manifest_rows(uri: str) -> list[dict]:
    import pyarrow.dataset as ds

    path = _local(uri)
    if path is not None:
        return ds.dataset(path, format="parquet").to_table().to_pylist()
    from pyarrow.fs import FileSystem

    store, path = FileSystem.from_uri(uri)
    return ds.dataset(path, format="parquet", filesystem=store).to_table().to_pylist()


def lines_of(stream, begin: int, end: int, chunk: int = _CHUNK) -> Iterator[list[bytes]]:
    """The lines that start in ``[begin, end)`` of a stream, some at a time, without their line ends."""
    at, held = begin, b""
    if begin:
        # A line starts here only if the byte before ends one.
        stream.seek(begin - 1)
        at = begin - 1
        while True:
            data = stream.read(chunk)
            if not data:
                return
            cut = data.find(_LF)
            if cut >= 0:
                at += cut + 1
                held = data[cut + 1 :]
                break
            at += len(data)
    while at < end:
        data = stream.read(chunk)
        parts = (held + data).split(_LF) if data or held else [b""]
        if not data:
            # Lines that were already held, and the last one if no line end closes the file.
            parts = parts if parts[-1] else parts[:-1]
            starts, out = at, []
            for p in parts:
                if starts >= end:
                    break
                out.append(p)
                starts += len(p) + 1
            if out:
                yield out
            return
        held = parts.pop()
        size = sum(map(len, parts)) + len(parts)
        if at + size <= end:
            at += size
            if parts:
                yield parts
            continue
        out = []
        for p in parts:
            if at >= end:
                break
            out.append(p)
            at += len(p) + 1
        if out:
            yield out


class JsonState:
    """Where a scan of JSON text stands: inside a string, behind a backslash, how deep."""

    _STRUCTURE = np.zeros(256, bool)
    _STRUCTURE[list(b"[]{},")] = True
    _STEP = np.zeros(256, np.int64)
    _STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1

    def __init__(self, inside: bool = False, escaped: bool = False, depth: int = 0):
        self.inside, self.escaped, self.depth = inside, escaped, depth

    def take(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Go over ``data``; returns places and bytes of structural signs outside strings and the depth behind them."""
        quotes = np.flatnonzero(data == _QUOTE)
        slashes = np.flatnonzero(data == _BACKSLASH)
        if len(slashes) or self.escaped:
            # Length of the run of backslashes that ends at each place of one.
            new = np.r_[True, np.diff(slashes) > 1] if len(slashes) else np.zeros(0, bool)
            first = slashes[np.maximum.accumulate(np.where(new, np.arange(len(slashes)), 0))] if len(slashes) else slashes
            run = slashes - first + 1 + (self.escaped & (first == 0))
            before = np.searchsorted(slashes, quotes - 1)
            behind = np.zeros(len(quotes), bool)
            if len(slashes):
                at = np.minimum(before, len(slashes) - 1)
                behind = (slashes[at] == quotes - 1) & (run[at] % 2 == 1)
            if self.escaped:
                behind |= quotes == 0
            quotes = quotes[~behind]
            if len(slashes) and slashes[-1] == len(data) - 1:
                escaped = bool(run[-1] % 2)
            else:
                escaped = self.escaped and not len(data)
            self.escaped = escaped
        places = np.flatnonzero(self._STRUCTURE[data])
        within = (np.searchsorted(quotes, places) + self.inside) % 2 == 1
        places = places[~within]
        signs = data[places]
        depth = self.depth + np.cumsum(self._STEP[signs])
        if len(depth):
            self.depth = int(depth[-1])
        self.inside = bool((self.inside + len(quotes)) % 2)
        return places, signs, depth


def elements_of(stream, begin: int, end: int, state: JsonState, chunk: int = _CHUNK) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the elements of a top-level array whose opening sign or comma is in ``[begin, end)``."""
    stream.seek(begin)
    at, pieces, place = begin, None, 0
    while at < end or pieces is not None:
        data = stream.read(chunk)
        if not data:
            return
        places, signs, depth = state.take(np.frombuffer(data, np.uint8))
        # Only the outermost bracket goes from depth 0 to 1.
        opens = ((signs == ord("[")) | (signs == ord(","))) & (depth == 1)
        marks = np.flatnonzero(opens | (signs == ord("]")) & (depth == 0))
        start = 0
        for p, starts in zip(places[marks].tolist(), opens[marks].tolist(), strict=True):
            if pieces is not None:
                yield place, b"".join([*pieces, data[start:p]])
                pieces = None
            if at + p >= end:
                return
            if starts:
                pieces, place, start = [], at + p, p + 1
        if pieces is not None:
            pieces.append(data[start:])
        at += len(data)


class RangePartition(InputPartition):
    def __init__(self, rows: list[dict]):
        self.rows = rows


class RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.give, self.manifest = options["give"], options["manifest"]
        self.begin, self.end = int(options.get("begin", 0)), int(options.get("end", _WHOLE))
        self.block = int(options.get("block", BLOCK))

    def partitions(self) -> list[RangePartition]:
        rows = sorted(_manifest_rows(self.manifest), key=lambda r: (r["file"], r["begin"]))
        if self.give == "lines":
            rows = [r for r in rows if r["position"] < self.end and r["position"] + r["lines"] > self.begin]
        out: list[list[dict]] = []
        room = 0
        for row in rows:
            size = row["end"] - row["begin"]
            if size > room or not out:
                out.append([])
                room = self.block
            out[-1].append(row)
            room -= size
        return [RangePartition(rows) for rows in out] or [RangePartition([])]

    def read(self, partition: RangePartition) -> Iterator[pa.RecordBatch]:
        for row in partition.rows:
            with open_stream(row["file"]) as stream:
                yield from getattr(self, "_" + self.give)(row, stream)

    def _counts(self, row: dict, stream) -> Iterator[pa.RecordBatch]:
        n = sum(map(len, lines_of(stream, row["begin"], row["end"])))
        yield _batch("counts", [[row["file"]], [row["begin"]], [row["end"]], [n]])

    def _lines(self, row: dict, stream) -> Iterator[pa.RecordBatch]:
        done = 0
        for lines in lines_of(stream, row["begin"], row["end"]):
            first = row["position"] + done
            low, high = max(0, self.begin - first), max(0, min(len(lines), self.end - first))
            if low < high:
                texts = [_text(line) for line in lines[low:high]]
                at = np.arange(done + low, done + high, dtype=np.int64)
                columns = [[row["file"]] * len(texts), row["first_line"] + at, row["position"] + at, texts]
                yield _batch("lines", columns)
            done += len(lines)
            if row["position"] + done >= self.end:
                return

    def _states(self, row: dict, stream) -> Iterator[pa.RecordBatch]:
        """How each state at the first byte ends: outside a string, inside one, behind a backslash."""
        states = [JsonState(), JsonState(True), JsonState(True, True)]
        stream.seek(row["begin"])
        left, first = row["end"] - row["begin"], None
        while left and (data := stream.read(min(_CHUNK, left))):
            left -= len(data)
            if first is None:
                first = next(iter(data.lstrip()[:1]), None)
            for state in states:
                state.take(np.frombuffer(data, np.uint8))
        ends = [[getattr(s, name) for s in states] for name in ("inside", "escaped", "depth")]
        yield _batch("states", [[row["file"]], [row["begin"]], [row["end"]], [first], *[[e] for e in ends]])

    def _elements(self, row: dict, stream) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        state = JsonState(row["inside"], row["escaped"], row["depth"])
        for at, text in elements_of(stream, row["begin"], row["end"], state):
            text = text.strip()
            if text:
                held.append((row["file"], at, text.decode("utf-8", "replace")))
                size += len(text)
            if size > _CHUNK:
                yield _batch("elements", list(zip(*held, strict=True)))
                held, size = [], 0
        if held:
            yield _batch("elements", list(zip(*held, strict=True)))


_ARROW = {
    "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(),
    "array<boolean>": pa.list_(pa.bool_()), "array<bigint>": pa.list_(pa.int64()),
}


def _text(line: bytes) -> str:
    if line[-1:] == b"\r":
        line = line[:-1]
    return line.decode("utf-8", "replace")


def _batch(give: str, columns: list) -> pa.RecordBatch:
    fields = [f.split(" ") for f in _SHAPES[give].split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields]
    )


class RangeSource(DataSource):
    """``spark.read.format("turnwise_ranges")`` with options ``give`` and ``manifest``."""

    @classmethod
    def name(cls) -> str:
        return "turnwise_ranges"

    def schema(self) -> str:
        return _SHAPES[self.options["give"]]

    def reader(self, schema) -> RangeReader:
        return RangeReader(dict(self.options))


def _read(spark: SparkSession, give: str, manifest: str, **options) -> DataFrame:
    ship(spark)
    spark.dataSource.register(RangeSource)
    return spark.read.format("turnwise_ranges").options(give=give, manifest=manifest, **options).load()


def _stored(spark: SparkSession, rows: Iterable[tuple], schema: str) -> str:
    path = scratch_path(spark, "ranges")
    spark.createDataFrame(list(rows), schema).coalesce(1).write.parquet(path)
    return path


def files_of(spark: SparkSession, path: str | list[str]) -> list[tuple[str, int]]:
    """Name and length of all files that Spark would read for ``path``, in order of their names."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    return sorted(tuple(r) for r in listed.collect())


def _ranges(files: list[tuple[str, int]], block: int) -> list[tuple[str, int, int]]:
    out = []
    for name, length in files:
        if _codec(name):
            out.append((name, 0, _WHOLE))
        else:
            out += [(name, at, min(length, at + block)) for at in range(0, length, block)]
    return out


def line_manifest(spark: SparkSession, path: str | list[str], block: int = BLOCK) -> tuple[str, int]:
    """A stored table (file, begin, end, first_line, position, lines) of all ranges, and the number of lines.

    One pass counts the lines of each range; on the driver is one row per range. ``first_line``
    counts from 1 in each file, ``position`` from 0 over all files in order of their names.
    """
    ranges = _stored(spark, _ranges(files_of(spark, path), block), "file string, begin bigint, end bigint")
    counted = sorted(_read(spark, "counts", ranges, block=block).collect(), key=lambda r: (r.file, r.begin))
    rows, position, first, file = [], 0, 1, None
    for r in counted:
        if r.file != file:
            file, first = r.file, 1
        rows.append((r.file, r.begin, r.end, first, position, r.lines))
        first += r.lines
        position += r.lines
    shape = "file string, begin bigint, end bigint, first_line bigint, position bigint, lines bigint"
    return _stored(spark, rows, shape), position


def read_lines(spark: SparkSession, manifest: str, begin: int = 0, end: int = _WHOLE, block: int = BLOCK) -> DataFrame:
    """``file, line_no, position, line`` of the lines at positions ``[begin, end)``; ranges outside are not opened."""
    return _read(spark, "lines", manifest, begin=begin, end=end, block=block)


def array_elements(spark: SparkSession, path: str | list[str], block: int = BLOCK) -> tuple[DataFrame | None, list[str]]:
    """The elements (file, at, value) of JSON arrays, and the files that hold no plain array.

    What a range's first byte is part of depends on all bytes before it. One pass finds, for
    each range, how it would end from each of three states (outside a string, inside, behind a
    backslash); going over these in order, one row per range, gives every range its true state
    and depth. An element belongs to the range with the bracket or comma before it.
    """
    files = files_of(spark, path)
    plain = [f for f in files if not _codec(f[0])]
    ranges = _stored(spark, _ranges(plain, block), "file string, begin bigint, end bigint")
    found = sorted(_read(spark, "states", ranges, block=block).collect(), key=lambda r: (r.file, r.begin))
    rows, others, file = [], {f for f, _ in files} - {f for f, n in plain if n}, None
    inside = escaped = False
    depth = 0
    first = None
    for r in found:
        if r.file != file:
            file, inside, escaped, depth, first = r.file, False, False, 0, None
        first = r.first if first is None else first
        if first is not None and first != ord("["):
            others.add(r.file)
        rows.append((r.file, r.begin, r.end, inside, escaped, depth))
        state = (2 if escaped else 1) if inside else 0
        inside, escaped, depth = r.inside[state], r.escaped[state], depth + r.depth[state]
    rows = [r for r in rows if r[0] not in others]
    empty = {f for f, n in plain if not n}
    if not rows:
        return None, sorted(others - empty)
    manifest = _stored(spark, rows, "file string, begin bigint, end bigint, inside boolean, escaped boolean, depth bigint")
    return _read(spark, "elements", manifest, block=block), sorted(others - empty)
