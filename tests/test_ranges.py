"""Fixed byte ranges: line numbers and array elements do not depend on how files are cut."""

import gzip
import io
import json
import random

import numpy as np
import pytest

from turnwise.sources import ranges, readers


def odd_lines(seed: int, n: int) -> bytes:
    rnd = random.Random(seed)
    ends = [b"\n", b"\n", b"\r\n"]
    out = b"".join(
        rnd.choice([b"", b"x", "é東🎉".encode() * rnd.randrange(9), b"y" * rnd.randrange(60)]) + rnd.choice(ends) for _ in range(n)
    )
    return out if seed % 2 else out + b"no line end"


@pytest.mark.parametrize("seed", range(6))
def test_lines_of_ranges_are_the_lines_of_the_file(seed):
    data = odd_lines(seed, 80)
    want = data.split(b"\n")
    want = want if want[-1] else want[:-1]
    for block in (1, 7, 64, 10**6):
        for chunk in (1, 5, 4096):
            got = []
            for at in range(0, len(data), block):
                for lines in ranges.lines_of(io.BytesIO(data), at, min(len(data), at + block), chunk):
                    got += lines
            assert got == want


def odd_value(rnd: random.Random, deep: int = 0):
    kind = rnd.randrange(7 if deep < 3 else 4)
    if kind < 3:
        return rnd.choice(["", "a,b]", 'q"u\\', "\\", '\\"', "é東🎉", "[{", "}]", "\n", "x" * 30, "\\\\,"])
    if kind == 3:
        return rnd.choice([None, 1.5, -3, True])
    if kind == 4:
        return [odd_value(rnd, deep + 1) for _ in range(rnd.randrange(4))]
    return {rnd.choice(["a", 'k"', "[", "é"]): odd_value(rnd, deep + 1) for _ in range(rnd.randrange(4))}


@pytest.mark.parametrize("seed", range(12))
def test_elements_of_blocks_are_the_elements_of_the_array(seed):
    rnd = random.Random(seed)
    rows = [odd_value(rnd) for _ in range(rnd.randrange(0, 25))]
    data = json.dumps(rows, ensure_ascii=seed % 2 == 0, indent=rnd.choice([None, 1])).encode()
    data = b" \n" * (seed % 3) + data + b"\n" * (seed % 2)
    for block in (1, 4, 13, 100, 10**6):
        for chunk in (1, 6, 4096):
            inside = escaped = False
            depth, got = 0, []
            for at in range(0, len(data), block):
                end = min(len(data), at + block)
                state = ranges.JsonState(inside, escaped, depth)
                got += [json.loads(t) for _, t in ranges.elements_of(io.BytesIO(data), at, end, state, chunk) if t.strip()]
                scan = ranges.JsonState(inside, escaped, depth)
                for i in range(at, end, chunk):
                    scan.take(np.frombuffer(data[i : min(end, i + chunk)], np.uint8))
                inside, escaped, depth = scan.inside, scan.escaped, scan.depth
            assert got == rows


def test_numbers_stay_when_splits_are_planned_anew(spark, tmp_path):
    n = 20_000
    (tmp_path / "a.jsonl").write_text("".join(f'{{"id":"p{i}","prompt":"{"t" * (i % 50)}"}}\n' for i in range(n)))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    manifest, total = ranges.line_manifest(spark, str(tmp_path), block=50_000)
    lines = ranges.read_lines(spark, manifest, block=50_000)
    good, rejects = readers.read_prompts(spark, str(tmp_path))
    try:
        for size, cores in (("1m", "4"), ("10k", "7"), ("128m", "1")):
            spark.conf.set(key, size)
            spark.conf.set("spark.sql.files.minPartitionNum", cores)
            rows = lines.collect()
            assert total == n and lines.rdd.getNumPartitions() > 10
            assert sorted((r.line_no, r.position, json.loads(r.line)["id"]) for r in rows) == [(i + 1, i, f"p{i}") for i in range(n)]
            assert {(r.line_no, r.id) for r in good.collect()} == {(i + 1, f"p{i}") for i in range(n)}
            assert rejects.count() == 0
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_slices_open_only_what_they_need(spark, tmp_path):
    for f in range(4):
        (tmp_path / f"part-{f}.jsonl").write_text("".join(f'{{"question_id":{100 * f + i},"turns":["t"]}}\n' for i in range(100)))
    manifest, total = ranges.line_manifest(spark, str(tmp_path), block=400)
    assert total == 400
    part = ranges.read_lines(spark, manifest, 150, 170, block=400)
    assert part.rdd.getNumPartitions() < 5
    assert sorted(r.position for r in part.collect()) == list(range(150, 170))
    assert ranges.read_lines(spark, manifest, 500, 600).count() == 0
    for begin, end in ((None, None), (5, None), (-7, None), (390, 999), (10, 3), (-20, -10)):
        got = sorted(r.question_id for r in readers.read_questions(spark, str(tmp_path), begin, end).collect())
        assert got == list(range(400))[begin:end]


def test_compressed_and_empty_files(spark, tmp_path):
    with gzip.open(tmp_path / "b.txt.gz", "wt") as out:
        out.write("one\ntwo\n\nfour")
    (tmp_path / "a.txt").write_text("")
    rows = readers.numbered_lines(spark, str(tmp_path)).collect()
    assert [(r.line_no, r.line) for r in sorted(rows, key=lambda r: r.line_no)] == [(1, "one"), (2, "two"), (3, ""), (4, "four")]


def test_json_arrays_as_spark_reads_them_whole(spark, tmp_path):
    rnd = random.Random(5)
    schema = "a string, b array<struct<c:string,d:bigint>>"
    for f in range(3):
        rows = [
            {"a": odd_value(rnd, 3), "b": [{"c": rnd.choice(['"', "\\", "],[", "é🎉"]) * rnd.randrange(50), "d": i}] * (i % 3)}
            for i in range(300)
        ]
        (tmp_path / f"{f}.json").write_text(json.dumps(rows, ensure_ascii=f == 0, indent=f or None))
    (tmp_path / "empty.json").write_text(" [ ] ")
    (tmp_path / "single.json").write_text('{"a": "alone"}')
    with gzip.open(tmp_path / "z.json.gz", "wt") as out:
        out.write('[{"a": "packed"}, {"a": "twice"}]')
    want = spark.read.schema(schema).option("multiLine", True).json(str(tmp_path)).collect()
    got = readers.read_json_array(spark, str(tmp_path), schema, block=1000)
    assert got.rdd.getNumPartitions() > 20
    assert sorted(map(str, got.collect())) == sorted(map(str, want)) and len(want) == 903
