"""Growing files: ranges, appends, replaced heads and unfinished lines."""

import json
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import growing


@pytest.fixture(scope="module")
def source(spark):
    growing.register(spark)
    return lambda path, **o: spark.read.format("growing_lines").options(path=str(path), **o).load()


def got(df):
    return sorted((r.path.rsplit("/", 1)[-1], r.revision, r.byte_offset, r.payload) for r in df.collect())


def lines(data: bytes, name="a.jsonl", revision=1, start=0):
    out, at = [], 0
    for line in data.split(b"\n")[:-1]:
        if at >= start:
            out.append((name, revision, at, line.decode("utf-8", "replace")))
        at += len(line) + 1
    return sorted(out)


def test_ranges_of_any_size_read_each_line_once(spark, source, tmp_path):
    rng = random.Random(3)
    data = b"".join(bytes(rng.choice(b"abc\xc3\xa9 ") for _ in range(rng.choice([0, 1, 5, 40, 300]))) + b"\n" for _ in range(200)) + b"pending"
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.jsonl").write_bytes(data)
    for size in (1, 7, 64, 100_000):
        df = source(tmp_path, rangeBytes=str(size), suffix=".jsonl") if size > 1 else source(tmp_path / "d" / "a.jsonl", rangeBytes="97")
        assert got(df) == lines(data)
        assert df.filter(F.sha2("payload", 256) != F.col("payload_hash")).filter(~F.col("payload").contains("�")).count() == 0
    assert source(tmp_path, rangeBytes="500").rdd.getNumPartitions() > 10
    (tmp_path / "d" / "b.txt").write_text("other\n")
    assert got(source(tmp_path, suffix=".jsonl")) == lines(data) and source(tmp_path / "none").count() == 0


def test_a_batch_resumes_appends_and_restarts_replaced_files(source, tmp_path):
    a = tmp_path / "a.jsonl"
    a.write_bytes(b"one\ntwo\nthr")
    since = growing.progress(str(tmp_path))
    assert json.loads(since)[str(a)]["end"] == 8
    a.write_bytes(b"one\ntwo\nthree\nfour\n")
    assert got(source(tmp_path, since=since)) == [("a.jsonl", 1, 8, "three"), ("a.jsonl", 1, 14, "four")]
    since = growing.progress(str(tmp_path), since)
    assert got(source(tmp_path, since=since)) == []
    a.write_bytes(b"One\ntwo\nthree\nfour\nfive\n")  # another head
    assert got(source(tmp_path, since=since)) == lines(b"One\ntwo\nthree\nfour\nfive\n", revision=2)
    since = growing.progress(str(tmp_path), since)
    a.write_bytes(b"One\n")  # shorter
    assert got(source(tmp_path, since=since)) == lines(b"One\n", revision=3)
    a.unlink()
    assert got(source(tmp_path, since=growing.progress(str(tmp_path), since))) == []


def test_a_stream_reads_new_bytes_only_and_survives_restarts(spark, source, tmp_path):
    (tmp_path / "in").mkdir()
    a, out = tmp_path / "in" / "a.jsonl", str(tmp_path / "out")

    def run():
        stream = spark.readStream.format("growing_lines").options(path=str(tmp_path / "in"), state=str(tmp_path / "state"), rangeBytes="16").load()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        return got(spark.read.parquet(out))

    a.write_bytes(b"one\ntwo\nunfin")
    assert run() == lines(b"one\ntwo\n")
    a.write_bytes(b"one\ntwo\nunfinished\n" + b"more " * 20 + b"\n")
    whole = lines(a.read_bytes())
    assert run() == whole and run() == whole
    (tmp_path / "in" / "b.jsonl").write_bytes(b"b\n")
    assert run() == sorted(whole + [("b.jsonl", 1, 0, "b")])
    a.write_bytes(b"new\nhead\n")
    assert run() == sorted(whole + [("b.jsonl", 1, 0, "b")] + lines(b"new\nhead\n", revision=2))


def test_a_stream_needs_a_place_for_its_progress(spark, source, tmp_path):
    with pytest.raises(Exception, match="state"):
        spark.readStream.format("growing_lines").options(path=str(tmp_path)).load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
