"""Merging batches into an archive, and episodes of a stream against those of a batch."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.episodes import segment
from palimpsest.streaming import archive
from palimpsest.streaming.episodes import episodes

SCHEMA = "path string, at long, body string"


def write(spark, rows, folder, number, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{number}")


def stored(spark, target):
    return sorted((r.path or "", r.at, r.body) for r in spark.read.parquet(target).collect())


def test_a_merge_reads_only_the_parts_of_its_sources(spark, tmp_path):
    target = str(tmp_path / "archive")
    first = spark.createDataFrame([(f"s{k % 20}", k, "x") for k in range(200)] + [(None, 1, "n"), ("s1", 1, "x")], SCHEMA)
    archive.append(archive.merge(first, target, ["path", "at"], by=["path"], content="body", buckets=64), target)
    assert len(stored(spark, target)) == 201
    second = spark.createDataFrame([("s3", 3, "x"), ("s3", 1000, "y"), ("s3", 1000, "y"), (None, 1, "n"), (None, 2, "n")], SCHEMA)
    fresh = archive.merge(second, target, ["path", "at"], by=["path"], content="body", buckets=64)
    assert sorted((r.path or "", r.at) for r in fresh.collect()) == [("", 2), ("s3", 1000)]
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan or "_bucket#" in plan.split("PartitionFilters")[1][:80]
    assert archive.merge(second.limit(0), target, ["path", "at"], by=["path"]).count() == 0


@pytest.mark.parametrize("rows", [[("s1", 1, "other")], [("new", 1, "a"), ("new", 1, "b")]])
def test_other_content_under_a_key_is_refused(spark, tmp_path, rows):
    target = str(tmp_path / "archive")
    archive.append(archive.merge(spark.createDataFrame([("s1", 1, "x")], SCHEMA), target, ["path", "at"], content="body"), target)
    with pytest.raises(archive.MutatedRecord):
        archive.merge(spark.createDataFrame(rows, SCHEMA), target, ["path", "at"], content="body")
    again = archive.merge(spark.createDataFrame([("s1", 1, "x")], SCHEMA), target, ["path", "at"], content="body")
    assert again.count() == 0


def test_replayed_and_broken_batches_add_nothing_twice(spark, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "archive")
    write(spark, [("a", k, "x") for k in range(50)], folder, 0, SCHEMA)
    read = lambda: spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(folder)
    # rows of the batch that were written before it broke off
    archive.append(archive.merge(spark.createDataFrame([("a", k, "x") for k in range(20)], SCHEMA), target, ["path", "at"], by=["path"]), target)
    archive.ingest(read(), target, str(tmp_path / "ck"), ["path", "at"], by=["path"], content="body").awaitTermination()
    assert len(stored(spark, target)) == 50
    write(spark, [("a", k, "x") for k in range(40, 60)], folder, 1, SCHEMA)
    archive.ingest(read(), target, str(tmp_path / "ck"), ["path", "at"], by=["path"], content="body").awaitTermination()
    assert stored(spark, target) == [("a", k, "x") for k in range(60)]
    # another stream over the same input replays all of it
    archive.ingest(read(), target, str(tmp_path / "ck2"), ["path", "at"], by=["path"], content="body").awaitTermination()
    assert len(stored(spark, target)) == 60
    assert sorted((r.batch, r.stream[-3:]) for r in spark.read.parquet(f"{target}_batches").collect()) == [(0, "/ck"), (0, "ck2"), (1, "/ck")]


HOUR = 3_600_000_000
EVENTS = "session_id long, event_id long, kind string, us long"


def random_events(seed, n=120):
    rng, rows, at = random.Random(seed), [], {}
    for k in range(n):
        s = rng.randrange(3)
        at[s] = at.get(s, 0) + rng.choice([0, 1, 2, 11, 12, 13, 30]) * HOUR
        rows.append((s, k, rng.choice(["goal", "tool-input", "error", "note", "outcome", "goal"]), None if rng.random() < 0.1 else at[s]))
    return rows


def run(spark, tmp_path, batches, name, late):
    folder, out = tmp_path / f"in{name}", str(tmp_path / f"out{name}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for number, rows in enumerate(batches):
            write(spark, rows, str(folder), number, EVENTS)
            stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).parquet(str(folder))
            q = episodes(stream, late=late).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"ck{name}")).trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.parquet(out)


def test_streamed_episodes_equal_batch_ones_after_any_cut(spark, tmp_path):
    rows = random_events(5)
    want = {r.event_id: r.episode_no for r in segment(spark.createDataFrame(rows, EVENTS), ["session_id"]).collect()}
    for name, cuts in enumerate(([0, 120], [0, 1, 37, 38, 90, 120])):
        got = run(spark, tmp_path, [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], name, "1000 days")
        assert {r.event_id: r.episode_no for r in got.filter("what = 'event'").collect()} == want
        # what was closed last of each episode has its true bounds
        closed = got.filter("what = 'closed'").groupBy("session_id", "episode_no").agg(F.max_by(F.struct("first_id", "last_id", "events", "start_us", "end_us"), "last_id").alias("c")).collect()
        for r in closed:
            own = [x for x in rows if x[0] == r.session_id and want[x[1]] == r.episode_no]
            times = [x[3] for x in own if x[3] is not None]
            assert tuple(r.c) == (own[0][1], own[-1][1], len(own), min(times, default=None), max(times, default=None))
        last = {s: max(want[x[1]] for x in rows if x[0] == s) for s in range(3)}
        assert {(r.session_id, r.episode_no) for r in closed} >= {(s, k) for s in range(3) for k in range(1, last[s])}


def test_a_timer_closes_the_last_episode(spark, tmp_path):
    first = [(1, 1, "goal", HOUR), (1, 2, "tool-input", 2 * HOUR)]
    got = run(spark, tmp_path, [first, [(2, 3, "goal", 40 * HOUR)], [(2, 4, "note", 41 * HOUR)]], "t", "1 hour")
    closed = [tuple(r)[:9] for r in got.filter("what = 'closed'").collect()]
    assert closed == [(1, 1, "closed", None, 1, 2, HOUR, 2 * HOUR, 2)]
