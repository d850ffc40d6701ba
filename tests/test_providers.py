"""Providers of logs, and lists of sessions and episodes."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import reads
from palimpsest.sources import providers as P


class Notes(P.RecordProvider):
    """A format that the library does not know: a record holds several notes."""

    name, suffix = "notes", ".notes"

    def parse_many(self, data, path):
        if not isinstance(data, dict):
            return super().parse_many(data, path)
        return [{"event_type": "note", "session_external_id": data["s"], "role": "user", "timestamp": data.get("at"), "cwd": "/w", "fragments": [{"kind": "user-message", "text": t}]} for t in data["notes"]]


@pytest.fixture
def notes():
    yield P.register(Notes())
    P._registered.pop("notes")


def test_a_new_format_needs_no_change_of_the_library(spark, tmp_path, notes):
    (tmp_path / "a.notes").write_text("\n".join(["{\"s\": \"s1\", \"notes\": [\"one\", \"two\", \"\"], \"at\": 5}", "[1]", "not json", "{\"s\": \"s2\"}", "{\"s\": \"s3\", \"notes\": []}", "unfinished"]))
    message = {"type": "user", "uuid": "u", "sessionId": "m", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": "hello"}}
    (tmp_path / "b.jsonl").write_text(json.dumps(message) + "\n")
    got = P.archive_events(spark, {"notes": [str(tmp_path)], "message-log": [str(tmp_path), str(tmp_path)]})
    assert got.dtypes == spark.createDataFrame([], P.EVENTS).dtypes
    rows = sorted(got.collect(), key=lambda r: (r.provider, r.byte_offset, r.projection_index))
    assert [(r.provider, r.session_external_id, r.event_type, [f.text for f in r.fragments]) for r in rows] == [
        ("message-log", "m", "user", ["hello"]), ("notes", "s1", "note", ["one"]), ("notes", "s1", "note", ["two"]), ("notes", "s1", "note", []), ("notes", None, "parse-error", []), ("notes", None, "parse-error", []), ("notes", None, "parse-error", []),
    ]
    assert [r.parse_error.split(":")[0] for r in rows if r.parse_error] == ["ValueError", "JSONDecodeError", "KeyError"]
    assert "top-level JSON value is not an object" in rows[4].parse_error and rows[1].timestamp == "5" and all(r.payload_hash for r in rows)


def test_names_are_taken_once(notes):
    with pytest.raises(ValueError):
        P.register(Notes())
    assert P.register(notes) is notes and set(P.providers()) >= {"message-log", "item-log", "notes"}


def test_lists_of_sessions(spark):
    rows = [(1, "a", "p1", "/x/Foo", 5, 9, None), (2, "a", "p2", "/x", 5, None, "foo title"), (3, "b", "p1", None, None, None, None), (4, "a", None, "/y", 1, 2, None)]
    df = spark.createDataFrame(rows, "session_id long, provider string, project string, cwd string, start_us long, end_us long, title string")
    pick = lambda **o: [r.session_id for r in reads.list_sessions(df, **o).orderBy("position").collect()]
    assert pick() == [1, 2, 4, 3] and pick(provider="a") == [1, 2, 4] and pick(project="p1") == [1, 3] and pick(text="FOO") == [1, 2] and pick(limit=2, offset=1) == [2, 4] and pick(text="100%") == []


def test_lists_of_episodes(spark):
    rows = [(1, "p", 0, "discussion", 5, 9, "alpha beta"), (2, "p", 1, "error-observed", 5, 20, "alpha x beta"), (3, "q", 0, "discussion", 5, None, "beta only"), (4, "p", 0, "discussion", 1, 9, "beta alpha")]
    df = spark.createDataFrame(rows, "episode_id long, project string, errors int, evidence_state string, start_us long, end_us long, document string")
    pick = lambda **o: [r.episode_id for r in reads.list_episodes(df, **o).orderBy("position").collect()]
    assert pick() == [2, 4, 1, 3] and pick(project="p", limit=2) == [2, 4] and pick(errors_only=True) == [2] and pick(state="discussion") == [4, 1, 3]
    asked = spark.createDataFrame([(7, "Alpha BETA"), (8, "none")], "query_id long, query string")
    got = [(r.query_id, r.episode_id, r.position) for r in reads.list_episodes(df, asked).orderBy("query_id", "position").collect()]
    assert got == [(7, 4, 1), (7, 1, 2), (7, 2, 3)]
    assert reads.list_episodes(df, asked, errors_only=True).select("episode_id").collect()[0][0] == 2


def test_rules_hold_for_paths_of_any_kind(spark):
    from palimpsest.operators import registry as R

    rules = spark.createDataFrame([("a/b", 0, 9, "deep"), ("a", 0, 9, "top")], "prefix string, from_us long, to_us long, v string")
    rows = spark.createDataFrame([("a/b/c", 1), ("a/b/c", 1), ("a", 1), ("ab", 1), (None, 1), ("a/b", 99)], "path string, at long")
    assert [r.v for r in R.most_specific(rows.coalesce(1), rules, "path", "at", "v").orderBy(F.col("path").asc_nulls_first(), "at").collect()] == [None, "top", None, "deep", "deep", None]
