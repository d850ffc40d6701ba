"""The baseline review, evidence packets, resume surfaces, review states and origins of evidence, on cases of their own."""

import pytest
from pyspark.sql import Row, functions as F

from palimpsest.operators import baseline as B, reports as P, resume, review

UNIT = "g long, provider string, us long, ordinal long, event_id long, unit_index int, role string, kind string, label string, is_error boolean, text string, content_hash string, event_type string"


def packet(spark, rows, **limits):
    units = spark.createDataFrame([(1, "p", us, k, k, 0, role, kind, label, err, text, f"h{k}", etype) for k, us, role, kind, label, err, text, etype in rows], UNIT)
    return resume.packets(units, units.select("g", "event_id", "event_type"), "g", **limits).first()


def said(k, text="hi", us=0, kind="user-message", role="user", label=None, err=None, etype="message"):
    return (k, us, role, kind, label, err, text, etype)


def test_packet_lines_name_time_role_kind_label_and_error(spark):
    p = packet(spark, [said(1, " a\n b ", us=None), said(2, "x", us=1_500_000, role=None, kind="tool-output", label="Bash", err=True), said(3, "w" * 30, us=2_000_000)], longest=10)
    assert p.early_evidence == ["[unknown-time | p | user | user-message] a b", "[1970-01-01T00:00:02+00:00 | p | user | user-message] " + "w" * 9 + "…"]
    assert p.recent_evidence[1] == "[1970-01-01T00:00:01.500000+00:00 | p | tool-output | tool-output/Bash/error] x"


def test_instants_before_the_epoch_and_in_another_time_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Australia/Perth")
        assert spark.range(1).select(resume.iso_utc(F.lit(-1)).alias("t")).first().t == "1969-12-31T23:59:59.999999+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_packets_merge_head_and_tail_and_ignore_what_is_no_evidence(spark):
    rows = [said(k, us=k) for k in range(10)] + [said(10, us=10, kind="tool-input"), said(11, us=11, etype="compacted"), said(12, us=12, kind="note")]
    p = packet(spark, rows, head=3, tail=4)
    assert len(p.early_evidence) == 3 and len(p.recent_evidence) == 7  # 0 1 2, 7 8 9 10
    assert (p.source_events, p.last_event_id) == (12, 12)
    again = packet(spark, rows + rows[:2], head=3, tail=4)
    assert again.recent_evidence == p.recent_evidence
    assert packet(spark, rows[:-2], head=3, tail=4).evidence_fingerprint != p.evidence_fingerprint


def test_packets_keep_a_first_line_beyond_the_budget_cut(spark):
    p = packet(spark, [said(1, "a" * 200, us=1), said(2, "b", us=2), said(3, "c" * 200, us=3)], early=60, recent=50)
    assert [len(x) for x in p.early_evidence] == [60] and p.early_evidence[0].startswith("[1970")
    assert [len(x) for x in p.recent_evidence] == [50] and set(p.recent_evidence[0]) == {"c"}
    line = len("[1970-01-01T00:00:00.000002+00:00 | p | user | user-message] b")
    fits = packet(spark, [said(1, "a", us=1), said(2, "b", us=2), said(3, "c", us=3)], early=2 * line, recent=2 * line - 1)
    assert (len(fits.early_evidence), len(fits.recent_evidence)) == (2, 1)


def test_surfaces_are_the_newest_and_a_place_is_listed_once_with_its_last_session(spark):
    s = spark.createDataFrame([(k, k * 10, "ready", '["a", "b"]' if k else "no json", None, "[]") for k in range(4)], "surface_id long, last_us long, state string, next_moves_json string, research_directions_json string, open_loops_json string")
    newest = resume.newest_surfaces(s, 0)  # kept within 1 and 500
    assert [(r.surface_id, r.next_moves, r.research_directions) for r in newest.collect()] == [(3, ["a", "b"], [])]
    assert {r.surface_id: r.next_moves for r in resume.newest_surfaces(s).collect()}[0] == []
    links = spark.createDataFrame([(3, k, k) for k in range(5)] + [(2, 0, 0)], "surface_id long, session_id long, position long")
    sessions = spark.createDataFrame([(0, "m", "a", None, "p"), (1, "m", "b", "x", "p"), (2, "m", "a", None, "p"), (3, "m", "b", "x", "q"), (4, "m", "b", "x", "p")], "session_id long, machine string, cwd string, project string, provider string")
    got = [(r.place_no, r.session_id) for r in resume.surface_places(newest, links, sessions).orderBy("place_no").collect()]
    assert got == [(1, 4), (2, 3), (3, 2)]
    empty = resume.surface_overview(s.limit(0), spark.createDataFrame([], "run_id long, status string, started long"), spark.createDataFrame([], "start_us long, end_us long"))
    assert {r.what: r.value for r in empty.collect()} == {"total": "0", "latest_activity": None}


def test_verdicts_replace_the_annotation_of_their_label_and_none_is_a_label(spark):
    ann = spark.createDataFrame([("event", "1", None, "old", "reviewing", 1, 1), ("event", "1", "bug", "b", "unreviewed", 2, 2)], "target_type string, target_key string, label string, note string, review_state string, created long, updated long")
    new = spark.createDataFrame([("event", "1", None, "mid", "reviewing", 5), ("event", "1", None, "new", "reviewed", 6), ("event", "2", "bug", None, "reviewed", 7), ("page", "2", None, "", "reviewed", 8), ("event", "2", "nope", "", "reviewed", 8), ("event", "2", None, "", None, 8)], "target_type string, target_key string, label string, note string, review_state string, at long")
    labels = spark.createDataFrame([("bug",)], "name string")
    wrong = review.faults(new, labels)
    assert sorted(r.fault for r in wrong.collect()) == ["review_state", "target_type", "unknown label"]
    out = review.saved(ann, new.filter("at < 8"))
    assert sorted((r.target_key, r.label or "", r.note, r.review_state, r.created, r.updated) for r in out.collect()) == [("1", "", "new", "reviewed", 1, 6), ("1", "bug", "b", "unreviewed", 2, 2), ("2", "bug", None, "reviewed", 7, 7)]
    c = spark.createDataFrame([("event", str(k % 4), k, "t") for k in range(8)], "target_type string, target_key string, rank long, heading string")
    q = review.queue(c, out, limit=2).collect()
    assert [(r.target_key, r["rank"], r.annotations, r.labels) for r in q] == [("0", 0, 0, []), ("3", 3, 0, [])]
    every = review.queue(c, out, limit=9, unreviewed_only=False).collect()
    assert [(r.target_key, r.reviewed, r.latest_state) for r in every] == [("0", False, None), ("1", True, "reviewed"), ("2", True, "reviewed"), ("3", False, None)]


def test_own_rows_of_evidence_are_not_read_where_there_is_a_set(spark):
    intervals = spark.createDataFrame([(1, 7), (2, 7), (3, None), (4, None), (5, 8)], "interval_id long, evidence_set_id long")
    members = spark.createDataFrame([(7, 1), (7, 1)], "evidence_set_id long, event_id long")
    legacy = spark.createDataFrame([(1, 2), (3, 1), (3, 2), (5, 2)], "interval_id long, event_id long")
    events = spark.createDataFrame([(1, "git"), (2, "chat")], "event_id long, provider string")
    got = {r.interval_id: r.origin for r in P.interval_origins(intervals, members, legacy, events).collect()}
    assert got == {1: "git", 2: "git", 3: "both", 4: None, 5: None}


def test_echoes_count_as_physical_alone_and_events_without_a_session_are_their_own(spark):
    a = spark.createDataFrame([("h", "ls", 1, 1, "x", True), ("h", "ls", 1, 1, "x", True), ("h", "ls", 2, None, None, True), ("h", "ls", 3, None, None, True), ("h", "ls", 9, 5, "y", False), ("k", "cd", 4, 1, "x", True), ("n", "no", 4, 1, "x", False)], "value_hash string, value string, event_id long, session_id long, project string, counted boolean")
    (r,) = B.repeated_values(a, least=2).collect()
    assert (r.value, r.physical, r.independent, r.sessions, r.projects, r.echoes, r.first_event_id) == ("ls", 5, 3, 3, 2, 2, 1)
    assert B.repeated_values(a, least=1).count() == 2  # a value of echoes only is none


def test_failures_count_episodes_once_and_leave_out_raw_hits(spark):
    p = spark.createDataFrame([("h", "boom", 1, 1, None, 10), ("h", "boom", 1, 1, None, 9), ("h", "boom", 2, 2, "x", 11), ("k", "bang", 3, 3, "x", 12)], "value_hash string, value string, episode_id long, session_id long, project string, first_event_id long")
    hits = spark.createDataFrame([("h",)] * 5 + [("k",)], "value_hash string")
    (r,) = B.repeated_failures(p, hits, least=2, top=5).collect()
    assert (r.episodes, r.sessions, r.projects, r.excluded, r.first_event_id) == (2, 2, 2, 3, 9)
    lines = spark.createDataFrame([(9, "a|b", 4)], "event_id long, path string, line_no long")
    assert [x.reference for x in B.sourced(B.repeated_failures(p, hits, least=1, top=5), lines).orderBy("value_hash").collect()] == ["`a\\|b:4`", "(unavailable)"]


@pytest.mark.parametrize("text, n, want", [(" a \n b ", 9, "a b"), ("x" * 12, 10, "x" * 9 + "…"), ("a|b`c", 10, "a\\|b'c"), ("", 5, "")])
def test_cells(spark, text, n, want):
    assert spark.createDataFrame([Row(t=text)]).select(B.cell(F.col("t"), n).alias("c")).first().c == want


def test_a_review_of_nothing_has_its_remarks(spark):
    e = lambda schema: spark.createDataFrame([], schema)
    corpus = spark.createDataFrame([(0,) * 7], "sources long, source_bytes long, sessions long, events long, text_units long, artifacts long, parse_errors long")
    out = B.baseline_report(
        corpus, e("run_id long, run_key string, profile string, model string, dimensions int, windows long, freshness string, status string, completed long"), e("run_id long, cluster_id long, label string, windows long"),
        e("session_id long, project string, errors long, attempts long, active_us long, duplicates long"), e("value_hash string, value string, episode_id long, session_id long, project string, first_event_id long"), e("value_hash string"),
        e("value_hash string, value string, event_id long, session_id long, project string, counted boolean"), e("event_id long, path string, line_no long"), e("session_id long, provider string, project string, events long, start_us long, end_us long, text_units long"), e("name string, uses long"),
    )
    lines = {}
    for r in out.orderBy("section", "line_no").collect():
        lines.setdefault(r.section, []).append(r.line)
    assert lines[1][2] == "- Sources: **0** (0 B)"
    assert (lines[2], lines[3]) == ([B.SEMANTIC, "", B.NO_RUN], [B.EPISODES, "", B.NO_EPISODE])
    assert (lines[4], lines[5]) == ([B.FAILURES, "", B.NO_FAILURE], [B.COMMANDS, "", B.NO_COMMAND])
    assert (lines[6], lines[7], lines[8]) == (B.SESSIONS, B.PROJECTS, B.LABELS)
