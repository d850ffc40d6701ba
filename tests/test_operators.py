"""Micro-fixtures of single operators."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import costs, freshness as fresh, dedup, episodes, intervals as I, registry as R, search as S, trace
from palimpsest.sources import exports, logs
from palimpsest.streaming import archive

MIN = 60_000_000
CLOCK = ["contributor_id", "project_id"]


def points(spark, rows):
    return spark.createDataFrame([(k, 1, p, m * MIN) for k, (p, m) in enumerate(rows)], "event_id long, contributor_id long, project_id long, us long")


def intervals(spark, rows):
    return spark.createDataFrame([(1, p, a * MIN, b * MIN) for p, a, b in rows], "contributor_id long, project_id long, start_us long, end_us long")


def bounds(df, *more):
    return sorted((*(r[c] for c in more), r.start_us // MIN, r.end_us // MIN) for r in df.collect())


def test_a_gap_of_an_hour_joins_and_more_splits(spark):
    assert bounds(I.segments(points(spark, [(10, 0), (10, 60), (10, 121)]), CLOCK)) == [(0, 60), (121, 121)]


def test_another_project_does_not_bridge(spark):
    got = I.segments(points(spark, [(10, 0), (20, 60), (10, 120)]), CLOCK).filter("project_id = 10")
    assert bounds(got) == [(0, 0), (120, 120)]


def test_empty_points(spark):
    assert I.segments(points(spark, []), CLOCK).count() == 0


def test_union_merges_overlaps_and_touching_and_absorbs_instants(spark):
    got = I.union(intervals(spark, [(10, 0, 30), (10, 5, 25), (10, 30, 30), (10, 40, 40), (10, 40, 40), (20, 5, 25)]), CLOCK)
    assert bounds(got, "project_id") == [(10, 0, 30), (10, 40, 40), (20, 5, 25)]


def test_midnight_split(spark):
    day = 24 * 60
    got = I.split_midnights(intervals(spark, [(1, day * 100 + 15 * 60 + 55, day * 100 + 16 * 60 + 5)]), "Australia/Perth")
    assert [r.end_us - r.start_us for r in got.collect()] == [5 * MIN, 5 * MIN]


def test_combined_clock(spark):
    got = I.combined_clock(intervals(spark, [(1, 60, 180), (2, 120, 240)]), ["contributor_id"], "project_id").orderBy("start_us").collect()
    assert [((r.end_us - r.start_us) // (60 * MIN), r.member_count) for r in got] == [(1, 1), (1, 2), (1, 1)]


def test_fifo_pairs_ignore_early_outputs(spark):
    kinds = ["tool-output", "tool-input", "tool-input", "tool-output", "tool-output", "tool-output", "tool-input"]
    ev = spark.createDataFrame([(k, 1, x) for k, x in enumerate(kinds)], "event_id long, session_id long, kind string")
    got = {r.call_id: r.output_id for r in trace.pair_calls(ev, ["session_id"]).collect()}
    assert got == {1: 3, 2: 4, 6: None}


def test_episodes_split_on_progress_and_breaks(spark):
    hour = 60 * MIN
    rows = [("goal", 0), ("goal", 1), ("tool-input", 2), ("goal", 3), ("error", 4), ("tool-input", 30)]
    ev = spark.createDataFrame([(k, 1, x, h * hour) for k, (x, h) in enumerate(rows)], "event_id long, session_id long, kind string, us long")
    got = {r.event_id: r.episode_no for r in episodes.segment(ev, ["session_id"]).collect()}
    assert [got[k] for k in range(6)] == [1, 1, 1, 2, 2, 3]


def test_price_as_of_and_null_tier(spark):
    prices = spark.createDataFrame([("m", None, "2024-01-01", "2.000000"), ("m", None, "2024-02-01", "3.000000"), ("m", "fast", "2024-01-01", "9.000000")], "model string, tier string, d string, r string").select("model", "tier", F.col("d").cast("date").alias("effective_from"), F.col("r").cast("decimal(12,6)").alias("rate"))
    usage = spark.createDataFrame([(1, "m", None, "2024-01-31", 1_000_000), (2, "m", None, "2024-02-01", 1), (3, "m", "slow", "2024-02-01", 1)], "message_id long, model string, tier string, d string, tokens long").withColumn("day", F.col("d").cast("date")).drop("d")
    got = costs.cost_by(costs.priced(usage, prices), ["model"]).first()
    assert (got.priced, got.unpriced, str(got.cost)) == (2, 1, "2.000003000000")


def test_lineage_with_cycles_and_missing_parents(spark):
    e = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 7), (7, 5), (8, 7)], "id long, parent_id long")
    got = {r.id: r.root_id for r in R.lineage_roots(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 5, 8: 5}


def test_rolling_windows_overlap(spark):
    u = spark.createDataFrame([(1, k, "x" * 30) for k in range(5)], "session_id long, ordinal long, text string")
    got = sorted((r.first, r.last) for r in S.rolling_windows(u, "session_id", "ordinal", "text", 100, 1).collect())
    assert got == [(0, 2), (2, 4)]


def test_dedupe_keeps_the_newest(spark):
    c = spark.createDataFrame([(1, "same", 1, 10), (3, "same", 2, 30), (4, "other", 3, 5)], "event_id long, text string, rank int, us long")
    got = {r.text: (r.representative, r["rank"], r.collapsed) for r in S.recall_groups(c, ["text"]).collect()}
    assert got == {"same": (3, 1, 1), "other": (4, 3, 0)}


def test_membership_faults_count_copies(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, 3)], "x int, y int")
    b = spark.createDataFrame([(1, None), (2, 4)], "x int, y int")
    assert sorted((r.x, r.y or 0, r.side) for r in dedup.membership_faults(a, b, ["x", "y"]).collect()) == [(1, 0, "left"), (2, 3, "left"), (2, 4, "right")]


def test_sanitize_and_artifacts(spark):
    d = spark.createDataFrame([("  a\0b ",), ("A" * 2000,), ("see src/a/b.py.\n```py\ncode\n```\nValueError: 0xff bad",), (None,)], "t string").select(X.sanitize(F.col("t")).alias("s"), X.artifacts(F.col("t")).alias("a")).collect()
    assert d[0].s == "a␀b" and d[1].s.startswith("[opaque payload omitted") and d[3].s is None
    assert ("code-block", "code") in [tuple(x) for x in d[2].a] and ("error-signature", "ValueError: <address> bad") in [tuple(x) for x in d[2].a]


MESSAGES = [
    {"type": "user", "uuid": "u1", "sessionId": "s", "timestamp": "2024-01-01T00:00:00Z", "cwd": "/w", "message": {"role": "user", "content": "hello"}},
    {"type": "assistant", "uuid": "u2", "parentUuid": "u1", "sessionId": "s", "timestamp": "2024-01-01T00:00:01Z", "message": {"id": "m1", "role": "assistant", "model": "x", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "name": "Bash", "input": {"command": "ls"}}], "usage": {"input_tokens": 5, "output_tokens": 7, "cache_creation_input_tokens": 300, "cache_read_input_tokens": 1}}},
    {"type": "user", "sessionId": "s", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t", "is_error": True, "content": [{"type": "text", "text": "no"}]}]}},
    {"type": "assistant", "sessionId": "s", "message": {"role": "assistant", "model": "x", "content": [], "usage": {"input_tokens": True, "output_tokens": 7}}},
]


def test_message_logs(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, MESSAGES)) + "\n{not-json}\npending")
    rows = logs.message_events(logs.raw_lines(spark, str(tmp_path))).orderBy("line_no").collect()
    assert [r.event_type for r in rows] == ["user", "assistant", "user", "assistant", "parse-error"]
    assert rows[1].byte_offset == len(json.dumps(MESSAGES[0])) + 1
    assert [(f.kind, f.text) for f in rows[0].fragments] == [("user-message", "hello")]
    assert [(f.kind, f.label) for f in rows[1].fragments] == [("reasoning", None), ("tool-input", "Bash")]
    assert [(f.kind, f.text, f.is_error) for f in rows[2].fragments] == [("tool-output", "no", True)]
    u = rows[1].token_usage
    assert (u.input_tokens, u.output_tokens, u.cache_write_5m_tokens, u.cache_write_1h_tokens, u.cache_read_tokens, u.message_id) == (5, 7, 300, 0, 1, "m1")
    assert rows[3].token_usage is None and rows[0].us == 1_704_067_200_000_000


def test_item_logs_documents_and_histories(spark, tmp_path):
    (tmp_path / "items").mkdir()
    items = [
        {"timestamp": "2024-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": "sid", "cwd": "/w"}},
        {"timestamp": "2024-01-01T00:00:01Z", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "hi"}]}},
        {"timestamp": "2024-01-01T00:00:02Z", "type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": "{\"cmd\":\"ls\"}", "call_id": "c"}},
        {"timestamp": "2024-01-01T00:00:03Z", "type": "event_msg", "payload": {"type": "error", "message": "bad"}},
    ]
    (tmp_path / "items" / "a.jsonl").write_text("".join(json.dumps(x) + "\n" for x in items))
    rows = logs.item_events(logs.raw_lines(spark, str(tmp_path / "items"))).orderBy("line_no").collect()
    assert [[(f.kind, f.text, f.is_error) for f in r.fragments] for r in rows] == [[], [("user-message", "hi", False)], [("tool-input", '{"cmd":"ls"}', False)], [("error", "bad", True)]]
    assert rows[0].session_external_id == "sid" and rows[2].provider_event_id == "c"
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "d.json").write_text(json.dumps({"sessionId": "g", "startTime": "2024-01-01T00:00:00Z", "summary": "sum", "messages": [{"id": "1", "type": "user", "content": "q"}, {"id": "2", "type": "model", "content": [{"text": "a"}], "thoughts": [{"subject": "s", "description": "d"}], "toolCalls": [{"name": "t", "args": {"x": 1}, "result": "r", "status": "error"}]}]}))
    rows = logs.document_events(spark, str(tmp_path / "docs")).orderBy("projection_index").collect()
    assert [[f.kind for f in r.fragments] for r in rows] == [["context-summary"], ["user-message"], ["assistant-message", "reasoning-summary", "tool-input", "tool-output"]]
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "history.jsonl").write_text(json.dumps({"session_id": "s", "text": "p", "ts": 1704067200}) + "\n")
    r = logs.history_events(logs.raw_lines(spark, str(tmp_path / "h")), text="$.text", session="$.session_id", time="$.ts").first()
    assert (r.session_external_id, r.us, r.fragments[0].text) == ("s", 1_704_067_200_000_000, "p")


def test_commit_logs(spark):
    log = spark.createDataFrame([("\x1eabc\x1fp1 p2\x1fN\x1fn@x\x1f2024-01-01T08:00:00+08:00\x1fsubject\x1fbody\x1e",)], "value string")
    r = logs.commit_log(log).first()
    assert (r.hash, r.parents, r.us, r.body) == ("abc", ["p1", "p2"], 1_704_067_200_000_000, "body")
    line = spark.createDataFrame([("0" * 40 + " " + "a" * 40 + " N <n@x> 1704067200 +0800\tcommit: x",), ("junk",)], "value string")
    assert logs.reflog(line).select("us", "message").collect() == [(1_704_067_200_000_000, "commit: x")]


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a|b", [1, 2])], "id long, t string, xs array<int>")
    exports.write(rows, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["id", "t", "xs"]
    exports.write(rows, str(tmp_path / "j"), "jsonl")
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    assert exports.markdown(rows.drop("xs")).orderBy("line_no").collect()[2].line == "| 1 | a\\|b |"
    assert exports.manifest(rows, ["id"]).first().digest == exports.manifest(rows.repartition(3), ["id"]).first().digest
    with pytest.raises(ValueError):
        exports.write(rows, str(tmp_path / "x"), "xml")


def test_streamed_ingestion_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(src)
    for run in ("one", "two"):  # a fresh checkpoint replays everything
        archive.ingest(archive.read_stream(spark, src, "k long, v string"), out, str(tmp_path / run), ["k"]).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_changed_sessions(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "session_id long, event_id long")
    state = spark.createDataFrame([(1, 2, 2, "3"), (2, 2, 3, "5")], "session_id long, rows long, last_id long, s string").withColumn("id_sum", F.col("s").cast("decimal(38,0)")).drop("s")
    assert [r.session_id for r in archive.changed_sessions(rows, state, "session_id", "event_id").collect()] == [2]


def test_entry_imports_without_llm(small, spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_episodes_equal_a_state_machine(spark):
    import random

    rnd = random.Random(5)
    rows, want, k = [], {}, 0
    for track in range(30):
        no, last, has_goal, moved, at = 0, None, False, False, 0
        for _ in range(60):
            kind = rnd.choice(("goal", "goal", "tool-input", "error", "note"))
            at += rnd.choice((1, 2, 11, 12, 13)) * 60 * MIN if rnd.random() < 0.2 else MIN
            us = None if rnd.random() < 0.1 else at
            goal, progress = kind == "goal", kind in ("tool-input", "error")
            gap = us is not None and last is not None and max(0, us - last) >= 12 * 60 * MIN
            if no == 0 or (goal and has_goal and moved) or (gap and (goal or progress)):
                no, has_goal, moved = no + 1, False, False
            moved = moved or (has_goal and progress)
            has_goal = has_goal or goal
            last = last if us is None else us
            rows.append((k, track, kind, us))
            want[k] = no
            k += 1
    ev = spark.createDataFrame(rows, "event_id long, session_id long, kind string, us long")
    assert {r.event_id: r.episode_no for r in episodes.segment(ev, ["session_id"]).collect()} == want


def test_rolling_windows_equal_a_plain_loop(spark):
    import random

    rnd = random.Random(6)
    rows = [(t, k, "x" * rnd.choice((0, 5, 30, 90, 200))) for t in range(12) for k in range(40)]
    want = []
    for t in range(12):
        now, n = [], 0
        for _, k, x in [r for r in rows if r[0] == t]:
            if now and sum(len(y) for _, y in now) + len(x) > 150:
                want.append((t, n, now[0][0], now[-1][0]))
                n += 1
                now = now[-2:]
                if sum(len(y) for _, y in now) + len(x) > 150:
                    now = []
            now.append((k, x))
        want.append((t, n, now[0][0], now[-1][0]))
    df = spark.createDataFrame(rows, "session_id long, ordinal long, text string").repartition(5)
    got = S.rolling_windows(df, "session_id", "ordinal", "text", 150, 2).collect()
    assert sorted((r.session_id, r.window_no, r.first, r.last) for r in got) == want


def test_headlines_mark_whole_words(spark):
    r = spark.createDataFrame([("x" * 300 + " The Cat sat; concat cat.", ["cat", "sat"]), ("nothing", [])], "t string, q array<string>").select(S.headline(F.col("t"), F.col("q")).alias("h")).collect()
    assert r[0].h.endswith("The <mark>Cat</mark> <mark>sat</mark>; concat <mark>cat</mark>.") and len(r[0].h) < 340 and r[1].h == "nothing"


def test_failed_lines_in_any_case_are_actionable(spark):
    lines = ["failed", "Failed", "FAILED x", "failed: y", "unfailed", "not failed"]
    got = spark.createDataFrame([(x,) for x in lines], "t string").select(X.is_actionable(F.col("t")).alias("a")).collect()
    assert [r.a for r in got] == [True, True, True, True, False, False]


def test_lineage_of_long_chains_and_long_cycles(spark):
    chain = [(k, k - 1 if k else None) for k in range(300)]
    ring = [(1000 + k, 1000 + (k + 7) % 150) for k in range(150)] + [(2000, 1003)]
    got = {r.id: r.root_id for r in R.lineage_roots(spark.createDataFrame(chain + ring, "id long, parent_id long")).collect()}
    assert all(got[k] == 0 for k in range(300)) and all(got[1000 + k] == 1000 for k in range(150)) and got[2000] == 1000


def test_sections_keep_fair_shares(spark):
    from palimpsest.operators import records as C

    def level(sizes, room):
        r = spark.range(1).select(C.fair_level(F.lit(sizes) if sizes else F.array().cast("array<int>"), F.lit(room)).alias("w")).first().w
        return r.level, r.odd

    assert level([5, 50, 50], 61) == (28, 0) and level([10, 10], 5) == (2, 1) and level([1, 2], 50) == (None, 0) and level([], 5) == (None, 0)
    parts = "".join(f"[{n}]\n{c * 900}\n\n" for n, c in (("GOAL", "a"), ("RESULT", "b"), ("ERROR", "c"), ("CONTEXT", "d")))
    texts = [parts, "short", "x" * 3000, f"[GOAL]\n  \n[ERROR]\n{'e' * 3000}\n\n[RESULT]\nr\n", None]
    cut = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(C.balanced(F.col("t"), 2000)).collect()]
    assert [len(p.split("\n")[1]) for p in cut[0].split("\n\n")] == [489] * 4 and all(p.endswith("…") for p in cut[0].split("\n\n"))
    assert cut[1] == "short" and cut[2] == "x" * 2000 and cut[4] is None
    assert cut[3] == f"[ERROR]\n{'e' * 1977}…\n\n[RESULT]\nr"


def test_json_redaction_and_counts(spark):
    from palimpsest.functions import jsontext as J

    body = json.dumps({"type": "reasoning", "encrypted_content": "äb", "summary": [{"type": "t", "text": "s"}], "deep": [{"type": "REASONING", "summary": "A" * 128}]})
    d = spark.createDataFrame([(body,), ("no",), (None,)], "t string").select(J.redacted(F.col("t")).alias("r"), J.footprint(F.col("t")).alias("n"), J.sorted_json(F.col("t")).alias("s")).collect()
    out = json.loads(d[0].r)
    assert out["encrypted_content"] == J.MARKER and out["encrypted_content_byte_count"] == 3 and out["encrypted_content_redacted"] is True
    assert tuple(d[0].n) == (2, 1, 3, 1, 1) and tuple(d[1].n) == (0, 0, 0, 0, 0) and d[1].r is None and d[2].s is None
    assert d[0].s == json.dumps(json.loads(body), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_table_stores(spark):
    s = spark.createDataFrame([("s1", "/w", None)], "id string, directory string, parent_id string")
    m = spark.createDataFrame([("m1", "s1", 1704067200000, '{"role":"user"}'), ("m2", "s1", 1704067201000, '{"role":"assistant"}'), ("m3", "s9", 1, "{}")], "id string, session_id string, time_created long, data string")
    p = spark.createDataFrame([("p2", "m2", '{"type":"tool","tool":"bash","state":{"status":"error","input":{"a":1},"error":"bad"}}'), ("p1", "m2", '{"type":"text","text":"hi"}'), ("p0", "m1", '{"type":"text","text":"q"}')], "id string, message_id string, data string")
    rows = {r.provider_event_id: r for r in logs.table_events(s, m, p).collect()}
    assert [(f.kind, f.text, f.is_error) for f in rows["m2"].fragments] == [("assistant-message", "hi", False), ("tool-input", '{"a":1}', False), ("tool-output", "bad", True)]
    assert [f.kind for f in rows["m1"].fragments] == ["user-message"] and rows["m1"].us == 1_704_067_200_000_000 and rows["m3"].fragments == [] and rows["m1"].cwd == "/w"


def test_commit_owners_and_source_scopes(spark):
    seen = spark.createDataFrame([("h", "b", 5), ("h", "a", 5), ("h", "c", 9), ("g", "z", 1)], "hash string, identity string, first_seen long")
    assert {r.hash: r.identity for r in logs.commit_owners(seen).collect()} == {"h": "a", "g": "z"}
    files = spark.createDataFrame([("x/2024/01/05/a.jsonl", "2024-03-01"), ("y/b.jsonl", "2024-01-06"), ("z/c.jsonl", "2024-02-01")], "path string, d string").select("path", F.to_timestamp("d").alias("modified"))
    got = {r.path[0]: r.decision for r in logs.in_scope(files, "2024-01-05", "2024-01-31").collect()}
    assert got == {"x": "exact", "y": "mtime"} and {r.decision for r in logs.in_scope(files, None, None).collect()} == {"unbounded"}


def test_snapshots_and_partitions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    root = str(tmp_path / "p")
    exports.publish(rows, root, "one")
    exports.publish(rows.filter("k = 2"), root, "two")
    assert [r.k for r in exports.published(spark, root).collect()] == [2]
    path = str(tmp_path / "q")
    exports.replace_partitions(rows, path, ["k"])
    exports.replace_partitions(spark.createDataFrame([(2, "c")], "k long, v string"), path, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_streamed_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 10:30:00"), ("a", "2024-01-02 10:00:00"), ("b", "2024-01-01 11:00:00")]
    spark.createDataFrame(rows, "who string, t string").select("who", F.to_timestamp("t").alias("at")).write.parquet(src)

    def run(build, name, mode):
        q = build(archive.read_stream(spark, src, "who string, at timestamp"), "at", "who").writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert sorted((r.who, r.events) for r in run(archive.timeline, "tumbling", "complete")) == [("a", 1), ("a", 2), ("b", 1)]
    assert len(run(archive.sliding, "overlapping", "complete")) == 8 + 7
    assert sorted((r.who, r.events) for r in run(archive.sessions, "by_gap", "complete")) == [("a", 1), ("a", 2), ("b", 1)]


def test_price_books_do_not_change_under_their_version(spark):
    from palimpsest.operators import reports as P

    book = spark.createDataFrame([("v1", 1, "2.5"), ("v1", 2, "3")], "version string, line long, rate string")
    old, other = (fresh.price_books(b, "version", ["line", "rate"], "version") for b in (book, book.withColumn("rate", F.lit("9"))))
    assert P.check_book(old, old, "version").count() == 0 and P.check_book(old, other, "version").count() == 1


def test_json_of_any_depth_and_odd_numbers(spark):
    from palimpsest.functions import jsontext as J

    deep = "[" * 50_000 + "]" * 50_000
    texts = [deep, '{"a":NaN}', '{"b":1,"a":"\\ud800"}', '{"type":"reasoning","summary":["' + "QUJD" * 32 + '"," x ",{"id":"no","y":["z"]}]}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(J.sorted_json(F.col("t")).alias("s"), J.redacted(F.col("t")).alias("r"), J.footprint(F.col("t")).alias("n")).collect()
    assert rows[0].s is None and rows[0].r is None and rows[1].s is None and tuple(rows[1].n) == (0,) * 5
    assert rows[2].s == '{"a":"\\ud800","b":1}' and tuple(rows[3].n) == (1, 0, 0, 1, 2)


def test_repeated_usage_is_priced_once_a_row(spark):
    prices = spark.createDataFrame([("m", None, "2024-01-01", "2"), ("m", None, "2024-01-01", "1"), ("m", None, "2024-03-01", "3"), ("m", "fast", "2024-01-01", "9")], "model string, tier string, d string, r string").select("model", "tier", F.to_date("d").alias("effective_from"), F.col("r").cast("decimal(12,6)").alias("rate"))
    rows = [(1, "m", None, "2024-02-01", 10)] * 2 + [(2, "m", None, "2024-03-01", 10), (3, "m", None, "2023-12-31", 10), (4, "m", "fast", "2025-01-01", 10), (5, None, None, "2024-02-01", 10)]
    usage = spark.createDataFrame(rows, "message_id long, model string, tier string, d string, tokens long").withColumn("day", F.to_date("d")).drop("d")
    got = sorted((r.message_id, r.rate and int(r.rate)) for r in costs.priced(usage, prices).collect())
    assert got == [(1, 2), (1, 2), (2, 3), (3, None), (4, 9), (5, None)]


def test_combined_clock_equals_a_scan_of_instants(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, None]), rng.randrange(4), a, a + rng.randrange(0, 60)) for a in (rng.randrange(-200, 400) for _ in range(80))]
    df = spark.createDataFrame(rows, "contributor_id long, project_id long, start_us long, end_us long")
    got = {}
    for r in I.combined_clock(df, ["contributor_id"], "project_id", span_us=50).collect():
        assert r.member_count == len(r.members.split(","))
        for t in range(r.start_us, r.end_us):
            assert (r.contributor_id, t) not in got
            got[r.contributor_id, t] = r.members
    want = {(c, t): ",".join(str(p) for p in sorted({p for k, p, a, b in rows if k == c and a <= t < b})) for c in (1, None) for t in range(-200, 460)}
    assert got == {k: v for k, v in want.items() if v}
    whole = I.combined_clock(df, ["contributor_id"], "project_id")
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, I.combined_clock(df, ["contributor_id"], "project_id", span_us=50).collect()))
    assert "NestedLoop" not in (plan := whole._jdf.queryExecution().toString()) and "Cartesian" not in plan
