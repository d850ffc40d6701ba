"""Documents of episodes, calls with outcomes, drafts, freshness, shapes and the map."""

import json

import numpy as np
from pyspark.sql import functions as F

from palimpsest.operators import freshness as fresh, inventory, records as C, reports as P, semanticmap, trace

UNIT = "e long, ev long, o long, kind string, label string, text string, is_error boolean"


def documents(spark, units, signatures=()):
    df = spark.createDataFrame([(1, *u) for u in units], UNIT)
    signs = spark.createDataFrame([(1, *s) for s in signatures], "e long, ev long, value string") if signatures else None
    return C.documents(df, ["e"], "o", event="ev", signatures=signs).first()


def test_documents_have_their_parts_in_order_and_leave_out_control_messages(spark):
    units = [
        (1, 1, "user-message", None, "<environment_context>x</environment_context>", False), (2, 2, "assistant-message", None, "will do", False), (3, 3, "user-message", None, " fix it ", None), (4, 4, "tool-input", "Bash", "ls", False),
        (5, 5, "tool-output", "Bash", "a b", False), (6, 6, "reasoning", None, "hm", False), (7, 7, "error", None, "boom", False), (8, 8, "tool-output", None, "boom", True), (9, 9, "assistant-message", None, "will do", False),
        (10, 10, "user-message", None, "fix it", False), (11, 11, "ai-title", None, "Title", False), (12, 12, "user-message", None, "<goal_context><objective>carry on</objective>", False), (13, 13, "note", None, "nothing", False), (4, 14, "tool-input", "Bash", "ls", False),
    ]
    d = documents(spark, units)
    assert d.document == "[OBJECTIVE]\ncarry on\n\n[GOAL]\nfix it\n\n[CONTEXT]\nTitle\n\n[REASONING]\nhm\n\n[ATTEMPTS]\n[Bash] ls\n\n[RESULTS]\n[Bash] a b\n\n[ERROR EVIDENCE]\nboom\n\n[OUTCOME MESSAGES]\nwill do"
    assert (d.goal, d.outcome, d.attempts, d.errors, d.evidence_state) == ("fix it", "will do\n\nwill do", 1, 1, "error-observed")


def test_states_of_evidence_need_an_attempt(spark):
    said, tried = (2, 2, "assistant-message", None, "done", False), (1, 1, "tool-input", None, "ls", False)
    assert documents(spark, [said]).evidence_state == "discussion"
    assert documents(spark, [said, tried]).evidence_state == "result-observed"
    assert documents(spark, [tried]).evidence_state == "attempt-observed"
    only = documents(spark, [(1, 1, "user-message", None, "<codex_internal_context><objective> a </objective>", False), (2, 2, "user-message", None, "<goal_context><objective>b</objective>", False)])
    assert (only.goal, only.outcome) == ("b", "")


def test_a_successful_output_is_no_failure_whatever_it_quotes(spark):
    output = lambda text: [(1, 1, "tool-input", "x", "run", False), (2, 2, "tool-output", "x", text, False)]
    sign = [(2, "ValueError: bad value")]
    good = documents(spark, output("Exit code: 0\nValueError: bad value"), sign)
    assert good.errors == 0 and "[RESULTS]" in good.document and good.evidence_state == "attempt-observed"
    bad = documents(spark, output("Exit code: 1\nValueError: bad value"), sign)
    assert bad.errors == 1 and "[ERROR EVIDENCE]\n[x] Exit code: 1" in bad.document and bad.evidence_state == "error-observed"


def test_documents_are_bounded(spark):
    units = [(k, k, "user-message", None, f"{k:03d}" + "g" * 5000, False) for k in range(20)] + [(30 + k, 30 + k, "assistant-message", None, f"{k:03d}" + "s" * 3000, False) for k in range(9)]
    d = documents(spark, units)
    assert len(d.goal) == 12_000 and d.goal.endswith("…") and "019g" in d.goal and "000g" not in d.goal
    assert len(d.outcome) == 12_000 and d.outcome.endswith("s") and "008s" in d.outcome
    assert len(d.document) == 24_000 and d.document.startswith("[GOAL]\n000g") and d.document.endswith("…")


def test_whole_documents_are_not(spark):
    goals, said = [f"{k:03d}" + "g" * 5000 for k in range(20)], ["s" * 5000 + f"{k}" for k in range(9)]
    units = [(k, k, "user-message", None, g, False) for k, g in enumerate(goals)] + [(30 + k, 30 + k, "assistant-message", None, s, False) for k, s in enumerate(said)] + [(50, 50, "reasoning", None, None, False)]
    d = C.documents(spark.createDataFrame([(1, *u) for u in units], UNIT), ["e"], "o", event="ev", whole=True).first()
    assert (d.goal, d.outcome) == ("\n\n".join(goals), "\n\n".join(said))
    assert d.document == f"[GOAL]\n{d.goal}\n\n[OUTCOME MESSAGES]\n{d.outcome}"


def test_calls_are_paired_in_order_and_told_apart_by_outcome(spark):
    rows = [(1, "tool-input", "a", "", False, False), (2, "tool-input", "a", "", False, False), (3, "tool-output", None, "ok", False, False), (4, "error", None, "", False, False), (5, "tool-input", "b", "", False, False), (6, "tool-output", None, "x\nexit code: 0", False, True), (7, "tool-input", "b", "", False, False), (8, "tool-output", None, "Exit code: 2", False, True), (9, "tool-output", None, "stray", True, False), (10, "tool-input", "b", "", None, None)]
    df = spark.createDataFrame([(1, k, kind, "act", op, text, err, sig, k * 10) for k, kind, op, text, err, sig in rows], "s long, event_id long, kind string, action string, operation string, text string, is_error boolean, has_signature boolean, us long")
    calls = trace.call_outcomes(df, ["s"])
    assert sorted((r.call_id, r.output_id, r.outcome, r.end_us) for r in calls.collect()) == [(1, 3, "result", 30), (2, 4, "error", 40), (5, 6, "result", 60), (7, 8, "error", 80), (10, None, "unknown", 100)]
    runs = [(r.run_no, r.operation, r.outcome, r["count"], r.first_id, r.last_id) for r in trace.call_runs(calls, ["s"]).orderBy("run_no").collect()]
    assert runs == [(1, "a", "result", 1, 1, 3), (2, "a", "error", 1, 2, 4), (3, "b", "result", 1, 5, 6), (4, "b", "error", 1, 7, 8), (5, "b", "unknown", 1, 10, 10)]


def draft(spark, **given):
    own = {"state": "ready", "decision": None, "moves": ["Go on."], "research": [], "loops": []} | given
    df = spark.createDataFrame([tuple(own.values())], "state string, decision string, moves array<string>, research array<string>, loops array<string>")
    return df.select(C.resume_draft(*(F.col(c) for c in df.columns)).alias("d")).first().d


def test_a_drafts_state_agrees_with_what_is_left(spark):
    assert draft(spark, state="done", moves=["Check the result later."]).state == "ready"
    assert draft(spark, state="done", moves=[]).state == "done" and draft(spark, state="done", moves=[]).fault is None
    assert draft(spark, decision="Should it be merged?").state == "decision"
    closed = draft(spark, state="done", decision="No decision required; it is complete.", moves=["No further action required."])
    assert tuple(closed) == ("done", None, [], None)
    assert draft(spark, state="done", moves=[], loops=["open"]).fault == "next_moves" and draft(spark, state="waiting", moves=[" "]).fault == "next_moves"
    assert draft(spark, state="decision").state == "ready" and draft(spark, state="paused").fault == "state" and draft(spark, state=None, moves=None).fault == "state"
    assert draft(spark, decision="Nonetheless?").decision == "Nonetheless?"


def test_available_runs_prefer_active_ones_and_need_none(spark):
    rows = [(1, "a", "k1", "complete", 5, False), (2, "conversation", "k2", "complete", 3, False), (3, "a", "k3", "failed", 9, True)]
    runs = spark.createDataFrame(rows, "run_id long, profile string, run_key string, status string, completed long, active boolean")
    pick = lambda **o: [r.run_id for r in P.available_run(runs, **o).collect()]
    assert pick() == [2] and pick(prefer="a") == [1] and pick(profile="a") == [1] and pick(run_key="k3") == [] and pick(run_key="k2") == [2]
    more = runs.unionByName(runs.filter("run_id = 1").withColumns({"run_id": F.lit(4).cast("long"), "active": F.lit(True), "completed": F.lit(1).cast("long")}))
    assert [r.run_id for r in P.available_run(more).collect()] == [4]


def test_revisions_do_not_depend_on_order_parts_or_partitions(spark):
    rows = [(k % 5, k, None if k % 7 == 0 else f"t{k}") for k in range(200)]
    df = spark.createDataFrame(rows, "part int, k int, t string")
    now = lambda d: fresh.revision(fresh.fingerprints(d, ["part"], ["k", "t"]), []).first().revision
    assert now(df) == now(df.orderBy(F.desc("k")).repartition(7)) == now(df.withColumn("part", F.lit(1)))
    assert now(df) != now(df.unionByName(df.limit(1))) and now(df) != now(df.fillna("", ["t"])) and now(df) != now(df.filter("k < 199"))
    kept = fresh.fingerprints(df, ["part"], ["k", "t"])
    changed = df.withColumn("t", F.when(F.col("part") == 2, "new").otherwise(F.col("t")))
    again = fresh.replaced(kept, fresh.fingerprints(changed.filter("part = 2"), ["part"], ["k", "t"]), ["part"])
    assert fresh.revision(again, []).first().revision == now(changed)


def status(spark, sources, now="r", derived=(("episodes", "r", None, 3), ("timesheet", "r", 2, 1), ("costs", "r", None, 1)), runs=()):
    s = spark.createDataFrame([("x", *r) for r in sources], "archive string, status string, pending long, errors long")
    n = spark.createDataFrame([("x", now)] if now else [], "archive string, revision string")
    d = spark.createDataFrame([("x", *r) for r in derived], "archive string, what string, revision string, algorithm int, rows int")
    a = spark.createDataFrame([("x", *r) for r in runs], "archive string, profile string, attempt_status string, revision string")
    return fresh.automation_status(s, n, d, a, "archive", algorithm=2).first()


def test_a_status_tells_what_is_stale_and_what_blocks(spark):
    good = status(spark, [("complete", 0, 1)], runs=[("conversation", "complete", "r")])
    assert (good.status, good.warnings, good.actions, good.parse_errors, good.safe) == ("healthy", [], [], 1, True)
    failed = status(spark, [("complete", 0, 0), ("failed", 7, 0)])
    assert failed.status == "blocked" and failed.blocking_reasons == [fresh.FAILED[0]] and failed.pending_bytes == 7 and not failed.safe
    assert status(spark, [("partial", 0, 0)]).warnings == [fresh.INCOMPLETE[0]]
    old = status(spark, [("complete", 0, 0)], now="s")
    assert old.status == "needs-attention" and old.warnings == [fresh.STALE[k][0] for k in ("episodes", "timesheet", "costs")]
    assert status(spark, [("complete", 0, 0)], derived=[]).warnings == [fresh.STALE[k][0] for k in ("episodes", "no-timesheet", "costs")]
    empty = status(spark, [("complete", 0, 0)], now=None, derived=[])
    assert fresh.STALE["episodes"][0] not in empty.warnings and fresh.STALE["no-timesheet"][0] in empty.warnings
    runs = status(spark, [("complete", 0, 0)], runs=[("conversation", "failed", "q"), ("episodes", "failed", None)])
    assert runs.warnings == ["latest semantic conversation attempt failed", "semantic conversation index is stale", "latest semantic episodes attempt failed"]
    assert status(spark, [("complete", 0, 0)], derived=(("episodes", "r", None, 3), ("timesheet", "r", 1, 1), ("costs", "r", None, 1))).actions == [fresh.STALE["timesheet"][1]]


def test_shapes_and_paths_of_records(spark):
    texts = ['{"type":"message","b":1,"payload":{"type":"text"}}', '{"b":2,"type":"message"}', '{"x":[[1,{"y":null}],"s",1.5]}', "[1]", "no", None, '{"message":{"role":"user"}}']
    df = spark.createDataFrame([("p", t) for t in texts], "provider string, body string")
    assert {r.shape: r.records for r in inventory.shapes(df, "provider", "body").collect()} == {"p:message:b,payload,type": 1, "p:message:b,type": 1, "p:history-record:x": 1, "p:history-record:message": 1, "p:parse-error:": 3}
    assert [r[0] for r in df.select(inventory.record_label(F.col("body"))).collect()] == ["message/text", "message", "history-record", None, None, None, "history-record/user"]
    got = {(r.path, r.type): r["values"] for r in inventory.key_paths(df, "body").collect()}
    assert got[("b", "bigint")] == 2 and got[("payload.type", "string")] == 1 and got[("x[][].y", "void")] == 1 and got[("x[][]", "object")] == 1 and got[("x[]", "array")] == 1 and got[("x[]", "decimal")] == 1 and got[("[]", "bigint")] == 1
    deep = spark.createDataFrame([(json.dumps({"a": {"b": {"c": {"d": [1]}}}}),)], "body string")
    assert inventory.key_paths(deep, "body").filter("path = 'a.b.c.d[]'").count() == 1


def test_the_map_has_the_axes_of_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal((40, 6)) * [3, 2, 1, 1, 1, 1] + 20 * np.eye(6)[g] for g in range(3)])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 6)]
    got = {r.id: r for r in semanticmap.project(spark.createDataFrame(rows, "id long, vector array<double>"), "vector", clusters=3).collect()}
    _, v = np.linalg.eigh(np.cov(x.T))
    for k, name in ((1, "x"), (2, "y")):
        axis = v[:, -k] * np.sign(v[np.abs(v[:, -k]).argmax(), -k])
        assert np.allclose([got[i][name] for i in range(120)], x @ axis)
    assert all(len({got[i].cluster for i in range(40 * g, 40 * g + 40)}) == 1 for g in range(3)) and len({got[i].cluster for i in range(120)}) == 3
    assert got[900].cluster is None and got[901].x is None
    few = semanticmap.project(spark.createDataFrame(rows[:4], "id long, vector array<double>"), "vector", clusters=3).collect()
    assert all((r.x, r.y, r.cluster) == (r.vector[0], r.vector[1], -1) for r in few)
