"""Documents of conversations, identities of threads and projects, artifacts: small cases and brute force."""

import json
import re

from pyspark.sql import functions as F

from palimpsest.sources import logs, transcripts as R

FRAGMENTS = "k long, fragments array<struct<kind:string,text:string,label:string,is_error:boolean>>"


def lines(spark, *records, path="/r/a.jsonl"):
    return spark.createDataFrame([(path, k, 0, json.dumps(r), str(k)) for k, r in enumerate(records)], "path string, line_no long, byte_offset long, payload string, payload_hash string")


def test_encoded_content_is_named_even_in_lines(spark):
    cases = ["a\0b ", "A" * 1023, "A" * 1024, ("A" * 64 + "\n") * 16, "A" * 1024 + "!", "", None]
    got = [r.v for r in spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, c string").select("k", R.visible(F.col("c")).alias("v")).orderBy("k").collect()]
    assert got == ["a␀b", "A" * 1023, "[opaque encoded payload: 1024 characters]", "[opaque encoded payload: 1039 characters]", "A" * 1024 + "!", "", None]


def test_messages_have_media_results_and_attachments(spark):
    result = {"type": "user", "sessionId": "s", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t", "content": [{"type": "text", "text": ""}, {"type": "image", "source": {"media_type": "image/png", "data": "abcd"}}]}]}}
    media = {"type": "user", "sessionId": "s", "message": {"role": "user", "content": [{"type": "image", "source": {"type": "url"}}, {"type": "document"}]}}
    file = {"type": "attachment", "sessionId": "s", "attachment": {"name": "n.txt", "text": "body", "content": {"b": 1}}}
    rows = logs.message_events(lines(spark, result, media, file, {"type": "attachment", "attachment": "none"})).orderBy("line_no").collect()
    assert [[(f.kind, f.text, f.label) for f in r.fragments] for r in rows] == [
        [("tool-output", "[text attachment]", "t"), ("tool-output", "[image/png attachment, 4 encoded characters]", "t")],
        [("media", "[url attachment]", "image"), ("media", "[document attachment]", "document")],
        [("attachment-text", "body", "n.txt"), ("attachment-text", '{"b":1}', "n.txt")],
        [],
    ]


def test_items_know_their_threads_and_kinds(spark):
    spawned = {"type": "session_meta", "payload": {"id": "x", "source": {"subagent": {"thread_spawn": {"parent_thread_id": "p"}}}}}
    forked = {"type": "session_meta", "payload": {"session_id": "y", "id": "x", "parent_thread_id": "", "forked_from_id": "f"}}
    said = [{"type": "response_item", "payload": {"type": "message", "role": r, "content": [{"type": t, "text": "a"}]}} for r, t in (("developer", "text"), ("tool", "reasoning_text"), ("tool", "text"))]
    rows = logs.item_events(lines(spark, spawned, forked, *said)).orderBy("line_no").collect()
    assert [(r.session_external_id, r.parent_session_external_id) for r in rows[:2]] == [("x", "p"), ("y", "f")]
    assert rows[2].session_external_id == "file:a.jsonl"
    assert [r.fragments[0].kind for r in rows[2:]] == ["developer-message", "reasoning", "message"]


def test_conversation_documents(spark):
    deep = {"a": [{"data": "d" * 1024, "x": {"inlineData": {"mimeType": "m", "data": "1234"}}}], "data": "short"}
    doc = {
        "sessionId": "g", "startTime": "2024-01-01T00:00:00Z", "summary": "sum",
        "messages": [
            {"id": "1", "type": "user", "timestamp": "2024-01-01T00:00:01Z", "content": "q"},
            {"id": "2", "type": "gemini", "content": [{"text": "a"}, {"inlineData": {"data": "12"}}, {"fileData": {"mimeType": "p", "fileUri": "u"}}, {"z": 1, "b": 2}, {"functionResponse": {"name": "f", "r": deep}}, "plain"], "displayContent": "shown",
             "thoughts": [{"subject": "s", "description": "d"}, "no"], "toolCalls": [{"displayName": "t", "args": deep, "result": "r", "resultDisplay": {"fileData": {}}, "status": "error"}, {"args": None}]},
            {"type": "error", "content": "bad"}, "stray", {"type": "info", "content": {"k": 1}},
        ],
    }
    files = spark.createDataFrame([("a", json.dumps(doc)), ("b", "[1"), ("c", '{"sessionId": "h"}'), ("d", None)], "path string, payload string")
    rows = R.conversation_documents(files).orderBy("path", "projection_index").collect()
    assert [(r.path, r.event_type, r.subtype, r.role) for r in rows] == [
        ("a", "session_meta", None, None), ("a", "message", "user", "user"), ("a", "message", "gemini", "assistant"), ("a", "error", "error", None), ("a", "info", "info", None),
        ("b", "parse-error", None, None), ("c", "session_meta", None, None), ("d", "parse-error", None, None),
    ]
    light = '{"a":[{"data":"[opaque encoded payload: 1024 characters]","x":"[m attachment, 4 encoded characters]"}],"data":"short"}'
    assert [(f.kind, f.text, f.label, f.is_error) for f in rows[2].fragments] == [
        ("assistant-message", "a", None, False), ("attachment", "[binary attachment, 2 encoded characters]", None, False), ("attachment", "[p attachment: u]", None, False), ("attachment", "[Gemini attachment fields: b, z]", None, False),
        ("tool-output", '{"name":"f","r":' + light + "}", "f", False), ("assistant-message", "plain", None, False), ("display-content", "shown", None, False), ("reasoning-summary", "d", "s", False),
        ("tool-input", light, "t", False), ("tool-output", "r", "t", True), ("tool-output-display", "[file attachment]", "t", True),
    ]
    assert [(f.kind, f.text, f.is_error) for r in (rows[0], rows[3], rows[4]) for f in r.fragments] == [("session-summary", "sum", False), ("error-message", "bad", True), ("info-message", '{"k":1}', False)]
    assert rows[0].us == 1_704_067_200_000_000 and rows[1].us == rows[0].us + 1_000_000 and rows[5].fragments == []


def test_nested_messages_do_not_end_a_job(spark):
    deep = '{"messages":[{"type":"user","content":"q","x":' + "[" * 3000 + "]" * 3000 + "}]}"
    assert R.conversation_documents(spark.createDataFrame([("a", deep)], "path string, payload string")).count() >= 1


def test_a_marker_beats_a_mapping(spark):
    folders = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c"), ("t", "b"), ("s", "a")], "store string, folder string")
    markers = spark.createDataFrame([("s", "a", " /m/a\n"), ("s", "b", "  ")], "store string, folder string, content string")
    mappings = spark.createDataFrame([("s", json.dumps({"projects": {"/p/a": "a", "/p/b": "b", "/q/b": "b"}})), ("t", "no json")], "store string, content string")
    got = {(r.store, r.folder): (r.project_root, r.evidence_kind) for r in R.project_roots(folders, markers, mappings).collect()}
    assert got == {("s", "a"): ("/m/a", "project-root-marker"), ("s", "b"): ("/q/b", "projects-json-mapping"), ("s", "c"): (None, None), ("t", "b"): (None, None)}


def test_artifacts_stand_once_with_the_label_of_their_first_mention(spark):
    text = "see /etc/hosts, and src/a/b.py.\n```py\nx = 1\n```\n```\nx = 1\n```\n```sh \n\n```\nValueError: bad 0xff"
    rows = [
        (1, [("user-message", text, None, False), ("assistant-message", text, None, False), ("tool-input", '{"cmd": " ls ", "command": 5, "chars": ""}', "Bash", False), ("tool-input", '{"cmd": "ls"}', "Bash", False), ("tool-input", "no json", "", False)]),
        (2, []), (3, None), (4, [("user-message", None, None, False), ("user-message", "", None, False)]),
    ]
    got = sorted((r.k, r.kind, r.value, r.label or "") for r in R.artifact_rows(spark.createDataFrame(rows, FRAGMENTS), "k").collect())
    assert got == [
        (1, "code-block", "x = 1", "py"), (1, "command", "ls", "Bash"), (1, "command", "ls", "Bash"), (1, "error-signature", "ValueError: bad <address>", ""),
        (1, "path", "/etc/hosts,", ""), (1, "path", "src/a/b.py", ""), (1, "tool", "Bash", ""), (1, "tool", "Bash", ""), (1, "tool", "tool", ""),
    ]


def test_code_blocks_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.concat(F.lit("```"), "lang", F.lit("\n"), F.substring("text", 1, 300), F.lit("\n```\n"), "text", F.lit("\n```\n"), F.substring("text", 1, 300), F.lit("\n``` tail")).alias("t"))
    frag = F.array(F.struct(F.lit("user-message").alias("kind"), F.col("t").alias("text"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("is_error")))
    got = sorted((r.doc_id, r.value, r.label) for r in R.artifact_rows(docs.select("doc_id", frag.alias("fragments")), "doc_id").filter("kind = 'code-block'").collect())
    want = []
    for r in docs.collect():
        seen = {}
        for m in re.finditer(r"```([^\n`]*)\n(.*?)```", r.t, re.S):
            if m[2].strip():
                seen.setdefault(m[2].strip(), m[1].strip() or None)
        want += [(r.doc_id, v, label) for v, label in seen.items()]
    assert got == sorted(want)


def test_histories_and_documents_have_providers(spark, tmp_path):
    from palimpsest.sources import providers as P

    message = {"type": "user", "sessionId": "m", "message": {"role": "user", "content": "hello"}}
    past = [{"display": "p", "sessionId": "s", "timestamp": 1704067200000, "project": "/w", "pastedContents": {"1": "x"}}, {"display": "q", "sessionId": "s", "pastedContents": {}}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(json.dumps(message) + "\n")
    (tmp_path / "history.jsonl").write_text("".join(json.dumps(x) + "\n" for x in past))
    (tmp_path / "in" / "d.json").write_text(json.dumps({"sessionId": "g", "messages": [{"type": "user", "content": "c"}]}))
    roots = [str(tmp_path), str(tmp_path / "in")]
    got = P.archive_events(spark, {"message-log": roots, "message-history": roots, "conversation-document": roots})
    rows = sorted((r for r in got.collect() if r.payload_hash), key=lambda r: (r.provider, r.event_type, r.byte_offset))
    assert [(r.provider, r.session_external_id, r.event_type, r.projection_index, r.cwd, [(f.kind, f.text) for f in r.fragments]) for r in rows] == [
        ("conversation-document", "g", "message", 1, None, [("user-message", "c")]), ("conversation-document", "g", "session_meta", 0, None, []),
        ("message-history", "s", "history", 0, "/w", [("user-message", "p"), ("pasted-content", '{"1":"x"}')]), ("message-history", "s", "history", 0, None, [("user-message", "q")]),
        ("message-log", "m", "user", 0, None, [("user-message", "hello")]),
    ]
