"""Provider logs to events, in DataFrame functions alone.

Two kinds of JSON lines are read: *message logs*, whose records hold a message with
content blocks, and *item logs*, whose records hold a typed payload; further whole
JSON documents of a conversation, and delimited version-control logs.  Each reader
returns one row for each record with its fragments as an array, so exploding,
hashing and filtering stay in the engine.  A record that is no JSON object becomes
a ``parse-error`` event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from palimpsest.functions import text as X

FRAGMENT = "array<struct<kind:string,text:string,label:string,is_error:boolean>>"


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, byte_offset, payload, payload_hash) of files below a path; a last line without an end is left for later.

    Files are session logs: each fits a row.  Offsets count bytes of the file.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\n").alias("_l"))
    rows = files.select("path", (F.size("_l") - 1).alias("_whole"), F.posexplode("_l").alias("_n", "payload")).filter("_n < _whole")
    before = Window.partitionBy("path").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.octet_length("payload").cast("long") + 1).over(before), F.lit(0))
    return rows.select("path", (F.col("_n") + 1).alias("line_no"), offset.alias("byte_offset"), "payload", F.sha2("payload", 256).alias("payload_hash"))


def _frag(kind: Column, value: Column, label: Column | None = None, error: Column | None = None) -> Column:
    return F.struct(kind.alias("kind"), X.sanitize(value).alias("text"), (F.lit(None).cast("string") if label is None else label).alias("label"), (F.lit(False) if error is None else F.coalesce(error, F.lit(False))).alias("is_error"))


def _some(fragments: Column) -> Column:
    return F.filter(fragments, lambda f: f["text"].isNotNull() & (f["text"] != ""))


def _get(json: Column, path: str) -> Column:
    return F.get_json_object(json, path)


def _list(json: Column) -> Column:
    """Elements of a JSON array as JSON texts (strings plain); of another value the value alone; of null none."""
    many = F.from_json(json, "array<string>")
    return F.when(json.isNull(), F.array().cast("array<string>")).when(json.startswith("[") & many.isNotNull(), many).otherwise(F.array(json))


def _is_object(json: Column) -> Column:
    return json.startswith("{")


def strict_int(json: Column, path: str) -> Column:
    """A JSON integer of 0 to 2^63 - 1; null for anything else, booleans and fractions too."""
    v = F.variant_get(F.try_parse_json(json), path, "variant")
    return F.when(F.schema_of_variant(v) == "BIGINT", F.when(v.cast("bigint") >= 0, v.cast("bigint")))


def token_usage(line: Column) -> Column:
    """struct of counts of an assistant's message, or null if a count is missing or malformed."""
    m = "$.message.usage."

    def or_zero(path: str) -> Column:
        return F.when(F.variant_get(F.try_parse_json(line), path, "variant").isNull(), F.lit(0).cast("bigint")).otherwise(strict_int(line, path))

    five, hour = or_zero(m + "cache_creation.ephemeral_5m_input_tokens"), or_zero(m + "cache_creation.ephemeral_1h_input_tokens")
    has_total = _get(line, m + "cache_creation_input_tokens").isNotNull()
    total = F.when(has_total, strict_int(line, m + "cache_creation_input_tokens")).otherwise(five + hour)
    inp, out, read = strict_int(line, m + "input_tokens"), strict_int(line, m + "output_tokens"), or_zero(m + "cache_read_input_tokens")
    model = X.strip(_get(line, "$.message.model"))
    ok = (F.coalesce(_get(line, "$.message.role"), _get(line, "$.type")) == "assistant") & (model != "") & (inp >= 0) & (out >= 0) & (read >= 0) & (five + hour <= total)
    return F.when(ok, F.struct(model.alias("model"), _get(line, m + "service_tier").alias("service_tier"), inp.alias("input_tokens"), out.alias("output_tokens"), (total - hour).alias("cache_write_5m_tokens"), hour.alias("cache_write_1h_tokens"), read.alias("cache_read_tokens"), _get(line, "$.message.id").alias("message_id")))


def media_descriptor(block: Column) -> Column:
    """What stands for a block of media: its type and the size of its encoded content, or the block's own type."""
    data = _get(block, "$.source.data")
    size = F.when(F.length(data) > 0, F.concat(F.lit(", "), F.length(data).cast("string"), F.lit(" encoded characters"))).otherwise("")
    named = F.concat(F.lit("["), F.coalesce(F.nullif(_get(block, "$.source.media_type"), F.lit("")), F.nullif(_get(block, "$.source.type"), F.lit("")), F.lit("binary")), F.lit(" attachment"), size, F.lit("]"))
    bare = F.concat(F.lit("["), F.coalesce(_get(block, "$.type"), F.lit("media")), F.lit(" attachment]"))
    return F.when(F.coalesce(_is_object(_get(block, "$.source")), F.lit(False)), named).otherwise(bare)


def _attachment(json: Column) -> Column:
    """Fragments of an attachment's extracted content, text and content, under its name."""
    name = F.coalesce(F.nullif(_get(json, "$.fileName"), F.lit("")), F.nullif(_get(json, "$.name"), F.lit("")), F.lit("attachment"))
    return F.array(*(_frag(F.lit("attachment-text"), _get(json, f"$.{k}"), name) for k in ("extractedContent", "text", "content")))


def _block_fragments(block: Column, role: Column) -> Column:
    kind = F.coalesce(_get(block, "$.type"), F.lit("unknown"))
    error = _get(block, "$.is_error") == "true"
    result = F.transform(_list(_get(block, "$.content")), lambda i: _frag(F.lit("tool-output"), F.when(_is_object(i), F.coalesce(F.nullif(_get(i, "$.text"), F.lit("")), F.nullif(_get(i, "$.content"), F.lit("")), media_descriptor(i))).otherwise(i), _get(block, "$.tool_use_id"), error))
    media = media_descriptor(block)
    one = (
        F.when(~_is_object(block), F.array(_frag(F.concat(role, F.lit("-message")), block)))
        .when(kind == "text", F.array(_frag(F.concat(role, F.lit("-message")), _get(block, "$.text"))))
        .when(kind == "thinking", F.array(_frag(F.lit("reasoning"), _get(block, "$.thinking"))))
        .when(kind == "tool_use", F.array(_frag(F.lit("tool-input"), _get(block, "$.input"), F.coalesce(_get(block, "$.name"), F.lit("tool")))))
        .when(kind == "tool_result", result)
        .when(kind.isin("image", "document"), F.array(_frag(F.lit("media"), media, kind)))
    )
    return one.otherwise(F.array(*(_frag(F.concat(F.lit("block-"), kind), _get(block, f"$.{k}"), kind) for k in ("text", "content", "message"))))


def _common(lines: DataFrame, columns: dict[str, Column], fragments: Column) -> DataFrame:
    ok = _is_object(F.ltrim("payload")) & F.try_parse_json("payload").isNotNull()
    own = {k: F.when(ok, v) for k, v in columns.items()}
    own["event_type"] = F.when(ok, columns["event_type"]).otherwise("parse-error")
    out = lines.select("*", *(v.alias(k) for k, v in own.items()), F.when(ok, _some(fragments)).otherwise(F.array().cast(FRAGMENT)).alias("fragments"))
    return out.withColumn("us", X.normalize_timestamp(F.col("timestamp"))).withColumn("event_key", F.sha2(F.concat_ws("\0", "path", F.col("line_no").cast("string"), "payload_hash"), 256))


def message_events(lines: DataFrame) -> DataFrame:
    """Events of message logs: one for each line, with fragments and token usage."""
    p = F.col("payload")
    role = F.coalesce(_get(p, "$.message.role"), F.lit("message"))
    kind = F.coalesce(_get(p, "$.type"), F.lit("unknown"))
    blocks = F.flatten(F.transform(_list(_get(p, "$.message.content")), lambda b: _block_fragments(b, role)))
    plain = F.when(~F.coalesce(_is_object(_get(p, "$.message")), F.lit(True)), F.array(_frag(F.concat(kind, F.lit("-message")), _get(p, "$.message"), None, _get(p, "$.isApiErrorMessage") == "true")))
    system = F.when(kind == "system", F.array(_frag(F.lit("system-message"), _get(p, "$.content"), _get(p, "$.subtype"), _get(p, "$.subtype").isin("error", "api_error"))))
    other = F.when(kind.isin("queue-operation", "last-prompt", "ai-title"), F.array(_frag(kind, F.coalesce(_get(p, "$.content"), _get(p, "$.lastPrompt"), _get(p, "$.aiTitle")))))
    attached = F.when((kind == "attachment") & _is_object(_get(p, "$.attachment")), _attachment(_get(p, "$.attachment")))
    none = F.array().cast(FRAGMENT)
    every = F.concat(*(F.coalesce(x.cast(FRAGMENT), none) for x in (blocks, plain, system, attached, other)))
    sub = F.nullif(F.regexp_extract("path", r"/subagents/(?:agent-)?([^/]+)\.jsonl$", 1), F.lit(""))
    session = F.coalesce(_get(p, "$.sessionId"), F.nullif(F.regexp_extract("path", r"/([^/]+)/subagents/", 1), F.lit("")), F.regexp_extract("path", r"([^/]+)\.jsonl$", 1))
    columns = {
        "session_external_id": F.when(sub.isNotNull(), F.concat(session, F.lit(":subagent:"), sub)).otherwise(session), "parent_session_external_id": F.when(sub.isNotNull(), session), "event_type": kind, "subtype": _get(p, "$.subtype"),
        "role": F.coalesce(_get(p, "$.message.role"), F.when(kind.isin("user", "assistant", "system"), kind)), "timestamp": _get(p, "$.timestamp"), "provider_event_id": F.coalesce(_get(p, "$.uuid"), _get(p, "$.key")), "parent_event_id": _get(p, "$.parentUuid"),
        "turn_id": F.coalesce(_get(p, "$.promptId"), _get(p, "$.requestId")), "cwd": _get(p, "$.cwd"), "token_usage": token_usage(p),
    }
    return _common(lines, columns, every)


def item_events(lines: DataFrame) -> DataFrame:
    """Events of item logs: a typed payload on each line."""
    p = F.col("payload")
    outer, kind = F.coalesce(_get(p, "$.type"), F.lit("unknown")), _get(p, "$.payload.type")
    role = _get(p, "$.payload.role")
    spoken = lambda block: F.when(role.isin("user", "assistant", "developer", "system"), F.concat(role, F.lit("-message"))).when(F.coalesce(_get(block, "$.type"), F.lit("text")).contains("reason"), "reasoning").otherwise("message")
    message = F.transform(_list(_get(p, "$.payload.content")), lambda b: _frag(F.when(_is_object(b), spoken(b)).otherwise("message"), F.when(_is_object(b), F.coalesce(_get(b, "$.text"), _get(b, "$.content"))).otherwise(b), F.when(_is_object(b), F.coalesce(_get(b, "$.type"), F.lit("text")))))
    reasoning = F.transform(F.concat(_list(_get(p, "$.payload.summary")), _list(_get(p, "$.payload.content"))), lambda b: _frag(F.lit("reasoning"), F.when(_is_object(b), F.coalesce(_get(b, "$.text"), _get(b, "$.summary"))).otherwise(b)))
    call = F.array(_frag(F.lit("tool-input"), F.coalesce(_get(p, "$.payload.arguments"), _get(p, "$.payload.input")), F.coalesce(_get(p, "$.payload.name"), kind)))
    output = F.array(_frag(F.lit("tool-output"), F.coalesce(_get(p, "$.payload.output"), _get(p, "$.payload.content")), _get(p, "$.payload.call_id")))
    item = F.when(kind == "message", message).when(kind.isin("function_call", "custom_tool_call"), call).when(kind.isin("function_call_output", "custom_tool_call_output"), output).when(kind == "reasoning", reasoning).when(kind == "agent_message", F.array(_frag(F.lit("agent-message"), _get(p, "$.payload.message"))))
    wrong = kind.isin("error", "warning", "stream_error")
    history = F.transform(_list(_get(p, "$.payload.replacement_history")), lambda e: _frag(F.when(_get(e, "$.type") == "message", F.concat(F.lit("compacted-"), F.coalesce(_get(e, "$.role"), F.lit("message")))).when(_get(e, "$.type").like("%_output"), "compacted-tool-output").otherwise("compacted-tool-input"), F.coalesce(_get(e, "$.content[0].text"), _get(e, "$.arguments"), _get(e, "$.input"), _get(e, "$.output"), _get(e, "$.content")), _get(e, "$.name")))
    every = (
        F.when(outer == "response_item", item.cast(FRAGMENT))
        .when(outer == "event_msg", F.array(_frag(F.when(wrong, "error").otherwise("event-message"), _get(p, "$.payload.message"), kind, wrong)).cast(FRAGMENT))
        .when(outer == "compacted", F.concat(F.array(_frag(F.lit("compaction-summary"), _get(p, "$.payload.message"))).cast(FRAGMENT), history.cast(FRAGMENT)))
        .when(outer == "turn_context", F.array(_frag(F.lit("context-summary"), _get(p, "$.payload.summary"))).cast(FRAGMENT))
        .when(outer.isin("inter_agent_communication_metadata", "ghost_snapshot"), F.array(_frag(F.lit("agent-metadata"), _get(p, "$.payload.message"))).cast(FRAGMENT))
    )
    session = F.coalesce(_get(p, "$.payload.session_id"), F.when(outer == "session_meta", _get(p, "$.payload.id")), F.nullif(F.regexp_extract("path", r"([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})\.jsonl$", 1), F.lit("")), F.concat(F.lit("file:"), F.regexp_extract("path", r"([^/]+)$", 1)))
    parents = ("parent_thread_id", "forked_from_id", "source.subagent.thread_spawn.parent_thread_id")
    columns = {
        "session_external_id": session, "parent_session_external_id": F.coalesce(*(F.nullif(_get(p, f"$.payload.{k}"), F.lit("")) for k in parents)), "event_type": outer, "subtype": kind, "role": role, "timestamp": F.coalesce(_get(p, "$.timestamp"), _get(p, "$.payload.timestamp")),
        "provider_event_id": F.coalesce(_get(p, "$.payload.id"), _get(p, "$.payload.call_id")), "parent_event_id": _get(p, "$.payload.parent_id"), "turn_id": F.coalesce(_get(p, "$.payload.turn_id"), _get(p, "$.payload.internal_chat_message_metadata_passthrough.turn_id")), "cwd": _get(p, "$.payload.cwd"),
    }
    return _common(lines, columns, F.coalesce(every, F.array().cast(FRAGMENT)))


def history_events(lines: DataFrame, *, text: str, session: str, time: str, pasted: str | None = None, cwd: str | None = None) -> DataFrame:
    """Events of prompt histories: a text, a session and a time on each line, by the given JSON paths; pasted contents and a folder if named."""
    p = F.col("payload")
    columns = {"session_external_id": _get(p, session), "event_type": F.lit("history"), "subtype": F.lit("user-prompt"), "role": F.lit("user"), "timestamp": _get(p, time)}
    if cwd is not None:
        columns["cwd"] = _get(p, cwd)
    more = [] if pasted is None else [_frag(F.lit("pasted-content"), F.when(~_get(p, pasted).isin("{}", "[]"), _get(p, pasted)))]
    return _common(lines, columns, F.array(_frag(F.lit("user-message"), _get(p, text)), *more))


def document_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of whole-file conversations: one for the document and one for each message."""
    docs = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("d"))
    rows = docs.filter(F.try_parse_json("d").isNotNull()).select("path", _get(F.col("d"), "$.sessionId").alias("session_external_id"), "d", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), _list(_get(F.col("d"), "$.messages")))).alias("projection_index", "m"))
    m = F.col("m")
    kind = F.when(_get(m, "$.type") == "user", "user-message").otherwise("assistant-message")
    content = F.transform(_list(_get(m, "$.content")), lambda b: _frag(kind, F.when(_is_object(b), F.coalesce(_get(b, "$.text"), F.lit("[attachment]"))).otherwise(b)))
    thoughts = F.transform(_list(_get(m, "$.thoughts")), lambda t: _frag(F.lit("reasoning-summary"), F.concat_ws(": ", _get(t, "$.subject"), _get(t, "$.description"))))
    calls = F.flatten(F.transform(_list(_get(m, "$.toolCalls")), lambda c: F.array(_frag(F.lit("tool-input"), _get(c, "$.args"), _get(c, "$.name")), _frag(F.lit("tool-output"), _get(c, "$.result"), _get(c, "$.name"), _get(c, "$.status") == "error"))))
    fragments = F.when(m.isNull(), F.array(_frag(F.lit("context-summary"), _get(F.col("d"), "$.summary")))).otherwise(F.concat(content, thoughts, calls))
    return rows.select("path", "session_external_id", "projection_index", F.when(m.isNull(), "session_meta").otherwise(F.coalesce(_get(m, "$.type"), F.lit("unknown"))).alias("event_type"), X.normalize_timestamp(F.coalesce(_get(m, "$.timestamp"), _get(F.col("d"), "$.startTime"))).alias("us"), _get(m, "$.id").alias("provider_event_id"), _some(fragments).alias("fragments"))


def table_events(sessions: DataFrame, messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Events of a store with sessions (id, directory, parent_id, time_created), messages and parts (id, ..., data as JSON).

    One event for each message, in order of its id; its fragments are its parts by
    id: text, reasoning, and tools with input, output and whether they failed.  A
    message without parts has no fragments, and one of an unknown session is kept.
    """
    d = F.col("_p.data")
    kind, state = _get(d, "$.type"), "$.state"
    said = F.when(F.col("_role") == "user", "user-message").otherwise("assistant-message")
    failed = _get(d, f"{state}.status") == "error"
    one = (
        F.when(kind == "text", F.array(_frag(said, _get(d, "$.text")))).when(kind == "reasoning", F.array(_frag(F.lit("reasoning"), _get(d, "$.text"))))
        .when(kind == "tool", F.array(_frag(F.lit("tool-input"), _get(d, f"{state}.input"), _get(d, "$.tool")), _frag(F.lit("tool-output"), F.coalesce(_get(d, f"{state}.output"), _get(d, f"{state}.error")), _get(d, "$.tool"), failed)))
        .when(kind == "file", F.array(_frag(F.lit("attachment"), F.concat_ws(" ", F.lit("[attachment]"), _get(d, "$.mime"), _get(d, "$.filename"))))).otherwise(F.array().cast(FRAGMENT))
    )
    own = messages.select(F.col("id").alias("message_id"), F.col("session_id"), F.col("time_created"), _get(F.col("data"), "$.role").alias("_role"))
    held = parts.select("message_id", F.struct("id", "data").alias("_p")).join(own.select("message_id", "_role"), "message_id").select("message_id", F.col("_p.id").alias("_id"), one.alias("_f"))
    whole = held.groupBy("message_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_id", "_f"))), lambda x: x["_f"])).alias("_all"))
    s = sessions.select(F.col("id").alias("session_id"), F.col("directory").alias("cwd"), F.col("parent_id").alias("parent_session_external_id"))
    out = own.join(whole, "message_id", "left").join(s, "session_id", "left")
    return out.select(F.col("session_id").alias("session_external_id"), "parent_session_external_id", F.lit("message").alias("event_type"), F.col("_role").alias("role"), X.normalize_timestamp(F.col("time_created").cast("string")).alias("us"), F.col("message_id").alias("provider_event_id"), "cwd", _some(F.coalesce("_all", F.array().cast(FRAGMENT))).alias("fragments"))


def commit_log(log: DataFrame, column: str = "value") -> DataFrame:
    """Commits of a log framed by the ASCII record (30) and unit (31) separators: hash, parents, name, email, time, subject, body."""
    records = log.select(F.explode(F.split(column, "\x1e")).alias("r")).select(F.split(X.strip(F.col("r")), "\x1f").alias("f")).filter(F.size("f") >= 6)
    names = ("hash", "parents", "author_name", "author_email", "timestamp", "subject")
    return records.select(*(F.get("f", F.lit(k)).alias(n) for k, n in enumerate(names)), F.array_join(F.slice("f", 7, F.size("f")), "\x1f").alias("body")).withColumn("parents", F.filter(F.split("parents", " "), lambda x: x != "")).withColumn("us", X.normalize_timestamp(F.col("timestamp")))


def reflog(lines: DataFrame, column: str = "value") -> DataFrame:
    """Entries of reference logs: old and new hash, name, email, seconds, offset and message."""
    pattern = r"^([0-9a-f]{40,64}) ([0-9a-f]{40,64}) (.*) <([^>]*)> (\d+) ([+-]\d{4})\t?(.*)$"
    names = ("old", "new", "name", "email", "seconds", "offset", "message")
    return lines.filter(F.col(column).rlike(pattern)).select(*(F.regexp_extract(column, pattern, k + 1).alias(n) for k, n in enumerate(names))).withColumn("us", F.col("seconds").cast("long") * 1_000_000)


def commit_owners(seen: DataFrame) -> DataFrame:
    """(hash, identity): the repository that saw a commit first owns it; ties go to the lesser identity."""
    return seen.groupBy("hash").agg(F.min_by("identity", F.struct("first_seen", "identity")).alias("identity"))


def in_scope(sources: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """Files (path, modified) within days, both included: by the day in the path (…/yyyy/mm/dd/…) or else of their change.

    Adds ``decision``: exact, mtime or unbounded.
    """
    day = F.to_date(F.nullif(F.regexp_extract("path", r"/(\d{4}/\d{2}/\d{2})/", 1), F.lit("")), "yyyy/MM/dd")
    out = sources.withColumn("_day", F.coalesce(day, F.to_date("modified")))
    out = out.withColumn("decision", F.lit("unbounded") if first is None and last is None else F.when(day.isNotNull(), "exact").otherwise("mtime"))
    if first is not None:
        out = out.filter(F.col("_day") >= F.lit(first).cast("date"))
    if last is not None:
        out = out.filter(F.col("_day") <= F.lit(last).cast("date"))
    return out.drop("_day")
