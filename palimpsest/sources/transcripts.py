"""Whole conversations as documents, identities of threads and projects, and artifacts of any provider's fragments.

Nested values of tools may hold media of any size at any depth; one small Arrow-fed
function puts descriptors in their place, message by message. All else is columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from palimpsest.functions import jsontext as J, text as X
from palimpsest.sources import logs
from palimpsest.sources.logs import FRAGMENT, _get, _is_object

# fixed values: what stands for encoded content, the least length of it, and roles by a message's type
OPAQUE = "[opaque encoded payload: {} characters]"
OPAQUE_LENGTH = 1024
INLINE, FILE, FIELDS = "[{} attachment, {} encoded characters]", "[{} attachment{}]", "[Gemini attachment fields: {}]"
ROLES = {"user": "user", "gemini": "assistant", "system": "system"}
COMMAND_KEYS = ["cmd", "command", "chars"]


def visible(c: Column) -> Column:
    """A fragment's text: NUL made visible, white space at the ends gone; encoded content, even if broken into lines, is named only."""
    text = X.strip(F.replace(c, F.lit("\0"), F.lit("␀")))
    compact = F.regexp_replace(text, r"(?U)\s+", "")
    before, after = OPAQUE.split("{}")
    return F.when((F.length(compact) >= OPAQUE_LENGTH) & compact.rlike(r"^[A-Za-z0-9+/=_-]+\z"), F.concat(F.lit(before), F.length(text).cast("string"), F.lit(after))).otherwise(text)


def _described(part: dict) -> str:
    """The descriptor of an object that is no text: inline data, a file, or the names of its fields."""
    inline, file = part.get("inlineData"), part.get("fileData")
    named = lambda holder, key, other: holder[key] if isinstance(holder.get(key), str) and holder[key] else other
    if isinstance(inline, dict):
        return INLINE.format(named(inline, "mimeType", "binary"), len(named(inline, "data", "")))
    if isinstance(file, dict):
        uri = named(file, "fileUri", "")
        return FILE.format(named(file, "mimeType", "file"), f": {uri}" if uri else "")
    return FIELDS.format(", ".join(sorted(part)))


def _named_only(value: Any) -> Any:
    """The value with descriptors in place of media and of long texts under ``data``, at any depth."""
    root = {"": value}
    pending: list[tuple[Any, Any]] = [(root, "")]
    while pending:
        holder, at = pending.pop()
        part = holder[at]
        if isinstance(part, dict) and ("inlineData" in part or "fileData" in part):
            holder[at] = _described(part)
        elif isinstance(part, dict):
            for key, inner in part.items():
                if key == "data" and isinstance(inner, str) and len(inner) >= OPAQUE_LENGTH:
                    part[key] = OPAQUE.format(len(inner))
                else:
                    pending.append((part, key))
        elif isinstance(part, list):
            pending += [(part, k) for k in range(len(part))]
    return root[""]


def _light(text: str | None) -> str | None:
    """A message whose tools' values and contents are safe to keep; what is no JSON object stays as it is."""
    ok, message = J._parsed(text)
    if not ok or not isinstance(message, dict):
        return text
    for call in message["toolCalls"] if isinstance(message.get("toolCalls"), list) else []:
        if isinstance(call, dict):
            call.update({k: _named_only(call[k]) for k in ("args", "result", "resultDisplay") if k in call})
    for field in ("content", "displayContent"):
        items = message.get(field)
        for k, item in enumerate(items if isinstance(items, list) else []):
            if isinstance(item, dict) and "text" not in item:
                if "functionResponse" in item:
                    item["functionResponse"] = _named_only(item["functionResponse"])
                else:
                    items[k] = {"attachment": _described(item)}
    return J._written(message)


@F.pandas_udf(StringType())
def light_messages(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(_light)


def _fragment(kind: Column, value: Column, label: Column | None = None, error: Column | None = None) -> Column:
    return F.struct(kind.alias("kind"), visible(value).alias("text"), (F.lit(None).cast("string") if label is None else F.nullif(label, F.lit(""))).alias("label"), (F.lit(False) if error is None else F.coalesce(error, F.lit(False))).alias("is_error"))


def _contents(json: Column, kind: Column, error: Column) -> Column:
    """Fragments of a content: a text, or a list of texts, answers of functions and attachments."""

    def one(item: Column) -> Column:
        answer, media = _get(item, "$.functionResponse"), _get(item, "$.attachment")
        return (
            F.when(~_is_object(item), _fragment(kind, item, None, error)).when(_get(item, "$.text").isNotNull(), _fragment(kind, _get(item, "$.text"), None, error))
            .when(answer.isNotNull(), _fragment(F.lit("tool-output"), answer, _get(item, "$.functionResponse.name"), error)).otherwise(_fragment(F.lit("attachment"), media))
        )

    none = F.array().cast(FRAGMENT)
    many = F.from_json(json, "array<string>")
    listed = F.transform(F.filter(many, lambda i: i.isNotNull()), one).cast(FRAGMENT)
    return F.when(json.isNull(), none).when(json.startswith("[") & many.isNotNull(), listed).otherwise(F.array(_fragment(kind, json, None, error)).cast(FRAGMENT))


def conversation_documents(documents: DataFrame) -> DataFrame:
    """Events of whole conversations (path, payload): one for the document with its summary, one for each message.

    A message of a known role is a ``message``; another keeps its type, and type
    ``error`` marks its contents. A document that is no JSON object is a single
    ``parse-error``; one without messages has its own event only. Long messages stay
    whole, but encoded content is named by a descriptor. A text in a list that itself
    looks like a JSON object is read as one. byte_offset and payload_hash are kept if
    there are any.
    """
    kept = [c for c in ("byte_offset", "payload_hash") if c in documents.columns]
    d, m = F.col("payload"), F.col("_m")
    ok = F.coalesce(_is_object(F.ltrim(d)) & F.try_parse_json(d).isNotNull(), F.lit(False))
    listed = F.coalesce(F.when(ok, F.from_json(_get(d, "$.messages"), "array<string>")), F.array().cast("array<string>"))
    head = F.array(F.lit(None).cast("string"))
    rows = documents.withColumn("_ok", ok).withColumns({"session_external_id": F.when(ok, _get(d, "$.sessionId")), "_start": _get(d, "$.startTime"), "_summary": _get(d, "$.summary")})
    rows = rows.select("path", *kept, "_ok", "session_external_id", "_start", "_summary", F.posexplode(F.concat(head, F.filter(listed, lambda x: _is_object(x)))).alias("projection_index", "_m"))
    rows = rows.withColumn("_m", light_messages("_m"))
    kind = F.coalesce(F.nullif(_get(m, "$.type"), F.lit("")), F.lit("unknown"))
    role = F.element_at(F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair)), kind)
    error = kind == "error"
    thoughts = F.transform(F.filter(F.from_json(_get(m, "$.thoughts"), "array<string>"), _is_object), lambda t: _fragment(F.lit("reasoning-summary"), _get(t, "$.description"), _get(t, "$.subject")))

    def call(c: Column) -> Column:
        label = F.coalesce(F.nullif(_get(c, "$.name"), F.lit("")), F.nullif(_get(c, "$.displayName"), F.lit("")), F.lit("tool"))
        wrong = _get(c, "$.status") == "error"
        return F.array(_fragment(F.lit("tool-input"), _get(c, "$.args"), label), _fragment(F.lit("tool-output"), _get(c, "$.result"), label, wrong), _fragment(F.lit("tool-output-display"), _get(c, "$.resultDisplay"), label, wrong))

    calls = F.flatten(F.transform(F.filter(F.from_json(_get(m, "$.toolCalls"), "array<string>"), _is_object), call))
    none = F.array().cast(FRAGMENT)
    spoken = F.concat(_contents(_get(m, "$.content"), F.concat(F.coalesce(role, kind), F.lit("-message")), error), _contents(_get(m, "$.displayContent"), F.lit("display-content"), error), F.coalesce(thoughts.cast(FRAGMENT), none), F.coalesce(calls.cast(FRAGMENT), none))
    summary = F.array(_fragment(F.lit("session-summary"), F.col("_summary"))).cast(FRAGMENT)
    first = m.isNull()
    return rows.select(
        "path", *kept, "session_external_id", "projection_index",
        F.when(~F.col("_ok"), "parse-error").when(first, "session_meta").when(role.isNotNull(), "message").otherwise(kind).alias("event_type"),
        F.when(~first, kind).alias("subtype"), F.when(~first, role).alias("role"), F.when(first, F.col("_start")).otherwise(_get(m, "$.timestamp")).alias("timestamp"), _get(m, "$.id").alias("provider_event_id"),
        F.when(~F.col("_ok"), none).otherwise(logs._some(F.when(first, summary).otherwise(spoken))).alias("fragments"),
    ).withColumn("us", X.normalize_timestamp(F.col("timestamp")))


def project_roots(folders: DataFrame, markers: DataFrame, mappings: DataFrame) -> DataFrame:
    """Where each stored folder's project is: a marker file beats a mapping; a folder with neither has no root.

    ``folders``: store, folder; ``markers``: store, folder, content; ``mappings``: store,
    content, a JSON object whose ``projects`` name a folder by path. Of paths of one
    folder the last counts. An empty marker and a mapping that is no JSON say nothing.
    """
    key = ["store", "folder"]
    said = markers.select(*key, X.strip(F.col("content")).alias("_root"), F.sha2("content", 256).alias("_hash")).filter("_root <> ''").groupBy(*key).agg(F.min(F.struct("_root", "_hash")).alias("_marker"))
    named = mappings.select("store", F.sha2("content", 256).alias("_hash"), F.posexplode(F.map_entries(F.from_json(_get(F.col("content"), "$.projects"), "map<string,string>"))).alias("_at", "_e"))
    mapped = named.filter("_e.value is not null").groupBy("store", F.col("_e.value").alias("folder")).agg(F.max_by(F.struct(F.col("_e.key").alias("_root"), "_hash"), F.struct("_hash", "_at")).alias("_map"))
    out = folders.select(*key).distinct().join(said, key, "left").join(mapped, key, "left")
    how = F.when(F.col("_marker").isNotNull(), "project-root-marker").when(F.col("_map").isNotNull(), "projects-json-mapping")
    return out.select(*key, F.coalesce("_marker._root", "_map._root").alias("project_root"), how.alias("evidence_kind"), F.coalesce("_marker._hash", "_map._hash").alias("evidence_sha256"))


def _texts_of(json: Column, keys: list[str]) -> Column:
    """The values under keys of a JSON object that are texts, without white space at the ends and not empty."""
    v = F.try_parse_json(json)
    text = [F.when(F.schema_of_variant(F.variant_get(v, f"$.{k}", "variant")) == "STRING", X.strip(F.variant_get(v, f"$.{k}", "string"))) for k in keys]
    return F.filter(F.array(*text), lambda t: t.isNotNull() & (t != ""))


def artifact_rows(events: DataFrame, key: str = "event_key", *, longest: int = 100_000) -> DataFrame:
    """(key, kind, value, label, value_hash): tools, their commands, code blocks, paths and error signatures of events' fragments.

    Tools and commands stand once for each call; the others once for each event,
    with the label of their first mention (a code block's language). Values are cut
    to ``longest`` characters after they are told apart. Rows go apart by event, so an
    event of any number of mentions is grouped, not listed. Nulls and empty values give none.
    """
    one = events.select(key, F.posexplode("fragments").alias("_at", "_f")).select(key, "_at", "_f.*")
    calls = one.filter("kind = 'tool-input'")
    tool = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.lit("tool"))
    none = F.lit(None).cast("string")
    tools = calls.select(key, F.lit("tool").alias("kind"), tool.alias("value"), none.alias("label"))
    commands = calls.select(key, F.lit("command").alias("kind"), F.explode(_texts_of(F.col("text"), COMMAND_KEYS)).alias("value"), tool.alias("label"))
    text = F.col("text")
    fence = lambda group: F.regexp_extract_all(text, F.lit(r"(?s)```([^\n`]*)\n(.*?)```"), F.lit(group))
    blocks = F.transform(F.arrays_zip(fence(1).alias("l"), fence(2).alias("v")), lambda b: F.struct(F.lit("code-block").alias("kind"), X.strip(b["v"]).alias("value"), F.nullif(X.strip(b["l"]), F.lit("")).alias("label")))
    plain = lambda kind, values, clean: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), clean(v).alias("value"), none.alias("label")))
    paths = plain("path", F.regexp_extract_all(text, F.lit(X.PATH), F.lit(0)), lambda v: X.strip(F.regexp_replace(v, r"\.+$", "")))
    errors = plain("error-signature", F.regexp_extract_all(text, F.lit("(?d)" + X.ERROR_LINE), F.lit(0)), X.normalize_error)
    found = one.select(key, "_at", F.posexplode(F.concat(blocks, paths, errors)).alias("_n", "_a")).select(key, "_at", "_n", "_a.*").filter("value <> ''")
    common = found.groupBy(key, "kind", "value").agg(F.min(F.struct("_at", "_n", "label"))["label"].alias("label")).select(key, "kind", "value", "label")
    return tools.unionByName(commands).unionByName(common).withColumn("value", F.substring("value", 1, longest)).withColumn("value_hash", F.sha2("value", 256))
