"""Providers of logs: one contract, so that a new format needs no change of this library.

A provider says which files are its own, how they are divided into raw records, and
turns records into rows of ``EVENTS``.  A column provider does that with DataFrame
functions; a record provider with a Python function of one record, which runs as a
polymorphic table function next to the data.  Providers are registered by name, by
other packages too, through the entry points of the group ``palimpsest.providers``.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from importlib.metadata import entry_points
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.sources import growing, logs, transcripts

#: What every provider gives for each projected event.
EVENTS = (
    "provider string, path string, byte_offset long, payload_hash string, projection_index int, session_external_id string, parent_session_external_id string, event_type string, subtype string, role string, "
    "timestamp string, provider_event_id string, parent_event_id string, turn_id string, cwd string, project string, parse_error string, fragments " + logs.FRAGMENT
)
_NAMES = [c.split()[0] for c in EVENTS.split(", ")]
#: Columns that a record's function may fill.
PARSED = tuple(n for n in _NAMES if n not in ("provider", "path", "byte_offset", "payload_hash", "projection_index", "parse_error"))


class Provider(ABC):
    """``suffix`` tells a provider's files below its roots; ``parser_version`` grows whenever records would be read differently."""

    name: str
    suffix: str = ".jsonl"
    parser_version: int = 1

    def records(self, spark: SparkSession, roots: list[str]) -> DataFrame:
        """Raw records (path, byte_offset, payload, payload_hash): the finished lines of all files below the roots."""
        growing.register(spark)
        parts = [spark.read.format("growing_lines").options(path=r, suffix=self.suffix).load() for r in dict.fromkeys(roots)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.dropDuplicates(["path", "byte_offset"]) if len(parts) > 1 else out  # roots may lie within one another

    @abstractmethod
    def events(self, records: DataFrame) -> DataFrame:
        """Rows with any of the columns of ``EVENTS``."""

    def project_name(self, cwd: str | None) -> str | None:
        return cwd


class ColumnProvider(Provider):
    """A provider whose records a function of DataFrames reads."""

    def __init__(self, name: str, read: Callable[[DataFrame], DataFrame], *, suffix: str = ".jsonl", parser_version: int = 1) -> None:
        self.name, self.read, self.suffix, self.parser_version = name, read, suffix, parser_version

    def events(self, records: DataFrame) -> DataFrame:
        return self.read(records.withColumn("line_no", F.col("byte_offset")))


class DocumentProvider(ColumnProvider):
    """A column provider whose records are whole files; each fits a row."""

    def records(self, spark: SparkSession, roots: list[str]) -> DataFrame:
        files = spark.read.text(list(dict.fromkeys(roots)), wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{self.suffix}")
        out = files.select(F.col("_metadata.file_path").alias("path"), F.lit(0).cast("long").alias("byte_offset"), F.col("value").alias("payload"), F.sha2("value", 256).alias("payload_hash"))
        return out.dropDuplicates(["path"]) if len(roots) > 1 else out  # roots may lie within one another


class RecordProvider(Provider):
    """A provider that reads one decoded record at a time; what it raises becomes a parse error of that record alone."""

    def parse(self, data: dict[str, Any], path: str) -> dict[str, Any]:
        """One event of a record."""
        raise NotImplementedError

    def parse_many(self, data: Any, path: str) -> list[dict[str, Any]]:
        """All events of a record; by default the one of :meth:`parse`, of a JSON object only."""
        if not isinstance(data, dict):
            raise ValueError("top-level JSON value is not an object")
        return [self.parse(data, path)]

    def events(self, records: DataFrame) -> DataFrame:
        provider = self
        kinds = ", ".join(f"{n} {logs.FRAGMENT if n == 'fragments' else 'string'}" for n in PARSED)

        class Parse:
            def eval(self, payload: str, path: str) -> Iterator[tuple]:
                try:
                    found = [tuple(_fragments(e.get(n)) if n == "fragments" else _text(e.get(n)) for n in PARSED) for e in provider.parse_many(json.loads(payload), path)]
                except Exception as e:  # a record must not stop the others
                    bad = dict.fromkeys(PARSED) | {"event_type": "parse-error", "fragments": []}
                    yield 0, f"{type(e).__name__}: {e}"[:500], *(bad[n] for n in PARSED)
                    return
                for k, values in enumerate(found):
                    yield k, None, *values

        table = F.udtf(Parse, returnType=f"projection_index int, parse_error string, {kinds}")
        return records.lateralJoin(table(F.col("payload").outer(), F.col("path").outer()))


def _text(value: Any) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def _fragments(values: Any) -> list[tuple]:
    return [(f.get("kind"), _text(f.get("text")), f.get("label"), bool(f.get("is_error"))) for f in values or () if f.get("text") not in (None, "")]


_registered: dict[str, Provider] = {}


def register(provider: Provider) -> Provider:
    """Add a provider under its name; a name has one provider."""
    if provider.name in _registered and _registered[provider.name] is not provider:
        raise ValueError(f"{provider.name} is already registered")
    _registered[provider.name] = provider
    return provider


def providers() -> dict[str, Provider]:
    """All providers by name: those of this library, registered ones, and those of installed packages."""
    for e in entry_points(group="palimpsest.providers"):
        if e.name not in _registered:
            register(e.load()())
    return dict(_registered)


def archive_events(spark: SparkSession, roots: dict[str, list[str]]) -> DataFrame:
    """The events of all named providers below their roots, in the one schema ``EVENTS``."""
    out = None
    for name, places in roots.items():
        provider = providers()[name]
        found = provider.events(provider.records(spark, places)).withColumn("provider", F.lit(name))
        wanted = [(F.col(n) if n in found.columns else F.lit(None)).cast(t).alias(n) for n, t in (c.split(" ", 1) for c in EVENTS.split(", "))]
        rows = found.select(*wanted).withColumn("projection_index", F.coalesce("projection_index", F.lit(0)))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no provider was named")
    return out


#: A prompt history lies beside the logs that it repeats and has a provider of its own.
HISTORY = "history.jsonl"


def _logs(read: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda lines: read(lines.filter(F.element_at(F.split("path", "/"), -1) != HISTORY))


register(ColumnProvider("message-log", _logs(logs.message_events)))
register(ColumnProvider("item-log", _logs(logs.item_events)))
register(ColumnProvider("message-history", lambda r: logs.history_events(r, text="$.display", session="$.sessionId", time="$.timestamp", pasted="$.pastedContents", cwd="$.project"), suffix=HISTORY))
register(ColumnProvider("item-history", lambda r: logs.history_events(r, text="$.text", session="$.session_id", time="$.ts"), suffix=HISTORY))
register(DocumentProvider("conversation-document", transcripts.conversation_documents, suffix=".json"))
