"""Filters of searches and scopes: what a caller may ask for, as one predicate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Kinds of text units by what a policy admits.
MESSAGES = ("user-message", "assistant-message", "message", "system-message")
REASONING = ("reasoning",)
REASONING_SUMMARIES = ("reasoning-summary",)
TOOLS = ("tool-input", "tool-output", "tool-input-display")
CONTEXT = ("context-summary", "compaction-summary", "last-prompt", "ai-title")


def clamp(value: int, most: int, least: int = 1) -> int:
    """A caller's limit within what an interface allows."""
    return min(max(value, least), most)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def matching(
    rows: DataFrame, *, equal: dict[str, object] | None = None, any_of: dict[tuple[str, ...], object] | None = None, classification: str | None = None, date_from: object = None, date_to: object = None, errors_only: bool = False, include_reasoning: bool = True, time: str = "us"
) -> DataFrame:
    """Rows that meet every filter that is set; None and empty strings set none.

    ``any_of`` asks that one of several columns has the value; ``classification``
    counts a null as 'unclassified'; both date bounds are inclusive, and a row
    without a time fails them.
    """

    def is_set(v: object) -> bool:
        return v is not None and v != ""

    found = [F.col(c) == F.lit(v) for c, v in (equal or {}).items() if is_set(v)]
    found += [reduce(lambda a, b: a | b, [F.coalesce(F.col(c) == F.lit(v), F.lit(False)) for c in cs]) for cs, v in (any_of or {}).items() if is_set(v)]
    if is_set(classification):
        found.append(F.coalesce("classification", F.lit("unclassified")) == classification)
    if is_set(date_from):
        found.append(F.col(time) >= F.lit(date_from))
    if is_set(date_to):
        found.append(F.col(time) <= F.lit(date_to))
    if errors_only:
        found.append(F.col("is_error"))
    if not include_reasoning:
        found.append(~F.col("kind").isin(*REASONING, *REASONING_SUMMARIES))
    return rows.filter(all_of(found))


def admitted_kinds(*, reasoning: bool = False, summaries: bool = False, tools: bool = False, context: bool = False) -> list[str]:
    return [*MESSAGES, *(REASONING if reasoning else ()), *(REASONING_SUMMARIES if summaries else ()), *(TOOLS if tools else ()), *(CONTEXT if context else ())]


def scope_values(values: list[object] | None) -> list[str]:
    """Distinct non-empty values as text, in their order."""
    return list(dict.fromkeys(str(v).strip() for v in values or () if v is not None and str(v).strip()))


def scoped(rows: DataFrame, kinds: list[str], *, providers: list[object] | None = None, projects: list[object] | None = None, date_from: str | None = None, date_to: str | None = None, project_columns: tuple[str, ...] = ("project",), day: Column | None = None) -> DataFrame:
    """Rows of admitted kinds within a scope of providers, projects and UTC days (ISO texts, inclusive).

    A row with any of the projects in any of its columns is in; without a day it
    is out as soon as a date bound is set.
    """
    found = [F.col("kind").isin(*kinds)]
    if providers := scope_values(providers):
        found.append(F.coalesce(F.col("provider"), F.lit("")).isin(*providers))
    if projects := scope_values(projects):
        found.append(reduce(lambda a, b: a | b, [F.coalesce(F.col(c).cast("string").isin(*projects), F.lit(False)) for c in project_columns]))
    day = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd") if day is None else day
    if date_from:
        found.append(F.coalesce(day >= date_from[:10], F.lit(False)))
    if date_to:
        found.append(F.coalesce(day <= date_to[:10], F.lit(False)))
    return rows.filter(all_of(found))


def independent(events: DataFrame, units: DataFrame, *, key: str = "event_id", exclude: tuple[str, ...] = ()) -> DataFrame:
    """Canonical events of no excluded type or history source that have at least one text unit."""
    own = events.filter(F.col("canonical_id").isNull() & ~F.col("event_type").isin(*exclude) & (F.coalesce("source_kind", F.lit("")) != "history"))
    return own.join(units.select(key).distinct(), key, "left_semi")


def in_period(rows: DataFrame, start_us: int, end_us: int, *, time: str = "us", fallback: str = "start_us") -> DataFrame:
    """Rows whose time, or else whose session's start, lies in [start_us, end_us)."""
    at = F.coalesce(time, fallback)
    return rows.filter((at >= start_us) & (at < end_us))


def touching(rows: DataFrame, start_us: int, end_us: int, *, start: str = "start_us", end: str = "end_us") -> DataFrame:
    """Rows whose [start, end or else start] meets [start_us, end_us)."""
    return rows.filter((F.col(start) < end_us) & (F.coalesce(end, start) >= start_us))
