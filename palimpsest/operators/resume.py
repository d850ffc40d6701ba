"""Picking work up again: bounded evidence of a thread, and the surfaces and places that are shown for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.functions import text as T

# fixed values: kinds of units read from a thread's head and from its tail, and types of events that are no evidence
HEAD = ["user-message", "assistant-message", "agent-message", "context-summary", "compaction-summary"]
TAIL = [*HEAD, "tool-input", "tool-output", "event-message"]
IGNORED = ["compacted", "parse-error", "last-prompt", "ai-title"]


def iso_utc(us: Column) -> Column:
    """An instant in UTC as ISO 8601 text, whatever the session's time zone; a fraction only where there is one."""
    whole = F.floor(us / 1_000_000)
    t = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=whole.cast("decimal(18,6)"))
    rest = F.pmod(us, F.lit(1_000_000))
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(rest == 0, "").otherwise(F.format_string(".%06d", rest)), F.lit("+00:00"))


def evidence_line(longest: int) -> Column:
    """A unit as one line: time, provider, role, kind with label and error mark, and its text in at most ``longest`` characters."""
    body = T.tidy(F.coalesce("text", F.lit("")))
    cut = F.when(F.length(body) > longest, F.concat(F.substring(body, 1, longest - 1), F.lit("…"))).otherwise(body)
    label = F.when(F.col("label") != "", F.concat(F.lit("/"), "label")).otherwise("")
    error = F.when(F.col("is_error"), "/error").otherwise("")
    when = F.coalesce(iso_utc(F.col("us")), F.lit("unknown-time"))
    role = F.when(F.col("role") != "", F.col("role")).otherwise(F.col("kind"))
    return F.concat(F.lit("["), when, F.lit(" | "), F.coalesce("provider", F.lit("")), F.lit(" | "), role, F.lit(" | "), "kind", label, error, F.lit("] "), cut)


def packets(units: DataFrame, events: DataFrame, group: str, *, head: int = 40, tail: int = 110, early: int = 14_000, recent: int = 28_000, longest: int = 2_400) -> DataFrame:
    """One row for each group with a unit of evidence: early and recent lines under their budgets, totals and a fingerprint.

    ``units`` has provider, us, ordinal, event_id, unit_index, role, kind, label,
    is_error, text, content_hash and event_type; ``events`` has event_id and
    event_type. A group's first ``head`` spoken units and last ``tail`` units of
    any kind are merged; early lines fill their budget from the first one on,
    recent lines from the last one backwards. A first line beyond its budget is
    cut, not left out. Units without a time come first. Rows that repeat an
    (event, unit) share its place, and one of them stays. Ranks are limited before the shuffle, so a group of
    any size sends only head and tail units of each task.
    """
    key = ["event_id", "unit_index"]
    order = ["us", "ordinal", *key]
    evidence = ~F.coalesce(F.col("event_type").isin(IGNORED), F.lit(False))
    read = units.filter(evidence & F.col("kind").isin(TAIL)).select(group, *order, "kind", "content_hash", evidence_line(longest).alias("_line"))
    up = Window.partitionBy(group).orderBy(F.asc_nulls_first("us"), "ordinal", *key)
    down = Window.partitionBy(group).orderBy(F.desc_nulls_last("us"), F.desc("ordinal"), *(F.desc(c) for c in key))
    first = read.filter(F.col("kind").isin(HEAD)).withColumn("_n", F.dense_rank().over(up)).filter(F.col("_n") <= head).withColumn("_early", F.lit(True))
    last = read.withColumn("_n", F.dense_rank().over(down)).filter(F.col("_n") <= tail).withColumn("_early", F.lit(False))
    row = F.max(F.struct("us", "ordinal", "content_hash", "_line"))
    both = first.unionByName(last).groupBy(group, *key).agg(F.max("_early").alias("_early"), row.alias("_row")).select(group, *key, "_early", "_row.*")
    # from here on a group has at most head + tail rows
    size = F.length("_line")
    placed = both.withColumn("_at", F.row_number().over(up))
    forth, back = Window.partitionBy(group).orderBy("_at"), Window.partitionBy(group).orderBy(F.desc("_at"))
    filled = placed.withColumn("_used", F.sum(F.when(F.col("_early"), F.least(size, F.lit(early))).otherwise(0)).over(forth)).withColumn("_left", F.sum(F.least(size, F.lit(recent))).over(back))
    taken = lambda ok, line: F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("_at", line.alias("line"))))), lambda x: x["line"])
    names = F.transform(F.array_sort(F.collect_list(F.struct("_at", F.concat_ws(":", F.col("event_id"), F.col("unit_index"), F.coalesce("content_hash", F.lit(""))).alias("name")))), lambda x: x["name"])
    out = filled.groupBy(group).agg(
        taken(F.col("_early") & (F.col("_used") <= early), F.substring("_line", 1, early)).alias("early_evidence"),
        taken(F.col("_left") <= recent, F.when(size > recent, F.expr(f"right(_line, {int(recent)})")).otherwise(F.col("_line"))).alias("recent_evidence"),
        names.alias("_names"),
    )
    totals = events.filter(evidence).groupBy(group).agg(F.count("*").alias("source_events"), F.max("event_id").alias("last_event_id"))
    out = out.join(totals, group, "left").na.fill(0, ["source_events", "last_event_id"])
    parts = F.concat(F.array(F.col("source_events").cast("string"), F.col("last_event_id").cast("string")), "_names")
    return out.withColumn("evidence_fingerprint", F.sha2(F.array_join(parts, "\n"), 256)).drop("_names")


def newest_surfaces(surfaces: DataFrame, limit: int = 200) -> DataFrame:
    """The surfaces of latest activity (at most 500: a list's feature) with their lists read; a list that is no JSON is empty."""
    lists = {c: F.coalesce(F.from_json(f"{c}_json", "array<string>"), F.array().cast("array<string>")) for c in ("next_moves", "research_directions", "open_loops")}
    newest = surfaces.orderBy(F.desc_nulls_last("last_us"), F.desc("surface_id")).limit(min(max(int(limit), 1), 500))
    return newest.withColumns(lists).drop(*(f"{c}_json" for c in lists))


def surface_places(newest: DataFrame, links: DataFrame, sessions: DataFrame) -> DataFrame:
    """Places of each listed surface, the last session of each, later ones first, numbered from 1.

    A place is a machine, folder, project and provider. ``newest`` has at most 500
    rows (see above), so its ids may be broadcast.
    """
    place = ["machine", "cwd", "project", "provider"]
    own = links.join(F.broadcast(newest.select("surface_id").distinct()), "surface_id", "left_semi").join(sessions, "session_id")
    rest = [c for c in sessions.columns if c not in place]
    last = own.groupBy("surface_id", *place).agg(F.max(F.struct("position", *rest)).alias("_last")).select("surface_id", *place, "_last.*")
    return last.withColumn("place_no", F.row_number().over(Window.partitionBy("surface_id").orderBy(F.desc("position"), "session_id")))


def surface_overview(surfaces: DataFrame, runs: DataFrame, sessions: DataFrame) -> DataFrame:
    """(what, name, value): surfaces of each state and in all, the last run's id and status, the latest activity of any session."""
    long = lambda c: F.col(c).cast("string")
    states = surfaces.groupBy(F.col("state").alias("name")).agg(F.count("*").alias("n")).select(F.lit("state").alias("what"), "name", long("n").alias("value"))
    total = surfaces.agg(F.count("*").alias("n")).select(F.lit("total"), F.lit(""), long("n"))
    run = runs.agg(F.max(F.struct("started", "run_id", "status")).alias("r")).filter("r is not null").select(F.lit("latest_run"), F.col("r.status"), F.col("r.run_id").cast("string"))
    seen = sessions.agg(F.max(F.coalesce("end_us", "start_us")).alias("n")).select(F.lit("latest_activity"), F.lit(""), long("n"))
    return states.union(total).union(run).union(seen)
