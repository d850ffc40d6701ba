"""Reports and statuses of an archive: totals, roll-ups, retention and run states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def left_totals(dim: DataFrame, key: str, totals: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """A dimension with a total of each fact table, zero where it has none; facts are summed before they are joined."""
    out = dim
    for name, (facts, total) in totals.items():
        out = out.join(facts.groupBy(key).agg(total.cast("long").alias(name)), key, "left")
    return out.na.fill(0, list(totals))


def registry_summary(sessions: DataFrame, aliases: DataFrame, defaults: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """One row: projects, aliases, and sessions without a contributor or without a default activity at their start.

    With ``projects`` (project_id, is_unresolved) the registry's own projects are
    counted, and those that are unresolved; without it, the projects of sessions.
    A session without a project has no default activity.
    """
    dated = defaults.select(F.col("project_id").alias("_p"), "from_us", "to_us")
    on = (F.col("project_id") == F.col("_p")) & (F.col("start_us") >= F.col("from_us")) & (F.col("start_us") < F.col("to_us"))
    bare = sessions.join(dated, on, "left_anti").agg(F.count("*").alias("unresolved_activities"))
    people = F.count_if(F.col("contributor_id").isNull()).alias("unresolved_contributors")
    if projects is None:
        own = sessions.agg(F.countDistinct("project_id").alias("projects"), people)
    else:
        own = sessions.agg(people).crossJoin(projects.agg(F.count("*").alias("projects"), F.count_if("is_unresolved").alias("unresolved_projects")))
    return own.crossJoin(aliases.agg(F.count("*").alias("aliases"))).crossJoin(bare)


def episode_projects(episodes: DataFrame) -> DataFrame:
    """Episodes, those with errors, attempts and active hours of each project; null is '(unknown)'."""
    return episodes.groupBy(F.coalesce("project", F.lit("(unknown)")).alias("project")).agg(F.count("*").alias("episodes"), F.count_if(F.col("errors") > 0).alias("error_episodes"), F.sum("attempts").alias("attempts"), F.round(F.sum("active_us") / 3_600_000_000.0, 6).alias("active_hours"))


def episode_stats(episodes: DataFrame, session: str = "session_id") -> DataFrame:
    return episodes.agg(F.count("*").alias("episodes"), F.countDistinct(session).alias("sessions"), F.count_if(F.col("errors") > 0).alias("error_episodes"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"), F.round(F.coalesce(F.sum("active_us"), F.lit(0)) / 1_000_000.0, 6).alias("active_seconds"))


def largest_sessions(sessions: DataFrame, top: int) -> DataFrame:
    """The sessions of most events with their span in hours (a top-k report)."""
    hours = F.round((F.col("end_us") - F.col("start_us")) / 3_600_000_000.0, 6)
    return sessions.select("session_id", "events", hours.alias("hours")).orderBy(F.desc("events"), F.desc("hours"), "session_id").limit(top)


def largest(rows: DataFrame, order: list, top: int) -> DataFrame:
    """The first rows of a total order with their rank; only they are ranked."""
    return rows.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def reconcile(sessions: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Sessions with counts and bounds taken anew from their events.

    A bound without any dated event stays as it was; sessions without events go
    unless a source names them (``sourced``).
    """
    now = events.groupBy(key).agg(F.count("*").alias("events"), F.min("us").alias("_lo"), F.max("us").alias("_hi"))
    out = sessions.drop("events").join(now, key, "left").na.fill(0, ["events"])
    out = out.withColumn("start_us", F.coalesce("_lo", "start_us")).withColumn("end_us", F.coalesce("_hi", "end_us")).drop("_lo", "_hi")
    return out.filter(F.col("sourced") | (F.col("events") > 0))


def archive_status(revisions: DataFrame) -> DataFrame:
    """One row over (source, status, pending, byte_length, real_length)."""
    failing = F.col("status").isin("failed", "partial") | (F.col("pending") > 0)
    states = [F.count_if(F.col("status") == s).alias(s) for s in ("complete", "failed", "partial")]
    return revisions.agg(F.countDistinct("source").alias("sources"), F.count("*").alias("revisions"), F.count_if(F.col("byte_length") != F.col("real_length")).alias("length_mismatches"), F.count_if(failing).alias("attention"), F.coalesce(F.sum("pending"), F.lit(0)).alias("pending_bytes"), *states)


def active_status(sources: DataFrame, revisions: DataFrame, records: DataFrame, payloads: DataFrame) -> DataFrame:
    """One row: sources, revisions, records and payloads of an archive, and the state of the revisions that are active.

    ``sources``: source_id, active_revision_id; ``revisions``: revision_id, status,
    pending, size_bytes, ingested; ``payloads``: byte_length, real_length. Sources without an
    active revision count as sources only.
    """
    active = sources.join(revisions.withColumnRenamed("revision_id", "active_revision_id"), "active_revision_id")
    failing = F.col("status").isin("failed", "partial") | (F.col("pending") > 0)
    states = [F.count_if(F.col("status") == s).alias(s) for s in ("complete", "failed", "partial")]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    now = active.agg(F.count_if(failing).alias("attention"), total("pending").alias("pending_bytes"), total("size_bytes").alias("source_bytes"), total("ingested").alias("indexed_bytes"), *states)
    counts = [df.agg(F.count("*").alias(name)) for name, df in (("sources", sources), ("revisions", revisions), ("raw_records", records))]
    whole = payloads.agg(F.count("*").alias("raw_payloads"), F.count_if(F.col("byte_length") != F.col("real_length")).alias("length_mismatches"))
    return reduce(DataFrame.crossJoin, [*counts, whole, now])  # frames of one row


def corpus_scope(events: DataFrame, sessions: DataFrame, counts: dict[str, DataFrame]) -> DataFrame:
    """(what, name, value): rows of each table, parse errors, first and last instant, sessions of each provider."""
    tables = [df.agg(F.lit("rows").alias("what"), F.lit(name).alias("name"), F.count("*").alias("value")) for name, df in counts.items()]
    one = events.agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("parse_error").alias("parse_errors"))
    range_ = one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, one.columns)), F.array(*one.columns))).alias("name", "value")).select(F.lit("events"), "name", "value")
    by = sessions.groupBy("provider").agg(F.count("*").alias("n")).select(F.lit("provider"), "provider", "n")
    return reduce(DataFrame.union, [*tables, range_, by])


def interval_origins(intervals: DataFrame, members: DataFrame, legacy: DataFrame, events: DataFrame, version_control: str = "git") -> DataFrame:
    """Whether each interval's evidence comes from version control, from conversations or from both; null without evidence.

    Evidence is a shared set (``members``: evidence_set_id, event_id); an interval
    without a set has its own rows (``legacy``: interval_id, event_id), which are
    not read where there is a set. A set is told once and then joined, so that many
    intervals of one set multiply nothing. ``events``: event_id, provider.
    """
    who = events.select("event_id", (F.col("provider") == version_control).alias("_git"))
    flags = [F.coalesce(F.bool_or("_git"), F.lit(False)).alias("has_git"), F.coalesce(F.bool_or(~F.col("_git")), F.lit(False)).alias("has_chat")]
    sets = members.join(who, "event_id").groupBy("evidence_set_id").agg(*flags)
    bare = intervals.filter("evidence_set_id is null")
    own = legacy.join(bare.select("interval_id").distinct(), "interval_id", "left_semi").join(who, "event_id").groupBy("interval_id").agg(*flags)
    shared = intervals.filter("evidence_set_id is not null").join(sets, "evidence_set_id", "left")
    both = shared.unionByName(bare.join(own, "interval_id", "left"))
    origin = F.when(F.col("has_git") & F.col("has_chat"), "both").when(F.col("has_git"), "git").when(F.col("has_chat"), "chat")
    return both.withColumn("origin", origin)


def locations(sessions: DataFrame, spoken: DataFrame, group: str) -> DataFrame:
    """Places where a group's work went on, the newest session of each, newest first.

    Only sessions with words of the user count (``spoken``: their ids); a place is
    a machine, folder, project and provider.
    """
    newest = [F.desc("end_us"), F.desc("session_id")]
    own = sessions.join(spoken.select("session_id").distinct(), "session_id", "left_semi")
    one = own.withColumn("_n", F.row_number().over(Window.partitionBy(group, "machine", "cwd", "project_id", "provider").orderBy(*newest))).filter("_n = 1").drop("_n")
    return one.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*newest)))


def run_status(*, caught: Column, release_error: Column, failed: Column, generated: Column, reused: Column) -> Column:
    """failed if the run was cut short; with failures partial if it gave anything, else failed; otherwise complete."""
    faulty = release_error | (failed > 0)
    return F.when(caught, "failed").when(faulty, F.when((generated > 0) | (reused > 0), "partial").otherwise("failed")).otherwise("complete")


def merged(parts: DataFrame, *, sums: list[str], tops: list[str]) -> DataFrame:
    """Summaries of parts as one: totals add up, marks take the greatest; independent of order."""
    return parts.agg(*(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in tops))


def older_than(rows: DataFrame, by: list[str], order: list, keep: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") > keep).drop("_n")


def available_run(runs: DataFrame, *, profile: str | None = None, run_key: str | None = None, prefer: str = "conversation") -> DataFrame:
    """The complete run to use: active ones first, then the preferred profile, then the newest; one row or none.

    ``profile`` and ``run_key`` leave only runs of theirs.
    """
    found = runs.filter("status = 'complete'")
    for column, value in (("profile", profile), ("run_key", run_key)):
        if value is not None:
            found = found.filter(F.col(column) == value)
    liked = (F.col("profile") == prefer).cast("int")
    return found.orderBy(F.desc_nulls_last("active"), F.desc_nulls_last(liked), F.desc_nulls_last("completed"), F.desc("run_id")).limit(1)


def run_overview(runs: DataFrame) -> DataFrame:
    """Each profile's latest attempt and latest complete run, and whether they are the same."""
    last = runs.groupBy("profile").agg(F.max("run_id").alias("attempt_id"), F.max_by("status", "run_id").alias("attempt_status"), F.max(F.when(F.col("status") == "complete", F.col("run_id"))).alias("complete_id"))
    return last.withColumn("fresh", F.coalesce(F.col("complete_id") == F.col("attempt_id"), F.lit(False)))


def seeded_sample(rows: DataFrame, key: str, n: int, *, seed: int) -> DataFrame:
    """n rows drawn without replacement, the same ones whatever the partitions (a sampling operator)."""
    return rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)).limit(n)


def size_histogram(rows: DataFrame, by: list[str], size: str) -> DataFrame:
    """Files and bytes by group and power of two of their size."""
    magnitude = F.when(F.col(size) == 0, 0).otherwise(F.length(F.bin(size)) - 1).cast("long")
    return rows.groupBy(*by, magnitude.alias("magnitude")).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.min(size).alias("smallest"), F.max(size).alias("largest"))


def scope_estimate(rows: DataFrame, by: list[str], included: Column, size: Column) -> DataFrame:
    """Records and bytes that a scope includes, with the share in percent."""
    n = rows.groupBy(*by).agg(F.count("*").alias("records"), F.count_if(included).alias("included"), F.coalesce(F.sum(F.when(included, size)), F.lit(0)).alias("included_bytes"))
    return n.withColumn("included_percent", F.round(100.0 * F.col("included") / F.col("records"), 6))


def report_lines(sections: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """(section, line_no, line): a heading and a table row for each row of a small report, in order of its columns."""
    parts = []
    for k, (title, rows, columns) in enumerate(sections, 1):
        spark = rows.sparkSession
        cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))
        parts.append(spark.range(1).select(F.lit(k).alias("section"), F.lit(0).alias("line_no"), F.lit(f"## {title}").alias("line")))
        parts.append(rows.select(F.lit(k).alias("section"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*columns)).alias("line_no"), cells.alias("line")))
    return reduce(DataFrame.unionByName, parts)


def check_book(books: DataFrame, new: DataFrame, version: str) -> DataFrame:
    """Versions that are given again with another content: a book must not change under its version."""
    return new.join(books.select(version, F.col("book_hash").alias("_was")), version).filter(F.col("book_hash") != F.col("_was")).drop("_was")
