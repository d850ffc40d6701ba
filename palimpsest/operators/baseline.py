"""The baseline review of a corpus as text: coverage, semantic runs, episodes, repetitions, sessions, projects, labels.

A section is made of frames of one row, whose ``lines`` are an array. Tables are
cut to their first rows before these are put in order, so no frame grows with the
corpus; totals are aggregates. Lines are numbered within a section.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.functions import text as T
from palimpsest.operators import reports as P

# fixed values: headings, table heads and remarks of the report
COVERAGE = "## Corpus coverage"
SEMANTIC = "## Semantic snapshot"
NO_RUN = "No completed semantic derivation is available."
RUNS = ["", "Selectable completed runs:", "", "| Profile | Run | Model | Dimensions | Windows | Freshness |", "|---|---|---|---:|---:|---|"]
CLUSTERS = ["", "Largest clusters:", "", "| Cluster | Label | Windows |", "|---:|---|---:|"]
EPISODES = "## Goal-attempt-result episodes"
NO_EPISODE = "No episode derivation is available."
EPISODE_PROJECTS = ["", "Highest-volume episode projects:", "", "| Project | Episodes | Error episodes | Attempts | Active hours |", "|---|---:|---:|---:|---:|"]
FAILURES = "## Repeated normalized error signatures"
NO_FAILURE = "No cross-session observed failures met the threshold."
FAILURE_HEAD = ["| Episodes | Sessions | Projects | Excluded raw hits | Observed failure evidence | Representative source |", "|---:|---:|---:|---:|---|---|"]
COMMANDS = "## Repeated commands"
NO_COMMAND = "No cross-session repetitions met the threshold."
COMMAND_HEAD = ["| Sessions | Projects | Independent | Echoes removed | Candidate evidence | Representative source |", "|---:|---:|---:|---:|---|---|"]
SESSIONS = ["## Largest sessions", "", "Large sessions are review-priority candidates; size alone does not mean failure.", "", "| Session | Provider | Project | Events | Span hours |", "|---:|---|---|---:|---:|"]
PROJECTS = ["## Highest-volume projects", "", "| Provider | Project | Sessions | Events | Text units |", "|---|---|---:|---:|---:|"]
LABELS = ["## Human review coverage", "", "| Label | Reviewed targets |", "|---|---:|"]
UNKNOWN = "(unknown)"


def cell(c: Column, n: int) -> Column:
    """A text within a table: on one line, in at most n characters, without marks that end a cell or open code."""
    one = T.tidy(c)
    cut = F.when(F.length(one) > n, F.concat(F.substring(one, 1, n - 1), F.lit("…"))).otherwise(one)
    return F.replace(F.replace(cut, F.lit("|"), F.lit("\\|")), F.lit("`"), F.lit("'"))


def row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def number(name: str) -> Column:
    return F.format_number(F.coalesce(F.col(name), F.lit(0)), 0)


def fixed(lines: list[str]) -> Column:
    return F.array(*map(F.lit, lines)) if lines else F.array().cast("array<string>")


def table(rows: DataFrame, order: list, top: int | None, line: Column, head: list[str], empty: list[str]) -> DataFrame:
    """The first ``top`` rows of a total order (None: all of a small registry) under a head, or ``empty`` if there is none."""
    ranked = (rows if top is None else rows.orderBy(*order).limit(top)).withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))), lambda x: x["line"])
    return ranked.agg(lines.alias("lines")).select(F.when(F.size("lines") == 0, fixed(empty)).otherwise(F.concat(fixed(head), "lines")).alias("lines"))


def repeated_values(artifacts: DataFrame, *, least: int) -> DataFrame:
    """Values in ``least`` sessions or more: sessions, projects, independent uses, echoes removed, and the first event.

    ``artifacts``: value_hash, value, event_id (of the canonical event), session_id
    and project of that event, ``counted`` (false for histories and compactions,
    which are echoes only). An event without a session is a session of its own.
    Uses are summed by event, session and project in turn, so a frequent value is
    combined before each shuffle and no distinct count expands the rows.
    """
    own = F.col("counted")
    session = F.coalesce(F.concat(F.lit("s"), F.col("session_id").cast("string")), F.concat(F.lit("e"), F.col("event_id").cast("string")))
    keyed = artifacts.select("value_hash", "value", F.when(own, F.coalesce("project", F.lit(UNKNOWN))).alias("_p"), F.when(own, session).alias("_s"), F.when(own, F.col("event_id")).alias("_e"))
    one = keyed.groupBy("value_hash", "_p", "_s", "_e").agg(F.min("value").alias("value"), F.count("*").alias("physical"))
    by_session = one.groupBy("value_hash", "_p", "_s").agg(F.min("value").alias("value"), F.sum("physical").alias("physical"), F.count("_e").alias("independent"), F.min("_e").alias("first_event_id"))
    sums = [F.min("value").alias("value"), F.sum("physical").alias("physical"), F.sum("independent").alias("independent"), F.min("first_event_id").alias("first_event_id")]
    by_project = by_session.groupBy("value_hash", "_p").agg(*sums, F.count("_s").alias("sessions"))
    out = by_project.groupBy("value_hash").agg(*sums, F.sum("sessions").alias("sessions"), F.count("_p").alias("projects"))
    return out.filter((F.col("sessions") >= least) & (F.col("independent") > 0)).withColumn("echoes", F.col("physical") - F.col("independent"))


def repeated_failures(prints: DataFrame, hits: DataFrame, *, least: int, top: int) -> DataFrame:
    """The ``top`` error signatures (a report's feature) seen in ``least`` sessions or more, with the raw hits left out.

    ``prints``: value_hash, value, episode_id, session_id, project, first_event_id;
    ``hits``: value_hash of each raw occurrence, counted for the reported ones alone.
    """
    project = F.coalesce("project", F.lit(UNKNOWN)).alias("_p")
    one = prints.groupBy("value_hash", project, "session_id", "episode_id").agg(F.min("value").alias("value"), F.min("first_event_id").alias("first_event_id"))
    sums = [F.min("value").alias("value"), F.min("first_event_id").alias("first_event_id")]
    by_session = one.groupBy("value_hash", "_p", "session_id").agg(*sums, F.count("*").alias("episodes"))
    by_project = by_session.groupBy("value_hash", "_p").agg(*sums, F.sum("episodes").alias("episodes"), F.count("*").alias("sessions"))
    out = by_project.groupBy("value_hash").agg(*sums, F.sum("episodes").alias("episodes"), F.sum("sessions").alias("sessions"), F.count("*").alias("projects"))
    first = out.filter(F.col("sessions") >= least).orderBy(F.desc("sessions"), F.desc("episodes"), "value_hash").limit(top)
    raw = hits.select("value_hash").join(F.broadcast(first.select("value_hash")), "value_hash", "left_semi").groupBy("value_hash").agg(F.count("*").alias("_hits"))
    return first.join(raw, "value_hash", "left").withColumn("excluded", F.greatest(F.coalesce("_hits", F.lit(0)) - F.col("episodes"), F.lit(0))).drop("_hits")


def sourced(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """At most ``top`` rows with path and line of their first event; ``lines`` is read once and only those events leave it."""
    at = lines.select(F.col("event_id").alias("first_event_id"), F.concat(F.lit("`"), cell(F.col("path"), 180), F.lit(":"), F.col("line_no").cast("string"), F.lit("`")).alias("_ref"))
    found = at.join(F.broadcast(rows.select("first_event_id").distinct()), "first_event_id", "left_semi").groupBy("first_event_id").agg(F.min("_ref").alias("_ref"))
    return rows.join(found, "first_event_id", "left").withColumn("reference", F.coalesce("_ref", F.lit("(unavailable)"))).drop("_ref")


def report(sections: list[list[DataFrame]]) -> DataFrame:
    """(section, line_no, line) of sections that are lists of frames of one row with ``lines``."""
    parts = [part.select(F.lit(k).alias("section"), F.lit(p).alias("_p"), F.posexplode("lines").alias("_at", "line")) for k, section in enumerate(sections, 1) for p, part in enumerate(section)]
    number = F.row_number().over(Window.partitionBy("section").orderBy("_p", "_at"))
    return reduce(DataFrame.unionByName, parts).select("section", number.alias("line_no"), "line")


def baseline_report(corpus: DataFrame, runs: DataFrame, clusters: DataFrame, episodes: DataFrame, prints: DataFrame, hits: DataFrame, commands: DataFrame, lines: DataFrame, sessions: DataFrame, labels: DataFrame, *, top: int = 30, least: int = 2, prefer: str = "conversation", units: tuple[str, ...] = T.UNITS) -> DataFrame:
    """The whole review, eight sections; a table that is empty gives its remark, or its head alone.

    ``corpus``: one row of totals. ``runs``: run_id, run_key, profile, model,
    dimensions, windows, freshness, status, completed. ``clusters``: run_id,
    cluster_id, label, windows. ``episodes``: session_id, project, errors,
    attempts, active_us, duplicates. ``prints`` and ``hits``: see
    ``repeated_failures``; ``commands``: see ``repeated_values``, values of fewer
    than two characters are left out. ``lines``: event_id, path, line_no.
    ``sessions``: session_id, provider, project, events, start_us, end_us,
    text_units. ``labels``: name, uses. ``top`` is kept within 1 and 200; ``units``
    are those that the sources' size may be told in.
    """
    top, least = min(max(top, 1), 200), max(least, 1)
    bold = lambda text, value: F.concat(F.lit(f"- {text}: **"), value, F.lit("**"))
    coverage = corpus.select(F.array(F.lit(COVERAGE), F.lit(""), F.concat(bold("Sources", number("sources")), F.lit(" ("), T.human_bytes(F.col("source_bytes"), units), F.lit(")")), bold("Sessions", number("sessions")), bold("Source events", number("events")), bold("Searchable text units", number("text_units")), bold("Extracted evidence artifacts", number("artifacts")), bold("Parse-error records", number("parse_errors"))).alias("lines"))

    liked = F.coalesce((F.col("profile") == prefer).cast("int"), F.lit(0))
    order = [F.desc("_liked"), F.desc_nulls_last("completed"), F.desc("run_id")]
    complete = runs.filter("status = 'complete'").withColumn("_liked", liked)
    chosen = complete.orderBy(*order).limit(1)
    told = F.array(F.lit(SEMANTIC), F.lit(""), F.concat(F.lit("- Run: `"), "r.run_key", F.lit("`")), bold("Profile", F.col("r.profile")), bold("Windows", number("r.windows")), bold("Indexed-snapshot freshness", F.col("r.freshness")))
    run = chosen.agg(F.max(F.struct("run_key", "profile", "windows", "freshness")).alias("r")).select(F.when(F.col("r").isNull(), fixed([SEMANTIC, "", NO_RUN])).otherwise(told).alias("lines"))
    run_rows = table(complete, order, 20, row(F.coalesce("profile", F.lit("legacy")), F.concat(F.lit("`"), "run_key", F.lit("`")), F.concat(F.lit("`"), cell(F.col("model"), 80), F.lit("`")), F.col("dimensions").cast("string"), number("windows"), F.col("freshness")), RUNS, [])
    own = clusters.join(F.broadcast(chosen.select("run_id")), "run_id", "left_semi")
    cluster_rows = table(own, [F.desc("windows"), "cluster_id"], min(top, 30), row(F.col("cluster_id").cast("string"), cell(F.when(F.col("label") != "", F.col("label")).otherwise("(unlabelled)"), 160), number("windows")), CLUSTERS, [])

    hours = lambda us: F.format_number(F.coalesce(F.col(us), F.lit(0)) / 3_600_000_000.0, 1)
    stats = P.episode_stats(episodes).join(episodes.agg(F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates"), F.sum("active_us").alias("active_us")), F.lit(True))  # one row each
    spoken = F.array(F.lit(EPISODES), F.lit(""), F.concat(bold("Episodes", number("episodes")), F.lit(" across **"), number("sessions"), F.lit("** sessions")), bold("Episodes with observed error evidence", number("error_episodes")), bold("Tool attempts represented", number("attempts")), F.concat(F.lit("- Gap-capped active time: **"), hours("active_us"), F.lit(" hours**")), bold("Shared-prefix provider events removed", number("duplicates")))
    episode_facts = stats.select(F.when(F.col("episodes") == 0, fixed([EPISODES, "", NO_EPISODE])).otherwise(spoken).alias("lines"))
    by_project = episodes.groupBy(F.coalesce("project", F.lit(UNKNOWN)).alias("project")).agg(F.count("*").alias("episodes"), F.count_if(F.col("errors") > 0).alias("error_episodes"), F.sum("attempts").alias("attempts"), F.sum("active_us").alias("active_us"))
    episode_rows = table(by_project, [F.desc("error_episodes"), F.desc("episodes"), "project"], min(top, 50), row(cell(F.col("project"), 180), number("episodes"), number("error_episodes"), number("attempts"), hours("active_us")), EPISODE_PROJECTS, [])

    quoted = F.concat(F.lit("`"), cell(F.col("value"), 420), F.lit("`"))
    failures = sourced(repeated_failures(prints, hits, least=least, top=top), lines)
    failure_rows = table(failures, [F.desc("sessions"), F.desc("episodes"), "value_hash"], top, row(number("episodes"), number("sessions"), number("projects"), number("excluded"), quoted, F.col("reference")), [FAILURES, "", *FAILURE_HEAD], [FAILURES, "", NO_FAILURE])
    most = [F.desc("sessions"), F.desc("independent"), "value_hash"]
    repeated = repeated_values(commands.filter(F.length(F.trim("value")) >= 2), least=least).orderBy(*most).limit(top)
    command_rows = table(sourced(repeated, lines), most, top, row(number("sessions"), number("projects"), number("independent"), number("echoes"), quoted, F.col("reference")), [COMMANDS, "", *COMMAND_HEAD], [COMMANDS, "", NO_COMMAND])

    named = sessions.withColumn("project", F.coalesce("project", F.lit(UNKNOWN)))
    span = named.withColumn("_span", F.col("end_us") - F.col("start_us"))
    session_rows = table(span, [F.desc("events"), F.desc_nulls_first("_span"), "session_id"], min(top, 50), row(F.col("session_id").cast("string"), F.col("provider"), cell(F.col("project"), 180), number("events"), F.when(F.col("_span").isNull(), "—").otherwise(F.format_string("%.1f", F.col("_span") / 3_600_000_000.0))), SESSIONS, SESSIONS)
    volume = named.groupBy("provider", "project").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"), F.sum("text_units").alias("text_units"))
    volume_rows = table(volume, [F.desc("events"), "provider", "project"], min(top, 50), row(F.col("provider"), cell(F.col("project"), 200), number("sessions"), number("events"), number("text_units")), PROJECTS, PROJECTS)
    label_rows = table(labels, ["name"], None, row(F.col("name"), number("uses")), LABELS, LABELS)  # labels are a registry that people write
    return report([[coverage], [run, run_rows, cluster_rows], [episode_facts, episode_rows], [failure_rows], [command_rows], [session_rows], [volume_rows], [label_rows]])
