"""Revisions of a corpus by fingerprints that add up, and what is stale against them.

A part's fingerprint is a count and two sums of 60-bit names of its rows.  Sums do not
depend on order or partitions and add up over parts, so the fingerprints of parts
are kept as a table, a changed part is counted anew alone, and a status reads that
table instead of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SUMS = ("n", "a", "b")
# What a status says and recommends, in its order.
INCOMPLETE = ("active source revisions are incomplete or still ingesting", "allow the next sync cycle to ingest newly completed source lines")
FAILED = ("one or more active source revisions failed", "inspect the sync log and repair or quarantine the failed source revision")
STALE = {
    "episodes": ("derived episodes are stale relative to the active source catalog", "run the derived episode refresh"),
    "no-timesheet": ("no complete timesheet snapshot exists", "run the timesheet refresh"),
    "timesheet": ("latest timesheet snapshot is stale relative to the active source catalog", "run the timesheet refresh"),
    "costs": ("token-cost snapshot is missing or stale", "run the token-cost refresh"),
}
RUN_FAILED = ("latest semantic {} attempt failed", "inspect the semantic {} job error before retrying")
RUN_STALE = ("semantic {} index is stale", "run the guarded semantic {} refresh")
PROFILES = ("conversation", "episodes")


def fingerprints(rows: DataFrame, parts: list[str], columns: list[str]) -> DataFrame:
    """(parts, n, a, b): the fingerprint of each part's rows over ``columns``; nulls differ from empty texts, and repeated rows count."""
    body = F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns))
    name = F.md5(body)
    word = [F.conv(F.substring(name, k, 15), 16, 10).cast("decimal(19,0)") for k in (1, 16)]
    return rows.select(*parts, word[0].alias("_a"), word[1].alias("_b")).groupBy(*parts).agg(F.count("*").alias("n"), F.sum("_a").cast("decimal(38,0)").alias("a"), F.sum("_b").cast("decimal(38,0)").alias("b"))


def replaced(kept: DataFrame, fresh: DataFrame, parts: list[str]) -> DataFrame:
    """The table of fingerprints after some parts were counted anew."""
    return kept.join(fresh.select(*parts).distinct(), parts, "left_anti").unionByName(fresh)


def revision(kept: DataFrame, by: list[str]) -> DataFrame:
    """(by, revision): one text for all parts of each group; equal contents have equal texts, however they are parted."""
    whole = kept.groupBy(*by).agg(*(F.sum(s).cast("decimal(38,0)").alias(s) for s in SUMS))
    return whole.select(*by, F.sha2(F.concat_ws(":", *(F.col(s).cast("string") for s in SUMS)), 256).alias("revision"))


def _said(when: Column, texts: tuple[str, str], k: int) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.lit(texts[k]))


def automation_status(sources: DataFrame, revisions: DataFrame, derived: DataFrame, runs: DataFrame, archive: str, *, algorithm: int) -> DataFrame:
    """(archive, status, warnings, blocking_reasons, actions, pending_bytes, parse_errors, safe) of archives.

    ``sources``: the active revision of each source (status, pending, errors).
    ``revisions``: :func:`revision` of each archive's corpus, null or absent without events.
    ``derived``: what was derived (``what``: episodes, timesheet or costs; the
    ``revision`` and, for timesheets, ``algorithm`` that it was derived under, and ``rows``).
    ``runs``: the latest attempt and complete run of each profile (attempt_status, the complete
    run's ``revision``); a profile without a complete run is optional and no fault.

    A failed source blocks; anything else that is incomplete or stale needs attention.
    """
    states = sources.groupBy(archive).agg(F.count_if(F.col("status").isin("partial", "ingesting", "pending")).alias("_open"), F.count_if(F.col("status") == "failed").alias("_failed"), F.coalesce(F.sum("pending"), F.lit(0)).alias("pending_bytes"), F.coalesce(F.sum("errors"), F.lit(0)).alias("parse_errors"))

    def of(what: str, value: Column) -> Column:
        return F.max(F.when(F.col("what") == what, value))

    made = derived.groupBy(archive).agg(of("episodes", F.col("revision")).alias("_episodes"), of("episodes", F.col("rows")).alias("_rows"), of("timesheet", F.col("revision")).alias("_timesheet"), of("timesheet", F.col("algorithm")).alias("_algorithm"), of("costs", F.col("revision")).alias("_costs"))
    tried = runs.groupBy(archive).agg(*(F.max(F.when(F.col("profile") == p, F.col(c))).alias(f"_{p}_{c}") for p in PROFILES for c in ("attempt_status", "revision")))
    all_ = states.join(revisions.select(archive, F.col("revision").alias("_now")), archive, "left").join(made, archive, "left").join(tried, archive, "left")
    now = F.col("_now")

    def stale(was: Column) -> Column:
        return ~was.eqNullSafe(now)

    episodes_stale = now.isNotNull() & (stale(F.col("_episodes")) | (F.coalesce("_rows", F.lit(0)) == 0))
    faults: list[tuple[Column, tuple[str, str]]] = [
        (F.col("_open") > 0, INCOMPLETE), (F.col("_failed") > 0, FAILED), (episodes_stale, STALE["episodes"]), (F.col("_timesheet").isNull(), STALE["no-timesheet"]),
        (F.col("_timesheet").isNotNull() & (stale(F.col("_timesheet")) | ~F.col("_algorithm").eqNullSafe(F.lit(algorithm))), STALE["timesheet"]), (stale(F.col("_costs")), STALE["costs"]),
    ]
    for p in PROFILES:
        faults.append((F.col(f"_{p}_attempt_status") == "failed", tuple(t.format(p) for t in RUN_FAILED)))
        faults.append((F.col(f"_{p}_revision").isNotNull() & stale(F.col(f"_{p}_revision")), tuple(t.format(p) for t in RUN_STALE)))
    told = all_.select(archive, *(F.array_distinct(F.array_compact(F.array(*(_said(w, t, k) for w, t in faults)))).alias(n) for k, n in enumerate(("warnings", "actions"))), F.array_compact(F.array(_said(F.col("_failed") > 0, FAILED, 0))).alias("blocking_reasons"), "pending_bytes", "parse_errors")
    status = F.when(F.size("blocking_reasons") > 0, "blocked").when(F.size("warnings") > 0, "needs-attention").otherwise("healthy")
    return told.select(archive, status.alias("status"), "warnings", "blocking_reasons", "actions", "pending_bytes", "parse_errors", (F.size("blocking_reasons") == 0).alias("safe"))


def price_books(rows: DataFrame, version: str, columns: list[str], imported: str) -> DataFrame:
    """(version, book_hash, imported, active): each version's content hash; the version that was imported last is active.

    The hash is a sum over rows, so a book of any size is no one row's list.
    """
    books = revision(fingerprints(rows, [version], columns), [version]).withColumnRenamed("revision", "book_hash").join(rows.groupBy(version).agg(F.max(imported).alias("imported")), version)
    last = books.agg(F.max_by(version, F.struct("imported", version)).alias("_last"))
    return books.crossJoin(F.broadcast(last)).select(version, "book_hash", "imported", F.col(version).eqNullSafe(F.col("_last")).alias("active"))
