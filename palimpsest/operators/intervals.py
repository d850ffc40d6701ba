"""Work intervals: sessions by inactivity, their union, and splits at midnights and boundaries.

All times are microseconds.  Every step is a window or an equi-join on the clock's
keys; clocks are many, and one clock's rows are one contributor's activity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def segments(points: DataFrame, clock: list[str], *, gap_us: int = 3_600_000_000, time: str = "us", tie: str = "event_id") -> DataFrame:
    """Runs of points of a clock without a gap of more than ``gap_us``; a gap of exactly that joins.

    Returns (clock, segment_no, start_us, end_us, events, event_ids).
    """
    w = Window.partitionBy(*clock).orderBy(time, tie)
    new = F.when(F.col(time) - F.lag(time).over(w) <= gap_us, 0).otherwise(1)
    runs = points.filter(F.col(time).isNotNull()).withColumn("_new", new).withColumn("segment_no", F.sum("_new").over(w))
    return runs.groupBy(*clock, "segment_no").agg(F.min(time).alias("start_us"), F.max(time).alias("end_us"), F.count("*").alias("events"), F.sort_array(F.collect_list(tie)).alias("event_ids"))


def capped_seconds(points: DataFrame, clock: list[str], *, cap_us: int = 1_800_000_000, time: str = "us", tie: str = "event_id") -> DataFrame:
    """Per clock the sum of gaps between neighbours, each cut to ``cap_us`` (``active_us``)."""
    gap = F.col(time) - F.lag(time).over(Window.partitionBy(*clock).orderBy(time, tie))
    return points.withColumn("_gap", F.when(gap.isNotNull(), F.greatest(F.lit(0), F.least(gap, F.lit(cap_us))))).groupBy(*clock).agg(F.coalesce(F.sum("_gap"), F.lit(0)).alias("active_us"), F.count("*").alias("events"))


def union(segs: DataFrame, clock: list[str], *, evidence: str | None = None) -> DataFrame:
    """Merge overlapping and touching intervals of a clock: (clock, start_us, end_us, segments[, evidence]).

    A zero-length interval within a longer one, its end included, is absorbed;
    others stay, one for each instant.
    """
    w = Window.partitionBy(*clock).orderBy("start_us", "end_us")
    before = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = segs.withColumn("_new", F.when(F.col("start_us") <= before, 0).otherwise(1)).withColumn("_isle", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ids = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(evidence)))).alias(evidence)] if evidence else []
    return marked.groupBy(*clock, "_isle").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("segments"), *ids).drop("_isle")


def coalesce_touching(intervals: DataFrame, clock: list[str], same: list[str]) -> DataFrame:
    """Merge neighbours that touch and agree on ``same``."""
    w = Window.partitionBy(*clock).orderBy("start_us", "end_us")
    agree = F.lag("end_us").over(w) == F.col("start_us")
    for c in same:
        agree = agree & F.lag(c).over(w).eqNullSafe(F.col(c))
    runs = intervals.withColumn("_new", F.when(agree, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(*clock, *same, "_run").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("_run")


def _local(us: Column, zone: str) -> Column:
    return F.from_utc_timestamp(F.timestamp_micros(us), zone)


def split_midnights(intervals: DataFrame, zone: str) -> DataFrame:
    """One row for each local day that an interval touches, with ``local_date``; other columns go to each part."""
    first = F.to_date(_local(F.col("start_us"), zone))
    last = F.to_date(_local(F.greatest(F.col("start_us"), F.col("end_us") - 1), zone))
    days = intervals.withColumn("local_date", F.explode(F.sequence(first, last)))

    def midnight(day: Column) -> Column:
        return F.unix_micros(F.to_utc_timestamp(day.cast("timestamp"), zone))

    return days.withColumn("_from", midnight(F.col("local_date"))).withColumn("_to", midnight(F.date_add("local_date", 1))).withColumn("start_us", F.greatest("start_us", "_from")).withColumn("end_us", F.least("end_us", "_to")).drop("_from", "_to")


def split_boundaries(intervals: DataFrame, dates: DataFrame, key: str) -> DataFrame:
    """Split intervals at the ``from_us`` and ``to_us`` of the key's dated rows that lie inside."""
    inside = dates.select(F.col(key).alias("_k"), F.explode(F.array("from_us", "to_us")).alias("_b")).distinct().groupBy("_k").agg(F.sort_array(F.collect_list("_b")).alias("_cuts"))
    held = intervals.join(inside, F.col(key) == F.col("_k"), "left")
    cuts = F.filter(F.coalesce("_cuts", F.array().cast("array<bigint>")), lambda b: (b > F.col("start_us")) & (b < F.col("end_us")))
    edges = F.concat(F.array("start_us"), cuts, F.array("end_us"))
    parts = held.withColumn("_edges", edges).withColumn("_k2", F.explode(F.sequence(F.lit(0), F.size("_edges") - 2)))
    return parts.withColumn("start_us", F.get("_edges", F.col("_k2"))).withColumn("end_us", F.get("_edges", F.col("_k2") + 1)).drop("_k", "_cuts", "_edges", "_k2")


def as_of(rows: DataFrame, dated: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Left as-of join: the value of the latest ``from_us <= at < to_us`` of the keys."""
    own = rows.withColumn("_row", F.monotonically_increasing_id())
    d = dated.select(*(F.col(k).alias(f"_{k}") for k in keys), "from_us", "to_us", F.col(value).alias("_v"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("from_us") <= F.col(at), F.col(at) < F.col("to_us")]
    hit = own.join(d, on, "left")
    best = F.max_by("_v", "from_us")
    return hit.groupBy("_row", *rows.columns).agg(best.alias(value)).drop("_row")


def combined_clock(intervals: DataFrame, clock: list[str], member: str, *, span_us: int = 86_400_000_000) -> DataFrame:
    """Elementary intervals of a clock with the set of members active in each, equal neighbours merged.

    Returns (clock, start_us, end_us, members, member_count).  A sweep: starts count 1
    and ends -1, and a member is active while its running sum is positive.  Time is
    cut into spans first, into each of which an interval that lies across is carried,
    so a clock spreads over tasks by its spans; within a span the running sums of its
    members are windows, and what the cuts parted is merged again at the end.
    """
    place = [*clock, "_span"]
    own = union(intervals.filter("end_us > start_us"), [*clock, member])  # disjoint, so a member's sum is 0 or 1
    first, last = F.floor(F.col("start_us") / span_us), F.floor((F.col("end_us") - 1) / span_us)
    cut = own.withColumn("_span", F.explode(F.sequence(first, last)))
    edge = F.explode(F.array(F.struct(F.greatest("start_us", F.col("_span") * span_us).alias("at"), F.lit(1).alias("step")), F.struct(F.least("end_us", (F.col("_span") + 1) * span_us).alias("at"), F.lit(-1).alias("step"))))
    edges = cut.select(*place, member, edge.alias("_e")).select(*place, member, "_e.at", "_e.step")
    cells = edges.select(*place, "at").distinct().withColumn("to", F.lead("at").over(Window.partitionBy(*place).orderBy("at"))).filter("`to` is not null")
    there = edges.select(*(F.col(c).alias(f"_{c}") for c in place), member).distinct()
    on = F.lit(True)
    for c in place:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    grid = cells.join(there, on).select(*place, member, "at", F.lit(0).alias("step"), "to")
    running = F.sum("step").over(Window.partitionBy(*place, member).orderBy("at"))  # with all rows of the same time
    live = edges.withColumn("to", F.lit(None).cast("long")).unionByName(grid).withColumn("_live", running).filter("_live > 0 and `to` is not null")
    active = live.groupBy(*clock, F.col("at").alias("start_us"), F.col("to").alias("end_us")).agg(F.array_join(F.sort_array(F.collect_set(member)), ",").alias("members"))
    merged = coalesce_touching(active, clock, ["members"])
    return merged.withColumn("member_count", F.size(F.split("members", ",")))


def overlaps(intervals: DataFrame, clock: list[str]) -> DataFrame:
    """Positive intervals that begin before an earlier one of their clock ends; empty if all is well."""
    w = Window.partitionBy(*clock).orderBy("start_us", "end_us").rowsBetween(Window.unboundedPreceding, -1)
    return intervals.filter("end_us > start_us").withColumn("_before", F.max("end_us").over(w)).filter("start_us < _before").drop("_before")
