"""Goal-driven episodes: openings by windows over each track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BREAK_US = 12 * 3_600_000_000


def segment(events: DataFrame, track: list[str], *, break_us: int = BREAK_US, order: str = "event_id", time: str = "us") -> DataFrame:
    """``events`` with ``episode_no``.

    A goal opens a new episode once the current one has a goal and progress after
    it, or after a break; any activity opens one after a break.

    Breaks depend on times alone and cut a track into stretches.  Within a stretch,
    goals and progress alternate in runs, and the first goal of a run opens an
    episode if there was a goal before: then the run of goals before it is in the
    current episode and the progress between them came after it.  So windows tell
    all openings, and no track is held as one row.
    """
    goal, progress = F.col("kind") == "goal", F.col("kind").isin("tool-input", "tool-output", "error", "outcome")
    w = Window.partitionBy(*track).orderBy(order)
    gap = F.greatest(F.lit(0), F.col(time) - F.last(time, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))) >= break_us
    cut = (F.row_number().over(w) == 1) | (F.coalesce(gap, F.lit(False)) & (goal | progress))
    rows = events.withColumn("_cut", cut).withColumn("_stretch", F.sum(F.col("_cut").cast("int")).over(w))
    earlier = Window.partitionBy(*track, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    moved = F.last(F.when(goal | progress, progress), ignorenulls=True).over(earlier)
    opens = F.col("_cut") | (goal & F.coalesce(moved, F.lit(False)) & F.coalesce(F.max(goal).over(earlier), F.lit(False)))
    rows = rows.withColumn("_opens", opens)
    return rows.withColumn("episode_no", F.sum(F.col("_opens").cast("int")).over(w).cast("int")).drop("_cut", "_stretch", "_opens")


def render(segmented: DataFrame, track: list[str], *, order: str = "event_id", time: str = "us", cap_us: int = 1_800_000_000) -> DataFrame:
    """One row for each episode: bounds, counts by role, capped active time and the state of its evidence.

    Attempts are tool inputs; an outcome is a result only of an attempt.
    """
    keys = [*track, "episode_no"]
    gap = F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(order))
    rows = segmented.withColumn("_gap", F.when(gap.isNotNull(), F.greatest(F.lit(0), F.least(gap, F.lit(cap_us)))))

    def n(*kinds: str) -> Column:
        return F.count(F.when(F.col("kind").isin(*kinds), 1))

    out = rows.groupBy(*keys).agg(F.min(order).alias("anchor_id"), F.min(time).alias("start_us"), F.max(time).alias("end_us"), F.count("*").alias("events"), n("goal").alias("goals"), n("tool-input").alias("attempts"), n("error").alias("errors"), n("outcome").alias("outcomes"), F.coalesce(F.sum("_gap"), F.lit(0)).alias("active_us"))
    state = F.when(F.col("errors") > 0, "error-observed").when((F.col("attempts") > 0) & (F.col("outcomes") > 0), "result-observed").when(F.col("attempts") > 0, "attempt-observed").otherwise("discussion")
    return out.withColumn("evidence_state", state)


def fingerprints(segmented: DataFrame, track: list[str], value: Column, *, order: str = "event_id", most: int = 100) -> DataFrame:
    """Distinct evidence values of each episode and kind, at most ``most`` by first appearance (a feature of the report)."""
    keys = [*track, "episode_no", "kind"]
    first = segmented.withColumn("value", value).filter("value is not null").groupBy(*keys, "value").agg(F.min(order).alias("first_id"))
    w = Window.partitionBy(*keys).orderBy("first_id", "value")
    return first.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= most)
