"""Human review: a queue of targets with the state of their annotations, and the merging of new verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# fixed values
TARGETS = ["session", "event", "window", "episode"]
STATES = ["unreviewed", "reviewing", "reviewed"]
TARGET = ["target_type", "target_key"]


def faults(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """Verdicts that cannot be saved, with the reason: a wrong target, a wrong state or a label that nobody defined."""
    known = labels.select(F.col("name").alias("label"), F.lit(True).alias("_known")).distinct()
    reason = F.when(~F.col("target_type").isin(TARGETS) | F.col("target_type").isNull(), "target_type").when(~F.col("review_state").isin(STATES) | F.col("review_state").isNull(), "review_state").when(F.col("label").isNotNull() & F.col("_known").isNull(), "unknown label")
    return verdicts.join(known, "label", "left").withColumn("fault", reason).drop("_known").filter("fault is not null")


def saved(annotations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Annotations after new verdicts: one for each target and label, no label being one of them.

    A verdict replaces note and state of the annotation that is there; that one
    keeps its time of creation. Of several verdicts on one the last counts, ties
    by state and note. Wrong verdicts must be told by ``faults`` first.
    """
    rows = annotations.select(*TARGET, "label", "note", "review_state", "created", "updated", F.lit(0).alias("_new"))
    new = verdicts.select(*TARGET, "label", "note", "review_state", F.col("at").alias("created"), F.col("at").alias("updated"), F.lit(1).alias("_new"))
    last = F.max(F.struct("_new", "updated", "review_state", "note"))
    return rows.unionByName(new).groupBy(*TARGET, "label").agg(last.alias("_last"), F.min("created").alias("created")).select(*TARGET, "label", "_last.note", "_last.review_state", "created", "_last.updated")


def queue(candidates: DataFrame, annotations: DataFrame, *, limit: int, unreviewed_only: bool = True) -> DataFrame:
    """The first targets by rank that are not reviewed, each once, with their annotations' states.

    ``candidates`` come from any number of lists, with ``rank`` as their common
    order; a target that several lists name stays at its best rank. The limit is
    taken after reviewed targets are gone.
    """
    rest = [c for c in candidates.columns if c not in (*TARGET, "rank")]
    once = candidates.groupBy(*TARGET).agg(F.min(F.struct("rank", *rest)).alias("_best")).select(*TARGET, "_best.*")
    state = annotations.groupBy(*TARGET).agg(
        F.count("*").alias("annotations"), F.coalesce(F.bool_or(F.col("review_state") == "reviewed"), F.lit(False)).alias("reviewed"),
        F.max(F.struct("updated", "review_state"))["review_state"].alias("latest_state"), F.array_sort(F.collect_set("label")).alias("labels"),
    )
    out = once.join(state, TARGET, "left").na.fill(0, ["annotations"]).na.fill(False, ["reviewed"]).withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
    if unreviewed_only:
        out = out.filter(~F.col("reviewed"))
    return out.orderBy("rank", *TARGET).limit(limit)
