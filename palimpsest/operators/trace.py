"""Tool-call traces: pairing calls with outputs, runs and transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Fixed value: how a tool reports success.
SUCCESS = r"(?im)^(?:exit code:\s*0\b|process exited with code 0\b|script completed\b)"


def pair_calls(events: DataFrame, track: list[str], *, order: str = "event_id", outputs: tuple[str, ...] = ("tool-output",)) -> DataFrame:
    """First-in first-out: the n-th effective output of a track belongs to the n-th input.

    An output with nothing pending is ignored.  With running counts i of inputs and
    o of outputs, the ignored ones so far are max(o - i) over the past; an output
    counts if that did not grow at it, and pairs with input number o less ignored.
    Returns (track, call_id, output_id), output_id null for pending calls.
    """
    w = Window.partitionBy(*track).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    calls = events.filter(F.col("kind").isin("tool-input", *outputs))
    is_in = (F.col("kind") == "tool-input").cast("int")
    counts = calls.withColumn("_i", F.sum(is_in).over(upto)).withColumn("_o", F.sum(1 - is_in).over(upto))
    counts = counts.withColumn("_ign", F.greatest(F.lit(0), F.max(F.col("_o") - F.col("_i")).over(upto)))
    counts = counts.withColumn("_was", F.coalesce(F.lag("_ign").over(w), F.lit(0)))
    outs = counts.filter(F.col("kind").isin(*outputs) & (F.col("_ign") == F.col("_was"))).select(*track, (F.col("_o") - F.col("_ign")).alias("_n"), F.col(order).alias("output_id"))
    ins = counts.filter("kind = 'tool-input'").select(*track, F.col("_i").alias("_n"), F.col(order).alias("call_id"))
    return ins.join(outs, [*track, "_n"], "left").drop("_n")


def call_outcomes(units: DataFrame, track: list[str], *, order: str = "event_id", time: str = "us") -> DataFrame:
    """Calls with what came of them: (track, call_id, output_id, action, operation, outcome, start_us, end_us).

    ``units`` hold kind, action, operation, text, ``is_error`` and ``has_signature`` (an
    error signature was found in the event).  An output or error belongs to the
    longest waiting call.  It is an error if it says so, or if it bears a signature
    without reporting success; else a result.  A call without one is unknown.
    """
    pairs = pair_calls(units, track, order=order, outputs=("tool-output", "error"))
    calls = units.select(*track, F.col(order).alias("call_id"), "action", "operation", F.col(time).alias("start_us"))
    error = F.coalesce(F.col("is_error"), F.lit(False)) | (F.col("kind") == "error") | (F.coalesce(F.col("has_signature"), F.lit(False)) & ~F.coalesce(F.col("text").rlike(SUCCESS), F.lit(False)))
    ends = units.select(*track, F.col(order).alias("output_id"), F.when(error, "error").otherwise("result").alias("_o"), F.col(time).alias("_end"))
    out = pairs.join(calls, [*track, "call_id"]).join(ends, [*track, "output_id"], "left")
    return out.select(*track, "call_id", "output_id", "action", "operation", F.coalesce("_o", F.lit("unknown")).alias("outcome"), "start_us", F.coalesce("_end", "start_us").alias("end_us"))


def call_runs(calls: DataFrame, track: list[str]) -> DataFrame:
    """Successive calls of one action, operation and outcome as one: (track, run_no, ..., count, first_id, last_id, start_us, end_us)."""
    same = ["action", "operation", "outcome"]
    w = Window.partitionBy(*track).orderBy("call_id")
    new = F.row_number().over(w) == 1
    for c in same:
        new = new | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    marked = calls.withColumn("_new", new.cast("int")).withColumn("run_no", F.sum("_new").over(w))
    last = F.coalesce("output_id", "call_id")
    return marked.groupBy(*track, "run_no", *same).agg(F.count("*").alias("count"), F.min("call_id").alias("first_id"), F.max_by(last, "call_id").alias("last_id"), F.min_by("start_us", "call_id").alias("start_us"), F.max_by("end_us", "call_id").alias("end_us"))


def runs(events: DataFrame, track: list[str], value: str, *, order: str = "event_id") -> DataFrame:
    """Run-length encoding of a track: (track, run_no, value, length, first_id)."""
    w = Window.partitionBy(*track).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = events.withColumn("_new", new).withColumn("run_no", F.sum("_new").over(w))
    return marked.groupBy(*track, "run_no", value).agg(F.count("*").alias("length"), F.min(order).alias("first_id"))


def transitions(events: DataFrame, track: list[str], value: str, *, order: str = "event_id") -> DataFrame:
    """Pairs of successive values: how often, in how many tracks, and where first seen."""
    w = Window.partitionBy(*track).orderBy(order)
    pairs = events.withColumn("next_value", F.lead(value).over(w)).filter("next_value is not null")
    return pairs.groupBy(F.col(value).alias("value"), "next_value").agg(F.count("*").alias("uses"), F.countDistinct(*track).alias("support"), F.min(order).alias("first_seen"))
