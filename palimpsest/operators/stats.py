"""Counts, timelines, calendars and coverage."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.session import checkpoint


def bucket_label(us: Column, bucket: str) -> Column:
    """Label of a day, ISO week (2024-W01) or month of a UTC instant."""
    t = F.timestamp_micros(us)
    if bucket == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), t).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(t).cast("string"), 2, "0"))
    return F.date_format(t, {"day": "yyyy-MM-dd", "month": "yyyy-MM"}[bucket])


def timeline(events: DataFrame, bucket: str, by: str) -> DataFrame:
    return events.filter("us is not null").groupBy(bucket_label(F.col("us"), bucket).alias("bucket"), by).agg(F.count("*").alias("events"), F.countDistinct("session_id").alias("sessions"))


def financial_year(day: Column) -> Column:
    """The calendar year in which the July-to-June year of a date begins."""
    return F.year(day) - (F.month(day) < 7).cast("int")


def calendar(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Seconds of whole intervals (each cut to full seconds), intervals and ambiguous seconds by ``by``."""
    seconds = F.floor((F.col("end_us") - F.col("start_us")) / 1_000_000).cast("long")
    return intervals.withColumn("_s", seconds).groupBy(*by).agg(F.sum("_s").alias("seconds"), F.count("*").alias("intervals"), F.bool_or("ambiguous").alias("ambiguous"), F.sum(F.when(F.col("ambiguous"), F.col("_s")).otherwise(0)).alias("ambiguous_seconds"))


def coverage(rows: DataFrame, by: list[str], status: str, statuses: list[str]) -> DataFrame:
    """Counts of each status as columns, zero where there is none."""
    return rows.groupBy(*by).pivot(status, statuses).count().na.fill(0, statuses)


def left_counts(dim: DataFrame, facts: DataFrame, key: str, name: str = "uses") -> DataFrame:
    """Each row of a dimension with its number of facts, zeros kept."""
    n = facts.groupBy(key).agg(F.count("*").alias(name))
    return dim.join(n, key, "left").na.fill(0, [name])


def repetition(facts: DataFrame, key: str, *, least: int = 2) -> DataFrame:
    """Physical and independent uses of a value, and how many sessions and projects have it."""
    own = F.col("canonical")
    out = facts.groupBy(key).agg(F.count("*").alias("physical"), F.sum(own.cast("int")).cast("long").alias("independent"), F.countDistinct(F.when(own, F.col("session_id"))).alias("sessions"), F.countDistinct(F.when(own, F.col("project_id"))).alias("projects"))
    return out.filter(F.col("independent") >= least).withColumn("echoes", F.greatest(F.col("physical") - F.col("independent"), F.lit(0)).cast("long"))


def ordinals(rows: DataFrame, key: str, *, name: str = "ordinal") -> DataFrame:
    """Rows numbered from 0 in order of a key (nulls first), without one task seeing them all.

    Rows are dealt by range of the key, whatever its values; the counts of the ranges,
    as many as there are partitions, give each its first number.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpoint(rows.repartitionByRange(n, key).withColumn("_range", F.spark_partition_id()))  # read twice
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return dealt.withColumn("_own", own).join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_own")).drop("_range", "_own", "_start")


def ordered_md5(rows: DataFrame, by: list[str], number: str, *, name: str = "md5") -> DataFrame:
    """(by, md5) of each group's whole numbers, ascending and joined by commas.

    Numbers become text in pieces of 4,096 consecutive ones; the pieces of a group pass
    through one hash in order, of which a task holds a batch at a time.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(number)), lambda x: x.cast("string")), ",")
    pieces = rows.groupBy(*by, F.shiftright(number, 12).alias("_at")).agg(text.alias("_piece")).withColumn("_group", F.to_json(F.struct(*by)))
    kinds = {c: t for c, t in rows.dtypes if c in by}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.md5()
        for b in batches:
            rows_ = b.to_pylist()
            done = []
            for r in rows_:
                if now is not None and r["_group"] == now["_group"]:
                    state.update(b"," + r["_piece"].encode())
                    continue
                if now is not None:
                    done.append(now | {name: state.hexdigest()})
                now, state = r, hashlib.md5(r["_piece"].encode())
            yield made(done, b.schema)
        if now is not None:
            yield made([now | {name: state.hexdigest()}], b.schema)

    def made(done: list[dict], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{k: r[k] for k in (*by, name)} for r in done], schema=pa.schema([*(schema.field(c) for c in by), (name, pa.string())]))

    dealt = pieces.repartition("_group").sortWithinPartitions("_group", "_at").select(*by, "_group", "_piece")
    return dealt.mapInArrow(hashed, ", ".join(f"{c} {kinds[c]}" for c in by) + f", {name} string")


def stride_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Every n-th row in order of the key, so that at most ``limit`` stay (a sampling operator)."""
    stride = rows.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(float(limit)))).cast("long").alias("_stride"))
    return ordinals(rows, key).crossJoin(F.broadcast(stride)).filter("ordinal % _stride = 0").drop("_stride", "ordinal")
