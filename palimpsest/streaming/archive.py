"""Incremental archives: append-only ingestion, timelines with late data, and changed sessions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery


class MutatedRecord(ValueError):
    """A key came again with other content."""


def _bucket(columns: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def merge(batch: DataFrame, target: str, keys: list[str], *, by: list[str] | None = None, content: str | None = None, buckets: int = 256) -> DataFrame:
    """The rows of a batch whose key the archive lacks, one for each key: what :func:`append` may write.

    The archive is parted by a hash of ``by`` (columns among the keys, all of them if
    not given), and only the parts that the batch falls into are read, of these only
    keys and content.  With ``by`` a source's name, a batch of few sources reads few
    parts, however large the archive.  Of several rows of a key in the batch the one
    with the least content stands; a key with other content than before raises
    :class:`MutatedRecord`.
    """
    spark = batch.sparkSession
    placed = batch.withColumn("_bucket", _bucket(by or keys, buckets))
    hit = sorted(r[0] for r in placed.select("_bucket").distinct().collect())  # at most one a bucket
    told = F.xxhash64(content) if content else F.lit(0).cast("long")
    seen = [*keys, "_bucket"]
    there = _archive(spark, target)
    if there is not None:
        there = there.filter(F.col("_bucket").isin(hit)).select(*seen, told.alias("_was"))
        placed = placed.join(there, on=[placed[c].eqNullSafe(there[c]) for c in seen], how="left").select(*(placed[c] for c in placed.columns), "_was", there["_bucket"].isNotNull().alias("_old"))
    else:
        placed = placed.withColumns({"_was": F.lit(None).cast("long"), "_old": F.lit(False)})
    if content:
        own = Window.partitionBy(*keys)
        faults = placed.withColumn("_is", told).withColumn("_n", F.size(F.collect_set("_is").over(own))).filter("_n > 1 or (_old and not _was <=> _is)").select(*keys).limit(1).collect()
        if faults:
            raise MutatedRecord(f"other content under {faults[0].asDict()}")
    order = [content] if content else keys
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return placed.filter("not _old").withColumn("_n", first).filter("_n = 1").drop("_n", "_was", "_old")


def _archive(spark: SparkSession, target: str) -> DataFrame | None:
    try:
        return spark.read.parquet(target)
    except AnalysisException as e:  # the first batch finds no archive
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def append(fresh: DataFrame, target: str) -> None:
    """Write merged rows into their parts of the archive, a file for each part."""
    fresh.repartition("_bucket").write.partitionBy("_bucket").mode("append").parquet(target)


def ingest(stream: DataFrame, target: str, checkpoint: str, keys: list[str], *, by: list[str] | None = None, content: str | None = None, buckets: int = 256) -> StreamingQuery:
    """Merge new records into an archive, each key once, however often a batch is replayed.

    ``<target>_batches`` is the ledger of batches whose rows are all there: such a batch is
    passed over without reading the archive.  A batch that broke off before is not
    in it; its replay meets the rows that it had written and adds the others.
    """
    ledger = f"{target.rstrip('/')}_batches"

    def add(batch: DataFrame, number: int) -> None:
        done = _archive(batch.sparkSession, ledger)
        if done is not None and not done.filter((F.col("batch") == number) & (F.col("stream") == checkpoint)).isEmpty():
            return
        append(merge(batch, target, keys, by=by, content=content, buckets=buckets), target)
        batch.sparkSession.createDataFrame([(checkpoint, number)], "stream string, batch long").coalesce(1).write.mode("append").parquet(ledger)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def timeline(stream: DataFrame, time: str, by: str, *, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by tumbling window; events later than the watermark are dropped, and windows are emitted when it passes."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), by, "events")


def sliding(stream: DataFrame, time: str, by: str, *, window: str = "7 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by windows that overlap: each event counts in every window that it falls into."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window, slide), by).agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), by, "events")


def sessions(stream: DataFrame, time: str, key: str, *, gap: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Work sessions by inactivity: an event exactly a gap later joins; ``last`` is the last event, not its end of waiting."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("events")).select(key, "first", "last", "events")


def changed_sessions(rows: DataFrame, state: DataFrame, session: str, row_id: str) -> DataFrame:
    """Sessions whose signature (rows, greatest id, sum of ids) differs from the stored one, with the new signature."""
    now = rows.groupBy(session).agg(F.count("*").alias("rows"), F.max(row_id).alias("last_id"), F.sum(F.col(row_id).cast("decimal(28,0)")).alias("id_sum"))
    was = state.select(F.col(session).alias("_s"), F.col("rows").alias("_r"), F.col("last_id").alias("_l"), F.col("id_sum").alias("_i"))
    return now.join(was, (F.col(session) == F.col("_s")) & (F.col("rows") == F.col("_r")) & (F.col("last_id") == F.col("_l")) & (F.col("id_sum") == F.col("_i")), "left_anti")


def read_stream(spark: SparkSession, path: str, schema: str, *, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(path)
