"""The next key of each key, in order, without one task seeing all keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import exchange as X


def successors(keys: DataFrame, columns: list[str], *, wrap: bool = False) -> DataFrame:
    """Distinct non-null keys with ``next_*`` columns: the following key in ascending order.

    Keys are dealt by range; a window runs within each range, and the last key of a
    range takes the first key of the next range that has any (as many rows as
    ranges).  The last key of all has nulls, or with ``wrap`` the first key.
    """
    n = X.partitions(keys.sparkSession)
    ranged = keys.select(*columns).dropna().distinct().repartitionByRange(n, *columns).withColumn("_range", F.spark_partition_id())
    ranged = X.checkpoint(ranged)  # the dealing must not change between the two readings
    key = F.struct(*columns)
    within = Window.partitionBy("_range").orderBy(*columns)
    firsts = ranged.groupBy("_range").agg(F.min(key).alias("_first"))
    chain = Window.partitionBy(F.lit(0)).orderBy("_range")  # one row for each range
    following = F.lead("_first").over(chain)
    if wrap:
        following = F.coalesce(following, F.first("_first").over(chain))
    heads = firsts.select("_range", following.alias("_following"))
    out = ranged.withColumn("_next", F.lead(key).over(within)).join(F.broadcast(heads), "_range", "left")
    out = out.withColumn("_next", F.coalesce("_next", "_following"))
    return out.select(*columns, *(F.col(f"_next.{c}").alias(f"next_{c}") for c in columns))
