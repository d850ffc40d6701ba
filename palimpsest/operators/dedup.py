"""Canonical rows, first rows by key, set operations and membership checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def canonical(rows: DataFrame, identity: list[str], order: str) -> DataFrame:
    """``rows`` with ``canonical_id``: the least ``order`` of equal identities, null for that row itself."""
    least = F.min(order).over(Window.partitionBy(*identity))
    return rows.withColumn("canonical_id", F.when(least != F.col(order), least))


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_by(rows: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not there yet, one for each key."""
    return new.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def upsert_first_non_null(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: every other column's first value that is not null, in order."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest))


def membership_faults(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that only one side has, compared null-safely and with multiplicity: (columns, side)."""
    a, b = left.select(*columns), right.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def evidence_sets(rows: DataFrame, owner: list[str], member: str) -> DataFrame:
    """Content-addressed sets: each owner's fingerprint of its sorted distinct members."""
    members = F.sort_array(F.collect_set(member))
    body = F.array_join(F.transform(members, lambda m: F.concat(F.lit("["), m.cast("string"), F.lit("]"))), "\n")
    sets = rows.groupBy(*owner).agg(members.alias("_m")).withColumn("members", F.size("_m").cast("long"))
    body = F.array_join(F.transform("_m", lambda m: F.concat(F.lit("["), m.cast("string"), F.lit("]"))), "\n")
    return sets.withColumn("fingerprint", F.concat(F.lit("v1:"), F.sha2(F.concat(F.lit("v1\n"), body), 256))).drop("_m")
