"""Sinks: evidence and timesheets as CSV, JSON lines and Markdown, each with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def flat(rows: DataFrame) -> DataFrame:
    """Columns in order of name, nested ones as JSON, as the CSV export needs them."""
    plain = []
    for f in sorted(rows.schema, key=lambda f: f.name):
        nested = f.dataType.typeName() in ("array", "struct", "map")
        plain.append((F.to_json(f.name) if nested else F.col(f.name)).alias(f.name))
    return rows.select(*plain)


def write(rows: DataFrame, path: str, kind: str) -> None:
    """Write to a folder: csv (with header), jsonl or parquet; an earlier export is replaced."""
    if kind == "csv":
        flat(rows).write.mode("overwrite").option("header", True).csv(path)
    elif kind == "jsonl":
        rows.write.mode("overwrite").json(path)
    elif kind == "parquet":
        rows.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown export kind: {kind}")


def markdown(rows: DataFrame) -> DataFrame:
    """One row for each line of a Markdown table, in order of ``line_no``, which may leave gaps; header lines are 0 and 1."""
    spark = rows.sparkSession
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in rows.columns)), F.lit(" |"))
    head = spark.createDataFrame([(0, "| " + " | ".join(rows.columns) + " |"), (1, "|" + " --- |" * len(rows.columns))], "line_no long, line string")
    return head.unionByName(rows.select((F.monotonically_increasing_id() + 2).alias("line_no"), cells.alias("line")))


def manifest(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row: how many rows an export has, and a SHA-256 that does not depend on their order: of the sums of their hashes' parts."""
    hashes = rows.select(F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    # an order-free digest, so no task has to sort all rows: counts and sums of the hashes' parts
    parts = [F.sum(F.conv(F.substring("h", k, 12), 16, 10).cast("decimal(20,0)")).alias(f"p{k}") for k in (1, 13, 25, 37)]
    return hashes.agg(F.count("*").alias("rows"), *parts).select("rows", F.sha2(F.concat_ws(",", *(F.col(f"p{k}").cast("string") for k in (1, 13, 25, 37))), 256).alias("digest"))


def replace_partitions(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Write rows by key; keys that come again are replaced whole, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def publish(rows: DataFrame, root: str, snapshot: str) -> None:
    """Write a snapshot beside the others and then point to it, so that readers see all of it or none."""
    rows.write.mode("errorifexists").parquet(f"{root}/snapshots/{snapshot}")
    rows.sparkSession.createDataFrame([(snapshot,)], "snapshot string").coalesce(1).write.mode("overwrite").json(f"{root}/current")


def published(spark: SparkSession, root: str) -> DataFrame:
    """The snapshot that was published last."""
    return spark.read.parquet(f"{root}/snapshots/{spark.read.json(f'{root}/current').first().snapshot}")
