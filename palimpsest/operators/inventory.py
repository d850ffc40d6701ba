"""What kinds of records an archive holds: labels, shapes and key paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.session import checkpoint


def record_label(payload: Column) -> Column:
    """A record's type with its payload's type or its message's role; null for what is no JSON object."""
    said = F.coalesce(F.get_json_object(payload, "$.payload.type"), F.get_json_object(payload, "$.message.role"))
    return F.when(F.json_object_keys(payload).isNotNull(), F.concat_ws("/", _type(payload), F.nullif(said, F.lit(""))))


def _type(payload: Column) -> Column:
    return F.coalesce(F.nullif(F.get_json_object(payload, "$.type"), F.lit("")), F.lit("history-record"))


def shapes(records: DataFrame, provider: str, payload: str) -> DataFrame:
    """(shape, records): how many records of a provider and type have the same keys; ``provider:type:key,key``, keys sorted.

    Records that are no JSON objects have the shape ``provider:parse-error:``.
    """
    keys = F.json_object_keys(F.col(payload))
    shape = F.when(keys.isNotNull(), F.concat(F.col(provider), F.lit(":"), _type(F.col(payload)), F.lit(":"), F.array_join(F.array_sort(F.array_distinct(keys)), ","))).otherwise(F.concat(F.col(provider), F.lit(":parse-error:")))
    return records.groupBy(shape.alias("shape")).agg(F.count("*").alias("records"))


def key_paths(records: DataFrame, payload: str) -> DataFrame:
    """(path, type, values): every path of keys at any depth with its type and how many values have both.

    Elements of arrays are ``[]``.  Each level of nesting is exploded once, until no
    value holds others; texts that are no JSON have no paths.
    """
    spark = records.sparkSession
    level = records.select(F.lit("").alias("path"), F.try_parse_json(payload).alias("v")).filter("v is not null")
    found = None
    while True:
        inner = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(F.when(F.col("key").isNull(), F.concat("path", F.lit("[]"))).otherwise(F.concat("path", F.when(F.col("path") == "", "").otherwise("."), "key")).alias("path"), F.col("value").alias("v"))
        kind = F.schema_of_variant("v")
        typed = inner.withColumn("type", F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind.startswith("DECIMAL"), "decimal").otherwise(F.lower(kind)))
        typed = checkpoint(typed)  # a level is read twice: counted, and opened
        here = typed.groupBy("path", "type").agg(F.count("*").alias("values"))
        found = here if found is None else found.unionByName(here)
        level = typed.filter(F.col("type").isin("object", "array")).select("path", "v")
        if level.isEmpty():
            return found.groupBy("path", "type").agg(F.sum("values").alias("values"))
