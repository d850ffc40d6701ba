"""Token usage: duplicate responses, price as of a day, and cost roll-ups in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Micro-amounts: tokens times a rate of six places, summed before the one division by a million.
MICRO = "decimal(38,6)"


def rank_usage(rows: DataFrame, identity: list[str], order: list[Column]) -> DataFrame:
    """``rows`` with ``usage_rank``; ranks over 1 are duplicates of a response."""
    return rows.withColumn("usage_rank", F.row_number().over(Window.partitionBy(*identity).orderBy(*order)))


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Each usage, repeated ones too, with the ``rate`` of the latest price not after its day; a null tier only matches a null tier.

    A price holds until the next one of its model and tier; of two of one day the
    greater rate holds.  So a usage meets at most one row and nothing is aggregated.
    """
    until = F.lead("effective_from").over(Window.partitionBy("model", "tier").orderBy("effective_from", "rate"))
    book = prices.select(F.col("model").alias("_model"), F.col("tier").alias("_tier"), F.col("effective_from").alias("_from"), until.alias("_until"), F.col("rate").alias("_rate"))
    holds = (F.col("_from") <= F.col("day")) & (F.col("_until").isNull() | (F.col("day") < F.col("_until")))
    hit = usage.join(book, (F.col("model") == F.col("_model")) & F.col("tier").eqNullSafe(F.col("_tier")) & holds, "left")
    return hit.select(*usage.columns, F.col("_rate").alias("rate"))


def amount(micro: Column) -> Column:
    """A micro-amount as money with twelve places."""
    return (micro.cast("decimal(26,6)") * F.lit("0.000001").cast("decimal(6,6)")).cast("decimal(38,12)")


def cost_by(priced_usage: DataFrame, by: list[Column | str]) -> DataFrame:
    """Tokens, priced and unpriced messages, and the cost of the priced ones."""
    micro = F.sum(F.col("tokens").cast("decimal(12,0)") * F.col("rate").cast("decimal(12,6)")).cast(MICRO)
    out = priced_usage.groupBy(*by).agg(F.sum("tokens").alias("tokens"), F.count("rate").alias("priced"), F.count(F.when(F.col("rate").isNull(), 1)).alias("unpriced"), F.coalesce(micro, F.lit(0).cast(MICRO)).alias("_micro"))
    return out.withColumn("cost", amount(F.col("_micro"))).drop("_micro")
