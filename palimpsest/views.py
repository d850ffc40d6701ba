"""The standard tables in the shape of an archive.

events -> workload events of sessions (user), projects and contributors;
conversations -> text units; documents -> contents; orders and lineitem -> token
usage of messages; literal rows -> effective-dated dimensions.
Times are microseconds since the epoch (``us``), so that results are exact and
need no time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

HOUR = 3_600_000_000
DAY = 24 * HOUR
#: Start of 2024 in microseconds.
Y2024 = 1_704_067_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for costly work on each row: a small one, with fewer splits than cores, is dealt to all cores.

    A table that fills the cluster is read as it is, so nothing large is shuffled.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "goal").when(F.col("event_type") == "view", "tool-input").when(F.col("event_type") == "click", "tool-output").when(F.col("event_type") == "error", "error").otherwise("outcome")
    return table(spark, sf_dir, "events").select("event_id", micros("ts").alias("us"), F.col("user_id").alias("session_id"), (F.col("user_id") % 7).alias("project_id"), (F.col("user_id") % 5).alias("contributor_id"), kind.alias("kind"), "event_type", "value", "props")


EVENTS_SQL = """ev AS (SELECT event_id, epoch_us(ts) AS us, user_id AS session_id, user_id % 7 AS project_id, user_id % 5 AS contributor_id,
  CASE event_type WHEN 'signup' THEN 'goal' WHEN 'view' THEN 'tool-input' WHEN 'click' THEN 'tool-output' WHEN 'error' THEN 'error' ELSE 'outcome' END AS kind,
  event_type, value, props FROM events)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text units of conversations, in order of their turns."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ordinal"), "role", F.concat("role", F.lit("-message")).alias("kind"), "text")


def activities(spark: SparkSession) -> DataFrame:
    """Effective-dated default activities of projects, half-open: [from_us, to_us)."""
    rows = [(p, name, Y2024 + a * DAY, Y2024 + b * DAY) for p in range(6) for name, a, b in (("design", 0, 9 + p), ("build", 9 + p, 20), ("review", 20, 400))]
    return spark.createDataFrame(rows, "project_id long, activity string, from_us long, to_us long")


ACTIVITIES_SQL = """act AS (SELECT p AS project_id, a.activity, (1704067200000000 + (CASE WHEN a.lo < 0 THEN 9 + p ELSE a.lo END) * 86400000000)::BIGINT AS from_us,
  (1704067200000000 + (CASE WHEN a.hi < 0 THEN 9 + p ELSE a.hi END) * 86400000000)::BIGINT AS to_us
  FROM range(6) r(p), (VALUES ('design', 0, -1), ('build', -1, 20), ('review', 20, 400)) a(activity, lo, hi))"""


def prices(spark: SparkSession) -> DataFrame:
    """A price book: rates per million tokens by model, tier (null: none) and day from which they hold."""
    rows = [(f"model-{m}", tier, day, rate) for m in range(3) for tier in (None, "fast") for day, rate in (("1990-01-01", f"{m + 1}.250000"), ("1998-07-01", f"{m + 2}.500000"))]
    return spark.createDataFrame(rows, "model string, tier string, day string, rate string").select("model", "tier", F.col("day").cast("date").alias("effective_from"), F.col("rate").cast("decimal(12,6)").alias("rate"))


PRICES_SQL = """price AS (SELECT 'model-' || m AS model, t.tier, d.day::DATE AS effective_from, ((m + d.plus) || d.frac)::DECIMAL(12,6) AS rate
  FROM range(3) r(m), (VALUES (NULL), ('fast')) t(tier), (VALUES ('1990-01-01', 1, '.25'), ('1998-07-01', 2, '.5')) d(day, plus, frac))"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token usage: an order is a message of a session (customer), its lines' quantities are tokens."""
    o, item = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    tokens = item.groupBy(F.col("l_orderkey").alias("message_id")).agg(F.sum(F.col("l_quantity").cast("long") * 1000).alias("tokens"))
    tier = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "fast")
    m = o.select(F.col("o_orderkey").alias("message_id"), F.col("o_custkey").alias("session_id"), F.concat(F.lit("model-"), (F.col("o_custkey") % 4).cast("string")).alias("model"), tier.alias("tier"), F.to_date("o_orderdate").alias("day"))
    return m.join(tokens, "message_id")


USAGE_SQL = """usage AS (SELECT o_orderkey AS message_id, o_custkey AS session_id, 'model-' || (o_custkey % 4) AS model,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast' END AS tier, o_orderdate::DATE AS day, tokens
  FROM orders JOIN (SELECT l_orderkey, sum(l_quantity::BIGINT * 1000)::BIGINT AS tokens FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each session of the events: who, where and when, with counts."""
    ev = events(spark, sf_dir)
    s = F.col("session_id")
    place = F.concat(F.lit("src/src"), (s % 23).cast("string"), F.when(s % 2 == 0, "/en").otherwise("/de"), F.lit("/x"))
    return ev.groupBy("session_id", "project_id", "contributor_id").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("events"), F.count_if(F.col("kind") == "error").alias("errors"), F.count_if(F.col("kind").isin("tool-input", "tool-output")).alias("attempts")).withColumns(
        {"provider": F.concat(F.lit("p"), (s % 3).cast("string")), "machine": F.concat(F.lit("m"), (s % 4).cast("string")), "cwd": place}
    )


SESSIONS_SQL = """ses AS (SELECT session_id, project_id, contributor_id, min(us) AS start_us, max(us) AS end_us, count(*) AS events, count(*) FILTER (WHERE kind = 'error') AS errors, count(*) FILTER (WHERE kind IN ('tool-input', 'tool-output')) AS attempts,
  'p' || (session_id % 3) AS provider, 'm' || (session_id % 4) AS machine, 'src/src' || (session_id % 23) || CASE WHEN session_id % 2 = 0 THEN '/en' ELSE '/de' END || '/x' AS cwd FROM ev GROUP BY session_id, project_id, contributor_id)"""
