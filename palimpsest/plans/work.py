"""Queries over workload events: intervals, calendars, traces, episodes, attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest import views as V
from palimpsest.operators import dedup, episodes, intervals as I, registry as R, stats as S, trace as T
from palimpsest.plans.registry import query

CLOCK = ["contributor_id", "session_id", "project_id"]
EV = "WITH " + V.EVENTS_SQL
SEG = EV + """, gaps AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 3600000000 THEN 0 ELSE 1 END AS n FROM ev WINDOW w AS (PARTITION BY contributor_id, session_id, project_id ORDER BY us, event_id)),
runs AS (SELECT *, (sum(n) OVER (PARTITION BY contributor_id, session_id, project_id ORDER BY us, event_id))::BIGINT AS segment_no FROM gaps),
seg AS (SELECT contributor_id, session_id, project_id, segment_no, min(us) AS start_us, max(us) AS end_us, count(*) AS events FROM runs GROUP BY ALL)"""
UNION = SEG + """, isle AS (SELECT *, CASE WHEN start_us <= max(end_us) OVER (PARTITION BY contributor_id, project_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM seg),
isle2 AS (SELECT *, sum(n) OVER (PARTITION BY contributor_id, project_id ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS k FROM isle),
uni AS (SELECT contributor_id, project_id, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS segments FROM isle2 GROUP BY contributor_id, project_id, k)"""
PERTH = UNION + """, loc AS (SELECT *, (make_timestamp(start_us) AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Perth' AS ls, (make_timestamp(greatest(start_us, end_us - 1)) AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Perth' AS le FROM uni),
days AS (SELECT contributor_id, project_id, segments, start_us, end_us, unnest(generate_series(ls::DATE, le::DATE, INTERVAL 1 DAY))::DATE AS local_date FROM loc),
split AS (SELECT contributor_id, project_id, segments, local_date, greatest(start_us, epoch_us((local_date::TIMESTAMP AT TIME ZONE 'Australia/Perth') AT TIME ZONE 'UTC')) AS start_us,
 least(end_us, epoch_us(((local_date + 1)::TIMESTAMP AT TIME ZONE 'Australia/Perth') AT TIME ZONE 'UTC')) AS end_us FROM days)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.segments(V.events(spark, sf_dir), CLOCK)


def unioned(spark: SparkSession, sf_dir: str, evidence: bool = False) -> DataFrame:
    return I.union(segments(spark, sf_dir), ["contributor_id", "project_id"], evidence="event_ids" if evidence else None)


@query(SEG + " SELECT contributor_id, session_id, project_id, segment_no, start_us, end_us, events FROM seg")
def sessionize_1h(spark, sf_dir):
    return segments(spark, sf_dir).drop("event_ids")


@query(EV + """, g AS (SELECT session_id, greatest(0, least(us - lag(us) OVER (PARTITION BY session_id ORDER BY us, event_id), 1800000000)) AS gap, us - lag(us) OVER (PARTITION BY session_id ORDER BY us, event_id) AS raw FROM ev)
SELECT session_id, coalesce(sum(CASE WHEN raw IS NULL THEN 0 ELSE gap END), 0)::BIGINT AS active_us, count(*) AS events FROM g GROUP BY 1""")
def active_seconds_capped(spark, sf_dir):
    return I.capped_seconds(V.events(spark, sf_dir), ["session_id"])


@query(UNION + " SELECT contributor_id, project_id, start_us, end_us, segments, (end_us - start_us) // 1000000 AS seconds FROM uni")
def interval_union_project(spark, sf_dir):
    return unioned(spark, sf_dir).withColumn("seconds", F.floor((F.col("end_us") - F.col("start_us")) / 1_000_000).cast("long"))


@query(PERTH + " SELECT contributor_id, project_id, strftime(local_date, '%Y-%m-%d') AS local_date, start_us, end_us FROM split")
def split_local_midnight(spark, sf_dir):
    return I.split_midnights(unioned(spark, sf_dir), "Australia/Perth").select("contributor_id", "project_id", F.date_format("local_date", "yyyy-MM-dd").alias("local_date"), "start_us", "end_us")


EDGES = UNION + ", " + V.ACTIVITIES_SQL + """, cut AS (SELECT contributor_id, u.project_id, start_us AS lo, end_us AS hi, b FROM uni u JOIN (SELECT project_id, from_us AS b FROM act UNION SELECT project_id, to_us FROM act) c ON c.project_id = u.project_id AND b > start_us AND b < end_us
 UNION SELECT contributor_id, project_id, start_us, end_us, start_us FROM uni),
part AS (SELECT contributor_id, project_id, b AS start_us, coalesce(lead(b) OVER (PARTITION BY contributor_id, project_id, lo, hi ORDER BY b), hi) AS end_us FROM cut)"""


@query(EDGES + " SELECT p.contributor_id, p.project_id, p.start_us, p.end_us, activity FROM part p LEFT JOIN act ON act.project_id = p.project_id AND from_us <= p.start_us AND p.start_us < to_us")
def split_effective_boundaries(spark, sf_dir):
    act = V.activities(spark)
    parts = I.split_boundaries(unioned(spark, sf_dir).drop("segments"), act, "project_id")
    return I.as_of(parts, act, ["project_id"], "start_us", "activity")


@query(EV + ", " + V.ACTIVITIES_SQL + " SELECT event_id, ev.project_id, activity FROM ev LEFT JOIN act ON act.project_id = ev.project_id AND from_us <= us AND us < to_us")
def asof_activity(spark, sf_dir):
    return I.as_of(V.events(spark, sf_dir).select("event_id", "project_id", "us"), V.activities(spark), ["project_id"], "us", "activity").select("event_id", "project_id", "activity")


COMBINED = UNION + """, live AS (SELECT * FROM uni WHERE end_us > start_us), tm AS (SELECT contributor_id, start_us AS t0 FROM live UNION SELECT contributor_id, end_us FROM live),
cell AS (SELECT contributor_id, t0, lead(t0) OVER (PARTITION BY contributor_id ORDER BY t0) AS t1 FROM tm),
act2 AS (SELECT c.contributor_id, c.t0 AS start_us, c.t1 AS end_us, string_agg(l.project_id::VARCHAR, ',' ORDER BY l.project_id) AS members FROM cell c JOIN live l ON l.contributor_id = c.contributor_id AND l.start_us <= c.t0 AND c.t1 <= l.end_us GROUP BY ALL),
tch AS (SELECT *, CASE WHEN lag(end_us) OVER w = start_us AND lag(members) OVER w = members THEN 0 ELSE 1 END AS n FROM act2 WINDOW w AS (PARTITION BY contributor_id ORDER BY start_us)),
tch2 AS (SELECT *, sum(n) OVER (PARTITION BY contributor_id ORDER BY start_us) AS k FROM tch),
comb AS (SELECT contributor_id, members, min(start_us) AS start_us, max(end_us) AS end_us FROM tch2 GROUP BY contributor_id, members, k)"""


@query(COMBINED + " SELECT contributor_id, members, start_us, end_us, len(string_split(members, ','))::INTEGER AS member_count FROM comb")
def combined_clock_sweep(spark, sf_dir):
    return I.combined_clock(unioned(spark, sf_dir), ["contributor_id"], "project_id")


def day_parts(spark, sf_dir) -> DataFrame:
    parts = I.split_midnights(unioned(spark, sf_dir), "Australia/Perth")
    return parts.withColumn("ambiguous", F.col("segments") > 1)


CAL = PERTH + ", dp AS (SELECT *, (end_us - start_us) // 1000000 AS s, segments > 1 AS ambiguous FROM split)"


@query(CAL + " SELECT strftime(local_date, '%Y-%m-%d') AS local_date, project_id, sum(s)::BIGINT AS seconds, count(*) AS intervals, bool_or(ambiguous) AS ambiguous, sum(CASE WHEN ambiguous THEN s ELSE 0 END)::BIGINT AS ambiguous_seconds, (year(local_date) - (month(local_date) < 7)::INT)::INTEGER AS financial_year FROM dp GROUP BY local_date, project_id")
def calendar_day_project(spark, sf_dir):
    out = S.calendar(day_parts(spark, sf_dir), ["local_date", "project_id"])
    return out.withColumn("financial_year", S.financial_year(F.col("local_date"))).withColumn("local_date", F.date_format("local_date", "yyyy-MM-dd"))


@query(CAL + " SELECT project_id, sum(s)::BIGINT AS seconds, count(DISTINCT local_date) AS active_days, strftime(min(local_date), '%Y-%m-%d') AS first_date, strftime(max(local_date), '%Y-%m-%d') AS last_date FROM dp GROUP BY project_id")
def calendar_projects(spark, sf_dir):
    days = S.calendar(day_parts(spark, sf_dir), ["local_date", "project_id"])
    return days.groupBy("project_id").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("active_days"), F.date_format(F.min("local_date"), "yyyy-MM-dd").alias("first_date"), F.date_format(F.max("local_date"), "yyyy-MM-dd").alias("last_date"))


@query(CAL + " SELECT strftime(local_date, '%Y-%m-%d') AS local_date, contributor_id, project_id, printf('%.6f', sum(s) / 3600.0) AS hours, bool_or(ambiguous) AS ambiguous FROM dp GROUP BY local_date, contributor_id, project_id")
def timesheet_export_rows(spark, sf_dir):
    out = S.calendar(day_parts(spark, sf_dir), ["local_date", "contributor_id", "project_id"])
    return out.select(F.date_format("local_date", "yyyy-MM-dd").alias("local_date"), "contributor_id", "project_id", F.format_string("%.6f", F.col("seconds") / 3600.0).alias("hours"), "ambiguous")


@query(SEG + """, b AS (SELECT *, max(end_us) OVER (PARTITION BY contributor_id, project_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM seg WHERE end_us > start_us)
SELECT contributor_id, project_id, session_id, segment_no, start_us, end_us FROM b WHERE start_us < before""")
def overlap_guard(spark, sf_dir):
    return I.overlaps(segments(spark, sf_dir), ["contributor_id", "project_id"]).select("contributor_id", "project_id", "session_id", "segment_no", "start_us", "end_us")


def _timeline(bucket, fmt):
    @query(EV + f" SELECT strftime(make_timestamp(us), '{fmt}') AS bucket, event_type, count(*) AS events, count(DISTINCT session_id) AS sessions FROM ev GROUP BY 1, 2")
    def run(spark, sf_dir):
        return S.timeline(V.events(spark, sf_dir), bucket, "event_type")

    return run


for _bucket, _fmt in (("day", "%Y-%m-%d"), ("week", "%G-W%V"), ("month", "%Y-%m")):
    _f = _timeline(_bucket, _fmt)
    from palimpsest.plans import registry as _r

    _r.QUERIES[f"timeline_{_bucket}"], _r.SQL[f"timeline_{_bucket}"] = _r.QUERIES.pop("run"), _r.SQL.pop("run")


@query(EV + " SELECT count(*) AS events, count(DISTINCT session_id) AS sessions, count(DISTINCT project_id) AS projects, min(us) AS first_us, max(us) AS last_us, (SELECT count(*) FROM documents) AS contents, (SELECT count(DISTINCT text) FROM documents) AS distinct_contents, (SELECT sum(strlen(text))::BIGINT FROM documents) AS bytes FROM ev")
def corpus_counts(spark, sf_dir):
    ev = V.events(spark, sf_dir).agg(F.count("*").alias("events"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("project_id").alias("projects"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    docs = V.table(spark, sf_dir, "documents").agg(F.count("*").alias("contents"), F.countDistinct("text").alias("distinct_contents"), F.sum(F.octet_length("text")).alias("bytes"))
    return ev.crossJoin(docs)


@query(EV + " SELECT kind, project_id, count(*) AS events, count(DISTINCT session_id) AS sessions, count(*) FILTER (WHERE value > 50) AS large, round(100.0 * count(*) FILTER (WHERE value > 50) / count(*), 6) AS large_percent FROM ev GROUP BY 1, 2")
def grouped_status(spark, sf_dir):
    big = F.count_if(F.col("value") > 50)
    return V.events(spark, sf_dir).groupBy("kind", "project_id").agg(F.count("*").alias("events"), F.countDistinct("session_id").alias("sessions"), big.alias("large"), F.round(100.0 * big / F.count("*"), 6).alias("large_percent"))


@query(EV + " SELECT project_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{s}') AS {s}" for s in ("click", "error", "purchase", "signup", "view")) + " FROM ev GROUP BY 1")
def coverage_pivot(spark, sf_dir):
    return S.coverage(V.events(spark, sf_dir), ["project_id"], "event_type", ["click", "error", "purchase", "signup", "view"])


@query(EV + " SELECT session_id, count(*) AS events, max(event_id) AS last_id, sum(event_id)::DECIMAL(38,0)::VARCHAR AS id_sum, round((max(us) - min(us)) / 3600000000.0, 6) AS span_hours FROM ev GROUP BY 1")
def session_signatures(spark, sf_dir):
    return V.events(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("events"), F.max("event_id").alias("last_id"), F.sum(F.col("event_id").cast("decimal(28,0)")).cast("string").alias("id_sum"), F.round((F.max("us") - F.min("us")) / 3600000000.0, 6).alias("span_hours"))


PAIR = EV + """, c AS (SELECT *, (kind = 'tool-input')::INT AS a FROM ev WHERE kind IN ('tool-input', 'tool-output')),
n AS (SELECT *, sum(a) OVER w AS i, sum(1 - a) OVER w AS o FROM c WINDOW w AS (PARTITION BY session_id ORDER BY event_id)),
g AS (SELECT *, greatest(0, max(o - i) OVER (PARTITION BY session_id ORDER BY event_id)) AS ign FROM n),
h AS (SELECT *, coalesce(lag(ign) OVER (PARTITION BY session_id ORDER BY event_id), 0) AS was FROM g),
outs AS (SELECT session_id, o - ign AS k, event_id AS output_id FROM h WHERE a = 0 AND ign = was), ins AS (SELECT session_id, i AS k, event_id AS call_id FROM h WHERE a = 1)"""


@query(PAIR + " SELECT session_id, call_id, output_id FROM ins LEFT JOIN outs USING (session_id, k)")
def trace_pair_calls(spark, sf_dir):
    return T.pair_calls(V.events(spark, sf_dir), ["session_id"])


@query(EV + """, m AS (SELECT *, CASE WHEN lag(kind) OVER w = kind THEN 0 ELSE 1 END AS n FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY event_id)), k AS (SELECT *, (sum(n) OVER (PARTITION BY session_id ORDER BY event_id))::BIGINT AS run_no FROM m)
SELECT session_id, run_no, kind, count(*) AS length, min(event_id) AS first_id FROM k GROUP BY ALL""")
def trace_runs(spark, sf_dir):
    return T.runs(V.events(spark, sf_dir), ["session_id"], "kind")


def call_units(spark, sf_dir):
    """Events as units of calls: operations by their counter, some outputs with an error signature, some of these reporting success."""
    k = F.get_json_object("props", "$.k").cast("long")
    return V.events(spark, sf_dir).withColumns({"action": F.when(k % 2 == 0, "test").otherwise("edit"), "operation": F.concat(F.lit("op:"), (k % 3).cast("string")), "is_error": k % 11 == 0, "has_signature": k % 4 == 0, "text": F.when(k % 8 == 0, "log\nExit code: 0").otherwise("log\nExit code: 1")})


CALLS = PAIR.replace("kind IN ('tool-input', 'tool-output')", "kind IN ('tool-input', 'tool-output', 'error')") + """, u AS (SELECT *, (props->>'k')::BIGINT AS k FROM ev),
calls AS (SELECT ins.session_id, call_id, output_id, CASE WHEN a.k % 2 = 0 THEN 'test' ELSE 'edit' END AS action, 'op:' || (a.k % 3) AS operation, CASE WHEN output_id IS NULL THEN 'unknown' WHEN b.kind = 'error' OR b.k % 11 = 0 OR (b.k % 4 = 0 AND b.k % 8 <> 0) THEN 'error' ELSE 'result' END AS outcome, a.us AS start_us, coalesce(b.us, a.us) AS end_us
 FROM ins LEFT JOIN outs USING (session_id, k) JOIN u a ON a.event_id = call_id LEFT JOIN u b ON b.event_id = output_id)"""


@query(CALLS + " SELECT * FROM calls")
def trace_call_outcomes(spark, sf_dir):
    return T.call_outcomes(call_units(spark, sf_dir), ["session_id"])


@query(CALLS + """, m AS (SELECT *, CASE WHEN lag(action || operation || outcome) OVER (PARTITION BY session_id ORDER BY call_id) = action || operation || outcome THEN 0 ELSE 1 END AS n FROM calls), nb AS (SELECT *, (sum(n) OVER (PARTITION BY session_id ORDER BY call_id))::BIGINT AS run_no FROM m)
SELECT session_id, run_no, action, operation, outcome, count(*) AS count, min(call_id) AS first_id, arg_max(coalesce(output_id, call_id), call_id) AS last_id, arg_min(start_us, call_id) AS start_us, arg_max(end_us, call_id) AS end_us FROM nb GROUP BY ALL""")
def trace_call_runs(spark, sf_dir):
    return T.call_runs(T.call_outcomes(call_units(spark, sf_dir), ["session_id"]), ["session_id"])


TRANS = EV + ", p AS (SELECT session_id, event_id, kind, lead(kind) OVER (PARTITION BY session_id ORDER BY event_id) AS next_value FROM ev)"


@query(TRANS + " SELECT kind AS value, next_value, count(*) AS uses, count(DISTINCT session_id) AS support, min(event_id) AS first_seen FROM p WHERE next_value IS NOT NULL GROUP BY 1, 2")
def trace_transitions(spark, sf_dir):
    return T.transitions(V.events(spark, sf_dir), ["session_id"], "kind")


@query(TRANS + " SELECT kind AS value, next_value, count(*) AS uses, min(event_id) AS first_seen FROM p WHERE next_value IS NOT NULL GROUP BY 1, 2 ORDER BY uses DESC, first_seen LIMIT 12")
def trace_top_transitions(spark, sf_dir):
    return T.transitions(V.events(spark, sf_dir), ["session_id"], "kind").drop("support").orderBy(F.desc("uses"), "first_seen").limit(12)


EPISODE = "WITH RECURSIVE " + V.EVENTS_SQL + """, o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS rn FROM ev),
st(session_id, rn, event_id, us, kind, no, has_goal, moved) AS (
 SELECT session_id, rn, event_id, us, kind, 1, kind = 'goal', false FROM o WHERE rn = 1
 UNION ALL SELECT o.session_id, o.rn, o.event_id, o.us, o.kind, st.no + CASE WHEN opens THEN 1 ELSE 0 END, (NOT opens AND st.has_goal) OR o.kind = 'goal', (NOT opens AND st.moved) OR (NOT opens AND st.has_goal AND o.kind <> 'goal')
 FROM st JOIN o ON o.session_id = st.session_id AND o.rn = st.rn + 1, LATERAL (SELECT (o.kind = 'goal' AND st.has_goal AND st.moved) OR (greatest(0, o.us - st.us) >= 43200000000) AS opens) x)"""


def episode_rows(spark, sf_dir) -> DataFrame:
    return episodes.segment(V.events(spark, sf_dir), ["session_id"])


@query(EPISODE + " SELECT session_id, event_id, no::INTEGER AS episode_no FROM st")
def episode_segments(spark, sf_dir):
    return episode_rows(spark, sf_dir).select("session_id", "event_id", "episode_no")


@query(EPISODE + """, gp AS (SELECT *, us - lag(us) OVER (PARTITION BY session_id, no ORDER BY event_id) AS gap FROM st),
r AS (SELECT session_id, no::INTEGER AS episode_no, min(event_id) AS anchor_id, min(us) AS start_us, max(us) AS end_us, count(*) AS events, count(*) FILTER (WHERE kind = 'goal') AS goals, count(*) FILTER (WHERE kind = 'tool-input') AS attempts,
 count(*) FILTER (WHERE kind = 'error') AS errors, count(*) FILTER (WHERE kind = 'outcome') AS outcomes, coalesce(sum(greatest(0, least(gap, 1800000000))) FILTER (WHERE gap IS NOT NULL), 0)::BIGINT AS active_us FROM gp GROUP BY session_id, no)
SELECT *, CASE WHEN errors > 0 THEN 'error-observed' WHEN attempts > 0 AND outcomes > 0 THEN 'result-observed' WHEN attempts > 0 THEN 'attempt-observed' ELSE 'discussion' END AS evidence_state FROM r""")
def episode_render(spark, sf_dir):
    return episodes.render(episode_rows(spark, sf_dir), ["session_id"])


@query(EPISODE + """, f AS (SELECT session_id, no::INTEGER AS episode_no, st.kind, props AS value, min(st.event_id) AS first_id FROM st JOIN ev USING (event_id) WHERE props IS NOT NULL GROUP BY st.session_id, no, st.kind, props),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id, episode_no, kind ORDER BY first_id, value)::INTEGER AS position FROM f) SELECT * FROM k WHERE position <= 100""".replace("SELECT session_id, no::INTEGER", "SELECT st.session_id AS session_id, no::INTEGER"))
def episode_fingerprints(spark, sf_dir):
    return episodes.fingerprints(episode_rows(spark, sf_dir), ["session_id"], F.col("props"))


@query(EV + """, c AS (SELECT *, event_id = min(event_id) OVER (PARTITION BY session_id, event_type, props) AS own FROM ev)
SELECT props, count(*) AS physical, count(*) FILTER (WHERE own) AS independent, count(DISTINCT CASE WHEN own THEN session_id END) AS sessions, count(DISTINCT CASE WHEN own THEN project_id END) AS projects, greatest(count(*) - count(*) FILTER (WHERE own), 0) AS echoes
FROM c WHERE kind = 'tool-input' GROUP BY 1 HAVING count(*) FILTER (WHERE own) >= 2""")
def repetition_commands(spark, sf_dir):
    ev = dedup.canonical(V.events(spark, sf_dir), ["session_id", "event_type", "props"], "event_id").withColumn("canonical", F.col("canonical_id").isNull())
    return S.repetition(ev.filter("kind = 'tool-input'"), "props")


@query(EPISODE + """, e AS (SELECT st.session_id, no, props, min(st.event_id) AS first_id FROM st JOIN ev USING (event_id) WHERE st.kind = 'error' GROUP BY st.session_id, no, props), raw AS (SELECT props, count(*) AS hits FROM ev WHERE kind = 'error' GROUP BY 1)
SELECT e.props, count(*) AS episodes, count(DISTINCT e.session_id) AS sessions, greatest(max(hits) - count(*), 0) AS echoes FROM e JOIN raw ON raw.props = e.props GROUP BY 1 HAVING count(*) >= 2""")
def repetition_errors(spark, sf_dir):
    prints = episodes.fingerprints(episode_rows(spark, sf_dir), ["session_id"], F.col("props")).filter("kind = 'error'")
    raw = V.events(spark, sf_dir).filter("kind = 'error'").groupBy("props").agg(F.count("*").alias("hits"))
    out = prints.groupBy(F.col("value").alias("props")).agg(F.count("*").alias("episodes"), F.countDistinct("session_id").alias("sessions")).filter("episodes >= 2")
    return out.join(raw, "props").select("props", "episodes", "sessions", F.greatest(F.col("hits") - F.col("episodes"), F.lit(0)).cast("long").alias("echoes"))


LINE = """WITH RECURSIVE u AS (SELECT DISTINCT user_id AS id, user_id // 2 AS parent FROM events), p AS (SELECT id, CASE WHEN parent = id OR parent NOT IN (SELECT id FROM u) THEN NULL ELSE parent END AS parent FROM u),
w(id, up) AS (SELECT id, id FROM p UNION ALL SELECT w.id, p.parent FROM w JOIN p ON p.id = w.up WHERE p.parent IS NOT NULL)"""


@query(LINE + " SELECT id, min(up) AS root_id FROM w GROUP BY 1")
def lineage_root(spark, sf_dir):
    own = V.events(spark, sf_dir).select(F.col("session_id").alias("id")).distinct()
    return R.lineage_roots(own.select("id", F.when(F.col("id") != F.floor(F.col("id") / 2), F.floor(F.col("id") / 2)).alias("parent_id")))


@query(EV + """, d AS (SELECT session_id, project_id, max(us) AS us FROM ev GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY us DESC, session_id)::INTEGER AS depth FROM d), n AS (SELECT *, max(us) OVER (PARTITION BY project_id) AS newest FROM k WHERE depth <= 5)
SELECT session_id, project_id, us, depth FROM n ORDER BY depth, newest DESC, project_id LIMIT 20""")
def round_robin_select(spark, sf_dir):
    groups = V.events(spark, sf_dir).groupBy("session_id", "project_id").agg(F.max("us").alias("us"))
    return R.round_robin(groups, "project_id", "us", "session_id", per_bucket=5, limit=20)


@query(EV + """, s AS (SELECT session_id, project_id, list_sort(list_distinct(list(event_id))) AS m FROM ev WHERE kind = 'error' GROUP BY 1, 2)
SELECT session_id, project_id, len(m)::BIGINT AS members, 'v1:' || sha256('v1' || chr(10) || array_to_string(list_transform(m, lambda x: '[' || x || ']'), chr(10))) AS fingerprint FROM s""")
def evidence_sets(spark, sf_dir):
    return dedup.evidence_sets(V.events(spark, sf_dir).filter("kind = 'error'"), ["session_id", "project_id"], "event_id")


@query(EV + " SELECT event_id, 'event' AS origin FROM ev WHERE kind = 'error' UNION ALL SELECT doc_id, 'label' FROM labels")
def union_all_evidence(spark, sf_dir):
    errors = V.events(spark, sf_dir).filter("kind = 'error'").select("event_id", F.lit("event").alias("origin"))
    return errors.unionByName(V.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id"), F.lit("label").alias("origin")))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id").subtract(V.table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def set_intersection(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id").intersect(V.table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"))


@query("SELECT doc_id, quality, toxic, 'left' AS side FROM labels WHERE toxic = 1 OR toxic IS NULL")
def verify_membership(spark, sf_dir):
    labels = V.table(spark, sf_dir, "labels")
    return dedup.membership_faults(labels, labels.filter("toxic = 0"), ["doc_id", "quality", "toxic"])


# ---- token usage and costs

from palimpsest.operators import costs as C  # noqa: E402

COST = "WITH " + V.USAGE_SQL + ", " + V.PRICES_SQL + """, pr AS (SELECT u.*, (SELECT arg_max(rate, effective_from) FROM price p WHERE p.model = u.model AND p.tier IS NOT DISTINCT FROM u.tier AND p.effective_from <= u.day) AS rate FROM usage u)"""
COST_COLUMNS = "sum(tokens)::BIGINT AS tokens, count(rate) AS priced, count(*) - count(rate) AS unpriced, (coalesce(sum(tokens::DECIMAL(18,0) * rate::DECIMAL(12,6)), 0)::DECIMAL(32,6) * 0.000001::DECIMAL(6,6))::DECIMAL(38,12) AS cost"


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC)::INTEGER AS usage_rank FROM orders")
def usage_dedup_rank(spark, sf_dir):
    return C.rank_usage(V.table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], [F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")]).select("o_orderkey", "o_custkey", "usage_rank")


def priced(spark, sf_dir) -> DataFrame:
    return C.priced(V.usage(spark, sf_dir), V.prices(spark))


@query(COST + f" SELECT strftime(day, '%Y-%m-%d') AS day, {COST_COLUMNS} FROM pr GROUP BY 1")
def token_cost_daily(spark, sf_dir):
    return C.cost_by(priced(spark, sf_dir), [F.date_format("day", "yyyy-MM-dd").alias("day")])


@query(COST + f" SELECT model, tier, {COST_COLUMNS} FROM pr GROUP BY 1, 2")
def token_cost_model(spark, sf_dir):
    return C.cost_by(priced(spark, sf_dir), ["model", "tier"])


@query(COST + f" SELECT session_id, {COST_COLUMNS} FROM pr GROUP BY 1")
def token_cost_session(spark, sf_dir):
    return C.cost_by(priced(spark, sf_dir), ["session_id"])


@query(COST + f" SELECT strftime(date_trunc('week', day), '%Y-%m-%d') AS week, {COST_COLUMNS} FROM pr GROUP BY 1")
def token_cost_group_week(spark, sf_dir):
    return C.cost_by(priced(spark, sf_dir), [F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd").alias("week")])


@query("WITH " + V.USAGE_SQL + " SELECT model, tier, strftime(day, '%Y-%m') AS month, md5(string_agg(message_id::VARCHAR, ',' ORDER BY message_id)) AS messages_md5, sum(tokens)::BIGINT AS tokens FROM usage GROUP BY 1, 2, 3")
def token_usage_collect(spark, sf_dir):
    by = ["model", "tier", "month"]
    u = V.usage(spark, sf_dir).withColumn("month", F.date_format("day", "yyyy-MM"))
    ids = S.ordered_md5(u, by, "message_id", name="messages_md5")
    sums = u.groupBy(*by).agg(F.sum("tokens").alias("tokens"))
    on = [sums[c].eqNullSafe(ids[c]) for c in by]
    return sums.join(ids, on).select(*(sums[c] for c in by), "messages_md5", "tokens")
