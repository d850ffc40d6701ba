"""Queries over sessions and rules: filters, attribution, overrides, reports and statuses."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest import views as V
from palimpsest.operators import dedup, freshness as fresh, policy, registry as R, reports as P
from palimpsest.plans.registry import query
from palimpsest.plans.work import EV

SES = EV + ", " + V.SESSIONS_SQL
T0 = V.Y2024


# ---------------------------------------------------------------- filters


@query(SES + f""" SELECT event_id, provider, kind FROM (SELECT ev.*, provider, 'project-' || ev.project_id AS project_key, CASE WHEN ev.project_id = 3 THEN NULL WHEN ev.project_id < 3 THEN 'build' ELSE 'review' END AS classification FROM ev JOIN ses USING (session_id)) x
WHERE (project_key = 'project-3' OR event_type = 'project-3') AND coalesce(classification, 'unclassified') = 'unclassified' AND us >= {T0} AND us <= {T0 + 90 * V.DAY} AND kind = 'error'""")
def search_filters(spark, sf_dir):
    who = V.sessions(spark, sf_dir).select("session_id", "provider")
    rows = V.events(spark, sf_dir).join(who, "session_id").withColumns({
        "project_key": F.concat(F.lit("project-"), F.col("project_id").cast("string")), "is_error": F.col("kind") == "error",
        "classification": F.when(F.col("project_id") < 3, "build").when(F.col("project_id") > 3, "review"),
    })
    found = policy.matching(rows, equal={"provider": None, "contributor_id": ""}, any_of={("project_key", "event_type"): "project-3"}, classification="unclassified", date_from=T0, date_to=T0 + 90 * V.DAY, errors_only=True, include_reasoning=False)
    return found.select("event_id", "provider", "kind")


@query(SES + " SELECT event_id, kind, provider FROM ev JOIN ses USING (session_id) WHERE kind IN ('tool-input', 'tool-output') AND provider IN ('p0', 'p2') AND ev.project_id IN (1, 4) AND strftime(make_timestamp(CASE WHEN event_id % 5 = 0 THEN NULL ELSE us END), '%Y-%m-%d') BETWEEN '2024-01-05' AND '2024-02-20'")
def semantic_policy(spark, sf_dir):
    who = V.sessions(spark, sf_dir).select("session_id", "provider")
    rows = V.events(spark, sf_dir).join(who, "session_id").withColumn("us", F.when(F.col("event_id") % 5 != 0, F.col("us")))
    kinds = policy.admitted_kinds(tools=True)
    return policy.scoped(rows, kinds, providers=["p0", "p2", "p0", None], projects=[1, 4], date_from="2024-01-05T10:00", date_to="2024-02-20", project_columns=("project_id",)).select("event_id", "kind", "provider")


@query(EV + """, c AS (SELECT event_id, event_type, session_id, row_number() OVER (PARTITION BY session_id, event_type, value ORDER BY event_id) AS n, CASE WHEN event_id % 11 = 0 THEN 'history' WHEN event_id % 11 < 9 THEN 'session' END AS source_kind FROM ev)
SELECT event_id, event_type FROM c WHERE n = 1 AND event_type NOT IN ('signup') AND source_kind IS DISTINCT FROM 'history' AND session_id IN (SELECT conv_id FROM conversations)""")
def canonical_filter(spark, sf_dir):
    ev = V.events(spark, sf_dir).withColumn("source_kind", F.when(F.col("event_id") % 11 == 0, "history").when(F.col("event_id") % 11 < 9, "session"))
    ev = dedup.canonical(ev, ["session_id", "event_type", "value"], "event_id")
    units = ev.join(V.units(spark, sf_dir).select("session_id").distinct(), "session_id").select("event_id")
    return policy.independent(ev, units, exclude=("signup",)).select("event_id", "event_type")


@query(SES + f" SELECT event_id FROM ev JOIN ses USING (session_id) WHERE coalesce(CASE WHEN event_id % 3 > 0 THEN us END, start_us) >= {T0 + 10 * V.DAY} AND coalesce(CASE WHEN event_id % 3 > 0 THEN us END, start_us) < {T0 + 40 * V.DAY}")
def period_scope(spark, sf_dir):
    rows = V.events(spark, sf_dir).withColumn("us", F.when(F.col("event_id") % 3 > 0, F.col("us"))).join(V.sessions(spark, sf_dir).select("session_id", "start_us"), "session_id")
    return policy.in_period(rows, T0 + 10 * V.DAY, T0 + 40 * V.DAY).select("event_id")


@query(SES + f" SELECT DISTINCT project_id, provider, machine FROM ses WHERE start_us < {T0 + 30 * V.DAY} AND coalesce(CASE WHEN session_id % 4 > 0 THEN end_us END, start_us) >= {T0 + 20 * V.DAY}")
def session_period_overlap(spark, sf_dir):
    s = V.sessions(spark, sf_dir).withColumn("end_us", F.when(F.col("session_id") % 4 > 0, F.col("end_us")))
    return policy.touching(s, T0 + 20 * V.DAY, T0 + 30 * V.DAY).select("project_id", "provider", "machine").distinct()


# ---------------------------------------------------------------- attribution

ALIASES = [(1, None, None, "src", 0, 400, "all"), (2, "m1", None, "src", 0, 400, "m1-all"), (3, None, "p2", "src/src4", 0, 60, "p2-four"), (4, None, None, "src/src4/en", 0, 400, "four-en"), (5, "m1", "p1", "src/src9", 0, 400, "m1p1-nine"), (6, None, None, "src/src4/en", 30, 400, "four-en-later"), (7, None, None, "src/src1", 0, 400, "one"), (8, "m2", None, "src/src10/en/x", 0, 5, "early")]
RULES = [(1, "m0", None, None, 0, 400, 10), (2, "m0", "p1", "src/src1", 0, 400, 11), (3, "m1", None, "src/src2", 0, 400, 12), (4, "m1", None, "src/src2", 20, 400, 13), (5, "m2", "p2", "src/", 0, 400, 14), (6, "m2", None, None, 10, 20, 15)]


def _rules(spark, rows, value, kind):
    schema = f"id long, machine string, provider string, prefix string, a long, b long, {value} {kind}"
    return spark.createDataFrame(rows, schema).select("id", "machine", "provider", "prefix", (T0 + F.col("a") * V.DAY).alias("from_us"), (T0 + F.col("b") * V.DAY).alias("to_us"), value)


def _sql_rules(rows):
    def text(v):
        return "NULL" if v is None else repr(v)

    return "rule AS (SELECT id, machine, provider, prefix, (%d + a * %d)::BIGINT AS lo, (%d + b * %d)::BIGINT AS hi, v FROM (VALUES %s) r(id, machine, provider, prefix, a, b, v))" % (T0, V.DAY, T0, V.DAY, ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows))


@query(SES + ", " + _sql_rules(ALIASES) + """ SELECT session_id, x.v AS project FROM ses s LEFT JOIN LATERAL (SELECT v FROM rule r WHERE (r.machine IS NULL OR r.machine = s.machine) AND (r.provider IS NULL OR r.provider = s.provider) AND (s.cwd = prefix OR starts_with(s.cwd, prefix || '/')) AND start_us >= lo AND start_us < hi
ORDER BY (r.machine IS NOT NULL) DESC, (r.provider IS NOT NULL) DESC, length(prefix) DESC, lo DESC, id DESC LIMIT 1) x ON true""")
def alias_five_keys(spark, sf_dir):
    return R.most_specific(V.sessions(spark, sf_dir), _rules(spark, ALIASES, "project", "string"), "cwd", "start_us", "project", optional=["machine", "provider"]).select("session_id", "project")


@query(SES + ", " + _sql_rules(RULES) + """ SELECT session_id, x.v::BIGINT AS ruled FROM ses s LEFT JOIN LATERAL (SELECT v FROM rule r WHERE r.machine = s.machine AND (r.provider IS NULL OR r.provider = s.provider) AND starts_with(s.cwd, coalesce(prefix, '')) AND start_us >= lo AND start_us < hi
ORDER BY length(coalesce(prefix, '')) DESC, lo DESC, id DESC LIMIT 1) x ON true""")
def contributor_rule(spark, sf_dir):
    return R.contributor_of(V.sessions(spark, sf_dir), _rules(spark, RULES, "ruled", "long"), "cwd", "start_us", "ruled").select("session_id", "ruled")


OVERRIDE = """epi AS (SELECT session_id, event_id, event_id % 97 AS episode FROM ev), ovr AS (SELECT episode, 'act-' || (episode % 5) AS activity, CASE WHEN episode % 3 = 0 THEN 90 + episode % 4 END AS project FROM (SELECT DISTINCT event_id % 97 AS episode FROM ev) e WHERE episode % 8 = 0)"""


def _episodes(spark, sf_dir):
    return V.events(spark, sf_dir).select("session_id", "event_id", "us", F.col("project_id"), (F.col("event_id") % 97).alias("episode"))


def _overrides(spark, sf_dir):
    e = _episodes(spark, sf_dir).select("episode").distinct().filter("episode % 8 = 0")
    return e.select("episode", F.concat(F.lit("act-"), (F.col("episode") % 5).cast("string")).alias("activity"), F.when(F.col("episode") % 3 == 0, 90 + F.col("episode") % 4).alias("project"))


@query(EV + ", " + OVERRIDE + ", l AS (SELECT session_id, min(episode) AS episode FROM epi WHERE episode IN (SELECT episode FROM ovr) GROUP BY 1) SELECT ev.event_id, activity, coalesce(project, project_id)::BIGINT AS project FROM ev LEFT JOIN l USING (session_id) LEFT JOIN ovr USING (episode)")
def override_top1(spark, sf_dir):
    """Each event with the override of its session's first overridden episode; the override's project, or else its own."""
    ev = V.events(spark, sf_dir).select("event_id", "session_id", "project_id")
    linked = _episodes(spark, sf_dir).select("session_id", "episode").join(_overrides(spark, sf_dir), "episode")
    return R.first_override(ev, linked, "session_id", "episode", ["activity", "project"]).select("event_id", "activity", F.coalesce("project", "project_id").alias("project"))


@query(EV + ", " + V.ACTIVITIES_SQL + ", " + OVERRIDE + """, slice AS (SELECT session_id, project_id, min(us) AS t0 FROM ev GROUP BY 1, 2), o AS (SELECT session_id, count(DISTINCT activity) AS n, min(activity) AS a FROM epi JOIN ovr USING (episode) GROUP BY 1)
SELECT s.session_id, CASE WHEN n = 1 THEN a WHEN n > 1 THEN NULL ELSE act.activity END AS activity, coalesce(n > 1, false) AS ambiguous FROM slice s LEFT JOIN o USING (session_id) LEFT JOIN act ON act.project_id = s.project_id AND from_us <= t0 AND t0 < to_us""")
def activity_of_slice(spark, sf_dir):
    slices = V.events(spark, sf_dir).groupBy("session_id", "project_id").agg(F.min("us").alias("at"))
    own = _episodes(spark, sf_dir).select("session_id", "episode").join(_overrides(spark, sf_dir), "episode").select("session_id", "activity")
    return R.activity_of(slices, own, V.activities(spark), "session_id", "project_id", "at").select("session_id", "activity", "ambiguous")


@query(EV + ", i AS (SELECT DISTINCT session_id, event_type, round(value, 0) AS v FROM ev) SELECT DISTINCT b.session_id FROM i a JOIN i b ON a.event_type = b.event_type AND a.v = b.v WHERE a.session_id IN (3, 5, 8)")
def related_sessions(spark, sf_dir):
    ids = V.events(spark, sf_dir).select("session_id", "event_type", F.round("value", 0).alias("v"))
    return R.related(ids, ids.filter("session_id in (3, 5, 8)"), ["event_type", "v"], "session_id")


@query(SES + ", c AS (SELECT DISTINCT start_us // 86400000000 AS day, machine FROM ses) SELECT machine, (SELECT count(*) FROM c WHERE c.machine = m.machine) AS sources, (SELECT count(*) FROM ses WHERE ses.machine = m.machine) AS sessions, (SELECT coalesce(sum(events), 0)::BIGINT FROM ses WHERE ses.machine = m.machine) AS events FROM (SELECT 'm' || k AS machine FROM range(6) r(k)) m")
def machine_counts(spark, sf_dir):
    s = V.sessions(spark, sf_dir)
    machines = spark.range(6).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("machine"))
    sources = s.select("machine", F.floor(F.col("start_us") / V.DAY)).distinct()
    return P.left_totals(machines, "machine", {"sources": (sources, F.count("*")), "sessions": (s, F.count("*")), "events": (s, F.sum("events"))})


@query(SES + " SELECT c AS contributor_id, (SELECT count(*) FROM ses WHERE contributor_id = c) AS sessions, (SELECT count(DISTINCT machine) FROM ses WHERE contributor_id = c) AS machines FROM range(8) r(c)")
def contributor_list(spark, sf_dir):
    s = V.sessions(spark, sf_dir)
    return P.left_totals(spark.range(8).withColumnRenamed("id", "contributor_id"), "contributor_id", {"sessions": (s, F.count("*")), "machines": (s, F.countDistinct("machine"))})


@query(SES + ", " + V.ACTIVITIES_SQL + ", " + _sql_rules(ALIASES) + """ SELECT (SELECT count(DISTINCT project_id) FROM ses) AS projects, (SELECT count(*) FROM rule) AS aliases, (SELECT count(*) FROM ses WHERE contributor_id = 4) AS unresolved_contributors,
(SELECT count(*) FROM ses s WHERE NOT EXISTS (SELECT 1 FROM act WHERE act.project_id = s.project_id AND start_us >= from_us AND start_us < to_us)) AS unresolved_activities""")
def registry_summary(spark, sf_dir):
    s = V.sessions(spark, sf_dir).withColumn("contributor_id", F.when(F.col("contributor_id") != 4, F.col("contributor_id")))
    return P.registry_summary(s, _rules(spark, ALIASES, "project", "string"), V.activities(spark))


# ---------------------------------------------------------------- reports

@query(SES + " SELECT CASE WHEN project_id < 6 THEN 'project-' || project_id ELSE '(unknown)' END AS project, count(*) AS episodes, count(*) FILTER (WHERE errors > 0) AS error_episodes, sum(attempts)::BIGINT AS attempts, round(sum(end_us - start_us) / 3600000000.0, 6) AS active_hours FROM ses GROUP BY 1")
def episode_projects(spark, sf_dir):
    e = V.sessions(spark, sf_dir).withColumns({"project": F.when(F.col("project_id") < 6, F.concat(F.lit("project-"), F.col("project_id").cast("string"))), "active_us": F.col("end_us") - F.col("start_us")})
    return P.episode_projects(e)


@query(SES + " SELECT session_id, events, round((end_us - start_us) / 3600000000.0, 6) AS hours FROM ses ORDER BY events DESC, hours DESC, session_id LIMIT 20")
def longest_sessions(spark, sf_dir):
    return P.largest_sessions(V.sessions(spark, sf_dir), 20)


@query(SES + " SELECT provider, project_id, count(*) AS sessions, sum(events)::BIGINT AS events FROM ses GROUP BY 1, 2 ORDER BY events DESC, provider, project_id LIMIT 50")
def project_volume(spark, sf_dir):
    return V.sessions(spark, sf_dir).groupBy("provider", "project_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events")).orderBy(F.desc("events"), "provider", "project_id").limit(50)


@query(SES + " SELECT count(*) AS episodes, count(DISTINCT contributor_id) AS sessions, count(*) FILTER (WHERE errors > 0) AS error_episodes, coalesce(sum(attempts), 0)::BIGINT AS attempts, round(coalesce(sum(end_us - start_us), 0) / 1000000.0, 6) AS active_seconds FROM ses")
def episode_stats(spark, sf_dir):
    e = V.sessions(spark, sf_dir).withColumn("active_us", F.col("end_us") - F.col("start_us"))
    return P.episode_stats(e, "contributor_id")


@query(EV + """, s AS (SELECT k AS session_id, CASE WHEN k % 3 = 0 THEN NULL ELSE 5 END AS start_us, 7 AS end_us, k % 2 = 0 AS sourced FROM range(400) r(k)), n AS (SELECT session_id, count(*) AS c, min(CASE WHEN event_id % 2 = 0 THEN us END) AS lo, max(CASE WHEN event_id % 2 = 0 THEN us END) AS hi FROM ev GROUP BY 1)
SELECT session_id, coalesce(c, 0) AS events, coalesce(lo, start_us)::BIGINT AS start_us, coalesce(hi, end_us)::BIGINT AS end_us FROM s LEFT JOIN n USING (session_id) WHERE coalesce(c, 0) > 0 OR sourced""")
def reconcile_sessions(spark, sf_dir):
    old = spark.range(400).select(F.col("id").alias("session_id"), F.when(F.col("id") % 3 != 0, F.lit(5)).cast("long").alias("start_us"), F.lit(7).cast("long").alias("end_us"), (F.col("id") % 2 == 0).alias("sourced"))
    ev = V.events(spark, sf_dir).withColumn("us", F.when(F.col("event_id") % 2 == 0, F.col("us")))
    return P.reconcile(old, ev, "session_id").select("session_id", "events", "start_us", "end_us")


REVISIONS = "rev AS (SELECT doc_id, source, CASE doc_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' ELSE 'complete' END AS status, CASE WHEN doc_id % 9 = 0 THEN n_chars ELSE 0 END AS pending, strlen(text) + CASE WHEN doc_id % 50 = 0 THEN 1 ELSE 0 END AS byte_length, strlen(text) AS real_length FROM documents)"


def revisions(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    status = F.when(F.col("doc_id") % 7 == 0, "failed").when(F.col("doc_id") % 7 == 1, "partial").otherwise("complete")
    real = F.octet_length("text").cast("long")
    return d.select("doc_id", "source", status.alias("status"), F.when(F.col("doc_id") % 9 == 0, F.col("n_chars")).otherwise(0).alias("pending"), (real + (F.col("doc_id") % 50 == 0).cast("long")).alias("byte_length"), real.alias("real_length"))


@query("WITH " + REVISIONS + " SELECT count(DISTINCT source) AS sources, count(*) AS revisions, count(*) FILTER (WHERE byte_length <> real_length) AS length_mismatches, count(*) FILTER (WHERE status IN ('failed', 'partial') OR pending > 0) AS attention, sum(pending)::BIGINT AS pending_bytes, count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'partial') AS partial FROM rev")
def archive_status(spark, sf_dir):
    return P.archive_status(revisions(spark, sf_dir))


# the columns of a row, nulls told apart from texts
FINGER = "(SELECT source, count(*) AS n, sum(('0x' || substr(h, 1, 15))::BIGINT)::HUGEINT AS a, sum(('0x' || substr(h, 16, 15))::BIGINT)::HUGEINT AS b FROM (SELECT source, md5('=' || doc_id || chr(31) || coalesce('=' || lang, '-') || chr(31) || '=' || text) AS h FROM documents) x GROUP BY 1)"


def content_fingerprints(spark, sf_dir):
    return fresh.fingerprints(V.table(spark, sf_dir, "documents"), ["source"], ["doc_id", "lang", "text"])


@query("SELECT source, n, a::VARCHAR AS a, b::VARCHAR AS b FROM " + FINGER + " f")
def corpus_fingerprints(spark, sf_dir):
    """The fingerprint of each source's documents."""
    return content_fingerprints(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in ("a", "b")})


@query("SELECT sha256(sum(n) || ':' || sum(a) || ':' || sum(b)) AS revision FROM " + FINGER + " f")
def corpus_revision(spark, sf_dir):
    """One text for the whole corpus from its sources' fingerprints, some of them counted anew."""
    kept = content_fingerprints(spark, sf_dir)
    again = content_fingerprints(spark, sf_dir).filter(F.length("source") % 2 == 0)
    return fresh.revision(fresh.replaced(kept, again, ["source"]), [])


def archive_number(source):
    return F.regexp_extract(source, "[0-9]+$", 0).try_cast("long")


@query("WITH " + REVISIONS + ", f AS " + FINGER + r""", s AS (SELECT source, try_cast(regexp_extract(source, '[0-9]+$') AS BIGINT) AS k, count(*) FILTER (WHERE status = 'partial' AND doc_id % 3 = 0) AS open, count(*) FILTER (WHERE status = 'failed' AND doc_id % 14 = 0) AS failed, sum(pending)::BIGINT AS pending_bytes, count(*) FILTER (WHERE doc_id % 10 = 0) AS parse_errors FROM rev GROUP BY 1),
w AS (SELECT s.*, [CASE WHEN open > 0 THEN 'active source revisions are incomplete or still ingesting' END, CASE WHEN failed > 0 THEN 'one or more active source revisions failed' END, CASE WHEN k % 2 = 0 THEN 'derived episodes are stale relative to the active source catalog' END, CASE WHEN k % 5 = 0 THEN 'no complete timesheet snapshot exists' END, CASE WHEN k % 5 IN (1, 2) THEN 'latest timesheet snapshot is stale relative to the active source catalog' END, CASE WHEN k % 3 = 0 THEN 'token-cost snapshot is missing or stale' END, CASE WHEN k % 4 = 1 THEN 'latest semantic conversation attempt failed' END, CASE WHEN k % 4 IN (1, 3) THEN 'semantic conversation index is stale' END] AS t,
 [CASE WHEN open > 0 THEN 'allow the next sync cycle to ingest newly completed source lines' END, CASE WHEN failed > 0 THEN 'inspect the sync log and repair or quarantine the failed source revision' END, CASE WHEN k % 2 = 0 THEN 'run the derived episode refresh' END, CASE WHEN k % 5 < 3 THEN 'run the timesheet refresh' END, CASE WHEN k % 3 = 0 THEN 'run the token-cost refresh' END, CASE WHEN k % 4 = 1 THEN 'inspect the semantic conversation job error before retrying' END, CASE WHEN k % 4 IN (1, 3) THEN 'run the guarded semantic conversation refresh' END] AS act FROM s)
SELECT source, CASE WHEN failed > 0 THEN 'blocked' WHEN len(list_filter(t, lambda x: x IS NOT NULL)) > 0 THEN 'needs-attention' ELSE 'healthy' END AS status, array_to_string(list_filter(t, lambda x: x IS NOT NULL), '; ') AS warnings, array_to_string(list_filter(act, lambda x: x IS NOT NULL), '; ') AS actions, pending_bytes, parse_errors, failed = 0 AS safe FROM w WHERE k IS NOT NULL""")
def automation_status(spark, sf_dir):
    """Each source as an archive, with episodes, timesheets, costs and semantic runs of its revision or of an older one."""
    k = archive_number(F.col("source"))
    d = F.col("doc_id")
    state = F.when((F.col("status") == "partial") & (d % 3 == 0), "partial").when((F.col("status") == "failed") & (d % 14 == 0), "failed").otherwise("complete")
    sources = revisions(spark, sf_dir).filter(k.isNotNull()).select("source", state.alias("status"), "pending", (d % 10 == 0).cast("int").alias("errors"))
    now = fresh.revision(content_fingerprints(spark, sf_dir), ["source"])
    old = F.lit("an older revision")
    made = [("episodes", F.when(k % 2 == 0, old).otherwise(F.col("revision")), F.lit(None), F.lit(None)), ("timesheet", F.when(k % 5 == 1, old).otherwise(F.col("revision")), F.when(k % 5 == 2, 1).otherwise(2), k % 5 == 0), ("costs", F.when(k % 3 != 0, F.col("revision")), F.lit(None), F.lit(None))]
    derived = [now.filter(~F.coalesce(without.cast("boolean"), F.lit(False))).select("source", F.lit(what).alias("what"), r.alias("revision"), version.cast("int").alias("algorithm"), F.lit(1).alias("rows")) for what, r, version, without in made]
    runs = now.filter(k % 4 > 0).select("source", F.lit("conversation").alias("profile"), F.when(k % 4 == 1, "failed").otherwise("complete").alias("attempt_status"), F.when(k % 4 == 2, F.col("revision")).otherwise(old).alias("revision"))
    out = fresh.automation_status(sources, now, derived[0].unionByName(derived[1]).unionByName(derived[2]), runs, "source", algorithm=2)
    return out.select("source", "status", F.array_join("warnings", "; ").alias("warnings"), F.array_join("actions", "; ").alias("actions"), "pending_bytes", "parse_errors", "safe")


@query(SES + ", r AS (SELECT contributor_id, machine, project_id, provider, cwd, session_id, end_us, errors, events FROM ses WHERE session_id IN (SELECT conv_id FROM conversations WHERE role = 'user')) SELECT contributor_id, machine, project_id, provider, cwd, session_id, position::INTEGER AS position FROM (SELECT *, row_number() OVER (PARTITION BY contributor_id ORDER BY end_us DESC, session_id DESC) AS position FROM (SELECT *, row_number() OVER (PARTITION BY contributor_id, machine, cwd, project_id, provider ORDER BY end_us DESC, session_id DESC) AS n FROM r) x WHERE n = 1) y")
def resume_locations(spark, sf_dir):
    spoken = V.units(spark, sf_dir).filter("kind = 'user-message'").select("session_id")
    return P.locations(V.sessions(spark, sf_dir), spoken, "contributor_id").select("contributor_id", "machine", "project_id", "provider", "cwd", "session_id", "position")


@query(SES + ", st AS (SELECT CASE WHEN errors > 0 THEN 'blocked' WHEN attempts > 0 THEN 'active' ELSE 'idle' END AS state, coalesce(end_us, start_us) AS seen FROM ses) SELECT state, count(*) AS surfaces, max(seen) AS latest_us FROM st GROUP BY 1")
def resume_states(spark, sf_dir):
    state = F.when(F.col("errors") > 0, "blocked").when(F.col("attempts") > 0, "active").otherwise("idle")
    return V.sessions(spark, sf_dir).groupBy(state.alias("state")).agg(F.count("*").alias("surfaces"), F.max(F.coalesce("end_us", "start_us")).alias("latest_us"))


@query(SES + " SELECT session_id, CASE WHEN session_id % 13 = 0 THEN 'failed' WHEN errors > 0 OR session_id % 11 = 0 THEN CASE WHEN attempts > 0 THEN 'partial' ELSE 'failed' END ELSE 'complete' END AS status FROM ses")
def run_status(spark, sf_dir):
    s = F.col("session_id")
    return V.sessions(spark, sf_dir).select("session_id", P.run_status(caught=s % 13 == 0, release_error=s % 11 == 0, failed=F.col("errors"), generated=F.col("attempts"), reused=F.lit(0)).alias("status"))


@query("SELECT sum(n_chars)::BIGINT AS bytes, max(n_chars) AS largest, count(*) AS files, count(DISTINCT source) AS sources FROM documents")
def merge_summaries(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    parts = d.groupBy("source", "lang").agg(F.sum("n_chars").alias("bytes"), F.max("n_chars").alias("largest"), F.count("*").alias("files"))
    return P.merged(parts, sums=["bytes", "files"], tops=["largest"]).crossJoin(d.agg(F.countDistinct("source").alias("sources"))).select("bytes", "largest", "files", "sources")


RUNS = "run AS (SELECT doc_id AS run_id, lang AS profile, CASE WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'complete' END AS status, n_chars AS completed, doc_id % 5 = 0 AS active FROM documents)"


def semantic_run_table(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"), F.col("lang").alias("profile"), F.when(F.col("doc_id") % 3 == 0, "failed").otherwise("complete").alias("status"), F.col("n_chars").alias("completed"), (F.col("doc_id") % 5 == 0).alias("active"))


@query("WITH " + RUNS + " SELECT run_id, profile FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY completed DESC, run_id DESC) AS n FROM run WHERE status = 'complete') x WHERE n > 2")
def stale_runs(spark, sf_dir):
    """Runs that a retention of the two newest of each profile removes."""
    return P.older_than(semantic_run_table(spark, sf_dir).filter("status = 'complete'"), ["profile"], [F.desc("completed"), F.desc("run_id")], 2).select("run_id", "profile")


@query("WITH " + RUNS + " SELECT profile, arg_max(run_id, completed * 1000000000 + run_id) AS run_id FROM run WHERE status = 'complete' GROUP BY 1")
def latest_snapshot(spark, sf_dir):
    return semantic_run_table(spark, sf_dir).filter("status = 'complete'").groupBy("profile").agg(F.max_by("run_id", F.struct("completed", "run_id")).alias("run_id"))


@query("WITH " + RUNS + " SELECT run_id, profile FROM run WHERE status = 'complete' ORDER BY active DESC, (profile = 'de') DESC, completed DESC, run_id DESC LIMIT 1")
def available_run(spark, sf_dir):
    return P.available_run(semantic_run_table(spark, sf_dir), prefer="de").select("run_id", "profile")


@query("WITH " + RUNS + """, a AS (SELECT profile, run_id AS attempt_id, status AS attempt_status, completed FROM run QUALIFY row_number() OVER (PARTITION BY profile ORDER BY run_id DESC) = 1), c AS (SELECT profile, run_id AS complete_id FROM run WHERE status = 'complete' QUALIFY row_number() OVER (PARTITION BY profile ORDER BY run_id DESC) = 1)
SELECT profile, attempt_id, attempt_status, complete_id, complete_id IS NOT NULL AND complete_id = attempt_id AS fresh FROM a LEFT JOIN c USING (profile)""")
def semantic_runs(spark, sf_dir):
    return P.run_overview(semantic_run_table(spark, sf_dir))


@query("SELECT doc_id FROM documents ORDER BY sha256('42:' || doc_id) LIMIT 100")
def fit_sample(spark, sf_dir):
    return P.seeded_sample(V.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, seed=42)


@query("SELECT provider, language, n, rank::INTEGER AS rank FROM (SELECT source AS provider, lang AS language, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source, lang) AS rank FROM documents GROUP BY 1, 2) x WHERE rank <= 50")
def corpus_groups(spark, sf_dir):
    """The fifty largest groups of the corpus (a report's feature)."""
    n = V.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("provider"), F.col("lang").alias("language")).agg(F.count("*").alias("n"))
    return P.largest(n, [F.desc("n"), "provider", "language"], 50)


@query("""SELECT source, lang, count(*) AS files, sum(strlen(text))::BIGINT AS bytes, min(strlen(text)) AS smallest, max(strlen(text)) AS largest, CASE WHEN strlen(text) = 0 THEN 0 ELSE floor(log2(strlen(text)))::BIGINT END AS magnitude FROM documents GROUP BY source, lang, magnitude""")
def inventory_histogram(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").withColumn("bytes_", F.octet_length("text").cast("long"))
    return P.size_histogram(d, ["source", "lang"], "bytes_")


@query(SES + ", b AS (SELECT session_id % 40 AS episode, session_id FROM ses UNION ALL SELECT 41, 1 UNION ALL SELECT 42, 1) SELECT session_id, count(DISTINCT episode) AS episodes FROM b GROUP BY 1 HAVING count(DISTINCT episode) > 1")
def canonical_member_faults(spark, sf_dir):
    s = V.sessions(spark, sf_dir).select((F.col("session_id") % 40).alias("episode"), "session_id")
    extra = spark.createDataFrame([(41, 1), (42, 1)], "episode long, session_id long")
    return R.member_faults(s.unionByName(extra), "session_id", "episode").withColumnRenamed("owners", "episodes")


@query(SES + " SELECT machine, min(start_us) AS first_us, max(end_us) AS last_us, min(contributor_id) AS contributor_id FROM ses GROUP BY 1 UNION ALL SELECT 'unallocated', NULL, NULL, NULL")
def machine_registry(spark, sf_dir):
    return R.dimension(V.sessions(spark, sf_dir), "machine", {"first_us": F.min("start_us"), "last_us": F.max("end_us"), "contributor_id": F.min("contributor_id")}, fallback="unallocated")


@query(SES + """, e AS (SELECT session_id, project_id, start_us, errors, provider FROM ses), """ + V.ACTIVITIES_SQL + """, o AS (SELECT session_id, 'override' AS activity FROM ses WHERE session_id % 10 = 0)
SELECT session_id, provider, coalesce(o.activity, act.activity) AS activity, CASE coalesce(o.activity, act.activity) WHEN 'design' THEN 'planning' WHEN 'build' THEN 'delivery' ELSE 'unclassified' END AS classification, errors FROM e LEFT JOIN o USING (session_id) LEFT JOIN act ON act.project_id = e.project_id AND from_us <= start_us AND start_us < to_us ORDER BY start_us DESC, session_id DESC LIMIT 200""")
def work_trail(spark, sf_dir):
    s = V.sessions(spark, sf_dir)
    override = s.filter("session_id % 10 = 0").select("session_id", F.lit("override").alias("activity"))
    kinds = spark.createDataFrame([("design", "planning"), ("build", "delivery")], "activity string, classification string")
    return R.work_trail(s, override, V.activities(spark), kinds, limit=policy.clamp(200, 2000)).select("session_id", "provider", "activity", "classification", "errors")


@query(SES + ", p AS (SELECT start_us // 86400000000 AS day, project_id, sum(events)::BIGINT AS events FROM ses WHERE project_id IN (1, 2, 5) GROUP BY 1, 2) SELECT (day + 3) // 7 AS week, sum(events)::BIGINT AS events, count(DISTINCT day) AS days FROM p GROUP BY 1")
def week_totals(spark, sf_dir):
    """Totals of whole weeks (from Monday) over chosen projects, from day totals."""
    s = V.sessions(spark, sf_dir).filter(F.col("project_id").isin(1, 2, 5)).groupBy(F.floor(F.col("start_us") / V.DAY).alias("day"), "project_id").agg(F.sum("events").alias("events"))
    return s.groupBy(F.floor((F.col("day") + 3) / 7).alias("week")).agg(F.sum("events").alias("events"), F.countDistinct("day").alias("days"))


@query(EV + """, s AS (SELECT kind, count(*) AS n FROM ev GROUP BY 1)
SELECT 1 AS section, 0 AS line_no, '## Events' AS line UNION ALL SELECT 1, row_number() OVER (ORDER BY kind)::INTEGER, '| ' || kind || ' | ' || n || ' |' FROM s UNION ALL SELECT 2, 0, '## Languages' UNION ALL SELECT 2, row_number() OVER (ORDER BY lang)::INTEGER, '| ' || lang || ' | ' || n || ' |' FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1) l""")
def report_sections(spark, sf_dir):
    """A report's lines, section by section, from aggregates."""
    kinds = V.events(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))
    langs = V.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return P.report_lines([("Events", kinds, ["kind", "n"]), ("Languages", langs, ["lang", "n"])])


@query("SELECT lang, count(*) AS records, count(*) FILTER (WHERE n_chars > 500) AS included, round(100.0 * count(*) FILTER (WHERE n_chars > 500) / count(*), 6) AS included_percent, coalesce(sum(n_chars) FILTER (WHERE n_chars > 500), 0)::BIGINT AS included_bytes FROM documents GROUP BY 1")
def scope_estimate(spark, sf_dir):
    return P.scope_estimate(V.table(spark, sf_dir, "documents"), ["lang"], F.col("n_chars") > 500, F.col("n_chars"))


@query("WITH " + RUNS + ", p AS (SELECT profile AS version, max(completed) AS imported, sha256(count(*) || ':' || sum(('0x' || substr(h, 1, 15))::BIGINT)::HUGEINT || ':' || sum(('0x' || substr(h, 16, 15))::BIGINT)::HUGEINT) AS book_hash FROM (SELECT *, md5('=' || run_id || chr(31) || '=' || completed) AS h FROM run) x GROUP BY profile) SELECT version, book_hash, imported, row_number() OVER (ORDER BY imported DESC, version DESC) = 1 AS active FROM p")
def price_books(spark, sf_dir):
    """Versions of a price book by content hash; the one that was imported last is active."""
    rows = semantic_run_table(spark, sf_dir).select(F.col("profile").alias("version"), "run_id", "completed")
    return fresh.price_books(rows, "version", ["run_id", "completed"], "completed")
