"""Queries over records and text units: integrity, reads, recall, goals, signatures and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest import views as V
from palimpsest.functions import jsontext as J, text as X
from palimpsest.operators import inventory, lexicon as L, reads, recall, records as C, search as S, semanticmap
from palimpsest.plans.content import LEX, LEXTOP, WORDS, LINES, lexical_hits, lexical_ranked, log_lines
from palimpsest.plans.registry import query
from palimpsest.plans.work import EPISODE, EV, episode_rows

T = V.table
UNITS = "u AS (SELECT conv_id AS session_id, turn AS ordinal, role, role || '-message' AS kind, text FROM conversations)"


# ---------------------------------------------------------------- integrity


@query("WITH a AS (SELECT n_chars AS k, sha256(text) AS h FROM documents WHERE doc_id % 2 = 0), b AS (SELECT n_chars AS k, sha256(text) AS h FROM documents WHERE doc_id % 2 = 1) SELECT k, count(DISTINCT h) AS contents FROM (SELECT * FROM b UNION ALL SELECT * FROM a WHERE k IN (SELECT k FROM b)) x GROUP BY k HAVING count(DISTINCT h) > 1")
def mutated_records(spark, sf_dir):
    """Odd documents as a batch, even ones as the archive, with the length as a (bad) key."""
    d = T(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("k"), F.sha2("text", 256).alias("h"))
    return C.mutated(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"), ["k"], "h")


@query("SELECT source, count(*) FILTER (WHERE doc_id % 50 <> 0) AS intact, count(*) FILTER (WHERE doc_id % 50 = 0) AS broken FROM documents GROUP BY 1")
def rebuild_check(spark, sf_dir):
    d = T(spark, sf_dir, "documents").withColumn("digest", F.sha2(F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256))
    return C.rebuilt(d, "text", "digest", lambda rows: rows, ["source"])[1]


@query("SELECT doc_id, md5(lower(text)) AS projection FROM documents WHERE doc_id % 50 <> 0")
def rebuild_projection(spark, sf_dir):
    d = T(spark, sf_dir, "documents").withColumn("digest", F.sha2(F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256))
    return C.rebuilt(d, "text", "digest", lambda rows: rows.select("doc_id", F.md5(F.lower("text")).alias("projection")), ["source"])[0]


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'new' WHEN doc_id % 5 = 2 OR (doc_id % 5 = 3 AND length(text) > 0) THEN 'restart' WHEN doc_id % 5 = 1 AND length(text) > 1 THEN 'resume' ELSE 'unchanged' END AS state FROM documents")
def resume_state(spark, sf_dir):
    """Sources as they are against checkpoints of the same text, of its first half, of other text, of longer text, and of none."""
    d, k, text = T(spark, sf_dir, "documents"), F.col("doc_id") % 5, F.col("text")
    half = F.left(text, F.ceil(F.length("text") / 2))
    was = F.when(k == 0, text).when(k == 1, half).when(k == 2, F.concat(F.lit("!"), F.substring(text, 2, 1 << 30))).when(k == 3, F.concat(text, text))
    stored = C.checkpoints(d.filter("doc_id % 5 < 4").select("doc_id", was.cast("binary").alias("content")), "doc_id", region=256)
    return C.resume_state(d.select("doc_id", text.cast("binary").alias("content")), stored, "doc_id", region=256)


@query("SELECT doc_id, source, n_chars // 100 AS revision FROM documents d WHERE n_chars // 100 = (SELECT max(n_chars // 100) FROM documents e WHERE e.source = d.source)")
def replaced_sources(spark, sf_dir):
    d = T(spark, sf_dir, "documents").select("doc_id", "source", F.floor(F.col("n_chars") / 100).alias("revision"))
    return C.live(d, "source", "revision").select("doc_id", "source", "revision")


# ---------------------------------------------------------------- reads


@query(EV + " SELECT session_id, event_id, kind, position::INTEGER AS position FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY us, event_id) AS position FROM ev) x WHERE position BETWEEN 4 AND 8")
def session_events(spark, sf_dir):
    return C.page(V.events(spark, sf_dir), "session_id", ["us", "event_id"], limit=5, offset=3).select("session_id", "event_id", "kind", "position")


@query("WITH " + UNITS + ", p AS (SELECT session_id, ordinal // 4 AS event, ordinal, row_number() OVER (PARTITION BY session_id, ordinal // 4 ORDER BY ordinal) AS position FROM u) SELECT session_id, event, ordinal, position::INTEGER AS position FROM p WHERE CASE WHEN event = 1 THEN position BETWEEN 2 AND 4 ELSE position = 1 END")
def unit_pages(spark, sf_dir):
    u = V.units(spark, sf_dir).withColumn("event", F.floor(F.col("ordinal") / 4))
    return C.unit_page(u, ["session_id", "event"], "ordinal", u.filter("event = 1"), offset=1).select("session_id", "event", "ordinal", "position")


def mixed_units(spark, sf_dir):
    kind = F.when(F.col("ordinal") % 4 == 1, "tool-output").when(F.col("ordinal") % 4 == 2, "reasoning").when(F.col("ordinal") % 7 == 3, "context-summary").otherwise(F.col("kind"))
    return V.units(spark, sf_dir).withColumn("kind", kind).withColumn("text", F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit("["), "role", F.lit("]\n"), "text")).otherwise(F.col("text")))


MIXED = "m AS (SELECT session_id, ordinal, CASE WHEN ordinal % 4 = 1 THEN 'tool-output' WHEN ordinal % 4 = 2 THEN 'reasoning' WHEN ordinal % 7 = 3 THEN 'context-summary' ELSE kind END AS kind, text FROM u)"


@query("WITH " + UNITS + ", " + MIXED + r""", b AS (SELECT session_id, ordinal // 3 AS window_no, ordinal, CASE WHEN kind LIKE '%message' THEN 0 WHEN kind LIKE 'reasoning%' THEN 1 WHEN kind LIKE 'tool%' THEN 2 ELSE 3 END AS p, left(regexp_replace(text, '^\s+|\s+$', '', 'g'), 300) AS body FROM m)
SELECT session_id, window_no, arg_min(body, p * 1000000 + ordinal) AS preview FROM b WHERE body <> '' GROUP BY 1, 2""")
def window_previews(spark, sf_dir):
    u = mixed_units(spark, sf_dir)
    w = u.groupBy("session_id", F.floor(F.col("ordinal") / 3).alias("window_no")).agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))
    return C.window_previews(w, u, "session_id", "ordinal")


@query("WITH " + UNITS + ", w AS (SELECT session_id, ordinal // 3 AS event, string_agg(text, chr(10) || chr(10) ORDER BY ordinal) AS t FROM u GROUP BY 1, 2) SELECT session_id, event, k::INTEGER AS segment_no, substr(t, (k * 400 + 1)::BIGINT, 400) AS segment FROM (SELECT *, unnest(range(ceil(length(t) / 400.0)::BIGINT)) AS k FROM w WHERE t <> '') x")
def event_segments(spark, sf_dir):
    u = V.units(spark, sf_dir).withColumn("event", F.floor(F.col("ordinal") / 3))
    return C.event_segments(u, ["session_id", "event"], "ordinal", "text", 400)


@query(r"""WITH c AS (SELECT lang, source, doc_id, left(text, 320) AS snippet, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS anchor, min(doc_id) OVER (PARTITION BY lang, source) AS best FROM documents), p AS (SELECT *, dense_rank() OVER (PARTITION BY lang ORDER BY best) AS place FROM c WHERE anchor <= 3),
s AS (SELECT *, length(snippet) + 5 * len(regexp_extract_all(snippet, '[^\x00-\x7F]')) + len(regexp_extract_all(snippet, '["\\\n\r\t\x08\f]')) + 256 AS cost FROM p WHERE place <= 20)
SELECT lang, source, doc_id, place::INTEGER AS place, anchor::INTEGER AS anchor, used FROM (SELECT *, (sum(cost) OVER (PARTITION BY lang ORDER BY place, anchor))::BIGINT AS used FROM s) x WHERE used <= 12000""")
def recall_response(spark, sf_dir):
    d = T(spark, sf_dir, "documents").select("lang", "source", "doc_id", "text")
    return C.response(d, ["lang"], "source", "doc_id", "text").select("lang", "source", "doc_id", "place", "anchor", "used")


@query("""WITH r AS (SELECT doc_id AS rank, lang, source, left(text, 10 + (doc_id % 3) * 5) AS t, doc_id % 40 AS unit FROM documents), l AS (SELECT unit, arg_max(t, length(t) * 1000000000 + rank) AS long FROM r GROUP BY 1),
g AS (SELECT r.unit, rank, CASE WHEN starts_with(long, t) THEN long ELSE t END AS t FROM r JOIN l USING (unit)) SELECT unit, t AS text, min(rank) AS rank, count(*) - 1 AS collapsed FROM g GROUP BY 1, 2""")
def recall_units(spark, sf_dir):
    d = T(spark, sf_dir, "documents").select(F.col("doc_id").alias("rank"), F.left(F.col("text"), (10 + F.col("doc_id") % 3 * 5).cast("int")).alias("text"), (F.col("doc_id") % 40).alias("unit"))
    return C.unit_copies(d.withColumn("us", F.col("rank")), ["unit"], "text", rank="rank", recency="us")


def prior_candidates(spark, sf_dir, n):
    """Documents as events of sessions (their sources' numbers), later ids being newer, ranked for each item."""
    d = T(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("provider"), "source")
    hit = lexical_ranked(spark, sf_dir, n).join(d, "doc_id")
    return hit.select("item_id", "rank", F.col("doc_id").alias("event_id"), F.regexp_extract("source", "[0-9]+$", 0).try_cast("long").alias("session_id"), F.lit("u").alias("unit_key"), "text", "provider", F.col("doc_id").alias("us"), F.col("source").alias("source_path"), F.col("score").alias("lexical_score"))


@query(LEXTOP + ", g AS (SELECT item_id, max(top.doc_id) AS representative, min(rank) AS first_rank, count(*) - 1 AS collapsed FROM top JOIN documents doc ON doc.doc_id = top.doc_id WHERE rank <= 45 GROUP BY item_id, doc.lang, doc.text) SELECT item_id, representative, first_rank::INTEGER AS rank, collapsed FROM g")
def prior_work_groups(spark, sf_dir):
    """Copies among each item's candidates: here whole equal texts of one language, the newest of which leads."""
    return recall.grouped(prior_candidates(spark, sf_dir, 45), query="item_id", most=45)


@query()
def find_prior_work(spark, sf_dir):
    """A reply of at most 12,000 characters for each item, with excerpts around its words; tests hold its rules."""
    items = T(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"), S.query_terms(F.col("text")).alias("terms"))
    found = L.headlines(prior_candidates(spark, sf_dir, 45).join(items, "item_id"), "text", "terms").withColumnRenamed("headline", "snippet")
    return recall.find_prior_work(found, items, query="item_id")


@query(LEX + ", e AS (SELECT DISTINCT item_id, d.source AS episode FROM hit JOIN documents d USING (doc_id)) SELECT item_id, episode FROM e")
def episode_lexical(spark, sf_dir):
    """Episodes (here sources) that hold a document with all words of a query."""
    of = T(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("episode"))
    return lexical_hits(spark, sf_dir).join(of, "doc_id").select("item_id", "episode").distinct()


@query("SELECT vec_id, label FROM embeddings WHERE vec_id > (SELECT max(vec_id) FROM embeddings) - 30")
def map_recent(spark, sf_dir):
    """The points of the last stretch before the newest one."""
    return S.recent(T(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", 30)


@query("WITH " + LINES.format("(props->>'k')::BIGINT") + " SELECT event_id, line FROM lines WHERE line ILIKE '%error%' AND regexp_matches(line, '(?i)^(fatal|panic|failed|failure|error|exception|traceback|assertionerror)(:|\\s|$)')")
def artifact_browse(spark, sf_dir):
    line = F.col("line")
    return log_lines(spark, sf_dir).filter(line.ilike("%error%") & (X.error_flag(line) == 1) & ~line.rlike("(?i)(command|process).*(exited|failed)"))


# ---------------------------------------------------------------- goals and signatures


def spoken(spark, sf_dir):
    """Units whose texts are partly commands, control messages and objectives."""
    k, t = F.col("ordinal") % 6, F.col("text")
    said = F.when(k == 0, F.concat(F.lit("<command-name>/goal</command-name> <command-args> "), t, F.lit(" </command-args>"))).when(k == 1, F.lit("<command-name> /clear </command-name>"))
    said = said.when(k == 2, F.concat(F.lit("<environment_context>"), t)).when(k == 3, F.concat(F.lit(" <goal_context><objective> "), t, F.lit(" </objective>"))).otherwise(t)
    return V.units(spark, sf_dir).withColumn("text", said).withColumn("kind", F.when(F.col("ordinal") % 5 == 4, "tool-input").when(F.col("ordinal") % 5 == 3, "assistant-message").otherwise("user-message")).withColumn("is_error", F.col("ordinal") % 7 == 5)


SPOKEN = r"""sp AS (SELECT session_id, ordinal, CASE ordinal % 6 WHEN 0 THEN '<command-name>/goal</command-name> <command-args> ' || text || ' </command-args>' WHEN 1 THEN '<command-name> /clear </command-name>' WHEN 2 THEN '<environment_context>' || text WHEN 3 THEN ' <goal_context><objective> ' || text || ' </objective>' ELSE text END AS text,
CASE ordinal % 5 WHEN 4 THEN 'tool-input' WHEN 3 THEN 'assistant-message' ELSE 'user-message' END AS kind, ordinal % 7 = 5 AS is_error, regexp_replace(text, '^\s+|\s+$', '', 'g') AS bare FROM u),
gl AS (SELECT *, CASE WHEN kind <> 'user-message' THEN NULL WHEN ordinal % 6 = 0 THEN CASE WHEN bare <> '' THEN bare END WHEN ordinal % 6 IN (1, 2, 3) THEN NULL ELSE bare END AS goal FROM sp)"""


@query("WITH " + UNITS + ", " + SPOKEN + " SELECT session_id, ordinal, goal FROM gl")
def goal_text(spark, sf_dir):
    return spoken(spark, sf_dir).select("session_id", "ordinal", C.goal_text(F.col("kind"), F.col("text")).alias("goal"))


SECTION = "se AS (SELECT *, CASE WHEN goal IS NOT NULL THEN 'goal' WHEN ordinal % 6 = 3 AND bare <> '' THEN 'objective' WHEN kind = 'user-message' AND ordinal % 6 IN (2, 3) THEN 'metadata' WHEN is_error THEN 'error' WHEN kind = 'tool-input' THEN 'attempt' WHEN kind = 'assistant-message' THEN 'outcome' END AS section FROM gl)"


@query("WITH " + UNITS + ", " + SPOKEN + ", " + SECTION + " SELECT session_id, ordinal // 2 AS event, CASE WHEN count(DISTINCT section) = 1 THEN min(section) ELSE 'mixed' END AS section FROM se GROUP BY 1, 2")
def event_sections(spark, sf_dir):
    return C.event_sections(spoken(spark, sf_dir).withColumn("event", F.floor(F.col("ordinal") / 2)), ["session_id", "event"])


DOCUMENTS = r""", dv AS (SELECT session_id, ordinal, kind, is_error, regexp_replace(text, '^\s+|\s+$', '', 'g') AS whole, bare, goal, CASE WHEN goal IS NOT NULL THEN 2 WHEN ordinal % 6 = 3 AND bare <> '' THEN 1 WHEN kind = 'user-message' AND ordinal % 6 IN (2, 3) THEN NULL WHEN is_error THEN 7 WHEN kind = 'tool-input' THEN 5 WHEN kind = 'assistant-message' THEN 8 END AS k FROM gl),
dt AS (SELECT *, CASE k WHEN 2 THEN goal WHEN 1 THEN bare ELSE whole END AS v FROM dv), once AS (SELECT session_id, k, v, min(ordinal) AS o FROM dt WHERE k IS NOT NULL GROUP BY 1, 2, 3),
part AS (SELECT session_id, k, '[' || ['OBJECTIVE', 'GOAL', 'CONTEXT', 'REASONING', 'ATTEMPTS', 'RESULTS', 'ERROR EVIDENCE', 'OUTCOME MESSAGES'][k] || ']' || chr(10) || string_agg(v, chr(10) || chr(10) ORDER BY o) AS b FROM once GROUP BY 1, 2),
whole AS (SELECT session_id, string_agg(b, chr(10) || chr(10) ORDER BY k) AS document FROM part GROUP BY 1), gs AS (SELECT session_id, string_agg(v, chr(10) || chr(10) ORDER BY o) FILTER (k = 2) AS g, arg_max(v, o) FILTER (k = 1) AS ob FROM once GROUP BY 1),
n AS (SELECT session_id, count(*) FILTER (k = 5) AS attempts, count(DISTINCT whole) FILTER (k = 7) AS errors, string_agg(v, chr(10) || chr(10) ORDER BY ordinal) FILTER (k = 8) AS said FROM dt GROUP BY 1)"""


@query("WITH " + UNITS + ", " + SPOKEN + DOCUMENTS + """ SELECT session_id, coalesce(g, ob, '') AS goal, coalesce(said, '') AS outcome, coalesce(document, '') AS document, attempts, errors, CASE WHEN errors > 0 THEN 'error-observed' WHEN attempts > 0 AND said <> '' THEN 'result-observed' WHEN attempts > 0 THEN 'attempt-observed' ELSE 'discussion' END AS evidence_state
FROM n LEFT JOIN whole USING (session_id) LEFT JOIN gs USING (session_id)""")
def episode_documents(spark, sf_dir):
    return C.documents(spoken(spark, sf_dir), ["session_id"], "ordinal")


@query()
def section_budgets(spark, sf_dir):
    """Episode documents cut to 600 characters, each section keeping its share."""
    docs = C.documents(spoken(spark, sf_dir), ["session_id"], "ordinal")
    return docs.select("session_id", C.balanced(F.col("document"), 600).alias("text"))


@query(EV + ", " + LINES.format("(props->>'k')::BIGINT").replace("FROM events)", "FROM events)") + r""", r AS (SELECT session_id, event_id, ev.kind, event_type, line FROM ev JOIN lines USING (event_id)),
er AS (SELECT session_id, t, row_number() OVER (PARTITION BY session_id ORDER BY s DESC, length(t), o) AS n FROM (SELECT session_id, t, o, (contains(l, 'error')::INT + contains(l, 'failed')::INT + contains(l, 'failure')::INT + contains(l, 'exception')::INT + contains(l, 'traceback')::INT + contains(l, 'not found')::INT + contains(l, 'denied')::INT + contains(l, 'timeout')::INT + contains(l, 'timed out')::INT + contains(l, 'broken pipe')::INT) AS s
 FROM (SELECT session_id, t, lower(t) AS l, min(event_id) AS o FROM (SELECT session_id, event_id, trim(regexp_replace(line, '\s+', ' ', 'g')) AS t FROM r WHERE kind = 'error') y GROUP BY 1, 2) x) w),
op AS (SELECT session_id, event_type AS v, row_number() OVER (PARTITION BY session_id ORDER BY min(event_id)) AS n FROM r GROUP BY 1, 2),
top AS (SELECT s.session_id, (SELECT list(t ORDER BY n) FROM er WHERE er.session_id = s.session_id AND n <= 3) AS e, (SELECT list(v ORDER BY n) FROM op WHERE op.session_id = s.session_id AND n <= 6) AS o FROM (SELECT DISTINCT session_id FROM r) s)
SELECT session_id, CASE WHEN e IS NOT NULL THEN 'Observed error: ' || e[1] ELSE 'Call sequence led by ' || o[1] END AS title, CASE WHEN e IS NOT NULL THEN 'observed-error' ELSE 'normalised-operation' END AS basis, md5(array_to_string(list_concat(coalesce(e, []), o), '|')) AS material FROM top""")
def trace_signature(spark, sf_dir):
    """The signature of each session's occurrence, from its error lines and operations."""
    r = V.events(spark, sf_dir).join(log_lines(spark, sf_dir), "event_id")

    def first_seen(value, rows):
        once = rows.groupBy("session_id", value.alias("v")).agg(F.min("event_id").alias("o"))
        return once.groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]).alias("all"))

    errors = first_seen(X.tidy(F.col("line")), r.filter("kind = 'error'")).withColumnRenamed("all", "errors")
    rows = first_seen(F.col("event_type"), r).withColumnRenamed("all", "operations").join(errors, "session_id", "left")
    none = F.array().cast("array<string>")
    s = rows.select("session_id", C.signature(F.coalesce("errors", none), none, F.col("operations"), F.lit(""), F.lit(0), F.col("session_id")).alias("s"))
    return s.select("session_id", "s.title", "s.basis", F.md5(F.array_join(F.concat("s.errors", "s.operations"), "|")).alias("material"))


@query(EV + " SELECT event_id, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE greatest(0, b - a) END AS gap_us FROM (SELECT event_id, CASE WHEN event_id % 9 > 0 THEN us END AS b, lag(CASE WHEN event_id % 9 > 0 THEN us END) OVER (PARTITION BY session_id ORDER BY event_id) AS a FROM ev) x")
def event_gaps(spark, sf_dir):
    from pyspark.sql import Window

    us = F.when(F.col("event_id") % 9 > 0, F.col("us"))
    rows = V.events(spark, sf_dir).withColumn("b", us)
    return rows.withColumn("a", F.lag("b").over(Window.partitionBy("session_id").orderBy("event_id"))).select("event_id", C.gap_us(F.col("a"), F.col("b")).alias("gap_us"))


@query(EV + """, f AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'done' WHEN 1 THEN 'ready' WHEN 2 THEN 'decision' WHEN 3 THEN 'waiting' WHEN 4 THEN 'paused' END AS st, CASE event_id % 5 WHEN 0 THEN 'No further decision needed.' WHEN 1 THEN 'Which ' || event_type || '?' WHEN 2 THEN ' ' END AS de, CASE event_id % 4 WHEN 0 THEN ['No further action required.'] WHEN 1 THEN ['Run ' || event_type, 'none'] ELSE [] END AS mv, event_id % 7 = 0 AS lo FROM ev),
g AS (SELECT *, CASE WHEN event_id % 5 = 1 THEN de END AS d, CASE WHEN event_id % 4 = 1 THEN mv[1:1] ELSE [] END AS m FROM f), h AS (SELECT *, coalesce(st = 'done', false) AND d IS NULL AND len(m) = 0 AND NOT lo AS settled FROM g)
SELECT event_id, CASE WHEN settled THEN st WHEN d IS NOT NULL THEN 'decision' WHEN st IN ('done', 'decision') THEN 'ready' ELSE st END AS state, d AS decision, array_to_string(m, ';') AS moves, CASE WHEN coalesce(st, '') NOT IN ('ready', 'decision', 'blocked', 'waiting', 'done', 'unclear') THEN 'state' WHEN NOT settled AND len(m) = 0 THEN 'next_moves' END AS fault FROM h""")
def draft_faults(spark, sf_dir):
    """Drafts of all states with decisions, moves and open loops, and with words that say there are none."""
    k, kind = F.col("event_id"), F.col("event_type")
    none = F.array().cast("array<string>")
    state = F.when(k % 6 == 0, "done").when(k % 6 == 1, "ready").when(k % 6 == 2, "decision").when(k % 6 == 3, "waiting").when(k % 6 == 4, "paused")
    decision = F.when(k % 5 == 0, "No further decision needed.").when(k % 5 == 1, F.concat(F.lit("Which "), kind, F.lit("?"))).when(k % 5 == 2, " ")
    moves = F.when(k % 4 == 0, F.array(F.lit("No further action required."))).when(k % 4 == 1, F.array(F.concat(F.lit(" Run  "), kind), F.lit("none"))).otherwise(none)
    draft = C.resume_draft(state, decision, moves, none, F.when(k % 7 == 0, F.array(F.lit("loop"))).otherwise(none))
    return V.events(spark, sf_dir).select("event_id", draft.alias("d")).select("event_id", "d.state", "d.decision", F.array_join("d.moves", ";").alias("moves"), "d.fault")


# ---------------------------------------------------------------- JSON and paths


def json_records(spark, sf_dir):
    """Records as JSON with unsorted keys: reasoning with encrypted content, one of them nested, and text that is no JSON."""
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    deep = F.concat(F.lit('{"type":"Reasoning","summary":[{"type":"t","text":" '), kind, F.lit('é "}],"encrypted_content":"'), kind, F.lit('","a":'), k, F.lit("}"))
    text = F.when(F.col("event_id") % 3 == 0, deep).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"z":[1,'), deep, F.lit('],"b":"'), kind, F.lit('"}'))).otherwise(F.concat(F.lit("no json "), kind))
    return T(spark, sf_dir, "events").select("event_id", text.alias("body"))


DEEP = """js AS (SELECT event_id, '{"a":' || (props->>'k') || ',"encrypted_content":"' || event_type || '","summary":[{"text":" ' || event_type || 'é ","type":"t"}],"type":"Reasoning"}' AS deep, event_type AS kind, props->>'k' AS k, event_id % 3 AS c FROM events)"""


@query("WITH " + DEEP + """ SELECT event_id, CASE c WHEN 0 THEN deep WHEN 1 THEN '{"b":"' || kind || '","z":[1,' || deep || ']}' END AS body FROM js""")
def json_sorted(spark, sf_dir):
    return json_records(spark, sf_dir).select("event_id", J.sorted_json(F.col("body")).alias("body"))


@query("WITH " + DEEP + """, rd AS (SELECT *, '{"a":' || k || ',"encrypted_content":"[redacted encrypted reasoning]","encrypted_content_byte_count":' || strlen(kind) || ',"encrypted_content_redacted":true,"encrypted_content_sha256":"' || sha256(kind) || '","summary":[{"text":" ' || kind || 'é ","type":"t"}],"type":"Reasoning"}' AS out FROM js)
SELECT event_id, CASE c WHEN 0 THEN out WHEN 1 THEN '{"b":"' || kind || '","z":[1,' || out || ']}' END AS body FROM rd""")
def redacted_records(spark, sf_dir):
    return json_records(spark, sf_dir).select("event_id", J.redacted(F.col("body")).alias("body"))


@query("SELECT event_type, count(*) FILTER (WHERE event_id % 3 < 2) AS reasoning_records, count(*) FILTER (WHERE event_id % 3 < 2) AS encrypted_records, coalesce(sum(strlen(event_type)) FILTER (WHERE event_id % 3 < 2), 0)::BIGINT AS encrypted_bytes, count(*) FILTER (WHERE event_id % 3 < 2) AS readable_summary_records, coalesce(sum(strlen(event_type) + 2) FILTER (WHERE event_id % 3 < 2), 0)::BIGINT AS readable_summary_bytes FROM events GROUP BY 1")
def retention_preview(spark, sf_dir):
    rows = json_records(spark, sf_dir).join(T(spark, sf_dir, "events").select("event_id", "event_type"), "event_id").select("event_type", J.footprint(F.col("body")).alias("n"))
    return rows.groupBy("event_type").agg(*(F.sum(f"n.{c}").alias(c) for c in J.COUNTS))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (props->>'k')::BIGINT END AS a FROM events")
def tolerant_json(spark, sf_dir):
    return json_records(spark, sf_dir).select("event_id", J.tolerant(F.col("body"), "a long, type string")["a"].alias("a"))


@query(r"""SELECT page_id, CASE WHEN p <> '' THEN regexp_extract(p, '([^/]*)$', 1) END AS leaf, CASE page_id % 4 WHEN 0 THEN 'history' WHEN 1 THEN 'subagent' WHEN 2 THEN 'workflow-journal' ELSE 'session' END AS kind, CASE WHEN page_id % 4 = 1 THEN 'parent' || page_id END AS parent
FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS p FROM pages) x""")
def path_parts(spark, sf_dir):
    k, place = F.col("page_id") % 4, F.regexp_replace("url", "[?#].*$", "")
    path = F.when(k == 0, F.lit("a/history.jsonl")).when(k == 1, F.concat(F.lit("a/parent"), F.col("page_id").cast("string"), F.lit("/subagents/x.jsonl"))).when(k == 2, F.lit("b/journal.jsonl")).otherwise(place)
    return T(spark, sf_dir, "pages").select("page_id", X.path_leaf(place).alias("leaf"), X.source_kind(path).alias("kind"), X.parent_session(path).alias("parent"))


DEEPER = """rec AS (SELECT c, kind, count(*) AS n FROM js GROUP BY 1, 2), sums AS (SELECT sum(n) FILTER (c = 0) AS n0, sum(n) FILTER (c = 1) AS n1 FROM rec)"""


@query("WITH " + DEEP + " SELECT 'events:' || CASE c WHEN 0 THEN 'Reasoning:a,encrypted_content,summary,type' WHEN 1 THEN 'history-record:b,z' ELSE 'parse-error:' END AS shape, count(*) AS records FROM js GROUP BY c")
def schema_shapes(spark, sf_dir):
    return inventory.shapes(json_records(spark, sf_dir).withColumn("provider", F.lit("events")), "provider", "body")


@query("WITH " + DEEP + ", " + DEEPER + """ SELECT path, type, (CASE WHEN d = 0 THEN n0 ELSE n1 END)::BIGINT AS values FROM sums, (VALUES ('b', 'string', 1), ('z', 'array', 1), ('z[]', 'bigint', 1), ('z[]', 'object', 1)) t(path, type, d)
UNION ALL SELECT CASE WHEN d = 0 THEN path ELSE 'z[].' || path END, type, (CASE WHEN d = 0 THEN n0 ELSE n1 END)::BIGINT FROM sums, (VALUES ('a', 'bigint'), ('encrypted_content', 'string'), ('summary', 'array'), ('summary[]', 'object'), ('summary[].text', 'string'), ('summary[].type', 'string'), ('type', 'string')) t(path, type), range(2) r(d)""")
def schema_paths(spark, sf_dir):
    """Every path of keys within the records, whatever its depth."""
    return inventory.key_paths(json_records(spark, sf_dir), "body")


@query()
def semantic_map(spark, sf_dir):
    """Windows of the conversations with given vectors, in two coordinates and eight labelled clusters; tests hold the axes against numpy."""
    vectors = T(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("session_id"), (F.col("vec_id") % 5).cast("int").alias("window_no"), F.col("embedding").alias("vector"))
    return semanticmap.semantic_map(V.units(spark, sf_dir), vectors, "session_id", "ordinal", stop=["the", "and", "que", "les", "der", "die", "und", "des"])


# ---------------------------------------------------------------- lists and details

SES = EV + ", " + V.SESSIONS_SQL


@query(SES + " SELECT session_id, provider, cwd, events, position::INTEGER AS position FROM (SELECT *, row_number() OVER (ORDER BY coalesce(end_us, start_us) DESC, session_id DESC) AS position FROM ses WHERE provider = 'p1' AND contains(lower(cwd), '/en')) x WHERE position BETWEEN 6 AND 25")
def session_list(spark, sf_dir):
    """A page of one provider's sessions by part of their folder, the latest first."""
    return reads.list_sessions(V.sessions(spark, sf_dir), provider="p1", text="/EN", limit=20, offset=5).select("session_id", "provider", "cwd", "events", "position")


@query("WITH " + UNITS + ", " + LINES.format("(props->>'k')::BIGINT") + r""", un AS (SELECT session_id AS event_id, string_agg(ordinal || ':' || kind || ':' || length(text), ',' ORDER BY ordinal) AS units FROM u GROUP BY 1), ar AS (SELECT event_id, '1:' || sha256(line) AS artifacts FROM lines WHERE event_id % 3 = 0)
SELECT event_id, event_type, coalesce(units, '') AS units, coalesce(artifacts, '') AS artifacts FROM events LEFT JOIN un USING (event_id) LEFT JOIN ar USING (event_id) WHERE event_id % 2 = 0""")
def event_details(spark, sf_dir):
    """Every second event with the units of the conversation under its number and, for some, its log line as an artifact."""
    units = V.units(spark, sf_dir).select(F.col("session_id").alias("event_id"), F.col("ordinal").alias("unit_index"), F.concat(F.lit("u"), "ordinal").alias("unit_key"), "kind", F.lit(None).cast("string").alias("label"), F.lit(False).alias("is_error"), "text")
    artifacts = log_lines(spark, sf_dir).filter("event_id % 3 = 0").select("event_id", F.lit(1).alias("artifact_id"), F.lit("line").alias("kind"), F.lit(None).cast("string").alias("label"), F.col("line").alias("value"))
    events = T(spark, sf_dir, "events")
    found = reads.event_details(events, units, artifacts, events.filter("event_id % 2 = 0"))
    each = F.array_join(F.transform("units", lambda u: F.concat_ws(":", u["unit_index"], u["kind"], u["chars"])), ",")
    return found.select("event_id", "event_type", each.alias("units"), F.array_join(F.transform("artifacts", lambda a: F.concat_ws(":", a["artifact_id"], a["value_hash"])), ",").alias("artifacts"))


@query(EPISODE + """, li AS (SELECT session_id, no, string_agg(event_id || ':' || kind, ',' ORDER BY event_id) AS events FROM st GROUP BY 1, 2), pr AS (SELECT session_id, no, string_agg(kind || '=' || props, ',' ORDER BY kind, props) AS fingerprints FROM (SELECT DISTINCT st.session_id, no, st.kind, props FROM st JOIN ev USING (event_id)) x GROUP BY 1, 2)
SELECT session_id, no::INTEGER AS episode_no, events, fingerprints FROM li JOIN pr USING (session_id, no) WHERE no % 2 = 1""")
def episode_details(spark, sf_dir):
    """Every second episode of a session with its events in order and its fingerprints by kind and value."""
    from palimpsest.operators import episodes

    rows, keys = episode_rows(spark, sf_dir), ["session_id", "episode_no"]
    links = rows.select(*keys, F.col("event_id").alias("position"), F.col("kind").alias("section"), "event_id")
    every = rows.select(*keys).distinct()
    prints = episodes.fingerprints(rows, ["session_id"], F.col("props"), most=1 << 30)
    found = reads.episode_details(every, links, V.events(spark, sf_dir), prints, every.filter("episode_no % 2 = 1"), episode=keys)
    return found.select(*keys, F.array_join(F.transform("events", lambda e: F.concat_ws(":", e["event_id"], e["kind"])), ",").alias("events"), F.array_join(F.transform("fingerprints", lambda f: F.concat_ws("=", f["kind"], f["value"])), ",").alias("fingerprints"))


ASKED = LEXTOP.replace(LEXTOP[: LEXTOP.index("hit AS (")], "WITH " + UNITS + ", " + SPOKEN + DOCUMENTS + f""", q AS (SELECT conv_id AS item_id, list_distinct({WORDS.format('text')}[1:2]) AS t FROM conversations WHERE turn = 0 AND conv_id % 10 = 0), d AS (SELECT session_id AS doc_id, {WORDS.format('document')} AS w FROM whole JOIN n USING (session_id) WHERE errors = 0),
""")


@query(ASKED + " SELECT item_id AS query_id, doc_id AS session_id, score, position::INTEGER AS position FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) AS position FROM top) x WHERE position <= 10")
def episode_search(spark, sf_dir):
    """Episodes without errors whose whole document holds the first two words of some conversations, by cover density."""
    found = C.documents(spoken(spark, sf_dir), ["session_id"], "ordinal", whole=True).filter("errors = 0").withColumns({"start_us": F.lit(0), "end_us": F.lit(0)})
    first = F.array_join(F.slice(S.tokens(F.col("text")), 1, 2), " ")
    asked = V.units(spark, sf_dir).filter("ordinal = 0 and session_id % 10 = 0").select(F.col("session_id").alias("query_id"), first.alias("query"))
    return reads.list_episodes(found, asked, key="session_id", limit=10).select("query_id", "session_id", "score", "position")
