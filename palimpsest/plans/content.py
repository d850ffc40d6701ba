"""Queries over contents and dimensions: dedup, search, recall, text functions, registry, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest import views as V
from palimpsest.functions import identity, text as X
from palimpsest.operators import dedup, lexicon as L, registry as R, search as S, stats, vectorindex
from palimpsest.plans.registry import query

T = V.table
WORDS = "regexp_extract_all(lower({}), '[\\pL\\pN_]+')"


@query("SELECT doc_id, CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY text) THEN min(doc_id) OVER (PARTITION BY text) END AS canonical_id FROM documents")
def canonical_dedup(spark, sf_dir):
    return dedup.canonical(T(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], "doc_id").select("doc_id", "canonical_id")


@query("SELECT lang, count(*) AS events, count(DISTINCT text) AS logical, count(*) - count(DISTINCT text) AS copies FROM documents GROUP BY 1")
def canonical_summary(spark, sf_dir):
    d = dedup.canonical(T(spark, sf_dir, "documents"), ["lang", "text"], "doc_id")
    return d.groupBy("lang").agg(F.count("*").alias("events"), F.count_if(F.col("canonical_id").isNull()).alias("logical"), F.count("canonical_id").alias("copies"))


@query("SELECT arg_min(doc_id, doc_id) AS doc_id, source, lang FROM documents GROUP BY source, lang")
def distinct_on_first(spark, sf_dir):
    return dedup.first_by(T(spark, sf_dir, "documents"), ["source", "lang"], ["doc_id"]).select("doc_id", "source", "lang")


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY 1")
def insert_ignore_contents(spark, sf_dir):
    d = T(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash"), "doc_id")
    new = d.filter("doc_id % 2 = 1").groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
    return dedup.insert_ignore(d.filter("doc_id % 2 = 0"), new, ["content_hash"])


@query("""SELECT c_nationkey, arg_min(c_mktsegment, c_custkey) FILTER (WHERE c_acctbal > 0) AS segment, arg_min(c_name, c_custkey) FILTER (WHERE c_acctbal > 5000) AS name FROM customer GROUP BY 1""")
def session_upsert(spark, sf_dir):
    rows = T(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_acctbal") > 5000, F.col("c_name")).alias("name"))
    return dedup.upsert_first_non_null(rows, ["c_nationkey"], "c_custkey")


@query("SELECT doc_id, sha256(lang || chr(0) || source || chr(0) || doc_id::VARCHAR) AS event_key FROM documents".replace("chr(0)", "'|'"))
def identity_keys(spark, sf_dir):
    d = T(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(F.concat_ws("|", "lang", "source", F.col("doc_id").cast("string")), 256).alias("event_key"))


@query("SELECT doc_id, (('0x' || substr(sha256(source || '/' || doc_id::VARCHAR), 1, 16))::UBIGINT % 16)::INTEGER AS shard FROM documents")
def shard_filter(spark, sf_dir):
    return T(spark, sf_dir, "documents").select("doc_id", identity.shard(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")), 16).alias("shard"))


LEX = f"""WITH q AS (SELECT item_id, list_distinct({WORDS.format("array_to_string((regexp_extract_all(text, '[\\pL\\pN_@./:-]+'))[1:64], ' ')")}) AS t FROM benchmark), d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
hit AS (SELECT item_id, doc_id, list_sum(list_transform(w, lambda x: list_contains(t, x)::INT))::BIGINT AS tf, len(w)::BIGINT AS length FROM q, d WHERE len(t) > 0 AND list_has_all(w, t))"""


def lexical_hits(spark, sf_dir):
    return S.lexical(V.texts(spark, sf_dir, "documents"), T(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


@query(LEX + " SELECT item_id, doc_id, tf, length FROM hit")
def lexical_and_match(spark, sf_dir):
    return lexical_hits(spark, sf_dir)


# the latest place of each of a query's words up to each place of any; covers end where the first of these moves on
LEXTOP = LEX + """, occ AS (SELECT item_id, doc_id, p, term, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY p) AS i FROM (SELECT item_id, doc_id, t, unnest(w) AS term, unnest(range(len(w))) AS p FROM hit JOIN q USING (item_id) JOIN d USING (doc_id)) x WHERE list_contains(t, term)),
grid AS (SELECT item_id, doc_id, p, i, max(CASE WHEN term = other THEN i END) OVER (PARTITION BY item_id, doc_id, other ORDER BY i) AS latest FROM occ JOIN (SELECT item_id, unnest(t) AS other FROM q) u USING (item_id)),
low AS (SELECT item_id, doc_id, p, i, min(latest) AS l FROM grid GROUP BY 1, 2, 3, 4 HAVING count(latest) = count(*)),
cov AS (SELECT * FROM low QUALIFY l > coalesce(lag(l) OVER (PARTITION BY item_id, doc_id ORDER BY i), 0)),
sc AS (SELECT c.item_id, c.doc_id, round(sum(0.1::DOUBLE / (1 + (c.p - o.p) - (c.i - o.i))), 9) AS score, count(*) AS covers FROM cov c JOIN occ o ON o.item_id = c.item_id AND o.doc_id = c.doc_id AND o.i = c.l GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC)::INTEGER AS rank FROM hit JOIN sc USING (item_id, doc_id))"""


def lexical_ranked(spark, sf_dir, n):
    found = L.search(V.texts(spark, sf_dir, "documents"), T(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", best=n)
    return S.ranked(found, ["item_id"], [F.desc("score"), F.desc("doc_id")], n)


@query(LEXTOP + " SELECT item_id, doc_id, score, covers, tf, length, rank FROM top WHERE rank <= 10")
def lexical_topk(spark, sf_dir):
    """Each item's ten best documents by cover density."""
    return lexical_ranked(spark, sf_dir, 10)


@query()
def search_headlines(spark, sf_dir):
    """Excerpts of each item's three best documents; SQL has no fold over covers, tests hold them against a plain scan."""
    items = T(spark, sf_dir, "benchmark").select("item_id", S.query_terms(F.col("text")).alias("terms"))
    best = lexical_ranked(spark, sf_dir, 3).join(T(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(items, "item_id")
    return L.headlines(best, "text", "terms").select("item_id", "doc_id", "rank", "headline")


@query(f"SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences, min(p)::INTEGER AS earliest FROM (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS p FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents) y) x GROUP BY 1")
def inverted_file(spark, sf_dir):
    """The lexicon of an inverted file of all documents: how many hold a word, how often, and its earliest place."""
    found = L.postings(V.texts(spark, sf_dir, "documents"), "doc_id", "text")
    return found.groupBy("term").agg(F.count("*").alias("documents"), F.sum(F.size("positions")).alias("occurrences"), F.min(F.get("positions", F.lit(0))).alias("earliest"))


VECTORS = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
PAIRS = "(SELECT query_id, vec_id, list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe))) AS s FROM v, q WHERE vec_id <> query_id{}) x"
TOP = "SELECT query_id, vec_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 13) DESC, vec_id)::INTEGER AS rank FROM "
NN = f"WITH {VECTORS}, q AS (SELECT vec_id AS query_id, e AS qe, label AS ql FROM v WHERE vec_id % 100 = 0), top AS ({TOP}{PAIRS.format('')})"


def nearest(spark, sf_dir, k=10, cell=None):
    """Every vector whose id is divisible by 100, against all vectors or those of its cell."""
    e = T(spark, sf_dir, "embeddings")
    return S.exact_neighbours(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding", k, cell=cell).withColumn("score", F.round("score", 6))


@query(NN + " SELECT query_id, vec_id, score, rank FROM top WHERE rank <= 10")
def semantic_topk(spark, sf_dir):
    return nearest(spark, sf_dir)


@query(f"{LEXTOP}, {VECTORS}, vq AS (SELECT item_id AS query_id, e AS qe FROM benchmark JOIN v ON vec_id = item_id), near AS ({TOP}{PAIRS.format('').replace('v, q', 'v, vq')})" + """,
u AS (SELECT item_id, doc_id, rank FROM top WHERE rank <= 100 UNION ALL SELECT query_id, vec_id, rank FROM near WHERE rank <= 100)
SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS lists FROM u GROUP BY 1, 2""")
def hybrid_rrf(spark, sf_dir):
    """Words of a benchmark item and the vector under its id, each against all documents."""
    e = T(spark, sf_dir, "embeddings")
    asked = e.join(T(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    near = S.exact_neighbours(e, asked, "vec_id", "embedding", 100).select(F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), "rank")
    return S.fuse([lexical_ranked(spark, sf_dir, 100), near], ["item_id"], "doc_id")


@query(NN + f", part AS ({TOP}{PAIRS.format(' AND v.label = ql')})" + " SELECT round(avg(hit), 6) AS recall, count(*) AS queries, avg(hit) >= 0.95 AS publishable FROM (SELECT query_id, (SELECT count(*) FROM top JOIN part USING (query_id, vec_id) WHERE top.query_id = q.query_id AND top.rank <= 10 AND part.rank <= 10) / 10.0::DOUBLE AS hit FROM q)")
def label_cell_recall(spark, sf_dir):
    """How many of the ten nearest lie in the query's own label: as cells of an index, labels must not pass the gate."""
    found = nearest(spark, sf_dir).join(nearest(spark, sf_dir, cell="label").select("query_id", "vec_id"), ["query_id", "vec_id"]).groupBy("query_id").agg((F.count("*") / 10.0).alias("hit"))
    every = T(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"))
    return every.join(found, "query_id", "left").na.fill(0.0).agg(F.round(F.avg("hit"), 6).alias("recall"), F.count("*").alias("queries"), (F.avg("hit") >= 0.95).alias("publishable"))


def vector_index(spark, sf_dir):
    return vectorindex.build(T(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query()
def index_topk(spark, sf_dir):
    """Every vector whose id is divisible by 100 against the index of all vectors."""
    return vector_index(spark, sf_dir).search(T(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0"), 10).withColumn("score", F.round("score", 6))


@query()
def recall_at_10(spark, sf_dir):
    """How many of the ten nearest the index finds, over every vector whose id is divisible by 100, and what its gate says."""
    index = vector_index(spark, sf_dir)
    asked = T(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0")
    found = nearest(spark, sf_dir).join(index.search(asked, 10).select("query_id", "vec_id"), ["query_id", "vec_id"]).groupBy("query_id").agg((F.count("*") / 10.0).alias("hit"))
    every = asked.select(F.col("vec_id").alias("query_id"))
    return every.join(found, "query_id", "left").na.fill(0.0).agg(F.round(F.avg("hit"), 6).alias("recall"), F.count("*").alias("queries")).withColumns({"probes": F.lit(index.probes), "cells": F.lit(len(index.centroids)), "publishable": F.lit(index.recall >= index.gate)})


@query("SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS o, greatest(1, ceil(count(*) OVER () / 100.0))::BIGINT AS stride FROM embeddings) x WHERE o % stride = 0")
def map_sample(spark, sf_dir):
    return stats.stride_sample(T(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", 100)


@query("SELECT label, count(*) AS total, round(min(embedding[1]::DOUBLE), 6) AS min_x, round(max(embedding[1]::DOUBLE), 6) AS max_x, round(min(embedding[2]::DOUBLE), 6) AS min_y, round(max(embedding[2]::DOUBLE), 6) AS max_y FROM embeddings GROUP BY 1")
def map_bounds(spark, sf_dir):
    x, y = (F.get("embedding", F.lit(k)).cast("double") for k in (0, 1))
    return T(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("total"), F.round(F.min(x), 6).alias("min_x"), F.round(F.max(x), 6).alias("max_x"), F.round(F.min(y), 6).alias("min_y"), F.round(F.max(y), 6).alias("max_y"))


STOP = ["the", "and", "que", "les", "der", "die", "und", "des"]


@query(f"""WITH w AS (SELECT source, doc_id, unnest(list_distinct({WORDS.format('text')})) AS word FROM documents), f AS (SELECT * FROM w WHERE length(word) > 2 AND word NOT IN ({', '.join(repr(s) for s in STOP)})),
df AS (SELECT word, count(*) AS df FROM f GROUP BY 1), dc AS (SELECT source, word, count(*) AS dfc FROM f GROUP BY 1, 2), sz AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
s AS (SELECT source, word, round(dfc::DOUBLE / n * ln(1 + (SELECT count(*) FROM documents)::DOUBLE / df), 6) AS score FROM dc JOIN df USING (word) JOIN sz USING (source)), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, word DESC)::INTEGER AS rank FROM s) SELECT * FROM r WHERE rank <= 8""")
def cluster_keywords(spark, sf_dir):
    return S.cluster_keywords(V.texts(spark, sf_dir, "documents"), "source", "doc_id", "text", STOP, 8)


@query("WITH c AS (SELECT CASE WHEN source LIKE '%1' THEN NULL ELSE source END AS cluster, doc_id, text FROM documents)" + f""", w AS (SELECT cluster, doc_id, unnest(list_distinct({WORDS.format('text')})) AS word FROM c), f AS (SELECT * FROM w WHERE length(word) > 2 AND word NOT IN ({', '.join(repr(s) for s in STOP)})),
df AS (SELECT word, count(*) AS df FROM f GROUP BY 1), dc AS (SELECT cluster, word, count(*) AS dfc FROM f GROUP BY 1, 2), sz AS (SELECT cluster, count(*) AS n FROM c GROUP BY 1),
s AS (SELECT dc.cluster, word, round(dfc::DOUBLE / n * ln(1 + (SELECT count(*) FROM c)::DOUBLE / df), 6) AS score, n FROM dc JOIN df USING (word) JOIN sz ON sz.cluster IS NOT DISTINCT FROM dc.cluster), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, word DESC) AS rank FROM s)
SELECT coalesce(cluster, '') AS cluster, CASE WHEN cluster IS NULL THEN 'Unclustered' ELSE string_agg(word, ' / ' ORDER BY rank) END AS label, any_value(n) AS size FROM r WHERE rank <= 3 GROUP BY cluster""")
def cluster_labels(spark, sf_dir):
    d = V.texts(spark, sf_dir, "documents").withColumn("cluster", F.when(~F.col("source").like("%1"), F.col("source")))
    return S.cluster_labels(d, "cluster", "doc_id", "text", STOP)


@query("SELECT doc_id, k::INTEGER AS chunk_no, substr(text, k * 1000 + 1, 1000) AS chunk FROM (SELECT doc_id, text, unnest(range(ceil(length(text) / 1000.0)::BIGINT)) AS k FROM documents WHERE length(text) > 0) x".replace("k * 1000 + 1", "(k * 1000 + 1)::BIGINT"))
def chunk_text(spark, sf_dir):
    return S.chunks(T(spark, sf_dir, "documents").select("doc_id", "text"), "text", 1000).select("doc_id", "chunk_no", "chunk")


@query("""WITH RECURSIVE u AS (SELECT conv_id AS session_id, turn AS ordinal, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
st(session_id, rn, f, o, n, total, w) AS (SELECT session_id, rn, ordinal, ordinal, n, n, 0 FROM u WHERE rn = 1 UNION ALL SELECT u.session_id, u.rn, CASE WHEN st.total + u.n <= 1500 THEN st.f WHEN st.n + u.n <= 1500 THEN st.o ELSE u.ordinal END, u.ordinal, u.n,
 CASE WHEN st.total + u.n <= 1500 THEN st.total + u.n WHEN st.n + u.n <= 1500 THEN st.n + u.n ELSE u.n END, CASE WHEN st.total + u.n <= 1500 THEN st.w ELSE st.w + 1 END FROM st JOIN u ON u.session_id = st.session_id AND u.rn = st.rn + 1)
SELECT session_id, w::INTEGER AS window_no, min(f) AS first, max(o) AS last, max(total)::BIGINT AS characters FROM st GROUP BY session_id, w""")
def rolling_windows(spark, sf_dir):
    return S.rolling_windows(V.units(spark, sf_dir), "session_id", "ordinal", "text", 1500, 1)


@query("SELECT lang, source, text_hash, arg_max(doc_id, n_chars * 1000000000 + doc_id) AS representative, min(doc_id) AS rank, count(*) - 1 AS collapsed FROM (SELECT *, md5(text) AS text_hash FROM documents) x GROUP BY 1, 2, 3")
def recall_dedupe(spark, sf_dir):
    d = T(spark, sf_dir, "documents").select("lang", "source", F.md5("text").alias("text_hash"), F.col("doc_id").alias("event_id"), F.col("n_chars").alias("us"), F.col("doc_id").alias("rank"))
    return S.recall_groups(d, ["lang", "source", "text_hash"])


@query("""WITH g AS (SELECT lang, source, text_hash, max(doc_id) AS newest, min(doc_id) AS rank FROM (SELECT *, md5(text) AS text_hash FROM documents) x GROUP BY 1, 2, 3), a AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY rank)::INTEGER AS anchor FROM g)
SELECT lang, source, newest, anchor FROM a WHERE anchor <= 3""")
def recall_group(spark, sf_dir):
    d = T(spark, sf_dir, "documents").groupBy("lang", "source", F.md5("text").alias("h")).agg(F.max("doc_id").alias("newest"), F.min("doc_id").alias("rank"))
    return dedup.top_by(d, ["lang", "source"], ["rank"], 3, "anchor").select("lang", "source", "newest", "anchor")


@query("""WITH p AS (SELECT conv_id, turn, role, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST)) AS n FROM conversations), a AS (SELECT conv_id, n AS anchor_position FROM p WHERE turn = 3)
SELECT p.conv_id AS session_id, turn AS ordinal, role, anchor_position::INTEGER AS anchor_position, (n - anchor_position)::INTEGER AS distance FROM p JOIN a USING (conv_id) WHERE abs(n - anchor_position) <= 2""")
def neighborhood(spark, sf_dir):
    u = V.units(spark, sf_dir)
    return S.neighbourhood(u, u.filter("ordinal = 3"), "session_id", ["ordinal"], ["session_id", "ordinal"], 2).select("session_id", "ordinal", "role", "anchor_position", "distance")


@query("SELECT conv_id AS session_id, turn AS ordinal, role, n::INTEGER AS position FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations) x WHERE n <= 2 OR n > c - 2")
def head_tail_evidence(spark, sf_dir):
    return S.head_tail(V.units(spark, sf_dir), "session_id", ["ordinal"], 2, 2).select("session_id", "ordinal", "role", "position")


@query("SELECT * FROM (SELECT conv_id AS session_id, turn AS ordinal, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS used FROM conversations) x WHERE used <= 2000")
def char_budget(spark, sf_dir):
    return S.within_budget(V.units(spark, sf_dir), "session_id", ["ordinal"], "text", 2000).select("session_id", "ordinal", "used")


def rules(spark):
    """Literal prefix rules with dates; the longest prefix in force wins."""
    rows = [("src", 0, 10**9, "all"), *((f"src/src{k}", 0, 500, f"p{k}") for k in range(20)), *((f"src/src{k}/en", 0, 300 + 50 * k, f"p{k}-en") for k in range(10))]
    return spark.createDataFrame(rows, "prefix string, from_us long, to_us long, project string")


RULES = "rule AS (SELECT 'src' AS prefix, 0 AS lo, 1000000000 AS hi, 'all' AS project UNION ALL SELECT 'src/src' || k, 0, 500, 'p' || k FROM range(20) r(k) UNION ALL SELECT 'src/src' || k || '/en', 0, 300 + 50 * k, 'p' || k || '-en' FROM range(10) r(k))"


@query("WITH " + RULES + ", d AS (SELECT doc_id, 'src/' || source || '/' || lang AS path FROM documents) SELECT doc_id, path, project FROM d LEFT JOIN LATERAL (SELECT project FROM rule WHERE (d.path = prefix OR starts_with(d.path, prefix || '/')) AND lo <= doc_id AND doc_id < hi ORDER BY length(prefix) DESC LIMIT 1) x ON true")
def alias_most_specific(spark, sf_dir):
    d = T(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("src/"), "source", F.lit("/"), "lang").alias("path"))
    return R.most_specific(d, rules(spark), "path", "doc_id", "project")


@query("SELECT c_custkey, n_name, r_name, c_acctbal < 0 AS ambiguous FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def star_join(spark, sf_dir):
    n, r = T(spark, sf_dir, "nation"), T(spark, sf_dir, "region")
    dims = n.join(F.broadcast(r), F.col("r_regionkey") == F.col("n_regionkey"), "left")  # nations and regions are fixed tables
    return T(spark, sf_dir, "customer").join(F.broadcast(dims), F.col("n_nationkey") == F.col("c_nationkey"), "left").select("c_custkey", "n_name", "r_name", (F.col("c_acctbal") < 0).alias("ambiguous"))


@query("SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def project_list(spark, sf_dir):
    c = T(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.countDistinct("c_custkey").alias("customers"))
    s = T(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.countDistinct("s_suppkey").alias("suppliers"))
    out = T(spark, sf_dir, "nation").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").na.fill(0, ["customers", "suppliers"])
    return out.groupBy("n_name").agg(F.sum("customers").alias("customers"), F.sum("suppliers").alias("suppliers"))


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def semi_exists(spark, sf_dir):
    return T(spark, sf_dir, "documents").select("doc_id", "source").join(T(spark, sf_dir, "labels").filter("quality = 1"), "doc_id", "left_semi")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_unresolved(spark, sf_dir):
    return R.unresolved(T(spark, sf_dir, "documents").select("doc_id", "source"), T(spark, sf_dir, "labels"), "doc_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphan_prune(spark, sf_dir):
    orders = T(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return T(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@query("SELECT d.source, count(l.doc_id) AS uses FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN (SELECT doc_id, source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) l USING (source) GROUP BY 1")
def label_coverage(spark, sf_dir):
    docs = T(spark, sf_dir, "documents")
    return stats.left_counts(docs.select("source").distinct(), docs.join(T(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id"), "source")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars > 3000 AND doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY n_chars DESC, doc_id LIMIT 50")
def review_queue(spark, sf_dir):
    fresh = T(spark, sf_dir, "documents").filter("n_chars > 3000").join(T(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return fresh.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)


@query("SELECT conv_id AS session_id, arg_max(left(text, 80), turn) AS preview, max(turn) AS ordinal FROM conversations WHERE role = 'user' GROUP BY 1")
def latest_preview(spark, sf_dir):
    return V.units(spark, sf_dir).filter("role = 'user'").groupBy("session_id").agg(F.max_by(F.substring("text", 1, 80), "ordinal").alias("preview"), F.max("ordinal").alias("ordinal"))


@query("SELECT page_id, url FROM pages WHERE url ILIKE '%BLOG%' OR url ILIKE '%.html'")
def ilike_filter(spark, sf_dir):
    return T(spark, sf_dir, "pages").filter(F.col("url").ilike("%BLOG%") | F.col("url").ilike("%.html")).select("page_id", "url")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE (o_orderpriority IS DISTINCT FROM '5-LOW') AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderstatus IN ('F', 'O')")
def policy_filter(spark, sf_dir):
    o = T(spark, sf_dir, "orders")
    return o.filter(~F.col("o_orderpriority").eqNullSafe("5-LOW") & (F.col("o_orderdate") >= "1996-01-01") & (F.col("o_orderdate") < "1997-01-01") & F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", "o_orderpriority")


SPACE = r"[ \t\n\x0b\f\r]"


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url || ' at 0xDEADbeef 1234567 2024-01-01T10:00:00Z'), '0x[0-9a-fA-F]+', '<address>', 'g'), '\b\d{4}-\d{2}-\d{2}[T ][0-9:.+-Z]+\b', '<timestamp>', 'g'), '\b\d{5,}\b', '<number>', 'g'), '\s+', ' ', 'g') AS signature FROM pages")
def error_signature_normalize(spark, sf_dir):
    return T(spark, sf_dir, "pages").select("page_id", X.normalize_error(F.concat("url", F.lit(" at 0xDEADbeef 1234567 2024-01-01T10:00:00Z"))).alias("signature"))


#: Lines of logs as an event's kind and number give them, in three cases of letters.
LINES = """lines AS (SELECT event_id, CASE k % 3 WHEN 0 THEN line WHEN 1 THEN upper(line) ELSE lower(line) END AS line FROM (SELECT event_id, k, CASE k % 16 WHEN 0 THEN 'Failed' WHEN 1 THEN 'FAILED tests: ' || k WHEN 2 THEN 'ValueError: bad ' || event_type WHEN 3 THEN 'tests failed: ' || k WHEN 4 THEN 'the ' || event_type || ' was not failed'
  WHEN 5 THEN 'process exited with code ' || (k % 7) WHEN 6 THEN '# error: ' || event_type WHEN 7 THEN 'npm ERR! code ' || k WHEN 8 THEN 'lint: error[E' || k || ']: x' WHEN 9 THEN 'error: ' || event_type || ' => ' || k WHEN 10 THEN 'exception: you may see ' || event_type WHEN 11 THEN 'except ValueError: ' || k
  WHEN 12 THEN 'fatal: ' || event_type WHEN 13 THEN 'Traceback (most recent call last):' WHEN 14 THEN 'prose about errors and ' || event_type ELSE 'error: ' || event_type || ',' END AS line FROM (SELECT event_id, event_type, {} AS k FROM events) y) x)"""
ACTIONABLE_SQL = " OR ".join(f"regexp_matches(t, '{p}')" for p in (
    r"(?i)^traceback \(most recent call last\):", r"(?i)^(?:fatal|panic|segmentation fault)\b", r"(?i)^(?:failed|failure)\b(?:\s|:)", r"(?i)^(?:npm\s+err!|error\b|exception\b)(?:\s|:)", r"^[A-Za-z_][\w.]*?(?:Error|Exception):(?:\s|$)", r"(?i)^(?:assertionerror|keyboardinterrupt)(?::|$)",
    r"(?i)^.+?\s+failed:(?:\s|$)", r"(?i)\b(?:command|process) (?:exited|failed)(?: with)? (?:code|status) [1-9]\d*\b", r"(?i)(?:^|:\s)error(?:\[[^\]]+\])?(?:\s+[A-Z]+\d+)?\s*:", r"(?i)^failed(?:\s|$)",
))


def log_lines(spark, sf_dir):
    T(spark, sf_dir, "events").createOrReplaceTempView("palimpsest_events")
    return spark.sql("WITH " + LINES.format("cast(get_json_object(props, '$.k') AS BIGINT)").replace("FROM events)", "FROM palimpsest_events)") + " SELECT event_id, line FROM lines")


@query("WITH " + LINES.format("(props->>'k')::BIGINT") + f""", a AS (SELECT event_id, t, lower(t) AS l, NOT regexp_matches(lower(t), '^(except |raise |catch |//|# )') AND ({ACTIONABLE_SQL}) AS actionable FROM (SELECT event_id, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS t FROM lines) x)
SELECT event_id, actionable, actionable AND NOT (l IN ('traceback (most recent call last):', 'error:', 'error: null,', 'failed', 'failure') OR (starts_with(l, 'exception:') AND regexp_matches(l, 'you may |if working |the exception is '))
 OR regexp_matches(l, ' not failed| no error| not an error') OR regexp_matches(t, '^[a-z][A-Za-z0-9_]*Error:') OR (starts_with(l, 'error:') AND (regexp_matches(t, '[,;]$') OR regexp_matches(l, ' instanceof | \\?\\? |=>|string \\| null')))) AS reportable FROM a""")
def error_classify(spark, sf_dir):
    line = F.col("line")
    return log_lines(spark, sf_dir).select("event_id", X.is_actionable(line).alias("actionable"), X.is_reportable(line).alias("reportable"))


@query("WITH " + LINES.format("(props->>'k')::BIGINT") + " SELECT event_id, (regexp_matches(line, '(?i)^(fatal|panic|failed|failure|error|exception|traceback|assertionerror)(:|\\s|$)') OR regexp_matches(line, '(?i)(command|process).*(exited|failed).*(code|status) [1-9][0-9]*'))::INTEGER AS flag FROM lines")
def error_flag(spark, sf_dir):
    return log_lines(spark, sf_dir).select("event_id", X.error_flag(F.col("line")).alias("flag"))


#: Tool calls as an event's number gives them: a tool's name and its value.
CALLS = """calls AS (SELECT event_id, CASE k % 9 WHEN 0 THEN 'exec_command' WHEN 1 THEN 'Bash' WHEN 2 THEN 'shell' WHEN 3 THEN 'WebSearch' WHEN 4 THEN 'apply-patch' WHEN 5 THEN 'code_search' WHEN 6 THEN 'My_Browser' WHEN 7 THEN 'file_read' ELSE 'tool_' || event_type END AS tool,
  CASE k % 12 WHEN 0 THEN 'uv run pytest -q ' || k WHEN 1 THEN 'psql -c ' || k WHEN 2 THEN 'FOO=1 sudo rg ' || event_type WHEN 3 THEN 'cd a; git commit -m ' || k WHEN 4 THEN 'ls -la' WHEN 5 THEN '/usr/bin/Make all' WHEN 6 THEN 'ruff check .' WHEN 7 THEN 'docker ps' WHEN 8 THEN 'curl http://' || event_type WHEN 9 THEN 'env A=b python3 x.py' WHEN 10 THEN 'cat ' || k || ' | wc' ELSE event_type END AS command FROM (SELECT event_id, event_type, {} AS k FROM events) y)"""


@query("WITH " + CALLS.format("(props->>'k')::BIGINT") + r""", n AS (SELECT event_id, replace(lower(trim(tool)), '-', '_') AS t, regexp_replace(command, '^(?:[A-Za-z_][A-Za-z0-9_]*=[^ ]+\s+|sudo\s+|env\s+)+', '') AS c FROM calls),
s AS (SELECT *, lower(c) AS l, lower(regexp_extract(regexp_extract(c, '^\s*(\S+)', 1), '([^/]+)/*$', 1)) AS w FROM n),
o AS (SELECT event_id, t, CASE WHEN regexp_matches(l, '\b(?:pytest|vitest|jest|bun test|npm test|cargo test|go test)\b') THEN 'test test:' || regexp_extract(l, 'pytest|vitest|jest|bun|npm|cargo|go')
 WHEN regexp_matches(l, '\b(?:ruff|mypy|pyright|tsc|eslint|prettier)\b') THEN 'validate validate:' || regexp_extract(l, 'ruff|mypy|pyright|tsc|eslint|prettier')
 WHEN regexp_matches(l, '(?:^|[;&|]\s*)(rg|grep|find|fd)\b') THEN 'search search:' || regexp_extract(l, '(?:^|[;&|]\s*)(rg|grep|find|fd)\b', 1)
 WHEN regexp_matches(l, '(?:^|[;&|]\s*)(sed|head|tail|cat|ls|wc)\b') THEN 'inspect inspect:' || regexp_extract(l, '(?:^|[;&|]\s*)(sed|head|tail|cat|ls|wc)\b', 1)
 WHEN regexp_matches(l, '\b(psql|sqlite3|mysql|duckdb)\b') THEN 'database database:' || regexp_extract(l, '\b(psql|sqlite3|mysql|duckdb)\b', 1)
 WHEN regexp_matches(l, '\bgit\s+([a-z-]+)') THEN 'version-control git:' || regexp_extract(l, '\bgit\s+([a-z-]+)', 1)
 WHEN regexp_matches(l, '\b(systemctl|docker|kubectl|tmux|tailscale)\b') THEN 'operate operate:' || regexp_extract(l, '\b(systemctl|docker|kubectl|tmux|tailscale)\b', 1)
 WHEN regexp_matches(l, '\b(curl|wget)\b') THEN 'research network:' || regexp_extract(l, '\b(curl|wget)\b', 1)
 WHEN regexp_matches(l, '\b(python3?|uv|node|bun|deno|cargo|go)\b') THEN 'execute execute:' || regexp_extract(l, '\b(python3?|uv|node|bun|deno|cargo|go)\b', 1) ELSE 'execute execute:' || left(w, 40) END AS sh FROM s),
r AS (SELECT event_id, CASE WHEN t IN ('exec_command', 'bash', 'shell') THEN sh WHEN t = 'websearch' THEN 'research research:web-search' WHEN t = 'apply_patch' THEN 'edit edit:patch' WHEN contains(t, 'search') THEN 'search search:' || t WHEN contains(t, 'read') THEN 'inspect inspect:' || t WHEN contains(t, 'browser') THEN 'research research:' || t ELSE 'other tool:' || t END AS x FROM o)
SELECT event_id, split_part(x, ' ', 1) AS action, split_part(x, ' ', 2) AS operation FROM r""")
def normalize_call(spark, sf_dir):
    T(spark, sf_dir, "events").createOrReplaceTempView("palimpsest_events")
    d = spark.sql("WITH " + CALLS.format("cast(get_json_object(props, '$.k') AS BIGINT)").replace("FROM events)", "FROM palimpsest_events)") + " SELECT * FROM calls")
    value = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("command").alias("cmd")))).otherwise(F.col("command"))
    return d.select("event_id", X.normalize_call(F.col("tool"), value).alias("n")).select("event_id", "n.action", "n.operation")


@query(r"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS h, regexp_extract(url, '://[^/?#]+/+([^/?#]+)', 1) AS o, regexp_replace(regexp_extract(url, '://[^/?#]+/+[^/?#]+/+([^/?#]+)', 1), '\.git$', '') AS r FROM pages)
SELECT page_id, CASE WHEN h <> '' AND o <> '' AND r <> '' THEN 'https://' || h || '/' || lower(o) || '/' || lower(r) END AS url FROM u""")
def git_remote_parts(spark, sf_dir):
    """Each page's address as a remote: with a scheme, as a bare host, or in the form user@host:path."""
    bare = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[^:]+://", "")
    scp = F.concat(F.lit("git@"), F.regexp_replace(F.regexp_replace(bare, "/+$", ""), "^([^/]+)/+", "$1:"), F.lit(".git"))
    remote = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, bare).otherwise(scp)
    return T(spark, sf_dir, "pages").select("page_id", X.git_remote(remote)["url"].alias("url"))


@query(r"SELECT page_id, CASE WHEN length(p) > 1 THEN regexp_replace(p, '/$', '') ELSE p END AS path FROM (SELECT page_id, regexp_replace(replace('\root\' || url, '\', '/'), '/+', '/', 'g') AS p FROM pages) x")
def path_normalize(spark, sf_dir):
    return T(spark, sf_dir, "pages").select("page_id", X.normalize_path(F.concat(F.lit("\\root\\"), "url")).alias("path"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN epoch_us(ts) // 1000000 * 1000000 WHEN 1 THEN epoch_us(ts) // 1000 * 1000 WHEN 5 THEN NULL ELSE epoch_us(ts) // 1000000 * 1000000 END AS us FROM events")
def timestamp_normalize(spark, sf_dir):
    """Each event's time written as seconds, milliseconds, ISO in UTC, ISO with an offset, naive ISO, or as no time."""
    us = V.micros("ts")
    second = F.timestamp_seconds(F.floor(us / 1_000_000))
    text = F.when(F.col("event_id") % 6 == 0, F.floor(us / 1_000_000).cast("string")).when(F.col("event_id") % 6 == 1, F.floor(us / 1000).cast("string"))
    text = text.when(F.col("event_id") % 6 == 2, F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 6 == 3, F.date_format(F.from_utc_timestamp(second, "+08:00"), "yyyy-MM-dd HH:mm:ss'+08:00'"))
    text = text.when(F.col("event_id") % 6 == 4, F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.col("event_type"))
    return T(spark, sf_dir, "events").select("event_id", X.normalize_timestamp(text).alias("us"))


@query()
def artifact_extract(spark, sf_dir):
    pages = V.texts(spark, sf_dir, "pages").select("page_id", F.explode(X.artifacts(F.concat("url", F.lit("\n"), "html"))).alias("a"))
    return pages.select("page_id", "a.kind", "a.value")


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN rtrim(left(text, 59)) || '…' ELSE text END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents) x")
def tidy_preview(spark, sf_dir):
    return T(spark, sf_dir, "documents").select("doc_id", X.bounded(X.tidy(F.col("text")), 60).alias("short"))


@query("SELECT doc_id, CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MiB', n / 1048576.0) ELSE printf('%.1f GiB', n / 1073741824.0) END AS size FROM (SELECT doc_id, strlen(text) AS n FROM documents) x")
def human_sizes(spark, sf_dir):
    d = T(spark, sf_dir, "documents").withColumn("n", F.octet_length("text"))
    return d.select("doc_id", X.human_bytes(F.col("n")).alias("size"))


@query("SELECT conv_id AS session_id, turn AS ordinal FROM conversations WHERE regexp_matches(text, '(?i)\\b(?:still (?:broken|failing|wrong|not)|again|not fixed|did not work|didn''t work|you (?:missed|ignored|forgot)|incorrect|wrong|not what i (?:asked|meant|wanted)|regress(?:ed|ion)?)\\b')")
def correction_turns(spark, sf_dir):
    return V.units(spark, sf_dir).filter(F.col("text").rlike(X.CORRECTION)).select("session_id", "ordinal")


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_probe(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return T(spark, sf_dir, "events").select("event_id", k.alias("k"))


@query("SELECT source, n_chars, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) x WHERE n <= 2")
def inventory_samples(spark, sf_dir):
    return dedup.top_by(T(spark, sf_dir, "documents"), ["source"], [F.desc("n_chars"), "doc_id"], 2).select("source", "n_chars", "doc_id")
