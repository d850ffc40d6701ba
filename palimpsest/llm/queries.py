"""The thin queries over the standard tables: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .conversations import conversation_trie
from .cotraining import quality_scores
from .descent import near_links
from .fingerprints import syncmer_fingerprints
from .html import extract_main_text
from .jaccard import ngram_jaccard_join
from .neighbours import cross_polytope_search
from .packing import pack_documents
from .repeats import recompression_dedup, suffix_array_dedup
from .sentencepieces import sentencepiece_encode
from .urls import filter_urls
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), size=5, threshold=(75, 100))


def op2_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmer_fingerprints(_table(spark, sf_dir, "documents"))


def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "quality_score", "quality_text", "quality_metadata", "keep")


def op4_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return cross_polytope_search(rows, rows.filter("vec_id % 50 = 0"), k=5)


def op5_shared_prefix_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), max_tokens=2048, max_segments=2048)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(_table(spark, sf_dir, "documents"), threshold=200)


def op8_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op9_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression_dedup(_table(spark, sf_dir, "documents"), window=35)


#: The rules of op10: verdict, host and path.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op10_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op11_smallest_member_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"), family=5, shared=9)


def op12_compensated_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    # null where the exact number is no long
    return whiten(_table(spark, sf_dir, "embeddings"), components=16).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_descent_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_links(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [v for k, v in globals().items() if k.startswith("op") and callable(v)]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}


_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_JACCARD_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 75 * (a.n + b.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id WHERE r.root < e.y)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(root) AS component_id FROM r GROUP BY 1) c ON c.id = d.doc_id"""

_REPEATS_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35) x),
rep AS (SELECT doc_id, p FROM win QUALIFY count(*) OVER (PARTITION BY h) > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM rep),
word AS (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT word.doc_id, string_agg(v, ' ' ORDER BY word.i) AS k, count(*) AS n FROM word ANTI JOIN cov ON cov.doc_id = word.doc_id AND cov.i = word.i GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""

# bytes are pairs of hex digits, positions count from 1
_BYTES_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, p, md5(substr(x, 2 * p - 1, 400)) AS h FROM (SELECT doc_id, x, unnest(range(1, len(x) // 2 - 198)) AS p FROM d WHERE len(x) >= 400) y),
rep AS (SELECT doc_id, p FROM win QUALIFY count(*) OVER (PARTITION BY h) > 1),
cut AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS fresh FROM rep),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM cut),
span AS (SELECT doc_id, min(p) AS s, max(p) + 199 AS e FROM run GROUP BY doc_id, k),
piece AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) + 1 AS a, s - 1 AS b FROM span UNION ALL SELECT d.doc_id, coalesce(max(e), 0) + 1, max(len(x)) // 2 FROM d LEFT JOIN span ON span.doc_id = d.doc_id GROUP BY 1),
kept AS (SELECT piece.doc_id, string_agg(substr(x, 2 * a - 1, 2 * (b - a + 1)), '' ORDER BY a) AS k FROM piece JOIN d ON d.doc_id = piece.doc_id WHERE b >= a GROUP BY 1),
n AS (SELECT doc_id, count(*) AS spans, sum(e - s + 1)::BIGINT AS gone FROM span GROUP BY 1)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""

# CRC-32 of the decimal digits, bit by bit; a node is the list of its turns' digests
_TRIE_SQL = """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, md5(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS e, strlen(coalesce(text, ''))::BIGINT AS b FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
  lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 9 AS h FROM (SELECT DISTINCT conv_id FROM t) q),
s AS (SELECT c.conv_id, 0 AS part, place, e, b FROM c JOIN t ON t.conv_id = base AND place <= h UNION ALL SELECT c.conv_id, 1, place, e, b FROM c JOIN t ON t.conv_id = c.conv_id AND place > h),
path AS (SELECT c.conv_id, coalesce(list(e ORDER BY part, place) FILTER (e IS NOT NULL), []) AS es, coalesce(list(b ORDER BY part, place) FILTER (e IS NOT NULL), []) AS bs FROM c LEFT JOIN s ON s.conv_id = c.conv_id GROUP BY 1),
occ AS (SELECT conv_id, d, es[:d] AS node, d = len(es) AS ends, coalesce(bs[d], 0) AS b FROM (SELECT *, unnest(range(len(es) + 1)) AS d FROM path) x),
node AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n, any_value(b) AS b, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends FROM occ GROUP BY 1, 2),
kid AS (SELECT node[:d - 1] AS node, d - 1 AS d, count(*) AS k FROM node WHERE d > 0 GROUP BY 1, 2),
full_node AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kid ON kid.node = node.node AND kid.d = node.d),
sub AS (SELECT node[:j] AS node, j AS d, sum((n - 1) * b)::BIGINT AS saved, count(*) FILTER (k = 0) AS leaves FROM (SELECT *, unnest(range(d + 1)) AS j FROM full_node) x GROUP BY 1, 2)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.k AS n_children, leaves AS n_leaves, saved AS saved_tokens, f.ends AS ends_sha256
FROM full_node f JOIN sub ON sub.node = f.node AND sub.d = f.d LEFT JOIN node p ON p.d = f.d - 1 AND p.node = f.node[:f.d - 1]"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that SQL can express on whole tables; the others are tested against brute force."""
    return {"op1_ngram_jaccard_join": _JACCARD_SQL, "op7_suffix_array_dedup": _BYTES_SQL, "op9_recompression_dedup": _REPEATS_SQL, "op11_smallest_member_trie": _TRIE_SQL}
