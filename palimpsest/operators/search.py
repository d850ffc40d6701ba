"""Lexical, vector and hybrid search, and compact recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.session import checkpoint

#: Most tokens of a query that count.
QUERY_TOKENS = 64


#: Distinct query terms up to which they are broadcast to the words of the corpus.
BROADCAST_TERMS = 200_000


def tokens(text: Column) -> Column:
    """Lower-cased words of letters, digits and underscores, in Unicode."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def query_terms(query: Column) -> Column:
    """Distinct words of a query's first QUERY_TOKENS tokens; a token is a run of word characters and ``@ . / : -``."""
    first = F.slice(F.regexp_extract_all(query, F.lit(r"[\p{L}\p{N}_@./:-]+"), F.lit(0)), 1, QUERY_TOKENS)
    return F.array_distinct(tokens(F.array_join(first, " ")))


def lexical(docs: DataFrame, queries: DataFrame, key: str, text: str, qkey: str, qtext: str) -> DataFrame:
    """Documents that hold every term of a query, with ``tf``: how often they hold them, and the text's ``length``.

    A text's words meet the queries' distinct terms before anything is counted, so
    only words that are asked for are shuffled; the terms are broadcast if a count
    finds them few.  A query's candidates are the documents that hold its rarest
    term, and only they meet its other terms.  A query without words matches nothing.
    """
    asked = queries.select(F.col(qkey), query_terms(F.col(qtext)).alias("_t"))
    terms = asked.select(qkey, F.explode("_t").alias("term"), F.size("_t").alias("_need"))
    wanted = terms.select("term").distinct()
    few = wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    words = docs.select(F.col(key), tokens(F.col(text)).alias("_w")).withColumn("length", F.size("_w"))
    words = words.select(key, "length", F.explode("_w").alias("term"))  # without the array itself, which each row would copy
    counts = words.join(F.broadcast(wanted) if few else wanted, "term", "left_semi").groupBy("term", key, "length").agg(F.count("*").alias("tf"))
    counts = checkpoint(counts)  # it is read three times
    held = counts.groupBy("term").agg(F.count("*").alias("_df"))
    rare = terms.join(held, "term", "left").groupBy(qkey, "_need").agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("n"), "term"))["term"].alias("term"))
    found = counts.join(rare, "term").select(qkey, key, "_need")
    hits = found.join(terms.select(qkey, "term"), qkey).join(counts, [key, "term"]).groupBy(qkey, key, "_need", "length").agg(F.count("*").alias("_got"), F.sum("tf").alias("tf"))
    return hits.filter("_got = _need").select(qkey, key, "tf", F.col("length").cast("long").alias("length"))


def ranked(rows: DataFrame, by: list[str], order: list[Column], limit: int, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= limit)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in doubles."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


#: Queries of a pair of blocks whose products with all of its rows are held at a time.
QUERY_STRIP = 64


def _matrix(vectors: pa.ChunkedArray, n: int) -> np.ndarray:
    """Lists of doubles of one length as rows of a matrix, without a copy if they lie in one piece."""
    return np.asarray(pc.list_flatten(vectors).combine_chunks()).reshape(n, -1)


def _nearest(k: int):
    """Rows (side 0) and queries (side 1) of one pair of blocks to each query's k best rows."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            ids, v = rows.column("id").to_numpy(), _matrix(rows.column("v"), rows.num_rows)
            asked, q = queries.column("id").to_numpy(), _matrix(queries.column("v"), queries.num_rows)
            norm, qnorm = np.sqrt((v * v).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            unit = (v / norm[:, None]).T
            for a in range(0, len(q), QUERY_STRIP):
                rough = (q[a : a + QUERY_STRIP] / qnorm[a : a + QUERY_STRIP, None]) @ unit
                for i, s in enumerate(rough, a):
                    s[ids == asked[i]] = -np.inf
                    top = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
                    near = np.nonzero((s >= top - 1e-9) & (s > -np.inf))[0]
                    exact = (v[near] * q[i]).sum(axis=1) / (norm[near] * qnorm[i])  # row by row, so that equal vectors tie
                    found += [(int(asked[i]), int(ids[near[j]]), float(exact[j])) for j in np.lexsort((ids[near], -exact))[:k]]
        return pa.table([pa.array([f[c] for f in found], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "other", "score"])

    return run


def usable_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is neither null, empty nor zero and holds only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0))


def exact_neighbours(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, *, cell: str | None = None, row_block: int = 50_000, query_block: int = 2_000) -> DataFrame:
    """k nearest rows of each query by cosine: (query_id, key, score, rank), ties by key; a query is no neighbour of itself.

    Rows and queries are dealt into blocks whose numbers follow from counts, and each
    pair of blocks is matrix products of bounded size, for ``QUERY_STRIP`` queries at a
    time; each query's best of the blocks are ranked at the end. Block sizes are for
    vectors of 64 components; longer ones are dealt into as many more blocks.  With ``cell``, only rows of the query's own cell
    are compared: an approximate search that reads one cell instead of all.
    Vectors that are null, zero or not finite take no part; only equal lengths are compared.
    """
    own = [(F.col(cell) if cell else F.lit(0)).alias("cell"), F.size(vector).alias("dim")]
    rows, queries = usable_vectors(rows, vector), usable_vectors(queries, vector)

    def many(block: int) -> Column:
        return F.ceil(F.count("*") * F.greatest(F.max(F.size(vector)) / 64, F.lit(1)) / block)

    size = rows.groupBy(*own).agg(many(row_block).alias("nr")).join(queries.groupBy(*own).agg(many(query_block).alias("nq")), ["cell", "dim"])

    def dealt(df: DataFrame, mine: str, other: str) -> DataFrame:
        flat = df.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), *own).join(size, ["cell", "dim"])
        return flat.withColumn(f"b{mine}", F.pmod(F.xxhash64("id"), F.col(mine))).withColumn(f"b{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).select("cell", "dim", "bnr", "bnq", "id", "v")

    keys = ["cell", "dim", "bnr", "bnq"]
    found = dealt(rows, "nr", "nq").groupBy(*keys).cogroup(dealt(queries, "nq", "nr").groupBy(*keys)).applyInArrow(_nearest(k), "query_id long, other long, score double")
    return ranked(found.withColumnRenamed("other", key), ["query_id"], [F.desc("score"), F.col(key)], k)


def fuse(lists: list[DataFrame], by: list[str], key: str, *, constant: int = 60, most: int = 100) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (by, key, rank), each cut to ``most``."""
    every = lists[0].select(*by, key, "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select(*by, key, "rank"))
    return every.filter(F.col("rank") <= most).groupBy(*by, key).agg(F.round(F.sum(F.lit(1.0) / (constant + F.col("rank"))), 9).alias("score"), F.count("*").alias("lists"))


def recall_groups(candidates: DataFrame, same: list[str], *, rank: str = "rank", recency: str = "us", key: str = "event_id") -> DataFrame:
    """Exact copies among candidates: (representative, rank, copies): the newest stands for all, at the best rank."""
    return candidates.groupBy(*same).agg(F.max_by(key, F.struct(F.col(recency), F.col(key))).alias("representative"), F.min(rank).alias("rank"), (F.count("*") - 1).alias("collapsed"))


def neighbourhood(rows: DataFrame, anchors: DataFrame, track: str, order: list[str], key: list[str], around: int) -> DataFrame:
    """Rows within ``around`` places of an anchor row of their track, with ``distance``."""
    w = Window.partitionBy(track).orderBy(*[F.asc_nulls_first(c) for c in order])
    placed = rows.withColumn("_at", F.row_number().over(w))
    spots = placed.join(anchors.select(*key), key).select(F.col(track).alias("_t"), F.col("_at").alias("_anchor"))
    spots = spots.withColumn("distance", F.explode(F.sequence(F.lit(-around), F.lit(around)))).select(F.col("_t").alias(track), (F.col("_anchor") + F.col("distance")).alias("_at"), F.col("_anchor").alias("anchor_position"), "distance")
    return placed.join(spots, [track, "_at"]).drop("_at")


def head_tail(rows: DataFrame, track: str, order: list[str], head: int, tail: int) -> DataFrame:
    """The first and last rows of each track, each row once."""
    up = F.row_number().over(Window.partitionBy(track).orderBy(*order))
    n = F.count("*").over(Window.partitionBy(track))
    return rows.withColumn("position", up).withColumn("_n", n).filter((F.col("position") <= head) | (F.col("position") > F.col("_n") - tail)).drop("_n")


def within_budget(rows: DataFrame, track: str, order: list[str], text: str, budget: int) -> DataFrame:
    """The prefix of each track whose characters fit the budget."""
    w = Window.partitionBy(track).orderBy(*order)
    return rows.withColumn("used", F.sum(F.length(text)).over(w)).filter(F.col("used") <= budget)


def cluster_keywords(docs: DataFrame, cluster: str, key: str, text: str, stop: list[str], top: int) -> DataFrame:
    """Words that mark a cluster: share of its documents times log1p(N / df), by (score, word) descending."""
    words = docs.select(cluster, key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("word")).filter((F.length("word") > 2) & ~F.col("word").isin(stop))
    dfc = words.groupBy(cluster, "word").agg(F.count("*").alias("_dfc"))
    dfc = dfc.withColumn("_df", F.sum("_dfc").over(Window.partitionBy("word")))  # as many rows as clusters for a word
    size = docs.groupBy(cluster).agg(F.count("*").alias("_size"))
    total = docs.agg(F.count("*").alias("_all"))
    scored = dfc.join(size, cluster).crossJoin(F.broadcast(total)).withColumn("score", F.round(F.col("_dfc") / F.col("_size") * F.log1p(F.col("_all") / F.col("_df")), 6))
    return ranked(scored.select(cluster, "word", "score"), [cluster], [F.desc("score"), F.desc("word")], top)


def cluster_labels(docs: DataFrame, cluster: str, key: str, text: str, stop: list[str], *, words: int = 3) -> DataFrame:
    """(cluster, label, size): a cluster's best words; documents without a cluster are 'Unclustered', under an empty name."""
    own = docs.withColumn(cluster, F.coalesce(F.col(cluster), F.lit("")))
    best = cluster_keywords(own, cluster, key, text, stop, words).groupBy(cluster).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), " / ").alias("label"))
    size = own.groupBy(cluster).agg(F.count("*").alias("size"))
    return best.join(size, cluster).withColumn("label", F.when(F.col(cluster) == "", "Unclustered").otherwise(F.col("label")))


def chunks(rows: DataFrame, text: str, size: int) -> DataFrame:
    """Texts cut into pieces of ``size`` characters: chunk_no from 0 and ``chunk``; an empty text has none."""
    n = F.ceil(F.length(text) / size).cast("int")
    return rows.filter(F.length(text) > 0).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("chunk", F.substring(F.col(text), F.col("chunk_no") * size + 1, F.lit(size)))


def rolling_windows(rows: DataFrame, track: str, order: str, text: str, budget: int, overlap: int) -> DataFrame:
    """Greedy windows of at most ``budget`` characters; the next window starts ``overlap`` rows before the last one's end.

    Returns (track, window_no, first, last, characters).  Tracks are dealt out and
    sorted, and each is read once with the state of one window, so that no track is
    held whole; a row longer than the budget is a window of its own.  Tracks and
    orders are whole numbers.
    """
    sized = rows.select(F.col(track).cast("long").alias("t"), F.col(order).cast("long").alias("o"), F.length(text).cast("long").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[tuple[int, int]] = []
        owner, number, out = None, 0, []

        def close() -> None:
            nonlocal number
            if now:
                out.append((owner, number, now[0][0], now[-1][0], sum(n for _, n in now)))
                number += 1

        def given() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            found = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["t", "window_no", "first", "last", "characters"])
            out.clear()
            return found

        for b in batches:
            for t, o, n in zip(b.column("t").to_pylist(), b.column("o").to_pylist(), b.column("n").to_pylist(), strict=True):
                n = n or 0
                if t != owner:
                    close()
                    now, owner, number = [], t, 0
                if now and sum(x for _, x in now) + n > budget:
                    close()
                    now = now[max(len(now) - overlap, 0) :] if overlap else []
                    if sum(x for _, x in now) + n > budget:
                        now = []
                now.append((o, n))
            yield given()
        close()
        yield given()

    dealt = sized.repartition("t").sortWithinPartitions("t", "o")
    out = dealt.mapInArrow(run, "t long, window_no int, first long, last long, characters long")
    return out.withColumnRenamed("t", track)


def recent(rows: DataFrame, time: str, span: int) -> DataFrame:
    """Rows of the last ``span`` units before the newest row."""
    newest = rows.agg(F.max(time).alias("_newest"))
    return rows.crossJoin(F.broadcast(newest)).filter(F.col(time) > F.col("_newest") - span).drop("_newest")


def headline(text: Column, terms: Column, *, before: int = 80, width: int = 320) -> Column:
    """An excerpt around the first of the terms, each of them within <mark> tags; the text's head if it holds none."""
    pattern = F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}_])("), F.array_join(terms, "|"), F.lit(r")(?![\p{L}\p{N}_])"))
    start = F.greatest(F.regexp_instr(text, pattern) - before, F.lit(1))
    return F.when(F.size(terms) > 0, F.regexp_replace(F.substring(text, start, F.lit(width)), pattern, F.lit("<mark>$1</mark>"))).otherwise(F.substring(text, 1, width))
