"""A positional inverted file, ranks by cover density, and excerpts.

The file holds one row for each word of a document with all of its places.  A query
reads the rows of its own words alone; its candidates are the documents of its rarest
word.  A *cover* is a shortest stretch of a document that holds every word of the
query: no shorter stretch within it does.  A document scores 0.1 / (1 + noise) for
each cover, noise being the words in it that the query does not have.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from palimpsest.operators.search import BROADCAST_TERMS, query_terms, tokens
from palimpsest.session import checkpoint

#: Parts of a stored file, by the hash of the word; a search reads those of its words.
BUCKETS = 256
WORD, GAP = r"[\p{L}\p{N}_]+", r"[\p{L}\p{N}_]+([^\p{L}\p{N}_]*)"


#: Words of the rows that a task works on at a time, a longer text being a piece of its own; pairs and places likewise.
PIECE, PAIRS, PLACES = 1 << 18, 1 << 16, 1 << 20
#: Hits that a task holds before it drops all but each query's best.
HELD = 1 << 20


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive stretches whose sizes add up to ``most`` or less; a larger one is alone."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        before = ends[a - 1] if a else 0
        b = max(int(np.searchsorted(ends, before + most, "right")), a + 1)
        yield a, b
        a = b


def _pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    n = pc.fill_null(pc.list_value_length(b.column("_w")), 0).to_numpy(zero_copy_only=False)
    for x, y in _runs(n, PIECE):
        yield b.slice(x, y - x)


def _words(lists: pa.ListArray) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Length of each row, all words, and each word's row and place."""
    n = pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int64()).to_numpy(zero_copy_only=False)
    flat = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(n)), n)
    return n, flat, row, (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)


def postings(docs: DataFrame, key: str, text: str, wanted: DataFrame | None = None) -> DataFrame:
    """The inverted file: (term, key, length, positions), places counted from 0; of ``wanted`` terms alone if they are given.

    A null text has no words.  A word's places in one document are one row, so a word
    of any frequency spreads over as many rows as there are documents with it; a
    search takes rows that repeat a document as one.  A document's rows are made from its own row, without a
    shuffle; wanted terms are looked up where the words are, if a count finds them few.
    """
    words = docs.select(F.col(key), tokens(F.col(text)).alias("_w"))
    looked = [r.term for r in wanted.limit(BROADCAST_TERMS + 1).collect()] if wanted is not None else []
    few = wanted is not None and len(looked) <= BROADCAST_TERMS
    terms = pa.array(looked, pa.string()) if few else None

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in _pieces(whole)):
            length, flat, row, pos = _words(b.column("_w"))
            code = flat.indices.to_numpy()
            if terms is not None:
                held = np.nonzero(pc.is_in(flat.dictionary, terms).to_numpy(zero_copy_only=False)[code])[0]
                code, row, pos = code[held], row[held], pos[held]
            order = np.lexsort((code, row))  # stable, so places stay ascending
            code, row, pos = code[order], row[order], pos[order]
            first = np.nonzero((np.diff(row, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))[0]
            own = pa.array(row[first])
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(pos)), pa.int32()), pa.array(pos))
            yield pa.RecordBatch.from_arrays([flat.dictionary.take(pa.array(code[first])), b.column(key).take(own), pa.array(length).take(own), places], names=["term", key, "length", "positions"])

    found = words.mapInArrow(placed, f"term string, {key} {dict(words.dtypes)[key]}, length long, positions array<int>")
    return found if wanted is None or few else found.join(wanted, "term", "left_semi")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_postings(found: DataFrame, key: str, path: str) -> None:
    """Store an inverted file in parts by word; rows are dealt by range, so a frequent word's part has many writers."""
    found.withColumn("bucket", _bucket(F.col("term"))).repartitionByRange("bucket", "term", key).sortWithinPartitions("bucket", "term", key).write.partitionBy("bucket").mode("overwrite").parquet(path)


def read_postings(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The rows of wanted terms of a stored file; parts without any of them are not read."""
    parts = wanted.select("term", _bucket(F.col("term")).alias("bucket"))
    few = parts.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    return spark.read.parquet(path).join(F.broadcast(parts) if few else parts, ["bucket", "term"], "left_semi").drop("bucket")


def asked_terms(queries: DataFrame, qkey: str, qtext: str) -> DataFrame:
    """(qkey, t, term, need): the distinct words of each query, numbered; a query without words has none."""
    asked = queries.select(F.col(qkey), query_terms(F.col(qtext)).alias("_t"))
    return asked.select(qkey, F.size("_t").alias("need"), F.posexplode("_t").alias("t", "term"))


def covers(pos: np.ndarray, term: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last entry and noise of each cover; entries are the places of a query's words in a document, ascending."""
    at = np.arange(len(pos))
    low = at.copy()
    for t in range(need):  # the latest entry of every word, and of these the first
        low = np.minimum(low, np.maximum.accumulate(np.where(term == t, at, -1)))
    ends = np.nonzero((low >= 0) & (low > np.concatenate(([-1], low[:-1]))))[0]
    starts = low[ends]
    return starts, ends, pos[ends] - pos[starts] - (ends - starts)


def hits(found: DataFrame, terms: DataFrame, key: str, qkey: str) -> DataFrame:
    """(qkey, key, score, covers, tf, length) of the documents that hold all words of a query.

    ``found`` is an inverted file with the terms' rows, ``terms`` is :func:`asked_terms`.
    Rows of one key and length are one document, with each place once.
    """
    found = checkpoint(found)  # it is read three times
    held = found.groupBy("term").agg(F.count("*").alias("_df"))
    rare = terms.join(held, "term", "left").groupBy(qkey, "need").agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("n"), "term"))["term"].alias("term"))
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS  # and there are no more queries than terms
    candidates = found.join(F.broadcast(rare) if few else rare, "term").select(qkey, key).repartition(key).distinct()
    own = candidates.join(found, key).join(F.broadcast(terms) if few else terms, [qkey, "term"])  # places move once, by document
    rows = own.groupBy(qkey, key, "need", "length").agg(F.size(F.collect_set("t")).alias("_got"), F.collect_list(F.struct("t", "positions")).alias("_p"))
    entry = F.array_sort(F.array_distinct(F.flatten(F.transform("_p", lambda x: F.transform(x["positions"], lambda p: F.struct(p.alias("pos"), x["t"].alias("t")))))))
    whole = rows.filter("_got = need").select(qkey, key, "need", "length", entry.alias("_e")).select(qkey, key, "need", "length", F.transform("_e", lambda e: e["pos"]).alias("pos"), F.transform("_e", lambda e: e["t"]).alias("t"))
    kinds = dict(whole.dtypes)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos, term = b.column("pos"), b.column("t")
            at, flat, words = np.asarray(pos.offsets), np.asarray(pos.flatten()), np.asarray(term.flatten())
            at = at - at[0]
            out = []
            for k, need in enumerate(b.column("need").to_pylist()):
                _, _, noise = covers(flat[at[k] : at[k + 1]], words[at[k] : at[k + 1]], need)
                out.append((float((0.1 / (1 + noise)).sum()), len(noise), int(at[k + 1] - at[k])))
            yield pa.RecordBatch.from_arrays([b.column(qkey), b.column(key), *(pa.array([r[c] for r in out], t) for c, t in enumerate((pa.float64(), pa.int64(), pa.int64()))), b.column("length")], names=[qkey, key, "score", "covers", "tf", "length"])

    return whole.mapInArrow(score, f"{qkey} {kinds[qkey]}, {key} {kinds[key]}, score double, covers long, tf long, length long").withColumn("score", F.round("score", 9))


def _rounded(x: np.ndarray) -> np.ndarray:
    """To nine decimals, halves away from zero, as Spark's round does."""
    values, at = np.unique(x, return_inverse=True)
    return np.array([float(Decimal(repr(v)).quantize(Decimal("1e-9"), ROUND_HALF_UP)) for v in values.tolist()])[at]


class _Asked:
    """Sets of words that queries ask for; each set is looked for from the word that fewest sets ask for."""

    def __init__(self, sets: list[list[str]]) -> None:
        often = Counter(w for s in sets for w in s)
        self.words = sorted(often)
        number = {w: k for k, w in enumerate(self.words)}
        ordered = [[number[w] for w in sorted(s, key=lambda w: (often[w], -len(w), w))] for s in sets]
        self.need = np.array([len(s) for s in sets], np.int64)
        self.at = np.cumsum(self.need) - self.need
        self.flat = np.array([w for s in ordered for w in s], np.int64)
        first = self.flat[self.at]
        self.by_first = np.argsort(first, kind="stable")
        self.firsts = np.searchsorted(first[self.by_first], np.arange(len(self.words) + 1))

    def hits(self, lists: pa.ListArray) -> Iterator[tuple[np.ndarray, ...]]:
        """(set, row, score, covers, tf) of the rows that hold all words of a set, in bounded pieces."""
        _, flat, row, pos = _words(lists)
        known = pc.fill_null(pc.index_in(flat.dictionary, pa.array(self.words, pa.string())), -1).to_numpy(zero_copy_only=False)
        code = known[flat.indices.to_numpy()] if len(row) else row
        held = np.nonzero(code >= 0)[0]
        place = row[held] * len(self.words) + code[held]
        order = np.argsort(place, kind="stable")
        pos = pos[held][order]
        keys, first, count = np.unique(place[order], return_index=True, return_counts=True)
        own, word = keys // len(self.words), keys % len(self.words)
        sets = self.firsts[word + 1] - self.firsts[word]
        for a, b in _runs(sets, PAIRS):
            n = sets[a:b]
            q = self.by_first[np.repeat(self.firsts[word[a:b]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            r = np.repeat(own[a:b], n)
            for slot in range(1, int(self.need[q].max(initial=0))):  # rarest words first, so few pairs meet the others
                more = np.nonzero(self.need[q] > slot)[0]
                asked = r[more] * len(self.words) + self.flat[self.at[q[more]] + slot]
                found = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                left = np.ones(len(q), bool)
                left[more[keys[found] != asked]] = False
                q, r = q[left], r[left]
            if len(q):
                need = self.need[q]
                pair = np.repeat(np.arange(len(q)), need)
                slot = np.arange(len(pair)) - np.repeat(np.cumsum(need) - need, need)
                at = np.searchsorted(keys, r[pair] * len(self.words) + self.flat[self.at[q[pair]] + slot])
                total = np.bincount(pair, count[at]).astype(np.int64)
                for x, y in _runs(total, PLACES):
                    own_slots = slice(*np.searchsorted(pair, [x, y]))
                    yield q[x:y], r[x:y], *self._scores(pair[own_slots] - x, slot[own_slots], first[at[own_slots]], count[at[own_slots]], need[x:y], pos), total[x:y]

    @staticmethod
    def _scores(pair: np.ndarray, slot: np.ndarray, first: np.ndarray, count: np.ndarray, need: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and covers of pairs whose words' places are ``count`` entries of ``pos`` from ``first`` on; see :func:`covers`."""
        own, term = np.repeat(pair, count), np.repeat(slot, count)
        pos = pos[np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(own))]
        order = np.lexsort((pos, own))
        own, term, pos = own[order], term[order], pos[order]
        at = np.arange(len(own))
        begin = np.searchsorted(own, np.arange(len(need)))[own]
        low = at.copy()
        for t in range(int(need.max())):
            latest = np.maximum.accumulate(np.where(term == t, at, -1))
            low = np.where(need[own] > t, np.minimum(low, np.where(latest < begin, -1, latest)), low)
        ends = np.nonzero((low >= 0) & (low > np.concatenate(([-1], low[:-1]))))[0]
        starts = low[ends]
        noise = pos[ends] - pos[starts] - (ends - starts)
        return np.bincount(own[ends], 0.1 / (1 + noise), len(need)), np.bincount(own[ends], minlength=len(need))


def search(docs: DataFrame, queries: DataFrame, key: str, text: str, qkey: str, qtext: str, *, best: int | None = None, latest: str | None = None) -> DataFrame:
    """:func:`hits` of texts that have no stored inverted file: a text's places meet the queries' words where they are.

    No place is shuffled, queries of the same words are looked for once. With ``best`` only
    hits are surely returned that are among so many of a query by score, ``latest`` (a whole
    number, the greatest first, null last) and key, the greatest first; a task holds no more of them.
    Queries of more than ``BROADCAST_TERMS`` words in all go through the inverted file.
    """
    terms = asked_terms(queries, qkey, qtext)
    if terms.limit(BROADCAST_TERMS + 1).count() > BROADCAST_TERMS:
        return hits(postings(docs, key, text, terms.select("term").distinct()), terms, key, qkey)
    asking: dict[tuple[str, ...], list] = {}
    for q, t in queries.select(qkey, F.array_sort(query_terms(F.col(qtext)))).filter(F.size(query_terms(F.col(qtext))) > 0).distinct().collect():
        asking.setdefault(tuple(t), []).append(q)
    kinds = dict(docs.dtypes) | dict(queries.dtypes)
    schema = f"_set int, {key} {kinds[key]}, score double, covers long, tf long, length long"
    plan = _Asked([list(t) for t in asking])
    words = docs.select(F.col(key), (F.col(latest) if latest else F.lit(0)).cast("long").alias("_late"), tokens(F.col(text)).alias("_w"))

    def cut(held: pa.Table) -> pa.Table:
        number = np.unique(held.column(key).to_numpy(), return_inverse=True)[1]
        late = pc.fill_null(held.column("_late"), -(1 << 63)).to_numpy()
        known = held.column("_late").is_null().to_numpy()
        q, length = held.column("_set").to_numpy(), held.column("length").to_numpy()
        order = np.lexsort((length, -number, ~late, known, -held.column("score").to_numpy(), q))
        q, number, length = q[order], number[order], length[order]
        once = np.concatenate(([True], (np.diff(q) != 0) | (np.diff(number) != 0) | (np.diff(length) != 0)))
        order, q = order[once], q[once]
        return held.take(pa.array(order[np.arange(len(q)) - np.searchsorted(q, q) < best]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        for b in (p for whole in batches for p in _pieces(whole)):
            lists = b.column("_w")
            length = pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int64())
            for q, r, score, n, tf in plan.hits(lists):
                at = pa.array(r)
                rows = pa.table([pa.array(q, pa.int32()), b.column(key).take(at), pa.array(_rounded(score)), pa.array(n, pa.int64()), pa.array(tf, pa.int64()), length.take(at), b.column("_late").take(at)], names=["_set", key, "score", "covers", "tf", "length", "_late"])
                if best is None:
                    yield from rows.drop_columns("_late").to_batches()
                    continue
                parts.append(rows)
                if sum(p.num_rows for p in parts[1:]) > max(HELD, parts[0].num_rows):
                    parts = [cut(pa.concat_tables(parts))]
        if parts:
            yield from cut(pa.concat_tables(parts)).drop_columns("_late").combine_chunks().to_batches(max_chunksize=PAIRS)

    found = words.mapInArrow(run, schema).dropDuplicates(["_set", key, "length"])
    owners = docs.sparkSession.createDataFrame([(k, q) for k, qs in enumerate(asking.values()) for q in qs], f"_set int, {qkey} {kinds[qkey]}")
    return found.join(F.broadcast(owners), "_set").select(qkey, key, "score", "covers", "tf", "length")


def excerpt(words: list[str], gaps: list[str], term: np.ndarray, need: int, fragments: int, most: int, least: int) -> str:
    """Up to so many fragments of a text around its densest covers, the query's words marked."""
    at = np.nonzero(term >= 0)[0]
    starts, ends, noise = covers(at, term[at], need) if need else (at[:0],) * 3
    chosen: list[tuple[int, int]] = []
    for k in np.lexsort((starts, noise)):
        first, last = int(at[starts[k]]), int(at[ends[k]])
        a = max(first - max(most - (last - first + 1), 0) // 2, 0)
        b = min(a + most, len(words))
        if len(chosen) < fragments and all(b <= x or y <= a for x, y in chosen):
            chosen.append((a, b))
    parts = []
    for a, b in sorted(chosen) or [(0, min(least, len(words)))]:
        text = "".join((f"<mark>{words[k]}</mark>" if term[k] >= 0 else words[k]) + (gaps[k] if k + 1 < b else "") for k in range(a, b))
        parts.append(text)
    return " ... ".join(parts)


def headlines(rows: DataFrame, text: str, terms: str, *, fragments: int = 3, most: int = 48, least: int = 12) -> DataFrame:
    """``rows`` with ``headline``: excerpts of the text around covers of the terms (an array of lower-cased words).

    At most ``fragments`` that do not overlap, densest covers first, of at most ``most``
    words each, in the text's order and parted by `` ... ``; a longer cover is cut.
    Without a cover it is the text's first ``least`` words.  A null text gives null.
    """

    @F.arrow_udf(T.StringType())
    def cut(words: pa.Array, gaps: pa.Array, term: pa.Array, need: pa.Array) -> pa.Array:
        each = zip(words, gaps, term, need, strict=True)  # one row's words at a time are Python's
        return pa.array([None if not w.is_valid else excerpt(w.as_py(), g.as_py(), np.asarray(t.as_py(), int), n.as_py(), fragments, most, least) for w, g, t, n in each], pa.string())

    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    number = F.transform(words, lambda w: (F.array_position(F.col(terms), F.lower(w)) - 1).cast("int"))
    return rows.withColumn("headline", cut(words, F.regexp_extract_all(F.col(text), F.lit(GAP), F.lit(1)), number, F.coalesce(F.size(terms), F.lit(0))))
