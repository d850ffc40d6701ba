"""Cover ranking, excerpts and the vector index against plain scans."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import lexicon as L, search as S, vectorindex


def spans(words, terms):
    """Every shortest stretch that holds all terms, by trying all stretches."""
    full = [(a, b) for a in range(len(words)) for b in range(a, len(words)) if set(terms) <= set(words[a : b + 1])]
    return [(a, b) for a, b in full if not any((x, y) != (a, b) and a <= x and y <= b for x, y in full)]


def score(words, terms):
    return round(sum(0.1 / (1 + sum(w not in terms for w in words[a : b + 1])) for a, b in spans(words, terms)), 9)


def test_covers_equal_all_stretches():
    rng = random.Random(1)
    for _ in range(300):
        words = [rng.choice("abcdex") for _ in range(rng.randrange(0, 25))]
        terms = rng.sample("abc", rng.randrange(1, 4))
        at = [k for k, w in enumerate(words) if w in terms]
        a, b, noise = L.covers(np.array(at, int), np.array([terms.index(words[k]) for k in at], int), len(terms))
        assert [(at[i], at[j]) for i, j in zip(a, b, strict=True)] == spans(words, terms)
        assert list(noise) == [sum(w not in terms for w in words[x : y + 1]) for x, y in spans(words, terms)]


def texts(spark):
    rng = random.Random(2)
    docs = [(k, " ".join(rng.choice(["Alpha", "beta", "gamma,", "Öl", "x_1", "the", "a"]) for _ in range(rng.randrange(0, 30)))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "alpha " * 3000 + "beta"), (3, docs[3][1])]
    queries = [(1, "alpha beta"), (2, "the"), (3, "öl, X_1 the"), (4, ""), (5, None), (6, "absent the"), (7, "the The THE")]
    return docs, queries, spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(queries, "q long, s string")


def expected(docs, queries):
    seen, out = {}, {}
    for d, t in docs:
        seen.setdefault(d, t)
    for q, s in queries:
        terms = list(dict.fromkeys(re.findall(r"\w+", (s or "").lower())))
        for d, t in seen.items():
            words = re.findall(r"\w+", (t or "").lower())
            if d != 102 and terms and set(terms) <= set(words):
                out[q, d] = (score(words, terms), len(spans(words, terms)), sum(w in terms for w in words), len(words))
    return out


def test_search_ranks_by_covers_with_and_without_a_stored_file(spark, tmp_path):
    docs, queries, d, q = texts(spark)
    want = expected(docs, queries)

    def rows(df):
        return {(r.q, r.d): (r.score, r.covers, r.tf, r.length) for r in df.collect() if r.d != 102}

    assert rows(L.search(d, q, "d", "t", "q", "s")) == want
    L.write_postings(L.postings(d, "d", "t"), "d", str(tmp_path / "file"))
    terms = L.asked_terms(q, "q", "s")
    stored = L.read_postings(spark, str(tmp_path / "file"), terms.select("term").distinct())
    assert rows(L.hits(stored, terms, "d", "q")) == want
    long = [r for r in L.search(d, q, "d", "t", "q", "s").collect() if r.d == 102]
    assert [(r.q, r.covers, r.tf) for r in long] == [(1, 1, 3001)]
    assert L.search(d.limit(0), q, "d", "t", "q", "s").count() == 0


def test_headlines_cut_the_densest_covers(spark):
    text = "Zero one two. Alpha x beta three " + "w " * 100 + "beta! ALPHA; end " + "v " * 100 + "alpha y z beta " + "u " * 60 + "alpha q q q q beta"
    rows = [(1, text, ["alpha", "beta"]), (2, "no words of it, but many others " * 4, ["alpha"]), (3, None, ["alpha"]), (4, "some text", []), (5, "alpha " + "n " * 90 + "beta", ["alpha", "beta"])]
    df = spark.createDataFrame(rows, "k long, t string, terms array<string>")
    got = {r.k: r.headline for r in L.headlines(df, "t", "terms", most=8).collect()}
    parts = got[1].split(" ... ")
    assert len(parts) == 3 and all(len(re.findall(r"\w+", p.replace("<mark>", "").replace("</mark>", ""))) <= 8 for p in parts)
    assert "<mark>Alpha</mark> x <mark>beta</mark>" in parts[0] and "<mark>beta</mark>! <mark>ALPHA</mark>" in parts[1] and "<mark>alpha</mark> y z <mark>beta</mark>" in parts[2]
    assert got[2] == "no words of it, but many others no words of it, but" and got[3] is None and got[4] == "some text"
    assert got[5] == "<mark>alpha</mark> " + " ".join("n" * 7)


def clusters(spark, n=1500, d=16, groups=30):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((groups, d))
    rows = [(i, (centres[i % groups] + 0.3 * rng.standard_normal(d)).tolist()) for i in range(n)]
    return rows, spark.createDataFrame([*rows, (9000, None), (9001, [0.0] * d), (9002, [float("nan")] * d), (9003, [1.0] * 3), (9004, [])], "id long, v array<double>")


def test_the_index_passes_its_gate_and_reads_few_cells(spark, tmp_path):
    rows, df = clusters(spark)
    index = vectorindex.build(df, "id", "v", cells=30)
    assert index.recall >= 0.95 and index.probes <= 8
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    asked = df.filter("id % 50 = 0 and id < 9000")
    found = {}
    for r in index.search(asked, 10).collect():
        found.setdefault(r.query_id, set()).add(r.id)
    hit = [len(found[q] & set(np.argsort(-(x @ x[q]))[1:11].tolist())) / 10 for q in range(0, 1500, 50)]
    assert np.mean(hit) >= 0.95
    index.publish(str(tmp_path / "index"))
    again = vectorindex.load(spark, str(tmp_path / "index"))
    key = ["query_id", "id", "rank"]
    assert sorted(map(tuple, again.search(asked, 10).select(*key).collect())) == sorted(map(tuple, index.search(asked, 10).select(*key).collect()))
    index.recall = 0.9
    with pytest.raises(vectorindex.RecallBelowGate):
        index.publish(str(tmp_path / "other"))
    assert not (tmp_path / "other").exists()


def test_exact_neighbours_leave_out_what_has_no_direction(spark):
    _, df = clusters(spark, n=60)
    got = S.exact_neighbours(df, df.filter("id in (0, 9000, 9001, 9002, 9003, 9004)"), "id", "v", 100)
    assert got.filter("query_id = 0").count() == 59 and got.filter("query_id >= 9000").count() == 0
    with pytest.raises(ValueError):
        vectorindex.build(df.filter(F.col("id") == 9000), "id", "v")


def test_a_pair_of_blocks_holds_the_products_of_few_queries(spark):
    rng = np.random.default_rng(4)
    v, q = rng.standard_normal((20_000, 8)), rng.standard_normal((1000, 8))
    block = lambda first, x: pa.table({"id": np.arange(first, first + len(x)), "v": pa.array(list(x), pa.list_(pa.float64()))})
    rows, queries = block(0, v), block(50_000, q)
    tracemalloc.start()
    found = S._nearest(3)(rows, queries).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # all products are 160 MB
    u, w = v / np.linalg.norm(v, axis=1)[:, None], q / np.linalg.norm(q, axis=1)[:, None]
    assert found["other"] == np.argsort(-(w @ u.T), axis=1, kind="stable")[:, :3].ravel().tolist()


def test_an_index_that_probes_all_cells_repeats_no_query(spark, monkeypatch):
    _, df = clusters(spark, n=300)
    index = vectorindex.build(df, "id", "v", cells=10)
    asked = df.filter("id % 50 = 0 and id < 9000")
    want = sorted(map(tuple, S.exact_neighbours(df, asked, "id", "v", 5).collect()))
    monkeypatch.setattr(vectorindex, "_placed", None)
    assert sorted(map(tuple, index.search(asked, 5, probes=10).collect())) == want


def test_rows_are_sent_to_their_cells_in_bounded_pieces(spark, monkeypatch):
    rows, df = clusters(spark, n=200)
    monkeypatch.setattr(vectorindex, "SENT", 8)
    centres = np.array([v for _, v in rows[:6]])
    placed = vectorindex._placed(df.filter("id < 9000"), "id", "v", centres, 3)
    assert placed.count() == 600 and placed.select("id", "cell").distinct().count() == 600


def test_postings_are_made_of_bounded_pieces(monkeypatch):
    monkeypatch.setattr(L, "PIECE", 5)
    words = [["a"] * 3, ["b"] * 2, None, ["c"] * 9, [], ["d"]]
    pieces = list(L._pieces(pa.RecordBatch.from_pydict({"_w": pa.array(words, pa.list_(pa.string()))})))
    assert [p.column("_w").to_pylist() for p in pieces] == [words[:3], [words[3]], words[4:]]


def test_the_best_hits_of_a_query_are_kept_where_they_are(spark, monkeypatch):
    docs, queries, d, q = texts(spark)
    q = q.unionByName(spark.createDataFrame([(8, "beta ALPHA")], q.schema))
    every = [tuple(r) for r in L.search(d, q, "d", "t", "q", "s").collect()]
    assert {r[1:] for r in every if r[0] == 8} == {r[1:] for r in every if r[0] == 1}
    want = {k: sorted((r for r in every if r[0] == k), key=lambda r: (-r[2], -r[1]))[:3] for k in {r[0] for r in every}}
    found = [tuple(r) for r in L.search(d, q, "d", "t", "q", "s", best=3).collect()]
    assert len(found) < len(every)  # a task gives no more than three of a query
    assert {k: sorted((r for r in found if r[0] == k), key=lambda r: (-r[2], -r[1]))[:3] for k in want} == want
