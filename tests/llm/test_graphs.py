"""The trie of conversations, whitening and near duplicates of embeddings against brute force."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest

from palimpsest.llm.conversations import conversation_trie, running_sums
from palimpsest.llm.descent import near_links
from palimpsest.llm.whitening import add, outer_sums, total, whiten

TURNS = "conv_id long, turn long, role string, text string"
VECTORS = "vec_id long, embedding array<double>, label int"


def trie(rows, family=5, shared=9):
    """All nodes by building every path and every subtree."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0), hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest(), (r, t)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        if family is None:
            paths[c] = tuple(turns)
        else:
            h = zlib.crc32(str(c).encode()) % shared
            paths[c] = tuple(own.get(c - c % family, [])[:h] + turns[h:])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)]
        ends = ",".join(str(c) for c in sorted(m) if paths[c] == node)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        children = sum(1 for x in below if len(x) == len(node) + 1)
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes_of(df):
    return sorted((tuple(r[c] for c in NODE) for r in df.collect()), key=repr)


@pytest.mark.parametrize("family", [5, None])
def test_trie_of_conversations_equals_brute_force(spark, family):
    rng = np.random.default_rng(3)
    rows = []
    for c in [*range(24), 1000, 1001, 4096 * 3, 4096 * 3 + 4]:
        for turn in range(int(rng.integers(1, 12))):
            rows.append((c, None if rng.random() < 0.1 else turn, None if rng.random() < 0.1 else "user", None if rng.random() < 0.2 else "é" * int(rng.integers(0, 3))))
    rows += [rows[5], (None, 1, "user", "no conversation"), (7, 3, "user", "same turn"), (7, 3, "user", "other text")]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    assert nodes_of(conversation_trie(df, family=family)) == trie(rows, family)


def test_trie_of_copies_long_conversations_and_clashing_columns(spark):
    rows = [(c, t, "user", "hello") for c in range(60) for t in range(2)] + [(500, t, "user", str(t)) for t in range(700)]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS c", "'x' AS node", "2 AS place", "3 AS depth", "4 AS _range")
    assert nodes_of(conversation_trie(df)) == trie(rows)
    assert conversation_trie(df.limit(0)).count() == 0


def test_running_sums_of_a_key_that_spans_all_tasks(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).select(F.when(F.col("id") < 990, 1).otherwise(2).cast("long").alias("k"), "id")
    got = {(r.k, r.id): r.n for r in running_sums(df, "k", ["id"], {"n": F.lit(1).cast("long")}).collect()}
    assert got == {(1 if i < 990 else 2, i): i + 1 if i < 990 else i - 989 for i in range(1000)}


def test_compensated_sums_keep_what_doubles_lose():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 5)) * 10.0 ** rng.integers(-9, 9, (1500, 5))
    high, low = outer_sums(x, np.zeros_like(x))
    for i in range(5):
        for j in range(i, 5):
            exact = sum(Fraction(float(a)) * Fraction(float(b)) for a, b in zip(x[:, i], x[:, j], strict=True))
            assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - exact) <= abs(exact) * Fraction(1, 2**90) + Fraction(1, 2**40)
    h, lo = total(np.array([[1e16], [1.0], [-1e16]]), np.zeros((3, 1)))
    assert h[0] + lo[0] == 1.0
    assert add((1e16, 0.0), (1.0, 0.0)) == (1e16, 1.0)


def whitened(rows, k, scale=64, origin=1_000_000):
    """By exact rational sums for each length of vectors."""
    out = {}
    good = [(i, [int(np.floor(scale * c)) + origin for c in v]) for i, v, *_ in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    for d in {len(x) for _, x in good}:
        same = [(i, x) for i, x in good if len(x) == d]
        fit = sorted({tuple(x) for _, x in same})
        n, s = len(fit), [sum(x[j] for x in fit) for j in range(d)]
        cov = np.array([[float(Fraction(n * sum(x[i] * x[j] for x in fit) - s[i] * s[j], n * n)) for j in range(d)] for i in range(d)])
        e, v = np.linalg.eigh(cov)
        e, v = e[::-1][:k], v[:, ::-1][:, :k]
        for i, x in same:
            y = [float(Fraction(n * a - b, n)) for a, b in zip(x, s, strict=True)]
            out[i] = (n, sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)), np.array(y) @ v / np.sqrt(e), e / cov.trace())
    return out


def test_whitening_equals_rational_arithmetic(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(6) * [1, 2, 3, 4, 5, 6]).tolist(), 0) for i in range(300)]
    rows += [(300 + i, rng.standard_normal(3).tolist(), 0) for i in range(40)]
    rows += [(400, rows[0][1], 1)]
    bad = [(500, None, 0), (501, [], 0), (502, [None, 1.0, 2.0], 0), (503, [float("nan"), 1.0, 2.0], 0), (504, [float("inf"), 1.0, 2.0], 0), (505, [1e300, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows + bad, VECTORS).selectExpr("*", "1 AS id", "2 AS d", "3 AS x").repartition(3)
    want, got = whitened(rows, 4), {}
    for r in whiten(df, components=4).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == set(want)
    sign = {}
    for i, (n, deviation, white, share) in want.items():
        assert sorted(got[i]) == list(range(1, len(white) + 1))
        for j, r in got[i].items():
            assert r.n == n and int(r.deviation) == deviation and r.identity_error < 1e-9
            assert abs(r.explained - share[j - 1]) < 1e-12
            s = sign.setdefault((len(white), j), np.sign(r.whitened * white[j - 1]))
            assert abs(s * r.whitened - white[j - 1]) < 1e-8


def test_whitening_of_degenerate_tables(spark):
    one = [(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0)]
    assert whiten(spark.createDataFrame(one, VECTORS)).count() == 0
    assert whiten(spark.createDataFrame([], VECTORS)).count() == 0
    flat = [(i, [float(i), 3.0], 0) for i in range(10)] + [(None, [1.0, 3.0], 0), (3, [3.0, 3.0], 0)]
    got = whiten(spark.createDataFrame(flat, VECTORS)).collect()
    assert len(got) == 12 and {r.component for r in got} == {1} and all(r.explained == 1.0 for r in got)
    far = [(i, [float(2**50 + i), float(i * i)], 0) for i in range(50)]
    want = whitened(far, 2)
    assert {r.vec_id: int(r.deviation) for r in whiten(spark.createDataFrame(far, VECTORS)).collect()} == {i: w[1] for i, w in want.items()}


def links(rows, threshold):
    """By all pairs and by following links."""
    good = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) and lab is not None for _, v, lab in rows]
    near = [[] for _ in rows]
    for a, (_, v, lab) in enumerate(rows):
        for b in range(a):
            w = rows[b][1]
            if good[a] and good[b] and lab == rows[b][2] and len(v) == len(w):
                x, y = np.array(v), np.array(w)
                if (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())) >= threshold:
                    near[a].append(b)
                    near[b].append(a)
    out = []
    for a, (i, _, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((i, len(near[a]), least, i == least))
    return sorted(out, key=repr)


def linked_rows(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def test_near_links_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.standard_normal(12).tolist(), int(rng.integers(0, 3))) for i in range(300)]
    for group, size in ((3, 40), (70, 25), (120, 2)):  # larger than the lists
        rows += [(1000 + 50 * group + j, (np.array(rows[group][1]) + 0.12 * rng.standard_normal(12)).tolist(), rows[group][2]) for j in range(size)]
    turn = [(5000 + j, [float(np.cos(0.3 * j)), float(np.sin(0.3 * j)), *[0.0] * 10], 0) for j in range(18)]  # a chain
    rows += turn + [(6000 + j, rows[5][1], rows[5][2]) for j in range(30)] + [(6100, [2 * c for c in rows[5][1]], rows[5][2])]
    rows += [(7000, None, 0), (7001, [], 0), (7002, [0.0] * 12, 0), (7003, [None] * 12, 0), (7004, [float("nan")] * 12, 0), (7005, rows[5][1], None), (7006, rows[5][1][:3], rows[5][2]), (None, rows[6][1], rows[6][2]), (6, rows[6][1], rows[6][2])]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS id", "2 AS nid", "3 AS v", "4 AS comp").repartition(3)
    assert linked_rows(near_links(df, neighbours=4, orders=3)) == links(rows, 0.93)


def test_near_links_of_small_tables(spark):
    assert near_links(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (3, None, 0)]
    assert linked_rows(near_links(spark.createDataFrame(rows, VECTORS))) == links(rows, 0.93)
    same = [(i, [1.0, 2.0], 0) for i in range(50)]
    assert linked_rows(near_links(spark.createDataFrame(same, VECTORS))) == links(same, 0.93)


def test_blocks_of_a_component_count_alike(spark, monkeypatch):
    from palimpsest.llm import descent

    rng = np.random.default_rng(2)
    rows = [(i, (np.ones(8) + 0.2 * rng.standard_normal(8)).tolist(), 0) for i in range(90)]
    monkeypatch.setattr(descent, "BLOCK", 16)
    assert linked_rows(near_links(spark.createDataFrame(rows, VECTORS), neighbours=4)) == links(rows, 0.93)
