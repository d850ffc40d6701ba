"""N-gram Jaccard join: documents whose shingle sets overlap by a given share.

1. *Sets.*  A document's set holds 64-bit names of its shingles.  Documents with
   equal sets form a class; only classes go on.
2. *Global order.*  An exchange by shingle counts in how many classes each occurs.
   Shingles are ordered by that count (then by name), so rare ones come first.
   A class can only link if the share of its shingles that others have too
   reaches the threshold; all other classes leave here, with exact counts.
3. *Prefixes.*  Two sets that link share a shingle among the first
   ``n - ceil(t n) + 1`` of each.  Classes that share a prefix shingle are
   connected to candidate groups (``graph.components``).  Hot shingles are
   contracted in each map task before they are exchanged.
4. *Prefix tree.*  Each group's ordered sets are stored in a compressed trie.  A
   set is looked up in it level by level: the overlap so far is shared by all sets
   below a node, and a subtree is pruned if its remaining lengths cannot reach the
   threshold, or if it is linked with the set already.  A group of more than
   ``GROUP_KEYS`` shingles is dealt as pairs of blocks, each of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import exchange as X
from .graph import components, local_components
from .repeats import Rolling, _texts, word_symbols

#: Shingles of a candidate group that one task holds.
GROUP_KEYS = 4_000_000


def shingles(data: bytes, size: int) -> np.ndarray:
    """Sorted distinct names of the word n-grams of lower-cased (A-Z) text; of all words, if they are fewer."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    roll = Rolling(word_symbols(words))
    if len(words) < size:
        return X.mix(roll.at(np.array([0]), np.array([len(words)])) + np.uint64(len(words)))
    return np.unique(X.mix(roll.every(size)))


def class_name(keys: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(keys.tobytes(), digest_size=8).digest(), "little", signed=True)


def needed(n: np.ndarray | int, m: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    """Least overlap of sets of n and m that link: den * o >= num * (n + m - o)."""
    return -(-num * (n + m) // (num + den))


class Trie:
    """Compressed trie over ordered sets; sets are numbered in lexicographic order."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.order, self.sets, self.n = order, [sets[i] for i in order], sizes[order]
        parent, lo, hi, depth, ends, label, last = [-1], [0], [0], [0], [[]], [np.empty(0, np.int64)], [-1]
        stack = [0]

        def node(par: int, first: int, tokens: np.ndarray, end: int) -> int:
            parent.append(par), lo.append(first), hi.append(0), depth.append(end), ends.append([]), label.append(tokens), last.append(int(tokens[-1]))
            return len(parent) - 1

        before = np.empty(0, np.int64)
        for i, s in enumerate(self.sets):
            m = min(len(s), len(before))
            differ = np.nonzero(s[:m] != before[:m])[0]
            common = int(differ[0]) if len(differ) else m
            while depth[stack[-1]] > common:
                top = stack.pop()
                hi[top] = i
                if depth[stack[-1]] < common:  # the edge splits
                    at = depth[stack[-1]]
                    mid = node(stack[-1], lo[top], label[top][: common - at], common)
                    label[top], parent[top] = label[top][common - at :], mid
                    stack.append(mid)
            if common < len(s):
                stack.append(node(stack[-1], i, s[common:], len(s)))
            ends[stack[-1]].append(i)
            before = s
        for k in stack:
            hi[k] = len(self.sets)
        self.lo, self.hi, self.depth, self.last = np.array(lo), np.array(hi), np.array(depth), np.array(last)
        lens = np.array([len(x) for x in self.sets])
        self.most = np.array([lens[a:b].max() if b > a else 0 for a, b in zip(lo, hi, strict=True)])
        self.least_n = np.array([self.n[a:b].min() if b > a else 0 for a, b in zip(lo, hi, strict=True)])
        self.most_n = np.array([self.n[a:b].max() if b > a else 0 for a, b in zip(lo, hi, strict=True)])
        self.ends = ends
        par = np.array(parent)
        kids = np.argsort(par, kind="stable")[1:]
        self.kid_at = np.searchsorted(par[kids], np.arange(len(par) + 1))
        self.kids = kids
        size = np.array([len(x) for x in label])
        self.label_at = np.concatenate(([0], np.cumsum(size)))
        self.label = np.concatenate(label) if len(label) else np.empty(0, np.int64)
        self.words = int(max((x[-1] for x in self.sets if len(x)), default=-1)) + 1


def _spans(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def link_group(sets: list[np.ndarray], sizes: np.ndarray, side: np.ndarray | None, num: int, den: int) -> np.ndarray:
    """Component label (an index) of each set; with ``side``, only sets of different sides are compared."""
    t = Trie(sets, sizes)
    k = len(sets)
    where = None if side is None else side[t.order]
    label = np.arange(k)
    changes = np.arange(k)
    has = np.zeros(t.words + 1, bool)
    for q in range(k - 1):
        own, nq = t.sets[q], int(t.n[q])
        has[own] = True
        front, over = t.kids[t.kid_at[0] : t.kid_at[1]], None
        over = np.zeros(len(front), np.int64)
        while len(front):
            live = (t.hi[front] > q + 1) & (t.most_n[front] * den >= nq * num) & (t.least_n[front] * num <= nq * den)
            uniform = (changes[t.hi[front] - 1] == changes[t.lo[front]]) & (label[t.lo[front]] == label[q])
            live &= ~uniform
            front, over = front[live], over[live]
            if not len(front):
                break
            at, size = t.label_at[front], t.label_at[front + 1] - t.label_at[front]
            hits = has[t.label[_spans(at, size)]].astype(np.int64)
            over = over + np.add.reduceat(hits, np.cumsum(size) - size)
            rest = np.minimum(len(own) - np.searchsorted(own, t.last[front], "right"), t.most[front] - t.depth[front])
            live = over + rest >= needed(nq, np.maximum(t.least_n[front], -(-num * nq // den)), num, den)
            front, over = front[live], over[live]
            for node, o in zip(front.tolist(), over.tolist(), strict=True):
                for s in t.ends[node]:
                    if s > q and label[s] != label[q] and den * o >= num * (nq + int(t.n[s]) - o) and (where is None or where[s] != where[q]):
                        label[label == max(label[s], label[q])] = min(label[s], label[q])
                        changes = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
            count = t.kid_at[front + 1] - t.kid_at[front]
            over = np.repeat(over, count)
            front = t.kids[_spans(t.kid_at[front], count)]
        has[own] = False
    out = np.empty(k, np.int64)
    out[np.array(t.order)] = np.array(t.order)[label]
    return out


_DF = np.dtype("<u4")


def _judge(ids: np.ndarray, keys: np.ndarray, aux: object, tags: np.ndarray) -> tuple:
    """Of the shingles that occur in two classes or more: (class, shingle, number of classes, size of the class)."""
    order = np.lexsort((ids, keys))
    ids, keys, tags = ids[order], keys[order], tags[order]
    first = np.concatenate(([True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])))  # copies count once
    ids, keys, tags = ids[first], keys[first], tags[first]
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    group = np.cumsum(new) - 1
    df = np.bincount(group)[group]
    keep = df > 1
    return ids[keep], keys[keep], df[keep].astype(_DF), tags[keep]


def _survivors(num: int, den: int):
    def finish(ids: np.ndarray, keys: np.ndarray, df: np.ndarray, tags: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((keys, df, ids))
        ids, keys, df, tags = ids[order], keys[order], df[order], tags[order]
        cut = np.concatenate(([0], np.nonzero(ids[1:] != ids[:-1])[0] + 1, [len(ids)]))
        size, n = np.diff(cut), tags[cut[:-1]].astype(np.int64)
        for part in np.array_split(np.nonzero(size * den >= n * num)[0], max(1, len(cut) // 2000)):
            rows = [(cut[j], cut[j + 1]) for j in part]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(ids[a]) for a, _ in rows], pa.int64()), pa.array([int(tags[a]) for a, _ in rows], pa.int64()), pa.array([b - a for a, b in rows], pa.int64()), pa.array([keys[a:b].tobytes() for a, b in rows], pa.binary()), pa.array([df[a:b].tobytes() for a, b in rows], pa.binary())],
                names=["cls", "n", "shared", "keys", "dfs"],
            )

    return finish


def _prefixes(num: int, den: int):
    """(shingle, class) rows that connect classes as the prefixes in this task do, a class for each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, n = b.column("cls").to_numpy(), b.column("n").to_numpy()
            tok = [np.frombuffer(x.as_py(), np.uint64) for x in b.column("keys")]
            take = np.array([len(t) for t in tok]) - (-(-num * n // den)) + 1 if len(cls) else np.empty(0, np.int64)
            key = np.concatenate([t[:k] for t, k in zip(tok, take, strict=True)]) if len(cls) else np.empty(0, np.uint64)
            own = np.repeat(cls, take)
            order = np.lexsort((own, key))
            key, own = key[order], own[order]
            new = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
            head = own[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))] if len(key) else own
            node, root = local_components(own, head)
            far = node != root
            link = X.mix(node[far].view(np.uint64) ^ X.mix(root[far].view(np.uint64)))  # a made-up shingle for each link
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((key[new], link, link)).view(np.int64)), pa.array(np.concatenate((own[new], node[far], root[far])))], names=["key", "cls"])

    return run


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that connect classes with a common key, as few as a task can tell."""
    got = [(b.column("key").to_numpy(), b.column("cls").to_numpy()) for b in batches]
    if got:
        key, own = (np.concatenate([g[k] for g in got]) for k in (0, 1))
        order = np.lexsort((own, key))
        key, own = key[order], own[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        head = own[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        node, root = local_components(own, head)
        far = node != root
        yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(root[far])], names=["u", "v"])


def _linked(num: int, den: int):
    """Rows sorted by (grp, blk) to (cls, root)."""

    def solve(rows: list[tuple], crossing: bool) -> pa.RecordBatch | None:
        if len(rows) < 2:
            return None
        keys, dfs = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in ((3, np.uint64), (4, _DF)))
        names, at = np.unique(keys, return_inverse=True)
        df = np.zeros(len(names), np.int64)
        df[at] = dfs
        rank = np.empty(len(names), np.int64)
        rank[np.lexsort((names, df))] = np.arange(len(names))
        sets = np.split(rank[at], np.cumsum([r[2] for r in rows])[:-1])
        root = link_group(sets, np.array([r[1] for r in rows]), np.array([r[5] for r in rows]) if crossing else None, num, den)
        cls = np.array([r[0] for r in rows])
        low = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(low, root, cls)
        return pa.RecordBatch.from_arrays([pa.array(cls), pa.array(low[root])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now: tuple = ()
        for b in batches:
            for grp, blk, *row in zip(*(b.column(c).to_pylist() for c in ("grp", "blk", "cls", "n", "shared", "keys", "dfs", "side")), strict=True):
                if (grp, tuple(blk)) != now:
                    if (out := solve(rows, len(now) > 1 and now[1][0] != now[1][1])) is not None:
                        yield out
                    rows, now = [], (grp, tuple(blk))
                rows.append(tuple(row))
        if (out := solve(rows, len(now) > 1 and now[1][0] != now[1][1])) is not None:
            yield out

    return run


def ngram_jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: tuple[int, int] = (75, 100)) -> DataFrame:
    """Per document: (id_col, n_shingles, component_id), the least id reachable by links, itself included.

    Documents link when ``den * overlap >= num * union`` for ``threshold = (num, den)``.
    A text without words, and a null text, has an empty set and links with nothing.
    Repeated rows have equal sets and link.  Rows with a null id take part; if a
    component has no other ids its component_id is null.  Other columns are left
    out, whatever their names; an empty table gives an empty result.
    """
    num, den = threshold
    spark = docs.sparkSession
    X.prepare(spark)
    parts = X.partitions(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shingles(t, size) for t in _texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(g) for g in got], pa.int64()), pa.array([class_name(g) if len(g) else None for g in got], pa.int64())], names=["id", "n", "cls"])

    def keys(batch: pa.RecordBatch) -> Iterator[tuple]:
        for t in _texts(batch):
            if len(g := shingles(t, size)):
                yield class_name(g), g, None, len(g)

    members = X.checkpoint(texts.mapInArrow(sets, f"id {texts.schema['id'].dataType.simpleString()}, n long, cls long"))
    shared = X.gather(X.scatter(texts.select("text"), keys), _judge, None)
    alive = X.checkpoint(X.returned(shared, _survivors(num, den), "cls long, n long, shared long, keys binary, dfs binary", _DF))
    edges = alive.select("cls", "n", "keys").mapInArrow(_prefixes(num, den), "key long, cls long").repartition(parts, "key").mapInArrow(_forest, "u long, v long")
    groups = components(edges).withColumnRenamed("node", "cls").withColumnRenamed("label", "grp")
    found = alive.join(groups, "cls")
    large = X.checkpoint(groups.join(alive.select("cls", "shared"), "cls").groupBy("grp").agg(F.sum("shared").alias("held")).filter(F.col("held") > GROUP_KEYS).select("grp", F.ceil(F.col("held") / (GROUP_KEYS // 2)).alias("k")))
    split = not large.isEmpty()
    dealt = found.join(large, "grp", "left") if split else found.withColumn("k", F.lit(1).cast("long"))
    dealt = dealt.withColumn("k", F.coalesce("k", F.lit(1))).withColumn("side", F.pmod(F.xxhash64("cls"), "k")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    dealt = dealt.withColumn("blk", F.array(F.least("side", "other"), F.greatest("side", "other"))).drop("k", "other")
    links = dealt.repartition(parts, "grp", "blk").sortWithinPartitions("grp", "blk").mapInArrow(_linked(num, den), "u long, v long")
    roots = components(links) if split else links.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = X.checkpoint(roots)
    classes = members.filter("cls is not null").groupBy("cls").agg(F.min("id").alias("least")).join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    classes = classes.select("cls", "least", F.coalesce("label", "cls").alias("label"))
    least = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "label").select("cls", "component_id")
    out = members.join(named, "cls", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
