"""Near duplicates among embeddings by NN-descent.

Equal vectors of a label are one node.  Each node keeps a list of its nearest nodes;
lists begin with what lies beside a node in a few sorted orders of random
projections, and rounds then compare the neighbours of each node with one another,
where at least one of a pair is new, and keep what is nearer.  Rounds compare
vectors of one byte an entry; every link is decided on the original vectors.

A list is saturated when all of its entries are links.  Links join nodes to
components, and entries of a node's own component then take none of its places:
saturated lists are enlarged by their whole component and get as many places again
outside of it, filled at random and refined by further rounds, until no link between
two components is found.  Within a component all links are counted, block against
block, so a list that was too short loses no link there.

A sample of nodes is held against all nodes of its label; while the audit finds too
few of their links, lists are doubled and rounds go on from fresh orders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import exchange as X
from .graph import components
from .neighbours import usable

#: Nodes that are compared with one another at once; the neighbours of a hub are dealt to several such groups.
GROUP = 64
#: Nodes of a component that one task holds of either side.
BLOCK = 4096
#: Cosines this near to the threshold are computed again one by one.
_CLOSE = 1e-9
_SIDE = ("label", "dim", "nid", "q", "slack")
_EDGES = "u long, v long, s double, near boolean"


def _sketch(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one byte an entry, and how much of a cosine each side's rounding may change."""
    most = np.abs(x).max(axis=1)
    slack = 1.1 * np.sqrt(x.shape[1]) / 127 * most / np.sqrt((x * x).sum(axis=1))
    return np.rint(127 * x / most[:, None]).astype(np.int8), slack


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(float), b.astype(float)
    return (a @ b.T) / (np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1)))


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of a and b have a cosine of the threshold or more, in double precision."""
    s = _cosines(a, b)
    for i, j in zip(*np.nonzero(np.abs(s - threshold) < _CLOSE), strict=True):
        x, y = a[i].astype(float), b[j].astype(float)
        s[i, j] = (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))
    return s >= threshold


def _nearest(ids: np.ndarray, q: list[bytes], slack: list[float], ok: np.ndarray, k: int, threshold: float, least: np.ndarray | float = -2.0) -> Iterator[pa.RecordBatch]:
    """Each row's k best allowed columns over its least; ties go to the smaller id; ``near`` ones may be links."""
    x, slack = _bytes(q, np.int8), np.array(slack)
    s = _cosines(x, x)
    s = np.where(ok & (s > least), s, -np.inf)
    order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
    best = np.take_along_axis(s, order, axis=1)
    i, j = np.nonzero(best > -np.inf)
    if len(i):
        to, score = order[i, j], best[i, j]
        yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[to]), pa.array(score), pa.array(score + slack[i] + slack[to] >= threshold)], names=["u", "v", "s", "near"])


def _stacked(batches: Iterator[pa.RecordBatch], key: list[str], columns: list[str], most: int) -> Iterator[tuple[tuple, list[list]]]:
    """Rows of a sorted partition by key, at most so many at a time."""
    now, held = None, []
    for b in batches:
        rows = zip(zip(*(b.column(c).to_pylist() for c in key), strict=True), zip(*(b.column(c).to_pylist() for c in columns), strict=True), strict=True)
        for own, row in rows:
            if own != now or len(held) >= most:
                if held:
                    yield now, list(zip(*held, strict=True))
                now, held = own, []
            held.append(row)
    if held:
        yield now, list(zip(*held, strict=True))


def _bytes(blobs: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1)


def _beside(nodes: DataFrame, k: int, threshold: float, orders: int, seed: int) -> DataFrame:
    """Each node's k nearest among the nodes beside it, in each of several orders by the signs of random projections."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, q = b.column("dim").to_numpy(zero_copy_only=False), b.column("q").to_pylist()
            for d in np.unique(dims):
                at = np.nonzero(dims == d)[0]
                x, some = _bytes([q[i] for i in at], np.int8).astype(float), b.take(pa.array(at))
                for t in range(orders):
                    plane = np.random.default_rng([seed, t, int(d)]).standard_normal((int(d), 62))
                    code = (x @ plane > 0) @ (np.int64(1) << np.arange(62, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t), pa.int32()), pa.array(code, pa.int64()), *(some.column(c) for c in _SIDE)], names=["t", "code", *_SIDE])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (ids, q, slack) in _stacked(batches, ["t", "label", "dim"], ["nid", "q", "slack"], GROUP):
            yield from _nearest(np.array(ids), q, slack, ~np.eye(len(ids), dtype=bool), k, threshold)

    coded = nodes.select(*_SIDE).mapInArrow(project, "t int, code long, label string, dim int, nid long, q binary, slack double")
    order = ["t", "label", "dim", "code", "nid"]
    return coded.repartitionByRange(X.partitions(nodes.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(compare, _EDGES)


def _at_random(nodes: DataFrame, k: int, threshold: float, seed: int) -> DataFrame:
    """Each saturated node's k nearest outside of its component among some nodes of its label, dealt at random."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (ids, comp, asks, q, slack) in _stacked(batches, ["label", "dim"], ["nid", "comp", "saturated", "q", "slack"], 2 * GROUP):
            c = np.array(comp)
            yield from _nearest(np.array(ids), q, slack, (c[:, None] != c) & np.array(asks)[:, None], k, threshold)

    dealt = nodes.select(*_SIDE, F.xxhash64("nid", F.lit(seed)).alias("r"), "comp", "saturated")
    order = ["label", "dim", "r", "nid"]
    return dealt.repartitionByRange(X.partitions(nodes.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(compare, _EDGES)


def _kept(entries: DataFrame, k: int) -> DataFrame:
    """The k nearest entries of each list within the node's component and as many outside of it; an old entry stays old."""
    own = entries.repartition(X.partitions(entries.sparkSession), "u").groupBy("u", "v").agg(F.max("s").alias("s"), F.max("near").alias("near"), F.min("new").alias("new"), F.max("inside").alias("inside"))
    place = F.row_number().over(Window.partitionBy("u", "inside").orderBy(F.desc("s"), "v"))
    return own.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def _fresh(found: DataFrame) -> DataFrame:
    return found.withColumns({"new": F.lit(True), "inside": F.lit(False)})


def _round(lists: DataFrame, nodes: DataFrame, k: int, threshold: float, turn: int) -> DataFrame:
    """Lists after each node's neighbours, either way and itself, were compared with one another."""
    ways = lists.select(F.col("u").alias("p"), F.col("v").alias("m"), "new").union(lists.select("v", "u", "new"))
    ways = ways.groupBy("p", "m").agg(F.max("new").alias("new"))
    pivots = ways.groupBy("p").agg(F.count("*").alias("held"), F.max("new").alias("any")).filter("any").drop("any")
    near = ways.join(pivots, "p").unionByName(pivots.select("p", F.col("p").alias("m"), F.lit(False).alias("new"), "held"))
    parts = F.ceil((F.col("held") + 1) / GROUP)
    near = near.select("p", "m", "new", F.pmod(F.xxhash64("m", F.lit(turn)), parts).cast("int").alias("part"))
    # what a candidate must beat: the last entry of a full list
    last = lists.filter("not inside").groupBy("u").agg(F.count("*").alias("held"), F.min("s").alias("least")).filter(F.col("held") >= k)
    sides = nodes.select(F.col("nid").alias("m"), "comp", "q", "slack").join(last.select(F.col("u").alias("m"), "least"), "m", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    dealt = near.join(sides, "m").repartition(X.partitions(lists.sparkSession), "p", "part").sortWithinPartitions("p", "part")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (ids, new, comp, least, q, slack) in _stacked(batches, ["p", "part"], ["m", "new", "comp", "least", "q", "slack"], 4 * GROUP):
            fresh, c = np.array(new), np.array(comp)
            if fresh.any():
                yield from _nearest(np.array(ids), q, slack, (fresh[:, None] | fresh) & (c[:, None] != c), k, threshold, np.array(least)[:, None])

    return _kept(lists.withColumn("new", F.lit(False)).unionByName(_fresh(dealt.mapInArrow(compare, _EDGES))), k)


def _verified(lists: DataFrame, nodes: DataFrame, kind: type, threshold: float) -> DataFrame:
    """(u, v): the pairs of the lists between two components that are links on the original vectors."""
    pairs = lists.filter("near").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    one, two = (nodes.select(F.col("nid").alias(n), F.col("v").alias(f"x{n}"), F.col("comp").alias(f"c{n}")) for n in ("u", "v"))
    both = pairs.join(one, "u").join(two, "v").filter("cu <> cv")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = zip(b.column("xu").to_pylist(), b.column("xv").to_pylist(), strict=True)
            keep = [bool(linked(_bytes([x], kind), _bytes([y], kind), threshold)[0, 0]) for x, y in sides]
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", "xu", "xv").mapInArrow(test, "u long, v long")


def _links_within(nodes: DataFrame, kind: type, threshold: float) -> DataFrame:
    """(nid, links): how many other rows each node is linked with, among the nodes of its component.

    Blocks of a component meet in pairs, each pair as one group of rows that holds
    two blocks; only counts leave it.
    """
    parts = nodes.groupBy("comp").agg(F.count("*").alias("size")).filter("size > 1").select("comp", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"))
    block = F.pmod(F.xxhash64("nid"), F.col("parts")).cast("int")
    dealt = nodes.join(parts, "comp").select("comp", "nid", "mult", "v", block.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side"), "nid", "mult", "v")
    key = ["comp", "i", "j"]
    dealt = dealt.repartition(X.partitions(nodes.sparkSession), *key).sortWithinPartitions(*key, "side", "nid")

    def counted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, same: bool) -> Iterator[np.ndarray]:
        for k in range(0, len(x), GROUP):  # a strip of the matrix at a time
            hit = linked(x[k : k + GROUP], y, threshold)
            if same:
                hit[np.arange(len(hit)), k + np.arange(len(hit))] = False
            yield hit @ weight

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), (side, ids, mult, v) in _stacked(batches, key, ["side", "nid", "mult", "v"], 1 << 62):
            x, w, first = _bytes(v, kind), np.array(mult), ~np.array(side)
            if i == j:
                links = np.concatenate(list(counted(x, x, w, True)))
            else:
                links = np.zeros(len(x), np.int64)
                for own in (first, ~first):
                    if own.any() and not own.all():
                        links[own] = np.concatenate(list(counted(x[own], x[~own], w[~own], False)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64())], names=["nid", "links"])

    return dealt.select(*key, "side", "nid", "mult", "v").mapInArrow(count, "nid long, links long").groupBy("nid").agg(F.sum("links").alias("links"))


def _audited(nodes: DataFrame, kind: type, threshold: float, sample: int, seed: int) -> float:
    """The share of a sample's links, against all nodes of its labels, that lie within a component."""
    asked = nodes.orderBy(F.xxhash64("nid", F.lit(seed))).limit(sample).select("nid", "label", "dim", "v", "comp").collect()  # a bounded sample
    groups: dict[tuple, list] = {}
    for r in asked:
        groups.setdefault((r.label, r.dim), []).append((r.nid, bytes(r.v), r.comp))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            there = found = 0
            for own, (ids, comp, v) in _stacked(iter([b]), ["label", "dim"], ["nid", "comp", "v"], 1 << 62):
                q = groups.get(own)
                if q:
                    hit = linked(_bytes([x for _, x, _ in q], kind), _bytes(v, kind), threshold) & (np.array([n for n, _, _ in q])[:, None] != np.array(ids))
                    there, found = there + int(hit.sum()), found + int((hit & (np.array([c for _, _, c in q])[:, None] == np.array(comp))).sum())
            yield pa.RecordBatch.from_arrays([pa.array([there], pa.int64()), pa.array([found], pa.int64())], names=["there", "found"])

    got = nodes.select("label", "dim", "nid", "comp", "v").mapInArrow(test, "there long, found long").agg(F.sum("there"), F.sum("found")).first()
    return got[1] / got[0] if got[0] else 1.0


def near_links(
    rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, neighbours: int = 8, orders: int = 4, audit: int = 1024, recall: float = 0.99, seed: int = 13
) -> DataFrame:
    """Every row with its near duplicates of the same label: (id, n_links, component_id, kept).

    ``n_links`` counts the other rows found linked directly: rows of an equal label
    whose cosine, in double precision, is ``threshold`` or more.  ``component_id`` is
    the smallest id that links reach, the row's own included; ``kept`` says that it
    is the row's own.  No pair below the threshold is linked; pairs above it are found
    by descent, which may miss some: ``audit`` nodes are held against all others, and
    work goes on until at least ``recall`` of their links are found.

    A row whose vector is null, empty, zero or holds null or non-finite entries, or
    whose label is null, links with nothing.  Vectors of different lengths do not link.
    Rows that share an id are rows of their own; null ids are kept and are no
    component's smallest unless it has no other.  An empty table gives no rows.  Other
    columns are not read.
    """
    spark = rows.sparkSession
    X.prepare(spark)
    kind = np.float32 if "float" in rows.schema[vector_col].dataType.simpleString() else np.float64
    picked = rows.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vec"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v: list[bytes | None] = [None] * b.num_rows
            for at, x in usable(b, "vec", kind):
                for k, row in zip(at, x, strict=True):
                    v[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(v, pa.binary())], names=["id", "label", "v"])

    id_type = rows.schema[id_col].dataType.simpleString()
    packed = picked.mapInArrow(pack, f"id {id_type}, label string, v binary")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v").to_pylist()
            dims = np.array([len(x) // np.dtype(kind).itemsize for x in v], int)
            for d in np.unique(dims):
                at = np.nonzero(dims == d)[0]
                some = b.take(pa.array(at))
                q, slack = _sketch(_bytes(some.column("v").to_pylist(), kind).astype(float))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("nid", "label", "v", "mult", "first")), pa.array(np.full(len(at), d), pa.int32()), pa.array([x.tobytes() for x in q], pa.binary()), pa.array(slack)], names=["nid", "label", "v", "mult", "first", "dim", "q", "slack"])

    classes = packed.filter("label is not null and v is not null").groupBy("label", "v").agg(F.count("*").alias("mult"), F.min("id").alias("first"))
    numbered = X.checkpoint(classes.withColumn("nid", F.monotonically_increasing_id()))  # numbers that no later task deals anew
    base = X.checkpoint(numbered.select("nid", "label", "v", "mult", "first").mapInArrow(sketch, f"nid long, label string, v binary, mult long, first {id_type}, dim int, q binary, slack double"))

    k, pass_no = neighbours, 0
    nodes = base.withColumns({"comp": F.col("nid"), "saturated": F.lit(False)})
    links = lists = None
    while True:
        begun = _fresh(_beside(nodes, k, threshold, orders, seed + pass_no))
        lists = X.checkpoint(_kept(begun if lists is None else lists.unionByName(begun), k))
        turn = 0
        while True:
            before = lists.filter("near").count()
            lists, turn = X.checkpoint(_round(lists, nodes, k, threshold, turn)), turn + 1
            if turn > 1 and lists.filter("near").count() <= before:
                more = X.checkpoint(_verified(lists, nodes, kind, threshold))
                if more.isEmpty():
                    break
                links = more if links is None else X.checkpoint(links.union(more))
                labels = components(links).select(F.col("node").alias("nid"), F.col("label").alias("comp"))
                full = lists.groupBy("u").agg(F.count("*").alias("held"), F.min("near").alias("near")).filter((F.col("held") >= k) & F.col("near")).select(F.col("u").alias("nid"), F.lit(True).alias("saturated"))
                nodes = X.checkpoint(base.join(labels, "nid", "left").join(full, "nid", "left").withColumns({"comp": F.coalesce("comp", "nid"), "saturated": F.coalesce("saturated", F.lit(False))}))
                if nodes.filter("saturated").isEmpty():
                    break
                ends = [nodes.select(F.col("nid").alias(n), F.col("comp").alias(f"c{n}")) for n in ("u", "v")]
                lists = lists.join(ends[0], "u").join(ends[1], "v").withColumns({"inside": F.col("cu") == F.col("cv"), "new": F.lit(False)}).drop("cu", "cv")
                lists, turn = X.checkpoint(_kept(lists.unionByName(_fresh(_at_random(nodes, k, threshold, seed + turn + pass_no))), k)), 0
        share = _audited(nodes, kind, threshold, audit, seed + pass_no)
        if share >= recall:
            break
        k, pass_no = 2 * k, pass_no + 1

    within = nodes.join(_links_within(nodes, kind, threshold), "nid", "left")
    least = nodes.groupBy("comp").agg(F.min("first").alias("least"))
    judged = within.join(least, "comp").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "least")
    out = packed.join(judged, ["label", "v"], "left")
    own = F.coalesce("least", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))
