"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import exchange as X


def local_components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node that each reaches, for edges held in memory."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        old = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == old).all():
            return nodes, nodes[label]


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long edges to (node, label): the least node of each component.

    Alternates large-star and small-star steps, which need a logarithmic number of
    rounds, and stops when a round changes nothing; each round is a checkpoint.  Nodes without an edge do not appear.  The
    joins are plain equi-joins whose hot keys (centres of stars) the adaptive
    skew join splits.  Self-edges and nulls are ignored; an empty table gives an
    empty result.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = X.checkpoint(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now = state(e)
    while now[0]:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).filter("u <> v").distinct()
        new = X.checkpoint(small)
        before, now, e = now, state(new), new
        if now == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
