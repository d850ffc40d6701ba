"""An approximate vector index: coarse cells, several probed, exact reranking, and a gate on its recall.

Centroids are fitted on a bounded sample; every row lies in the cell of its nearest
centroid.  A query reads the cells of its nearest centroids and ranks their rows by
exact cosine.  How many cells are probed follows from an audit: it is doubled until
the audited queries' true neighbours lie in probed cells by the wanted share.  An index below its
gate cannot be published.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.operators.search import exact_neighbours, usable_vectors
from palimpsest.session import checkpoint

#: Most rows of the sample that the driver fits centroids on, and most cells.
SAMPLE, CELLS = 100_000, 4096
#: Rows that a task sends on at a time, each with one of its cells.
SENT = 1 << 15


class RecallBelowGate(ValueError):
    """The index finds too few of the true neighbours to be used."""


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def fit_centroids(x: np.ndarray, cells: int, *, rounds: int = 10, seed: int = 42) -> np.ndarray:
    """Spherical k-means: unit centroids; a cell that loses its rows starts again at a row."""
    rng = np.random.default_rng(seed)
    x = _unit(x)
    c = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        own = _nearest_cells(x, c, 1)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.sqrt((sums * sums).sum(axis=1))
        empty = norm < 1e-12
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = _unit(sums)
    return c


def _nearest_cells(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    near = np.empty((len(x), n), np.int64)
    for k in range(0, len(x), 4096):  # a strip of the products at a time
        s = x[k : k + 4096] @ centroids.T
        near[k : k + 4096] = s.argmax(axis=1)[:, None] if n == 1 else np.argsort(-s, axis=1, kind="stable")[:, :n]
    return near


@dataclass
class VectorIndex:
    """``rows`` are (key, vector, cell); ``recall`` is what the audit found with ``probes`` cells."""

    key: str
    vector: str
    centroids: np.ndarray
    rows: DataFrame
    probes: int
    recall: float
    gate: float

    def search(self, queries: DataFrame, k: int = 10, *, probes: int | None = None) -> DataFrame:
        """(query_id, key, score, rank): each query's k nearest rows of the probed cells; a query is no neighbour of itself.

        All cells are all rows, so no query is repeated for each of them.
        """
        probes = min(probes or self.probes, len(self.centroids))
        if probes == len(self.centroids):
            return exact_neighbours(self.rows, queries, self.key, self.vector, k)
        asked = _placed(queries, self.key, self.vector, self.centroids, probes)
        return exact_neighbours(self.rows, asked, self.key, self.vector, k, cell="cell")

    def publish(self, path: str) -> None:
        """Write the index for :func:`load`; raises if its recall is below the gate."""
        if self.recall < self.gate:
            raise RecallBelowGate(f"recall {self.recall:.3f} is below {self.gate}")
        spark = self.rows.sparkSession
        self.rows.repartition("cell").sortWithinPartitions("cell", self.key).write.partitionBy("cell").mode("overwrite").parquet(f"{path}/rows")
        centres = [(i, c.tolist()) for i, c in enumerate(self.centroids)]
        spark.createDataFrame(centres, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        # written last: an index without it is not finished
        spark.createDataFrame([(self.key, self.vector, self.probes, self.recall, self.gate)], "key string, vector string, probes int, recall double, gate double").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> VectorIndex:
    m = spark.read.parquet(f"{path}/manifest").first()
    centres = sorted((r.cell, r.centre) for r in spark.read.parquet(f"{path}/centroids").collect())  # at most CELLS rows
    return VectorIndex(m.key, m.vector, np.array([c for _, c in centres]), spark.read.parquet(f"{path}/rows"), m.probes, m.recall, m.gate)


def _placed(rows: DataFrame, key: str, vector: str, centroids: np.ndarray, n: int) -> DataFrame:
    """Usable rows of the centroids' length with each of their n nearest cells."""
    kinds = dict(rows.dtypes)
    width = centroids.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(vector).flatten().cast(pa.float64())).reshape(-1, width)
                step = max(SENT // n, 1)
                for k in range(0, len(x), step):
                    part = x[k : k + step]
                    each = pa.array(np.repeat(np.arange(k, k + len(part)), n))
                    yield pa.RecordBatch.from_arrays([b.column(key).take(each), b.column(vector).take(each), pa.array(_nearest_cells(part, centroids, n).ravel().astype(np.int32))], names=[key, vector, "cell"])

    fit = usable_vectors(rows.select(key, vector), vector).filter(F.size(vector) == width)
    return fit.mapInArrow(place, f"{key} {kinds[key]}, {vector} {kinds[vector]}, cell int")


def build(rows: DataFrame, key: str, vector: str, *, cells: int | None = None, sample: int = SAMPLE, audit: int = 100, k: int = 10, gate: float = 0.95, seed: int = 42) -> VectorIndex:
    """Index all rows whose vector has the commonest length and is neither null, zero, nor not finite.

    Cells number the root of the rows, at most ``CELLS``.  ``sample`` rows fit them and
    ``audit`` rows set the probes, both chosen by a hash of the key.
    """
    good = usable_vectors(rows.select(key, vector), vector)
    sizes = good.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        raise ValueError("no row has a usable vector")
    cells = cells or min(CELLS, int(np.ceil(np.sqrt(sizes.n))))
    same = good.filter(F.size(vector) == sizes.d)
    drawn = same.orderBy(F.xxhash64(key, F.lit(seed)), key)
    x = np.array([r[0] for r in drawn.select(vector).limit(min(sample, max(64 * cells, 1000))).collect()], float)
    centroids = fit_centroids(x, min(cells, len(x)), seed=seed)
    index = VectorIndex(key, vector, centroids, checkpoint(_placed(same, key, vector, centroids, 1)), min(4, len(centroids)), 0.0, gate)
    asked = checkpoint(same.orderBy(F.xxhash64(key, F.lit(seed + 1)), key).limit(audit))
    exact = exact_neighbours(same, asked, key, vector, k).select("query_id", key)
    cells_of = exact.join(index.rows.select(key, "cell"), key).select("query_id", "cell").collect()  # at most audit * k rows
    asked = asked.select(key, vector).collect()
    order = _nearest_cells(np.array([r[1] for r in asked], float), centroids, len(centroids))
    turn = {r[0]: np.argsort(order[i]) for i, r in enumerate(asked)}  # when a cell is probed
    turns = np.array([turn[q][cell] for q, cell in cells_of], int)
    while True:  # a true neighbour is found if and only if its cell is probed
        index.recall = float((turns < index.probes).mean()) if len(turns) else 1.0
        if index.recall >= gate or index.probes == len(centroids):
            return index
        index.probes = min(2 * index.probes, len(centroids))
