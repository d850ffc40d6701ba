"""Packed exchanges: moving 64-bit keys between tasks as arrays instead of rows.

A deduplication step has to learn, for billions of small keys, which of them
occur more than once.  One Spark row for each key costs several times the key
itself, so keys travel in blobs: a map task sorts its keys by bucket and emits
one row for each bucket and flush, holding parallel arrays.  There is a bucket
for each shuffle partition, labelled so that Spark's hash deals it there; a
task's memory is its share of the keys, which ``spark.sql.shuffle.partitions``
sets.

Layout of a packed row: ``bucket``, ``ids`` (int64 unit ids, one for each run of
keys of the same unit), ``runs`` (uint64: the run's length, and above it 32 bits
that tag the unit) and ``keys`` (the low ``width`` bytes of uint64), with optional
``aux`` arrays that are parallel to the keys; plain uint32 ones travel as differences, which compress.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PACKED = "bucket int, ids binary, runs binary, keys binary, aux binary"
#: Keys that a map task holds before it emits them.
FLUSH_KEYS = 1_500_000
#: Rows and bytes of text that one Arrow batch may hold.
BATCH_ROWS = 500


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small, as rows hold whole texts, and let executors import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_palimpsest_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp()) / "palimpsest_llm.zip"
    with zipfile.ZipFile(target, "w") as z:
        z.write(top / "__init__.py", "palimpsest/__init__.py")
        for p in sorted((top / "llm").glob("*.py")):
            z.write(p, f"palimpsest/llm/{p.name}")
    sc.addPyFile(str(target))
    sc._palimpsest_shipped = True


def checkpoint(df: DataFrame, name: str = "") -> DataFrame:
    """Cut the lineage with files in the shared checkpoint folder.

    The folder is ``spark.checkpoint.dir`` of the session.  Only a local session may
    leave that unset; it gets a folder of its own.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="palimpsest-checkpoints-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: equal inputs give equal, well spread names."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash (Murmur3, seed 42) of ints."""
    def turn(v: np.ndarray, n: int) -> np.ndarray:
        return (v << np.uint32(n)) | (v >> np.uint32(32 - n))

    k = turn(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = turn(k ^ np.uint32(42), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(by)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def labels(n: int) -> np.ndarray:
    """For each of n partitions, an int that Spark deals to it."""
    found, x = np.full(n, -1, np.int64), np.arange(max(1024, 24 * n))
    while (found < 0).any():
        to = _spark_hash(x).astype(np.int64) % n
        found[to[::-1]] = x[::-1]
        x = np.arange(2 * len(x))
    return found.astype(np.int32)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _differ(aux: np.ndarray) -> np.ndarray:
    return np.diff(aux, prepend=np.uint32(0)) if aux.dtype == np.uint32 else aux


class Packer:
    """Gathers (id, keys, aux) of units and yields packed batches by bucket."""

    def __init__(self, buckets: int, width: int = 8):
        self.buckets, self.width, self.n, self.parts, self.labels = buckets, width, 0, [], labels(buckets)

    def add(self, ids: np.ndarray, keys: np.ndarray, aux: np.ndarray | None = None, tags: np.ndarray | int = 0, route: np.ndarray | None = None) -> None:
        """Parallel arrays; the keys of a unit are contiguous.  Buckets follow ``route``, or else the keys."""
        if len(keys):
            self.parts.append((ids, keys, aux, np.full(len(keys), tags, np.uint32) if np.isscalar(tags) else tags, bucket_of(keys if route is None else route, self.buckets)))
            self.n += len(keys)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        ids, keys, tags, bucket = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1, 3, 4))
        aux = None if self.parts[0][2] is None else np.concatenate([p[2] for p in self.parts])
        self.parts, self.n = [], 0
        order = np.argsort(bucket, kind="stable")
        ids, keys, tags, bucket = ids[order], keys[order], tags[order], bucket[order]
        aux = None if aux is None else aux[order]
        edges = np.searchsorted(bucket, np.arange(self.buckets + 1))
        cols: list[list] = [[], [], [], [], []]
        for b in np.nonzero(np.diff(edges))[0]:
            lo, hi = edges[b], edges[b + 1]
            own = ids[lo:hi]
            cut = np.concatenate(([0], np.nonzero(own[1:] != own[:-1])[0] + 1, [hi - lo]))
            row = (int(self.labels[b]), own[cut[:-1]].tobytes(), (np.diff(cut).astype(np.uint64) | tags[lo:hi][cut[:-1]].astype(np.uint64) << np.uint64(32)).tobytes(), keys[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.width].tobytes(), b"" if aux is None else _differ(aux[lo:hi]).tobytes())
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "ids", "runs", "keys", "aux"])

    def full(self) -> Iterator[pa.RecordBatch]:
        if self.n >= FLUSH_KEYS:
            yield from self.flush()


def unpack(batches: Iterator[pa.RecordBatch], aux_type: np.dtype | None = None, width: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """All of a partition's packed rows as parallel (ids, keys, aux, tags)."""
    ids, keys, aux, tags = [], [], [], []
    for b in batches:
        for i, r, k, a in zip(b.column("ids"), b.column("runs"), b.column("keys"), b.column("aux"), strict=True):
            runs = np.frombuffer(r.as_py(), np.uint64)
            n = (runs & np.uint64(0xFFFFFFFF)).astype(np.int64)
            ids.append(np.repeat(np.frombuffer(i.as_py(), np.int64), n))
            tags.append(np.repeat((runs >> np.uint64(32)).astype(np.uint32), n))
            whole = np.zeros((int(n.sum()), 8), np.uint8)
            whole[:, :width] = np.frombuffer(k.as_py(), np.uint8).reshape(-1, width)
            keys.append(whole.view(np.uint64).ravel())
            if aux_type is not None:
                got = np.frombuffer(a.as_py(), aux_type)
                aux.append(np.cumsum(got, dtype=np.uint32) if got.dtype == np.uint32 else got)
    if not ids:
        return np.empty(0, np.int64), np.empty(0, np.uint64), None if aux_type is None else np.empty(0, aux_type), np.empty(0, np.uint32)
    return np.concatenate(ids), np.concatenate(keys), np.concatenate(aux) if aux_type is not None else None, np.concatenate(tags)


def exchange(packed: DataFrame) -> DataFrame:
    return packed.repartition(partitions(packed.sparkSession), "bucket")


def scatter(units: DataFrame, extract: Callable[[pa.RecordBatch], Iterator[tuple]], width: int = 8) -> DataFrame:
    """Rows of ``units`` to packed rows by key; ``extract`` yields (id, keys, aux[, tag[, route]]) for each unit."""
    buckets = partitions(units.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets, width)
        for batch in batches:
            for unit, keys, aux, *tag in extract(batch):
                packer.add(np.full(len(keys), unit, np.int64), keys, aux, *tag)
            yield from packer.full()
        yield from packer.flush()

    return units.mapInArrow(run, PACKED)


def gather(packed: DataFrame, judge: Callable[..., tuple], aux_type: np.dtype | None, width: int = 8) -> DataFrame:
    """By key: ``judge(ids, keys, aux, tags)`` sees all occurrences of its keys and returns (ids, values, aux, tags) to send back to the units."""
    buckets = partitions(packed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, aux, tags = unpack(batches, aux_type, width)
        if len(keys):
            back, values, more, marks = judge(ids, keys, aux, tags)
            del ids, keys, aux, tags
            order = np.argsort(back, kind="stable")
            packer = Packer(buckets)
            packer.add(back[order], values[order], None if more is None else more[order], 0 if marks is None else marks[order], mix(back[order].view(np.uint64)))
            yield from packer.flush()

    return exchange(packed).mapInArrow(run, PACKED)


def returned(packed: DataFrame, finish: Callable[..., Iterator[pa.RecordBatch]], schema: str, aux_type: np.dtype | None = None) -> DataFrame:
    """By unit: ``finish(ids, values, aux, tags)`` sees all values of its units, sorted by id and value, and yields rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, aux, tags = unpack(batches, aux_type)
        if len(ids):
            order = np.lexsort((values, ids))
            yield from finish(ids[order], values[order], None if aux is None else aux[order], tags[order])

    return exchange(packed).mapInArrow(run, schema)


def rows_of(ids: np.ndarray, values: np.ndarray, dtype: type, *, name: str = "vals", rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """One row for each id with its values as bytes; ids are sorted."""
    cut = np.concatenate(([0], np.nonzero(ids[1:] != ids[:-1])[0] + 1, [len(ids)]))
    values = values.astype(dtype)
    for k in range(0, len(cut) - 1, rows):
        part = range(k, min(k + rows, len(cut) - 1))
        yield pa.RecordBatch.from_arrays([pa.array(ids[cut[k : part[-1] + 1]], pa.int64()), pa.array([values[cut[j] : cut[j + 1]].tobytes() for j in part], pa.binary())], names=["uid", name])
