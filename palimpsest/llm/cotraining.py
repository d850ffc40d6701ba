"""Quality classifier by co-training of a text view and a metadata view.

Each view is a logistic model over hashed features: the text view sees shapes of
words and ratios of a text's characters and words, the metadata view sees the
other columns.  Both start from the labelled documents.  In each round a view
labels the unlabelled documents of which it is confident, by calibrated
probability, and the other view learns from them.  In the end both views are
calibrated on held-out labels and combined: their log-odds add up beyond the
prior's.  Every document is scored.

Models start on the driver from at most ``max_labelled`` labelled documents, those
with the least hash of their id; the labels are read in full.  Every unlabelled
document takes part in each round: its features are computed once, and tasks sum
the gradient over all that the other view is confident of, in whole numbers, so
that the sums do not depend on the partitions.  A labelled document of the sample
stands for all labelled ones, so the views weigh alike at every size.  Scoring is
a map over all documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache, lru_cache
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import exchange as X

BITS = 14
_SHAPES = [(re.compile(p), r) for p, r in ((r"[A-ZÀ-ÖØ-Þ]+", "A"), (r"[a-zß-öø-ÿ]+", "a"), (r"[0-9]+", "0"), (r"([^Aa0])\1+", r"\1\1"))]
#: Words whose shape is told at once: capitals, small letters and one mark, each part possibly empty.
_PLAIN = re.compile(r"([A-ZÀ-ÖØ-Þ]*)([a-zß-öø-ÿ]*)([.,;:!?]?)")
_SHAPE_OF: dict[str, int] = {}
_LEVELS = 12
#: Steps over all confident documents in a round, weight of a pseudo-label, and unit of the gradients' sums.
STEPS, PSEUDO, UNIT = 10, 0.3, float(1 << 30)


@lru_cache(1 << 14)
def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) & ((1 << BITS) - 1)


def _shape(word: str) -> int:
    slot = _SHAPE_OF.get(word)
    if slot is None:
        if plain := _PLAIN.fullmatch(word):
            shape = "A" * bool(plain[1]) + "a" * bool(plain[2]) + plain[3]
        else:
            shape = word
            for pattern, by in _SHAPES:
                shape = pattern.sub(by, shape)
        slot = _slot("s" + shape)
        if len(_SHAPE_OF) > 150_000:
            _SHAPE_OF.clear()
        _SHAPE_OF[word] = slot
    return slot


@cache
def _kinds() -> np.ndarray:
    """For each code point: 1 for a letter, 2 more for an upper-case one."""
    points = list(map(chr, range(0x110000)))
    return np.fromiter(map(str.isalpha, points), np.uint8, len(points)) | np.fromiter(map(str.isupper, points), np.uint8, len(points)) << 1


def text_features(text: str) -> dict[int, float]:
    """Slots and weights; an empty text has the bias and a mark of its own."""
    words = text.split()
    out = {_slot("bias"): 1.0}
    if not words:
        return out | {_slot("empty"): 1.0}
    n, times = len(words), Counter(words)
    shapes: dict[int, int] = {}
    for s, c in zip(map(_shape, times), times.values(), strict=True):
        shapes[s] = shapes.get(s, 0) + c
    for s, c in shapes.items():
        out[s] = out.get(s, 0.0) + (c / n) ** 0.5
    kinds = np.bincount(_kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")], minlength=4).tolist()
    letters = kinds[1] + kinds[3] or 1
    ratios = {
        "upper": (kinds[2] + kinds[3]) / letters,
        "letters": letters / len(text),
        "distinct": len(times) / n,
        "again": sum(map(eq, words, islice(words, 1, None))) / n,
        "long": sum(c for w, c in times.items() if len(w) > 20) / n,
        "lines": len(set(lines := text.split("\n"))) / len(lines),
        "size": min(np.log2(n + 1) / 16, 1.0),
    }
    for name, r in ratios.items():  # soft steps: the share's level and the next
        at = r * _LEVELS
        low = int(at)
        for level, w in ((low, 1 - (at - low)), (low + 1, at - low)):
            k = _slot(f"{name}{level}")
            out[k] = out.get(k, 0.0) + w
    return out


def metadata_features(values: dict[str, object]) -> dict[int, float]:
    """A slot for each column's value; numbers by their magnitude, nulls as a value of their own."""
    out = {_slot("bias"): 1.0}
    for name, v in values.items():
        level = f"2^{int(np.log2(abs(v) + 1))}" if isinstance(v, (int, float)) and not isinstance(v, bool) and np.isfinite(v) else str(v)
        out[_slot(f"m{name}={level}")] = 1.0
    return out


class Sparse:
    """Rows of (slot, weight) features."""

    def __init__(self, rows: list[dict[int, float]]):
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.slot = np.array([k for r in rows for k in r], np.int64)
        self.value = np.array([v for r in rows for v in r.values()])

    def packed(self) -> list[bytes]:
        return [np.bincount(self.row, minlength=self.n).astype("<i4").tobytes(), self.slot.astype("<u2").tobytes(), self.value.astype("<f4").tobytes()]

    @classmethod
    def unpacked(cls, sizes: bytes, slots: bytes, values: bytes) -> Sparse:
        out = cls([])
        size = np.frombuffer(sizes, "<i4")
        out.n, out.row = len(size), np.repeat(np.arange(len(size)), size)
        out.slot, out.value = np.frombuffer(slots, "<u2").astype(np.int64), np.frombuffer(values, "<f4").astype(float)
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * w[self.slot], minlength=self.n)

    def sums(self, error: np.ndarray) -> np.ndarray:
        return np.bincount(self.slot, weights=self.value * error[self.row], minlength=1 << BITS)


class Logistic:
    """Logistic regression by Adam on the full gradient; later steps go on from the earlier ones."""

    def __init__(self):
        self.w, self.m, self.v = (np.zeros(1 << BITS) for _ in range(3))
        self.t = 0

    def step(self, gradient: np.ndarray, *, ridge: float = 1e-4) -> None:
        g = gradient + ridge * self.w
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.99 * self.v + 0.01 * g * g
        self.w = self.w - 0.1 * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's slope and offset of log-odds, by Newton steps with smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * z + b)
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        s = p * (1 - p)
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(a), 0.0), float(b)


def cotrain(views: list[list[dict]], labels: np.ndarray, gather: Callable, *, rounds: int, pseudo: float, held: np.ndarray) -> tuple[list[np.ndarray], list[tuple[float, float]], float]:
    """Weights and calibrations of both views, and the prior's log-odds.

    ``labels`` are 1 or 0.  ``gather(weights, fits, now)`` gives, for each view, the
    sum of the gradient at ``now`` over the unlabelled documents of which the other
    view is confident by ``weights`` and ``fits``, and their number.
    """
    data = [Sparse(v) for v in views]
    known = ~held
    prior = float(np.log((labels[known].sum() + 1) / ((labels[known] == 0).sum() + 1)))
    check = held if len(set(labels[held])) == 2 else known
    models = [Logistic() for _ in data]

    def own(k: int) -> np.ndarray:
        return data[k].sums((_sigmoid(data[k].dot(models[k].w)) - labels) * known)

    for _ in range(150):
        for k, model in enumerate(models):
            model.step(own(k) / max(known.sum(), 1))
    for r in range(rounds + 1):
        weights = [model.w for model in models]
        fits = [calibrated(d.dot(w)[check], labels[check]) for d, w in zip(data, weights, strict=True)]
        if r == rounds:
            return weights, fits, prior
        for _ in range(STEPS):
            others = gather(weights, fits, [model.w for model in models])
            for k, (model, (sums, n)) in enumerate(zip(models, others, strict=True)):
                model.step((own(k) + pseudo * sums) / (known.sum() + pseudo * n))


def confident_sums(views: list[Sparse], weights: list[np.ndarray], fits: list[tuple[float, float]], now: list[np.ndarray], confident: float) -> tuple[np.ndarray, np.ndarray]:
    """For each view: the gradient summed over the rows of which the other view is confident, in units, and their number."""
    total, n = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for own in (0, 1):
        a, b = fits[1 - own]
        p = _sigmoid(a * views[1 - own].dot(weights[1 - own]) + b)
        sure = (p >= confident) | (p <= 1 - confident)
        error = (_sigmoid(views[own].dot(now[own])) - (p > 0.5)) * sure
        each = np.rint(views[own].value * error[views[own].row] * UNIT)
        total[own] = np.bincount(views[own].slot, weights=each, minlength=1 << BITS).astype(np.int64)
        n[own] = sure.sum()
    return total, n


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: tuple[str, ...] = ("lang", "source", "n_chars"), max_labelled: int = 12_000, rounds: int = 3, confident: float = 0.97, threshold: float = 0.5) -> DataFrame:
    """Every column of ``docs`` with ``quality_score`` (0 to 1), ``quality_text``, ``quality_metadata`` and ``keep``.

    ``labels`` holds (id_col, label_col); several labels of an id count by majority,
    and a tie or a null is no label.  Without labels of both kinds every score is
    the prior and every document is kept.  Null and empty texts are scored like
    others.  Columns of ``docs`` that have the new names are replaced.  Repeated
    rows are each scored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    X.prepare(spark)
    new = ["quality_score", "quality_text", "quality_metadata", "keep"]
    docs = docs.drop(*new)
    metadata = tuple(c for c in metadata if c in docs.columns and c not in (id_col, text_col))
    told = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).dropna().groupBy("id").agg(F.avg("y").alias("y")).filter("y <> 0.5").select("id", (F.col("y") > 0.5).cast("int").alias("y"))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(_plain(c) for c in metadata))
    ids = slim.select("id").join(told, "id").withColumn("pick", F.xxhash64(F.lit("sample"), "id"))
    sample = ids.orderBy("pick", "id").limit(max_labelled).dropDuplicates(["id"])
    # at most max_labelled rows: of rows that share an id one stands for all
    given = F.struct("pick", "y", "text", *metadata)
    chosen = slim.join(F.broadcast(sample), "id").groupBy("id").agg(F.min_by(given, F.xxhash64("text", *metadata)).alias("g")).select("g.*")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = _features(b, metadata)
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("pick"), *(pa.array([np.array([list(r), list(r.values())]).astype("<f8").tobytes() for r in v], pa.binary()) for v in got)], names=["y", "pick", "a", "b"])

    rows = sorted(map(tuple, chosen.mapInArrow(features, "y int, pick long, a binary, b binary").collect()), key=lambda r: r[1:])
    views = [[dict(zip(*np.frombuffer(r[k], "<f8").reshape(2, -1), strict=True)) for r in rows] for k in (2, 3)]
    y = np.array([r[0] for r in rows], np.int64)
    model = None
    if len(set(y)) == 2:
        parts = [f"{view}{k}" for view in "ab" for k in range(3)]

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for v in _features(b, metadata) for x in Sparse(v).packed()], names=parts)

        # a merge join at every size: the labels grow with the input, so they are not broadcast
        rest = X.checkpoint(slim.join(told.hint("merge"), "id", "left_anti").mapInArrow(pack, ", ".join(f"{c} binary" for c in parts)))

        def gather(weights: list[np.ndarray], fits: list[tuple[float, float]], now: list[np.ndarray]) -> list[tuple[np.ndarray, int]]:
            given = spark.sparkContext.broadcast((weights, fits, now))

            def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total, n = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
                for b in batches:
                    for row in zip(*(b.column(c).to_pylist() for c in parts), strict=True):
                        got = confident_sums([Sparse.unpacked(*row[:3]), Sparse.unpacked(*row[3:])], *given.value, confident)
                        total, n = total + got[0], n + got[1]
                flat = np.concatenate((total.ravel(), n))
                at = np.nonzero(flat)[0]
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], names=["k", "n"])

            flat = np.zeros((2 << BITS) + 2)
            for k, n in rest.mapInArrow(add, "k int, n long").groupBy("k").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():  # at most 2 models' slots
                flat[k] = float(n)
            given.unpersist()
            return [(flat[k << BITS : (k + 1) << BITS] / UNIT, flat[(2 << BITS) + k]) for k in (0, 1)]

        held = np.arange(len(y)) % 4 == 0
        pseudo = PSEUDO * len(y) / max(ids.count(), 1)
        model = spark.sparkContext.broadcast(cotrain(views, y, gather, rounds=rounds, pseudo=pseudo, held=held))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    wanted = docs.withColumn("_q_text", F.col(text_col).cast("string")).withColumns({f"_q_{k}": _plain(c) for k, c in enumerate(metadata)})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_columns - 1 - len(metadata)
            own = pa.RecordBatch.from_arrays(b.columns[n:], names=["text", *metadata])
            if model is None:
                p = [np.full(b.num_rows, np.nan)] * 2
                s = np.full(b.num_rows, (y.mean() if len(y) else 1.0))
                keep = np.ones(b.num_rows, bool)
            else:
                weights, fits, prior = model.value
                z = [a * Sparse(v).dot(w) + c for v, w, (a, c) in zip(_features(own, metadata), weights, fits, strict=True)]
                p = [_sigmoid(x) for x in z]
                s = _sigmoid(z[0] + z[1] - prior)
                keep = s >= threshold
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(s), *map(pa.array, p), pa.array(keep)], names=[*b.schema.names[:n], *new])

    return wanted.mapInArrow(score, f"{fields}, quality_score double, quality_text double, quality_metadata double, keep boolean")


def _plain(column: str) -> Column:
    return F.col(f"`{column}`").cast("string").alias(column)


def _features(batch: pa.RecordBatch, metadata: tuple[str, ...]) -> tuple[list[dict], list[dict]]:
    def value(v: str | None) -> object:
        try:
            return float(v)
        except (TypeError, ValueError):
            return v

    text = [text_features(t or "") for t in batch.column("text").to_pylist()]
    columns = [[value(v) for v in batch.column(c).to_pylist()] for c in metadata]
    meta = [metadata_features(dict(zip(metadata, row, strict=True))) for row in zip(*columns, strict=True)] if metadata else [metadata_features({}) for _ in text]
    return text, meta
