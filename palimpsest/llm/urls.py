"""URL filters: host and path rules, and a character language-model ratio for the rest.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, give
each character a probability after up to ``ORDER`` characters, interpolated down
to order 0.  A URL is blocked if the difference of its log-likelihoods, for each
character, lies below a threshold.  The threshold is calibrated on hosts that
were not trained on, so that at most ``false_blocks`` of their accepted URLs go;
the models that judge are then fitted to all hosts.

Training labels are distant: a URL whose host holds one of ``rejected_words`` is a
rejected example and all others are accepted ones.  Counts are exact and cover
every URL of the table: a context of up to five bytes and its character make one
number, counted by DataFrames that grow with the input.  Chunks of URLs ask for
the n-grams that they hold, each once, and are scored with the answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import exchange as X

ORDER = 5
#: Weight of the shorter context, in characters.
PRIOR = 2.0
#: Patterns of words in host names that mark rejected examples.
REJECTED_WORDS = (r"\bads?\b", r"\btrack(?:er|ing)?\b", "adult", "bets", "casino", "cheap", "click", "dating", "escort", "farm", "free", "gambl", "loan", "lottery", "pills", "poker", "porn", "replica", "sex", "spam", "viagra", "warez", "xxx")
#: Scores are cut to +-RANGE and counted in BINS for calibration.
RANGE, BINS = 16.0, 1 << 14
HELD_OUT = 5
#: URLs that are scored together (a power of two), and distinct n-grams that a task holds before it emits them.
CHUNK, HELD_GRAMS = 1 << 12, 2_000_000


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(verdict, rule), or null; of equally long rules the first given."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each character with the ORDER bytes before it, as one number whose lowest byte is the character; and its text."""
    size = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(b"\2" * ORDER + t for t in texts), np.uint8).astype(np.int64)
    first = np.cumsum(size + ORDER) - size
    at = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    gram = np.zeros(len(at), np.int64)
    for k in range(ORDER + 1):
        gram |= flat[at - k] << (8 * k)
    return gram, np.repeat(np.arange(len(texts)), size)


def _texts(b: pa.RecordBatch | pa.Table) -> list[bytes]:
    return [(h + p).encode() for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]


#: Counts of n-grams in accepted and rejected URLs, without the held-out ones and of these alone.
_CLASSES = ["a", "r", "held_a", "held_r"]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, counts by class) of rows (host, path, rejected, held_out), summed within the task."""

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held >> 2), *(pa.array(np.where(held & 3 == c, n, 0)) for c in range(4))], names=["gram", *_CLASSES])

    held, n = np.empty(0, np.int64), np.empty(0, np.int64)
    for b in batches:
        gram, of = _grams(_texts(b))
        kind = (np.asarray(b.column("rejected").cast(pa.int64())) + 2 * np.asarray(b.column("held_out").cast(pa.int64())))[of]
        new, times = np.unique(gram << 2 | kind, return_counts=True)
        held, at = np.unique(np.concatenate((held, new)), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate((n, times)), minlength=len(held)).astype(np.int64)
        if len(held) > HELD_GRAMS:
            yield emit()
            held, n = np.empty(0, np.int64), np.empty(0, np.int64)
    yield emit()


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct (chunk, gram) of rows (chunk, host, path), whose chunks follow each other."""

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(held), now)), pa.array(held)], names=["chunk", "gram"])

    now, held = -1, np.empty(0, np.int64)
    for b in batches:
        chunk = b.column("chunk").to_numpy()
        gram, of = _grams(_texts(b))
        for c in np.unique(chunk).tolist():
            if c != now:
                yield emit()
                now, held = c, np.empty(0, np.int64)
            held = np.union1d(held, gram[chunk[of] == c])
    yield emit()


def gains(grams: DataFrame) -> DataFrame:
    """(gram, all_gain, train_gain): log-likelihood differences, accepted less rejected, of all URLs' models and of those without the held-out ones."""
    level = [X.checkpoint(grams.select(F.col("gram").alias("key"), F.col("a").alias("n0"), F.col("r").alias("n1"), (F.col("a") + F.col("held_a")).alias("n2"), (F.col("r") + F.col("held_r")).alias("n3")))]
    for k in range(ORDER - 1, -1, -1):  # a shorter context's counts are sums of the longer ones'
        level.insert(0, X.checkpoint(level[0].groupBy(F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("key")).agg(*(F.sum(f"n{j}").alias(f"n{j}") for j in range(4)))))
    out = None
    for k, counts in enumerate(level):  # at most 256 rows have a context or a shorter n-gram in common
        context = Window.partitionBy(F.shiftright("key", 8))
        rows = counts.select("key", F.col("key").bitwiseAND((1 << 8 * k) - 1).alias("low"), *(F.col(f"n{j}") for j in range(4)), *(F.sum(f"n{j}").over(context).alias(f"m{j}") for j in range(4)))
        rows = rows.withColumns({f"q{j}": F.lit(1 / 256) for j in range(4)}) if out is None else rows.join(out, "low")
        out = rows.select(F.col("key").alias("low"), *(((F.col(f"n{j}") + PRIOR * F.col(f"q{j}")) / (F.col(f"m{j}") + PRIOR)).alias(f"q{j}") for j in range(4)))
    return out.select(F.col("low").alias("gram"), (F.log("q2") - F.log("q3")).alias("all_gain"), (F.log("q0") - F.log("q1")).alias("train_gain"))


def _scored(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """Mean gains of a character for each row of a chunk; 0 for an empty text."""
    order = np.argsort(answers.column("gram").to_numpy())
    known = answers.column("gram").to_numpy()[order]
    gain = [answers.column(c).to_numpy()[order] for c in ("all_gain", "train_gain")]
    found: list[list[np.ndarray]] = [[], []]
    for b in rows.to_batches(max_chunksize=X.BATCH_ROWS):
        gram, of = _grams(_texts(b))
        at, n = np.searchsorted(known, gram), np.maximum(np.bincount(of, minlength=b.num_rows), 1)
        for out, g in zip(found, gain, strict=True):
            out.append(np.bincount(of, weights=g[at], minlength=b.num_rows) / n)
    names = ["id", "host", "path", "rejected", "held_out"]
    return pa.table([*(rows.column(c) for c in names), *(pa.array(np.concatenate(f) if f else np.empty(0)) for f in found)], names=[*names, "score", "train_score"])


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", rejected_words: tuple[str, ...] = REJECTED_WORDS, false_blocks: float = 0.01) -> DataFrame:
    """(id_col, host, path, rule, verdict, score): the longest fitting rule's verdict, else the models'.

    A null URL, or one without ``://``, has an empty host and path; it has score 0.
    Without rejected examples in the table the models allow everything.  Rows are
    judged one by one, so repeated rows and null ids are kept, and other columns
    are left out; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    X.prepare(spark)
    url = F.col(url_col).cast("string")
    parts = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rejected = F.col("host").rlike("|".join(rejected_words)) if rejected_words else F.lit(False)
    chunk = F.shiftright(F.monotonically_increasing_id(), CHUNK.bit_length() - 1)
    parts = X.checkpoint(parts.select("*", rejected.alias("rejected"), (F.pmod(F.xxhash64("host"), HELD_OUT) == 0).alias("held_out"), chunk.alias("chunk")))
    counted = parts.select("host", "path", "rejected", "held_out").mapInArrow(_count, "gram long, " + ", ".join(f"{c} long" for c in _CLASSES))
    answers = gains(counted.groupBy("gram").agg(*(F.sum(c).alias(c) for c in _CLASSES)))
    asked = parts.select("chunk", "host", "path").mapInArrow(_asked, "chunk long, gram long").join(answers, "gram")
    schema = f"id {parts.schema['id'].dataType.simpleString()}, host string, path string, rejected boolean, held_out boolean, score double, train_score double"
    scored = X.checkpoint(parts.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(_scored, schema))
    told = scored.filter("host <> '' or path <> ''")
    bins = F.floor((F.least(F.greatest("train_score", F.lit(-RANGE)), F.lit(RANGE)) + RANGE) * (BINS / 2 / RANGE)).cast("int")
    seen = dict(told.filter("held_out and not rejected").groupBy(bins.alias("bin")).agg(F.count("*").alias("n")).collect())  # at most BINS rows
    limit = 0.0
    if not told.filter("rejected").isEmpty():
        allowed, gone = int(false_blocks * sum(seen.values())), 0
        for b in sorted(seen):
            gone += seen[b]
            if gone > allowed:
                limit = min(limit, b / (BINS / 2 / RANGE) - RANGE)
                break
    else:
        limit = -np.inf
    rule = longest_rule(F.col("host"), F.col("path"), rules)
    out = scored.withColumn("fit", rule)
    own = F.when(F.col("score") < F.lit(float(limit)), "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "score")
