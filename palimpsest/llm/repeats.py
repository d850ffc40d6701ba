"""Exact removal of long repeated passages: bytes by prefix doubling, words by recompression.

Both operators answer the same question: which windows of a fixed length (200
bytes, 35 words) start at more than one place in the corpus?  Shipping a name
for every window would move many times the text.  So each first names sparse,
locally consistent pieces, drops what is unique, and names windows only where
pieces are shared:

* ``suffix_array_dedup`` sorts ranks of sampled suffixes.  A window samples the
  position whose 16 bytes have the least fingerprint among its first ``SPREAD``
  positions, a choice that equal windows make alike.  Round one ranks prefixes of
  the sampled suffixes (about half the threshold); suffixes with a unique prefix
  leave.  Round two, at a growing offset, ranks all that the windows of a suffix
  cover; suffixes equal there are settled.  The last round ranks the windows at
  the ends of matches, at the full threshold.
* ``recompression_dedup`` names runs of equal words and then pairs (left and
  right symbols as told by a bit of the name), round after round.  Equal word
  sequences get equal symbols except near their ends, and the parse tracks how
  far each symbol depends on its surroundings.  A symbol that occurs once rules
  out every window that determines it; the other windows are verified.

Names are 64-bit fingerprints instead of dense ranks, so that a name needs no
global numbering and equal strings are named alike in all tasks.  Two different
windows that meet in a partition share a name with a chance of 2^-56.

Corner cases (both operators): null and empty texts have no windows and keep
nothing; texts shorter than a window keep everything; repeated rows count as
occurrences, so an exact copy of a long text loses every window; extra columns
are left out unless ``carry`` is set; an empty table gives an empty result.  A row is
known by a hash of its id and text, so equal ids with different texts are
separate rows, and rows with null ids take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import exchange as X

#: Bytes that a sampled position's fingerprint covers, and positions of which the least is sampled.
GRAM, SPREAD = 16, 96
_ROOT = np.uint64(0x9E3779B97F4A7C15)  # an odd multiplier for rolling fingerprints
_INVERSE = np.uint64(pow(int(_ROOT), -1, 2**64))
_BYTES = X.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: dict[str, np.ndarray] = {}
#: Window starts that are sampled at once, and the bits of a gram that rank it (the others hold its place).
_CHUNK, _HIGH = 1 << 22, np.uint64(2**64 - 2**24)


def _power(root: np.uint64, n: int) -> np.ndarray:
    """The first n powers of root, kept for later calls."""
    key = str(root)
    if len(_powers.get(key, ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        p = np.full(size, root, np.uint64)
        p[0] = 1
        _powers[key] = np.multiply.accumulate(p)
    return _powers[key][:n]


class Rolling:
    """Fingerprints of all substrings of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * _power(_ROOT, len(symbols)), out=self.sums[1:])
        self.back = _power(_INVERSE, len(symbols) + 1)

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return X.mix((self.sums[end] - self.sums[start]) * self.back[start])

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.back[:n]


def _sliding(x: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    """best over each w consecutive values, by block prefixes and suffixes."""
    n = len(x)
    pad = -n % w
    fill = x[-1]
    blocks = np.concatenate((x, np.full(pad, fill, x.dtype))).reshape(-1, w)
    front = best.accumulate(blocks, axis=1).ravel()
    rear = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(rear[: n - w + 1], front[w - 1 : n])


def sampled(roll: Rolling, windows: int, spread: int = SPREAD) -> tuple[np.ndarray, np.ndarray]:
    """The sampled position of each window start below ``windows``: the leftmost least gram of the ``spread`` grams from it.

    Returns the sampled positions and the first window start that each owns; the
    starts up to the next one's are its own.  What a window samples depends on
    nothing outside of it.
    """
    at, first = [], []
    for base in range(0, windows, _CHUNK):
        n = min(_CHUNK, windows - base)
        end = base + n + spread - 1
        grams = X.mix((roll.sums[base + GRAM : end + GRAM] - roll.sums[base:end]) * roll.back[base:end])
        ranked = (grams & _HIGH) | np.arange(end - base, dtype=np.uint64)  # of equal grams the leftmost is least
        own = (_sliding(ranked, spread, np.minimum) & ~_HIGH).astype(np.int64)
        new = np.concatenate(([0], np.nonzero(own[1:] != own[:-1])[0] + 1))
        at.append(own[new] + base)
        first.append(new + base)
    return np.concatenate(at), np.concatenate(first)


# ---------------------------------------------------------------- bytes


def _suffixes(data: bytes, threshold: int) -> tuple | None:
    """Sampled suffixes: first and last window start that each owns, the name of its prefix, the name of all that its windows cover."""
    if len(data) < threshold:
        return None
    roll = Rolling(_BYTES[np.frombuffer(data, np.uint8)])
    windows = len(data) - threshold + 1
    at, first = sampled(roll, windows)
    last = np.concatenate((first[1:], [windows])) - 1
    return first, last, roll.at(at, at + threshold - SPREAD + 1), roll.at(first, last + threshold), roll


#: Bytes of a name that travel.  Names are compared within a partition, those of windows in 56 bits; what is named
#: first in 48 bits is confirmed by longer names or by windows.
_WIDTH, _FULL = 6, 7
_AUX7 = np.dtype([("low", "<u4"), ("high", "<u2"), ("first", "<u4")])
#: Positions that one range holds; longer ranges are dealt as several.
LONGEST = 1 << 23
#: What a round says of a suffix: name its windows for others or itself; its windows are settled as repeated.
_NAME, _SETTLED = 1, 2


def _judge_suffixes(ids: np.ndarray, keys: np.ndarray, aux: np.ndarray, _: object) -> tuple:
    """Drop suffixes with a unique prefix; settle those whose longer name is shared; have the rest named in full."""
    longer = aux["low"].astype(np.uint64) | aux["high"].astype(np.uint64) << np.uint64(32)
    order = np.lexsort((longer, keys))
    ids, keys, aux, longer = ids[order], keys[order], aux[order], longer[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    group = np.cumsum(new) - 1
    many = np.bincount(group) > 1
    same = np.concatenate(([False], (~new[1:]) & (longer[1:] == longer[:-1])))
    settled = same.copy()
    settled[:-1] |= same[1:]
    open_ = np.bincount(group, weights=~settled) > 0
    keep = many[group]
    flag = settled * _SETTLED + open_[group] * _NAME
    value = (aux["first"].astype(np.uint64) << np.uint64(8)) | flag.astype(np.uint64)
    return ids[keep], value[keep], None, None


def _judge_windows(ids: np.ndarray, keys: np.ndarray, aux: np.ndarray, _: object) -> tuple:
    """Ranges of positions whose window name occurs more than once: first position, and below it 24 bits of length."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    pick = order[twice]
    ids, at = ids[pick], aux[pick].astype(np.int64)
    order = np.lexsort((at, ids))
    ids, at = ids[order], at[order]
    new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (at[1:] > at[:-1] + 1)))[: len(ids)]
    place = np.arange(len(ids))
    new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % LONGEST == 0
    cut = np.nonzero(new)[0]
    length = at[np.concatenate((cut[1:], [len(ids)])) - 1] - at[cut] + 1 if len(cut) else at
    return ids[cut], _ranges(at[cut], length), None, None


def _ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """First position, and below it 24 bits of length, which is at most LONGEST."""
    return first.astype(np.uint64) << np.uint64(24) | length.astype(np.uint64)


def _same_symbols(ids: np.ndarray, keys: np.ndarray, aux: np.ndarray, _: object) -> tuple:
    """Ordinals of the symbols that occur more than once."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.concatenate(([False], k[1:] == k[:-1], [False]))
    pick = order[same[1:] | same[:-1]]
    return ids[pick], aux[pick].astype(np.uint64), None, None


def _starts(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All window starts in the ranges."""
    n = last - first + 1
    return np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _flagged(flags: np.ndarray, bit: int) -> np.ndarray:
    return (flags[(flags & np.uint64(bit)) > 0] >> np.uint64(8)).astype(np.int64)


def _covered(n: int, ranges: np.ndarray, length: int) -> np.ndarray:
    """Positions below n that lie in a window of the given length which starts in one of the ranges."""
    first = (ranges >> np.uint64(24)).astype(np.int64)
    end = first + (ranges & np.uint64(0xFFFFFF)).astype(np.int64) - 1 + length
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, first, 1)
    np.subtract.at(depth, np.minimum(end, n), 1)
    return np.cumsum(depth[:-1]) > 0


def _values(batch: pa.RecordBatch, name: str, dtype: type) -> Iterator[np.ndarray]:
    for v in batch.column(name):
        yield np.frombuffer(v.as_py() or b"", dtype)


def _texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    for v in batch.column(name).cast(pa.large_binary()):
        yield v.as_py() or b""


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one: a dealt text is read more often than it is written."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for b in batches:
        at = b.schema.names.index("text")
        yield b.set_column(at, "text", pa.array([squeeze.compress(t) for t in _texts(b)], pa.binary()))


def _whole(batch: pa.RecordBatch) -> Iterator[bytes]:
    open_ = zstandard.ZstdDecompressor()
    for v in batch.column("text"):
        yield open_.decompress(v.as_py())


def _known(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """(uid, id, text) and, with ``carry``, a struct of the other columns."""
    X.prepare(docs.sparkSession)
    rest = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col))).alias("rest")] if carry and len(docs.columns) > 2 else []
    return docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("uid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *rest)


def _dealt(known: DataFrame) -> DataFrame:
    """Rows dealt by uid, so that the joins by it read them as they are."""
    return known.mapInArrow(_squeezed, _ddl(known).replace("`text` string", "`text` binary")).repartition(X.partitions(known.sparkSession), "uid")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _finish(docs: DataFrame, windows: DataFrame, settle, remove, schema: str, id_col: str) -> DataFrame:
    """Join the repeated window starts with the texts and cut them out; ``schema`` is of what ``remove`` returns."""
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [remove(t, settle(t, v), w) for t, v, w in zip(_whole(b), _values(b, "flags", np.uint64), _values(b, "vals", np.uint64), strict=True)]
            held = [n for n in ("id", "rest") if n in b.schema.names]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in held), *(pa.array([o[n] for o in out], t) for n, t in fields)], names=[*held, *(n for n, _ in fields)])

    own = docs.select(*(c for c in docs.columns if c in ("id", "rest")))
    done = docs.join(windows, "uid", "left").mapInArrow(run, f"{_ddl(own)}, {schema}")
    new = [n for n, _ in fields]
    carried = [c for c in docs.schema["rest"].dataType.names if c not in (id_col, *new)] if "rest" in docs.columns else []
    return done.select(F.col("id").alias(id_col), *new, *(F.col("rest")[c].alias(c) for c in carried))


def _long_windows(docs: DataFrame, first, judge, aux_type, second) -> tuple[DataFrame, DataFrame]:
    """The two exchanges: pieces, then windows.  Returns texts with flags, and repeated window starts."""
    pieces = X.gather(X.scatter(docs, first, _WIDTH), judge, aux_type, _WIDTH)
    flags = X.returned(pieces, lambda ids, v, *_: X.rows_of(ids, v, np.uint64, name="flags"), "uid long, flags binary")
    flagged = _dealt(docs).join(flags, "uid", "left")
    named = X.scatter(flagged, second, _FULL)  # no filter: both readers of `flagged` then share its exchanges
    windows = X.gather(named, _judge_windows, np.dtype("<u4"), _FULL)
    return flagged, X.returned(windows, _distinct_starts, "uid long, vals binary")


def _distinct_starts(ids: np.ndarray, v: np.ndarray, *_: object) -> Iterator[pa.RecordBatch]:
    return X.rows_of(ids, v, np.uint64)


def suffix_array_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = 200, with_text: bool = False, carry: bool = False) -> DataFrame:
    """Remove every byte that lies in a ``threshold``-byte string which starts anywhere else too.

    Returns (id_col, n_bytes, n_removed, n_spans, kept_sha256) and, ``with_text``,
    ``kept``: the remaining bytes as text, where a cut character's rest is dropped;
    with ``carry`` the other columns follow; those that have the new names are replaced.
    All occurrences are removed, and strings are judged on the input.  A null text
    counts as empty.
    """
    if threshold < SPREAD + GRAM:
        raise ValueError(f"threshold must be at least {SPREAD + GRAM}")

    def first(batch: pa.RecordBatch) -> Iterator[tuple]:
        for uid, data in zip(batch.column("uid").to_pylist(), _texts(batch), strict=True):
            if (s := _suffixes(data, threshold)) is not None:
                aux = np.empty(len(s[0]), _AUX7)
                aux["low"], aux["high"], aux["first"] = s[3] & np.uint64(0xFFFFFFFF), (s[3] >> np.uint64(32)) & np.uint64(0xFFFF), s[0]
                yield uid, s[2], aux

    def second(batch: pa.RecordBatch) -> Iterator[tuple]:
        batch = batch.filter(batch.column("flags").is_valid())
        for uid, data, flags in zip(batch.column("uid").to_pylist(), _whole(batch), _values(batch, "flags", np.uint64), strict=True):
            if len(pick := _flagged(flags, _NAME)):
                first, last, prefix, _, roll = _suffixes(data, threshold)
                own = np.isin(first, pick)
                starts = _starts(first[own], last[own])  # they meet where their suffix does
                yield uid, roll.at(starts, starts + threshold), starts.astype(np.uint32), 0, np.repeat(prefix[own], last[own] - first[own] + 1)

    def settle(data: bytes, flags: np.ndarray) -> np.ndarray:
        if not len(pick := _flagged(flags, _SETTLED)):
            return np.empty(0, np.uint64)
        first, last, *_ = _suffixes(data, threshold)
        own = np.isin(first, pick)
        return _ranges(first[own], last[own] - first[own] + 1)

    def remove(data: bytes, settled: np.ndarray, windows: np.ndarray) -> dict:
        gone = _covered(len(data), np.concatenate((settled, windows)), threshold) if len(data) else np.empty(0, bool)
        edges = np.diff(np.concatenate(([False], gone)).astype(np.int8))
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out = {"n_bytes": len(data), "n_removed": int(gone.sum()), "n_spans": int((edges == 1).sum()), "kept_sha256": hashlib.sha256(kept).hexdigest()}
        return out | ({"kept": kept.decode("utf-8", "ignore")} if with_text else {})

    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
    flagged, windows = _long_windows(_known(docs, id_col, text_col, carry), first, _judge_suffixes, _AUX7, second)
    return _finish(flagged, windows, settle, remove, schema, id_col)


# ---------------------------------------------------------------- words

#: Rounds of run and pair naming.
ROUNDS = 4
_FAR = 1 << 40
_NO_SYMBOL = 2**32 - 1


class _Names(dict):
    """64-bit names of words; bounded, as it only saves work."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = name = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return name


_names = _Names()


def word_symbols(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_names.__getitem__, words), np.uint64, len(words))


def recompress(symbols: np.ndarray, wall: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, and for each the range [lo, hi) of positions that determines it.

    Walls stand around each text; a symbol that depends on what is behind a wall
    has a range that reaches beyond all positions.
    """
    n = len(symbols)
    name, lo, hi = symbols, np.arange(n, dtype=np.int64), np.arange(1, n + 1, dtype=np.int64)
    lo[wall], hi[wall] = -_FAR, _FAR
    for r in range(rounds):
        # runs of equal symbols become one symbol; that a run ends is told by its neighbours
        cut = np.concatenate(([0], np.nonzero(name[1:] != name[:-1])[0] + 1))
        size = np.diff(np.concatenate((cut, [len(name)])))
        lo = np.concatenate(([-_FAR], lo[cut[1:] - 1]))
        hi = np.concatenate((hi[cut[1:]], [_FAR]))
        wall = wall[cut]
        lo[wall], hi[wall] = -_FAR, _FAR
        name = np.where(size > 1, X.mix(name[cut] ^ X.mix(size.astype(np.uint64) + np.uint64(r << 32))), name[cut])
        # a left symbol before a right one becomes a pair
        side = (X.mix(name + np.uint64(2 * r + 1)) >> np.uint64(63)).astype(bool)
        pair = np.concatenate((~side[:-1] & side[1:] & ~wall[:-1] & ~wall[1:], [False]))
        second = np.concatenate(([False], pair[:-1]))
        single = ~pair & ~second
        after = np.concatenate((hi[1:], [_FAR]))
        new_lo = np.where(single, np.minimum(np.concatenate(([-_FAR], lo[:-1])), lo), lo)
        new_hi = np.where(single | pair, np.maximum(after, hi), hi)
        new_name = np.where(pair, X.mix(X.mix(name + np.uint64(r)) + np.concatenate((name[1:], name[:1]))), name)
        keep = ~second
        name, lo, hi, wall = new_name[keep], new_lo[keep], new_hi[keep], wall[keep]
    return name, lo, hi


class Parsed:
    """The texts of a batch that have a window, parsed side by side."""

    def __init__(self, uids: list[int], texts: Iterator[bytes], window: int):
        words: list[bytes] = [b""]  # no word is empty: these are the walls
        self.uids, starts, sizes = [], [], []
        for uid, data in zip(uids, texts, strict=True):
            own = data.split()
            if len(own) >= window:
                self.uids.append(uid)
                starts.append(len(words))
                sizes.append(len(own))
                words += own
                words.append(b"")
        self.uids, self.starts = np.array(self.uids, np.int64), np.array(starts, np.int64)
        self.window, self.symbols = window, word_symbols(words)
        wall = np.ones(len(words), bool)
        wall[_starts(self.starts, self.starts + sizes - 1)] = False
        name, lo, hi = recompress(self.symbols, wall)
        use = (lo >= 0) & (hi < _FAR) & (hi - lo <= window)
        self.name, self.lo, self.hi = name[use], lo[use], hi[use]
        self.text = self.text_at(self.lo)
        self.first = np.searchsorted(self.text, np.arange(len(starts)))  # of each text's symbols
        self.open = np.zeros(len(words), bool)
        self.open[_starts(self.starts, self.starts + np.array(sizes, np.int64) - window)] = True

    def text_at(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def undecided(self, alone: np.ndarray | slice) -> np.ndarray:
        """Window starts whose window holds none of the ranges of the given symbols whole."""
        holds = np.zeros(len(self.open) + 1, np.int32)
        np.add.at(holds, np.maximum(self.hi[alone] - self.window, 0), 1)
        np.subtract.at(holds, self.lo[alone] + 1, 1)
        return np.nonzero((np.cumsum(holds)[:-1] == 0) & self.open)[0]


def recompression_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35, with_text: bool = False, carry: bool = False) -> DataFrame:
    """Remove every word that lies in a ``window``-word sequence which starts anywhere else too.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared unchanged.  Returns (id_col, n_words,
    n_removed, kept_sha256) of the kept words joined by one space and, ``with_text``,
    that text as ``kept``; with ``carry`` the other columns follow; those that have
    the new names are replaced.  A null text has no words.
    """

    def first(batch: pa.RecordBatch) -> Iterator[tuple]:
        p = Parsed(batch.column("uid").to_pylist(), _texts(batch), window)
        if len(p.uids):
            yield p.uids[p.text], p.name, (np.arange(len(p.name)) - p.first[p.text]).astype(np.uint32)
            # in long runs, say, windows hold no symbol: a name of the text's own, given twice, makes such a text return
            own = np.repeat(p.uids[np.unique(p.text_at(p.undecided(slice(None))))], 2)
            yield own, X.mix(own.view(np.uint64)), np.full(len(own), _NO_SYMBOL, np.uint32)

    def second(batch: pa.RecordBatch) -> Iterator[tuple]:
        batch = batch.filter(batch.column("flags").is_valid())
        flags = dict(zip(batch.column("uid").to_pylist(), _values(batch, "flags", np.uint64), strict=True))
        p = Parsed(batch.column("uid").to_pylist(), _whole(batch), window)
        if len(p.uids):
            alone = np.ones(len(p.name), bool)
            for uid, base in zip(p.uids.tolist(), p.first.tolist(), strict=True):
                shared = flags[uid].astype(np.int64)
                alone[base + shared[shared != _NO_SYMBOL]] = False
            starts = p.undecided(alone)
            text = p.text_at(starts)
            yield p.uids[text], Rolling(p.symbols).at(starts, starts + window), (starts - p.starts[text]).astype(np.uint32)

    def remove(data: bytes, _: object, windows: np.ndarray) -> dict:
        words = data.split()
        gone = _covered(len(words), windows, window) if len(words) else np.empty(0, bool)
        kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words)
        out = {"n_words": len(words), "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest()}
        return out | ({"kept": kept.decode("utf-8")} if with_text else {})

    schema = "n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    flagged, windows = _long_windows(_known(docs, id_col, text_col, carry), first, _same_symbols, np.dtype("<u4"), second)
    return _finish(flagged, windows, lambda *_: None, remove, schema, id_col)
