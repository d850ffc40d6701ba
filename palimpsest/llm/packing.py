"""Vector bin packing of token sequences under several limits at once.

Each task streams its documents: it tokenises them, cuts what is longer than a
sequence, and keeps the remainders in a pool of bounded size.  Sequences are
filled one at a time.  A piece demands a vector (tokens, segments, loss-bearing
tokens) and of the pieces that fit, the one with the largest dot product with
what is left of the sequence goes in; demands and rests count as shares of the
limits.  If nothing fits, the piece that exceeds the gap least is cut to fill
it.  The last tokens of a task go to sequences whose lengths are powers of two.
Nothing is shuffled, and a task needs only its pool in memory.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import exchange as X

#: Pieces that a task holds while it packs.
POOL = 1024
#: Words whose ids a task remembers.
WORDS = 500_000
#: A worker's encoders: what one task learns serves the next.
_encoders: dict[str, Encoder] = {}
END_ID = 1
#: White space that holds two spaces, or a space in its middle.
_MIXED = re.compile(r" \s* |\s \s")


class Encoder:
    """Ids of a byte-level BPE file for ``tokenizers``, as little-endian uint32 bytes.

    The pattern that splits a text never joins what stands left and right of a
    single space, unless other white space surrounds it.  So other texts are put
    together from the ids of their space-led words, which are remembered.  New
    words and texts with such space go through the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.fast = _ranks_beside(path)

    def _ids(self, text: str) -> bytes:
        ids = self.fast.encode_ordinary(text) if self.fast else self.whole.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _MIXED.search(text):
            return self._ids(text)
        first, *rest = text.split(" ")
        known = self.words
        try:
            return self._ids(first) + b"".join([known[w] for w in rest])
        except KeyError:
            if len(known) > WORDS:
                known.clear()
            for w in rest:
                if w not in known:
                    known[w] = self._ids(" " + w)
            return self._ids(first) + b"".join([known[w] for w in rest])


def _ranks_beside(path: str):
    """The same vocabulary as a rank file beside the tokenizer's file, which is read much faster; None without it."""
    try:
        import public_tokenizers
        import tiktoken

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    except (ImportError, OSError):
        return None


class Pool:
    """Pieces that wait: arrays of demands, and what each is."""

    def __init__(self, limits: tuple[int, int, int]):
        self.limits = np.array(limits, float)
        self.need = np.empty((0, 3), np.int64)
        self.what: list[tuple] = []

    def add(self, needs: list[tuple], what: list[tuple]) -> None:
        if needs:
            self.need = np.concatenate((self.need, np.array(needs, np.int64)))
            self.what += what

    def fill(self, room: int) -> list[tuple]:
        """Take pieces for one sequence of ``room`` tokens; returns (doc, start, ids, loss tokens, doc tokens)."""
        taken: list[int] = []
        out: list[tuple] = []
        rest = np.array([room, self.limits[1], self.limits[2]])
        need, live = self.need, np.ones(len(self.need), bool)
        share = need / self.limits
        while rest[0] > 0 and rest[1] > 0:
            fits = live & (need <= rest).all(axis=1)
            if not fits.any():
                break
            k = int(np.argmax(np.where(fits, share @ (rest / self.limits), -1.0)))
            live[k] = False
            rest = rest - need[k]
            taken.append(k)
            out.append(self.what[k])
        if rest[0] > 0 and rest[1] > 0 and rest[2] > 0 and live.any():
            k = int(np.argmin(np.where(live, need[:, 0], 1 << 60)))
            doc, start, ids, loss, total = self.what[k]
            cut = int(rest[0])
            head = _loss(start, cut, loss, total)
            if cut < need[k, 0] and head <= rest[2]:
                out.append((doc, start, ids[: 4 * cut], loss, total))
                self.what[k] = (doc, start + cut, ids[4 * cut :], loss, total)
                need[k] = (need[k, 0] - cut, 1, need[k, 2] - head)
        keep = np.ones(len(need), bool)
        keep[taken] = False
        self.need = need[keep]
        self.what = [w for w, x in zip(self.what, keep.tolist(), strict=True) if x]
        return out


def _loss(start: int, length: int, loss: int, total: int) -> int:
    """Loss-bearing tokens of a piece: those among the last ``loss`` of the document."""
    return max(0, min(start + length, total) - max(start, total - loss))


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None, max_tokens: int = 2048, max_segments: int = 256, max_loss: int | None = None, with_ids: bool = False) -> DataFrame:
    """Pack every document (ids, then id 1) into sequences; one row for each piece.

    Returns (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset) and,
    ``with_ids``, ``ids``: the piece's ids.  A sequence holds at most ``max_tokens``
    tokens, ``max_segments`` pieces and ``max_loss`` (all, if None) loss-bearing
    tokens; ``loss_col`` counts those at a document's end (null or no column: all).
    A null text counts as empty and gives the piece [1]; repeated rows are packed
    again; null ids are kept; an empty table gives an empty result.
    """
    X.prepare(docs.sparkSession)
    most_loss = max_tokens if max_loss is None else max_loss
    if not (max_tokens > 0 and max_segments > 0 and most_loss > 0):
        raise ValueError("limits must be positive")
    columns = [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), (F.col(loss_col).cast("long") if loss_col else F.lit(None).cast("long")).alias("loss")]
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer))
        pool = Pool((max_tokens, max_segments, most_loss))
        at = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        id_type = None

        def close(pieces: list[tuple]) -> None:
            nonlocal at
            offset = 0
            for doc, start, ids, _, total in pieces:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, at, offset) + ((np.frombuffer(ids, "<u4").astype(np.int32),) if with_ids else ()))
                offset += len(ids) // 4
            at += 1

        def given() -> pa.RecordBatch:
            kinds = [id_type, *[pa.int64()] * 6] + [pa.list_(pa.int32())] * with_ids
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
            rows.clear()
            return out

        for b in batches:
            id_type = b.schema.field("id").type
            needs, what = [], []
            for doc, text, loss in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), b.column("loss").to_pylist(), strict=True):
                ids = encode(text or "") + END_ID.to_bytes(4, "little")
                total = len(ids) // 4
                loss = total if loss is None else min(max(loss, 0), total)
                start = 0
                while start < total:
                    size = min(max_tokens, total - start)
                    if _loss(start, size, loss, total) > most_loss:
                        size = max(start, total - loss) + most_loss - start
                    piece = (doc, start, ids[4 * start : 4 * (start + size)], loss, total)
                    if size == max_tokens:
                        close([piece])
                    else:
                        needs.append((size, 1, _loss(start, size, loss, total)))
                        what.append(piece)
                    start += size
            pool.add(needs, what)
            while len(pool.what) > POOL:
                close(pool.fill(max_tokens))
            if rows:
                yield given()
        while pool.what:
            left = int(pool.need[:, 0].sum())
            close(pool.fill(min(max_tokens, 1 << (left.bit_length() - 1))))
            if len(rows) > POOL:
                yield given()
        if rows:
            yield given()

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:7]) + ", ids array<int>" * with_ids
    return docs.select(*columns).mapInArrow(run, schema).withColumnRenamed("id", id_col)
