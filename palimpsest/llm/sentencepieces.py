"""SentencePiece encoding and decoding over shared prefixes.

A batch's distinct marked words (a run of word marks and what follows it) are
sorted, which lines them up as a depth-first walk of their trie: the forward
table of a word is kept as far as the next word has the same prefix.  An entry
of the table holds the last piece of the best segmentation of that prefix.

* For unigram models this is Viterbi: the entry with the best sum of scores; of
  equal sums the longer last piece.
* For BPE models a sum of scores does not give the model's segmentation.  There
  the entry is the only piece that the merges leave at the prefix's end: a piece
  that merges to itself, and that stays apart from the entry before it when the
  two are merged together.

Characters outside the vocabulary become byte pieces, or the unknown piece if
the model has no byte fallback.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import exchange as X

MARK = "▁"
#: Words whose ids a task remembers.
WORDS = 500_000
#: Bytes of text whose words are sorted together.
GATHER = 8 << 20
#: A worker's encoders: what one task learns serves the next.
_encoders: dict[str, Encoder] = {}
_UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6


class Model:
    """Pieces, scores and normalisation of a SentencePiece model file."""

    def __init__(self, path: str | None = None, *, proto: bytes | None = None):
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        m.ParseFromString(proto)
        spec = m.normalizer_spec
        if len(spec.precompiled_charsmap) or spec.remove_extra_whitespaces or not spec.escape_whitespaces or m.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models with identity normalisation are supported")
        self.bpe = m.trainer_spec.model_type == 2
        self.prefix = spec.add_dummy_prefix
        self.pieces = [p.piece for p in m.pieces]
        self.id = {p.piece: k for k, p in enumerate(m.pieces) if p.type in (_NORMAL, _USER)}
        self.score = {p.piece: p.score for p in m.pieces if p.type in (_NORMAL, _USER)}
        self.unknown = next(k for k, p in enumerate(m.pieces) if p.type == _UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(m.pieces) if p.type == _BYTE}
        self.inner_mark = any(MARK in p.lstrip(MARK) for p in self.id)
        self.unknown_score = min(self.score.values(), default=0.0) - 10.0
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else p.piece.replace(MARK, " ").encode() if p.type in (_NORMAL, _USER) else b" \xe2\x81\x87 " if p.type == _UNKNOWN else b"" for p in m.pieces]
        self.id4 = {p: k.to_bytes(4, "little") for p, k in self.id.items()}
        self.table = pa.array(self.raw, pa.large_binary())
        self.edges: dict[str, list[tuple]] = {}
        self._apart: dict[tuple[str, str], bool] = {}
        self.trie: dict = {}  # by character: its children, and the piece that ends there
        for p in sorted(self.id):  # a piece's prefixes that are pieces come first
            if self.bpe:
                self.edges[p] = self.merging(p)
            if len(p) > 1 and (not self.bpe or self.edges[p][-1][1] == p):
                node = self.trie
                for c in p[:-1]:
                    node = node.setdefault(c, ({}, None))[0]
                node[p[-1]] = ({}, p)

    def merging(self, word: str) -> list[tuple]:
        """Plain BPE: join the best-scored, then leftmost, neighbours until none has a piece.

        Returns, before each join and at the end, the score of what is joined next
        (at the end minus infinity) and the first and the last part.
        """
        parts, out = list(word), []
        while True:
            found = [(self.score[p], -k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in self.score]
            if not found:
                return [*out, (-np.inf, parts[0], parts[-1])]
            top, k = max(found)
            out.append((top, parts[0], parts[-1]))
            parts[-k : 2 - k] = [parts[-k] + parts[1 - k]]

    def _stays(self, left: str, right: str) -> bool:
        """Whether two parts stay apart: no join across their border comes before both have merged."""
        if len(self._apart) > 2_000_000:
            self._apart.clear()
        alone = -np.inf
        lefts, rights = self.edges.get(left, [(alone, left, left)]), self.edges.get(right, [(alone, right, right)])
        i = j = 0
        while True:
            a, _, tail = lefts[i]
            b, head, _ = rights[j]
            across = self.score.get(tail + head, alone)
            if across > a and across >= b:
                break
            if a == b == alone:
                break
            if a >= b:
                i += 1
            else:
                j += 1
        known = self._apart[left, right] = across == alone
        return known

    def segment(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """Sorted distinct words with their pieces."""
        before = ""
        last = [""]  # by prefix length: the last piece
        best = [0.0]  # by prefix length: the sum of scores, for unigram models
        live: list[list[tuple]] = [[(0, self.trie)]]  # by prefix length: where pieces that may still grow begin, the longest first
        extend = self._extend_merged if self.bpe else self._extend_best
        for word in words:
            common, most = 0, min(len(word), len(before))
            while common < most and word[common] == before[common]:
                common += 1
            del last[common + 1 :], best[common + 1 :], live[common + 1 :]
            extend(word, common, last, best, live)
            out, j = [], len(word)
            while j:
                out.append(last[j])
                j -= len(last[j])
            out.reverse()
            yield word, out
            before = word

    def _extend_merged(self, word: str, start: int, last: list, best: list, live: list) -> None:
        trie, apart = self.trie, self._apart
        for j in range(start, len(word)):
            c, chosen, grown = word[j], None, []
            for i, kids in live[j]:
                found = kids.get(c)
                if found is not None:
                    kids, piece = found
                    if kids:
                        grown.append((i, kids))
                    if chosen is None and piece is not None:
                        if i:
                            stays = apart.get((last[i], piece))
                            if stays or (stays is None and self._stays(last[i], piece)):
                                chosen = piece
                        else:
                            chosen = piece
            grown.append((j + 1, trie))
            live.append(grown)
            last.append(chosen or c)

    def _extend_best(self, word: str, start: int, last: list, best: list, live: list) -> None:
        score = self.score
        for j in range(start, len(word)):
            c, grown = word[j], []
            chosen, top = c, best[j] + score.get(c, self.unknown_score)
            longer = None
            for i, kids in live[j]:
                found = kids.get(c)
                if found is not None:
                    kids, piece = found
                    if kids:
                        grown.append((i, kids))
                    if piece is not None and (longer is None or best[i] + score[piece] > longer[0]):
                        longer = (best[i] + score[piece], piece)
            if longer and longer[0] >= top:  # of equal sums the longer last piece
                top, chosen = longer
            grown.append((j + 1, self.trie))
            live.append(grown)
            last.append(chosen)
            best.append(top)

    def ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            k = self.id.get(p)
            if k is not None:
                out.append(k)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:  # neighbouring unknowns are one
                out.append(self.unknown)
        return out

    def units(self, text: str) -> list[str]:
        """Marked words; of texts whose words stand between single spaces, the words without their marks."""
        if not text:
            return []
        if self.prefix and not self.inner_mark and text[0] != " " and text[-1] != " " and "  " not in text and MARK not in text:
            return text.split(" ")
        marked = (MARK if self.prefix else "") + text.replace(" ", MARK)
        return [marked] if self.inner_mark else _UNITS.findall(marked)

    def marked(self, unit: str) -> str:
        return MARK + unit if self.prefix and not unit.startswith(MARK) else unit

    def packed(self, pieces: list[str]) -> bytes:
        """Ids as little-endian uint32."""
        try:
            return b"".join([self.id4[p] for p in pieces])
        except KeyError:
            return np.array(self.ids(pieces), "<u4").tobytes()

    def decode(self, ids: Iterator[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def round_trips(self, ids: list[np.ndarray], texts: list[str]) -> list[bool]:
        """Whether the ids of each text decode to it; all ids of a batch are looked up at once."""
        found = self.table.take(pa.array(np.concatenate(ids) if ids else np.empty(0, np.uint32)))
        at = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1] if len(found) else np.zeros(1, np.int64)
        data = memoryview(found.buffers()[2]).cast("B") if len(found) and at[-1] else memoryview(b"")
        ends = at[np.cumsum([0, *map(len, ids)])].tolist()
        lead = b" " if self.prefix else b""
        return [data[a:b] == lead + t.encode() if t else a == b for a, b, t in zip(ends[:-1], ends[1:], texts, strict=True)]


class Encoder:
    """Texts to little-endian uint32 ids, a batch at a time."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        model, known = self.model, self.known
        units = [model.units(t) for t in texts]
        if len(known) > WORDS:
            known.clear()
        found = [list(map(known.get, x)) for x in units]
        fresh = {u for x, v in zip(units, found, strict=True) if None in v for u, ids in zip(x, v, strict=True) if ids is None}
        marked = {u: model.marked(u) for u in fresh}
        packed = {word: model.packed(pieces) for word, pieces in model.segment(sorted(set(marked.values())))}
        known.update((u, packed[w]) for u, w in marked.items())
        return [b"".join(v if None not in v else map(known.__getitem__, x)) for x, v in zip(units, found, strict=True)]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(Model(path))
        gc.freeze()  # the model's many small objects stay: no collection need visit them
    return _encoders[path]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to GATHER bytes or a little more: the more words are sorted at once, the more prefixes they share."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= GATHER:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def sentencepiece_encode(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id_col, n_ids, ids_crc32, round_trip) of each text and, ``with_ids``, ``ids``.

    ``ids_crc32`` is over the ids as little-endian uint32; ``round_trip`` tells if
    decoding the ids gives the text again (it does unless the text holds the word
    mark U+2581 itself).  Null and empty texts have no ids.  Repeated rows and null
    ids are kept, other columns left out; an empty table gives an empty result.
    """
    X.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(model)
        m = encode.model
        for b in _gathered(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            got = encode(texts)
            arrays = [np.frombuffer(x, "<u4") for x in got]
            columns = [b.column("id"), pa.array([len(a) for a in arrays], pa.int64()), pa.array([zlib.crc32(x) for x in got], pa.int64()), pa.array(m.round_trips(arrays, texts), pa.bool_())]
            names = ["id", "n_ids", "ids_crc32", "round_trip"]
            if with_ids:
                columns.append(pa.array([a.astype(np.int32) for a in arrays], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_ids long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def sentencepiece_decode(rows: DataFrame, model: str, *, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``rows`` with ``out_col``: the text of an array of ids; null for null, and nulls within are skipped."""
    X.prepare(rows.sparkSession)
    rows = rows.drop(out_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = encoder(model).model
        for b in batches:
            text = [None if x is None else m.decode(k for k in x if k is not None) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*b.schema.names, out_col])

    return rows.mapInArrow(run, f"{fields}, `{out_col}` string")
