"""SentencePiece encoding and decoding by suffix-array matching, for BPE models with byte fallback.

The distinct stretches of a batch (a run of spaces and what follows up to the next space or line end;
no piece crosses these) are concatenated and indexed by a suffix array.  Every piece of the
vocabulary is binary-searched in it; its occurrence range gives edges, which are sorted by where they
end and then relaxed: at each position exactly one piece can end the encoding of the prefix, the one
that is compatible with the piece that ends the encoding before it.  Two pieces are compatible if
encoding their concatenation gives them back, which is decided by undoing merges across the seam;
answers are cached.  So the path is the one that the model's merges give, not a shortest path, which
for a model trained on merges would be another.  Stretches of several leading spaces (whose pieces
tie in score) or longer than ``LONG`` bytes are merged pair by pair instead, with the same result.  The
array orders suffixes by their first 16 bytes; longer pieces are compared with the text.

The result equals the library's for the same model.  Null and empty texts have no pieces and decode
to the empty text.  A character outside the vocabulary becomes one piece a byte.  The character
U+2581 counts as a space, as the model cannot tell them apart, so a text with it is not given back
exactly (``round_trip`` false); every other text is.  Repeated rows are encoded each; extra columns
are ignored, whatever their names, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import tables
from .textcore import U64, mix, powers, row_slices, string_buffer

MODEL = os.environ.get("TIDEWATER_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: Bytes of a stretch that goes through the array; the edges' order has 11 bits for places in one.
LONG = 2000
#: Bytes of distinct stretches that one suffix array covers, and of texts whose stretches are encoded once.
INDEXED = 1 << 18
TOGETHER = 4 << 20
#: Bytes of texts that are cut at once, unless one is longer.
SLICE = 1 << 20
SPACE = "▁"
UNKNOWN = -2
_CACHE = 1 << 21


class Vocabulary:
    """Pieces, their order of merging, their last merges, and which pairs merge to what."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.size, self.byte_ids = n, np.full(256, sp.unk_id(), np.int32)
        text, normal = [""] * n, []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)):
                text[i] = piece
                normal.append(i)
        self.ids = {text[i]: i for i in normal}
        self.score = {text[i]: sp.get_score(i) for i in normal}
        splits: dict[str, tuple[str, str]] = {}
        for piece in list(self.ids):
            if len(piece) > 1 and not (piece.startswith(SPACE * 2) or piece == SPACE):
                if len(self.merge(piece, splits)) != 1:
                    del self.ids[piece]
        usable = [p for p in self.ids if not p.startswith(SPACE * 2)]
        merged = sorted((p for p in usable if len(p) > 1), key=lambda p: -self.score[p])
        single = [p for p in usable if len(p) == 1]
        order = {p: k for k, p in enumerate(single + merged)}
        self.singles = len(single)
        self.id_of = np.array([self.ids[p] for p in order], np.int32)
        self.left = np.array([order[splits[p][0]] if len(p) > 1 else k for p, k in order.items()], np.int64)
        self.right = np.array([order[splits[p][1]] if len(p) > 1 else k for p, k in order.items()], np.int64)
        pairs = sorted((order[p[:k]] * len(order) + order[p[k:]], order[p]) for p in merged for k in range(1, len(p)) if p[:k] in order and p[k:] in order)
        self.pair_keys, self.pair_ids = np.array([x[0] for x in pairs], np.int64), np.array([x[1] for x in pairs], np.int64)
        raw = [p.replace(SPACE, " ").encode() for p in order]
        self.length = np.array([len(x) for x in raw], np.int64)
        self.short = np.flatnonzero(self.length <= LONG)
        self.low = np.array([raw[k][:16] for k in self.short], "S16")
        self.high = np.array([raw[k][:16].ljust(16, b"\xff") for k in self.short], "S16")
        self.raw = raw
        every = [text[i].replace(SPACE, " ").encode() for i in range(n)]
        for b in range(256):
            every[self.byte_ids[b]] = bytes([b])
        self.text_at = np.concatenate([[0], np.cumsum([len(x) for x in every])])
        self.text_bytes = np.frombuffer(b"".join(every), np.uint8)

    def merge(self, text: str, splits: dict | None = None) -> list[str]:
        """The model's merges on one stretch, pair by pair: best score first, leftmost on ties."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts) and (score := self.score.get(both := parts[i] + parts[after[i]])) is not None:
                heapq.heappush(heap, (-score, i, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != both:
                continue
            if splits is not None and both == text:
                splits[text] = (parts[i], parts[j])
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def merged_ids(self, text: str) -> list[int]:
        out: list[int] = []
        for p in self.merge(text):
            own = self.ids.get(p)
            out += [own] if own is not None else self.byte_ids[np.frombuffer(p.replace(SPACE, " ").encode(), np.uint8)].tolist()
        return out

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether encoding the two pieces' concatenation gives the two back (pieces by merge order)."""
        out = np.ones(len(first), dtype=bool)
        a, b = first.copy(), second.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            x, y, top = a[live], b[live], limit[live]
            slot = np.minimum(np.searchsorted(self.pair_keys, x * len(self.left) + y), len(self.pair_keys) - 1)
            broken = (self.pair_keys[slot] == x * len(self.left) + y) & (self.pair_ids[slot] < top)
            out[live[broken]] = False
            live, x, y = live[~broken], x[~broken], y[~broken]
            undo_first = np.where(x >= self.singles, np.where(y >= self.singles, x > y, True), False)
            over = (x < self.singles) & (y < self.singles)
            limit[live] = np.where(undo_first, x, y + 1)
            a[live] = np.where(undo_first, self.right[x], x)
            b[live] = np.where(undo_first, y, self.left[y])
            live = live[~over]
        return out


class Encoder:
    """Encodes batches; the cache of compatible pairs lives as long as the encoder."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.keys, self.answers = np.full(_CACHE, -1, np.int64), np.zeros(_CACHE, dtype=bool)

    def _compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        key = first * (1 << 20) + second
        slot = (mix(key.view(U64)) & U64(_CACHE - 1)).astype(np.int64)
        known = self.keys[slot] == key
        out = self.answers[slot]
        if not known.all():
            fresh, back = np.unique(key[~known], return_inverse=True)
            found = self.v.compatible(fresh >> 20, fresh & ((1 << 20) - 1))
            out[~known] = found[back]
            self.keys[slot[~known]], self.answers[slot[~known]] = key[~known], found[back]
        return out

    def _edges(self, text: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Sorted edges of all pieces: bits of the end inside the stretch, the end, 63 - length, the piece."""
        padded = np.concatenate([text, np.zeros(16, np.uint8)])
        eight = sum((padded[k : k + len(text) + 8].astype(U64) << U64(8 * (7 - k)) for k in range(8)), np.zeros(len(text) + 8, U64))
        first, second = eight[: len(text)], eight[8:]
        suffixes = np.lexsort((second, first))
        index = np.empty((len(text), 2), ">u8")
        index[:, 0], index[:, 1] = first[suffixes], second[suffixes]
        index = index.reshape(-1).view("S16")
        low, high = np.searchsorted(index, self.v.low, "left"), np.searchsorted(index, self.v.high, "right")
        some = np.flatnonzero(high > low)
        piece = np.repeat(self.v.short[some], (high - low)[some])
        count = (high - low)[some]
        rank = np.arange(len(piece)) + np.repeat(low[some] - np.concatenate([[0], np.cumsum(count)])[:-1], count)
        at = suffixes[rank]
        if (far := np.flatnonzero(self.v.length[piece] > 16)).size:
            raw = text.tobytes()
            wrong = [k for k in far.tolist() if raw[at[k] : at[k] + self.v.length[piece[k]]] != self.v.raw[piece[k]]]
            at, piece = np.delete(at, wrong), np.delete(piece, wrong)
        end = at + self.v.length[piece]
        inside = end - begin[np.searchsorted(begin, at, "right") - 1]
        return np.sort((inside << 52) | (end << 28) | ((63 - self.v.length[piece]) << 20) | piece)

    def _relaxed(self, text: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """For each position the piece that ends the encoding of its stretch up to there."""
        edges = self._edges(text, begin)
        last = np.full(len(text) + 1, UNKNOWN, np.int64)
        starts = np.zeros(len(text) + 1, dtype=bool)
        starts[begin] = True
        top = int(edges[-1] >> 52) if len(edges) else 0
        cuts = np.searchsorted(edges, np.arange(top + 2) << 52)
        for step in range(1, top + 1):
            e = edges[cuts[step] : cuts[step + 1]]
            if not len(e):
                continue
            end = (e >> 28) & ((1 << 24) - 1)
            heads = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
            stop = np.append(heads[1:], len(e))
            while len(heads):
                own = e[heads]
                to, piece = (own >> 28) & ((1 << 24) - 1), own & ((1 << 20) - 1)
                at = to - self.v.length[piece]
                before = last[at]
                good = starts[at] | (before == UNKNOWN)
                ask = np.flatnonzero(~good)
                good[ask] = self._compatible(before[ask], piece[ask])
                last[to[good]] = piece[good]
                heads, stop = heads[~good] + 1, stop[~good]
                more = heads < stop
                heads, stop = heads[more], stop[more]
        return last

    def _stretches(self, text: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stretches one after the other, and each one's count."""
        last = self._relaxed(text, begin)
        at = begin + length
        owner, step, value = [], [], []
        live, k = np.arange(len(begin)), 0
        while len(live):
            piece = last[at[live]]
            unknown = piece == UNKNOWN
            value.append(np.where(unknown, self.v.byte_ids[text[at[live] - 1]], self.v.id_of[np.maximum(piece, 0)]))
            owner.append(live)
            step.append(np.full(len(live), k))
            at[live] -= np.where(unknown, 1, self.v.length[np.maximum(piece, 0)])
            live = live[at[live] > begin[live]]
            k += 1
        owner, step = np.concatenate(owner), np.concatenate(step)
        return np.concatenate(value)[np.lexsort((-step, owner))].astype(np.int32), np.bincount(owner, minlength=len(begin))

    def distinct(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where in it each of the distinct stretches has its own and how many."""
        at, counts = np.zeros(len(stretches), np.int64), np.zeros(len(stretches), np.int64)
        pool, used = [np.zeros(0, np.int32)], 0
        length = np.array([len(s) for s in stretches], np.int64)
        slow = np.array([len(s) > LONG or s[:2] == b"  " or s == b" " for s in stretches], dtype=bool)
        for i in np.flatnonzero(slow).tolist():
            ids = self.v.merged_ids(stretches[i].decode("utf-8", "surrogateescape").replace(" ", SPACE))
            pool.append(np.array(ids, np.int32))
            at[i], counts[i], used = used, len(ids), used + len(ids)
        fast = np.flatnonzero(~slow)
        block = np.cumsum(length[fast] + 1) // INDEXED
        for own in np.split(fast, np.flatnonzero(np.diff(block)) + 1) if len(fast) else []:
            begin = np.concatenate([[0], np.cumsum(length[own] + 1)])[:-1]
            ids, count = self._stretches(np.frombuffer(b"\0".join([stretches[i] for i in own.tolist()]) + b"\0", np.uint8), begin, length[own])
            pool.append(ids)
            at[own], counts[own], used = used + np.cumsum(count) - count, count, used + len(ids)
        return np.concatenate(pool), at, counts

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For runs of rows: first and last row, ids, each row's first id, and the bytes encoded with offsets."""
        data, offs = string_buffer(column)
        for a, b in row_slices(offs, TOGETHER):
            for c, d, *rest in self._encode(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]):
                yield a + c, a + d, *rest

    def _encode(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple]:
        cut = [(a, b, *_spaced(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])) for a, b in row_slices(offs, SLICE)]
        known, texts, slices = np.zeros(0, U64), [], []
        for _, _, own, at in cut:
            begin, key = _cut(own, at)
            order = np.argsort(key)
            heads = np.concatenate([[True], key[order][1:] != key[order][:-1]])[: len(key)]
            index = order[heads]
            back = np.empty(len(key), np.int64)
            back[order] = np.cumsum(heads) - 1
            fresh = key[index]
            new = np.flatnonzero(~np.isin(fresh, known))
            ends = np.append(begin[1:], len(own))[index[new]]
            raw = own.tobytes()
            texts += [raw[i:j] for i, j in zip(begin[index[new]].tolist(), ends.tolist(), strict=True)]
            known = np.concatenate([known, fresh[new]])
            slices.append((begin, fresh, back))
        pool, pool_at, counts = self.distinct(texts)
        order = np.argsort(known)
        for (a, b, own, at), (begin, fresh, back) in zip(cut, slices, strict=True):
            slot = order[np.searchsorted(known, fresh, sorter=order)][back]
            count = counts[slot]
            first = np.concatenate([[0], np.cumsum(count)])
            ids = pool[np.arange(int(first[-1])) + np.repeat(pool_at[slot] - first[:-1], count)]
            yield a, b, ids, first[np.searchsorted(begin, at)], own, at

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the pieces one after the other; spaces are spaces."""
        begin, length = self.v.text_at[ids], np.diff(self.v.text_at)[ids]
        first = np.concatenate([[0], np.cumsum(length)])
        return self.v.text_bytes[np.arange(int(first[-1])) + np.repeat(begin - first[:-1], length)]


def _spaced(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buffer with a space before each text that isn't empty, and U+2581 as a space."""
    mark = SPACE.encode()
    if mark in (raw := data.tobytes()):
        texts = [raw[a:b].replace(mark, b" ") for a, b in zip(offs[:-1], offs[1:], strict=True)]
        data, offs = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    filled = np.diff(offs) > 0
    moved = offs + np.concatenate([[0], np.cumsum(filled)])
    out = np.full(int(moved[-1]), 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.cumsum(filled), np.diff(offs))] = data
    return out, moved


def _cut(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the stretches of all texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    feed, space = data == 10, data == 32
    edge = feed.copy()
    edge[1:] |= feed[:-1] | (space[1:] & ~space[:-1])
    edge[offs[:-1][np.diff(offs) > 0]] = True
    begin = np.flatnonzero(edge)
    end = np.append(begin[1:], len(data))
    up, down = powers(len(data))
    total = np.concatenate([np.zeros(1, U64), np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)])])
    return begin, mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(U64))


_encoders: dict[bytes, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """One encoder a worker process and model."""
    key = hashlib.sha256(model).digest()
    if key not in _encoders:
        _encoders[key] = Encoder(Vocabulary(model))
    return _encoders[key]


def _shipped(documents: DataFrame, model_file: str):
    """The model's bytes, read on the driver and broadcast: about a megabyte, whatever the corpus."""
    return documents.sparkSession.sparkContext.broadcast(Path(model_file).read_bytes())


def _digests(model, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model.value)
        names = ["doc_id", "n_bytes", "n_pieces", "n_byte_pieces", "ids_sha256", "round_trip"] + ["ids"] * with_ids
        for batch in batches:
            data, offs = string_buffer(batch.column(1))
            for a, b, ids, first, _, _ in own.encode(batch.column(1)):
                raw = np.diff(np.concatenate([[0], np.cumsum(np.isin(ids, own.v.byte_ids), dtype=np.int32)])[first])
                back = own.decode(ids)
                decoded_at = np.concatenate([[0], np.cumsum(np.diff(own.v.text_at)[ids])])[first]
                digest, whole = [], []
                for i in range(b - a):
                    digest.append(hashlib.sha256(ids[first[i] : first[i + 1]].astype("<i4").tobytes()).hexdigest())
                    text = back[decoded_at[i] + 1 : decoded_at[i + 1]] if first[i + 1] > first[i] else back[:0]
                    whole.append(np.array_equal(text, data[offs[a + i] : offs[a + i + 1]]))
                columns = [batch.column(0).slice(a, b - a), pa.array(np.diff(offs[a : b + 1])), pa.array(np.diff(first)), pa.array(raw.astype(np.int64)), pa.array(digest, pa.string()), pa.array(whole, pa.bool_())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


DIGESTS = "doc_id long, n_bytes long, n_pieces long, n_byte_pieces long, ids_sha256 string, round_trip boolean"


def encoded_digests(documents: DataFrame, model_file: str = MODEL, with_ids: bool = False) -> DataFrame:
    """Per row: bytes, pieces, byte pieces, SHA-256 of the ids as 32-bit little-endian integers, whether
    decoding gave the text back, and the ids themselves if asked for."""
    schema = DIGESTS + ", ids array<int>" if with_ids else DIGESTS
    return documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_digests(_shipped(documents, model_file), with_ids), schema)


def _encode(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model.value)
        for batch in batches:
            for a, b, ids, first, _, _ in own.encode(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return run


def encode(documents: DataFrame, model_file: str = MODEL) -> DataFrame:
    """doc_id and ids of every row."""
    return documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_encode(_shipped(documents, model_file)), "doc_id long, ids array<int>")


def _decode(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model.value)
        for batch in batches:
            texts = [own.decode(np.array(x or [], np.int32)).tobytes().decode("utf-8", "replace")[1:] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, model_file: str = MODEL) -> DataFrame:
    """doc_id and text of rows of ids; null ids give the empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(_shipped(encoded, model_file)), "doc_id long, text string")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(tables.read(spark, sf_dir, "documents"))
