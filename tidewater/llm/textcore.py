"""Byte-level text kernels on Arrow batches: words, word hashes and word shingles in numpy.

A batch's string column is one byte buffer with offsets, so classifying bytes, cutting words and
hashing them are whole-array operations; Python sees documents, never characters.  Work is cut in
windows of about ``WINDOW`` bytes, so memory does not follow the length of a text, and a window ends
between words, so no word is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
WINDOW = 1 << 20
MULT = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and return.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Words are runs of digits, letters and bytes beyond ASCII (after lower-casing A-Z).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Words are runs of letters and bytes beyond ASCII.
ALPHA = ALNUM.copy()
ALPHA[0x30:0x3A] = False

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of MULT and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, WINDOW + 4096)
        for k, base in enumerate((MULT, pow(MULT, -1, 1 << 64))):
            out = np.full(size, base, U64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on every element."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & MASK], U64))[0])


def string_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def row_slices(offs: np.ndarray, limit: int = 2 * WINDOW) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes together, or of one longer row."""
    row, n = 0, len(offs) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


class Words:
    """Words of consecutive rows: start and length in bytes, 64-bit hash, and first word of each row."""

    __slots__ = ("start", "length", "hash", "first", "prefix")

    def __init__(self, start: np.ndarray, length: np.ndarray, hash_: np.ndarray, first: np.ndarray):
        self.start, self.length, self.hash, self.first = start, length, hash_, first
        self.prefix: dict[int, np.ndarray] = {}


def windows(data: np.ndarray, kept: np.ndarray, breaks: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of the buffer that fall on a row's start or on a byte outside words."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + WINDOW)
        if end < n:
            back = np.flatnonzero(~kept[data[at:end]])
            row = int(np.searchsorted(breaks, end, "right")) - 1
            cut = max(at + int(back[-1]) + 1 if len(back) else 0, int(breaks[row]) if row >= 0 else 0)
            if cut <= at:  # one word longer than a window
                later = int(breaks[row + 1]) if row + 1 < len(breaks) else n
                cut = later
                for step in range(end, later, WINDOW):
                    if len(ahead := np.flatnonzero(~kept[data[step : min(later, step + WINDOW)]])):
                        cut = step + int(ahead[0]) + 1
                        break
            end = cut
        yield at, end
        at = end


def words(data: np.ndarray, offs: np.ndarray, kept: np.ndarray, fold: np.ndarray = LOWER, hashes: bool = True, prefixes: tuple[int, ...] = ()) -> Words:
    """Cut every row into words and hash them.  ``kept``: bytes of words, after ``fold``.

    ``prefixes``: lengths in bytes whose hashes ``Words.prefix`` gets too; 0 for shorter words.
    """
    kept_raw = kept[fold]
    starts, lengths, values = [], [], []
    heads: dict[int, list[np.ndarray]] = {p: [] for p in prefixes}
    for a, b in windows(data, kept_raw, offs):
        raw = data[a:b]
        inside = kept_raw[raw]
        edge = inside.copy()
        edge[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = offs[np.searchsorted(offs, a) : np.searchsorted(offs, b)] - a
        edge[cuts] = inside[cuts]
        cuts = cuts[cuts > 0] - 1
        last[cuts] = inside[cuts]
        s = np.flatnonzero(edge)
        e = np.flatnonzero(last) + 1
        starts.append(s + a)
        lengths.append(e - s)
        if hashes:
            up, down = powers(b - a)
            total = np.zeros(b - a + 1, U64)
            np.cumsum((fold[raw].astype(U64) + U64(1)) * up[: b - a], out=total[1:])
            values.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(U64)))
            for p in prefixes:
                value = np.zeros(len(s), U64)
                long = s[e - s >= p]
                value[e - s >= p] = mix((total[long + p] - total[long]) * down[long] + U64(p))
                heads[p].append(value)
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    length = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    value = np.concatenate(values) if values else np.zeros(0, U64)
    out = Words(start, length, value, np.searchsorted(start, offs))
    out.prefix = {p: np.concatenate(x) if x else np.zeros(0, U64) for p, x in heads.items()}
    return out


def word_hash(word: str) -> int:
    """The hash that ``words`` gives this word, already folded."""
    value, power = 0, 1
    raw = word.encode()
    for b in raw:
        value, power = value + (b + 1) * power & MASK, power * MULT & MASK
    return mix_int(value + len(raw))


SHINGLE = 5
_FACTORS = [U64(mix_int(0x51ED270B + k) | 1) for k in range(SHINGLE)]


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's 5-word shingles, repeats included, and where each row's begin.

    A row of one to four words has its whole sequence as its only shingle; a row without words none.
    """
    counts = np.diff(w.first)
    per_row = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(per_row)])
    out = np.zeros(int(first[-1]), U64)
    n = len(w.hash)
    if n >= SHINGLE:
        total = w.hash[: n - SHINGLE + 1] * _FACTORS[0]
        for k in range(1, SHINGLE):
            total = total + w.hash[k : n - SHINGLE + 1 + k] * _FACTORS[k]
        whole = counts >= SHINGLE
        rows = np.flatnonzero(whole)
        at = np.arange(int(per_row[rows].sum())) + np.repeat(w.first[rows] - np.concatenate([[0], np.cumsum(per_row[rows])])[:-1], per_row[rows])
        to = np.arange(len(at)) + np.repeat(first[rows] - np.concatenate([[0], np.cumsum(per_row[rows])])[:-1], per_row[rows])
        out[to] = mix(total[at])
    for row in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        value = int(counts[row])
        for h in w.hash[w.first[row] : w.first[row + 1]].tolist():
            value = ((value * MULT) ^ h) & MASK
        out[first[row]] = U64(mix_int(value))
    return out, first


def distinct_shingles(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of each text of a column."""
    data, offs = string_buffer(column)
    for a, b in row_slices(offs):
        w = words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], SPACED)
        s, first = shingles(w)
        for row in range(b - a):
            own = np.sort(s[first[row] : first[row + 1]])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            yield a + row, own


def word_counts(column: pa.Array) -> np.ndarray:
    """Words of each text, without hashing them."""
    data, offs = string_buffer(column)
    out = np.zeros(len(offs) - 1, np.int64)
    for a, b in row_slices(offs):
        out[a:b] = np.diff(words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], SPACED, hashes=False).first)
    return out
