"""Whole Arrow text columns as arrays of words: boundaries, hashes and windows.

Python code in this subpackage never loops over the words of a document.  A
batch of texts is one byte buffer with document offsets; words are runs of bytes
of a class.  A word's 64-bit hash is a chain of bijective mixes over its blocks of
eight bytes (BLAKE2 for words of over 256 bytes), that of a window is made by
doubling: two halves are mixed into one.  No step is linear in the bytes, so no
pattern of words makes equal hashes, as it does for polynomials modulo 2**64; as the
steps can be undone, single words with equal hashes can be made if the seed is known.
Counts and sets go by a seed of their run.
`Words.exact` numbers words by their bytes where a result must not rest on hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; longer documents are never cut, they make a chunk of their own.
CHUNK_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Words between ASCII white space.
NOT_SPACE = ~SPACE
#: Words of digits, lower-case ASCII letters and anything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
#: Maps A-Z to a-z and leaves other bytes alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Odd factors that part the chains and halves.
_CHAIN, _LEFT, _RIGHT = U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95), U64(0xA24BAED4963EE407)
#: Words of more bytes are hashed one by one.
_LONG = 256
#: Keeps the first i bytes of a block.
FIRST = np.array([(1 << (8 * i)) - 1 for i in range(9)], U64)


#: Elements that are mixed together, so that they stay in a core's cache.
_CACHED = 1 << 14


def _mix(v: np.ndarray, spare: np.ndarray) -> None:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0)):
        np.right_shift(v, U64(shift), out=spare)
        np.bitwise_xor(v, spare, out=v)
        if factor:
            np.multiply(v, U64(factor), out=v)


def mix64(x: np.ndarray, own: bool = False) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit; own: x may be overwritten."""
    x = x if own else x.astype(U64, copy=True)
    spare = np.empty(min(len(x), _CACHED), U64)
    for lo in range(0, len(x), _CACHED):
        v = x[lo : lo + _CACHED]
        _mix(v, spare[: len(v)])
    return x


def blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros follow the last byte."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span of bytes; equal bytes give equal hashes, another seed gives independent ones."""
    size = end - start
    out = mix64(size.astype(U64) * _LEFT + U64((seed * 0x2545F4914F6CDD1D + 1) % (1 << 64)), own=True)
    if not len(size):
        return out
    at, all_blocks = np.flatnonzero(size <= _LONG), blocks(data)
    done = 0
    while len(at):
        value = all_blocks[start[at] + done]
        value &= FIRST[np.minimum(size[at] - done, 8)]
        value ^= out[at] * _CHAIN
        out[at] = mix64(value, own=True)
        done += 8
        at = at[size[at] > done]
    salt = seed.to_bytes(8, "little")
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = int.from_bytes(blake2b(data[start[i] : end[i]], digest_size=8, salt=salt).digest(), "little")
    return out


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One value for two, mixed so that neither order nor sums survive."""
    return mix64((left * _LEFT ^ (right >> U64(32) | right << U64(32))) + right * _RIGHT, own=True)


@lru_cache(maxsize=8)
def _factors(k: int) -> np.ndarray:
    """Odd factors without any relation to each other."""
    return mix64(np.arange(0x9E37, 0x9E37 + k, dtype=U64) * _CHAIN, own=True) | U64(1)


def combined(values: np.ndarray, k: int, apart: int = 1) -> np.ndarray:
    """Hashes of all runs of k values that stand `apart` from one another: sums with unrelated odd factors, mixed.

    The values are hashes already, whose sums have no pattern; a polynomial's factors, powers of one number, would make one.
    """
    n, factors = len(values) - (k - 1) * apart, _factors(k)
    if n <= 0:
        return np.zeros(0, U64)
    out, spare = np.empty(n, U64), np.empty(min(n, _CACHED), U64)
    for lo in range(0, n, _CACHED):
        hi = min(n, lo + _CACHED)
        v, t = out[lo:hi], spare[: hi - lo]
        np.multiply(values[lo:hi], factors[0], out=v)
        for j in range(1, k):
            np.multiply(values[lo + j * apart : hi + j * apart], factors[j], out=t)
            np.add(v, t, out=v)
        _mix(v, t)
    return out


class Texts:
    """The texts of a chunk of rows: `data` bytes, row r is data[offsets[r]:offsets[r + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def row_bytes(self, r: int) -> bytes:
        return self.data[self.offsets[r] : self.offsets[r + 1]].tobytes()

    def byte_lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def pieces(self, most: int = CHUNK_BYTES) -> Iterator[tuple[int, Texts]]:
        """The first row and the texts of slices of about `most` bytes; no text is cut."""
        begin = 0
        while begin < len(self):
            end = int(np.searchsorted(self.offsets, self.offsets[begin] + most, "right")) - 1
            end = min(max(end, begin + 1), len(self))
            lo, hi = self.offsets[begin], self.offsets[end]
            yield begin, Texts(self.data[lo:hi], self.offsets[begin : end + 1] - lo)
            begin = end

    def lowered(self) -> Texts:
        return Texts(LOWER[self.data], self.offsets)


class Words:
    """Words of a chunk: word w is data[start[w]:end[w]] of row[w]; row r has words first[r]:first[r + 1]."""

    def __init__(self, texts: Texts, kind: np.ndarray = NOT_SPACE):
        self.texts, self._spaced = texts, None
        data, offsets = texts.data, texts.offsets
        inside = kind[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        begins[edges] = inside[edges]
        self.start = np.flatnonzero(begins)
        stops = inside
        if len(data):
            stops = inside.copy()
            stops[:-1] &= ~inside[1:]
            stops[edges - 1] = inside[edges - 1]
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return span_hashes(self.texts.data, self.start, self.end, seed)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of k words that lie in one row, and the windows' hashes."""
        at = np.arange(max(0, len(hashes) - k + 1))
        at = at[self.row[at] == self.row[at + k - 1]] if len(at) else at
        return at, combined(hashes, k)[at]

    def spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """The words one after the other, each followed by a space, and where each begins (and the last one ends)."""
        if self._spaced is None:
            size = self.end - self.start
            first = np.concatenate([[0], np.cumsum(size + 1)])
            out = np.full(int(first[-1]), 0x20, np.uint8)
            out[ranges(first[:-1], size)] = self.texts.data[ranges(self.start, size)]
            self._spaced = out, first
        return self._spaced

    def exact(self) -> np.ndarray:
        """A number for each word, by its bytes: equal words have equal ones, different words different ones."""
        data, first = self.spaced()
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(first.astype(np.int64)), pa.py_buffer(data)])
        return numbered(column)


def numbered(column: pa.Array) -> np.ndarray:
    """Equal values by equal numbers, counted from 0 in order of appearance."""
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def named(values: np.ndarray, k: int) -> np.ndarray:
    """Numbers for all runs of k values (numbers below 2**31): equal runs have equal ones, different runs different ones."""
    n, width = len(values), 1
    if n < k:
        return np.zeros(0, np.int64)
    both = lambda x, y: x << 32 | y
    while 2 * width <= k:
        values = numbered(pa.array(both(values[:-width], values[width:])))
        width *= 2
    return both(values[: n - k + 1], values[k - width :]) if width < k else values


#: Odd factors of the rolling hash.
_ROLL_BASE = 0x9E3779B9
_ROLL_VALUES = mix64(np.arange(1, 257, dtype=U64)).astype(np.uint32) | np.uint32(1)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**32 for i < n."""
    out = []
    for b in (base, pow(base, -1, 1 << 32)):
        p = np.full(n, b, np.uint32)
        p[:1] = 1
        out.append(np.multiply.accumulate(p, dtype=np.uint32))
    return out[0], out[1]


def rolling_hashes(texts: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all k-byte strings of the chunk's bytes but those across rows, with 32-bit hashes: cheap, for places to cut at."""
    n = len(texts.data)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    power, inverse = _powers(_ROLL_BASE, 1 << max(12, n.bit_length()))
    total = np.zeros(n + 1, np.uint32)
    np.cumsum(_ROLL_VALUES[texts.data] * power[:n], out=total[1:])
    mixed = (total[k:] - total[:-k]) * inverse[: n - k + 1]
    inside = np.ones(n - k + 1, bool)
    edges = texts.offsets[(texts.offsets > 0) & (texts.offsets < n)]
    inside[np.maximum(edges[:, None] - np.arange(1, k), 0).ravel().clip(0, n - k)] = False
    return np.flatnonzero(inside), ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(8))[inside]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length)."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(np.asarray(starts, np.int64) - before, lengths) + np.arange(total)


def sliding_argmin(keys: np.ndarray, k: int) -> np.ndarray:
    """For each of the len(keys) - k + 1 windows of k keys, the leftmost place of the smallest upper half of a key.

    A place is packed below the upper 32 bits of its key, so plain minima carry it.
    Blocks of k places: a window is the end of one block and the start of the next,
    so running minima from both sides of each block give all windows' minima.
    """
    n = len(keys)
    if n < k:
        return np.zeros(0, np.int64)
    whole = -(-n // k) * k
    packed = np.full(whole, np.iinfo(np.uint64).max, U64)
    np.bitwise_or(keys & U64(0xFFFFFFFF00000000), np.arange(n, dtype=U64), out=packed[:n])
    grid = packed.reshape(-1, k)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).ravel()
    return (np.minimum(back[: n - k + 1], ahead[k - 1 : n]) & U64(0xFFFFFFFF)).astype(np.int64)


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """One chunk of the whole column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return Texts(raw, offsets - offsets[0])


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the batches with about `most` bytes of text each, together with their texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = texts_of(batch.column(batch.schema.get_field_index(column)))
        for begin, own in whole.pieces(most):
            yield batch.slice(begin, len(own)), own
