"""Vectorised text helpers shared by the corpus operators: blocks of documents, words and their hashes.

Everything works on UTF-8 bytes in numpy, a few megabytes at a time, so a task's memory does not
depend on how many rows its partition holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 21

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over all 64 output bits."""
    h = h ^ (h >> U64(30))
    h = h * _M1
    h = h ^ (h >> U64(27))
    h = h * _M2
    return h ^ (h >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * _ODD)
_BASE = 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


class _Powers:
    """Powers of the rolling base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.n = 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16, 2 * self.n)
            self.up = _powers(_BASE, self.n)
            self.down = _powers(pow(_BASE, -1, 1 << 64), self.n)
        return self.up, self.down


_POWERS = _Powers()


def word_table(separators: bytes, lower: bool = True) -> np.ndarray:
    """A 256-entry byte map: separators become 0, ASCII capitals are lowered if asked for."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[np.frombuffer(separators, dtype=np.uint8)] = 0
    return table


#: Words are runs of anything but ASCII white space. NUL is a word byte here: it is mapped to 255, which UTF-8 never uses.
WHITE = bytes([0x20, *range(0x09, 0x0E)])
WHITE_TABLE = word_table(WHITE)
WHITE_TABLE[0] = 255
#: The same with capitals kept.
RAW_TABLE = word_table(WHITE, lower=False)
RAW_TABLE[0] = 255
#: Words are runs of ASCII letters, digits and anything beyond ASCII.
PLAIN = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_plain = word_table(PLAIN, lower=False)
_plain[65:91] = np.arange(97, 123)
PLAIN_TABLE = _plain


class Block:
    """Some whole documents of a batch: `rows` their places in it, `data` their bytes, `offsets` where each starts."""

    def __init__(self, rows: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        self.rows, self.data, self.offsets = rows, data, offsets

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(off, dtype=np.int64, count=column.offset + n + 1)[column.offset :] if n else np.zeros(1, np.int64)
    base = int(offsets[0])
    raw = np.frombuffer(data, dtype=np.uint8)[base : int(offsets[-1])] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - base


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a text column into blocks of whole documents of about `size` bytes; a longer document is a block of its own."""
    data, offsets = text_buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield Block(np.arange(i, j), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def words(block: Block, table: np.ndarray, inner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word, and the index of each document's first word (one more entry at the end).

    A word never crosses a document. `inner` marks bytes at which a word starts though no separator stands before. The hash of a word is its polynomial over the bytes, taken from
    prefix sums modulo 2**64, then mixed.
    """
    data, offsets = table[block.data], block.offsets
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    inside = data != 0
    first = np.empty(n, bool)
    first[0] = inside[0]
    np.greater(inside[1:], inside[:-1], out=first[1:])
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    first[cuts] |= inside[cuts]
    last = np.empty(n, bool)
    last[-1] = inside[-1]
    np.greater(inside[:-1], inside[1:], out=last[:-1])
    before = cuts[cuts > 0] - 1
    last[before] |= inside[before]
    if inner is not None:
        first |= inner
        last[:-1] |= inner[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, offsets, side="left")


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that follow one another without overlap."""
    hashes = np.empty(len(starts), U64)
    step = 1 << 20
    lo = 0
    while lo < len(starts):  # prefix sums over a stretch of whole spans, so that memory stays bounded
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + step, side="right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        up, down = _POWERS.get(b - a + 1)
        sums = np.empty(b - a + 1, U64)
        sums[0] = 0
        np.cumsum(_BYTE[data[a:b]] * up[: b - a], out=sums[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        hashes[lo:hi] = mix((sums[e] - sums[s]) * down[s])
        lo = hi
    return hashes


def run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of consecutive entries, hashes[starts[i] : ends[i]], order kept."""
    up, down = _POWERS.get(len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(hashes * up[: len(hashes)], dtype=U64)])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words (one entry fewer by k-1 than words)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, _ = _POWERS.get(k + 1)
    out = np.zeros(n, U64)
    for j in range(k):
        out += hashes[j : j + n] * up[j + 1]
    return mix(out ^ U64(k))


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where one occurrence of each distinct hash stands, and for every entry the number of its distinct hash.

    A direct table settles most entries without sorting; those whose slot another hash has taken are sorted.
    """
    n = len(hashes)
    bits = max(8, min(18, n.bit_length()))
    slot = (hashes >> U64(64 - bits)).astype(np.int64)
    table = np.zeros(1 << bits, np.int64)
    table[slot] = np.arange(n)
    rep = table[slot]
    lost = np.flatnonzero(hashes[rep] != hashes)
    if len(lost):
        _, first, inverse = np.unique(hashes[lost], return_index=True, return_inverse=True)
        rep[lost] = lost[first][inverse]
    mark = np.zeros(n, bool)
    mark[rep] = True
    firsts = np.flatnonzero(mark)
    number = np.empty(n, np.int64)
    number[firsts] = np.arange(len(firsts))
    return firsts, number[rep]


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Joins the runs flat[starts[i] : starts[i] + lengths[i]] in order."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


def fold64(h: np.ndarray) -> np.ndarray:
    """The same bits as signed longs, as Spark has them."""
    return h.view(np.int64)


def batches(it, columns: list[str]):
    """Arrow batches as lists of the named columns, empty batches left out. After the last one the worker gives memory back."""
    for b in it:
        if b.num_rows:
            yield [b.column(b.schema.get_field_index(c)) for c in columns]
    give_back()


def give_back() -> None:
    """Returns what Arrow and the C library hold free to the system: a worker process lives on through other stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, others need none
    if trim is not None:
        trim(0)
