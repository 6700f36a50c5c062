"""Words and word hashes of many texts at once, on the UTF-8 bytes of Arrow columns.

Everything here is vectorised over blocks of about a megabyte, so that memory is
bounded by the block or by the single longest text, not by the Arrow batch.
Hashes are 64-bit; where an operator calls a comparison of hashes exact, two
different words or shingles that nobody has chosen for it have the same hash with a
probability of 2**-64.  A word of up to ``LONG`` bytes is a polynomial modulo 2**64; longer
ones, of which some would agree by their structure whatever the base, are sums of mixed bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
LONG = 128
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: One constant for each byte, so that a word's hash is a polynomial in these.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
FOLDED_VALUE = BYTE_VALUE.copy()
FOLDED_VALUE[65:91] = BYTE_VALUE[97:123]
#: Constants of the positions in a shingle.
PLACE = mix(np.arange(101, 133, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)

#: Bytes of words: all but white space (space, tab to carriage return).
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[32, *range(9, 14)]] = False
#: Bytes of words: ASCII letters and digits, and all bytes of characters beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers: dict[str, np.ndarray] = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, at least n of each."""
    if len(_powers["up"]) < n:
        size = max(n, BLOCK + 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        for key, base in (("up", _BASE), ("down", inverse)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[key] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


class Block(NamedTuple):
    """Consecutive texts: rows first..first+len(offsets)-1 of the batch, their bytes and byte offsets."""

    first: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Byte starts and ends of all words, and for each text the number of its first word (one more at the end)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    """Cut a string column (null: empty) into blocks of about ``limit`` bytes, at least one text each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, n)
        yield Block(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def words(block: Block, is_word: np.ndarray) -> Words:
    """Maximal runs of word bytes; a run ends where its text ends."""
    size = len(block.data)
    inside = np.zeros(size + 2, dtype=bool)
    np.take(is_word, block.data, out=inside[1:-1])
    here = inside[1:-1]
    edge = np.zeros(size + 1, dtype=bool)
    edge[block.offsets] = True
    starts = np.flatnonzero(here & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(here & (~inside[2:] | edge[1:])) + 1
    return Words(starts, ends, np.searchsorted(starts, block.offsets))


def hash_spans(block: Block, starts: np.ndarray, ends: np.ndarray, value: np.ndarray = FOLDED_VALUE) -> np.ndarray:
    """64-bit hashes of byte spans in the order of their starts; by default A-Z count as a-z.

    Spans are taken about ``BLOCK`` bytes at a time, so a long text needs no more room than that.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, low + BLOCK)))
        a, b = starts[at:to] - low, ends[at:to] - low
        size = int(b.max())
        up, down = _power_tables(size + 1)
        total = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(value[block.data[low : low + size]] * up[:size], out=total[1:])
        out[at:to] = mix((total[b] - total[a]) * down[a])
        long = np.flatnonzero(ends[at:to] - starts[at:to] > LONG)
        for k in long.tolist():
            out[at + k] = _mixed_bytes(block.data[starts[at + k] : ends[at + k]], value)
        at = to
    return out


def _mixed_bytes(data: np.ndarray, value: np.ndarray) -> np.uint64:
    """The hash of a long span: every byte mixed with its place."""
    total = np.zeros(1, dtype=np.uint64)
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        places = np.arange(at, at + len(part), dtype=np.uint64) * np.uint64(_BASE)
        total += mix(value[part] ^ places).sum(dtype=np.uint64)
    return mix(total + np.uint64(len(data)))[0]


def hash_word(word: str) -> np.uint64:
    """The hash that ``hash_spans`` gives the UTF-8 bytes of a word."""
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    block = Block(0, raw, np.array([0, len(raw)]))
    return hash_spans(block, np.array([0]), np.array([len(raw)]))[0]


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k-1 positions are left out."""
    n = max(0, len(hashes) - k + 1)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        total += hashes[i : i + n] * PLACE[i]
    return mix(total + np.uint64(k))


def text_shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct, sorted hashes of one text's k-word shingles; fewer words: all words as one; no words: none."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    return np.unique(shingles(hashes, min(n, k)))


def same_text_positions(first: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """For each of the n_words-k+1 windows: whether all its words belong to one text."""
    n = max(0, n_words - k + 1)
    last = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + k <= last
