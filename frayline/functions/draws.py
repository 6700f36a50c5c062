"""Random draws of whole Arrow batches: md5 of ``head|place`` for every place of every row, as numpy arrays.

The draws are those of ``md5(concat_ws('|', salt, key, i))``, so any engine repeats them; a short
message is one block of md5, which all messages go through together.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Messages that go through md5 together (its arrays stay in the cache), and the longest message of one block.
CHUNK, SHORT = 8192, 55
_TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel()
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], dtype=np.uint32)


def _md5(words: np.ndarray) -> np.ndarray:
    """The four numbers (big-endian) of the md5 of each column of 16 words, padded messages of one block."""
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in _START)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            at = 7 * i % 16
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _SINES[i]
        f += words[at]
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=g)
        f <<= np.uint32(_TURNS[i])
        f |= g
        f += b
        a, d, c, b, f = d, c, b, f, a
    return np.stack([x + s for x, s in zip((a, b, c, d), _START, strict=True)]).byteswap()


def hashes(heads: list[bytes], owner: np.ndarray, spot: np.ndarray) -> np.ndarray:
    """Four 32-bit numbers, from the front of the digest, of ``heads[owner]|spot`` (columns are the pairs)."""
    out = np.empty((4, len(owner)), np.uint32)
    if not len(owner):
        return out
    sizes = np.fromiter(map(len, heads), np.int64, len(heads)) + 1
    digits = np.searchsorted(10 ** np.arange(1, 19), spot, side="right") + 1
    longest = sizes[owner] + digits
    rows = np.array(heads, dtype="S64").view(np.uint8).reshape(-1, 64)
    rows[np.arange(len(heads)), np.minimum(sizes, 64) - 1] = ord("|")
    short = np.flatnonzero(longest <= SHORT)
    for left in range(0, len(short), CHUNK):
        own = short[left : left + CHUNK]
        text, start, place, many, n = rows[owner[own]], sizes[owner[own]], spot[own], digits[own], np.arange(len(own))
        for k in range(int(many.max())):
            part = n[many > k] if k else n
            text[part, (start + many)[part] - 1 - k] = 48 + place[part] // 10**k % 10
        text[n, start + many] = 128
        words = text.view("<u4").T.copy()
        words[14] = 8 * (start + many)
        out[:, own] = _md5(words)
    for i in np.flatnonzero(longest > SHORT):
        out[:, i] = np.frombuffer(hashlib.md5(heads[owner[i]] + b"|%d" % spot[i]).digest(), ">u4")
    return out


def places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the place in it (from 0) of each element of rows of these sizes."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def in_order(owner: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """The order of elements by row, hash and present place; ``owner`` grows."""
    high = (drawn[0].astype(np.uint64) << np.uint64(32)) | drawn[1]
    bits = max(1, int(owner[-1]).bit_length()) if len(owner) else 1
    key = (owner.astype(np.uint64) << np.uint64(64 - bits)) | (high >> np.uint64(bits))
    order = np.argsort(key)
    ranked = key[order]
    if (ranked[1:] == ranked[:-1]).any():  # the rest of the hash has to tell them apart
        order = np.lexsort((drawn[3], drawn[2], high, owner))
    return order


def chosen(heads: list[bytes], sizes: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether each place of each row is one of the ``k`` of the smallest hashes."""
    owner, spot = places(sizes)
    order = in_order(owner, hashes(heads, owner, spot))
    out = np.empty(len(owner), bool)
    out[order] = spot < k[owner]  # sorted by row, so the n-th of a row has the rank n
    return out
