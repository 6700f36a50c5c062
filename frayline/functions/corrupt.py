"""Text corruptions of whole Arrow batches, and word tools as column expressions: the choice of positions is by hash rank, so it is repeatable."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SEVERITY, TEXT, severity
from . import draws

#: Replacement words, by a rule: syllable pairs.
VOCABULARY = tuple(a + b for a in ("ba", "ke", "li", "mo", "nu", "ra", "si", "to") for b in ("den", "fal", "gor", "mit", "nes", "pul", "rik", "sam"))


def words_of(text: Column) -> Column:
    """Non-empty words between blanks, those beyond ASCII included."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def affected(n: Column, fraction: Column) -> Column:
    """How many of n words a fraction affects: at least one, at most all, halves to even; none of none."""
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.least(n, F.rint(fraction * n).cast("int")))).cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: inside another function's lambda it would be again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def levelled(kind: str, sizes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """How many words each row's level affects (see ``affected``): none at level 0; levels beyond 5 raise."""
    if len(levels) and not ((levels >= 0) & (levels <= len(SEVERITY[kind]))).all():
        raise ValueError("severities must be 0 to 5")
    k = np.maximum(1, np.minimum(sizes, np.rint(np.array([0.0, *SEVERITY[kind]])[levels] * sizes).astype(np.int64)))
    return np.where((levels == 0) | (sizes == 0), 0, k)


def salted(salt: str, keys: list[bytes]) -> list[bytes]:
    return [salt.encode() + k for k in keys]


def sources(kind: str, keys: list[bytes], sizes: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the changed rows comes from (its place among all words, or ``-1 - v`` for a vocabulary word), and the rows' new sizes.

    ``keys`` have a ``|`` in front.  mask deletes k words, shuffle permutes the words of k places (two
    at least; fewer than two words stay), replace puts vocabulary words at k places.
    """
    owner, spot = draws.places(sizes)
    at = np.arange(len(owner))
    if kind == "shuffle":
        k = np.where((sizes < 2) | (k == 0), 0, np.maximum(k, 2))
    hit = draws.chosen(salted(kind, keys), sizes, k)
    if kind == "mask":
        return at[~hit], sizes - np.bincount(owner[hit], minlength=len(sizes))
    some = np.flatnonzero(hit)
    if kind == "shuffle":
        at[some] = some[draws.in_order(owner[some], draws.hashes(salted("permute", keys), owner[some], spot[some]))]
    else:
        at[some] = -1 - (draws.hashes(salted("word", keys), owner[some], spot[some])[0] % len(VOCABULARY)).astype(np.int64)
    return at, sizes


def arrow_rows(words: pa.Array, key: pa.Array, level: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Sizes (null: none), keys with a ``|`` in front (null: left out, as ``concat_ws`` does) and levels of a batch."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    keys = [b"" if k is None else b"|" + k.encode() for k in key.to_pylist()]
    return sizes, keys, pc.fill_null(level, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _changed(kind: str):
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(words: pa.Array, key: pa.Array, level: pa.Array) -> pa.Array:
        sizes, keys, levels = arrow_rows(words, key, level)
        source, sizes = sources(kind, keys, sizes, levelled(kind, sizes, levels))
        flat = words.flatten().cast(pa.string())
        taken = pa.concat_arrays([flat, pa.array(VOCABULARY)]).take(pa.array(np.where(source < 0, len(flat) - 1 - source, source)))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), taken, mask=words.is_null())

    return run


_CHANGED = {kind: _changed(kind) for kind in TEXT}


def corrupt_text(kind: str, words: Column, key: Column, level: Column | int) -> Column:
    """Corrupted words; ``none`` and severity 0 leave them alone, unknown kinds raise."""
    if kind == "none":
        return words
    if kind not in TEXT:
        raise KeyError(f"unknown corruption: {kind}")
    if isinstance(level, int):
        if level == 0:
            return words
        severity(kind, level)
        level = F.lit(level)
    return _CHANGED[kind](words, key, level)
