"""Damage rulers without a model: token edit distance, BLEU, PSNR, SSIM; all but SSIM as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import IMAGE, TEXT, severity_column
from . import corrupt
from .corrupt import let

PSNR_CAP = 60.0
#: Words of pairs whose n-grams are compared one by one, and words of a batch that are corrupted at once.
FEW_WORDS, WORDS = 32, 1 << 16


def token_edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two word arrays, unit costs.

    Each distinct word of the two becomes a character of its own (there are a million beyond
    the basic plane), so that the engine's string distance counts words.
    """
    def coded(words: Column, known: Column) -> Column:
        code = F.transform(words, lambda w: F.lpad(F.hex(F.array_position(known, w) + 0xFFFF), 8, "0"))
        return F.decode(F.unhex(F.array_join(code, "")), "UTF-32")

    return let(F.array_union(a, b), lambda known: F.levenshtein(coded(a, known), coded(b, known)))


def normalised_edit_distance(a: Column, b: Column) -> Column:
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(token_edit_distance(a, b) / F.greatest(longest, F.lit(1)))


def ngrams(words: Column, n: int) -> Column:
    count = F.size(words) - n + 1
    spots = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.array_join(F.slice(words, i, n), "\x01"))


def numbered(grams: Column) -> Column:
    """The n-grams in order, each with the number of its copy, so that counts can be compared as sets."""
    number = lambda ranked: F.transform(ranked, lambda g, i: F.concat(g, F.lit("\x02"), (i - F.array_position(ranked, g)).cast("string")))
    return let(F.array_sort(grams), number)


def clipped_matches(hypothesis: Column, reference: Column, n: int) -> Column:
    """For each distinct n-gram the smaller of its counts, summed."""
    return F.size(F.array_intersect(numbered(ngrams(hypothesis, n)), numbered(ngrams(reference, n))))


def bleu4(hypothesis: Column, reference: Column) -> Column:
    """Sentence BLEU of up to 4-grams; zero counts are smoothed to 0.1, no shared word gives 0, two empty texts 1."""
    hyp, ref = F.size(hypothesis), F.size(reference)
    penalty = F.when(hyp > ref, F.lit(1.0)).otherwise(F.exp(1 - ref / F.greatest(hyp, F.lit(1))))

    def score(matches: Column) -> Column:
        share = F.transform(matches, lambda m, i: F.log(F.when(m == 0, F.lit(0.1)).otherwise(m.cast("double")) / F.greatest(F.lit(1), hyp - i)))
        mean = F.aggregate(share, F.lit(0.0), lambda s, x: s + x) / 4
        return F.when((hyp == 0) & (ref == 0), F.lit(1.0)).when((hyp == 0) | (F.get(matches, F.lit(0)) == 0), F.lit(0.0)).otherwise(penalty * F.exp(mean))

    return let(F.array(*[clipped_matches(hypothesis, reference, n) for n in range(1, 5)]), score)


def _matrix(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, fill: int) -> np.ndarray:
    """Rows of codes of different lengths, filled up."""
    spot = np.arange(int(sizes.max(initial=0)))
    inside = spot < sizes[:, None]
    return np.where(inside, codes[np.where(inside, starts[:, None] + spot, 0)], fill) if len(codes) else np.full(inside.shape, fill)


def edit_distances(codes: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], cells: int = 1 << 16) -> np.ndarray:
    """Levenshtein distances of many pairs of runs of ``codes`` (starts, sizes), a row of all their tables at a time.

    Pairs of like length are taken together, as many as have ``cells`` words on either side, or one.
    """
    out = np.zeros(len(a[0]), dtype=np.int64)
    longest = np.maximum(a[1], b[1])
    order, at = np.argsort(longest, kind="stable"), 0
    while at < len(order):
        near = order[at : at + 4096]
        fits = np.arange(1, len(near) + 1) * (longest[near] + 1) <= cells
        rows = near[: max(1, int(fits.sum()))]
        at += len(rows)
        x, y = (_matrix(codes, s[rows], n[rows], fill).T.astype(np.int32, order="C") for (s, n), fill in ((a, -1), (b, -2)))
        kind = np.int16 if len(x) + len(y) < 1 << 14 else np.int32
        spot = np.arange(len(y) + 1, dtype=kind)[:, None]
        row, done = np.repeat(spot, len(rows), axis=1), a[1][rows]
        for i in range(len(x)):
            new = row + kind(1)
            np.minimum(new[1:], row[:-1] + (y != x[i]), out=new[1:])
            if len(rows) < len(y):
                new = np.minimum.accumulate(new - spot, axis=0) + spot
            else:  # the same, a word at a time of all pairs
                for j in range(1, len(new)):
                    np.minimum(new[j], new[j - 1] + kind(1), out=new[j])
            row = np.where(i < done, new, row) if i >= done.min() else new
        out[rows] = row[b[1][rows], np.arange(len(rows))]
    return out


def _grams(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit number for each n-gram of each run, in which its run takes part, and the run."""
    count = np.maximum(sizes - n + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), count)
    spot = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)
    key = owner.astype(np.uint64)
    for i in range(n):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + codes[spot + i].astype(np.uint64) + np.uint64(1)
    return key ^ (key >> np.uint64(32)), owner


def _few_matches(codes: np.ndarray, hyp: tuple[np.ndarray, np.ndarray], ref: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Clipped matches of n-grams, n from 1 to 4, of pairs of few words: each n-gram is compared with all of the other side, and with its earlier copies."""
    x, y = (_matrix(codes, *runs, fill).T.astype(np.int32, order="C") for runs, fill in ((hyp, -1), (ref, -2)))
    out = np.zeros((4, len(hyp[1])))
    ones = x[:, None] == y[None], (x[:, None] == x[None]) & np.tri(len(x), k=-1, dtype=bool)[:, :, None]
    found, copies = ones
    for n in range(4):
        if n:
            found, copies = (part[:-1, :-1] & one[n:, n:] for part, one in zip((found, copies), ones, strict=True))
        if not found.size:
            break
        there, before = (part.view(np.uint8).sum(axis=1, dtype=np.uint8) for part in (found, copies))
        out[n] = (before < there).sum(axis=0)
    return out


def _many_matches(codes: np.ndarray, hyp: tuple[np.ndarray, np.ndarray], ref: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The same of any pairs, by sorting their n-grams."""
    out = np.zeros((4, len(hyp[1])))
    for n in range(1, 5):
        (one, mine), (two, other) = _grams(codes, *hyp, n), _grams(codes, *ref, n)
        keys, place = np.unique(np.concatenate([one, two]), return_inverse=True)
        owner = np.zeros(len(keys), dtype=np.int64)
        owner[place] = np.concatenate([mine, other])
        both = np.minimum(np.bincount(place[: len(one)], minlength=len(keys)), np.bincount(place[len(one) :], minlength=len(keys)))
        out[n - 1] = np.bincount(owner, weights=both, minlength=len(hyp[1]))
    return out


def bleu_scores(codes: np.ndarray, hyp: tuple[np.ndarray, np.ndarray], ref: tuple[np.ndarray, np.ndarray], cells: int = 1 << 18) -> np.ndarray:
    """Sentence BLEU of many pairs (see ``bleu4``)."""
    h, r = hyp[1], ref[1]
    longest, matches = np.maximum(h, r), np.zeros((4, len(h)))
    order, at = np.argsort(longest, kind="stable"), 0
    few = int(np.searchsorted(longest[order], FEW_WORDS, side="right"))
    while at < few:
        near = order[at : min(few, at + 4096)]
        rows = near[: max(1, int((np.arange(1, len(near) + 1) * longest[near] ** 2 <= cells).sum()))]
        at += len(rows)
        matches[:, rows] = _few_matches(codes, (hyp[0][rows], h[rows]), (ref[0][rows], r[rows]))
    if len(rows := order[few:]):
        matches[:, rows] = _many_matches(codes, (hyp[0][rows], h[rows]), (ref[0][rows], r[rows]))
    logs = sum(np.log(np.where(m == 0, 0.1, m) / np.maximum(1, h - n)) for n, m in enumerate(matches)) / 4
    penalty = np.where(h > r, 1.0, np.exp(1 - r / np.maximum(h, 1)))
    return np.where((h == 0) & (r == 0), 1.0, np.where((h == 0) | (matches[0] == 0), 0.0, penalty * np.exp(logs)))


def _runs(column: pa.Array, shift: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.cumsum(sizes) - sizes + shift, sizes


_RULERS = T.StructType([T.StructField("edit", T.DoubleType()), T.StructField("bleu", T.DoubleType())])


def _ruled(codes: np.ndarray, original: tuple[np.ndarray, np.ndarray], changed: tuple[np.ndarray, np.ndarray], edits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    longest = np.maximum(original[1], changed[1])
    edits = edit_distances(codes, original, changed) if edits is None else edits
    edit = np.where(longest == 0, 0.0, edits / np.maximum(longest, 1))
    return edit, bleu_scores(codes, changed, original)


def _coded(*parts: pa.Array) -> np.ndarray:
    """A number for each word: equal ones for equal words."""
    return pa.concat_arrays([x.cast(pa.string()) for x in parts]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


@F.arrow_udf(_RULERS)
def text_rulers(original: pa.Array, changed: pa.Array) -> pa.Array:
    """Normalised edit distance, and BLEU of the changed words, of two word arrays; whole Arrow batches at a time (null: no words)."""
    flat = [original.flatten(), changed.flatten()]
    found = _ruled(_coded(*flat), _runs(original, 0), _runs(changed, len(flat[0])))
    return pa.StructArray.from_arrays([pa.array(x) for x in found], ["edit", "bleu"])


@F.arrow_udf(T.ArrayType(_RULERS))
def corrupted_rulers(words: pa.Array, key: pa.Array, level: pa.Array) -> pa.Array:
    """``text_rulers`` of the words and of each text corruption of them, in the order of ``TEXT``; the changed words are made as numbers, ``WORDS`` of a batch at a time."""
    sizes, keys, levels = corrupt.arrow_rows(words, key, level)
    codes = _coded(words.flatten(), pa.array(corrupt.VOCABULARY))
    vocabulary, ends = codes[len(codes) - len(corrupt.VOCABULARY) :], np.cumsum(sizes)
    found, left = np.empty((2, len(sizes), len(TEXT))), 0
    while left < len(sizes):
        first = int(ends[left] - sizes[left])
        right = max(left + 1, int(np.searchsorted(ends, first + WORDS, side="right")))
        n, own = sizes[left:right], codes[first : ends[right - 1]]
        for i, kind in enumerate(TEXT):
            source, new = corrupt.sources(kind, keys[left:right], n, corrupt.levelled(kind, n, levels[left:right]))
            made = np.where(source < 0, vocabulary[np.where(source < 0, -1 - source, 0)], own[np.maximum(source, 0)])
            edits = n - new if kind == "mask" else None  # what only loses words is as far away as it lost
            found[:, left:right, i] = _ruled(np.concatenate([own, made]), (np.cumsum(n) - n, n), (np.cumsum(new) - new + len(own), new), edits)
        left = right
    rulers = pa.StructArray.from_arrays([pa.array(x.ravel()) for x in found], ["edit", "bleu"])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * len(TEXT), pa.int32()), rulers)


def psnr(mse: Column) -> Column:
    """Decibels on the 0..255 scale, capped."""
    return F.when(mse <= 1e-12, F.lit(PSNR_CAP)).otherwise(F.least(F.lit(PSNR_CAP), 20 * F.log10(F.lit(255.0)) - 10 * F.log10(F.greatest(mse, F.lit(1e-300)))))


def mean_squared_error(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return total / F.greatest(F.size(a), F.lit(1))


def normal(*parts: Column) -> Column:
    """A standard normal number of a key: the polar transform of two 32-bit halves of its hash, so any engine repeats it; tails reach 6.6."""
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    one, two = (F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("double") for k in (0, 1))
    return F.sqrt(-2.0 * F.log((one + 1.0) / 4294967296.0)) * F.cos(2.0 * float(np.pi) * (two / 4294967296.0))


def noise(pixels: Column, key: Column, sigma: Column) -> Column:
    """Add normal noise to every number, clip and cut to whole values."""
    return F.transform(pixels, lambda p, i: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), p + sigma * normal(F.lit("noise"), key, i)))).cast("double"))


def cutout(pixels: Column, key: Column, side: int | Column, fraction: Column, channels: int = 1) -> Column:
    """Blacken one near-square of about ``fraction`` of a side x side picture at a place given by a hash, in all channels."""
    side = F.lit(side) if isinstance(side, int) else side
    area = F.greatest(F.lit(1), F.floor(fraction * side * side).cast("int"))
    w = F.least(side, F.floor(F.sqrt(area)).cast("int"))
    h = F.least(side, F.floor(area / F.greatest(w, F.lit(1))).cast("int"))
    place = F.md5(F.concat_ws("|", F.lit("cutout"), key))
    number = lambda k: F.conv(F.substring(place, 1 + 8 * k, 8), 16, 10).cast("long")
    left, top = (number(0) % (side - w + 1)).cast("int"), (number(1) % (side - h + 1)).cast("int")
    box = F.struct(left.alias("x"), top.alias("y"), (left + w).alias("right"), (top + h).alias("bottom"))
    spot = lambda i: F.floor(i / channels).cast("int")
    x, y = lambda i: spot(i) % side, lambda i: F.floor(spot(i) / side).cast("int")
    inside = lambda b, i: (x(i) >= b["x"]) & (x(i) < b["right"]) & (y(i) >= b["y"]) & (y(i) < b["bottom"])
    return let(box, lambda b: F.transform(pixels, lambda p, i: F.when(inside(b, i), F.lit(0.0)).otherwise(p)))


def _windows(images: np.ndarray, size: int = 7) -> np.ndarray:
    """Means over all windows of each image of a stack (images, rows, columns)."""
    total = np.zeros((images.shape[0], images.shape[1] + 1, images.shape[2] + 1))
    total[:, 1:, 1:] = images.cumsum(1).cumsum(2)
    return (total[:, size:, size:] - total[:, :-size, size:] - total[:, size:, :-size] + total[:, :-size, :-size]) / (size * size)


def ssim_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean structural similarity of each pair of a stack, over 7 x 7 windows with sample covariance; values 0..255.

    Stacks are (images, rows, columns) or, with channels, (images, rows, columns, channels): then the mean over channels.
    """
    if a.shape != b.shape or min(a.shape[1:3]) < 7:
        raise ValueError("two images of one shape, at least 7 pixels a side, are needed")
    if a.ndim == 4:
        return np.mean([ssim_of(a[..., c], b[..., c]) for c in range(a.shape[3])], axis=0)
    unbiased = 49 / 48
    ma, mb = _windows(a), _windows(b)
    va, vb, vab = (unbiased * (_windows(x * y) - mx * my) for x, y, mx, my in ((a, a, ma, ma), (b, b, mb, mb), (a, b, ma, mb)))
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return (((2 * ma * mb + c1) * (2 * vab + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean(axis=(1, 2))


def blur_of(images: np.ndarray, radius: float) -> np.ndarray:
    """Separable Gaussian blur of a stack, edges repeated, rounded to whole values."""
    reach = max(1, int(np.ceil(3 * radius)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / radius) ** 2)
    kernel /= kernel.sum()
    out = images
    for axis in (1, 2):
        padded = np.pad(out, [(reach, reach) if k == axis else (0, 0) for k in range(out.ndim)], mode="edge")
        n = out.shape[axis]
        out = sum(w * np.take(padded, range(i, i + n), axis) for i, w in enumerate(kernel))
    return np.rint(out)


def _stacks(*columns: pd.Series, channels: int = 1) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Rows whose square images have one size, and their images as stacks."""
    sizes = columns[0].map(len).to_numpy()
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        side = int(round((size / channels) ** 0.5))
        shape = (len(rows), side, side) if channels == 1 else (len(rows), side, side, channels)
        yield rows, [np.array(c.iloc[rows].tolist(), dtype=float).reshape(shape) for c in columns]


def _ssim(channels: int):
    @F.pandas_udf(T.DoubleType())
    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in pairs:
            out = np.empty(len(a))
            for rows, (x, y) in _stacks(a, b, channels=channels):
                out[rows] = ssim_of(x, y)
            yield pd.Series(out)

    return run


#: SSIM of two square images given as arrays: of one channel, and of interleaved red, green and blue.
ssim, ssim_rgb = _ssim(1), _ssim(3)


def _blur(channels: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for images, radii in pairs:
            out = np.empty(len(images), dtype=object)
            for radius in radii.dropna().unique():
                own = np.flatnonzero((radii == radius).to_numpy())
                for rows, (x,) in _stacks(images.iloc[own], channels=channels):
                    for row, image in zip(own[rows], blur_of(x, float(radius)), strict=True):
                        out[row] = image.ravel()
            yield pd.Series(out)

    return run


#: Blurred square pictures (one channel, or interleaved red, green and blue); the second column is the radius, null for none.
gaussian_blur, gaussian_blur_rgb = _blur(1), _blur(3)


def corrupt_image(kind: str, pixels: Column, key: Column, level: Column, side: int | Column, channels: int = 1) -> Column:
    """A corrupted square picture of one or three channels; ``none`` and severity 0 leave it alone, unknown kinds raise."""
    if kind == "none":
        return pixels
    if kind not in IMAGE:
        raise KeyError(f"unknown corruption: {kind}")
    share = severity_column(kind, level)
    blur = gaussian_blur if channels == 1 else gaussian_blur_rgb
    made = {"gaussian_noise": lambda: noise(pixels, key, share), "gaussian_blur": lambda: blur(pixels, share), "cutout": lambda: cutout(pixels, key, side, share, channels)}[kind]()
    return F.when(level == 0, pixels).otherwise(made)
