"""Benchmark decontamination: SimHash fingerprints of item-sized windows, looked up by Hamming blocks, then verified.

A window of similarity s shares shingles of at least the share s of the item's weight, so
only windows that hold enough weight of any benchmark shingles are fingerprinted; nothing is
lost by that, and these are few, so that every window has the whole length of its item and
the radius can be wide.  An edit may still move a fingerprint beyond the radius; for such
items a lookup by a prefix of their shingles is exact: any shingles that weigh more than the
share 1 - s cannot all be missing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable, filter_rows, forget
from .textblocks import NOT_BLANK, Block, blocks, hash_spans, shingles, words

#: Fingerprints of 64 bits within this Hamming distance are candidates: a tenth of the words, the most that
#: may differ at the similarity below, flips 9 bits on average and more than these hardly ever.
RADIUS = 18
#: Words in a shingle, and the weighted Jaccard similarity that a window must reach.
SHINGLE, SIMILARITY = 5, 0.8
#: Items, and bytes of their texts, that a task holds at once; a larger benchmark takes several passes over the corpus.
ITEMS_PER_PASS, BYTES_PER_PASS = 20_000, 32 << 20
#: Windows of a long text are fingerprinted over so many words at a time, and looked up so many at a time.
SEGMENT, WINDOWS = 1 << 16, 1 << 14
#: Bits of a position in a block of texts, in codes of an item and a position.
POSITION = 40
#: Pairs of a window and an item of equal block values that are compared at once.
PAIRS = 1 << 20


def signs(hashes: np.ndarray) -> np.ndarray:
    """A row of 64 values +1 or -1 for each word."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8)).reshape(-1, 64)
    return (bits.astype(np.int8) << 1) - 1


def fingerprints(hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """SimHash of each window of words (starts sorted): the sign of the sum of its words' values, bit by bit.

    Windows that overlap are summed together, over a bounded stretch at a time.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    apart = np.append(np.flatnonzero(starts[1:] > stops[:-1]) + 1, len(starts))
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = min(int(apart[np.searchsorted(apart, at, side="right")]), max(at + 1, int(np.searchsorted(starts, low + SEGMENT))))
        high = int(stops[at:to].max())
        running = np.zeros((high - low + 1, 64), dtype=np.int32)
        np.cumsum(signs(hashes[low:high]), axis=0, dtype=np.int32, out=running[1:])
        total = running[stops[at:to] - low] - running[starts[at:to] - low]
        out[at:to] = np.packbits(total > 0, axis=1).view("<u8").ravel()
        at = to
    return out


class Shingled:
    """An item's 5-word shingles with their counts and weights (letters in the shingle)."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray):
        self.counts, self.weights = weighted(hashes, sizes)
        self.total = sum(n * self.weights[key] for key, n in self.counts.items())
        self.sum = sum(n * key for key, n in self.counts.items()) % (1 << 64)

    def prefix(self, similarity: float, held_by: Counter) -> list[int]:
        """Shingles one of which stands in every window of this similarity: those of the fewest items, the heaviest first."""
        rest, out = max(0.0, 1 - similarity) * self.total * (1 + 1e-9), []
        for key in sorted(self.counts, key=lambda k: (held_by[k], -self.counts[k] * self.weights[k], k)):
            out.append(key)
            rest -= self.counts[key] * self.weights[key]
            if rest < 0:
                break
        return out

    def best(self, keys: np.ndarray, running: np.ndarray, runs: list[tuple[int, int]], n_words: int, end: int) -> tuple[float, int]:
        """Similarity and start of the best window (the first one among ties) that starts in one of the runs.

        ``keys`` are the shingles by position and ``running`` the sums of their weights; windows
        have ``n_words`` words, or fewer where the text ends.
        """
        k = min(SHINGLE, n_words)
        best = 0.0, -1
        for begin, last in runs:
            have: Counter = Counter()
            low, to = 0, begin
            for start in range(begin, last + 1):
                stop = min(start + n_words, end) - k + 1
                for key in keys[to:stop].tolist():
                    if key in self.counts:
                        have[key] += 1
                        low += self.weights[key] * (have[key] <= self.counts[key])
                to = max(to, stop)
                high = self.total + int(running[stop] - running[start]) - low
                if low / high > best[0]:
                    best = low / high, start
                key = int(keys[start])
                if key in self.counts:
                    low -= self.weights[key] * (have[key] <= self.counts[key])
                    have[key] -= 1
        return best

    def similarity(self, hashes: np.ndarray, sizes: np.ndarray) -> float:
        counts, weights = weighted(hashes, sizes)
        low = high = 0
        for key in self.counts.keys() | counts.keys():
            a, b = self.counts.get(key, 0), counts.get(key, 0)
            w = self.weights.get(key) or weights[key]
            low, high = low + w * min(a, b), high + w * max(a, b)
        return low / high if high else 0.0


def weighted(hashes: np.ndarray, sizes: np.ndarray) -> tuple[Counter, dict[int, int]]:
    k = min(SHINGLE, len(hashes))
    if not k:
        return Counter(), {}
    keys = shingles(hashes, k).tolist()
    total = np.convolve(sizes, np.ones(k, dtype=np.int64), mode="valid").tolist()
    return Counter(keys), dict(zip(keys, total, strict=True))


class Index:
    """The benchmark's fingerprints of one window length, by the values of blocks of bits.

    Two fingerprints that differ in fewer than twice as many bits as there are blocks differ in
    at most one bit of some block, so looking up every block's value, and that value with each
    bit flipped, finds all of them.  A block has a bit more than the items' number has, so a value
    is shared by about one item whatever their number: the lookups are then near linear in the windows.
    Many items leave room for few blocks, which narrows ``radius``.
    """

    def __init__(self, length: int, prints: np.ndarray, radius: int):
        self.length, self.prints = length, prints
        count = max(1, min(64 // (len(prints).bit_length() + 1), max(4, radius // 2 + 1)))
        self.radius = min(radius, 2 * count - 1)
        self.flip = self.radius >= count
        cuts = np.linspace(0, 64, count + 1).round().astype(int)
        self.blocks = []
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            shift, mask = np.uint64(low), np.uint64((1 << (high - low)) - 1)
            value = ((prints >> shift) & mask).astype(np.int64)
            order = np.argsort(value, kind="stable")
            start = np.searchsorted(value[order], np.arange((1 << (high - low)) + 1))
            flips = np.concatenate([[0], 1 << np.arange(high - low)]) if self.flip else np.zeros(1, dtype=np.int64)
            self.blocks.append((shift, mask, order, start.astype(np.int32), flips))

    def candidates(self, windows: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(window, item, distance) of all pairs within the radius, each once."""
        for window, item, distance in self.pieces(windows):
            yield from zip(window.tolist(), item.tolist(), distance.tolist(), strict=True)

    def pieces(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The candidates in arrays of bounded size, the nearer ones of an array first."""
        for first in range(0, len(windows), WINDOWS):
            prints = windows[first : first + WINDOWS]
            for number, (shift, mask, order, start, flips) in enumerate(self.blocks):
                value = (((prints >> shift) & mask).astype(np.int64)[:, None] ^ flips).ravel()
                low, many = start[value], start[value + 1] - start[value]
                hits = np.flatnonzero(many)
                low, many, whose = low[hits], many[hits].astype(np.int64), hits // len(flips)
                upto = np.cumsum(many)
                at = 0
                while at < len(hits):
                    to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
                    n = many[at:to]
                    window = np.repeat(whose[at:to], n)
                    item = order[np.repeat(low[at:to] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    yield self._near(prints, window, item, number, first)
                    at = to

    def _near(self, prints: np.ndarray, window: np.ndarray, item: np.ndarray, number: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs that agree in one block: those within the radius that no earlier block has found."""
        apart = prints[window] ^ self.prints[item]
        distance = np.bitwise_count(apart)
        good = np.flatnonzero(distance <= self.radius)
        for shift, mask, *_ in self.blocks[:number]:
            good = good[np.bitwise_count((apart[good] >> shift) & mask) > self.flip]
        good = good[np.argsort(distance[good], kind="stable")]
        return window[good] + first, item[good], distance[good]


class Keys:
    """A sorted set of shingles with a bitmap in front of it."""

    def __init__(self, keys: set[int]):
        self.keys = np.array(sorted(keys), dtype=np.uint64)
        self.shift = np.uint64(64 - min(24, max(16, 3 + len(self.keys).bit_length())))
        self.maybe = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.maybe[(self.keys >> self.shift).astype(np.int64)] = True

    def hits(self, keys: np.ndarray) -> np.ndarray:
        """Positions of shingles of the set."""
        at = np.flatnonzero(self.maybe[(keys >> self.shift).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        return at[self.keys[slot] == keys[at]]


class Item:
    def __init__(self, key: int, hashes: np.ndarray, sizes: np.ndarray):
        self.key, self.n_words, self.shingled = key, len(hashes), Shingled(hashes, sizes)
        self.print = fingerprints(hashes, np.array([0]), np.array([len(hashes)]))[0]


class Group:
    """Items whose shingles have ``k`` words: their shingles, prefixes, and an index for each length."""

    def __init__(self, k: int, items: list[Item], radius: int, similarity: float):
        self.k, self.items = k, items
        held_by = Counter(key for item in items for key in item.shingled.counts)
        self.known = Keys(set(held_by))
        prefix: list[tuple[int, int]] = []
        by_length: dict[int, list[int]] = {}
        for number, item in enumerate(items):
            for key in item.shingled.prefix(similarity, held_by):
                prefix.append((key, number))
            by_length.setdefault(item.n_words, []).append(number)
        prefix.sort()
        self.prefix = np.array([key for key, _ in prefix], dtype=np.uint64)
        self.prefix_item = np.array([number for _, number in prefix], dtype=np.int64)
        self.lengths = []
        for length, numbers in sorted(by_length.items()):
            least = min(items[x].shingled.total for x in numbers) * similarity * (1 - 1e-9)
            self.lengths.append((length, least, np.array(numbers), Index(length, np.array([items[x].print for x in numbers], dtype=np.uint64), radius)))
        self.least = min(x[1] for x in self.lengths)

    def spots(self, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sorted codes (item, position) of the prefix shingles that stand at these positions."""
        low = np.searchsorted(self.prefix, keys[at], side="left")
        many = np.searchsorted(self.prefix, keys[at], side="right") - low
        item = self.prefix_item[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        return np.sort((item << POSITION) + np.repeat(at, many))

    def find(self, hashes: np.ndarray, sizes: np.ndarray, first: np.ndarray, similarity: float) -> Iterator[tuple[int, Item, int, int, int, float]]:
        """(text, item, start, words, distance, similarity) of the best window of each item that a text holds."""
        k = self.k
        keys = shingles(hashes, k)
        hits = self.known.hits(keys)
        texts = np.searchsorted(first, hits, side="right") - 1
        whole = hits + k <= first[texts + 1]
        hits, texts = hits[whole], texts[whole]
        if not len(hits):
            return
        weights = np.concatenate([[0], np.cumsum(np.convolve(sizes, np.ones(k, dtype=np.int64), mode="valid"))])
        own = weights[hits + 1] - weights[hits]
        heavy = np.flatnonzero(np.bincount(texts, weights=own, minlength=len(first) - 1) >= self.least)
        if not len(heavy):
            return
        sizes_of = first[heavy + 1] - first[heavy]
        places = np.repeat(first[heavy] - (np.cumsum(sizes_of) - sizes_of), sizes_of) + np.arange(sizes_of.sum())
        ends = np.repeat(first[heavy + 1], sizes_of)
        places, ends = places[places + k <= ends], ends[places + k <= ends]
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(keys, dtype=np.uint64)])
        held = np.zeros(len(hashes) + 1, dtype=np.int64)
        held[hits + 1] = own
        np.cumsum(held, out=held)
        spots = self.spots(keys, hits[np.isin(texts, heavy)])
        best: dict[tuple[int, int], tuple[float, int]] = {}
        open_: set[tuple[int, int]] = set()  # texts that have windows of a length heavy enough
        for length, least, numbers, index in self.lengths:
            stops = np.minimum(places + length, ends)
            good = held[stops - k + 1] - held[places] >= least
            if not good.any():
                continue
            starts, stops = places[good], stops[good]
            of = np.searchsorted(first, starts, side="right") - 1
            open_.update((text, length) for text in np.unique(of).tolist())
            for window, slot, _ in index.pieces(fingerprints(hashes, starts, stops)):
                item = numbers[slot] << POSITION
                after = np.searchsorted(spots, item + starts[window])  # a window without a prefix shingle of the item is not similar to it
                hold = np.flatnonzero(spots[np.minimum(after, len(spots) - 1)] - item <= stops[window] - k) if len(spots) else after[:0]
                hold = hold[after[hold] < len(spots)]
                for w, number in zip(window[hold].tolist(), numbers[slot[hold]].tolist(), strict=True):
                    start, stop, key = int(starts[w]), int(stops[w]), (int(of[w]), number)
                    if key in best and best[key][0] == -1.0 and (best[key][1] <= start or (int(sums[stop - k + 1]) - int(sums[start])) % (1 << 64) != self.items[number].shingled.sum):
                        continue  # an equal window is known, and this one is later or not equal
                    score = self.items[number].shingled.similarity(hashes[start:stop], sizes[start:stop])
                    if score >= similarity and (key not in best or (-score, start) < best[key]):
                        best[key] = -score, start
        near: dict[tuple[int, int], list[int]] = {}
        place = spots & ((1 << POSITION) - 1)
        for number, at, text in zip((spots >> POSITION).tolist(), place.tolist(), (np.searchsorted(first, place, side="right") - 1).tolist(), strict=True):
            if (text, self.items[number].n_words) in open_ and best.get((text, number), (0.0,))[0] != -1.0:
                near.setdefault((text, number), []).append(at)
        for (text, number), ends_ in near.items():
            item = self.items[number]
            score, start = item.shingled.best(keys, weights, covered(np.array(ends_), item.n_words - k + 1, int(first[text])), item.n_words, int(first[text + 1]))
            if score >= similarity and ((text, number) not in best or (-score, start) < best[text, number]):
                best[text, number] = -score, start
        for (text, number), (score, start) in sorted(best.items()):
            item = self.items[number]
            stop = min(start + item.n_words, int(first[text + 1]))
            seen = fingerprints(hashes, np.array([start]), np.array([stop]))[0]
            yield text, item, start - int(first[text]), stop - start, int(np.bitwise_count(seen ^ item.print)), -score


def covered(ends: np.ndarray, length: int, lowest: int) -> list[tuple[int, int]]:
    """First and last positions of the unions of stretches of ``length`` that end at sorted places, none before ``lowest``."""
    breaks = np.flatnonzero(np.diff(ends) > length)
    low = np.maximum(ends[np.append(0, breaks + 1)] - length + 1, lowest)
    return list(zip(low.tolist(), ends[np.append(breaks, len(ends) - 1)].tolist(), strict=True))


class Benchmark:
    """A bounded part of the benchmark, ready to be looked up."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS, similarity: float = SIMILARITY):
        self.similarity = similarity
        by_words: dict[int, list[Item]] = {}
        for key, text in items:
            block = next(blocks(pa.array([text])))
            found = words(block, NOT_BLANK)
            if len(found.starts):
                item = Item(key, hash_spans(block, found.starts, found.ends), found.ends - found.starts)
                by_words.setdefault(min(SHINGLE, item.n_words), []).append(item)
        self.groups = [Group(k, own, radius, similarity) for k, own in sorted(by_words.items())]

    def find(self, block: Block) -> Iterator[tuple[int, Item, int, int, int, float]]:
        found = words(block, NOT_BLANK)
        if len(found.starts):
            hashes, sizes = hash_spans(block, found.starts, found.ends), found.ends - found.starts
            for group in self.groups:
                yield from group.find(hashes, sizes, found.first, self.similarity)


def _passes(benchmark: DataFrame, radius: int, similarity: float, items_per_pass: int) -> Iterator[Benchmark]:
    """Distinct texts of the benchmark, a bounded part at a time."""
    texts = benchmark.select("text").where("text is not null").distinct()
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, -(-n // items_per_pass), -(-size // BYTES_PER_PASS))
    keyed = texts.select(F.xxhash64("text").alias("key"), "text")
    for number in range(passes):
        part = keyed.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == number).orderBy("key")
        yield Benchmark([tuple(r) for r in part.toLocalIterator()], radius, similarity)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    radius: int = RADIUS,
    similarity: float = SIMILARITY,
    items_per_pass: int = ITEMS_PER_PASS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Find the benchmark items that stand in each whole text.

    A window starts at every word (white-space words, A-Z as a-z) and is as long as the item,
    or what is left of the text.  It is a candidate if its SimHash is within ``radius`` bits of
    the item's (fewer where many items have one length, see ``Index``), or if it holds one of
    the item's prefix shingles; then it must have a weighted
    Jaccard similarity of 5-word shingles (repeats counted, weighted by letters) of
    ``similarity`` or more.  The second way finds every such window, whatever its distance.
    Returns ``doc_id, item_id, start_word, n_words, distance, similarity``: for each input row
    and item the best window (the first one among ties).

    Null and empty texts, and items without a word, match nothing; an item or window of
    fewer than five words is one shingle.  A very long text is hashed in parts and
    fingerprinted where it holds enough benchmark shingles, a bounded stretch at a time.
    Repeated documents or items give a row each; null ids stay null; further columns of any
    name are ignored; empty tables give no rows.  The benchmark is a query set: its distinct
    texts are taken in passes of about ``items_per_pass``, so what the driver and a task hold
    does not grow with it.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found, before = None, None
    for part in _passes(items, radius, similarity, items_per_pass):
        if before is not None:  # more than one pass: each is done before the next part of the benchmark is read
            found = _add(found, durable(before[0], "contamination"))
            before[1].destroy()
        part_ = docs.sparkSession.sparkContext.broadcast(part)
        before = _pass(source, part_), part_
    found = _add(found, before[0])
    keyed = items.select("item_id", F.xxhash64("text").alias("key"))
    return found.join(keyed, "key").select("doc_id", "item_id", "start_word", "n_words", "distance", "similarity")


def _add(found: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if found is None else found.unionByName(more)


def _pass(source: DataFrame, benchmark_) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block in blocks(batch.column(1)):
                rows += [(block.first + text, item.key, *rest) for text, item, *rest in benchmark_.value.find(block)]
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds, 1))], ["doc_id", "key", "start_word", "n_words", "distance", "similarity"]
            )

    return source.mapInArrow(run, "doc_id long, key long, start_word long, n_words long, distance int, similarity double")


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    radius: int = RADIUS,
    similarity: float = SIMILARITY,
    items_per_pass: int = ITEMS_PER_PASS,
    text_col: str = "text",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` whose texts hold no benchmark item (see ``find_contamination``); decided row by row, whatever the ids.

    What a pass keeps is written before the next part of the benchmark is read, so one part is held at a time.
    """
    texts = benchmark.select(F.col(item_text_col).cast("string").alias("text"))
    kept, part_, written = docs, None, None
    for part in _passes(texts, radius, similarity, items_per_pass):
        if part_ is not None:
            done = durable(kept, "decontaminated")
            part_.destroy()
            if written is not None:
                forget(written)
            kept = written = done
        part_ = docs.sparkSession.sparkContext.broadcast(part)
        kept = filter_rows(kept, text_col, _cleaner(part_))
    return kept


def _cleaner(benchmark_) -> Callable[[pa.Array], np.ndarray]:
    def clean(texts: pa.Array) -> np.ndarray:
        keep = np.ones(len(texts), dtype=bool)
        for block in blocks(texts):
            for text, *_ in benchmark_.value.find(block):
                keep[block.first + text] = False
        return keep

    return clean
