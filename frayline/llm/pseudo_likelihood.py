"""LM scoring by masked pseudo-likelihood: every token is predicted from the words on both sides of it.

A small window network, trained in numpy, gives the probability of the token's class from
its neighbours' embeddings; counts over the whole corpus give that of the token in its class.
Classes come from the company that words keep: words with like shares of frequent neighbours
are put together.  The frequent words of the corpus are known one by one; all others are told
apart by their endings, and those of one ending are equally likely.

Training is spread over buckets of texts, dealt by a hash and bounded in size: in each round
every bucket starts from the same weights, passes over its texts in the order of their hashes
and returns its change, and the changes are averaged.  So the result depends on the rows
alone, neither on files nor on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable, sum_slots
from .textblocks import NOT_BLANK, PLACE, Block, blocks, hash_spans, mix, words

#: Words known one by one: the most frequent ones, found by their hashes in a table of 2**SLOT_BITS entries.
KNOWN, SLOT_BITS = 1 << 16, 20
#: Words with embeddings of their own; endings (last three bytes, hashed), which stand for all other words; "outside the text".
EMBEDDED, ENDINGS = 4096, 2048
OUTSIDE = EMBEDDED + ENDINGS
#: Words seen on each side, width of an embedding, hidden units, classes; the most frequent words are classes of their own.
SIDE, WIDTH, HIDDEN, CLASSES, OWN_CLASSES = 2, 16, 32, 64, 16
#: Frequent words whose shares among the neighbours of a word tell its class.
ANCHORS = 64
#: Rounds of training share out the positions of each text, so that together they take every position; sums of squares begin at SQUARES.
ROUNDS, BATCH, RATE, SQUARES = 2, 1024, 0.1, 1e-6
#: Bytes of text in a bucket, about; positions that are dealt out over so many batches at a time.
BUCKET_BYTES, SHUFFLED = 16 << 20, 16
_FIXED = float(1 << 10)  # changes are added up as integers, so that their order does not matter

SHAPES = {"e": (OUTSIDE + 1, WIDTH), "w": (2 * SIDE * WIDTH, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, CLASSES), "c": (CLASSES,)}
N_WEIGHTS = sum(int(np.prod(s)) for s in SHAPES.values())


class Vocabulary:
    """The known words by their hashes, most frequent first, and the mass and number of the other words of each ending."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, ending: np.ndarray, rest_mass: np.ndarray, rest_words: np.ndarray):
        slots = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        kept = np.sort(np.unique(slots, return_index=True)[1])  # of words in one slot the most frequent one
        lost = np.setdiff1d(np.arange(len(hashes)), kept)
        self.hashes, self.counts, self.ending = hashes[kept], counts[kept], ending[kept]
        self.rest_mass = rest_mass + np.bincount(ending[lost], weights=counts[lost], minlength=ENDINGS)
        self.rest_words = rest_words + np.bincount(ending[lost], minlength=ENDINGS)
        self.table = np.full(1 << SLOT_BITS, -1, dtype=np.int32)
        self.table[slots[kept]] = np.arange(len(kept), dtype=np.int32)

    def tokens(self, hashes: np.ndarray, ending: np.ndarray) -> np.ndarray:
        """The number of each known word, and -1 - ending of each other one."""
        number = self.table[(hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        if len(self.hashes):
            number[(number >= 0) & (self.hashes[number] != hashes)] = -1
        return np.where(number >= 0, number, -1 - ending).astype(np.int32)

    def types(self, tokens: np.ndarray) -> np.ndarray:
        """Embedding row of each token: its own, or that of its ending."""
        if not len(self.hashes):
            return (EMBEDDED - 1 - tokens).astype(np.uint16)
        ending = np.where(tokens >= 0, self.ending[np.maximum(tokens, 0)], -1 - tokens)
        return np.where((tokens >= 0) & (tokens < EMBEDDED), tokens, EMBEDDED + ending).astype(np.uint16)


class Units(NamedTuple):
    """Class of each embedding row; logarithm of the share in its class of each known word, and of each other word by ending."""

    kind: np.ndarray
    log_known: np.ndarray
    log_other: np.ndarray

    def log_share(self, tokens: np.ndarray) -> np.ndarray:
        out = self.log_other[np.where(tokens < 0, -1 - tokens, 0)]
        return np.where(tokens >= 0, self.log_known[np.maximum(tokens, 0)], out) if len(self.log_known) else out


def cluster(profiles: np.ndarray, mass: np.ndarray, n: int, passes: int = 12) -> np.ndarray:
    """Weighted k-means of rows on the unit sphere, from spread-out first centres; no randomness."""
    if len(profiles) <= n:
        return np.arange(len(profiles))
    x = np.sqrt(profiles / np.maximum(profiles.sum(axis=1, keepdims=True), 1e-12))
    centres = [x[int(np.argmax(mass))]]
    far = np.full(len(x), np.inf)
    for _ in range(n - 1):
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
        centres.append(x[int(np.argmax(far * np.sqrt(mass)))])
    centres = np.array(centres)
    for _ in range(passes):
        kind = np.argmax(x @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
        for k in range(n):
            own = kind == k
            if own.any():
                centres[k] = np.average(x[own], axis=0, weights=np.maximum(mass[own], 1e-9))
    return kind


def make_units(vocabulary: Vocabulary, profiles: np.ndarray) -> Units:
    """Classes from ``profiles`` (for each embedding row counts of anchors around it), shares from the counts."""
    known = vocabulary.types(np.arange(len(vocabulary.hashes)))
    mass = np.bincount(known, weights=vocabulary.counts, minlength=OUTSIDE) + np.pad(vocabulary.rest_mass, (EMBEDDED, 0))
    usual = (profiles.sum(axis=0) + 1) / (profiles.sum() + ANCHORS)
    kind = np.zeros(OUTSIDE, dtype=np.int32)
    kind[OWN_CLASSES:] = OWN_CLASSES + cluster(profiles[OWN_CLASSES:] + 8 * usual, mass[OWN_CLASSES:], CLASSES - OWN_CLASSES)
    kind[:OWN_CLASSES] = np.arange(OWN_CLASSES)
    # words that the corpus does not hold: one of each ending
    other = vocabulary.rest_mass + 1
    words_ = vocabulary.rest_words + 1
    of_class = np.bincount(kind[known], weights=vocabulary.counts, minlength=CLASSES) + np.bincount(kind[EMBEDDED:], weights=other, minlength=CLASSES)
    log_known = np.log(vocabulary.counts / of_class[kind[known]])
    return Units(kind, log_known, np.log(other / words_ / of_class[kind[EMBEDDED:]]))


def first_weights() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(0)
    return {k: (rng.standard_normal(s) * (0.1 if k == "e" else 1 / np.sqrt(s[0]) if len(s) > 1 else 0)).astype(np.float32) for k, s in SHAPES.items()}


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in SHAPES])


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        out[k] = values[at : at + int(np.prod(s))].reshape(s).astype(np.float32)
        at += int(np.prod(s))
    return out


_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32


def word_keys(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the first word of each text, hashes of all words (A-Z as a-z), and their endings."""
    found = words(block, NOT_BLANK)
    last = np.zeros(len(found.starts), dtype=np.uint64)
    for k in (3, 2, 1):
        at = found.ends - k
        last = last * np.uint64(256) + np.where(at >= found.starts, _LOWER[block.data[np.maximum(at, 0)]], np.uint64(0))
    ending = (mix(last + PLACE[0]) >> np.uint64(40)).astype(np.int64) % ENDINGS
    return found.first, hash_spans(block, found.starts, found.ends), ending


def neighbours(types: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Embedding rows of the words around each position, those beyond the text's ends as "outside"."""
    text = np.searchsorted(first, at, side="right") - 1
    low, high = first[text], first[text + 1]
    out = np.empty((len(at), 2 * SIDE), dtype=np.uint16)
    for k, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        there = at + step
        inside = (there >= low) & (there < high)
        out[:, k] = np.where(inside, types[np.where(inside, there, 0)], OUTSIDE)
    return out


def forward(weights: dict[str, np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, hidden units and log-probabilities of the classes."""
    x = weights["e"][context].reshape(len(context), -1)
    h = np.tanh(x @ weights["w"] + weights["b"])
    z = h @ weights["v"] + weights["c"]
    z -= z.max(axis=1, keepdims=True)
    return x, h, z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train_step(weights: dict[str, np.ndarray], squares: dict[str, np.ndarray], context: np.ndarray, kind: np.ndarray) -> None:
    """One AdaGrad step on the mean negative log-probability of the classes."""
    n = len(kind)
    x, h, logp = forward(weights, context)
    dz = np.exp(logp)
    dz[np.arange(n), kind] -= 1
    dz /= n
    dh = (dz @ weights["v"].T) * (1 - h * h)
    dx = (dh @ weights["w"].T).reshape(-1, WIDTH)
    for key, g in (("v", h.T @ dz), ("c", dz.sum(axis=0)), ("w", x.T @ dh), ("b", dh.sum(axis=0))):
        squares[key] += g * g
        weights[key] -= RATE * g / np.sqrt(squares[key])
    rows = context.ravel()
    order = np.argsort(rows, kind="stable")
    ranked = rows[order]
    start = np.concatenate([[0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1])
    own, g = ranked[start], np.add.reduceat(dx[order], start, axis=0)
    squares["e"][own] += g * g
    weights["e"][own] -= RATE * g / np.sqrt(squares["e"][own])


def count_words(texts: DataFrame, known: int | None = None) -> Vocabulary:
    """Exact counts of all words of the corpus in a Spark table; the most frequent words and sums by ending come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0), 8 << 20):
                _, hashes, ending = word_keys(block)
                own, at, n = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(ending[at].astype(np.int32)), pa.array(n)], ["word", "ending", "n"])

    counts = durable(texts.select("text").mapInArrow(run, "word long, ending int, n long").groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n")), "words")
    top = counts.orderBy(F.desc("n"), "word").limit(KNOWN if known is None else known).toArrow()
    sums = counts.groupBy("ending").agg(F.sum("n").alias("mass"), F.count("*").alias("words")).toArrow()
    n, ending = top["n"].to_numpy().astype(np.int64), top["ending"].to_numpy().astype(np.int64)
    mass, words_ = np.zeros(ENDINGS), np.zeros(ENDINGS)
    mass[sums["ending"].to_numpy()], words_[sums["ending"].to_numpy()] = sums["mass"].to_numpy(), sums["words"].to_numpy()
    mass -= np.bincount(ending, weights=n, minlength=ENDINGS)
    words_ -= np.bincount(ending, minlength=ENDINGS)
    return Vocabulary(top["word"].to_numpy().view(np.uint64), n, ending, mass, words_)


def count_company(texts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """How often each of the most frequent words stands near each embedding row, over all positions."""
    vocabulary_ = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(OUTSIDE * ANCHORS, dtype=np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                total += company(vocabulary_.value, *word_keys(block))
        yield _slots(total)

    return sum_slots(texts.select("text").mapInArrow(run, "slot int, value long"), OUTSIDE * ANCHORS).reshape(OUTSIDE, ANCHORS)


def company(vocabulary: Vocabulary, first: np.ndarray, hashes: np.ndarray, ending: np.ndarray) -> np.ndarray:
    types = vocabulary.types(vocabulary.tokens(hashes, ending)).astype(np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    total = np.zeros(OUTSIDE * ANCHORS, dtype=np.int64)
    anchors = np.flatnonzero(types < ANCHORS)
    for step in (-2, -1, 1, 2):
        near = anchors + step
        good = (near >= 0) & (near < len(types))
        good[good] &= text[near[good]] == text[anchors[good]]
        total += np.bincount(types[near[good]] * ANCHORS + types[anchors[good]], minlength=OUTSIDE * ANCHORS)
    return total


def _slots(values: np.ndarray) -> pa.RecordBatch:
    slots = np.flatnonzero(values)
    return pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(values[slots])], ["slot", "value"])


def round_positions(first: np.ndarray, number: int, rounds: int) -> np.ndarray:
    """The words of a block, by their places in their texts, that a round trains on."""
    at = np.arange(first[-1])
    return at[(at - np.repeat(first[:-1], np.diff(first))) % rounds == number]


class Trainer:
    """Training over one bucket: steps depend on the order of its texts only, not on how they come in batches."""

    def __init__(self, start: dict[str, np.ndarray]):
        self.start = start
        self.weights = {k: v.copy() for k, v in start.items()}
        self.squares = {k: np.full_like(v, SQUARES) for k, v in start.items()}
        self.context, self.kind = np.empty((0, 2 * SIDE), np.uint16), np.empty(0, np.int32)
        self.seen = 0

    def feed(self, context: np.ndarray, kind: np.ndarray) -> None:
        self.context, self.kind = np.concatenate([self.context, context]), np.concatenate([self.kind, kind])
        whole = len(self.kind) // (BATCH * SHUFFLED) * (BATCH * SHUFFLED)
        for at in range(0, whole, BATCH * SHUFFLED):
            self._steps(self.context[at : at + BATCH * SHUFFLED], self.kind[at : at + BATCH * SHUFFLED])
        self.context, self.kind = self.context[whole:], self.kind[whole:]

    def _steps(self, context: np.ndarray, kind: np.ndarray) -> None:
        """Each step takes positions from all over a stretch of text."""
        n = -(-len(kind) // BATCH)
        for k in range(n):
            train_step(self.weights, self.squares, context[k::n], kind[k::n])
        self.seen += len(kind)

    def change(self) -> np.ndarray:
        """The change of all weights times the positions seen, and the positions, as whole numbers."""
        if len(self.kind):
            self._steps(self.context, self.kind)
        return np.append(np.round((flat(self.weights) - flat(self.start)).astype(np.float64) * self.seen * _FIXED).astype(np.int64), self.seen)


def train(texts: DataFrame, vocabulary: Vocabulary, units: Units, rounds: int = ROUNDS, bucket_bytes: int = BUCKET_BYTES) -> dict[str, np.ndarray]:
    """Averaged training over all texts; each round sums the buckets' changes, weighted by their positions."""
    spark = texts.sparkSession
    weights = first_weights()
    model_ = spark.sparkContext.broadcast((vocabulary, units.kind))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    key = F.xxhash64("text", "doc_id")
    dealt = texts.where("text <> ''").select(F.pmod(key, F.lit(size // bucket_bytes + 1)).alias("bucket"), key.alias("key"), "text")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "key", "text")
    for number in range(rounds):
        start_ = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], number=number, start_=start_) -> Iterator[pa.RecordBatch]:
            vocabulary, kinds = model_.value
            bucket, trainer = None, None
            for batch in batches:
                of_row = batch.column(0).to_numpy()
                for own in np.split(np.arange(len(of_row)), np.flatnonzero(np.diff(of_row)) + 1):
                    if not len(own):
                        continue
                    if trainer is None or of_row[own[0]] != bucket:
                        if trainer is not None:
                            yield _slots(trainer.change())
                        bucket, trainer = of_row[own[0]], Trainer(start_.value)
                    for block in blocks(batch.column(1).slice(int(own[0]), len(own))):
                        first, hashes, ending = word_keys(block)
                        types = vocabulary.types(vocabulary.tokens(hashes, ending))
                        at = round_positions(first, number, rounds)
                        trainer.feed(neighbours(types, first, at), kinds[types[at]])
            if trainer is not None:
                yield _slots(trainer.change())

        total = sum_slots(dealt.select("bucket", "text").mapInArrow(run, "slot int, value long"), N_WEIGHTS + 1)
        if total[-1]:
            weights = shaped(flat(weights) + total[:-1] / total[-1] / _FIXED)
    return weights


class Model(NamedTuple):
    vocabulary: Vocabulary
    units: Units
    weights: dict[str, np.ndarray]

    def tokens_scored(self, block: Block, at_once: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
        """Number of the first token of each text, and each token's log-probability, given the words on both sides."""
        first, hashes, ending = word_keys(block)
        tokens = self.vocabulary.tokens(hashes, ending)
        types = self.vocabulary.types(tokens)
        out = self.units.log_share(tokens)
        for i in range(0, len(tokens), at_once):
            at = np.arange(i, min(len(tokens), i + at_once))
            out[at] += forward(self.weights, neighbours(types, first, at))[2][np.arange(len(at)), self.units.kind[types[at]]]
        return first, out


def fit_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, bucket_bytes: int = BUCKET_BYTES) -> Model:
    """Counts, classes and weights from all texts."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    vocabulary = count_words(texts)
    units = make_units(vocabulary, count_company(texts, vocabulary))
    return Model(vocabulary, units, train(texts, vocabulary, units, rounds, bucket_bytes))


def score_with(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text with a fitted model (see ``score_pseudo_likelihood``)."""
    model_ = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                first, scores = model_.value.tokens_scored(block)
                n = np.diff(first)
                total = np.bincount(np.repeat(np.arange(len(n)), n), weights=scores, minlength=len(n))
                mean = np.round(total / np.maximum(n, 1), 4)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(n)), pa.array(n.astype(np.int64)), pa.array(np.round(total, 2)), pa.array(mean, mask=n == 0)],
                    ["doc_id", "n_tokens", "pseudo_log_likelihood", "mean_log_probability"],
                )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_tokens long, pseudo_log_likelihood double, mean_log_probability double")


def score_pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Score every whole text: ``doc_id, n_tokens, pseudo_log_likelihood`` (sum over all tokens), ``mean_log_probability``.

    Counts and training cover all texts and all positions.  A text without a word (null, empty,
    blank) has no tokens, the sum 0 and a null mean.  A very long text is scored whole, a
    stretch at a time.  Equal texts get equal scores, whatever the files and partitions; null
    ids, repeated rows and further columns of any name are allowed; an empty table gives no
    rows.  Rows that repeat both id and text meet in one bucket of training.  Sums are rounded
    to 2 decimals and means to 4.
    """
    return score_with(docs, fit_model(docs, id_col, text_col, rounds, bucket_bytes), id_col, text_col)
