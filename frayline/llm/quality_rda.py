"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has a Gaussian density whose covariance is shrunk towards the pooled one and
towards a multiple of the identity.  The fit needs sums and sums of products only, which
Spark adds up over all labelled documents; a score comes from the difference of two
Mahalanobis log-densities with the Cholesky factors computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable
from .textblocks import NOT_BLANK, Block, Words, blocks, hash_spans, shingles, words

#: Shrinkage towards the pooled covariance, and towards the identity.
POOLED, IDENTITY = 0.1, 0.05
#: Log-density differences are divided by this before the logistic function: densities of many statistics are too sure of themselves.
TEMPERATURE = 4.0

FEATURES = (
    "words", "word_length", "symbols", "capitals", "digits", "marks", "pipes", "lines", "distinct_words", "repeated_triples",
    "repeated_lines", "shouted_words", "stop_length",
)

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[list(b"#*$%&<>@^~=_+\\{}[]")] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[list(b"!?;:,.\"'()-/")] = 4
_CLASS[ord("|")] = 5
_CLASS[10] = 6


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many distinct values each owner has."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.sqrt(part / np.maximum(whole, 1))


def statistics(block: Block, found: Words) -> np.ndarray:
    """A row of transformed statistics for each whole text."""
    n = len(block.offsets) - 1
    size = np.diff(block.offsets)
    owner = np.repeat(np.arange(n), size)
    kinds = np.bincount(owner * 8 + _CLASS[block.data], minlength=n * 8).reshape(n, 8)
    n_words = np.diff(found.first)
    of_word = np.repeat(np.arange(n), n_words)
    lengths = found.ends - found.starts
    letters = np.bincount(of_word, weights=lengths, minlength=n)
    hashes = hash_spans(block, found.starts, found.ends)
    triples = shingles(hashes, 3)
    inside = of_word[: len(triples)] == of_word[2:] if len(triples) else np.empty(0, bool)
    n_triples = np.maximum(n_words - 2, 0)
    breaks = np.flatnonzero(block.data == 10)
    edges = np.unique(np.concatenate([block.offsets, breaks + 1]))
    filled = np.flatnonzero(np.diff(edges) > 1)
    of_line = np.searchsorted(block.offsets, edges[filled], side="right") - 1
    stops = edges[filled + 1]
    stops = stops - (block.data[stops - 1] == 10)
    n_lines = np.bincount(of_line, minlength=n)
    distinct_lines = _distinct(hash_spans(block, edges[filled], stops), of_line, n)
    capital = np.concatenate([[0], np.cumsum(_CLASS[block.data] == 2)])
    shouted = capital[found.ends] - capital[found.starts] >= 2
    longest = np.maximum(size, 1)
    return np.column_stack(
        [
            np.log1p(n_words),
            np.log1p(letters / np.maximum(n_words, 1)),
            _share(kinds[:, 1], longest),
            _share(kinds[:, 2], longest),
            _share(kinds[:, 3], longest),
            _share(kinds[:, 4], longest),
            _share(kinds[:, 5], longest),
            _share(kinds[:, 6], np.maximum(n_words, 1)),
            np.log1p(n_words) - np.log1p(_distinct(hashes, of_word, n)),
            _share(n_triples - _distinct(triples[inside], of_word[: len(triples)][inside], n), n_triples),
            _share(n_lines - distinct_lines, n_lines),
            _share(np.bincount(of_word[shouted], minlength=n), n_words),
            _share(np.bincount(of_word[lengths <= 3], minlength=n), n_words),
        ]
    )


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``x`` (array of the transformed statistics), one row for each input row; null text: as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                x = statistics(block, words(block, NOT_BLANK))
                rows = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(x)), rows], ["doc_id", "x"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, x array<double>")


class Density(NamedTuple):
    mean: np.ndarray
    whitener: np.ndarray
    constant: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.whitener
        return self.constant - 0.5 * (z * z).sum(axis=1)


class Discriminant(NamedTuple):
    """Scale of the statistics, and the log-densities (with class shares) of labels 0 and 1; None: no rows of that label."""

    center: np.ndarray
    scale: np.ndarray
    low: Density | None
    high: Density | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.low is None or self.high is None:
            return np.full(len(x), 0.5 if self.low is self.high else float(self.low is None))
        z = (x - self.center) / self.scale
        return 1 / (1 + np.exp(np.clip((self.low(z) - self.high(z)) / TEMPERATURE, -500, 500)))


def fit_discriminant(labelled: DataFrame, pooled: float = POOLED, identity: float = IDENTITY) -> Discriminant:
    """Fit on all rows of ``x`` and ``label`` (0 or 1): one aggregation, two rows to the driver."""
    d = len(FEATURES)
    at = [F.col("x")[i] for i in range(d)]
    sums = [F.sum(a).alias(f"s{i}") for i, a in enumerate(at)]
    products = [F.sum(at[i] * at[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    got = {r["label"]: r for r in labelled.groupBy("label").agg(F.count("*").alias("n"), *sums, *products).collect()}
    n, mean, scatter = {}, {}, {}
    for label, row in got.items():
        n[label] = row["n"]
        mean[label] = np.array([row[f"s{i}"] for i in range(d)]) / row["n"]
        second = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                second[i, j] = second[j, i] = row[f"p{i}_{j}"]
        scatter[label] = np.round(second / row["n"] - np.outer(mean[label], mean[label]), 9)
    total = max(1, sum(n.values()))
    center = sum((n[k] * mean[k] for k in sorted(n)), np.zeros(d)) / total
    within = sum((n[k] * scatter[k] for k in sorted(n)), np.zeros((d, d))) / total
    spread = within + sum((n[k] * np.outer(mean[k] - center, mean[k] - center) for k in sorted(n)), np.zeros((d, d))) / total
    scale = np.sqrt(np.maximum(np.diag(spread), 1e-6))
    rescaled = np.outer(scale, scale)

    def density(label: int) -> Density | None:
        if label not in n:
            return None
        own = (1 - pooled) * scatter[label] / rescaled + pooled * within / rescaled
        own = (1 - identity) * own + identity * np.trace(own) / d * np.eye(d) + 1e-6 * np.eye(d)
        factor = np.linalg.cholesky(own)
        whitener = np.linalg.inv(factor).T
        return Density((mean[label] - center) / scale, whitener, float(-np.log(np.diag(factor)).sum() + np.log(n[label] / total)))

    return Discriminant(center, scale, density(0), density(1))


def score_quality(
    docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """Score every whole text: ``doc_id, score`` (0 to 1, higher: label 1 likelier), one row for each input row.

    Learns from documents whose id has a label of 0 or 1 where ``learn`` (a condition on
    ``doc_id``) holds; several labels of one id count as their majority, ties as 0; rows
    with a null id or label are not learnt from.  Null and empty texts have statistics like
    any other; a very long text is counted whole, by itself, at some twenty times its bytes.  With labels of one kind only, the score is that label; without labels 0.5.
    Repeated rows get equal scores; further columns of any name are ignored.
    """
    stats = durable(document_statistics(docs, id_col, text_col), "quality-statistics")
    ids = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    ids = ids.groupBy("doc_id").agg((F.avg("label") > 0.5).cast("int").alias("label"))
    model = fit_discriminant(stats.where(learn).join(ids, "doc_id").select("label", "x"))
    model_ = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            score = np.clip(np.round(model_.value.score(x), 6), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")
