"""Language identification in two steps: the family, then one-versus-one linear SVMs inside it."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import filter_rows
from .textblocks import Block, blocks

#: Features: hashed pairs and triples of bytes of the lower-cased text, all non-letters of ASCII as one blank.
N_FEATURES = 4096
#: Labelled texts of each language that the machines are fitted on (an expected number of distinct texts, picked by a hash).
PER_LANGUAGE = 1000
#: Texts whose features are held at once.
ROWS = 256
#: Languages that are told apart after their family; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg"),
}
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def family_of(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang in langs), f"only {lang}")


def features(block: Block) -> np.ndarray:
    """A row for each text: square roots of the shares of its hashed byte pairs and triples."""
    n = len(block.offsets) - 1
    b = _FOLD[block.data]
    row = np.repeat(np.arange(n, dtype=np.int64) * N_FEATURES, np.diff(block.offsets))
    counts = np.zeros(n * N_FEATURES)
    for size in (2, 3):
        if len(b) < size:
            continue
        gram = b[: len(b) - size + 1].copy()
        for i in range(1, size):
            gram = gram * np.uint32(256) + b[i : len(b) - size + 1 + i]
        bucket = (gram * np.uint32(2654435761) + np.uint32(size * 40503)) >> np.uint32(20)
        inside = row[: len(gram)] == row[size - 1 :]
        counts += np.bincount((row[: len(gram)] + bucket)[inside], minlength=n * N_FEATURES)
    counts = counts.reshape(n, N_FEATURES)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def text_blocks(texts: pa.Array) -> Iterator[Block]:
    """Lower-cased blocks of a bounded number of texts, since a row of features is wide whatever the text's length."""
    for at in range(0, len(texts), ROWS):
        for block in blocks(pc.utf8_lower(texts.slice(at, ROWS))):
            yield block._replace(first=block.first + at)


def fit_linear_svm(x: np.ndarray, positive: np.ndarray, cost: float = 10.0, passes: int = 15) -> np.ndarray:
    """Weights and bias (last) of an L2-loss support vector machine, by dual coordinate descent.

    ``x`` stays in half precision; one row at a time is widened.
    """
    y = np.where(positive, 1.0, -1.0)
    weight = cost * len(y) / (2 * np.maximum(1, np.where(positive, positive.sum(), (~positive).sum())))
    wide = lambda i: np.append(x[i].astype(np.float64), 1.0)
    diagonal = np.array([wide(i) @ wide(i) for i in range(len(y))]) + 0.5 / weight
    alpha, w, rng = np.zeros(len(y)), np.zeros(x.shape[1] + 1), np.random.default_rng(0)
    for _ in range(passes):
        for i in rng.permutation(len(y)):
            row = wide(i)
            step = max(0.0, alpha[i] - (y[i] * (row @ w) - 1 + alpha[i] * 0.5 / weight[i]) / diagonal[i]) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * row
    return w


class Duels:
    """One machine for each pair of classes; most wins, then the larger sum of margins, decides."""

    def __init__(self, x: np.ndarray, label: np.ndarray):
        self.classes = sorted(set(label))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        fitted = []
        for a, b in self.pairs:
            own = (label == self.classes[a]) | (label == self.classes[b])
            fitted.append(fit_linear_svm(x[own], label[own] == self.classes[a]))
        self.w = np.array(fitted).T if fitted else np.zeros((x.shape[1] + 1, 0))

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class number of each row, and how surely it won its closest duel (0 to 1)."""
        n = len(x)
        margin = x @ self.w[:-1] + self.w[-1]
        wins, total = np.zeros((n, len(self.classes))), np.zeros((n, len(self.classes)))
        for k, (a, b) in enumerate(self.pairs):
            wins[:, a] += margin[:, k] > 0
            wins[:, b] += margin[:, k] <= 0
            total[:, a] += margin[:, k]
            total[:, b] -= margin[:, k]
        best = np.argmax(wins + 0.5 * np.tanh(total / (1 + len(self.pairs))), axis=1)
        sure = np.ones(n)
        for k, (a, b) in enumerate(self.pairs):
            own = np.where(best == a, margin[:, k], np.where(best == b, -margin[:, k], np.inf))
            sure = np.minimum(sure, 1 / (1 + np.exp(-np.clip(3 * own, -50, 50))))
        return best, sure


class LanguageModel:
    def __init__(self, x: np.ndarray, lang: np.ndarray):
        family = np.array([family_of(v) for v in lang])
        self.family = Duels(x, family)
        self.inside = {f: Duels(x[family == f], lang[family == f]) for f in self.family.classes}

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, score = self.family(x)
        out = np.empty(len(x), dtype=object)
        for k, name in enumerate(self.family.classes):
            rows = np.flatnonzero(best == k)
            if len(rows):
                choice, sure = self.inside[name](x[rows])
                out[rows] = np.array(self.inside[name].classes, dtype=object)[choice]
                score[rows] *= sure
        return out, score


def has_letter(block: Block, texts: pa.Array) -> np.ndarray:
    """Whether each text has a character of Unicode's letter categories."""
    seen = np.concatenate([[0], np.cumsum(_FOLD[block.data] != 32)])
    ascii_letters = np.concatenate([[0], np.cumsum((_FOLD[block.data] >= 97) & (_FOLD[block.data] < 123))])
    found = np.diff(ascii_letters[block.offsets]) > 0
    for i in np.flatnonzero(~found & (np.diff(seen[block.offsets]) > 0)):
        found[i] = any(c.isalpha() for c in texts[block.first + int(i)].as_py() or "")
    return found


def fit_language_model(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """Fit on about ``per_language`` distinct texts of each language among the rows where ``learn`` holds; None without any.

    The sample is picked by a hash of the text, so it has a bound whatever the ids (all may be
    null) and however often a text is repeated.  One task fits the machines, so neither texts
    nor features of the sample come to the driver.  Languages are few: there is a machine for
    each pair of them within a family.
    """
    key = F.xxhash64(F.col(text_col).cast("string"))
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), key.alias("key"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.approx_count_distinct("key", 0.02)).collect()}
    if not counts:
        return None
    picked = F.pmod(F.xxhash64(F.col("key"), F.lit("language sample")), F.lit(1 << 30))
    limit = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(min(1.0, per_language / max(1, n)) * (1 << 30)))) for k, n in counts.items()])
    sample = rows.where(picked < limit)

    def features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            names, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            new = [i for i, k in enumerate(zip(names, keys, strict=True)) if k not in seen and not seen.add(k)]
            batch = batch.take(pa.array(new, pa.int64()))
            for block in text_blocks(batch.column(1)):
                x = features(block).astype(np.float16)
                own = [c.slice(block.first, len(x)) for c in (batch.column(0), batch.column(2))]
                yield pa.RecordBatch.from_arrays([*own, pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "key", "x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, lang = [], []
        for batch in batches:
            parts.append(np.empty((len(batch), N_FEATURES), dtype=np.float16))
            for row, raw in zip(parts[-1], batch.column(2), strict=True):
                row[:] = np.frombuffer(raw.as_buffer(), dtype=np.float16)
            lang += batch.column(0).to_pylist()
        if lang:
            x = parts[0] if len(parts) == 1 else np.concatenate(parts)
            parts.clear()
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(LanguageModel(x, np.array(lang, dtype=object)))], pa.binary())], ["model"])

    one_of_each = sample.mapInArrow(features_of, "lang string, key long, x binary").dropDuplicates(["lang", "key"])
    got = one_of_each.repartition(1).sortWithinPartitions("lang", "key").mapInArrow(fit, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else None


def _predicted(model: LanguageModel | None, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, languages and scores of each block of texts."""
    for block in text_blocks(texts):
        n = len(block.offsets) - 1
        lang, score = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
        known = has_letter(block, texts)
        if model is not None and known.any():
            found, sure = model.predict(features(block))
            lang[known], score[known] = found[known], sure[known]
        yield block.first, lang, np.clip(score, 0, 1)


def identify_languages(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict the language of every whole text: ``doc_id, lang_pred, score``, one row for each input row.

    ``lang_pred`` is ``und`` with score 0 for a null text and for one without a letter (so
    also for an empty one), and for every text if there was nothing to learn from.  A very
    long text is one row of features; it is counted whole and by itself, at about twenty
    times its bytes.  Equal texts get equal predictions; null ids, repeated rows and other
    columns of any name are allowed; an empty table gives no rows.
    """
    model_ = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, lang, score in _predicted(model_.value, batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(lang)), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double")


def drop_unknown(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language can be told; decided row by row, whatever the ids."""
    model_ = docs.sparkSession.sparkContext.broadcast(model)

    def known(texts: pa.Array) -> np.ndarray:
        return np.concatenate([np.empty(0, bool), *(lang != UNKNOWN for _, lang, _ in _predicted(model_.value, texts))])

    return filter_rows(docs, text_col, known)
