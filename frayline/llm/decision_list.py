"""Quality rules: an ordered list of threshold conjunctions, learnt from labelled statistics by sequential covering.

Statistics, labels and verdicts are DataFrame expressions.  The list is grown and pruned on
the driver from a bounded table of numbers (no texts) and comes back as one ``when`` chain.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the list is learnt from (an expected number of ids, picked by a hash; one row of each).
LABELLED_ROWS = 20_000
#: Thresholds tried for each statistic; conditions in a rule; rules in the list.
THRESHOLDS, MAX_CONDITIONS, MAX_RULES = 64, 4, 12
#: A rule must be right on this share of the rows that it was not grown on, and cover so many of them.
LEAST_PRECISION, LEAST_COVERED = 0.9, 3

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def feature_columns() -> dict[str, Column]:
    """The numbers that conditions are about."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / chars,
        "capitals": F.col("n_capitals") / chars,
        "marks": F.col("n_marks") / words,
        "line_length": F.col("n_words") / lines,
        "dup_lines": F.col("n_dup_lines") / lines,
        "repeats": F.col("n_repeat_words") / words,
    }


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks", "n_lines")


def base_statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts over every whole text (null: as empty) beside the columns ``keep``, one row for each input row.

    Words are runs of non-blank characters.  ``n_repeat_words``: words inside 3-word windows
    that the text has twice or more.  Windows are compared by a 64-bit hash, sorted with their
    places, so that equal ones come together.
    """
    row = F.struct(*keep).alias("row")
    rows = docs.select(row, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    trimmed = F.btrim("text", F.lit(BLANKS))
    rows = rows.select(
        "row",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK)).alias("w"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit("[!?]")).cast("long").alias("n_marks"),
        F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "").alias("lines"),
    )
    rows = rows.select(
        "row", "n_symbols", "n_capitals", "n_marks",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "case when size(w) < 3 then cast(array() as array<struct<h: bigint, i: int>>) else sort_array(transform(sequence(0, size(w) - 3), "
            "i -> struct(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)) as h, i))) end"
        ).alias("windows"),
    )
    rows = rows.withColumn(
        "twice", F.expr("sort_array(transform(filter(windows, (x, k) -> x.h = get(windows, k + 1).h or x.h = get(windows, k - 1).h), x -> x.i))")
    ).drop("windows")
    covered = F.expr(
        "aggregate(twice, named_struct('total', 0L, 'before', -3), (a, x) -> named_struct('total', a.total + least(3, x - a.before), 'before', x), a -> a.total)"
    )
    return rows.withColumn("n_repeat_words", covered).select("row.*", *STATISTICS)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def rows_where(statistics: DataFrame, condition: Column) -> DataFrame:
    """A filter that is applied to the finished statistics: Spark would else take it apart and count again inside it."""
    return statistics.withColumn("task", F.spark_partition_id()).where(condition & (F.col("task") >= 0)).drop("task")


class Condition(NamedTuple):
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = feature_columns()[self.feature]
        return value >= self.threshold if self.above else value < self.threshold

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([rows, *(c.holds(x) for c in rule)])


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Rule:
    """Add the condition of the largest information gain until only bad rows are covered."""
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS:
        p, n = int((rows & bad).sum()), int((rows & ~bad).sum())
        if not p or not n:
            break
        best, gain = None, 1e-9
        for name, values in x.items():
            own, is_bad = values[rows], bad[rows]
            order = np.argsort(own, kind="stable")
            own, hits = own[order], np.concatenate([[0], np.cumsum(is_bad[order])])
            cuts = np.unique(np.quantile(own, np.linspace(0, 1, THRESHOLDS + 2)[1:-1], method="higher"))
            bad_own = own[is_bad[order]]
            cuts = np.unique(np.concatenate([cuts, np.quantile(bad_own, np.linspace(0, 1, THRESHOLDS), method="higher")]))
            at = np.searchsorted(own, cuts)
            for above, q, total in ((True, p - hits[at], len(own) - at), (False, hits[at], at)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = np.where(q > 0, q * (np.log2(q / total) - np.log2(p / (p + n))), 0.0)
                k = int(np.argmax(score))
                if score[k] > gain:
                    best, gain = Condition(name, above, float(cuts[k])), float(score[k])
        if best is None:
            break
        rule.append(best)
        rows = rows & best.holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Rule:
    """Drop last conditions while that does not make the rule worse on rows that it was not grown on."""

    def worth(r: Rule) -> float:
        own = _covered(r, x, rows)
        p, n = (own & bad).sum(), (own & ~bad).sum()
        return (p - n) / (p + n + 1)

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, growing: np.ndarray) -> list[Rule]:
    """Sequential covering: grow a rule, prune it, keep it if it is precise enough, and go on with the rows it leaves."""
    left, rules = np.ones(len(bad), dtype=bool), []
    while len(rules) < MAX_RULES:
        rule = _prune(_grow(x, bad, left & growing), x, bad, left & ~growing)
        if not rule:
            break
        own = _covered(rule, x, left & ~growing)
        if own.sum() < LEAST_COVERED or (own & bad).sum() < LEAST_PRECISION * own.sum():
            break
        rules.append(rule)
        left &= ~_covered(rule, x, left)
    return rules


def fit_decision_list(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = LABELLED_ROWS
) -> list[Rule]:
    """Learn the list for label 0 from about ``rows`` labelled documents, of these the ones that the base rule keeps; no labels: no rules.

    Only the documents of the sample are counted for it.  Of a repeated id one row is learnt
    from, so what comes to the driver has the bound of the sample.
    """
    ids = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    total = ids.count()
    if not total:
        return []
    spot = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("rules")), F.lit(1 << 30))
    ids = ids.where(spot < int(min(1.0, rows / total) * (1 << 30))).groupBy("doc_id").agg((F.avg("label") > 0.5).alias("good"))
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("grow or prune")), F.lit(3))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = rows_where(base_statistics(source.join(F.broadcast(ids), "doc_id"), keep=("doc_id", "good")), ~base_failed())  # about ``rows`` ids
    numbers = F.struct(*[c.alias(k) for k, c in feature_columns().items()])
    got = sample.groupBy("doc_id", "good").agg(F.max(numbers).alias("x")).select("doc_id", "good", part.alias("part"), "x.*").orderBy("doc_id").toArrow()
    if not got.num_rows:
        return []
    x = {k: got[k].to_numpy().astype(float) for k in feature_columns()}
    return learn_rules(x, ~got["good"].to_numpy(), got["part"].to_numpy() > 0)


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds (from 1), as one ordered conditional expression; null: none."""
    out = None
    for k, rule in enumerate(rules, 1):
        condition = rule[0].column()
        for c in rule[1:]:
            condition = condition & c.column()
        out = F.when(condition, k) if out is None else out.when(condition, k)
    return F.lit(None).cast("int") if out is None else out


def apply_quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Statistics and verdict of every whole text, one row for each input row.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated windows.
    ``rule``: number of the first learnt rule that holds (null: none).  ``kept``: neither.
    Null and empty texts count as texts without words and fail; a very long text is counted
    whole, in one row, with some hundred bytes for each word of it; without labels no rule is
    learnt; several labels of one id count as their majority, ties as 0.  Null ids, repeated
    rows and further columns of any name are allowed; an empty table gives no rows.
    """
    rules = fit_decision_list(docs, labels, id_col, text_col, label_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = base_statistics(source).withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_by_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` that neither the base rule nor a learnt one rejects; decided row by row, whatever the ids."""
    rules = fit_decision_list(docs, labels, id_col, text_col, label_col)
    whole = docs.select(F.struct(*docs.columns).alias("whole"), F.col(text_col).cast("string").alias("text"))
    rows = base_statistics(whole, keep=("whole",))
    return rows_where(rows, ~base_failed() & verdict(rules).isNull()).select("whole.*")
