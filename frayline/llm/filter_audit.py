"""Filter interaction audit: what each filter removes, in every order of the filters, from tables of failing ids.

Every filter has one table of the rows that fail it.  What a sequence of filters leaves does
not depend on their order, so the survivors of each *set* of filters are worked out once: those
of a set are those of the set without its last filter, left-anti joined to that filter's table.
The failing rows of a filter, semi joined to the survivors of a set, are what it removes after
that set; anti joined, what it finds removed already.  All orders are read from these counts.

Rows are numbered once, in a written table, so that repeated and null ids are rows of their own.
A null text is empty; a row with a null id is never a copy of another one (and no other row is
its copy); rows that repeat an id and its text are not copies of each other; a null part is the
empty string.  Labels of one id are taken together: it is good or toxic if any row says so; ids
without labels are neither.  An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable, forget

BLANKS = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of a text: too few words, too few distinct words, too many capitals, symbols."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _numbered(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column], text: Column, part: Column, id_col: str) -> DataFrame:
    """``row, id, part, digest, good, toxic`` and the verdict of each condition, written once; text is read once."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.sha2(F.encode(text, "UTF-8"), 256).alias("digest"), *[c.alias(f"fails_{k}") for k, c in conditions.items()])
    of = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = rows.where("id is not null").join(of.hint("merge"), "id", "left")
    unknown = rows.where("id is null").withColumns({"good": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})  # never one task's: null keys are not shuffled
    both = known.unionByName(unknown).withColumns({"good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))})
    return durable(both.withColumn("row", F.monotonically_increasing_id()), "audit-rows")


def later_copies(rows: DataFrame) -> DataFrame:
    """Rows (``id, digest``) whose digest a smaller id has too.

    The least id of each digest is an aggregate, combined before the shuffle; the anti join is
    on digest and id, so a large group of copies is spread over its ids.
    """
    known = rows.where("id is not null")
    first = known.groupBy("digest").agg(F.min("id").alias("id"))
    return known.join(first.hint("merge"), ["digest", "id"], "left_anti")


def audit_filters(
    docs: DataFrame, labels: DataFrame, conditions: dict[str, Column] | None = None, copies: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """A row for each part, order of the filters and step: ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    ``conditions``: letters and failure conditions of the columns of ``docs`` (``text_filters`` by default);
    ``copies``: the letter of the filter for texts that a smaller id has, if any.  ``labels`` has the id,
    ``quality`` and ``toxic``.  With n filters there are 2**n sets and n! orders, so n is at most 6.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    conditions = text_filters(text) if conditions is None else conditions
    letters = "".join(sorted([*conditions, *([copies] if copies else [])]))
    if not 1 <= len(letters) <= 6 or any(len(k) != 1 for k in letters):
        raise ValueError("one to six filters of one letter each are needed")
    base = _numbered(docs, labels, conditions, text, F.col(part_col), id_col)
    failing = {k: base.where(f"fails_{k}") for k in conditions} | ({copies: later_copies(base)} if copies else {})
    #: One table of ids for each filter.
    failing = {k: durable(rows.select("row", "part", "good", "toxic"), f"audit-fails-{k}") for k, rows in failing.items()}
    spent = [base, *failing.values()]

    def tagged(columns: list[str]) -> DataFrame:
        out = None
        for n, k in enumerate(letters):
            rows = failing[k].select(*columns, F.lit(n).alias("filter"))
            out = rows if out is None else out.unionByName(rows)
        return out

    left = base.select("row", "part", F.lit(0).alias("done"))
    survivors = left
    for _ in letters:
        # each set is reached from the set without its last filter
        more = left.withColumn("filter", F.explode(F.sequence(F.lit(0), F.lit(len(letters) - 1)))).where(F.call_function("shiftright", F.col("done"), F.col("filter")) == 0)
        left = more.join(tagged(["row"]).hint("merge"), ["row", "filter"], "left_anti").select("row", "part", (F.col("done") + _bit(F.col("filter"))).alias("done"))
        left = durable(left, "audit-survivors")
        spent.append(left)
        survivors = survivors.unionByName(left)

    sets = F.filter(F.sequence(F.lit(0), F.lit((1 << len(letters)) - 1)), lambda s: s.bitwiseAND(_bit(F.col("filter"))) == 0)
    tried = tagged(["row", "part", "good", "toxic"]).withColumn("done", F.explode(sets))
    there = survivors.select("row", "done").hint("merge")
    cell = ["part", "done", "filter"]
    removed = tried.join(there, ["row", "done"], "left_semi").groupBy(cell).agg(F.count("*").alias("removed"), F.sum("good").alias("good_lost"), F.sum("toxic").alias("toxic_lost"))
    redundant = tried.join(there, ["row", "done"], "left_anti").groupBy(cell).agg(F.count("*").alias("redundant"))
    counts = durable(removed.join(redundant.hint("merge"), cell, "full"), "audit-counts")
    kept = durable(survivors.groupBy("part", F.col("done").alias("after")).agg(F.count("*").alias("kept")), "audit-kept")
    forget(*spent)
    return _by_order(counts, kept, letters)


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), n)


def _by_order(counts: DataFrame, kept: DataFrame, letters: str) -> DataFrame:
    """All orders of the filters, from the counts of each (part, set, filter) and (part, set)."""
    n = len(letters)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    size = F.bit_count("done")
    # of all orders, those in which just this set goes before the filter
    orders = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), size + 1).cast("long")
    of_filter = counts.groupBy("part", "filter").agg(F.sum(F.coalesce("removed", F.lit(0)) * orders).alias("shapley"), F.sum(F.when(size == n - 1, F.col("removed"))).alias("unique_fails"))
    every = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = kept.where("after = 0").select("part", F.explode(every).alias("filter_order")).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    place = lambda c: F.instr(F.lit(letters), c) - 1
    before = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda s, i: s + F.when(i < F.col("step"), _bit(place(F.substring("filter_order", i, F.lit(1))))).otherwise(0))
    steps = steps.withColumns({"filter": place(F.substring("filter_order", F.col("step"), F.lit(1))), "done": before}).withColumn("after", F.col("done") + _bit(F.col("filter")))
    rows = steps.join(counts.hint("merge"), ["part", "done", "filter"], "left").join(of_filter.hint("merge"), ["part", "filter"], "left").join(kept.hint("merge"), ["part", "after"], "left")
    return rows.select("part", "filter_order", "step", *[zero(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])


#: The same counts in DuckDB SQL, from the verdicts of each row.
AUDIT_SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d LEFT JOIN l USING (doc_id)),
g AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL), parts AS (SELECT DISTINCT part FROM g),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (SELECT [a.b, b.b, c.b, d.b, e.b] AS bits, a.c || b.c || c.c || d.c || e.c AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE a.b | b.b | c.b | d.b | e.b = 31),
steps AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS done FROM orders, (SELECT unnest(range(1, 6))::INT AS step)),
rows_ AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (WHERE mask & (done | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & done = 0 AND mask & bit > 0), 0) AS removed,
  coalesce(sum(n) FILTER (WHERE mask & done > 0 AND mask & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (WHERE mask & done = 0 AND mask & bit > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & done = 0 AND mask & bit > 0), 0) AS toxic_lost FROM steps, g GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM rows_"""
