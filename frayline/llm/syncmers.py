"""Document fingerprints by closed syncmers: runs of words whose least inner pair stands at an edge.

Of every K consecutive words the hashes of the inner runs of S words are compared; the K words
are an anchor if the least of these is the first or the last one.  Whether they are depends on
these K words alone, not on what is around them, so two texts that share a passage share its
anchors, however the rest of them differs, and anchors never lie further apart than K - S + 1
words.  An anchor is kept with its place, so that shared anchors tell where a passage stands.

Words are what lies between blanks, case kept.  A text of fewer than K words is one anchor as a
whole; a text without words (null, empty, blank) has none and the empty fingerprint.  A hash has
32 bits: of two unlike texts of 5,000 anchors each, less than one in a hundred anchors agrees by
chance.  Everything is column expressions; a text is worked on where it is, as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.corrupt import let

#: Words of an anchor, and of the inner runs that are compared.
K, S = 5, 2
#: Ranges of ids beyond which no more are cut.
MOST_RANGES = 4096


def _spots(size: Column, width: int) -> Column:
    """0 to size - width, or nothing."""
    return F.when(size >= width, F.sequence(F.lit(0), size - width)).otherwise(F.array().cast("array<int>"))


def _folded(hashes: Column, i: Column, n: int) -> Column:
    """One number of n consecutive hashes, in their order."""
    out = F.get(hashes, i)
    for k in range(1, n):
        out = F.call_function("shiftleft", out, F.lit(7)).bitwiseXOR(F.call_function("shiftrightunsigned", out, F.lit(57))).bitwiseXOR(F.get(hashes, i + k))
    return out


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """The anchors of a text in order: longs, in the upper 32 bits the hash, in the lower the number of the first word."""
    if not 1 <= s < k:
        raise ValueError("an inner run must be shorter than the anchor")
    hashes = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def mixed(value: Column, place: Column) -> Column:
        return F.call_function("shiftleft", F.xxhash64(value), F.lit(32)).bitwiseOR(place.cast("long"))

    def chosen(h: Column) -> Column:
        inner = F.transform(_spots(F.size(h), s), lambda i: _folded(h, i, s))

        def at_edge(p: Column) -> Column:
            last = k - s
            edge = lambda i: F.least(F.get(p, i), F.get(p, i + last))
            within = lambda i: F.least(*[F.get(p, i + j) for j in range(last + 1)])
            return F.filter(_spots(F.size(h), k), lambda i: edge(i) == within(i))

        whole = F.array(mixed(F.aggregate(h, F.size(h).cast("long"), lambda a, x: F.xxhash64(a, x)), F.lit(0)))
        runs = F.transform(let(inner, at_edge), lambda i: mixed(_folded(h, i, k), i))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < k, whole).otherwise(runs)

    return let(hashes, chosen)


def _hashes(of: Column) -> Column:
    return F.transform(of, lambda a: F.call_function("shiftrightunsigned", a, F.lit(32)))


def fingerprint(of: Column) -> Column:
    """Eight hexadecimal digits for each anchor, in the order of the text."""
    return F.array_join(F.transform(of, lambda a: F.lower(F.substring(F.lpad(F.hex(a), 16, "0"), 1, 8))), "")


def likeness(a: Column, b: Column) -> Column:
    """Twice the distinct anchors in common over the distinct anchors of both, 0 to 1; without any anchor on both sides 1."""

    def of(one: Column, two: Column) -> Column:
        total = F.size(one) + F.size(two)
        return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(one, two)) / F.greatest(total, F.lit(1)))

    return let(F.array_distinct(_hashes(a)), lambda one: let(F.array_distinct(_hashes(b)), lambda two: of(one, two)))


def in_place(a: Column, b: Column) -> Column:
    """Anchors that two texts have at the same word: what an edit further on leaves alone."""
    return F.size(F.array_intersect(a, b))


def matched_places(pairs: DataFrame, a: str, b: str, key: list[str]) -> DataFrame:
    """``shift, matches`` of each pair: shared anchors (columns ``a, b``) by how many words further on they stand in ``b``.

    A shared passage is one shift of many matches.  Anchors that one text repeats meet at each of their places.
    """
    place = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    side = lambda c, n: pairs.select(*key, F.explode(c).alias("x")).select(*key, F.call_function("shiftrightunsigned", F.col("x"), F.lit(32)).alias("h"), place(F.col("x")).alias(n))
    both = side(a, "at_a").join(side(b, "at_b"), [*key, "h"])
    return both.groupBy(*key, (F.col("at_b") - F.col("at_a")).alias("shift")).agg(F.count("*").alias("matches"))


def with_next(docs: DataFrame, id_col: str, text_col: str, ranges: int | None = None) -> DataFrame:
    """``id, text, next_text``: every row with the text of the row after it by descending id; the row after the last is the first.

    Null ids come last; rows of one id are ordered by their texts, descending.  Ids are cut into
    ranges at approximate quantiles, so no task sorts the table; the first row of each range is
    also given to the range before it.  Rows of one id (or without any) are one task's.
    """
    spark = docs.sparkSession
    ranges = min(MOST_RANGES, ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 100 * ranges).alias("c")).first()["c"] if ranges > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    below = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c > F.col("id"))) if cuts else F.lit(0)
    rows = rows.withColumn("range", F.when(F.col("id").isNull(), len(cuts) + 1).otherwise(below))
    # the first row of each range: one id each, then the largest of its texts
    first = rows.groupBy("range").agg(F.max("id").alias("id"))
    order = Window.orderBy("range")  # of ranges, MOST_RANGES at most
    ends = first.withColumns({"before": F.coalesce(F.lag("range").over(order), F.max("range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))})
    same = rows["range"].eqNullSafe(ends["range"]) & rows["id"].eqNullSafe(ends["id"])
    heads = rows.join(F.broadcast(ends), same).groupBy(F.col("before").alias("range")).agg(F.max("text").alias("text"))
    every = rows.withColumn("ghost", F.lit(0)).unionByName(heads.select(F.lit(None).cast("long").alias("id"), "text", "range", F.lit(1).alias("ghost")))
    here = Window.partitionBy("range").orderBy("ghost", F.col("id").desc_nulls_last(), F.col("text").desc())
    dealt = every.repartitionById(len(cuts) + 2, "range")
    return dealt.withColumn("next_text", F.lead("text").over(here))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last half replaced by as many of the next document's first code points
    (all, if that is shorter).  Returns ``id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, n_anchors, n_in_place``, the last being anchors that
    the edited text has at the same word.  A single row is its own next.  Repeated rows are rows of
    their own; further columns are ignored; an empty table gives no rows.
    """
    here = Window.partitionBy("range").orderBy("ghost", F.col("id").desc_nulls_last(), F.col("text").desc())
    rows = with_next(docs, id_col, text_col).withColumn("own", anchors(F.col("text"), k, s))
    rows = rows.withColumn("next", F.lead("own").over(here)).where("ghost = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    rows = rows.select(F.col("id").alias(id_col), n.cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "own", "next", anchors(F.col("edited"), k, s).alias("changed"))
    return rows.select(
        id_col, "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
        F.size("own").cast("long").alias("n_anchors"), in_place(F.col("own"), F.col("changed")).cast("long").alias("n_in_place"),
    )
