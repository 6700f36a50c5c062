"""Shards along a Hilbert curve over metadata: near neighbours in several dimensions share files, so readers can skip files.

Only DataFrame and SQL expressions.  The curve is followed by a table of states, built
from the rule of the curve for any number of dimensions, and looked up once for each bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .durable import durable, forget

#: Cells along each dimension: 2 to this power.
BITS = 5


def _gray(i: int) -> int:
    return i ^ (i >> 1)


def _rotate(x: int, k: int, n: int) -> int:
    """Rotate the n bits of x left by k."""
    k %= n
    return ((x << k) | (x >> (n - k))) & ((1 << n) - 1)


def _entry(i: int) -> int:
    """The corner at which the curve enters sub-cube number i."""
    return 0 if i == 0 else _gray(2 * ((i - 1) // 2))


def _direction(i: int, n: int) -> int:
    """The axis along which sub-cube number i is crossed: trailing ones of the odd number at or below i (0 for 0)."""
    odd = i if i % 2 else i - 1
    return 0 if i == 0 else ((odd ^ (odd + 1)).bit_length() - 1) % n


def curve_table(n: int) -> tuple[list[int], list[int]]:
    """For state s = entry * n + axis and cell c (a bit of each dimension), at s * 2**n + c: digit of the index, next state."""
    cells = 1 << n
    position = {_gray(w): w for w in range(cells)}
    digits, states = [], []
    for state in range(cells * n):
        entry, axis = divmod(state, n)
        for cell in range(cells):
            w = position[_rotate(cell ^ entry, n - (axis + 1) % n, n)]
            digits.append(w)
            states.append((entry ^ _rotate(_entry(w), axis + 1, n)) * n + (axis + _direction(w, n) + 1) % n)
    return digits, states


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """The curve's index (long) of a cell given by one integer of ``bits`` bits for each dimension."""
    n = len(dims)
    digits, states = curve_table(n)
    digit_of = F.array(*[F.lit(d) for d in digits])
    state_of = F.array(*[F.lit(s) for s in states])

    def step(acc: Column, bit: Column) -> Column:
        cell = F.lit(0)
        for k, dim in enumerate(dims):
            cell = cell + F.get(F.array(*[F.getbit(dim, F.lit(b)).cast("int") * (1 << k) for b in range(bits)]), bit)
        at = acc["state"] * (1 << n) + cell
        return F.struct((acc["index"] * (1 << n) + F.get(digit_of, at)).alias("index"), F.get(state_of, at).alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["index"])


def _ranked_cells(values: DataFrame, name: str, bits: int) -> DataFrame:
    """``value, cell`` of the distinct texts of a column: cells of about equal numbers of rows, in the order of the whole values."""
    counts = values.where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    ordered = durable(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()), f"shard-{name}")
    sums = sorted((r["part"], r["n"]) for r in ordered.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row for each partition
    total, before, offsets = sum(n for _, n in sums), 0, []
    for part, n in sums:
        offsets.append((part, before))
        before += n
    known = values.sparkSession.createDataFrame(offsets, "part int, start long")
    up_to = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("start") + F.coalesce(F.sum("n").over(up_to), F.lit(0))
    return ordered.join(F.broadcast(known), "part").select("value", F.floor(rank * (1 << bits) / max(1, total)).cast("int").alias("cell"))


def shard_documents(
    docs: DataFrame,
    n_shards: int = 40,
    dimensions: tuple[str, ...] = ("lang", "source", "n_chars"),
    bits: int = BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: bool = False,
) -> DataFrame:
    """Put every row into one of ``n_shards`` runs of the Hilbert order, with counts at most one apart.

    Each dimension is cut into 2**bits cells at quantiles of the whole table, texts by the ranks
    of their whole values (nulls and absent columns: cell 0).  Equal texts are one group: it has
    the least cell of its rows and lies together in the order, by the hash of the text and then
    by id.  A cut between shards falls inside a group only where equal counts demand it, so at
    most ``n_shards - 1`` groups are in more than one shard; a group that holds more than a
    shard's rows must be.  A cell that holds a third of all rows is spread over partitions.

    Returns ``doc_id, size`` (UTF-8 bytes of the text plus 16; null: 16), ``text_crc32`` (0 for
    null and empty), ``cell`` (curve index), ``shard`` and ``slot`` (place in the shard, from 0),
    and with ``keep`` the source's ``row``.  A very long text is hashed where it is and not moved
    (but for ``keep``).  Null ids and repeated rows are rows like others; fewer rows than shards
    leave shards empty; columns of clashing names are not read; an empty table gives no rows.
    """
    kinds = dict(docs.dtypes)
    use = [c for c in dimensions if c in kinds]
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    carried = ["row"] if keep else []
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
        *[F.col(c).cast("string" if kinds[c] == "string" else "double").alias(f"dim{k}") for k, c in enumerate(use)],
        *([F.struct(*docs.columns).alias("row")] if keep else []),
    )
    base = durable(base, "shard-metadata")
    cuts = [i / (1 << bits) for i in range(1, 1 << bits)]
    numbers = [k for k, c in enumerate(use) if kinds[c] != "string"]
    quantiles = base.agg(*[F.percentile_approx(f"dim{k}", cuts, 10_000).alias(f"q{k}") for k in numbers]).first() if numbers else None
    placed = base
    for k, c in enumerate(use):
        if k in numbers:
            edges = sorted(set(quantiles[f"q{k}"] or []))
            value = F.coalesce(F.col(f"dim{k}"), F.lit(float("-inf")))
            placed = placed.withColumn(f"cell{k}", sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0)))
        else:
            found = _ranked_cells(base.select(F.col(f"dim{k}").alias("value")), c, bits)
            placed = placed.join(found.select(F.col("value").alias(f"dim{k}"), F.col("cell").alias(f"cell{k}")), f"dim{k}", "left").fillna(0, [f"cell{k}"])
    index = hilbert_index([F.col(f"cell{k}") for k in range(len(use))], bits) if use else F.lit(0).cast("long")
    placed = placed.select("doc_id", "size", "text_crc32", "text_key", index.alias("own"), *carried)
    groups = placed.groupBy("text_key").agg(F.min("own").alias("cell"), F.max("own").alias("most")).where("cell < most").drop("most")  # groups in several cells only
    placed = placed.join(groups, "text_key", "left").withColumn("cell", F.coalesce("cell", "own"))
    # The order: range partitions, each sorted; written once, so that counts and ranks see the same partitions.
    key = ["cell", "text_crc32", "text_key", "doc_id"]
    within = F.monotonically_increasing_id()
    ordered = placed.select(*key, "size", *carried).repartitionByRange(*key, F.xxhash64("doc_id", "size")).sortWithinPartitions(*key)
    ordered = durable(ordered.select("*", F.shiftright(within, 33).cast("int").alias("part"), within.bitwiseAND((1 << 33) - 1).alias("place")), "shard-order")
    counts = sorted((r["part"], r["count"]) for r in ordered.groupBy("part").count().collect())  # one row for each partition
    forget(base)
    total, before, offsets = sum(c for _, c in counts), 0, []
    for part, count in counts:
        offsets.append((part, before))
        before += count
    names = ["doc_id", "size", "text_crc32", "cell", *carried]
    if not total:
        return ordered.select(*names, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    known = docs.sparkSession.createDataFrame(offsets, "part int, before long")
    rank = F.col("before") + F.col("place")
    shard = F.expr(f"(before + place) * {n_shards}L div {total}L")
    ranked = ordered.join(F.broadcast(known), "part").select(*names, rank.alias("rank"), shard.alias("shard"))
    begins = F.expr(f"(shard * {total}L + {n_shards - 1}L) div {n_shards}L")  # the smallest rank of the shard
    return ranked.select(*names, F.col("shard").cast("int").alias("shard"), (F.col("rank") - begins).alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, dimensions: tuple[str, ...] = ("lang", "source", "n_chars"), bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows of ``docs`` as Parquet, a folder ``shard=k`` each, in the order of the curve, so that the files' ranges of each dimension are narrow."""
    rows = shard_documents(docs, n_shards, dimensions, bits, id_col, text_col, keep=True).select("shard", "slot", "row")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").select("shard", "row.*").write.partitionBy("shard").parquet(path)
