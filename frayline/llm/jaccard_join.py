"""Exact Jaccard similarity join on word shingles by token-combination prefixes.

Each text is a set of shingles (tokens).  All tokens have one global order: rare ones
first, frequent ones last.  A set of n tokens can miss at most ``n - need`` of them in a
similar set, so of its first ``n - need + 1`` tokens at least one is shared: rare tokens
are indexed alone.  Frequent tokens are dealt into classes and indexed as pairs of one
class: every class gives the prefix one token less, so the prefix is extended until its
tokens, less one for each class met, outnumber the tokens that may be missing; then some
class has two shared tokens.  Pairs are far more selective than single frequent tokens.

What is frequent comes from counts over the whole corpus in a table of fixed size; a
token that falls in with others is at worst indexed as a pair, which is exact as well.

Candidates in a list are not paired with each other at first: all are compared with the
list's most central text.  Only texts of different components that still share a list are
then paired, and of these pairs only those are compared whose sketches (parities of their
tokens on a fixed number of bits) leave room for the similarity, so that a large group of
near copies costs about as many comparisons as it has members, and no link that could join
two components is missed.

The links of each text are counted afterwards.  Both ends of a link are in one component, so
the sets of a component are dealt into blocks of a bounded number of sets and shingles, and a
task compares two blocks by one product of their incidence matrices: what is moved is a set
for each block of its component, what comes out is one number for each set, and no pair is a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected_components
from .durable import durable, forget
from .textblocks import NOT_BLANK, PLACE, blocks, hash_spans, mix, text_shingles, words

SHINGLE = 5
#: Linked: 100 * shared >= PERCENT * united.
PERCENT = 80
#: Slots of the table of token counts: 2 to this power, whatever the size of the corpus.
COUNT_BITS = 22
#: The table travels in pieces of so many slots.
PIECE = 1 << 13
#: Lists of token pairs are first dealt with in so many parts.
PARTS = 32
#: Bits of the filter that keeps unwanted texts from being moved.
FILTER_BITS = 1 << 24
#: Words of 64 bits in the sketch of a set.
SKETCH = 8
#: A text of a list knows so many lists before it of its own, by which a pair that has met before is told.
BEFORE = 8
#: Sets of a component are compared in blocks of about so many sets,
BLOCK_SETS = 2048
#: of about so many shingles together,
BLOCK_SHINGLES = 1 << 20
#: in strips of so many sets,
STRIP = 256
#: by so many shingles at a time.
COLUMNS = 2048


def text_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for block in blocks(column):
        found = words(block, NOT_BLANK)
        hashes = hash_spans(block, found.starts, found.ends)
        for i in range(len(block.offsets) - 1):
            yield block.first + i, text_shingles(hashes[found.first[i] : found.first[i + 1]], k)


def set_key(tokens: np.ndarray) -> int:
    """One number for a set: equal sets have equal keys, others differ but for a chance of 2**-64."""
    if not len(tokens):
        return 0
    return int(mix(np.array([mix(tokens ^ PLACE[0]).sum(dtype=np.uint64) + np.uint64(len(tokens))], dtype=np.uint64)).view(np.int64)[0])


def need(n: int, percent: int) -> int:
    """Tokens that a similar set must share with one of n tokens."""
    return -(-percent * n // 100)


def level(n: int) -> int:
    """Classes of frequent tokens: 2**level, about one for 16 tokens of a set."""
    return max(0, (n // 16).bit_length() - 1)


def signatures(tokens: np.ndarray, counts: np.ndarray, frequent_from: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of a set, the place of each in the order, and whether it is a pair.

    Two sets with the wanted similarity share a signature at whose places the positional
    bound holds (see ``similar_enough``).
    """
    n = len(tokens)
    missing = n - need(n, percent)
    count = counts[(tokens >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
    is_frequent = count >= frequent_from
    rare = tokens[~is_frequent]
    rare = rare[np.lexsort((rare, count[~is_frequent]))]
    if n < 2:  # a similar set would be equal
        return tokens[:0], np.empty(0, np.int64), np.empty(0, bool)
    if len(rare) > missing:
        return rare[: missing + 1], np.arange(missing + 1), np.zeros(missing + 1, bool)
    frequent, count = tokens[is_frequent], count[is_frequent]
    frequent = frequent[np.lexsort((frequent, count))]
    pairs = []
    for lev in sorted({level(need(n, percent)), level(n), level(100 * n // percent)}):
        kind = (mix(frequent ^ PLACE[1]) >> np.uint64(40)).astype(np.int64) & ((1 << lev) - 1)
        order = np.argsort(kind, kind="stable")
        sizes = np.bincount(kind, minlength=1 << lev)
        rank = np.empty(len(kind), dtype=np.int64)
        rank[order] = np.arange(len(kind)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        stop = int(np.searchsorted(len(rare) + np.cumsum(rank >= 1), missing + 1)) + 1
        kind = kind[:stop]
        order = np.argsort(kind, kind="stable")
        ranked = frequent[:stop][order]
        for own in np.split(ranked, np.flatnonzero(np.diff(kind[order])) + 1):
            i, j = np.triu_indices(len(own), 1)
            pairs.append(mix(own[i] * PLACE[2] + own[j] * PLACE[3] + np.uint64(lev)))
    both = np.concatenate([rare, *pairs])
    places = np.concatenate([np.arange(len(rare)), np.full(len(both) - len(rare), len(rare))])
    return both, places, np.arange(len(both)) >= len(rare)


def similar_enough(a: str, b: str, percent: int = PERCENT) -> str:
    """SQL: sizes na, nb and places pa, pb leave room for the similarity.

    At the first shared token nothing before either place is shared.  Where a pair is the
    signature, either a rare token is shared, which then is a signature of its own, or none
    is, and the places are the numbers of rare tokens.
    """
    room = f"least(n{a} - p{a}, n{b} - p{b})"
    return f"100 * least(n{a}, n{b}) >= {percent} * greatest(n{a}, n{b}) and {100 + percent} * {room} >= {percent} * (n{a} + n{b})"


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The parity of the tokens that fall on each of 64 * SKETCH bits."""
    bits = np.bincount((mix(tokens ^ PLACE[2]) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def sketches_allow(a: str, b: str, percent: int = PERCENT) -> str:
    """SQL: the sketches s0a.., s0b.. leave room for the similarity.

    Every bit in which they differ stands for at least one token of only one of the sets.
    """
    differ = " + ".join(f"bit_count(s{i}{a} ^ s{i}{b})" for i in range(SKETCH))
    return f"{100 + percent} * (n{a} + n{b} - ({differ})) >= {2 * percent} * (n{a} + n{b})"


SKETCHES = [f"s{i}" for i in range(SKETCH)]


def _side(nodes: DataFrame, name: str) -> DataFrame:
    """Sizes and sketches of sets as one side of a pair."""
    return nodes.select(F.col("node").alias(name), F.col("n").alias(f"n{name}"), *[F.col(c).alias(c + name) for c in SKETCHES])


def _texts(keyed: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, text``: one text of each set in ``wanted`` (``node``).

    A bitmap of fixed size tells, before any text is moved, most rows that are not wanted;
    where it is full, on a very large corpus, all rows go to the join, which decides.
    """
    chosen = nodes.join(wanted, "node", "left_semi").select("node", F.coalesce("row.doc_id", F.lit(-1)).alias("doc_id"), "row.text_key")
    slot = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(FILTER_BITS))
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    filled = chosen.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    bitmap[filled["word"].to_numpy()] = filled["bits"].to_numpy()
    bitmap_ = keyed.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            slots = batch.column(0).to_numpy()
            maybe = np.flatnonzero(bitmap_.value[slots >> 6] >> (slots & 63) & 1)
            row_of = batch.column(1).to_numpy()
            rows = [int(i) for i in maybe if row_of[i] not in seen and not seen.add(row_of[i])]
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(rows, pa.int64())) for k in (2, 3, 4)], ["doc_id", "text_key", "text"])

    rows = keyed.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "text_key", "text")
    rows = rows.select(slot.alias("slot"), F.xxhash64("text_key", "doc_id").alias("row"), "doc_id", "text_key", "text")
    rows = rows.mapInArrow(run, "doc_id long, text_key long, text string")
    # repeated rows of one id and text, which are left once for each task, meet where the join has brought them
    return rows.join(chosen, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select("node", "text")


def _verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` of set keys whose texts meet the threshold, by their whole sets."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            good = []
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                sets = []
                for key, column in ((a, 2), (b, 3)):
                    if key not in known:
                        if len(known) >= 64:
                            known.clear()
                        known[key] = next(text_sets(batch.column(column).slice(i, 1), k))[1]
                    sets.append(known[key])
                shared = len(np.intersect1d(*sets, assume_unique=True))
                good.append(100 * shared >= percent * (len(sets[0]) + len(sets[1]) - shared))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.select("doc_id", "text", F.xxhash64("text").alias("text_key"))


def count_links(left: list[np.ndarray], right: list[np.ndarray] | None, copies: tuple[np.ndarray, np.ndarray | None], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray | None]:
    """How many copies of sets of the other side each set is linked with; without a right side, of the other sets of its own."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    held = times > 1  # what only one set has is shared with none
    chosen = held[column]
    column = (np.cumsum(held) - 1)[column[chosen]]
    row = np.repeat(np.arange(len(sets)), sizes)[chosen]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    ends = range(0, int(held.sum()), COLUMNS)
    cuts = [(at, *np.searchsorted(column, [at, at + COLUMNS]).tolist()) for at in ends]
    first = len(left) if right is not None else 0
    n_left, n_right = sizes[: len(left)], sizes[first:]
    weight = copies[1] if right is not None else copies[0]
    out = np.zeros(len(left), dtype=np.int64)
    back = np.zeros(len(n_right), dtype=np.int64)
    for low in range(0, len(left), STRIP):
        high = min(low + STRIP, len(left))
        shared = np.zeros((high - low, len(n_right)))
        for at, a, b in cuts:
            r, c = row[a:b], column[a:b] - at
            mine = (r >= low) & (r < high)
            if not mine.any():
                continue
            one = np.zeros((high - low, COLUMNS), dtype=np.float32)
            one[r[mine] - low, c[mine]] = 1
            two = np.zeros((len(n_right), COLUMNS), dtype=np.float32)
            theirs = r >= first
            two[r[theirs] - first, c[theirs]] = 1
            shared += one @ two.T
        linked = 100 * shared >= percent * (n_left[low:high, None] + n_right[None, :] - shared)
        if right is None:
            linked[np.arange(high - low), np.arange(low, high)] = False
        out[low:high] = linked @ weight
        back += copies[0][low:high] @ linked
    return out, back if right is not None else None


def _count_links(sets: DataFrame, sizes: DataFrame, keyed: DataFrame, k: int, percent: int) -> DataFrame:
    """``node, linked``: for each set (``node, label, row, copies``) of a component of several, the rows of other sets that it links with."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    members = sets.join(sizes.where("m > 1").select("label", blocks.alias("blocks")), "label")
    members = durable(members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "shingle-blocks")
    texts = _texts(keyed, members, members.select("node"))
    told = members.select("node", "label", "copies", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    told = told.join(texts, "node").withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    key = ["label", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def counted() -> pa.RecordBatch:
            one, two = [h for h in held if h[0] == now[1]], [h for h in held if h[0] != now[1]]
            copies = [np.array([h[2] for h in side], dtype=np.int64) for side in (one, two)]
            if now[1] == now[2]:
                numbers, _ = count_links([h[3] for h in one], None, (copies[0], None), percent)
            elif one and two:
                numbers = np.concatenate(count_links([h[3] for h in one], [h[3] for h in two], (copies[0], copies[1]), percent))
            else:
                numbers = np.zeros(len(held), dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array([h[1] for h in one + two], pa.int64()), pa.array(numbers, pa.int64())], ["node", "linked"])

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            places, nodes, copies = (batch.column(i).to_pylist() for i in (3, 4, 5))
            for i, tokens in text_sets(batch.column(6), k):
                if keys[i] != now:
                    if held:
                        yield counted()
                    now, held = keys[i], []
                held.append((places[i], nodes[i], copies[i], tokens))
        if held:
            yield counted()

    told = told.select(*key, "block", "node", "copies", "text").repartition(*key).sortWithinPartitions(*key)
    counted = durable(told.mapInArrow(run, "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked")), "shingle-counts")
    forget(members)
    return counted


def linked_sets(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``doc_id, text_key, n, node`` of each row: hash of its text, size and key of its set; and ``node, component`` of the sets with links."""
    keyed = _keyed(docs, id_col, text_col)
    spark = docs.sparkSession

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, dtype=np.int32)
        seen: set[int] = set()
        for batch in batches:
            keys, sizes = [], []
            drawn = np.zeros((batch.num_rows, SKETCH), dtype=np.int64)
            for i, tokens in text_sets(batch.column(1), k):
                key = set_key(tokens)
                keys.append(key)
                sizes.append(len(tokens))
                drawn[i] = sketch(tokens)
                if key not in seen:
                    seen.add(key)
                    np.add.at(counts, (tokens >> np.uint64(64 - COUNT_BITS)).astype(np.int64), 1)
            none = [None] * len(keys)
            yield _described(batch.column(0), keys, sizes, batch.column(2), none, none, drawn.T)
        pieces = [(i, counts[i * PIECE : (i + 1) * PIECE]) for i in range(len(counts) // PIECE)]
        pieces = [(i, _packed(c)) for i, c in pieces if c.any()]
        none = [None] * len(pieces)
        yield _described(none, none, none, none, [i for i, _ in pieces], [c for _, c in pieces], [none] * SKETCH)

    schema = ", ".join(["doc_id long, node long, n int, text_key long, piece int, counts binary", *(f"{c} long" for c in SKETCHES)])
    facts = durable(keyed.mapInArrow(describe, schema), "shingle-sets")
    counts = _total_counts(facts.where("piece is not null").select("piece", "counts"))
    usual = float(np.median(counts))
    frequent_from = int(usual + max(32, 8 * np.sqrt(usual)))
    counts_ = spark.sparkContext.broadcast(counts)
    facts = facts.where("piece is null")
    # one row of each set: copies are combined before they are moved
    nodes = facts.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("row"), F.max("n").alias("n"), *[F.max(c).alias(c) for c in SKETCHES])
    nodes = durable(nodes, "shingle-nodes")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for _, tokens in text_sets(batch.column(0), k):
                key = set_key(tokens)
                if key in seen:
                    continue
                seen.add(key)
                both, places, paired = signatures(tokens, counts_.value, frequent_from, percent)
                out.append((both, places, paired, key, len(tokens)))
                held += len(both)
                if held > 200_000:
                    yield _signed(out)
                    out, held = [], 0
            if out:
                yield _signed(out)

    signed = keyed.select("text").mapInArrow(sign, "sig long, node long, n int, p int, paired boolean")
    signed = signed.withColumn("part", F.when(F.col("paired"), F.pmod(F.xxhash64("node"), F.lit(PARTS))).otherwise(0).cast("int"))
    central = F.first(F.struct("node", "n", "p")).over(Window.partitionBy("sig", "part").orderBy("p", "n", "node"))
    lists = signed.withColumn("c", central).where("node <> c.node or paired")
    lists = durable(lists.select("sig", "paired", F.col("c.node").alias("a"), F.col("c.n").alias("na"), F.col("c.p").alias("pa"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb")), "shingle-lists")
    # the central texts of the parts of one list of token pairs meet in a second round
    heads = lists.where("paired").select("sig", "a", "na", "pa").distinct()
    central = F.first(F.struct("a", "na", "pa")).over(Window.partitionBy("sig").orderBy("pa", "na", "a"))
    heads = heads.withColumn("c", central).where("a <> c.a")
    heads = heads.select("sig", F.lit(True).alias("paired"), F.col("c.a").alias("a"), F.col("c.na").alias("na"), F.col("c.pa").alias("pa"), F.col("a").alias("b"), F.col("na").alias("nb"), F.col("pa").alias("pb"))
    stars = durable(lists.where("a <> b").unionByName(heads), "shingle-stars")
    forget(lists)

    first = stars.where(similar_enough("a", "b", percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = first.join(_side(nodes, "a"), "a").join(_side(nodes, "b"), "b").where(sketches_allow("a", "b", percent))
    first = durable(first.select("a", "b"), "shingle-pairs")
    texts = durable(_texts(keyed, nodes, _ends(first).distinct()), "shingle-texts")
    links = durable(_verify(first, texts, k, percent), "shingle-links")
    forget(texts)

    # a list of single tokens has compared its central text with all others, so only these are left to compare with each other
    members = stars.where("paired").select("sig", F.col("a").alias("node"))
    members = members.unionByName(stars.select("sig", F.col("b").alias("node"))).distinct()
    part = connected_components(links)
    placed = durable(members.join(part, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("label")), "shingle-members")
    forget(stars)
    open_lists = placed.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("sig")
    placed = placed.join(open_lists, "sig").join(nodes.drop("row"), "node")
    before = F.collect_list("sig").over(Window.partitionBy("node").orderBy("sig").rowsBetween(-BEFORE, -1))
    placed = durable(placed.withColumn("before", before), "shingle-open")
    one, two = (placed.select("sig", *[F.col(c).alias(name + x) for c, name in (("node", ""), ("n", "n"), ("label", "l"), ("before", "before_"), *((c, c) for c in SKETCHES))]) for x in "ab")
    met = one.join(two, "sig").where("a < b and la <> lb").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").where(sketches_allow("a", "b", percent))
    # all filters are the pair's own, so it is the same in every list: it counts in the first one, and where that is out of sight
    rest = met.where("not arrays_overlap(before_a, before_b)").select("a", "b").distinct()
    rest = durable(rest.join(first, ["a", "b"], "left_anti"), "shingle-rest")
    more = durable(_verify(rest, _texts(keyed, nodes, _ends(rest).distinct()), k, percent), "shingle-links")
    whole = durable(connected_components(links.unionByName(more)), "shingle-components")
    forget(placed, nodes, first, rest, links, more)
    return facts.select("doc_id", "text_key", "n", "node"), whole


def place_rows(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, n, label`` of each row: hash of its text, size of its set, and a number of its component."""
    rows, whole = linked_sets(docs, k, percent, id_col, text_col)
    return rows.join(whole, "node", "left").select("doc_id", "text_key", "n", F.coalesce("component", "node").alias("label"))


def jaccard_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of the graph that links texts with 100 * shared >= percent * united shingles.

    Words are runs of non-blank characters with A-Z as a-z; a text's set holds its distinct
    k-word shingles, or all its words as one if they are fewer; null, empty and blank texts
    have no set and no links.  A very long text is one set like any other: a task holds the
    shingles of one text at a time, and of two when it compares.  Returns ``doc_id,
    n_shingles`` (set size), ``component_id`` (smallest id reachable by links, its own
    included) and ``n_links`` (other rows that it is linked with), one row for each input row.
    Equal sets are one node, so copies, repeated rows and rows without an id are in one
    component with each other, and each counts as a link; a component without any id has a
    null one.  Further columns of any name are ignored; an empty table gives no rows.
    """
    rows, whole = linked_sets(docs, k, percent, id_col, text_col)
    sets = rows.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("row"), F.max("n").alias("n"), F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    sets = durable(sets.join(whole, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"), "shingle-placed")
    sizes = sets.groupBy("label").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"), F.min("least").alias("component_id"))
    sizes = durable(sizes, "shingle-sizes")
    counted = _count_links(sets, sizes, _keyed(docs, id_col, text_col), k, percent)
    told = sets.join(sizes.select("label", "component_id"), "label").join(counted, "node", "left")
    told = durable(told.select("node", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "shingle-told")
    forget(sets, sizes, counted, whole)
    out = rows.join(told, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row of the smallest id stays.

    Rows with an id come before rows without, and of one id's texts the one of the smallest
    hash comes first; so decisions are made by row, and a repeated id loses only the texts
    that are near copies of what stays.  A row that is repeated as a whole stays once.  Rows
    without a word have no copies and all stay.  Columns are those of ``docs``.
    """
    placed = place_rows(docs, k, percent, id_col, text_col).where("n > 0")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("text_key").alias("key"))
    kept = placed.groupBy("label").agg(F.min(order).alias("r")).select(F.col("r.id").alias("_id"), F.col("r.key").alias("_key"))
    text = F.col(text_col).cast("string")
    blank = F.coalesce(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), F.lit("")) == ""
    rows = docs.where(~blank).withColumns({"_id": F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), "_key": F.xxhash64(text)})
    row = F.struct(*docs.columns)
    once = rows.join(kept, ["_id", "_key"]).groupBy("_id", "_key").agg(F.max_by(row, F.xxhash64(*docs.columns)).alias("row"))
    return once.select("row.*").unionByName(docs.where(blank))


def _packed(counts: np.ndarray) -> bytes:
    """A piece of the table, in as few bytes as its numbers allow."""
    size = 1 if counts.max() < 256 else 4
    return bytes([size]) + pa.compress(counts.astype(np.uint8 if size == 1 else np.int32).tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    size = raw[0]
    return np.frombuffer(pa.decompress(raw[1:], PIECE * size, codec="zstd", asbytes=True), dtype=np.uint8 if size == 1 else np.int32)


def _total_counts(pieces: DataFrame) -> np.ndarray:
    """Add up the tasks' tables piece by piece, in passing; the result is one table of fixed size (capped at 2**31)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, total = None, np.zeros(PIECE, dtype=np.int64)
        give = lambda: pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([_packed(np.minimum(total, 2**31 - 1))])], ["piece", "counts"])
        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if number != piece:
                    if piece is not None:
                        yield give()
                    piece, total = number, np.zeros(PIECE, dtype=np.int64)
                total += _unpacked(raw.as_py())
        if piece is not None:
            yield give()

    out = np.zeros(1 << COUNT_BITS, dtype=np.int32)
    summed = pieces.repartition("piece").sortWithinPartitions("piece").mapInArrow(add, "piece int, counts binary")
    for row in summed.toLocalIterator():
        out[row["piece"] * PIECE : (row["piece"] + 1) * PIECE] = _unpacked(bytes(row["counts"]))
    return out


def _described(ids, keys, sizes, text_keys, pieces, counts, drawn) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * SKETCH)
    columns = [c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip((ids, keys, sizes, text_keys, pieces, counts, *drawn), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "n", "text_key", "piece", "counts", *SKETCHES])


def _signed(out: list[tuple]) -> pa.RecordBatch:
    sizes = [len(o[0]) for o in out]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([o[0] for o in out]).view(np.int64)),
            pa.array(np.repeat(np.array([o[3] for o in out], dtype=np.int64), sizes)),
            pa.array(np.repeat(np.array([o[4] for o in out], dtype=np.int32), sizes)),
            pa.array(np.concatenate([o[1] for o in out]).astype(np.int32)),
            pa.array(np.concatenate([o[2] for o in out])),
        ],
        ["sig", "node", "n", "p", "paired"],
    )
