"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often they meet in the corpus.

A byte-level BPE (A) and a piece model with byte fallback (B) both cover a blank and the text.
Two tokens are linked where their bytes overlap; every link is one stretch between two
neighbouring token ends of either side, so links are found by merging both lists of ends.

How often an id pair is linked is counted in dense vectors without keys.  The distinct pairs of
the corpus are dealt into segments of about ``SEGMENT`` by a hash; each segment gets a minimal
perfect hash, which numbers its pairs from 0 without gaps: levels of bits, on each of which a
pair that has its place to itself is set, the others going on to the next level; the number is
the rank of its bit.  Each task of the counting pass adds up one vector for every segment;
vectors are summed in a tree.  The second pass aligns every document again and looks its links
up by the same numbers; the stored pair at that number is compared with the pair looked for.

Tokens are computed once and kept in a table of two-byte ids.  A pass holds ``PASS_SEGMENTS``
segments, about two million pairs; more pairs take further passes, and nothing is left out.
The driver holds one pass of segments and one number for each id of B.

Texts that are null or empty, or whose joined tokens of either side are not the blank and the
text (unknown characters, changed by the model), have no tokens: zeros and an empty digest.
Repeated rows count as often as they are there; ids may be null; further columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable, forget
from .textblocks import mix

#: Pairs in a segment, and segments that a pass holds at once.
SEGMENT, PASS_SEGMENTS = 1 << 16, 32
#: Vectors that are added up in one step of the tree.
FAN_IN = 16
#: Bytes of text aligned at once (or the single longest text).
BLOCK = 1 << 20


class Vocabulary(NamedTuple):
    """The bytes of every id, one after another, where they start, and the id in decimal digits (five columns or more)."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    digits: np.ndarray
    widths: np.ndarray


def _vocabulary(tokens: list[bytes]) -> Vocabulary:
    sizes = np.array([len(t) for t in tokens], dtype=np.int64)
    numbers = [str(i).encode() for i in range(len(tokens))]
    wide = max(map(len, numbers)) + 1  # with a place for the mark behind
    digits = np.frombuffer(b"".join(n.ljust(wide) for n in numbers), dtype=np.uint8).reshape(-1, wide)
    return Vocabulary(np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes, digits, np.array([len(n) for n in numbers], dtype=np.int64))


def _byte_of_character() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@cache
def encoder_a(path: str, pattern: str):
    """Encoder and vocabulary of a byte-level BPE file whose ids are in the order of its merges; special tokens are left out."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    byte, special = _byte_of_character(), {t["content"] for t in model["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): n for token, n in model["model"]["vocab"].items() if token not in special}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, n in ranks.items():
        tokens[n] = token
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), _vocabulary(tokens)


@cache
def encoder_b(path: str):
    """Model and vocabulary of a piece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    raw = lambda i: bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    return model, _vocabulary([raw(i) for i in range(model.get_piece_size())])


def _bytes_of(ids: np.ndarray, of: Vocabulary) -> np.ndarray:
    sizes = of.sizes[ids]
    ends = np.cumsum(sizes)
    spot = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    return of.data[np.repeat(of.starts[ids], sizes) + spot]


def encode_documents(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, a, b``: the ids of every text, four bytes each or two where a vocabulary allows it; nothing for texts that are not covered."""

    def ids(text: str | None) -> tuple[bytes, bytes]:
        (a, va), (b, vb) = encoder_a(a_path, pattern), encoder_b(b_path)
        if not text:
            return b"", b""
        wanted = np.frombuffer((" " + text).encode(), dtype=np.uint8)
        one, two = a.encode_to_numpy(" " + text, disallowed_special=()), np.array(b.encode(text, num_threads=1), dtype=np.int64)
        if any(int(v.sizes[x].sum()) != len(wanted) or not np.array_equal(_bytes_of(x, v), wanted) for x, v in ((one, va), (two, vb))):
            return b"", b""
        return one.astype(_kind(va)).tobytes(), two.astype(_kind(vb)).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [ids(x.as_py()) for x in part.column(1)]
                columns = [part.column(0), *[pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)]]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "a", "b"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, a binary, b binary")


def _kind(of: Vocabulary) -> type:
    return np.uint16 if len(of.sizes) <= 1 << 16 else np.uint32


class Aligned(NamedTuple):
    """Ids of consecutive documents, where each document's tokens begin, and their links in order, as places of both lists."""

    a: np.ndarray
    b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    common: np.ndarray
    first_link: np.ndarray


def align(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, va: Vocabulary, vb: Vocabulary) -> Aligned:
    """Links of documents whose tokens cover the same bytes on both sides; ``first_a``, ``first_b`` have one entry more than there are documents.

    ``common`` marks the links behind which tokens of both sides end: the last ones of their groups.
    """
    end_a, end_b = np.cumsum(va.sizes[a]), np.cumsum(vb.sizes[b])
    mark = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, dtype=np.uint8)
    mark[end_a] = 1
    mark[end_b] |= 2
    ends = np.flatnonzero(mark)
    kind = mark[ends]
    ends_a, ends_b = (kind & 1).astype(np.int64), (kind >> 1).astype(np.int64)
    link_a, link_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    first_link = np.searchsorted(link_a, first_a)  # a document begins with a token of both sides
    return Aligned(a, b, first_a, first_b, link_a, link_b, kind == 3, first_link)


def _blocks(batch: pa.RecordBatch, va: Vocabulary, vb: Vocabulary) -> Iterator[tuple[int, Aligned]]:
    """The documents of a batch (columns ``a``, ``b``), some at a time, with the row of the first."""
    sides = []
    for name, of in (("a", va), ("b", vb)):
        column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
        width = np.dtype(_kind(of)).itemsize
        sides.append((data, offsets, width, _kind(of)))
    at, n = 0, batch.num_rows
    limit = BLOCK // 2  # bytes of ids
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(sides[0][1], sides[0][1][at] + limit, side="right")) - 1))
        (a, first_a), (b, first_b) = ((np.frombuffer(data[o[at] : o[to]].tobytes(), dtype=kind).astype(np.int64), (o[at : to + 1] - o[at]) // width) for data, o, width, kind in sides)
        yield at, align(a, b, first_a, first_b, va, vb)
        at = to


def _keys(of: Aligned) -> np.ndarray:
    return (of.a[of.link_a] << 32) | of.b[of.link_b]


def _groups_text(of: Aligned, va: Vocabulary, vb: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The groups as written (``a1,a2|b1;a3|b2``) of all documents in one run of bytes, a mark behind every id, and where each document begins."""
    stop = np.flatnonzero(of.common)
    ends_a, ends_b = of.link_a[stop], of.link_b[stop]  # last tokens of the groups
    group_a, group_b = np.searchsorted(ends_a, np.arange(len(of.a))), np.searchsorted(ends_b, np.arange(len(of.b)))
    before_b, before_a = np.concatenate([[0], ends_b + 1]), ends_a + 1
    place_a, place_b = np.arange(len(of.a)) + before_b[group_a], np.arange(len(of.b)) + before_a[group_b]
    n, wide = len(of.a) + len(of.b), max(va.digits.shape[1], vb.digits.shape[1])
    text, width = np.zeros((n, wide), dtype=np.uint8), np.zeros(n, dtype=np.int64)
    for ids, place, v in ((of.a, place_a, va), (of.b, place_b, vb)):
        text[place, : v.digits.shape[1]] = v.digits[ids]
        width[place] = v.widths[ids]
    text[np.arange(n), width] = ord(",")
    text[place_a[ends_a], width[place_a[ends_a]]] = ord("|")
    text[place_b[ends_b], width[place_b[ends_b]]] = ord(";")
    starts = np.concatenate([[0], np.cumsum(width + 1)])[of.first_a + of.first_b]
    return text[np.arange(wide) <= width[:, None]], starts


def _seeds(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF))


def _segment_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix(mix(keys.astype(np.uint64)) + np.uint64(0x632BE59BD9B4E019)) % np.uint64(n)).astype(np.int64)


def build_hash(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of bits that number distinct keys from 0 to n - 1 without gaps, and the numbers of the keys."""
    left, levels = keys.astype(np.uint64), []
    while len(left):
        spot = (_seeds(left, len(levels)) % np.uint64(2 * len(left))).astype(np.int64)
        alone = np.bincount(spot, minlength=2 * len(left)) == 1
        levels.append(alone)
        left = left[~alone[spot]]
    return levels, Numbering(levels).of(keys)


class Numbering:
    """Looks keys up in the levels of ``build_hash``; keys that were not built in get some number or -1."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        counts = np.concatenate([*levels, np.zeros(1, dtype=bool)]).astype(np.int32)
        self.rank = np.cumsum(counts, dtype=np.int32) - counts
        self.base = np.cumsum([0, *[len(x) for x in levels]])

    def of(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        rows, left = np.arange(len(keys)), keys.astype(np.uint64)
        for k, bits in enumerate(self.levels):
            spot = (_seeds(left, k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[spot]
            out[rows[hit]] = self.rank[self.base[k] + spot[hit]]
            rows, left = rows[~hit], left[~hit]
            if not len(rows):
                break
        return out


def _packed(levels: list[np.ndarray]) -> tuple[bytes, list[int]]:
    return b"".join(np.packbits(x).tobytes() for x in levels), [len(x) for x in levels]


def _unpacked(data: bytes, sizes: list[int]) -> list[np.ndarray]:
    out, at = [], 0
    for n in sizes:
        out.append(np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), count=n).astype(bool))
        at += (n + 7) // 8
    return out


def distinct_pairs(tokens: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """``key``: every linked id pair of the corpus once; a task drops its own repeats first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = encoder_a(a_path, pattern)[1], encoder_b(b_path)[1]
        held, parts = np.empty(0, np.int64), []
        for batch in batches:
            for _, found in _blocks(batch, va, vb):
                parts.append(np.unique(_keys(found)))
                if sum(map(len, parts)) > 1 << 20:
                    held, parts = np.unique(np.concatenate([held, *parts])), []
                    if len(held) > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(held)], ["key"])
                        held = held[:0]
        held = np.unique(np.concatenate([held, *parts]))
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held)], ["key"])

    return tokens.mapInArrow(run, "key long").distinct()


def hash_segments(pairs: DataFrame, n_segments: int) -> DataFrame:
    """``segment, n, bits, sizes, keys``: a minimal perfect hash for each segment, and its pairs in the order of their numbers."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_segment_of(batch.column(0).to_numpy(), n_segments).astype(np.int32)), batch.column(0)], ["segment", "key"])

    def build(table: pa.Table) -> pa.Table:
        keys = np.sort(table["key"].to_numpy())  # whatever order the rows came in
        levels, numbers = build_hash(keys)
        ordered = np.empty_like(keys)
        ordered[numbers] = keys
        bits, sizes = _packed(levels)
        return pa.table({"segment": table["segment"][:1], "n": pa.array([len(keys)], pa.int64()), "bits": pa.array([bits], pa.binary()), "sizes": pa.array([sizes], pa.list_(pa.int64())), "keys": pa.array([ordered.tobytes()], pa.binary())})

    return pairs.mapInArrow(deal, "segment int, key long").groupBy("segment").applyInArrow(build, "segment int, n long, bits binary, sizes array<long>, keys binary")


def count_links(tokens: DataFrame, numberings: dict[int, tuple[bytes, list[int], int]], n_segments: int, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """``segment, counts``: the links of every pair of the given segments, as a vector in the order of the numbers."""
    shared = tokens.sparkSession.sparkContext.broadcast(numberings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = encoder_a(a_path, pattern)[1], encoder_b(b_path)[1]
        known = {s: Numbering(_unpacked(bits, sizes)) for s, (bits, sizes, _) in shared.value.items()}
        vectors = {}
        for batch in batches:
            for _, found in _blocks(batch, va, vb):
                keys, times = np.unique(_keys(found), return_counts=True)
                segment = _segment_of(keys, n_segments)
                for s, numbering in known.items():
                    own = segment == s
                    if own.any():
                        vector = vectors.setdefault(s, np.zeros(shared.value[s][2], dtype=np.int64))
                        vector[numbering.of(keys[own])] += times[own]
        part = TaskContext.get().partitionId()
        for s, vector in vectors.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([part], pa.int32()), pa.array([vector.tobytes()], pa.binary())], ["segment", "part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), dtype=np.int64) for x in table["counts"])
        return pa.table({"segment": table["segment"][:1], "part": table["part"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    vectors, parts = tokens.mapInArrow(run, "segment int, part int, counts binary"), tokens.rdd.getNumPartitions()
    while True:
        vectors = vectors.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("segment", "part").applyInArrow(add, "segment int, part int, counts binary")
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            return vectors.drop("part")


def most_links(index: DataFrame, size: int) -> np.ndarray:
    """For each id of B the links of its most frequent pair (0: none); one number for each id of a vocabulary is all the driver gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b, counts = np.frombuffer(row["keys"], dtype=np.int64) & 0xFFFFFFFF, np.frombuffer(row["counts"], dtype=np.int64)
                best = np.zeros(size, dtype=np.int64)
                np.maximum.at(best, b, counts)
                ids = np.flatnonzero(best)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best[ids])], ["b", "most"])

    found = index.select("keys", "counts").mapInArrow(run, "b long, most long").groupBy("b").agg(F.max("most").alias("most")).toArrow()
    out = np.zeros(size, dtype=np.int64)
    out[found["b"].to_numpy()] = found["most"].to_numpy()
    return out


def _look_up(tokens: DataFrame, segments: list[dict], most: np.ndarray, n_segments: int, last: bool, id_col: str, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """Adds what the given segments say to ``n_best`` and ``count_sum``; the last pass gives the results of the documents instead of their ids."""
    shared = tokens.sparkSession.sparkContext.broadcast((segments, most))
    at = {c: i for i, c in enumerate(tokens.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = encoder_a(a_path, pattern)[1], encoder_b(b_path)[1]
        segments, most = shared.value
        known = {r["segment"]: (Numbering(_unpacked(r["bits"], r["sizes"])), np.frombuffer(r["keys"], dtype=np.int64), np.frombuffer(r["counts"], dtype=np.int64)) for r in segments}
        for batch in batches:
            for first, found in _blocks(batch, va, vb):
                rows = batch.slice(first, len(found.first_a) - 1)
                keys, which = np.unique(_keys(found), return_inverse=True)
                segment, count = _segment_of(keys, n_segments), np.zeros(len(keys), dtype=np.int64)
                for s, (numbering, stored, counts) in known.items():
                    own = np.flatnonzero(segment == s)
                    number = numbering.of(keys[own])
                    if not np.array_equal(stored[number], keys[own]):
                        raise RuntimeError("a pair is not in its segment")
                    count[own] = counts[number]
                best = (count > 0) & (count == most[keys & 0xFFFFFFFF])
                per_doc = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[found.first_link])  # noqa: E731, B023
                sums = [rows.column(at[c]).to_numpy() + per_doc(x[which]) for c, x in (("n_best", best.astype(np.int64)), ("count_sum", count))]
                if not last:
                    yield pa.RecordBatch.from_arrays([*[rows.column(at[c]) for c in (id_col, "a", "b")], *map(pa.array, sums)], [id_col, "a", "b", "n_best", "count_sum"])
                    continue
                text, starts = _groups_text(found, va, vb)
                digests = [hashlib.sha256(text[x : y - 1].tobytes()).hexdigest() if y > x else "" for x, y in zip(starts[:-1], starts[1:], strict=True)]
                numbers = [np.diff(found.first_a), np.diff(found.first_b), per_doc(found.common.astype(np.int64)), np.diff(found.first_link), *sums]
                yield pa.RecordBatch.from_arrays([rows.column(at[id_col]), *[pa.array(x.astype(np.int64)) for x in numbers], pa.array(digests, pa.string())], names)

    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    kind = f"`{id_col}` {dict(tokens.dtypes)[id_col]}"
    done = ", ".join([kind, *[f"{c} long" for c in names[1:-1]], "groups_sha256 string"])
    return tokens.mapInArrow(run, done if last else f"{kind}, a binary, b binary, n_best long, count_sum long")


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document.

    ``a_path``: a byte-level BPE as JSON, ``pattern`` what its texts are cut by; ``b_path``: a piece model.
    """
    files = (a_path, b_path, pattern)
    tokens = durable(encode_documents(docs, *files, id_col, text_col), "align-tokens")
    pairs = durable(distinct_pairs(tokens, *files), "align-pairs")
    n_segments = max(1, -(-pairs.count() // SEGMENT))
    hashes = durable(hash_segments(pairs, n_segments), "align-hashes")
    groups = [range(k, min(n_segments, k + PASS_SEGMENTS)) for k in range(0, n_segments, PASS_SEGMENTS)]
    counted = None
    for group in groups:
        rows = hashes.where(F.col("segment").between(group[0], group[-1])).select("segment", "bits", "sizes", "n").toArrow().to_pylist()
        counts = count_links(tokens, {r["segment"]: (r["bits"], r["sizes"], r["n"]) for r in rows}, n_segments, *files)
        counted = counts if counted is None else counted.unionByName(counts)
    index = durable(hashes.join(counted, "segment"), "align-index")
    most = most_links(index, len(encoder_b(b_path)[1].sizes))
    rows = tokens.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for k, group in enumerate(groups):
        segments = index.where(F.col("segment").between(group[0], group[-1])).toArrow().to_pylist()
        rows = _look_up(rows, segments, most, n_segments, k == len(groups) - 1, id_col, *files)
        if k < len(groups) - 1:
            rows = durable(rows, "align-sums")
    forget(pairs, hashes)
    return rows
