"""Byte-level BPE encoding and decoding by dynamic programming over byte prefixes.

For a fixed merge table the encoding of a byte string is unique, and cutting the last
token off gives the encoding of the shorter prefix.  So one token for each byte
prefix - the last one of that prefix's encoding - describes the encodings of all
prefixes: bytes can be appended, and an edit needs new entries only from its place on
until the old entries hold again.  A token can follow another exactly if the merge
rules leave the two apart, which is looked up once for each pair of tokens.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries kept in each of a task's tables of encoded pieces or spans, and of token pairs, before it starts anew.
PIECE_CACHE, PAIR_CACHE = 400_000, 1_000_000


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """The tiktoken rank file: base64 token and rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class PrefixEncoder:
    """Encodes pieces of text; keeps for each byte prefix the one token that can end it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.by_rank = {v: k for k, v in ranks.items()}
        self._found = ahocorasick.Automaton()  # all tokens that end at a byte, in one pass
        for raw, rank in ranks.items():
            self._found.add_word(raw.decode("latin-1"), (rank, len(raw)))
        self._found.make_automaton()
        self._pairs: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}

    def merge(self, raw: bytes) -> list[int]:
        """The definition: join the neighbours of lowest rank, leftmost first, until none can be joined."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _stands(self, token: int) -> bool:
        """Whether the merge rules ever make this token of its own bytes."""
        found = self._whole.get(token)
        if found is None:
            found = self._whole[token] = self.merge(self.by_rank[token]) == [token]
        return found

    def follows(self, left: int, right: int) -> bool:
        """Whether the merge rules keep these two tokens apart."""
        found = self._pairs.get((left, right))
        if found is None:
            if len(self._pairs) >= PAIR_CACHE:
                self._pairs.clear()
            found = self._pairs[left, right] = self.merge(self.by_rank[left] + self.by_rank[right]) == [left, right]
        return found

    def extend(self, raw: bytes, last: list[int]) -> list[int]:
        """Append to ``last`` (the last tokens of the prefixes already done) those of the longer prefixes of ``raw``."""
        pairs, done = self._pairs, len(last)
        begin = max(0, done + 1 - self.longest)
        for at, (token, size) in self._found.iter(raw[begin:].decode("latin-1")):
            end = begin + at + 1
            if end <= done:
                continue
            if end > done + 1:
                break
            start = end - size
            if start:
                before = last[start - 1]
                fits = pairs.get((before, token))
                if fits is None:
                    fits = self._stands(token) and self.follows(before, token)
            else:
                fits = self._stands(token)
            if fits:
                last.append(token)
                done += 1
        if done < len(raw):
            raise ValueError(f"no token ends at byte {done + 1}: the ranks lack single bytes")
        return last

    def tokens(self, last: list[int]) -> list[int]:
        """Read the encoding off the prefix table, from the end."""
        out, at = [], len(last)
        while at:
            token = last[at - 1]
            out.append(token)
            at -= len(self.by_rank[token])
        return out[::-1]

    def encode(self, raw: bytes) -> list[int]:
        """A piece that is itself a token stays whole; else the merge rules' encoding."""
        token = self.ranks.get(raw)
        return [token] if token is not None else self.tokens(self.extend(raw, []))

    def edit(self, raw: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """Replace raw[start:stop]: entries up to ``start`` stay, and the old tail's once a whole span of them agrees."""
        out = raw[:start] + new + raw[stop:]
        table, shift = last[:start], len(new) - (stop - start)
        after = start + len(new)
        while len(table) < len(out):
            self.extend(out[: len(table) + 1], table)
            at = len(table)
            # an entry depends on those of the last `longest` prefixes only
            if at >= after + self.longest and table[at - self.longest : at] == last[at - shift - self.longest : at - shift]:
                table += last[at - shift :]
                break
        return out, table

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.by_rank.__getitem__, ids))


class PieceTables:
    """An encoder with bounded tables of what it has encoded: pieces, and spans between blanks.

    ``blank_starts`` says that the pattern's matches have a blank only at their front or among
    other white space.  Then, where a blank follows a character that is not white space, a match
    starts, and the span up to the next such place can be matched, and its encoding kept, by
    itself.  For any other pattern texts are matched whole.
    """

    def __init__(self, encoder: PrefixEncoder, pattern: str, blank_starts: bool = False):
        self.encoder, self.blank_starts = encoder, blank_starts
        self._find = regex.compile(pattern).findall
        self._pieces: dict[str, bytes] = {}
        self._spans: dict[str, bytes] = {}

    def forget(self) -> None:
        """Empty the tables that grow with the texts; those of the ranks stay."""
        for table in (self._pieces, self._spans, self.encoder._pairs):
            table.clear()

    def _encode(self, span: str) -> bytes:
        out = []
        for piece in self._find(span):
            part = self._pieces.get(piece)
            if part is None:
                ids = self.encoder.encode(piece.encode())
                part = struct.pack(f"<{len(ids)}I", *ids)
                _keep(self._pieces, piece, part)
            out.append(part)
        return b"".join(out)

    def packed(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if not self.blank_starts:
            return self._encode(text)
        spans = text.split(" ")
        parts = list(map(self._spans.get, spans))
        parts[0] = None
        at = 0
        while True:
            try:
                at = parts.index(None, at)
            except ValueError:
                return b"".join(parts)
            span, stop = spans[at], at
            if at and span and not span[-1].isspace():
                parts[at] = self._encode(" " + span)
                _keep(self._spans, span, parts[at])
            else:
                while stop + 1 < len(spans) and (not spans[stop] or spans[stop][-1].isspace()):  # no match need start after it
                    stop += 1
                parts[at] = self._encode((" " if at else "") + " ".join(spans[at : stop + 1]))
                parts[at + 1 : stop + 1] = [b""] * (stop - at)
            at = stop + 1


def _keep(table: dict[str, bytes], key: str, value: bytes) -> None:
    if len(key) <= 64:
        if len(table) >= PIECE_CACHE:
            table.clear()
        table[key] = value


_tables: dict[tuple[str, str, bool], PieceTables] = {}


def _worker_pieces(raw: bytes, pattern: str, blank_starts: bool) -> PieceTables:
    """The tables of a worker process, one for each rank file and pattern; a task empties them at its end, as Spark keeps workers for the tasks of later stages."""
    key = hashlib.sha256(raw).hexdigest(), pattern, blank_starts
    if key not in _tables:
        _tables[key] = PieceTables(PrefixEncoder(parse_ranks(raw)), pattern, blank_starts)
    return _tables[key]


def bpe_encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", blank_starts: bool = False) -> DataFrame:
    """Encode every whole text and decode it again; one row for each input row.

    Returns the id, ``ids`` (token ids as little-endian unsigned 32-bit integers),
    ``n_tokens`` and ``decoded`` (the bytes the ids stand for).  ``blank_starts``: see
    ``PieceTables``; it makes no difference to the result of a pattern of which it is true.
    Null and empty texts have no tokens; a very long text is encoded whole, a piece at a time,
    and its ids and bytes leave the task before the next text is read; repeated rows, null ids and further columns of any name are allowed and give
    a row each; an empty table gives no rows.  The rank file (a bounded table of some
    50,000 tokens) is read on the driver and broadcast; the texts never leave their tasks.
    """
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _worker_pieces(ranks.value, pattern, blank_starts)
        table = pieces.encoder.by_rank
        try:
            for batch in batches:
                rows, held = [], 0
                for at, text in enumerate(batch.column(1)):
                    text = text.as_py()
                    packed = pieces.packed(text) if text else b""
                    decoded = b"".join(map(table.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))
                    rows.append((at, packed, decoded))
                    held += len(packed) + len(decoded)
                    if held > 8 << 20:
                        yield _encoded(batch, rows)
                        rows, held = [], 0
                if rows:
                    yield _encoded(batch, rows)
        finally:
            pieces.forget()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, ids binary, n_tokens long, decoded binary")


def _encoded(batch: pa.RecordBatch, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    ids = batch.column(0).slice(rows[0][0], len(rows))
    packed = [r[1] for r in rows]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
        ["doc_id", "ids", "n_tokens", "decoded"],
    )
