"""Operators 11 to 13 against brute force: one token, one word, one row at a time."""

import hashlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from frayline.llm import filter_audit, queries, syncmers, token_alignment

FILES = (P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN)


def align_one_by_one(docs):
    """Results of operator 11 by id, with the other library's encoder for A."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a_model.encode_special_tokens = True
    byte = token_alignment._byte_of_character()
    counts, rows = Counter(), []
    for i, text in docs:
        found = None
        if text:
            a = [(n, bytes(byte[c] for c in a_model.id_to_token(n))) for n in a_model.encode(" " + text, add_special_tokens=False).ids]
            b = [(n, bytes([int(p[3:5], 16)]) if p[:3] == "<0x" else p.replace("▁", " ").encode()) for n in b_model.encode(text) for p in [b_model.id_to_piece(n)]]
            if b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                at = lambda side: [(n, sum(len(x) for _, x in side[:k]), sum(len(x) for _, x in side[: k + 1])) for k, (n, _) in enumerate(side)] if len(side) < 2000 else _places(side)
                pa, pb = at(a), at(b)
                links, j = [], 0
                for n, start, end in pa:
                    while pb[j][2] <= start:
                        j += 1
                    k = j
                    while k < len(pb) and pb[k][1] < end:
                        links.append((n, pb[k][0]))
                        k += 1
                common = sorted({e for *_, e in pa} & {e for *_, e in pb})
                groups, ia, ib = [], iter(pa), iter(pb)
                for stop in common:
                    sides = []
                    for it in (ia, ib):
                        own = []
                        for n, _, e in it:
                            own.append(str(n))
                            if e == stop:
                                break
                        sides.append(",".join(own))
                    groups.append("|".join(sides))
                counts.update(links)
                found = (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
        rows.append((i, found))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted((str(i), *((0,) * 6 + ("",) if f is None else (*f[:3], len(f[3]), sum(counts[x] == most[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), f[4]))) for i, f in rows)


def _places(side):
    out, at = [], 0
    for n, x in side:
        out.append((n, at, at + len(x)))
        at += len(x)
    return out


def rows_of(result):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((str(r["doc_id"]), *[r[c] for c in names]) for r in result.collect())


def test_alignment_equals_brute_force(spark, sf, odd_docs):
    extra = [(100, "<|endoftext|> is plain <s> text </s>"), (101, "▁ marks and \x00 nothing"), (102, " starts and ends blank "), (103, "ﬁ ligature Å é"), (104, "tab\there\nnew  line")]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    docs = docs.unionByName(spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text")).withColumn("a", F.lit("mine"))
    want = align_one_by_one([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert rows_of(token_alignment.align_tokenizers(docs, *FILES)) == want


def test_alignment_in_many_segments_and_passes(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    want = rows_of(token_alignment.align_tokenizers(docs, *FILES))
    monkeypatch.setattr(token_alignment, "SEGMENT", 300)
    monkeypatch.setattr(token_alignment, "PASS_SEGMENTS", 2)
    monkeypatch.setattr(token_alignment, "FAN_IN", 2)
    assert rows_of(token_alignment.align_tokenizers(docs.repartition(7), *FILES)) == want


def test_alignment_of_nothing(no_docs, spark):
    assert token_alignment.align_tokenizers(no_docs, *FILES).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert rows_of(token_alignment.align_tokenizers(blank, *FILES)) == [("1", 0, 0, 0, 0, 0, 0, ""), ("2", 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 70_000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 62, n))
    levels, numbers = token_alignment.build_hash(keys)
    assert sorted(numbers) == list(range(len(keys)))
    bits, sizes = token_alignment._packed(levels)
    again = token_alignment.Numbering(token_alignment._unpacked(bits, sizes))
    assert (again.of(keys[::-1]) == numbers[::-1]).all()


MASK = (1 << 64) - 1


def anchors_one_by_one(text, k=syncmers.K, s=syncmers.S):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]

    def folded(i, n):
        out = h[i]
        for j in range(1, n):
            out = (((out << 7) & MASK) ^ (out >> 57)) ^ h[i + j]
        return out

    upper = lambda x: xxhash.xxh64_intdigest(x.to_bytes(8, "little"), 42) & 0xFFFFFFFF
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    if not h:
        return []
    if len(h) < k:
        total = len(h)
        for x in h:
            total = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), xxhash.xxh64_intdigest(total.to_bytes(8, "little"), 42))
        return [(total_of(total), 0)]
    out = []
    for i in range(len(h) - k + 1):
        inner = [signed(folded(i + j, s)) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((upper(folded(i, k)), i))
    return out


def total_of(x):
    return xxhash.xxh64_intdigest(x.to_bytes(8, "little"), 42) & 0xFFFFFFFF


def fingerprints_one_by_one(docs):
    ordered = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()), reverse=True)
    like = lambda a, b: 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))
    out = []
    for n, (i, text) in enumerate(ordered):
        following = ordered[(n + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other, after = (anchors_one_by_one(t) for t in (text, edited, following))
        sets = [{h for h, _ in x} for x in (own, other, after)]
        digits = lambda x: "".join(f"{h:08x}" for h, _ in x)
        out.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest(), digits(own), digits(other), round(like(sets[0], sets[1]), 9), round(like(sets[0], sets[2]), 9), len(own), len(set(own) & set(other))))
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 5])
def test_fingerprints_equal_brute_force(spark, sf, odd_docs, partitions):
    docs = odd_docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text")).withColumn("range", F.lit(1))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = syncmers.fingerprint_documents(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    columns = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_anchors", "n_in_place"]
    got = sorted((str(r["doc_id"]), *[round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns]) for r in found)
    assert got == fingerprints_one_by_one([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_fingerprints_of_nothing_and_of_one(spark, no_docs):
    assert syncmers.fingerprint_documents(no_docs).count() == 0
    one = syncmers.fingerprint_documents(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"a b c d a b c d"[: 8] + b"a b c d"[:7]).hexdigest()


def test_anchors_do_not_depend_on_what_is_around(spark):
    rng = np.random.default_rng(1)
    word = lambda: f"w{rng.integers(0, 5000)}"
    shared = [word() for _ in range(200)]
    texts = [" ".join([word() for _ in range(n)] + shared + [word() for _ in range(30)]) for n in (10, 57)]
    pair = spark.createDataFrame([(1, *texts)], "k int, x string, y string").select("k", syncmers.anchors(F.col("x")).alias("x"), syncmers.anchors(F.col("y")).alias("y"))
    shifts = {r["shift"]: r["matches"] for r in syncmers.matched_places(pair, "x", "y", ["k"]).collect()}
    inside = sum(10 <= at <= 10 + 200 - syncmers.K for _, at in anchors_one_by_one(texts[0]))
    assert shifts[47] >= inside > 60 and max(shifts.values()) == shifts[47]


def audit_row_by_row(docs, labels):
    import re

    good, toxic, first = set(), set(), {}
    for i, q, t in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if t == 1 and i is not None else set()
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    rows = []
    for i, text, part in docs:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and first[text] < i}
        rows.append((part or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = Counter()
        found = []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                found.append([part, "".join(order), step, len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f])
        out += [(*r[:-1], shapley[r[-1]]) for r in found]
    return sorted(out)


def test_audit_equals_row_by_row(spark, sf, odd_docs):
    docs = odd_docs.select("doc_id", "text", "source", "labels").unionByName(spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "case when doc_id % 9 > 0 then source end as source", "'x' as labels"))
    docs = docs.unionByName(docs.where("doc_id < 20").withColumn("doc_id", F.lit(None).cast("long"))).withColumn("row", F.lit(1)).withColumn("good", F.lit(1))
    labels = spark.read.parquet(f"{sf}/labels.parquet").unionByName(spark.createDataFrame([(4, 1, None), (None, 1, 1), (5, None, 1), (5, 1, 0)], "doc_id long, quality int, toxic int"))
    found = filter_audit.audit_filters(docs, labels)
    want = audit_row_by_row([tuple(r) for r in docs.select("doc_id", "text", "source").collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in found.select(columns).collect()) == want


def test_audit_of_other_filters_and_of_nothing(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(no_docs, labels).count() == 0
    docs = spark.createDataFrame([(1, "x", "s"), (2, "y", "s"), (3, "xy", "s")], "doc_id long, text string, source string")
    found = filter_audit.audit_filters(docs, labels, {"X": F.col("text").contains("x"), "Y": F.col("text").contains("y")}, None)
    assert {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["shapley"]) for r in found.collect()} == {("XY", 1): (1, 2, 0, 3), ("XY", 2): (0, 1, 1, 3), ("YX", 1): (1, 2, 0, 3), ("YX", 2): (0, 1, 1, 3)}
    with pytest.raises(ValueError):
        filter_audit.audit_filters(docs, labels, {}, None)


def test_audit_query_equals_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()["op13_filter_audit"]).df()
    keys = ["part", "filter_order", "step"]
    found = queries.queries()["op13_filter_audit"](spark, sf).toPandas()[want.columns]
    assert found.sort_values(keys).reset_index(drop=True).equals(want.sort_values(keys).reset_index(drop=True))


def test_audit_sends_no_table_through_the_driver(spark, sf, monkeypatch):
    plans = []
    write = filter_audit.durable

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(filter_audit, "durable", seen)
    found = queries.queries()["op13_filter_audit"](spark, sf)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 14 and not any("Broadcast" in p for p in plans)
