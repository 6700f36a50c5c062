"""Operators 3 and 5 against brute force."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from frayline.llm import decision_list, hilbert_shards, queries

from .conftest import DOCS


def test_curve_visits_all_cells_in_unit_steps(spark):
    for n, bits in ((2, 3), (3, 2)):
        rows = [tuple(p) for p in product(range(1 << bits), repeat=n)]
        names = [f"d{k}" for k in range(n)]
        got = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in names)).withColumn("h", hilbert_shards.hilbert_index([F.col(c) for c in names], bits))
        path = [tuple(r[:n]) for r in got.orderBy("h").collect()]
        assert sorted(r.h for r in got.collect()) == list(range(len(rows)))
        assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(path, path[1:], strict=False))


def check_shards(rows, want, n):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(by[k]) for k in range(n)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1 and set(by) <= set(range(n))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards(spark, sf, odd_docs, no_docs):
    texts = spark.read.parquet(f"{sf}/documents.parquet").collect()
    facts = lambda pairs: Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in pairs)
    rows = queries.op3_hilbert_shards(spark, sf).collect()
    check_shards(rows, facts((r.doc_id, r.text) for r in texts), 40)
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.cell for r in order] == sorted(r.cell for r in rows)
    assert len({r.cell for r in rows}) > 20
    for n in (1, 3, 40):
        check_shards(hilbert_shards.shard_documents(odd_docs, n).collect(), facts(DOCS), n)
    assert hilbert_shards.shard_documents(odd_docs.select("doc_id", "text"), 4).count() == len(DOCS)
    assert hilbert_shards.shard_documents(no_docs, 4).count() == 0


def test_equal_texts_lie_together(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    moved = docs.limit(60).withColumns({"doc_id": F.col("doc_id") + 10**6, "source": F.lit("elsewhere"), "lang": F.lit(None).cast("string")})
    rows = sorted(hilbert_shards.shard_documents(docs.unionByName(moved), 40).collect(), key=lambda r: (r.shard, r.slot))
    text = {r.doc_id: r.text for r in docs.unionByName(moved).collect()}
    places = defaultdict(list)
    for k, r in enumerate(rows):
        places[text[r.doc_id]].append(k)
    assert all(v == list(range(v[0], v[0] + len(v))) for v in places.values())
    assert sum(len({rows[k].shard for k in v}) > 1 for v in places.values()) <= 39


def test_text_dimensions_are_ranked_by_whole_values(spark):
    rows = [(i, f"t{i}", f"https://example.org/common/prefix/{i % 16:02d}") for i in range(640)]
    got = hilbert_shards.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), 16, ("source",)).collect()
    assert all(len({r.doc_id % 16 for r in got if r.shard == k}) == 1 for k in range(16))


def test_written_shards_can_be_skipped(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, f"text {i}", "abcd"[rng.integers(4)], f"src{rng.integers(20)}", int(rng.integers(10_000))) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    hilbert_shards.write_shards(docs, f"{tmp_path}/s", 40)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert Counter(back.select(docs.columns).collect()) == Counter(docs.collect())
    for column, value in (("lang", "b"), ("source", "src7"), ("n_chars", 5000)):
        ranges = back.groupBy("shard").agg(F.min(column).alias("a"), F.max(column).alias("b")).collect()
        assert sum(r.a <= value <= r.b for r in ranges) <= 24, column  # of 40; files in the order of ids would all have to be read


def statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeats = len(covered)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeats, len(words) < 50 or 100 * repeats > 50 * len(words)


def test_statistics_and_verdicts(spark, sf, odd_docs, no_docs):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").unionByName(odd_docs.select("doc_id", "text", "lang"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = decision_list.apply_quality_rules(texts, labels).collect()
    want = Counter((r.doc_id, *statistics(r.text)) for r in texts.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(r.kept == (not r.base_failed and r.rule is None) for r in got)
    none = decision_list.apply_quality_rules(odd_docs, labels.limit(0)).collect()
    assert all(r.rule is None for r in none) and len(none) == len(DOCS)
    assert decision_list.apply_quality_rules(no_docs, labels).count() == 0


def test_rules_hold_on_other_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op5_decision_list(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(labels[i], r.kept) for i, r in rows.items() if i in labels and not r.base_failed]
    assert np.mean([k for q, k in judged if q == 1]) > 0.97
    assert np.mean([not k for q, k in judged if q == 0]) > 0.6


def test_covering_recovers_planted_rules():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(4000), "b": rng.random(4000), "c": rng.random(4000)}
    bad = ((x["a"] > 0.7) & (x["b"] < 0.4)) | (x["c"] > 0.9)
    rules = decision_list.learn_rules(x, bad, rng.random(4000) < 0.67)
    hit = np.logical_or.reduce([np.logical_and.reduce([c.holds(x) for c in r]) for r in rules])
    assert (hit == bad).mean() > 0.97


def test_emitted_expression_equals_the_rules(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rules = decision_list.fit_decision_list(docs, labels)
    assert rules
    rows = decision_list.apply_quality_rules(docs, labels).collect()
    for r in rows:
        w, c, n = max(1, r.n_words), max(1, r.word_chars), max(1, r.n_lines)
        x = {
            "words": r.n_words, "word_length": r.word_chars / w, "symbols": r.n_symbols / c, "capitals": r.n_capitals / c, "marks": r.n_marks / w,
            "line_length": r.n_words / n, "dup_lines": r.n_dup_lines / n, "repeats": r.n_repeat_words / w,
        }
        first = next((k for k, rule in enumerate(rules, 1) if all((x[q.feature] >= q.threshold) == q.above for q in rule)), None)
        assert r.rule == first and r.kept == (first is None and not r.base_failed)


def test_long_texts_are_counted_exactly(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 3000, 120_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (1, "a b c " * 40), (None, "x y z " * 30)], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_repeat_words) for r in decision_list.base_statistics(docs).collect())
    assert got == Counter((i, s[0], s[4]) for i, s in ((r.doc_id, statistics(r.text)) for r in docs.collect()))


def test_a_repeated_id_is_learnt_from_once(spark):
    docs = spark.createDataFrame([(1, f"{'word ' * 20}{' '.join(f'v{i}x{k}' for k in range(60))}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert decision_list.fit_decision_list(docs, labels) == []
    assert decision_list.keep_by_rules(docs, labels).count() == 50
