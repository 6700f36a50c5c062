"""The corpus pipeline against a brute-force version, and every stage on awkward rows."""

import hashlib
import struct
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from frayline.llm import bpe_prefix, decision_list, language_id, queries

from .conftest import DOCS
from .test_jaccard_join import brute_force, shingle_set
from .test_text_operators import similarity, weighted, words


@pytest.fixture(scope="module")
def encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = bpe_prefix.parse_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def contaminated(text, items):
    ws = words(text)
    for item in items:
        iw = words(item)
        near = {i for i in range(len(ws) - 4) if tuple(ws[i : i + 5]) in set(weighted(iw))}
        for s in {s for i in near for s in range(i - len(iw), i + 1) if 0 <= s < len(ws)}:
            if similarity(weighted(iw), weighted(ws[s : s + len(iw)])) >= 0.8:
                return True
    return False


def test_pipeline_equals_brute_force(spark, sf, encoding):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit_language_model(docs, queries.id_remainder(4) != 2)
    spoken = {r.doc_id for r in language_id.identify_languages(docs, model).collect() if r.lang_pred != "und"}
    left = docs.where(F.col("doc_id").isin(spoken))
    rules = decision_list.apply_quality_rules(left, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    kept = {r.doc_id for r in rules if r.kept}
    rows = [(r.doc_id, r.text) for r in left.collect() if r.doc_id in kept]
    first = [i for i, _, c, _ in brute_force(rows) if i == c]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = dict(rows)
    want = set()
    for i in first:
        if not contaminated(texts[i], items):
            ids = encoding.encode_ordinary(texts[i])
            want.add((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest()))
    got = [tuple(r) for r in cp.run(spark, sf).collect()]
    assert len(got) == len(set(got)) > 20 and set(got) == want


SENTENCE = " ".join(f"plain{i} word{i} stands{i} here" for i in range(30))


def odd(spark, docs):
    """Awkward rows with the columns of documents and one more; an id with two texts, repeated rows, rows without an id."""
    rows = [(i, t, "en", "s", 1, "mine") for i, t in DOCS]
    rows += [(50, SENTENCE, "en", "s", 1, "a"), (50, "other " + SENTENCE.replace("word", "term").replace("stands", "lies"), "en", "s", 1, "a"), (51, SENTENCE, None, "s", None, "a"), (None, SENTENCE, "en", None, 1, "a")]
    rows += [(60, "twice " + SENTENCE.replace("plain", "same").replace("word", "thing"), "en", "s", 1, "a")] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")


def test_stages_on_odd_rows(spark, sf):
    docs = odd(spark, None)
    count = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    everything = count(docs)
    spoken = cp.language_stage(spark, docs, sf)
    assert spoken.columns == docs.columns
    assert count(spoken) == Counter({k: n for k, n in everything.items() if k[1] and any(c.isalpha() for c in k[1])})
    ruled = cp.rules_stage(spark, docs, sf)
    assert ruled.columns == docs.columns
    long_enough = {k for k in everything if k[1] and len(k[1].split()) >= 50}
    assert count(ruled).keys() <= long_enough and (50, SENTENCE) in count(ruled) and (None, SENTENCE) in count(ruled)
    single = cp.near_duplicate_stage(spark, docs, sf)
    assert single.columns == docs.columns
    groups = defaultdict(list)
    for i, t in everything:
        groups[shingle_set(t) or (i, t)].append((i is None, i or -1, t))
    left = count(single)
    assert all(n == 1 for k, n in left.items() if shingle_set(k[1]))
    assert (50, SENTENCE) in left and (51, SENTENCE) not in left and (None, SENTENCE) not in left and left[60, "twice " + SENTENCE.replace("plain", "same").replace("word", "thing")] == 1
    assert sum(k[0] == 50 for k in left) == 2 and {k for k in everything if not shingle_set(k[1])} <= left.keys()
    assert len(left) == len({(frozenset(s) if isinstance(s, frozenset) else s) for s in groups})
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    dirty = docs.unionByName(docs.where("doc_id = 50").withColumns({"text": F.lit(f"see {item} there"), "doc_id": F.lit(None).cast("long")}))
    clean = cp.contamination_stage(spark, dirty, sf)
    assert clean.columns == docs.columns and count(clean) == everything
    tokens = cp.token_stage(spark, docs, sf)
    assert tokens.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and tokens.count() == docs.count()
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
