"""Operator 4: counts, training and scores against plain loops, and what training learns."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from frayline.llm import pseudo_likelihood as pl
from frayline.llm import queries
from frayline.llm.textblocks import blocks

from .conftest import DOCS

WORDS = b" \t\n\x0b\x0c\r"


def split(text):
    out, word = [], b""
    for byte in (text or "").encode():
        if bytes([byte]) in [bytes([b]) for b in WORDS]:
            out, word = (out + [word], b"") if word else (out, b"")
        else:
            word += bytes([byte + 32 if 65 <= byte <= 90 else byte])
    return out + [word] if word else out


def keys_of(word):
    (block,) = blocks(pa.array([word.decode("utf-8", "surrogateescape")]))
    _, hashes, ending = pl.word_keys(block)
    return int(hashes[0]), int(ending[0])


def corpus(n, seed=1):
    """Two "languages" with words of their own; in each the words follow a cycle, with noise."""
    rng = random.Random(seed)
    tongues = [[f"{c}{i}{c}en" for i in range(40)] for c in "xq"]
    rows = []
    for i in range(n):
        own, at = tongues[i % 2], rng.randrange(40)
        words = [own[(at + k) % 40] if rng.random() < 0.8 else rng.choice(own) for k in range(rng.randrange(30, 80))]
        rows.append((i, " ".join([*words, f"rare{rng.randrange(10**6)}"])))
    return rows


def brute_force(rows, bucket_bytes, spark):
    """The whole query with dictionaries and one token at a time (steps of training by the gradients of each token)."""
    texts = [(i, split(t)) for i, t in rows if t]
    counts = Counter(w for _, ws in texts for w in ws)
    key = {w: keys_of(w) for w in counts}
    ranked = sorted(counts, key=lambda w: (-counts[w], key[w][0] - (1 << 64) if key[w][0] >> 63 else key[w][0]))[: pl.KNOWN]
    known, slots = [], set()
    for w in ranked:
        if (slot := key[w][0] >> (64 - pl.SLOT_BITS)) not in slots:
            slots.add(slot)
            known.append(w)
    number = {w: k for k, w in enumerate(known)}
    row_of = lambda w: number[w] if number.get(w, pl.EMBEDDED) < pl.EMBEDDED else pl.EMBEDDED + key[w][1]
    near = np.zeros((pl.OUTSIDE, pl.ANCHORS), dtype=np.int64)
    for _, ws in texts:
        for i, w in enumerate(ws):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(ws) and number.get(ws[j], pl.ANCHORS) < pl.ANCHORS:
                    near[row_of(w), number[ws[j]]] += 1
    vocabulary = pl.Vocabulary(
        np.array([key[w][0] for w in known], dtype=np.uint64), np.array([counts[w] for w in known]), np.array([key[w][1] for w in known]),
        np.array([sum(n for w, n in counts.items() if w not in number and key[w][1] == e) for e in range(pl.ENDINGS)], float),
        np.array([sum(w not in number and key[w][1] == e for w in counts) for e in range(pl.ENDINGS)], float),
    )
    units = pl.make_units(vocabulary, near)
    context = lambda ws, i: [row_of(ws[j]) if 0 <= j < len(ws) else pl.OUTSIDE for j in (i - 2, i - 1, i + 1, i + 2)]
    hashed = spark.createDataFrame([(i, t) for i, t in rows if t], "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text, doc_id) h").collect()
    n_buckets = sum(len(t.encode()) for _, t in rows if t) // bucket_bytes + 1
    buckets = {}
    for r in sorted(hashed, key=lambda r: (r.h, r.text)):
        buckets.setdefault(r.h % n_buckets, []).append(split(r.text))
    weights = pl.first_weights()
    for number_ in range(pl.ROUNDS):
        total, seen = 0.0, 0
        for bucket in buckets.values():
            own = {k: v.astype(float) for k, v in weights.items()}
            squares = {k: np.full(v.shape, pl.SQUARES) for k, v in weights.items()}
            examples = [(context(ws, i), int(units.kind[row_of(ws[i])])) for ws in bucket for i in range(number_, len(ws), pl.ROUNDS)]
            for at in range(0, len(examples), pl.BATCH * pl.SHUFFLED):
                stretch = examples[at : at + pl.BATCH * pl.SHUFFLED]
                n = math.ceil(len(stretch) / pl.BATCH)
                for k in range(n):
                    step = stretch[k::n]
                    slope = {name: np.zeros(v.shape) for name, v in own.items()}
                    for c, kind in step:
                        x = np.concatenate([own["e"][j] for j in c])
                        h = np.tanh(x @ own["w"] + own["b"])
                        p = np.exp(h @ own["v"] + own["c"])
                        dz = p / p.sum()
                        dz[kind] -= 1
                        dh = (own["v"] @ dz) * (1 - h * h)
                        slope["v"] += np.outer(h, dz)
                        slope["c"] += dz
                        slope["w"] += np.outer(x, dh)
                        slope["b"] += dh
                        for j, d in zip(c, (own["w"] @ dh).reshape(-1, pl.WIDTH), strict=True):
                            slope["e"][j] += d
                    for name, g in slope.items():
                        squares[name] += (g / len(step)) ** 2
                        own[name] -= pl.RATE * (g / len(step)) / np.sqrt(squares[name])
            total = total + (pl.flat(own) - pl.flat(weights)) * len(examples)
            seen += len(examples)
        weights = pl.shaped(pl.flat(weights) + total / max(seen, 1))
    out = {}
    of_class = Counter()
    for w in known:
        of_class[units.kind[row_of(w)]] += counts[w]
    for e in range(pl.ENDINGS):
        of_class[units.kind[pl.EMBEDDED + e]] += vocabulary.rest_mass[e] + 1
    for i, t in rows:
        ws, score = split(t), 0.0
        for at, w in enumerate(ws):
            x = np.concatenate([weights["e"][j] for j in context(ws, at)]).astype(float)
            z = np.tanh(x @ weights["w"] + weights["b"]) @ weights["v"] + weights["c"]
            kind = units.kind[row_of(w)]
            e = key[w][1]
            share = counts[w] if w in number else (vocabulary.rest_mass[e] + 1) / (vocabulary.rest_words[e] + 1)
            score += z[kind] - np.log(np.exp(z).sum()) + np.log(share / of_class[kind])
        out.setdefault(i, []).append((len(ws), score))
    return out


def test_query_equals_brute_force(spark):
    rows = corpus(120) + [(i, t) for i, t in DOCS if i not in (10, 11)]
    want = brute_force(rows, 25_000, spark)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    results = [sorted(pl.score_pseudo_likelihood(df.repartition(n), bucket_bytes=25_000).collect(), key=str) for n in (4, 13)]
    assert results[0] == results[1]
    for r in results[0]:
        assert any(n == r.n_tokens and abs(score - r.pseudo_log_likelihood) < 0.02 + 2e-4 * n for n, score in want[r.doc_id]), (r, want[r.doc_id])
    assert Counter(r.doc_id for r in results[0]) == Counter(i for i, _ in rows)


def test_probabilities_of_all_words_sum_to_one(spark):
    rows = corpus(40)
    vocabulary = pl.count_words(spark.createDataFrame(rows, "doc_id long, text string"), known=50)
    units = pl.make_units(vocabulary, np.ones((pl.OUTSIDE, pl.ANCHORS)))
    share = np.bincount(units.kind[vocabulary.types(np.arange(len(vocabulary.hashes)))], weights=np.exp(units.log_known), minlength=pl.CLASSES)
    share += np.bincount(units.kind[pl.EMBEDDED :], weights=np.exp(units.log_other) * (vocabulary.rest_words + 1), minlength=pl.CLASSES)
    assert np.allclose(share[share > 0], 1)
    assert vocabulary.counts.sum() + vocabulary.rest_mass.sum() == sum(len(t.split()) for _, t in rows)


def unigram(model, texts):
    """Mean log-probability of the words by the same counts, without context."""
    v = model.vocabulary
    known = v.types(np.arange(len(v.hashes)))
    mass = np.bincount(model.units.kind[known], weights=v.counts, minlength=pl.CLASSES) + np.bincount(model.units.kind[pl.EMBEDDED :], weights=v.rest_mass + 1, minlength=pl.CLASSES)
    total = n = 0
    for block in blocks(pa.array(texts)):
        _, hashes, ending = pl.word_keys(block)
        tokens = v.tokens(hashes, ending)
        total += (np.log(np.maximum(mass, 1e-9) / mass.sum())[model.units.kind[v.types(tokens)]] + model.units.log_share(tokens)).sum()
        n += len(tokens)
    return total / n


def gain(model, texts):
    scores = np.concatenate([model.tokens_scored(block)[1] for block in blocks(pa.array(texts))])
    return scores.mean() - unigram(model, texts)


def test_context_helps_on_texts_not_trained_on(spark):
    rows = corpus(2000)
    model = pl.fit_model(spark.createDataFrame(rows[:1800], "doc_id long, text string"), bucket_bytes=50_000)
    texts = [t for _, t in rows[1800:]]
    rng = random.Random(3)
    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts]
    assert gain(model, texts) > 1.0
    assert gain(model, texts) > gain(model, shuffled) + 0.3


def test_held_out_documents_gain_over_unigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    model = pl.fit_model(docs.where("doc_id % 10 <> 3"), bucket_bytes=1 << 20)
    assert gain(model, [r.text for r in docs.where("doc_id % 10 = 3").collect()]) > 0.4


def test_all_rows_scored_and_reproducible(spark, sf, odd_docs, no_docs):
    got = queries.op4_pseudo_likelihood(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert sorted(got) == sorted(queries.op4_pseudo_likelihood(spark, sf).collect())
    rows = pl.score_pseudo_likelihood(odd_docs).collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        assert (r.mean_log_probability is None) == (r.n_tokens == 0) and r.pseudo_log_likelihood <= 0
    assert len({r.pseudo_log_likelihood for r in rows if r.doc_id == 4}) == 1
    assert pl.score_pseudo_likelihood(no_docs).count() == 0
