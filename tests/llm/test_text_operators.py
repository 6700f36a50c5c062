"""Operators 1, 2, 7, 8, 9 and 10 against brute force, round trips and held-out accuracy."""

import base64
import hashlib
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from pyspark.sql import functions as F

from frayline.llm import bpe_prefix, decontaminate, language_id, license_scan, quality_rda, queries, warc_chunks
from frayline.llm.textblocks import hash_word, mix

from .conftest import DOCS, crc

lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe_prefix.parse_ranks(f.read())


def test_bpe_equals_tiktoken_on_odd_texts(spark, odd_docs, no_docs, ranks):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = Counter((r.doc_id, bytes(r.ids), r.n_tokens, bytes(r.decoded)) for r in bpe_prefix.bpe_encode_decode(odd_docs, path, public_tokenizers.PATTERN, blank_starts=True).collect())
    want = Counter()
    for i, text in DOCS:
        ids = own.encode_ordinary(text or "")
        want[i, struct.pack(f"<{len(ids)}I", *ids), len(ids), (text or "").encode()] += 1
    assert got == want
    assert bpe_prefix.bpe_encode_decode(no_docs, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_query_equals_tiktoken(spark, sf, ranks):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op7_bpe_prefix(spark, sf).collect():
        ids = own.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_append_and_edit_reuse_the_prefix_table(ranks):
    encoder = bpe_prefix.PrefixEncoder(ranks)
    raw = b"internationalization" * 20
    last = encoder.extend(raw[:100], [])
    assert encoder.tokens(encoder.extend(raw, last)) == encoder.merge(raw)
    for start, stop, new in ((0, 0, b"pre"), (57, 61, b""), (200, 203, b"XYZW"), (len(raw), len(raw), b"end")):
        out, table = encoder.edit(raw, last, start, stop, new)
        assert encoder.tokens(table) == encoder.merge(out)
        assert encoder.decode(encoder.tokens(table)) == out


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", lower(text))


def weighted(ws):
    k = min(5, len(ws))
    return Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if k else Counter()


def similarity(a, b):
    keys = a.keys() | b.keys()
    size = lambda s: sum(len(w.encode()) for w in s)
    high = sum(size(s) * max(a[s], b[s]) for s in keys)
    return sum(size(s) * min(a[s], b[s]) for s in keys) / high if high else 0.0


def test_decontamination_finds_what_brute_force_finds(spark, sf):
    got = {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in queries.op2_decontamination(spark, sf).collect()}
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = {}
    for item in items:
        iw = words(item.text)
        known, first = weighted(iw), set(weighted(iw))
        for doc in docs:
            ws = words(doc.text)
            near = {i for i in range(len(ws) - 4) if tuple(ws[i : i + 5]) in first}
            spots = {s for i in near for s in range(i - len(iw), i + 1) if 0 <= s <= len(ws) - len(iw)}
            for s in sorted(spots):
                score = similarity(known, weighted(ws[s : s + len(iw)]))
                if score >= 0.8 and score > want.get((doc.doc_id, item.item_id), (0, 0))[1]:
                    want[doc.doc_id, item.item_id] = s, score
    exact = {k: v for k, v in want.items() if v[1] == 1.0}
    assert exact and all(got[k] == v for k, v in exact.items())
    assert got.keys() == want.keys()
    assert all(abs(got[k][1] - v[1]) < 1e-9 for k, v in want.items())


def test_hamming_blocks_lose_nothing_within_the_radius():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k, dtype=np.uint64)) if k else np.uint64(0) for k in range(8)])
    windows = (prints[:, None] ^ flips[None, :]).ravel()
    got = set(decontaminate.Index(10, prints, 5).candidates(windows))
    want = {(w, i, int(d)) for i in range(len(prints)) for w in range(len(windows)) if (d := np.bitwise_count(windows[w] ^ prints[i])) <= 5}
    assert got == want


def test_decontamination_finds_every_edited_passage(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").orderBy("item_id").limit(60).collect()]
    rows, want = [], {}
    for item_id, text in items:
        ws = words(text)
        edits = [["X1", *ws[1:]], ["X1", "X2", *ws[2:]], [*ws[:-1], "X1"], [*ws[: len(ws) // 2], "X1", *ws[len(ws) // 2 + 1 :]], [*ws[: len(ws) // 2], "X1", *ws[len(ws) // 2 :]]]
        for whole in ([f"before{item_id}", "it", *e, "and", "after", "it"] for e in edits):
            rows.append((len(rows), " ".join(whole)))
        rows.append((len(rows), " ".join(["before", *ws[:-1]])))
        for doc_id, doc in rows[-6:]:
            doc = words(doc)
            score, start = max((similarity(weighted(ws), weighted(doc[s : s + len(ws)])), -s) for s in range(len(doc)))
            if score >= 0.8:
                want[doc_id, item_id] = -start, min(len(ws), len(doc) + start), score
    found = decontaminate.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.similarity) for r in found.collect() if r.doc_id // 6 == [i for i, _ in items].index(r.item_id)}
    assert len({doc_id % 6 for doc_id, _ in want}) == 6
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}, f"{len(got)} of {len(want)}"
    assert all(abs(got[k][2] - v[2]) < 1e-9 for k, v in want.items())


def test_many_items_of_one_length_narrow_the_radius_and_lose_nothing_within_it():
    rng = np.random.default_rng(6)
    prints = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
    prints[:1000] = prints[0]  # one hot fingerprint
    index = decontaminate.Index(10, prints, 18)
    assert 5 <= index.radius < 18
    windows = prints[rng.integers(0, 3000, 60)].copy()
    for _ in range(index.radius):
        windows ^= np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)
    got = list(index.candidates(windows))
    want = {(w, i, int(d)) for w in range(60) for i, d in enumerate(np.bitwise_count(windows[w] ^ prints)) if d <= index.radius}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


def test_a_text_may_quote_a_whole_benchmark_of_similar_items():
    base = [f"word{i}" for i in range(40)]
    items = [" ".join([*base[:18], *(f"{c}{i}" for c in "abcd"), *base[22:]]) for i in range(150)]
    plain = [" ".join(f"p{i}x{j}" for j in range(40)) for i in range(400)]
    bench = decontaminate.Benchmark(list(enumerate(items + plain)))
    text = " then ".join(plain + items)
    got = {(item.key, start): score for _, item, start, _, _, score in bench.find(next(decontaminate.blocks(pa.array([text]))))}
    order = [*range(150, 550), *range(150)]
    assert got == {(key, 41 * place): 1.0 for place, key in enumerate(order)}


def test_contaminated_rows_go_in_one_pass_or_many(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {r.doc_id for r in decontaminate.find_contamination(docs, items).collect()}
    once, many = (sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, items, items_per_pass=n).collect()) for n in (10**6, 7))
    assert once == many == sorted(r.doc_id for r in docs.collect() if r.doc_id not in found) and found


def test_decontamination_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "a b c d e"), (1, "one"), (2, None), (3, ""), (None, "five words")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.find_contamination(odd_docs, items, items_per_pass=1).collect())
    assert got == Counter({(4, 1): 2, (6, 1): 1, (7, 1): 1, (None, None): 1})
    assert decontaminate.find_contamination(no_docs, items).count() == 0
    assert decontaminate.find_contamination(odd_docs, items.limit(0)).count() == 0


def test_licenses_against_brute_force(spark, sf, odd_docs, no_docs):
    union = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    got = Counter(tuple(r) for r in license_scan.scan_licenses(union).drop("blocks", "score").collect())
    scores = [r.score for r in license_scan.scan_licenses(union).collect()]
    assert all(0 <= s <= 1 for s in scores)
    token = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    want = Counter()
    for r in union.collect():
        ws, base, places = token(r.text), set(), []
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            for i in range(len(ws) - len(p) + 1):
                if ws[i : i + len(p)] == p:
                    base.add(label)
                    places.append(i)
        labels = set(base)
        for line in (r.text or "").split("\n"):
            own = set(token(line))
            for label, text in license_scan.TEMPLATES:
                t = set(token(text))
                if len(own & t) >= license_scan.THRESHOLD * len(t) - 1e-9:
                    labels.add(label)
        want[r.doc_id, len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels))] += 1
    assert got == want
    assert license_scan.scan_licenses(no_docs).count() == 0


def test_license_notices_get_just_their_own_label(spark):
    gpl3, apache = license_scan.TEMPLATES[4][1], license_scan.TEMPLATES[2][1]
    rows, want = [], []
    for label, text in license_scan.TEMPLATES:
        ws = text.split()
        wrapped = ["\n * ".join(" ".join(ws[i : i + n]) for i in range(0, len(ws), n)) for n in (3, 7)]
        for shape in (text, *wrapped, f"Some words before.\n{text}.\nThen version 2 and 3 of more.", " ".join([ws[0], "(as we say here, for all files)", *ws[1:]])):
            rows.append((len(rows), shape))
            want.append(label)
    mixed = {f"{gpl3}. {apache}": "apache-2,gpl-3", f"{gpl3}.\n{apache}": "apache-2,gpl-3", gpl3.replace("3", "2 or 3"): "gpl-2,gpl-3"}
    mixed |= {gpl3.replace("3", "1"): "", license_scan.TEMPLATES[8][1].replace("2.0", "1.0"): "", gpl3.replace("GNU", "Own"): "", gpl3[:40]: ""}
    for text, label in mixed.items():
        rows.append((len(rows), text))
        want.append(label)
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), notices=True).collect()}
    assert [(rows[i][1], got[i]) for i in got if got[i] != want[i]] == []
    assert len(got) == len(rows)


def test_license_query_names_one_license_a_notice(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.labels for r in queries.op9_license_scan(spark, sf).collect() if "Licensed under CC BY-NC 4.0" in texts[r.doc_id]}
    assert got and all("cc-by" not in x.split(",") for x in got.values())


def test_warc_round_trip(spark, sf, tmp_path):
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "u", ""), (None, "n\r\nX: y", "same"), (5, "big", "é" * 200_000), (6, "g", "g")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    chunks = warc_chunks.write_archives(pages, chunk_bytes=1000).cache()
    assert max(len(r.data) for r in chunks.collect()) < 1500
    got = warc_chunks.read_archives(chunks).collect()
    best = defaultdict(list)
    for i, _, html in rows:
        best[html or ""].append(-1 if i is None else i)
    want = Counter()
    for i, _, html in rows:
        raw, top = (html or "").encode(), max(best[html or ""])
        kind = "response" if i == top else "revisit"
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, top if kind == "revisit" else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(r.intact for r in got)
    archive = chunks.first().archive
    size = warc_chunks.export_archive(chunks, archive, str(tmp_path / "x.warc"))
    raw = (tmp_path / "x.warc").read_bytes()
    assert len(raw) == size and raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    small = warc_chunks.read_archives(warc_chunks.write_archives(pages, min_revisit_bytes=10)).where("record_type = 'revisit'")
    assert small.count() == 0
    assert warc_chunks.archive_and_read(pages.limit(0)).count() == 0
    broken = chunks.withColumn("data", __import__("pyspark.sql.functions", fromlist=["x"]).expr("case when chunk_no = 3 then cast(repeat('z', 1000) as binary) else data end"))
    assert warc_chunks.read_archives(broken).where("not intact").count() == 1


def test_languages_held_out(spark, sf, odd_docs, no_docs):
    langs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries.op10_language_id(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in langs if crc(i) % 4 == 2}
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.97
    model = language_id.fit_language_model(odd_docs, queries.id_remainder(4) != 2)
    for m in (model, None):
        rows = language_id.identify_languages(odd_docs, m).collect()
        assert len(rows) == len(DOCS) and all(0 <= r.score <= 1 for r in rows)
        assert all(r.lang_pred == "und" for r in rows if r.doc_id in (1, 2, 3, 12))
        assert m is None or all(r.lang_pred == "en" for r in rows if r.doc_id == 9)
    assert language_id.fit_language_model(no_docs, queries.id_remainder(4) != 2) is None
    assert language_id.identify_languages(no_docs, model).count() == 0


def test_quality_held_out(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op1_quality_rda(spark, sf).collect()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.93
    few = spark.createDataFrame([(4, 1), (4, 0), (6, 0), (8, 1), (9, None), (None, 1)], "doc_id long, quality int")
    learn = queries.id_remainder(5) >= 0
    for chosen, value in ((few, None), (few.where("quality = 1 and doc_id = 8"), 1.0), (few.limit(0), 0.5)):
        rows = quality_rda.score_quality(odd_docs, chosen, learn).collect()
        assert len(rows) == len(DOCS) and all(0 <= r.score <= 1 and (value is None or r.score == value) for r in rows)
    assert quality_rda.score_quality(no_docs, few, learn).count() == 0


def naive_statistics(text):
    """The transformed statistics of operator 1, a byte at a time."""
    raw = (text or "").encode()
    fold = lambda w: bytes(b + 32 if 65 <= b <= 90 else b for b in w)
    ws = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, size = len(ws), max(1, len(raw))
    among = lambda chars: sum(b in chars for b in raw)
    share = lambda a, b: (a / max(b, 1)) ** 0.5
    triples = [tuple(map(fold, ws[i : i + 3])) for i in range(n - 2)]
    lines = [x for k, x in enumerate(raw.split(b"\n")) if len(x) + (k < raw.count(b"\n")) > 1]
    return [
        np.log1p(n), np.log1p(sum(map(len, ws)) / max(n, 1)), share(among(b"#*$%&<>@^~=_+\\{}[]"), size), share(among(range(65, 91)), size), share(among(range(48, 58)), size),
        share(among(b"!?;:,.\"'()-/"), size), share(among(b"|"), size), share(among(b"\n"), max(n, 1)), np.log1p(n) - np.log1p(len(set(map(fold, ws)))),
        share(len(triples) - len(set(triples)), len(triples)), share(len(lines) - len(set(map(fold, lines))), len(lines)),
        share(sum(sum(65 <= b <= 90 for b in w) >= 2 for w in ws), n), share(sum(len(w) <= 3 for w in ws), n),
    ]


def test_quality_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    x = np.array([naive_statistics(t) for _, t in docs])
    learn = [k for k, (i, _) in enumerate(docs) if crc(i) % 5 and i in labels]
    y = np.array([labels[docs[k][0]] for k in learn])
    own = {v: x[learn][y == v] for v in (0, 1)}
    total, center = len(learn), x[learn].mean(axis=0)
    scatter = {v: np.cov(own[v].T, bias=True) for v in own}
    within = sum(len(own[v]) * scatter[v] for v in own) / total
    scale = np.sqrt(np.maximum(np.diag(np.cov(x[learn].T, bias=True)), 1e-6))
    log_density = []
    for v in (0, 1):
        cov = ((1 - quality_rda.POOLED) * scatter[v] + quality_rda.POOLED * within) / np.outer(scale, scale)
        cov = (1 - quality_rda.IDENTITY) * cov + (quality_rda.IDENTITY * np.trace(cov) / len(cov) + 1e-6) * np.eye(len(cov))
        z = (x - own[v].mean(axis=0)) / scale
        log_density.append(-0.5 * (z * np.linalg.solve(cov, z.T).T).sum(axis=1) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(len(own[v]) / total))
    want = 1 / (1 + np.exp(np.clip((log_density[0] - log_density[1]) / quality_rda.TEMPERATURE, -500, 500)))
    got = {r.doc_id: r.score for r in queries.op1_quality_rda(spark, sf).collect()}
    assert all(abs(got[i] - w) < 1e-4 for (i, _), w in zip(docs, want, strict=True))


def naive_features(text):
    raw = (text or "").lower().encode()
    folded = [b if 97 <= b <= 122 or b > 127 else 32 for b in raw]
    counts = np.zeros(language_id.N_FEATURES)
    for size in (2, 3):
        for i in range(len(raw) - size + 1):
            gram = int.from_bytes(bytes(folded[i : i + size]), "big")
            counts[((gram * 2654435761 + size * 40503) % 2**32) >> 20] += 1
    return np.sqrt(counts / max(1, counts.sum()))


def test_language_query_equals_brute_force(spark, sf):
    """The same machines fitted on naive features of the learning rows, and duels one pair at a time."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", F.xxhash64("text").alias("key")).collect()
    learn = sorted({(r.lang, r.key, r.text) for r in rows if crc(r.doc_id) % 4 != 2 and r.lang is not None and r.text is not None})
    model = language_id.LanguageModel(np.array([naive_features(t) for _, _, t in learn]).astype(np.float16), np.array([v for v, _, _ in learn], dtype=object))

    def winner(duels, x):
        wins, margins = Counter(dict.fromkeys(duels.classes, 0)), Counter()
        for k, (a, b) in enumerate(duels.pairs):
            m = float(x @ duels.w[:-1, k] + duels.w[-1, k])
            wins[duels.classes[a if m > 0 else b]] += 1
            margins[duels.classes[a]] += m
            margins[duels.classes[b]] -= m
        return max(duels.classes, key=lambda c: wins[c] + 0.5 * np.tanh(margins[c] / (1 + len(duels.pairs))))

    got = {r.doc_id: r.lang_pred for r in queries.op10_language_id(spark, sf).collect()}
    for r in rows:
        x = naive_features(r.text)
        want = winner(model.inside[winner(model.family, x)], x) if any(c.isalpha() for c in r.text or "") else "und"
        assert got[r.doc_id] == want


def test_languages_are_learnt_without_ids_and_from_repeated_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.lit(None).cast("long").alias("doc_id"), "text", "lang")
    docs = docs.unionByName(docs.limit(1).crossJoin(spark.range(3000)).drop("id"))
    model = language_id.fit_language_model(docs, F.lit(True), per_language=40)
    assert model is not None
    rows = language_id.identify_languages(docs, model).join(docs.select("lang"), F.lit(False), "left").select("lang_pred").collect()
    assert sum(r.lang_pred == "und" for r in rows) < 0.1 * len(rows)


def test_other_patterns_are_matched_whole(spark, ranks):
    encoder = bpe_prefix.PrefixEncoder(ranks)
    text, pattern = "ab cd  ef\n gh " * 3, r"\S+\s\S+|\s+|\S+"
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    ids = own.encode_ordinary(text)
    assert bpe_prefix.PieceTables(encoder, pattern).packed(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_spans_of_a_long_text_have_the_hashes_of_short_ones():
    from frayline.llm import textblocks

    text = " ".join(f"Word{i % 977}é" for i in range(260_000))
    (block,) = textblocks.blocks(pa.array([text]), 1 << 30)
    found = textblocks.words(block, textblocks.NOT_BLANK)
    assert len(block.data) > 2 * textblocks.BLOCK
    hashes = textblocks.hash_spans(block, found.starts, found.ends)
    assert all(hashes[i] == hash_word(f"Word{i % 977}é") for i in (0, 5, 123_456, 259_999))


def test_word_hashes_fold_ascii_only():
    assert hash_word("AbC") == hash_word("aBc") != hash_word("abd")
    assert hash_word("É") != hash_word("é")
    assert len(np.unique(mix(np.arange(100_000, dtype=np.uint64)))) == 100_000
