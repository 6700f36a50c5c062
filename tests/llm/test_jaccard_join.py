"""Operator 6 against brute force over all pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from frayline.llm import components, jaccard_join, queries

from .conftest import DOCS


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if k else frozenset()


def brute_force(rows):
    """(id, set size, component, links) of each row, comparing all pairs of distinct sets that share a shingle."""
    sets = defaultdict(list)
    for i, text in rows:
        sets[shingle_set(text)].append(i)
    keys = [s for s in sets if s]
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    where = defaultdict(list)
    links = [len(sets[s]) - 1 for s in keys]
    for x, s in enumerate(keys):
        for token in s:
            where[token].append(x)
    for x, s in enumerate(keys):
        for y, shared in Counter(y for token in s for y in where[token] if y < x).items():
            if 100 * shared >= 80 * (len(s) + len(keys[y]) - shared):
                root[find(x)] = find(y)
                links[x] += len(sets[keys[y]])
                links[y] += len(sets[s])
    least = {}
    for x, s in enumerate(keys):
        ids = [i for i in sets[s] if i is not None]
        r = find(x)
        least[r] = min([*ids, *([least[r]] if least.get(r) is not None else [])], default=least.get(r))
    number = {s: x for x, s in enumerate(keys)}
    return Counter((i, len(s), least[find(number[s])] if s else i, links[number[s]] if s else 0) for i, s in ((i, shingle_set(t)) for i, t in rows))


def near_copies(seed, n_groups, size, length, edits):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    common = [word() for _ in range(60)]
    rows = []
    for _ in range(n_groups):
        base = [word() for _ in range(length)] + (common if rng.random() < 0.5 else [])
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own[: len(own) - rng.randint(0, 5)])))
    return rows


@pytest.mark.parametrize(("n_groups", "size", "length", "edits"), [(3, 150, 150, 9), (60, 5, 40, 3), (150, 2, 8, 1), (1, 120, 700, 40)])
def test_components_equal_brute_force(spark, n_groups, size, length, edits):
    rows = near_copies(n_groups, n_groups, size, length, edits) + [(100_000 + i, t) for i, t in DOCS if i is not None] + [(None, "only a null id has this text")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter(map(tuple, got)) == brute_force(rows)


def test_links_of_a_component_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 20)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 4000)
    rows = near_copies(8, 2, 130, 90, 6)
    rows += [(1000 + i, t) for i, t in rows[::7]] + [(None, rows[3][1])]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(map(tuple, got)) == brute_force(rows)


def test_counted_links_equal_pairs(monkeypatch):
    monkeypatch.setattr(jaccard_join, "STRIP", 7)
    monkeypatch.setattr(jaccard_join, "COLUMNS", 11)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: 60 - rng.integers(0, 12)], rng.integers(0, 2**63, rng.integers(0, 9)).astype(np.uint64)])) for _ in range(50)]
    copies = rng.integers(1, 5, 50)
    near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
    one, two = sets[:30], sets[30:]
    out, back = jaccard_join.count_links(one, two, (copies[:30], copies[30:]))
    assert out.tolist() == [sum(int(c) for b, c in zip(two, copies[30:], strict=True) if near(a, b)) for a in one]
    assert back.tolist() == [sum(int(c) for a, c in zip(one, copies[:30], strict=True) if near(a, b)) for b in two]
    own, none = jaccard_join.count_links(sets, None, (copies, None))
    assert none is None and own.tolist() == [sum(int(copies[j]) for j in range(50) if j != i and near(sets[i], sets[j])) for i in range(50)]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert Counter(map(tuple, queries.op6_jaccard_join(spark, sf).collect())) == brute_force(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    got = jaccard_join.jaccard_components(odd_docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert Counter(map(tuple, got.collect())) == brute_force(DOCS)
    assert jaccard_join.jaccard_components(no_docs).count() == 0


def test_similar_sets_share_a_signature_with_room():
    rng = np.random.default_rng(3)
    counts = np.ones(1 << jaccard_join.COUNT_BITS, dtype=np.int64)
    counts[::3] = 1000
    for _ in range(1500):
        n = int(rng.integers(2, 200))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        if rng.random() < 0.5:
            a = a[(a >> np.uint64(64 - jaccard_join.COUNT_BITS)) % 3 == 0] if rng.random() < 0.5 else a
        cut, more = rng.integers(0, 1 + len(a) // 5, 2)
        b = np.unique(np.concatenate([rng.permutation(a)[cut:], rng.integers(0, 2**63, more).astype(np.uint64) * np.uint64(2)]))
        shared = len(np.intersect1d(a, b))
        if not shared or 100 * shared < 80 * (len(a) + len(b) - shared) or np.array_equal(a, b):
            continue
        (sa, pa, _), (sb, pb, _) = (jaccard_join.signatures(x, counts, 500) for x in (a, b))
        place = dict(zip(sb.tolist(), pb.tolist(), strict=True))
        assert any(s in place and 180 * min(len(a) - p, len(b) - place[s]) >= 80 * (len(a) + len(b)) for s, p in zip(sa.tolist(), pa.tolist(), strict=True))


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (-5, -6)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[1000 + i] == 1000 for i in range(50)) and got[-5] == got[-6] == -6
