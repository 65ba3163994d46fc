"""Shingle-set components against comparing all pairs."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabkit.llm import components as module
from tabkit.llm import jaccard_join
from tabkit.llm.components import components
from tabkit.llm.prefixes import prefix_candidates
from tabkit.sources.workspace import Scratch


def shingle_set(text):
    lower = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[i:i + 5]) for i in range(len(found) - 4)}


def plain(rows):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[find(i)] = min(name, least.get(find(i), name))
    return sorted((repr(name), len(s), repr(least.get(find(i)))) for i, ((name, _), s) in enumerate(zip(rows, sets)))


def edited(words, rate):
    return " ".join("w" + str(random.random()) if random.random() < rate else w for w in words)


def corpus(seed=1):
    random.seed(seed)
    fresh = lambda n: [f"t{random.randrange(10**6)}" for _ in range(n)]
    texts = [None, "", " \n\t", "one", "One", "a b c d", "A b\tc\nd", "a b c", "a b c d e", "a b c d e f", "a b c d e f g"]
    for n in (5, 8, 12, 20, 33, 60, 64, 70, 130, 400, 1500):
        base = fresh(n)
        texts += [" ".join(base), " ".join(base).upper(), " ".join(base + fresh(max(1, n // 9)))]
        texts += [edited(base, r) for r in (0.5 / n, 1 / n, 2 / n, 0.02, 0.03, 0.05)]
        cut = base[: int(n * 0.82)]
        texts += [" ".join(cut), edited(cut, 0.01)]
    passage = fresh(30)
    texts += [" ".join(fresh(12) + passage + fresh(25)) for _ in range(40)]        # share 26 of about 60 shingles
    base = fresh(90)
    texts += [edited(base, 0.012) for _ in range(60)]
    chain = fresh(100)
    texts += [" ".join(chain[3 * i:] + fresh(3 * i)) for i in range(12)]
    return [(i, t) for i, t in enumerate(texts)]


def got(docs, **options):
    rows = jaccard_join.jaccard_components(docs, **options).collect()
    return sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in rows)


@pytest.mark.parametrize("options", [{}, {"hot": 4, "dense": 1}, {"name_bits": 6}])
def test_against_all_pairs(spark, options):
    rows = corpus()
    rows += [(None, rows[30][1]), (None, rows[3][1]), (5, rows[40][1]), (7, rows[7][1]), (7, rows[7][1])]
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, c string, n int").repartition(5)
    assert got(docs, **options) == plain(rows)


def test_hot_groups_of_unlike_texts(spark):
    """Many texts around one passage, some of them linked."""
    random.seed(9)
    fresh = lambda n: [f"t{random.randrange(10**6)}" for _ in range(n)]
    passage = fresh(24)
    rows = [(i, " ".join(passage + fresh(10 if i % 3 else 2))) for i in range(80)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), hot=5, dense=3) == plain(rows)


def test_empty(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []


def test_every_pair_is_made_sure():
    """Whatever the sizes, one of two linked sets has more effort than differences, or both index each shingle."""
    rng = np.random.default_rng(4)
    for n in [*range(1, 80), 127, 128, 160, 161, 500]:
        a = rng.integers(1 << 62, size=n).astype(np.uint64)
        for lost, new in ((0, 0), (n // 9, 0), (0, n // 5), (n // 20, n // 20), (n // 18, n // 18)):
            b = np.concatenate([a[lost:], rng.integers(1 << 62, size=new).astype(np.uint64)])
            if not len(b) or 100 * (n - lost) < 80 * (n + new):
                continue
            owner = np.repeat([0, 1], [n, len(b)])
            doc, _, sig, _ = jaccard_join.postings(owner, np.concatenate([np.sort(a), np.sort(b)]), np.array([n, len(b)]))
            assert set(sig[doc == 0].tolist()) & set(sig[doc == 1].tolist())


def test_components(spark):
    random.seed(2)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, None), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    out = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r["node"], r["component"]) for r in out} == {(x, find(x)) for x in root} and len(out) == len(root)
    assert components(spark.createDataFrame([], "a long, b long")).filter(F.col("node") > 0).count() == 0


@pytest.mark.parametrize("together", [0, 20_000])
def test_stars_take_no_turn(spark, monkeypatch, together):
    """Edges that form stars are only read; a chain gets the same labels with and without a shuffle."""
    monkeypatch.setattr(module, "TOGETHER", together)
    kept = []
    real = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, heavy=False: kept.append(1) or real(self, df, heavy))
    out = components(spark.createDataFrame([(i, i % 3) for i in range(3, 60)], "a long, b long")).collect()
    assert {(r["node"], r["component"]) for r in out} == {(i, i % 3) for i in range(60)} and len(kept) == 2
    chain = components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")).collect()
    assert {(r["node"], r["component"]) for r in chain} == {(i, 0) for i in range(41)}


def test_rows_with_clashing_ids_stay(spark):
    """Rows are told apart by id and text; one of each component stays, and equal rows of it are one."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (7, c, "x"), (1, c, "x"), (None, b + " end", "x"), (8, None, "x"), (8, None, "x"), (9, "", "x"),
            (2, "just three words", "x"), (2, "just three words", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    got = [tuple(r) for r in jaccard_join.without_near_duplicates(docs).collect()]
    want = [(1, a, "x"), (None, b + " end", "x"), (1, c, "x"), (8, None, "x"), (8, None, "x"), (9, "", "x"), (2, "just three words", "x")]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert jaccard_join.without_near_duplicates(docs.limit(0)).count() == 0


def test_prefixes_of_long_sets(spark):
    """Elements of long sets are made distinct by hashing, not by comparing all with all; repeated rows change nothing."""
    sets = spark.range(2).selectExpr("id AS name", "explode(sequence(1L, 60000L)) AS s").selectExpr("name", "60000 AS n", "s")
    began = time.time()
    for some in (sets, sets.unionByName(sets)):
        pairs, _ = prefix_candidates(some, 80, Scratch(spark, "long"))
        assert [(r["a"], r["b"]) for r in pairs.collect()] == [(0, 1)]
    assert time.time() - began < 60


def test_only_promising_pairs_fetch_texts(spark, monkeypatch):
    """Texts whose every candidate differs in too many parities are never fetched."""
    random.seed(31)
    fresh = lambda n: [f"t{random.randrange(10**6)}" for _ in range(n)]
    passage, base = fresh(60), fresh(100)
    rows = [(i, " ".join(passage + fresh(60))) for i in range(12)] + [(20, " ".join(base)), (21, " ".join(base[:-2]))]
    held = []
    real = jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda some, texts: held.append(texts.count()) or real(some, texts))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)
    assert set(held) == {2}


def test_parities_tell_long_sets_apart(spark):
    """Linked sets pass whatever their sizes, long sets with little in common do not."""
    rng = np.random.default_rng(6)
    sets, linked, apart = [], [], []
    for n in (3, 250, 290, 1100, 5000, 9000):
        a, far = (np.sort(rng.integers(1 << 62, size=n).astype(np.uint64)) for _ in range(2))
        near = np.concatenate([a, rng.integers(1 << 62, size=n // 5).astype(np.uint64)])
        linked.append((len(sets), len(sets) + 1, 1))
        apart.append((len(sets), len(sets) + 2, 1))
        sets += [a, near, far]
    odd = jaccard_join.parities(np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets), len(sets)).to_pylist()
    marks = spark.createDataFrame([(i, len(x), o) for i, (x, o) in enumerate(zip(sets, odd))], "c long, n int, odd array<bigint>")
    pairs = spark.createDataFrame(linked + apart, "a long, b long, votes long")
    assert sorted((r["a"], r["b"], r["votes"]) for r in jaccard_join.promising(pairs, marks).collect()) == linked
