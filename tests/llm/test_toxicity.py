"""Nearest examples against all cosines, and held-out accuracy on small text."""

import random
import zlib

import numpy as np
import pytest

from tabkit.llm import toxicity


@pytest.mark.parametrize("seed", range(6))
def test_nearest_is_exact(seed):
    rng = np.random.default_rng(seed)
    examples, terms, documents, k = int(rng.integers(1, 400)), int(rng.integers(1, 60)), 40, int(rng.integers(1, 9))
    dense = rng.random((examples, terms)) * (rng.random((examples, terms)) < 0.2)
    dense[rng.integers(examples, size=examples // 3)] = dense[0]       # ties
    asked = rng.random((documents, terms)) * (rng.random((documents, terms)) < 0.3)
    asked[0] = 0
    norm = lambda m: m / np.where(np.linalg.norm(m, axis=1) > 0, np.linalg.norm(m, axis=1), 1)[:, None]
    dense, asked = norm(dense), norm(asked)
    e, t = np.nonzero(dense)
    index = toxicity.BlockMaxIndex(e, t, dense[e, t], examples, terms)
    d, u = np.nonzero(asked)
    but = rng.integers(examples, size=documents)
    for skip in (None, but):
        who, best = index.nearest(d, u, asked[d, u], documents, k, but=skip)
        cosine = np.round(asked @ dense.T, 9)
        if skip is not None:
            cosine[np.arange(documents), skip] = -1
        for i in range(documents):
            order = [j for j in np.lexsort((np.arange(examples), -cosine[i])) if cosine[i, j] > 0][:k]
            assert np.allclose([x for x in best[i] if x > 0], cosine[i, order], atol=1e-8)
            assert len([x for x in who[i] if x >= 0]) == len(order)


def corpus():
    random.seed(4)
    words = ["".join(random.choices("abcdefghijklmnop", k=random.randint(3, 7))) for _ in range(500)]
    bad = ["grubslob", "vilefoot", "dungwit", "mudbrain"]
    rows = []
    for i in range(600):
        body = random.choices(words, k=random.randint(30, 120))
        if i % 8 == 0:
            for w in random.choices(bad, k=4):
                body.insert(random.randrange(len(body)), w + random.choice(["", "s", "!", ","]))
        rows.append((i, " ".join(body), int(i % 8 == 0)))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows] + [(1000, None, "x", 0.5), (1001, "", "x", 0.5), (None, rows[8][1], "x", 0.5), (7, rows[7][1], "x", 0.5)],
                                 "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i % 4 != 3] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == 604 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(y == p for y, p in held) >= 0.97 * len(held)
    assert next(r for r in got if r["doc_id"] is None)["predicted"] == 1
    assert all(e["toxic"] in (0, 1) and 0 < e["similarity"] <= 1.000001 for r in got for e in r["evidence"])
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0
    none = toxicity.toxicity_scores(docs.limit(5), labels.limit(0)).collect()
    assert len(none) == 5 and len({r["score"] for r in none}) == 1


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = corpus()[:200]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    out = []
    for flip in (0, 1):
        known = [(i, (1 - y) if flip and zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in rows]
        out.append(sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity_scores(docs, spark.createDataFrame(known, "doc_id long, toxic int")).collect()))
    assert out[0] == out[1]
