"""Removal of repeated passages against counting every string of the length."""

import hashlib
import random
from collections import Counter

import pytest

from tabkit.llm import repeats


def plain(texts, length):
    bodies = [(t or "").encode() for t in texts]
    counts = Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    random.seed(3)
    word = lambda: "".join(random.choices("abcdeé ", k=random.randint(2, 9)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    passage, other = fresh(60), fresh(90)
    texts = [None, "", "short", "a" * 199, "a" * 201, "b" * 200, fresh(400)]
    texts += [fresh(20) + passage + fresh(30) for _ in range(12)]
    texts += [passage[i:] + other[:300 + i] + fresh(10) for i in range(0, 60, 7)]
    base = fresh(200)
    texts += [base[:k] + "#" + base[k + 1:] for k in range(0, 900, 150)]
    texts += [base, base, other + fresh(3) + other, fresh(3000) + passage[:260]]
    return texts


@pytest.mark.parametrize("hot_rows", [50_000, 3])
def test_against_counts(spark, hot_rows):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, k1 string, copies long").repartition(4)
    got = repeats.without_repeats(docs, 200, hot_rows=hot_rows)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = sorted(map(tuple, got.collect()))
    assert [r[1:] for r in rows] == plain(texts, 200)


def test_shorter_length_and_kept_bytes(spark):
    texts = corpus()[:20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(map(tuple, repeats.without_repeats(docs, 60, with_text=True).collect()))
    assert [r[1:5] for r in rows] == plain(texts, 60)
    assert all(hashlib.sha256(r[5]).hexdigest() == r[4] for r in rows)


def test_first_copy_stays(spark):
    """The operator's own ranges, with the first occurrence left out."""
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, _, all_hits = repeats.repeated_spans(docs, 200, 50_000, keep_first=False)
    _, _, later = repeats.repeated_spans(docs, 200, 50_000, keep_first=True)
    starts = lambda hits: {(r["k1"], i) for r in hits.collect() for i in range(r["low"], r["high"] + 1)}
    both, kept = starts(all_hits), starts(later)
    assert kept < both and len(kept) >= len(both) / 2


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, "x" * 300), (None, "x" * 300), (1, None)], "doc_id long, text string")
    got = sorted(map(tuple, repeats.without_repeats(docs).select("n_bytes", "n_removed").collect()))
    assert got == [(0, 0), (300, 300), (300, 300)]
    assert repeats.without_repeats(docs.limit(0)).count() == 0
