"""Quality counts against plain Python; verdicts on junk and on clean text."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabkit.llm import quality, texts
from tabkit.llm.texts import raw


def plain(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(found, found[1:], found[2:]))
    covered = {i + k for i in range(len(found) - 2) if windows[tuple(found[i:i + 3])] > 1 for k in range(3)}
    return [len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab é#|\n\t\r😀")), max_size=60) | st.none(), min_size=1, max_size=5))
def test_counts(texts):
    data, offsets = raw(pa.array(texts, pa.string()))
    sums, hashes, doc = quality.hashed_words(data, offsets)
    got = quality.text_counts(data, offsets, sums, (hashes, doc))
    assert np.stack([got[c] for c in quality.COUNTS], 1).tolist() == [plain(t) for t in texts]


def corpus():
    random.seed(5)
    words = ["".join(random.choices("aeioulnrst", k=random.randint(2, 7))) for _ in range(300)]
    clean = [" ".join(random.choices(words, k=120)) for _ in range(80)]
    junk = [" ".join(w.upper() + "!!" for w in random.choices(words, k=120)) for _ in range(20)]
    return clean, junk


def test_verdicts_and_edges(spark):
    clean, junk = corpus()
    texts = clean + junk + [None, "", "short text", "same words here " * 40, clean[0], "w" * 50000 + " " + clean[1]]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, clean[2], "x", 1), (0, clean[0], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(0, 100, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels, bits=10)
    assert got.columns == ["doc_id", "text", "lang", *quality.COUNTS, "base_failed", "score", "kept"]
    rows = got.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert [r[c] for c in quality.COUNTS] == plain(r["text"])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
        assert r["kept"] == (r["text"] in clean or (r["text"] or "").startswith("www"))
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert all(r["score"] == 0 for r in quality.quality_scores(docs, labels.limit(0)).collect())


def scored(spark, texts, trusted, bits, **kw):
    """Scores by the operator and by plain counting over buckets of n-grams."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i < trusted), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    grams = []
    for t in texts:
        _, hashes, doc = quality.hashed_words(*raw(pa.array([t])))
        grams.append(quality.ngrams(hashes, doc, bits)[0].tolist())
    counts = [not out and i < trusted for i, out in enumerate(quality.held_out(np.arange(len(texts))))]
    corpus, good = Counter(g for d in grams for g in d), Counter(g for d, c in zip(grams, counts) if c for g in d)
    rate = good.total() / corpus.total()
    want = [np.mean([np.log((good[g] + 10) / (corpus[g] * rate + 10)) for g in d]) for d in grams]
    got = {r["doc_id"]: (r["score"], r["kept"]) for r in quality.quality_scores(docs, labels, bits=bits, **kw).collect()}
    return got, want


@pytest.mark.parametrize("bits,listed", [(10, 1000), (14, 1000), (22, 1000), (14, 5)])
def test_scores_against_plain_counts(spark, bits, listed):
    random.seed(9)
    word = lambda: "".join(random.choices("abcdefghijklmnop", k=6))
    common = [word() for _ in range(50)]
    texts = [" ".join(random.choice(common) if random.random() < 0.3 else word() for _ in range(300)) for _ in range(150)]
    texts += [texts[3], "one " * 60 + "z" * 200_000]
    got, want = scored(spark, texts, 60, bits, listed=listed)
    assert np.allclose([got[i][0] for i in range(len(texts))], want, atol=1e-6)
    held = sorted(np.floor(w * 10_000) / 10_000 for i, w in enumerate(want) if i < 60 and quality.held_out(np.arange(60))[i])
    low, middle = (held[int(np.ceil(q * len(held))) - 1] for q in (0.05, 0.5))
    fence = low - max(1.5 * (middle - low), 0.05)
    assert all(got[i][1] == (want[i] >= fence) for i in range(150) if abs(want[i] - fence) > 1e-5)


def test_buckets_grow_with_the_corpus(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "bucket_ratios", lambda rows, members, bits, weight: seen.append(bits) or np.zeros(1 << bits, np.float32))
    for size in (10, 3_000_000):
        docs = spark.createDataFrame([(1, "word " * (size // 5))], "doc_id long, text string")
        quality.quality_scores(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count()
    assert seen == [quality.BLOCK, 16]


def test_memory_of_a_block(monkeypatch):
    """A task's arrays stay small beside its share of an executor, however large a batch is."""
    monkeypatch.setattr(texts, "_powers", [])
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{i}x{j}" for j in range(400)) for i in range(4000)])], ["text"])
    ratios = np.zeros(1 << 12, np.float32)
    tracemalloc.start()
    for block in texts.blocks([batch]):
        data, offsets = raw(block.column("text"))
        sums, hashes, doc = quality.hashed_words(data, offsets)
        quality.text_counts(data, offsets, sums, (hashes, doc))
        quality.text_scores(hashes, doc, block.num_rows, ratios)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20
