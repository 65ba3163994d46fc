"""Spelling variants against every pair of words, compared letter by letter."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabkit.llm import spelling
from tests.llm.helpers import CLASHES, frame

WORD = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, least, every):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in WORD.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= least:
                n[run] += 1
    return n


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(rows, least=7, twice=2, times=10, every=31):
    n = {w: k for w, k in counted(rows, least, every).items() if k >= twice}
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def texts():
    """Words and their misspellings over few letters, some very common, some long, with accents."""
    rng = np.random.default_rng(5)
    letters = list("abcdeéÀ÷")
    words = ["".join(rng.choice(letters, rng.integers(5, 11))) for _ in range(60)] + ["a" * 9, "b" * 400]
    rows = []
    for i in range(300):
        chosen = []
        for w in rng.choice(words, 12, p=np.array([3.0 ** -(k % 7) for k in range(62)]) / sum(3.0 ** -(k % 7) for k in range(62))):
            at = int(rng.integers(0, len(w)))
            x = rng.random()
            chosen.append(w if x > 0.3 else w[:at] + w[at + 1:] if x > 0.2 else w[:at] + rng.choice(letters) + w[at + (x > 0.1):])
        rows.append((i, " ".join(chosen)))
    # A chain of forms: each ten times as common as the one before.
    return rows + [(1000 + i, "chainaaa " * (i < 4) + "chainaab " * (2 if i < 40 else 0) + "chainabb " * 20 + "chainbbb " * 300) for i in range(90)]


@pytest.mark.parametrize("every", [31, 3])
def test_all_pairs(spark, every):
    rows = [*texts(), (7, None), (8, ""), (None, "aaaaaaaaa Bbbbbbbbb x1y"), (0, texts()[0][1]), (0, texts()[0][1]), (900, "abcdefg-" * 30_000)]
    docs = frame(spark, rows)
    got = [tuple(r) for r in spelling.spelling_variants(docs, every=every).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = variants(rows, every=every)
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] not in r[:2] for r in want)


def test_empty_and_extra_columns(spark):
    assert spelling.spelling_variants(frame(spark, [])).count() == 0
    assert set(CLASHES) <= set(frame(spark, []).columns)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text(alphabet=st.sampled_from(list("abé")), min_size=2, max_size=6), min_size=1, max_size=60))
def test_signatures_find_each_pair_once(words):
    words = sorted(words)
    signatures = spelling.Signatures({97: 5, 98: 3, 233: 1})
    key, kind, row = signatures.rows(pa.array(words))
    order = np.argsort(key, kind="stable")
    key, kind, row = key[order], kind[order], row[order]
    a, b = spelling.near_of_groups(key, kind, pa.array(words).take(pa.array(row)), signatures)
    got = sorted(tuple(sorted((words[row[x]], words[row[y]]))) for x, y in zip(a, b))
    assert got == sorted((x, y) for i, x in enumerate(words) for y in words[i + 1:] if one_apart(x, y))


def test_checksums_of_spans():
    data = np.frombuffer(b"hello world, " * 20, np.uint8)
    starts, ends = np.array([0, 3, 6, 10]), np.array([5, 3, 11, 250])
    begun = np.array([zlib.crc32(b"7:")] * 4, np.uint32)
    got = spelling.crc_of_runs(data, starts, ends, begun)
    assert got.tolist() == [zlib.crc32(b"7:" + data[a:b].tobytes()) for a, b in zip(starts, ends)]
