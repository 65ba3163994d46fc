"""Divergence of sources against plain counting, and run-length columns against dense ones."""

import collections
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tabkit.llm import divergence
from tests.llm.helpers import frame

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "text string, lang string, source string"


def audit(rows, least_docs, best):
    counts, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        groups = sorted(s for a, s in counts if a == lang)
        whole = {t: sum(counts[lang, s][t] for s in groups) for t in kept}

        def parts(n):
            total = sum(n[t] for t in kept)
            return {t: 1 + 10**9 * (n[t] + 5) // (total + 5 * len(kept)) for t in kept}
        q, p = parts(whole), {s: parts(counts[lang, s]) for s in groups}
        for s in groups:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items, top in (("pair", pairs, None), ("term", terms, best)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:top]
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)}
    return out


def texts():
    rng = np.random.default_rng(3)
    words = ["the", "The", "été", "mañana", "a_b", "x9y", "語", "ÉTÉ", "z" * 3000] + [f"w{'abc'[i % 3]}{'xyz'[i // 3 % 3]}" for i in range(30)]
    rows = [(" ".join(rng.choice(words, rng.integers(1, 40))), f"l{i % 2}", f"s{rng.integers(0, 6) if i % 3 else 0}") for i in range(300)]
    return rows + [(None, "l0", "s9"), ("", None, None), ("the", None, ""), ("the the", "l0", None), (rows[0]), (rows[0]),
                   ("only here", "l9", "s1"), ("only there", "l9", "s2"), ("the " * 60_000, "l1", "s1")]


def test_counts(spark):
    rows = texts()
    for least, best in ((30, 50), (3, 4)):
        got = [tuple(r) for r in divergence.source_divergence(frame(spark, rows, COLUMNS), least, best).select(
            "lang", "source", "part", "item", "value", "rank").collect()]
        assert len(got) == len(set(got)) and set(got) == audit(rows, least, best)


def test_empty(spark):
    assert divergence.source_divergence(frame(spark, [], COLUMNS)).count() == 0


def test_large_counts_are_exact():
    counts = [0, 1, 10**12 + 7, 8 * 10**15]
    total, terms = 8 * 10**15 + 10**12 + 8, 4
    assert divergence.frequency(np.array(counts), total, terms).tolist() == [1 + 10**9 * (c + 5) // (total + 5 * terms) for c in counts]
    assert divergence.frequency(np.array([3]), 3, 1).tolist() == [1 + 10**9]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=40))
def test_runs_against_dense_columns(rows):
    a, b = np.array(rows).T
    at = np.arange(len(a))
    columns = [divergence.encode_runs(at[x > 0], x[x > 0], len(x)) for x in (a, b)]
    assert divergence.run_distance(*columns, len(a)) == np.abs(a - b).sum()
