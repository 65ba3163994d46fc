"""The curriculum against resharing by hand, numeric integration and a plain walk through each source."""

import hashlib
import math
import re

import pytest

from tabkit.llm import mixing
from tests.llm.helpers import frame

WORD = re.compile("[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, source string"
SHAPES = [mixing.FALLING, mixing.MIDDLE, mixing.RISING]
SCHEDULE = mixing.rotating(*SHAPES)


def targets(sizes, weights, budget, most):
    """Shares by weight; what is above its limit stops there and the excess is shared anew."""
    total, capped = budget * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        rest = sum(weights[s] for s in sizes if s not in capped)
        share = {s: most * sizes[s] if s in capped else left * weights[s] / rest for s in sizes}
        above = {s for s in sizes if s not in capped and share[s] > most * sizes[s]}
        if not above:
            return share
        capped |= above


def integral(shape, t):
    out = 0.0
    for (t0, w0), (t1, w1) in zip(shape, shape[1:]):
        x = min(max(t - t0, 0.0), t1 - t0)
        out += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
    return out


def rows_of(seed=1):
    import random
    r = random.Random(seed)
    out = [(i, " ".join(["w"] * r.randint(0, 60)), f"src{r.choice([0, 0, 0, 1, 2, 3, 4])}") for i in range(400)]
    return out + [(401, None, "src1"), (402, "a b", None), (None, "c\td\x0be", None), (403, "", ""), (403, "x y", ""), (403, "x y", ""),
                  (404, "tiny", "small"), (405, "w " * 20_000, "src2"), (406, None, "none"), (407, " \n", "zero")]


@pytest.fixture(scope="module")
def mix(spark):
    rows = rows_of()
    mix = mixing.mixed(frame(spark, rows, COLUMNS), SCHEDULE, span_rows=16)
    return rows, mix, [r.asDict(recursive=True) for r in mix.collect()]


def test_words_taken(mix):
    rows, _, got = mix
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = targets(sizes, weights, 1.5, 2)
    by_doc = {}
    for doc_id, text, source in rows:
        by_doc.setdefault((doc_id, len(WORD.findall(text or ""))), []).append(source)
    # doc_id 403 stands in one source alone, so a document's source is known from its id and size.
    taken = dict.fromkeys(order, 0)
    for r in got:
        source = by_doc[r["doc_id"], r["size"]][0]
        assert r["source_size"] == sizes[source] and math.isclose(r["target"], want[source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(p["words"] for p in r["placements"])
        taken[source] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in order)


def test_places(mix):
    rows, _, got = mix
    text_of = {}
    for doc_id, text, source in rows:
        text_of[doc_id, len(WORD.findall(text or ""))] = (text or "", source)
    order = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    walk = {s: [] for s in order}
    for r in got:
        text, source = text_of[r["doc_id"], r["size"]]
        stamp = hashlib.md5(f"11:{'' if r['doc_id'] is None else r['doc_id']}:{text}".encode()).hexdigest()
        walk[source].append((int(stamp[:15], 16), r))
    for i, s in enumerate(order):
        shape, first = SHAPES[i % 3], 0
        total = round(walk[s][0][1]["target"])
        size = sum(r["size"] for _, r in walk[s])
        group = sorted(walk[s], key=lambda x: (x[0], [p["pass"] for p in x[1]["placements"]], [p["place"] for p in x[1]["placements"]]))
        for _, r in group:
            for p in r["placements"]:
                begun = p["pass"] * size + first
                assert math.isclose(integral(shape, p["place"]), begun / total * integral(shape, 1), abs_tol=1e-9)
                assert p["words"] == min(r["size"], total - begun)
            first += r["size"]


def test_order_and_reruns(spark, mix):
    rows, m, got = mix
    order = [tuple(r) for r in mixing.training_order(m).select("place", "doc_id", "pass").collect()]
    assert len(order) == sum(len(r["placements"]) for r in got)
    assert [x[0] for x in order] == sorted(x[0] for x in order) and all(0 <= x[0] <= 1 for x in order)
    again = mixing.mixed(frame(spark, rows[::-1], COLUMNS).repartition(5), SCHEDULE, span_rows=64)
    key = lambda r: repr((r["doc_id"], r["size"], r["placements"]))                          # noqa: E731
    assert sorted(map(key, got)) == sorted(map(key, (r.asDict(recursive=True) for r in again.collect())))


def test_empty_and_wordless(spark):
    assert mixing.mixed(frame(spark, [], COLUMNS), SCHEDULE).count() == 0
    got = mixing.mixed(frame(spark, [(1, None, "a"), (2, " ", None)], COLUMNS), SCHEDULE).collect()
    assert [(r["size"], r["target"], r["taken"], r["placements"]) for r in got] == [(0, 0.0, 0, [])] * 2


def test_a_source_that_rests(spark):
    """A weight of zero for a while takes nothing then; a source without any weight takes nothing at all."""
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(40)]
    schedule = mixing.rotating([(0, 0), (0.5, 0), (1, 2)], [(0, 0), (1, 0)])
    got = mixing.mixed(frame(spark, rows, COLUMNS), schedule, budget=0.5).collect()
    assert {r["taken"] for r in got if r["doc_id"] % 2} == {0}
    places = [p["place"] for r in got for p in r["placements"]]
    assert len(places) == 20 and min(places) >= 0.5
