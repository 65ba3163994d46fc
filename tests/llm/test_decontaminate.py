"""Containment search against comparing every document with every item."""

import random
import re

from tabkit.llm import decontaminate


def parts(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def plain(docs, items):
    out = []
    for d, text in docs:
        own = parts(text)
        for i, item in items:
            s = parts(item)
            if s and 100 * len(s & own) >= 80 * len(s):
                out.append((repr(d), repr(i), len(s), len(s & own)))
    return sorted(out)


def corpus():
    random.seed(5)
    fresh = lambda n: [f"w{random.randrange(5000)}" for _ in range(n)]
    items = [(i, fresh(random.choice([3, 5, 6, 9, 14, 30, 58, 120]))) for i in range(40)]
    docs = [(0, None), (1, ""), (2, "a b c"), (3, " ".join(fresh(9000)))]
    for k in range(4, 160):
        body = fresh(random.choice([0, 10, 80, 900]))
        for _, words in random.sample(items, 2):
            words = list(words)
            for _ in range(random.choice([0, 0, 1, 2, 5])):
                words[random.randrange(len(words))] = "changed"
            half = len(words) // 2
            at = random.randrange(len(body) + 1)
            body[at:at] = words if k % 3 else words[:half + 4] + fresh(3) + words[half:]
        docs.append((k, ", ".join(body).upper() if k % 2 else " ".join(body) + "."))
    return docs + [docs[20], (None, docs[30][1])], [(i, " ".join(w) + "!") for i, w in items] + [(None, " ".join(items[5][1])), (3, " ".join(items[3][1]) + "!"), (99, None)]


def test_against_all_pairs(spark):
    docs, items = corpus()
    left = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, item string, n int").repartition(4)
    right = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int")
    got = decontaminate.contaminated(left, right)
    assert got.columns == ["doc_id", "item_id", "n_shingles", "n_found", "containment"]
    want = plain(docs, items)
    assert sorted((repr(r[0]), repr(r[1]), r[2], r[3]) for r in got.collect()) == want and len(want) > 100
    assert decontaminate.contaminated(left.limit(0), right).count() == 0
    assert decontaminate.contaminated(left, right.limit(0)).count() == 0
