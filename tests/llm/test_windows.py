"""Decontamination against an exact search over all windows of an item's length."""

import re
from collections import Counter

import numpy as np

from brindle.llm import decontaminate
from brindle.llm.tables import ship


def words(t):
    return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]


def similarity(a, b):
    shingles = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    x, y = shingles(a), shingles(b)
    return sum((x & y).values()) / sum((x | y).values())


def exact(docs, items):
    out = set()
    for d, t in docs:
        w = words(t)
        for i, u in items:
            v = words(u)
            starts = range(max(1, len(w) - len(v) + 1)) if len(v) >= 5 else range(len(w) - len(v) + 1)
            if v and w and any(similarity(w[s : s + len(v)], v) >= 0.8 for s in starts if len(v) >= 5 or w[s : s + len(v)] == v):
                out.add((d, i))
    return out


def cases():
    dice = np.random.default_rng(4)
    word = lambda: f"w{dice.integers(0, 300)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([60, 60, 45, 80, 12, 30, 3, 1, 5, 4])] + [(90, None), (91, ""), (None, "w1 w2 w3 w4 w5 w6")]
    docs = [(0, None), (1, ""), (2, "w1"), (None, items[0][1])]
    for d in range(60):
        v = words(items[d % 10][1])
        for _ in range(int(dice.integers(0, 3))):
            at = int(dice.integers(0, len(v) + 1))
            v[at : at + int(dice.integers(0, 2))] = [word() for _ in range(int(dice.integers(0, 2)))]
        before, after = ([word() for _ in range(int(dice.integers(0, 40)))] for _ in range(2))
        docs.append((10 + d, " ".join([*before, *v, *after])))
    return [*docs, docs[5]], [*items, items[0]]


def test_equals_all_windows(spark, monkeypatch):
    ship(spark)
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS h", "3 AS start").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS key", "2 AS q", "3 AS doc_id")
    want = exact([x for x in dict(docs).items() if x[0] is not None], [x for x in dict(items).items() if x[0] is not None])
    run = lambda: {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()}
    assert run() == want
    monkeypatch.setattr(decontaminate, "SEND_ROWS", 0)  # nothing is sent whole
    assert run() == want
