"""Operator 13: neighbours by a plain loop, bins and donors by their definition, likeness against exact similarity."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from brindle.llm import fingerprints
from brindle.llm.fingerprints import Sketcher, neighbours
from brindle.llm.fingerprints import fingerprints as fingerprint
from brindle.llm.shingles import shingles
from brindle.llm.tables import ship, table


def brute(docs):
    sketch = Sketcher()
    order = sorted(((i, t or "") for i, t in docs if i is not None))
    out = []
    for k, (i, t) in enumerate(order):
        other = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + other[:half]
        a, b, c = map(sketch.packed, (t, new, other))
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), a.hex(), b.hex(), sketch.likeness(a, b), sketch.likeness(a, c)))
    none = [(None, len(t or ""), None, sketch.packed(t).hex(), None, None, None) for i, t in docs if i is None]
    return sorted(out + none, key=str)


def test_edges(spark, monkeypatch):
    ship(spark)
    random.seed(4)
    texts = [None, "", " \n ", "one", "two words", "é" * 7, "same text of some more words here", "same text of some more words here", "w " * 30_000]
    texts += [" ".join(random.choices("a b c d e f g h".split(), k=random.randint(1, 60))) for _ in range(60)]
    docs = [(i * 7 - 40, t) for i, t in enumerate(texts)] + [(-40, "again"), (2, "x y"), (2, "x y"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(*d, 1, True, "f") for d in docs], "doc_id long, text string, range long, further boolean, fingerprint string").repartition(5)
    assert sorted(map(tuple, neighbours(df).collect()), key=str) == brute(docs)
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 1 << 10)
    assert sorted(map(tuple, neighbours(df).collect()), key=str) == brute(docs)
    for few in (docs[:0], docs[:1], docs[-2:]):
        assert sorted(map(tuple, neighbours(spark.createDataFrame(few, "doc_id long, text string")).collect()), key=str) == brute(few)
    assert {(r.doc_id, r.fingerprint) for r in fingerprint(df).collect()} == {(i, Sketcher().packed(t).hex()) for i, t in docs}


def test_bins_and_donors():
    sketch, rng = Sketcher(64, 4), np.random.default_rng(1)
    for n in (1, 2, 5, 40, 1000):
        h = np.unique(rng.integers(0, 2**64, n, np.uint64))
        bins = {}
        for x in h.tolist():
            bins[x >> 58] = min(bins.get(x >> 58, x), x)
        want = [bins[b] if b in bins else bins[min(bins, key=lambda j: sketch.place[b, j])] for b in range(64)]
        assert sketch.minima(h).tolist() == want
    assert all(sorted(row) == list(range(64)) for row in sketch.place.tolist())


def test_likeness_is_close_to_similarity():
    """Over sizes and overlaps the mean error is near 0 (the bias correction holds) and errors stay within the spread of 512 bins."""
    random.seed(6)
    sketch, errors = Sketcher(), []
    for n in (3, 30, 300, 3000):
        for shared in (0, 0.3, 0.6, 0.9):
            words = [f"w{random.random()}" for _ in range(2 * n + 20)]
            both = int(shared * n)
            a, b = " ".join(words[: n + 4]), " ".join(words[n - both : 2 * n - both + 4])
            x, y = shingles(a, 5), shingles(b, 5)
            true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            errors.append((n, sketch.likeness(sketch.packed(a), sketch.packed(b)) - true))
    assert all(abs(e) < (0.12 if n >= 300 else 0.45) for n, e in errors) and abs(np.mean([e for n, e in errors if n >= 30])) < 0.05


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert sorted(map(tuple, neighbours(docs).collect()), key=str) == brute([(r.doc_id, r.text) for r in docs.select(F.col("doc_id"), "text").collect()])
