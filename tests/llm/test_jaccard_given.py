"""The Jaccard join on given documents against brute force, and its candidates against their promise."""

import numpy as np
import pytest

from brindle.llm import jaccard
from brindle.llm.components import connected_components
from brindle.llm.shingles import shingles
from brindle.llm.tables import ship


@pytest.mark.parametrize(("size", "num"), [(4, 85), (5, 80)])
def test_given_documents(spark, size, num):
    ship(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 3 = 0").selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars"))
    sets = {r.doc_id: {int(x) for x in shingles(r.text, size)} for r in docs.select("doc_id", "text").collect()}
    label = {i: i for i in sets}
    find = lambda i: i if label[i] == i else find(label[i])
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, size, num).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in ids}


def test_linked_sets_hang_together(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(jaccard, "BUCKET", 64)
    dice, rows = np.random.default_rng(1), []
    for _ in range(400):
        words = dice.integers(0, 40, dice.integers(3, 60)).tolist()
        for copy in range(3):
            changed = [w if dice.random() > 0.01 * copy else -1 for w in words]
            rows.append((len(rows), " ".join(f"w{w}" for w in changed)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").dropDuplicates(["text"]).cache()
    texts = dict(docs.collect())
    sets = {i: {int(x) for x in shingles(t, 4)} for i, t in texts.items()}
    sizes = spark.createDataFrame([(i, len(s)) for i, s in sets.items()], "doc_id bigint, n_shingles bigint")
    near = {r.node: r.component for r in connected_components(jaccard.candidates(docs, sizes, 4, 80, 100)).collect()}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(linked) > 50
    assert all(near[a] == near[b] for a, b in linked)
    assert len(near) < len(sets)


def test_packed_ids():
    for ids in ([], [5], [9, 3, 1 << 62, -(1 << 62), 3]):
        assert jaccard._unpack(jaccard._pack(np.array(ids, np.int64))).tolist() == ids
