"""Exact search in blocks, and the registered search of every hundredth vector."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from brindle.operators import vectors


def test_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 100)
    e = np.random.default_rng(4).integers(-3, 4, (350, 4)).astype(float)  # small whole numbers: many ties
    df = spark.createDataFrame([(i, x.tolist(), i // 7) for i, x in enumerate(e)], "vec_id long, embedding array<float>, label int")
    df.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = e / np.linalg.norm(e, axis=1, keepdims=True)
    want = []
    for q in range(0, 350, 100):
        s = [(-round(float(unit[q] @ unit[i]), 9), f"v:{i}") for i in range(350) if i // 7 % 2 == q // 7 % 2 and e[i].any()]
        want += [(q, c, k + 1) for k, (_, c) in enumerate(sorted(s)[:10])] if e[q].any() else []
    got = entry.queries()["jn04_tk02_dense_all"](spark, str(tmp_path)).select("query_id", "chunk_id", F.col("rank")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) >= 30
