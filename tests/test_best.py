"""Search whose k best are kept within tasks, against the same by joins; cutting of texts; passages found by a word of theirs."""

import random

import pyarrow as pa
import numpy as np
from pyspark.sql import functions as F

from brindle.functions.text import split_parts, split_text, strip
from brindle.operators import lexical, vectors
from brindle.operators.best import Best


def test_best_with_ties():
    r = random.Random(1)
    rows = [(f"c{i:03}", [r.choice((0.25, 0.5, 0.75, -np.inf)) for _ in range(3)]) for i in range(400)]
    r.shuffle(rows)
    found = Best(5, 3)
    for k in range(0, 400, 7):
        found.add((), pa.array([n for n, _ in rows[k : k + 7]]), np.array([s for _, s in rows[k : k + 7]]))
    ((_, of, names, scores),) = found.rows()
    want = [(q, n, -s) for q in range(3) for s, n in sorted((-s[q], n) for n, s in rows if s[q] > -np.inf)[:5]]
    assert list(zip(of.tolist(), names.tolist(), scores.tolist(), strict=True)) == want


def test_words_and_passages(spark):
    r = random.Random(2)
    word = lambda: r.choice(["aa", "bb", "cc", "dd", "ee", "rare1", "rare2", "图表"])
    data = [(f"{i:04}", f"k{i % 3}", [word() for _ in range(r.randrange(9))], i % 5 > 0, [i % 4, 3]) for i in range(300)]
    chunks = spark.createDataFrame(data, "chunk_id string, collection string, tokens array<string>, ok boolean, readers array<long>").repartition(5)
    questions = spark.createDataFrame([(1, "aa rare1"), (2, "bb cc"), (3, "nowhere"), (4, "")], "query_id long, question string")
    asked = spark.createDataFrame([(1, 0), (2, 3), (2, 9), (1, 3)], "query_id long, actor long")
    for by, keep, who in (((), None, None), (("collection",), F.col("ok"), None), (("collection",), None, asked)):
        got = lexical.best(chunks, questions, 4, by, keep, who)
        want = lexical._best_by_shuffle(chunks, lexical.query_terms(questions), 4, by, keep, who, 1.5, 0.75)
        cols = sorted(want.columns)
        a, b = (sorted(map(tuple, x.withColumn("score", F.round("score", 6)).select(*cols).collect())) for x in (got, want))
        assert a == b and len(a) > 7
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    text = chunks.select("chunk_id", "tokens", F.concat(F.lit("x"), F.array_join("tokens", " ")).alias("content"))
    starts = spark.createDataFrame([(1, "a bb "), (2, "rare1"), (3, "a 图表 d"), (4, None), (5, "zz yy xx")], "query_id long, start string")
    want = sorted((r_.query_id, r_.chunk_id) for r_ in text.join(starts, F.contains("content", "start")).collect())
    assert sorted(map(tuple, lexical.containing(text, starts).collect())) == want and {q for q, _ in want} == {1, 2, 3}


def test_many_queries_go_by_blocks(spark, monkeypatch):
    r = np.random.RandomState(3)
    v = spark.createDataFrame([(f"v{i}", i % 2, r.randn(4).tolist()) for i in range(60)], "chunk_id string, c int, vector array<double>")
    q = v.where("chunk_id LIKE '%3'").select(F.col("chunk_id").alias("query_id"), "c", "vector")
    for on in (None, ["c"]):
        monkeypatch.setattr(vectors, "QUERIES", 20_000)
        near = sorted(map(tuple, vectors.dense_top(v, q, 5, on).select("query_id", "chunk_id", "rank").collect()))
        monkeypatch.setattr(vectors, "QUERIES", 2)
        assert sorted(map(tuple, vectors.dense_top(v, q, 5, on).select("query_id", "chunk_id", "rank").collect())) == near and len(near) == 30


def test_parts_of_texts(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("ab .!。\n　 \u0085\x1c😀") for _ in range(r.randrange(200))) for _ in range(300)] + ["", "x" * 50, " ", "a" * 10 + " " * 30 + "b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip(F.col("t")).alias("s")).select("s", split_text(F.col("s"), 10).alias("p")).collect()
    for x in rows:
        assert split_parts(x["s"], 10) == x["p"]


def test_small_blocks_and_passages_without_joins(spark, monkeypatch):
    r = random.Random(5)
    data = [(f"{i:04}", [r.choice(["aa", "bb", "cc", "dd", "x1", "图表"]) for _ in range(r.randrange(9))]) for i in range(200)] + [("none", [])]
    chunks = spark.createDataFrame(data, "chunk_id string, tokens array<string>").withColumn("content", F.when(F.col("chunk_id") != "none", F.array_join("tokens", " "))).repartition(3)
    questions = spark.createDataFrame([(i, " ".join(r.choice(["aa", "bb", "cc", "x1", "zz"]) for _ in range(3))) for i in range(7)], "query_id long, question string")
    monkeypatch.setattr(lexical, "CELLS", 10)
    monkeypatch.setattr(lexical, "BESIDE", 3)
    got, want = lexical.best(chunks, questions, 4), lexical._best_by_shuffle(chunks, lexical.query_terms(questions), 4, (), None, None, 1.5, 0.75)
    a, b = (sorted((x.query_id, x.chunk_id, x["rank"], round(x.score, 6)) for x in df.collect()) for df in (got, want))
    assert a == b and len({x[0] for x in a}) > 5
    starts = spark.createDataFrame([(1, "a bb c"), (2, "aa"), (3, "b cc b"), (4, "x1 图表 d"), (5, ""), (6, "b cc")], "query_id long, start string")
    near = lexical.containing(chunks, starts)
    assert near._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    want = sorted(map(tuple, chunks.join(starts, F.contains("content", "start")).select("query_id", "chunk_id").collect()))
    assert sorted(map(tuple, near.collect())) == want and {q for q, _ in want} >= {1, 2, 3, 5, 6}
    monkeypatch.setattr(lexical, "SEND_ROWS", 2)
    assert sorted(map(tuple, lexical.containing(chunks, starts).collect())) == want
