"""Fences follow their group: the same document is kept in one source and rejected in another."""

import random

from pyspark.sql import functions as F

from brindle.llm.quality import METRICS, judged, quality_rules

WORDS = "some plain words that stand here with others".split()


def test_sources_differ(spark):
    rows = []
    for k in range(400):
        plain = " ".join(WORDS[(k * 7 + j * (1 + k % 5)) % 8] + str(20_000 + k * 31 + j) for j in range(30))
        rows += [(k, plain, "en", "prose"), (1000 + k, " ".join(w * (1 + (k + j * j) % 6 + k % 5) for j, w in enumerate(plain.split())), "en", "lists")]
    long = " ".join(f"{w}{j}{w}{w}{w}" for j, w in enumerate(WORDS * 4))
    rows += [(5000, long, "en", "prose"), (5001, long, "en", "lists"), (5002, long, None, None), (5003, None, "en", "prose")]
    kept = {r.doc_id for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert 5000 not in kept and 5001 in kept and 5003 not in kept
    assert len([k for k in kept if k < 1000]) > 380 and len([k for k in kept if 1000 <= k < 5000]) > 380


def test_groups_of_like_documents_are_kept_whole(spark):
    """Sources whose documents are alike, far from what is usual elsewhere, of any size from a dozen on; and odd documents in small sources go."""
    random.seed(7)
    usual = lambda: " ".join("w" * random.randint(2, 8) + str(random.randint(100, 999)) for _ in range(40))
    rows = [(usual(), "mixed") for _ in range(600)]
    for n in (15, 99, 100, 300):
        rows += [(" ".join("ab" * 6 + f"{random.randint(1000, 9999)}" for _ in range(20)), f"long{n}") for _ in range(n)]
        rows += [("\n".join(["one plain line", *[" ".join(f"v{random.random()}" for _ in range(9)) for _ in range(2)], "one plain line"]), f"forms{n}") for _ in range(n)]
        rows += [(" ".join(f"sign{random.random()}" for _ in range(10)) + " #x", f"signs{n}") for _ in range(n)]
        rows += [("the same text of a form that a source has again and again", f"same{n}")] * n
    rows += [(" ".join("x" * 70 + str(random.random()) for _ in range(20)), "few")] * 2
    df = spark.createDataFrame([(k, t, "en", s) for k, (t, s) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    by = {r.source: (r.n, r.kept) for r in judged(df, [F.col("doc_id"), F.col("source")]).groupBy("source").agg(F.count_if(~F.col("base_failed")).alias("n"), F.count_if("kept").alias("kept")).collect()}
    assert by.pop("few") == (2, 0) and by["mixed"][1] > 560 and all(n > 14 for n, _ in by.values())
    assert {s: v for s, v in by.items() if s != "mixed" and v[0] != v[1]} == {} and set(METRICS) == {"symbols", "word_length", "dup_lines", "repeats"}
