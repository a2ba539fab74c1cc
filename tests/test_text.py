"""Text functions against plain restatements of their rules."""

import random
import re

from pyspark.sql import functions as F

from brindle.functions.numbers import decimal, mean40, number_error, render
from brindle.functions.text import caption_kind, column_letter, split_text, tokenize


def one(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r[0] for r in df.select(expression(F.col("t")).alias("x"), "i").orderBy("i").collect()]


def test_tokens(spark):
    got = one(spark, ["Urban100 PSNR 27.45", "状态 Straße a-b_c", "", "!"], tokenize)
    assert got == [["urban100", "psnr", "27.45"], ["状", "态", "状态", "strasse", "a-b_c"], [], []]


def _split(text, limit):
    out = []
    while len(text) > limit:
        found = list(re.finditer(r"[。！？.!?]\s*|\s+", text[: limit + 1]))
        k = min(limit, found[-1].end() if found else limit)
        out.append(text[:k].strip())
        text = text[k:].strip()
    return [x for x in [*out, text] if x]


def test_split_text(spark):
    rng = random.Random(1)
    texts = ["第一句话。第二句话。第三句话。", "", "a" * 100, *["".join(rng.choice("ab .!\n") for _ in range(rng.randrange(90))).strip() for _ in range(200)]]
    assert one(spark, texts, lambda t: split_text(t, 20)) == [_split(t, 20) for t in texts]


def test_numbers(spark):
    cells = ["1", "-.5", "1e3", "+2.", "", "1,000", "5%", "3kg", "[公式结果不可用]", None, "0.12345678901", " 7 "]
    assert one(spark, cells, number_error) == [None, None, None, None, "blank", "not a number", "not a number", "not a number", "missing", "blank", "out of range", None]
    assert one(spark, cells[:4], lambda t: render(decimal(t))) == ["1", "-0.5", "1000", "2"]
    df = spark.createDataFrame([("1", 3), ("0", 2), ("0", 0), ("10", 4)], "t string, n int")
    assert [r[0] for r in df.select(mean40("t", "n")).collect()] == ["0." + "3" * 40, "0", None, "2.5"]


def test_small_functions(spark):
    assert one(spark, ["Figure 3. x", "table 2", "图 1", "text"], caption_kind) == ["figure", "table", "figure", None]
    assert one(spark, [1, 26, 27, 702, 703], column_letter, "int") == ["A", "Z", "AA", "ZZ", "AAA"]
