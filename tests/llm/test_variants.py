"""Operator 11 against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from brindle.llm.tables import ship, table
from brindle.llm.variants import BEGIN, END, Grams, near_words, spelling_variants, variant_groups


def apart(a, b):
    """One inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def groups(n):
    """word: (form, root, n, n_near, form_n) by all pairs."""
    near = {w: [v for v in n if apart(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def words(docs, least=5, times=3):
    seen = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: k for w, k in seen.items() if len(w) >= least and k >= times}


def test_bound_holds_for_every_edit():
    random.seed(3)
    for letters, lo, hi, qmax, rare in (("ab", 2, 9, 4, 5), ("abc", 3, 9, 4, 20), ("abcdef", 5, 10, 4, 4), ("abcdef", 5, 10, 3, 4), ("ab", 2, 12, 5, 30)):
        ws = {"".join(random.choices(letters, k=random.randint(lo, hi))) for _ in range(300)}
        seen = Counter((BEGIN + w + END)[i : i + k] for w in ws for k in range(2, qmax + 1) for i in range(len(w) + 3 - k))
        grams, plain = Grams({g: k for g, k in seen.items() if k > rare}, 2, qmax), Grams({}, 2, 2)
        keys = {w: set(own) if bounded else {*own, *plain.listed(w)[0]} for w in ws for own, bounded in [grams.listed(w)]}
        assert all(keys[a] & keys[b] for a in ws for b in ws if apart(a, b))


def test_groups_of_words(spark):
    ship(spark)
    random.seed(5)
    n = {"".join(random.choices("abé", k=random.randint(5, 8))): random.choice([3, 4, 7, 20, 50, 900]) for _ in range(400)}
    n |= {"x" * 5000: 3, "x" * 4999 + "y": 9, "x" * 4999: 8, "colour": 10, "color": 10, "colors": 10}
    got = variant_groups(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert len(got) == len(n) and {tuple(r) for r in got} == groups(n)
    assert near_words(spark.createDataFrame([], "word string, n long")).count() == 0


def test_words_of_documents(spark):
    ship(spark)
    text = " ".join(f"Gar{c}en garden GARDENS Über÷flow ÀB" for c in "abcdefgh") + " éclair eclair éclair"
    docs = [(i, text) for i in range(130)] + [(3, text), (None, text), (131, None), (132, ""), (133, "z" * 200_000), (134, "1 2 \n")]
    df = spark.createDataFrame([(*d, 1, "g", 2) for d in docs], "doc_id long, text string, n long, word string, key long").repartition(3)
    assert {tuple(r) for r in spelling_variants(df).collect()} == groups(words(docs))
    assert spelling_variants(df.limit(0)).count() == 0


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").where(F.col("doc_id") < 120)
    want = groups(words([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    assert len(want) > 500 and {tuple(r) for r in spelling_variants(docs).collect()} == want
