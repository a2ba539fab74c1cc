"""Operator 1: benchmark decontamination. DataFrame functions only.

Texts are lower-cased words of letters and digits; shingles are five words, and a shingle that occurs k times counts k times.

1. Windows as long as an item lie on a document wherever the two have a shingle in common, lined up at that shingle. Windows without a
   common shingle have similarity 0, so none that matters is left out. Equal windows are merged before anything else.
2. Windows and items get SimHash fingerprints. RADIUS + 1 blocks of bits index them: two fingerprints within RADIUS bits agree in one
   block at least, so the equi-join on (item size, block, bits) finds every pair within the radius.
3. Each such pair is verified by its exact weighted shingle similarity, sum of minima over sum of maxima, at least 0.8.

RADIUS is wide for that similarity (the expected distance is 10 bits at 0.8, with a deviation of 3), so blocks are of few bits and the index chooses little;
its pairs are windows that hold a shingle of some item, times the items of their size. A pair beyond RADIUS, or a window that no common shingle lines up, could be
missed; the tests compare with an exact search over all windows.

Items of fewer than five words are one shingle of as many words: a document holds such an item where these words stand in it in sequence.

Defined results: null and empty texts have no words and match nothing; texts of any length are searched whole. Of equally similar windows the first counts.
Repeated rows of docs are reported once per doc_id, repeated items per item_id; rows of a null doc_id or item_id are left out. Empty tables give no rows.
Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, RADIUS, BITS = 5, 18, 64
PERCENT = 80
SEND_ROWS = 2_000_000  # shingles of all items, at most sent to all executors


def _words() -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingled(df: DataFrame, id_: str) -> DataFrame:
    """id, __n words, __h: a hash for each shingle, in order; null without one.

    Neither a filter on __h nor a plain explode of it may follow: Spark would push a condition that holds all of __h, with the words
    split anew for each element, below the projections. posexplode_outer has no such condition.
    """
    df = df.where(f"{id_} IS NOT NULL").select(id_, _words().alias("__w"))
    n, word = F.size("__w"), lambda i: F.get("__w", i)
    hashes = F.transform(F.sequence(F.lit(0), n - SIZE), lambda i: F.xxhash64(*[word(i + k) for k in range(SIZE)]))
    return df.select(id_, n.alias("__n"), F.when(n >= SIZE, hashes).alias("__h"))


def _weighted(h: Column) -> Column:
    """Shingles made distinct by how often they came before: sums of minima and maxima of counts are sizes of sets of these."""
    counted = F.transform(h, lambda x, i: F.xxhash64(x, F.size(F.filter(F.slice(h, F.lit(1), i), lambda y: y == x))))
    plain = F.transform(h, lambda x: F.xxhash64(x, F.lit(0)))
    return F.when(F.size(F.array_distinct(h)) < F.size(h), counted).otherwise(plain)


def simhash(tokens: Column) -> Column:
    bit = lambda h, b: F.call_function("shiftright", h, b).bitwiseAND(F.lit(1).cast("long"))
    lead = lambda b: F.aggregate(tokens, F.lit(0), lambda a, h: a + F.when(bit(h, b) == 1, 1).otherwise(-1))
    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(
        F.when(lead(b) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))


def _blocks(fingerprint: Column) -> Column:
    edges = [k * BITS // (RADIUS + 1) for k in range(RADIUS + 2)]
    return F.array(*[
        F.struct(F.lit(k).alias("block"), F.call_function("shiftright", fingerprint, F.lit(a)).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("bits"))
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SEND_ROWS else df


def _short(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, similarity: where the items of fewer than SIZE words stand."""
    words = lambda df, id_: df.where(f"{id_} IS NOT NULL").select(id_, _words().alias("w"))
    items = words(benchmark, "item_id").where(F.size("w").between(1, SIZE - 1)).select("item_id", F.size("w").alias("n"), F.xxhash64("w").alias("key"))
    sizes = sorted(r["n"] for r in items.select("n").distinct().collect())  # at most SIZE - 1
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, start int, similarity bigint")
    runs = [F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.struct(F.lit(n).alias("n"), i.alias("start"), F.xxhash64(F.slice("w", i + 1, F.lit(n))).alias("key"))) for n in sizes]  # noqa: B023
    runs = [F.when(F.size("w") >= n, r).otherwise(F.array().cast("array<struct<n:int,start:int,key:bigint>>")) for n, r in zip(sizes, runs, strict=True)]
    found = words(docs, "doc_id").select("doc_id", F.inline_outer(F.concat(*runs)))
    return found.join(_small(items, items.count()), ["n", "key"]).select("doc_id", "item_id", "start", F.lit(100).cast("bigint").alias("similarity"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start (word of the document), similarity (per cent, rounded down) of each document and item that it holds:
    the most similar window, of those the first. docs: doc_id, text; benchmark: item_id, text."""
    from brindle.llm.storage import materialize

    items = materialize(_shingled(benchmark, "item_id").select("item_id", F.col("__n").alias("n"), F.col("__h").alias("h")), "items").where("h IS NOT NULL")
    anchors = materialize(items.select("n", F.posexplode_outer("h").alias("q", "key")).where("key IS NOT NULL").distinct(), "item-shingles")
    n_anchors = anchors.count()

    shingled = _shingled(docs, "doc_id")
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), F.col("__n") - F.col("n")))
    if n_anchors <= SEND_ROWS:
        hits = shingled.select("doc_id", "__n", "__h", F.posexplode_outer("__h").alias("p", "key")).join(F.broadcast(anchors), "key")
        hits = hits.select("doc_id", "n", start.alias("start"), "__n", "__h")
    else:  # shingles are shuffled without the text that they are of; only texts with windows are joined to these
        places = shingled.select("doc_id", "__n", F.posexplode_outer("__h").alias("p", "key")).where("key IS NOT NULL")
        starts = materialize(places.join(anchors, "key").select("doc_id", "n", start.alias("start")).distinct(), "window-starts")
        hits = shingled.join(starts, "doc_id").select("doc_id", "n", "start", "__n", "__h")
    window = F.slice("__h", F.col("start") + 1, F.greatest(F.least(F.col("n"), F.col("__n")) - SIZE + 1, F.lit(1)))
    windows = hits.select("doc_id", "n", "start", window.alias("h")).withColumn("w", F.xxhash64("h"))
    windows = materialize(windows.groupBy("doc_id", "n", "start", "w").agg(F.first("h").alias("h")), "windows")

    different = windows.groupBy("n", "w").agg(F.first("h").alias("h"))
    prints = lambda df, *keep: df.select(*keep, _weighted(F.col("h")).alias("t")).withColumn("f", simhash(F.col("t")))
    found = materialize(prints(different, "n", "w"), "window-prints")
    known = materialize(prints(items, "item_id", "n"), "item-prints")
    index = known.select("item_id", "n", F.col("f").alias("g"), F.col("t").alias("u"), F.inline(_blocks(F.col("f"))))
    probes = found.select("n", "w", "f", "t", F.inline(_blocks(F.col("f"))))
    n_index = known.count() * (RADIUS + 1)
    pairs = probes.join(F.broadcast(index) if n_index <= 100_000 else index, ["n", "block", "bits"])
    # Of the blocks in which a pair agrees only the first counts, so that each pair is verified once.
    lowest = F.array_min(F.transform(F.filter(F.arrays_zip(_blocks(F.col("f")).alias("a"), _blocks(F.col("g")).alias("b")), lambda z: z["a"]["bits"] == z["b"]["bits"]), lambda z: z["a"]["block"]))
    pairs = pairs.where(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= RADIUS).where(F.col("block") == lowest)
    both = F.size(F.array_intersect("t", "u"))
    pairs = pairs.select("n", "w", "item_id", both.alias("both"), (F.size("t") + F.size("u")).alias("sizes"))
    union = F.col("sizes") - F.col("both")
    pairs = materialize(pairs.where(100 * F.col("both") >= PERCENT * union).select("n", "w", "item_id", F.floor(100 * F.col("both") / union).cast("long").alias("similarity")), "window-pairs")

    placed = windows.select("doc_id", "n", "start", "w").join(_small(pairs, pairs.count()), ["n", "w"])
    placed = placed.select("doc_id", "item_id", "start", "similarity").unionByName(_short(docs, benchmark))
    best = placed.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"))).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.before")).cast("long").alias("start"), F.col("best.similarity").alias("similarity"))
