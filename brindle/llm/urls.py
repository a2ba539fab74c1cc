"""Operator 4: URL filters. DataFrame functions only.

Longest-prefix rules over host and path decide first. A URL that no rule fits is looked up in a list of canonical URLs: a blocked
Bloom filter (each key sets bits in one block of 8 words of 64 bits) lets nearly only listed URLs pass, and a hash join with the
list itself removes what passed wrongly. The filter is sent to executors while its size, known before it is built, stays below
FILTER_MB; beyond that the hash join takes all rows, which gives the same result.

Defined results: a null URL or one without :// has an empty host and path, fits no rule and is never listed. Repeated rows are
judged row by row. A repeated or null entry of the list counts once or not at all. Further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path prefix, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY, BLOCK_WORDS, FILTER_MB = 16, 8, 64


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host + path, and its verdict; null where none does. Rules are a short stated list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def canonical(host: Column, path: Column) -> Column:
    """Host without www., m. or a default port; path without . segments, doubled or final slashes and .html. Null without a host."""
    h = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^(www|m)\.", "")
    p = F.regexp_replace(F.regexp_replace(path, r"(/\.)+(/|$)", "/"), r"/+", "/")
    return F.when(h != "", F.concat(h, F.regexp_replace(p, r"(\.html?)?/?$", "")))


def _probe(url: Column, n_blocks: int) -> dict[str, Column]:
    """The block of a key and the bits it has in each word: 3 bits of the second hash choose a word, 6 a bit, five times."""
    h = F.xxhash64(url, F.lit(1))
    part = lambda shift, bits: F.call_function("shiftrightunsigned", h, F.lit(shift)).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    out = {"__block": F.pmod(F.xxhash64(url), F.lit(n_blocks))}
    for w in range(BLOCK_WORDS):
        bits = F.lit(0).cast("long")
        for k in range(5):
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), part(12 * k + 3, 6).cast("int"))
            bits = bits.bitwiseOR(F.when(part(12 * k, 3) == w, bit).otherwise(F.lit(0).cast("long")))
        out[f"__w{w}"] = bits
    return out


def bloom_filter(urls: DataFrame, n_blocks: int) -> DataFrame:
    """__block and its words f0.. f7, of the column __url."""
    keyed = urls.select(*[c.alias(k) for k, c in _probe(F.col("__url"), n_blocks).items()])
    return keyed.groupBy("__block").agg(*[F.bit_or(f"__w{w}").alias(f"f{w}") for w in range(BLOCK_WORDS)])


def listed(rows: DataFrame, urls: DataFrame) -> DataFrame:
    """Adds __listed to rows: whether their __url is in the column __url of urls. urls is distinct and without nulls."""
    n_keys = urls.count()
    n_blocks = max(1, -(-n_keys * BITS_PER_KEY // (64 * BLOCK_WORDS)))
    if n_blocks * BLOCK_WORDS * 8 > FILTER_MB << 20:
        maybe, rest = rows.where("__url IS NOT NULL"), rows.where("__url IS NULL")
    else:
        probes = _probe(F.col("__url"), n_blocks)
        seen = rows.withColumn("__block", probes["__block"]).join(F.broadcast(bloom_filter(urls, n_blocks)), "__block", "left")
        hit = F.lit(True)
        for w in range(BLOCK_WORDS):
            hit &= F.col(f"f{w}").bitwiseAND(probes[f"__w{w}"]) == probes[f"__w{w}"]
        seen = seen.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias("__maybe"))
        maybe, rest = (seen.where(c).drop("__maybe") for c in ("__maybe", "NOT __maybe"))
    # What the filter stops is not shuffled: as null keys of an outer join it would all meet in one task.
    exact = maybe.join(urls.select("__url", F.lit(True).alias("__hit")), "__url", "left")
    return exact.select(*rows.columns, F.coalesce("__hit", F.lit(False)).alias("__listed")).unionByName(rest.withColumn("__listed", F.lit(False)))


def url_filter(pages: DataFrame, urls: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed, canonical_url of every row of pages.

    urls: one column url of listed URLs. Without it the list is what the block rules block, so that other spellings of
    a blocked page are caught too.
    """
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.select("*", name.alias("rule"), verdict.alias("__verdict"), canonical(F.col("host"), F.col("path")).alias("__url"))
    if urls is None:
        known = parts.where("__verdict = 'block'").select("__url")
    else:
        known = urls.select(canonical(host(F.col("url")), path(F.col("url"))).alias("__url"))
    known = known.where(F.col("__url").isNotNull()).distinct()
    free = parts.withColumn("__full", F.col("__url")).withColumn("__url", F.when(F.col("rule").isNull(), F.col("__url")))
    out = listed(free, known)
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("__verdict", F.when(F.col("__listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("__listed").alias("listed"), F.col("__full").alias("canonical_url"),
    )
