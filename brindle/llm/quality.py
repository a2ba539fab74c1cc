"""Operator 3: quality rules with thresholds learnt from quantile sketches. DataFrame functions only.

Every document gets integer metrics (per ten thousand words, lines or characters; lengths of words in thousandths). A sketch is a histogram over
integer buckets of bounded relative width, kept per language and source: plain counts, so sketches merge by
addition, in any order, and a lost task changes nothing. Zeros are counted apart: of a metric that is mostly zero the quantiles are those
of the other values. To a language's sketch PRIOR values are added that lie as those of the whole table, and to a group's PRIOR values that lie as its
language's: a group of few documents is judged as its language is, and the more it has the more by its own. From each sketch come the median and the
quantiles on both sides of it (1 / TAIL of the values lie beyond each); a fence lies STEPS times as far from the median as the quantile, and
at least one bucket beyond the quantile. Values are compared with fences by their buckets. No figure in it is a cutoff: where a group's values lie close together its fences
do, too, but around them. Documents that fail the base rules take no part in the sketches, as the fences are those of what is normal in a group. The fences are joined to the
documents of their group and decide, besides the base rules, what is kept.

Defined results: null text counts as empty (no words: base_failed). Null language or source is a group of its own.
Texts of any length are judged whole. Repeated rows are judged row by row, each counts in the sketches; values in a fence's bucket are inside, so a group of like
documents is kept whole. An empty table gives no rows. Columns of the input beyond doc_id, text, lang and source are carried by
quality_rules() and ignored by quality_stats(); their names may clash with anything made here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: metric: whether a low value is a fault too
METRICS = {"symbols": False, "word_length": True, "dup_lines": False, "repeats": False}
TAIL, STEPS = 10, 4  # 1 / TAIL of a group's values lie beyond each quantile, room for as much junk; fences lie STEPS times as far from the median
PRIOR = 50  # values as of the language (or the whole table) that each sketch has besides its own: five beyond each quantile
UNIT = 10_000  # a value's weight: prior values are dealt to buckets in parts of it
BROADCAST_GROUPS = 50_000  # rows of fences, under 10 MB
_NONE = "\u0001"  # stands for a null language or source


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds __words (array of words) and __t (the text, null as empty)."""
    df = df.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    return df.withColumn("__words", F.array_remove(F.split("__t", SPACE), ""))


def quality_stats(docs: DataFrame, keep: list[Column] | None = None) -> DataFrame:
    """One row per document: what `keep` selects, then __lang, __source, n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, base_failed and the metrics m_*.

    A word belongs to a repeat if a window of 5 words that covers it occurs twice or more in the text. Windows are compared by
    64-bit hashes within one text.
    """
    keep = keep or [F.col("doc_id")]
    key = lambda c: F.coalesce(F.col(c), F.lit(_NONE)).alias(f"__{c}")
    df = with_words(docs.select(F.struct(*keep).alias("__keep"), key("lang"), key("source"), F.col("text").alias("__text")), "__text")
    n = F.size("__words")
    word = lambda i: F.get("__words", i)
    df = df.select(
        "__keep", "__lang", "__source", n.cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
        F.when(n >= 6, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2), word(i + 3), word(i + 4)))).alias("__h"),
    )
    lines = F.size("__lines").cast("long")
    df = df.withColumns({"n_lines": lines, "n_dup_lines": lines - F.size(F.array_distinct("__lines"))}).drop("__lines")
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    df = df.withColumn("__s", F.when(repeats, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("p")))))).drop("__h")
    at = lambda k: F.get("__s", k)["h"]
    df = df.withColumn("__p", F.when(F.col("__s").isNotNull(), F.sort_array(F.transform(
        F.filter("__s", lambda x, k: ((k > 0) & (at(k - 1) == x["h"])) | F.coalesce(at(k + 1) == x["h"], F.lit(False))), lambda x: x["p"])))).drop("__s")
    covered = F.aggregate(
        "__p", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + 5 - F.greatest(p, a["end"])).alias("n"), (p + 5).alias("end")), lambda a: a["n"])
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__p")
    share = lambda a, b, of: F.floor(of * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("long")
    df = df.withColumns({
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        "m_symbols": share("n_symbols", "n_words", 10_000), "m_word_length": share("word_chars", "n_words", 1000),
        "m_dup_lines": share("n_dup_lines", "n_lines", 10_000), "m_repeats": share("n_repeat_words", "n_words", 10_000),
    })
    # Through a generator Spark pushes no condition on these columns: below the projections it would compute them once for each use.
    made = F.struct(*[c for c in df.columns if c not in ("__keep", "__t", "__words")])
    return df.select("__keep.*", F.inline_outer(F.array(made)))


def bucket(value: Column) -> Column:
    """The value with all but its six highest bits cleared: exact below 64, within 1/32 above."""
    low = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def width(edge: Column) -> Column:
    """The width of the bucket that begins at edge."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(edge)) - 6, F.lit(0)))


def quantile_sketches(stats: DataFrame) -> DataFrame:
    """Counts by __lang, __source, metric and bucket, of what passes the base rules: a table as small as the number of groups. Groups without such documents
    have a row of a null metric."""
    rows = F.when(~F.col("base_failed"), F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(f"m_{m}")).alias("bucket")) for m in METRICS]))
    long = stats.select("__lang", "__source", F.inline_outer(rows))
    return long.groupBy("__lang", "__source", "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def mixed(own: DataFrame, of: DataFrame, keys: list[str], shared: list[str]) -> DataFrame:
    """keys, metric, bucket, n: own counts (keys, metric, bucket, n) in UNITs, and PRIOR values dealt as those of `of` (shared, metric, bucket, n). own has a row for
    each key, of a null metric if it has no values."""
    n = F.col("n").cast("decimal(38,0)")
    total = of.groupBy(*shared, "metric").agg(F.sum("n").alias("total"))
    prior = of.join(total, [*shared, "metric"]).select(*shared, "metric", "bucket", F.expr(f"cast({PRIOR * UNIT} * cast(n as decimal(38,0)) div total as bigint)").alias("n"))
    groups = own.select(*keys).distinct()
    added = groups.join(prior, shared) if shared else groups.crossJoin(F.broadcast(prior))  # the whole table's buckets: some hundreds
    both = own.where("metric IS NOT NULL").select(*keys, "metric", "bucket", (n * UNIT).cast("long").alias("n")).unionByName(added.select(*keys, "metric", "bucket", "n"))
    return both.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame) -> DataFrame:
    """By __lang and __source, low_<metric> and high_<metric>: buckets of the outermost values that are inside; null where the table has no values."""
    groups, seen = ["__lang", "__source"], F.col("metric").isNotNull() & ((F.col("bucket") > 0) | (F.col("metric") == "word_length"))
    own = sketches.select(*groups, F.when(seen, F.col("metric")).alias("metric"), "bucket", "n")
    by_lang = own.groupBy("__lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    whole = by_lang.where("metric IS NOT NULL").groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    found = mixed(own, mixed(by_lang, whole, ["__lang"], []), groups, ["__lang"])
    listed = found.groupBy(*groups, "metric").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("b"))
    reached = lambda a, x, num, den: den * (a["seen"] + x["n"]) >= num * a["total"]
    cuts = {"low": (1, TAIL), "mid": (1, 2), "high": (TAIL - 1, TAIL)}
    step = lambda a, x: F.struct(
        (a["seen"] + x["n"]).alias("seen"), a["total"].alias("total"), *[F.coalesce(a[q], F.when(reached(a, x, *of), x["bucket"])).alias(q) for q, of in cuts.items()])  # noqa: B023
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.col("total").alias("total"), *[F.lit(None).cast("long").alias(q) for q in cuts])
    q = listed.select(*groups, "metric", F.aggregate("b", start, step).alias("q"))
    low = F.least(F.col("q.mid") - STEPS * (F.col("q.mid") - F.col("q.low")), F.col("q.low") - width(F.col("q.low")))
    high = F.greatest(F.col("q.mid") + STEPS * (F.col("q.high") - F.col("q.mid")), F.col("q.high") + width(F.col("q.high")))
    wide = q.groupBy(*groups).agg(*[F.max(F.when(F.col("metric") == m, side)).alias(f"{name}_{m}") for m, both in METRICS.items() for name, side in (("low", low), ("high", high)) if both or name == "high"])
    return sketches.select(*groups).distinct().join(wide, groups, "left")


def judge(stats: DataFrame, limits: DataFrame, n_groups: int) -> DataFrame:
    """Adds kept. The fences are sent to all executors only while they are few; beyond, both sides are shuffled by group
    and Spark splits a group that is hot."""
    limits = F.broadcast(limits) if n_groups <= BROADCAST_GROUPS else limits
    inside = F.lit(True)
    for m, low in METRICS.items():
        inside &= F.coalesce(bucket(F.col(f"m_{m}")) <= F.col(f"high_{m}"), F.lit(True))
        if low:
            inside &= F.coalesce(bucket(F.col(f"m_{m}")) >= F.col(f"low_{m}"), F.lit(True))
    joined = stats.join(limits, ["__lang", "__source"], "left").withColumn("kept", ~F.col("base_failed") & inside)
    return joined.drop(*limits.columns)


def judged(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """What keep selects of each row of docs, its statistics and the verdict. Statistics are computed once and written, with keep but without
    texts unless keep has them: the sketches and the verdict read them."""
    from brindle.llm.storage import materialize

    stats = materialize(quality_stats(docs, keep), "quality-stats")
    sketches = materialize(quantile_sketches(stats), "quality-sketches")
    return judge(stats, fences(sketches), sketches.select("__lang", "__source").distinct().count())


def quality_rules(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their own columns. The written statistics carry the rows, so no text is read twice or shuffled."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("__row")
    return judged(docs, [row]).where("kept").select("__row.*")
