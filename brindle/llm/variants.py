"""Operator 11: spelling variants of a corpus' words, by a variable-length gram index.

1. Words are counted in each task and added up.
2. Gram dictionary. Grams of QMIN to QMAX characters of the words, with marks before and after, are counted; those that occur more than
   total / ENTRIES times are frequent, so the dictionary has at most ENTRIES grams of a length, however many words there are.
3. Decomposition. The gram of a position is its shortest one that is not frequent (or the longest allowed); grams that lie within an
   earlier one are left out.
4. Affected grams. For each word and each place of one edit, the grams that it may take away are counted with the dictionary: those that hold the
   place, and those that a gram reaching over it may come to cover. The largest count is the word's bound.
5. Lists. If two words are one edit apart, at most that many grams of each are not shared, so among its bound + 1 rarest grams (one order for
   all words) there is a shared one. Only these go into lists. The edit lies to one side of a shared gram and all on the other side
   is equal, so a gram's list is divided by what is before it and by what is after it. If a gram occurs more than once, what is before the edit
   is shared from its first occurrence on, what is behind it up to its last: these two are listed. A word whose bound leaves no gram also goes
   to lists by its grams of QMIN characters, where it meets others like it.
6. Words that meet in a list are verified by their edit distance.

Defined results: null and empty texts have no words; texts of any length are taken whole. Repeated rows count each. In rows of a null doc_id no
character is deleted. Of near words of equal count the first in code-point order is the form. Further columns, whatever their names, are
ignored. An empty table gives no rows. Lists are keyed by 64-bit hashes: a collision is one more pair to verify.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.storage import materialize

QMIN, QMAX = 2, 4
ENTRIES, RARE = 20_000, 30  # frequent grams of a length at most; a gram of fewer occurrences is never frequent
FLUSH = 300_000  # words that a task counts before it sends them
RUN = re.compile("[A-Za-zÀ-ÿ]+")
BEGIN, END, ANY = "<", ">", "*"  # no letters
_P, _M = 0x9E3779B97F4A7C15, (1 << 61) - 1
_OPEN: dict[str, "Grams"] = {}


class Grams:
    """Grams of words under a dictionary: frequent (gram: occurrences)."""

    def __init__(self, frequent: dict[str, int], qmin: int = QMIN, qmax: int = QMAX):
        self.frequent, self.qmin, self.qmax = frequent, qmin, qmax
        #: grams that go on, also with one character unknown
        self.on = {g for g in frequent if len(g) < qmax}
        self.on |= {g[:k] + ANY + g[k + 1 :] for g in self.on for k in range(len(g))}

    def end(self, w: str, p: int) -> int:
        """Where the gram of position p ends; at most there, if w has an unknown character."""
        e, last = p + self.qmin, min(p + self.qmax, len(w))
        while e < last and w[p:e] in self.on:
            e += 1
        return e

    def of(self, w: str) -> tuple[list[int], list[int], list[int]]:
        """The end of each position's gram, and starts and ends of the grams that are in no earlier one."""
        ends = [self.end(w, p) for p in range(len(w) - self.qmin + 1)]
        starts, upto = [], []
        for p, e in enumerate(ends):
            if not upto or e > upto[-1]:
                starts.append(p)
                upto.append(e)
        return ends, starts, upto

    def affected(self, w: str, ends: list[int], starts: list[int], upto: list[int]) -> int:
        """The most grams of w that one edit between its marks takes away."""
        most, far = 0, self.qmax - 1
        for i in range(1, len(w)):
            # inserted before i: grams over the gap change, and a gram begins at the new character
            lo, t = bisect_right(upto, i), w[max(0, i - far) : i] + ANY + w[i : i + self.qmax]
            base = max(0, i - far)
            reach = self.end(t, i - base) + base - 1 if i - base + self.qmin <= len(t) else 0
            over = [p for p in range(base, i) if p < len(ends) and ends[p] > i]
            reach = max([reach, *[self.end(t, p - base) + base - 1 for p in over]])
            most = max(most, max(bisect_left(starts, i), bisect_right(upto, reach)) - lo)
            if i == len(w) - 1:
                break
            held = bisect_right(starts, i)
            t = w[base:i] + ANY + w[i + 1 : i + 1 + self.qmax]  # replaced
            reach = max(self.end(t, p - base) + base for p in [*over, i] if p - base + self.qmin <= len(t))
            most = max(most, max(held, bisect_right(upto, reach)) - lo)
            t = w[base:i] + w[i + 1 : i + 2 + self.qmax]  # deleted
            reach = max([self.end(t, p - base) + base + 1 for p in over if p - base + self.qmin <= len(t)], default=0)
            most = max(most, max(held, bisect_right(upto, reach)) - lo)
        return most

    def listed(self, word: str) -> tuple[list[int], bool]:
        """Keys of the lists that word goes to, and whether its bound left any gram."""
        w = BEGIN + word + END
        ends, starts, upto = self.of(w)
        bound = self.affected(w, ends, starts, upto)
        rank = sorted((self.frequent.get(w[p:e], 0), w[p:e], p, e) for p, e in zip(starts, upto, strict=True))
        last = rank[min(bound, len(rank) - 1)][:2]
        before, after = [0], [0]
        for a, b in zip(w, reversed(w), strict=True):
            before.append((before[-1] * _P + ord(a)) % _M)
            after.append((after[-1] * _P + ord(b)) % _M)
        first, final = {}, {}
        for count, gram, p, e in rank:
            if (count, gram) > last:
                break
            first.setdefault(gram, (p, e))
            final[gram] = p, e
        keys = [hash((self.qmax, 0, p, e, before[e])) for p, e in first.values()]
        keys += [hash((self.qmax, 1, len(w) - p, e - p, after[len(w) - p])) for p, e in final.values()]
        return keys, bound < len(rank)


def corpus_words(docs: DataFrame, least: int = 5, times: int = 3, every: int = 97) -> DataFrame:
    """word, n: lower-cased runs of letters of docs (doc_id, text), of which every so many (by a hash of document and run) lose a character."""

    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py()
                if not text:
                    continue
                head = None if i is None else zlib.crc32(b"%d:" % i)
                for run, k in Counter(RUN.findall(text.encode().lower().decode())).items():
                    if len(run) >= least:
                        if head is not None and not (h := zlib.crc32(run.encode(), head)) % every:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < least:
                                continue
                        seen[run] += k
                if len(seen) >= FLUSH:
                    yield rows(seen)
                    seen = Counter()
        if seen:
            yield rows(seen)

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def gram_dictionary(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX) -> dict[str, int]:
    """Frequent grams of words (word) and their occurrences: at most ENTRIES of each length reach the driver."""
    total = words.agg(F.sum(F.char_length("word") + 2)).first()[0] or 0
    rare = max(RARE, math.ceil(total / ENTRIES))
    w = F.concat(F.lit(BEGIN), "word", F.lit(END))
    of = lambda k: F.transform(F.sequence(F.lit(1), F.char_length(w) - k + 1), lambda p: F.substring(w, p, k))
    grams = F.concat(*map(of, range(qmin, qmax + 1)))
    found = words.select(F.explode(grams).alias("gram")).where(F.char_length("gram") >= qmin).groupBy("gram").count()
    return {r["gram"]: r["count"] for r in found.where(F.col("count") > rare).collect()}


def near_words(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX) -> DataFrame:
    """a, b, n_a, n_b: pairs of words (word, n; each once) with exactly one inserted, deleted or replaced code point between them, each pair once."""
    sent, key = words.sparkSession.sparkContext.broadcast(gram_dictionary(words, qmin, qmax)), uuid.uuid4().hex

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _OPEN:
            _OPEN.clear()
            _OPEN[key], _OPEN[key + "-"] = Grams(sent.value, qmin, qmax), Grams({}, qmin, qmin)
        grams, plain = _OPEN[key], _OPEN[key + "-"]
        for b in batches:
            at, keys = [], []
            for k, word in enumerate(b.column(0).to_pylist()):
                own, bounded = grams.listed(word)
                if not bounded:
                    own += plain.listed(word)[0]
                keys += own
                at += [k] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *b.take(pa.array(at, pa.int64())).columns], names=["key", "word", "n"])

    listed = materialize(words.select("word", "n").mapInArrow(index, "key bigint, word string, n bigint"), "variant-lists")
    # the lists of each length: a word meets those of its own, and those with one character more
    side = lambda x: (F.col("word").alias(x), F.col("n").alias(f"n_{x}"))
    size = F.char_length("word")
    a = listed.select(F.explode(F.array(F.struct(F.xxhash64("key", size).alias("list"), F.lit(0).alias("more")), F.struct(F.xxhash64("key", size + 1).alias("list"), F.lit(1).alias("more")))).alias("x"), *side("a"))
    b = listed.select(F.xxhash64("key", size).alias("list"), *side("b"))
    met = a.select("x.*", "a", "n_a").join(b, "list").where(((F.col("more") == 1) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "b", "n_a", "n_b").distinct()


def variant_groups(words: DataFrame, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n; each once): a word's form is its near word of largest count, if that is at least
    factor times its own; its root is where forms lead."""
    pairs = materialize(near_words(words), "variant-pairs")
    both = pairs.select("a", "b", "n_a", "n_b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b")))
    best = both.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("w"))).alias("first"), F.first("n_a").alias("n_a"))
    has = -F.col("first.n") >= factor * F.col("n_a")
    best = materialize(best.select("a", "n_near", F.when(has, F.col("first.w")).alias("form"), F.when(has, -F.col("first.n")).alias("form_n")), "variant-forms")

    # counts grow by the factor with each form, which bounds the length of chains; each round doubles the steps taken
    top = words.agg(F.max("n")).first()[0] or 1
    up = best.where("form IS NOT NULL").select("a", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(2.0, math.log(top, factor) + 1)))):
        further = up.select(F.col("a").alias("__a"), F.col("root").alias("__root"))
        up = materialize(up.join(further, up["root"] == further["__a"], "left").select("a", F.coalesce("__root", "root").alias("root")), "variant-roots")
    out = words.join(best, words["word"] == best["a"], "left").drop("a")
    out = out.join(up, out["word"] == up["a"], "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, least: int = 5, times: int = 3) -> DataFrame:
    """variant_groups of the words of docs (doc_id, text) with least code points and times occurrences."""
    return variant_groups(materialize(corpus_words(docs, least, times), "variant-words"))
