"""Operator 8: removal of bytes within 50-byte strings that a document of smaller doc_id holds too.

1. Copies of a whole text lose all bytes to the smallest doc_id; only that one goes on.
2. Every 50-byte string contains an anchor (a minimizer of q-grams) chosen by the string alone; an anchor's context is all 50-byte
   strings that contain it. Anchors are sorted by hash. Those of one document are done with; so are those whose contexts are all the same, as
   their strings all have the same smallest doc_id.
3. Different contexts of an anchor are merged where equal, and the suffixes that begin in them are put in order by deep-shallow sorting
   to a depth of 50 bytes, suffixes at the same distance from the anchor together. Equal neighbours share a smallest doc_id.
4. Bytes of strings with a smaller doc_id go; overlaps are united.

Hot anchors are split. A task that meets a context many times sends on two rows of it under the anchor's hash and deals the others out by document. Of an
anchor with more than HOT different contexts, these are dealt to tasks by their hash, sorted there, and the smallest doc_ids of the tasks' classes
of equal strings are merged. No task holds more than a group of about GROUP contexts and LIMIT rows.

All is judged on the input. Defined results: null text is empty; texts of under 50 bytes lose nothing; texts of any length are taken whole, one in
memory at a time. doc_id identifies the text: rows that repeat it must repeat the text, and are each returned. A null doc_id is neither
smaller nor larger than any. Further columns, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.anchors import MATCH, SPAN, contexts
from brindle.llm.storage import discard, materialize
from brindle.llm.suffix_sort import sorted_suffixes

SEND_ROWS = 1_000_000  # of one long, at most sent to all executors
OFTEN = 16  # rows of one context in a part of a task, from which on they are dealt out
LIMIT = 1 << 20  # rows of an anchor that wait to be judged together
GROUP, HOT = 10_000, 20_000  # contexts sorted at once; different contexts of an anchor that one task sorts
PARTED, DEALT = 1, 2  # what a row says of its context: others were dealt out, or it is one of these
_U32 = 0xFFFFFFFF


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], names=schema.split())


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, c (the anchor's and its context's hash), doc_id, place: position * 512 + what it says * 128 + length of the context."""
    for b in batches:
        for k in range(0, b.num_rows, 256):
            part, found = b.slice(k, 256), []
            for t in part.column(1):
                found.append(contexts(np.frombuffer(_bytes(t.as_py()), np.uint8)))
            h, c = (np.concatenate([x[j] for x in found]).view(np.int64) for j in (1, 2))
            place = np.concatenate([x[0] * 512 + x[3] for x in found])
            doc = np.repeat(part.column(0).to_numpy(), [len(x[0]) for x in found])
            order = np.argsort(c, kind="stable")
            starts = np.flatnonzero(np.concatenate(([True], c[order][1:] != c[order][:-1]))) if len(c) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, len(c)))
            for s, n in zip(starts[sizes >= OFTEN].tolist(), sizes[sizes >= OFTEN].tolist(), strict=True):
                rows = order[s : s + n]
                low, high = rows[doc[rows].argmin()], rows[doc[rows].argmax()]
                if doc[low] != doc[high]:
                    place[rows] += 128 * DEALT
                    place[[low, high]] += 128 * (PARTED - DEALT)
            yield _batch("h c doc_id place", h, c, doc, place)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by h, c and doc_id. Of anchors in several documents: all rows, done = false, if they have different contexts; else the rows that
    are not of the smallest doc_id, done = true."""
    wait = [np.zeros(0, np.int64)] * 4
    flowing = None  # an anchor of more than LIMIT rows: sorting its contexts is right for any anchor

    def judge(h, c, doc, place) -> pa.RecordBatch:
        says = (place >> 7) & 3
        passed = (says == DEALT) | (h == flowing if flowing is not None else False)
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        each = np.diff(np.append(starts, len(h)))
        own = ~passed
        big, small = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        least = np.minimum.reduceat(np.where(own, doc, big), starts)
        shared = least < np.maximum.reduceat(np.where(own, doc, small), starts)
        alike = np.minimum.reduceat(np.where(own, c, big), starts) == np.maximum.reduceat(np.where(own, c, small), starts)
        parted = np.logical_or.reduceat(own & (says == PARTED), starts)
        alike &= ~parted
        shared, alike, least = (np.repeat(x, each) for x in (shared | parted, alike, least))
        done = own & shared & alike & (doc != least) & (place & 127 >= MATCH)
        keep = done | passed | (own & shared & ~alike)
        return _batch("h c doc_id place done", h[keep], c[keep], doc[keep], place[keep], done[keep])

    for b in batches:
        rows = [np.concatenate((w, x.to_numpy())) for w, x in zip(wait, b.columns, strict=True)]
        h = rows[0]
        if not len(h):
            continue
        end = int(np.searchsorted(h, h[-1]))
        if len(h) - end > LIMIT:
            flowing = h[-1]
        if flowing is not None and h[-1] == flowing:
            end = len(h)
        wait = [x[end:] for x in rows]
        if end:
            yield judge(*[x[:end] for x in rows])
    if len(wait[0]):
        yield judge(*wait)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts that a document stands for. g: by what they are dealt to tasks."""
    for b in batches:
        for k in range(0, b.num_rows, 64):
            part = b.slice(k, 64)
            out: list[list] = [[] for _ in range(7)]
            for doc, text, found in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), strict=True):
                data = _bytes(text.as_py())
                for x in found:
                    at = x["place"] >> 9
                    start = max(0, at - SPAN + 1)
                    g = x["h"] if x["salts"] is None else xxhash.xxh3_64_intdigest(b"%d %d" % (x["h"], x["c"] % x["salts"])) - (1 << 63)
                    for col, v in zip(out, (g, x["h"], x["c"], doc, x["most"], (at - start) * 2 + (x["salts"] is not None), data[start : at + MATCH]), strict=True):
                        col.append(v)
            yield _batch("g h c doc_id most before context", *[pa.array(x, pa.int64()) for x in out[:6]], pa.array(out[6], pa.binary()))


_RANGES = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32()), ("least", pa.int64())]))
_MEMBERS = pa.list_(pa.struct([("c", pa.int64()), ("low", pa.int32())]))
RANGES, MEMBERS = "array<struct<low:int,high:int,least:bigint>>", "array<struct<c:bigint,low:int>>"


def _first_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by g. By context h, c: ranges of places, low to high, with the smallest doc_id of the strings that begin there, where that
    is smaller than the largest doc_id with the context. Of anchors that were split: the class's d (a hash), its members and smallest doc_id."""
    held: list[list] = [[] for _ in range(7)]

    def solve(n: int) -> Iterator[pa.RecordBatch]:
        g, h, c, doc, most, before = (np.array(x[:n], np.int64) for x in held[:6])
        raw = held[6][:n]
        for col in held:
            del col[:n]
        split, before = before & 1, before >> 1
        data = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.array([len(x) for x in raw])
        count = np.maximum(sizes - MATCH + 1, 0)
        owner = np.repeat(np.arange(n), count)
        if not len(owner):
            return
        low = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        starts = np.repeat(np.cumsum(sizes) - sizes, count) + low
        run = np.cumsum(np.concatenate(([False], (g[1:] != g[:-1]) | (h[1:] != h[:-1]))))
        order, begins = sorted_suffixes(data, starts, MATCH, run[owner] * 64 + before[owner] - low)
        edge = np.flatnonzero(begins)
        by_class = np.minimum.reduceat(doc[owner[order]], edge)
        least = np.empty(len(owner), np.int64)
        least[order] = np.repeat(by_class, np.diff(np.append(edge, len(order))))
        first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (least[1:] != least[:-1]))))
        last = np.append(first[1:], len(owner)) - 1
        keep = (split[owner[first]] == 0) & (least[first] < most[owner[first]])
        first, last = first[keep], last[keep]
        at = np.flatnonzero(np.concatenate(([True], owner[first][1:] != owner[first][:-1]))) if len(first) else first
        ranges = pa.StructArray.from_arrays([low[first].astype(np.int32), low[last].astype(np.int32), least[first]], names=["low", "high", "least"])
        ranges = pa.ListArray.from_arrays(pa.array(np.append(at, len(first)).astype(np.int32)), ranges)
        who = owner[first[at]]
        yield _batch("h c ranges least d members", h[who], c[who], ranges, *[pa.nulls(len(at), t) for t in (pa.int64(), pa.int64(), _MEMBERS)])
        if not split.any():
            return
        rows = []
        for a, z, doc_ in zip(edge.tolist(), np.append(edge[1:], len(order)).tolist(), by_class.tolist(), strict=True):
            x = order[a]
            if split[owner[x]]:
                d = xxhash.xxh3_64_intdigest(data[starts[x] : starts[x] + MATCH].tobytes()) - (1 << 63)
                rows.append((h[owner[x]], doc_, d, [{"c": c[owner[y]], "low": low[y]} for y in order[a:z]]))
        if rows:
            hs, leasts, ds, members = zip(*rows, strict=True)
            yield _batch("h c ranges least d members", pa.array(hs, pa.int64()), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), _RANGES), pa.array(leasts, pa.int64()), pa.array(ds, pa.int64()), pa.array(members, _MEMBERS))

    for b in batches:
        for col, got in zip(held, b.columns, strict=True):
            col += got.to_pylist()
        while len(held[0]) > GROUP:
            n = len(held[0])
            while n and held[0][n - 1] == held[0][-1]:  # the last one's contexts may go on
                n -= 1
            if not n:
                break
            yield from solve(n)
    if held[0]:
        yield from solve(len(held[0]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 128):
            part, out = b.slice(k, 128), []
            for text, copy, spans in zip(part.column(1), part.column(2).to_pylist(), part.column(3), strict=True):
                data = _bytes(text.as_py())
                n, kept, removed, runs = len(data), hashlib.sha256(), 0, 0
                if copy and n >= MATCH:
                    removed, runs = n, 1
                elif spans.is_valid and not copy:
                    x = np.sort(spans.values.to_numpy())
                    s, e = x >> 8, np.maximum.accumulate((x >> 8) + (x & 255))
                    first = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
                    cuts = [0, *np.stack((s[first], e[np.append(first[1:], len(s)) - 1]), axis=1).ravel().tolist(), n]
                    for a, z in zip(cuts[::2], cuts[1::2], strict=True):
                        kept.update(data[a:z])
                        removed -= z - a
                    removed, runs = removed + n, len(first)
                else:
                    kept.update(data)
                out.append((n, removed, runs, kept.hexdigest()))
            *numbers, digest = zip(*out, strict=True)
            yield _batch("doc_id n_bytes n_removed n_spans kept_sha256", part.column(0), *[pa.array(x, pa.int64()) for x in numbers], pa.array(digest, pa.string()))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SEND_ROWS else df


def spans(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """doc_id, spans: the removed strings as start * 256 + length, overlapping as they may, of docs that are not in copies (doc_id)."""
    own = docs.where("doc_id IS NOT NULL AND octet_length(text) >= 50").join(_small(copies, copies.count()), "doc_id", "left_anti")
    kind = "h bigint, c bigint, doc_id bigint, place bigint"
    rows = own.mapInArrow(_anchor_rows, kind)
    dealt = F.when(F.expr(f"(place >> 7) & 3 = {DEALT}"), F.xxhash64("h", "doc_id")).otherwise(F.col("h"))
    rows = rows.repartition(dealt).sortWithinPartitions("h", "c", "doc_id")
    shared = materialize(rows.mapInArrow(_judged, f"{kind}, done boolean"), "anchors")
    different = shared.where("NOT done").select("h", "c", "doc_id", "place")
    stands = different.groupBy("h", "c").agg(F.min("doc_id").alias("doc_id"), F.min_by("place", "doc_id").alias("place"), F.max("doc_id").alias("most"))
    stands = materialize(stands, "contexts")
    hot = stands.groupBy("h").agg(F.count("*").alias("n")).where(f"n > {HOT}").select("h", F.ceil(F.col("n") / HOT).alias("salts"))
    hot = materialize(hot, "hot-anchors")
    n_hot = hot.count()
    by_doc = stands.join(_small(hot, n_hot), "h", "left").groupBy("doc_id").agg(F.collect_list(F.struct("h", "c", "place", "most", "salts")).alias("found"))
    found = own.join(by_doc, "doc_id").select("doc_id", "text", "found")
    found = found.mapInArrow(_contexts, "g bigint, h bigint, c bigint, doc_id bigint, most bigint, before bigint, context binary")
    first = found.repartition("g").sortWithinPartitions("g").mapInArrow(
        _first_docs, f"h bigint, c bigint, ranges {RANGES}, least bigint, d bigint, members {MEMBERS}")
    first = materialize(first, "first-docs")
    discard(stands)
    known = first.where("d IS NULL").select("h", "c", "ranges")
    if n_hot:
        classes = first.where("d IS NOT NULL").select("h", "d", "least", "members")
        merged = classes.groupBy("h", "d").agg(F.min("least").alias("least"))
        members = classes.drop("least").join(merged, ["h", "d"]).select("h", "least", F.inline("members"))
        places = members.groupBy("h", "c").agg(F.collect_list(F.struct("low", F.col("low").alias("high"), "least")).alias("ranges"))  # at most SPAN of a context
        known = known.unionByName(places)
    start = f"shiftright(place, 9) - least(shiftright(place, 9), {SPAN - 1})"
    hits = different.join(known, ["h", "c"]).selectExpr(
        "doc_id", f"transform(filter(ranges, x -> x.least < doc_id), x -> ({start} + x.low) * 256 + (x.high - x.low + {MATCH})) AS spans").where("size(spans) > 0")
    whole = shared.where("done").selectExpr("doc_id", f"array(({start}) * 256 + (place & 127)) AS spans")
    out = materialize(whole.unionByName(hits).groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    discard(shared)
    discard(first)
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    digests = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("d1"), F.xxhash64("text", F.lit(1)).alias("d2"))
    classes = digests.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last")
    copies = materialize(digests.join(classes, ["d1", "d2"]).where("doc_id > rep").select("doc_id").distinct(), "copies")
    found = spans(docs, copies)
    marks = found.select("doc_id", F.lit(False).alias("copy"), "spans").unionByName(
        copies.select("doc_id", F.lit(True).alias("copy"), F.lit(None).cast("array<bigint>").alias("spans")))
    return docs.join(marks, "doc_id", "left").select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "spans").mapInArrow(
        _cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
