"""Operator 10: n-gram Jaccard join, exact, by size-banded tiles with bitmap signatures.

1. Documents of equal shingle sets are one class, of which the smallest doc_id goes on.
2. Candidates. A set that links shares at least need = ceil(n num / den) of its n shingles with one other, so a document fewer of whose shingles occur
   elsewhere links with nothing. Each shingle goes once through a shuffle, in packed buckets of hash space (4 bytes, and about one for its document);
   a shingle repeated within a flush is known as shared there and sends one hash. Hashes are cut to 32 bits and those of the bucket: a collision can
   only keep a document. For those left, shingles are counted exactly and put in one order, rare ones first: two sets that link
   have the first shingle they share among their first n - need + 1, whatever the order. Each document is tied to the first one of each such shingle.
3. Candidates that hang together are dealt to tiles: up to TILE_DOCS documents and TILE_SHINGLES shingles, all of one size band where a
   group is larger. Each tile, and each pair of tiles whose bands can link, is one unit of work in which size and
   the bit counts of hashed bitmaps bound the overlap from above, and sorted arrays give it exactly. Pairs already connected
   in the unit are left out: components need no more.
4. Links give the components.

Defined results: null text or a text without words has no shingles and is its own component. Texts of any length are taken whole, one at a time.
Repeated rows are each returned; rows of a null doc_id stay unlinked. Further columns, whatever their names, are ignored. An empty table gives no
rows. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.components import connected_components
from brindle.llm.shingles import shingles
from brindle.llm.storage import materialize

FLUSH, BUCKET = 1 << 19, 1 << 19  # shingles that a task sends at once, and those of a bucket on average
TILE_DOCS, TILE_SHINGLES = 1024, 1 << 20
BITMAP_WORDS = 32  # of 64 bits
SEND_ROWS = 1_000_000  # of two longs, at most sent to all executors


def linked(inter, a, b, num: int, den: int):
    return den * inter >= num * (a + b - inter)


def bitmap(s: np.ndarray) -> np.ndarray:
    out = np.zeros(BITMAP_WORDS * 64, np.uint8)
    out[s % np.uint64(BITMAP_WORDS * 64)] = 1
    return np.packbits(out).view(np.uint64)


def joined(ids: list[int], sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect the documents as all links would. side: 0 and 1; where both occur, only pairs across are compared."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes, maps = sizes[order], np.stack([bitmap(sets[k]) for k in order])
    across = len(set(side.tolist())) > 1
    side, group, found = side[order], np.arange(len(order)), []
    for i in range(1, len(order)):
        first = np.searchsorted(sizes[:i], -(-num * sizes[i] // den))
        ok = group[first:i] != group[i]
        if across:
            ok &= side[first:i] != side[i]
        at = first + np.flatnonzero(ok)
        if not len(at):
            continue
        both = np.bitwise_count(maps[at] & maps[i]).sum(axis=1, dtype=np.int64)
        own, other = int(np.bitwise_count(maps[i]).sum()), np.bitwise_count(maps[at]).sum(axis=1, dtype=np.int64)
        most = np.minimum(sizes[i] - (own - both), sizes[at] - (other - both))
        at = at[linked(most, sizes[at], sizes[i], num, den)]
        for j in at.tolist():
            if group[j] != group[i]:
                a, b = sets[order[j]], sets[order[i]]
                inter = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                if linked(inter, len(a), len(b), num, den):
                    found.append((ids[order[i]], ids[order[j]]))
                    group[group == group[j]] = group[i]
    return found


def set_sizes(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (a 128-bit digest of the set; null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n, d = b.column(0), [], []
            for t in b.column(1):
                s = shingles(t.as_py(), size)
                n.append(len(s))
                d.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8").tolist() if len(s) else [None, None])
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), *[pa.array([x[k] for x in d], pa.int64()) for k in (0, 1)]], names=["doc_id", "n_shingles", "d1", "d2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint")


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SEND_ROWS else df


def _rows(names: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names[k], t) for k, t in kinds.items()], names=list(kinds))


def _pack(ids: np.ndarray) -> bytes:
    """Differences of ids, byte by byte of all and compressed: small ones take about a byte. 8 bytes before tell the number."""
    raw = np.diff(ids, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="lz4", asbytes=True)


def _unpack(raw: bytes) -> np.ndarray:
    plain = pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="lz4", asbytes=True)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(8, -1).T).view(np.int64).ravel())


def _repeated(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values of h occur more than once, and these values."""
    order = np.argsort(h)
    at = np.flatnonzero(np.concatenate(([True], h[order[1:]] != h[order[:-1]]))) if len(h) else np.zeros(0, np.int64)
    long = np.diff(np.append(at, len(h)))
    out = np.zeros(len(h), bool)
    out[order] = np.repeat(long > 1, long)
    return out, h[order[at[long > 1]]]


_SENT = {"bucket": pa.int64(), "docs": pa.binary(), "hashes": pa.binary(), "common": pa.binary(), "doc": pa.int64(), "n": pa.int64()}


def _flushed(ids: list[int], sets: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of buckets: documents and hashes that occur once here, and hashes that are common here. Rows doc, n: common shingles of a document."""
    h, doc = np.concatenate(sets), np.repeat(np.array(ids, np.int64), [len(s) for s in sets])
    again, common = _repeated(h)
    which, times = np.unique(doc[again], return_counts=True)
    place = lambda x: (x >> np.uint64(64 - bits)).astype(np.int64)
    short = lambda x: (x >> np.uint64(32 - bits)).astype(np.uint32)
    h, doc = h[~again], doc[~again]
    order = np.argsort(place(h), kind="stable")
    h, doc = h[order], doc[order]
    mine, theirs = place(h), place(common)
    buckets = np.unique(np.concatenate((mine, theirs)))
    cut, cut_common = np.append(np.searchsorted(mine, buckets), len(h)), np.append(np.searchsorted(theirs, buckets), len(common))
    h, common, span = short(h), short(common), range(len(buckets))
    yield _rows({
        "bucket": buckets, "docs": [_pack(doc[cut[k]:cut[k + 1]]) for k in span], "hashes": [h[cut[k]:cut[k + 1]].tobytes() for k in span],
        "common": [common[cut_common[k]:cut_common[k + 1]].tobytes() for k in span], "doc": [None] * len(buckets), "n": [None] * len(buckets)}, _SENT)
    none = [None] * len(which)
    yield _rows({"bucket": which % (1 << bits), "docs": none, "hashes": none, "common": none, "doc": which, "n": times}, _SENT)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket. doc, n: that many shingles of the document are shared. Rows doc, n made before pass."""
    at, parts = None, []
    kinds = {"doc": pa.int64(), "n": pa.int64()}

    def done() -> pa.RecordBatch:
        docs, hashes, common = (np.concatenate(x) for x in zip(*parts, strict=True))
        again, _ = _repeated(np.concatenate((hashes, common)))
        which, times = np.unique(docs[again[: len(docs)]], return_counts=True)
        return _rows({"doc": which, "n": times}, kinds)

    for b in batches:
        made = b.column(4).is_valid()
        yield b.filter(made).select(["doc", "n"])
        b = b.filter(pa.compute.invert(made))
        for bucket, *raw in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3), strict=True):
            if bucket != at:
                if parts:
                    yield done()
                at, parts = bucket, []
            docs, hashes, common = (x.as_py() for x in raw)
            parts.append((_unpack(docs), np.frombuffer(hashes, np.uint32), np.frombuffer(common, np.uint32)))
    if parts:
        yield done()
    pa.default_memory_pool().release_unused()


def candidates(docs: DataFrame, sizes: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Edges u, v among docs (doc_id, text; ids not null): documents that link hang together. sizes: doc_id, n_shingles of docs."""
    total = sizes.agg(F.sum("n_shingles")).first()[0] or 0
    bits = max(1, math.ceil(math.log2(max(1, total / BUCKET))))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, held = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingles(t.as_py(), size)
                if len(s):
                    ids.append(i)
                    sets.append(s)
                    held += len(s)
                if held >= FLUSH:
                    yield from _flushed(ids, sets, bits)
                    ids, sets, held = [], [], 0
        if held:
            yield from _flushed(ids, sets, bits)
        pa.default_memory_pool().release_unused()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingles(t.as_py(), size)
                n = len(s)
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.full(n, i, np.int64)), pa.array(np.full(n, -(-num * n // den), np.int64))], names=["h", "doc", "need"])

    packed = docs.mapInArrow(sent, "bucket bigint, docs binary, hashes binary, common binary, doc bigint, n bigint")
    counted = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "doc bigint, n bigint").groupBy("doc").agg(F.sum("n").alias("n"))
    able = sizes.join(counted, sizes["doc_id"] == counted["doc"]).where(den * F.col("n") >= num * F.col("n_shingles"))
    able = materialize(able.select("doc_id").distinct(), "jaccard-able")
    left = docs.join(_small(able, able.count()), "doc_id", "left_semi")
    found = materialize(left.mapInArrow(pairs, "h bigint, doc bigint, need bigint"), "jaccard-shingles")
    often = found.groupBy("h").agg(F.count("*").alias("often")).where("often > 1")
    whole = Window.partitionBy("doc")
    first = found.join(often, "h").select(
        "h", "doc", F.row_number().over(whole.orderBy("often", "h")).alias("place"), F.count("*").over(whole).alias("shared"), F.min("need").over(whole).alias("need"))
    first = materialize(first.where("place <= shared - need + 1").select("h", "doc"), "jaccard-firsts")
    least = first.groupBy("h").agg(F.min("doc").alias("v"))
    return first.join(least, "h").where("doc <> v").select(F.col("doc").alias("u"), "v")


def jaccard_components(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text): sets link when den * intersection >= num * union."""
    docs = docs.select("doc_id", "text")
    known = materialize(set_sizes(docs, size), "jaccard-sets")
    classes = known.where("d1 IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    known = materialize(known.join(classes, ["d1", "d2"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "jaccard-classes")
    out = known.where("rep <> doc_id OR n_shingles = 0").select("doc_id")
    alone = docs.where("doc_id IS NOT NULL").join(_small(out, out.count()), "doc_id", "left_anti")

    edges = candidates(alone, known.where("rep = doc_id AND n_shingles > 0").select("doc_id", "n_shingles"), size, num, den)
    near = connected_components(edges)

    band = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(den / num)).cast("int")
    sized = known.where("rep = doc_id").select("doc_id", "n_shingles").join(near.withColumnRenamed("node", "doc_id"), "doc_id")
    sized = materialize(sized.select("doc_id", "component", "n_shingles", band.alias("band")), "jaccard-candidates")
    parts = lambda: F.greatest(F.ceil(F.count("*") / TILE_DOCS), F.ceil(F.sum("n_shingles") / TILE_SHINGLES)).cast("int")
    large = sized.groupBy("component").agg(parts().alias("parts")).where("parts > 1").select("component")
    large = materialize(sized.join(large, "component").groupBy("component", "band").agg(parts().alias("parts")), "jaccard-bands")
    n_large = large.count()
    beside = lambda by, name: _small(large.select("component", (F.col("band") - by).alias("band"), F.col("parts").alias(name)), n_large)
    dealt = sized.join(beside(0, "own"), ["component", "band"], "left").join(beside(1, "above"), ["component", "band"], "left").join(beside(-1, "below"), ["component", "band"], "left")
    mine = F.pmod(F.xxhash64("doc_id"), F.col("own")).cast("int")
    unit = lambda b, s, o, side: F.struct(b.cast("int").alias("low"), s.cast("int").alias("a"), o.cast("int").alias("b"), F.lit(side[0]).alias("kind"), F.lit(side[1]).alias("side"))
    span = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    nought = F.lit(0)
    dealt = dealt.withColumn("mine", mine).withColumn("unit", F.when(F.col("own").isNull(), F.array(unit(F.lit(-1), nought, nought, (0, 0)))).otherwise(F.concat(
        F.transform(span(F.col("own")), lambda x: F.struct(F.col("band").alias("low"), F.least(x, F.col("mine")).alias("a"), F.greatest(x, F.col("mine")).alias("b"), F.lit(0).alias("kind"), (F.col("mine") > x).cast("int").alias("side"))),
        F.transform(span(F.coalesce("above", nought)), lambda y: unit(F.col("band"), F.col("mine"), y, (1, 0))),
        F.transform(span(F.coalesce("below", nought)), lambda y: unit(F.col("band") - 1, y, F.col("mine"), (1, 1))))))
    dealt = materialize(dealt.select("doc_id", "component", "unit"), "jaccard-tiles")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                s = [shingles(t.as_py(), size).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(s, pa.binary())], names=["doc_id", "component", "unit", "shingles"])

    kind = "array<struct<low:int,a:int,b:int,kind:int,side:int>>"
    full = docs.join(_small(dealt, dealt.count()), "doc_id").select("doc_id", "text", "component", "unit")
    full = full.mapInArrow(sets, f"doc_id bigint, component bigint, unit {kind}, shingles binary")
    full = full.select("doc_id", "component", F.explode("unit").alias("unit"), "shingles").select("doc_id", "component", "unit.*", "shingles")
    tile = ["component", "low", "kind", "a", "b"]
    full = full.repartition(*tile).sortWithinPartitions(*tile)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, arrays, side = None, [], [], []

        def done() -> pa.RecordBatch:
            found = joined(ids, arrays, np.array(side), num, den)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in (*tile, "doc_id", "side", "shingles")]
            *names, docs_, sides, raw = cols
            for name, doc, which, s in zip(zip(*[c.to_pylist() for c in names], strict=True), docs_.to_pylist(), sides.to_pylist(), raw, strict=True):
                if name != at:
                    if len(ids) > 1:
                        yield done()
                    at, ids, arrays, side = name, [], [], []
                ids.append(doc)
                arrays.append(np.frombuffer(s.as_py(), np.uint64))
                side.append(which)
        if len(ids) > 1:
            yield done()

    found = connected_components(full.mapInArrow(links, "u bigint, v bigint"))
    out = known.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "rep")).alias("component_id"))
