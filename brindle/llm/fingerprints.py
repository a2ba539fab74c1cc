"""Operator 13: document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

Each word shingle is hashed once. The hash's upper bits choose one of BINS bins, which keeps its least hash. An empty bin takes the value of a
bin that is not: bins are asked in an order that is random for each empty bin and the same for all texts, so donors are chosen alike wherever
the same bins are filled. Of each bin, BITS low-order bits of its value, mixed with the bin's number, are packed. Two unrelated bins agree in
these by chance once in 2^BITS; likeness() takes that off.

Each document is compared with the one after it in the order of doc_id, and with its text edited by that one. Documents go to ranges of doc_id, each in
its order; a range also gets the first document of the next, so one shuffle by range is all, and no task sees more than its ranges.

Defined results: null text counts as empty. Texts without words have the empty fingerprint, whose likeness to itself is 1 and to others 0; texts of fewer
words than a shingle have one shingle, the whole. Texts of any length are taken whole. Repeated rows are each returned; of rows with one doc_id, the order is by
text. Rows of a null doc_id have no place in the order: their edited and near columns are null. The only document is followed by itself. Further
columns, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.shingles import mix, shingles

BINS, BITS, WORDS = 512, 2, 5
RANGE_BYTES = 16 << 20  # of text in a range, on average


class Sketcher:
    """Fingerprints of texts: bins and bits are powers of two, bits at most 8."""

    def __init__(self, bins: int = BINS, bits: int = BITS, words: int = WORDS):
        self.bins, self.bits, self.words = bins, bits, words
        self.shift = np.uint64(64 - int(bins).bit_length() + 1)
        own = np.arange(bins, dtype=np.uint64)
        self.salt = mix(own + np.uint64(1))
        #: place of each bin in the order in which an empty bin asks the others
        asked = np.argsort(mix(own[:, None] * np.uint64(bins) + own + np.uint64(1 << 32)), axis=1)
        self.place = np.empty((bins, bins), np.uint16)
        np.put_along_axis(self.place, asked, np.broadcast_to(np.arange(bins, dtype=np.uint16), (bins, bins)), axis=1)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        """The value of each bin: its least hash or that of its donor. hashes: sorted, not empty."""
        bin_ = (hashes >> self.shift).astype(np.int64)
        first = np.concatenate(([True], bin_[1:] != bin_[:-1]))
        full, out = bin_[first], np.zeros(self.bins, np.uint64)
        out[full] = hashes[first]
        if len(full) < self.bins:
            held = np.zeros(self.bins, bool)
            held[full] = True
            empty = np.flatnonzero(~held)
            out[empty] = out[full[self.place[np.ix_(empty, full)].argmin(axis=1)]]
        return out

    def packed(self, text: str | None) -> bytes:
        """The fingerprint: bits of all bins, or nothing if the text has no words."""
        h = shingles(text, self.words)
        if not len(h):
            return b""
        low = (mix(self.minima(h) ^ self.salt) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        return np.packbits(np.unpackbits(low[:, None], axis=1)[:, 8 - self.bits :]).tobytes()

    def likeness(self, a: bytes, b: bytes) -> float:
        """Estimated Jaccard similarity of the shingles behind two fingerprints, 0 to 1."""
        if not a or not b:
            return float(a == b)
        differ = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(self.bins, self.bits).any(axis=1)
        chance = 0.5**self.bits
        return max(0.0, (1 - float(differ.mean()) - chance) / (1 - chance))


def edited(text: str, other: str) -> str:
    """text, its last half replaced by as much of the start of other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def fingerprints(docs: DataFrame, **kinds: int) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) of every row of docs (doc_id, text). kinds: bins, bits, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(**kinds)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sketch.packed(t.as_py()).hex() for t in b.column(1)], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, fingerprint string")


def range_starts(docs: DataFrame) -> list[int]:
    """doc_ids at which ranges of about RANGE_BYTES of text begin, the first one included: as many as the driver has partitions."""
    size = F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("size")
    size, least = docs.where("doc_id IS NOT NULL").agg(size, F.min("doc_id")).first()
    if least is None:
        return []
    n = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    return sorted({least, *cuts})


def neighbours(docs: DataFrame, **kinds: int) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    starts = range_starts(docs)
    at = np.array(starts, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their range; the first documents of ranges once more, for the range before."""
        for b in batches:
            ids = b.column(0).to_numpy()
            own = np.searchsorted(at, ids, "right") - 1
            first = np.flatnonzero(at[own] == ids)
            rows = np.concatenate((np.arange(len(ids)), first))
            further = np.arange(len(rows)) >= len(ids)
            where = np.concatenate((own, (own[first] - 1) % len(at)))
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(further), *b.take(pa.array(rows)).columns], names=["range", "further", "doc_id", "text"])

    kinds_out = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by range in their order, with the first document of the next range last."""
        sketch, before, out = Sketcher(**kinds), None, []
        for which, further, doc, text in chain.from_iterable(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True) for b in batches):
            if before is None and further:
                continue  # more rows with the next range's first doc_id
            text = text.as_py()
            own = sketch.packed(text)
            if before is not None:
                doc0, text0, own0 = before
                new = edited(text0, text)
                print_ = sketch.packed(new)
                out.append((doc0, len(text0), hashlib.sha256(new.encode()).hexdigest(), own0.hex(), print_.hex(), sketch.likeness(own0, print_), sketch.likeness(own0, own)))
                if len(out) == 256:
                    yield _batch(out, kinds_out)
                    out = []
            before = None if further else (doc, text, own)
        if out:
            yield _batch(out, kinds_out)

    lost = docs.where("doc_id IS NULL")
    ddl = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    alone = fingerprints(lost.select(F.char_length("text").cast("long").alias("doc_id"), "text"), **kinds).select(
        none("doc_id", "long"), F.col("doc_id").alias("n_chars"), none("edited_sha256", "string"), "fingerprint", none("edited_fingerprint", "string"), none("near_edited", "double"), none("near_next", "double"))
    if not starts:
        return alone
    placed = docs.where("doc_id IS NOT NULL").mapInArrow(place, "range bigint, further boolean, doc_id bigint, text string")
    dealt = placed.repartition(len(starts), "range").sortWithinPartitions("range", "further", "doc_id", "text")
    return dealt.mapInArrow(judge, ddl).unionByName(alone)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
