"""Operator 12: alignment of two tokenizers' tokens by the byte offsets where both end.

Each text is encoded by both; where tokens end, in bytes, gives two sorted lists. The shorter one drives a galloping search (steps that
double, then a binary search between the last two) through the longer. Indices of common ends cut both token lists into
groups; differences of their ranks are the tokens that a group's two sides have. A link is a pair of tokens that end together.

Where neither tokenizer has a token over the start of a blank that follows something else than white space, texts are cut there into
chunks: both sides end there, so a text's groups are those of its chunks, and a chunk seen before is a lookup. Other tokenizers get texts whole.

Counts of linked pairs of ids cover all texts: each task adds up its own before the shuffle. The most frequent pairs, at most SEND_PAIRS, are
sent to all executors; links of other pairs go through a shuffle by pair.

Defined results: null and empty texts have no tokens, nor have those whose joined tokens are not a blank and the text. Texts of any length are
taken whole. Repeated rows are each returned and each count. Links whose counts tie for the highest of their second id are all best. Further columns,
whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.chunks import _BYTES, Cache
from brindle.llm.storage import materialize

SEND_PAIRS = 1_000_000  # pairs of ids sent to all executors at most: 24 bytes each
CUT = re.compile(r"(?<=\S)(?= .)", re.DOTALL)  # a last blank stays with the word before it
UNEVEN = re.compile(r"  |[^\S ] ")  # blanks that do not each follow a word
_OPEN: dict[tuple[str, str], Aligner] = {}
_TABLES: dict[str, tuple[np.ndarray, ...]] = {}


def common(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Indices in a and in b of their common values. Both ascend strictly."""
    if len(a) > len(b):
        there, here = common(b, a)
        return here, there
    mine, theirs, lo, n = [], [], 0, len(b)
    for k, x in enumerate(a):
        step, hi = 1, lo
        while hi < n and b[hi] < x:
            lo, hi, step = hi + 1, hi + step, 2 * step
        lo = bisect_left(b, x, lo, min(hi, n))
        if lo == n:
            break
        if b[lo] == x:
            mine.append(k)
            theirs.append(lo)
    return mine, theirs


class Aligner:
    """Two tokenizers: a byte-level one of the library tokenizers (A) and a model of sentencepiece (B)."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        plain = {c: bytes([k]) for k, c in _BYTES.items()}
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.a_bytes[k] = b"".join(plain.get(c, c.encode()) for c in token)
        size = self.b.get_piece_size()
        piece = lambda k: bytes([int(self.b.id_to_piece(k)[3:5], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace("▁", " ").encode()
        self.b_bytes = [piece(k) for k in range(size)]
        self.ids_b = size
        self.a_text, self.b_text = list(map(str, range(len(self.a_bytes)))), list(map(str, range(size)))
        self.by_chunk = self._cuts_at_blanks(json.loads(self.a.to_str()), b)
        self.cache = Cache(self.aligned)

    def _cuts_at_blanks(self, own: dict, path: str) -> bool:
        """Whether both leave the start of a blank after a word as a border of tokens, whatever is around it."""
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        step, norm = own.get("pre_tokenizer") or {}, spec.normalizer_spec
        even = step.get("type") == "ByteLevel" and step.get("use_regex") and not step.get("add_prefix_space") and not own.get("normalizer")
        kept = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and not spec.trainer_spec.user_defined_symbols
        return bool(even and kept and not any(re.search("[^▁]▁", p.piece) for p in spec.pieces))

    def chunks(self, text: str) -> list[str]:
        """A blank and text, in chunks that each begin with a blank."""
        if not self.by_chunk or "▁" in text:
            return [" " + text]
        if UNEVEN.search(text) or text[0] == " ":
            return CUT.split(" " + text)
        cut = [" " + w for w in text.split(" ")]
        return cut if text[-1] != " " else [*cut[:-2], cut[-2] + " "]

    def aligned(self, chunks: list[str]) -> dict[str, tuple | None]:
        """Of each chunk: numbers of tokens of A and B, groups as text, links as packed codes; None where tokens do not give the chunk."""
        out, pa_, pb = {}, self.a_bytes, self.b_bytes
        for k in range(0, len(chunks), 1024):
            part = chunks[k : k + 1024]
            for w, ea, ib in zip(part, self.a.encode_batch_fast(part, add_special_tokens=False), self.b.encode([w[1:] for w in part], num_threads=1), strict=True):
                ia, raw = ea.ids, w.encode()
                ta, tb = [pa_[x] for x in ia], [pb[x] for x in ib]
                if b"".join(ta) != raw or b"".join(tb) != raw:
                    out[w] = None
                else:
                    out[w] = self._value(ia, ib, *common(list(accumulate(map(len, ta))), list(accumulate(map(len, tb)))))
        return out

    def _value(self, ia: list[int], ib: list[int], at_a: list[int], at_b: list[int]) -> tuple:
        ta, tb = [self.a_text[x] for x in ia], [self.b_text[x] for x in ib]
        groups, links, a, b, ids_b = [], [], 0, 0, self.ids_b
        for x, y in zip(at_a, at_b, strict=True):
            groups.append(f"{ta[x] if a == x else ','.join(ta[a : x + 1])}|{tb[y] if b == y else ','.join(tb[b : y + 1])}")
            links.append(ia[x] * ids_b + ib[y])
            a, b = x + 1, y + 1
        return len(ia), len(ib), ";".join(groups), struct.pack(f"<{len(links)}q", *links)

    def texts(self, texts: list[str | None]) -> Iterator[tuple]:
        """n_a, n_b, groups, links of each text."""
        cut = [self.chunks(t) if t else [] for t in texts]
        known = self.cache.lookup(set().union(*cut)) if any(cut) else None
        for chunks in cut:
            found = [known(c) for c in chunks]
            if not found or None in found:
                yield 0, 0, "", b""
            else:
                a, b, groups, links = zip(*found, strict=True)
                yield sum(a), sum(b), ";".join(groups), b"".join(links)


def opened(a: str, b: str) -> Aligner:
    if (a, b) not in _OPEN:
        _OPEN[a, b] = Aligner(a, b)
    return _OPEN[a, b]


def token_alignment(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups ('a1,a2|b1;a3|b2': ids by group), pairs, times of every row of docs (doc_id, text): linked
    pairs of ids, each once, as a id * (ids of B) + b id, and how often the text links them."""
    out = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups")], ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = opened(a, b)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                n_a, n_b, groups, links = zip(*aligner.texts(part.column(1).to_pylist()), strict=True)
                links = [np.frombuffer(x, "<i8") for x in links]
                once = [np.unique(x, return_counts=True) for x in links]
                pairs, times = (pa.ListArray.from_arrays(np.cumsum([0, *[len(x[0]) for x in once]]).astype(np.int32), pa.array(np.concatenate([x[j] for x in once]), t)) for j, t in ((0, pa.int64()), (1, pa.int32())))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(list(map(len, links)), pa.int64()), pa.array(groups), pairs, times], schema=out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(align, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, pairs array<bigint>, times array<int>")


def pair_counts(aligned: DataFrame, ids_b: int) -> DataFrame:
    """pair, n, best of all linked pairs: how many links have the pair, and whether no pair with its second id has more."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, at = np.unique(b.column(0).flatten().to_numpy(), return_inverse=True)
            n = np.zeros(len(codes), np.int64)
            np.add.at(n, at, b.column(1).flatten().to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["pair", "n"])

    counted = aligned.select("pairs", "times").mapInArrow(add, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    return counted.select("pair", "n", (F.col("n") == F.max("n").over(Window.partitionBy(F.col("pair") % ids_b))).alias("best"))


def _most_frequent(pairs: DataFrame) -> DataFrame:
    """Pairs above a count that at most SEND_PAIRS pairs exceed: all, where there are no more."""
    if pairs.count() <= SEND_PAIRS:
        return pairs
    held, least = 0, 64
    for r in pairs.groupBy(F.floor(F.log2("n")).alias("power")).count().orderBy(F.desc("power")).collect():  # a row for each power of two
        if held + r["count"] > SEND_PAIRS:
            break
        held, least = held + r["count"], r["power"]
    return pairs.where(F.floor(F.log2("n")) >= least)


def link_scores(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """aligned (row, unique; pairs, times; others) with n_best, count_sum in place of pairs and times: links whose pair is best, and the sum of
    their counts."""
    spark, key = aligned.sparkSession, uuid.uuid4().hex
    top = _most_frequent(pairs).toArrow().sort_by("pair")
    sent = spark.sparkContext.broadcast((top["pair"].to_numpy(), top["n"].to_numpy(), top["best"].to_numpy()))
    whole = top.num_rows == pairs.count()
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]

    def found(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Of all links of b: their row in b, pair, times, whether the pair was sent, and where it is."""
        if key not in _TABLES:
            _TABLES.clear()
            _TABLES[key] = sent.value
        codes = _TABLES[key][0]
        pairs_, times = b.column("pairs"), b.column("times").flatten().to_numpy().astype(np.int64)
        mine = pairs_.flatten().to_numpy()
        at = np.searchsorted(codes, mine).clip(max=max(0, len(codes) - 1))
        return np.repeat(np.arange(b.num_rows), pairs_.value_lengths().to_numpy()), mine, times, codes[at] == mine if len(codes) else np.zeros(len(mine), bool), at

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, _, times, here, at = found(b)
            _, n, best = _TABLES[key]
            sums = np.zeros((2, b.num_rows), np.int64)
            np.add.at(sums[0], row[here], times[here] * best[at[here]])
            np.add.at(sums[1], row[here], times[here] * n[at[here]])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(sums[0]), pa.array(sums[1])], names=[*kept, "n_best", "count_sum"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, mine, times, here, _ = found(b)
            yield pa.RecordBatch.from_arrays([pa.array(b.column("row").to_numpy()[row[~here]]), pa.array(mine[~here]), pa.array(times[~here])], names=["__row", "pair", "times"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.select(kept).schema)
    scores = aligned.mapInArrow(score, f"{ddl}, n_best bigint, count_sum bigint")
    if whole:
        return scores
    others = aligned.select("row", "pairs", "times").mapInArrow(rest, "__row bigint, pair bigint, times bigint").join(pairs, "pair").groupBy("__row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("__best"), F.sum(F.col("times") * F.col("n")).alias("__sum"))
    scores = scores.join(others, scores["row"] == others["__row"], "left")
    more = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    return scores.select(*kept, more("n_best", "__best"), more("count_sum", "__sum"))


def alignment_digest(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs (doc_id, text)."""
    made = token_alignment(docs, a, b).withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
    made = materialize(made.withColumn("row", F.monotonically_increasing_id()), "aligned-links")
    pairs = materialize(pair_counts(made, opened(a, b).ids_b), "aligned-pairs")
    return link_scores(made, pairs).select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
