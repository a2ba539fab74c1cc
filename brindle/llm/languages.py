"""Operator 6: language identification by interpolated Kneser-Ney character models.

Training takes a bounded sample of the labelled rows (SAMPLE documents a language, chosen by a hash of doc_id, so the same at
every run). Spark counts 4-grams of characters within words; the models, one column a language, live in hash arrays sorted by
n-gram and are small whatever the corpus. A text's cross-entropy is that of its words, in nats a character; the language with
the lowest wins. Its score is the posterior with the evidence of at most CONFIDENT characters. A text whose
cross-entropy exceeds what nearly all of a second sample of that language has is marked accepted = false (an extra
column: the contract asks for a learned language wherever there are letters).

Defined results: `und` and score 0 for a null text or one without letters, and for all texts if nothing can be learnt. Repeated rows
are judged each; further columns are ignored. lang, source and doc_id of a row never enter its prediction.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.storage import materialize

ORDER, DISCOUNT = 4, 0.75
SAMPLE, CALIBRATION = 1000, 300  # documents a language, about
QUANTILE, MARGIN = 0.995, 1.05  # of the calibration texts' cross-entropy; a text may exceed it by so much
CONFIDENT = 60
CACHE_WORDS = 200_000
_WORD = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, so keys stay distinct
_CACHES: dict[str, tuple[dict[str, int], list[np.ndarray]]] = {}


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each character of each word and at its end, as packed code units, and each word's number of grams."""
    padded = "".join(f"   {w} " for w in ws)
    cp = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    cp = (cp ^ (cp >> np.uint64(16))) & np.uint64(0xFFFF)
    sizes = np.array([len(w) + 4 for w in ws])
    packed = cp.copy()
    for k in range(1, ORDER):
        packed[k:] |= cp[:-k] << np.uint64(16 * k)
    ends = np.ones(len(cp), bool)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(int)
    for k in range(ORDER - 1):
        ends[starts + k] = False
    return packed[ends], sizes - (ORDER - 1)


def _low(keys: np.ndarray, order: int) -> np.ndarray:
    return keys & np.uint64((1 << (16 * order)) - 1) if order < ORDER else keys


@dataclass
class Models:
    """For each order, the sorted hashes of its n-grams with log probabilities, and of its contexts with log back-off weights."""

    langs: list[str]
    hashes: list[np.ndarray]
    logp: list[np.ndarray]
    context_hashes: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: np.ndarray
    limits: np.ndarray

    def score(self, keys: np.ndarray) -> np.ndarray:
        """Log probability of each 4-gram's last character, by language."""
        out = np.zeros((len(keys), len(self.langs)), np.float32)
        open_ = np.arange(len(keys))
        for order in range(ORDER, 0, -1):
            own = _low(keys[open_], order)
            at, hit = _find(self.hashes[order - 1], own * _MIX)
            out[open_[hit]] += self.logp[order - 1][at[hit]]
            open_, own = open_[~hit], own[~hit]
            if order > 1 and len(open_):
                at, hit = _find(self.context_hashes[order - 1], (own >> np.uint64(16)) * _MIX)
                out[open_[hit]] += self.backoff[order - 1][at[hit]]
        out[open_] += self.floor
        return out


def _find(sorted_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return np.zeros(len(keys), int), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)
    return at, sorted_[at] == keys


def build(langs: list[str], lang: np.ndarray, key: np.ndarray, count: np.ndarray) -> Models:
    """Interpolated Kneser-Ney: the highest order has counts, each lower one the number of characters seen before an n-gram."""
    n = len(langs)
    tables = [None] * ORDER
    uniq, at = np.unique(key, return_inverse=True)
    c = np.zeros((len(uniq), n))
    np.add.at(c, (at, lang), count)
    for order in range(ORDER, 0, -1):
        tables[order - 1] = (uniq, c)
        if order > 1:
            low, at = np.unique(_low(uniq, order - 1), return_inverse=True)
            lower = np.zeros((len(low), n))
            np.add.at(lower, at, (c > 0).astype(float))
            uniq, c = low, lower
    vocabulary = len(tables[0][0]) + 1
    before = np.full((1, n), 1 / vocabulary)
    hashes, logp, context_hashes, backoff = [], [], [], []
    for order in range(1, ORDER + 1):
        keys, c = tables[order - 1]
        context, at = np.unique(keys >> np.uint64(16), return_inverse=True)
        total, kinds = np.zeros((len(context), n)), np.zeros((len(context), n))
        np.add.at(total, at, c)
        np.add.at(kinds, at, (c > 0).astype(float))
        weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        lower = before[np.searchsorted(tables[order - 2][0], _low(keys, order - 1))] if order > 1 else before
        p = np.maximum(c - DISCOUNT, 0) / np.maximum(total[at], 1) + weight[at] * lower
        before = p
        for names, values, h, v in ((hashes, logp, keys, p), (context_hashes, backoff, context, weight)):
            mixed = h * _MIX
            order_ = np.argsort(mixed)
            names.append(mixed[order_])
            values.append(np.log(v[order_]).astype(np.float32))
    floor = np.log(1 / vocabulary).astype(np.float32) + backoff[0][0]
    return Models(langs, hashes, logp, context_hashes, backoff, floor, np.full(n, np.inf))


def _entropies(models: Models, model_id: str, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: cross-entropy by language, characters counted, whether it has letters."""
    if model_id not in _CACHES:
        _CACHES.clear()
        _CACHES[model_id] = ({}, [np.zeros((0, len(models.langs))), np.zeros(0)])
    known, store = _CACHES[model_id]
    split = [words(t) for t in texts]
    new = list({w for ws in split for w in ws if w not in known})
    if len(known) + len(new) > CACHE_WORDS:
        known.clear()
        store[0], store[1] = store[0][:0], store[1][:0]
        new = list({w for ws in split for w in ws})
    if new:
        rows, sizes = [], []
        for k in range(0, len(new), 20_000):
            keys, n = grams(new[k : k + 20_000])
            edges = np.concatenate(([0], np.cumsum(n)[:-1]))
            rows.append(np.add.reduceat(models.score(keys), edges, axis=0))
            sizes.append(n)
        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        store[0], store[1] = np.vstack([store[0], *rows]), np.concatenate([store[1], *sizes])
    ce, n, letters = np.zeros((len(texts), len(models.langs))), np.zeros(len(texts)), np.zeros(len(texts), bool)
    for k, ws in enumerate(split):
        if any(c.isalpha() for w in ws for c in w):
            at = np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))
            n[k] = store[1][at].sum()
            ce[k] = -store[0][at].sum(axis=0) / n[k]
            letters[k] = True
    return ce, n, letters


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, Counter] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            seen.setdefault(lang, Counter()).update(words(text))
    for lang, counts in seen.items():
        if counts:
            keys, sizes = grams(list(counts))
            weights = np.repeat(np.fromiter(counts.values(), np.int64), sizes)
            uniq, at = np.unique(keys, return_inverse=True)
            n = np.bincount(at, weights=weights).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(uniq), "key": uniq.view(np.int64), "n": n})


def train(rows: DataFrame) -> Models | None:
    """rows: doc_id, text, lang of the documents to learn from."""
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, sizes[k])])
    dice = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), share[F.col("lang")])
    picked = materialize(rows.select("lang", "text", dice.alias("dice")).where(f"dice < {SAMPLE + CALIBRATION}"), "language-sample")
    counts = picked.where(f"dice < {SAMPLE}").select("lang", "text").mapInArrow(_counted, "lang string, key bigint, n bigint")
    table = counts.groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    if table.empty:
        return None
    place = {x: k for k, x in enumerate(langs)}
    models = build(langs, table["lang"].map(place).to_numpy(), table["key"].to_numpy(np.int64).view(np.uint64), table["n"].to_numpy(float))
    held = predict(picked.select(F.col("lang").alias("doc_id"), "text", "dice").where(f"dice >= {SAMPLE}"), models, "string")
    cuts = held.where("doc_id = lang_pred").groupBy("doc_id").agg(F.percentile("cross_entropy", QUANTILE).alias("q"), F.count("*").alias("n"))
    for r in cuts.collect():
        if r["n"] >= 20:
            models.limits[place[r["doc_id"]]] = MARGIN * r["q"]
    return models


def predict(docs: DataFrame, models: Models | None, id_type: str = "bigint") -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, accepted of docs (doc_id, text)."""
    if models is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(False).alias("accepted"))
    sent, model_id = docs.sparkSession.sparkContext.broadcast(models), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for k in range(0, b.num_rows, 512):
                ids, text = b.slice(k, 512).columns
                ce, n, letters = _entropies(m, model_id, text.to_pylist())
                best = ce.argmin(axis=1)
                lowest = ce[np.arange(len(best)), best]
                posterior = 1 / np.exp(-(ce - lowest[:, None]) * np.minimum(n, CONFIDENT)[:, None]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array([m.langs[x] if y else "und" for x, y in zip(best, letters, strict=True)]), pa.array(np.where(letters, posterior, 0.0)),
                    pa.array(lowest, mask=~letters), pa.array(letters & (lowest <= m.limits[best]))], names=["doc_id", "lang_pred", "score", "cross_entropy", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double, cross_entropy double, accepted boolean")
