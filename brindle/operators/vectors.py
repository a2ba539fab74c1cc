"""Exact search over vectors, for a table of query vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from brindle.functions.binding import let
from brindle.operators.best import Best
from brindle.operators.lexical import PLACES, top

QUERIES = 20_000  # that are sent to all tasks
BLOCK = 10_000  # rows of each side compared at once, about


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def valid(v: Column) -> Column:
    """Not empty, finite and not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & (norm(v) > 0), F.lit(False))


def normalized(v: Column) -> Column:
    """Of length 1; null where not valid."""
    return F.when(valid(v), let(norm(v), lambda n: F.transform(v, lambda x: x.cast("double") / n)))


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, on: list[str] | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank by cosine. vectors: chunk_id, vector; queries: query_id, vector; on: columns that must agree. Vectors of another length
    are not compared.

    Exact search compares every query with every vector. The queries are the small side (QUERIES at most; more go by blocks) and stay where the vectors are; scores are
    products of matrices, and each task keeps its k best of a query before anything is shuffled.
    """
    on = on or []
    asked = queries.select("query_id", *on, normalized(F.col("vector")).alias("__q")).where("__q IS NOT NULL").limit(QUERIES + 1).collect()
    if len(asked) > QUERIES:
        key = F.struct(*[F.col(c) for c in on]) if on else F.lit(0)
        both = [df.withColumn("__key", F.when(sum((F.col(c).isNull().cast("int") for c in on), F.lit(0)) == 0, F.xxhash64(key) if on else key)) for df in (vectors, queries)]
        return dense_top_blocks(*both, k, "__key")
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["chunk_id"]
    kind, name = to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(vectors.schema["chunk_id"].dataType)
    sides: dict = {}
    for r in asked:
        sides.setdefault((tuple(r[c] for c in on), len(r["__q"])), []).append((r["query_id"], r["__q"]))
    sides = {key: ([q for q, _ in rows], np.array([v for _, v in rows]).T) for key, rows in sides.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {key: Best(k, len(ids)) for key, (ids, _) in sides.items()}
        for b in batches:
            v = b.column("__v")
            rows: dict = {}
            for i, key in enumerate(zip(*(b.column(c).to_pylist() for c in on), v.value_lengths().to_pylist(), strict=True)):
                rows.setdefault((key[:-1], key[-1]), []).append(i)
            for key, at in rows.items():
                if key not in sides:
                    continue
                for s in range(0, len(at), 2048):
                    part = v.take(pa.array(at[s : s + 2048]))
                    raw = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), key[1])
                    raw = raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))
                    held[key].add((), b.column("chunk_id").take(pa.array(at[s : s + 2048])), np.round(raw @ sides[key][1], PLACES))
        for key, found in held.items():
            for _, of, names, scores in found.rows():
                yield pa.RecordBatch.from_arrays([pa.array([sides[key][0][q] for q in of], kind), pa.array(names, name), pa.array(scores)], names=["query_id", "chunk_id", "score"])

    a = vectors.select("chunk_id", *on, F.col("vector").alias("__v")).where(valid(F.col("__v")))
    return top(a.mapInArrow(run, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double"), k)


def dense_top_blocks(vectors: DataFrame, queries: DataFrame, k: int, on: str) -> DataFrame:
    """dense_top() for queries that grow with the vectors; `on`: a column that must agree; vectors of another length are not compared.

    Both sides are cut into blocks by hash; each pair of blocks is one group of bounded size (about BLOCK rows of each), whose scores are
    a product of matrices. A group keeps its k best of each query; these are merged. Nothing is broadcast.
    """
    n_q, n_v = (max(1, -(-df.count() // BLOCK)) for df in (queries, vectors))
    side = lambda df, key, n: df.select(key, F.col(on).alias("__on"), normalized(F.col("vector")).alias("__v"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("__own")).where("__v IS NOT NULL AND __on IS NOT NULL").withColumn("__size", F.size("__v"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = side(vectors, "chunk_id", n_v).withColumnRenamed("__own", "__vb").withColumn("__qb", every(n_q))
    q = side(queries, "query_id", n_q).withColumnRenamed("__own", "__qb").withColumn("__vb", every(n_v))
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["chunk_id"]

    def best(a: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(a) and len(q):
            a = a.sort_values("chunk_id", kind="stable")
            ids, v, asked, w = a["chunk_id"].to_numpy(), np.stack(a["__v"]), q["query_id"].to_numpy(), np.stack(q["__v"])
            for s in range(0, len(asked), 64):
                scores = np.round(w[s : s + 64] @ v.T, PLACES)
                for query, row in zip(asked[s : s + 64], scores, strict=True):
                    at = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                    found += [(query, ids[j], row[j]) for j in at[np.argsort(-row[at], kind="stable")][:k]]
        return pd.DataFrame(found, columns=["query_id", "chunk_id", "score"])

    keys = ["__on", "__size", "__vb", "__qb"]
    pairs = a.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(best, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")
    return top(pairs, k)


def hashed_tokens(size: int = 64):
    """The default text model: counts of hashed tokens. Its fingerprint is `hashed-tokens-{size}`. A real model is loaded where the returned
    function is first called in a worker. It is given lists of tokens, and returns a row for each."""

    def encode(tokens: pa.Array) -> np.ndarray:
        n = np.nan_to_num(pc.list_value_length(tokens).to_numpy(zero_copy_only=False)).astype(np.int64)
        coded = tokens.flatten().dictionary_encode()  # each word is hashed once a batch
        slots = np.array([zlib.crc32(t.encode()) % size for t in coded.dictionary.to_pylist()], np.int64)
        key = np.repeat(np.arange(len(n)), n) * size + (slots[coded.indices.to_numpy(zero_copy_only=False)] if len(slots) else np.zeros(0, np.int64))
        return np.bincount(key, minlength=len(n) * size).astype(np.float32).reshape(len(n), size)

    return encode


def embedded(df: DataFrame, key: str, tokens: Column, encode=None) -> DataFrame:
    """key and vector (array<float>) of each row, by Arrow batches. As an operator of its own the model runs once a row: no condition on
    vectors is pushed below it with a copy of the call."""
    encode = encode or hashed_tokens()
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = encode(b.column("__tokens"))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * made.shape[1], pa.int32()), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(key), rows], names=[key, "vector"])

    return df.select(key, tokens.alias("__tokens")).mapInArrow(run, f"{key} {kind}, vector array<float>")
