"""Operator 5: token counts through a two-tier lookup, without a shuffle of pre-tokens.

First, each task counts the chunks of its rows in a bounded sketch (the least frequent are forgotten when it is full; chunks of more
than LONGEST characters, as of texts without spaces, never enter it, so it is bounded in bytes too); sketches
merge in a tree, and the most frequent chunks with their token counts become a table of at most TABLE entries, which
is sent to all executors. Then each task counts its own rows: table first, its worker's cache second, the
tokenizer last. What the sketch forgets only costs time; counts are exact.

Defined results: null text counts as empty (0 bytes, 0 tokens). Texts of any length are counted whole, by chunks. Repeated rows are counted row by
row; of equally frequent chunks either may be in the table. Further columns, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.chunks import LONGEST, Cache, Tiers, opened, split

TABLE, SKETCH, FANIN = 65_536, 16_384, 16
_TABLES: dict[str, tuple[Tiers, Cache]] = {}


def _top(counts: Counter, n: int) -> Counter:
    return counts if len(counts) <= n else Counter(dict(counts.most_common(n)))


def _row(counts: Counter) -> Iterator[pa.RecordBatch]:
    if counts:
        yield pa.RecordBatch.from_pydict({"chunks": [list(counts)], "counts": [list(counts.values())]}, schema=_SKETCH)


_SKETCH = pa.schema([("chunks", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for b in batches:
        for t in b.column(0):
            if (text := t.as_py()) is not None:
                seen.update(w for w in split(text) if len(w) <= LONGEST)
                if len(seen) > 20 * SKETCH:
                    seen = _top(seen, 4 * SKETCH)
    yield from _row(_top(seen, SKETCH))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for b in batches:
        for words, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for w, n in zip(words, counts, strict=True):
                seen[w] += n
        seen = _top(seen, TABLE)
    yield from _row(seen)


def frequent_chunks(docs: DataFrame) -> list[str]:
    """At most TABLE chunks: the driver receives one merged sketch, whose size the corpus does not change."""
    ddl = "chunks array<string>, counts array<bigint>"
    texts = docs.select("text")
    sketches, parts = texts.mapInArrow(_count, ddl), texts.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FANIN)
        sketches = sketches.repartition(parts).mapInArrow(_merge, ddl)
    rows = sketches.collect()
    return [w for r in rows for w in r["chunks"]]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs (doc_id, text). tokenizer: path of a file for the library
    tokenizers whose pre-tokenizer drops white space."""
    chunks = frequent_chunks(docs)
    packed = docs.sparkSession.sparkContext.broadcast(opened(tokenizer).lengths(chunks))
    key = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _TABLES:
            _TABLES.clear()
            _TABLES[key] = Tiers(packed.value), Cache(opened(tokenizer).lengths)
        table, cache = _TABLES[key]
        for b in batches:
            for k in range(0, b.num_rows, 512):
                doc, size, text = b.slice(k, 512).columns
                words = [split(t or "") for t in text.to_pylist()]
                table.beyond = cache.lookup(set().union(*words).difference(table))
                n = [sum(map(table.__getitem__, ws)) for ws in words]
                yield pa.RecordBatch.from_arrays([doc, size, pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    out = docs.select("doc_id", n_bytes, "text").mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return out.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
