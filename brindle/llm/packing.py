"""Operator 7: packing token ids into windows by Karmarkar-Karp multiway differencing.

Each task tokenizes its rows once and packs them in groups of about GROUP_TOKENS ids and at most GROUP_DOCS documents: no row leaves its
task, and memory is that of a group and one document. A document gives full windows of its own; what remains is an item. Every FINE-th
item is cut into halves, quarters and so on, so that fine pieces can level the windows. Multiway differencing starts from one partial
partition for each item, always takes the two of largest spread and merges them with opposing order, largest with
smallest. Of a partial partition only the sums above zero are held. The windows come out nearly equal; if one exceeds the capacity, all is done
again with more windows, by as many as the excess over all windows fills.

Defined results: null or empty text is the separator alone. A very long text is whole windows and one item. Repeated rows are packed each; items of
equal length keep the order of their rows. Further columns, whatever their names, are ignored. An empty
table gives no rows. sequence_id is the task's number times 2^33 plus a count, stable as long as the input's partitions are.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from brindle.llm.chunks import opened

CAPACITY, SEPARATOR, GROUP_TOKENS, GROUP_DOCS = 4096, 2, 1 << 20, 1 << 16
DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
FINE, FINEST = 16, 16  # of so many items one is cut, into pieces of as many ids at least


def differencing(lengths: list[int], m: int) -> np.ndarray:
    """The window, 0 to m - 1, of each item.

    A partial partition is its sums above zero, largest first; the other windows, up to m, are empty. Two of them that fit beside each other
    only interleave.
    """
    n = len(lengths)
    sums: dict[int, np.ndarray] = {k: np.array([x]) for k, x in enumerate(lengths)}
    spread = lambda s: int(s[0]) - (int(s[-1]) if len(s) == m else 0)
    heap = [(-spread(s), k) for k, s in sums.items()]
    heapq.heapify(heap)
    made: list[tuple[int, int, int, int, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        x, y = sums.pop(a), sums.pop(b)
        over = max(0, len(x) + len(y) - m)  # windows in which both have something: the smallest of x meet the smallest of y, crosswise
        low, high = x[: len(x) - over], y[: len(y) - over]
        both = np.concatenate((low, x[len(x) - over :] + y[len(y) - over :][::-1], high))
        order = np.argsort(-both, kind="stable")
        key = n + len(made)
        sums[key] = both = both[order]
        made.append((a, b, len(x), len(y), order))
        heapq.heappush(heap, (-spread(both), key))
    window = np.zeros(n, np.int64)
    top = sums[heap[0][1]] if heap else np.zeros(0)
    labels = {heap[0][1]: np.arange(len(top))} if heap else {}
    for k in range(len(made) - 1, -1, -1):  # from the last merge down, hand each sum's window to the two partitions
        a, b, nx, ny, order = made[k]
        own = np.empty(len(order), np.int64)
        own[order] = labels.pop(n + k)
        for child, lab in ((a, own[:nx]), (b, np.concatenate((own[nx:], own[len(order) - ny : nx][::-1])))):
            if child < n:
                window[child] = lab[0]
            else:
                labels[child] = lab
    if n == 1:
        window[0] = 0
    return window


def windows(lengths: list[int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """The window of each item, and the number of windows, of which none exceeds the capacity."""
    if not lengths:
        return np.zeros(0, np.int64), 0
    m = -(-sum(lengths) // capacity)
    while True:
        found = differencing(lengths, m)
        over = np.maximum(np.bincount(found, weights=lengths, minlength=m) - capacity, 0).sum()
        if not over:
            return found, m
        m += -(-int(over) // capacity)


def _cuts(n: int, fine: bool, capacity: int) -> list[tuple[int, int, bool]]:
    """(start, length, is a full window) of a document's pieces."""
    out = [(s, capacity, True) for s in range(0, n - capacity + 1, capacity)]
    at = len(out) * capacity
    while at < n:
        left = n - at
        size = left // 2 if fine and left >= 2 * FINEST else left
        out.append((at, size, False))
        at += size
    return out


def _pack(group: list[tuple[int, bytes]], first: int, capacity: int) -> tuple[pa.RecordBatch, int]:
    """A group's pieces, and the number of its sequences."""
    rows, items, full = [], [], 0
    for k, (doc, ids) in enumerate(group):
        n = len(ids) // 4
        for s, size, whole in _cuts(n, k % FINE == 0, capacity):
            row = [doc, s, size, zlib.crc32(ids[4 * s : 4 * (s + size)]), n, 0, 0]
            if whole:
                row[5] = first + full
                full += 1
            else:
                items.append(row)
            rows.append(row)
    found, m = windows([r[2] for r in items], capacity)
    filled = [0] * m
    for row, w in zip(items, found.tolist(), strict=True):
        row[5], row[6] = first + full + w, filled[w]
        filled[w] += row[2]
    names = [x.split()[0] for x in DDL.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names), full + m


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """The pieces of every row of docs (doc_id, text): DDL. tokenizer: path of a file for the library tokenizers whose
    pre-tokenizer drops white space."""
    end = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = opened(tokenizer)
        first, group, size = TaskContext.get().partitionId() << 33, [], 0
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                for doc, ids in zip(part.column(0).to_pylist(), enc.ids_of(part.column(1)), strict=True):
                    group.append((doc, ids + end))
                    size += len(ids) // 4 + 1
                    if size >= GROUP_TOKENS or len(group) >= GROUP_DOCS:
                        out, n = _pack(group, first, capacity)
                        first, group, size = first + n, [], 0
                        yield out
        if group:
            yield _pack(group, first, capacity)[0]

    return docs.select("doc_id", "text").mapInArrow(run, DDL)
