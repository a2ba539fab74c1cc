"""Deep-shallow sorting against Python's sort, and suffix deduplication with split anchors against brute force."""

import hashlib

import numpy as np
import pytest

from brindle.llm import suffix_dedup
from brindle.llm.suffix_sort import sorted_suffixes
from brindle.llm.tables import ship


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_order_is_that_of_a_plain_sort(letters):
    dice = np.random.default_rng(letters)
    half = dice.integers(97, 97 + letters, 1500).astype(np.uint8)
    data = np.concatenate((half, half, half[:700], dice.integers(0, 256, 200).astype(np.uint8)))
    starts = dice.permutation(len(data) - 50)
    group = dice.integers(0, 3, len(starts))
    order, begins = sorted_suffixes(data, starts, 50, group)
    text = data.tobytes()
    keys = [(g, text[s : s + 50]) for g, s in zip(group[order].tolist(), starts[order].tolist(), strict=True)]
    assert sorted(order.tolist()) == list(range(len(starts))) and keys == sorted(keys)
    assert begins.tolist() == [k == 0 or keys[k] != keys[k - 1] for k in range(len(keys))]


def expected(texts):
    seen, want = set(), {}
    for i, t in sorted(texts.items()):
        b = t.encode()
        gone, own = bytearray(len(b)), [b[k : k + 50] for k in range(len(b) - 49)]
        for k, x in enumerate(own):
            if x in seen:
                gone[k : k + 50] = b"\1" * 50
        seen |= set(own)
        runs = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        want[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return want


@pytest.mark.parametrize("small", [False, True])
def test_a_passage_in_changing_surroundings(spark, monkeypatch, small):
    """One passage in all documents, others in some, each time between other words; small: nearly every anchor is hot."""
    ship(spark)
    if small:
        monkeypatch.setattr(suffix_dedup, "HOT", 2)
    dice = np.random.default_rng(5)
    word = lambda: "".join(chr(x) for x in dice.integers(97, 123, 6))
    passages = ["the same passage stands in very many documents of this table, always the same", "another one of just over fifty bytes, seen in some", "ab" * 60]
    texts = {}
    for i in range(150):
        parts = [word() for _ in range(dice.integers(0, 12))]
        for p in passages[: 1 + i % 3]:
            parts.insert(int(dice.integers(0, len(parts) + 1)), p)
        texts[int(i * 7919 % 1000) - 300] = " ".join(parts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.deduplicated(docs).collect()} == expected(texts)


def test_given_documents(spark):
    ship(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.deduplicated(docs).collect()} == expected(texts)


@pytest.mark.parametrize("limit", [2, 1 << 20])
def test_rows_of_one_anchor_beyond_the_limit(monkeypatch, limit):
    """Anchors 1 (one context), 2 (two contexts), 3 (one document): beyond the limit rows go on to be sorted, none is lost."""
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "LIMIT", limit)
    rows = [(1, 5, d, 512 + 60) for d in range(8)] + [(2, c, d, 512 + 60) for c in (1, 2) for d in range(3)] + [(3, 1, 4, 512 + 60), (3, 1, 4, 1024 + 60)]
    batches = [suffix_dedup._batch("h c doc_id place", *[pa.array(x, pa.int64()) for x in zip(*rows[k : k + 3], strict=True)]) for k in range(0, len(rows), 3)]
    got = [r for b in suffix_dedup._judged(iter(batches)) for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
    of = lambda h: sorted((r[2], r[4]) for r in got if r[0] == h)
    assert of(2) == sorted((d, False) for d in range(3) for _ in range(2)) and not of(3)
    assert of(1) == ([(d, True) for d in range(1, 8)] if limit > 8 else [(d, False) for d in range(8)])
