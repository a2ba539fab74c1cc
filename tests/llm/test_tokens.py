"""Token counts and packing: characters that separate nothing, texts without spaces, many tiny texts, and the differencing method itself."""

import heapq
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from brindle.llm.chunks import Chunks, opened
from brindle.llm.packing import differencing, packed, windows
from brindle.llm.tables import ship
from brindle.llm.token_counts import _count, token_counts

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = ["plain words", "a\0b c", "\0", "İstanbul ǅ straße. ŉab, Σας ªº don't a1b2!! x<|endoftext|>y", "x\u0085y  a b K ﬁx", "é a. café, x;;; ?! ...", "漢字" * 40_000, "q" * 300_000, "Ünder ÀÉÎ " * 50]


def test_odd_texts(spark):
    ship(spark)
    t = Tokenizer.from_file(TOKENIZER)
    want = [t.encode(x, add_special_tokens=False).ids for x in ODD]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(ODD * 2)], "doc_id long, text string").repartition(2)
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts(docs, TOKENIZER).collect()) == [(k, len(want[k % len(ODD)])) for k in range(2 * len(ODD))]
    assert [np.frombuffer(x, "<u4").tolist() for x in opened(TOKENIZER).ids_of(ODD)] == want


def test_sketch_holds_no_long_chunks():
    import pyarrow as pa

    out = list(_count(iter([pa.RecordBatch.from_pydict({"text": ["漢" * 5000 + " short", None, "short"]})])))
    assert out[0].to_pylist() == [{"chunks": ["short"], "counts": [2]}]


def by_definition(lengths: list[int], m: int) -> list[int]:
    heap = [(-x if m > 1 else 0, k, [x] + [0] * (m - 1)) for k, x in enumerate(lengths)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        s = sorted((x + y for x, y in zip(a, b[::-1], strict=True)), reverse=True)
        heapq.heappush(heap, (s[-1] - s[0], made, s))
        made += 1
    return sorted(heap[0][2])


def test_differencing_equals_the_definition():
    dice = random.Random(1)
    for _ in range(200):
        lengths, m = [dice.randint(1, 50) for _ in range(dice.randint(1, 30))], dice.randint(1, 8)
        assert sorted(np.bincount(differencing(lengths, m), weights=lengths, minlength=m).tolist()) == by_definition(lengths, m)


def test_many_empty_texts(spark):
    """A group of nothing but separators: as few windows as can be, in bounded memory."""
    found, m = windows([1] * 50_000)
    assert m == 13 and np.ptp(np.bincount(found)) <= 1
    got = packed(spark.range(70_000).selectExpr("id AS doc_id", "IF(id % 2 = 0, NULL, '') AS text").coalesce(1), TOKENIZER)
    rows = got.groupBy("sequence_id").sum("length").collect()
    assert sum(r[1] for r in rows) == 70_000 and max(r[1] for r in rows) <= 4096 and len(rows) <= 18


def test_words_come_to_the_model_once():
    """Whatever their case and the signs behind them, over calls; texts may be a slice of an Arrow array."""
    enc, seen = Chunks(TOKENIZER), []
    make = enc.cores.make
    enc.cores.make = lambda words: seen.extend(words) or make(words)
    texts = ["skipped", "Word word. WORD,&&& x\tword\nx$$$ été Été! don't 'tis a<|endoftext|>b$ " + "q" * 100, None, "", "word#? \r q " + "Q" * 100]
    t = Tokenizer.from_file(TOKENIZER)
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts[1:]]
    for given in (pa.array(texts).slice(1), texts[1:]):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.ids_of(given)] == want
    assert sorted(seen) == ["q", "word", "x", "été"]
    assert enc.ids_of([]) == [] and enc.ids_of([None]) == [b""]
