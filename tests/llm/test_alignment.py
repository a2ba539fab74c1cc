"""Operator 12 against encoding whole texts and comparing all offsets."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brindle.llm import alignment
from brindle.llm.alignment import alignment_digest, common
from brindle.llm.tables import ship, table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  ", "\n", "one", " lead", "trail ", "two  spaces  and   more", "line\nbreaks \n and\n\n  tabs\t\t x", "a\x1c b\x85 c　 d  e", "it's <|endoftext|> <s> </s> <unk> <0x41>", "日本語 áb ΑΣ \x00 🙂🙂 é", "under▁score ▁ x", "x" * 5000, "ab " * 20_000, "one", "ﬁ ½ " * 3, "​ zero", "don't  'll 12345 6.7e-8"]


def brute(docs):
    t, p = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b) if b in printed else chr(256 + [x for x in range(256) if x not in printed].index(b)): b for b in range(256)}
    rows, count = [], Counter()
    for i, text in docs:
        groups, links, na, nb = [], [], 0, 0
        if text:
            ia, ib, raw = t.encode(" " + text, add_special_tokens=False).ids, p.encode(text), (" " + text).encode()
            ta = [bytes(byte[c] for c in t.id_to_token(x)) for x in ia]
            tb = [bytes([int(p.id_to_piece(x)[3:5], 16)]) if p.is_byte(x) else p.id_to_piece(x).replace("▁", " ").encode() for x in ib]
            if b"".join(ta) == raw == b"".join(tb):
                na, nb = len(ia), len(ib)
                ends = [[sum(map(len, ts[: k + 1])) for k in range(len(ts))] if len(ts) < 100 else [] for ts in (ta, tb)]
                for e, ts in zip(ends, (ta, tb), strict=True):
                    at = 0
                    for x in ts if not e else []:
                        e.append(at := at + len(x))
                a0 = b0 = 0
                for x in sorted(set(ends[0]) & set(ends[1])):
                    a1, b1 = ends[0].index(x), ends[1].index(x)
                    groups.append(",".join(map(str, ia[a0 : a1 + 1])) + "|" + ",".join(map(str, ib[b0 : b1 + 1])))
                    links.append((ia[a1], ib[b1]))
                    a0, b0 = a1 + 1, b1 + 1
        count.update(links)
        rows.append((i, na, nb, links, groups))
    top = defaultdict(int)
    for (_, y), k in count.items():
        top[y] = max(top[y], k)
    return sorted(((i if i is not None else -1, na, nb, len(g), len(ls), sum(count[x] == top[x[1]] for x in ls), sum(count[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for i, na, nb, ls, g in rows))


def rows(df):
    cols = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((r.doc_id if r.doc_id is not None else -1, *[r[c] for c in cols]) for r in df.collect())


def test_galloping():
    random.seed(2)
    for _ in range(300):
        a, b = (sorted(random.sample(range(1, 120), random.randint(0, n))) for n in (9, 90))
        for x, y in ((a, b), (b, a)):
            both = sorted(set(x) & set(y))
            assert common(x, y) == ([x.index(v) for v in both], [y.index(v) for v in both])


def test_edges(spark, monkeypatch):
    ship(spark)
    docs = [*enumerate(TEXTS), (5, "one"), (None, "one two")]
    df = spark.createDataFrame([(*d, 1, 2, "p") for d in docs], "doc_id long, text string, row long, n_best long, pairs string").repartition(3)
    want = brute(docs)
    assert rows(alignment_digest(df, A, B)) == want
    monkeypatch.setattr(alignment, "SEND_PAIRS", 12)  # the rest goes through the shuffle
    assert rows(alignment_digest(df, A, B)) == want
    assert alignment_digest(df.limit(0), A, B).count() == 0


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").where(F.col("doc_id") < 80)
    assert rows(alignment_digest(docs, A, B)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
