"""Stages of the pipeline on small tables."""

import corpus_pipeline


def test_near_duplicates(spark):
    """A text of 200 words with 4 scattered edits shares 176 of 216 shingles of five words (0.815); with 5, 171 of 221 (0.774)."""
    words = [f"w{k}" for k in range(200)]
    edited = lambda at: " ".join("changed" + w if k in at else w for k, w in enumerate(words))
    rows = [(1, edited([])), (2, edited([30, 70, 110, 150])), (3, edited([20, 55, 90, 125, 160])), (4, "a text of its own with some words"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [1, 3, 4, 5]


def test_whole_run_against_brute_force(spark, tmp_path):
    """Nulls, empty, repeated, copied, nearly copied and leaking texts, extra columns with names of the operators: what is left, and its tokens. With fewer
    documents than a fence needs, the base rules alone decide on quality."""
    import zlib
    from collections import defaultdict

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    dice = np.random.default_rng(7)
    own = lambda n: [f"w{x}" for x in dice.integers(0, 5000, n)]
    item = own(30)
    base = own(60)
    near = [*base[:30], "other", *base[31:]]
    texts = {1: None, 2: "", 3: "few words", 4: " ".join(base), 5: " ".join(base), 6: " ".join(near), 7: " ".join([*own(20), *item, *own(20)]), 8: " ".join(own(40) * 3), 9: " ".join(own(6000)), 10: " ".join(own(12))}
    rows = [(k, t, "en", "s", len(t or ""), True, 1, "x") for k, t in texts.items()]
    kind = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id long, __row string"
    docs = spark.createDataFrame([*rows, rows[9]], kind)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns
    # 1 to 3: too few words; 5 and 6: the smallest of copies and near copies stays; 7 leaks; 8 repeats itself
    assert sorted(r.doc_id for r in left.collect()) == [4, 9, 10, 10]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        found[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert sorted(found) == [4, 9, 10]
    for k, pieces in found.items():
        ids = [*t.encode(texts[k], add_special_tokens=False).ids, 2]
        copies = 2 if k == 10 else 1
        assert sum(p[1] for p in pieces) == copies * len(ids) and all(p[3] == len(ids) and p[2] == zlib.crc32(np.array(ids[p[0] : p[0] + p[1]], "<u4").tobytes()) for p in pieces)
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
