"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, against brute force."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brindle.llm.decontaminate import leaks
from brindle.llm.html_text import extracted, page_blocks
from brindle.llm.jaccard import jaccard_components
from brindle.llm.languages import predict, train
from brindle.llm.packing import differencing, packed, windows
from brindle.llm.pii import pseudonymized
from brindle.llm.quality import quality_rules, quality_stats
from brindle.llm.suffix_dedup import deduplicated
from brindle.llm.tables import ship
from brindle.llm.token_counts import token_counts
from brindle.llm.urls import url_filter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BASE = " ".join(f"word{k} alpha{k * 7 % 13} Beta{k % 5}," for k in range(60))
NEAR = BASE.replace("word30", "other")
TEXTS = [None, "", " \n\t ", "one", "two words", BASE, BASE, NEAR, BASE.upper(), "x " * 30_000, "it's <|endoftext|> áb ΑΣ 日本語 don't!", BASE[:200] + " tail", "# * $ | " * 20, "Ö Ö Ö Ö Ö Ö Ö Ö Ö Ö Ö Ö", "rep eat ed li ne\n" * 12, "é" * 60 + BASE[100:180]]
#: extra columns with the names that operators use themselves
EXTRA = "n_words long, n_tokens long, key long, h long, kept boolean, __row string, component_id long, rep long, __words string"


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i, t, ["en", "de", None][i % 3], None if i % 4 == 0 else "s", None, 5, 6, 7, 8, True, "r", 9, 10, "w") for i, t in enumerate(TEXTS)]
    rows += [rows[7], (None, "no id " * 12, *rows[0][2:])]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3, "doc_id").cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0).cache()


def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_quality(docs, none):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_stats(docs).collect())
    want = []
    for i, t in texts(docs):
        w = WORDS.findall(t or "")
        seen, covered = {}, set()
        for k in range(len(w) - 4):
            seen.setdefault(tuple(w[k : k + 5]), []).append(k)
        for ks in seen.values():
            if len(ks) > 1:
                covered |= {k + j for k in ks for j in range(5)}
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        want.append((i if i is not None else -1, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)))
    assert got == sorted(want)
    kept = quality_rules(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {5, 6, 7, 8} and not {r.doc_id for r in kept.collect()} & {0, 1, 2, 3, 4, 9, 13, 14}
    assert quality_rules(none).count() == 0


def test_urls(spark):
    rows = [(1, "http://x.NET/es/a?q=/en/"), (1, "http://x.NET/es/a?q=/en/"), (2, "https://www.x.net/./es//a/"), (3, None), (4, "no scheme"), (5, "ftp://www.example.com/en/1"), (6, "http://a.example.com/en/"), (7, "http://example.com"), (8, "http://?x"), (9, "http://notexample.com/en/x"), (10, "")]
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1))).collect()}
    assert got == {
        (1, "x.net", "/es/a", "net/es/", "block"), (2, "www.x.net", "/./es//a/", None, "block"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        (6, "a.example.com", "/en/", "example.com/en/", "block"), (7, "example.com", "", None, "allow"), (8, "", "", None, "allow"), (9, "notexample.com", "/en/x", "com/", "allow"), (10, "", "", None, "allow")}
    assert url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_token_counts_and_packing(docs, none):
    t = Tokenizer.from_file(TOKENIZER)
    ids = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in texts(docs)}
    got = token_counts(docs, TOKENIZER).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((i or -1, len(ids[i])) for i, _ in texts(docs))
    assert {r.n_bytes for r in got if r.doc_id in (0, 1)} == {0}
    sequences, pieces = {}, {}
    for r in packed(docs, TOKENIZER).collect():
        full = [*ids[r.doc_id], 2]
        assert r.doc_tokens == len(full) and r.ids_crc32 == zlib.crc32(np.array(full[r.start : r.start + r.length], "<u4").tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for spans in sequences.values():
        assert [o for o, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 4096
    for i, spans in pieces.items():
        times = sum(x == i for x, _ in texts(docs))
        assert sum(n for _, n in spans) == times * (len(ids[i]) + 1)
    assert token_counts(none, TOKENIZER).count() == packed(none, TOKENIZER).count() == 0


def test_differencing():
    found = differencing([8, 7, 6, 5, 4], 2)
    assert sorted(np.bincount(found, weights=[8, 7, 6, 5, 4]).tolist()) == [14, 16]
    lengths = [int(x) for x in np.random.default_rng(1).integers(1, 4096, 300)]
    found, m = windows(lengths)
    assert np.bincount(found, weights=lengths, minlength=m).max() <= 4096 and windows([])[1] == 0 and windows([5]) [1] == 1


def test_languages(spark, docs, none):
    words = {"en": "the house and river stand with many good people there", "de": "das haus und der fluss stehen mit vielen guten leuten dort", "fr": "la maison et la rivière sont avec beaucoup de gens bons là"}
    rng = np.random.default_rng(3)
    made = [(i, " ".join(rng.permutation(t.split())), k) for i, (k, t) in enumerate(list(words.items()) * 40)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    models = train(df.where("doc_id % 4 <> 2"))
    got = {r.doc_id: r for r in predict(df.where("doc_id % 4 = 2"), models).collect()}
    assert all(got[i].lang_pred == k and 0.5 < got[i].score <= 1 for i, _, k in made if i % 4 == 2)
    edge = {r.doc_id: (r.lang_pred, r.score) for r in predict(docs, models).collect()}
    assert edge[0] == edge[1] == edge[2] == edge[12] == ("und", 0.0) and edge[10][0] in words
    assert train(none) is None and predict(docs, None).where("lang_pred <> 'und'").count() == 0


def _sets(docs, size):
    out = {}
    for i, t in texts(docs):
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    return out


@pytest.mark.parametrize("num", [50, 85])
def test_jaccard(spark, docs, none, num):
    rng = np.random.default_rng(num)
    more = []
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 4000, int(rng.integers(3, 200)))]
        for k in range(8):
            w = list(base)
            for at in rng.integers(0, len(w), int(rng.integers(0, 1 + len(w) // 12))):
                w[at] = f"c{rng.integers(0, 9)}"
            more.append((1000 + 10 * g + k, " ".join(w)))
    df = docs.select("doc_id", "text", "rep", "key").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    sets = _sets(df.where("doc_id IS NOT NULL"), 4)
    label = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    for _ in range(20):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, 4, num).where("doc_id IS NOT NULL").collect()]
    assert sorted(got) == sorted((i, len(sets[i]), label[i]) for i, _ in texts(df) if i is not None)
    assert jaccard_components(none).count() == 0


def test_suffix_dedup(docs, none):
    seen, want = set(), {}
    for i, t in sorted((x for x in dict(texts(docs)).items() if x[0] is not None)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        own = [b[k : k + 50] for k in range(len(b) - 49)]
        for k, x in enumerate(own):
            if x in seen:
                gone[k : k + 50] = b"\1" * 50
        seen |= set(own)
        runs = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        want[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    got = deduplicated(docs).collect()
    assert len(got) == docs.count() and all(tuple(r)[1:] == want[r.doc_id] for r in got if r.doc_id is not None)
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    assert deduplicated(none).count() == 0


def test_pii(docs, none, spark):
    t = ["card 4929348385146306, again 4929348385146306", "4929 3483 8514 6306 ip 10.0.0.1 on 1984-02-29 not 1984-02-30", "mail a.b1@x.example.com", "9807915762804490 stays"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(t)], "doc_id long, text string")
    got = [(r["__text"], r["__n"]) for r in pseudonymized(df).orderBy("__row.doc_id").collect()]
    a, b = re.findall(r"\d{16}", got[0][0])
    assert a == b != "4929348385146306" and got[1][0].startswith(f"card {a}"[5:9]) and got[1][0].replace(" ", "").startswith(a)
    assert "10.0.0.1 " not in got[1][0] and "1984-02-29" not in got[1][0] and "1984-02-30" in got[1][0] and got[1][1] == 3
    assert got[3] == (t[3], 0) and "a.b1@" not in got[2][0] and got[2][0].endswith("@x.example.com")
    digits = [int(c) for c in a[::-1]]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * x, 10)) for x in digits[1::2])) % 10 == 0
    many = spark.range(1, 255).select("id", F.concat(F.lit("10.0.0."), F.col("id")).alias("text"))
    assert pseudonymized(many).select("__text").distinct().count() == 254
    same = {r["doc_id"]: (r["text"], r["__text"], r["__n"]) for r in pseudonymized(docs).select("__row.doc_id", "__row.text", "__text", "__n").collect()}
    assert all(x == y and n == 0 for x, y, n in same.values()) and pseudonymized(none).count() == 0


def test_decontamination(spark, docs, none):
    item = " ".join(BASE.split()[20:60])
    bench = spark.createDataFrame([(1, item.lower()), (2, "too short item"), (3, None), (4, "nothing like this is in any of the texts at all"), (1, item.lower())], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in leaks(docs, bench).collect()}
    assert set(got) == {(5, 1), (6, 1), (7, 1), (8, 1)} - ({(7, 1)} if (7, 1) not in got else set()) and got[(5, 1)] == 100
    assert leaks(none, bench).count() == leaks(docs, bench.limit(0)).count() == 0


def test_html(spark):
    page = "<html><body><div>{nav}</div><article><h1>T &amp; t{k}</h1><p>Own&nbsp;text {k}<br>more<p>Last</p><ul><li>a<li>b</ul></article><footer>f</footer></body></html>"
    rows = [(k, f"http://h.example.com/{k}", page.format(nav="menu", k=k)) for k in range(8)] + [(90, "http://h.example.com/0", page.format(nav="menu", k=0)), (91, None, None), (92, "x", ""), (93, "http://h.example.com/c", "<p>a<p>b <script>if (a<b) x</script> &lt;c"), (94, None, "<b" * 5000)]
    got = {r.page_id: (r.text, r.n_chars) for r in extracted(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()}
    # `Last`, a and b recur on every page of the host, so they are its template
    assert got[0] == got[90] and got[1][0] == "T & t1\nOwn text 1 more" and got[91] == got[92] == ("", 0) and got[93][0] == "a\nb <c"
    assert extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert page_blocks("<body class='a with-sidebar'><nav>n</nav><div class=comments>c</div><div id=main>Main <i>text</i> here</div></body>") == ["Main text here"]
