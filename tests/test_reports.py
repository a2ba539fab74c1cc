"""Word blocks against a fold over one document; ranges of rows over block borders; results that are sound and unsound."""

import random
import re

from pyspark.sql import functions as F

from brindle.operators import reports, tables
from brindle.sources import files


def fold(blocks):
    """Paragraphs and tables of one document, read in order."""
    title, number, parents, out, found = "T", 0, [], [], []
    for kind, style, text, rows in blocks:
        if kind == "paragraph":
            number += 1
            text = (text or "").strip()
            if not text:
                continue
            if m := re.fullmatch(r"(?:Heading|标题)\s*([0-9])", style or "", re.IGNORECASE):
                parents = [p for p in parents if p[0] < int(m[1])] + [(int(m[1]), text)]
                title = text
            out.append((number, title, " / ".join(t for _, t in parents), text))
        elif width := max(map(len, rows), default=0):
            found.append((len(found) + 1, title, " / ".join(t for _, t in parents), [[c.strip() for c in r] + [""] * (width - len(r)) for r in rows]))
    return out, found


def test_word_stream(spark):
    random.seed(11)
    styles = [None, "Normal", "Heading 1", "heading2", "标题 3", "Heading 10", "Heading 0", "HEADING 2"]
    docs = {d: [(random.choice(["paragraph", "paragraph", "table"]), random.choice(styles), random.choice([" a ", "b", "", None, "c d"]), random.choice([[["x", " y "], ["z"]], [], [[]], [["q"]]])) for _ in range(random.randint(1, 40))] for d in range(12)}
    rows = [(d, "T", k * 3, *b) for d, bs in docs.items() for k, b in enumerate(bs)]
    stream = files.word_stream(spark.createDataFrame(rows, "doc long, title string, seq long, kind string, style string, text string, rows array<array<string>>"))
    got, cut = {d: [] for d in docs}, {d: [] for d in docs}
    for r in files.word_paragraphs(stream).orderBy("doc", "paragraph").collect():
        got[r.doc].append((r.paragraph, r.section, r.heading_path, r.text))
    for r in files.word_tables(stream).orderBy("doc", "table").collect():
        cut[r.doc].append((r.table, r.section, r.heading_path, r.rows))
    for d, bs in docs.items():
        assert (got[d], cut[d]) == fold(bs), d


def test_lineage(spark):
    random.seed(12)
    rows = [(random.choice("aaab"), None if k % 90 == 0 else "g", k) for k in range(500) if k % 37] + [("a", "g", k) for k in range(500, 900)]
    got = sorted((r.k or "", r.g or "", r.first, r.last) for r in tables.lineage(spark.createDataFrame(rows, "k string, g string, row_number long").repartition(5), ["k", "g"], block=64).collect())
    want, held = [], {}
    for k, g, n in sorted(rows, key=lambda r: (r[0], r[1] or "", r[2])):
        key = (k, g or "")
        if held.get(key) and held[key][-1][1] == n - 1:
            held[key][-1][1] = n
        else:
            held.setdefault(key, []).append([n, n])
    want = sorted((*key, a, b) for key, rs in held.items() for a, b in rs)
    assert got == want


def test_integrity(spark):
    kind = ("result long, question string, document_ids array<string>, summary string, summary_evidence_ids array<string>, findings array<struct<text:string,evidence_ids:array<string>>>, conflicts array<struct<text:string,evidence_ids:array<string>>>,"
            " recommendations array<string>, missing_information array<string>, evidence array<struct<evidence_id:string,document_id:string,kind:string,calculation_id:string>>, calculations array<struct<calculation_id:string,document_id:string>>")
    e = ("e1", "d1", "document", None)
    sound = [1, "q", ["d1"], "s", ["e1"], [("f", ["e1"])], [], ["do"], [], [e, ("e2", "d1", "calculation", "c1")], [("c1", "d1")]]
    bare = [2, "q", ["d1"], "s", [], [], [], ["do"], ["more"], [e], []]
    many = [3, "q", ["d1"], "s", ["e1"], [], [], [], [], [(f"e{k}", "d1", "document", None) for k in range(65)], [(f"c{k}", "d1") for k in range(21)]]
    broken = [4, None, ["d1"], "s", ["e1", "e1", "e9"], [], [], [], [], [e, e, (None, None, "calculation", None)], [("c1", "d2"), ("c1", "d1"), (None, "d1")]]
    empty = [5, "q", None, "s", [], [("f", [])], [], [], ["x"], [], []]
    df = spark.createDataFrame([tuple(r) for r in (sound, bare, many, broken, empty)], kind)
    got = {(r.result, r.rule) for r in reports.violations(df).collect()}
    assert got == {(3, "evidence over limit"), (3, "calculations over limit"), (4, "evidence without id"), (4, "evidence repeated"), (4, "evidence outside documents"), (4, "calculation without id"), (4, "calculation repeated"),
                   (4, "calculation outside documents"), (4, "calculation missing"), (4, "reference repeated"), (4, "reference unknown"), (4, "question"), (5, "summary without sources")}
    assert {(r.result, r.summary, r.recommendations == ["do"]) for r in reports.published(df).collect()} == {(1, "s", True), (2, reports.NO_EVIDENCE, False)}


def test_section_context(spark):
    p = spark.createDataFrame([("d", "s", 1, None, 2, "two"), ("d", "s", 1, "x", 1, "one"), ("d", "t", 1, None, 3, "other"), ("d", "s", 2, None, 4, "page")], "document string, section string, page int, source string, place int, text string")
    h = spark.createDataFrame([(1, "d", "s", 1, None, "own"), (2, "d", "s", 1, "x", "own"), (3, "d", "u", 1, None, "own")], "hit long, document string, section string, page int, source string, content string")
    got = {(r.hit, r.context, r.truncated) for r in reports.section_context(h, p, 6).collect()}
    assert got == {(1, "one\n\nt", True), (2, "one", False), (3, "own", False)}
