import json

import pytest
from pyspark.sql import functions as F

from brindle.operators import access, evaluation, logs, ranking, requests, runs
from brindle.operators import tables as t


def test_modes_compose_channels(spark):
    asked = []

    def channel(name, ids):
        def top(n):
            asked.append((name, n))
            return spark.createDataFrame([(1, c, 1.0 / r, r) for r, c in enumerate(ids, 1)][:n], "query_id int, chunk_id string, score double, rank int")

        return top

    words, text, image = channel("bm25", ["a", "b", "c"]), channel("dense", ["b", "d"]), channel("image", ["d", "c"])
    ids = lambda df: [r["chunk_id"] for r in df.orderBy("rank").collect()]
    assert ids(ranking.retrieved("bm25", 2, words)) == ["a", "b"] and asked == [("bm25", 2)]
    asked.clear()
    assert ids(ranking.retrieved("hybrid", 1, words, text, image)) == ["b"] and asked == [("bm25", 20), ("dense", 20)]
    asked.clear()
    # without text vectors a multimodal search fuses words and images
    assert ids(ranking.retrieved("auto", 9, words, image=image)) == ["c", "a", "d", "b"] and [a for a, _ in asked] == ["bm25", "image"]
    assert ids(ranking.retrieved("multimodal", 9, words, text, image))[:2] == ["b", "d"]
    last = lambda found, k: found.where("chunk_id = 'd'").limit(k)
    assert ids(ranking.retrieved("auto", 1, words, text, image, last)) == ["d"]
    for mode in ("dense", "image", "hybrid_rerank", "multimodal"):
        with pytest.raises(RuntimeError):
            ranking.retrieved(mode, 1, words)


def test_report_is_written_and_its_digest_is_of_the_rows(spark, tmp_path):
    ex = spark.createDataFrame([(1, "one", "x"), (2, None, "y"), (3, "three", "y")], "query_id long, question string, category string")
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (9, "z")], "query_id long, chunk_id string")
    ranked = spark.createDataFrame([(1, "c", 1.0, 1), (1, "a", 0.5, 2), (2, "a", 0.5, 1)], "query_id long, chunk_id string, score double, rank int")
    evaluation.write_report(str(tmp_path), ex, gold, {"bm25": ranked, "image": "no index"}, ["query_id", "question"])
    done, found = (df.collect() for df in evaluation.read_report(spark, str(tmp_path)))
    by = {r["mode"]: r for r in done}
    assert (by["bm25"]["sample_count"], by["bm25"]["relevance_sample_count"], by["bm25"]["unanswerable_sample_count"], by["bm25"]["mrr"], by["bm25"]["empty_retrieval"]) == (3, 1, 2, 0.5, 0.5)
    assert by["image"]["status"] == "unavailable" and by["image"]["reason"] == "no index" and by["image"]["mrr"] is None
    assert {r["query_id"]: (r["ranked_ids"], r["mrr"], r["empty_retrieval"]) for r in found} == {1: (["c", "a"], 0.5, None), 2: (["a"], None, 0.0), 3: ([], None, 1.0)}
    assert json.loads(next((tmp_path / "runs").glob("*.json")).read_text().splitlines()[0])["mode"] == "bm25"
    digest = lambda df: evaluation.dataset_digest(df, ["query_id", "question"]).first()[0]
    assert digest(ex) == digest(ex.orderBy(F.desc("query_id"))) == by["bm25"]["dataset_sha256"]
    assert len({digest(ex), digest(ex.union(ex)), digest(ex.fillna("", ["question"])), digest(ex.limit(0))}) == 4
    with pytest.raises(ValueError):
        evaluation.write_report(str(tmp_path / "none"), ex.limit(0), gold, {}, ["query_id"])
    assert not (tmp_path / "none").exists()


def test_a_report_searches_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    ranked = spark.createDataFrame([(1, "c", 1.0, 1), (1, "a", 0.5, 2), (2, "a", 0.5, 1)], "query_id long, chunk_id string, score double, rank int")
    ex = spark.createDataFrame([(1, "one", "x"), (2, "two", "y")], "query_id long, question string, category string")
    evaluation.write_report(str(tmp_path), ex, spark.createDataFrame([(1, "a")], "query_id long, chunk_id string"), {"bm25": ranked.mapInArrow(counted, ranked.schema)}, ["query_id"])
    assert seen.value == 3 and evaluation.read_report(spark, str(tmp_path))[0].first()["mrr"] == 0.5


def test_requests_break_one_rule_each(spark):
    good = (" q ", 5, "a_b-1", "auto", ["d"], 1, "s", "text")
    broken = {"blank": (0, "　\n"), "length": (0, "x" * 8001), "k": (1, 21), "collection": (2, "../x"), "mode": (3, "fast"), "documents": (4, ["d"] * 101), "page": (5, 0), "section": (6, "s" * 201), "content_type": (7, "video")}
    rows = [("none", *good)] + [(name, *good[:i], v, *good[i + 1 :]) for name, (i, v) in broken.items()]
    rows += [("none", "q", 20, "a", "image", None, None, None, None), ("blank", None, 0, "", None, None, None, None, None), ("collection", "q", 1, "a\n", "auto", None, None, None, None), ("mode", "q", 1, "a", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "want string, question string, k int, collection string, mode string, document_ids array<string>, page int, section string, content_type string")
    got = requests.validated(df).collect()
    assert all((r["reason"] or "none") == r["want"] for r in got) and got[0]["question"] == "q"
    taken, refused = requests.split(df)
    assert taken.count() == 2 and refused.count() == len(rows) - 2 and "reason" not in taken.columns
    assert requests.validated(df.select("question", F.lit(100).alias("k")), most=100).where("reason IS NULL").count() == len(rows) - 3
    assert requests.validated(df.limit(0)).count() == 0


def test_tasks_show_only_with_all_their_documents(spark):
    known = {
        "users": spark.createDataFrame([(1, "member", True), (2, "member", True), (9, "admin", True), (8, "admin", False)], "actor int, role string, active boolean"),
        "grants": spark.createDataFrame([("c", 1, "viewer"), ("c", 2, "viewer")], "collection string, actor int, role string"),
        "policies": spark.createDataFrame([(10, True), (11, True)], "document int, restricted boolean"),
        "document_grants": spark.createDataFrame([(10, 1, "viewer")], "document int, actor int, role string"),
    }
    tasks = spark.createDataFrame([("open", 1, "c"), ("mine", 1, "c"), ("held", 1, "c"), ("other", 1, "d"), ("bare", 2, "c")], "task string, owner int, collection string")
    refers = spark.createDataFrame([("open", 5), ("mine", 5), ("mine", 10), ("mine", 10), ("held", 10), ("held", 11), ("other", 5), ("bare", None)], "task string, document int")
    asked = tasks.select("task").union(spark.createDataFrame([("unknown",)], "task string")).crossJoin(spark.createDataFrame([(1,), (2,), (8,), (9,), (7,)], "actor int"))
    shown = {(r["actor"], r["task"]) for r in access.shown_tasks(asked, tasks, refers, **known).where("shown").collect()}
    assert shown == {(1, "open"), (1, "mine"), (2, "bare")} | {(9, x) for x in ("open", "mine", "held", "other", "bare")}


def test_retention_of_jobs_and_sessions_and_restarts(spark):
    day = 86400.0
    jobs = [(i, "succeeded", i * 10.0, 100 * day - i * 5 * day) for i in range(12)] + [(50, "running", 0.0, 0.0), (51, "queued", 1.0, 1.0), (52, None, 200.0, 99 * day), (53, "failed", 110.0, None)]
    df = spark.createDataFrame(jobs, "id int, status string, created_at double, updated_at double")
    plain = sorted([j for j in jobs if j[1] not in ("queued", "running")], key=lambda j: (-j[2], -j[0]))[:9]
    want = {j[0] for j in plain if j[3] is not None and j[3] >= 100 * day - 30 * day} | {50, 51}
    assert {r["id"] for r in logs.retained_jobs(df, 100 * day, newest_n=9).collect()} == want
    assert logs.retained_jobs(df.limit(0), 0.0).count() == 0
    s = spark.createDataFrame([(u, i, float(i // 2)) for u in (1, 2) for i in range(40 * u)], "user int, id int, expires double")
    kept = sorted((r["user"], r["id"]) for r in logs.live_sessions(s, 10.0, 10).collect())
    assert kept == [(1, i) for i in range(30, 40)] + [(2, i) for i in range(70, 80)]
    states = spark.createDataFrame([("a", "running", 1.0), ("b", "running", 5.0), ("c", "succeeded", 1.0), ("d", "queued", 2.0), ("e", None, 1.0)], "task string, status string, at double")
    again = lambda times: {r["task"]: (r["status"], r["interrupted"]) for r in logs.after_restarts(states, spark.createDataFrame([(x,) for x in times], "at double")).collect()}
    assert again([0.5, 2.0]) == {"a": ("failed", True), "b": ("running", False), "c": ("succeeded", False), "d": ("queued", False), "e": (None, False)}
    assert all(not x[1] for x in again([]).values())


def test_groups_beyond_the_limit_are_refused_whole(spark):
    rows = spark.createDataFrame([(i, i + 1, [str(i % 7), "0.5"]) for i in range(70)], "row_index long, row_number long, cells array<string>")
    spec = t.Spec("group_sum", 1, 0)
    got = t.grouped_or_refused(rows, spec, 2, most=7).collect()
    assert len(got) == 7 and {(r["status"], r["overall"], r["count"], r["value"]) for r in got} == {("complete", "35", 10, "5")}
    got = t.grouped_or_refused(rows, spec, 2, most=6).collect()
    assert [(r["status"], r["overall"], r["key"], r["value"]) for r in got] == [("refused", None, None, None)]
    assert t.grouped_or_refused(rows.limit(0), spec, 2).count() == 0
    assert t.grouped_or_refused(rows, t.Spec("group_count", None, 1), 2).first()["overall"] == "70"


def test_catalog_and_visuals(spark):
    tables = spark.createDataFrame([("big", f"d{i}", "f", 1, None, ["h"]) for i in range(3)] + [("c", "e", "e.csv", 1, "cap", ["a", "", None]), ("c", "e", "e.csv", 2, "", [])], "collection string, document string, filename string, table int, caption string, headers array<string>")
    rows = spark.createDataFrame([("e", 1)] * 4 + [("d0", 1)], "document string, table int")
    warnings = spark.createDataFrame([("e", "w2"), ("e", "w1"), ("e", "w1"), ("e", None)], "document string, warning string")
    got = t.catalog(tables, rows, warnings, most=2).orderBy("collection", "table").collect()
    assert [(r["collection"], r["status"], r["row_count"], r["warnings"]) for r in got] == [("big", "refused", None, None), ("c", "listed", 4, ["w1", "w2"]), ("c", "listed", 0, ["w1", "w2"])]
    assert [c["label"] for c in got[1]["columns"]] == ["1. a", "2. 未命名列", "3. 未命名列"] and got[2]["columns"] == [] and got[1]["source"]["filename"] == "e.csv"
    docs, lines = spark.createDataFrame([("e",), ("e",)], "document string"), spark.createDataFrame([("e", 1, i, f"r{i}") for i in range(30)] + [("x", 1, 0, "no")], "document string, table int, row_index int, content string")
    figures = spark.createDataFrame([("e", 4, "fig")], "document string, position int, content string")
    shown = runs.visuals(docs, figures, lines, warnings).collect()
    assert sorted(r["position"] for r in shown if r["kind"] == "row") == list(range(20)) and {r["total_rows"] for r in shown if r["kind"] == "row"} == {30}
    assert sorted((r["position"], r["content"]) for r in shown if r["kind"] != "row") == [(0, "w1"), (1, "w2"), (4, "fig")]
