"""Snapshots: what a reader sees before, during and after a replace, and after one that fails."""

import pytest
from pyspark.sql import functions as F

from brindle.sources import snapshots


def rows(df):
    return sorted((r.collection, r.document, r.text) for r in df.collect())


def frame(spark, data):
    return spark.createDataFrame(data, "collection string, document string, text string")


@pytest.fixture
def index(spark, tmp_path):
    path = str(tmp_path / "index")
    first = frame(spark, [(f"c{i % 2}", f"d{i}", f"v1 {i} {k}") for i in range(40) for k in range(2)])
    assert snapshots.latest(spark, path) == 0
    assert snapshots.replace_documents(path, first, {"chunks": first}) == 1
    return path, first


def test_replace(spark, index):
    path, first = index
    before = snapshots.read(spark, path, "chunks")
    changed = frame(spark, [("c1", "d3", "v2"), ("c1", "d5", "v2"), ("c0", "new", "v2")])
    gone = frame(spark, [("c0", "d0", "")])
    assert snapshots.replace_documents(path, changed.unionByName(gone), {"chunks": changed}) == 2
    assert rows(before) == rows(first)  # one who began to read before
    want = [r for r in rows(first) if r[1] not in ("d3", "d5", "d0")] + rows(changed)
    assert rows(snapshots.read(spark, path, "chunks")) == sorted(want)
    assert rows(snapshots.read(spark, path, "chunks", version=1)) == rows(first)
    assert rows(snapshots.read(spark, path, "chunks", collections=["c0"])) == sorted(r for r in want if r[0] == "c0")
    assert snapshots.rows_of(spark, path, "chunks") == len(want)
    one, two = (snapshots.manifest(spark, path, v)["tables"]["chunks"]["parts"] for v in (1, 2))
    moved = {k for k in two if one.get(k) != two[k]}
    assert len(moved) <= 4 and len(two) - len(moved) >= 10  # untouched partitions stay
    assert snapshots.manifest(spark, path)["revisions"] == {"c0": 2, "c1": 2}
    only = frame(spark, [("c1", "d3", "v3")])
    snapshots.replace_documents(path, only, {"chunks": only})
    assert snapshots.manifest(spark, path)["revisions"] == {"c0": 2, "c1": 3}


def test_failures_leave_the_old_version(spark, index):
    path, first = index
    new = frame(spark, [("c0", "d2", "v2")])
    with pytest.raises(ValueError):
        snapshots.replace_documents(path, new, {"chunks": new}, limits={"chunks": 10})
    with pytest.raises(KeyError):
        snapshots.replace_documents(path, new, {"chunks": new}, known=frame(spark, [("c1", "d2", "")]))
    broken = new.withColumn("text", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        snapshots.replace_documents(path, new, {"chunks": broken})
    assert snapshots.latest(spark, path) == 1 and rows(snapshots.read(spark, path, "chunks")) == rows(first)


def test_one_of_two_writers_fails(spark, index):
    path, first = index
    a, b = frame(spark, [("c0", "d2", "a")]), frame(spark, [("c0", "d4", "b")])
    assert snapshots.replace_documents(path, a, {"chunks": a}, expected=1) == 2
    with pytest.raises(snapshots.Conflict):
        snapshots.replace_documents(path, b, {"chunks": b}, expected=1)
    assert ("c0", "d2", "a") in rows(snapshots.read(spark, path, "chunks")) and ("c0", "d4", "b") not in rows(snapshots.read(spark, path, "chunks"))
    assert snapshots.replace_documents(path, b, {"chunks": b}) == 3


def test_a_further_table_and_an_empty_index(spark, index):
    path, _ = index
    vectors = frame(spark, [("c0", "d2", "x")])
    snapshots.replace_documents(path, vectors, {"chunks": vectors, "vectors": vectors})
    assert rows(snapshots.read(spark, path, "vectors")) == rows(vectors)
    everything = snapshots.read(spark, path, "chunks")
    snapshots.replace_documents(path, everything, {})
    assert snapshots.read(spark, path, "chunks").count() == 0 and snapshots.read(spark, path, "vectors").count() == 0
