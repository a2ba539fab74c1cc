"""Composed and decomposed spellings of a cell are the same text."""

from brindle.operators import tables as t
from brindle.operators.tables import Condition, Spec

ROWS = [(0, 2, ["café", "1"]), (1, 3, ["café ", "2"]), (2, 4, ["cafe", "3"]), (3, 5, [None, "4"])]


def test_normal_form(spark):
    rows = spark.createDataFrame(ROWS, "row_index long, row_number long, cells array<string>")
    for value in ("café", "café"):
        assert [r.row_number for r in rows.where(t.selection(Spec("count", filters=(Condition(0, "eq", value),)))).orderBy("row_number").collect()] == [2, 3]
    got = {r.key: (r["count"], r.value) for r in t.groups(rows, Spec("group_sum", column=1, group_by=0), 2).collect()}
    assert got["café"] == (2, "3") and got["cafe"] == (1, "3") and got[""] == (1, "4") and len(got) == 3
