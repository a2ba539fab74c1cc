"""Filter and group statistics over tables of text cells, with the source rows of every result."""

from __future__ import annotations

from dataclasses import dataclass, field

from unicodedata import normalize

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.numbers import clean, decimal, mean40, number_error, render
from brindle.functions.text import MISSING_FORMULA, strip

OPERATIONS = ("count", "sum", "mean", "min", "max", "group_count", "group_sum")
COMPARE = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}
BLANK = "（空白）"  # fixed value: the label of a blank group


@dataclass(frozen=True)
class Condition:
    column: int
    operator: str  # eq, ne, contains, gt, gte, lt, lte
    value: str


@dataclass(frozen=True)
class Spec:
    """What to compute. Numeric operations need a column, grouped ones group_by; others have neither."""

    operation: str
    column: int | None = None
    group_by: int | None = None
    filters: tuple[Condition, ...] = field(default=())

    def check(self, width: int) -> None:
        if self.operation not in OPERATIONS or len(self.filters) > 12:
            raise ValueError("unknown operation, or more than 12 filters")
        numeric, grouped = self.operation in ("sum", "mean", "min", "max", "group_sum"), self.operation.startswith("group_")
        if numeric != (self.column is not None) or grouped != (self.group_by is not None):
            raise ValueError(f"{self.operation} does not go with this column and group_by")
        if any(c is not None and not 0 <= c < width for c in (self.column, self.group_by, *(f.column for f in self.filters))):
            raise ValueError("a column is out of range")


def cell(i: int) -> Column:
    return F.coalesce(F.get("cells", F.lit(i)), F.lit(""))


def condition(c: Condition) -> Column:
    left, right = clean(cell(c.column)), strip(F.lit(normalize("NFC", c.value)))
    if c.operator in COMPARE:
        return getattr(decimal(cell(c.column)), COMPARE[c.operator])(decimal(F.lit(c.value)))
    return {"eq": left == right, "ne": left != right, "contains": F.contains(left, right)}[c.operator]


def selection(spec: Spec) -> Column:
    out = F.lit(True)
    for c in spec.filters:
        out &= F.coalesce(condition(c), F.lit(False))
    return out


def errors(rows: DataFrame, spec: Spec) -> DataFrame:
    """row_number, column, error: bad cells of numeric filters on all rows, of the value column on selected rows."""
    found = [F.struct(F.lit(c.column).alias("column"), number_error(cell(c.column)).alias("error")) for c in spec.filters if c.operator in COMPARE]
    if spec.column is not None:
        found.append(F.struct(F.lit(spec.column).alias("column"), F.when(selection(spec), number_error(cell(spec.column))).alias("error")))
    if not found:
        return rows.select("row_number", F.lit(0).alias("column"), F.lit("").alias("error")).limit(0)
    return rows.select("row_number", F.inline(F.array(*found))).where("error IS NOT NULL")


def _validated(rows: DataFrame, spec: Spec, on_error: str) -> DataFrame:
    if on_error == "raise":
        bad = errors(rows, spec).limit(1).collect()
        if bad:
            raise ValueError(f"row {bad[0]['row_number']}, column {bad[0]['column'] + 1}: {bad[0]['error']}")
    return rows.where(selection(spec))


def _value(spec: Spec) -> Column:
    if spec.operation in ("count", "group_count"):
        return F.count(F.lit(1)).cast("string")
    x = decimal(cell(spec.column))
    total = F.coalesce(F.sum(x), F.lit(0).cast("decimal(38,10)"))
    return {"sum": render(total), "group_sum": render(total), "min": render(F.min(x)), "max": render(F.max(x)), "mean": mean40(total.cast("string"), F.count(x))}[spec.operation]


def statistics(rows: DataFrame, spec: Spec, width: int, on_error: str = "raise") -> DataFrame:
    """One row: operation, value, total_rows, selected_rows, excluded_rows. One pass over rows, beside the check for errors."""
    spec.check(width)
    total = F.broadcast(rows.agg(F.count("*").alias("total_rows")))
    out = _validated(rows, spec, on_error).agg(_value(spec).alias("value"), F.count(F.lit(1)).alias("selected_rows")).crossJoin(total)
    return out.select(F.lit(spec.operation).alias("operation"), "value", "total_rows", "selected_rows", (F.col("total_rows") - F.col("selected_rows")).alias("excluded_rows"))


def groups(rows: DataFrame, spec: Spec, width: int, on_error: str = "raise", lineage: bool = True) -> DataFrame:
    """key, label, count, value and, with lineage, row_numbers of each group. lineage lists every row of a group: leave it out where
    groups are large, and join on the key instead."""
    spec.check(width)
    key = clean(cell(spec.group_by))
    key = F.when(key == MISSING_FORMULA, F.raise_error(F.lit("a group has no formula result"))).otherwise(key)
    rows = _validated(rows, spec, on_error).withColumn("key", key)
    more = [F.array_sort(F.collect_list("row_number")).alias("row_numbers")] if lineage else []
    out = rows.groupBy("key").agg(F.count(F.lit(1)).alias("count"), _value(spec).alias("value"), *more)
    return out.withColumn("label", F.when(F.col("key") == "", BLANK).otherwise(F.col("key")))


GROUPS, TABLES = 200, 1000  # fixed values: groups of an analysis, tables of a catalog
UNNAMED = "未命名列"  # fixed value: the label of a column without a name


def grouped_or_refused(rows: DataFrame, spec: Spec, width: int, on_error: str = "raise", most: int = GROUPS) -> DataFrame:
    """status, overall, key, label, count, value: the groups, with the value over all selected rows, or, beyond `most` groups, one row of status `refused`: nothing is
    cut off or merged. One more group than allowed is enough to refuse, so at most so many meet in the last task."""
    found = groups(rows, spec, width, on_error, lineage=False).limit(most + 1)
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    found = found.withColumn("__refused", n > most).withColumn("__at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("key")))
    shown = lambda c: F.when(~F.col("__refused"), F.col(c)).alias(c)
    overall = F.sum("count").over(Window.partitionBy(F.lit(0))).cast("string")
    if spec.operation == "group_sum":
        overall = render(F.sum(F.col("value").cast("decimal(38,10)")).over(Window.partitionBy(F.lit(0))))
    kept = found.withColumn("overall", overall).where("NOT __refused OR __at = 1")
    return kept.select(F.when(F.col("__refused"), "refused").otherwise("complete").alias("status"), shown("overall"), *[shown(c) for c in ("key", "label", "count", "value")])


def catalog(tables: DataFrame, rows: DataFrame, warnings: DataFrame, most: int = TABLES) -> DataFrame:
    """collection, document, table, caption, columns (index, name, label), row_count, column_count, source, warnings of tables (collection, document, filename, table, caption,
    headers), and status: `refused`, with nothing but the collection, where a collection has more than `most` tables. rows: document, table, one each; warnings: document, warning."""
    n = rows.groupBy("document", "table").agg(F.count("*").alias("row_count"))
    told = warnings.where("warning IS NOT NULL").groupBy("document").agg(F.array_sort(F.collect_set("warning")).alias("warnings"))
    too_many = tables.groupBy("collection").agg(F.count("*").alias("__n")).where(F.col("__n") > most).select("collection")
    refused = too_many.withColumn("status", F.lit("refused"))
    label = lambda name, i: F.concat((i + 1).cast("string"), F.lit(". "), F.when(name == "", UNNAMED).otherwise(name))
    columns = F.transform(F.transform("headers", lambda h: F.coalesce(h, F.lit(""))), lambda h, i: F.struct(i.alias("index"), h.alias("name"), label(h, i).alias("label")))
    good = tables.join(too_many, "collection", "left_anti").join(n, ["document", "table"], "left").join(told, "document", "left")
    source = F.struct("collection", "document", "filename", "table", "caption")
    out = good.select(
        "collection", F.lit("listed").alias("status"), "document", "table", "caption", columns.alias("columns"), F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.size("headers").cast("long").alias("column_count"), source.alias("source"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))
    return out.unionByName(refused, allowMissingColumns=True)


def lineage(rows: DataFrame, by: list[str], block: int = 1 << 16) -> DataFrame:
    """by, first, last: the row_numbers (each once) of each group as ranges without gaps, one row a range. Ranges are made within blocks of the table, so the rows of
    a group never meet, however many they are; only ranges that touch a block's border are shuffled by group, two a block at most, to be joined across borders."""
    r = rows.select(*by, "row_number", F.floor(F.col("row_number") / block).alias("__block"))
    within = Window.partitionBy("__block").orderBy("row_number")
    same = F.lag("row_number").over(within).eqNullSafe(F.col("row_number") - 1)
    for c in by:
        same &= F.lag(c).over(within).eqNullSafe(F.col(c)) & (F.row_number().over(within) > 1)
    r = r.withColumn("__new", (~same).cast("int")).withColumn("__run", F.sum("__new").over(within))
    runs = r.groupBy("__block", "__run", *by).agg(F.min("row_number").alias("first"), F.max("row_number").alias("last"))
    at_border = (F.col("first") == F.col("__block") * block) | (F.col("last") == (F.col("__block") + 1) * block - 1)
    across = Window.partitionBy(*by).orderBy("first")
    border = runs.where(at_border).withColumn("__new", (~F.lag("last").over(across).eqNullSafe(F.col("first") - 1)).cast("int"))
    border = border.withColumn("__run", F.sum("__new").over(across)).groupBy(*by, "__run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.where(~at_border).select(*by, "first", "last").unionByName(border.select(*by, "first", "last"))


def preview(rows: DataFrame, spec: Spec, width: int) -> DataFrame:
    """The first selected rows, at most 50 and at most 2000 cells."""
    return rows.where(selection(spec)).orderBy("row_number").limit(min(50, 2000 // max(1, width)))


def shape(rows: DataFrame, by: list[str], width: Column) -> DataFrame:
    """rows, cells, text characters and longest cell of each table, and whether all rows have the given width."""
    longest = F.array_max(F.transform("cells", F.length))
    chars = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.length(c))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.sum(F.size("cells")).alias("n_cells"), F.sum(chars).alias("n_chars"), F.max(longest).alias("longest_cell"),
        (F.min(F.size("cells") == width)).alias("even"))


def row_ranges(numbers: DataFrame, by: list[str]) -> DataFrame:
    """ranges `1–3, 7` of the distinct row_number of each group."""
    w = Window.partitionBy(*by).orderBy("row_number")
    islands = numbers.select(*by, "row_number").distinct().withColumn("i", F.col("row_number") - F.row_number().over(w))
    ends = islands.groupBy(*by, "i").agg(F.min("row_number").alias("a"), F.max("row_number").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("–", "a", "b"))
    listed = ends.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))).alias("l"))
    return listed.select(*by, F.array_join(F.transform("l", lambda x: x["t"]), ", ").alias("ranges"))


def row_chunks(rows: DataFrame, headers: list[str], caption: str) -> DataFrame:
    """chunk text of each table row: caption, headers, cells."""
    return rows.select("row_index", "row_number", F.concat(F.lit(f"{caption}\n{' | '.join(headers)}\n"), F.array_join("cells", " | ")).alias("content"))


def context(hits: DataFrame, rows: DataFrame, before: int = 3, most: int = 20) -> DataFrame:
    """table, hit, offset, total, rows (row_index and cells, in order) of hits (table, hit: a row_index; each once): the rows of its table from `before` rows above it, at most
    `most`. rows: table, row_index, cells. A window lies in two blocks of `most` rows at most, so windows meet their rows by an equal key; how
    many hits there are, or how many in one place, changes nothing else."""
    offset = F.greatest(F.lit(0), F.col("hit") - before)
    wanted = hits.select("table", "hit", offset.alias("offset")).distinct()
    block = lambda c: F.floor(c / most).cast("long")
    wanted = wanted.select("*", F.explode(F.array_distinct(F.array(block(F.col("offset")), block(F.col("offset") + most - 1)))).alias("block"))
    near = rows.withColumn("block", block(F.col("row_index"))).join(wanted, ["table", "block"]).where(f"row_index >= offset AND row_index < offset + {most}")
    listed = near.groupBy("table", "hit", "offset").agg(F.array_sort(F.collect_list(F.struct("row_index", "cells"))).alias("rows"))
    return listed.join(F.broadcast(rows.groupBy("table").agg(F.count("*").alias("total"))), "table").select("table", "hit", "offset", "total", "rows")
