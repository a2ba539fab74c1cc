"""Queries over the given tables: table statistics with lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.numbers import decimal, number_error, render
from brindle.functions.text import column_letter
from brindle.operators import tables as t
from brindle.operators.tables import Condition, Spec
from brindle.sources.views import table, table_cells

# orders: 0 orderkey, 1 custkey, 2 orderstatus, 3 totalprice, 4 orderdate, 5 orderpriority
WIDTH = 6
DEAR = (Condition(3, "gt", "100000"), Condition(5, "ne", "5-LOW"))


def _orders(spark, sf) -> DataFrame:
    return table_cells(spark, sf, "orders")


def flt02_predicates(spark: SparkSession, sf: str) -> DataFrame:
    spec = Spec("count", filters=(*DEAR, Condition(4, "contains", "-03-"), Condition(2, "eq", "O")))
    return _orders(spark, sf).where(t.selection(spec)).select("row_number")


def scl04_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with bad cells put in by rule: each kind of error is reported."""
    bad = F.create_map(*[F.lit(x) for k, v in enumerate(("", "n/a", "1,000", "12%")) for x in (k, v)])
    rows = _orders(spark, sf).select("row_number", F.coalesce(bad[(F.col("row_index") % 97).cast("int")], F.get("cells", F.lit(3))).alias("c"))
    return rows.select("row_number", "c", number_error(F.col("c")).alias("error")).where("error IS NOT NULL")


def ag08_count(spark: SparkSession, sf: str) -> DataFrame:
    return t.statistics(_orders(spark, sf), Spec("count", filters=DEAR), WIDTH)


def ag09_sum(spark: SparkSession, sf: str) -> DataFrame:
    return t.statistics(_orders(spark, sf), Spec("sum", column=3, filters=DEAR), WIDTH)


def ag10_mean(spark: SparkSession, sf: str) -> DataFrame:
    return t.statistics(_orders(spark, sf), Spec("mean", column=3, filters=DEAR), WIDTH).withColumn("value", F.round(F.col("value").cast("double"), 4))


def ag11_min_max(spark: SparkSession, sf: str) -> DataFrame:
    return t.statistics(_orders(spark, sf), Spec("min", column=3), WIDTH).unionByName(t.statistics(_orders(spark, sf), Spec("max", column=3), WIDTH))


def ag12_ag13_groups(spark: SparkSession, sf: str) -> DataFrame:
    g = t.groups(_orders(spark, sf), Spec("group_sum", column=3, group_by=5, filters=DEAR), WIDTH)
    return g.select("key", "label", "count", "value", F.size("row_numbers").cast("long").alias("n_rows"), F.md5(F.array_join(F.col("row_numbers").cast("array<string>"), ",")).alias("lineage"))


def ag14_pl04_summary(spark: SparkSession, sf: str) -> DataFrame:
    spec = Spec("group_count", group_by=2, filters=DEAR)
    n = t.groups(_orders(spark, sf), spec, WIDTH, lineage=False).agg(F.count("*").alias("group_count"))
    shown = t.preview(_orders(spark, sf), spec, WIDTH).agg(F.count("*").alias("preview_rows"))
    return t.statistics(_orders(spark, sf), spec, WIDTH).crossJoin(F.broadcast(n)).crossJoin(F.broadcast(shown))


def wn07_row_ranges(spark: SparkSession, sf: str) -> DataFrame:
    rows = _orders(spark, sf).where(t.selection(Spec("count", filters=DEAR))).select(F.get("cells", F.lit(2)).alias("status"), (F.col("row_number") % 50).alias("part"), "row_number")
    return t.row_ranges(rows, ["status", "part"])


def wn08_preview(spark: SparkSession, sf: str) -> DataFrame:
    return t.preview(_orders(spark, sf), Spec("count", filters=DEAR), WIDTH).select("row_number", F.array_join("cells", "|").alias("cells"))


def flt06_shape(spark: SparkSession, sf: str) -> DataFrame:
    both = _orders(spark, sf).select(F.lit("orders").alias("table_id"), "cells", F.lit(6).alias("width")).unionByName(table_cells(spark, sf, "part").select(F.lit("part").alias("table_id"), "cells", F.lit(6).alias("width")))
    return t.shape(both, ["table_id"], F.col("width"))


def prj03_row_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """By suffix: CSV rows count from 2, others from 1."""
    rows = _orders(spark, sf).select("row_index", F.explode(F.array(F.lit(".csv"), F.lit(".md"))).alias("suffix"))
    rows = rows.withColumn("n", F.col("row_index") + F.when(F.col("suffix") == ".csv", 2).otherwise(1))
    return rows.groupBy("suffix").agg(F.min("n").alias("first"), F.max("n").alias("last"), (F.count_distinct("n") == F.count("*")).alias("unique"))


def scl05_render(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", render(decimal(F.col("p_retailprice").cast("decimal(18,2)").cast("string"))).alias("price"))


def scl16_wn04_row_chunks(spark: SparkSession, sf: str) -> DataFrame:
    columns = table(spark, sf, "part").columns
    c = t.row_chunks(table_cells(spark, sf, "part"), columns, "part")
    n = F.col("row_number")
    return c.select("row_index", F.md5("content").alias("content"), F.concat(F.lit("A"), n.cast("string"), F.lit(":"), column_letter(F.lit(len(columns))), n.cast("string")).alias("cell_range"))


def ag15_catalog(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name in ("orders", "part", "customer"):
        df = table(spark, sf, name)
        labels = ", ".join(f"{i + 1}. {c}" for i, c in enumerate(df.columns))
        part = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_id"), F.lit(len(df.columns)).cast("long").alias("column_count"), "row_count", F.lit(labels).alias("columns"))
        out = part if out is None else out.unionByName(part)
    return out


def snk05_report(spark: SparkSession, sf: str) -> DataFrame:
    s = ag09_sum(spark, sf)
    return s.select(F.concat(F.lit("e_"), F.substring(F.sha2("operation", 256), 1, 24)).alias("evidence_id"), F.format_string("orders: %s is %s, %d of %d rows selected.", "operation", F.coalesce("value", F.lit("none")), "selected_rows", "total_rows").alias("summary"))


def jn06_tk04_tk05_context(spark: SparkSession, sf: str) -> DataFrame:
    """Hits at every 500th row of part: the rows from three before, at most 20, in order."""
    p = table_cells(spark, sf, "part")
    hits = p.where("row_index % 500 = 0").select(F.col("row_index").alias("hit"), F.greatest(F.lit(0), F.col("row_index") - 3).alias("offset"))
    near = p.join(F.broadcast(hits), (p["row_index"] >= hits["offset"]) & (p["row_index"] < hits["offset"] + 20))
    listed = near.groupBy("hit", "offset").agg(F.array_sort(F.collect_list(F.struct("row_index", "cells"))).alias("rows"))
    return listed.select("hit", "offset", F.size("rows").cast("long").alias("n"), F.md5(F.array_join(F.transform("rows", lambda r: F.array_join(r["cells"], "|")), "\n")).alias("rows"))


def ag13_lineage_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of orders by the first letters of status and priority, as ranges."""
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.left("o_orderpriority", F.lit(1)).alias("priority"), (F.col("o_orderkey") + 2).alias("row_number"))
    return t.lineage(o, ["status", "priority"], block=1000)


QUERIES = {f.__name__: f for f in (
    ag13_lineage_ranges, flt02_predicates, scl04_errors, ag08_count, ag09_sum, ag10_mean, ag11_min_max, ag12_ag13_groups, ag14_pl04_summary, wn07_row_ranges, wn08_preview, flt06_shape, prj03_row_numbers,
    scl05_render, scl16_wn04_row_chunks, ag15_catalog, snk05_report, jn06_tk04_tk05_context,
)}

_CELLS = "[o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, o_totalprice::DECIMAL(18,2)::VARCHAR, strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority]"
_PCELLS = "[p_partkey::VARCHAR, p_name, p_brand, p_type, p_size::VARCHAR, p_retailprice::DECIMAL(18,2)::VARCHAR]"
_D = "o_totalprice::DECIMAL(18,2) > 100000 AND o_orderpriority <> '5-LOW'"
_NUM = "CASE WHEN {0} = 0 THEN '0' ELSE rtrim(rtrim({0}::DECIMAL(38,2)::VARCHAR, '0'), '.') END"
_SUM = "(SELECT count(*) FROM orders) AS total_rows, count(*) AS selected_rows, (SELECT count(*) FROM orders) - count(*) AS excluded_rows"
_X = "o_totalprice::DECIMAL(18,2)"
SQL = {
    "ag13_lineage_ranges": """WITH r AS (SELECT o_orderstatus AS status, left(o_orderpriority, 1) AS priority, o_orderkey + 2 AS n FROM orders),
      i AS (SELECT *, n - row_number() OVER (PARTITION BY status, priority ORDER BY n) AS i FROM r)
      SELECT status, priority, min(n) AS first, max(n) AS last FROM i GROUP BY status, priority, i""",
    "flt02_predicates": f"SELECT o_orderkey + 2 AS row_number FROM orders WHERE {_D} AND strftime(o_orderdate, '%Y-%m-%d') LIKE '%-03-%' AND o_orderstatus = 'O'",
    "scl04_errors": "SELECT o_orderkey + 2 AS row_number, CASE o_orderkey % 97 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN '1,000' ELSE '12%' END AS c, CASE o_orderkey % 97 WHEN 0 THEN 'blank' ELSE 'not a number' END AS error FROM orders WHERE o_orderkey % 97 < 4",
    "ag08_count": f"SELECT 'count' AS operation, count(*)::VARCHAR AS value, {_SUM} FROM orders WHERE {_D}",
    "ag09_sum": f"SELECT 'sum' AS operation, {_NUM.format(f'sum({_X})')} AS value, {_SUM} FROM orders WHERE {_D}",
    "ag10_mean": f"SELECT 'mean' AS operation, round(sum({_X})::DOUBLE / count(*), 4) AS value, {_SUM} FROM orders WHERE {_D}",
    "ag11_min_max": f"SELECT 'min' AS operation, {_NUM.format(f'min({_X})')} AS value, {_SUM} FROM orders UNION ALL SELECT 'max', {_NUM.format(f'max({_X})')}, {_SUM} FROM orders",
    "ag12_ag13_groups": f"SELECT o_orderpriority AS key, o_orderpriority AS label, count(*) AS count, {_NUM.format(f'sum({_X})')} AS value, count(*) AS n_rows, md5(string_agg(o_orderkey + 2, ',' ORDER BY o_orderkey)) AS lineage FROM orders WHERE {_D} GROUP BY 1, 2",
    "ag14_pl04_summary": f"SELECT 'group_count' AS operation, count(*)::VARCHAR AS value, {_SUM}, count(DISTINCT o_orderstatus) AS group_count, least(count(*), 50) AS preview_rows FROM orders WHERE {_D}",
    "wn07_row_ranges": f"""WITH r AS (SELECT o_orderstatus AS status, (o_orderkey + 2) % 50 AS part, o_orderkey + 2 AS n FROM orders WHERE {_D}),
      i AS (SELECT *, n - row_number() OVER (PARTITION BY status, part ORDER BY n) AS i FROM r), e AS (SELECT status, part, min(n) AS a, max(n) AS b FROM i GROUP BY status, part, i)
      SELECT status, part, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '–' || b END, ', ' ORDER BY a) AS ranges FROM e GROUP BY 1, 2""",
    "wn08_preview": f"SELECT o_orderkey + 2 AS row_number, array_to_string({_CELLS}, '|') AS cells FROM orders WHERE {_D} ORDER BY o_orderkey LIMIT 50",
    "flt06_shape": f"""SELECT table_id, count(*) AS n_rows, sum(len(c))::BIGINT AS n_cells, sum(list_sum(list_transform(c, lambda x: length(x))))::BIGINT AS n_chars, max(list_max(list_transform(c, lambda x: length(x)))) AS longest_cell, true AS even
      FROM (SELECT 'orders' AS table_id, {_CELLS} AS c FROM orders UNION ALL SELECT 'part', {_PCELLS} FROM part) GROUP BY 1""",
    "prj03_row_numbers": "SELECT '.csv' AS suffix, 2 AS first, count(*) + 1 AS last, true AS \"unique\" FROM orders UNION ALL SELECT '.md', 1, count(*), true FROM orders",
    "scl05_render": f"SELECT p_partkey, {_NUM.format('p_retailprice::DECIMAL(18,2)')} AS price FROM part",
    "scl16_wn04_row_chunks": f"""WITH r AS (SELECT p_partkey AS i, p_partkey + 2 AS n, {_PCELLS} AS c FROM part)
      SELECT i AS row_index, md5('part' || chr(10) || 'p_partkey | p_name | p_brand | p_type | p_size | p_retailprice' || chr(10) || array_to_string(c, ' | ')) AS content,
      'A' || n || ':F' || n AS cell_range FROM r""",
    "ag15_catalog": " UNION ALL ".join(f"SELECT '{n}' AS table_id, {len(c)}::BIGINT AS column_count, (SELECT count(*) FROM {n}) AS row_count, '{', '.join(f'{i + 1}. {x}' for i, x in enumerate(c))}' AS columns" for n, c in {
        "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split(), "part": "p_partkey p_name p_brand p_type p_size p_retailprice".split(),
        "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment".split()}.items()),
    "snk05_report": f"SELECT 'e_' || left(sha256('sum'), 24) AS evidence_id, 'orders: sum is ' || {_NUM.format(f'sum({_X})')} || ', ' || count(*) || ' of ' || (SELECT count(*) FROM orders) || ' rows selected.' AS summary FROM orders WHERE {_D}",
    "jn06_tk04_tk05_context": f"""WITH p AS (SELECT p_partkey AS i, array_to_string({_PCELLS}, '|') AS c FROM part), h AS (SELECT i AS hit, greatest(0, i - 3) AS o FROM p WHERE i % 500 = 0)
      SELECT hit, o AS "offset", count(*) AS n, md5(string_agg(c, chr(10) ORDER BY i)) AS rows FROM h JOIN p ON i >= o AND i < o + 20 GROUP BY 1, 2""",
}
