"""Joins between boxes on pages. Boxes are x0, y0, x1, y1, with y growing downwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import caption_kind, strip

REACH, SLACK, LESS = 90, 8, 30  # how far a caption may be, how far it may reach into its box, and what the worse side costs
COVERED = 0.8
_BOX = ("x0", "y0", "x1", "y1")


def nearby(regions: DataFrame, blocks: DataFrame, n: int = 3, reach: float = 180, limit: int = 1800) -> DataFrame:
    """doc, page, region, nearby: text of the n nearest blocks that overlap sideways and lie within reach, from top to bottom."""
    r = regions.select("doc", "page", "region", *[F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")])
    pairs = r.join(blocks, ["doc", "page"]).where("least(rx1, x1) > greatest(rx0, x0)")
    pairs = pairs.withColumn("distance", F.greatest(F.lit(0.0), F.col("y0") - F.col("ry1"), F.col("ry0") - F.col("y1"))).where(F.col("distance") < reach)
    w = Window.partitionBy("doc", "page", "region").orderBy("distance", "y0", "text")
    near = pairs.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    listed = near.groupBy("doc", "page", "region").agg(F.array_sort(F.collect_list(F.struct("y0", "k", "text"))).alias("t"))
    return listed.select("doc", "page", "region", F.left(F.array_join(F.transform("t", lambda x: x["text"]), "\n"), F.lit(limit)).alias("nearby"))


def outside(boxes: DataFrame, holders: DataFrame) -> DataFrame:
    """boxes within which no holder (doc, page, box) of the page lies wholly."""
    h = holders.select("doc", "page", *[F.col(c).alias(f"h{c}") for c in ("x0", "y0", "x1", "y1")])
    inside = (boxes["doc"] == h["doc"]) & (boxes["page"] == h["page"]) & (h["hx0"] >= boxes["x0"]) & (h["hy0"] >= boxes["y0"]) & (h["hx1"] <= boxes["x1"]) & (h["hy1"] <= boxes["y1"])
    return boxes.join(h, inside, "left_anti")


def distinct_regions(regions: DataFrame, covered: float = 0.9, least: float = 40) -> DataFrame:
    """regions (doc, page, n, box) in order of n, without small ones and those of which a kept one covers nearly all."""
    listed = regions.where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least)).groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("n", "x0", "y0", "x1", "y1"))).alias("r"))
    shared = lambda a, b: F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])) * F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda a: (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])
    kept = F.aggregate("r", F.slice("r", 1, 0), lambda out, x: F.when(F.exists(out, lambda k: shared(k, x) >= covered * area(x)), out).otherwise(F.concat(out, F.array(x))))
    return listed.select("doc", "page", F.inline(kept))


def assembled(captions: DataFrame, drawings: DataFrame, reach: float = 260, pad: float = 4) -> DataFrame:
    """doc, page, caption and box: the drawings up to reach above a caption that overlap it sideways, as one box of 40 x 30 at least."""
    c = captions.select("doc", "page", F.col("n").alias("caption"), F.col("x0").alias("cx0"), F.col("x1").alias("cx1"), F.col("y0").alias("cy0"))
    near = c.join(drawings, ["doc", "page"]).where((F.least("cx1", "x1") > F.greatest("cx0", "x0")) & (F.col("y1") <= F.col("cy0")) & (F.col("y0") >= F.col("cy0") - reach))
    box = near.groupBy("doc", "page", "caption").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    box = box.where("x1 - x0 >= 40 AND y1 - y0 >= 30")
    return box.select("doc", "page", "caption", *[(F.col(k) + d).alias(k) for k, d in (("x0", -pad), ("y0", -pad), ("x1", pad), ("y1", pad))])


def _distance(caption, box) -> tuple[Column, Column, Column]:
    """Whether a caption is below or above a box, and how far (null: neither, or not in line)."""
    below, above = caption("y0") >= box("y1") - SLACK, caption("y1") <= box("y0") + SLACK
    far = F.when(below, F.greatest(F.lit(0.0), caption("y0") - box("y1"))).when(above, F.greatest(F.lit(0.0), box("y0") - caption("y1")))
    return below, above, F.when(F.least(caption("x1"), box("x1")) > F.greatest(caption("x0"), box("x0")), far)


def captions_near(boxes: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc, page, box, caption of boxes (doc, page, box, kind: figure or table, x0 to y1): the text of the nearest block (doc, page, text, x0 to y1) that is a caption of
    that kind. A figure's is better below, a table's above."""
    b = boxes.select("doc", "page", "box", "kind", *[F.col(c).alias(f"b{c}") for c in _BOX])
    text = strip(F.col("text"))
    c = blocks.select("doc", "page", text.alias("text"), caption_kind(text).alias("kind"), *_BOX).where("kind IS NOT NULL")
    below, above, far = _distance(F.col, lambda x: F.col(f"b{x}"))
    better = F.when(F.col("kind") == "figure", below).otherwise(above)
    near = b.join(c, ["doc", "page", "kind"]).withColumn("far", far).where(F.col("far") <= REACH)
    best = near.groupBy("doc", "page", "box").agg(F.min(F.struct((F.col("far") + F.when(better, 0).otherwise(LESS)).alias("score"), "text"))["text"].alias("caption"))
    return boxes.select("doc", "page", "box").join(best, ["doc", "page", "box"], "left").select("doc", "page", "box", F.coalesce("caption", F.lit("")).alias("caption"))


def section_at(boxes: DataFrame, headings: DataFrame) -> DataFrame:
    """doc, page, box, section of boxes (doc, page, box, y0): the heading (doc, page, block_no, title, y0) that is highest up on the page but not below the box's top
    edge, of equally high ones the first block; else the last heading, by block, of the pages before; else null."""
    last = headings.groupBy("doc", "page").agg(F.max_by("title", "block_no").alias("last"))
    pages = boxes.select("doc", "page").distinct().join(last, ["doc", "page"], "full_outer")
    before = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    carried = pages.select("doc", "page", F.last("last", ignorenulls=True).over(before).alias("title")).where("title IS NOT NULL")
    none = F.lit(None)
    rows = carried.select("doc", "page", F.lit(float("-inf")).alias("y0"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("order"), "title", none.cast("long").alias("box"))
    rows = rows.unionByName(headings.select("doc", "page", F.col("y0").cast("double"), F.lit(0).alias("kind"), (-F.col("block_no")).cast("long").alias("order"), "title", none.cast("long").alias("box")))
    rows = rows.unionByName(boxes.select("doc", "page", F.col("y0").cast("double"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("order"), none.cast("string").alias("title"), F.col("box").cast("long").alias("box")))
    open_ = Window.partitionBy("doc", "page").orderBy("y0", "kind", "order")
    return rows.withColumn("section", F.last("title", ignorenulls=True).over(open_)).where("kind = 1").select("doc", "page", "box", "section")


def vector_regions(captions: DataFrame, drawings: DataFrame, regions: DataFrame, reach: float = 260, slack: float = 3, pad: float = 4) -> DataFrame:
    """doc, page, caption, x0 to y1: a box for each figure caption (doc, page, n, x0 to y1), in order of n, that is near no region (doc, page, x0 to y1) or earlier box: around
    the drawings that begin up to reach above it and end above it or at most slack below its top. Boxes under 40 x 30, and those of which a region or earlier
    box covers 80 %, are left out."""
    c = captions.select("doc", "page", F.col("n").alias("caption"), *[F.col(x).cast("double").alias(f"c{x}") for x in _BOX])
    parts = c.join(drawings, ["doc", "page"]).where("y0 >= cy0 - {} AND y0 < cy0 AND y1 <= cy0 + {} AND x1 > cx0 AND x0 < cx1".format(reach, slack))
    box = parts.groupBy("doc", "page", "caption", *[f"c{x}" for x in _BOX]).agg(*[f(x).cast("double").alias(x) for f, x in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    box = box.where("x1 - x0 >= 40 AND y1 - y0 >= 30").withColumns({x: F.col(x) + d for x, d in zip(_BOX, (-pad, -pad, pad, pad), strict=True)})
    wanted = box.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("caption", *[f"c{x}" for x in _BOX], *_BOX))).alias("wanted"))
    held = regions.groupBy("doc", "page").agg(F.collect_list(F.struct(F.lit(None).cast("long").alias("caption"), *[F.col(x).cast("double").alias(x) for x in _BOX])).alias("held"))
    both = wanted.join(held, ["doc", "page"], "left")
    kind = "array<struct<caption:bigint,x0:double,y0:double,x1:double,y1:double>>"
    width = lambda a, b, lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))

    def step(kept, x):
        taken = F.exists(kept, lambda k: F.coalesce(_distance(lambda n: x[f"c{n}"], lambda n: k[n])[2] <= REACH, F.lit(False)))
        covered = F.exists(kept, lambda k: width(k, x, "x0", "x1") * width(k, x, "y0", "y1") >= COVERED * (x["x1"] - x["x0"]) * (x["y1"] - x["y0"]))
        new = F.struct(x["caption"].cast("long").alias("caption"), *[x[n].alias(n) for n in _BOX])
        return F.when(taken | covered, kept).otherwise(F.concat(kept, F.array(new)))

    start = F.coalesce(F.col("held").cast(kind), F.array().cast(kind))
    return both.select("doc", "page", F.inline(F.aggregate("wanted", start, step))).where("caption IS NOT NULL")
