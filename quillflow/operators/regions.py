"""Page geometry: boxes, captions and figures.  Boxes are x0, y0, x1, y1 in points, the origin top left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

ROLE_AREA, TINY_AREA, LABEL_CONFIDENCE = 5000.0, 500.0, 0.30


def area(x0="x0", y0="y0", x1="x1", y1="y1") -> Column:
    return (F.col(x1) - F.col(x0)) * (F.col(y1) - F.col(y0))


def valid(x0="x0", y0="y0", x1="x1", y1="y1") -> Column:
    return (F.col(x0) >= 0) & (F.col(y0) >= 0) & (F.col(x1) > F.col(x0)) & (F.col(y1) > F.col(y0))


def flip(boxes: DataFrame, height: float = 792.0) -> DataFrame:
    """Boxes from bottom-left to top-left origin; invalid ones become null.  A page without height is of letter size."""
    h = F.coalesce(F.col("page_height"), F.lit(height))
    out = boxes.withColumn("t0", h - F.col("y1")).withColumn("t1", h - F.col("y0"))
    ok = valid("x0", "t0", "x1", "t1")
    return out.select(*[c for c in boxes.columns if c not in ("x0", "y0", "x1", "y1")], *[F.when(ok, F.col(c)).alias(n) for c, n in (("x0", "x0"), ("t0", "y0"), ("x1", "x1"), ("t1", "y1"))])


def union_boxes(boxes: DataFrame, by: list[str]) -> DataFrame:
    """The box around all boxes of a group."""
    return boxes.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def largest(boxes: DataFrame, by: list[str], id_: str = "box_id") -> DataFrame:
    """The largest box of each group; among equals the smaller id."""
    return boxes.groupBy(*by).agg(F.max(F.struct(area(), -F.col(id_))).alias("m")).select(*by, (-F.col("m.col2")).alias(id_))


def _prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])


def outside(blocks: DataFrame, regions: DataFrame, share: float = 0.8) -> DataFrame:
    """Blocks that no region of their page covers to that share of their area."""
    r = _prefixed(regions, "r")
    w = F.greatest(F.lit(0.0), F.least("x1", "r_x1") - F.greatest("x0", "r_x0"))
    h = F.greatest(F.lit(0.0), F.least("y1", "r_y1") - F.greatest("y0", "r_y0"))
    return blocks.join(r, (F.col("page") == F.col("r_page")) & (w * h >= share * area()), "left_anti")


def nearest_captions(images: DataFrame, captions: DataFrame) -> DataFrame:
    """(image_id, caption_id): the caption of the same page whose centre is nearest in height; ties to the smaller id."""
    c = _prefixed(captions, "c")
    both = images.join(c, F.col("page") == F.col("c_page"))
    dy = F.abs((F.col("y0") + F.col("y1")) / 2 - (F.col("c_y0") + F.col("c_y1")) / 2)
    n = F.row_number().over(W.partitionBy("image_id").orderBy(dy, "c_caption_id"))
    return both.withColumn("n", n).where("n = 1").select("image_id", F.col("c_caption_id").alias("caption_id"))


def recover_captions(images: DataFrame, texts: DataFrame, band: float = 72.0) -> DataFrame:
    """(image_id, text_id): text of the same page that shares some width and stands within the band, below before above, nearest first."""
    t = _prefixed(texts, "t")
    both = images.join(t, (F.col("page") == F.col("t_page")) & (F.least("x1", "t_x1") > F.greatest("x0", "t_x0")))
    below, above = F.col("t_y0") - F.col("y1"), F.col("y0") - F.col("t_y1")
    side = F.when(below.between(0, band), 0).when(above.between(0, band), 1)
    near = both.withColumn("side", side).where("side IS NOT NULL").withColumn("gap", F.when(F.col("side") == 0, below).otherwise(above))
    n = F.row_number().over(W.partitionBy("image_id").orderBy("side", "gap", "t_text_id"))
    return near.withColumn("n", n).where("n = 1").select("image_id", F.col("t_text_id").alias("text_id"))


def role(figures: DataFrame, labels: DataFrame) -> DataFrame:
    """figures with role: a caption makes a figure, then a label of enough confidence by the given map (label, role), then the area."""
    f = figures.join(F.broadcast(labels.select(F.col("label").alias("_l"), F.col("role").alias("_r"))), F.col("label") == F.col("_l"), "left")
    captioned = F.coalesce(F.col("caption"), F.lit("")).rlike(r"(?i)^\s*(figure|fig\.?|table)\s+\d+")
    by_label = F.when(F.col("confidence") >= LABEL_CONFIDENCE, F.col("_r"))
    return f.withColumn("role", F.when(captioned, "figure").otherwise(F.coalesce(by_label, F.when(area() < ROLE_AREA, "decoration").otherwise("figure")))).drop("_l", "_r")


def table_markdown(cells: Column) -> Column:
    """Rows of cells (array of arrays of text) as a markdown table, rows padded to the widest, the first as heading."""
    width = F.array_max(F.transform(cells, lambda r: F.size(r)))
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\n\s*", " "))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), clean), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    rows = F.transform(cells, line)
    return F.when(F.size(cells) > 0, F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, 2, F.greatest(F.lit(0), F.size(rows) - 1))), "\n"))
