"""Cells of ruled tables from ruling lines and glyphs: no page is drawn, only coordinates are compared.

lines: (page, x0, y0, x1, y1), horizontal ones with y0 = y1 and vertical ones with x0 = x1, within a tolerance. glyphs: (page, x, y,
text), a glyph's or word's centre. y grows downwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bands(lines: DataFrame, *, tolerance: float = 1.0) -> DataFrame:
    """(page, top, bottom): what lies between neighbouring horizontal lines of a page; lines nearer than the tolerance are one."""
    flat = lines.where(F.abs(F.col("y1") - F.col("y0")) <= tolerance).where(F.abs(F.col("x1") - F.col("x0")) > tolerance)
    down = Window.partitionBy("page").orderBy("y")
    level = flat.select("page", ((F.col("y0") + F.col("y1")) / 2).alias("y")).distinct().withColumn("above", F.lag("y").over(down))
    own = level.where(F.col("above").isNull() | (F.col("y") - F.col("above") > tolerance)).select("page", "y")
    return own.select("page", F.col("y").alias("top"), F.lead("y").over(down).alias("bottom")).where("bottom IS NOT NULL")


def grid(lines: DataFrame, *, tolerance: float = 1.0) -> DataFrame:
    """(page, table, row, last, top, bottom, x0, x1, tx0, tx1): the cells of each row, between neighbouring vertical lines that span it.

    A line counts only for the rows it spans, so a stray one splits cells in its own rows alone. Rows that touch are
    one table, numbered from 0 down the page, rows from 0 within; tx0 and tx1 are its sides.
    """
    upright = lines.where(F.abs(F.col("x1") - F.col("x0")) <= tolerance).select(
        "page", ((F.col("x0") + F.col("x1")) / 2).alias("x"), F.least("y0", "y1").alias("from"), F.greatest("y0", "y1").alias("to")
    )
    rows = bands(lines, tolerance=tolerance)
    # equal in page, so a page's lines meet its bands only
    spanning = rows.join(upright, "page").where((F.col("from") <= F.col("top") + tolerance) & (F.col("to") >= F.col("bottom") - tolerance))
    across = Window.partitionBy("page", "top").orderBy("x")
    xs = spanning.select("page", "top", "bottom", "x").distinct().withColumn("left", F.lag("x").over(across))
    xs = xs.where(F.col("left").isNull() | (F.col("x") - F.col("left") > tolerance)).select("page", "top", "bottom", "x")
    cells = xs.select("page", "top", "bottom", F.col("x").alias("x0"), F.lead("x").over(across).alias("x1")).where("x1 IS NOT NULL")
    ruled = cells.groupBy("page", "top", "bottom").agg(F.min("x0").alias("rx0"), F.max("x1").alias("rx1"))
    down = Window.partitionBy("page").orderBy("top")
    gap = F.coalesce((F.col("top") - F.lag("bottom").over(down) > tolerance).cast("int"), F.lit(0))
    tables = ruled.withColumn("gap", gap).withColumn("table", F.sum("gap").over(down).cast("int"))
    whole = Window.partitionBy("page", "table")
    numbered = tables.select(
        "page", "table", "top", (F.row_number().over(whole.orderBy("top")) - 1).alias("row"), (F.max("top").over(whole) == F.col("top")).alias("last"), F.min("rx0").over(whole).alias("tx0"), F.max("rx1").over(whole).alias("tx1")
    )
    return cells.join(numbered, ["page", "top"]).select("page", "table", "row", "last", "top", "bottom", "x0", "x1", "tx0", "tx1")


def sides(cells: DataFrame) -> DataFrame:
    """(page, table, row, last, top, bottom, lx0, lx1, rx0, rx1): each row's cells united on the two halves of its table.

    A cell is on the left if its middle is left of the table's; a side without a cell is null, the row stays.
    """
    left = (F.col("x0") + F.col("x1")) / 2 < (F.col("tx0") + F.col("tx1")) / 2
    of = lambda agg, c, keep: agg(F.when(keep, F.col(c)))
    return cells.groupBy("page", "table", "row", "last", "top", "bottom").agg(
        of(F.min, "x0", left).alias("lx0"), of(F.max, "x1", left).alias("lx1"), of(F.min, "x0", ~left).alias("rx0"), of(F.max, "x1", ~left).alias("rx1")
    )


def row_texts(lines: DataFrame, glyphs: DataFrame, *, tolerance: float = 1.0) -> DataFrame:
    """(page, table, row, last, left, right): the text of both halves of every row, glyphs by line and place, joined by spaces.

    A glyph belongs to the row whose band holds its y and to the side that holds its x, lower bounds included; one
    outside all rows is in none. A side without a cell is null, one without glyphs empty.
    """
    rows = sides(grid(lines, tolerance=tolerance))
    near = (F.col("y") >= F.col("top")) & (F.col("y") < F.col("bottom"))
    inside = lambda a, b: F.coalesce((F.col("x") >= F.col(a)) & (F.col("x") < F.col(b)), F.lit(False))
    side = F.when(inside("lx0", "lx1"), "left").when(inside("rx0", "rx1"), "right")
    placed = rows.join(glyphs.select("page", "x", "y", "text"), "page").where(near).select("page", "table", "row", "x", "y", "text", side.alias("side")).where("side IS NOT NULL")
    # a cell's own glyphs are what one text holds
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "text"))), lambda g: g["text"]), " ")
    texts = placed.groupBy("page", "table", "row", "side").agg(ordered.alias("text"))
    both = texts.groupBy("page", "table", "row").agg(*[F.max(F.when(F.col("side") == s, F.col("text"))).alias(f"{s}_text") for s in ("left", "right")])
    shown = lambda x, s: F.when(F.col(x).isNotNull(), F.coalesce(F.col(f"{s}_text"), F.lit(""))).alias(s)
    return rows.join(both, ["page", "table", "row"], "left").select("page", "table", "row", "last", shown("lx0", "left"), shown("rx0", "right"))
