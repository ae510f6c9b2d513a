"""Lines of a page in columns and reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A new column starts after a gap of so many thousandths; boxes below or above these shares of a column's median are put right.
COLUMN_GAP, NARROW, TALL = 100, 0.5, 1.3


def boxes_of(df: DataFrame) -> DataFrame:
    """line_boxes with ymin, xmin, ymax, xmax; copies once, boxes without four numbers left out."""
    df = df.select("page_id", "det_id", "det_idx", "text", "box_2d").dropDuplicates(["det_id"]).where("size(box_2d) = 4 and not exists(box_2d, x -> x is null)")
    return df.select("page_id", "det_id", "det_idx", "text", *(F.element_at("box_2d", k + 1).alias(c) for k, c in enumerate(("ymin", "xmin", "ymax", "xmax"))))


def columns(boxes: DataFrame) -> DataFrame:
    """boxes with col: by xmin, a gap of more than COLUMN_GAP to the box before starts the next column. Ties by det_idx, det_id."""
    page = W.partitionBy("page_id").orderBy("xmin", "det_idx", "det_id")
    new = F.when(F.col("xmin") - F.lag("xmin").over(page) > COLUMN_GAP, 1).otherwise(0)
    return boxes.withColumn("__new", new).withColumn("col", F.sum("__new").over(page).cast("int")).drop("__new")


def column_medians(with_col: DataFrame) -> DataFrame:
    """Per page and column: number of boxes and the upper medians of width, height, xmin and xmax."""
    upper = lambda c: F.element_at(F.sort_array(F.collect_list(c)), (F.floor(F.count("*") / 2) + 1).cast("int"))
    return with_col.groupBy("page_id", "col").agg(
        F.count("*").alias("n"), upper(F.col("xmax") - F.col("xmin")).alias("width"), upper(F.col("ymax") - F.col("ymin")).alias("height"),
        upper(F.col("xmin")).alias("xmin"), upper(F.col("xmax")).alias("xmax"),
    )


_BOX = "struct<ymin:int,xmin:int,ymax:int,xmax:int,det_id:bigint,det_idx:int,text:string>"


def _apart(boxes: Column) -> Column:
    """A column's boxes, largest first, without those that overlap a kept one by more than half of the shorter height."""

    def hits(k: Column, r: Column) -> Column:
        return 2 * (F.least(k["ymax"], r["ymax"]) - F.greatest(k["ymin"], r["ymin"])) > F.least(k["ymax"] - k["ymin"], r["ymax"] - r["ymin"])

    return F.aggregate(boxes, F.array().cast(f"array<{_BOX}>"), lambda kept, r: F.when(F.exists(kept, lambda k: hits(k, r)), kept).otherwise(F.concat(kept, F.array(r))))


def _upper(boxes: Column, value) -> Column:  # noqa: ANN001
    return F.element_at(F.array_sort(F.transform(boxes, value)), (F.floor(F.size(boxes) / 2) + 1).cast("int"))


def _changed(r: Column, **new: Column) -> Column:
    return F.struct(*(new.get(c, r[c]).alias(c) for c in ("ymin", "xmin", "ymax", "xmax", "det_id", "det_idx", "text")))


def reading_order(boxes: DataFrame) -> DataFrame:
    """boxes in reading order (pos from 0): columns left to right, each from top to bottom.

    In a column of two or more, boxes without height and those that lie on a larger one go; with three or more left, narrow ones get the
    median extent, then tall ones the median height. Pages without a usable box give no row. Equal places are ordered by larger area,
    then xmin, then det_idx. One shuffle by page; a column is one array, its duplicates are found by a fold over it."""
    tall = lambda r: r["ymax"] - r["ymin"]
    wide = lambda r: r["xmax"] - r["xmin"]
    by_page = columns(boxes.repartition("page_id"))
    area = (F.col("ymax") - F.col("ymin")) * (F.col("xmax") - F.col("xmin"))
    row = F.struct((-area).alias("k"), F.col("xmin").alias("k2"), F.col("det_idx").alias("k3"), F.col("det_id").alias("k4"), F.struct("ymin", "xmin", "ymax", "xmax", "det_id", "det_idx", "text").alias("r"))
    cols = by_page.groupBy("page_id", "col").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias("rs"))
    kept = F.when(F.size("rs") > 1, _apart(F.filter("rs", lambda r: tall(r) > 0))).otherwise(F.col("rs"))
    cols = cols.withColumn("rs", kept).where("size(rs) > 0")
    many = F.size("rs") >= 3
    cols = cols.withColumns({"w": F.when(many, _upper(F.col("rs"), wide)), "l": F.when(many, _upper(F.col("rs"), lambda r: r["xmin"])), "x": F.when(many, _upper(F.col("rs"), lambda r: r["xmax"])), "h": F.when(many, _upper(F.col("rs"), tall))})

    def right(r: Column) -> Column:
        narrow = F.coalesce((F.col("w") > 0) & (F.col("x") > F.col("l")) & (wide(r) < NARROW * F.col("w")), F.lit(False))
        high = F.coalesce(tall(r) > TALL * F.col("h"), F.lit(False))
        return _changed(r, xmin=F.when(narrow, F.col("l")).otherwise(r["xmin"]), xmax=F.when(narrow, F.col("x")).otherwise(r["xmax"]), ymax=F.when(high, r["ymin"] + F.col("h")).otherwise(r["ymax"]))

    rows = cols.select("page_id", "col", F.posexplode(F.transform("rs", right)).alias("rank", "r")).select("page_id", "col", "rank", "r.*")
    page = W.partitionBy("page_id").orderBy("col", "ymin", "rank")
    return rows.withColumn("pos", (F.row_number().over(page) - 1).cast("int")).select("page_id", "det_id", "det_idx", "text", "ymin", "xmin", "ymax", "xmax", "col", "pos")
