"""Joins and filters by place on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import geometry as G


def banded_join(left: DataFrame, right: DataFrame, by: list[str], meets, height: float = 64.0) -> DataFrame:
    """Rows of both sides (by, box) in like groups whose boxes `meets` holds for; columns l_* and r_*.

    Boxes are dealt into bands of y, so the join is on equal keys and not on every pair of a group; a pair that meets
    in several bands is kept in the first one that both touch. `meets` must imply that the boxes touch.
    """

    def dealt(df: DataFrame, side: str) -> DataFrame:
        first, last = F.floor(G.y0(F.col("box")) / height), F.floor(G.y1(F.col("box")) / height)
        own = df.select(*by, *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in by], first.alias(f"{side}_first"), F.explode(F.sequence(first, last)).alias("band"))
        return own

    both = dealt(left, "l").join(dealt(right, "r"), [*by, "band"])
    both = both.where(F.col("band") == F.greatest("l_first", "r_first")).where(meets(F.col("l_box"), F.col("r_box")))
    return both.drop("band", "l_first", "r_first")


def paint_overlap(objects: DataFrame, page: str = "page") -> DataFrame:
    """page, idx, n_over, over: for every text object how many later objects that are no text cover part of it, and
    which. objects: page, idx, kind, box."""
    text = objects.where("kind = 'text'").select(page, "idx", "box")
    other = objects.where("kind != 'text'").select(page, "idx", "box")
    hit = banded_join(text, other, [page], G.boxes_overlap).where("r_idx > l_idx")
    found = hit.groupBy(page, F.col("l_idx").alias("idx")).agg(F.count(F.lit(1)).alias("n_over"), F.array_sort(F.collect_list("r_idx")).alias("over"))
    return text.select(page, "idx").join(found, [page, "idx"], "left").na.fill(0, ["n_over"])


def occlusion(objects: DataFrame, page: str = "page", hidden: float = 0.95, partly: float = 0.05) -> DataFrame:
    """page, idx, covered (greatest share of a text object that one later object covers) and verdict."""
    text = objects.where("kind = 'text'").select(page, "idx", "box")
    other = objects.where("kind != 'text'").select(page, "idx", "box")
    hit = banded_join(text, other, [page], G.boxes_overlap).where("r_idx > l_idx")
    share = F.try_divide(G.shared_area(F.col("l_box"), F.col("r_box")), G.area(F.col("l_box")))
    most = hit.groupBy(page, F.col("l_idx").alias("idx")).agg(F.max(share).alias("covered"))
    every = text.select(page, "idx").join(most, [page, "idx"], "left").na.fill(0.0, ["covered"])
    verdict = F.when(F.col("covered") >= hidden, "invisible").when(F.col("covered") > partly, "unsupported").otherwise("visible")
    return every.withColumn("verdict", verdict)


def region_filter(records: DataFrame, region: Column) -> DataFrame:
    """Records whose place touches the region; those without a place go."""
    return records.where(F.col("box").isNotNull() & G.boxes_meet(F.col("box"), region))


def localized(records: DataFrame, page: Column, region: Column | None = None) -> Column:
    """localized, page_level or out_of_scope. records: page_index, precision, box (null for no place)."""
    bad = F.col("box").isNull() | ~F.col("precision").isin("exact", "estimated") | (G.area(F.col("box")) == 0)
    out = F.when(F.col("page_index") != page, "out_of_scope").when(bad, "page_level")
    if region is not None:
        out = out.when(~G.boxes_meet(F.col("box"), region), "out_of_scope")
    return out.otherwise("localized")


def gap_tolerance(fragments: DataFrame, by: list[str]) -> DataFrame:
    """by, median_height, tolerance: 1.5 median heights, 24 points at most."""
    out = fragments.groupBy(*by).agg(F.median(G.y1(F.col("box")) - G.y0(F.col("box"))).alias("median_height"))
    return out.withColumn("tolerance", F.least(1.5 * F.col("median_height"), F.lit(24.0)))


def off_crop(objects: DataFrame, crop: Column) -> DataFrame:
    """Text objects that reach beyond the crop box, and for every page one row of its own (kind 'page', no idx)."""
    b = F.col("box")
    out = objects.where("kind = 'text'").where((G.x0(b) < G.x0(crop)) | (G.x1(b) > G.x1(crop)) | (G.y0(b) < G.y0(crop)) | (G.y1(b) > G.y1(crop)))
    pages = objects.select("page").distinct().select("page", F.lit(None).cast("int").alias("idx"), F.lit("page").alias("kind"))
    return out.select("page", F.col("idx").cast("int"), F.lit("off_crop").alias("kind")).unionByName(pages)
