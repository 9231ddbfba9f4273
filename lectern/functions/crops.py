"""Crops for an engine that reads images: padding, clipping, scaling, and regions in different spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import geometry as G

PAD, PAD_SHARE = 8, 0.10


def plan_crop(rows: DataFrame, region: str, width: str, height: str, max_edge: int = 4096, max_pixels: int = 4_000_000) -> DataFrame:
    """rows with x0, y0, x1, y1 (the padded crop in pixels, inside the raster), clipped, scale (of the engine's input) and
    problem. A region is padded by a tenth of its height, 8 pixels at least; no region is the whole raster, unpadded."""
    b, w, h = F.col(region), F.col(width), F.col(height)
    own = F.coalesce(b, G.box(F.lit(0), F.lit(0), w, h))
    pad = F.when(b.isNull(), 0).otherwise(F.greatest(F.lit(PAD), F.ceil((G.y1(own) - G.y0(own)) * PAD_SHARE)))
    want = [F.floor(G.x0(own) - pad), F.floor(G.y0(own) - pad), F.ceil(G.x1(own) + pad), F.ceil(G.y1(own) + pad)]
    kept = [F.greatest(F.lit(0), want[0]), F.greatest(F.lit(0), want[1]), F.least(w, want[2]), F.least(h, want[3])]
    out = rows.withColumns({n: k.cast("int") for n, k in zip(("x0", "y0", "x1", "y1"), kept, strict=True)})
    out = out.withColumn("clipped", F.coalesce((want[0] < 0) | (want[1] < 0) | (want[2] > w) | (want[3] > h), F.lit(False)))
    cw, ch = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    fit = F.least(F.lit(1.0), F.try_divide(F.lit(float(max_edge)), F.greatest(cw, ch)), F.sqrt(F.try_divide(F.lit(float(max_pixels)), cw * ch)))
    flat = (G.x1(own) <= G.x0(own)) | (G.y1(own) <= G.y0(own))
    return out.withColumns({"scale": fit, "problem": F.when(flat, "degenerate").when((cw <= 0) | (ch <= 0), "empty")})


def recorded_scale(cw: Column, ch: Column, ow: Column, oh: Column) -> Column:
    """The scale to write down for a resized crop: the least millionth that is not below what either side needs, and the
    millionths next to it."""
    m = F.ceil(F.greatest(ow / cw, oh / ch) * 1e6)
    return F.array(m / 1e6, (m + 1) / 1e6, (m - 1) / 1e6)


def drag_box(ax: Column, ay: Column, bx: Column, by: Column, width: Column, height: Column) -> Column:
    """The region that a drag from one corner to another means, on the page; null for none."""
    inside = lambda v, most: F.greatest(F.lit(0.0), F.least(most, v))
    b = G.box(inside(F.least(ax, bx), width), inside(F.least(ay, by), height), inside(F.greatest(ax, bx), width), inside(F.greatest(ay, by), height))
    return F.when((G.x1(b) > G.x0(b)) & (G.y1(b) > G.y0(b)), b)


def display_box(region: Column, rotation: Column, width: Column, height: Column, scale: Column) -> Column:
    """A region as it is shown: turned with the page, scaled."""
    m = G.compose(G.matrix(scale, 0, 0, scale, 0, 0), G.display_rotation(rotation, width, height))
    return G.polygon_box(G.map_polygon(m, G.box_polygon(region)))


def provenance(left: Column, right: Column) -> Column:
    return F.concat(F.when(left == 1, "one").otherwise("many"), F.lit("_to_"), F.when(right == 1, "one").otherwise("many"))


#: Names of the modes in which a content stream paints text.
RENDER_MODES = ("fill", "stroke", "fill_stroke", "invisible", "fill_clip", "stroke_clip", "fill_stroke_clip", "clip")


def render_mode(mode: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(m) for m in RENDER_MODES]), mode), F.lit("unknown"))
