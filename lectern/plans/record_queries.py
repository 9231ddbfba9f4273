"""Queries over geometry records: views, rasters, regions, costs, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import crops as Y
from lectern.functions import geometry as G
from lectern.functions import text as X
from lectern.operators import runs as N
from lectern.operators import validate as V
from lectern.plans import adapters as A
from lectern.plans import sql as S
from lectern.plans.registry import query

_SIDES = ("x0", "y0", "x1", "y1")
#: The page that objects lie on, in points: its width and height.
_W, _H = 200.0, 150.0


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, idx, own (box): page objects, none twice."""
    return A.objects(spark, sf_dir).distinct().select("page", "idx", G.box(*[F.col(c) for c in _SIDES]).alias("own"))


def _sides(box, *names: str) -> list:
    return [F.round(F.get(box, F.lit(k)), 6).alias(n) for k, n in enumerate(names or _SIDES)]


_O = """o AS (SELECT DISTINCT page, idx, x0, y0, x1, y1 FROM objects)"""
_PAIRS = """p AS (SELECT a.page, a.idx, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1 FROM o a JOIN o b ON a.page = b.page AND b.idx = a.idx + 1)"""


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, idx, a, b: the boxes of an object and of the next on its page."""
    rows = _objects(spark, sf_dir)
    after = rows.select("page", (F.col("idx") - 1).alias("idx"), F.col("own").alias("b"))
    return rows.withColumnRenamed("own", "a").join(after, ["page", "idx"])


@query(
    S.with_(
        S.OBJECTS,
        _O,
        select="""SELECT page, idx, x0, y0, x1, y1, CASE WHEN idx % 5 = 0 THEN 'empty' WHEN x1 <= x0 OR y1 <= y0 THEN 'empty' WHEN NOT (x0 >= 0 AND y0 >= 0 AND x1 <= 200 AND y1 <= 150) THEN 'outside' END AS problem FROM o""",
    )
)
def region_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects as regions of their page; of every fifth the right side is drawn onto the left one."""
    rows = _objects(spark, sf_dir)
    flat = F.when(F.col("idx") % 5 == 0, G.box(G.x0(F.col("own")), G.y0(F.col("own")), G.x0(F.col("own")), G.y1(F.col("own")))).otherwise(F.col("own"))
    return rows.select("page", "idx", *_sides(F.col("own")), V.region_box_problem(flat, G.box(F.lit(0), F.lit(0), F.lit(_W), F.lit(_H))).alias("problem"))


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 200 - 200 AS w, l_partkey * 7 % 9000 AS h FROM lineitem)
    SELECT l_orderkey, l_linenumber, w, h, CASE WHEN w < 1 OR h < 1 THEN 'empty' WHEN w > 8192 OR h > 8192 THEN 'edge' WHEN w * h > 16000000 THEN 'pixels' END AS problem FROM r"""
)
def raster_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("l_quantity").cast("long") * 200 - 200, F.col("l_partkey") * 7 % 9000
    return A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", w.alias("w"), h.alias("h"), V.raster_problem(w, h).alias("problem"))


@query(
    r"""WITH p AS (SELECT page_id, concat(CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN '../' WHEN 3 THEN 'a/./' WHEN 4 THEN 'c:' ELSE 'a//' END, replace(regexp_extract(url, '//[^/]+/(.*)$', 1), '?', CASE WHEN page_id % 7 = 0 THEN '\' ELSE '?' END)) AS path FROM pages)
    SELECT page_id, path, NOT regexp_matches(path, '(^/)|(^[A-Za-z]:)|\\|(^|/)\.\.?(/|$)|//') AND length(path) > 0 AS safe FROM p"""
)
def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the pages, some made absolute, climbing, doubled or of another system."""
    k = F.col("page_id") % 6
    head = F.when(k == 0, "").when(k == 1, "/").when(k == 2, "../").when(k == 3, "a/./").when(k == 4, "c:").otherwise("a//")
    tail = F.replace(F.regexp_extract("url", "//[^/]+/(.*)$", 1), F.lit("?"), F.when(F.col("page_id") % 7 == 0, "\\").otherwise("?"))
    rows = A.table(spark, sf_dir, "pages").select("page_id", F.concat(head, tail).alias("path"))
    return rows.withColumn("safe", V.safe_relative_path(F.col("path")))


@query(
    S.with_(
        S.OBJECTS,
        _O,
        select="""SELECT page, idx, CASE WHEN idx % 3 = 0 THEN 5 ELSE greatest(5, x0) END::DOUBLE AS x0, CASE WHEN idx % 3 = 0 THEN 5 ELSE greatest(5, y0) END::DOUBLE AS y0,
          CASE WHEN idx % 3 = 0 THEN 200 ELSE least(200, x1) END::DOUBLE AS x1, CASE WHEN idx % 3 = 0 THEN 150 ELSE least(150, y1) END::DOUBLE AS y1 FROM o""",
    )
)
def effective_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects as crop boxes of one media box; every third page has none."""
    crop = F.when(F.col("idx") % 3 != 0, F.col("own"))
    return _objects(spark, sf_dir).select("page", "idx", *_sides(G.effective_view(G.box(F.lit(5), F.lit(5), F.lit(_W), F.lit(_H)), crop)))


@query(
    S.with_(
        S.OBJECTS,
        _O,
        """t AS (SELECT page, idx, 1 + (idx % 3) * 0.5::DOUBLE AS u, x0, y0, x1, y1 FROM o)""",
        select="""SELECT page, idx, round(u * (x1 - x0), 6) AS width, round(u * (y1 - y0), 6) AS height, round(-u * x0, 6) + 0.0 AS e, round(u * y1, 6) AS f FROM t""",
    )
)
def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects as view boxes with a user unit: the size in points, and where the transform moves the origin."""
    rows = _objects(spark, sf_dir).withColumn("u", 1 + (F.col("idx") % 3) * 0.5)
    size, m = G.canonical_size(F.col("own"), F.col("u")), G.canonical_transform(F.col("own"), F.col("u"))
    six = lambda c, n: (F.round(c, 6) + 0.0).alias(n)
    return rows.select("page", "idx", six(F.get(size, F.lit(0)), "width"), six(F.get(size, F.lit(1)), "height"), six(F.get(m, F.lit(4)), "e"), six(F.get(m, F.lit(5)), "f"))


@query(
    S.with_(
        S.OBJECTS,
        _O,
        """t AS (SELECT page, idx, CASE idx % 4 WHEN 0 THEN [x0, y0, x1, y1] WHEN 1 THEN [150 - y1, x0, 150 - y0, x1] WHEN 2 THEN [200 - x1, 150 - y1, 200 - x0, 150 - y0] ELSE [y0, 200 - x1, y1, 200 - x0] END AS b FROM o)""",
        select="""SELECT page, idx, round(1.5 * b[1], 6) + 0.0 AS x0, round(1.5 * b[2], 6) + 0.0 AS y0, round(1.5 * b[3], 6) + 0.0 AS x1, round(1.5 * b[4], 6) + 0.0 AS y1 FROM t""",
    )
)
def display_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects as regions of a page that is shown turned by quarters and half as large again."""
    turned = Y.display_box(F.col("own"), (F.col("idx") % 4) * 90, F.lit(_W), F.lit(_H), F.lit(1.5))
    return _objects(spark, sf_dir).select("page", "idx", turned.alias("b")).select("page", "idx", *[(c + 0.0).alias(n) for c, n in zip(_sides(F.col("b")), _SIDES, strict=True)])


@query(
    S.with_(
        S.OBJECTS,
        _O,
        """d AS (SELECT page, idx, greatest(0, least(200, least(x1, x0 - 60))) AS x0, greatest(0, least(150, least(y0 - 20, y1 - 10))) AS y0,
          greatest(0, least(200, greatest(x1, x0 - 60))) AS x1, greatest(0, least(150, greatest(y0 - 20, y1 - 10))) AS y1 FROM o)""",
        select="""SELECT page, idx, CASE WHEN x1 > x0 AND y1 > y0 THEN x0 END::DOUBLE AS x0, CASE WHEN x1 > x0 AND y1 > y0 THEN y0 END::DOUBLE AS y0,
          CASE WHEN x1 > x0 AND y1 > y0 THEN x1 END::DOUBLE AS x1, CASE WHEN x1 > x0 AND y1 > y0 THEN y1 END::DOUBLE AS y1 FROM d""",
    )
)
def drag_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drags from right of an object to left of it, some of them off the page."""
    b = F.col("own")
    drag = Y.drag_box(G.x1(b), G.y0(b) - 20, G.x0(b) - 60, G.y1(b) - 10, F.lit(_W), F.lit(_H))
    return _objects(spark, sf_dir).select("page", "idx", *_sides(drag))


@query(
    S.with_(
        S.OBJECTS,
        _O,
        """s AS (SELECT page, idx, ceil(greatest(floor((x1 - x0) * 1.37::DOUBLE) / (x1 - x0), floor((y1 - y0) * 1.37::DOUBLE) / (y1 - y0)) * 1000000::DOUBLE) AS m FROM o)""",
        select="""SELECT page, idx, CAST(m AS BIGINT) AS least, CAST(m + 1 AS BIGINT) AS above, CAST(m - 1 AS BIGINT) AS below FROM s""",
    )
)
def recorded_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects as crops that are made 1.37 times as large, to whole pixels; scales in millionths."""
    w, h = G.x1(F.col("own")) - G.x0(F.col("own")), G.y1(F.col("own")) - G.y0(F.col("own"))
    found = Y.recorded_scale(w, h, F.floor(w * 1.37).cast("double"), F.floor(h * 1.37).cast("double"))
    rows = _objects(spark, sf_dir).select("page", "idx", found.alias("s"))
    return rows.select("page", "idx", *[F.round(F.get("s", F.lit(k)) * 1e6).cast("long").alias(n) for k, n in enumerate(("least", "above", "below"))])


@query("""SELECT p_partkey, floor(p_retailprice / 7 * 1000000 + 0.5) / 1000000 AS half_up FROM part""")
def rounded_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "part").select("p_partkey", G.round6(F.col("p_retailprice") / 7).alias("half_up"))


@query(
    S.with_(
        S.OBJECTS,
        _O,
        _PAIRS,
        """e AS (SELECT *, 0.25::DOUBLE * least(ay1 - ay0, by1 - by0) AS dy FROM p)""",
        """f AS (SELECT *, greatest(0, least(ax1, bx1) + 2 - greatest(ax0, bx0) + 2) * greatest(0, least(ay1, by1) + dy - greatest(ay0, by0) + dy) AS shared,
          (ax1 - ax0 + 4) * (ay1 - ay0 + 2 * dy) + (bx1 - bx0 + 4) * (by1 - by0 + 2 * dy) AS total, sqrt(((ax0 + ax1 - bx0 - bx1) / 2) ** 2 + ((ay0 + ay1 - by0 - by1) / 2) ** 2) / sqrt(200 ** 2 + 150 ** 2) AS apart FROM e)""",
        """g AS (SELECT page, idx, greatest(0, least(1, CASE WHEN shared > 0 THEN 1 - shared / (total - shared) ELSE apart END)) AS distance FROM f)""",
        select="""SELECT page, idx, round(distance, 6) AS distance, round(greatest(0, least(1, 0.65 * distance + 0.2 * (idx % 3) + 0.15 * 0.25)), 6) AS cost FROM g""",
    )
)
def pair_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring objects: how far they are apart, and the cost of a match with some order and text."""
    page = G.box(F.lit(0), F.lit(0), F.lit(_W), F.lit(_H))
    rows = _neighbours(spark, sf_dir).withColumn("distance", G.geometry_distance(F.col("a"), F.col("b"), F.lit(4.0), page))
    cost = G.pair_cost(F.col("distance"), (F.col("idx") % 3).cast("double"), F.lit(0.25))
    return rows.select("page", "idx", F.round("distance", 6).alias("distance"), F.round(cost, 6).alias("cost"))


@query(S.with_(S.OBJECTS, _O, _PAIRS, select="""SELECT page, idx, least(ax0, bx0) AS x0, least(ay0, by0) AS y0, greatest(ax1, bx1) AS x1, greatest(ay1, by1) AS y1 FROM p"""))
def union_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _neighbours(spark, sf_dir)
    corners = F.concat(G.box_polygon(F.col("a")), G.box_polygon(F.col("b")))
    return rows.select("page", "idx", *_sides(G.polygon_box(corners)))


@query(S.with_(S.OBJECTS, _O, select="""SELECT page, idx, round(sqrt(idx ** 2 + (0.5 * x0) ** 2), 4) AS error FROM o"""))
def inverse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There and back by a matrix and a wrong inverse of it, which ends idx too low and half of x0 too far right."""
    b, k = F.col("own"), (F.col("idx") + 1).cast("double")
    there = G.matrix(k, 0, 0, 2, G.x0(b), G.y0(b))
    back = G.matrix(1 / k, 0, 0, 0.5, -G.x0(b) / k + 0.5 * G.x0(b), -0.5 * G.y0(b) + F.col("idx"))
    return _objects(spark, sf_dir).select("page", "idx", F.round(G.inverse_error(there, back, F.lit(_W), F.lit(_H)), 4).alias("error"))


_MODES = "['fill', 'stroke', 'fill_stroke', 'invisible', 'fill_clip', 'stroke_clip', 'fill_stroke_clip', 'clip']"


@query(
    f"""SELECT event_id, coalesce({_MODES}[CAST(user_id % 11 AS INTEGER) + 1], 'unknown') AS mode,
    CASE WHEN event_type IN ('error') THEN 'transient' WHEN event_type = 'purchase' THEN 'never' ELSE 'other' END AS retry,
    concat(CASE WHEN user_id % 3 = 1 THEN 'one' ELSE 'many' END, '_to_', CASE WHEN event_id % 4 = 1 THEN 'one' ELSE 'many' END) AS provenance FROM events"""
)
def record_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of paint modes, of what a failure's reason lets one try again, and of matches by the numbers of their sides."""
    t = F.col("event_type")
    reason = F.when(t == "error", "worker_crash").when(t == "purchase", "encrypted").otherwise(t)
    mode = Y.render_mode((F.col("user_id") % 11).cast("int"))
    return A.table(spark, sf_dir, "events").select("event_id", mode.alias("mode"), N.retry_kind(reason).alias("retry"), Y.provenance(F.col("user_id") % 3, F.col("event_id") % 4).alias("provenance"))


@query(S.with_(S.LINES, select=r"""SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, regexp_matches(raw_text, '[\p{Nd}\p{Sc}\p{Sm}\p{Pd}]') AS material FROM lines_a"""))
def material_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.lines(spark, sf_dir).select("doc_id", "ordinal", X.has_material(F.col("raw_text")).alias("material"))
