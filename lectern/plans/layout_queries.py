"""Queries by place: boxes, lines, spans, alignment, findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import geometry as G
from lectern.operators import coverage as C
from lectern.operators import findings as N
from lectern.operators import layout as P
from lectern.operators.alignment import align
from lectern.plans import adapters as A
from lectern.plans import sql as S
from lectern.plans.registry import query

_BOX = ("x0", "y0", "x1", "y1")


def _boxed(df: DataFrame) -> DataFrame:
    return df.withColumn("box", G.box(*[F.col(c) for c in _BOX])).drop(*_BOX)


_MEET = "a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"
_OVER = "t.x0 < o.x1 AND o.x0 < t.x1 AND t.y0 < o.y1 AND o.y0 < t.y1"
_OVERLAP = "greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least(a.y1 - a.y0, b.y1 - b.y0)"


@query(
    S.with_(
        S.LINES,
        select=f"""SELECT a.doc_id, CAST(a.ordinal AS INTEGER) AS l_ordinal, CAST(b.ordinal AS INTEGER) AS r_ordinal, round({_OVERLAP}, 6) AS overlap,
          round(greatest(0, a.x0 - b.x1, b.x0 - a.x1), 6) AS gap FROM lines_a a JOIN lines_b b ON a.doc_id = b.doc_id AND {_MEET}""",
    )
)
def bbox_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _boxed(A.lines(spark, sf_dir).drop("raw_text")), _boxed(A.lines_again(spark, sf_dir).drop("raw_text"))
    both = P.banded_join(a, b, ["doc_id"], G.boxes_meet)
    l, r = F.col("l_box"), F.col("r_box")  # noqa: E741
    return both.select("doc_id", "l_ordinal", "r_ordinal", F.round(G.vertical_overlap(l, r), 6).alias("overlap"), F.round(G.horizontal_gap(l, r), 6).alias("gap"))


@query(
    S.with_(
        S.OBJECTS,
        select=f"""SELECT t.page, t.idx, count(o.idx) AS n_over FROM (SELECT DISTINCT * FROM objects WHERE kind = 'text') t
          LEFT JOIN (SELECT DISTINCT * FROM objects WHERE kind <> 'text') o ON t.page = o.page AND o.idx > t.idx AND {_OVER} GROUP BY t.page, t.idx, t.x0, t.y0, t.x1, t.y1""",
    ).replace("GROUP BY t.page, t.idx, t.x0, t.y0, t.x1, t.y1", "GROUP BY t.page, t.idx")
)
def paint_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.paint_overlap(_boxed(A.objects(spark, sf_dir)).distinct())
    return found.select("page", "idx", "n_over").distinct()


@query(
    S.with_(
        S.OBJECTS,
        f"""hits AS (SELECT t.page, t.idx, greatest(0, least(t.x1, o.x1) - greatest(t.x0, o.x0)) * greatest(0, least(t.y1, o.y1) - greatest(t.y0, o.y0)) / ((t.x1 - t.x0) * (t.y1 - t.y0)) AS share
          FROM objects t JOIN objects o ON t.kind = 'text' AND o.kind <> 'text' AND t.page = o.page AND o.idx > t.idx AND {_OVER})""",
        """best AS (SELECT page, idx, max(share) AS covered FROM hits GROUP BY page, idx)""",
        select="""SELECT DISTINCT t.page, t.idx, round(coalesce(covered, 0), 6) AS covered, CASE WHEN coalesce(covered, 0) >= 0.95 THEN 'invisible' WHEN coalesce(covered, 0) > 0.05 THEN 'unsupported' ELSE 'visible' END AS verdict
          FROM objects t LEFT JOIN best USING (page, idx) WHERE t.kind = 'text'""",
    )
)
def occlusion_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.occlusion(_boxed(A.objects(spark, sf_dir)))
    return found.withColumn("covered", F.round("covered", 6)).distinct()


@query(S.with_(S.LINES, select="SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal FROM lines_a WHERE x0 <= 300 AND x1 >= 100 AND y0 <= 90 AND y1 >= 70"))
def region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = G.box(*[F.lit(v) for v in (100.0, 70.0, 300.0, 90.0)])
    return P.region_filter(_boxed(A.lines(spark, sf_dir)), region).select("doc_id", "ordinal")


@query(
    S.with_(
        S.LINES,
        select="""SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, CASE WHEN ordinal % 5 = 4 THEN 'out_of_scope' WHEN raw_text = '' OR ordinal % 4 = 3 THEN 'page_level'
          WHEN NOT (x0 <= 400 AND x1 >= 60 AND y0 <= 200 AND y1 >= 50) THEN 'out_of_scope' ELSE 'localized' END AS bucket FROM lines_a""",
    )
)
def localization(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxed(A.lines(spark, sf_dir)).withColumns({"page_index": F.when(F.col("ordinal") % 5 == 4, 1).otherwise(0), "precision": F.when(F.col("ordinal") % 4 == 3, "page_only").otherwise("exact")})
    region = G.box(*[F.lit(v) for v in (60.0, 50.0, 400.0, 200.0)])
    return rows.select("doc_id", "ordinal", P.localized(rows, F.lit(0), region).alias("bucket"))


@query(S.with_(S.LINES, select="SELECT doc_id, round(median(y1 - y0), 6) AS median_height, round(least(1.5 * median(y1 - y0), 24), 6) AS tolerance FROM lines_a GROUP BY doc_id"))
def median_height_gap_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.gap_tolerance(_boxed(A.lines(spark, sf_dir)), ["doc_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("median_height", "tolerance")})


@query(
    S.with_(
        S.LINES,
        """f AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, y0 ORDER BY x0, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS furthest FROM lines_a)""",
        select="""SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(sum(CASE WHEN x0 - furthest > 24 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, y0 ORDER BY x0, ordinal) AS BIGINT) AS run FROM f""",
    )
)
def line_runs_gaps_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.line_runs(A.lines(spark, sf_dir), ["doc_id", "y0"], "x0", "x1", F.lit(24.0), "ordinal").select("doc_id", "ordinal", F.col("run").cast("long"))


@query(
    """WITH s AS (SELECT a.conv_id, a.turn AS first, b.turn - a.turn + 1 AS length, a.turn AS t0, b.turn AS t1 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn AND a.turn + 3)
    SELECT s.conv_id, s.first, CAST(s.length AS INTEGER) AS length, md5(string_agg(c.text, '' ORDER BY c.turn)) AS digest FROM s JOIN conversations c ON c.conv_id = s.conv_id AND c.turn BETWEEN s.t0 AND s.t1 GROUP BY ALL"""
)
def spans_1_to_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.spans(A.table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")
    return out.select("conv_id", "first", "length", F.md5(F.col("text").cast("binary")).alias("digest"))


_PAIRS = "pairs AS (SELECT conv_id, turn AS l, length(text) * 1000 + turn AS r FROM conversations)"


@query(f"""WITH {_PAIRS} SELECT a.conv_id, count(*) AS inversions FROM pairs a JOIN pairs b ON a.conv_id = b.conv_id AND a.l < b.l AND a.r > b.r GROUP BY a.conv_id""")
def order_inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "conversations")
    pairs = rows.select("conv_id", F.col("turn").alias("left_ordinal"), (F.char_length("text") * 1000 + F.col("turn")).alias("right_ordinal"))
    return C.order_inversions(pairs, ["conv_id"])


@query("""SELECT conv_id, turn, round(CASE WHEN count(*) OVER (PARTITION BY conv_id) > 1 THEN (row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) - 1)::DOUBLE / (count(*) OVER (PARTITION BY conv_id) - 1) ELSE 0 END, 6) AS rank01 FROM conversations""")
def ordinal_rank01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "conversations").withColumn("n", F.char_length("text"))
    return C.ordinal_rank(rows, ["conv_id"], "n", "turn").select("conv_id", "turn", F.round("rank01", 6).alias("rank01"))


_AFFINE = "m AS (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice AS p FROM part)"


@query(
    f"""WITH {_AFFINE} SELECT p_partkey, round(s * 2 * 3 + 5 * s, 6) AS x, round(-(s * 2) * 4 + 7, 6) AS y, round(-(s * 2) * (s * 2), 4) AS det, round((11 - 5 * s) / (s * 2), 6) AS back_x FROM m"""
)
def affine_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flip and scale after a shift, its determinant, and the inverse of a point."""
    s = F.col("p_size").cast("double")
    scale, shift = G.matrix(s * 2, 0, 0, -(s * 2), 0, 0), G.translation(5 * s, F.lit(7.0))
    m = G.compose(shift, scale)
    there = G.apply(m, F.array(F.lit(3.0), F.lit(4.0)))
    back = G.apply(G.inverse(m), F.array(F.lit(11.0), F.lit(0.0)))
    rows = A.table(spark, sf_dir, "part")
    return rows.select("p_partkey", F.round(F.get(there, F.lit(0)), 6).alias("x"), F.round(F.get(there, F.lit(1)), 6).alias("y"), F.round(G.determinant(m), 4).alias("det"), F.round(F.get(back, F.lit(0)), 6).alias("back_x"))


_CLIP = "greatest(0, least(x1, 150) - greatest(x0, 50)) * greatest(0, least(y1, 150) - greatest(y0, 30))"


@query(
    S.with_(
        S.OBJECTS,
        select=f"""SELECT DISTINCT page, idx, kind, CASE WHEN x0 >= 50 AND y0 >= 30 AND x1 <= 150 AND y1 <= 150 THEN 'inside' WHEN {_CLIP} > 0 THEN 'partial' ELSE 'outside' END AS status, round({_CLIP}, 4) AS clipped_area,
          round((x1 - x0) * (y1 - y0), 4) AS area FROM objects""",
    )
)
def clip_status_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = G.box(*[F.lit(v) for v in (50.0, 30.0, 150.0, 150.0)])
    rows = _boxed(A.objects(spark, sf_dir))
    rows = G.clip(rows.withColumn("polygon", G.box_polygon(F.col("box"))), "polygon", view, "clipped")
    area = F.when(F.size("clipped") > 2, F.abs(G.signed_area(F.col("clipped")))).otherwise(0.0)
    status = G.clip_status(F.col("box"), view)
    return rows.select("page", "idx", "kind", status.alias("status"), F.round(area, 4).alias("clipped_area"), F.round(G.signed_area(F.col("polygon")), 4).alias("area")).distinct()


@query(
    S.with_(
        S.OBJECTS,
        select="""SELECT DISTINCT page, idx, 'off_crop' AS kind FROM objects WHERE kind = 'text' AND (x0 < 10 OR x1 > 180 OR y0 < 10 OR y1 > 180)
          UNION ALL SELECT DISTINCT page, NULL, 'page' FROM objects""",
    )
)
def off_crop_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.off_crop(_boxed(A.objects(spark, sf_dir)), G.box(*[F.lit(v) for v in (10.0, 10.0, 180.0, 180.0)])).distinct()


@query()
def align_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every line of both readers."""
    found = align(A.records(A.lines(spark, sf_dir), "a"), A.records(A.lines_again(spark, sf_dir), "b"), "doc_id")
    return found.where("kind IN ('left', 'right')").select("doc_id", "kind", "occurrence_id", "status")


@query()
def reading_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between the two readers, per document."""
    a, b = A.records(A.lines(spark, sf_dir), "a"), A.records(A.lines_again(spark, sf_dir), "b")
    return N.from_alignment(align(a, b, "doc_id"), a, b, "doc_id")


_FINDINGS = """f AS (SELECT event_id, concat('f_', CAST(event_id AS VARCHAR)) AS id, CAST(user_id % 6 AS INTEGER) AS page_index,
  CASE event_type WHEN 'error' THEN 'selected' WHEN 'purchase' THEN 'material_token' WHEN 'click' THEN 'ordinary' ELSE 'informational' END AS priority FROM events)"""


def _events_as_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    priority = F.when(t == "error", "selected").when(t == "purchase", "material_token").when(t == "click", "ordinary").otherwise("informational")
    return A.table(spark, sf_dir, "events").select(F.concat(F.lit("f_"), F.col("event_id").cast("string")).alias("id"), (F.col("user_id") % 6).cast("int").alias("page_index"), priority.alias("priority"))


@query(f"""WITH {_FINDINGS} SELECT id, priority, page_index, row_number() OVER (ORDER BY CASE priority WHEN 'selected' THEN 0 WHEN 'material_token' THEN 1 WHEN 'ordinary' THEN 2 ELSE 3 END, page_index, id) AS place FROM f ORDER BY place LIMIT 50""")
def finding_priority_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.top_by_priority(_events_as_findings(spark, sf_dir), 50)


@query(f"""WITH {_FINDINGS} SELECT page_index, priority, count(*) AS n, min(id) AS first_id FROM f GROUP BY page_index, priority""")
def finding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.grouped(_events_as_findings(spark, sf_dir), ["page_index", "priority"])
