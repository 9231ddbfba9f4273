"""Findings: what two readers' alignment of a page says, linked to its evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X

#: Most urgent first.
PRIORITIES = ("selected", "material_token", "ordinary", "informational")


def rank(priority: Column) -> Column:
    out = F.lit(len(PRIORITIES))
    for k, p in enumerate(PRIORITIES):
        out = F.when(priority == p, k).otherwise(out)
    return out


def top_by_priority(findings: DataFrame, n: int) -> DataFrame:
    """The n most urgent findings with their place: by priority, page, id. Only they meet in one task."""
    first = findings.orderBy(rank(F.col("priority")), "page_index", "id").limit(n)
    line = Window.orderBy(rank(F.col("priority")), "page_index", "id")
    return first.withColumn("place", F.row_number().over(line).cast("long"))


def grouped(findings: DataFrame, by: list[str]) -> DataFrame:
    """by, n, first_id: how many findings a group has, and the first of their ids."""
    return findings.groupBy(*by).agg(F.count("id").alias("n"), F.min("id").alias("first_id"))


def _units(aligned: DataFrame, left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, page_index, kind, unit, left_ids, right_ids, a, b: a page's units that may be findings, and each side's
    unmatched records as one. a, b: the texts of a unit's records in order, with spaces between; null if none was found
    or none is needed. `aligned` is read once, whatever it takes to make."""
    kind = F.col("kind")
    texted = kind.isin("match", "order", "page_level")
    alone = kind.isin("left", "right") & (F.col("status") == "unmatched")
    equal = (kind == "match") & (F.col("text_distance") == 0) & (F.size("left_ids") == 1) & (F.size("right_ids") == 1)
    rows = aligned.where((texted | kind.isin("ambiguous", "abstention") | alone) & ~F.coalesce(equal, F.lit(False)))
    # candidates come as JSON: every record that any of them touches belongs to the unit
    more = F.from_json("more", "array<struct<left:array<string>,right:array<string>>>")
    every = lambda own, side: F.array_distinct(F.concat(own, F.flatten(F.transform(more, lambda c: c[side]))))
    whole = lambda own, side: F.when(kind == "ambiguous", every(F.col(own), side)).when(kind == "abstention", F.col(own))
    # the other units' ids go apart to meet their texts, and come together by their places
    placed = lambda own, side: F.transform(own, lambda x, k: F.struct(F.lit(side).alias("side"), k.alias("at"), x.alias("id")))
    one = F.array(F.struct(kind.alias("side"), F.col("seq").alias("at"), F.col("occurrence_id").alias("id")))
    rows = rows.select(
        key, "page_index", "kind", F.when(alone, -1).otherwise(F.col("seq")).alias("unit"), whole("left_ids", "left").alias("left_whole"), whole("right_ids", "right").alias("right_whole"),
        F.explode_outer(F.when(texted, F.concat(placed("left_ids", "left"), placed("right_ids", "right"))).when(alone, one)).alias("own"),
    )
    rows = rows.withColumn("sought", F.when(F.col("unit") >= 0, F.col("own.id")))
    named = lambda df, side: df.select(F.col(key).alias("k_"), F.col("page_index").alias("p_"), F.lit(side).alias("s_"), F.col("id").alias("i_"), "ordinal", "text")
    texts = named(left, "left").unionByName(named(right, "right"))
    rows = rows.join(texts, (F.col(key) == F.col("k_")) & (F.col("page_index") == F.col("p_")) & (F.col("own.side") == F.col("s_")) & (F.col("sought") == F.col("i_")), "left")
    side = lambda n: F.col("own.side") == n
    ids = lambda n: F.transform(F.array_sort(F.collect_set(F.when(side(n), F.struct("own.at", "own.id")))), lambda x: x["id"])
    text = lambda n: F.collect_list(F.when(side(n) & F.col("i_").isNotNull(), F.struct("ordinal", "text")))
    out = rows.groupBy(key, "page_index", "kind", "unit").agg(
        F.coalesce(F.first("left_whole"), ids("left")).alias("left_ids"), F.coalesce(F.first("right_whole"), ids("right")).alias("right_ids"), text("left").alias("a"), text("right").alias("b")
    )
    return out.withColumns({c: F.when(F.size(c) > 0, X.group_text(F.col(c))) for c in "ab"})


def from_alignment(aligned: DataFrame, left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, page_index, kind, alignment, priority, left_ids, right_ids: findings of completed comparisons without a
    selected region.

    A match with different texts is a reading difference, of material priority if a token with an amount or a sign
    differs; one with equal texts in another order is an order difference; ambiguous units keep all their candidates;
    a component that was too large is an incomplete check; each side's unmatched records are one finding; page-level
    records of both sides with different texts are one.
    """
    units, kind = _units(aligned, left, right, key), F.col("kind")
    differ = F.col("a") != F.col("b")  # null where a side has no text
    found = [
        ((kind == "match") & differ, "reading_difference", "page_level", F.when(X.material_token_difference(F.col("a"), F.col("b")), "material_token").otherwise("ordinary")),
        ((kind == "order") & ~differ, "observed_structure", "not_applicable", "informational"),
        (kind == "ambiguous", "reading_difference", "ambiguous", "ordinary"),
        (kind == "abstention", "incomplete_check", "not_applicable", "informational"),
        (kind == "left", "observed_structure", "unmatched", "informational"),
        (kind == "right", "ocr_interpretation", "unmatched", "informational"),
        ((kind == "page_level") & differ, "reading_difference", "page_level", "ordinary"),
    ]
    says = lambda n: F.coalesce(*[F.when(f[0], f[n] if isinstance(f[n], Column) else F.lit(f[n])) for f in found])
    out = units.select(key, "page_index", says(1).alias("kind"), says(2).alias("alignment"), says(3).alias("priority"), "left_ids", "right_ids")
    return out.where("kind IS NOT NULL")


def one_sided_without_alignment(checks: DataFrame) -> DataFrame:
    """checks: key, page_index, text_status, ocr_status, alignment_status, left_ids, right_ids. Pages whose comparison
    never completed, read by one side only, and every check that did not complete."""
    never = ~F.coalesce(F.col("alignment_status") == "completed", F.lit(False))
    left = checks.where(never & (F.col("text_status") == "completed") & (F.size("right_ids") == 0) & (F.size("left_ids") > 0))
    right = checks.where(never & (F.col("ocr_status") == "completed") & (F.size("left_ids") == 0) & (F.size("right_ids") > 0))
    a = left.select("key", "page_index", F.lit("observed_structure").alias("kind"), F.lit("informational").alias("priority"))
    b = right.select("key", "page_index", F.lit("ocr_interpretation").alias("kind"), F.lit("informational").alias("priority"))
    each = F.explode(F.array("text_status", "ocr_status", "alignment_status"))
    open_checks = checks.select("key", "page_index", each.alias("s")).where("s IS NOT NULL AND s != 'completed'")
    c = open_checks.select("key", "page_index", F.lit("incomplete_check").alias("kind"), F.lit("informational").alias("priority"))
    return a.unionByName(b).unionByName(c)
