"""Comparison of two stored runs under acceptance rules.

A run is three tables keyed by report key: reports (key, document_sha256, readers), checks (key, id, status, ...) and
occurrences (key, id, seq, page_index, reader_id, raw_text, polygon, precision).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.geometry import max_vertex_distance

#: What a key came to, and the exit code; the worst of a run is the first of PRECEDENCE.
EXIT = {"errored": 3, "regressed": 5, "incomparable": 6, "changed": 0, "unchanged": 0}
PRECEDENCE = (2, 4, 5, 6, 3, 0)
MOST_IDS = 32


def side_by_side(left: DataFrame, right: DataFrame, key: str = "key") -> DataFrame:
    """All keys of both runs, each other column twice (left_, right_), and has_left, has_right."""
    name = lambda df, side: df.select(key, *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c != key], F.lit(True).alias(f"has_{side}"))
    out = name(left, "left").join(name(right, "right"), key, "full_outer")
    return out.withColumns({f"has_{s}": F.coalesce(f"has_{s}", F.lit(False)) for s in ("left", "right")})


def coverage_lost(checks: DataFrame, occurrences: DataFrame) -> DataFrame:
    """checks and occurrences of both runs (key, side, ...): whether the right run completed fewer checks or kept fewer
    occurrences. Null sides count as nothing."""
    done = lambda s: F.count_if((F.col("side") == s) & (F.col("status") == "completed"))
    own = lambda s: F.count_if(F.col("side") == s)
    c = checks.groupBy("key").agg(done("left").alias("cl"), done("right").alias("cr"))
    o = occurrences.groupBy("key").agg(own("left").alias("ol"), own("right").alias("orr"))
    every = c.join(o, "key", "full_outer").na.fill(0)
    return every.select("key", ((F.col("cr") < F.col("cl")) | (F.col("orr") < F.col("ol"))).alias("coverage_lost"))


def status(facts: DataFrame, mode: str = "same_document", fail_on_coverage_loss: bool = True, fail_on_error: bool = True) -> DataFrame:
    """facts: key, has_left, has_right, same_document, same_readers, violations, coverage_lost, right_failed, changes.
    The first that applies decides: a missing side, another document, other readers, broken rules, lost coverage, a
    failed check, a change."""
    missing = ~(F.col("has_left") & F.col("has_right"))
    strict = F.lit(fail_on_coverage_loss or fail_on_error)
    out = (
        F.when(missing & strict & F.col("has_rules"), "regressed")
        .when(missing, "errored")
        .when(~F.col("same_document") & F.lit(mode != "document_versions"), "incomparable")
        .when(~F.col("same_readers") & F.lit(mode not in ("reader_upgrade", "document_versions")), "incomparable")
        .when(F.col("violations") > 0, "regressed")
        .when(F.col("coverage_lost") & F.lit(fail_on_coverage_loss), "regressed")
        .when(F.col("right_failed") & F.lit(fail_on_error), "regressed")
        .when(F.col("changes") > 0, "changed")
        .otherwise("unchanged")
    )
    return facts.withColumn("status", out)


def exit_code(status: Column) -> Column:
    out = F.lit(0)
    for name, code in EXIT.items():
        out = F.when(status == name, code).otherwise(out)
    return out


def fold(statuses: DataFrame, fail_on_changed: bool = False) -> DataFrame:
    """The run's exit code, and how many keys there are of each status."""
    code = exit_code(F.col("status"))
    if fail_on_changed:
        code = F.when(F.col("status") == "changed", 5).otherwise(code)
    rank = F.lit(len(PRECEDENCE))
    for k, c in reversed(list(enumerate(PRECEDENCE))):
        rank = F.when(code == c, k).otherwise(rank)
    counts = [F.count_if(F.col("status") == s).alias(s) for s in EXIT]
    return statuses.select(code.alias("code"), rank.alias("rank"), "status").agg(F.coalesce(F.min_by("code", "rank"), F.lit(0)).alias("exit_code"), *counts)


def scoped(rules: DataFrame, occurrences: DataFrame, retained: DataFrame | None = None) -> DataFrame:
    """Occurrences each rule looks at: of its document and page, its reader if it names one, its region's if it names
    one. retained: region_id, occurrence_id. Rules are few and are sent to the occurrences; a rule keeps no row apart."""
    r = rules.select("rule_id", F.col("document_sha256").alias("_doc"), F.col("page_index").alias("_page"), F.col("reader_id").alias("_reader"), F.col("region_id").alias("_region"))
    hit = occurrences.join(r, (F.col("document_sha256") == F.col("_doc")) & (F.col("page_index") == F.col("_page")) & (F.col("_reader").isNull() | (F.col("reader_id") == F.col("_reader"))))
    if retained is not None:
        k = retained.select(F.col("region_id").alias("_kr"), F.col("occurrence_id").alias("_ko")).distinct()
        inside = hit.join(k, (F.col("_region") == F.col("_kr")) & (F.col("id") == F.col("_ko")), "left")
        hit = inside.where("_region IS NULL OR _ko IS NOT NULL").drop("_kr", "_ko")
    return hit.drop("_doc", "_page", "_reader", "_region")


def joined_text(hits: DataFrame, text: str = "raw_text") -> DataFrame:
    """rule_id, text (lines in order of seq), n, ids (the first MOST_IDS)."""
    rows = F.array_sort(F.collect_list(F.struct("seq", F.col(text).alias("text"), "id")))
    return hits.groupBy("rule_id").agg(rows.alias("rows")).select(
        "rule_id", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("text"), F.size("rows").alias("n"), F.slice(F.transform("rows", lambda r: r["id"]), 1, MOST_IDS).alias("ids")
    )


def geometry_deltas(left: DataFrame, right: DataFrame) -> DataFrame:
    """Scoped occurrences of both sides (rule_id, seq, polygon, precision), paired by place in order: per rule whether
    any pair can be compared, and the greatest distance of corners."""
    line = Window.partitionBy("rule_id").orderBy("seq")
    number = lambda df, s: df.select("rule_id", F.row_number().over(line).alias("n"), F.col("polygon").alias(f"{s}_polygon"), F.col("precision").alias(f"{s}_precision"))
    both = number(left, "l").join(number(right, "r"), ["rule_id", "n"])
    precise = F.col("l_precision").isin("exact", "estimated") & F.col("r_precision").isin("exact", "estimated")
    delta = F.when(precise, max_vertex_distance(F.col("l_polygon"), F.col("r_polygon")))
    return both.groupBy("rule_id").agg(F.max(delta).alias("delta"), F.coalesce(F.bool_or(delta.isNotNull()), F.lit(False)).alias("comparable"))


def evaluate_rules(rules: DataFrame, left: DataFrame, right: DataFrame, checks: DataFrame, retained: DataFrame | None = None) -> DataFrame:
    """rule_id, type, verdict (holds, violated or incomparable) of rules whose document is the right run's.

    rules: rule_id, type, document_sha256, page_index, reader_id, region_id, capability, expected_text, expected_count,
    max_delta_pt. checks: the right run's, with document_sha256, page_index, capability, reader_ids, region_id, status.
    """
    own = rules.join(right.select("document_sha256").union(checks.select("document_sha256")).distinct(), "document_sha256", "left_semi")
    now, was = scoped(own, right, retained), scoped(own, left, retained)
    a = joined_text(now).withColumnsRenamed({"text": "now_text", "n": "now_n"}).drop("ids")
    b = joined_text(was).select("rule_id", F.col("text").alias("was_text"))
    c = checks.select(F.col("document_sha256").alias("_d"), F.col("page_index").alias("_p"), F.col("capability").alias("_c"), F.col("reader_ids").alias("_r"), F.col("region_id").alias("_g"), "status")
    fits = (
        (F.col("document_sha256") == F.col("_d")) & (F.col("page_index") == F.col("_p")) & (F.col("reader_id").isNull() | F.array_contains("_r", F.col("reader_id")))
        & (F.col("capability").isNull() | (F.col("capability") == F.col("_c"))) & (F.col("region_id").isNull() | (F.col("region_id") == F.col("_g")))
    )
    done = own.join(c, fits).groupBy("rule_id").agg(F.bool_or(F.col("status") == "completed").alias("done"))
    every = own.join(a, "rule_id", "left").join(b, "rule_id", "left").join(done, "rule_id", "left").join(geometry_deltas(was, now), "rule_id", "left")
    text, old = F.coalesce("now_text", F.lit("")), F.coalesce("was_text", F.lit(""))
    t = F.col("type")
    violated = (
        F.when(t == "expected_text", ~F.contains(text, F.col("expected_text")))
        .when(t == "stable_reading", text != old)
        .when(t == "required_coverage", ~F.coalesce("done", F.lit(False)))
        .when(t == "expected_occurrence_count", F.coalesce("now_n", F.lit(0)) != F.col("expected_count"))
        .when(t == "max_geometry_delta", F.col("delta") > F.col("max_delta_pt"))
    )
    apart = (t == "max_geometry_delta") & ~F.coalesce("comparable", F.lit(False))
    verdict = F.when(apart, "incomparable").when(F.coalesce(violated, F.lit(False)), "violated").otherwise("holds")
    return every.select("rule_id", "type", verdict.alias("verdict"))


def incompatible_readers(left: DataFrame, right: DataFrame) -> DataFrame:
    """key, differ: whether reader ids (sorted) or settings (in list order) of the two runs differ. Both: key, readers
    (array of id, settings)."""
    ids = lambda c: F.array_sort(F.transform(c, lambda r: r["id"]))
    settings = lambda c: F.to_json(F.transform(c, lambda r: r["settings"]))
    both = left.select("key", F.col("readers").alias("l")).join(right.select("key", F.col("readers").alias("r")), "key")
    return both.select("key", ((ids("l") != ids("r")) | (settings("l") != settings("r"))).alias("differ"))
