"""Views of reports: coverage, previews, availability of readers, explanations, display classes, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a marker of nothing but another order says.
ORDER_ONLY = "emission order differs"
MOST_NOTES = 90


def preview(reports: DataFrame) -> DataFrame:
    """key and what an export would hold: counts, bytes of texts and assets, and warnings."""
    text = F.aggregate("occurrences", F.lit(0).cast("long"), lambda s, o: s + F.octet_length(o["raw_text"]))
    size = F.aggregate("assets", F.lit(0).cast("long"), lambda s, a: s + a["byte_length"])
    renders = F.size(F.filter("assets", lambda a: a["purpose"] == "page_render"))
    warnings = F.array_compact(
        F.array(
            F.when(F.size("occurrences") > 0, "holds text of the document"),
            F.when(renders > 0, "holds images of whole pages"),
            F.when(F.col("document.source_asset_id").isNotNull(), "holds the original"),
            F.when(F.col("document.display_name").isNotNull(), "holds the file's name"),
            F.when(size > 24 * 1024 * 1024, "assets are too large"),
        )
    )
    count = lambda c: F.size(c).cast("long")
    return reports.select(
        "key", count("occurrences").alias("occurrences"), count("findings").alias("findings"), count("annotations").alias("notes"), count("assets").alias("assets"), text.alias("text_bytes"),
        size.alias("asset_bytes"), warnings.alias("warnings"),
    )


def coverage_view(reports: DataFrame) -> DataFrame:
    """key and its checks' outcomes. Failed counts skipped ones too, and leaves out timeouts and cancellations, which
    have numbers of their own."""
    n = lambda *s: F.size(F.filter("checks", lambda c: c["status"].isin(*s))).cast("long")
    retained = F.aggregate("checks", F.lit(0).cast("long"), lambda s, c: s + F.size(c["retained_occurrence_ids"]))
    return reports.select("key", F.size("checks").cast("long").alias("planned"), n("completed").alias("completed"), n("failed", "skipped").alias("failed"), n("timeout").alias("timeout"), n("cancelled").alias("cancelled"), retained.alias("retained"))


def reader_availability(recorded: DataFrame, installed: DataFrame) -> DataFrame:
    """key, id, available: recorded readers (key, id, version), with their version, among installed ones (id, version)."""
    here = installed.select("id", "version").distinct().withColumn("available", F.lit(True))
    return recorded.join(here, ["id", "version"], "left").na.fill(False, ["available"])


def replay_readiness(reports: DataFrame, availability: DataFrame) -> DataFrame:
    """key, readiness: ready, missing_reader or missing_source."""
    missing = availability.where("NOT available").select("key").distinct().withColumn("_missing", F.lit(True))
    state = F.when(F.col("document.source_asset_id").isNull(), "missing_source").when(F.col("_missing"), "missing_reader").otherwise("ready")
    return reports.join(missing, "key", "left").select("key", state.alias("readiness"))


def occurrence_views(reports: DataFrame) -> DataFrame:
    """key, finding_id, position, reader, page_index, raw_text: the readings that a finding cites, in its order."""
    f = reports.select("key", F.explode("findings").alias("f")).select("key", F.col("f.id").alias("finding_id"), F.posexplode("f.occurrence_ids").alias("position", "id"))
    o = reports.select("key", F.explode("occurrences").alias("o")).select("key", F.col("o.id").alias("id"), F.col("o.reader_id").alias("reader_id"), F.col("o.page_index").alias("page_index"), F.col("o.raw_text").alias("raw_text"))
    r = reports.select("key", F.explode("readers").alias("r")).select("key", F.col("r.id").alias("reader_id"), F.concat_ws(" ", "r.name", "r.version").alias("reader"))
    return f.join(o, ["key", "id"]).join(r, ["key", "reader_id"], "left").drop("id", "reader_id")


def explain(views: DataFrame) -> DataFrame:
    """key, finding_id, explanation: what the first two readings of a finding say."""
    rows = F.array_sort(F.collect_list(F.struct("position", "reader", "raw_text")))
    each = views.groupBy("key", "finding_id").agg(rows.alias("r"))
    a, b = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    both = F.format_string('%s reads "%s"; %s reads "%s".', a["reader"], a["raw_text"], b["reader"], b["raw_text"])
    one = F.format_string('%s reads "%s"; no matching reading was found here.', a["reader"], a["raw_text"])
    return each.select("key", "finding_id", F.when(F.size("r") > 1, both).otherwise(one).alias("explanation"))


def display_class(finding: Column, texts: Column) -> Column:
    """How a finding is shown: incomplete, ambiguous, order_only, page_level, one_sided, difference or note."""
    same = F.size(F.array_distinct(texts)) <= 1
    return (
        F.when(finding["kind"] == "incomplete_check", "incomplete")
        .when(finding["alignment"] == "ambiguous", "ambiguous")
        .when((finding["kind"] == "observed_structure") & (finding["alignment"] == "not_applicable") & same, "order_only")
        .when(finding["alignment"] == "unmatched", "one_sided")
        .when(finding["alignment"] == "page_level", "page_level")
        .when(finding["kind"] == "reading_difference", "difference")
        .otherwise("note")
    )


def is_order_only(explanation: Column) -> Column:
    return F.contains(F.lower(explanation), F.lit(ORDER_ONLY))


def columns_by_reader(views: DataFrame, readers: list[str]) -> DataFrame:
    """One row for each finding, one column for each reader with its readings in order."""
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "raw_text"))), lambda r: r["raw_text"]), " ")
    return views.groupBy("key", "finding_id").pivot("reader", readers).agg(own)


def notes_with_ids(notes: DataFrame) -> DataFrame:
    """Annotations (key, finding_id, page_index, text) trimmed, without empty ones, numbered, the first MOST_NOTES."""
    rows = notes.withColumn("text", F.substring(F.trim("text"), 1, 4000)).where("text != ''")
    line = Window.partitionBy("key").orderBy("page_index", "finding_id", "text")
    rows = rows.withColumn("n", F.row_number().over(line)).where(F.col("n") <= MOST_NOTES)
    return rows.withColumn("id", F.concat(F.lit("a_"), F.substring(F.sha2(F.concat_ws("|", "key", "text"), 256), 1, 12), F.lit("_"), F.col("n").cast("string")))


def export_name(report: Column, extension: str) -> Column:
    """A file name that says which report it is and nothing of the document's own name."""
    return F.concat(F.lit("report-"), F.substring(report, 1, 12), F.lit(f".{extension}"))


def assemble(transforms: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transforms without repeats (the first of an id wins, by seq), and limitations rolled up: status, reason, n, ids."""
    line = Window.partitionBy("report_id", "id").orderBy("seq")
    once = transforms.withColumn("_n", F.row_number().over(line)).where("_n = 1").drop("_n")
    limits = checks.where("status != 'completed'").groupBy("report_id", "status", "reason").agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_list("id")), 1, 100).alias("ids"))
    return once, limits


def provenance_limits(left: DataFrame, right: DataFrame, first_key: Column | None = None) -> DataFrame:
    """field, left, right of reader identities (key, name, version, build) that differ in the first comparable key."""
    both = left.alias("l").join(right.alias("r"), "key").orderBy("key").limit(1)
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"l.{c}").alias("left"), F.col(f"r.{c}").alias("right")) for c in ("name", "version", "build")])
    return both.select(F.explode(F.filter(each, lambda d: ~d["left"].eqNullSafe(d["right"]))).alias("d")).select("d.*")
