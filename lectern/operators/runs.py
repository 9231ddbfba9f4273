"""Rules of inspection runs, corpus manifests and stored comparisons; changes between aligned runs; retries and slots."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.coverage import RESOLUTIONS, TERMINAL

#: Reasons that one more try may mend, and reasons that none will.
TRANSIENT = ("worker_crash", "init_crash")
NEVER = ("user_cancel", "encrypted", "unsupported", "integrity")
HEX, CHECK_ID = "^[0-9a-f]{64}$", "^[A-Za-z0-9][A-Za-z0-9_.:-]*$"
#: Slots for transferred rasters, ids that a change names.
SLOTS, MOST_IDS = 2, 32


def retry_kind(reason: Column) -> Column:
    return F.when(reason.isin(*TRANSIENT), "transient").when(reason.isin(*NEVER), "never").otherwise("other")


def reading_problems(readings: DataFrame) -> DataFrame:
    """readings (document_sha256, page_index, check_id, status, resolution, finding_ids, comparison_ref,
    occurrence_count, errors) with problem: why one cannot stand, null if it can. A resolution is evidence: its check has
    completed, and it names its findings or its comparison."""
    r, none = F.col("resolution"), F.lit(False)
    problem = (
        F.when(~F.coalesce(F.col("document_sha256").rlike(HEX), none), "document")
        .when(~F.coalesce(F.col("page_index") >= 0, none), "page")
        .when(~F.coalesce(F.col("check_id").rlike(CHECK_ID), none), "check_id")
        .when(~F.coalesce(F.col("status").isin(*TERMINAL), none), "status")
        .when(r.isNotNull() & ~r.isin(*RESOLUTIONS), "resolution")
        .when(r.isNotNull() & (F.col("status") != "completed"), "unfinished")
        .when((r == "useful_finding") & (F.coalesce(F.size("finding_ids"), F.lit(0)) < 1), "no_findings")
        .when((r == "actionable_comparison") & F.col("comparison_ref").isNull(), "no_comparison")
        .when(F.col("occurrence_count") < 0, "count")
        .when(F.exists("errors", lambda e: e < 0), "errors")
    )
    return readings.withColumn("problem", problem)


def corpus_problems(entries: DataFrame) -> DataFrame:
    """entries (key, source_path, sha256, group_id, pages) with problem."""
    twice = F.count(F.lit(1)).over(Window.partitionBy("key"))
    pages = F.col("pages")
    problem = (
        F.when(~F.col("key").rlike("^[a-z0-9][a-z0-9_-]*$"), "key")
        .when(twice > 1, "duplicate_key")
        .when(F.col("source_path").rlike(r"(^/)|\\|(^|/)\.\.?(/|$)"), "unsafe_path")
        .when(~F.col("sha256").rlike(HEX), "sha256")
        .when(F.col("group_id").isNull() | (F.col("group_id") == ""), "group")
        .when((F.size(pages) < 1) | F.exists(pages, lambda p: p < 0) | (F.size(F.array_distinct(pages)) < F.size(pages)), "pages")
    )
    return entries.withColumn("problem", problem)


def target_problem() -> Column:
    """Of targets (target, metric, comparator, threshold, min_samples)."""
    return (
        F.when(F.col("target").isNull() | (F.col("target") == ""), "target")
        .when(~F.col("comparator").isin(">=", "<=", ">", "<"), "comparator")
        .when(F.col("threshold").isNull() | F.isnan("threshold"), "threshold")
        .when(F.col("min_samples") < 1, "min_samples")
    )


def corpus_entries(fixtures: DataFrame, split: str) -> DataFrame:
    """Entries of one split's PDF fixtures (path, split, sha256, fixture_id, family): key, source_path, sha256, group_id,
    pages. A control belongs to the group of what it controls."""
    stem = F.regexp_extract("path", r"([^/]+)\.pdf$", 1)
    key = F.regexp_replace(F.regexp_replace(F.lower(stem), "[^a-z0-9_-]+", "-"), "^-+|-+$", "")
    rows = fixtures.where((F.col("split") == split) & F.col("path").endswith(".pdf"))
    return rows.select(key.alias("key"), F.concat(F.lit("fixtures/"), "path").alias("source_path"), "sha256", F.concat_ws("-", F.lower("fixture_id"), "family").alias("group_id"), F.array(F.lit(0)).alias("pages"))


def lineage_nodes(corpus: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Both shapes of entries as one: key, group_id, sha256, control."""
    a = corpus.select("key", "group_id", "sha256", F.explode_outer("controls").alias("control"))
    b = fixtures.select(F.col("path").alias("key"), F.concat_ws("-", F.lower("fixture_id"), "family").alias("group_id"), "sha256", "control")
    return a.unionByName(b)


def message_problem() -> Column:
    """Of messages (event, status, reason, completed_units, total_units, rows): whether their members go together."""
    return (
        F.when((F.col("event") == "terminal") & F.col("status").isNull(), "no_status")
        .when((F.col("event") == "terminal") & (F.col("status") != "completed") & F.col("reason").isNull(), "no_reason")
        .when((F.col("event") == "progress") & (F.col("completed_units") > F.col("total_units")), "progress")
        .when((F.col("event") == "chunk") & (F.coalesce("rows", F.lit(0)) < 1), "empty_chunk")
    )


def identity_conflicts(runs: DataFrame) -> DataFrame:
    """run of runs (run, declared_profile, report_profile) whose reports do not all say one profile, or not the declared."""
    each = runs.groupBy("run").agg(F.count_distinct("report_profile").alias("n"), F.bool_or(F.col("declared_profile") != F.col("report_profile")).alias("other"))
    return each.where((F.col("n") > 1) | F.coalesce("other", F.lit(False))).select("run")


def readiness(left: DataFrame, right: DataFrame) -> DataFrame:
    """key, ready: ready, missing_left, missing_right, other_document or other_readers, before a comparison starts."""
    a, b = (df.select("key", F.col("document_sha256").alias(f"{s}_doc"), F.array_sort("reader_ids").alias(f"{s}_readers")) for df, s in ((left, "l"), (right, "r")))
    both = a.join(b, "key", "full_outer")
    state = F.when(F.col("l_doc").isNull(), "missing_left").when(F.col("r_doc").isNull(), "missing_right").when(F.col("l_doc") != F.col("r_doc"), "other_document").when(F.col("l_readers") != F.col("r_readers"), "other_readers")
    return both.select("key", F.coalesce(state, F.lit("ready")).alias("ready"))


def verified_source(candidates: DataFrame, sha256: str, length: int) -> DataFrame:
    """candidates (name, content) with outcome: length first, then the hash."""
    own = F.octet_length("content")
    return candidates.select("name", F.when(own != length, "length").when(F.sha2("content", 256) != sha256, "sha256").otherwise("match").alias("outcome"))


def first_checks(plan: DataFrame) -> DataFrame:
    """run, page_index and the first check of each capability in the plan's order (seq)."""
    pick = lambda c: F.min_by(F.when(F.col("capability") == c, F.col("check_id")), F.when(F.col("capability") == c, F.col("seq"))).alias(c)
    return plan.groupBy("run", "page_index").agg(pick("native_text"), pick("ocr"), pick("alignment"))


def changes(aligned: DataFrame, left: DataFrame, right: DataFrame, checks: DataFrame, key: str) -> DataFrame:
    """key, kind, page_index, explanation of what differs between two stored runs of a key: check statuses, order, texts
    of matched records (lines in order), and else the whole raw text. checks: key, check_id, left_status, right_status.

    left and right: key, page_index, id, ordinal, text, raw_text.
    """
    status = checks.where(~F.col("left_status").eqNullSafe(F.col("right_status"))).select(key).distinct()
    one = status.select(key, F.lit("coverage").alias("kind"), F.lit(None).cast("int").alias("page_index"), F.lit("check statuses differ").alias("explanation"))
    order = aligned.where("kind = 'order'").select(key, "page_index").distinct().select(key, F.lit("order").alias("kind"), "page_index", F.lit("records come in another order").alias("explanation"))

    def lines(rows: DataFrame, ids: str, out: str) -> DataFrame:
        each = aligned.where("kind = 'match'").select(key, "page_index", "seq", F.posexplode(F.slice(ids, 1, MOST_IDS)).alias("n", "id"))
        own = each.join(rows.select(key, "page_index", "id", "text"), [key, "page_index", "id"])
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda r: r["text"]), "\n")
        return own.groupBy(key, "page_index", "seq").agg(text.alias(out))

    pairs = lines(left, "left_ids", "a").join(lines(right, "right_ids", "b"), [key, "page_index", "seq"], "full_outer")
    text = pairs.where(~F.coalesce("a", F.lit("")).eqNullSafe(F.coalesce("b", F.lit("")))).select(key, F.lit("text").alias("kind"), "page_index", F.lit("aligned records differ").alias("explanation"))
    whole = lambda rows, out: rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "ordinal", "raw_text"))), lambda r: r["raw_text"]), "\n").alias(out))
    both = whole(left, "a").join(whole(right, "b"), key, "full_outer")
    raw = both.where(~F.col("a").eqNullSafe(F.col("b"))).select(key).join(text.select(key).distinct(), key, "left_anti")
    last = raw.select(key, F.lit("text").alias("kind"), F.lit(0).alias("page_index"), F.lit("extracted text differs").alias("explanation"))
    return one.unionByName(order).unionByName(text).unionByName(last)


def slots(transfers: DataFrame) -> DataFrame:
    """transfers (run, arrival, kind: take or release) with in_use, and refused where no slot was free.

    A refused take changes nothing, so what is in use is a fold over a run's transfers in order. They come sorted, and a
    task keeps the number of the run at hand alone."""
    kinds = transfers.select("run", "arrival", "kind").schema

    def run(batches):
        key, n = None, 0
        for batch in batches:
            in_use, refused = [], []
            for own, kind in zip(batch.column("run").to_pylist(), batch.column("kind").to_pylist(), strict=True):
                if own != key:
                    key, n = own, 0
                refused.append(kind == "take" and n >= SLOTS)
                n = min(n + 1, SLOTS) if kind == "take" else max(n - 1, 0)
                in_use.append(n)
            cols = [*batch.columns, pa.array(in_use, pa.int32()), pa.array(refused, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, "in_use", "refused"])

    rows = transfers.select("run", "arrival", "kind").repartition("run").sortWithinPartitions("run", "arrival")
    return rows.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kinds], "in_use int", "refused boolean"]))


def next_attempts(jobs: DataFrame, most: int = 2) -> DataFrame:
    """Jobs (job, attempt, status, reason) to try again: the last attempt failed for a transient reason, and fewer than
    `most` were made."""
    last = jobs.groupBy("job").agg(F.max("attempt").alias("attempt"), F.max_by("status", "attempt").alias("status"), F.max_by("reason", "attempt").alias("reason"))
    again = (F.col("status") == "failed") & (retry_kind(F.col("reason")) == "transient") & (F.col("attempt") < most)
    return last.where(again).select("job", (F.col("attempt") + 1).alias("attempt"))


def settled(jobs: DataFrame, planned: DataFrame) -> DataFrame:
    """Every planned job with an end: those without one are failed, so that nothing waits for ever."""
    last = jobs.groupBy("job").agg(F.max_by("status", "attempt").alias("status"), F.max_by("reason", "attempt").alias("reason"))
    return planned.select("job").distinct().join(last, "job", "left").select("job", F.coalesce("status", F.lit("failed")).alias("status"), F.coalesce("reason", F.when(F.col("status").isNull(), "never_started")).alias("reason"))
