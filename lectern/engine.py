"""The commands: inspect, compare, run a corpus, keep a baseline, validate, evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import normalize
from lectern.operators import alignment, compare, coverage, findings, lineage, reports, validate
from lectern.sources import artifacts, readers, sinks


class Engine:
    """Commands over one session. DataFrames go in and come out; only writers touch files."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def inspect(self, docs: DataFrame, key: str = "doc_id", text: str = "text", pages: list[int] | None = None, region=None) -> DataFrame:
        """Records of a text reader with normalised text; of given pages, inside a region (an array of four)."""
        out = readers.text_lines(docs, key, text).withColumn("text", normalize(F.col("raw_text")))
        if pages is not None:
            out = out.where(F.col("page_index").isin(pages))
        if region is not None:
            from lectern.functions.geometry import boxes_meet, polygon_box

            out = out.where(F.col("polygon").isNotNull()).where(boxes_meet(polygon_box(F.col("polygon")), region))
        return out

    def compare_readers(self, left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """Alignment and findings of exactly two readers' records."""
        aligned = alignment.align(left, right, key)
        return aligned, findings.from_alignment(aligned, left, right, key)

    def compare_runs(self, facts: DataFrame, mode: str = "same_document", fail_on_changed: bool = False) -> tuple[DataFrame, int]:
        """Status of each key, and the exit code."""
        if mode not in ("same_document", "reader_upgrade", "document_versions"):
            raise ValueError(f"unknown mode {mode!r}")
        out = compare.status(facts, mode)
        return out, compare.fold(out, fail_on_changed).first()["exit_code"]

    def corpus_run(self, manifest: DataFrame, files: DataFrame, read, done: DataFrame | None = None) -> DataFrame:
        """key, status, reason, records of every entry of a verified corpus; what `done` (key, config_digest, status) has
        completed is not read again. An entry that is not what the manifest says fails; it never stops the run."""
        checked = artifacts.verified_corpus(manifest, files)
        jobs = checked.where("problem IS NULL")
        if done is not None:
            jobs, conflicts = lineage.incremental(jobs, done)
            if not conflicts.isEmpty():
                raise ValueError("completed entries were read under another configuration")
        content = jobs.join(files, "source_path").select("key", "content")
        out = readers.isolated(content, read, "key", "content")
        bad = checked.where("problem IS NOT NULL").select("key", F.lit("failed").alias("status"), F.col("problem").alias("reason"), F.lit(None).cast("string").alias("records"))
        return out.unionByName(bad)

    def baseline(self, run: DataFrame, folder: str, approved_by: str, rationale: str, rules: bytes = b"") -> dict:
        return sinks.create_baseline(run, folder, {"approved_by": approved_by, "rationale": rationale}, rules)

    def validate(self, path: str) -> DataFrame:
        """path, code of every artifact under a path: null for a valid report."""
        scanned = artifacts.scan(self.spark, path)
        stored = artifacts.reports(scanned)
        last = validate.hash_violations(stored).select("key", F.lit(len(validate.rules())).alias("rule"), "code")
        every = validate.violations(stored).select("key", "rule", "code").unionByName(last)
        broken = every.groupBy("key").agg(F.min_by("code", "rule").alias("broken"))
        named = scanned.withColumn("key", F.regexp_extract("path", r"([^/]+?)\.json$", 1))
        return named.join(broken, "key", "left").select("path", F.coalesce("code", "broken").alias("code"))

    def open(self, path: str) -> DataFrame:
        """key, coverage and preview of every report under a path."""
        stored = artifacts.reports(artifacts.scan(self.spark, path))
        return reports.coverage_view(stored).join(reports.preview(stored), "key")

    def evaluate(self, labels: DataFrame, readings: DataFrame, planned: DataFrame, targets: DataFrame) -> DataFrame:
        """Verdicts on targets of the metrics supported_coverage, full_coverage, clean_alerts, occurrence_preservation
        and check_accounting."""
        pages = coverage.collapse_readings(readings)
        one = lambda df, name, value, n: df.select(F.lit(name).alias("metric"), F.col(value).alias("value"), F.col(n).cast("long").alias("samples"))
        parts = [
            one(coverage.coverage(labels.where("truth = 'supported_failure'"), pages), "supported_coverage", "rate", "total"),
            one(coverage.coverage(labels, pages), "full_coverage", "rate", "total"),
            one(coverage.clean_alerts(labels, pages), "clean_alerts", "per_page", "clean_pages"),
            one(coverage.occurrence_preservation(labels, pages), "occurrence_preservation", "fraction", "pages"),
            one(coverage.check_accounting(planned, readings), "check_accounting", "fraction", "planned"),
        ]
        metrics = parts[0]
        for p in parts[1:]:
            metrics = metrics.unionByName(p)
        return coverage.verdicts(metrics, targets)
