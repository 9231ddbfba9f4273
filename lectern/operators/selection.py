"""Projection of a report to what was selected, and the checks that go with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cited(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the ids; ids may repeat."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def with_all_evidence(findings: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Findings all of whose occurrences are kept. findings: key, occurrence_ids; kept: key, occurrence_id."""
    wanted = findings.select(key, F.explode("occurrence_ids").alias("occurrence_id"))
    lost = wanted.join(kept, [key, "occurrence_id"], "left_anti").select(key).distinct()
    return findings.join(lost, key, "left_anti")


def project(occurrences: DataFrame, findings: DataFrame, select: str = "all", ids: DataFrame | None = None, key: str = "report_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """occurrences, findings and disclosure (what was left out) of a selection: all, cited, none or the ids given.

    Occurrences: key, id. Findings: key, id, occurrence_ids. A finding goes with any of its occurrences.
    """
    if select == "all":
        kept = occurrences
    elif select == "none":
        kept = occurrences.limit(0)
    elif select == "cited":
        used = findings.select(key, F.explode("occurrence_ids").alias("id")).distinct()
        kept = occurrences.join(used, [key, "id"], "left_semi")
    elif ids is not None:
        kept = occurrences.join(ids.select(key, "id").distinct(), [key, "id"], "left_semi")
    else:
        raise ValueError(f"unknown selection {select!r}")
    wanted = findings.select(key, "id", F.explode_outer("occurrence_ids").alias("o")).where("o IS NOT NULL")
    lost = wanted.join(kept.select(key, F.col("id").alias("o")), [key, "o"], "left_anti").select(key, "id").distinct()
    stay = findings.join(lost, [key, "id"], "left_anti")
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    every = count(occurrences, "occurrences").join(count(kept, "kept_occurrences"), key, "left").join(count(findings, "findings"), key, "left").join(count(stay, "kept_findings"), key, "left").na.fill(0)
    return kept, stay, every
