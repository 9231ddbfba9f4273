"""Coverage and evaluation figures with honest denominators: what was planned or labelled counts, read or not."""

from __future__ import annotations

from bisect import bisect_right, insort

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.statistics import quantiles, wilson

TERMINAL = ("completed", "failed", "timeout", "cancelled", "skipped", "unsupported")
RESOLUTIONS = ("useful_finding", "actionable_comparison")


def page_key(document: Column, page: Column) -> Column:
    return F.concat_ws(":", document, page.cast("string"))


def collapse_readings(readings: DataFrame) -> DataFrame:
    """One row for each page_key: readings, resolved, findings (distinct ids), min_count, max_error, statuses (status
    to number). A page is resolved if a completed reading says how; repeated readings never add pages.

    readings: page_key, status, resolution, finding_ids, occurrence_count, errors (pixels).
    """
    done = F.col("status") == "completed"
    tally = readings.groupBy("page_key", "status").agg(F.count(F.lit(1)).alias("n"))
    tally = tally.groupBy("page_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("statuses"))
    pages = readings.groupBy("page_key").agg(
        F.count(F.lit(1)).alias("readings"),
        F.bool_or(F.coalesce(done & F.col("resolution").isin(*RESOLUTIONS), F.lit(False))).alias("resolved"),
        F.array_distinct(F.flatten(F.collect_list(F.coalesce("finding_ids", F.array().cast("array<string>"))))).alias("findings"),
        F.min(F.when(done, F.col("occurrence_count"))).alias("min_count"),
        F.max(F.array_max("errors")).alias("max_error"),
    )
    return pages.join(tally, "page_key")


def by_label(labels: DataFrame, pages: DataFrame) -> DataFrame:
    """Every labelled page with what its readings came to, if there were any."""
    return labels.join(pages, "page_key", "left")


def coverage(labels: DataFrame, pages: DataFrame, *by: str) -> DataFrame:
    """total, covered, never_attempted, rate and the Wilson bounds, over all labelled pages or by columns of theirs."""
    every = by_label(labels, pages)
    total, covered = F.count(F.lit(1)), F.count_if(F.coalesce("resolved", F.lit(False)))
    out = every.groupBy(*by).agg(
        total.alias("total"), covered.alias("covered"), F.count_if(F.col("readings").isNull()).alias("never_attempted")
    )
    low, high = wilson(F.col("covered"), F.col("total"))
    rate = F.try_divide(F.col("covered").cast("double"), F.col("total"))
    return out.withColumns({"rate": rate, "wilson_low": low, "wilson_high": high})


def uncovered_statuses(labels: DataFrame, pages: DataFrame) -> DataFrame:
    """status, n over the readings of pages that are not covered; a page without any counts once as never_attempted."""
    open_pages = by_label(labels, pages).where(~F.coalesce("resolved", F.lit(False)))
    never = F.create_map(F.lit("never_attempted"), F.lit(1).cast("long"))
    each = open_pages.select(F.explode(F.coalesce("statuses", never)).alias("status", "n"))
    return each.groupBy("status").agg(F.sum("n").alias("n"))


def clean_alerts(labels: DataFrame, pages: DataFrame) -> DataFrame:
    """Findings on pages labelled clean, over all of these, read or not."""
    n = F.coalesce(F.size("findings"), F.lit(0))
    every = by_label(labels.where("truth = 'clean'"), pages).withColumn("n", F.when(F.col("findings").isNull(), 0).otherwise(n))
    return every.agg(
        F.count(F.lit(1)).alias("clean_pages"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("alerts"),
        F.count_if(F.col("n") > 0).alias("pages_with_alerts"),
        F.count_if(F.col("readings").isNotNull()).alias("pages_read"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_per_page"),
        F.try_divide(F.sum("n").cast("double"), F.count(F.lit(1))).alias("per_page"),
    )


def occurrence_preservation(labels: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages with an expected count whose least observed count is that. Silence is a loss, expected zero or not."""
    declared = by_label(labels.where("expected_occurrences >= 0"), pages)
    kept = F.coalesce(F.col("min_count") == F.col("expected_occurrences"), F.lit(False))
    return declared.agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(kept).alias("preserved"),
        F.try_divide(F.count_if(kept).cast("double"), F.count(F.lit(1))).alias("fraction"),
    )


def check_accounting(planned: DataFrame, attempts: DataFrame) -> DataFrame:
    """Distinct planned checks that came to an end, that were never tried, that were left open; and all attempts."""
    done = attempts.groupBy("check_id").agg(
        F.bool_or(F.col("status").isin(*TERMINAL)).alias("terminal"), F.count(F.lit(1)).alias("attempts")
    )
    every = planned.select("check_id").distinct().join(done, "check_id", "left")
    one = every.agg(
        F.count(F.lit(1)).alias("planned"),
        F.count_if(F.coalesce("terminal", F.lit(False))).alias("terminal"),
        F.count_if(F.col("terminal").isNull()).alias("missing"),
        F.count_if(~F.col("terminal")).alias("nonterminal"),
    )
    tries = done.agg(F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"))  # also those nobody planned
    return one.crossJoin(tries).withColumn("fraction", F.try_divide(F.col("terminal").cast("double"), F.col("planned")))


def label_gaps(labels: DataFrame, corpus: DataFrame) -> DataFrame:
    """page_key, side: labels for no page of the corpus, and pages without a label."""
    orphan = labels.select("page_key").join(corpus.select("page_key"), "page_key", "left_anti").withColumn("side", F.lit("label_only"))
    bare = corpus.select("page_key").distinct().join(labels.select("page_key"), "page_key", "left_anti").withColumn("side", F.lit("corpus_only"))
    return orphan.unionByName(bare)


def alignment_error(errors: DataFrame) -> DataFrame:
    """errors: page_key, error. The greatest of each page first, then over pages: n, p95 by rank, and the greatest."""
    pages = errors.groupBy("page_key").agg(F.max("error").alias("error")).where("error IS NOT NULL")
    whole = pages.agg(F.count(F.lit(1)).alias("n"), F.max("error").alias("worst"))
    return whole.join(quantiles(pages, [], "error", {"p95": (0.95, "rank")}).drop("n"), F.lit(True), "left")  # one row each


def repeatability(readings: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys whose readings all have one digest."""
    each = readings.groupBy(key).agg((F.count_distinct(digest) == 1).alias("same"))
    return each.agg(F.count(F.lit(1)).alias("keys"), F.count_if("same").alias("same"), F.try_divide(F.count_if("same").cast("double"), F.count(F.lit(1))).alias("share"))


def latency(rows: DataFrame, value: str, *by: str, least: int = 30) -> DataFrame:
    """n, p50, p95 (between neighbours), mean, greatest; p95 may be claimed from `least` values on."""
    v = F.col(value)
    sums = rows.groupBy(*by).agg(F.count(v).alias("n"), F.max(v).alias("max"), F.avg(v).alias("mean"), (F.count(v) >= least).alias("claimable"))
    found = quantiles(rows, list(by), value, {"p50": (0.5, "linear"), "p95": (0.95, "linear")}).drop("n")
    if not by:
        return sums.join(found, F.lit(True), "left")  # one row each
    named = found.withColumnsRenamed({c: f"_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return sums.join(named, same, "left").drop(*[f"_{c}" for c in by])


def verdicts(metrics: DataFrame, targets: DataFrame) -> DataFrame:
    """metrics: metric, value, samples. targets: target, metric, comparator, threshold, min_samples. A target that
    nothing measured, or too little, is UNMET, whatever it asks for."""
    v, t = F.col("value"), F.col("threshold")
    holds = F.when(F.col("comparator") == ">=", v >= t).when(F.col("comparator") == "<=", v <= t).when(F.col("comparator") == ">", v > t).when(F.col("comparator") == "<", v < t)
    enough = F.col("samples") >= F.coalesce("min_samples", F.lit(0))
    every = targets.join(metrics, "metric", "left")
    met = F.coalesce(v.isNotNull() & enough & holds, F.lit(False))
    reason = F.when(v.isNull(), "not measured").when(~F.coalesce(enough, F.lit(False)), "too few samples").when(~met, "threshold")
    return every.select("target", "metric", "value", "samples", F.when(met, "MET").otherwise("UNMET").alias("verdict"), reason.alias("reason"))


def adjudicate(items: DataFrame, votes: DataFrame, reviewers: int = 2) -> DataFrame:
    """items: item_id. votes: item_id, reviewer, useful. outcome: useful or not if `reviewers` or more agree, disagreed
    if they do not, incomplete with fewer. A reviewer's repeated equal vote counts once."""
    each = votes.select("item_id", "reviewer", "useful").distinct().groupBy("item_id").agg(
        F.count_distinct("reviewer").alias("reviewers"), F.count_distinct("useful").alias("kinds"), F.bool_and("useful").alias("useful")
    )
    every = items.select("item_id").distinct().join(each, "item_id", "left")
    seen = F.coalesce("reviewers", F.lit(0))
    outcome = F.when(seen < reviewers, "incomplete").when(F.col("kinds") > 1, "disagreed").when(F.col("useful"), "useful").otherwise("not_useful")
    return every.select("item_id", seen.cast("long").alias("reviewers"), outcome.alias("outcome"))


def diagnosis(sessions: DataFrame) -> DataFrame:
    """sessions: tester, condition (tool or control), seconds, understood. Per tester whether all was understood, and the
    ratio of median times; then the median over testers."""
    median = {"seconds": (0.5, "linear")}
    times = quantiles(sessions.select("tester", "condition", "seconds"), ["tester", "condition"], "seconds", median)
    own = lambda c: F.max(F.when(F.col("condition") == c, F.col("seconds")))
    ratios = times.groupBy("tester").agg(F.try_divide(own("tool"), own("control")).alias("ratio")).where("ratio IS NOT NULL")
    each = sessions.groupBy("tester").agg(F.bool_and("understood").alias("all_understood"))
    whole = each.agg(F.count(F.lit(1)).alias("testers"), F.count_if("all_understood").alias("all_understood"))
    middle = quantiles(ratios, [], "ratio", {"median_ratio": (0.5, "linear")}).drop("n")
    return whole.join(middle, F.lit(True), "left")  # one row each


def explain_statuses(checks: DataFrame, *by: str) -> DataFrame:
    """Checks by the seven things that can have come of them."""
    s = F.col("status")
    kinds = ("completed", "failed", "timeout", "cancelled", "skipped", "unsupported")
    own = F.when(s.isin(*kinds), s).otherwise("not_attempted")
    return checks.withColumn("category", own).groupBy(*by).pivot("category", [*kinds, "not_attempted"]).count().na.fill(0)


def run_status(checks: DataFrame, run: str) -> DataFrame:
    """complete if all checks are completed, failed if none is and one failed or timed out, else partial."""
    n, done = F.count(F.lit(1)), F.count_if(F.col("status") == "completed")
    bad = F.count_if(F.col("status").isin("failed", "timeout"))
    status = F.when(done == n, "complete").when((done == 0) & (bad > 0), "failed").otherwise("partial")
    return checks.groupBy(run).agg(status.alias("status"), done.alias("completed"), n.alias("checks"))


def execution_status(checks: DataFrame, run: str) -> DataFrame:
    """The stricter rule for whole documents: complete, failed only if every check failed or timed out, else partial."""
    n, done = F.count(F.lit(1)), F.count_if(F.col("status") == "completed")
    bad = F.count_if(F.col("status").isin("failed", "timeout"))
    return checks.groupBy(run).agg(F.when(done == n, "complete").when(bad == n, "failed").otherwise("partial").alias("status"))


def confusion(rows: DataFrame) -> DataFrame:
    """rows: truth, decided (both boolean, decided null for no decision): the four counts, precision, share decided."""
    t, d = F.col("truth"), F.col("decided")
    out = rows.agg(
        F.count_if(d & t).alias("tp"), F.count_if(d & ~t).alias("fp"), F.count_if(~d & ~t).alias("tn"), F.count_if(~d & t).alias("fn"), F.count_if(d.isNotNull()).alias("decided"), F.count(F.lit(1)).alias("n")
    )
    return out.withColumns({"precision": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), "decision_coverage": F.try_divide(F.col("decided").cast("double"), F.col("n"))})


def ordinal_rank(rows: DataFrame, by: list[str], ordinal: str, tie: str) -> DataFrame:
    """rows with rank01: place by ordinal from 0 to 1 within a group, 0 for a group of one."""
    line = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(line)
    place = F.row_number().over(line.orderBy(ordinal, tie)) - 1
    return rows.withColumn("rank01", F.when(n > 1, place / (n - 1)).otherwise(0.0))


def line_runs(rows: DataFrame, by: list[str], start: str, end: str, tolerance: Column, tie: str) -> DataFrame:
    """rows with run: how many breaks wider than the tolerance lie before, going by start. A break is measured from
    the furthest end so far."""
    line = Window.partitionBy(*by).orderBy(start, tie)
    furthest = F.max(end).over(line.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col(start) - furthest > tolerance).cast("int"), F.lit(0))
    return rows.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(line)).drop("_fresh")


def spans(rows: DataFrame, by: list[str], ordinal: str, text: str, most: int = 4) -> DataFrame:
    """Every run of one to `most` neighbours in a group: by, first (ordinal), length, text put together."""
    line = Window.partitionBy(*by).orderBy(ordinal)
    ahead = F.collect_list(F.coalesce(text, F.lit(""))).over(line.rowsBetween(0, most - 1))
    each = rows.withColumn("_ahead", ahead).withColumn("length", F.explode(F.sequence(F.lit(1), F.size("_ahead"))))
    return each.select(*by, F.col(ordinal).alias("first"), "length", F.array_join(F.slice("_ahead", F.lit(1), F.col("length")), "").alias("text"))


def order_inversions(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs: by, left_ordinal, right_ordinal. Pairs of pairs whose order the right side turns, by group; groups without
    one have no row.

    Groups are pages. Rows come by group and left ordinal, and a sorted list of the right ones before tells how many are
    larger, so a page of n pairs takes n steps and two lists of n numbers."""
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema if f.name in by]
    rows = pairs.where("left_ordinal IS NOT NULL AND right_ordinal IS NOT NULL").select(*[f.name for f in pairs.schema if f.name in by], "left_ordinal", "right_ordinal")
    names = rows.columns[:-2]

    def run(batches):
        key, n, before, now, last = None, 0, [], [], None
        out = []
        for batch in batches:
            for *own, left, right in zip(*[batch.column(c).to_pylist() for c in batch.schema.names], strict=True):
                if own != key:
                    if n:
                        out.append((*key, n))
                    key, n, before, now, last = own, 0, [], [], None
                if left != last:  # of one left ordinal none is before another
                    for r in now:
                        insort(before, r)
                    now, last = [], left
                n += len(before) - bisect_right(before, right)
                now.append(right)
        if n:
            out.append((*key, n))
        if out:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=[*names, "inversions"]), preserve_index=False)

    return rows.repartition(*names).sortWithinPartitions(*names, "left_ordinal").mapInArrow(run, ", ".join([*kinds, "inversions long"]))


def first_wins(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    line = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(line)).where("_n = 1").drop("_n")
