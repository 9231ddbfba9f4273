"""Evaluation and coverage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.statistics import bootstrap, quantiles
from lectern.operators import coverage as C
from lectern.plans import adapters as A
from lectern.plans import sql as S
from lectern.plans.registry import query

_LOW, _HIGH = S.wilson("covered", "total")
_COVERAGE = f"""
, tally AS (
  SELECT {{by}} count(*) AS total, count(*) FILTER (WHERE coalesce(resolved, false)) AS covered,
    count(*) FILTER (WHERE readings IS NULL) AS never_attempted
  FROM labels_v LEFT JOIN pages_v USING (page_key) {{group}})
SELECT {{by}} total, covered, never_attempted, round(covered::DOUBLE / total, 6) AS rate,
  round({_LOW}, 6) AS wilson_low, round({_HIGH}, 6) AS wilson_high FROM tally"""


def _coverage_sql(by: str = "") -> str:
    return S.with_(S.LABELS, S.READINGS, select="").rstrip() + _COVERAGE.format(by=f"{by}," if by else "", group=f"GROUP BY {by}" if by else "")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.collapse_readings(A.readings(spark, sf_dir))


@query(_coverage_sql("truth"))
def coverage_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.coverage(A.labels(spark, sf_dir), _pages(spark, sf_dir), "truth")
    return _rounded(out, "rate", "wilson_low", "wilson_high")


@query(_coverage_sql())
def full_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.coverage(A.labels(spark, sf_dir), _pages(spark, sf_dir))
    return _rounded(out, "rate", "wilson_low", "wilson_high")


@query(
    S.with_(
        S.LABELS,
        S.READINGS,
        select="""SELECT page_key, readings, resolved, n_findings, min_count, round(max_error, 6) AS max_error FROM pages_v""",
    )
)
def collapse_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return pages.select("page_key", "readings", "resolved", F.size("findings").cast("long").alias("n_findings"), "min_count", F.round("max_error", 6).alias("max_error"))


@query(
    S.with_(
        S.LABELS,
        S.READINGS,
        """open_pages AS (SELECT page_key, readings FROM labels_v LEFT JOIN pages_v USING (page_key)
           WHERE truth = 'supported_failure' AND NOT coalesce(resolved, false))""",
        select="""SELECT status, CAST(count(*) AS BIGINT) AS n FROM (
          SELECT r.status FROM open_pages p JOIN readings r USING (page_key)
          UNION ALL SELECT 'never_attempted' FROM open_pages WHERE readings IS NULL) GROUP BY status""",
    )
)
def uncovered_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.uncovered_statuses(A.labels(spark, sf_dir).where("truth = 'supported_failure'"), _pages(spark, sf_dir))


@query(
    S.with_(
        S.LABELS,
        S.READINGS,
        select="""SELECT count(*) AS clean_pages, CAST(coalesce(sum(n_findings), 0) AS BIGINT) AS alerts,
          count(*) FILTER (WHERE n_findings > 0) AS pages_with_alerts, count(*) FILTER (WHERE readings IS NOT NULL) AS pages_read,
          coalesce(max(n_findings), 0) AS max_per_page, round(sum(coalesce(n_findings, 0))::DOUBLE / count(*), 6) AS per_page
        FROM labels_v LEFT JOIN pages_v USING (page_key) WHERE truth = 'clean'""",
    )
)
def clean_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.clean_alerts(A.labels(spark, sf_dir), _pages(spark, sf_dir))
    return out.withColumns({c: F.col(c).cast("long") for c in ("alerts", "max_per_page")} | {"per_page": F.round("per_page", 6)})


@query(
    S.with_(
        S.LABELS,
        S.READINGS,
        select="""SELECT count(*) AS pages, count(*) FILTER (WHERE coalesce(min_count = expected_occurrences, false)) AS preserved,
          round(count(*) FILTER (WHERE coalesce(min_count = expected_occurrences, false))::DOUBLE / count(*), 6) AS fraction
        FROM labels_v LEFT JOIN pages_v USING (page_key) WHERE expected_occurrences >= 0""",
    )
)
def occurrence_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(C.occurrence_preservation(A.labels(spark, sf_dir), _pages(spark, sf_dir)), "fraction")


@query(
    S.with_(
        S.CHECKS,
        """planned AS (SELECT DISTINCT check_id FROM checks)""",
        """tried AS (SELECT check_id, bool_or(status IN ('completed', 'failed')) AS terminal, count(*) AS attempts FROM checks
           WHERE run % 9 <> 4 GROUP BY check_id)""",
        select="""SELECT (SELECT count(*) FROM planned) AS planned,
          (SELECT count(*) FROM planned JOIN tried USING (check_id) WHERE terminal) AS terminal,
          (SELECT count(*) FROM planned WHERE check_id NOT IN (SELECT check_id FROM tried)) AS missing,
          (SELECT count(*) FROM planned JOIN tried USING (check_id) WHERE NOT terminal) AS nonterminal,
          (SELECT CAST(sum(attempts) AS BIGINT) FROM tried) AS attempts,
          round((SELECT count(*) FROM planned JOIN tried USING (check_id) WHERE terminal)::DOUBLE / (SELECT count(*) FROM planned), 6) AS fraction""",
    )
)
def check_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = A.checks(spark, sf_dir)
    tried = planned.where("run % 9 != 4").withColumn("status", F.when(F.col("status") == "timeout", "running").otherwise(F.col("status")))
    return _rounded(C.check_accounting(planned, tried), "fraction")


@query(
    """SELECT concat(CAST(doc_id AS VARCHAR), ':0') AS page_key, 'label_only' AS side FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT concat(CAST(doc_id AS VARCHAR), ':0'), 'corpus_only' FROM (SELECT DISTINCT doc_id FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
)
def label_cover_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = A.table(spark, sf_dir, "documents").select(A.page_key("doc_id").alias("page_key"))
    return C.label_gaps(A.labels(spark, sf_dir), corpus)


@query("SELECT DISTINCT concat(CAST(doc_id AS VARCHAR), ':0') AS page_key FROM documents")
def page_keys_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "documents").select(C.page_key(F.col("doc_id").cast("string"), F.lit(0)).alias("page_key")).distinct()


@query(
    S.with_(
        S.READINGS,
        select="""SELECT count(*) AS n, round(quantile_disc(max_error, 0.95), 6) AS p95, round(max(max_error), 6) AS worst FROM pages_v""",
    )
)
def alignment_error_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = A.readings(spark, sf_dir).select("page_key", F.explode("errors").alias("error"))
    return _rounded(C.alignment_error(errors), "p95", "worst")


@query("SELECT event_type, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.5) AS p50 FROM events GROUP BY event_type")
def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles(A.table(spark, sf_dir, "events"), ["event_type"], "value", {"p95": (0.95, "rank"), "p50": (0.5, "rank")}).drop("n")


@query("SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY l_returnflag")
def linear_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return quantiles(rows, ["flag"], "l_extendedprice", {"p95": (0.95, "linear")}).select("flag", F.round("p95", 4).alias("p95"))


@query(
    """SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
    max(value) AS max, round(avg(value), 6) AS mean, count(value) >= 30 AS claimable FROM events GROUP BY event_type"""
)
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(C.latency(A.table(spark, sf_dir, "events"), "value", "event_type"), "p50", "p95", "mean")


@query(
    """SELECT count(*) AS keys, count(*) FILTER (WHERE same) AS same, round(count(*) FILTER (WHERE same)::DOUBLE / count(*), 6) AS share
    FROM (SELECT conv_id, count(DISTINCT role) = 1 AS same FROM conversations GROUP BY conv_id)"""
)
def repeatability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(C.repeatability(A.table(spark, sf_dir, "conversations"), "conv_id", "role"), "share")


_TARGETS = [
    ("t_errors", "error_share", "<=", 0.25, 100), ("t_value", "mean_value", ">=", 1e6, 10), ("t_few", "mean_value", ">=", 0.0, 10**9), ("t_none", "never_measured", ">=", 0.0, 1), ("t_top", "max_value", ">", 1.0, None),
]


@query(
    """WITH metrics AS (
      SELECT 'error_share' AS metric, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS value, count(*) AS samples FROM events
      UNION ALL SELECT 'mean_value', avg(value), count(*) FROM events UNION ALL SELECT 'max_value', max(value), count(*) FROM events),
    targets(target, metric, comparator, threshold, min_samples) AS (VALUES """
    + ", ".join(f"('{a}', '{b}', '{c}', {d}::DOUBLE, {'NULL' if e is None else e}::BIGINT)" for a, b, c, d, e in _TARGETS)
    + """), joined AS (SELECT t.*, m.value, m.samples, samples >= coalesce(min_samples, 0) AS enough,
      CASE comparator WHEN '>=' THEN value >= threshold WHEN '<=' THEN value <= threshold WHEN '>' THEN value > threshold ELSE value < threshold END AS holds
      FROM targets t LEFT JOIN metrics m USING (metric))
    SELECT target, metric, round(value, 6) AS value, samples, CASE WHEN coalesce(enough AND holds, false) THEN 'MET' ELSE 'UNMET' END AS verdict,
      CASE WHEN value IS NULL THEN 'not measured' WHEN NOT coalesce(enough, false) THEN 'too few samples' WHEN NOT holds THEN 'threshold' END AS reason FROM joined"""
)
def target_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = A.table(spark, sf_dir, "events")
    one = events.agg(F.avg((F.col("event_type") == "error").cast("double")).alias("error_share"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value"), F.count(F.lit(1)).alias("samples"))
    metrics = one.unpivot(["samples"], ["error_share", "mean_value", "max_value"], "metric", "value")
    targets = spark.createDataFrame(_TARGETS, "target string, metric string, comparator string, threshold double, min_samples long")
    return _rounded(C.verdicts(metrics, targets), "value")


@query(
    """WITH votes AS (SELECT event_id % 400 AS item_id, user_id % 3 AS reviewer, event_type IN ('purchase', 'click') AS useful FROM events),
    items AS (SELECT DISTINCT event_id % 500 AS item_id FROM events),
    tally AS (SELECT item_id, count(DISTINCT reviewer) AS reviewers, count(DISTINCT useful) AS kinds, bool_and(useful) AS useful FROM votes GROUP BY item_id)
    SELECT item_id, coalesce(reviewers, 0) AS reviewers, CASE WHEN coalesce(reviewers, 0) < 2 THEN 'incomplete' WHEN kinds > 1 THEN 'disagreed' WHEN useful THEN 'useful' ELSE 'not_useful' END AS outcome
    FROM items LEFT JOIN tally USING (item_id)"""
)
def adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = A.table(spark, sf_dir, "events")
    votes = events.select((F.col("event_id") % 400).alias("item_id"), (F.col("user_id") % 3).alias("reviewer"), F.col("event_type").isin("purchase", "click").alias("useful"))
    return C.adjudicate(events.select((F.col("event_id") % 500).alias("item_id")), votes)


@query(
    """WITH s AS (SELECT user_id AS tester, CASE WHEN event_id % 2 = 0 THEN 'tool' ELSE 'control' END AS condition, value AS seconds, event_type <> 'error' AS understood FROM events),
    each AS (SELECT tester, bool_and(understood) AS ok, median(seconds) FILTER (WHERE condition = 'tool') / nullif(median(seconds) FILTER (WHERE condition = 'control'), 0) AS ratio FROM s GROUP BY tester)
    SELECT count(*) AS testers, count(*) FILTER (WHERE ok) AS all_understood, round(median(ratio), 6) AS median_ratio FROM each"""
)
def median_of_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = A.table(spark, sf_dir, "events")
    sessions = events.select(F.col("user_id").alias("tester"), F.when(F.col("event_id") % 2 == 0, "tool").otherwise("control").alias("condition"), F.col("value").alias("seconds"), (F.col("event_type") != "error").alias("understood"))
    return _rounded(C.diagnosis(sessions), "median_ratio")


@query()
def grouped_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the share of good labels over groups of documents; the draws are Python's, the sums are Spark's.
    There are 50 groups however many documents."""
    groups = A.table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 50).alias("g")).agg(F.sum("quality").alias("s"), F.count(F.lit(1)).alias("n"))
    low, high = bootstrap([(f"{r.g:02d}", float(r.s), r.n) for r in groups.collect()])
    return spark.createDataFrame([(round(low, 6), round(high, 6), 2000)], "low double, high double, resamples int")


@query(
    S.with_(
        S.CHECKS,
        select="""SELECT run % 10 AS part, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
          count(*) FILTER (WHERE status = 'timeout') AS timeout, 0::BIGINT AS cancelled, 0::BIGINT AS skipped, 0::BIGINT AS unsupported, 0::BIGINT AS not_attempted
        FROM checks GROUP BY 1""",
    )
)
def coverage_breakdown_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.explain_statuses(A.checks(spark, sf_dir).withColumn("part", F.col("run") % 10), "part")


_STATUS = """WITH t AS (SELECT run, count(*) AS checks, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status IN ('failed', 'timeout')) AS bad FROM checks GROUP BY run)"""


@query(
    S.with_(S.CHECKS, _STATUS.removeprefix("WITH "), select="""SELECT run, CASE WHEN completed = checks THEN 'complete' WHEN completed = 0 AND bad > 0 THEN 'failed' ELSE 'partial' END AS status, completed, checks FROM t""")
)
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.run_status(A.checks(spark, sf_dir), "run")


@query(S.with_(S.CHECKS, _STATUS.removeprefix("WITH "), select="""SELECT run, CASE WHEN completed = checks THEN 'complete' WHEN bad = checks THEN 'failed' ELSE 'partial' END AS status FROM t"""))
def execution_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.execution_status(A.checks(spark, sf_dir), "run")


@query(
    """WITH r AS (SELECT quality = 0 AS truth, CASE WHEN doc_id % 6 <> 0 THEN toxic = 1 OR doc_id % 5 = 0 END AS decided FROM labels),
    t AS (SELECT count(*) FILTER (WHERE decided AND truth) AS tp, count(*) FILTER (WHERE decided AND NOT truth) AS fp, count(*) FILTER (WHERE NOT decided AND NOT truth) AS tn,
      count(*) FILTER (WHERE NOT decided AND truth) AS fn, count(decided) AS decided, count(*) AS n FROM r)
    SELECT *, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(decided::DOUBLE / n, 6) AS decision_coverage FROM t"""
)
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "labels")
    decided = F.when(F.col("doc_id") % 6 != 0, (F.col("toxic") == 1) | (F.col("doc_id") % 5 == 0))
    return _rounded(C.confusion(rows.select((F.col("quality") == 0).alias("truth"), decided.alias("decided"))), "precision", "decision_coverage")
