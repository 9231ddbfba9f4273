"""Queries over runs: comparison, rules, selection, ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import crops as Y
from lectern.functions import geometry as G
from lectern.operators import compare as R
from lectern.operators import ledger as K
from lectern.operators import lineage as L
from lectern.operators import runs as N
from lectern.operators import selection as E
from lectern.plans import adapters as A
from lectern.plans import sql as S
from lectern.plans.registry import query

_RUNS = """
l AS (SELECT l_orderkey AS key, count(*) AS checks, count(*) FILTER (WHERE l_returnflag <> 'R') AS done, CAST(sum(l_quantity) AS BIGINT) AS content FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey),
r AS (SELECT l_orderkey AS key, count(*) AS checks, count(*) FILTER (WHERE l_returnflag <> 'R') AS done, CAST(sum(l_quantity) AS BIGINT) AS content FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey),
facts AS (SELECT key, l.key IS NOT NULL AS has_left, r.key IS NOT NULL AS has_right, coalesce(l.content % 10 = r.content % 10 OR key % 3 <> 0, true) AS same_document,
  coalesce(key % 7 <> 0, true) AS same_readers, CASE WHEN key % 5 = 0 AND r.checks > 3 THEN 1 ELSE 0 END AS violations, coalesce(r.done < l.done, false) AS coverage_lost,
  coalesce(r.done < r.checks AND key % 2 = 0, false) AS right_failed, CASE WHEN l.content <> r.content THEN 1 ELSE 0 END AS changes FROM l FULL JOIN r USING (key)),
statuses AS (SELECT key, has_left, has_right, CASE WHEN NOT (has_left AND has_right) THEN 'errored' WHEN NOT same_document THEN 'incomparable' WHEN NOT same_readers THEN 'incomparable' WHEN violations > 0 THEN 'regressed'
  WHEN coverage_lost THEN 'regressed' WHEN right_failed THEN 'regressed' WHEN changes > 0 THEN 'changed' ELSE 'unchanged' END AS status FROM facts)"""


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem")
    side = lambda flag: rows.where(F.col("l_linestatus") == flag).groupBy(F.col("l_orderkey").alias("key")).agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(F.col("l_returnflag") != "R").alias("done"), F.sum("l_quantity").cast("long").alias("content")
    )
    both = R.side_by_side(side("F"), side("O"))
    yes = lambda c: F.coalesce(c, F.lit(True))
    no = lambda c: F.coalesce(c, F.lit(False))
    key, lc, rc = F.col("key"), F.col("left_content"), F.col("right_content")
    facts = both.select(
        "key", "has_left", "has_right", F.lit(False).alias("has_rules"), yes((lc % 10 == rc % 10) | (key % 3 != 0)).alias("same_document"), yes(key % 7 != 0).alias("same_readers"),
        F.when((key % 5 == 0) & (F.col("right_checks") > 3), 1).otherwise(0).alias("violations"), no(F.col("right_done") < F.col("left_done")).alias("coverage_lost"),
        no((F.col("right_done") < F.col("right_checks")) & (key % 2 == 0)).alias("right_failed"), F.when(lc != rc, 1).otherwise(0).alias("changes"),
    )
    return R.status(facts)


@query(S.with_(_RUNS, select="SELECT key, has_left, has_right, status FROM statuses"))
def stored_run_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, sf_dir).select("key", "has_left", "has_right", "status")


@query(
    S.with_(
        _RUNS,
        select="""SELECT CAST(CASE WHEN bool_or(status = 'regressed') THEN 5 WHEN bool_or(status = 'incomparable') THEN 6 WHEN bool_or(status = 'errored') THEN 3 ELSE 0 END AS INTEGER) AS exit_code,
          count(*) FILTER (WHERE status = 'errored') AS errored, count(*) FILTER (WHERE status = 'regressed') AS regressed, count(*) FILTER (WHERE status = 'incomparable') AS incomparable,
          count(*) FILTER (WHERE status = 'changed') AS changed, count(*) FILTER (WHERE status = 'unchanged') AS unchanged FROM statuses""",
    )
)
def status_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fold(_statuses(spark, sf_dir))


@query(
    """WITH c AS (SELECT l_orderkey AS key, count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'N') AS cl, count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag = 'N') AS cr,
      count(*) FILTER (WHERE l_linestatus = 'F') AS ol, count(*) FILTER (WHERE l_linestatus = 'O') AS orr FROM lineitem GROUP BY l_orderkey)
    SELECT key, cr < cl OR orr < ol AS coverage_lost FROM c"""
)
def coverage_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.when(F.col("l_linestatus") == "F", "left").otherwise("right").alias("side"), F.when(F.col("l_returnflag") == "N", "completed").otherwise("failed").alias("status"))
    return R.coverage_lost(rows, rows.select("key", "side"))


def _rules(docs: DataFrame) -> DataFrame:
    """Five rules for every document."""
    d, none = F.col("doc_id"), lambda t: F.lit(None).cast(t)

    def rule(name: str, kind: str, text=None, count=None, delta=None) -> F.Column:
        own = F.concat(F.lit(f"{name}_"), d.cast("string")).alias("rule_id")
        told = [none("string") if text is None else F.lit(text), none("int") if count is None else count.cast("int"), none("double") if delta is None else delta]
        return F.struct(own, F.lit(kind).alias("type"), *[c.alias(n) for c, n in zip(told, ("expected_text", "expected_count", "max_delta_pt"), strict=True)])

    five = F.array(
        rule("text", "expected_text", text="the"), rule("stable", "stable_reading"), rule("count", "expected_occurrence_count", count=d % 9),
        rule("cover", "required_coverage"), rule("delta", "max_geometry_delta", delta=0.5 + (d % 2)),
    )
    out = docs.select(d.cast("string").alias("document_sha256"), F.explode(five).alias("r")).select("document_sha256", "r.*")
    return out.withColumns({"page_index": F.lit(0), "reader_id": none("string"), "region_id": none("string"), "capability": none("string")})


@query(
    S.with_(
        S.LINES,
        """docs AS (SELECT doc_id FROM documents)""",
        """a AS (SELECT doc_id, string_agg(raw_text, chr(10) ORDER BY ordinal) AS text, count(*) AS n FROM lines_a GROUP BY doc_id)""",
        """b AS (SELECT doc_id, string_agg(raw_text, chr(10) ORDER BY ordinal) AS text, count(*) AS n FROM lines_b GROUP BY doc_id)""",
        # pairs by place in order: after the first line that B drops, places differ
        """za AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS k, x0, y0, x1, y1 FROM lines_a)""",
        """zb AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS k, x0, y0, x1, y1 FROM lines_b)""",
        """d AS (SELECT doc_id, max(greatest(sqrt((za.x0 - zb.x0) ** 2 + (za.y0 - zb.y0) ** 2), sqrt((za.x1 - zb.x1) ** 2 + (za.y0 - zb.y0) ** 2), sqrt((za.x1 - zb.x1) ** 2 + (za.y1 - zb.y1) ** 2),
          sqrt((za.x0 - zb.x0) ** 2 + (za.y1 - zb.y1) ** 2))) AS delta FROM za JOIN zb USING (doc_id, k) GROUP BY doc_id)""",
        """e AS (SELECT docs.doc_id, coalesce(b.text, '') AS now, coalesce(a.text, '') AS was, coalesce(b.n, 0) AS n, d.delta FROM docs LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN d USING (doc_id))""",
        select="""SELECT concat('text_', doc_id) AS rule_id, 'expected_text' AS type, CASE WHEN contains(now, 'the') THEN 'holds' ELSE 'violated' END AS verdict FROM e
          UNION ALL SELECT concat('stable_', doc_id), 'stable_reading', CASE WHEN now = was THEN 'holds' ELSE 'violated' END FROM e
          UNION ALL SELECT concat('count_', doc_id), 'expected_occurrence_count', CASE WHEN n = doc_id % 9 THEN 'holds' ELSE 'violated' END FROM e
          UNION ALL SELECT concat('cover_', doc_id), 'required_coverage', CASE WHEN doc_id % 4 = 0 THEN 'violated' ELSE 'holds' END FROM e
          UNION ALL SELECT concat('delta_', doc_id), 'max_geometry_delta', CASE WHEN delta IS NULL THEN 'incomparable' WHEN delta > 0.5 + doc_id % 2 THEN 'violated' ELSE 'holds' END FROM e""",
    )
)
def rule_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules for every document, of all five types; reader A's run is the left one, B's the right one."""

    def run(rows: DataFrame, reader: str) -> DataFrame:
        polygon = G.box_polygon(G.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))
        return rows.select(
            F.col("doc_id").cast("string").alias("document_sha256"), F.lit(0).alias("page_index"), F.lit(reader).alias("reader_id"), F.concat(F.lit("o_"), F.col("ordinal").cast("string")).alias("id"),
            F.col("ordinal").alias("seq"), "raw_text", polygon.alias("polygon"), F.lit("exact").alias("precision"),
        )

    docs = A.table(spark, sf_dir, "documents")
    checks = docs.select(
        F.col("doc_id").cast("string").alias("document_sha256"), F.lit(0).alias("page_index"), F.lit("native_text").alias("capability"), F.array(F.lit("b")).alias("reader_ids"), F.lit(None).cast("string").alias("region_id"),
        F.when(F.col("doc_id") % 4 == 0, "failed").otherwise("completed").alias("status"),
    )
    return R.evaluate_rules(_rules(docs), run(A.lines(spark, sf_dir), "a"), run(A.lines_again(spark, sf_dir), "b"), checks)


@query(
    """WITH cited AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0)
    SELECT source, count(*) AS kept, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM cited) GROUP BY source"""
)
def selection_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = A.table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    kept = E.cited(A.table(spark, sf_dir, "documents"), cited, "doc_id")
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("kept"), F.sum("n_chars").alias("chars"))


@query(
    """WITH f AS (SELECT conv_id, list(turn ORDER BY turn) AS ids FROM conversations GROUP BY conv_id), kept AS (SELECT conv_id, turn FROM conversations WHERE length(text) > 40)
    SELECT f.conv_id FROM f WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = f.conv_id AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.conv_id = c.conv_id AND k.turn = c.turn))"""
)
def findings_with_all_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "conversations")
    findings = rows.groupBy("conv_id").agg(F.collect_list("turn").alias("occurrence_ids"))
    kept = rows.where(F.char_length("text") > 40).select("conv_id", F.col("turn").alias("occurrence_id"))
    return E.with_all_evidence(findings, kept, "conv_id").select("conv_id")


_ADMIT = """
s AS (SELECT *, CASE WHEN generation <> 2 THEN 'stale_generation' WHEN run_key <> 'run' THEN 'stale_run' END AS stale FROM messages),
b AS (SELECT *, max(CASE WHEN stale IS NULL THEN seq END) OVER (PARTITION BY job_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
f AS (SELECT *, stale IS NULL AND (before IS NULL OR seq > before) AS fresh FROM b),
c AS (SELECT *, coalesce(bool_or(fresh AND terminal) OVER (PARTITION BY job_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS closed FROM f),
verdicts AS (SELECT arrival, job_id, coalesce(stale, CASE WHEN closed THEN 'terminal_job' WHEN NOT fresh THEN 'sequence' END) AS rejection FROM c)"""


@query(S.with_(S.MESSAGES, _ADMIT, select="SELECT arrival, job_id, rejection FROM verdicts"))
def message_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.admit(A.messages(spark, sf_dir), 2, "run").select("arrival", "job_id", "rejection")


@query(S.with_(S.MESSAGES, _ADMIT, select="SELECT coalesce(rejection, 'admitted') AS code, count(*) AS n FROM verdicts GROUP BY 1"))
def rejection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.rejections(K.admit(A.messages(spark, sf_dir), 2, "run"))


@query(
    """WITH c AS (SELECT user_id AS check_id, event_id AS seq, user_id % 7 + 1 AS rows, CAST(length(props) AS BIGINT) AS bytes FROM events),
    o AS (SELECT *, sum(rows) OVER w > 300 OR sum(bytes) OVER w > 900 AS over FROM c WINDOW w AS (PARTITION BY check_id ORDER BY seq))
    SELECT check_id, seq, NOT bool_or(over) OVER (PARTITION BY check_id ORDER BY seq) AS committed FROM o"""
)
def chunk_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("check_id"), F.col("event_id").alias("seq"), (F.col("user_id") % 7 + 1).alias("rows"), F.char_length("props").cast("long").alias("bytes"))
    return K.commit_chunks(chunks, 300, 900).select("check_id", "seq", "committed")


@query(
    """WITH e AS (SELECT user_id AS check_id, event_id AS arrival, event_type AS status FROM events WHERE event_type IN ('error', 'purchase')),
    n AS (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY arrival) AS k, count(*) OVER (PARTITION BY check_id) AS attempts FROM e) SELECT check_id, status, attempts FROM n WHERE k = 1"""
)
def terminal_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = A.table(spark, sf_dir, "events")
    return K.first_terminal(events.select(F.col("user_id").alias("check_id"), F.col("event_id").alias("arrival"), F.col("event_type").alias("status"), F.col("event_type").isin("error", "purchase").alias("terminal")))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four checks for each order: render, native_text, ocr, alignment; the statuses follow from the order."""
    caps = F.array(*[F.lit(c) for c in ("render", "native_text", "ocr", "alignment")])
    rows = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.explode(caps).alias("capability"))
    k = F.col("run")
    status = F.when((F.col("capability") == "render") & (k % 3 != 2), F.when(k % 3 == 0, "completed").otherwise("failed")).when((F.col("capability") == "native_text") & (k % 4 != 3), F.when(k % 4 == 1, "timeout").otherwise("completed"))
    return rows.select("run", F.concat_ws("_", F.col("run").cast("string"), "capability").alias("check_id"), F.lit(0).alias("page_index"), "capability", status.alias("status"))


_PLAN = """
base AS (SELECT o_orderkey AS run, CASE o_orderkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' END AS render, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 1 THEN 'timeout' ELSE 'completed' END AS native FROM orders),
ocr AS (SELECT *, CASE WHEN render = 'failed' THEN 'skipped' END AS ocr FROM base),
alg AS (SELECT *, CASE WHEN native = 'timeout' OR ocr = 'skipped' THEN 'skipped' END AS alignment FROM ocr)"""


@query(
    S.with_(
        _PLAN,
        select="""SELECT run, concat(run, '_render') AS check_id, render AS status FROM alg UNION ALL SELECT run, concat(run, '_native_text'), native FROM alg
          UNION ALL SELECT run, concat(run, '_ocr'), ocr FROM alg UNION ALL SELECT run, concat(run, '_alignment'), alignment FROM alg""",
    )
)
def dag_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _plan(spark, sf_dir)
    return K.propagate_skips(plan.select("run", "check_id", "status"), K.dependencies(plan))


@query(
    S.with_(
        _PLAN,
        select="""SELECT run, concat(run, '_render') AS check_id FROM alg WHERE render IS NULL UNION ALL SELECT run, concat(run, '_native_text') FROM alg WHERE native IS NULL
          UNION ALL SELECT run, concat(run, '_ocr') FROM alg WHERE render = 'completed'""",
    )
)
def dag_runnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _plan(spark, sf_dir)
    return K.runnable(plan.select("run", "check_id", "status"), K.dependencies(plan))


@query(
    """WITH done AS (SELECT DISTINCT o_custkey AS key, o_orderpriority AS digest FROM orders WHERE o_orderstatus = 'F')
    SELECT c_custkey AS key, c_mktsegment AS segment FROM customer WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.key = c_custkey AND done.digest = '1-URGENT')"""
)
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as jobs under one configuration; finished orders of the same digest are taken over."""
    jobs = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("1-URGENT").alias("config_digest"), F.col("c_mktsegment").alias("segment"))
    done = A.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("config_digest"), F.lit("completed").alias("status"))
    pending, _ = L.incremental(jobs, done)
    return pending.select("key", "segment")


@query(
    """WITH j AS (SELECT user_id AS job, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS attempt, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
      CASE WHEN event_id % 2 = 0 THEN 'worker_crash' ELSE 'encrypted' END AS reason, event_id FROM events)
    SELECT job, attempt + 1 AS attempt FROM (SELECT *, max(attempt) OVER (PARTITION BY job) AS last FROM j) WHERE attempt = last AND status = 'failed' AND reason = 'worker_crash' AND attempt < 9"""
)
def retry_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as jobs, their events as attempts; nine tries at most."""
    line = Window.partitionBy("user_id").orderBy("event_id")
    rows = A.table(spark, sf_dir, "events")
    jobs = rows.select(
        F.col("user_id").alias("job"), F.row_number().over(line).alias("attempt"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
        F.when(F.col("event_id") % 2 == 0, "worker_crash").otherwise("encrypted").alias("reason"),
    )
    return N.next_attempts(jobs, 9)


@query(
    """WITH RECURSIVE t AS (SELECT user_id AS run, event_id AS arrival, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'take' ELSE 'release' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    f AS (SELECT run, arrival, kind, k, CASE WHEN kind = 'take' THEN 1 ELSE 0 END AS in_use, false AS refused FROM t WHERE k = 1
      UNION ALL SELECT t.run, t.arrival, t.kind, t.k, CASE WHEN t.kind = 'take' THEN least(f.in_use + 1, 2) ELSE greatest(f.in_use - 1, 0) END, t.kind = 'take' AND f.in_use >= 2 FROM f JOIN t ON t.run = f.run AND t.k = f.k + 1)
    SELECT run, arrival, kind, in_use, refused FROM f"""
)
def slot_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as runs that take and release two slots."""
    rows = A.table(spark, sf_dir, "events")
    return N.slots(rows.select(F.col("user_id").alias("run"), F.col("event_id").alias("arrival"), F.when(F.col("event_type").isin("click", "view", "signup"), "take").otherwise("release").alias("kind")))


_CROP = "greatest(8, ceil((y1 - y0) * 0.1))"


@query(
    S.with_(
        S.OBJECTS,
        f"""p AS (SELECT *, {_CROP} AS pad FROM (SELECT DISTINCT * FROM objects))""",
        """c AS (SELECT *, greatest(0, floor(x0 - pad)) AS a, greatest(0, floor(y0 - pad)) AS b, least(200, ceil(x1 + pad)) AS c, least(150, ceil(y1 + pad)) AS d,
          floor(x0 - pad) < 0 OR floor(y0 - pad) < 0 OR ceil(x1 + pad) > 200 OR ceil(y1 + pad) > 150 AS clipped FROM p)""",
        select="""SELECT page, idx, CAST(a AS INTEGER) AS cx0, CAST(b AS INTEGER) AS cy0, CAST(c AS INTEGER) AS cx1, CAST(d AS INTEGER) AS cy1, clipped,
          CASE WHEN c - a <= 0 OR d - b <= 0 THEN 'empty' END AS problem FROM c""",
    )
)
def crop_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each object of a page as a region of a raster of 200 by 150 pixels."""
    rows = A.objects(spark, sf_dir).distinct()
    rows = rows.select("page", "idx", G.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("region"), F.lit(200).alias("w"), F.lit(150).alias("h"))
    out = Y.plan_crop(rows, "region", "w", "h")
    return out.select("page", "idx", F.col("x0").alias("cx0"), F.col("y0").alias("cy0"), F.col("x1").alias("cx1"), F.col("y1").alias("cy1"), "clipped", "problem")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 10 = 2 THEN 'status' WHEN doc_id % 10 = 1 AND regexp_matches(text, '[0-9]') THEN 'unfinished' WHEN doc_id % 10 = 5 AND regexp_matches(text, '[0-9]') THEN 'no_findings' WHEN doc_id % 10 = 7 THEN 'count' END AS problem FROM documents"""
)
def reading_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 10
    rows = A.table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("document_sha256"), F.lit(0).alias("page_index"), F.lit("check").alias("check_id"),
        F.when(k == 2, "running").when(k == 1, "failed").otherwise("completed").alias("status"), F.when(F.col("text").rlike("[0-9]") & (k != 2), "useful_finding").alias("resolution"),
        F.when(k != 5, F.array(F.lit("f"))).alias("finding_ids"), F.lit(None).cast("string").alias("comparison_ref"), F.when(k == 7, -1).otherwise(1).alias("occurrence_count"), F.array(F.lit(0.5)).alias("errors"),
    )
    return N.reading_problems(rows).select("doc_id", "problem")


@query(
    """SELECT o_custkey % 40 AS run, min(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS native_text, min(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS ocr, min(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS alignment
    FROM orders GROUP BY 1"""
)
def first_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as checks of 40 runs, in the order of their keys; the status stands for the capability."""
    s = F.col("o_orderstatus")
    rows = A.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 40).alias("run"), F.lit(0).alias("page_index"), F.col("o_orderkey").alias("check_id"), F.when(s == "F", "native_text").when(s == "O", "ocr").when(s == "P", "alignment").alias("capability"), F.col("o_orderkey").alias("seq")
    )
    return N.first_checks(rows).drop("page_index")
