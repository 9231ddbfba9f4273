"""The ledger of a run's checks in batch: admission of messages, caps, terminal states, dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.lineage import checkpoint

#: Most occurrences a check and a run may commit, and bytes of text a check may.
PER_CHECK, PER_RUN, TEXT_BYTES = 20_000, 100_000, 8 * 1024 * 1024


def admit(messages: DataFrame, generation: int, run_key: str, jobs: DataFrame | None = None, document: str | None = None) -> DataFrame:
    """messages with `rejection` (null for admitted): stale_generation, stale_document, stale_run, unknown_job,
    terminal_job or sequence, the first that applies. messages: arrival, job_id, generation, run_key, seq, terminal, and
    document_sha256 where `document` is given.

    A job's numbers must exceed all that were admitted before, and nothing follows its terminal message. Both depend
    on what was admitted so far; in order of arrival a message is admitted exactly if it exceeds the numbers of all
    live messages before it, so a running maximum tells.
    """
    stale = F.when(F.col("generation") != generation, "stale_generation")
    if document is not None:
        stale = stale.when(F.col("document_sha256") != document, "stale_document")
    stale = stale.when(F.col("run_key") != run_key, "stale_run")
    rows = messages.withColumn("rejection", stale)
    if jobs is not None:
        known = jobs.select("job_id").distinct().withColumn("_known", F.lit(True))
        rows = rows.join(known, "job_id", "left").withColumn("rejection", F.coalesce("rejection", F.when(F.col("_known").isNull(), "unknown_job"))).drop("_known")
    line = Window.partitionBy("job_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    live = F.col("rejection").isNull()
    before = F.max(F.when(live, F.col("seq"))).over(line)
    rows = rows.withColumn("_fresh", live & (before.isNull() | (F.col("seq") > before)))
    closed = F.coalesce(F.bool_or(F.col("_fresh") & F.col("terminal")).over(line), F.lit(False))
    own = F.when(live & closed, "terminal_job").when(live & ~F.col("_fresh"), "sequence")
    return rows.withColumn("rejection", F.coalesce("rejection", own)).drop("_fresh")


def rejections(admitted: DataFrame) -> DataFrame:
    return admitted.groupBy(F.coalesce("rejection", F.lit("admitted")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def commit_chunks(chunks: DataFrame, per_check: int = PER_CHECK, text_bytes: int = TEXT_BYTES, per_run: int = PER_RUN) -> DataFrame:
    """chunks (check_id, seq, rows, bytes, and run or not) with `committed`: all of a check up to the first that would go
    beyond a cap of the check or, in the order of seq, of the run; what was committed before stays. Without `run` all is
    one check's matter. A chunk that its check's caps refuse takes nothing of the run's."""
    line = Window.partitionBy("check_id").orderBy("seq")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    rows = chunks.withColumn("_over", (F.sum("rows").over(line) > per_check) | (F.sum("bytes").over(line) > text_bytes))
    rows = rows.withColumn("_over", F.bool_or("_over").over(so_far))
    if "run" in chunks.columns:
        whole = Window.partitionBy("run").orderBy("seq", "check_id").rowsBetween(Window.unboundedPreceding, 0)
        taken = F.sum(F.when(~F.col("_over"), F.col("rows")).otherwise(0)).over(whole)
        rows = rows.withColumn("_over", F.col("_over") | (taken > per_run))
        rows = rows.withColumn("_over", F.bool_or("_over").over(so_far))
    return rows.withColumn("committed", ~F.col("_over")).drop("_over")


def first_terminal(events: DataFrame) -> DataFrame:
    """check_id, status, attempts: the first terminal status of a check, and its attempts."""
    line = Window.partitionBy("check_id").orderBy("arrival")
    n = F.count(F.lit(1)).over(Window.partitionBy("check_id"))
    ends = events.where("terminal").withColumns({"_n": F.row_number().over(line), "attempts": n})
    return ends.where("_n = 1").select("check_id", "status", "attempts")


def dependencies(plan: DataFrame) -> DataFrame:
    """check_id, needs: an ocr check needs its page's renders, an alignment its page's texts and ocrs.
    plan: run, check_id, page_index, capability."""
    need = F.when(F.col("capability") == "ocr", F.array(F.lit("render"))).when(F.col("capability") == "alignment", F.array(F.lit("native_text"), F.lit("ocr")))
    a = plan.withColumn("_need", F.explode(need)).select("run", "check_id", "page_index", "_need")
    b = plan.select("run", F.col("check_id").alias("needs"), "page_index", F.col("capability").alias("_need"))
    return a.join(b, ["run", "page_index", "_need"]).select("run", "check_id", "needs")


def propagate_skips(states: DataFrame, needs: DataFrame) -> DataFrame:
    """states (run, check_id, status; queued ones have none) after every queued check with a failed need is skipped, and
    what needs it in turn, however deep. A round goes on from the checks that the one before has skipped, so each need
    is followed once; needs in a circle end it as others do."""
    queued = checkpoint(states.where("status IS NULL").select("run", "check_id"))
    waiting = checkpoint(needs.join(queued, ["run", "check_id"], "left_semi").select("run", "check_id", "needs"))
    bad = states.where("status IS NOT NULL AND status != 'completed'").select("run", "check_id")
    skipped = None
    while True:
        hit = waiting.join(bad.withColumnRenamed("check_id", "needs"), ["run", "needs"]).select("run", "check_id").distinct()
        if skipped is not None:
            hit = hit.join(skipped, ["run", "check_id"], "left_anti")
        bad = checkpoint(hit)
        if bad.isEmpty():
            break
        skipped = bad if skipped is None else skipped.unionByName(bad)
    if skipped is None:
        return states
    marked = states.join(skipped.withColumn("_skip", F.lit(True)), ["run", "check_id"], "left")
    return marked.withColumn("status", F.coalesce("status", F.when(F.col("_skip"), "skipped"))).drop("_skip")


def circular(needs: DataFrame) -> DataFrame:
    """run, check_id of the checks that need themselves by way of others, or that only such checks wait on and need. A
    plan with any is refused. Rounds leave out what needs nothing that is left, and what nothing left needs."""
    left = checkpoint(needs.select("run", "check_id", "needs").distinct())
    n = left.count()
    while n:
        sources = left.select("run", F.col("check_id").alias("needs")).distinct()
        wanted = left.select("run", F.col("needs").alias("check_id")).distinct()
        left = checkpoint(left.join(sources, ["run", "needs"], "left_semi").join(wanted, ["run", "check_id"], "left_semi"))
        n, before = left.count(), n
        if n == before:
            break
    return left.select("run", "check_id").distinct()


def runnable(states: DataFrame, needs: DataFrame) -> DataFrame:
    """Queued checks all of whose needs are completed."""
    done = states.where("status = 'completed'").select("run", F.col("check_id").alias("needs"))
    waiting = needs.join(done, ["run", "needs"], "left_anti").select("run", "check_id")
    return states.where("status IS NULL").select("run", "check_id").join(waiting, ["run", "check_id"], "left_anti")
