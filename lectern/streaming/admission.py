"""Admission of workers' messages as a stream.

A run's generation and key are settled from each message alone; what depends on a job's past (numbers, its end, chunks
that wait for an answer, caps, retries, deadlines) is kept as state by job. A late message is one that falls behind in
its job's numbers or comes after its end: no clock and no watermark decides that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Rows in a chunk, chunks without an answer, rows a job may commit, bytes of text, tries of one job.
CHUNK_ROWS, UNACKED, PER_CHECK, TEXT_BYTES, TRIES = 256, 2, 20_000, 8 * 1024 * 1024, 2
#: Failures that a second try may mend.
TRANSIENT = ("worker_crash", "init_crash")
STATE = "last_seq long, closed boolean, unacked int, rows long, bytes long, tries int"
OUT = "job_id string, arrival long, seq long, event string, verdict string, job_state string, tries int"


def step(state: tuple, message: dict) -> tuple[tuple, str, str]:
    """(state, verdict, job_state) after a message. Verdicts: admitted, retry, or why it is refused; a refused message
    changes nothing, but one that breaks a bound ends its job as resource_limit and keeps what was committed."""
    last, closed, unacked, rows, size, tries = state
    if closed:
        return state, "terminal_job", "terminal"
    if message["seq"] <= last:
        return state, "sequence", "running"
    last = message["seq"]
    event = message["event"]
    if event == "chunk":
        n, b = message["rows"], message["bytes"]
        if n > CHUNK_ROWS or unacked >= UNACKED or rows + n > PER_CHECK or size + b > TEXT_BYTES:
            return (last, True, unacked, rows, size, tries), "resource_limit", "terminal"
        return (last, False, unacked + 1, rows + n, size + b, tries), "admitted", "running"
    if event == "ack":
        return (last, False, max(0, unacked - 1), rows, size, tries), "admitted", "running"
    if event == "failed":
        if message["reason"] in TRANSIENT and tries + 1 < TRIES:
            return (-1, False, 0, 0, 0, tries + 1), "retry", "running"
        return (last, True, unacked, rows, size, tries), "admitted", "terminal"
    if event in ("completed", "cancelled", "terminal"):
        return (last, True, unacked, rows, size, tries), "admitted", "terminal"
    return (last, False, unacked, rows, size, tries), "admitted", "running"


START = (-1, False, 0, 0, 0, 0)


def admit(messages: DataFrame, generation: int, run_key: str, document: str | None = None, deadline_ms: int | None = None) -> DataFrame:
    """A verdict for every message of a stream (arrival, job_id, generation, run_key, document_sha256, seq, event, rows,
    bytes, reason), and one of its own, deadline, for a job that is silent for deadline_ms."""
    stale = F.when(F.col("generation") != generation, "stale_generation")
    if document is not None:
        stale = stale.when(F.col("document_sha256") != document, "stale_document")
    stale = stale.when(F.col("run_key") != run_key, "stale_run")
    rows = messages.withColumn("stale", stale).select("job_id", "arrival", "seq", "event", "rows", "bytes", "reason", "stale")

    def job(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else START
        if state.hasTimedOut:
            now = (now[0], True, *now[2:])
            state.update(now)
            yield pd.DataFrame([(key[0], None, None, "deadline", "deadline", "terminal", now[5])], columns=[c.split()[0] for c in OUT.split(", ")])
            return
        out = []
        every = pd.concat(list(batches)).sort_values("arrival", kind="stable")
        for m in every.to_dict("records"):
            if m["stale"] is not None and m["stale"] == m["stale"]:
                verdict, name = m["stale"], "terminal" if now[1] else "running"
            else:
                now, verdict, name = step(now, m)
            out.append((key[0], m["arrival"], m["seq"], m["event"], verdict, name, now[5]))
        state.update(now)
        if deadline_ms and not now[1]:
            state.setTimeoutDuration(deadline_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if deadline_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("job_id").applyInPandasWithState(job, OUT, STATE, "append", timeout)


def rejection_counts(verdicts: DataFrame) -> DataFrame:
    """verdict, n: to be written in update mode."""
    return verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


#: States of a run, and what leads from one to another.
TRANSITIONS = {
    ("idle", "start"): "planning", ("planning", "planned"): "running", ("planning", "failed"): "failed", ("running", "cancel"): "cancelling",
    ("running", "settled"): "finalizing", ("running", "run_deadline"): "finalizing", ("cancelling", "settled"): "cancelled", ("finalizing", "complete"): "complete",
    ("finalizing", "partial"): "partial", ("finalizing", "failed"): "failed", ("running", "clear"): "cleared", ("cancelling", "clear"): "cleared",
    ("complete", "clear"): "cleared", ("partial", "clear"): "cleared", ("failed", "clear"): "cleared", ("cancelled", "clear"): "cleared",
}


def run_states(events: DataFrame) -> DataFrame:
    """run_key, arrival, event, state, generation, legal of a stream of events (run_key, arrival, event). Cancelling and
    clearing raise the generation before anything else, so that whatever is on its way is stale."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, generation = state.get if state.exists else ("idle", 0)
        out = []
        for e in pd.concat(list(batches)).sort_values("arrival", kind="stable").to_dict("records"):
            after = TRANSITIONS.get((name, e["event"]))
            if after and e["event"] in ("start", "cancel", "clear"):
                generation += 1
            name = after or name
            out.append((key[0], e["arrival"], e["event"], name, generation, after is not None))
        state.update((name, generation))
        yield pd.DataFrame(out, columns=["run_key", "arrival", "event", "state", "generation", "legal"])

    return events.groupBy("run_key").applyInPandasWithState(
        run, "run_key string, arrival long, event string, state string, generation int, legal boolean", "state string, generation int", "append", GroupStateTimeout.NoTimeout
    )
