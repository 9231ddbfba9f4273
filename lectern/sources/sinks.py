"""Writing: files in one step, journals, reports, baselines."""

from __future__ import annotations

import hashlib
import html
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame

MOST_REPORT = 64 * 1024 * 1024


class SinkError(ValueError):
    def __init__(self, code: str, what: str) -> None:
        super().__init__(what)
        self.code = code


def atomic_write(path: str | Path, data: bytes) -> None:
    """The whole file or none of it, also after a power cut."""
    path = Path(path)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise
    folder = os.open(path.parent, os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)


class Journal:
    """An append-only file of JSON lines whose numbers go on where they ended; a torn last line is cut off."""

    def __init__(self, path: str | Path) -> None:
        self.path = Path(path)
        self.seq = 0
        if self.path.exists():
            raw = self.path.read_bytes()
            whole = raw[: raw.rfind(b"\n") + 1]
            if len(whole) < len(raw):
                with self.path.open("r+b") as f:
                    f.truncate(len(whole))
            for line in whole.splitlines():
                self.seq = json.loads(line)["seq"] + 1

    def record(self, event: str, **fields) -> int:
        line = json.dumps({"seq": self.seq, "event": event, **fields}, ensure_ascii=False) + "\n"
        with self.path.open("ab") as f:
            f.write(line.encode())
            f.flush()
            os.fsync(f.fileno())
        self.seq += 1
        return self.seq - 1


def report_json(report: dict) -> bytes:
    """Members in the order given, two spaces, a line end at the end: equal reports are equal bytes."""
    return (json.dumps(report, indent=2, ensure_ascii=False, allow_nan=False) + "\n").encode()


def write_report(path: str | Path, report: dict) -> None:
    data = report_json(report)
    if len(data) > MOST_REPORT:
        raise SinkError("SIZE", "report too large")
    atomic_write(path, data)


def report_html(report: dict) -> str:
    """A page without scripts or outside links: readings, findings, coverage."""
    e = lambda x: html.escape("" if x is None else str(x))
    row = lambda *cells: "<tr>" + "".join(f"<td>{e(c)}</td>" for c in cells) + "</tr>"
    part = lambda title, head, rows: f"<h2>{title}</h2><table><tr>{''.join(f'<th>{e(h)}</th>' for h in head)}</tr>{''.join(rows)}</table>"
    style = "table{border-collapse:collapse}td,th{border:1px solid #999;padding:2px 6px;text-align:left}"
    mark = hashlib.sha256(style.encode()).digest()
    import base64

    policy = f"default-src 'none'; style-src 'sha256-{base64.b64encode(mark).decode()}'"
    body = [
        part("Readings", ("reader", "page", "ordinal", "text"), [row(o["reader_id"], o["page_index"] + 1, o["ordinal"], o["raw_text"]) for o in report["occurrences"]]),
        part("Findings", ("kind", "page", "alignment", "priority"), [row(f["kind"], f["page_index"] + 1, f["alignment"], f["priority"]) for f in report["findings"]]),
        part("Coverage", ("check", "status", "reason"), [row(c["id"], c["status"], c["reason"]) for c in report["checks"]]),
        part("Notes", ("page", "text"), [row(a["page_index"] + 1, a["text"]) for a in report.get("annotations", ())]),
    ]
    out = (
        f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{e(policy)}"><title>Report {e(report["report_id"][:12])}</title>'
        f"<style>{style}</style></head><body><h1>Document {e(report['document']['sha256'])}</h1>{''.join(body)}</body></html>"
    )
    assert_script_free(out)
    return out


def assert_script_free(page: str) -> None:
    """Refuses scripts, event handlers, outside links and embedded documents."""
    import re

    bad = re.search(r"(?i)<\s*(script|iframe|object|embed|link|base|form)\b|<[^>]*\son\w+\s*=|<[^>]*\b(?:src|href|action)\s*=\s*[\"']?\s*(?!data:image/png|#)", page)
    if bad:
        raise SinkError("HTML", f"refused markup: {bad[0][:40]}")


def write_comparison(keys: DataFrame, folder: str) -> None:
    """One folder of JSON for each key. keys: key, status, ..."""
    keys.write.mode("errorifexists").partitionBy("key").json(folder)


def portable_key(keys: DataFrame) -> str | None:
    """The key to show first: the first that is regressed, errored or incomparable, else the first."""
    from pyspark.sql import functions as F

    bad = F.col("status").isin("regressed", "errored", "incomparable")
    row = keys.agg(F.min(F.when(bad, F.col("key"))).alias("bad"), F.min("key").alias("any")).first()
    return row["bad"] or row["any"]


def create_baseline(run: DataFrame, folder: str, approval: dict, rules: bytes = b"") -> dict:
    """An immutable copy of a run's reports (key, report_id, text) with who approved it and why; its manifest is written
    last, and an existing baseline is never written over."""
    target = Path(folder)
    if target.exists():
        raise SinkError("EXISTS", "a baseline is there")
    if not approval.get("approved_by") or not approval.get("rationale"):
        raise SinkError("APPROVAL", "who approved it, and why?")
    staged = target.with_name(f".{target.name}.staged")
    run.select("key", "report_id", "text").write.mode("overwrite").parquet(str(staged / "reports"))
    ids = run.select("report_id").distinct().orderBy("report_id")
    manifest = {"approval": approval, "report_ids": [r.report_id for r in ids.toLocalIterator()], "rules_sha256": hashlib.sha256(rules).hexdigest()}
    os.replace(staged, target)
    atomic_write(target / "baseline.json", report_json(manifest))
    return manifest


def load_baseline(spark, folder: str) -> DataFrame:
    """The reports of a baseline, if they are exactly those its manifest names."""
    manifest = json.loads(Path(folder, "baseline.json").read_text())
    reports = spark.read.parquet(f"{folder}/reports")
    named = spark.createDataFrame([(i,) for i in manifest["report_ids"]], "report_id string")
    own = reports.select("report_id").distinct()
    if not own.exceptAll(named).isEmpty() or not named.exceptAll(own).isEmpty():
        raise SinkError("BASELINE", "reports and manifest differ")
    return reports
