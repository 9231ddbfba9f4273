import hashlib

import pytest
from pyspark.sql import functions as F

from lectern.functions import crops as Y
from lectern.operators import alignment as A
from lectern.operators import runs as R
from lectern.sources import profiles
from lectern.sources.sinks import SinkError


def test_readings_need_evidence(spark):
    kind = "document_sha256 string, page_index int, check_id string, status string, resolution string, finding_ids array<string>, comparison_ref string, occurrence_count int, errors array<double>"
    sha = "a" * 64
    rows = [
        (sha, 0, "c", "completed", "useful_finding", ["f"], None, 1, [0.5]), (sha, 0, "c", "completed", None, None, None, None, None), ("x", 0, "c", "completed", None, None, None, None, None),
        (sha, -1, "c", "completed", None, None, None, None, None), (sha, 0, "!", "completed", None, None, None, None, None), (sha, 0, "c", "running", None, None, None, None, None),
        (sha, 0, "c", "completed", "sure", None, None, None, None), (sha, 0, "c", "failed", "useful_finding", ["f"], None, None, None), (sha, 0, "c", "completed", "useful_finding", [], None, None, None),
        (sha, 0, "c", "completed", "actionable_comparison", None, None, None, None), (sha, 0, "c", "completed", None, None, None, -1, None), (sha, 0, "c", "completed", None, None, None, None, [-1.0]),
    ]
    got = [r.problem for r in R.reading_problems(spark.createDataFrame(rows, kind).coalesce(1)).collect()]
    assert got == [None, None, "document", "page", "check_id", "status", "resolution", "unfinished", "no_findings", "no_comparison", "count", "errors"]


def test_corpus_entries_and_problems(spark):
    fixtures = spark.createDataFrame([("a/My File.pdf", "public", "0" * 64, "F01", "mapping", None), ("b.json", "public", "0" * 64, "F02", "x", None), ("c.pdf", "other", "0" * 64, "F03", "y", "a/My File.pdf")], "path string, split string, sha256 string, fixture_id string, family string, control string")
    entries = R.corpus_entries(fixtures, "public")
    assert [tuple(r) for r in entries.collect()] == [("my-file", "fixtures/a/My File.pdf", "0" * 64, "f01-mapping", [0])]
    assert R.corpus_problems(entries).first().problem is None
    both = R.corpus_problems(entries.unionByName(entries.withColumn("sha256", F.lit("q"))))
    assert {r.problem for r in both.collect()} == {"duplicate_key"}
    nodes = R.lineage_nodes(entries.withColumn("controls", F.array(F.lit("k"))), fixtures)
    assert nodes.count() == 4


def test_changes_between_runs(spark):
    kind = "document string, page_index int, id string, ordinal int, text string, raw_text string, polygon array<array<double>>, precision string"
    square = lambda y: [[0.0, y], [50.0, y], [50.0, y + 10], [0.0, y + 10]]
    row = lambda d, i, o, t, y: (d, 0, i, o, t, t, square(y), "exact")
    left = spark.createDataFrame([row("d", "a", 0, "100", 0.0), row("d", "b", 1, "x", 40.0), row("e", "c", 0, "same", 0.0)], kind)
    right = spark.createDataFrame([row("d", "z", 0, "700", 0.0), row("d", "y", 1, "x", 40.0), row("e", "w", 0, "same", 0.0)], kind)
    checks = spark.createDataFrame([("d", "c1", "completed", "completed"), ("e", "c1", "completed", "failed")], "document string, check_id string, left_status string, right_status string")
    got = {(r.document, r.kind, r.page_index) for r in R.changes(A.align(left, right), left, right, checks, "document").collect()}
    assert got == {("d", "text", 0), ("e", "coverage", None)}


def test_slots_retries_and_ends(spark):
    rows = spark.createDataFrame([("r", i, k) for i, k in enumerate(["take", "take", "take", "release", "take", "release", "release", "release"])], "run string, arrival long, kind string")
    got = R.slots(rows).orderBy("arrival").collect()
    assert [r.in_use for r in got] == [1, 2, 2, 1, 2, 1, 0, 0] and [r.refused for r in got].index(True) == 2
    jobs = spark.createDataFrame([("a", 1, "failed", "worker_crash"), ("b", 1, "failed", "worker_crash"), ("b", 2, "failed", "worker_crash"), ("c", 1, "failed", "encrypted"), ("d", 1, "completed", None)], "job string, attempt int, status string, reason string")
    assert [tuple(r) for r in R.next_attempts(jobs).collect()] == [("a", 2)]
    ends = R.settled(jobs, spark.createDataFrame([("a",), ("z",)], "job string")).orderBy("job").collect()
    assert [tuple(r) for r in ends] == [("a", "failed", "worker_crash"), ("z", "failed", "never_started")]


def test_first_checks_and_readiness(spark):
    plan = spark.createDataFrame([("r", 0, "c2", "ocr", 2), ("r", 0, "c1", "ocr", 1), ("r", 0, "c3", "native_text", 3)], "run string, page_index int, check_id string, capability string, seq int")
    got = R.first_checks(plan).first()
    assert (got.native_text, got.ocr, got.alignment) == ("c3", "c1", None)
    kind = "key string, document_sha256 string, reader_ids array<string>"
    left = spark.createDataFrame([("a", "x", ["1", "2"]), ("b", "x", ["1"]), ("c", "x", ["1"]), ("d", "x", ["1"])], kind)
    right = spark.createDataFrame([("a", "x", ["2", "1"]), ("b", "y", ["1"]), ("c", "x", ["3"]), ("e", "x", ["1"])], kind)
    assert {(r.key, r.ready) for r in R.readiness(left, right).collect()} == {("a", "ready"), ("b", "other_document"), ("c", "other_readers"), ("d", "missing_right"), ("e", "missing_left")}


def test_crops(spark):
    rows = spark.createDataFrame([(1, [10.0, 10.0, 110.0, 30.0]), (2, [0.0, 0.0, 990.0, 790.0]), (3, None), (4, [5.0, 5.0, 5.0, 9.0])], "k int, b array<double>").withColumns({"w": F.lit(1000), "h": F.lit(800)})
    got = {r.k: r for r in Y.plan_crop(rows, "b", "w", "h", max_edge=500).collect()}
    assert (got[1].x0, got[1].y0, got[1].x1, got[1].y1, got[1].clipped, got[1].scale) == (2, 2, 118, 38, False, 1.0)
    assert (got[2].x0, got[2].x1, got[2].y1, got[2].clipped, got[2].scale) == (0, 1000, 800, True, 0.5)
    assert (got[3].x1, got[3].y1, got[3].clipped) == (1000, 800, False) and got[4].problem == "degenerate"
    assert spark.range(1).select(Y.recorded_scale(F.lit(3.0), F.lit(3.0), F.lit(1.0), F.lit(1.0))).first()[0] == [0.333334, 0.333335, 0.333333]
    assert spark.range(1).select(Y.drag_box(*[F.lit(float(v)) for v in (50, 5, -3, 20, 40, 30)])).first()[0] == [0.0, 5.0, 40.0, 20.0]
    assert spark.range(1).select(Y.render_mode(F.lit(3)), Y.render_mode(F.lit(99))).first()[:] == ("invisible", "unknown")


def test_profiles_and_models(spark, tmp_path):
    sha = profiles.save_profile(tmp_path, {"name": "plain", "reader": "text-lines", "version": "1"})
    assert profiles.load_profile(tmp_path, "plain")["sha256"] == sha and profiles.profiles(spark, tmp_path).first().good
    (tmp_path / "plain.json").write_text((tmp_path / "plain.json").read_text().replace('"1"', '"2"'))
    with pytest.raises(SinkError):
        profiles.load_profile(tmp_path, "plain")
    with pytest.raises(SinkError):
        profiles.save_profile(tmp_path, {"name": "../x"})
    (tmp_path / "in").mkdir(), (tmp_path / "out").mkdir()
    (tmp_path / "in" / "m.bin").write_bytes(b"m")
    assert profiles.prepare_models({"m.bin": hashlib.sha256(b"m").hexdigest()}, tmp_path / "in", tmp_path / "out") == ["m.bin"]
    with pytest.raises(SinkError):
        profiles.prepare_models({"m.bin": "0"}, tmp_path / "in", tmp_path / "out")
