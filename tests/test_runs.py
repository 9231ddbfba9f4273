import json

import pytest
from pyspark.sql import functions as F

from lectern.engine import Engine
from lectern.functions.identity import seal
from lectern.operators import compare as R
from lectern.operators import coverage as C
from lectern.operators import ledger as K
from lectern.operators import lineage as L
from lectern.operators import selection as E
from lectern.operators import validate as V
from lectern.sources import artifacts, readers, sinks
from lectern.streaming import admission


def report(**change):
    polygon = [[0.0, 0.0], [10.0, 0.0], [10.0, 5.0], [0.0, 5.0]]
    geometry = {"precision": "exact", "space": "canonical_page", "polygon": polygon, "transform_ids": ["t"], "basis": "b"}
    occ = lambda i, r, t: {"id": i, "reader_id": r, "page_index": 0, "ordinal": 0, "raw_text": t, "normalized_text": t, "normalization_map": [{"raw_start": 0, "raw_end": len(t), "normalized_start": 0, "normalized_end": len(t), "operation": "identity"}], "geometry": geometry, "engine_score": None, "source_asset_id": None, "raw_source_locator": "x"}
    out = {
        "report_id": "", "document": {"sha256": "0" * 64, "byte_length": 1, "page_count": 1, "display_name": None, "source_asset_id": None},
        "readers": [{"id": "ra", "name": "A", "version": "1", "settings": {}}, {"id": "rb", "name": "B", "version": "1", "settings": {}}],
        "pages": [{"index": 0, "media_box": [0.0, 0.0, 100.0, 50.0], "crop_box": None, "effective_view_box": [0.0, 0.0, 100.0, 50.0], "user_unit": 1.0, "rotation": 0, "canonical_size_pt": [100.0, 50.0], "raw_to_canonical_transform_id": "t"}],
        "transforms": [{"id": "t", "page_index": 0, "from_space": "a", "to_space": "b", "matrix": [1.0, 0.0, 0.0, -1.0, 0.0, 50.0], "inverse": [1.0, 0.0, 0.0, -1.0, 0.0, 50.0], "operation": "canonical"}],
        "plan": {"selected_pages": [0], "regions": [], "checks": [{"id": "c", "page_index": 0, "capability": "native_text", "reader_ids": ["ra", "rb"], "region_id": None}]},
        "occurrences": [occ("o1", "ra", "100"), occ("o2", "rb", "700")],
        "checks": [{"id": "c", "status": "completed", "reason": None, "produced_occurrence_count": 2, "retained_occurrence_ids": ["o1", "o2"]}],
        "findings": [{"id": "f", "kind": "reading_difference", "page_index": 0, "occurrence_ids": ["o1", "o2"], "check_ids": ["c"], "alignment": "page_level", "region_id": None, "priority": "ordinary"}],
        "annotations": [], "execution": {"status": "complete", "run_key": "", "execution_id": "e"}, "assets": [],
        "export": {"mode": "report", "replay": "unavailable", "included": ["document_hash", "settings", "coverage", "selected_text"]},
    }
    return json.loads(json.dumps(out)) | change


BROKEN = {
    "ID": lambda r: r["readers"].append(r["readers"][0]),
    "COVERAGE": lambda r: r["checks"].clear(),
    "PAGE": lambda r: r["plan"]["selected_pages"].append(3),
    "TRANSFORM": lambda r: r["transforms"][0].update(inverse=[2.0, 0.0, 0.0, 1.0, 0.0, 0.0]),
    "GEOMETRY": lambda r: r["occurrences"][0]["geometry"].update(polygon=None),
    "NORMALIZATION": lambda r: r["occurrences"][0].update(raw_text="1  00"),
    "REFERENCE": lambda r: r["occurrences"][0].update(reader_id="nobody"),
    "EVIDENCE": lambda r: r["findings"][0].update(occurrence_ids=["o1"]),
    "PRIVACY": lambda r: r["export"]["included"].remove("selected_text"),
    "SCORE": lambda r: r["occurrences"][0].update(engine_score={"value": 2.0, "scale_min": 0.0, "scale_max": 1.0, "meaning": "m"}),
    "REPLAY": lambda r: r["export"].update(mode="replayable"),
}


def test_validation_names_the_first_broken_rule(spark, tmp_path):
    good = seal(report())
    (tmp_path / "good.json").write_bytes(sinks.report_json(good))
    for code, harm in BROKEN.items():
        bad = report()
        harm(bad)
        (tmp_path / f"{code}.json").write_bytes(sinks.report_json(seal(bad)))
    forged = good | {"findings": []}
    (tmp_path / "forged.json").write_bytes(sinks.report_json(forged))
    stale = json.loads(json.dumps(good))
    stale["occurrences"][0].update(raw_text="1  00")
    (tmp_path / "stale.json").write_bytes(sinks.report_json(stale))  # a broken map and a stale hash: the rule comes first
    (tmp_path / "twice.json").write_text('{"a": 1, "a": 2}')
    (tmp_path / "page.json").write_text("<html>")
    got = {r.path.rsplit("/", 1)[1][:-5]: r.code for r in Engine(spark).validate(str(tmp_path)).collect()}
    assert got.pop("stale") == "NORMALIZATION" and got.pop("good") is None and got.pop("forged") == "HASH" and got.pop("twice") == "DUPLICATE" and got.pop("page") == "markup"
    assert got == {c: c for c in BROKEN}
    stored = artifacts.reports(artifacts.scan(spark, str(tmp_path / "good.json")))
    assert V.violations(stored).count() == 0
    view = Engine(spark).open(str(tmp_path / "good.json")).first()
    assert (view.planned, view.completed, view.occurrences, view.text_bytes) == (1, 1, 2, 6)
    page = sinks.report_html(good)
    assert "700" in page and "<script" not in page
    with pytest.raises(sinks.SinkError):
        sinks.assert_script_free("<a href=http://x>")


def test_strict_json():
    for text, code in (('{"a":1,"a":2}', "DUPLICATE"), ("NaN", "NONFINITE"), ("[" * 30 + "]" * 30, "DEPTH"), (b"\xff", "UTF8"), ("{", "JSON"), (str(2**60), "NUMBER"), ('{"__proto__": 1}', "KEY"), (r'"\ud800"', "UNICODE")):
        with pytest.raises(artifacts.ArtifactError) as e:
            artifacts.loads_strict(text)
        assert e.value.code == code
    assert artifacts.loads_strict('{"a": [1, 2.5, null]}') == {"a": [1, 2.5, None]}


def test_journal_survives_a_torn_line(spark, tmp_path):
    path = tmp_path / "journal.jsonl"
    j = sinks.Journal(path)
    j.record("start"), j.record("end")
    with path.open("ab") as f:
        f.write(b'{"seq": 2, "ev')
    assert [r.event for r in artifacts.journal(spark, str(path)).collect()] == ["start", "end"]
    assert sinks.Journal(path).record("again") == 2
    assert [r.seq for r in artifacts.journal(spark, str(path)).collect()] == [0, 1, 2]
    path.write_text('{"seq": 0, "event": "a"}\n{broken\n{"seq": 2, "event": "c"}\n')
    with pytest.raises(artifacts.ArtifactError):
        artifacts.journal(spark, str(path))


def test_baseline_is_never_written_over(spark, tmp_path):
    run = spark.createDataFrame([("k", "id1", "{}")], "key string, report_id string, text string")
    folder = str(tmp_path / "b")
    Engine(spark).baseline(run, folder, "someone", "because")
    assert sinks.load_baseline(spark, folder).count() == 1
    with pytest.raises(sinks.SinkError):
        Engine(spark).baseline(run, folder, "someone", "because")
    with pytest.raises(sinks.SinkError):
        Engine(spark).baseline(run, str(tmp_path / "c"), "", "")


def test_decision_table(spark):
    names = ["key", "has_left", "has_right", "has_rules", "same_document", "same_readers", "violations", "coverage_lost", "right_failed", "changes"]
    rows = [
        ("missing", True, False, False, True, True, 0, False, False, 0), ("missing_ruled", True, False, True, True, True, 0, False, False, 0), ("other", True, True, True, False, False, 3, True, True, 1),
        ("readers", True, True, True, True, False, 3, True, True, 1), ("rules", True, True, True, True, True, 1, False, False, 0), ("lost", True, True, False, True, True, 0, True, False, 0),
        ("failed", True, True, False, True, True, 0, False, True, 0), ("changed", True, True, False, True, True, 0, False, False, 2), ("same", True, True, False, True, True, 0, False, False, 0),
    ]
    facts = spark.createDataFrame(rows, names)
    status, code = Engine(spark).compare_runs(facts)
    got = {r.key: r.status for r in status.collect()}
    assert got == {"missing": "errored", "missing_ruled": "regressed", "other": "incomparable", "readers": "incomparable", "rules": "regressed", "lost": "regressed", "failed": "regressed", "changed": "changed", "same": "unchanged"}
    assert code == 5
    upgrade, _ = Engine(spark).compare_runs(facts, "reader_upgrade")
    assert {r.key: r.status for r in upgrade.collect()}["readers"] == "regressed"
    only = R.status(facts.where("key IN ('changed', 'same')"))
    assert R.fold(only).first().exit_code == 0 and R.fold(only, fail_on_changed=True).first().exit_code == 5


def test_components_and_splits(spark):
    rows = spark.createDataFrame([(1, "a", "x", "p"), (2, "a", "y", "q"), (3, "b", "y", "p"), (4, "c", None, "p"), (5, None, None, "q")], "id long, g string, h string, split string")
    roots = L.components(rows, L.shared_keys(rows, "id", ["g", "h"]), "id")
    assert {(r.id, r.root) for r in roots.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}
    assert [tuple(r) for r in L.split_leaks(rows, roots, "id", "split").collect()] == [(1, 2, 3)]
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    ids = spark.range(41).withColumnRenamed("id", "v")
    assert L.components(ids, path, "v").select("root").distinct().count() == 1
    split = L.assign_grouped(roots, {"train": 0.5, "test": 0.5}, 1)
    assert split.count() == 3 and set(L.assign_naive(["a", "b", "c", "d"], {"x": 0.5, "y": 0.5}, 3).values()) == {"x", "y"}


def test_coverage_keeps_the_denominator(spark):
    kind = "page_key string, status string, resolution string, finding_ids array<string>, occurrence_count int, errors array<double>"
    readings = spark.createDataFrame([("a:0", "completed", "useful_finding", ["f"], 2, [1.0]), ("a:0", "failed", None, None, None, None), ("b:0", "timeout", "useful_finding", ["g"], 1, None)], kind)
    labels = spark.createDataFrame([("a:0", "supported_failure", 2), ("b:0", "supported_failure", 1), ("c:0", "clean", 0)], "page_key string, truth string, expected_occurrences int")
    pages = C.collapse_readings(readings)
    got = {r.truth: r for r in C.coverage(labels, pages, "truth").collect()}
    assert (got["supported_failure"].total, got["supported_failure"].covered) == (2, 1) and got["clean"].never_attempted == 1
    assert {(r.status, r.n) for r in C.uncovered_statuses(labels, pages).collect()} == {("timeout", 1), ("never_attempted", 1)}
    kept = C.occurrence_preservation(labels, pages).first()
    assert (kept.pages, kept.preserved) == (3, 1)  # silence is a loss, expected zero or not


def test_selection(spark):
    occ = spark.createDataFrame([("r", "o1"), ("r", "o2"), ("r", "o3")], "report_id string, id string")
    find = spark.createDataFrame([("r", "f1", ["o1"]), ("r", "f2", ["o1", "o2"]), ("r", "f0", [])], "report_id string, id string, occurrence_ids array<string>")
    own = spark.createDataFrame([("r", "o1")], "report_id string, id string")
    for select, ids, n, fs in (("all", None, 3, 3), ("none", None, 0, 1), ("cited", None, 2, 3), ("ids", own, 1, 2)):
        kept, stay, _ = E.project(occ, find, select, ids)
        assert (kept.count(), stay.count()) == (n, fs)


def test_admission_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"j{i % 3}", 2 if i % 7 else 1, "run", (i * 5) % 17, "completed" if i in (20, 25) else "note", 0, 0, None) for i in range(40)]
    kind = "arrival long, job_id string, generation int, run_key string, seq long, event string, rows long, bytes long, reason string"
    for part, at in ((rows[:23], "a"), (rows[23:], "b")):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = admission.admit(stream.withColumn("document_sha256", F.lit("d")), 2, "run")
    query = out.writeStream.format("memory").queryName("verdicts").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.arrival: None if r.verdict == "admitted" else r.verdict for r in spark.table("verdicts").collect()}
    batch = K.admit(spark.createDataFrame(rows, kind).withColumn("terminal", F.col("event") == "completed"), 2, "run")
    assert got == {r.arrival: r.rejection for r in batch.collect()}


def test_job_bounds():
    m = lambda seq, event, **k: {"seq": seq, "event": event, "rows": 1, "bytes": 1, "reason": None} | k
    s, v, _ = admission.step(admission.START, m(0, "chunk"))
    s, v, _ = admission.step(s, m(1, "chunk"))
    assert v == "admitted" and admission.step(s, m(1, "chunk"))[1] == "sequence"
    bad, v, name = admission.step(s, m(2, "chunk"))
    assert (v, name, bad[3]) == ("resource_limit", "terminal", 2) and admission.step(bad, m(9, "note"))[1] == "terminal_job"
    s, v, _ = admission.step(s, m(2, "failed", reason="worker_crash"))
    assert v == "retry" and admission.step(s, m(0, "failed", reason="worker_crash"))[2] == "terminal"


def test_readers(spark):
    tsv = "5\t1\t1\t1\t1\t1\t10\t20\t30\t8\t91.5\tTotal\n4\t1\t1\t1\t1\t0\t0\t0\t0\t0\t-1\t\n5\t1\t1\t1\t1\t2\t45\t20\t9\t8\t40\t9"
    got = readers.word_table(spark.createDataFrame([("d", tsv)], "k string, t string"), "k", "t").collect()
    assert [(r.ordinal, r.raw_text, r.low_score) for r in got] == [(0, "Total", False), (1, "9", True)] and got[0].polygon[2] == [40.0, 28.0]
    ops = readers.stream_operations("1 1 1 rg 10 10 50 20 re f BT 3 Tr (hidden) Tj ET q 0 g (a\\)b) Tj Q [(x) -2 (y)] TJ")
    assert [(o["kind"], o.get("text"), o["mode"]) for o in ops] == [("rect", None, 0), ("text", "hidden", 3), ("text", "a\\)b", 3), ("text", "xy", 3)]
    out = readers.isolated(spark.createDataFrame([("a", "1"), ("b", "x")], "k string, c string"), lambda c: [int(c)], "k", "c").collect()
    assert {(r.k, r.status) for r in out} == {("a", "completed"), ("b", "failed")}
    page = spark.createDataFrame([(1, "<p>a &amp; b<script>x</script><br>c</p>")], "page_id long, html string")
    assert readers.html_text(page).first().raw_text == "a & b c"
    chars = spark.createDataFrame([("d", i, c, [0.0, 0.0, 1.0, 1.0]) for i, c in enumerate("ab cd\ne")], "k string, n int, char string, box array<double>")
    assert [(r.ordinal, r.raw_text) for r in readers.glyph_runs(chars, ["k"]).orderBy("ordinal").collect()] == [(0, "ab"), (1, "cd"), (2, "e")]


def test_python_source(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    spark.dataSource.register(readers.ReadingSource)
    got = spark.read.format("reading").option("paths", str(tmp_path / "a.txt")).load().orderBy("ordinal").collect()
    assert [r.raw_text for r in got] == ["one", "two"]


def test_corpus(spark):
    import hashlib

    files = spark.createDataFrame([("a.txt", bytearray(b"one")), ("b.txt", bytearray(b"two"))], "source_path string, content binary")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    manifest = spark.createDataFrame([("a", "a.txt", sha(b"one"), "d1"), ("b", "b.txt", sha(b"xxx"), "d1"), ("c", "../c.txt", sha(b""), "d1"), ("d", "d.txt", sha(b""), "d1")], "key string, source_path string, sha256 string, config_digest string")
    got = {r.key: (r.status, r.reason) for r in Engine(spark).corpus_run(manifest, files, lambda b: [bytes(b).decode()]).collect()}
    assert got == {"a": ("completed", None), "b": ("failed", "sha256"), "c": ("failed", "unsafe_path"), "d": ("failed", "missing_file")}


def test_page_specs():
    assert V.page_spec("1,3-5", 6) == [0, 2, 3, 4] and V.page_spec("all", 3) == [0, 1, 2]
    for bad in ("0", "2-1", "1,1", "7", "x", "1-"):
        with pytest.raises(ValueError):
            V.page_spec(bad, 6)
