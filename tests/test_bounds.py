"""Bounds, caps, needs and exact figures against plain Python."""

import json
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.functions.statistics import quantiles
from lectern.operators import coverage as C
from lectern.operators import ledger as K
from lectern.operators import runs as N
from lectern.sources import artifacts as A


def _linear(values, q):
    v = sorted(values)
    at = q * (len(v) - 1)
    low = math.floor(at)
    return v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (at - low)


@pytest.mark.parametrize("cells", [2, 512])
def test_quantiles_are_exact(spark, cells):
    """Also of groups of one, of equal values, of negative ones, and with nulls as values and groups."""
    r = random.Random(1)
    rows = [(g, r.choice((r.gauss(0, 5), float(r.randint(-3, 3)), None))) for g in ("a", "b", None) for _ in range(300)] + [("one", 2.5), ("same", 7.0), ("same", 7.0), ("none", None)]
    got = {x.g: x for x in quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p50": (0.5, "linear"), "p95": (0.95, "linear"), "r": (0.95, "rank"), "least": (0.0, "rank")}, cells).collect()}
    by = defaultdict(list)
    for g, v in rows:
        if v is not None:
            by[g].append(v)
    assert set(got) == set(by)
    for g, vs in by.items():
        x = got[g]
        assert x.n == len(vs) and x.p50 == pytest.approx(_linear(vs, 0.5)) and x.p95 == pytest.approx(_linear(vs, 0.95))
        assert x.r == sorted(vs)[math.ceil(0.95 * len(vs)) - 1] and x.least == min(vs)
    whole = quantiles(spark.createDataFrame(rows, "g string, v double"), [], "v", {"m": (0.5, "linear")}, cells).first()
    assert whole.m == pytest.approx(_linear([v for vs in by.values() for v in vs], 0.5))
    assert quantiles(spark.createDataFrame([], "g string, v double"), [], "v", {"m": (0.5, "linear")}).count() == 0


def test_inversions_by_pairs(spark):
    r = random.Random(2)
    rows = [(p, r.randint(0, 20), r.randint(0, 20)) for p in range(4) for _ in range(60)] + [(9, 1, 1), (9, 2, 2)]
    got = {x.page: x.inversions for x in C.order_inversions(spark.createDataFrame(rows, "page long, left_ordinal int, right_ordinal int").repartition(3), ["page"]).collect()}
    want = defaultdict(int)
    for p, a, b in rows:
        want[p] += sum(q == p and a < c and b > d for q, c, d in rows)
    assert got == {p: n for p, n in want.items() if n}


def test_caps_of_a_run(spark):
    """Two checks of one run share its cap; another run has its own, and what a check's cap refuses takes nothing."""
    rows = [("r", "a", 1, 4, 1), ("r", "b", 2, 4, 1), ("r", "a", 3, 30, 1), ("r", "b", 4, 1, 1), ("r", "b", 5, 9, 1), ("r", "b", 6, 1, 1), ("s", "c", 7, 9, 1)]
    chunks = spark.createDataFrame(rows, "run string, check_id string, seq long, rows long, bytes long")
    got = {x.seq: x.committed for x in K.commit_chunks(chunks, per_check=20, text_bytes=100, per_run=10).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False, 6: False, 7: True}
    alone = {x.seq: x.committed for x in K.commit_chunks(chunks.drop("run"), per_check=20, text_bytes=100, per_run=10).collect()}
    assert alone[5] and alone[6] and not alone[3]


def test_stale_documents_are_refused(spark):
    kind = "arrival long, job_id string, generation int, run_key string, seq long, terminal boolean, document_sha256 string"
    rows = spark.createDataFrame([(1, "j", 2, "run", 1, False, "d"), (2, "j", 2, "old", 2, False, "e"), (3, "j", 1, "run", 3, False, "e"), (4, "j", 2, "run", 4, False, None), (5, "j", 2, "run", 5, False, "d")], kind)
    got = [x.rejection for x in K.admit(rows, 2, "run", document="d").orderBy("arrival").collect()]
    assert got[:3] == [None, "stale_document", "stale_generation"] and got[4] is None


def test_skips_go_as_deep_as_needs(spark):
    states = spark.createDataFrame([("r", "c0", "failed"), *[("r", f"c{k}", None) for k in range(1, 9)], ("r", "free", None), ("s", "c0", "completed"), ("s", "c1", None)], "run string, check_id string, status string")
    needs = spark.createDataFrame([("r", f"c{k}", f"c{k - 1}") for k in range(1, 9)] + [("r", "c3", "c8"), ("s", "c1", "c0")], "run string, check_id string, needs string")
    got = {(x.run, x.check_id): x.status for x in K.propagate_skips(states, needs).collect()}
    assert all(got["r", f"c{k}"] == "skipped" for k in range(1, 9)) and got["r", "free"] is None and got["s", "c1"] is None and got["s", "c0"] == "completed"
    assert {(x.run, x.check_id) for x in K.circular(needs).collect()} == {("r", f"c{k}") for k in range(3, 9)}
    assert K.circular(needs.where("needs != 'c8'")).count() == 0
    fine = spark.createDataFrame([("r", "a", "completed"), ("r", "b", None)], "run string, check_id string, status string")
    assert K.propagate_skips(fine, spark.createDataFrame([("r", "b", "a")], "run string, check_id string, needs string")).where("status = 'skipped'").count() == 0


def test_slots_by_folding(spark):
    r = random.Random(3)
    rows = [(r.randint(0, 5), k, r.choice(("take", "take", "release"))) for k in range(200)]
    got = {x.arrival: (x.in_use, x.refused) for x in N.slots(spark.createDataFrame(rows, "run int, arrival long, kind string").repartition(3)).collect()}
    now = defaultdict(int)
    for run, k, kind in rows:
        refused = kind == "take" and now[run] >= N.SLOTS
        now[run] = now[run] if refused else max(0, now[run] + (1 if kind == "take" else -1))
        assert got[k] == (now[run], refused)


@pytest.mark.parametrize(("text", "code"), [
    ("[1e300]", "NUMBER"), ("[9007199254740992.0]", "NUMBER"), ("[1e400]", "NONFINITE"), ('["' + "x" * (A.MOST_STRING + 1) + '"]', "SIZE"), ('{"' + "k" * (A.MOST_STRING + 1) + '": 1}', "SIZE"),
])
def test_strict_bounds(text, code):
    with pytest.raises(A.ArtifactError) as e:
        A.loads_strict(text)
    assert e.value.code == code


def test_within_strict_bounds():
    assert A.loads_strict("[0.5, 9007199254740991, 1e10]") == [0.5, 2**53 - 1, 1e10]
    assert len(A.loads_strict(json.dumps({"assets": [{"data_base64": "A" * (A.MOST_STRING + 8)}]}))["assets"]) == 1


@pytest.mark.parametrize("most", [A.MOST_SECRETS, 0])
def test_leaks_of_many_secrets(spark, monkeypatch, most):
    monkeypatch.setattr(A, "MOST_SECRETS", most)
    secrets = spark.createDataFrame([("a long secret value",), ("abc",), ("nowhere at all",), (None,), ("",)], "secret string")
    outputs = spark.createDataFrame([("one", "here is a long secret value, twice: a long secret value"), ("two", "xabcx"), ("three", ""), ("four", None)], "name string, text string")
    assert {tuple(x) for x in A.label_leaks(secrets, outputs).collect()} == {("one", "a long secret value"), ("two", "abc")}
