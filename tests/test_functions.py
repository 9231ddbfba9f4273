import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import geometry as G
from lectern.functions import identity as I
from lectern.functions import statistics as S
from lectern.functions import text as X

TEXTS = ["", "plain", " \t lead and trail \n ", "x 　y z w", "café nómina", "pay \U0001f4b8 now", "a​b﻿c", "line one\r\nline two", "−$1,000.00"]


def _model(s):
    out, entries, i, n = "", [], 0, 0
    while i < len(s):
        j = i
        white = s[i] in X.WHITE_SPACE
        while j < len(s) and (s[j] in X.WHITE_SPACE) == white:
            j += 1
        piece = " " if white else s[i:j]
        entries.append((i, j, n, n + len(piece), "whitespace" if white else "identity"))
        out, n, i = out + piece, n + len(piece), j
    return out, entries


def test_normalisation_and_map(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)] + [(99, None)], "k int, t string")
    rows = rows.withColumns({"n": X.normalize(F.col("t")), "m": X.normalization_map(F.col("t"))})
    got = {r.k: r for r in rows.select("k", "n", "m", X.map_is_contiguous(F.col("m"), F.col("t"), F.col("n")).alias("ok")).collect()}
    for k, t in enumerate(TEXTS):
        n, m = _model(t)
        assert got[k].n == n and [tuple(e) for e in got[k].m] == m and got[k].ok
    assert got[99].n is None
    assert len(X.WHITE_SPACE) == 25


def test_positions_go_back_and_forth(spark):
    rows = spark.createDataFrame([("a  b\t\tcd", i) for i in range(6)], "t string, i int").withColumn("m", X.normalization_map(F.col("t")))
    got = [tuple(r) for r in rows.select(X.to_raw(F.col("m"), F.col("i")), X.to_raw(F.col("m"), F.col("i") + 1, end=True), X.raw_slice(F.col("t"), F.col("m"), F.col("i"), F.col("i") + 1)).collect()]
    assert got == [(0, 1, "a"), (1, 3, "  "), (3, 4, "b"), (4, 6, "\t\t"), (6, 7, "c"), (7, 8, "d")]


def test_maps_of_many_texts_at_once():
    r = random.Random(7)
    texts = [None, *TEXTS, *("".join(r.choices("ab \t\u2003é\U0001f4b8", k=r.randint(0, 12))) for _ in range(200)), None, ""]
    flat, models = X.Maps(pa.array(["cut off", *texts])[1:]), [_model(t or "") for t in texts]
    assert flat.arrow().to_pylist() == [None if t is None else [dict(zip(("raw_start", "raw_end", "normalized_start", "normalized_end", "operation"), e)) for e in m] for t, (_, m) in zip(texts, models)]
    raw, new = np.array([len(t or "") for t in texts]), np.array([len(n) for n, _ in models])
    assert flat.contiguous(raw, new).all() and not flat.contiguous(raw + 1, new).any() and not flat.contiguous(raw, new + 1).any()
    flat.raw_start[flat.offsets[2:-1][np.diff(flat.offsets)[2:] > 1] + 1] += 1  # a gap before the second run
    assert (flat.contiguous(raw, new)[2:] == (np.diff(flat.offsets)[2:] < 2)).all()
    flat = X.Maps(pa.array(texts))
    for at in range(-1, 14):
        for end in (False, True):
            got, inside = flat.to_raw(np.full(len(texts), at), end)
            for k, (_, m) in enumerate(models):
                own = [e for e in m if (e[2] < at <= e[3] if end else e[2] <= at < e[3])]
                want = 0 if end and at == 0 else None if not own else own[0][end] if own[0][4] == "whitespace" else own[0][0] + at - own[0][2]
                assert (got[k] if inside[k] else None) == want
    assert [b - a for a, b in X._slices(pa.array(["aaa", None, "", "éé", "b" * 9, "c"]), 5)] == [3, 1, 1, 1]


def test_checked_maps(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*TEXTS, None, "a  b" * 50_000])], "k int, t string")
    n = X.normalize(F.col("t"))
    got = {r.k: r.c for r in rows.select("k", X.check_map(F.col("t"), n, F.lit(0), F.char_length(n)).alias("c")).collect()}
    assert got[0] == (True, None, 0) and got[len(TEXTS)] == (None, None, None) and got[len(TEXTS) + 1] == (True, 0, 200_000)
    assert all(got[k] == (True, 0, len(t)) for k, t in enumerate(TEXTS) if t)
    wrong = rows.select("k", X.check_map(F.col("t"), F.concat(n, F.lit("x")), F.lit(0), F.lit(1)).alias("c")).where("k < 9").collect()
    assert not any(r.c.contiguous for r in wrong)


def _edit(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = i + j
                continue
            cost = 0 if a[i - 1] == b[j - 1] else 2 if X.is_material(a[i - 1]) or X.is_material(b[j - 1]) else 1
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + cost)
    return d[-1][-1]


def test_distance_of_few_edits():
    r = random.Random(5)
    for _ in range(500):
        a = "".join(r.choices("ab1-", k=r.randint(0, 12)))
        b = "".join(r.choices("ab1-", k=r.randint(0, 12))) if r.random() < 0.3 else "".join(r.choice(["", "1", "b", c, c, c, c + "a"]) for c in a)
        d = _edit(a, b)
        assert X.weighted_levenshtein(a, b) == X._few_edits(a, b, 99) == d and (not d or X._few_edits(a, b, d - 1) is None)
    long = "".join(r.choices("abc1 ", k=200_000))
    assert X.weighted_levenshtein(long, long[:77] + "7" + long[78:-1] + "$") == _edit(long[70:80], long[70:77] + "7" + long[78:80]) + _edit(long[-1], "$")


def test_weighted_distance(spark):
    r = random.Random(3)
    pairs = [("".join(r.choices("ab1-$ ", k=r.randint(0, 9))), "".join(r.choices("ab1-$ ", k=r.randint(0, 9)))) for _ in range(200)]
    assert [X.weighted_levenshtein(a, b) for a, b in pairs] == [_edit(a, b) for a, b in pairs]
    rows = spark.createDataFrame([("abc", "abd"), ("a1", "a2"), ("", ""), (None, "x")], "a string, b string")
    got = [r[0] for r in rows.select(X.distance(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == [pytest.approx(1 / 3), 1.0, 0.0] and got[3] is None


def test_canonical_values():
    known = [(None, "4e"), (True, "54"), (False, "46"), (1, "443ff0000000000000"), (1.0, "443ff0000000000000"), (-0.0, "440000000000000000"), ("$1,000", "530000000624312c303030")]
    assert [I.canonical(v).hex() for v, _ in known] == [h for _, h in known]
    assert I.digest({"b": 1, "a": [None]}) == I.digest(json.loads('{"a": [null], "b": 1.0}')) != I.digest({"a": [], "b": 1})
    for bad, code in ((float("nan"), "NONFINITE"), (2**53, "NUMBER"), ("\ud800", "UNICODE"), ({1: 2}, "TYPE"), ({1, 2}, "TYPE")):
        with pytest.raises(I.IdentityError) as e:
            I.canonical(bad)
        assert e.value.code == code


def test_json_digest_column(spark):
    rows = spark.createDataFrame([('{"z": [1, 2], "a": "é"}',), ('{"a":"é","z":[1.0,2]}',), (None,)], "j string")
    a, b, c = (r[0] for r in rows.select(I.json_digest(F.col("j"))).collect())
    assert a == b == I.digest({"a": "é", "z": [1, 2]}) and c is None


def test_transforms_come_back(spark):
    r = random.Random(5)
    rows = []
    for _ in range(500):
        m = [r.uniform(-3, 3) for _ in range(6)]
        if abs(m[0] * m[3] - m[1] * m[2]) > 0.05:
            rows.append((m, [r.uniform(-500, 500), r.uniform(-500, 500)]))
    df = spark.createDataFrame(rows, "m array<double>, p array<double>")
    back = G.apply(G.inverse(F.col("m")), G.apply(F.col("m"), F.col("p")))
    off = df.select(F.hypot(F.get(back, F.lit(0)) - F.get("p", F.lit(0)), F.get(back, F.lit(1)) - F.get("p", F.lit(1))).alias("d")).agg(F.max("d")).first()[0]
    assert off < 1e-5
    assert spark.range(1).select(G.inverse(G.matrix(1, 2, 2, 4, 0, 0))).first()[0] is None


def test_pages_and_boxes(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    b = lambda *v: G.box(*[F.lit(float(x)) for x in v])
    assert get(G.canonical_transform(b(10, 20, 110, 220), F.lit(2.0))) == [2, 0, 0, -2, -20, 440]
    assert get(G.effective_view(b(0, 0, 100, 100), b(-5, 10, 50, 200))) == [0, 10, 50, 100]
    assert get(G.vertical_overlap(b(0, 0, 1, 10), b(0, 5, 1, 25))) == 0.5 and get(G.vertical_overlap(b(0, 0, 1, 10), b(0, 10, 1, 20))) == 0
    assert get(G.horizontal_gap(b(0, 0, 5, 1), b(8, 0, 9, 1))) == 3
    assert get(G.signed_area(G.box_polygon(b(0, 0, 4, 3)))) == 12
    assert get(G.geometry_distance(b(0, 0, 10, 10), b(0, 0, 10, 10), F.lit(6.0), b(0, 0, 20, 20))) == 0
    clipped = G.clip(one.withColumn("p", G.box_polygon(b(0, 0, 10, 10))), "p", b(5, 5, 20, 20), "c")
    assert clipped.select(G.signed_area(F.col("c"))).first()[0] == 25
    for turn in (0, 90, 180, 270):
        m = G.display_rotation(F.lit(turn), F.lit(100.0), F.lit(50.0))
        corner = get(G.apply(m, F.array(F.lit(100.0), F.lit(50.0))))
        assert min(corner) >= 0
    assert [get(G.round6(F.lit(x))) for x in (0.0000005, -0.0000001)] == [1e-6, 0.0]


def test_wilson_known_values(spark):
    rows = spark.createDataFrame([(95, 100), (50, 100), (100, 100), (0, 0)], "k int, n int")
    low, high = S.wilson(F.col("k"), F.col("n"))
    got = [tuple(r) for r in rows.select(low, high).collect()]
    near = lambda *v: pytest.approx(v, abs=1e-4)
    assert got[0] == near(0.8882, 0.9784) and got[1] == near(0.4038, 0.5962) and got[2] == near(0.9630, 1) and got[3] == (0, 1)


def test_bootstrap_by_hand():
    groups = [("a", 3.0, 3), ("b", 0.0, 1), ("c", 1.0, 2)]
    low, high = S.bootstrap(groups)
    assert (low, high) == S.bootstrap(groups[::-1]) and 0 <= low <= high <= 1 and S.bootstrap([]) == (0.0, 1.0)
    assert math.isclose(S.bootstrap([("a", 2.0, 4)])[0], 0.5)
