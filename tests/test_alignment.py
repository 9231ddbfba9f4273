import pytest

from lectern.operators import alignment as A
from lectern.operators import findings as N


def rec(ident, ordinal, text, box=None, precision="exact", page=0):
    polygon = None if box is None else [(box[0], box[1]), (box[2], box[1]), (box[2], box[3]), (box[0], box[3])]
    return A.Record(ident, ordinal, text, polygon, precision, page)


def status(result):
    return {x["id"]: x["status"] for x in result["left"] + result["right"]}


def test_equal_records_match():
    left = [rec("l0", 0, "Total $1,000.00", (10, 20, 90, 32)), rec("l1", 1, "Due", (10, 40, 90, 52))]
    got = A.align_page(left, [rec("r0", 0, "Total $1,000.00", (10, 20, 90, 32)), rec("r1", 1, "Due", (10, 40, 90, 52))])
    assert set(status(got).values()) == {"unique"} and [m["cost"] for m in got["matches"]] == [0.0, 0.0]
    assert got["order_differences"] == [] and got["diagnostics"]["blocks"] == 2


def test_parts_match_a_whole():
    left = [rec("l0", 0, "$1,", (10, 20, 40, 32)), rec("l1", 1, "000.00", (42, 20, 80, 32))]
    got = A.align_page(left, [rec("r0", 0, "$1,000.00", (10, 20, 80, 32))])
    assert [(m["left"], m["provenance"]) for m in got["matches"]] == [(["l0", "l1"], "many_to_one")]


def test_two_equal_candidates_are_no_match():
    got = A.align_page([rec("l0", 0, "x", (10, 20, 20, 32)), rec("l1", 1, "x", (22, 20, 32, 32))], [rec("r0", 0, "x", (16, 20, 26, 32))])
    assert got["matches"] == [] or all(m["margin"] >= A.MIN_MARGIN for m in got["matches"])
    assert all(a["candidates"] for a in got["ambiguous"])


def test_other_order_is_told_not_hidden():
    left = [rec("l0", 0, "a", (10, 20, 80, 32)), rec("l1", 1, "b", (300, 20, 380, 32))]
    got = A.align_page(left, [rec("r0", 1, "a", (10, 20, 80, 32)), rec("r1", 0, "b", (300, 20, 380, 32))])
    assert len(got["matches"]) == 2 and len(got["order_differences"]) == 2 and got["diagnostics"]["order_inversions"] == 1


def test_records_without_a_place_stay_apart():
    left = [rec("l0", 0, "same"), rec("l1", 1, "b", (1, 1, 9, 9), "unknown"), rec("l2", 2, "c", (5, 5, 5, 9))]
    got = A.align_page(left, [rec("r0", 0, "same", (10, 20, 80, 32)), rec("r1", 1, "x", (1, 1, 9, 9), page=3)], page=0)
    assert status(got) == {"l0": "page_level", "l1": "page_level", "l2": "page_level", "r0": "unmatched", "r1": "out_of_scope"}
    assert got["diagnostics"]["degenerate_left"] == 1 and got["page_level"]["left"] == ["l0", "l1", "l2"]


def test_a_region_limits_what_is_compared():
    region = [(0, 0), (100, 0), (100, 25), (0, 25)]
    side = lambda s: [rec(f"{s}0", 0, "in", (10, 5, 50, 15)), rec(f"{s}1", 1, "out", (10, 50, 50, 60))]
    got = A.align_page(side("l"), side("r"), region=region)
    assert status(got) == {"l0": "unique", "l1": "out_of_scope", "r0": "unique", "r1": "out_of_scope"}


def test_large_components_abstain():
    side = lambda s: [rec(f"{s}{i}", i, "w", (10 + i * 10, 20, 18 + i * 10, 30)) for i in range(A.MAX_COMPONENT + 1)]
    got = A.align_page(side("l"), side("r"))
    assert set(status(got).values()) == {"abstained"} and got["abstentions"][0]["reason"] == "component_too_large"


def test_bad_input_is_refused():
    with pytest.raises(A.AlignmentError) as e:
        A.align_page([rec("a", 0, "x"), rec("a", 1, "y")], [])
    assert e.value.code == "ID"
    with pytest.raises(A.AlignmentError) as e:
        A.align_page([rec("a", 0, "x")], [rec("b", 0, "x", page=1)])
    assert e.value.code == "PAGE"
    assert A.align_page([], [])["matches"] == []


def test_cheapest_pairing_against_all(monkeypatch):
    """The programme's cost equals the least over all pairings without crossings, tried one by one."""
    import random

    r = random.Random(2)
    for _ in range(30):
        n, m = r.randint(0, 4), r.randint(0, 4)
        pairs = {}
        for i in range(n):
            for j in range(m):
                if r.random() < 0.7:
                    pairs[i, j] = A.Pair(None, None, 0, 0, 0, round(r.random(), 3))
        cost, path = A.Solver().solve(n, m, A._moves((i, 1, j, 1, p) for (i, j), p in pairs.items()))

        def best(i, j):
            if i == n or j == m:
                return A.UNMATCHED * (n - i + m - j)
            ways = [best(i + 1, j) + A.UNMATCHED, best(i, j + 1) + A.UNMATCHED]
            if (i, j) in pairs:
                ways.append(best(i + 1, j + 1) + pairs[i, j].cost - A.PREFERENCE)
            return min(ways)

        assert cost == pytest.approx(best(0, 0)) and len(path) <= min(n, m)


def test_pages_in_spark(spark):
    kind = "document string, page_index int, id string, ordinal int, text string, polygon array<array<double>>, precision string"
    square = lambda y: [[0.0, y], [50.0, y], [50.0, y + 10], [0.0, y + 10]]
    left = spark.createDataFrame([("d", 0, "a", 0, "pay 100", square(0.0), "exact"), ("d", 0, "b", 1, "alone", square(40.0), "exact"), ("e", 0, "c", 0, "x", None, "page_only")], kind)
    right = spark.createDataFrame([("d", 0, "z", 0, "pay 700", square(0.0), "exact"), ("e", 0, "y", 0, "other", None, "page_only")], kind)
    aligned = A.align(left, right)
    got = {(r.document, r.occurrence_id): r.status for r in aligned.where("status IS NOT NULL").collect()}
    assert got == {("d", "a"): "unique", ("d", "b"): "unmatched", ("d", "z"): "unique", ("e", "c"): "page_level", ("e", "y"): "page_level"}
    found = {(r.document, r.kind, r.alignment, r.priority) for r in N.from_alignment(aligned, left, right, "document").collect()}
    assert found == {("d", "reading_difference", "page_level", "material_token"), ("d", "observed_structure", "unmatched", "informational"), ("e", "reading_difference", "page_level", "ordinary")}


def test_a_block_of_two_records_as_the_programme_has_it():
    """One fragment a side is matched without the programme; an own region, which all is in, takes the programme."""
    import random

    r = random.Random(4)
    kinds = set()
    for _ in range(200):
        place = [(r.randint(0, 9), r.randint(0, 9)) for _ in range(2)]
        sides = [[rec(s, r.randint(0, 3), r.choice(["a1", "b", "a7"]), (x, y, x + r.randint(1, 20), y + r.randint(1, 20)))] for s, (x, y) in zip("lr", place)]
        fast, slow = A.align_page(*sides), A.align_page(*sides, region=[(-9, -9), (99, -9), (99, 99), (-9, 99)])
        assert fast | {"region_scoped": True} == slow
        kinds.add((len(fast["matches"]), len(fast["ambiguous"])))
    assert kinds == {(0, 0), (0, 1), (1, 0)}


def test_blocks_against_all_pairs():
    import random

    r = random.Random(6)
    for _ in range(100):
        sides = []
        for s in "lr":
            boxes = [(x, y, x + r.randint(1, 9), y + r.randint(1, 9)) for x, y in ((r.randint(0, 40), r.randint(0, 40)) for _ in range(12))]
            sides.append([A.Run([A.Fragment(k, rec(f"{s}{k}", k, "x"), b)], b) for k, b in enumerate(boxes)])
        found, _, _, tests = A.blocks(*sides, 2.0)
        assert tests == sum(b.box[1] < a.box[3] for a in sides[0] for b in sides[1])
        part = {id(x): k for k, block in enumerate(found) for side in block for x in side}
        for a in sides[0]:
            for b in sides[1]:
                if b.box[1] < a.box[3] and A._near(a.box, b.box, 2.0):
                    assert part[id(a)] == part[id(b)]


def test_turned_places_against_all_pairs():
    import random
    from itertools import combinations

    r = random.Random(8)
    for _ in range(300):
        values = [r.randint(0, 9) for _ in range(r.randint(0, 9))]
        turned = [(i, j) for i, j in combinations(range(len(values)), 2) if values[i] > values[j]]
        assert A.turned_places(values) == (list(dict.fromkeys(k for pair in turned for k in pair)), len(turned))
    assert A.turned_places(list(range(50_000, 0, -1)))[1] == 50_000 * 49_999 // 2


def test_many_pages_of_long_lines_in_spark(spark):
    """More pages than a worker holds at a time, lines of 30,000 characters, an empty side, points that are no pairs."""
    kind = "doc long, page_index int, id string, ordinal int, text string, polygon array<array<double>>, precision string"
    square = lambda y: [[0.0, y], [50.0, y], [50.0, y + 10], [0.0, y + 10]]
    long = "word 1 " * 4_300
    left = spark.createDataFrame([(d, 0, f"a{k}", k, f"{d} {long}", square(20.0 * k), "exact") for d in range(150) for k in (1, 0)], kind).repartition(1)
    right = spark.createDataFrame([(d, 0, "b", 0, f"{d} {long}"[:-2] + "7 ", square(0.0), "exact") for d in range(1, 151)] + [(151, 0, "odd", 0, "x", [[1.0], [2.0], [3.0]], "exact")], kind)
    rows = A.align(left, right, "doc").collect()
    status = {(r.doc, r.occurrence_id): r.status for r in rows if r.kind in ("left", "right")}
    assert len(status) == 451 and all(status[d, "a0"] == status[d, "b"] == "unique" and status[d, "a1"] == "unmatched" for d in range(1, 150))
    assert [status[k] for k in ((0, "a0"), (150, "b"), (151, "odd"))] == ["unmatched", "unmatched", "page_level"]
    assert sorted(r.doc for r in rows if r.kind == "diagnostics") == list(range(152))
    assert {round(r.text_distance * 30_000) for r in rows if r.kind == "match"} == {2}


def test_findings_read_an_alignment_once(spark):
    kind = "doc string, page_index int, id string, ordinal int, text string, polygon array<array<double>>, precision string"
    square = lambda y: [[0.0, y], [50.0, y], [50.0, y + 10], [0.0, y + 10]]
    left = spark.createDataFrame([("d", 0, f"a{k}", k, f"same {k}", square(20.0 * k), "exact") for k in range(12)] + [("d", 0, f"p{k}", 50 + k, f"p {k}", None, "page_only") for k in range(11)], kind)
    right = spark.createDataFrame([("d", 0, f"b{k}", k, f"same {k}", square(20.0 * k), "exact") for k in range(3)] + [("d", 0, "q", 9, "other", None, "page_only"), ("e", 0, "z", 0, "x", square(0.0), "exact")], kind)
    found = N.from_alignment(A.align(left, right, "doc"), left, right, "doc")
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {(r.doc, r.kind, r.alignment): (r.priority, r.left_ids, r.right_ids) for r in found.collect()}
    assert got == {
        ("d", "observed_structure", "unmatched"): ("informational", [f"a{k}" for k in range(3, 12)], []),
        ("d", "reading_difference", "page_level"): ("ordinary", [f"p{k}" for k in range(11)], ["q"]),
        ("e", "ocr_interpretation", "unmatched"): ("informational", [], ["z"]),
    }
