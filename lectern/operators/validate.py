"""Referential and semantic rules of stored reports, each a condition on one row, so that nothing is joined or shuffled.

A report is a row with nested arrays (lectern.sources.schema.REPORT). The first rule that a report breaks names its
code; all broken ones can be listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import geometry as G
from lectern.functions import text as X
from lectern.functions.identity import report_digest, run_key

#: Largest difference of stored and recomputed numbers; largest asset and sum of assets in bytes.
CLOSE, MOST_ASSET, MOST_ASSETS = 1e-5, 16 * 1024 * 1024, 24 * 1024 * 1024


def _ids(rows: str) -> Column:
    return F.transform(rows, lambda r: r["id"])


def _repeated(ids: Column) -> Column:
    return F.size(F.array_distinct(ids)) < F.size(ids)


def _beyond(some: Column, every: Column) -> Column:
    """Whether an array has a value that the other has not."""
    return F.size(F.array_except(some, every)) > 0


def _by_id(rows: str, ident: Column) -> Column:
    return F.get(F.filter(rows, lambda r: r["id"] == ident), F.lit(0))


def _page(index: Column) -> Column:
    return F.get(F.filter("pages", lambda p: p["index"] == index), F.lit(0))


def _apart(a: Column, b: Column) -> Column:
    """Whether two arrays of numbers differ, by more than CLOSE anywhere."""
    far = F.exists(F.zip_with(a, b, lambda x, y: F.coalesce(F.abs(x - y) > CLOSE, F.lit(True))), lambda v: v)
    return F.coalesce(far, F.lit(True))


def _bad_geometry(g: Column, page: Column) -> Column:
    known = F.transform("transforms", lambda t: t["id"])
    own = F.transform(F.filter("transforms", lambda t: t["page_index"] == page), lambda t: t["id"])
    none = g["polygon"].isNull() != g["precision"].isin("unknown", "page_only")
    flat = g["polygon"].isNotNull() & (F.abs(G.signed_area(g["polygon"])) * 2 <= G.NO_AREA)
    return _beyond(g["transform_ids"], known) | _beyond(g["transform_ids"], own) | none | flat


def rules() -> list[tuple[str, str, Column]]:
    """(code, what, condition that breaks it), in the order in which they are looked at."""
    pages = F.transform("pages", lambda p: p["index"])
    plan, checks, occ = F.col("plan.checks"), F.col("checks"), F.col("occurrences")
    regions = F.col("plan.regions")
    region_ids, plan_ids = F.transform(regions, lambda r: r["id"]), F.transform(plan, lambda c: c["id"])
    reader_ids, occ_ids, check_ids, finding_ids, asset_ids = (_ids(c) for c in ("readers", "occurrences", "checks", "findings", "assets"))
    included = F.col("export.included")
    one = lambda rows, ident: F.get(F.filter(rows, lambda r: r["id"] == ident), F.lit(0))
    completed = F.size(F.filter(checks, lambda c: c["status"] == "completed"))
    status = F.col("execution.status")
    source = one(F.col("assets"), F.col("document.source_asset_id"))
    purposes = F.transform("assets", lambda a: a["purpose"])
    undisclosed = lambda purpose, name: F.array_contains(purposes, purpose) & ~F.array_contains(included, name)
    raw = lambda a: F.unbase64(a["data_base64"])

    def bad_page(p: Column) -> Column:
        v, u = p["effective_view_box"], p["user_unit"]
        t = _by_id("transforms", p["raw_to_canonical_transform_id"])
        flat = F.exists(F.array(p["media_box"], p["crop_box"], v), lambda b: b.isNotNull() & ((G.x1(b) <= G.x0(b)) | (G.y1(b) <= G.y0(b))))
        return flat | _apart(G.canonical_size(v, u), p["canonical_size_pt"]) | (t["page_index"] != p["index"]) | _apart(t["matrix"], G.canonical_transform(v, u))

    def loose_finding(f: Column) -> Column:
        own = F.filter(occ, lambda o: F.array_contains(f["occurrence_ids"], o["id"]))
        cited = F.filter(checks, lambda c: F.array_contains(f["check_ids"], c["id"]))
        few = F.size(F.array_distinct(F.transform(own, lambda o: o["reader_id"]))) < 2
        open_check = F.exists(cited, lambda c: c["status"] != "completed")
        bare = _beyond(f["occurrence_ids"], F.flatten(F.transform(cited, lambda c: c["retained_occurrence_ids"])))
        return (f["kind"] == "reading_difference") & (few | open_check | bare)

    def unplaced(f: Column) -> Column:
        own = F.filter(occ, lambda o: F.array_contains(f["occurrence_ids"], o["id"]))
        return (f["alignment"] == "unique") & (f["region_id"].isNull() | F.exists(own, lambda o: o["geometry"]["polygon"].isNull()))

    def unbound(c: Column) -> Column:
        p = one(plan, c["id"])
        own = F.filter(occ, lambda o: F.array_contains(c["retained_occurrence_ids"], o["id"]))
        return F.exists(own, lambda o: ~F.array_contains(p["reader_ids"], o["reader_id"]) | (o["page_index"] != p["page_index"]))

    def bad_asset(a: Column) -> Column:
        return (F.octet_length(raw(a)) != a["byte_length"]) | (F.sha2(raw(a), 256) != a["sha256"])

    def bad_kind(a: Column) -> Column:
        head = F.hex(F.substring(raw(a), 1, 24))
        size = F.array(F.conv(F.substring(head, 33, 8), 16, 10).cast("int"), F.conv(F.substring(head, 41, 8), 16, 10).cast("int"))
        png = ~a["purpose"].isin("crop", "page_render") | ~F.array_contains(pages, a["page_index"]) | ~head.startswith("89504E470D0A1A0A") | (size != a["pixel_size"])
        pdf = (a["purpose"] != "source_pdf") | ~head.startswith("255044462D")
        return F.when(a["media_type"] == "image/png", png).when(a["media_type"] == "application/pdf", pdf).otherwise(False)

    inverse_off = lambda t: _apart(G.inverse(t["matrix"]), t["inverse"])
    return [
        *[("ID", f"repeated id in {name}", _repeated(_ids(name))) for name in ("readers", "transforms", "occurrences", "findings", "assets")],
        ("PAGE", "repeated page", _repeated(pages)),
        ("PAGE", "page outside the document", F.exists(pages, lambda i: (i < 0) | (i >= F.col("document.page_count")))),
        *[("ID", f"repeated id in {name}", _repeated(ids)) for name, ids in (("regions", region_ids), ("plan", plan_ids), ("checks", check_ids))],
        ("COVERAGE", "planned checks and results differ", _beyond(plan_ids, check_ids) | _beyond(check_ids, plan_ids)),
        ("PAGE", "selected page without metadata", _beyond(F.col("plan.selected_pages"), pages)),
        ("REFERENCE", "page without its transform", F.exists("pages", lambda p: _by_id("transforms", p["raw_to_canonical_transform_id"]).isNull())),
        ("GEOMETRY", "page boxes, size or matrix", F.exists("pages", bad_page)),
        ("PAGE", "transform of no page", F.exists("transforms", lambda t: ~F.array_contains(pages, t["page_index"]))),
        ("TRANSFORM", "wrong inverse", F.exists("transforms", inverse_off)),
        ("PAGE", "region of no page", F.exists(regions, lambda r: ~F.array_contains(pages, r["page_index"]))),
        ("GEOMETRY", "region's geometry", F.exists(regions, lambda r: _bad_geometry(r["geometry"], r["page_index"]))),
        ("COVERAGE", "check outside the selected pages", F.exists(plan, lambda c: ~F.array_contains(F.col("plan.selected_pages"), c["page_index"]))),
        ("REFERENCE", "planned reader or region unknown", F.exists(plan, lambda c: _beyond(c["reader_ids"], reader_ids) | (c["region_id"].isNotNull() & ~F.array_contains(region_ids, c["region_id"])))),
        ("PAGE", "planned region on another page", F.exists(plan, lambda c: c["region_id"].isNotNull() & (one(regions, c["region_id"])["page_index"] != c["page_index"]))),
        ("REFERENCE", "occurrence's reader or page unknown", F.exists(occ, lambda o: ~F.array_contains(reader_ids, o["reader_id"]) | ~F.array_contains(pages, o["page_index"]))),
        ("GEOMETRY", "occurrence's geometry", F.exists(occ, lambda o: _bad_geometry(o["geometry"], o["page_index"]))),
        ("NORMALIZATION", "raw and normalised text differ", F.exists(occ, lambda o: o["normalized_text"] != X.normalize(o["raw_text"]))),
        ("NORMALIZATION", "map does not cover the texts", F.exists(occ, lambda o: ~X.map_is_contiguous(o["normalization_map"], o["raw_text"], o["normalized_text"]))),
        ("REFERENCE", "occurrence's asset unknown", F.exists(occ, lambda o: o["source_asset_id"].isNotNull() & ~F.array_contains(asset_ids, o["source_asset_id"]))),
        ("SCORE", "score outside its scale", F.exists(occ, lambda o: F.coalesce(~o["engine_score"]["value"].between(o["engine_score"]["scale_min"], o["engine_score"]["scale_max"]), F.lit(False)))),
        ("REFERENCE", "retained occurrence unknown", F.exists(checks, lambda c: _beyond(c["retained_occurrence_ids"], occ_ids))),
        ("ID", "occurrence retained twice", F.exists(checks, lambda c: _repeated(c["retained_occurrence_ids"]))),
        ("COVERAGE", "more retained than produced", F.exists(checks, lambda c: c["produced_occurrence_count"] < F.size(c["retained_occurrence_ids"]))),
        ("COVERAGE", "incomplete check without a reason", F.exists(checks, lambda c: (c["status"] != "completed") & c["reason"].isNull())),
        ("REFERENCE", "retained occurrence of another check", F.exists(checks, unbound)),
        ("PAGE", "finding of no page", F.exists("findings", lambda f: ~F.array_contains(pages, f["page_index"]))),
        ("REFERENCE", "finding's evidence unknown", F.exists("findings", lambda f: _beyond(f["occurrence_ids"], occ_ids) | _beyond(f["check_ids"], check_ids) | (f["region_id"].isNotNull() & ~F.array_contains(region_ids, f["region_id"])))),
        ("PAGE", "finding across pages", F.exists("findings", lambda f: F.exists(occ, lambda o: F.array_contains(f["occurrence_ids"], o["id"]) & (o["page_index"] != f["page_index"])))),
        ("EVIDENCE", "difference without two completed readings", F.exists("findings", loose_finding)),
        ("GEOMETRY", "unique match without a place", F.exists("findings", unplaced)),
        ("ID", "repeated id in annotations", _repeated(_ids("annotations"))),
        ("PAGE", "annotation of no page", F.exists("annotations", lambda a: ~F.array_contains(pages, a["page_index"]))),
        ("REFERENCE", "annotation's finding unknown", F.exists("annotations", lambda a: a["finding_id"].isNotNull() & ~F.array_contains(finding_ids, a["finding_id"]))),
        ("COVERAGE", "run's status and checks differ", F.when(status == "complete", completed < F.size(checks)).when(status == "failed", (completed > 0) | ~F.exists(checks, lambda c: c["status"].isin("failed", "timeout"))).when(status == "partial", completed == F.size(checks)).otherwise(False)),
        ("ASSET", "asset's hash or length", F.exists("assets", bad_asset)),
        ("SIZE", "asset too large", F.exists("assets", lambda a: a["byte_length"] > MOST_ASSET) | (F.aggregate("assets", F.lit(0).cast("long"), lambda s, a: s + a["byte_length"]) > MOST_ASSETS)),
        ("ASSET", "asset's kind", F.exists("assets", bad_kind)),
        ("PRIVACY", "required disclosure absent", _beyond(F.array(*[F.lit(x) for x in ("document_hash", "settings", "coverage")]), included)),
        ("PRIVACY", "undisclosed text", (F.size(occ) > 0) & ~F.array_contains(included, "selected_text")),
        ("PRIVACY", "undisclosed annotations", (F.size("annotations") > 0) & ~F.array_contains(included, "annotations")),
        ("PRIVACY", "undisclosed images", undisclosed("page_render", "page_renders") | undisclosed("crop", "crops")),
        ("PRIVACY", "undisclosed original", undisclosed("source_pdf", "source_pdf")),
        ("SOURCE", "original bytes not bound", F.col("document.source_asset_id").isNotNull() & F.coalesce((source["sha256"] != F.col("document.sha256")) | (source["byte_length"] != F.col("document.byte_length")) | (source["purpose"] != "source_pdf"), F.lit(True))),
        ("REPLAY", "replay without the original", ((F.col("export.mode") == "replayable") | (F.col("export.replay") == "source_included_environment_required")) & F.col("document.source_asset_id").isNull()),
        ("PRIVACY", "file name disclosure", F.col("document.display_name").isNotNull() != F.array_contains(included, "filename")),
    ]


def violations(reports: DataFrame, key: str = "key") -> DataFrame:
    """key, rule (its number), code, what: a row for every rule that a report breaks."""
    every = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(k).alias("rule"), F.lit(code).alias("code"), F.lit(what).alias("what"))) for k, (code, what, bad) in enumerate(rules())])
    return reports.select(key, F.explode(F.filter(every, lambda v: v.isNotNull())).alias("v")).select(key, "v.*")


def first_violation(reports: DataFrame, key: str = "key") -> DataFrame:
    """key, code: the code of the first broken rule, null for a valid report."""
    bad = violations(reports, key).groupBy(key).agg(F.min_by("code", "rule").alias("code"))
    return reports.select(key).join(bad, key, "left")


def hash_violations(reports: DataFrame, key: str = "key") -> DataFrame:
    """key, code of reports (key, text) whose run key or id is not what they say."""

    def run(batches):
        import json

        for pdf in batches:
            out = []
            for k, text in zip(pdf[key], pdf["text"], strict=True):
                r = json.loads(text)
                good = r["execution"]["run_key"] == run_key(r) and r["report_id"] == report_digest(r)
                if not good:
                    out.append((k, "HASH"))
            import pandas as pd

            yield pd.DataFrame(out, columns=[key, "code"])

    return reports.select(key, "text").mapInPandas(run, f"{key} string, code string")


def region_box_problem(box: Column, page: Column) -> Column:
    """Why a region is refused, null if it is good; it is never moved or cut."""
    return F.when(G.x1(box) <= G.x0(box), "empty").when(G.y1(box) <= G.y0(box), "empty").when(~G.box_within(box, page), "outside")


def raster_problem(width: Column, height: Column, edge: int = 8192, pixels: int = 16_000_000) -> Column:
    return F.when((width < 1) | (height < 1), "empty").when((width > edge) | (height > edge), "edge").when(width * height > pixels, "pixels")


def safe_relative_path(path: Column) -> Column:
    return ~path.rlike(r"(^/)|(^[A-Za-z]:)|\\|(^|/)\.\.?(/|$)|//|\x00") & (F.char_length(path) > 0)


def page_spec(spec: str, pages: int) -> list[int]:
    """Page numbers from 0 of '1,3-5' or 'all'; none twice, none that is not there."""
    if spec.strip() == "all":
        return list(range(pages))
    out: list[int] = []
    for part in spec.split(","):
        first, _, last = part.strip().partition("-")
        if not first.isdigit() or _ and not last.isdigit():
            raise ValueError(f"no page: {part!r}")
        a, b = int(first), int(last or first)
        if not 1 <= a <= b <= pages:
            raise ValueError(f"no such page: {part!r}")
        out += range(a - 1, b)
    if len(set(out)) < len(out):
        raise ValueError("a page comes twice")
    return sorted(out)
