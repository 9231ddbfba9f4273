"""Strict scans of JSON artifacts, journals, manifests and labels."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.schema import REPORT

#: Limits of one artifact: bytes, nesting, characters of a string.
MOST_BYTES, MOST_DEPTH, MOST_STRING = 32 * 1024 * 1024, 24, 2_000_000
SAFE = 2**53 - 1
#: Secrets that are sent to every task; characters of more that a text's places are joined by.
MOST_SECRETS, SECRET_HEAD = 1000, 8


class ArtifactError(ValueError):
    def __init__(self, code: str, what: str) -> None:
        super().__init__(what)
        self.code = code


def _members(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ArtifactError("DUPLICATE", "a key comes twice")
    return out


def _constant(name: str):
    raise ArtifactError("NONFINITE", f"{name} is no number")


def _audit(x, depth: int, most: int = MOST_STRING) -> None:
    if depth > MOST_DEPTH:
        raise ArtifactError("DEPTH", "nested too deeply")
    if isinstance(x, str) and len(x) > most:
        raise ArtifactError("SIZE", "a string is too long")
    if isinstance(x, dict):
        for k, v in x.items():
            if k in ("__proto__", "constructor", "prototype"):
                raise ArtifactError("KEY", f"key {k} is refused")
            _audit(k, depth + 1)
            # an asset's bytes are bounded with the artifact
            _audit(v, depth if k == "data_base64" else depth + 1, MOST_BYTES if k == "data_base64" else MOST_STRING)
    elif isinstance(x, list):
        for v in x:
            _audit(v, depth + 1)
    elif isinstance(x, str) and any(0xD800 <= ord(c) < 0xE000 for c in x):
        raise ArtifactError("UNICODE", "lone surrogate")
    elif isinstance(x, int) and not isinstance(x, bool) and abs(x) > SAFE:
        raise ArtifactError("NUMBER", "integer beyond 2**53")
    elif isinstance(x, float):
        if not math.isfinite(x):
            raise ArtifactError("NONFINITE", "a number beyond all bounds")
        if x.is_integer() and abs(x) > SAFE:
            raise ArtifactError("NUMBER", "integral number beyond 2**53")


def loads_strict(data: bytes | str):
    """The value of an artifact: UTF-8, of bounded size and depth, no key twice, no NaN, only safe integers."""
    if len(data) > MOST_BYTES:
        raise ArtifactError("SIZE", "too large")
    try:
        text = data.decode("utf-8") if isinstance(data, bytes) else data
    except UnicodeDecodeError as e:
        raise ArtifactError("UTF8", "no UTF-8") from e
    try:
        out = json.loads(text, object_pairs_hook=_members, parse_constant=_constant)
    except RecursionError as e:
        raise ArtifactError("DEPTH", "nested too deeply") from e
    except json.JSONDecodeError as e:
        raise ArtifactError("JSON", "no JSON") from e
    _audit(out, 0)
    return out


def kind_of(content: Column) -> Column:
    """What a file is by its first bytes: archive, pdf, markup, utf16, empty or json."""
    head = F.hex(F.substring(content, 1, 8))
    start = F.trim(F.substring(content, 1, 64).cast("string"))
    return (
        F.when(F.octet_length(content) == 0, "empty")
        .when(head.startswith("504B") | head.startswith("1F8B") | head.startswith("377ABCAF"), "archive")
        .when(head.startswith("25504446"), "pdf")
        .when(head.startswith("FFFE") | head.startswith("FEFF"), "utf16")
        .when(start.startswith("<"), "markup")
        .otherwise("json")
    )


def failure_class(code: Column) -> Column:
    """What to tell about a refused import: wrong_kind, too_large, unreadable or invalid."""
    return (
        F.when(code.isin("archive", "pdf", "markup", "utf16", "empty", "KIND"), "wrong_kind")
        .when(code.isin("SIZE", "DEPTH"), "too_large")
        .when(code.isin("UTF8", "JSON", "DUPLICATE", "NONFINITE", "NUMBER", "UNICODE"), "unreadable")
        .otherwise("invalid")
    )


def scan(spark: SparkSession, path: str) -> DataFrame:
    """path, length, kind, text, code of every file under a path: text is null and code says why where it is refused.
    Cheap refusals come first: size and kind are settled before anything is parsed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = kind_of(F.col("content"))
    early = F.when(F.col("length") > MOST_BYTES, "SIZE").when(kind != "json", kind)
    rows = files.select("path", "length", kind.alias("kind"), early.alias("code"), F.when(early.isNull(), F.col("content")).alias("content"))

    def run(batches):
        for pdf in batches:
            text, code = [], list(pdf["code"])
            for k, c in enumerate(pdf["content"]):
                text.append(None)
                if c is not None and code[k] is None:
                    try:
                        loads_strict(bytes(c))
                        text[-1] = bytes(c).decode("utf-8")
                    except ArtifactError as e:
                        code[k] = e.code
            yield pdf[["path", "length", "kind"]].assign(text=text, code=code)

    return rows.mapInPandas(run, "path string, length long, kind string, text string, code string")


def reports(scanned: DataFrame) -> DataFrame:
    """key (the file's stem) and the members of every accepted report."""
    stem = F.regexp_extract("path", r"([^/]+?)\.json$", 1)
    return scanned.where("code IS NULL").select(stem.alias("key"), "text", F.from_json("text", REPORT).alias("r")).select("key", "text", "r.*")


def ambiguous_keys(reports: DataFrame) -> DataFrame:
    return reports.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def with_intended(intended: DataFrame, reports: DataFrame) -> DataFrame:
    """Every intended key, with its report or without."""
    return intended.select("key").distinct().join(reports, "key", "left")


def journal(spark: SparkSession, path: str) -> DataFrame:
    """Records of an append-only journal by seq. A torn last line is passed over; a torn line before it is an error.

    A journal has one writer, so the file is read whole, as one value."""
    rows = spark.read.text(path, wholetext=True)
    each = rows.select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("n", "line"), F.size(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("of"))
    each = each.withColumn("seq", F.get_json_object("line", "$.seq").cast("long")).withColumn("good", F.expr("try_parse_json(line)").isNotNull() & F.col("seq").isNotNull())
    torn = each.where("NOT good AND n < of - 1")
    if not torn.isEmpty():
        raise ArtifactError("JOURNAL", "a line before the last is torn")
    return each.where("good").select("seq", F.get_json_object("line", "$.event").alias("event"), F.col("line").alias("record")).orderBy("seq")


def verified_corpus(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """manifest (key, source_path, sha256, ...) with problem: unsafe_path, duplicate_key, missing_file or sha256.
    files: source_path, content (as binaryFile reads them)."""
    safe = ~F.col("source_path").rlike(r"(^/)|(^[A-Za-z]:)|\\|(^|/)\.\.(/|$)|(^|/)\.(/|$)|//")
    twice = manifest.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    found = files.select("source_path", F.sha2("content", 256).alias("_sha"))
    rows = manifest.join(twice, "key").join(found, "source_path", "left")
    problem = F.when(~safe, "unsafe_path").when(F.col("_n") > 1, "duplicate_key").when(F.col("_sha").isNull(), "missing_file").when(F.col("_sha") != F.col("sha256"), "sha256")
    return rows.withColumn("problem", problem).drop("_n", "_sha")


def labels(spark: SparkSession, path: str, gated: bool = True) -> DataFrame:
    """page_key, truth, expected_occurrences, consent_ref of a label store: {"pages": {key: {...}}}. A gated store must
    say a consent for every page."""
    kind = "pages map<string,struct<truth:string,expected_occurrences:int,consent_ref:string>>"
    rows = spark.read.schema(kind).option("multiLine", "true").json(path)
    out = rows.select(F.explode("pages").alias("page_key", "l")).select("page_key", "l.*")
    if gated and not out.where("consent_ref IS NULL").isEmpty():
        raise ArtifactError("CONSENT", "a page has no consent")
    return out


def label_leaks(secrets: DataFrame, outputs: DataFrame) -> DataFrame:
    """name, secret of outputs (name, text) that say a value only the label store knows (secret). Up to MOST_SECRETS are
    looked for in every text; of more, those that share their first SECRET_HEAD characters with a place of the text are
    found by a join first. Shorter secrets are looked for as they are."""
    secrets = secrets.select("secret").where("secret IS NOT NULL AND secret != ''").distinct()
    if secrets.limit(MOST_SECRETS + 1).count() <= MOST_SECRETS:
        return outputs.join(F.broadcast(secrets), F.contains("text", F.col("secret"))).select("name", "secret")
    long, short = secrets.where(F.char_length("secret") >= SECRET_HEAD), secrets.where(F.char_length("secret") < SECRET_HEAD)
    places = F.sequence(F.lit(1), F.greatest(F.char_length("text") - SECRET_HEAD + 1, F.lit(1)))
    heads = outputs.select("name", "text", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring("text", i, F.lit(SECRET_HEAD))))).alias("_head"))
    met = heads.join(long.withColumn("_head", F.left("secret", F.lit(SECRET_HEAD))), "_head").where(F.contains("text", F.col("secret")))
    own = F.transform(F.sequence(F.lit(1), F.lit(SECRET_HEAD - 1)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("text"), F.lit(1))), lambda i: F.substring("text", i, n)))
    bits = outputs.select("name", F.explode(F.array_distinct(F.flatten(own))).alias("secret")).join(short, "secret")
    return met.select("name", "secret").unionByName(bits.select("name", "secret")).distinct()


def forbidden_keys(outputs: DataFrame, words: list[str]) -> DataFrame:
    """name, key of outputs (name, text: JSON) with a key one of whose words is forbidden; camelCase counts as words."""
    keys = F.explode(F.regexp_extract_all("text", F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1)))
    each = outputs.select("name", keys.alias("key")).distinct()
    parts = F.split(F.lower(F.regexp_replace("key", r"([a-z0-9])([A-Z])", "$1_$2")), r"[^a-z0-9]+")
    return each.where(F.arrays_overlap(parts, F.array(*[F.lit(w) for w in words])))
