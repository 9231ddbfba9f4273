"""Readers: what makes position-bearing records of text, markup, tables of words and content streams.

No reader of PDF files or images is here: no library for them is available, and none is pretended. Readers of other
kinds, and records stored by outside ones, come in through the same columns (lectern.sources.schema.OCCURRENCES).
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lectern.functions.geometry import box, box_polygon
from lectern.sources.schema import OCCURRENCES

CATALOG = [
    ("text-lines", "1", "native_text", "exact"),
    ("html-text", "1", "native_text", "page_only"),
    ("word-table", "1", "ocr", "exact"),
    ("content-stream", "1", "structure", "exact"),
]


def catalog(spark: SparkSession) -> DataFrame:
    """Readers that are here: id, version, capability, precision."""
    return spark.createDataFrame(CATALOG, "id string, version string, capability string, precision string")


def text_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A record for every line of a text, 14 points high, 6 points a character."""
    each = docs.select(F.sha2(F.col(text).cast("binary"), 256).alias("document_sha256"), F.col(key), F.posexplode(F.split(text, "\n")).alias("ordinal", "raw_text"))
    y = F.col("ordinal") * 14.0
    b = box(F.lit(0.0), y, 6.0 * F.greatest(F.char_length("raw_text"), F.lit(1)), y + 12.0)
    return each.select(
        key, "document_sha256", F.lit(0).alias("page_index"), F.lit("text-lines").alias("reader_id"), F.concat(F.lit("line_"), F.col("ordinal").cast("string")).alias("id"), "ordinal", "raw_text",
        F.lit("exact").alias("precision"), box_polygon(b).alias("polygon"), F.concat(F.lit("line:"), F.col("ordinal").cast("string")).alias("locator"),
    )


def html_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One record without a place for a page's whole text, as readers of pages without positions give."""
    bare = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("amp", "&")):
        bare = F.replace(bare, F.lit(f"&{name};"), F.lit(char))
    return pages.select(
        key, F.sha2(F.col(html).cast("binary"), 256).alias("document_sha256"), F.lit(0).alias("page_index"), F.lit("html-text").alias("reader_id"), F.lit("page_0").alias("id"), F.lit(0).alias("ordinal"),
        F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("raw_text"), F.lit("page_only").alias("precision"), F.lit(None).cast("array<array<double>>").alias("polygon"), F.lit("page:0").alias("locator"),
    )


def word_table(rows: DataFrame, key: str, tsv: str) -> DataFrame:
    """Records of words from an engine's table: tab-separated lines of level, page, block, paragraph, line, word, left,
    top, width, height, confidence, text. Words are level 5; a low confidence is kept and flagged, never dropped."""
    line = F.posexplode(F.split(F.col(tsv), "\n")).alias("n", "line")
    each = rows.select(key, line).withColumn("f", F.split("line", "\t"))
    word = each.where((F.size("f") >= 12) & (F.get("f", F.lit(0)) == "5") & (F.trim(F.get("f", F.lit(11))) != ""))
    num = lambda i: F.expr(f"try_cast(get(f, {i}) AS double)")
    b = box(num(6), num(7), num(6) + num(8), num(7) + num(9))
    place = F.row_number().over(Window.partitionBy(key).orderBy("n")) - 1
    return word.select(key, num(1).cast("int").alias("page_index"), place.alias("ordinal"), F.get("f", F.lit(11)).alias("raw_text"), box_polygon(b).alias("polygon"), (num(10) / 100).alias("score"), (num(10) < 60).alias("low_score"))


def engine_blocks(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """Words of an engine's nested result: blocks of paragraphs of lines of words (text, bbox x0 y0 x1 y1, confidence)."""
    kind = "array<struct<paragraphs:array<struct<lines:array<struct<words:array<struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>>>>>>>"
    out = rows.select(key, F.from_json(blocks, kind).alias("b")).select(key, F.posexplode("b.paragraphs").alias("i", "p"))
    out = out.select(key, "i", F.posexplode("p.lines").alias("j", "l")).select(key, "i", "j", F.posexplode("l.words").alias("k", "ws"))
    out = out.select(key, "i", "j", "k", F.posexplode("ws").alias("n", "w"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("i", "j", "k", "n")) - 1
    b = box(*[F.col(f"w.bbox.{c}") for c in ("x0", "y0", "x1", "y1")])
    return out.select(key, place.alias("ordinal"), F.col("w.text").alias("raw_text"), box_polygon(b).alias("polygon"), F.col("w.confidence").alias("confidence"), (F.col("w.confidence") < 60).alias("low_score"))


def mean_confidence(words: DataFrame, key: str) -> DataFrame:
    """A diagnostic; confidences of different engines are never put together."""
    return words.groupBy(key).agg(F.avg("confidence").alias("mean_confidence"), F.count("confidence").alias("words"))


def glyph_runs(chars: DataFrame, by: list[str]) -> DataFrame:
    """Characters (by, n, char, box) into runs: a line end, a space or another box ends one."""
    line = Window.partitionBy(*by).orderBy("n")
    before = F.lag(F.struct("char", "box")).over(line)
    fresh = before.isNull() | before["char"].isin("\r", "\n", " ") | (before["box"] != F.col("box"))
    rows = chars.withColumn("run", F.sum(fresh.cast("int")).over(line)).where(~F.col("char").isin("\r", "\n", " "))
    out = rows.groupBy(*by, "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "char"))), lambda c: c["char"]), "").alias("raw_text"), F.min("n").alias("_n"), F.first("box").alias("box"))
    return out.withColumn("ordinal", F.row_number().over(Window.partitionBy(*by).orderBy("_n")) - 1).drop("_n", "run")


_TOKEN = re.compile(r"\((?:[^()\\]|\\.)*\)|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+\d?")


def stream_operations(text: str) -> list[dict]:
    """Rectangles and texts that a page's content stream paints, in order, with fill and render mode at that point."""
    out: list[dict] = []
    operands: list = []
    state = {"fill": (0.0, 0.0, 0.0), "mode": 0}
    saved: list[dict] = []
    rects: list[tuple] = []
    for token in _TOKEN.findall(text):
        c = token[0]
        if c.isdigit() or c in "+-.":
            operands.append(float(token))
            continue
        if c in "(/[]":
            if c not in "[]":
                operands.append(token[1:-1] if c == "(" else token)
            continue
        numbers = [x for x in operands if isinstance(x, float)]
        if token == "q":
            saved.append(dict(state))
        elif token == "Q" and saved:
            state = saved.pop()
        elif token == "rg" and len(numbers) >= 3:
            state["fill"] = tuple(numbers[-3:])
        elif token == "g" and numbers:
            state["fill"] = (numbers[-1],) * 3
        elif token == "Tr" and numbers:
            state["mode"] = int(numbers[-1])
        elif token == "re" and len(numbers) >= 4:
            rects.append(tuple(numbers[-4:]))
        elif token in ("f", "F", "f*", "B", "b", "B*", "b*"):
            out += [{"kind": "rect", "box": [x, y, x + w, y + h], **state} for x, y, w, h in rects]
            rects = []
        elif token in ("n", "S", "s"):
            rects = []
        elif token in ("Tj", "TJ", "'", '"'):
            out.append({"kind": "text", "text": "".join(x for x in operands if isinstance(x, str) and not x.startswith("/")), **state})
        operands = []
    return [{"idx": k, **o} for k, o in enumerate(out)]


def content_stream(rows: DataFrame, key: str, stream: str) -> DataFrame:
    """key, idx, kind, text, fill, mode, box of what content streams (as text) paint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [{key: k, "text": None, "box": None, **o, "fill": list(o["fill"])} for k, s in zip(pdf[key], pdf[stream], strict=True) for o in stream_operations(s or "")]
            if out:
                yield pd.DataFrame(out)[[key, "idx", "kind", "text", "fill", "mode", "box"]]

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, stream).mapInPandas(run, f"{key} {kind}, idx int, kind string, text string, fill array<double>, mode int, box array<double>")


def isolated(rows: DataFrame, read, key: str, content: str) -> DataFrame:
    """key, status, reason, records (JSON) of an outside reader's function on every row: its failure is a row's status,
    never the job's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for pdf in batches:
            out = []
            for k, c in zip(pdf[key], pdf[content], strict=True):
                try:
                    out.append((k, "completed", None, json.dumps(read(c))))
                except TimeoutError as e:
                    out.append((k, "timeout", str(e)[:200] or "timeout", None))
                except Exception as e:  # any reader's failure is that row's outcome
                    out.append((k, "failed", f"{type(e).__name__}: {e}"[:200], None))
            yield pd.DataFrame(out, columns=[key, "status", "reason", "records"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, content).mapInPandas(run, f"{key} {kind}, status string, reason string, records string")


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _LineReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = options["paths"].split(",")

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        import hashlib

        with open(partition.path, "rb") as f:
            raw = f.read()
        sha = hashlib.sha256(raw).hexdigest()
        for n, line in enumerate(raw.decode("utf-8", "replace").split("\n")):
            y = 14.0 * n
            w = 6.0 * max(1, len(line))
            yield sha, 0, "text-lines", f"line_{n}", n, entities.unescape(line) if partition.path.endswith(".html") else line, "exact", [[0.0, y], [w, y], [w, y + 12], [0.0, y + 12]], f"line:{n}"


class ReadingSource(DataSource):
    """spark.read.format("reading").option("paths", "a.txt,b.txt"): a partition for each file that all machines see."""

    @classmethod
    def name(cls) -> str:
        return "reading"

    def schema(self) -> str:
        return OCCURRENCES

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.options)
