"""Reading records derived from the general tables, by rules that SQL can say too: see the views of the same names in
lectern.plans.sql."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.geometry import box


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_key(doc_id) -> F.Column:
    return F.concat_ws(":", F.col(doc_id).cast("string"), F.lit("0"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_key, truth, expected_occurrences: toxic rows are the failures to find, other good ones are clean."""
    truth = F.when(F.col("toxic") == 1, "supported_failure").when(F.col("quality") == 1, "clean").otherwise("unsupported")
    rows = table(spark, sf_dir, "labels")
    return rows.select(page_key("doc_id").alias("page_key"), truth.alias("truth"), (F.col("doc_id") % 5).cast("int").alias("expected_occurrences"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading of each document's page but those never tried; a second one of every third."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "text", "n_chars").where("doc_id % 10 != 2")
    rows = rows.withColumn("attempt", F.explode(F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    last = F.col("doc_id") % 10
    status = F.when((last == 0) & (F.col("attempt") == 1), "timeout").when(last == 1, "failed").otherwise("completed")
    digits = F.col("text").rlike("[0-9]")
    finding = F.when(digits, F.array(F.concat(F.lit("f_"), (F.col("doc_id") % 7).cast("string")))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        page_key("doc_id").alias("page_key"), F.concat_ws("_", F.lit("check"), F.col("doc_id").cast("string")).alias("check_id"), "attempt", status.alias("status"),
        F.when(digits, "useful_finding").alias("resolution"), finding.alias("finding_ids"), (F.col("n_chars") % 5).cast("int").alias("occurrence_count"),
        F.array((F.col("n_chars") % 40).cast("double") / 10, (F.col("doc_id") % 30).cast("double") / 10).alias("errors"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of reader A: every line of every document, in three columns on one page.

    doc_id, ordinal, raw_text, x0, y0, x1, y1."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "raw_text"))
    column, row = F.col("ordinal") % 3, F.floor(F.col("ordinal") / 3)
    x, y = 72.0 + column * 180.0, 60.0 + row * 14.0
    return rows.withColumns({"x0": x, "y0": y, "x1": x + 6.0 * F.least(F.char_length("raw_text"), F.lit(25)), "y1": y + 10.0 + column})


def lines_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of reader B: A's, without every seventh, with 1 read as 7, one point to the right."""
    rows = lines(spark, sf_dir).where("ordinal % 7 != 6")
    return rows.withColumns({"raw_text": F.replace("raw_text", F.lit("1"), F.lit("7")), "x0": F.col("x0") + 1.0, "x1": F.col("x1") + 1.0})


def records(rows: DataFrame, prefix: str) -> DataFrame:
    """Lines as records for alignment."""
    from lectern.functions.geometry import box_polygon
    from lectern.functions.text import normalize

    b = box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    named = F.concat(F.lit(prefix), F.col("ordinal").cast("string"))
    precision = F.when(F.col("raw_text") == "", "unknown").otherwise("exact")
    return rows.select("doc_id", F.lit(0).alias("page_index"), named.alias("id"), "ordinal", normalize(F.col("raw_text")).alias("text"), box_polygon(b).alias("polygon"), precision.alias("precision"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page objects of each order: its line items as boxes in painting order; every fourth is text."""
    rows = table(spark, sf_dir, "lineitem")
    x, y = (F.col("l_partkey") % 50).cast("double") * 4, (F.col("l_suppkey") % 25).cast("double") * 8
    return rows.select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("idx"), F.when(F.col("l_linenumber") % 4 == 1, "text").otherwise("path").alias("kind"),
        x.alias("x0"), y.alias("y0"), (x + 20.0 + F.col("l_quantity")).alias("x1"), (y + 10.0 + F.col("l_quantity") / 2).alias("y1"),
    )


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of each order's run: its line items, with the status that their flags say."""
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_linestatus") == "O", "timeout").otherwise("completed")
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("run"), F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("check_id"), status.alias("status"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worker messages: a job for each user, numbers that sometimes fall behind, an error as the end of a job."""
    rows = table(spark, sf_dir, "events")
    seq = F.col("event_id") - F.when(F.col("event_id") % 11 == 3, 500).otherwise(0)
    return rows.select(
        F.col("event_id").alias("arrival"), F.concat(F.lit("job_"), F.col("user_id").cast("string")).alias("job_id"), seq.alias("seq"),
        F.when(F.col("event_id") % 13 == 0, 1).otherwise(2).alias("generation"), F.when(F.col("event_id") % 17 == 0, "old").otherwise("run").alias("run_key"),
        (F.col("event_type") == "error").alias("terminal"), "event_type", F.col("value"),
    )
