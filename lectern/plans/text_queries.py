"""Text queries: normalisation, tokens, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import coverage as C
from lectern.operators import lineage as L
from lectern.plans import adapters as A
from lectern.plans import sql as S
from lectern.plans.registry import query


@query(f"""SELECT doc_id, sha256(regexp_replace(text, '{S.SPACE}+', ' ', 'g')) AS digest, CAST(length(regexp_replace(text, '{S.SPACE}+', ' ', 'g')) AS BIGINT) AS n FROM documents""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = X.normalize(F.col("text"))
    return A.table(spark, sf_dir, "documents").select("doc_id", F.sha2(new, 256).alias("digest"), F.char_length(new).cast("long").alias("n"))


@query(f"""SELECT doc_id, CAST(len(regexp_extract_all(text, '{S.SPACE}+')) AS BIGINT) AS white_runs FROM documents""")
def whitespace_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = X.runs(F.col("text"))
    white = F.filter(runs, lambda r: r.rlike(r"^\s") | r.rlike(f"^{X._SPACE}"))
    return A.table(spark, sf_dir, "documents").select("doc_id", F.size(white).cast("long").alias("white_runs"))


@query(S.with_(S.LINES, select="SELECT doc_id, ordinal, true AS contiguous, true AS round_trip FROM lines_a").replace("SELECT doc_id, ordinal, true", "SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, true"))
def map_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line's map covers both texts, and its middle goes back to where it came from."""
    rows = A.lines(spark, sf_dir).select("doc_id", "ordinal", "raw_text")
    rows = rows.withColumn("new", X.normalize(F.col("raw_text")))
    rows = rows.withColumn("map", X.check_map(F.col("raw_text"), F.col("new"), F.lit(0), F.char_length("new")))
    there = F.substring(F.col("raw_text"), F.col("map.raw_start") + 1, F.col("map.raw_end") - F.col("map.raw_start"))
    same = F.when(F.char_length("new") == 0, True).otherwise(there == F.col("raw_text"))
    return rows.select("doc_id", "ordinal", F.col("map.contiguous").alias("contiguous"), same.alias("round_trip"))


_TOKENS = r"""
pairs AS (SELECT a.doc_id, a.ordinal, a.raw_text AS a, b.raw_text AS b FROM lines_a a JOIN lines_b b USING (doc_id, ordinal)),
toks AS (SELECT *, regexp_split_to_array(a, '\s+') AS ta, regexp_split_to_array(b, '\s+') AS tb FROM pairs)"""


@query(
    S.with_(
        S.LINES,
        _TOKENS,
        select=r"""SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, a <> b AND len(list_filter(list_concat(list_filter(ta, lambda x: NOT list_contains(tb, x)), list_filter(tb, lambda x: NOT list_contains(ta, x))),
          lambda y: regexp_matches(y, '[$€£¥₹\d+-]'))) > 0 AS material FROM toks""",
    )
)
def material_token_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = A.lines(spark, sf_dir), A.lines_again(spark, sf_dir)
    both = a.select("doc_id", "ordinal", F.col("raw_text").alias("a")).join(b.select("doc_id", "ordinal", F.col("raw_text").alias("b")), ["doc_id", "ordinal"])
    return both.select("doc_id", "ordinal", X.material_token_difference(F.col("a"), F.col("b")).alias("material"))


#: DuckDB's levenshtein counts bytes, so the tables' letters beyond ASCII each become one byte of their own.
_BYTES = "'ÄÇÈÉÊÑÖÜßäçèéêíñóöü', concat(" + ", ".join(f"chr({k})" for k in [*range(1, 10), *range(11, 21)]) + ")"


@query(
    f"""WITH t AS (SELECT item_id, translate(text, {_BYTES}) AS text FROM benchmark),
    p AS (SELECT a.item_id AS a_id, b.item_id AS b_id, a.text AS a, b.text AS b FROM t a JOIN t b ON b.item_id = a.item_id + 1)
    SELECT a_id, b_id, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 0 ELSE least(1, levenshtein(a, b)::DOUBLE / greatest(length(a), length(b))) END, 6) AS distance FROM p"""
)
def text_distance_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring benchmark items' whole texts."""
    rows = A.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("t"))
    a, b = rows.select(F.col("item_id").alias("a_id"), F.col("t").alias("a")), rows.select(F.col("item_id").alias("b_id"), F.col("t").alias("b"))
    both = a.join(b, F.col("b_id") == F.col("a_id") + 1)
    return both.select("a_id", "b_id", F.round(X.plain_distance(F.col("a"), F.col("b")), 6).alias("distance"))


@query()
def text_distance_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two readers' lines that differ, with changes of digits and signs at double cost."""
    a, b = A.lines(spark, sf_dir), A.lines_again(spark, sf_dir)
    both = a.select("doc_id", "ordinal", F.col("raw_text").alias("a")).join(b.select("doc_id", "ordinal", F.col("raw_text").alias("b")), ["doc_id", "ordinal"]).where("a != b")
    return both.select("doc_id", "ordinal", F.round(X.distance(F.col("a"), F.col("b")), 6).alias("distance"))


@query(
    r"""SELECT conv_id, regexp_replace(string_agg(regexp_replace(text, '\s+', ' ', 'g'), ' ' ORDER BY turn), '^\s+|\s+$', '', 'g') AS text FROM conversations GROUP BY conv_id"""
)
def group_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "conversations")
    own = F.collect_list(F.struct(F.col("turn").alias("ordinal"), F.regexp_replace("text", r"\s+", " ").alias("text")))
    return rows.groupBy("conv_id").agg(X.group_text(own).alias("text"))


@query("SELECT md5(text) AS k, min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY md5(text)")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("k"))
    first = C.first_wins(rows, ["k"], ["doc_id"])
    return first.join(rows.groupBy("k").agg(F.count(F.lit(1)).alias("copies")), "k").select("k", "doc_id", "copies")


@query("""SELECT doc_id, row_number() OVER w - 1 AS sibling, count(*) OVER (PARTITION BY md5(text), lang) AS siblings FROM documents WINDOW w AS (PARTITION BY md5(text), lang ORDER BY doc_id)""")
def sibling_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("k"))
    line = Window.partitionBy("k", "lang")
    place = F.row_number().over(line.orderBy("doc_id")).cast("long") - 1
    return rows.select("doc_id", place.alias("sibling"), F.count(F.lit(1)).over(line).alias("siblings"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS root FROM documents")
def lineage_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with equal text belong together."""
    rows = A.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return L.components(rows, L.shared_keys(rows, "doc_id", ["digest"]), "doc_id")


@query(
    """WITH c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS root, CASE doc_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'development' ELSE 'held_out' END AS split FROM documents)
    SELECT root, count(DISTINCT split) AS splits, count(*) AS entries FROM c GROUP BY root HAVING count(DISTINCT split) > 1"""
)
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    roots = L.components(rows, L.shared_keys(rows, "doc_id", ["digest"]), "doc_id")
    split = F.when(F.col("doc_id") % 3 == 0, "public").when(F.col("doc_id") % 3 == 1, "development").otherwise("held_out")
    return L.split_leaks(rows.withColumn("split", split), roots, "doc_id", "split")


@query("""SELECT doc_id, CASE WHEN length(b) > 0 THEN left(b, 80) ELSE 'document' END AS name FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+', '') AS b FROM documents)""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "documents").select("doc_id", X.safe_name(F.col("text")).alias("name"))


@query("""SELECT item_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS html FROM benchmark""")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "benchmark").select("item_id", X.html_escape(F.col("text")).alias("html"))
