"""Document fingerprints by bin-wise consistent weighted sampling, in DataFrame functions only.

A term is five words in a row, its weight the number of times it occurs. A weight is dealt out in units: the k-th unit
of a term has a hash of its own, the same in every text that has the term k times or more. The least and the greatest
of two weights are the numbers of units that both texts and either of them have, so generalised Jaccard similarity is
that of the units. By its hash every unit falls into one of BINS bins, and in a bin gamma-based consistent weighted
sampling draws for each unit r and c from Gamma(2, 1) and b from the unit interval:

    t = floor(ln(weight) / r + b),  ln y = r * (t - b),  ln a = ln(c) - ln y - r

and keeps the unit of least a. A unit's weight is 1, so t is 0. Units weigh alike, hence a bin's two samples are equal
with the probability that a unit of either text, drawn evenly, is in both; and the share of equal samples among the
bins that either text fills is generalised Jaccard similarity in the mean, whatever the bins weigh. That does not hold
where whole weights are drawn, for then a bin with a heavy term counts as much as one with a light term.

All work on a text stays in its row: term hashes are sorted, runs counted, draws packed into longs as (bin, ln a, mark)
and sorted again, so the first of each bin is its sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import SHINGLE_WORDS, split_words, table

BINS = 128
#: Rows between two cuts of the order of ids, and the most cuts; each piece between two is put in order by itself.
PIECE_ROWS, CUTS = 1000, 1 << 16


def _halves(h: Column) -> tuple[Column, Column]:
    """Two numbers in (0, 1) from a hash."""
    low = h.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double")
    return (F.shiftrightunsigned(h, 32).cast("double") + 0.5) * F.lit(2.0**-32), (low + 0.5) * F.lit(2.0**-32)


def _draw(h: Column) -> Column:
    """(bin, ln a, mark) of a unit in one long: 7 bits, 33 bits, 24 bits of its hash."""
    one, two = _halves(F.xxhash64(h))
    three, four = _halves(F.xxhash64(h, F.lit(1)))
    r, c = -F.log(one * two), -F.log(three * four)
    b = (F.shiftrightunsigned(h, 24).bitwiseAND(F.lit((1 << 32) - 1)).cast("double") + 0.5) * F.lit(2.0**-32)
    ln_a = F.log(c) - r * (1 - b)  # from about -45 to 4
    level = ((ln_a + 100.0) * F.lit(2.0**25)).cast("long")
    head = F.shiftrightunsigned(h, 57)
    return F.shiftleft(head, 57).bitwiseOR(F.shiftleft(level, 24)).bitwiseOR(h.bitwiseAND(F.lit((1 << 24) - 1)))


def samples(text: str, df: DataFrame, out: str, n: int = SHINGLE_WORDS) -> DataFrame:
    """df with `out`: the text's samples, an array of at most BINS longs whose upper 7 bits are the bin. Empty for no
    words; a text of fewer than n words has one term, all of them."""
    w, h = f"_{out}_w", f"_{out}_h"
    df = split_words(df, text, w)
    ws, size = F.col(w), F.size(F.col(w))
    each = F.transform(
        F.sequence(F.lit(1), size - (n - 1)), lambda i: F.xxhash64(*[F.get(ws, i + (k - 1)) for k in range(n)])
    )
    none = F.array().cast("array<bigint>")
    df = df.withColumn(h, F.when(size >= n, F.sort_array(each)).when(size > 0, F.array(F.xxhash64(F.array_join(ws, " ")))).otherwise(none))
    hs = F.col(h)
    # only texts that repeat themselves have terms of several units: their hashes are told apart by their place in the run
    again = F.exists(F.sequence(F.lit(1), F.greatest(F.size(hs) - 1, F.lit(1))), lambda i: F.coalesce(F.get(hs, i) == F.get(hs, i - 1), F.lit(False)))
    starts = F.filter(F.sequence(F.lit(0), F.size(hs) - 1), lambda i: (i == 0) | (F.get(hs, i) != F.get(hs, i - 1)))
    runs = F.struct(starts.alias("at"))

    def units(p: Column, j: Column, at: Column) -> Column:
        last = F.coalesce(F.get(at, j + 1), F.size(hs)) - 1
        return F.transform(F.sequence(p, last), lambda i: F.when(i == p, F.get(hs, p)).otherwise(F.xxhash64(F.get(hs, p), i - p)))

    df = df.withColumn(f"_{out}_r", F.when(again, runs)).withColumn(
        h, F.when(again, F.flatten(F.transform(F.col(f"_{out}_r.at"), lambda p, j: units(p, j, F.col(f"_{out}_r.at"))))).otherwise(hs)
    )
    df = df.withColumn(out, F.sort_array(F.transform(F.col(h), _draw)))
    got = F.col(out)
    bin_of = lambda x: F.shiftright(x, 57)
    df = df.withColumn(out, F.filter(got, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(got, i - 1)))))
    return df.drop(w, h, f"_{out}_r")


def fingerprint(samples: Column) -> Column:
    """The samples as text: for each filled bin, bin and mark in 8 hex digits."""
    own = F.transform(
        samples,
        lambda x: F.lpad(
            F.lower(F.hex(F.shiftleft(F.shiftrightunsigned(x, 57), 24).bitwiseOR(x.bitwiseAND(F.lit((1 << 24) - 1))))), 8, "0"
        ),
    )
    return F.array_join(own, "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples among bins that a or b fills; 1 for two empty fingerprints."""
    marks = lambda s: F.transform(
        s, lambda x: F.shiftleft(F.shiftrightunsigned(x, 57), 24).bitwiseOR(x.bitwiseAND(F.lit((1 << 24) - 1)))
    )
    bins = lambda s: F.transform(s, lambda x: F.shiftrightunsigned(x, 57))
    equal = F.size(F.array_intersect(marks(a), marks(b)))
    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, 1.0).otherwise(equal / F.greatest(filled, F.lit(1))).cast("double")


def _pieces(ids: DataFrame) -> list[int]:
    """Ids that part all ids evenly, ascending, one for PIECE_ROWS rows but CUTS at most; the greatest id is the last."""
    n = min(CUTS, max(1, -(-ids.count() // PIECE_ROWS), ids.sparkSession.sparkContext.defaultParallelism))
    found = ids.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n + 1)], 4 * n).alias("p"), F.max("doc_id").alias("top")).first()
    return sorted({*(found["p"] or []), *([found["top"]] if found["top"] is not None else [])})


def _ordered(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with piece and ghost, dealt out so that within a piece the order of ids shows every
    row's successor. Pieces are cut at ids of the data; a piece holds the ids over one bound up to the next, and the
    rows at its lower bound once more as ghosts, as the lowest piece does with the greatest id (null ids are lowest).
    """
    bounds = _pieces(docs.select("doc_id"))
    n = len(bounds)
    marks = F.array(*[F.lit(b).cast("long") for b in bounds]).cast("array<bigint>")
    # the number of bounds below the id, by halving
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, n.bit_length())))])
    below = F.aggregate(
        steps, F.lit(0), lambda k, s: F.when((k + s <= n) & (F.get(marks, k + s - 1) < F.col("doc_id")), k + s).otherwise(k)
    )
    piece = F.coalesce(F.when(F.col("doc_id").isNull(), 0).otherwise(below), F.lit(0))
    docs = docs.withColumn("piece", piece)
    above = F.when(F.col("doc_id") == F.lit(bounds[-1] if n else 0), 0).when(
        F.col("doc_id") == F.get(marks, F.col("piece")), F.col("piece") + 1
    )
    if not n:  # no id at all: one row follows another by text, and the first of all follows the last
        above = F.lit(0)
    places = F.array(F.struct(F.col("piece").alias("piece"), F.lit(False).alias("ghost")), F.struct(above.alias("piece"), F.lit(True).alias("ghost")))
    places = F.filter(places, lambda x: x["piece"].isNotNull())
    docs = docs.withColumn("place", F.explode(places)).select(*[c for c in docs.columns if c != "piece"], "place.piece", "place.ghost")
    return docs.repartition("piece")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The edited text is the text with its last floor(n/2) code points replaced by as many (or all) from the start of
    the next document in descending doc_id; the last document's next is the first, a document alone is its own next.
    near_edited and near_next are the fingerprint's likeness to the edited text's and the next document's. Null texts
    are empty; an empty text has the fingerprint "" and likeness 1 to another. Rows with equal ids follow one another
    by text, equal rows are alike anyway; rows without id come after all others, as if they had the lowest. Other
    columns are left out. One shuffle, of texts with their samples; long texts stay single values in one row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = Window.partitionBy("piece").orderBy(F.col("ghost"), F.col("doc_id").desc_nulls_last(), "text")
    rows = _ordered(samples("text", docs, "own"))
    follow = F.lead(F.struct("text", "own")).over(own)
    rows = rows.withColumn("follow", follow).where(~F.col("ghost")).drop("piece", "ghost")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.left(F.col("follow.text"), half))
    rows = rows.withColumn("edited", edited)
    rows = samples("edited", rows, "new")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"),
        likeness(F.col("own"), F.col("follow.own")).alias("near_next"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
