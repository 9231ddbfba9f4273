"""N-gram Jaccard self-join by MinHash banding, verified on full n-gram sets.

1. A text's n-gram set is its distinct 64-bit hashes of n words in a row. Texts with equal sets form a class; only the
   class's smallest id goes on, with the number of its copies.
2. MinHash values are dealt into bands; rows and bands are chosen for a target recall at the threshold (choose_bands).
   Equal band hashes meet in a bucket. A count of each bucket drops those with one member before any set moves, and
   buckets with the same members keep one of them where that loses no pair.
3. A bucket of over BLOCK members is dealt into blocks by a hash of the member, and each pair of blocks is a group of
   its own, so no task sees more than two blocks at once. Within a group numpy finds the pairs whose first common band
   is this one, so each pair is verified once, on full sets; pairs never become rows. A group gives, for each member,
   its number of links, and edges of a spanning forest.
4. Components of the forest by label propagation, a constant number of small columns a round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import LEAST_SIMILARITY, SHINGLE_WORDS, cut, fresh, map_chunks, relax, table, words

RECALL = 0.999
BLOCK = 400
#: Sets that a task verifies, about, and the most tasks.
PART_ROWS, MOST_PARTS = 4000, 200_000
#: Ids that are sent to every task at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000
_SEED = np.random.RandomState(7)
_MULT = _SEED.randint(1, 2**31, size=1024).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _SEED.randint(0, 2**31, size=1024).astype(np.uint32)


def choose_bands(least: float = LEAST_SIMILARITY, recall: float = RECALL, far: float = 0.5, most: int = 160) -> tuple[int, int]:
    """(rows, bands): the target recall at similarity `least`, and fewest chance meetings at `far`, in `most` values."""
    best = None
    for rows in range(1, 33):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(least**rows) if least**rows < 1 else -1 + 1e-12)))
        if rows * bands <= most:
            best = min(best or (2.0, 0, 0), (1 - (1 - far**rows) ** bands, rows, bands))
    if best is None:
        raise ValueError(f"{most} values cannot give recall {recall} at {least}")
    return best[1], best[2]


def shingle_hashes(ws: list[bytes], n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of n words in a row; of all words where there are fewer, none for none."""
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    n = min(n, len(h))
    z = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        z ^= z >> np.uint64(31)
        z *= np.uint64(0x9E3779B97F4A7C15)
        z += h[k : len(h) - n + 1 + k]
    z ^= z >> np.uint64(29)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(32)
    return np.unique(z)


def band_hashes(shingles: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit hash for each band of MinHash values."""
    k = rows * bands
    low = np.full(k, 0xFFFFFFFF, dtype=np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    x ^= x >> np.uint32(15)
    for i in range(0, len(x), 2048):
        part = x[i : i + 2048, None] * _MULT[:k]
        part += _PLUS[:k]
        np.minimum(low, part.min(axis=0), out=low)
    out = np.full(bands, 0x2545F4914F6CDD1D, dtype=np.uint64)
    for r in range(rows):
        out ^= low.reshape(bands, rows)[:, r].astype(np.uint64)
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _texts(docs: DataFrame, n: int, bands: tuple[int, int] | None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text_hash (of the n-gram set; null for no words), band hashes, or without bands the set itself, and the
    columns in carry."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, own = [], []
        for t in batch.column("text").to_pylist():
            s = shingle_hashes(words(t), n)
            keys.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
            got = s if bands is None else band_hashes(s, *bands) if len(s) else s
            own.append(got.astype(np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(keys, pa.string()), pa.array(own, pa.list_(pa.int64())), *[batch.column(c) for c in carry]],
            ["doc_id", "text_hash", "hashes", *carry],
        )

    kind = lambda c: docs.schema[c].dataType.simpleString()
    more = "".join(f", `{c}` {kind(c)}" for c in carry)
    return map_chunks(docs.select("doc_id", "text", *carry), run, f"doc_id {kind('doc_id')}, text_hash string, hashes array<long>{more}")


def _verify(signs: np.ndarray, sets: list[np.ndarray], band: int, side: np.ndarray, alone: bool, least: float):
    """Index pairs (i < j) in different sides (or any, if alone) whose first common band is `band`, linked."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    found = []
    for a in range(len(order) - 1):
        i = order[a]
        rest = order[a + 1 :]
        rest = rest[size[i] >= least * size[rest]]  # a larger set beyond this cannot be similar enough
        if not alone:
            rest = rest[side[rest] != side[i]]
        if band and len(rest):
            rest = rest[~(signs[rest, :band] == signs[i, :band]).any(axis=1)]
        if not len(rest):
            continue
        other = np.concatenate([sets[j] for j in rest])
        at = np.searchsorted(sets[i], other)
        at[at == size[i]] = 0
        same = np.add.reduceat((sets[i][at] == other).astype(np.int64), np.concatenate(([0], np.cumsum(size[rest])[:-1])))
        ok = same >= least * (size[i] + size[rest] - same) - 1e-9
        found += [(i, j) for j in rest[ok].tolist()]
    return found


def _forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for i, j in pairs:
        a, b = top(i), top(j)
        if a != b:
            up[b] = a
            out.append((i, j))
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows with equal keys, which come one after another, over batches' ends: (rep, signs, set, salt)."""
    held: list[tuple] = []
    key = None
    for batch in batches:
        keys = zip(*[batch.column(c).to_pylist() for c in ("band", "bucket", "i", "j")], strict=True)
        ids, side = batch.column("rep").to_pylist(), batch.column("salt").to_pylist()
        signs, sets = batch.column("signs"), batch.column("shingles")
        for k, own in enumerate(keys):
            if own != key:
                if held:
                    yield key, held
                held, key = [], own
            held.append((ids[k], signs[k].values.to_numpy(), sets[k].values.to_numpy().view(np.uint64), side[k]))
    if held:
        yield key, held


def _sets(docs: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """text_hash and n-gram set of the needed classes, and of other texts with their ids. needed: text_id. Few ids are
    sent to the documents, whose texts stay where they are; many are joined."""
    ids = needed.select(F.col("text_id").alias("own"))
    ids = F.broadcast(ids) if needed.count() <= BROADCAST_IDS else ids.hint("merge")
    kept = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("own")), "left_semi")
    sets = _texts(kept, n, None).where("text_hash IS NOT NULL").select("text_hash", "hashes")
    return sets.groupBy("text_hash").agg(F.first("hashes").alias("shingles"))


def components(edges: DataFrame) -> DataFrame:
    """v and label (the component's smallest vertex) for every vertex of edges (a, b), in rounds: each vertex takes the
    least label among its neighbours', then its label's label. Every round's table is written, so joins with a vertex
    of very many edges can be split and a lost executor costs no more than a round."""
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")), "labels")
    while True:
        heard = both.join(now, F.col("a") == F.col("v")).groupBy("b").agg(F.min("label").alias("m"))
        taken = cut(now.join(heard, F.col("v") == F.col("b")).select("v", F.col("label").alias("old"), F.least("label", "m").alias("label")), "labels")
        up = taken.select(F.col("v").alias("up"), F.col("label").alias("top"))
        after = cut(taken.join(up, F.col("label") == F.col("up")).select("v", "old", F.col("top").alias("label")), "labels")
        now = after.select("v", "label")
        if after.where("old != label").isEmpty():
            return now


def links(
    docs: DataFrame,
    *,
    n: int = SHINGLE_WORDS,
    least: float = LEAST_SIMILARITY,
    recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """One row for each row of docs: doc_id, text_id, class_id, n_copies, n_links.

    text_id is the smallest doc_id with an equal n-gram set, n_copies the number of rows with it; n_links counts other
    sets at Jaccard similarity `least` or more (copies not expanded); class_id is the smallest doc_id in the row's
    connected component of copies and links. Texts without words (null, empty, signs only) are each their own class;
    texts of fewer than n words are one n-gram. Rows with a null doc_id are compared by text like others and name a
    class only where no id does. Other columns, whatever their names, are left out; an empty table gives no rows.
    Recall at `least` is `recall` by the choice of bands, higher above it; what is linked is exact on full sets.
    """
    return _linked(docs, (), n, least, recall, block).drop("component")


def _linked(docs: DataFrame, carry: tuple[str, ...], n: int, least: float, recall: float, block: int) -> DataFrame:
    """links(docs) with the columns in carry and `component`, a number of the row's class; null for texts without words."""
    rows_bands = choose_bands(least, recall)
    parts = max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every = cut(_texts(docs, n, rows_bands, carry), "texts")
    worded = every.where("text_hash IS NOT NULL")
    classes = worded.groupBy("text_hash").agg(F.min("doc_id").alias("text_id"), F.count(F.lit(1)).alias("n_copies"), F.first("hashes").alias("signs"))
    # a number of its own for each class, fixed once written; the text's hash has 128 bits
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")

    signs = classes.select("rep", F.posexplode("signs").alias("band", "bucket"))
    meet = cut(signs.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").drop("size"), "meet")
    sized = cut(signs.join(meet, ["band", "bucket"]), "buckets")
    count = sized.groupBy("band", "bucket").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")
    )
    # Of buckets with the same members the one of the lowest band stays. It is the first common band of every pair in
    # it for which any of them is, so no pair is lost.
    first = count.groupBy("size", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("b"))
    first = cut(first.select("b.band", "b.bucket", "size"), "first")
    dealt = sized.join(first, ["band", "bucket"]).withColumn("blocks", F.ceil(F.col("size") / F.lit(block)).cast("int"))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("rep", "band"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("rep", "band", "bucket", "salt", F.least("salt", "with").alias("i"), F.greatest("salt", "with").alias("j"))
    dealt = cut(dealt, "dealt")
    needed = cut(classes.select("rep", "text_hash", "text_id", "signs").join(dealt.select("rep").distinct(), "rep", "left_semi"), "needed")
    sets = _sets(docs, needed.select("text_id"), n).join(needed.select("text_hash", "rep", "signs"), "text_hash").drop("text_hash")
    parts = min(MOST_PARTS, max(parts, dealt.count() // PART_ROWS))
    keys = ["band", "bucket", "i", "j"]
    groups = dealt.join(sets, "rep").repartition(parts, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["rep", "n_links", "other"])

        for (band, _, i, j), held in _groups(batches):
            if len(held) < 2:
                continue
            ids = [h[0] for h in held]
            side = np.array([h[3] for h in held])
            found = _verify(np.array([h[1] for h in held]), [h[2] for h in held], band, side, i == j, least)
            degree = np.bincount(np.array(found, dtype=np.int64).ravel(), minlength=len(ids))
            out += [(ids[k], int(degree[k]), None) for k in np.flatnonzero(degree).tolist()]
            out += [(ids[a], 0, ids[b]) for a, b in _forest(found)]
            if len(out) > 10_000:
                yield flush()
        if out:
            yield flush()
        relax()

    verified = cut(groups.mapInArrow(run, "rep long, n_links long, other long"), "links")
    degree = verified.groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    labels = components(verified.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    linked = cut(classes.drop("signs").join(degree, "rep").join(labels.withColumnRenamed("v", "rep"), "rep"), "linked")
    ids = cut(linked.groupBy("label").agg(F.min("text_id").alias("class_id")), "ids")
    linked = linked.join(ids, "label").select("rep", "class_id", "n_links", "label")
    named = classes.drop("signs").join(linked, "rep", "left").select(
        "text_hash", "text_id", F.coalesce("class_id", "text_id").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("label", "rep").alias("component")
    )
    full = worded.select("doc_id", "text_hash", *carry).join(cut(named, "named"), "text_hash").drop("text_hash")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    own = F.col("doc_id")
    bare = every.where("text_hash IS NULL").select(
        own, *carry, own.alias("text_id"), own.alias("class_id"), one.alias("n_copies"), none.alias("n_links"), F.lit(None).cast("long").alias("component")
    )
    return full.unionByName(bare)


def _numbered(docs: DataFrame, key: str) -> DataFrame:
    """docs with a key of each row that stays the same however often it is read: the row's file (64 bits of a hash) and
    its number there if docs is a table of Parquet files just as read, and otherwise a number in a written copy."""
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and "_metadata" not in docs.columns:
        about = docs.metadataColumn("_metadata")
        if "row_index" in docs.select(about).schema[0].dataType.fieldNames():
            return docs.withColumn(key, F.struct(F.xxhash64(about["file_path"]).alias("file"), about["row_index"].alias("row")))
    return cut(docs.withColumn(key, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))), "rows")


def first_of_each(docs: DataFrame, *, repeats: bool = True, n: int = SHINGLE_WORDS, least: float = LEAST_SIMILARITY, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """docs without the members of a class other than the one that names it. Rows without words stay.

    With repeats, all rows of the class that have its id stay, and those without doc_id; without, one row of each class
    does, of the smallest id if there is one. Rows are told apart by a key of their own, so an id's other rows stay where
    one of them is a copy."""
    key, out = fresh(docs, "_row"), fresh(docs, "_gone")
    rows = _numbered(docs, key)
    found = _linked(rows, (key,), n, least, recall, block).where("component IS NOT NULL")
    found = cut(found.select(F.col(key).alias("row"), "doc_id", "class_id", "component"), "found")
    if repeats:
        gone = found.where("doc_id != class_id").select("row")
    else:
        first = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "row")).alias("first")
        kept = cut(found.groupBy("component").agg(first).select("first.row"), "kept")
        gone = found.select("row").join(kept, "row", "left_anti")
    gone = cut(gone.select(F.col("row").alias(out)), "gone")
    few = gone.count() <= BROADCAST_IDS
    left = rows.join(F.broadcast(gone) if few else gone, F.col(key) == F.col(out), "left_anti")
    return left.select(*[f"`{c}`" for c in docs.columns])


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: five words in a row, similarity 0.8 or more."""
    return links(table(spark, sf_dir, "documents"))
