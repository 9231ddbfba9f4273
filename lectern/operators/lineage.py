"""Which entries of a corpus belong together, and whether its splits keep them so."""

from __future__ import annotations

import random
import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpoint(df: DataFrame) -> DataFrame:
    """df, checkpointed in the folder that the session names; a local one where all runs on this machine."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lectern-"))
    return df.checkpoint()


def shared_keys(entries: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Edges (a, b) between each entry and the least one with the same value of a column: as many as entries, however
    many share a value."""
    out = None
    for c in columns:
        least = entries.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(key).alias("a"))
        edges = entries.select(F.col(key).alias("b"), c).join(least, c).where("a != b").select("a", "b")
        out = edges if out is None else out.unionByName(edges)
    return out


def components(vertices: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """key, root: the least key of its component, for every vertex. Rounds of least labels of neighbours and of the
    label's own label; each round is checkpointed."""
    both = checkpoint(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct())
    now = checkpoint(vertices.select(F.col(key).alias("v"), F.col(key).alias("root")).distinct())
    while True:
        heard = both.join(now, F.col("a") == F.col("v")).groupBy("b").agg(F.min("root").alias("heard"))
        step = now.join(heard, F.col("v") == F.col("b"), "left").select("v", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        step = checkpoint(step)
        up = step.select(F.col("v").alias("up"), F.col("root").alias("top"))
        after = checkpoint(step.join(up, F.col("root") == F.col("up"), "left").select("v", "old", F.coalesce("top", "root").alias("root")))
        now = after.select("v", "root")
        if after.where("old != root").isEmpty():
            return now.withColumnRenamed("v", key)


def split_leaks(entries: DataFrame, roots: DataFrame, key: str, split: str) -> DataFrame:
    """root, splits, entries of components that lie in several splits."""
    each = entries.join(roots, key).groupBy("root").agg(F.count_distinct(split).alias("splits"), F.count(F.lit(1)).alias("entries"))
    return each.where("splits > 1")


def assign_grouped(roots: DataFrame, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """root, split: whole components by a hash, so that an entry's split never depends on the other entries."""
    place = F.pmod(F.xxhash64(F.col("root").cast("string"), F.lit(seed)), F.lit(1_000_000)) / F.lit(1e6)
    out, upto = None, 0.0
    for name, share in shares.items():
        upto += share
        out = F.when(place < upto, name) if out is None else out.when(place < upto, name)
    return roots.select("root").distinct().withColumn("split", out.otherwise(list(shares)[-1]))


def assign_naive(keys: list[str], shares: dict[str, float], seed: int) -> dict[str, str]:
    """Entry by entry, as a counterexample: what belongs together may part."""
    rng = random.Random(seed)
    order = sorted(keys)
    rng.shuffle(order)
    out, at = {}, 0
    for k, (name, share) in enumerate(shares.items()):
        end = len(order) if k == len(shares) - 1 else at + round(share * len(order))
        out.update(dict.fromkeys(order[at:end], name))
        at = end
    return out


def incremental(jobs: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs (key, config_digest) to run, and conflicts: keys that were done under another configuration. done: key,
    config_digest, status; only completed ones are taken over."""
    ok = done.where("status = 'completed'").select("key", "config_digest").distinct()
    conflicts = jobs.join(ok.withColumnRenamed("config_digest", "was"), "key").where("was != config_digest")
    return jobs.join(ok, ["key", "config_digest"], "left_anti"), conflicts
