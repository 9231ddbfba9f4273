"""Intervals, percentiles and resampling of evaluation figures."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.96
RESAMPLES, SEED = 2000, 0x1A4C


def wilson(successes: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Lower and upper bound of a share; (0, 1) for no trials."""
    k = n.cast("double")
    p = F.try_divide(successes.cast("double"), k)
    middle = (p + F.try_divide(F.lit(z * z), 2 * k)) / (1 + F.try_divide(F.lit(z * z), k))
    inner = F.try_divide(p * (1 - p), k) + F.try_divide(F.lit(z * z), 4 * k * k)
    half = z * F.sqrt(inner) / (1 + F.try_divide(F.lit(z * z), k))
    low = F.when(n <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), middle - half))
    high = F.when(n <= 0, 1.0).otherwise(F.least(F.lit(1.0), middle + half))
    return low, high


def nearest_rank(value: str, q: float) -> Column:
    """The least value that a share q of all values does not exceed: one of the values of the named column."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY `{value}`)")


def linear(value: Column, q: float) -> Column:
    """The percentile between neighbours."""
    return F.percentile(value, F.lit(q))


def quantiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[float, str]], cells: int = 512) -> DataFrame:
    """by, n and the wanted exact quantiles (name: (share, "rank" or "linear")) of a column's values that are not null.

    Bounds near the quantiles deal a group's values into cells, which are counted; only the cells that hold a wanted rank
    are looked into, and there equal values are counted before they are put in order. So no task holds a group, and
    nothing but counts is shuffled. Groups without values have no row; nulls in `by` are a group.
    """
    rows = rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    key = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))
    rows = rows.select(F.to_json(key, {"ignoreNullFields": "false"}).alias("_key"), *by, "_v")
    marks = [k / cells for k in range(1, cells)]
    bounds = rows.groupBy("_key").agg(F.percentile_approx("_v", marks, 4 * cells).alias("_bounds"), F.count(F.lit(1)).alias("n"))
    # the number of bounds below the value, by halving
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(cells.bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda k, s: F.when((k + s <= F.size("_bounds")) & (F.get("_bounds", k + s - 1) < F.col("_v")), k + s).otherwise(k))
    dealt = rows.join(bounds.select("_key", "_bounds"), "_key").withColumn("_cell", below).drop("_bounds")
    counted = dealt.groupBy("_key", "_cell").agg(F.count(F.lit(1)).alias("_in"))
    counted = counted.withColumn("_to", F.sum("_in").over(Window.partitionBy("_key").orderBy("_cell")))
    ranks = []
    for name, (q, kind) in wanted.items():
        place = F.lit(q) * (F.col("n") - 1) + 1 if kind == "linear" else F.greatest(F.lit(1.0), F.ceil(F.lit(q) * F.col("n") - 1e-9).cast("double"))
        for end, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            ranks.append(F.struct(F.lit(name).alias("_name"), F.lit(end).alias("_end"), rank.cast("long").alias("_rank"), (place - F.floor(place)).alias("_part")))
    asked = bounds.select("_key", "n", F.explode(F.array(*ranks)).alias("r")).select("_key", "n", "r.*")
    held = asked.join(counted, "_key").where("_rank > _to - _in AND _rank <= _to").withColumn("_rank", F.col("_rank") - F.col("_to") + F.col("_in"))
    cells_held = held.select("_key", "_cell").distinct()
    values = dealt.join(cells_held, ["_key", "_cell"], "left_semi").groupBy("_key", *by, "_cell", "_v").agg(F.count(F.lit(1)).alias("_c"))
    values = values.withColumn("_upto", F.sum("_c").over(Window.partitionBy("_key", "_cell").orderBy("_v")))
    found = held.join(values, ["_key", "_cell"]).where("_rank > _upto - _c AND _rank <= _upto")
    at = lambda name, end, c: F.max(F.when((F.col("_name") == name) & (F.col("_end") == end), F.col(c)))
    out = [(at(n, "low", "_v") + (at(n, "high", "_v") - at(n, "low", "_v")) * at(n, "low", "_part")).alias(n) for n in wanted]
    return found.groupBy("_key", *by).agg(F.max("n").alias("n"), *out).drop("_key")


def bootstrap(groups: list[tuple[str, float, int]], resamples: int = RESAMPLES, seed: int = SEED, alpha: float = 0.05) -> tuple[float, float]:
    """Percentile interval of a mean over whole groups drawn with replacement. groups: (name, sum, count), any order;
    reduce to these in Spark first. (0, 1) for none."""
    if not groups:
        return 0.0, 1.0
    by = {name: (total, n) for name, total, n in groups}
    names = sorted(by)
    rng = random.Random(seed)
    means = []
    for _ in range(resamples):
        drawn = [by[rng.choice(names)] for _ in names]
        means.append(sum(t for t, _ in drawn) / sum(n for _, n in drawn))
    means.sort()
    return means[int(alpha / 2 * resamples)], means[min(resamples - 1, int((1 - alpha / 2) * resamples) - 1)]
