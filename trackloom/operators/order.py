"""Exact order statistics of distributed columns: no task and no aggregation buffer holds all values."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import checkpoint, running_start


def quantiles(df: DataFrame, column, levels, by=None) -> DataFrame:
    """``<by>, n, quantiles``: exact quantiles of the known values of a column, for each group or all rows (then always one row).

    Between two values they are interpolated linearly, as the built-in ``percentile`` does.  Equal values are counted first; the counts are dealt
    out by ranges of (group, value) and their sums carried across, and only the counts that hold a wanted rank are looked at
    further. ``by`` is one column (a struct for several); its nulls are a group.
    """
    levels = [float(q) for q in levels]
    group = F.col(by) if by else F.lit(0)
    counts = df.filter(F.col(column).isNotNull()).groupBy(group.alias("_g"), F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_start(checkpoint(counts), ["_v"], F.col("_n"), "_g")
    totals = placed.groupBy(F.col("_g").alias("_h")).agg(F.sum("_n").alias("_total"))
    placed = placed.join(totals, F.col("_g").eqNullSafe(F.col("_h"))).drop("_h")
    end = F.col("_start") + F.col("_n")
    holds = lambda rank: (rank >= F.col("_start")) & (rank < end)
    place = lambda q: q * (F.col("_total") - 1)
    wanted = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(q).alias("q")) for k, q in enumerate(levels)]), lambda s: holds(F.floor(place(s.q))) | holds(F.ceil(place(s.q))))
    near = placed.withColumn("_w", F.explode(wanted)).select("_g", "_v", "_n", "_start", "_total", F.col("_w.k").alias("k"), place(F.col("_w.q")).alias("_p"))
    low, high = F.floor("_p"), F.ceil("_p")
    near = near.groupBy("_g", "k").agg(F.first("_total").alias("n"), F.first("_p").alias("_p"), F.max(F.when(holds(low), F.col("_v"))).cast("double").alias("_low"), F.max(F.when(holds(high), F.col("_v"))).cast("double").alias("_high"))
    value = F.when(low == high, F.col("_low")).otherwise((high - F.col("_p")) * F.col("_low") + (F.col("_p") - low) * F.col("_high"))
    near = near.select("_g", "n", F.struct("k", value.alias("q")).alias("s"))
    listed = F.transform(F.array_sort(F.collect_list("s")), lambda s: s.q)  # one entry for each level
    if by is None:
        return near.agg(F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("n"), listed.alias("quantiles"))
    return near.groupBy(F.col("_g").alias(by)).agg(F.max("n").alias("n"), listed.alias("quantiles"))


def inner_levels(n):
    """Levels of the edges between ``n`` bins of equal counts."""
    return [i / n for i in range(1, n)]


def bin_of(value, edges):
    """Number of edges below a value."""
    return F.size(F.filter(edges, lambda e: e < value))
