"""Counts, shares, histograms and grids."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, times
from .order import quantiles


def shares(df: DataFrame, column) -> DataFrame:
    """``share`` and ``cumulative`` share of each class, largest first, ties by name."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    running = F.sum("n").over(Window.orderBy(F.desc("n"), column))
    return counts.select(column, "n", (F.col("n") / total).alias("share"), (running / total).alias("cumulative"))


def quantile_bins(df: DataFrame, column, n, name="bin") -> DataFrame:
    """Bin 0 .. of equal counts; equal values share a bin, equal edges are dropped."""
    edges = quantiles(df, column, [i / n for i in range(n + 1)]).select(F.array_distinct("quantiles").alias("_e"))
    df = df.crossJoin(F.broadcast(edges))  # one row
    inner = F.slice("_e", F.lit(2), F.greatest(F.size("_e") - 1, F.lit(0)))
    above = F.size(F.filter(inner, lambda e: e < F.col(column)))
    return df.withColumn(name, F.when(F.col(column).isNotNull(), above)).drop("_e")


def align_hemisphere(df: DataFrame, reference) -> DataFrame:
    """Latitudes of species whose median of track means lies in the other hemisphere than the reference's change sign."""
    means = df.groupBy("species", "id").agg(F.avg("latitude").alias("m")).groupBy("species").agg(F.signum(F.percentile("m", 0.5)).alias("_s"))
    own = means.filter(F.col("species") == reference).select(F.col("_s").alias("_r"))
    means = means.crossJoin(F.broadcast(own))  # one row
    return df.join(means, "species").withColumn("latitude", F.when(F.col("_s") != F.col("_r"), -F.col("latitude")).otherwise(F.col("latitude"))).drop("_s", "_r")


def null_share(df: DataFrame, columns, by=None) -> DataFrame:
    """Percent null of each column, for all rows or by a key, in long form."""
    keys = [by] if by else []
    wide = df.groupBy(*keys).agg(*[(100 * F.avg(F.col(c).isNull().cast("double"))).alias(c) for c in columns])
    return wide.unpivot(keys, list(columns), "column", "percent")


def grid_density(df: DataFrame, n_lat, n_lon, magnitude=None) -> DataFrame:
    """Count, or mean of a magnitude, on equal-width boxes."""
    i = F.least(F.floor((F.col("latitude") + 90) * F.lit(n_lat / 180)), F.lit(n_lat - 1)).cast("long")
    j = F.least(F.floor((F.col("longitude") + 180) * F.lit(n_lon / 360)), F.lit(n_lon - 1)).cast("long")
    value = F.count(F.lit(1)).cast("double") if magnitude is None else F.avg(magnitude)
    return df.groupBy(i.alias("i"), j.alias("j")).agg(value.alias("value"))


def equal_area_accuracy(df: DataFrame, n_lat, n_lon) -> DataFrame:
    """Mean accuracy of tracks, individuals and species in each cell of equal area."""
    per = df.groupBy(geo.equal_area_band("latitude", n_lat).alias("i"), geo.longitude_band("longitude", n_lon).alias("j"), "id", "species").agg(F.avg("accuracy").alias("a"))
    return per.groupBy("i", "j").agg(F.avg("a").alias("accuracy"), F.count_distinct("id").alias("n_animals"), F.count_distinct("species").alias("n_species"))


def space_time_density(df: DataFrame, n_lat, n_lon, day_width=None) -> DataFrame:
    """Share of fixes and mean accuracy of each cell, or cell and stretch of days."""
    keys = [geo.equal_area_band("latitude", n_lat).alias("i"), geo.longitude_band("longitude", n_lon).alias("j")]
    if day_width:
        keys.append(F.floor(times.day_of_year("date_time") / day_width).cast("long").alias("d"))
    cells = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("accuracy").alias("accuracy"))
    total = df.agg(F.count(F.lit(1)).alias("_t"))
    return cells.crossJoin(F.broadcast(total)).withColumn("density", F.col("n") / F.col("_t")).drop("_t")  # one row


def track_image(df: DataFrame, size, binary=False) -> DataFrame:
    """Sparse image of each track on its ``x, y`` in the unit square."""
    pixel = lambda c: F.least(F.floor(F.col(c) * size), F.lit(size - 1)).cast("long")
    out = df.groupBy("id", pixel("y").alias("i"), pixel("x").alias("j")).agg(F.count(F.lit(1)).alias("value"))
    return out.withColumn("value", F.lit(1).cast("long")) if binary else out


def bounding_boxes(df: DataFrame, by, pad=0.0) -> DataFrame:
    """Padded bounds and share of the points of each group."""
    box = df.groupBy(by).agg(*[(f(c) + s * pad).alias(f"{n}_{c[:3]}") for c in ("latitude", "longitude") for f, n, s in ((F.min, "min", -1), (F.max, "max", 1))], F.count(F.lit(1)).alias("n"))
    return box.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).drop("n")


def histogram(df: DataFrame, column, low, high, bins, by=None, log10=False) -> DataFrame:
    """Probability of each right-open bin and the running sum, overall or by a key."""
    x = F.log10(column) if log10 else F.col(column)
    keys = [by] if by else []
    index = F.floor((x - low) / ((high - low) / bins)).cast("long")
    counts = df.filter(x.isNotNull()).groupBy(*keys, F.greatest(F.lit(0), F.least(index, F.lit(bins - 1))).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    p = F.col("n") / F.sum("n").over(w)
    return counts.withColumn("p", p).withColumn("cdf", F.sum("p").over(w.orderBy("bin"))).drop("n")


def dataset_totals(fixes: DataFrame) -> DataFrame:
    """Fixes, animals and species, animals and fixes of a species on average, and a track's median length."""
    per = fixes.groupBy("species", "id").agg(F.count(F.lit(1)).alias("n"))
    sp = per.groupBy("species").agg(F.count(F.lit(1)).alias("animals"), F.sum("n").alias("fixes"))
    a = per.agg(F.sum("n").alias("n_fixes"), F.count(F.lit(1)).alias("n_animals"))
    a = a.crossJoin(quantiles(per, "n", [0.5]).select(F.try_element_at("quantiles", F.lit(1)).alias("median_length")))  # one row each
    b = sp.agg(F.count(F.lit(1)).alias("n_species"), F.avg("animals").alias("mean_animals"), F.avg("fixes").alias("mean_fixes"))
    return a.crossJoin(b)  # one row each


def class_weights(df: DataFrame, label) -> DataFrame:
    """N / (k n) of each class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    return counts.select(label, (F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n"))).alias("weight"))


def sequence_length(tracks: DataFrame, q=0.9) -> DataFrame:
    """Median over species of a high percentile of track lengths."""
    return tracks.groupBy("species").agg(F.percentile("length", q).alias("p")).agg(F.percentile("p", 0.5).alias("maxlen"))
