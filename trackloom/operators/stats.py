"""Correlations, information, bootstrap, learning curves, graphs and clusters over tables."""

import hashlib
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import checkpoint
from .motion import average_rank
from .order import bin_of, inner_levels, quantiles
from .report import chi_square_tail


def _corr(x, y):
    """Correlation, null where a side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y)), F.lit(0.0)))


def correlations(df: DataFrame, columns, method="pearson", by=()) -> DataFrame:
    """``a, b, r, n`` for all pairs of columns over rows where both are known, in one aggregate; ``spearman`` ranks first."""
    if method == "spearman":
        for c in columns:
            df = average_rank(df, c, by, f"_r_{c}").withColumn(c, F.when(F.col(c).isNotNull(), F.col(f"_r_{c}"))).drop(f"_r_{c}")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), _corr(F.when(both(a, b), F.col(a)), F.when(both(a, b), F.col(b))).alias("r"), F.count(F.when(both(a, b), 1)).alias("n")) for a, b in pairs]
    return df.groupBy(*by).agg(F.array(*cells).alias("_c")).select(*by, F.explode("_c").alias("c")).select(*by, "c.*")


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h


def t_test_p(r, n):
    """Two-sided probability of a correlation r of n pairs under independence."""
    if r is None or n is None or r != r or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    v = n - 2
    x = v / (v + r * r * v / (1 - r * r))
    a, b = v / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def significant(corr: DataFrame, alpha=0.05) -> DataFrame:
    """Correlations with their probability; r is null where it exceeds ``alpha``."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_test_p(None if pd.isna(x) else x, k) for x, k in zip(r, n, strict=True)], dtype="float64")

    return corr.withColumn("p", p("r", "n")).withColumn("r", F.when(F.col("p") <= alpha, F.col("r")))


def mean_correlation(df, target, columns, by="species", method="pearson"):
    """Correlation of columns with a target in each group, averaged over the groups; constant targets give none."""
    c = correlations(df, [target, *columns], method, (by,)).filter(F.col("a") == target)
    return c.filter("r is not null and not isnan(r)").groupBy(F.col("b").alias("feature")).agg(F.avg("r").alias("r"), F.count(F.lit(1)).alias("n_groups"))


def representatives(corr, groups, least):
    """Strongest feature of each group of features whose |r| reaches a limit: ``key, feature, r``."""
    g = corr.join(groups, "feature").filter(F.abs("r") >= least)
    return g.groupBy("key").agg(F.max_by(F.struct("feature", "r"), F.struct(F.abs("r"), "feature")).alias("b")).select("key", "b.*")


def gram(df, columns):
    """Sums of products of columns (d x d), in one aggregate: the only thing that reaches the driver."""
    d = len(columns)
    row = df.agg(*[F.sum(F.col(a) * F.col(b)) for a in columns for b in columns]).first()
    return np.array(row, float).reshape(d, d)


def vif(df, columns, g=None):
    """Variance inflation factors without an intercept, by column."""
    g = gram(df, columns) if g is None else g
    scale = np.sqrt(np.diag(g))
    values, vectors = np.linalg.eigh(g / np.outer(scale, scale))
    # Columns that depend on others exactly get a factor of about 1e14 instead of a division by 0.
    return dict(zip(columns, (vectors**2 / np.maximum(values, 1e-14)).sum(axis=1).tolist(), strict=True))


def eliminate_by_vif(df, columns, most=10.0, keep=()):
    """Columns left after dropping the highest factor again and again; the table is read once."""
    left, g = list(columns), gram(df, columns)
    while len(left) > 1:
        i = [columns.index(c) for c in left]
        found = vif(None, left, g[np.ix_(i, i)])
        worst = max((c for c in left if c not in keep), key=found.get, default=None)
        if worst is None or found[worst] < most:
            break
        left.remove(worst)
    return left


def entropy(df, column, name="entropy"):
    """Entropy of a class in bits."""
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy())
    return n.select((-p * F.log2(p)).alias("h")).agg(F.sum("h").alias(name))


def binned(df, column, bins):
    """Bin numbers of equal counts as ``column``."""
    edges = quantiles(df, column, inner_levels(bins)).select(F.col("quantiles").alias("_e"))
    return df.crossJoin(F.broadcast(edges)).withColumn(column, bin_of(F.col(column), F.col("_e"))).drop("_e")  # one row


def _joint_information(counts, key):
    """``key, mi`` in bits from counts ``key, a, b, n``."""
    na, nb, t = (F.sum("n").over(Window.partitionBy(key, *k)) for k in (["a"], ["b"], []))
    return counts.select(key, (F.col("n") / t * F.log2(F.col("n") * t / (na * nb))).alias("m")).groupBy(key).agg(F.sum("m").alias("mi"))


def feature_information(df, columns, label, bins=8):
    """``feature, mi, normalised``: binned information of each feature about a class, and as a share of the class entropy.

    All features go through one plan, as rows of feature and value. The edges are one row a feature.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = checkpoint(df.select(F.col(label).alias("b"), F.explode(cells).alias("c")).select("b", "c.*").filter("value is not null"))
    edges = quantiles(long, "value", inner_levels(bins), "feature").select("feature", "quantiles")
    counts = long.filter("b is not null").join(F.broadcast(edges), "feature")  # len(columns) rows
    counts = counts.groupBy("feature", bin_of(F.col("value"), F.col("quantiles")).alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))
    # A feature without a known value tells nothing.
    named = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    out = named.join(_joint_information(counts, "feature"), "feature", "left").crossJoin(F.broadcast(entropy(df, label, "_h")))  # one row
    return out.select("feature", "mi", F.try_divide("mi", "_h").alias("normalised"))


def feature_pairs(df, columns, bins):
    """``pair, x, y, i, j``: for every row and pair of features that it knows both of, their values and bins of equal counts among such rows.

    ``pair`` holds the features' places in ``columns``, the smaller one first. The plan is as large for many features as for few.
    """
    # Two explodes, of places and of later places, instead of an expression for each pair.
    rows = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("v")).select("v", F.posexplode("v").alias("a", "x")).filter("x is not null")
    rows = rows.filter(F.col("a") < len(columns) - 1).select("v", "a", "x", F.explode(F.sequence(F.col("a") + 1, F.lit(len(columns) - 1))).alias("b")).withColumn("y", F.get("v", F.col("b"))).filter("y is not null")
    rows = checkpoint(rows.select(F.struct("a", "b").alias("pair"), "x", "y"))
    sides = rows.select("pair", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("value")), F.struct(F.lit(1).alias("side"), F.col("y").alias("value")))).alias("s"))
    edges = quantiles(sides.select(F.struct("pair", "s.side").alias("key"), "s.value"), "value", inner_levels(bins), "key")
    edges = edges.groupBy("key.pair").agg(*[F.max(F.when(F.col("key.side") == k, F.col("quantiles"))).alias(f"e{k}") for k in (0, 1)])
    binned_rows = rows.join(F.broadcast(edges), "pair")  # a row for each pair of columns
    return binned_rows.select("pair", "x", "y", bin_of(F.col("x"), F.col("e0")).alias("i"), bin_of(F.col("y"), F.col("e1")).alias("j"))


def _pair_names(columns):
    """Expressions for the names of a ``pair``."""
    names = F.array(*[F.lit(c) for c in columns])
    return F.get(names, F.col("pair.a")), F.get(names, F.col("pair.b"))


def feature_redundancy(df, columns, bins=8):
    """``a, b, mi`` for pairs of features, over the rows that know both; all pairs in one plan."""
    counts = feature_pairs(df, columns, bins).groupBy("pair", F.col("i").alias("a"), F.col("j").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    a, b = _pair_names(columns)
    return _joint_information(counts, "pair").select(a.alias("a"), b.alias("b"), "mi")


def predictive_distances(df, columns, bins=8):
    """``real, pred, d`` for pairs of features: 1 - R squared of one from the other's bins, the smaller of both ways; null if neither varies.

    Counts, means and deviations within (pair, way, bin) are all that leaves the rows; a bin's part of the variance is count times its deviation.
    """
    ways = F.array(F.struct(F.lit(0).alias("way"), F.col("i").alias("bin"), F.col("y").alias("value")), F.struct(F.lit(1).alias("way"), F.col("j").alias("bin"), F.col("x").alias("value")))
    cells = feature_pairs(df, columns, bins).select("pair", F.explode(ways).alias("w")).groupBy("pair", "w.way", "w.bin").agg(F.count(F.lit(1)).alias("n"), F.avg("w.value").alias("m"), F.var_pop("w.value").alias("v"))
    mean = F.sum(F.col("n") * F.col("m")).over(Window.partitionBy("pair", "way")) / F.sum("n").over(Window.partitionBy("pair", "way"))
    cells = cells.withColumn("between", F.col("n") * (F.col("m") - mean) ** 2)
    inner = F.sum(F.col("n") * F.col("v"))
    per = cells.groupBy("pair", "way").agg(F.try_divide(inner, inner + F.sum("between")).alias("d"))
    a, b = _pair_names(columns)
    return per.groupBy("pair").agg(F.min("d").alias("d")).select(a.alias("real"), b.alias("pred"), "d")


def mrmr_order(information, redundancy):
    """``dropped, feature``: the order in which features are dropped, the least useful first (ties by name): information minus mean redundancy with those left.

    The tables stay in Spark, a row for each feature and for each pair of them. A step brings the name of one feature to the driver, and takes its
    part out of the others' sums.
    """
    one_way = redundancy.select(F.col("a").alias("feature"), F.col("b").alias("other"), "mi")
    pairs = checkpoint(one_way.unionAll(redundancy.select(F.col("b").alias("feature"), F.col("a").alias("other"), "mi")))
    sums = pairs.groupBy("feature").agg(F.sum("mi").alias("shared"))
    left = checkpoint(information.select("feature", "mi").join(sums, "feature", "left").fillna(0.0, ["shared"]))
    out, n = [], left.count()
    while n > 1:
        worst = left.orderBy(F.col("mi") - F.col("shared") / (n - 1), "feature").first().feature
        gone = pairs.filter(F.col("other") == worst).select("feature", F.col("mi").alias("_m"))
        left = checkpoint(left.filter(F.col("feature") != worst).join(gone, "feature", "left").select("feature", "mi", (F.col("shared") - F.coalesce("_m", F.lit(0.0))).alias("shared")))
        out.append(worst)
        n -= 1
    out += [r.feature for r in left.select("feature").collect()]
    return information.sparkSession.createDataFrame(list(enumerate(out)), "dropped int, feature string")


# Bootstrap by hashes. A row counts Poisson(1) times in each replicate, as it nearly does when as many rows as there are are drawn with
# replacement; so replicates need no draw of rows, and all of them are sums over one reading of the table.

#: Modulus of the hash, a prime, so that a row's hash times a replicate's spreads over all of its range.
PRIME = (1 << 31) - 1


def replicate_factor(r):
    """A replicate's factor, 1 .. PRIME - 1."""
    return int(hashlib.md5(f"rep-{r}".encode()).hexdigest()[:8], 16) % (PRIME - 1) + 1


def poisson_limits():
    """Smallest hashes at which a row counts at least 1, 2, ... times."""
    out, term, total = [], math.exp(-1), 0.0
    for k in range(1, 12):
        total += term
        term /= k
        out.append(math.floor(total * PRIME))
    return out


def poisson_counts(replicates, *names):
    """How often a row, named by columns, counts in each replicate: an array of longs."""
    row = F.conv(F.substring(F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in names])), 1, 8), 16, 10).cast("long") % PRIME

    def count(m):
        u, out = (row * m) % PRIME, F.when(F.lit(False), F.lit(0))
        for k, limit in enumerate(poisson_limits()):
            out = out.when(u < limit, k)
        return out.otherwise(len(poisson_limits()))

    return F.transform(F.array(*[F.lit(replicate_factor(r)).cast("long") for r in range(replicates)]), count)


def resampled_means(df, by, value, replicates=200, order="id"):
    """``by, rep, mean`` of bootstrap resamples of each group; no row if a group counts nothing in a replicate.

    ``order`` names a row within its group. The table is read once: a row's counts are a vector, and its partial sums merge by group like any sum, so no
    group meets in one task and no row is multiplied.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    counts = F.transform(poisson_counts(replicates, by, order), lambda c: c.cast("double"))
    rows = df.filter(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("_v"), counts.alias("_c"))
    sums = rows.groupBy(by).agg(Summarizer.sum(array_to_vector(F.concat("_c", F.transform("_c", lambda c: c * F.col("_v"))))).alias("_s"))
    sums = sums.withColumn("_s", vector_to_array("_s"))
    pairs = F.arrays_zip(F.slice("_s", 1, replicates).alias("n"), F.slice("_s", replicates + 1, replicates).alias("s"))
    out = sums.select(by, F.posexplode(pairs).alias("rep", "_p"))
    # The summed counts are whole numbers, up to rounding.
    return out.filter("_p.n > 0.5").select(by, "rep", (F.col("_p.s") / F.round("_p.n")).alias("mean"))


def percentile_interval(df, by, value, replicates=200, alpha=0.05, order="id"):
    """``by, low, high``: percentile bootstrap interval of the mean."""
    m = resampled_means(df, by, value, replicates, order)
    return m.groupBy(by).agg(F.percentile("mean", alpha / 2).alias("low"), F.percentile("mean", 1 - alpha / 2).alias("high"))


def normal_cdf(x):
    """Standard normal distribution function, with a relative error under 1.2e-7 in the tails."""
    tail = chi_square_tail(x * x) / 2
    return F.when(x < 0, tail).otherwise(1 - tail)


#: Fixed coefficients of a published rational approximation of the normal quantile (relative error under 1.2e-9): numerator and
#: denominator in the middle, then in the tails.
QUANTILE_MIDDLE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
)
QUANTILE_TAIL = (
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)


def normal_quantile(p):
    """Standard normal quantile of 0 < p < 1."""

    def poly(c, x):
        out = F.lit(c[0])
        for k in c[1:]:
            out = out * x + k
        return out

    def tail(q):
        x = F.sqrt(-2 * F.ln(q))
        return poly(QUANTILE_TAIL[0], x) / poly(QUANTILE_TAIL[1], x)

    middle = p - 0.5
    square = middle * middle
    return F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(middle * poly(QUANTILE_MIDDLE[0], square) / poly(QUANTILE_MIDDLE[1], square))


#: Part of a mean, or of 1, by which two means differ if they are not equal.
SAME = 1e-9


def bca_interval(df, by, value, replicates=200, alpha=0.05, order="id"):
    """``by, low, high``: bootstrap interval of the mean corrected for bias and acceleration; for groups of two rows or more.

    The acceleration of a mean by the jackknife is its skewness over 6 sqrt(n), so it needs no table of means without a row.
    """
    known = df.filter(F.col(value).isNotNull())
    facts = known.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_m"), F.skewness(value).alias("_skew")).filter("_n > 1")
    a = F.when(F.col("_skew").isNull() | F.isnan("_skew"), 0.0).otherwise(F.col("_skew") / (6 * F.sqrt("_n")))
    m = resampled_means(df, by, value, replicates, order).join(facts.select(by, "_m", a.alias("a")), by)
    # Equal up to rounding counts as a half.
    gap, slack = F.col("mean") - F.col("_m"), SAME * F.greatest(F.lit(1.0), F.abs("_m"))
    below = F.avg(F.when(gap < -slack, 1.0).when(gap <= slack, 0.5).otherwise(0.0))
    rows = m.groupBy(by).agg(F.first("a").alias("a"), below.alias("share"), F.array_sort(F.collect_list("mean")).alias("_v"))  # replicates of a group
    rows = rows.withColumn("z", normal_quantile(F.least(F.greatest("share", F.lit(1e-9)), F.lit(1 - 1e-9))))
    ends = {}
    for name, q in (("low", NormalDist().inv_cdf(alpha / 2)), ("high", NormalDist().inv_cdf(1 - alpha / 2))):
        ends[f"_{name}"] = normal_cdf(F.col("z") + (F.col("z") + q) / (1 - F.col("a") * (F.col("z") + q))) * (F.size("_v") - 1)
    rows = rows.withColumns(ends)

    def at(name):
        # Linear interpolation between the sorted means at the group's own level.
        k = F.floor(name).cast("int")
        lo, hi = F.get("_v", k), F.coalesce(F.get("_v", k + 1), F.get("_v", k))
        return lo + (F.col(name) - k) * (hi - lo)

    return rows.select(by, at("_low").alias("low"), at("_high").alias("high"))


def _numpy_counts(rows, replicates):
    """Counts as :func:`poisson_counts` gives them, from the rows' hashes."""
    factors = np.array([replicate_factor(r) for r in range(replicates)], np.int64)
    return np.searchsorted(np.array(poisson_limits()), rows[:, None] * factors[None, :] % PRIME, side="right")


def resampled_medians(df, by, value, replicates=100, order="id"):
    """``by, rep, median`` of bootstrap resamples of each group; no row if a group counts nothing in a replicate.

    Rows are laid out by (group, value). Each task sums the counts of its rows by group and replicate; the sums before it tell which places of
    a resample its rows hold, so it can tell whether the middle ones are its own. A group may span any number of tasks.
    """
    from pyspark.sql import types as T

    row = F.conv(F.substring(F.md5(F.concat_ws("-", F.col(by).cast("string"), F.col(order).cast("string"))), 1, 8), 16, 10).cast("long") % PRIME
    laid = df.filter(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).cast("double").alias("v"), row.alias("h"))
    laid = laid.repartitionByRange("g", "v", "h").sortWithinPartitions("g", "v", "h").withColumn("part", F.spark_partition_id())
    chunks = checkpoint(laid.groupBy("g", "part").agg(F.array_sort(F.collect_list(F.struct("v", "h"))).alias("rows")))  # what one task held of a group

    def total(batches):
        for b in batches:
            sums = [_numpy_counts(x.values.field(1).to_numpy(), replicates).sum(axis=0).tolist() for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sums, pa.list_(pa.int64()))], ["g", "part", "sums"])

    group = laid.schema["g"].dataType
    schema = T.StructType([T.StructField("g", group), T.StructField("part", T.IntegerType()), T.StructField("sums", T.ArrayType(T.LongType()))])
    sums = chunks.select("g", "part", "rows").mapInArrow(total, schema)
    zero = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda _: F.lit(0).cast("long"))
    add = lambda x, y: F.zip_with(x, y, lambda p, q: p + q)
    # One entry for each task that holds rows of the group.
    along = sums.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("part", "sums"))).alias("all"))
    start = F.struct(zero.alias("sum"), F.array().cast("array<struct<part:int,before:array<bigint>>>").alias("out"))
    carried = F.aggregate("all", start, lambda a, x: F.struct(add(a["sum"], x["sums"]).alias("sum"), F.array_append(a["out"], F.struct(x["part"].alias("part"), a["sum"].alias("before"))).alias("out")))
    along = along.select(F.col("g").alias("_g"), carried.alias("c")).select("_g", F.col("c.sum").alias("total"), F.inline("c.out"))

    def middle(batches):
        for b in batches:
            out = [[], [], [], []]
            for g, rows, before, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3), strict=True):
                v, counts = rows.values.field(0).to_numpy(), _numpy_counts(rows.values.field(1).to_numpy(), replicates)
                n, ends = n.values.to_numpy(), before.values.to_numpy() + np.cumsum(counts, axis=0)
                found = []
                for place in ((n - 1) // 2, n // 2):
                    at = (ends <= place).sum(axis=0)  # the row that holds the place, if the places before this task end at or below it
                    here = (n > 0) & (at < len(v)) & (place >= before.values.to_numpy())
                    found.append(np.where(here, v[np.minimum(at, len(v) - 1)], np.nan))
                keep = np.flatnonzero(~(np.isnan(found[0]) & np.isnan(found[1])))
                out[0] += [g] * len(keep)
                for o, x in zip(out[1:], (keep, found[0][keep], found[1][keep]), strict=True):
                    o.append(x)
            flat = [np.concatenate(o) if o else np.zeros(0) for o in out[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field(0).type), pa.array(flat[0].astype(np.int32)), pa.array(flat[1], from_pandas=True), pa.array(flat[2], from_pandas=True)], ["g", "rep", "low", "high"])

    schema = T.StructType([T.StructField("g", group), T.StructField("rep", T.IntegerType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])
    met = chunks.join(along, F.col("g").eqNullSafe(F.col("_g")) & (chunks["part"] == along["part"])).select("g", "rows", "before", "total")
    found = met.mapInArrow(middle, schema).groupBy("g", "rep").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    return found.select(F.col("g").alias(by), "rep", ((F.col("low") + F.col("high")) / 2).alias("median"))


def mean_of_medians_interval(df, by, value, replicates=100, alpha=0.05, order="id"):
    """``low, high`` for the mean of group medians: rows are resampled within their group, and groups among each other, both by Poisson counts."""
    medians = resampled_medians(df, by, value, replicates, order).withColumn("_part", F.lit("group"))
    weight = F.get(poisson_counts(replicates, "_part", by), F.col("rep"))
    means = medians.withColumn("_w", weight).groupBy("rep").agg(F.try_divide(F.sum(F.col("_w") * F.col("median")), F.sum("_w")).alias("m"))
    return means.agg(F.percentile("m", alpha / 2).alias("low"), F.percentile("m", 1 - alpha / 2).alias("high"))


# Learning curves: accuracy by number of samples.


def linear_fit(df, by):
    return df.groupBy(by).agg(F.regr_slope("accuracy", "n").alias("slope"), F.regr_intercept("accuracy", "n").alias("intercept"))


def exponential_fit(df, by):
    """1 - accuracy = a exp(b n) by a line through its logarithm; accuracies of 1 are left out."""
    y = F.when(F.col("accuracy") < 1, F.ln(1 - F.col("accuracy")))
    return df.groupBy(by).agg(F.exp(F.regr_intercept(y, "n")).alias("a"), F.regr_slope(y, "n").alias("b"))


def required_samples(fit, accuracy):
    """Samples (at least 1) for an accuracy, and the scale 1 / b of the gain."""
    n = F.greatest(F.lit(1.0), F.ln((1 - accuracy) / F.col("a")) / F.col("b"))
    return fit.withColumns({"n_required": F.when(F.col("b") < 0, n), "scale": F.try_divide(F.lit(1.0), F.col("b"))})


def sample_size_by_group(df, by, accuracy, jump=0.2, enough=0.98):
    """Required samples with regime rules: sizes count from a single jump in accuracy on, and up to the second size in a
    row beyond ``enough``; groups whose exponential does not fall use the line."""
    w = Window.partitionBy(by).orderBy("n")
    m = df.groupBy(by, "n").agg(F.avg("accuracy").alias("accuracy")).withColumn("_before", F.lag("accuracy").over(w))
    m = m.withColumns({"_jump": (F.col("accuracy") - F.col("_before") > jump).cast("int"), "_full": ((F.col("accuracy") > enough) & (F.col("_before") > enough)).cast("int")})
    whole = Window.partitionBy(by)
    m = m.withColumns({"_from": F.when(F.sum("_jump").over(whole) == 1, F.max(F.when(F.col("_jump") == 1, F.col("n"))).over(whole)), "_to": F.min(F.when(F.col("_full") == 1, F.col("n"))).over(whole)})
    m = m.filter((F.col("n") >= F.coalesce("_from", F.col("n"))) & (F.col("n") <= F.coalesce("_to", F.col("n"))))
    fit = required_samples(exponential_fit(m, by), accuracy).join(linear_fit(m, by), by)
    line = F.greatest(F.lit(1.0), F.try_divide(F.lit(accuracy) - F.col("intercept"), F.col("slope")))
    return fit.select(by, F.coalesce("n_required", line).alias("n_required"), "scale")


def sample_size_intervals(df, by, accuracy, seed="random_state", replicates=200, alpha=0.05):
    """Required samples of each group as mean over seeds with a bootstrap interval: :func:`sample_size_by_group` of every seed first."""
    keyed = df.withColumn("_k", F.struct(by, seed))
    per = sample_size_by_group(keyed, "_k", accuracy).select(F.col(f"_k.{by}").alias(by), F.col(f"_k.{seed}").alias(seed), "n_required").filter("n_required is not null")
    mean = per.groupBy(by).agg(F.avg("n_required").alias("n_required"), F.count(F.lit(1)).alias("n_seeds"))
    return mean.join(percentile_interval(per, by, "n_required", replicates, alpha, seed), by)


# Graph of confusions and its communities.


def confusion_graph(confused, least):
    return confused.filter((F.col("real") != F.col("pred")) & (F.col("share") > least)).select(F.col("real").alias("src"), F.col("pred").alias("dst"), F.col("share").alias("weight"))


def in_degree(edges):
    return edges.groupBy("dst").agg(F.sum("weight").alias("in_degree"))


def communities(edges, members):
    """Size, inner and outer weight and running share of inner weight of each community (``node, community``)."""
    e = edges.join(members.select(F.col("node").alias("src"), F.col("community").alias("_a")), "src").join(members.select(F.col("node").alias("dst"), F.col("community").alias("_b")), "dst")
    inner = e.filter("_a = _b").groupBy(F.col("_a").alias("community")).agg(F.sum("weight").alias("inner"), F.avg("weight").alias("mean_inner"))
    outer = e.filter("_a <> _b").select(F.explode(F.array("_a", "_b")).alias("community"), "weight").groupBy("community").agg(F.sum("weight").alias("outer"))
    df = members.groupBy("community").agg(F.count(F.lit(1)).alias("size")).join(inner, "community", "left").join(outer, "community", "left").fillna(0.0, ["inner", "mean_inner", "outer"])
    total = F.sum("inner").over(Window.partitionBy())
    running = F.sum("inner").over(Window.orderBy(F.desc("inner"), "community"))
    return df.withColumns({"share": F.try_divide("inner", total), "cumulative": F.try_divide(running, total)})


def modularity(edges, members):
    """Over existing directed edges: (weight - k_src k_dst / 2m) / 2m inside communities, degrees being in + out."""
    deg = edges.select(F.explode(F.array("src", "dst")).alias("node"), "weight").groupBy("node").agg(F.sum("weight").alias("k"))
    d = deg.join(members, "node")
    e = edges.join(d.select(F.col("node").alias("src"), F.col("k").alias("ks"), F.col("community").alias("_a")), "src").join(d.select(F.col("node").alias("dst"), F.col("k").alias("kd"), F.col("community").alias("_b")), "dst")
    e = e.crossJoin(F.broadcast(edges.agg((2 * F.sum("weight")).alias("_2m"))))  # one row
    return e.filter("_a = _b").agg(F.coalesce(F.sum((F.col("weight") - F.col("ks") * F.col("kd") / F.col("_2m")) / F.col("_2m")), F.lit(0.0)).alias("modularity"))


def threshold_sweep(confused, members, limits):
    """Edges, inner weight and total weight for each edge threshold, in one aggregate."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in limits])).alias("limit")
    e = confusion_graph(confused, -1.0).select("*", t).filter("weight > `limit`")
    e = e.join(members.select(F.col("node").alias("src"), F.col("community").alias("_a")), "src").join(members.select(F.col("node").alias("dst"), F.col("community").alias("_b")), "dst")
    return e.groupBy("limit").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("weight").alias("weight"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("weight")).otherwise(0.0)).alias("inner"))


def symmetric_distance(confused, how="mean"):
    """Distance 1 - similarity of two classes from both directions of their confusion: mean, harmonic, max or jaccard."""
    a = confused.select("real", "pred", F.col("share").alias("x"))
    d = confused.filter("real = pred").select(F.col("real").alias("_l"), F.col("share").alias("_d"))
    p = a.filter("real < pred").join(a.select(F.col("pred").alias("real"), F.col("real").alias("pred"), F.col("x").alias("y")), ["real", "pred"])
    p = p.join(d.select(F.col("_l").alias("real"), F.col("_d").alias("dx")), "real").join(d.select(F.col("_l").alias("pred"), F.col("_d").alias("dy")), "pred")
    s = {"mean": (F.col("x") + F.col("y")) / 2, "harmonic": F.coalesce(F.try_divide(2 * F.col("x") * F.col("y"), F.col("x") + F.col("y")), F.lit(0.0)), "max": F.greatest("x", "y"), "jaccard": F.coalesce(F.try_divide(F.col("x") + F.col("y"), F.col("dx") + F.col("dy") + F.col("x") + F.col("y")), F.lit(0.0))}[how]
    return p.select("real", "pred", (1 - s).alias("d"))


def single_linkage(distances, height, nodes=None):
    """``node, cluster``: connected components of pairs at most ``height`` apart, named by their smallest node; singletons dropped.

    Smallest names spread along the pairs, then from a name to its own name, until none changes.
    """
    e = distances.filter(F.col("d") <= height).select(F.col("real").alias("a"), F.col("pred").alias("b"))
    both = checkpoint(e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("cluster")).withColumnRenamed("a", "node")
    while True:
        near = both.join(label, both.b == label.node).groupBy(F.col("a").alias("n")).agg(F.min("cluster").alias("c"))
        moved = label.join(near, F.col("node") == F.col("n")).select("node", F.col("cluster").alias("old"), F.least("cluster", "c").alias("cluster"))
        up = label.select(F.col("node").alias("u"), F.col("cluster").alias("c"))
        moved = moved.join(up, F.col("cluster") == F.col("u")).select("node", "old", F.least("cluster", "c").alias("cluster"))
        moved = checkpoint(moved)
        if not moved.filter("old <> cluster").limit(1).count():
            return moved.select("node", "cluster")
        label = moved.select("node", "cluster")


# Tables of distances.


def pooled_distances(distances, labels, reduce=F.avg):
    """A table of distances pooled by the species of both tracks by any aggregate (for quantiles over all pairs of rows see ``distances.pooled_quantile``)."""
    a, b = (labels.select(F.col("id").alias(k), F.col("species").alias(s)) for k, s in (("i", "sp_i"), ("j", "sp_j")))
    df = distances.join(a, "i").join(b, "j")
    return df.select(F.least("sp_i", "sp_j").alias("sp_i"), F.greatest("sp_i", "sp_j").alias("sp_j"), "d").groupBy("sp_i", "sp_j").agg(reduce("d").alias("d"))


def knn_accuracy(near, labels, most=5, by=()):
    """Accuracy of the vote of the k nearest others (``id, other, d``) for k = 1 .. most; ties to the smaller label."""
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "id").orderBy("d", "other"))).filter(F.col("_r") <= most)
    near = near.join(labels.select(F.col("id").alias("other"), F.col("class").alias("vote")), "other")
    votes = near.select(*by, "id", "vote", F.explode(F.sequence(F.col("_r"), F.lit(most))).alias("k")).groupBy(*by, "id", "k", "vote").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy(*by, "id", "k").agg(F.max_by("vote", F.struct("n", -F.col("vote"))).alias("vote"))
    return best.join(labels, "id").groupBy(*by, "k").agg(F.avg((F.col("vote") == F.col("class")).cast("double")).alias("accuracy"))


def pca(df, columns, k):
    """Shares of variance of k principal components, and features' importance: sum of |loading| by share. d x k figures reach the driver."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    v = VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="skip").transform(df)
    v = StandardScaler(inputCol="_x", outputCol="_z", withMean=True).fit(v).transform(v)
    m = PCA(k=k, inputCol="_z", outputCol="_p").fit(v)
    share = m.explainedVariance.toArray()
    weight = np.abs(m.pc.toArray()) @ share
    spark = df.sparkSession
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(share)], "component int, share double"), spark.createDataFrame([(c, float(w)) for c, w in zip(columns, weight, strict=True)], "feature string, importance double")


def device_effect(df, tag, target="accuracy"):
    """Correlation of a tag's share with a target over species that carry both this tag and others."""
    s = df.groupBy("species").agg(F.avg((F.col("tag") == tag).cast("double")).alias("share"), F.avg(target).alias(target))
    return correlations(s.filter("share > 0 and share < 1"), ["share", target])


# Attributions: id, class, feature, value.


def mean_attribution(attr, labels=None, by=None):
    """Mean |value| of each feature over tracks; or by species or taxa, over the species' (or taxa's) tracks first."""
    if by is None:
        return attr.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance"))
    per = attr.join(labels, "id").groupBy("feature", by).agg(F.avg(F.abs("value")).alias("v"))
    return per.groupBy("feature").agg(F.avg("v").alias("importance"))


def of_class(attr, classes, column="predicted"):
    """Attribution of each track's predicted or real class."""
    return attr.join(classes.select("id", F.col(column).alias("class")), ["id", "class"])


def grouped_features(attr, groups):
    """Values summed over groups of features (a dict from feature to group)."""
    pairs = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    return attr.withColumn("feature", F.coalesce(F.try_element_at(pairs, F.col("feature")), F.col("feature"))).groupBy("id", "class", "feature").agg(F.sum("value").alias("value"))


def group_difference(attr, labels, by="taxa"):
    """Mean |value| of a group minus that of the rest, for each feature and group."""
    df = attr.join(labels, "id").groupBy("feature", by).agg(F.sum(F.abs("value")).alias("s"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("feature")
    rest = F.try_divide(F.sum("s").over(w) - F.col("s"), F.sum("n").over(w) - F.col("n"))
    return df.select("feature", by, (F.col("s") / F.col("n") - rest).alias("difference"))


def group_pair_difference(attr, labels, by="taxa"):
    m = attr.join(labels, "id").groupBy("feature", by).agg(F.avg(F.abs("value")).alias("m"))
    b = m.select("feature", F.col(by).alias("other"), F.col("m").alias("_m"))
    return m.join(b, "feature").filter(F.col(by) < F.col("other")).select("feature", by, "other", (F.col("m") - F.col("_m")).alias("difference"))


def compare_settings(a, b):
    """Features' importance and rank under two settings side by side."""
    rank = lambda df, s: df.select("feature", F.col("importance").alias(f"importance_{s}"), F.row_number().over(Window.orderBy(F.desc("importance"), "feature")).alias(f"rank_{s}"))
    return rank(a, "a").join(rank(b, "b"), "feature", "full")


def join_difference(attr, groups):
    """For groups of features: mean over tracks of the sum of absolutes and of the absolute of the sum."""
    pairs = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    g = attr.withColumn("group", F.try_element_at(pairs, F.col("feature"))).filter("`group` is not null").groupBy("id", "group").agg(F.sum(F.abs("value")).alias("sum_abs"), F.abs(F.sum("value")).alias("abs_sum"))
    return g.groupBy("group").agg(F.avg("sum_abs").alias("sum_abs"), F.avg("abs_sum").alias("abs_sum"), F.max(F.col("sum_abs") - F.col("abs_sum")).alias("max_gap"))


def reference_sample(df, column, by, size):
    """``size`` values of each group spaced evenly over its sorted values."""
    from .prune import evenly_spaced

    return evenly_spaced(df.filter(F.col(column).isNotNull()), size, (by,), (column, "fix_id"))


def median_member(members):
    """For each cluster the member whose length is nearest the cluster's median, ties to the smaller id."""
    m = members.groupBy("cluster").agg(F.percentile("length", 0.5).alias("_m"))
    return members.join(m, "cluster").groupBy("cluster").agg(F.min(F.struct(F.abs(F.col("length") - F.col("_m")).alias("g"), "id")).alias("b")).select("cluster", "b.id")
