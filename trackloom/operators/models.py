"""Model preparation, Spark classifiers on points, votes of points to tracks, and reports."""

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, times
from ..store import checkpoint
from . import motion, prune, report

CLASSIFIERS = {
    "tree": lambda **k: DecisionTreeClassifier(**k),
    "forest": lambda numTrees=60, maxDepth=12, **k: RandomForestClassifier(numTrees=numTrees, maxDepth=maxDepth, **k),
    "svm": lambda featuresCol, labelCol, maxIter=20, **k: OneVsRest(classifier=LinearSVC(maxIter=maxIter, **k), featuresCol=featuresCol, labelCol=labelCol),
    "boosting": lambda featuresCol, labelCol, maxIter=10, **k: OneVsRest(classifier=GBTClassifier(maxIter=maxIter, **k), featuresCol=featuresCol, labelCol=labelCol),
}
REGRESSORS = {"forest": lambda **k: RandomForestRegressor(**k), "boosting": lambda **k: GBTRegressor(**k), "linear": lambda **k: LinearRegression(**k)}
#: Models of folds that are fitted at once.
PARALLEL = 4


def prepare(fixes: DataFrame, tracks: DataFrame, origin="periodic", common_origin=False, delete=(), label="species", prune_options=None, side=None, pad_days=False) -> DataFrame:
    """Pruned fixes with encoded features and label codes.

    Prunes tracks (options of :func:`prune.keep_tracks`), encodes positions as x, y, z and the time of the year as sine
    and cosine, or as displacement from a common origin, drops features, and marks ``side`` rows (column, values).
    """
    kept = prune.keep_tracks(tracks, label=label, **(prune_options or {}))
    df = fixes.join(kept.drop("length", "days"), "id")
    s, c = times.periodic_time(times.day_of_year("date_time"), F.year("date_time"))
    if common_origin:
        df = motion.common_origin(df, keep=[x for x in df.columns if x not in ("id", "fix_id", "date_time")])
    else:
        df = df.withColumns(dict(zip("xyz", geo.unit_vector("latitude", "longitude"), strict=True)))
    df = df.withColumns({"sin_t": s, "cos_t": c}).drop(*delete)
    if side:
        main, other = prune.split_by_value(df, side[0], side[1], label)
        return main.withColumn("side", F.lit(False)).unionByName(other.withColumn("side", F.lit(True)))
    return prune.dense_codes(df, label)


def standardise(df, columns, train, by=None):
    """Columns minus the training rows' mean over their population deviation; by group, or all rows' where a group has no training rows."""
    base = df.filter(train)
    stats = lambda d, keys, s: d.groupBy(*keys).agg(*[f(c).alias(f"_{n}{s}_{c}") for c in columns for f, n in ((F.avg, "m"), (F.stddev_pop, "d"))])
    df = df.crossJoin(F.broadcast(stats(base, [], "g")))  # one row
    if by:
        df = df.join(stats(base, [by], "s"), by, "left")
    pick = (lambda n, c: F.coalesce(f"_{n}s_{c}", f"_{n}g_{c}")) if by else (lambda n, c: F.col(f"_{n}g_{c}"))
    df = df.withColumns({c: F.coalesce(F.try_divide(F.col(c) - pick("m", c), pick("d", c)), F.lit(0.0)) for c in columns})
    return df.drop(*[x for x in df.columns if x.startswith(("_mg_", "_dg_", "_ms_", "_ds_"))])


def sequences(df, columns, maxlen, step=1):
    """``id`` and an array of ``maxlen`` points (arrays of the columns): every ``step``-th point of tracks that are longer, cut, zero-padded."""
    point = F.struct("date_time", "fix_id", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("p"))
    arrays = df.groupBy("id").agg(F.sort_array(F.collect_list(point)).alias("a")).select("id", F.transform("a", lambda x: x["p"]).alias("a"))
    zero = F.array(*[F.lit(0.0)] * len(columns))
    stride = F.when(F.size("a") > maxlen, F.lit(step)).otherwise(F.lit(1))
    return arrays.select("id", F.transform(F.sequence(F.lit(0), F.lit(maxlen - 1)), lambda i: F.coalesce(F.get("a", i * stride), zero)).alias("sequence"))


def blocks(seq, n_steps):
    """Sequences reshaped to blocks of ``n_steps`` points."""
    return seq.withColumn("sequence", F.transform(F.sequence(F.lit(0), F.size("sequence") - 1, F.lit(n_steps)), lambda i: F.slice("sequence", i + 1, n_steps)))


def point_table(fixes, labels):
    """Each fix with its track's label."""
    return fixes.join(labels, "id")


def fit(train, columns, label="code", kind="tree", **options):
    model = CLASSIFIERS[kind](featuresCol="_features", labelCol=label, **options)
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="_features", handleInvalid="skip"), model]).fit(train)


def predict(model, df):
    """Rows with ``pred`` and, where the model gives them, ``probs``."""
    out = model.transform(df).withColumn("pred", F.col("prediction").cast("int"))
    if "probability" in out.columns:
        out = out.withColumn("probs", vector_to_array("probability"))
    return out.drop("_features", "rawPrediction", "probability", "prediction")


def majority_vote(points):
    """``id, pred, confidence``: commonest prediction of a track's points, the lowest on a tie, and its share."""
    n = points.groupBy("id", "pred").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("id").agg(F.max_by("pred", F.struct("n", -F.col("pred"))).alias("p"), (F.max("n") / F.sum("n")).alias("confidence")).withColumnRenamed("p", "pred")


def probability_vote(points, order="fix_id"):
    """Class of the largest summed probability, the lowest on a tie, and its share.

    Probabilities are added one by one in the order of a column, so sums, and with them ties that rest on a last digit, are those of a plain
    SQL sum over the ordered table, whatever the layout.
    """
    w = Window.partitionBy("id", "pred").orderBy(order, "p")
    long = points.select("id", order, F.posexplode("probs").alias("pred", "p"))
    long = long.withColumns({"_s": F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_n": F.row_number().over(w)})
    long = long.groupBy("id", "pred").agg(F.max_by("_s", "_n").alias("p"))
    return long.groupBy("id").agg(F.max_by("pred", F.struct("p", -F.col("pred"))).alias("pred"), (F.max("p") / F.sum("p")).alias("confidence"))


def track_prediction(rows, threshold=None):
    """Class and confidence from one probability row for each track; a binary threshold acts on the second class."""
    top = F.array_max("probs")
    pred = (F.array_position("probs", top) - 1).cast("int") if threshold is None else F.when(F.get("probs", F.lit(1)) >= threshold, 1).otherwise(0)
    return rows.select("id", pred.alias("pred"), (top if threshold is None else F.get("probs", pred)).alias("confidence"))


def log_loss(rows, label="code", by="fold"):
    """Mean of -ln of the true class's probability."""
    p = F.greatest(F.get("probs", F.col(label).cast("int")), F.lit(1e-15))
    return rows.groupBy(by).agg(F.avg(-F.ln(p)).alias("loss"))


def _out_of_fold(spark, k, one, parallel):
    """Union of ``one(fold)`` over the folds; up to ``parallel`` folds are fitted at once, each in jobs of its own."""
    with ThreadPool(max(1, min(parallel, k))) as pool:
        parts = pool.map(inheritable_thread_target(spark)(one), range(k))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def cross_validate(points, columns, label="code", k=5, kind="tree", parallel=PARALLEL, **options):
    """``id, fold, predicted, confidence``: stratified folds over tracks, one fit for each fold, votes of the points."""
    folds = prune.folds(points.select("id", label).distinct(), k, label).select("id", "fold")
    df = checkpoint(points.join(folds, "id"))  # read by every fit

    def one(f):
        model = fit(df.filter(F.col("fold") != f), columns, label, kind, **options)
        return majority_vote(predict(model, df.filter(F.col("fold") == f))).select("id", F.lit(f).alias("fold"), F.col("pred").alias("predicted"), "confidence")

    return _out_of_fold(points.sparkSession, k, one, parallel)


def classification_report(tracks, predictions, label="code", classifier="tree"):
    """Report: label columns, prediction, Correct or Wrong, fold, classifier."""
    return report.marked(tracks.join(predictions, "id"), label, "predicted").withColumn("classifier", F.lit(classifier))


def cross_validated_regression(df, columns, target, k=5, kind="forest", parallel=PARALLEL, **options):
    """``id, fold, y, pred``: out-of-fold predictions; folds are stratified over bins of the target."""
    bins = df.withColumn("_b", F.floor(F.col(target) * 10))
    df = checkpoint(prune.folds(bins, k, "_b").drop("_b"))
    assemble = VectorAssembler(inputCols=list(columns), outputCol="_features", handleInvalid="skip")

    def one(f):
        model = Pipeline(stages=[assemble, REGRESSORS[kind](featuresCol="_features", labelCol=target, **options)]).fit(df.filter(F.col("fold") != f))
        return model.transform(df.filter(F.col("fold") == f)).select("id", "fold", F.col(target).alias("y"), F.col("prediction").alias("pred"))

    return _out_of_fold(df.sparkSession, k, one, parallel)


def sweep(points, settings, columns, label="code", k=2, parallel=PARALLEL):
    """Reports of all rows of a small settings table (``kind, seed, n``), a ``setting`` column telling them apart.

    Further columns of ``settings`` are options of the classifier, null where one keeps its default.
    """
    out = None
    for i, s in enumerate(settings.collect()):
        options = {c: v for c, v in s.asDict().items() if c not in ("kind", "seed", "n") and v is not None}
        chosen = prune.sample_by_hash(points.select("id").distinct(), s.n, s.seed)
        got = cross_validate(points.join(chosen, "id"), columns, label, k, s.kind, parallel, **options).select(F.lit(i).alias("setting"), "*")
        out = got if out is None else out.unionAll(got)
    return out


def feature_clusters(df, columns, height, bins=8, cap=None, least=None, by="species"):
    """Clusters of features by single linkage of their predictive power; rows may be capped and rare groups left out first."""
    from .stats import predictive_distances, single_linkage

    if least:
        df = prune.min_animals(df, least, by)
    if cap:
        df = prune.evenly_spaced(df, cap, (by,))
    return single_linkage(predictive_distances(df, columns, bins), height)
