"""Aggregates over classification reports: a row for each animal, fold and seed with real and predicted class."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times


def _mean(condition):
    return F.avg(condition.cast("double"))


def marked(report: DataFrame, real="species", predicted="predicted") -> DataFrame:
    """Report with ``prediction`` Correct or Wrong and ``ok`` 1 or 0."""
    ok = F.col(real) == F.col(predicted)
    return report.withColumns({"prediction": F.when(ok, "Correct").otherwise("Wrong"), "ok": ok.cast("double")})


def accuracy_by_animal(report, wrong_as=None):
    """Mean over seeds; with one seed 1 or ``wrong_as`` (0 if not given)."""
    df = report.groupBy("id").agg(F.avg("ok").alias("accuracy"))
    return df if wrong_as is None else df.withColumn("accuracy", F.when(F.col("accuracy") == 0, F.lit(float(wrong_as))).otherwise(F.col("accuracy")))


def accuracy_by_fix(fixes, report):
    return fixes.join(accuracy_by_animal(report), "id")


def overall_and_species_accuracy(report, by=()):
    """Accuracy over animals and as mean of the species', their means and sample deviations over seeds."""
    species = report.groupBy(*by, "random_state", "species").agg(F.avg("ok").alias("a"), F.sum("ok").alias("s"), F.count(F.lit(1)).alias("n"))
    seed = species.groupBy(*by, "random_state").agg((F.sum("s") / F.sum("n")).alias("o"), F.avg("a").alias("m"))
    return seed.groupBy(*by).agg(F.avg("o").alias("acc_overall"), F.stddev_samp("o").alias("std_overall"), F.avg("m").alias("acc_species_mean"), F.stddev_samp("m").alias("std_species_mean"))


def confusion(report, real="species", predicted="predicted"):
    """Row-normalised confusion of all pairs of labels, zero where none fell."""
    counts = report.groupBy(F.col(real).alias("real"), F.col(predicted).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    labels = counts.select(F.explode(F.array("real", "pred")).alias("label")).distinct()  # as many rows as classes
    full = labels.select(F.col("label").alias("real")).crossJoin(labels.select(F.col("label").alias("pred"))).join(counts, ["real", "pred"], "left").fillna(0, ["n"])
    return full.select("real", "pred", "n", F.coalesce(F.try_divide("n", F.sum("n").over(Window.partitionBy("real"))), F.lit(0.0)).alias("share"))


def confusion_matrix(confused, labels):
    """Wide form, for display."""
    return confused.groupBy("real").pivot("pred", labels).agg(F.first("share"))


def taxa_confusion(report, animals):
    """Wrong predictions from one taxa to another as shares of all of the first taxa."""
    taxa = animals.select(F.col("species").alias("predicted"), F.col("taxa").alias("pred_taxa")).distinct()
    df = report.join(taxa, "predicted", "left")
    total = df.groupBy("taxa").agg(F.count(F.lit(1)).alias("_t"))
    wrong = df.filter("ok = 0").groupBy("taxa", "pred_taxa").agg(F.count(F.lit(1)).alias("n"))
    return wrong.join(total, "taxa").select("taxa", "pred_taxa", (F.col("n") / F.col("_t")).alias("share"))


def confusion_change(before, after, keys=("taxa", "pred_taxa")):
    """Difference of shares, a missing pair counting 0."""
    a, b = before.withColumnRenamed("share", "_a"), after.withColumnRenamed("share", "_b")
    return a.join(b, list(keys), "full").select(*keys, (F.coalesce("_b", F.lit(0.0)) - F.coalesce("_a", F.lit(0.0))).alias("change"))


def class_scores(report, real="species", predicted="predicted"):
    """Precision, recall, F1, support and chance F1 of each class."""
    r = report.groupBy(F.col(real).alias("class")).agg(F.count(F.lit(1)).alias("support"), F.sum((F.col(real) == F.col(predicted)).cast("long")).alias("tp"))
    p = report.groupBy(F.col(predicted).alias("class")).agg(F.count(F.lit(1)).alias("claimed"))
    df = r.join(p, "class", "full").fillna(0)
    total = F.sum("support").over(Window.partitionBy())
    return df.select("class", "support", F.coalesce(F.try_divide("tp", "claimed"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("claimed")), F.lit(0.0)).alias("f1"), times.chance_f1(F.col("support") / total).alias("chance_f1"))


def majority_baseline(df, by, column):
    """Share of the commonest class and its entropy."""
    n = df.groupBy(by, column).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(by).agg((F.max("n") / F.sum("n")).alias("base_acc")).withColumn("base_loss", times.binary_entropy("base_acc"))


def below_baseline(df, baseline, by, most):
    """Rows of groups whose majority share is under a limit."""
    return df.join(baseline.filter(F.col("base_acc") < most).select(by), by, "left_semi")


def chance_accuracies(df, column):
    """Random guess by shares, mean share, majority and 1 / k."""
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return p.agg(F.sum(F.col("p") ** 2).alias("random"), F.avg("p").alias("mean_share"), F.max("p").alias("majority"), (1 / F.count(F.lit(1))).alias("uniform"))


def accuracy_by_level(report, columns):
    """Share of correct rows for each level of each categorical column."""
    long = report.select("ok", *columns).unpivot(["ok"], list(columns), "column", "level")
    return long.groupBy("column", "level").agg(F.avg("ok").alias("accuracy"), F.count(F.lit(1)).alias("support"))


def accuracy_by_tag(report):
    """Accuracy by tag, as mean over species first."""
    return report.groupBy("tag", "species").agg(F.avg("ok").alias("a")).groupBy("tag").agg(F.avg("a").alias("accuracy"))


def taxa_blocks(confused, animals):
    """Mean over species of the confusion that falls into each taxa."""
    t = animals.select("species", "taxa").distinct()
    df = confused.join(t.select(F.col("species").alias("real"), F.col("taxa").alias("taxa_real")), "real").join(t.select(F.col("species").alias("pred"), F.col("taxa").alias("taxa_pred")), "pred")
    return df.groupBy("real", "taxa_real", "taxa_pred").agg(F.sum("share").alias("s")).groupBy("taxa_real", "taxa_pred").agg(F.avg("s").alias("share"))


def accuracy_by_sample_size(report, keys=("species_downsampled", "n", "random_state"), mode="all"):
    """Accuracy of each species evaluated for each downsampled species, size and seed; ``same``, ``others`` or ``all`` pairs."""
    same = F.col("species_downsampled") == F.col("species")
    df = {"all": report, "same": report.filter(same), "others": report.filter(~same)}[mode]
    return df.groupBy(*keys, F.col("species").alias("species_eval")).agg(F.avg("ok").alias("accuracy"))


def mean_accuracy(sized, by=("species_downsampled", "n")):
    """Mean accuracy over species. Values are added by size, so that equal accuracies give equal means on any layout; a species is one value."""
    listed = F.array_sort(F.collect_list("accuracy"))
    return sized.groupBy(*by).agg((F.try_divide(F.aggregate(listed, F.lit(0.0), lambda s, x: s + x), F.count("accuracy"))).alias("accuracy"))


def transfer_statistics(sized, by=("species_downsampled", "species_eval")):
    """Correlation, slope and difference of accuracy with the sample size; NaN, as in SQL, where the sizes (for the correlation: or accuracies) do not vary."""
    x, y = (F.when(F.col("n").isNotNull() & F.col("accuracy").isNotNull(), F.col(c).cast("double")) for c in ("n", "accuracy"))
    defined = lambda v: F.when(F.count(x) > 0, F.coalesce(v, F.lit(float("nan"))))
    over = lambda v: F.try_divide(F.covar_pop(x, y), F.nullif(v, F.lit(0.0)))
    return sized.groupBy(*by).agg(defined(over(F.stddev_pop(x) * F.stddev_pop(y))).alias("corr"), defined(over(F.var_pop(x))).alias("slope"), (F.max_by("accuracy", "n") - F.min_by("accuracy", "n")).alias("diff"))


def maintained_accuracy(report_a, report_b, keys=("id", "kfold", "random_state")):
    """P(B right | A right), P(B right), their effect size, and the chi-square probability of independence (one degree of freedom)."""
    return _maintained(report_a.select(*keys, F.col("ok").alias("a")).join(report_b.select(*keys, F.col("ok").alias("b")), list(keys)))


def maintained_summary(report, setting="setting", seed="random_state", keys=("id",)):
    """:func:`maintained_accuracy` of every ordered pair of settings, averaged over the seeds in which it is defined."""
    a = report.select(*keys, seed, F.col(setting).alias("setting_a"), F.col("ok").alias("a"))
    b = report.select(*keys, seed, F.col(setting).alias("setting_b"), F.col("ok").alias("b"))
    per_seed = _maintained(a.join(b, [*keys, seed]).filter("setting_a <> setting_b"), ("setting_a", "setting_b", seed))
    return per_seed.groupBy("setting_a", "setting_b").agg(*[F.avg(c).alias(c) for c in ("p_b_given_a", "p_b", "chi2", "h", "p_value")], F.count("chi2").alias("n_seeds"))


def _maintained(df, by=()):
    t = df.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("a").alias("na"), F.sum("b").alias("nb"), F.sum(F.col("a") * F.col("b")).alias("ab"))
    chi = F.try_divide(F.col("n") * (F.col("n") * F.col("ab") - F.col("na") * F.col("nb")) ** 2, F.col("na") * F.col("nb") * (F.col("n") - F.col("na")) * (F.col("n") - F.col("nb")))
    p = t.select(*by, F.try_divide("ab", "na").alias("p_b_given_a"), (F.col("nb") / F.col("n")).alias("p_b"), chi.alias("chi2"))
    return p.withColumns({"h": times.cohens_h("p_b_given_a", "p_b"), "p_value": chi_square_tail(F.col("chi2"))})


#: Fixed coefficients of the published Chebyshev fit of erfc.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def chi_square_tail(chi):
    """P(chi-square with one degree of freedom > chi), from a rational approximation of erfc with relative error under 1.2e-7."""
    z = F.sqrt(chi / 2)
    t = 1 / (1 + z / 2)
    poly = F.lit(ERFC[-1])
    for x in ERFC[-2::-1]:
        poly = poly * t + x
    return t * F.exp(poly - z * z)


def transfer_matrix(transfer, baseline):
    """Best of real and switched labels for each train and test species, minus the baseline; switched ones negative.

    ``transfer``: ``species_train, species_test, label_mode, fold, acc``.
    """
    m = transfer.groupBy("species_train", "species_test", "label_mode").agg(F.avg("acc").alias("acc"), F.stddev_samp("acc").alias("std"))
    best = m.groupBy("species_train", "species_test").agg(F.max_by(F.struct("label_mode", "acc", "std"), F.struct("acc", (F.col("label_mode") == "real").cast("int"))).alias("b"))
    df = best.select("species_train", "species_test", "b.*").join(baseline.select(F.col("species").alias("species_test"), "base_acc"), "species_test")
    return df.select("species_train", "species_test", "label_mode", (F.col("acc") - F.col("base_acc")).alias("gain"), "std")


def multi_transfer(transfer, baseline, stages):
    """Accuracy of each train and test species over folds, its deviation, the baseline and the number of the test species' categories.

    ``stages``: ``species, stage``; a species without stages has none.
    """
    m = transfer.groupBy("species_train", "species_test").agg(F.avg("acc").alias("acc"), F.stddev_pop("acc").alias("std"))
    kinds = stages.groupBy(F.col("species").alias("species_test")).agg(F.count_distinct("stage").alias("n_categories"))
    df = m.join(baseline.select(F.col("species").alias("species_test"), "base_acc"), "species_test", "left").join(kinds, "species_test", "left")
    return df.fillna(0, ["n_categories"])


def clean_transfer(matrix, least=0.01):
    """Transfer gains that count: own species, losses and tiny ones go, switched ones turn negative; long form without empty rows."""
    g = F.when(F.col("label_mode") != "real", -F.col("gain")).otherwise(F.col("gain"))
    return matrix.filter((F.col("species_train") != F.col("species_test")) & (F.col("gain") >= least)).select("species_train", "species_test", g.alias("gain"))


def remapped_accuracy(df, baseline):
    """Accuracy, baseline and improvement of stage predictions for each species."""
    a = df.groupBy("species").agg(_mean(F.col("stage") == F.col("predicted")).alias("accuracy"))
    return a.join(baseline, "species").select("species", "accuracy", "base_acc", (F.col("accuracy") - F.col("base_acc")).alias("improvement"))


def method_summary(df):
    """Mean and population deviation of the best accuracy of each species by method: long form of the summary table."""
    best = df.groupBy("species", "method", "fold").agg(F.max("acc").alias("acc"))
    return best.groupBy("species", "method").agg(F.avg("acc").alias("mean"), F.stddev_pop("acc").alias("std"))


def best_settings(df, base, most_base):
    """Best accuracy of each species over settings and its gain over the baseline, where the baseline leaves room."""
    best = df.groupBy("species").agg(F.max("acc").alias("best"))
    return best.join(base.filter(F.col("base_acc") < most_base), "species").select("species", "best", "base_acc", (F.col("best") - F.col("base_acc")).alias("gain"))


def joined_events(a, b, keys, column_a, column_b, limit_a=0.0, limit_b=0.0):
    """Two long matrices joined and turned to events ``x`` and ``y``."""
    return a.join(b, list(keys)).select(*keys, (F.col(column_a) > limit_a).cast("double").alias("x"), (F.col(column_b) > limit_b).cast("double").alias("y"))


def lift(events):
    """P(y | x) / P(y), the contingency table, and the chi-square with Yates' correction and its probability."""
    t = events.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("x").alias("nx"), F.sum("y").alias("ny"), F.sum(F.col("x") * F.col("y")).alias("nxy"))
    gap = F.greatest(F.lit(0.0), F.abs(F.col("n") * F.col("nxy") - F.col("nx") * F.col("ny")) - F.col("n") / 2)
    chi = F.try_divide(F.col("n") * gap**2, F.col("nx") * F.col("ny") * (F.col("n") - F.col("nx")) * (F.col("n") - F.col("ny")))
    t = t.withColumns({"lift": F.try_divide(F.col("nxy") * F.col("n"), F.col("nx") * F.col("ny")), "chi2": chi})
    return t.withColumn("p_value", chi_square_tail(F.col("chi2")))


def rmse_vs_constant(predictions, by=()):
    """Root mean square error of predictions and of the constant mean, and the skill; for each setting in ``by``."""
    e = predictions.groupBy(*by).agg(F.sqrt(F.avg((F.col("y") - F.col("pred")) ** 2)).alias("rmse"), F.stddev_pop("y").alias("base"))
    return e.withColumn("skill", 1 - F.try_divide("rmse", "base"))


def confidence(report, column="confidence"):
    """Mean and population deviation of the confidence of correct and of wrong rows."""
    return report.groupBy("prediction").agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))


def taxa_accuracy_intervals(report, setting, **options):
    """:func:`taxa_accuracy` of each setting with a corrected bootstrap interval over the taxa's species; ``options`` as in ``stats.bca_interval``."""
    from . import stats

    per = report.groupBy(setting, "taxa", "species").agg(F.avg("ok").alias("a")).withColumn("_k", F.concat_ws("|", F.col(setting).cast("string"), "taxa"))
    mean = per.groupBy("_k", setting, "taxa").agg(F.avg("a").alias("accuracy"), F.count(F.lit(1)).alias("n_species"))
    return mean.join(stats.bca_interval(per, "_k", "a", order="species", **options), "_k", "left").drop("_k")


def taxa_accuracy(report):
    """Mean over species of species accuracy for each taxa."""
    return report.groupBy("taxa", "species").agg(F.avg("ok").alias("a")).groupBy("taxa").agg(F.avg("a").alias("accuracy"), F.count(F.lit(1)).alias("n_species"))
