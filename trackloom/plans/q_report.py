"""Queries on classification reports."""

from pyspark.sql import functions as F

from ..functions import times
from ..operators import enrich, report as R
from .base import query
from .q_motion import r6, r9

OK = "ok AS (SELECT *, CASE WHEN predicted=species THEN 1.0 ELSE 0.0 END AS ok FROM reports)"


def poly(c, x):
    """A polynomial in SQL, its highest coefficient first."""
    return "".join("(" for _ in c[1:]) + repr(c[0]) + "".join(f"*{x}+{k!r})" for k in c[1:])


def two_sided(x):
    """Probability that a standard normal is beyond ``x`` on either side, in SQL."""
    t = f"(1/(1+abs({x})/sqrt(2)/2))"
    return f"({t}*exp({poly(R.ERFC[::-1], t)}-{x}*{x}/2))"


def rep(read):
    return R.marked(read("reports"))


def rounded(df, *names):
    return df.withColumns({c: r6(c) for c in names})


@query("c01_accuracy_by_animal", "C1 M13", f"WITH {OK} SELECT id, round(avg(ok),6)+0.0 AS accuracy FROM ok GROUP BY id")
def _(read):
    return rounded(R.accuracy_by_animal(rep(read)), "accuracy")


@query("c02_overall_and_species", "C2", f"""WITH {OK}, s AS (SELECT random_state, species, avg(ok) AS a, sum(ok) AS s, count(*) AS n FROM ok GROUP BY ALL), d AS (SELECT random_state, sum(s)/sum(n) AS o, avg(a) AS m FROM s GROUP BY random_state)
    SELECT round(avg(o),6)+0.0 AS acc_overall, round(stddev_samp(o),6)+0.0 AS std_overall, round(avg(m),6)+0.0 AS acc_species_mean, round(stddev_samp(m),6)+0.0 AS std_species_mean FROM d""")
def _(read):
    return rounded(R.overall_and_species_accuracy(rep(read)), "acc_overall", "std_overall", "acc_species_mean", "std_species_mean")


@query("c03_confusion", "C3", """WITH l AS (SELECT DISTINCT species AS x FROM reports UNION SELECT DISTINCT predicted FROM reports), c AS (SELECT species, predicted, count(*) AS n FROM reports GROUP BY ALL)
    SELECT a.x AS real, b.x AS pred, coalesce(n,0) AS n, round(coalesce(n,0)/sum(coalesce(n,0)) OVER (PARTITION BY a.x),6)+0.0 AS share FROM l a CROSS JOIN l b LEFT JOIN c ON c.species=a.x AND c.predicted=b.x""")
def _(read):
    return rounded(R.confusion(rep(read)), "share")


TAXA = "t AS (SELECT DISTINCT species, taxa FROM animals)"


@query("c04_taxa_confusion", "C4", f"WITH {TAXA}, r AS (SELECT r.taxa, t.taxa AS pred_taxa, r.species=predicted AS ok FROM reports r JOIN t ON t.species=predicted) SELECT taxa, pred_taxa, round(count(*)/(SELECT count(*) FROM r x WHERE x.taxa=r.taxa),6)+0.0 AS share FROM r WHERE NOT ok GROUP BY taxa, pred_taxa")
def _(read):
    return rounded(R.taxa_confusion(rep(read), read("animals")), "share")


@query("c05_confusion_change", "C5", f"""WITH {TAXA}, r AS (SELECT r.random_state, r.taxa, t.taxa AS pred_taxa, r.species=predicted AS ok FROM reports r JOIN t ON t.species=predicted),
    c AS (SELECT random_state, taxa, pred_taxa, count(*)/(SELECT count(*) FROM r x WHERE x.taxa=r.taxa AND x.random_state=r.random_state) AS s FROM r WHERE NOT ok GROUP BY random_state, taxa, pred_taxa)
    SELECT coalesce(a.taxa,b.taxa) AS taxa, coalesce(a.pred_taxa,b.pred_taxa) AS pred_taxa, round(coalesce(b.s,0)-coalesce(a.s,0),6)+0.0 AS change FROM (SELECT * FROM c WHERE random_state=1) a FULL JOIN (SELECT * FROM c WHERE random_state=2) b ON a.taxa=b.taxa AND a.pred_taxa=b.pred_taxa""")
def _(read):
    r, a = rep(read), read("animals")
    return rounded(R.confusion_change(R.taxa_confusion(r.filter("random_state = 1"), a), R.taxa_confusion(r.filter("random_state = 2"), a)), "change")


@query("c06_class_scores", "C6 C7", """WITH r AS (SELECT species AS c, count(*) AS support, sum(CASE WHEN species=predicted THEN 1 ELSE 0 END) AS tp FROM reports GROUP BY 1), p AS (SELECT predicted AS c, count(*) AS claimed FROM reports GROUP BY 1)
    SELECT c AS class, support, round(tp/claimed,6)+0.0 AS precision, round(tp/support,6)+0.0 AS recall, round(2*tp/(support+claimed),6)+0.0 AS f1, round(2*(support/sum(support) OVER ())/(support/sum(support) OVER ()+1),6)+0.0 AS chance_f1 FROM r FULL JOIN p USING (c)""")
def _(read):
    return rounded(R.class_scores(rep(read)), "precision", "recall", "f1", "chance_f1")


BASE = "b AS (SELECT species, max(n)/sum(n) AS base_acc FROM (SELECT species, stage, count(*) AS n FROM fixes JOIN animals USING (id) WHERE stage<>'unknown' GROUP BY 1, 2) GROUP BY species)"


def baseline(read):
    df = read("fixes").join(read("animals"), "id").filter("stage <> 'unknown'")
    return R.majority_baseline(df, "species", "stage")


@query("c08_majority_baseline", "C8", f"WITH {BASE} SELECT species, round(base_acc,6)+0.0 AS base_acc, round(-(base_acc*ln(base_acc)+(1-base_acc)*ln(1-base_acc)),6)+0.0 AS base_loss FROM b")
def _(read):
    return rounded(baseline(read), "base_acc", "base_loss")


@query("f21_baseline_filter", "F21", f"WITH {BASE} SELECT id FROM animals WHERE species IN (SELECT species FROM b WHERE base_acc < 0.36)")
def _(read):
    return R.below_baseline(read("animals"), baseline(read), "species", 0.36).select("id")


@query("c09_chance_accuracies", "C9", "WITH p AS (SELECT count(*)/(SELECT count(*) FROM animals) AS p FROM animals GROUP BY tag) SELECT round(sum(p*p),6)+0.0 AS random, round(avg(p),6)+0.0 AS mean_share, round(max(p),6)+0.0 AS majority, round(1/count(*),6)+0.0 AS uniform FROM p")
def _(read):
    return rounded(R.chance_accuracies(read("animals"), "tag"), "random", "mean_share", "majority", "uniform")


@query("c10_accuracy_by_level", "C10", f"""WITH {OK} SELECT 'sex' AS "column", sex AS level, round(avg(ok),6)+0.0 AS accuracy, count(*) AS support FROM ok GROUP BY sex UNION ALL SELECT 'tag', tag, round(avg(ok),6)+0.0, count(*) FROM ok GROUP BY tag""")
def _(read):
    return rounded(R.accuracy_by_level(rep(read), ["sex", "tag"]), "accuracy")


@query("c11_accuracy_by_tag", "C11", f"WITH {OK}, s AS (SELECT tag, species, avg(ok) AS a FROM ok GROUP BY ALL) SELECT tag, round(avg(a),6)+0.0 AS accuracy FROM s GROUP BY tag")
def _(read):
    return rounded(R.accuracy_by_tag(rep(read)), "accuracy")


@query("c12_taxa_blocks", "C12", f"""WITH {TAXA}, c AS (SELECT species, predicted, count(*)/(SELECT count(*) FROM reports x WHERE x.species=r.species) AS s FROM reports r GROUP BY species, predicted),
    g AS (SELECT a.species, a.taxa AS taxa_real, x.taxa AS taxa_pred, coalesce(sum(s),0) AS s FROM t a CROSS JOIN (SELECT DISTINCT taxa FROM animals) x LEFT JOIN (SELECT c.*, t.taxa AS pt FROM c JOIN t ON t.species=c.predicted) c ON c.species=a.species AND c.pt=x.taxa GROUP BY ALL)
    SELECT taxa_real, taxa_pred, round(avg(s),6)+0.0 AS share FROM g GROUP BY ALL""")
def _(read):
    return rounded(R.taxa_blocks(R.confusion(rep(read)), read("animals")), "share")


SIZED = "sized AS (SELECT CASE WHEN kfold<2 THEN 'S1' ELSE 'S2' END AS species_downsampled, species, 10*(1+id%4) AS n, random_state, CASE WHEN predicted=species THEN 1.0 ELSE 0.0 END AS ok FROM reports)"


def sized(read):
    return rep(read).withColumns({"species_downsampled": F.when(F.col("kfold") < 2, "S1").otherwise("S2"), "n": 10 * (1 + F.col("id") % 4)})


@query("c13_accuracy_by_sample_size", "C13", f"WITH {SIZED} SELECT species_downsampled, n, random_state, species AS species_eval, round(avg(ok),6)+0.0 AS accuracy FROM sized WHERE species<>species_downsampled GROUP BY ALL")
def _(read):
    return rounded(R.accuracy_by_sample_size(sized(read), mode="others"), "accuracy")


@query("c14_transfer_statistics", "C14", f"""WITH {SIZED}, a AS (SELECT species_downsampled, species AS species_eval, n, avg(ok) AS accuracy FROM (SELECT *, taxa FROM (SELECT s.*, 1 AS taxa FROM sized s)) GROUP BY ALL),
    g AS (SELECT species_downsampled, 'all' AS species_eval, n, avg(accuracy) AS accuracy FROM a GROUP BY ALL)
    SELECT species_downsampled, round(corr(n,accuracy),6)+0.0 AS corr, round(regr_slope(accuracy,n),6)+0.0 AS slope, round(arg_max(accuracy,n)-arg_min(accuracy,n),6)+0.0 AS diff FROM g GROUP BY species_downsampled""")
def _(read):
    a = R.mean_accuracy(R.accuracy_by_sample_size(sized(read), keys=("species_downsampled", "n")))
    return rounded(R.transfer_statistics(a, ["species_downsampled"]), "corr", "slope", "diff")


@query("c15_maintained_accuracy", "C15 J23", f"""WITH {OK}, j AS (SELECT a.ok AS a, b.ok AS b FROM ok a JOIN ok b ON a.id=b.id AND a.random_state=1 AND b.random_state=2),
    t AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(a) AS na, sum(b) AS nb, sum(a*b) AS ab FROM j)
    SELECT round(ab/na,6)+0.0 AS p_b_given_a, round(nb/n,6)+0.0 AS p_b, round(n*pow(n*ab-na*nb,2)/(na*nb*(n-na)*(n-nb)),6)+0.0 AS chi2, round(2*asin(sqrt(ab/na))-2*asin(sqrt(nb/n)),6)+0.0 AS h, round({two_sided("sqrt(n*pow(n*ab-na*nb,2)/(na*nb*(n-na)*(n-nb)))")},6)+0.0 AS p_value FROM t""")
def _(read):
    r = rep(read)
    df = R.maintained_accuracy(r.filter("random_state = 1"), r.filter("random_state = 2"), keys=["id"])
    return rounded(df, "p_b_given_a", "p_b", "chi2", "h", "p_value")


TRANSFER = """transfer AS (SELECT species AS species_train, predicted AS species_test, CASE WHEN id%3=0 THEN 'switched-labels' ELSE 'real' END AS label_mode, kfold AS fold, ((id*37+random_state*11)%100)/100.0 AS acc FROM reports),
    m AS (SELECT species_train, species_test, label_mode, avg(acc) AS acc FROM transfer GROUP BY ALL),
    w AS (SELECT *, row_number() OVER (PARTITION BY species_train, species_test ORDER BY acc DESC, label_mode) AS k FROM m),
    x AS (SELECT species_train, species_test, label_mode, acc-base_acc AS gain FROM w JOIN b ON b.species=w.species_test WHERE k=1)"""


def transfer(read):
    t = read("reports").select(F.col("species").alias("species_train"), F.col("predicted").alias("species_test"), F.when(F.col("id") % 3 == 0, "switched-labels").otherwise("real").alias("label_mode"), F.col("kfold").alias("fold"), (((F.col("id") * 37 + F.col("random_state") * 11) % 100) / 100).alias("acc"))
    return R.transfer_matrix(t, baseline(read))


@query("c16_transfer_matrix", "C16", f"WITH {BASE}, {TRANSFER} SELECT species_train, species_test, label_mode, round(gain,9)+0.0 AS gain FROM x")
def _(read):
    return transfer(read).withColumn("gain", r9("gain")).drop("std")


@query("c18_clean_transfer", "C18", f"WITH {BASE}, {TRANSFER} SELECT species_train, species_test, round(CASE WHEN label_mode<>'real' THEN -gain ELSE gain END,9)+0.0 AS gain FROM x WHERE species_train<>species_test AND gain>=0.01")
def _(read):
    return R.clean_transfer(transfer(read)).withColumn("gain", r9("gain"))


@query("c19_remapped_accuracy", "C19", f"WITH {BASE}, a AS (SELECT species, avg(CASE WHEN (CASE WHEN fix_id%4=0 THEN 'non-breeding' ELSE stage END)=stage THEN 1.0 ELSE 0.0 END) AS a FROM fixes JOIN animals USING (id) WHERE stage<>'unknown' GROUP BY species) SELECT species, round(a,6)+0.0 AS accuracy, round(base_acc,6)+0.0 AS base_acc, round(a-base_acc,6)+0.0 AS improvement FROM a JOIN b USING (species)")
def _(read):
    df = read("fixes").join(read("animals"), "id").filter("stage <> 'unknown'").withColumn("predicted", F.when(F.col("fix_id") % 4 == 0, "non-breeding").otherwise(F.col("stage")))
    return rounded(R.remapped_accuracy(df, baseline(read)), "accuracy", "base_acc", "improvement")


METHODS = "meth AS (SELECT species, CASE random_state%2 WHEN 0 THEN 'fine-tuned' ELSE 'zero-shot' END AS method, kfold AS fold, ((id*31+random_state*7)%97)/97.0 AS acc FROM reports)"


def methods(read):
    return read("reports").select("species", F.when(F.col("random_state") % 2 == 0, "fine-tuned").otherwise("zero-shot").alias("method"), F.col("kfold").alias("fold"), (((F.col("id") * 31 + F.col("random_state") * 7) % 97) / 97).alias("acc"))


@query("c20_method_summary", "C20", f"WITH {METHODS}, x AS (SELECT species, method, fold, max(acc) AS acc FROM meth GROUP BY ALL) SELECT species, method, round(avg(acc),6)+0.0 AS mean, round(stddev_pop(acc),6)+0.0 AS std FROM x GROUP BY ALL")
def _(read):
    return rounded(R.method_summary(methods(read)), "mean", "std")


@query("c21_best_settings", "C21", f"WITH {BASE}, {METHODS}, x AS (SELECT species, max(acc) AS best FROM meth GROUP BY species) SELECT species, round(best,6)+0.0 AS best, round(base_acc,6)+0.0 AS base_acc, round(best-base_acc,6)+0.0 AS gain FROM x JOIN b USING (species) WHERE base_acc < 0.36")
def _(read):
    return rounded(R.best_settings(methods(read), baseline(read), 0.36), "best", "base_acc", "gain")


@query("c23_lift", "C22 C23", f"""WITH {BASE}, {TRANSFER}, e AS (SELECT CASE WHEN gain>0.1 THEN 1.0 ELSE 0.0 END AS x, CASE WHEN gain>0.2 THEN 1.0 ELSE 0.0 END AS y FROM x),
    t AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(x) AS DOUBLE) AS nx, CAST(sum(y) AS DOUBLE) AS ny, CAST(sum(x*y) AS DOUBLE) AS nxy FROM e)
    SELECT n, nx, ny, nxy, round(nxy*n/(nx*ny),6)+0.0 AS lift, round(n*pow(greatest(0.0,abs(n*nxy-nx*ny)-n/2),2)/(nx*ny*(n-nx)*(n-ny)),6)+0.0 AS chi2,
        round({two_sided("sqrt(n*pow(greatest(0.0,abs(n*nxy-nx*ny)-n/2),2)/(nx*ny*(n-nx)*(n-ny)))")},6)+0.0 AS p_value FROM t""")
def _(read):
    t = transfer(read).select("species_train", "species_test", "gain")
    events = R.joined_events(t.withColumnRenamed("gain", "gain_a"), t, ["species_train", "species_test"], "gain_a", "gain", 0.1, 0.2)
    return rounded(R.lift(events), "lift", "chi2", "p_value")


@query("c24_rmse_vs_constant", "C24", "WITH p AS (SELECT env AS y, env*0.5+10 AS pred FROM fixes WHERE env IS NOT NULL), m AS (SELECT avg(y) AS m FROM p) SELECT round(sqrt(avg(pow(y-pred,2))),6)+0.0 AS rmse, round(sqrt(avg(pow(y-m,2))),6)+0.0 AS base, round(1-sqrt(avg(pow(y-pred,2)))/sqrt(avg(pow(y-m,2))),6)+0.0 AS skill FROM p, m")
def _(read):
    return rounded(R.rmse_vs_constant(read("fixes").filter("env is not null").select(F.col("env").alias("y"), (F.col("env") * 0.5 + 10).alias("pred"))), "rmse", "base", "skill")


@query("c25_confidence", "C25", f"WITH {OK} SELECT CASE WHEN ok=1 THEN 'Correct' ELSE 'Wrong' END AS prediction, round(avg((id%50)/50.0),6)+0.0 AS mean, round(stddev_pop((id%50)/50.0),6)+0.0 AS std FROM ok GROUP BY 1")
def _(read):
    return rounded(R.confidence(rep(read).withColumn("confidence", (F.col("id") % 50) / 50)), "mean", "std")


@query("c27_taxa_accuracy", "C27", f"WITH {OK}, s AS (SELECT taxa, species, avg(ok) AS a FROM ok GROUP BY ALL) SELECT taxa, round(avg(a),6)+0.0 AS accuracy, count(*) AS n_species FROM s GROUP BY taxa")
def _(read):
    return rounded(R.taxa_accuracy(rep(read)), "accuracy")


_ = (times, enrich)
