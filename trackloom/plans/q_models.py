"""Queries on model preparation and Spark models."""

from pyspark.sql import functions as F

from ..operators import models as M, prune
from ..sources import io
from .base import query
from .q_motion import r6
from .q_report import rounded
from .q_tables import MD5, tracks


def points(read):
    df = read("fixes").join(read("animals"), "id").filter("env is not null")
    return M.prepare(df.select("id", "fix_id", "date_time", "latitude", "longitude", "env"), tracks(read), label="sex")


@query("m01_prepared_fixes", "M1 X6 V7", """WITH t AS (SELECT a.*, count(*) OVER (PARTITION BY species) AS n FROM animals a), k AS (SELECT *, dense_rank() OVER (ORDER BY species)-1 AS code FROM t WHERE n>=12)
    SELECT fix_id, code, round(cos(radians(latitude))*cos(radians(longitude)),6)+0.0 AS x, round(sin(radians(latitude)),6)+0.0 AS z FROM fixes JOIN k USING (id)""")
def _(read):
    df = M.prepare(read("fixes"), tracks(read), prune_options={"min_animals": 12}, delete=["env"])
    return df.select("fix_id", F.col("code").cast("long").alias("code"), r6("x").alias("x"), r6("z").alias("z"))


@query("m03_standardised", "M3", "WITH s AS (SELECT avg(env) AS m, stddev_pop(env) AS d FROM fixes WHERE id%5<>0) SELECT fix_id, round(coalesce((env-m)/d,0.0),6)+0.0 AS env FROM fixes, s")
def _(read):
    return M.standardise(read("fixes").select("fix_id", "id", "env"), ["env"], F.col("id") % 5 != 0).select("fix_id", r6("env").alias("env"))


@query("m04_standardised_by_group", "M4 M5", """WITH f AS (SELECT fix_id, id, env, species FROM fixes JOIN animals USING (id)), g AS (SELECT avg(env) AS m, stddev_pop(env) AS d FROM f WHERE species<>'S3' AND id%5<>0),
    s AS (SELECT species, avg(env) AS m, stddev_pop(env) AS d FROM f WHERE species<>'S3' AND id%5<>0 GROUP BY species)
    SELECT fix_id, round(coalesce((env-coalesce(s.m,g.m))/coalesce(s.d,g.d),0.0),6)+0.0 AS env FROM f LEFT JOIN s USING (species), g""")
def _(read):
    df = M.point_table(read("fixes").select("fix_id", "id", "env"), read("animals").select("id", "species"))
    return M.standardise(df, ["env"], (F.col("species") != "S3") & (F.col("id") % 5 != 0), "species").select("fix_id", r6("env").alias("env"))


@query("m06_sequences", "M6", """WITH r AS (SELECT id, latitude, row_number() OVER (PARTITION BY id ORDER BY date_time, fix_id)-1 AS r, count(*) OVER (PARTITION BY id) AS n FROM fixes), a AS (SELECT DISTINCT id, n FROM r)
    SELECT a.id, CAST(i AS INTEGER) AS slot, round(coalesce(latitude,0.0),6)+0.0 AS latitude FROM a CROSS JOIN range(64) t(i) LEFT JOIN r ON r.id=a.id AND r.r=i*CASE WHEN a.n>64 THEN 2 ELSE 1 END""")
def _(read):
    s = M.blocks(M.sequences(read("fixes"), ["latitude"], 64, 2), 16)
    return s.select("id", F.posexplode(F.flatten("sequence")).alias("slot", "p")).select("id", "slot", r6(F.get("p", F.lit(0))).alias("latitude"))


PRED = "p AS (SELECT id, CAST((fix_id*7)%4 AS INTEGER) AS pred FROM fixes)"


def given(read):
    return read("fixes").withColumns({"pred": ((F.col("fix_id") * 7) % 4).cast("int"), "probs": F.transform(F.array(*[F.lit(i) for i in range(3)]), lambda i: ((F.col("fix_id") * (i + 2)) % 10 + 1) / 33)})


@query("m10_majority_vote", "M10", f"WITH {PRED}, n AS (SELECT id, pred, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, pred) AS k, sum(n) OVER (PARTITION BY id) AS t FROM n) SELECT id, pred, round(n/t,6)+0.0 AS confidence FROM r WHERE k=1")
def _(read):
    return rounded(M.majority_vote(given(read)), "confidence").select("id", "pred", "confidence")


@query("m11_probability_vote", "M11", "WITH p AS (SELECT id, CAST(i AS INTEGER) AS pred, sum(((fix_id*(i+2))%10+1)/33.0) AS p FROM fixes, range(3) t(i) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, pred) AS k, sum(p) OVER (PARTITION BY id) AS t FROM p) SELECT id, pred, round(p/t,6)+0.0 AS confidence FROM r WHERE k=1")
def _(read):
    return rounded(M.probability_vote(given(read)), "confidence").select("id", "pred", "confidence")


@query("m12_track_prediction", "M12", "SELECT fix_id AS id, CASE WHEN ((fix_id*3)%10+1)/33.0 >= 0.15 THEN 1 ELSE 0 END AS pred FROM fixes")
def _(read):
    return M.track_prediction(given(read).select(F.col("fix_id").alias("id"), "probs"), 0.15).select("id", "pred")


@query("m14_log_loss", "M14", "SELECT CAST(id%5 AS BIGINT) AS fold, round(avg(-ln(((fix_id*(id%3+2))%10+1)/33.0)),6)+0.0 AS loss FROM fixes GROUP BY 1")
def _(read):
    df = given(read).withColumns({"code": F.col("id") % 3, "fold": F.col("id") % 5})
    return rounded(M.log_loss(df), "loss")


@query("m07_cross_validated_tree", "M2 M5 M7 M10 M13")
def _(read):
    p = points(read)
    voted = M.cross_validate(p, ["x", "y", "z", "env"], k=3, kind="tree")
    return M.classification_report(p.select("id", "code").distinct(), voted).select("id", "fold", "predicted", "prediction", "classifier")


@query("m07_forest", "M7 M11")
def _(read):
    p = points(read)
    model = M.fit(p.filter("id % 4 <> 0"), ["x", "y", "z", "env"], kind="forest", numTrees=5, maxDepth=5)
    return M.probability_vote(M.predict(model, p.filter("id % 4 = 0")))


@query("m08_support_vectors", "M8")
def _(read):
    p = points(read)
    return M.majority_vote(M.predict(M.fit(p.filter("id % 4 <> 0"), ["x", "y", "z"], kind="svm"), p.filter("id % 4 = 0")))


@query("m09_boosted_trees", "M9")
def _(read):
    p = points(read)
    return M.majority_vote(M.predict(M.fit(p.filter("id % 4 <> 0"), ["x", "y", "z"], kind="boosting", maxIter=2), p.filter("id % 4 = 0")))


@query("m15_regression", "M15 C24")
def _(read):
    df = read("fixes").groupBy("id").agg(F.avg("latitude").alias("lat"), F.avg("env").alias("env"), F.count(F.lit(1)).alias("n")).withColumn("accuracy", (F.col("id") * 37 % 100) / 100)
    return M.cross_validated_regression(df, ["lat", "env", "n"], "accuracy", k=2, numTrees=5)


# Trees of one split over bands of latitude: SQL finds the same split, midway between two bands, from counts by band.

BANDED = "b AS (SELECT id, CAST(dense_rank() OVER (ORDER BY species)-1 AS INTEGER) AS code FROM animals), pts AS (SELECT fix_id, id, code, floor(latitude/20) AS v FROM fixes JOIN b USING (id))"
STUMP = """c AS (SELECT p.g, f.fold, p.v, p.code, count(*) AS n FROM p JOIN (SELECT DISTINCT g, fold FROM p) f ON p.g=f.g AND p.fold<>f.fold GROUP BY ALL),
    t AS (SELECT g, fold, (v+lead(v, 1, v) OVER (PARTITION BY g, fold ORDER BY v))/2 AS t FROM (SELECT DISTINCT g, fold, v FROM c)), s AS (SELECT g, fold, t, v<=t AS l, code, sum(n) AS n FROM c JOIN t USING (g, fold) GROUP BY ALL),
    u AS (SELECT g, fold, t, l, sum(n*n)/sum(n) AS u FROM s GROUP BY ALL), w AS (SELECT g, fold, t, sum(u) AS u FROM u GROUP BY ALL),
    best AS (SELECT g, fold, t FROM w QUALIFY row_number() OVER (PARTITION BY g, fold ORDER BY u DESC, t)=1),
    leaf AS (SELECT g, fold, l, t, code AS predicted FROM s JOIN best USING (g, fold, t) QUALIFY row_number() OVER (PARTITION BY g, fold, l ORDER BY n DESC, code)=1),
    x AS (SELECT p.g, p.fold, id, predicted, count(*) AS n FROM p JOIN leaf ON p.g=leaf.g AND p.fold=leaf.fold AND (p.v<=t)=l GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER (PARTITION BY g, id) AS total, row_number() OVER (PARTITION BY g, id ORDER BY n DESC, predicted) AS k FROM x)"""


def banded(read):
    labels = prune.dense_codes(read("animals").select("id", "species"), "species")
    return M.point_table(read("fixes").select("id", "fix_id", F.floor(F.col("latitude") / 20).cast("double").alias("v")), labels)


@query("m07_one_split", "M5 M7 M10 M13", f"""WITH {BANDED}, fold AS (SELECT id, (row_number() OVER (PARTITION BY code ORDER BY {MD5}, id)-1)%3 AS fold FROM (SELECT DISTINCT id, code FROM pts)),
    p AS (SELECT 0 AS g, fold, id, code, v FROM pts JOIN fold USING (id)), {STUMP}
    SELECT r.id, CAST(fold AS INTEGER) AS fold, predicted, CASE WHEN predicted=code THEN 'Correct' ELSE 'Wrong' END AS prediction, round(n/total,6)+0.0 AS confidence FROM r JOIN b USING (id) WHERE k=1""")
def _(read):
    p = banded(read)
    voted = M.cross_validate(p, ["v"], k=3, kind="tree", maxDepth=1)
    return rounded(M.classification_report(p.select("id", "code").distinct(), voted), "confidence").select("id", "fold", "predicted", "prediction", "confidence")


@query("m18_sweep_of_splits", "M18", f"""WITH {BANDED}, seeds AS (SELECT * FROM (VALUES (0,1,60),(1,2,90)) s(g, seed, n)),
    chosen AS (SELECT g, id, code FROM seeds CROSS JOIN (SELECT DISTINCT id, code FROM pts) QUALIFY row_number() OVER (PARTITION BY g ORDER BY md5(concat(id,'-',seed)), id)<=n),
    fold AS (SELECT g, id, (row_number() OVER (PARTITION BY g, code ORDER BY {MD5}, id)-1)%2 AS fold FROM chosen),
    p AS (SELECT g, fold, id, code, v FROM pts JOIN fold USING (id)), {STUMP}
    SELECT CAST(g AS INTEGER) AS setting, id, CAST(fold AS INTEGER) AS fold, predicted, round(n/total,6)+0.0 AS confidence FROM r WHERE k=1""")
def _(read):
    p = banded(read)
    settings = p.sparkSession.createDataFrame([("tree", 1, 60, 1), ("tree", 2, 90, 1)], "kind string, seed int, n int, maxDepth int")
    return rounded(M.sweep(p, settings, ["v"]), "confidence")


# Tracks lie in one hemisphere each, so a linear boundary tells all rows that it is fitted to apart.
@query("m08_hemispheres", "M8", "SELECT id, CASE WHEN avg(latitude)>=0 THEN 1 ELSE 0 END AS pred, 1.0::DOUBLE AS confidence FROM fixes GROUP BY id")
def _(read):
    f = read("fixes").select("id", "latitude")
    p = M.point_table(f, f.groupBy("id").agg((F.avg("latitude") >= 0).cast("int").alias("code")))
    return M.majority_vote(M.predict(M.fit(p, ["latitude"], kind="svm", maxIter=200), p)).select("id", "pred", "confidence")


@query("m09_boosted_splits", "M9", f"""WITH {BANDED}, c AS (SELECT v, code, count(*) AS n FROM pts WHERE id%4<>0 GROUP BY ALL), k AS (SELECT DISTINCT code AS cls FROM c), t AS (SELECT (v+lead(v, 1, v) OVER (ORDER BY v))/2 AS t FROM (SELECT DISTINCT v FROM c)),
    s AS (SELECT cls, t, v<=t AS l, sum(n) AS n, sum(CASE WHEN code=cls THEN n ELSE -n END) AS y FROM c, k, t GROUP BY ALL), w AS (SELECT cls, t, sum(y*y/n) AS u FROM s GROUP BY ALL),
    best AS (SELECT cls, t FROM w QUALIFY row_number() OVER (PARTITION BY cls ORDER BY u DESC, t)=1), leaf AS (SELECT cls, t, l, y/n AS score FROM s JOIN best USING (cls, t)),
    a AS (SELECT fix_id, id, cls AS pred FROM pts JOIN leaf ON (v<=t)=l WHERE id%4=0 QUALIFY row_number() OVER (PARTITION BY fix_id, id ORDER BY score DESC, cls)=1),
    x AS (SELECT id, pred, count(*) AS n FROM a GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY id) AS total, row_number() OVER (PARTITION BY id ORDER BY n DESC, pred) AS k FROM x)
    SELECT id, pred, round(n/total,6)+0.0 AS confidence FROM r WHERE k=1""")
def _(read):
    p = banded(read)
    model = M.fit(p.filter("id % 4 <> 0"), ["v"], kind="boosting", maxIter=1, maxDepth=1)
    return rounded(M.majority_vote(M.predict(model, p.filter("id % 4 = 0"))), "confidence").select("id", "pred", "confidence")


@query("m15_linear_regression", "M15", f"""WITH d AS (SELECT id, avg(latitude) AS a, count(*) AS b, (id*37%100)/100 AS y FROM fixes GROUP BY id),
    f AS (SELECT *, (row_number() OVER (PARTITION BY floor(y*10) ORDER BY {MD5}, id)-1)%4 AS fold FROM d),
    m AS (SELECT t.fold, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a,b) AS ab, covar_pop(a,y) AS ay, covar_pop(b,y) AS yb
          FROM f JOIN (SELECT DISTINCT fold FROM f) t ON f.fold<>t.fold GROUP BY t.fold)
    SELECT id, CAST(fold AS INTEGER) AS fold, y, round(my+((bb*ay-ab*yb)*(a-ma)+(aa*yb-ab*ay)*(b-mb))/(aa*bb-ab*ab),6)+0.0 AS pred FROM f JOIN m USING (fold)""")
def _(read):
    df = read("fixes").groupBy("id").agg(F.avg("latitude").alias("a"), F.count(F.lit(1)).alias("b")).withColumn("accuracy", (F.col("id") * 37 % 100) / 100)
    return rounded(M.cross_validated_regression(df, ["a", "b"], "accuracy", k=4, kind="linear"), "pred")


@query("m16_feature_clusters", "M16 M17 T26")
def _(read):
    df = read("fixes").filter("env is not null").withColumn("near", F.col("latitude") + F.col("env") / 1000)
    return M.feature_clusters(df.join(read("animals"), "id"), ["latitude", "longitude", "near"], 0.3)


@query("m18_sweep", "M18")
def _(read):
    p = points(read)
    settings = p.sparkSession.createDataFrame([("tree", 1, 60), ("tree", 2, 90)], "kind string, seed int, n int")
    return M.sweep(p, settings, ["x", "y", "z"])


@query("s06_clean_grid", "S6", "SELECT cell_lat, cell_lon, CASE WHEN CAST(floor(value) AS BIGINT)%10=0 THEN NULL ELSE value END AS effort FROM grid1")
def _(read):
    raw = read("grid1").select((F.col("cell_lat") + 0.0).alias("lat"), (F.col("cell_lon") + 0.0).alias("lon"), F.when(F.floor("value") % 10 == 0, 0.0).otherwise(F.col("value")).alias("effort"))
    return io.clean_effort(raw)


@query("s09_year_slices", "S9 S10 S11", "SELECT fix_id, date_time FROM long_fixes WHERE year(date_time) IN (1996,1997) UNION ALL SELECT fix_id, date_time FROM long_fixes WHERE year(date_time)=1999 AND month(date_time)=5")
def _(read):
    f = read("long_fixes")
    out = io.years(f, [1996, 1997]).unionByName(io.slice_time(f, 1999, 5))
    return out.select("fix_id", F.col("date_time").cast("timestamp_ntz").alias("date_time"))


@query("s03_legacy_fixes", "S3", "SELECT fix_id, CASE WHEN fix_id%9=0 THEN 6.0 ELSE CAST(fix_id%5 AS DOUBLE) END AS satellites, CAST(month(date_time) AS INTEGER) AS month FROM fixes")
def _(read):
    raw = read("fixes").withColumns({"NumberOfSatellites": F.when(F.col("fix_id") % 9 == 0, ">5").otherwise((F.col("fix_id") % 5).cast("string")), "ResidualError": F.lit("0.5"), "DATE": F.lit("x"), "TIME": F.lit("y"), "LATITUDE": F.col("latitude").cast("string"), "LONGITUDE": F.col("longitude").cast("string"), "DATE_TIME": F.col("date_time")})
    df = io.clean_legacy(raw)
    return df.select("fix_id", F.col("NumberOfSatellites").alias("satellites"), F.col("MONTH").alias("month"))


_ = prune
