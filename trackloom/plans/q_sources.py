"""Queries that go through readers, writers, stored tables and streams, and on operators that complete other rows of the inventory.

Files are written beside the checkpoints, which driver and executors share, and read back from there.
"""

from pyspark.sql import functions as F

from ..functions import geo, times
from ..operators import enrich, motion, prune, report as R, resample, stats as S
from ..sources import io
from ..store import folder
from ..streaming import rows
from .base import query
from .q_enrich import labelled
from .q_motion import r6, r9, steps_sql
from .q_report import BASE, OK, baseline, rep, rounded, two_sided
from .q_stats import CURVE, bca, boot

DAY = "dayofyear(date_time)-1+hour(date_time)/24+minute(date_time)/1440+CAST(floor(second(date_time)) AS DOUBLE)/86400"


def ntz(column):
    return F.col(column).cast("timestamp_ntz").alias(column)


@query("s01_fixes_csv", "S1", f'SELECT CAST(id AS VARCHAR) AS "ID", round(latitude,6)+0.0 AS "LATITUDE", round({DAY},9)+0.0 AS day, CAST(year(date_time) AS INTEGER) AS year FROM fixes')
def _(read):
    f = read("fixes")
    path = folder(f.sparkSession, "fixes")
    f.select(F.col("latitude").alias("LATITUDE"), F.col("longitude").alias("LONGITUDE"), F.date_format("date_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("DATE_TIME"), F.concat(F.lit(" "), F.col("id").cast("string")).alias("ID"), F.col("stage").alias("Stage")).write.csv(path, header=True, ignoreLeadingWhiteSpace=False)
    return io.read_fixes(f.sparkSession, path).select("ID", r6("LATITUDE").alias("LATITUDE"), r9("day").alias("day"), "year")


@query("s02_metadata_csv", "S2", 'SELECT CAST(id AS VARCHAR) AS "ID", species AS "COMMON_NAME", taxa AS "Taxa", sex AS "SEX" FROM animals')
def _(read):
    a = read("animals")
    path = folder(a.sparkSession, "metadata")
    a.select(F.col("id").alias("ID"), F.col("species").alias("Species"), F.col("taxa").alias("Taxa"), F.col("sex").alias("SEX")).write.csv(path, header=True)
    return io.read_metadata(a.sparkSession, path, ", SEX string")


@query("s05_base_table", "S4 S5", "SELECT id, date_trunc('millisecond', date_time) AS date_time, latitude, longitude FROM fixes")
def _(read):
    f = read("fixes")
    path = folder(f.sparkSession, "base")
    io.write_base(f, path)
    return f.sparkSession.read.parquet(path).select("id", ntz("date_time"), "latitude", "longitude")


@query("s06_effort_and_biodiversity_csv", "S6", """SELECT 'effort' AS grid, cell_lat, cell_lon, CASE WHEN CAST(floor(value) AS BIGINT)%10<>0 THEN value END AS value FROM grid1
    UNION ALL SELECT 'biodiversity', cell_lat, cell_lon, value FROM grid1""")
def _(read):
    g = read("grid1")
    effort, norm = folder(g.sparkSession, "effort"), folder(g.sparkSession, "biodiversity")
    zero = F.when(F.floor("value") % 10 == 0, 0.0).otherwise(F.col("value"))
    g.select(F.lit(1).alias("row"), F.lit("x").alias("dropped"), zero.alias("effort"), (F.col("cell_lat") + 0.0).alias("lat"), (F.col("cell_lon") + 0.0).alias("lon")).write.csv(effort, header=True)
    g.select(F.col("value").alias("EffectiveNorm"), (F.col("cell_lat") + 0.5).alias("Lat"), (F.col("cell_lon") + 0.5).alias("Lon")).write.csv(norm, header=True)
    spark = g.sparkSession
    parts = [(io.read_effort(spark, effort).withColumnRenamed("effort", "value"), "effort"), (io.read_biodiversity(spark, norm), "biodiversity")]
    a, b = (df.select(F.lit(n).alias("grid"), "cell_lat", "cell_lon", "value") for df, n in parts)
    return a.unionByName(b)


@query("s07_elevation_matrix", "S7", "SELECT 89-cell_lat AS i, cell_lon+180 AS j, coalesce(value,0.0) AS elevation FROM grid1 WHERE cell_lat<90 AND cell_lon<180")
def _(read):
    g = read("grid1").filter("cell_lat < 90 and cell_lon < 180")
    path = folder(g.sparkSession, "matrix")
    line = g.groupBy("cell_lat").agg(F.sort_array(F.collect_list(F.struct("cell_lon", F.coalesce("value", F.lit(0.0)).alias("v")))).alias("c"))
    text = F.concat_ws(" ", F.transform("c", lambda c: c["v"].cast("string")))
    line.select(text.alias("value"), "cell_lat").coalesce(1).sortWithinPartitions(F.desc("cell_lat")).select("value").write.text(path)  # 180 lines of one grid
    return io.read_matrix(g.sparkSession, path)


@query("s08_melt_grid", "S8", "SELECT cell_lat, cell_lon, CASE WHEN value<50 THEN value END AS value FROM grid1")
def _(read):
    g = read("grid1").withColumns({"lon": (F.col("cell_lon") + 0.0).cast("string"), "v": F.when(F.col("value") < 50, F.col("value")).otherwise(9999.0)})
    names = [f"{x}.0" for x in range(-180, 181)]
    wide = g.groupBy((F.col("cell_lat") + 0.0).alias("lat")).pivot("lon", names).agg(F.first("v"))
    return io.melt_grid(wide, "lat", names)


@query("s12_materialized_once", "S12", "SELECT id, count(*) AS n FROM fixes GROUP BY id")
def _(read):
    f = read("fixes")
    root = folder(f.sparkSession, "derived")
    counts = lambda least: f.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)
    io.materialize(counts, root, "counts", f.sparkSession, least=0)
    # Complete under these parameters, so what the function would give now is not asked for.
    return io.materialize(lambda least: counts(least).limit(0), root, "counts", f.sparkSession, least=0)


@query("s12_bucketed_tracks", "S5 S12 S14", f"WITH {steps_sql()} SELECT id, count(dist) AS n_steps, round(sum(dist),6)+0.0 AS length, round(sum(abs(south)),6)+0.0 AS south FROM steps GROUP BY id")
def _(read):
    f = read("fixes").select("id", "fix_id", "date_time", "latitude", "longitude")
    path = folder(f.sparkSession, "tracks")
    table = "tracks_" + path.rsplit("-", 1)[1]
    io.store_tracks(f.filter("fix_id % 5 > 0"), table, path, buckets=8)
    stored = io.append_tracks(f.filter("fix_id % 5 = 0"), table)
    # Steps along tracks and sums by track, without an exchange.
    return motion.steps(stored).groupBy("id").agg(F.count("dist").alias("n_steps"), r6(F.sum("dist")).alias("length"), r6(F.sum(F.abs("south"))).alias("south"))


@query("s13_report_table", "S13 S14", "SELECT id, species, predicted, random_state FROM reports WHERE random_state=2")
def _(read):
    r = read("reports").select("id", "species", "predicted", "random_state")
    path = folder(r.sparkSession, "reports")
    for seed in (1, 2, 3):
        io.append_results(r.filter(F.col("random_state") == seed), path)
    there = io.read_reports(r.sparkSession, path, r.schema, random_state=2)
    return there.unionByName(io.read_reports(r.sparkSession, path, r.schema, random_state=99))


@query("s15_added_once", "S15", "SELECT fix_id, latitude AS x, longitude AS y FROM fixes")
def _(read):
    f = read("fixes").select("fix_id", F.col("latitude").alias("x"), "longitude")
    f = io.add_missing(f, "x", lambda d: d.withColumn("x", F.lit(0.0)))
    return io.add_missing(f, "y", lambda d: d.withColumn("y", F.col("longitude"))).drop("longitude")


@query("st1_enriched_stream", "J4 V1", """SELECT fix_id, round(cos(radians(latitude))*cos(radians(longitude)),9)+0.0 AS x, round(sin(radians(latitude)),9)+0.0 AS z, g.value AS effort
    FROM fixes f LEFT JOIN grid1 g ON CAST(round_even(f.latitude,0) AS BIGINT)=g.cell_lat AND CAST(round_even(f.longitude,0) AS BIGINT)=g.cell_lon""")
def _(read):
    f = read("fixes").drop("stage")
    spark = f.sparkSession
    source, out = folder(spark, "arriving"), folder(spark, "enriched")
    f.write.parquet(source)
    stream = rows.enrich_stream(rows.stream_fixes(spark, source, f.schema, 4), read("grid1"), "effort")
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{out}-progress").format("parquet").start(out).awaitTermination()
    return spark.read.parquet(out).select("fix_id", r9("x").alias("x"), r9("z").alias("z"), "effort")


INSIDE = """p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date_time, fix_id) AS rn FROM fixes),
    g AS (SELECT *, rn - row_number() OVER (PARTITION BY id ORDER BY date_time, fix_id) AS g FROM p WHERE latitude >= -29.0 AND latitude <= 61.0 AND NOT (latitude BETWEEN 10.2 AND 11.3)),
    r AS (SELECT id, g, min(rn) AS start, count(*) AS n FROM g GROUP BY id, g), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, start) AS k FROM r)"""


@query("f14_keep_inside", "F14", f"WITH {INSIDE} SELECT fix_id FROM p JOIN b ON p.id=b.id AND k=1 AND rn>=start AND rn<start+n")
def _(read):
    ring = [(-29.0, -180.0), (10.2 - 1e-12, -180.0), (10.2 - 1e-12, 180.0), (11.3 + 1e-12, 180.0), (11.3 + 1e-12, -180.0), (61.0, -180.0), (61.0, 180.0), (-29.0, 180.0)]
    return prune.keep_inside(read("fixes"), ring).select("fix_id")


@query("f16_select_columns", "F16", "SELECT id, latitude, longitude, env FROM fixes")
def _(read):
    return prune.select_columns(read("fixes"), "position+env", {"position": ["latitude", "longitude"]})


@query("j16_merge_covariates", "J16 J17", "SELECT fix_id, latitude, env, latitude*2 AS twice, CAST(year(date_time) AS INTEGER) AS year FROM fixes")
def _(read):
    f = read("fixes")
    base = f.select("fix_id", "latitude")
    return enrich.merge_covariates(base, f.select("fix_id", "latitude", "env"), f.select("fix_id", "env", (F.col("latitude") * 2).alias("twice")), f.select("fix_id", F.year("date_time").alias("year")))


@query("t04_representatives", "T4", """WITH c AS (SELECT 'latitude' AS feature, 'place' AS key, corr(env,latitude) AS r FROM fixes UNION ALL SELECT 'longitude','place',corr(env,longitude) FROM fixes UNION ALL SELECT 'fix','other',corr(env,CASE WHEN env IS NOT NULL THEN CAST(fix_id AS DOUBLE) END) FROM fixes),
    k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY abs(r) DESC, feature DESC) AS n FROM c WHERE abs(r)>=0.00001) SELECT key, feature, round(r,6)+0.0 AS r FROM k WHERE n=1""")
def _(read):
    f = read("fixes").withColumn("fix", F.col("fix_id").cast("double"))
    corr = S.correlations(f, ["env", "latitude", "longitude", "fix"]).filter("a = 'env'").select(F.col("b").alias("feature"), "r")
    groups = f.sparkSession.createDataFrame([("latitude", "place"), ("longitude", "place"), ("fix", "other")], "feature string, key string")
    return rounded(S.representatives(corr, groups, 0.00001), "r")


@query("v09_day_from_periodic", "V9", f"SELECT fix_id, round({DAY},7)+0.0 AS day FROM fixes")
def _(read):
    f = read("fixes")
    sine, cosine = times.periodic_time(times.day_of_year("date_time"), F.year("date_time"))
    day = times.day_from_periodic(sine, cosine, times.year_days(F.year("date_time")))
    return f.select("fix_id", (F.round(day, 7) + 0.0).alias("day"))


@query("v16_sentinels", "V16", "SELECT fix_id, CASE WHEN fix_id%7<>0 THEN latitude END AS value, CASE WHEN stage<>'unknown' THEN stage END AS word FROM fixes")
def _(read):
    f = read("fixes").withColumns({"v": F.when(F.col("fix_id") % 7 == 0, 9999.0).otherwise(F.col("latitude"))})
    return f.select("fix_id", times.sentinel_to_null("v").alias("value"), times.words_to_null("stage", ("unknown",)).alias("word"))


RESAMPLED = """o AS (SELECT *, year(date_time) AS year, epoch_us(date_time)/86400000000.0*2 AS x, (lead(epoch_us(date_time)) OVER (PARTITION BY id ORDER BY date_time, fix_id)-epoch_us(date_time))/86400000000.0 AS dt FROM long_fixes),
    d AS (SELECT *, row_number() OVER (PARTITION BY id, x ORDER BY fix_id) AS k FROM o),
    e AS (SELECT id, year, x, dt, lead(x) OVER w AS x2, lead(dt) OVER w AS dt2 FROM d WHERE k=1 WINDOW w AS (PARTITION BY id, year ORDER BY x)),
    s AS (SELECT *, unnest(generate_series(CAST(ceil(x) AS BIGINT), CAST(coalesce(ceil(x2)-1, floor(x)) AS BIGINT))) AS slot FROM e),
    v AS (SELECT id, year, slot, CASE WHEN x2 IS NULL OR x2=x THEN 0.0 ELSE (slot-x)/(x2-x) END AS r, dt, dt2 FROM s)"""


@query("w15_resample_dt", "W15", f"WITH {RESAMPLED} SELECT id, CAST(year AS INTEGER) AS year, slot, round(coalesce(dt+r*(dt2-dt), dt),6)+0.0 AS dt FROM v")
def _(read):
    df = resample.resample(motion.steps(read("long_fixes")), 2, columns=("dt",), longitude=None)
    return df.select("id", "year", "slot", r6("dt").alias("dt"))


OVERLAPS = """c AS (SELECT DISTINCT id, species, taxa, CAST(ceil(latitude/2.0) AS BIGINT) AS i, CAST(ceil(longitude/2.0) AS BIGINT) AS j FROM fixes JOIN animals USING (id)),
    n AS (SELECT i, j, species, taxa, count(*) AS n FROM c GROUP BY i, j, species, taxa),
    o AS (SELECT *, n-1 AS same, sum(n) OVER (PARTITION BY i, j)-n AS other, sum(n) OVER (PARTITION BY i, j, taxa)-n AS taxa_other FROM n),
    t AS (SELECT c.id, c.species, quantile_cont(same,0.5) AS same, quantile_cont(other,0.5) AS other, quantile_cont(taxa_other,0.5) AS taxa_other FROM c JOIN o ON c.i=o.i AND c.j=o.j AND c.species=o.species GROUP BY c.id, c.species),
    s AS (SELECT species, avg(same) AS same, avg(other) AS other, avg(taxa_other) AS taxa_other FROM t GROUP BY species)"""


@query("a18_species_overlap", "A18", f"WITH {OVERLAPS} SELECT species, round(same,6)+0.0 AS same, round(CASE WHEN other<>0 THEN same/other END,6)+0.0 AS ratio, round(CASE WHEN taxa_other<>0 THEN same/taxa_other END,6)+0.0 AS taxa_ratio FROM s")
def _(read):
    tracks = enrich.overlap(labelled(read), 2.0, lambda c: F.percentile(c, 0.5)).join(read("animals").select("id", "species"), "id")
    return rounded(enrich.species_overlap(tracks).select("species", "same", "ratio", "taxa_ratio"), "same", "ratio", "taxa_ratio")


@query("c15_maintained_summary", "C15", f"""WITH {OK}, q AS (SELECT id, ok, random_state%2 AS setting, random_state//2 AS seed FROM ok),
    j AS (SELECT a.setting AS setting_a, b.setting AS setting_b, a.seed, a.ok AS a, b.ok AS b FROM q a JOIN q b ON a.id=b.id AND a.seed=b.seed AND a.setting<>b.setting),
    t AS (SELECT setting_a, setting_b, seed, CAST(count(*) AS DOUBLE) AS n, sum(a) AS na, sum(b) AS nb, sum(a*b) AS ab FROM j GROUP BY ALL),
    s AS (SELECT setting_a, setting_b, ab/na AS p1, nb/n AS p2, n*pow(n*ab-na*nb,2)/(na*nb*(n-na)*(n-nb)) AS chi FROM t)
    SELECT setting_a, setting_b, round(avg(p1),6)+0.0 AS p_b_given_a, round(avg(p2),6)+0.0 AS p_b, round(avg(chi),6)+0.0 AS chi2, round(avg(2*asin(sqrt(p1))-2*asin(sqrt(p2))),6)+0.0 AS h, round(avg({two_sided("sqrt(chi)")}),6)+0.0 AS p_value, count(chi) AS n_seeds FROM s GROUP BY ALL""")
def _(read):
    r = rep(read).withColumns({"setting": F.col("random_state") % 2, "seed": F.floor(F.col("random_state") / 2)})
    return rounded(R.maintained_summary(r, "setting", "seed"), "p_b_given_a", "p_b", "chi2", "h", "p_value")


@query("c17_multi_transfer", "C17", f"""WITH {BASE}, t AS (SELECT species AS species_train, predicted AS species_test, ((id*37+random_state*11)%100)/100.0 AS acc FROM reports),
    m AS (SELECT species_train, species_test, avg(acc) AS acc, stddev_pop(acc) AS std FROM t GROUP BY ALL), k AS (SELECT species AS s, count(DISTINCT stage) AS n FROM fixes JOIN animals USING (id) GROUP BY 1)
    SELECT species_train, species_test, round(acc,6)+0.0 AS acc, round(std,6)+0.0 AS std, round(base_acc,6)+0.0 AS base_acc, coalesce(n,0) AS n_categories FROM m LEFT JOIN b ON b.species=species_test LEFT JOIN k ON k.s=species_test""")
def _(read):
    t = read("reports").select(F.col("species").alias("species_train"), F.col("predicted").alias("species_test"), (((F.col("id") * 37 + F.col("random_state") * 11) % 100) / 100).alias("acc"))
    return rounded(R.multi_transfer(t, baseline(read), labelled(read).select("species", "stage")), "acc", "std", "base_acc")


@query("c27_taxa_intervals", "C27", f"""WITH {OK}, p AS (SELECT random_state, taxa, species, concat_ws('|', CAST(random_state AS STRING), taxa) AS key, avg(ok) AS a FROM ok GROUP BY random_state, taxa, species),
    t AS (SELECT key, random_state, taxa, avg(a) AS accuracy, count(*) AS n_species FROM p GROUP BY key, random_state, taxa), {boot("p", "key", "a", "species")}, {bca()}
    SELECT random_state, taxa, round(accuracy,6)+0.0 AS accuracy, n_species, round(low,6)+0.0 AS low, round(high,6)+0.0 AS high FROM t LEFT JOIN i ON g = key""")
def _(read):
    return rounded(R.taxa_accuracy_intervals(rep(read), "random_state"), "accuracy", "low", "high")


@query("c28_skill_by_height", "C28", """WITH h AS (SELECT env AS y, env*k/10.0+k AS pred, k AS height FROM fixes, range(1,6) t(k) WHERE env IS NOT NULL)
    SELECT CAST(height AS INTEGER) AS height, round(sqrt(avg(pow(y-pred,2))),6)+0.0 AS rmse, round(1-sqrt(avg(pow(y-pred,2)))/stddev_pop(y),6)+0.0 AS skill FROM h GROUP BY height""")
def _(read):
    p = read("fixes").filter("env is not null").select(F.col("env").alias("y"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("height")).withColumn("pred", F.col("y") * F.col("height") / 10 + F.col("height"))
    return rounded(R.rmse_vs_constant(p, ["height"]).select("height", "rmse", "skill"), "rmse", "skill")


@query("j02_species_of", "J2", "SELECT fix_id, species FROM fixes LEFT JOIN animals USING (id)")
def _(read):
    return enrich.species_of(read("fixes").select("fix_id", "id"), read("animals")).select("fix_id", "species")


SPECIES = [f"S{i}" for i in range(12)]
WIDE = ", ".join(f"round(max(CASE WHEN predicted='{s}' THEN share ELSE 0.0 END),6)+0.0 AS \"{s}\"" for s in SPECIES)


@query("c03_confusion_matrix", "C3", f"WITH c AS (SELECT species, predicted, count(*)/(SELECT count(*) FROM reports x WHERE x.species=r.species) AS share FROM reports r GROUP BY species, predicted) SELECT species AS real, {WIDE} FROM c GROUP BY species")
def _(read):
    return rounded(R.confusion_matrix(R.confusion(rep(read)), SPECIES), *SPECIES)


def curves(read):
    """Learning curves of each species under five seeds."""
    n = 10 * (1 + F.col("id") % 5)
    y = 1 - 0.5 * F.exp(-0.02 * n) * (1 + ((F.col("id") + F.col("random_state")) % 7) / 50)
    return read("reports").groupBy("species", "random_state", n.alias("n")).agg(F.avg(y).alias("accuracy"))


CURVES = """c0 AS (SELECT species, random_state, 10*(1+id%5) AS n, avg(1-0.5*exp(-0.02*(10*(1+id%5)))*(1+((id+random_state)%7)/50.0)) AS accuracy FROM reports GROUP BY ALL),
    c1 AS (SELECT *, lag(accuracy) OVER (PARTITION BY species, random_state ORDER BY n) AS before FROM c0),
    c2 AS (SELECT *, coalesce(sum(CASE WHEN accuracy-before>0.2 THEN 1 ELSE 0 END) OVER x, 0) AS jumps, max(CASE WHEN accuracy-before>0.2 THEN n END) OVER x AS jump, min(CASE WHEN accuracy>0.98 AND before>0.98 THEN n END) OVER x AS full_at FROM c1 WINDOW x AS (PARTITION BY species, random_state)),
    c3 AS (SELECT * FROM c2 WHERE n>=CASE WHEN jumps=1 THEN jump ELSE n END AND n<=coalesce(full_at, n)),
    f AS (SELECT species, random_state, exp(nullif(regr_intercept(ln(1-accuracy),n), CAST('nan' AS DOUBLE))) AS a, nullif(regr_slope(ln(1-accuracy),n), CAST('nan' AS DOUBLE)) AS b, nullif(regr_slope(accuracy,n), CAST('nan' AS DOUBLE)) AS s, nullif(regr_intercept(accuracy,n), CAST('nan' AS DOUBLE)) AS i0 FROM c3 GROUP BY species, random_state),
    p AS (SELECT species, random_state, coalesce(CASE WHEN b<0 THEN greatest(1.0, ln((1-0.9)/a)/b) END, CASE WHEN s<>0 THEN greatest(1.0, (0.9-i0)/s) ELSE 1.0 END) AS n_required FROM f)"""


@query("t17_sample_size_intervals", "T17", f"""WITH {CURVES}, {boot("p", "species", "n_required", "random_state")}
    SELECT g AS species, round(avg(any_n),6)+0.0 AS n_required, any_value(any_c) AS n_seeds, round(quantile_cont(mean,0.025),6)+0.0 AS low, round(quantile_cont(mean,0.975),6)+0.0 AS high
    FROM m JOIN (SELECT species, avg(n_required) AS any_n, count(*) AS any_c FROM p GROUP BY species) y ON y.species=g GROUP BY g""")
def _(read):
    return rounded(S.sample_size_intervals(curves(read), "species", 0.9), "n_required", "low", "high")


def _forsythe(most=5, folds=4):
    """Least squares by polynomials made orthogonal row by row (another way than the operator's), residuals summed up directly."""
    legendre = ["1.0", "x", "(3*x*x-1)/2", "(5*x*x*x-3*x)/2", "(35*x*x*x*x-30*x*x+3)/8", "(63*x*x*x*x*x-70*x*x*x+15*x)/8"]
    lead = [1.0, 1.0, 1.5, 2.5, 4.375, 7.875]
    levels, ys = "", ("la", "lo")
    for j in range(most + 1):
        sums = f"sum(t*p*p) OVER u AS d, sum(t*x*p*p) OVER u AS xd, sum(t*{legendre[j]}*{legendre[j]}) OVER u AS g, " + ", ".join(f"sum(t*{y}*p) OVER u AS b{y}" for y in ys)
        live = f"ok AND d*{lead[j] ** 2} > 1e-10*g"
        fits = ", ".join(f"CASE WHEN {live} THEN b{y}/d END AS w{y}{j}, CASE WHEN {live} THEN {f'f{y}{j - 1}' if j else '0.0'}+b{y}/d*p END AS f{y}{j}" for y in ys)
        levels += f""", s{j} AS (SELECT *, {sums} FROM r{j} WINDOW u AS (PARTITION BY id, fold)), q{j} AS (SELECT *, {live} AS ok1, {fits} FROM s{j}),
            r{j + 1} AS (SELECT * EXCLUDE (p, q, d, xd, g, bla, blo, ok, ok1, dd), ok1 AS ok, d AS dd, (x-xd/d)*p-{"d/dd" if j else "0.0"}*q AS p, p AS q FROM q{j})"""
    err = ", ".join(f"avg((f{y}{j}-{y})**2) FILTER (tested) AS e{y}{j}" for y in ys for j in range(most + 1))
    mean = ", ".join(f"avg(CASE WHEN n-tests > {j} AND n-2 >= {j} THEN e{y}{j} END) AS e{y}{j}" for y in ys for j in range(most + 1))
    chain = "SELECT *, " + ", ".join(f"e{y}0 AS best{y}, 0 AS deg{y}" for y in ys) + " FROM m JOIN v USING (id)"
    for j in range(1, most + 1):
        less = {y: f"e{y}{j} IS NOT NULL AND (best{y} IS NULL OR e{y}{j} < best{y}-1e-9*v{y})" for y in ys}
        chain = "SELECT * REPLACE (" + ", ".join(f"CASE WHEN {less[y]} THEN e{y}{j} ELSE best{y} END AS best{y}, CASE WHEN {less[y]} THEN {j} ELSE deg{y} END AS deg{y}" for y in ys) + f") FROM ({chain})"
    value = lambda y: f"m{y}+" + "+".join(f"CASE WHEN deg{y} >= {j} THEN coalesce({f'f{y}{j}-f{y}{j - 1}' if j else f'f{y}0'}, 0) ELSE 0 END" for j in range(most + 1))
    return f"""WITH f AS (SELECT id, epoch_us(date_time) AS us, latitude, longitude, row_number() OVER (PARTITION BY id ORDER BY date_time, fix_id)-1 AS i FROM fixes),
        b AS (SELECT id, min(us) AS a, max(us) AS z, greatest(max(us)-min(us), 1) AS span, count(*) AS n, avg(latitude) AS mla, avg(longitude) AS mlo FROM f GROUP BY id),
        v AS (SELECT id, var_pop(latitude) AS vla, var_pop(longitude) AS vlo FROM f GROUP BY id),
        r0 AS (SELECT id, n, mla, mlo, fold, CAST(NULL AS BIGINT) AS slot, i % {folds} = fold AS tested, CASE WHEN i % {folds} <> fold THEN 1.0 ELSE 0.0 END AS t, 2.0*(us-a)/span-1 AS x, latitude-mla AS la, longitude-mlo AS lo, 1.0 AS p, 0.0 AS q, true AS ok, 1.0 AS dd FROM f JOIN b USING (id), range({folds + 1}) g(fold)
          UNION ALL SELECT id, n, mla, mlo, {folds}, slot, false, 0.0, 2.0*(slot*86400000000.0-a)/span-1, 0.0, 0.0, 1.0, 0.0, true, 1.0 FROM (SELECT *, unnest(generate_series(CAST(ceil(a/86400000000.0) AS BIGINT), CAST(floor(z/86400000000.0) AS BIGINT))) AS slot FROM b)){levels},
        e AS (SELECT id, fold, any_value(n) AS n, count(*) FILTER (tested) AS tests, {err} FROM r{most + 1} WHERE fold < {folds} GROUP BY id, fold),
        m AS (SELECT id, {mean} FROM e WHERE tests > 0 GROUP BY id), c AS ({chain})
        SELECT id, slot, slot+0.0 AS t, round({value("la")},5)+0.0 AS latitude, round({value("lo")},5)+0.0 AS longitude, degla AS latitude_degree, round(bestla,6)+0.0 AS latitude_error, deglo AS longitude_degree, round(bestlo,6)+0.0 AS longitude_error
        FROM r{most + 1} JOIN c USING (id) WHERE slot IS NOT NULL"""


@query("w16_impute_polynomial", "W16", _forsythe())
def _(read):
    df = resample.impute_polynomial(read("fixes"))
    five = lambda c, k: (F.round(c, k) + 0.0).alias(c)
    return df.select("id", "slot", "t", five("latitude", 5), five("longitude", 5), "latitude_degree", five("latitude_error", 6), "longitude_degree", five("longitude_error", 6))


_ = (geo, CURVE)
