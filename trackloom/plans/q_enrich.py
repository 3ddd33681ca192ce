"""Queries on lookups, nearest joins, overlap and grids."""

from pyspark.sql import functions as F

from ..functions import geo, times
from ..operators import distances, enrich, gridstats, motion, resample
from .base import query
from .q_motion import ORIGIN, SPEED, hav, r6, r9


def labelled(read):
    return read("fixes").join(read("animals"), "id")


@query("j01_fixes_with_metadata", "J1 J2 J3", "SELECT fix_id, species, taxa, sex FROM fixes JOIN animals USING (id)")
def _(read):
    a = read("animals")
    df = enrich.with_metadata(read("fixes"), a.select("id", "species"))
    return enrich.add_columns(enrich.taxa_of(df, a), a.select("id", "sex")).select("fix_id", "species", "taxa", "sex")


@query("j03_species_by_taxa", "J3", "SELECT taxa, array_to_string(list_sort(list_distinct(list(species))), ',') AS species FROM animals GROUP BY taxa")
def _(read):
    return enrich.species_by_taxa(read("animals")).select("taxa", F.array_join("species", ",").alias("species"))


@query("j04_effort_lookup", "J4", "SELECT fix_id, g.value AS effort FROM fixes f LEFT JOIN grid1 g ON CAST(round_even(f.latitude,0) AS BIGINT)=g.cell_lat AND CAST(round_even(f.longitude,0) AS BIGINT)=g.cell_lon")
def _(read):
    return enrich.grid_lookup(read("fixes"), read("grid1"), name="effort").select("fix_id", "effort")


@query("j05_biodiversity_lookup", "J5", "SELECT fix_id, g.value AS biodiversity FROM fixes f LEFT JOIN grid1 g ON CAST(floor(f.latitude) AS BIGINT)=g.cell_lat AND least(CAST(floor(f.longitude) AS BIGINT),179)=g.cell_lon")
def _(read):
    return enrich.grid_lookup(read("fixes"), read("grid1"), "floor", "biodiversity").select("fix_id", "biodiversity")


@query("j06_complete_grid", "J6", """WITH f AS (SELECT la.i-90 AS cell_lat, lo.i-180 AS cell_lon FROM range(181) la(i), range(361) lo(i)),
    g AS (SELECT * FROM grid1 WHERE (cell_lat*7+cell_lon)%3<>0), v AS (SELECT f.*, g.value FROM f LEFT JOIN g ON f.cell_lat=g.cell_lat AND f.cell_lon=g.cell_lon)
    SELECT cell_lat, cell_lon, CASE WHEN abs(cell_lon)=180 THEN round(avg(CASE WHEN abs(cell_lon)=180 THEN value END) OVER (PARTITION BY cell_lat),6)+0.0 ELSE value END AS value FROM v""")
def _(read):
    return enrich.complete_grid(read("grid1").filter("(cell_lat * 7 + cell_lon) % 3 <> 0")).select("cell_lat", "cell_lon", F.when(F.abs("cell_lon") == 180, r6("value")).otherwise(F.col("value")).alias("value"))


@query("j07_bathymetry", "J7 J8", """WITH e AS (SELECT 89-cell_lat AS i, cell_lon+180 AS j, value-50 AS elevation FROM grid1 WHERE cell_lat<90 AND cell_lon<180)
    SELECT fix_id, CASE WHEN elevation>0 THEN 0.0 ELSE round(elevation,6)+0.0 END AS depth, CASE WHEN elevation>0 THEN -1.0 ELSE round(log10(1-elevation),6)+0.0 END AS log_depth
    FROM fixes f LEFT JOIN e ON CAST(greatest(ceil(90.0-f.latitude)-1,0) AS BIGINT)=e.i AND CAST(greatest(ceil(f.longitude+180.0)-1,0) AS BIGINT)=e.j""")
def _(read):
    e = read("grid1").filter("cell_lat < 90 and cell_lon < 180").select((89 - F.col("cell_lat")).alias("i"), (F.col("cell_lon") + 180).alias("j"), (F.col("value") - 50).alias("elevation"))
    plain = enrich.depth(read("fixes"), e, 1.0).select("fix_id", r6("elevation").alias("depth"))
    return plain.join(enrich.depth(read("fixes"), e, 1.0, log=True).select("fix_id", r6("elevation").alias("log_depth")), "fix_id")


SITES = "sites AS (SELECT cell_lat*3.0 AS lat, cell_lon*2.0+(cell_lat%2)*0.5 AS lon, value FROM grid1 WHERE cell_lat BETWEEN -20 AND 20 AND cell_lon BETWEEN -90 AND 89)"


def sites(read):
    return read("grid1").filter("cell_lat between -20 and 20 and cell_lon between -90 and 89").select((F.col("cell_lat") * 3.0).alias("lat"), (F.col("cell_lon") * 2.0 + (F.col("cell_lat") % 2) * 0.5).alias("lon"), "value")


@query("j09_nearest_cell_l1", "J9", f"""WITH {SITES}, p AS (SELECT * FROM fixes),
    m AS (SELECT fix_id, abs(latitude-lat)+abs(longitude-lon) AS gap, lat, lon, value FROM p JOIN sites ON value IS NOT NULL AND abs(latitude-lat)+abs(longitude-lon) < 1.5),
    b AS (SELECT *, row_number() OVER (PARTITION BY fix_id ORDER BY gap, lat, lon) AS k FROM m)
    SELECT p.fix_id, b.value FROM p LEFT JOIN b ON p.fix_id=b.fix_id AND k=1""")
def _(read):
    return enrich.nearest_l1(read("fixes"), sites(read)).select("fix_id", "value")


@query("j10_nearest_level", "J10", """WITH l AS (SELECT CAST(v AS DOUBLE) AS level FROM (VALUES (0),(10),(50),(200),(500)) t(v)), m AS (SELECT fix_id, level, row_number() OVER (PARTITION BY fix_id ORDER BY abs(level-env), level) AS k FROM fixes, l WHERE env IS NOT NULL)
    SELECT fix_id, level FROM m WHERE k=1""")
def _(read):
    f = read("fixes").filter("env is not null")
    levels = f.sparkSession.createDataFrame([(float(v),) for v in (0, 10, 50, 200, 500)], "level double")
    return enrich.nearest_level(f, levels, "env").select("fix_id", "level")


@query("j11_depth_columns", "J11", "SELECT id, max(CASE WHEN sex='M' THEN kfold END) AS \"M\", max(CASE WHEN sex='F' THEN kfold END) AS \"F\" FROM reports WHERE random_state=1 GROUP BY id")
def _(read):
    return enrich.depth_columns(read("reports").filter("random_state = 1"), ["id"], "sex", "kfold", ["M", "F"])


SERIES = "series AS (SELECT date_time - INTERVAL 17 MINUTE AS ts, CAST(round_even(latitude,0) AS BIGINT) AS cell_lat, CAST(round_even(longitude,0) AS BIGINT) AS cell_lon, CAST(fix_id AS DOUBLE) AS value FROM fixes WHERE fix_id%3=0)"


@query("j12_as_of_nearest", "J12 J13", f"""WITH {SERIES}, p AS (SELECT *, CAST(round_even(latitude,0) AS BIGINT) AS cell_lat, CAST(round_even(longitude,0) AS BIGINT) AS cell_lon FROM fixes),
    m AS (SELECT fix_id, s.value, row_number() OVER (PARTITION BY fix_id ORDER BY abs(epoch_us(date_time)-epoch_us(ts)), ts, s.value) AS k FROM p JOIN series s ON p.cell_lat=s.cell_lat AND p.cell_lon=s.cell_lon AND abs(epoch_us(date_time)-epoch_us(ts)) <= 1800000000)
    SELECT fixes.fix_id, m.value AS matched FROM fixes LEFT JOIN m ON fixes.fix_id=m.fix_id AND k=1""")
def _(read):
    f = read("fixes")
    s = f.filter("fix_id % 3 = 0").select((F.col("date_time") - F.expr("INTERVAL 17 MINUTES")).alias("ts"), geo.half_even_cell("latitude").alias("cell_lat"), geo.half_even_cell("longitude").alias("cell_lon"), F.col("fix_id").cast("double").alias("value"))
    return enrich.as_of_nearest(f, s).select("fix_id", "matched")


@query("j13_valid_time", "J13", "SELECT fix_id, date_time + to_hours(CAST(fix_id % 18 AS INTEGER)) AS valid_time FROM fixes")
def _(read):
    return enrich.valid_time(read("fixes").withColumn("step", (F.col("fix_id") % 18).cast("int")), "date_time").select("fix_id", F.col("valid_time").cast("timestamp_ntz").alias("valid_time"))


@query("j14_match_occurrences", "J14 J15", """WITH k AS (SELECT fix_id, date_trunc('day', date_time) AS d, row_number() OVER (PARTITION BY date_trunc('day', date_time), floor(latitude), floor(longitude) ORDER BY fix_id) AS n, floor(latitude) AS la, floor(longitude) AS lo FROM fixes),
    r AS (SELECT fix_id AS row_id, date_trunc('day', date_time) AS d, row_number() OVER (PARTITION BY date_trunc('day', date_time), floor(latitude), floor(longitude) ORDER BY fix_id) AS n, floor(latitude) AS la, floor(longitude) AS lo FROM fixes WHERE fix_id%2=0)
    SELECT fix_id, row_id FROM k JOIN r USING (d, la, lo, n)""")
def _(read):
    f = read("fixes").select("fix_id", F.date_trunc("DAY", "date_time").alias("date_time"), F.floor("latitude").cast("double").alias("latitude"), F.floor("longitude").cast("double").alias("longitude"))
    right = f.filter("fix_id % 2 = 0").withColumnRenamed("fix_id", "row_id")
    return enrich.match_occurrences(f, right, rounded=True).select("fix_id", "row_id")


@query("j18_distance_to_coast", "J18", f"""WITH {SITES}, p AS (SELECT * FROM fixes),
    m AS (SELECT fix_id, min({hav('latitude', 'longitude', 'lat', 'lon')}) AS d FROM p, sites GROUP BY fix_id) SELECT fix_id, round(d,6)+0.0 AS dist FROM m""")
def _(read):
    return enrich.nearest_site(read("fixes"), sites(read)).select("fix_id", r6("dist").alias("dist"))


@query("j19_impute_nearest", "J19 A20", """WITH f AS (SELECT *, CAST(ceil(latitude/2.0) AS BIGINT) AS ci, CAST(ceil(longitude/2.0) AS BIGINT) AS cj, CASE WHEN id%4=0 THEN NULL ELSE env END AS e FROM fixes),
    c AS (SELECT ci, cj, avg(e) AS m FROM f GROUP BY ci, cj), k AS (SELECT * FROM c WHERE m IS NOT NULL),
    n AS (SELECT c.ci, c.cj, k.m, row_number() OVER (PARTITION BY c.ci, c.cj ORDER BY abs(c.ci-k.ci)*2.0+abs(c.cj-k.cj)*2.0, k.ci, k.cj) AS r FROM c, k WHERE c.m IS NULL),
    a AS (SELECT ci, cj, m FROM k UNION ALL SELECT ci, cj, m FROM n WHERE r=1)
    SELECT fix_id, round(coalesce(e, m),9)+0.0 AS env FROM f JOIN a USING (ci, cj)""")
def _(read):
    f = read("fixes").withColumn("env", F.when(F.col("id") % 4 != 0, F.col("env")))
    return enrich.impute_nearest(f, "env", 2.0).select("fix_id", r9("env").alias("env"))


@query("j20_close_pairs", "J20", f"""WITH p AS (SELECT fix_id, species, latitude, longitude, env FROM fixes JOIN animals USING (id) WHERE env>5)
    SELECT a.fix_id AS a, b.fix_id AS b, round({hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')},6)+0.0 AS dist, round(least(a.env,b.env)/greatest(a.env,b.env),6)+0.0 AS ratio FROM p a JOIN p b ON a.species<b.species
    WHERE {hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} < 0.3 AND least(a.env,b.env)/greatest(a.env,b.env) > 0.1""")
def _(read):
    df = enrich.close_pairs(labelled(read), 0.3, 0.1, 5.0)
    return df.select("a", "b", r6("dist").alias("dist"), r6("ratio").alias("ratio"))


@query("j21_distance_matrix", "J21", "WITH p AS (SELECT * FROM points) SELECT a.id AS i, b.id AS j, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])),6)+0.0 AS d FROM p a JOIN p b ON a.id<b.id")
def _(read):
    return enrich.distance_matrix(read("points")).select("i", "j", r6("d").alias("d"))


@query("j21_close_rows", "J21", "WITH p AS (SELECT id, CAST(embedding AS DOUBLE[]) AS v FROM points) SELECT a.id AS i, b.id AS j, round(list_distance(a.v,b.v),6)+0.0 AS d FROM p a JOIN p b ON a.id<b.id WHERE list_distance(a.v,b.v) <= 1.15")
def _(read):
    return distances.close_rows(read("points"), 1.15).select("i", "j", r6("d").alias("d"))


@query("j22_closest_series", "J22", """WITH s AS (SELECT id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM points), p AS (SELECT id AS pid, v[1:8] AS p FROM s),
    d AS (SELECT pid, id, (SELECT min(sqrt(list_sum(list_transform(list_zip(p, v[k+1:k+8]), lambda z: (z[1]-z[2])*(z[1]-z[2]))))) FROM range(56) t(k)) AS m FROM p, s),
    r AS (SELECT pid, id, m, row_number() OVER (PARTITION BY pid ORDER BY m, id) AS n FROM d) SELECT pid, id, round(m/sqrt(8),6)+0.0 AS d FROM r WHERE n <= 3""")
def _(read):
    s = read("points").select("id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    p = s.select("id", F.slice("v", 1, 8).alias("v"))
    return enrich.shapelet_distances(p, s, k=3).select("pid", "id", r6("d").alias("d"))


@query("j22_shapelet_distance", "J22", """WITH s AS (SELECT id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM points), p AS (SELECT id AS pid, v[1:8] AS p FROM s),
    d AS (SELECT pid, id, (SELECT min(sqrt(list_sum(list_transform(list_zip(p, v[k+1:k+8]), lambda z: (z[1]-z[2])*(z[1]-z[2]))))) FROM range(56) t(k)) AS m FROM p, s)
    SELECT pid, id, round(m/sqrt(8),6)+0.0 AS d FROM d""")
def _(read):
    s = read("points").select("id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    d = enrich.shapelet_distances(s.withColumn("v", F.slice("v", 1, 8)), s)
    return d.withColumn("d", r6("d"))


@query("a14_feature_table", "A14 A6", f"""WITH {SPEED[5:]}, m AS (SELECT id, avg(speed) AS mean_speed, count(*) AS n_obs, avg(coalesce(env,0.0)) AS effort FROM speeds GROUP BY id),
    n AS (SELECT species, count(*) AS n_species FROM animals GROUP BY species)
    SELECT m.id, round(mean_speed,6)+0.0 AS mean_speed, n_obs, round(effort,9)+0.0 AS effort, n_species, CASE WHEN tag='GPS' THEN 1 ELSE 0 END AS tag_gps FROM m JOIN animals USING (id) JOIN n USING (species)""")
def _(read):
    f, a = read("fixes"), read("animals")
    speed = motion.speed_stats(f).select("id", "mean_speed")
    effort = motion.covariate_stats(f, "env", 0.0).select("id", F.col("mean").alias("effort"))
    out = speed.join(motion.positions(f).select("id", "n_obs"), "id").join(effort, "id").join(a, "id").join(a.groupBy("species").agg(F.count(F.lit(1)).alias("n_species")), "species")
    return out.select("id", r6("mean_speed").alias("mean_speed"), "n_obs", r9("effort").alias("effort"), "n_species", F.when(F.col("tag") == "GPS", 1).otherwise(0).alias("tag_gps"))


OVERLAP = """c AS (SELECT DISTINCT id, species, taxa, CAST(ceil(latitude/2.0) AS BIGINT) AS i, CAST(ceil(longitude/2.0) AS BIGINT) AS j FROM fixes JOIN animals USING (id)),
    n AS (SELECT i, j, species, taxa, count(*) AS n FROM c GROUP BY i, j, species, taxa),
    o AS (SELECT *, n-1 AS same, sum(n) OVER (PARTITION BY i, j)-n AS other, sum(n) OVER (PARTITION BY i, j, taxa)-n AS taxa_other FROM n),
    t AS (SELECT c.id, avg(same) AS same, avg(other) AS other, avg(taxa_other) AS taxa_other FROM c JOIN o ON c.i=o.i AND c.j=o.j AND c.species=o.species GROUP BY c.id)"""


@query("a15_occurrences", "A15", f"WITH {OVERLAP} SELECT i, j, species, n FROM n")
def _(read):
    return enrich.occurrences(labelled(read), 2.0).select("i", "j", "species", "n")


@query("a16_overlap", "A16 X3", f"WITH {OVERLAP} SELECT id, round(same,6)+0.0 AS same, round(other,6)+0.0 AS other, round(taxa_other,6)+0.0 AS taxa_other FROM t")
def _(read):
    return enrich.overlap(labelled(read), 2.0).select("id", *[r6(c).alias(c) for c in ("same", "other", "taxa_other")])


@query("a17_overlap_vs_accuracy", "A17 C1", f"WITH {OVERLAP}, acc AS (SELECT id, avg(CASE WHEN predicted=species THEN 1.0 ELSE 0.0 END) AS accuracy FROM reports GROUP BY id) SELECT id, round(CASE WHEN other<>0 THEN same/other END,6)+0.0 AS ratio, other=0 AND same>0 AS is_inf, round(accuracy,6)+0.0 AS accuracy FROM t JOIN acc USING (id)")
def _(read):
    from ..operators import report

    acc = report.accuracy_by_animal(report.marked(read("reports")))
    return enrich.overlap_vs_accuracy(labelled(read), acc, 2.0).select("id", r6("ratio").alias("ratio"), "is_inf", r6("accuracy").alias("accuracy"))


@query("a19_time_bin_average", "A19", """WITH b AS (SELECT *, year(date_time) AS year, CAST(ceil((dayofyear(date_time)-1+hour(date_time)/24+minute(date_time)/1440+CAST(floor(second(date_time)) AS DOUBLE)/86400)*3.0) AS BIGINT) AS bin FROM fixes),
    s AS (SELECT id, year, bin, stage, row_number() OVER (PARTITION BY id, year, bin ORDER BY count(*) DESC, stage) AS k FROM b WHERE bin>0 GROUP BY id, year, bin, stage),
    a AS (SELECT id, year, bin, avg(latitude) AS latitude, CASE WHEN max(longitude)>0 AND min(longitude)<0 THEN quantile_cont(longitude,0.5) ELSE avg(longitude) END AS longitude, avg(env) AS env FROM b WHERE bin>0 GROUP BY id, year, bin)
    SELECT a.id, CAST(a.year AS INTEGER) AS year, a.bin, round(latitude,9)+0.0 AS latitude, round(longitude,9)+0.0 AS longitude, s.stage, round(env,9)+0.0 AS env, round((a.bin-0.5)/3.0,6)+0.0 AS t FROM a JOIN s ON a.id=s.id AND a.year=s.year AND a.bin=s.bin AND k=1""")
def _(read):
    return enrich.time_bin_average(read("fixes")).select("id", "year", "bin", *[r9(c).alias(c) for c in ("latitude", "longitude", "env")], "stage", r6("t").alias("t"))


@query("a20_cell_means", "A20", "SELECT CAST(ceil(latitude/0.25) AS BIGINT) AS cell_lat, CAST(ceil(longitude/0.25) AS BIGINT) AS cell_lon, round(avg(env),9)+0.0 AS env FROM fixes GROUP BY 1, 2")
def _(read):
    return enrich.cell_means(read("fixes"), ["env"]).select("cell_lat", "cell_lon", r9("env").alias("env"))


@query("a24_null_share", "A24 A25", "SELECT CAST(year(date_time) AS INTEGER) AS year, 'env' AS \"column\", round(100.0*avg(CASE WHEN env>200000 THEN 1.0 ELSE 0.0 END),6)+0.0 AS percent FROM long_fixes GROUP BY 1")
def _(read):
    df = read("long_fixes").select(F.year("date_time").alias("year"), F.when(F.col("env") <= 200000, F.col("env")).alias("env"))
    return gridstats.null_share(df, ["env"], "year").select("year", "column", r6("percent").alias("percent"))


@query("a26_grid_density", "A26", "SELECT CAST(least(floor((latitude+90)*(18/180)),17) AS BIGINT) AS i, CAST(least(floor((longitude+180)*(36/360)),35) AS BIGINT) AS j, round(avg(env),9)+0.0 AS value FROM fixes GROUP BY 1, 2")
def _(read):
    return gridstats.grid_density(read("fixes"), 18, 36, "env").select("i", "j", r9("value").alias("value"))


ACC = "acc AS (SELECT id, avg(CASE WHEN predicted=species THEN 1.0 ELSE 0.0 END) AS accuracy FROM reports GROUP BY id)"
CELL = "CAST(least(floor(6.0*(1+sin(radians(latitude)))),11) AS BIGINT) AS i, CAST(least(floor((longitude+180)*(24/360)),23) AS BIGINT) AS j"


def per_fix(read):
    from ..operators import report

    return report.accuracy_by_fix(labelled(read), report.marked(read("reports")))


@query("a27_equal_area_accuracy", "A27 A29 C26", f"WITH {ACC}, p AS (SELECT {CELL}, id, species, avg(accuracy) AS a FROM fixes JOIN animals USING (id) JOIN acc USING (id) GROUP BY ALL) SELECT i, j, round(avg(a),9)+0.0 AS accuracy, count(DISTINCT id) AS n_animals, count(DISTINCT species) AS n_species FROM p GROUP BY i, j")
def _(read):
    return gridstats.equal_area_accuracy(per_fix(read), 12, 24).select("i", "j", r9("accuracy").alias("accuracy"), "n_animals", "n_species")


@query("a28_space_time_density", "A28", f"WITH {ACC}, p AS (SELECT {CELL}, CAST(floor((dayofyear(date_time)-1)/10) AS BIGINT) AS d, accuracy FROM fixes JOIN acc USING (id)) SELECT i, j, d, round(count(*)/(SELECT count(*) FROM p),9)+0.0 AS density, round(avg(accuracy),9)+0.0 AS accuracy FROM p GROUP BY i, j, d")
def _(read):
    return gridstats.space_time_density(per_fix(read), 12, 24, 10).select("i", "j", "d", r9("density").alias("density"), r9("accuracy").alias("accuracy"))


@query("a30_track_image", "A30", f"WITH {ORIGIN}, u AS (SELECT id, (we-min(we) OVER p)/(max(we) OVER p-min(we) OVER p) AS x, (sn-min(sn) OVER p)/(max(sn) OVER p-min(sn) OVER p) AS y FROM origin JOIN animals USING (id) WINDOW p AS (PARTITION BY species)) SELECT id, CAST(least(floor(y*16),15) AS BIGINT) AS i, CAST(least(floor(x*16),15) AS BIGINT) AS j, count(*) AS value FROM u GROUP BY ALL")
def _(read):
    return gridstats.track_image(motion.unit_square(motion.common_origin(read("fixes")).join(read("animals"), "id"), "species"), 16)


@query("a31_bounding_boxes", "A31", "SELECT species, min(latitude)-1 AS min_lat, max(latitude)+1 AS max_lat, min(longitude)-1 AS min_lon, max(longitude)+1 AS max_lon, round(count(*)/(SELECT count(*) FROM fixes),6)+0.0 AS share FROM fixes JOIN animals USING (id) GROUP BY species")
def _(read):
    df = gridstats.bounding_boxes(labelled(read), "species", 1.0)
    return df.withColumn("share", r6("share"))


@query("a33_histogram", "A33", """WITH h AS (SELECT taxa, CAST(greatest(0, least(floor((log10(env+1)-0)/((3.0-0)/12)),11)) AS BIGINT) AS bin, count(*) AS n FROM fixes JOIN animals USING (id) WHERE env IS NOT NULL GROUP BY 1, 2)
    SELECT taxa, bin, round(n/sum(n) OVER (PARTITION BY taxa),6)+0.0 AS p, round(sum(n) OVER (PARTITION BY taxa ORDER BY bin)/sum(n) OVER (PARTITION BY taxa),6)+0.0 AS cdf FROM h""")
def _(read):
    df = gridstats.histogram(labelled(read).withColumn("e1", F.col("env") + 1), "e1", 0.0, 3.0, 12, "taxa", log10=True)
    return df.select("taxa", "bin", r6("p").alias("p"), r6("cdf").alias("cdf"))


@query("a35_dataset_totals", "A35 A37", """WITH p AS (SELECT species, id, count(*) AS n FROM fixes JOIN animals USING (id) GROUP BY species, id), s AS (SELECT species, count(*) AS a, sum(n) AS f, quantile_cont(n,0.9) AS q FROM p GROUP BY species)
    SELECT CAST((SELECT sum(n) FROM p) AS BIGINT) AS n_fixes, (SELECT count(*) FROM p) AS n_animals, CAST((SELECT quantile_cont(n,0.5) FROM p) AS DOUBLE) AS median_length, count(*) AS n_species, round(avg(a),6)+0.0 AS mean_animals, round(avg(f),6)+0.0 AS mean_fixes, round(quantile_cont(q,0.5),6)+0.0 AS maxlen FROM s""")
def _(read):
    df = labelled(read)
    lengths = df.groupBy("species", "id").agg(F.count(F.lit(1)).alias("length"))
    return gridstats.dataset_totals(df).crossJoin(gridstats.sequence_length(lengths)).select("n_fixes", "n_animals", "median_length", "n_species", *[r6(c).alias(c) for c in ("mean_animals", "mean_fixes", "maxlen")])


@query("a36_class_weights", "A36", "SELECT species, round((SELECT count(*) FROM animals)/((SELECT count(DISTINCT species) FROM animals)*count(*)),6)+0.0 AS weight FROM animals GROUP BY species")
def _(read):
    return gridstats.class_weights(read("animals"), "species").select("species", r6("weight").alias("weight"))


RESAMPLE = """y AS (SELECT *, year(date_time) AS year, epoch_us(date_time)/86400000000.0*2 AS x FROM long_fixes), d AS (SELECT *, row_number() OVER (PARTITION BY id, x ORDER BY fix_id) AS k FROM y),
    e AS (SELECT id, year, x, latitude, longitude, lead(x) OVER w AS x2, lead(latitude) OVER w AS la2, lead(longitude) OVER w AS lo2 FROM d WHERE k=1 WINDOW w AS (PARTITION BY id, year ORDER BY x)),
    s AS (SELECT *, unnest(generate_series(CAST(ceil(x) AS BIGINT), CAST(coalesce(ceil(x2)-1, floor(x)) AS BIGINT))) AS slot FROM e),
    v AS (SELECT id, year, slot, CASE WHEN x2 IS NULL OR x2=x THEN 0.0 ELSE (slot-x)/(x2-x) END AS r, latitude, la2, longitude, (((lo2-longitude+180)%360+360)%360-180) AS dl FROM s)"""


@query("w14_resample", "W14", f"WITH {RESAMPLE} SELECT id, CAST(year AS INTEGER) AS year, slot, round(coalesce(latitude+r*(la2-latitude), latitude),9)+0.0 AS latitude, round(((coalesce(longitude+r*dl, longitude)+180)%360+360)%360-180,9)+0.0 AS longitude FROM v")
def _(read):
    df = resample.resample(read("long_fixes"), 2)
    return df.select("id", "year", "slot", r9("latitude").alias("latitude"), r9("longitude").alias("longitude"))


@query("w17_pad_year", "W17", """WITH s AS (SELECT id, year(date_time) AS year, dayofyear(date_time)-1 AS slot, avg(env) AS env FROM fixes GROUP BY ALL), t AS (SELECT DISTINCT id, year FROM s)
    SELECT t.id, CAST(t.year AS INTEGER) AS year, g.slot, round(coalesce(env,0.0),9)+0.0 AS env FROM t CROSS JOIN range(365) g(slot) LEFT JOIN s ON t.id=s.id AND t.year=s.year AND g.slot=s.slot""")
def _(read):
    s = read("fixes").groupBy("id", F.year("date_time").alias("year"), (F.dayofyear("date_time") - 1).cast("long").alias("slot")).agg(F.avg("env").alias("env"))
    return resample.pad_year(s, 1, ["env"]).select("id", "year", "slot", r9("env").alias("env"))


_ = times
