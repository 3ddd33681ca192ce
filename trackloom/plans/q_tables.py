"""Queries on selection, sampling, labels, stages and scalar functions."""

from pyspark.sql import functions as F

from ..functions import geo, times
from ..operators import motion, prune, report as R, stages
from .base import query
from .q_motion import hav, r6

MD5 = "md5(concat(CAST(id AS STRING), '-', '0'))"
TRACKS = """tracks AS (SELECT f.id, species, taxa, sex, tag, length, days FROM (SELECT id, count(*) AS length, (max(epoch_us(date_time))-min(epoch_us(date_time)))/86400000000.0 AS days FROM fixes GROUP BY id) f JOIN animals a ON f.id=a.id)"""


def tracks(read):
    return prune.track_table(read("fixes")).join(read("animals"), "id")


@query("f01_main_pruner", "F1 X1 X2 X6", f"""WITH {TRACKS}, t AS (SELECT *, sum(CASE WHEN length>62 THEN 1 ELSE 0 END) OVER (PARTITION BY species) AS n FROM tracks WHERE taxa IN ('X0','X1','X2'))
    SELECT id, species FROM t WHERE n >= 8 AND days > 29.0""")
def _(read):
    return prune.keep_tracks(tracks(read), "taxa", ["X0", "X1", "X2"], min_animals=8, min_length=62, min_days=29.0, fn=lambda d: d, mapping=lambda c: c).select("id", "species")


@query("f02_min_length", "F2", f"WITH {TRACKS} SELECT id, length FROM tracks WHERE length > 65")
def _(read):
    return prune.min_length(tracks(read), 65).select("id", "length")


@query("f03_min_days", "F3", f"WITH {TRACKS} SELECT id, round(days,6)+0.0 AS days FROM tracks WHERE days > 29.5")
def _(read):
    return prune.min_days(tracks(read), 29.5).select("id", r6("days").alias("days"))


@query("f04_min_animals", "F4", f"WITH {TRACKS} SELECT id, species FROM (SELECT *, count(*) OVER (PARTITION BY species) AS n FROM tracks) WHERE n >= 13")
def _(read):
    return prune.min_animals(tracks(read), 13).select("id", "species")


@query("f05_binary_target", "F5", "SELECT id, CASE WHEN species='S3' THEN 1 ELSE 0 END AS target, CASE WHEN species='S3' THEN 'S3' ELSE 'Not S3' END AS target_label FROM animals")
def _(read):
    return prune.binary_target(read("animals"), "species", "S3").select("id", "target", "target_label")


@query("f06_binary_stage", "F6 D3", "SELECT fix_id, CASE WHEN stage='unknown' THEN NULL WHEN stage='non-breeding' THEN 'non-breeding' ELSE 'breeding' END AS stage FROM fixes")
def _(read):
    return read("fixes").select("fix_id", times.binary_stage("stage").alias("stage"))


@query("f07_delete_random", "F7 L3", f"SELECT id FROM animals WHERE CAST(concat('0x', substr({MD5},1,8)) AS BIGINT)/4294967296.0 >= 0.3")
def _(read):
    return prune.delete_random(read("animals"), 0.3).select("id")


@query("f08_delete_stratified", "F8", f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY species ORDER BY {MD5}, id) AS r, count(*) OVER (PARTITION BY species) AS n FROM animals) WHERE r <= ceil((1-0.25)*n)")
def _(read):
    return prune.delete_stratified(read("animals"), 0.25).select("id")


@query("f09_delete_by_class", "F9", f"WITH r AS (SELECT id, md5(species) AS h, row_number() OVER (PARTITION BY species ORDER BY {MD5}, id) AS r FROM animals) SELECT id FROM r ORDER BY r, h, id LIMIT (SELECT CAST(round_even(0.6*count(*),0) AS BIGINT) FROM animals)")
def _(read):
    return prune.delete_by_class(read("animals"), 0.4).select("id")


@query("f10_downsample_one", "F10", f"SELECT id, species FROM animals WHERE species<>'S1' UNION ALL (SELECT id, species FROM animals WHERE species='S1' ORDER BY {MD5}, id LIMIT (SELECT CAST(round_even(0.5*count(*),0) AS BIGINT) FROM animals WHERE species='S1'))")
def _(read):
    return prune.downsample(read("animals"), "species", "S1", share=0.5).select("id", "species")


@query("f11_subset", "F11 D1", """WITH t AS (SELECT * FROM animals ORDER BY id LIMIT 100), k AS (SELECT *, count(*) OVER (PARTITION BY species) AS n FROM t)
    SELECT id, species, dense_rank() OVER (ORDER BY species)-1 AS code FROM k WHERE n >= 9""")
def _(read):
    return prune.subset(read("animals"), 100, 9).select("id", "species", F.col("code").cast("long").alias("code"))


SQUARE = [(-40.0, -150.0), (-40.0, 100.0), (10.0, 100.0), (40.0, 150.0), (40.0, -150.0)]
INSIDE = "(longitude BETWEEN -150.0 AND 150.0 AND latitude BETWEEN -40.0 AND 40.0 AND (longitude <= 100.0 OR longitude <= 100.0 + (latitude-10.0)*50.0/30.0))"


@query("f12_point_in_polygon", "F12", f"SELECT fix_id, {INSIDE} AS inside FROM fixes")
def _(read):
    return read("fixes").select("fix_id", geo.in_polygon("latitude", "longitude", SQUARE).alias("inside"))


@query("f13_longest_run_inside", "F13", f"""WITH p AS (SELECT *, latitude > (-60.0 + (id % 25) * 5.0 + 0.7) AS inside, row_number() OVER (PARTITION BY id ORDER BY date_time, fix_id) AS rn FROM fixes),
    g AS (SELECT *, rn - row_number() OVER (PARTITION BY id ORDER BY date_time, fix_id) AS g FROM p WHERE latitude BETWEEN -29.0 AND 61.0 AND longitude BETWEEN -180.0 AND 180.0 AND NOT (latitude BETWEEN 10.2 AND 11.3)),
    r AS (SELECT id, g, min(rn) AS start, count(*) AS n FROM g GROUP BY id, g), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, start) AS k FROM r)
    SELECT id, start, n FROM b WHERE k=1""")
def _(read):
    # Two bands of latitude joined by a line at the eastern edge, where no track is.
    ring = [(-29.0, -180.0), (10.2 - 1e-12, -180.0), (10.2 - 1e-12, 180.0), (11.3 + 1e-12, 180.0), (11.3 + 1e-12, -180.0), (61.0, -180.0), (61.0, 180.0), (-29.0, 180.0)]
    return prune.longest_inside(read("fixes"), ring).select("id", F.col("start").cast("long").alias("start"), "n")


@query("f15_common_window", "F15", """WITH s AS (SELECT DISTINCT id, dayofyear(date_time)-1 AS slot FROM fixes), st AS (SELECT DISTINCT slot AS start FROM s),
    f AS (SELECT start, s.id FROM st JOIN s ON s.slot BETWEEN start AND start+4 GROUP BY start, s.id HAVING count(*)=5)
    SELECT CAST(start AS INTEGER) AS start, count(*) AS n_tracks FROM f GROUP BY start ORDER BY n_tracks DESC, start LIMIT 1""")
def _(read):
    return prune.common_window(read("fixes"), 5)


@query("f18_drop_padding", "F18 F17", "SELECT fix_id FROM (SELECT fix_id, CASE WHEN fix_id%7=0 THEN 0.0 ELSE latitude END AS a, CASE WHEN fix_id%7=0 THEN 0.0 ELSE longitude END AS b FROM fixes) WHERE abs(a)>=1e-8 OR abs(b)>=1e-8")
def _(read):
    z = lambda c: F.when(F.col("fix_id") % 7 == 0, 0.0).otherwise(F.col(c))
    return prune.drop_padding(prune.drop_columns(read("fixes"), ["env"]).select("fix_id", z("latitude").alias("a"), z("longitude").alias("b")), ["a", "b"]).select("fix_id")


@query("f19_replace_inf", "F19", "SELECT fix_id, CASE WHEN fix_id%5=0 THEN 3.4028234663852886e38 ELSE env END AS env FROM fixes")
def _(read):
    return prune.replace_inf(read("fixes").select("fix_id", F.when(F.col("fix_id") % 10 == 0, float("inf")).when(F.col("fix_id") % 5 == 0, float("-inf")).otherwise(F.col("env")).alias("env")), ["env"])


@query("f20_wrong_predictions", "F20", "SELECT DISTINCT id, species FROM reports WHERE predicted<>species AND species IN ('S1','S2','S3')")
def _(read):
    return prune.reported(R.marked(read("reports")), "prediction = 'Wrong'", ("S1", "S2", "S3"), ("id", "species"))


@query("f20_wrong_in_mixed_taxa", "F20", "SELECT DISTINCT id, random_state FROM reports WHERE predicted<>species AND species IN (SELECT species FROM animals GROUP BY species HAVING count(DISTINCT sex) > 1)")
def _(read):
    mixed = read("animals").groupBy("species").agg(F.count_distinct("sex").alias("n")).filter("n > 1").select("species")
    return prune.reported(R.marked(read("reports")), F.col("prediction") == "Wrong", mixed, ("id", "random_state"))


@query("f22_confident_side_rows", "F22 U1", "SELECT id, species FROM animals WHERE id%2=0 UNION ALL SELECT id, species FROM animals WHERE id%2=1 AND (id%10)/10.0 < 0.4")
def _(read):
    a = read("animals").select("id", "species")
    return prune.add_confident(a.filter("id % 2 = 0"), a.filter("id % 2 = 1").withColumn("loss", (F.col("id") % 10) / 10), 0.4)


@query("l02_evenly_spaced", "L2 L4 L1", """WITH r AS (SELECT fix_id, id, row_number() OVER (PARTITION BY id ORDER BY date_time, fix_id)-1 AS r, count(*) OVER (PARTITION BY id) AS n FROM fixes),
    p AS (SELECT DISTINCT r.id, CAST(floor(i*(n-1)/19.0) AS BIGINT) AS r FROM r, range(20) t(i) WHERE r.r=0)
    SELECT fix_id FROM r JOIN p ON r.id=p.id AND r.r=p.r""")
def _(read):
    return prune.evenly_spaced(read("fixes"), 20).select("fix_id")


@query("l05_ordered_shares", "L5 A32", "WITH c AS (SELECT species, count(*) AS n FROM fixes JOIN animals USING (id) GROUP BY species) SELECT species, round(n/sum(n) OVER (),6)+0.0 AS share, round(sum(n) OVER (ORDER BY n DESC, species)/sum(n) OVER (),6)+0.0 AS cumulative FROM c")
def _(read):
    from ..operators import gridstats

    return gridstats.shares(read("fixes").join(read("animals"), "id"), "species").select("species", r6("share").alias("share"), r6("cumulative").alias("cumulative"))


@query("l08_partition_of_shuffle", "L8", f"SELECT id FROM animals WHERE CAST(concat('0x', substr({MD5},1,8)) AS BIGINT) % 4 = 1")
def _(read):
    return prune.partition(read("animals"), 4, 1).select("id")


@query("m02_stratified_folds", "M2", f"SELECT id, (row_number() OVER (PARTITION BY species ORDER BY {MD5}, id)-1)%5 AS fold FROM animals")
def _(read):
    return prune.folds(read("animals"), 5, "species").select("id", F.col("fold").cast("long").alias("fold"))


@query("u02_split_by_value", "U2 U3", """WITH k AS (SELECT tag, min(CASE WHEN species IN ('S1','S5') THEN 1 ELSE 0 END) AS s FROM animals WHERE NOT (species IN ('S0','S2','S3','S4','S6','S7','S8','S9','S10','S11') AND tag='GPS') GROUP BY tag),
    c AS (SELECT tag, row_number() OVER (ORDER BY s, tag)-1 AS code FROM k)
    SELECT id, code, species IN ('S1','S5') AS side FROM animals JOIN c USING (tag) WHERE NOT (species NOT IN ('S1','S5') AND tag='GPS')""")
def _(read):
    a = read("animals").filter("not (species not in ('S1','S5') and tag = 'GPS')")
    main, side = prune.split_by_value(a, "species", ["S1", "S5"], "tag")
    both = main.withColumn("side", F.lit(False)).unionByName(side.withColumn("side", F.lit(True)))
    return both.select("id", F.col("code").cast("long").alias("code"), "side")


@query("u03_set_operations", "U3 U4 U5 J24", """SELECT 'both' AS kind, count(*) AS n FROM (SELECT species FROM animals WHERE sex='M' INTERSECT SELECT species FROM animals WHERE sex='F')
    UNION ALL SELECT 'only', count(*) FROM (SELECT id FROM animals EXCEPT SELECT id FROM reports WHERE predicted<>species)
    UNION ALL SELECT 'semi', count(*) FROM animals a WHERE EXISTS (SELECT 1 FROM reports r WHERE r.id=a.id AND r.predicted<>r.species)""")
def _(read):
    a, r = read("animals"), read("reports").filter("predicted <> species")
    count = lambda d, k: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n")
    both = a.filter("sex = 'M'").select("species").intersect(a.filter("sex = 'F'").select("species"))
    return count(both, "both").unionAll(count(prune.missing_ids(a, r), "only")).unionAll(count(prune.present_ids(a, r), "semi"))


@query("d02_relabel_stages", "D2 D4 V11", """SELECT fix_id, CASE WHEN stage='unknown' THEN NULL WHEN stage='breeding: incubation' THEN 'breeding: brood' ELSE stage END AS stage,
    concat(upper(substr(split_part(stage,':',1),1,1)), substr(split_part(stage,':',1),2)) AS stage_type, nullif(split_part(stage,': ',2),'') AS sub FROM fixes""")
def _(read):
    df = read("fixes").join(read("animals").select("id", "species"), "id").withColumns({"stage_type": times.stage_type("stage"), "sub": times.sub_stage("stage")})
    return prune.relabel_stages(df, True, {"breeding: incubation": "breeding: brood"}).select("fix_id", "stage", "stage_type", "sub")


@query("d05_remap_to_known", "D5", """WITH k AS (SELECT DISTINCT species, stage FROM fixes JOIN animals USING (id) WHERE stage<>'unknown' AND (id%12<6 OR stage<>'breeding: incubation') UNION SELECT DISTINCT species, 'breeding' FROM animals WHERE id%12=7),
    p AS (SELECT fix_id, species, stage AS predicted FROM fixes JOIN animals USING (id)),
    m AS (SELECT fix_id, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.species=p.species AND k.stage=p.predicted) THEN predicted WHEN EXISTS (SELECT 1 FROM k WHERE k.species=p.species AND k.stage=split_part(p.predicted,':',1)) THEN split_part(p.predicted,':',1) END AS predicted FROM p)
    SELECT fix_id, predicted FROM m WHERE predicted IS NOT NULL""")
def _(read):
    df = read("fixes").join(read("animals"), "id")
    known = df.filter("stage <> 'unknown' and (id % 12 < 6 or stage <> 'breeding: incubation')").select("species", "stage").unionAll(read("animals").filter("id % 12 = 7").select("species", F.lit("breeding").alias("stage"))).distinct()
    return prune.remap_to_known(df.select("fix_id", "species", F.col("stage").alias("predicted")), known).select("fix_id", "predicted")


@query("d06_collapse_switch", "D6 D7", "SELECT fix_id, CASE WHEN stage LIKE 'breeding%' THEN CASE WHEN species='S2' THEN 'non-breeding' ELSE 'breeding' END WHEN stage='non-breeding' AND species='S2' THEN 'breeding' ELSE stage END AS stage FROM fixes JOIN animals USING (id)")
def _(read):
    df = read("fixes").join(read("animals"), "id").withColumn("stage", times.collapse_breeding("stage"))
    return prune.switch_binary(df, "stage", ["S2"], "breeding", "non-breeding").select("fix_id", "stage")


@query("v01_unit_vector", "V1 V7 V8 V15", """WITH v AS (SELECT fix_id, date_time, env, cos(radians(latitude))*cos(radians(longitude)) AS x, cos(radians(latitude))*sin(radians(longitude)) AS y, sin(radians(latitude)) AS z, latitude, longitude,
      dayofyear(date_time)-1+hour(date_time)/24+minute(date_time)/1440+CAST(floor(second(date_time)) AS DOUBLE)/86400 AS day FROM long_fixes)
    SELECT fix_id, round(x,6)+0.0 AS x, round(y,6)+0.0 AS y, round(z,6)+0.0 AS z, round(latitude,6)+0.0 AS lat, round(sin(2*pi()*day/CASE WHEN year(date_time)%4=0 THEN 366.0 ELSE 365.0 END),6)+0.0 AS s, round(cos(radians(env)),6)+0.0 AS c FROM v""")
def _(read):
    x, y, z = geo.unit_vector("latitude", "longitude")
    df = read("long_fixes").withColumns({"x": x, "y": y, "z": z})
    s, _ = times.periodic_time(times.day_of_year("date_time"), F.year("date_time"))
    return df.select("fix_id", *[r6(c).alias(c) for c in "xyz"], r6(geo.to_lat_lon("x", "y", "z")[0]).alias("lat"), r6(s).alias("s"), r6(times.angle_to_sin_cos("env")[1]).alias("c"))


@query("v02_haversine", "V2", f"SELECT fix_id, round({hav('latitude', 'longitude', '0.0', '0.0')},6)+0.0 AS d FROM fixes")
def _(read):
    return read("fixes").select("fix_id", r6(geo.great_circle("latitude", "longitude", F.lit(0.0), F.lit(0.0))).alias("d"))


@query("v04_exp_of_log", "V4 V5 V6", "SELECT fix_id, round(latitude,5)+0.0 AS lat FROM fixes")
def _(read):
    back = geo.exp_map(F.lit(10.0), F.lit(20.0), geo.log_map(F.lit(10.0), F.lit(20.0), "latitude", "longitude"))
    return read("fixes").select("fix_id", (F.round(back[0], 5) + 0.0).alias("lat"))


@query("v10_features", "V10 V14 V12", "SELECT fix_id, round(cos(radians(latitude))*cos(radians(longitude)),6)+0.0 AS x, env AS \"Environment\", date_trunc('second', date_time + INTERVAL 500 MILLISECONDS) AS at FROM fixes")
def _(read):
    return read("fixes").select("fix_id", r6(geo.unit_vector("latitude", "longitude")[0]).alias("x"), F.col("env").alias("Environment"), times.to_second("date_time").cast("timestamp_ntz").alias("at"))


@query("v17_intervals", "V17", f"WITH {TRACKS} SELECT id, CASE WHEN days>0 AND days<=1 THEN 0 WHEN days>1 AND days<=10 THEN 1 WHEN days>10 AND days<=50 THEN 2 WHEN days>50 AND days<=100 THEN 3 WHEN days>100 AND days<=200 THEN 4 WHEN days>200 AND days<=500 THEN 5 END AS bin FROM tracks")
def _(read):
    return tracks(read).select("id", times.interval("days").alias("bin"))


@query("v18_quantile_bins", "V18", """WITH e AS (SELECT quantile_cont(env, [0.0,0.2,0.4,0.6,0.8,1.0]) AS e FROM fixes)
    SELECT fix_id, CASE WHEN env<=e[2] THEN 0 WHEN env<=e[3] THEN 1 WHEN env<=e[4] THEN 2 WHEN env<=e[5] THEN 3 WHEN env<=e[6] THEN 4 END AS bin FROM fixes, e""")
def _(read):
    from ..operators import gridstats

    return gridstats.quantile_bins(read("fixes"), "env", 5).select("fix_id", "bin")


@query("v19_grid_cells", "V19 V20", "SELECT fix_id, CAST(ceil(latitude/0.25) AS BIGINT) AS cell, round(ceil(longitude/0.5)*0.5-0.25,6)+0.0 AS centre, CAST(least(floor(5.0*(1+sin(radians(latitude)))),9) AS BIGINT) AS band FROM fixes")
def _(read):
    return read("fixes").select("fix_id", geo.cell("latitude", 0.25).alias("cell"), r6(geo.cell_centre("longitude", 0.5)).alias("centre"), geo.equal_area_band("latitude", 10).alias("band"))


@query("v21_month_week", "V21 V22", "SELECT fix_id, CAST(month(DATE '2020-01-01' + CAST(dayofyear(date_time)-1 AS INTEGER)) AS INTEGER) AS month, CAST(floor((dayofyear(date_time)-1)/7) AS BIGINT) AS week, CASE WHEN sex='M' THEN 1 ELSE 0 END AS sex_M FROM fixes JOIN animals USING (id)")
def _(read):
    day = times.day_of_year("date_time")
    return prune.one_hot(read("fixes").join(read("animals"), "id"), "sex", ["M"]).select("fix_id", times.month_of_day(day).alias("month"), times.week_of_day(day).alias("week"), "sex_M")


@query("v23_effect_sizes", "V23", """WITH a AS (SELECT species, avg(CASE WHEN predicted=species THEN 1.0 ELSE 0.0 END) AS p FROM reports GROUP BY species)
    SELECT species, round(2*asin(sqrt(p))-2*asin(sqrt(0.5)),6)+0.0 AS h, round(CASE WHEN p>0 AND p<1 THEN -(p*ln(p)+(1-p)*ln(1-p)) ELSE 0.0 END,6)+0.0 AS e, round(2*p/(p+1),6)+0.0 AS f1 FROM a""")
def _(read):
    a = read("reports").groupBy("species").agg(F.avg((F.col("predicted") == F.col("species")).cast("double")).alias("p"))
    return a.select("species", r6(times.cohens_h("p", F.lit(0.5))).alias("h"), r6(times.binary_entropy("p")).alias("e"), r6(times.chance_f1("p")).alias("f1"))


RUNSQ = """n AS (SELECT * FROM fixes WHERE stage<>'unknown'), g AS (SELECT *, CASE WHEN stage = lag(stage) OVER w THEN 0 ELSE 1 END AS fresh FROM n WINDOW w AS (PARTITION BY id ORDER BY date_time, fix_id)),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY date_time, fix_id) AS run FROM g),
    k AS (SELECT *, dense_rank() OVER (PARTITION BY id, stage ORDER BY run) AS k, count(*) OVER (PARTITION BY id, run) AS c, max(run) OVER (PARTITION BY id) AS runs FROM r)"""


@query("w18_stage_runs", "W18 A2", f"""WITH {RUNSQ} SELECT CASE WHEN runs=1 THEN CAST(id AS STRING) ELSE concat(CAST(id AS STRING),'-',stage,'-',CAST(k AS STRING)) END AS new_id, stage, count(*) AS length,
    round((max(epoch_us(date_time))-min(epoch_us(date_time)))/86400000000.0,6)+0.0 AS days FROM k WHERE c>1 GROUP BY 1, stage""")
def _(read):
    return stages.run_days(stages.stage_runs(read("fixes"))).select("new_id", "stage", "length", r6("days").alias("days"))


@query("a21_stage_by_bin", "A21", """WITH b AS (SELECT id, year(date_time) AS year, CAST(ceil((dayofyear(date_time)-1+hour(date_time)/24+minute(date_time)/1440+CAST(floor(second(date_time)) AS DOUBLE)/86400)*0.2) AS BIGINT) AS bin, stage FROM fixes),
    c AS (SELECT id, year, bin, stage, count(*) AS n FROM b WHERE bin>0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id, year, bin ORDER BY n DESC, stage) AS k FROM c)
    SELECT id, CAST(year AS INTEGER) AS year, bin, stage FROM r WHERE k=1""")
def _(read):
    return stages.stage_by_bin(read("fixes"), 0.2)


@query("a22_stage_counts", "A22 A34", """SELECT species, stage, count(DISTINCT id) AS n_animals, count(DISTINCT stage) AS n_stages, CAST(grouping(species, stage) AS BIGINT) AS level FROM fixes JOIN animals USING (id) GROUP BY ROLLUP (species, stage) HAVING grouping(species, stage) < 3""")
def _(read):
    return stages.stage_counts(read("fixes").join(read("animals"), "id"))


@query("a23_stage_kinds", "A23", "SELECT species, count(DISTINCT stage) AS n_stages, CASE WHEN count(DISTINCT stage)<=1 THEN 'one-class' WHEN count(DISTINCT stage)=2 THEN 'binary' ELSE 'multi' END AS kind FROM fixes JOIN animals USING (id) GROUP BY species")
def _(read):
    return stages.stage_kinds(read("fixes").join(read("animals"), "id"))


@query("a38_hemisphere", "A38 V24", """WITH m AS (SELECT id, avg(latitude) AS m FROM fixes GROUP BY id), s AS (SELECT species, quantile_cont(m,0.5) AS s FROM m JOIN animals USING (id) GROUP BY species)
    SELECT fix_id, round(CASE WHEN sign(s.s)<>sign((SELECT s FROM s WHERE species='S1')) THEN -latitude ELSE latitude END,6)+0.0 AS latitude FROM fixes JOIN animals USING (id) JOIN s USING (species)""")
def _(read):
    from ..operators import gridstats

    return gridstats.align_hemisphere(read("fixes").join(read("animals"), "id"), "S1").select("fix_id", r6("latitude").alias("latitude"))


_ = motion
