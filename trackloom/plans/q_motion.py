"""Queries on steps and summaries of tracks."""

from pyspark.sql import functions as F

from ..operators import motion as M
from .base import query


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


def r9(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 9) + 0.0


def hav(a, b, c, d):
    return f"2*asin(least(1.0, sqrt(pow(sin((radians({c})-radians({a}))/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin((radians({d})-radians({b}))/2),2))))"


def steps_sql(view="fixes"):
    """Steps with great circle distance, displacement components and repaired dt."""
    return f"""s0 AS (SELECT *, lead(latitude) OVER w AS la2, lead(longitude) OVER w AS lo2,
         (epoch_us(lead(date_time) OVER w) - epoch_us(date_time)) / 86400000000.0 AS dt0
         FROM {view} WINDOW w AS (PARTITION BY id ORDER BY date_time, fix_id)),
    s1 AS (SELECT *, {hav('latitude', 'longitude', 'la2', 'lo2')} AS dist,
         cos(radians(latitude))*cos(radians(longitude)) AS px, cos(radians(latitude))*sin(radians(longitude)) AS py, sin(radians(latitude)) AS pz,
         cos(radians(la2))*cos(radians(lo2)) AS qx, cos(radians(la2))*sin(radians(lo2)) AS qy, sin(radians(la2)) AS qz FROM s0),
    s2 AS (SELECT *, CASE WHEN sin(dist) > 0 THEN dist/sin(dist) ELSE 0.0 END AS k FROM s1),
    s3 AS (SELECT *, k*(qx-cos(dist)*px) AS vx, k*(qy-cos(dist)*py) AS vy, k*(qz-cos(dist)*pz) AS vz FROM s2),
    steps AS (SELECT *, vx*sin(radians(latitude))*cos(radians(longitude)) + vy*sin(radians(latitude))*sin(radians(longitude)) - vz*cos(radians(latitude)) AS south,
         -vx*sin(radians(longitude)) + vy*cos(radians(longitude)) AS east,
         CASE WHEN dt0 < 1e-8 THEN coalesce(avg(CASE WHEN dt0 >= 1e-8 THEN dt0 END) OVER (PARTITION BY id), 0.11) ELSE dt0 END AS dt FROM s3)"""


SPEED = f"WITH {steps_sql()}, speeds AS (SELECT *, dist/dt AS speed FROM steps)"


@query("species_speed", "W1 W2 W4 A4 A9 J1", SPEED + """, per AS (SELECT id, avg(speed) AS m, quantile_cont(speed, 0.5) AS md, stddev_pop(speed) AS sd, max(speed) AS mx, count(speed) AS n,
      quantile_cont(latitude, 0.5) AS lat FROM speeds GROUP BY id)
    SELECT species, count(*) AS n_animals, CAST(sum(n) AS BIGINT) AS n_steps, round(avg(m),6)+0.0 AS mean_speed, round(avg(md),6)+0.0 AS median_speed, round(avg(sd),6)+0.0 AS std_speed,
      round(max(mx),6)+0.0 AS max_speed, round(avg(lat),6)+0.0 AS mean_median_lat FROM per JOIN animals USING (id) GROUP BY species""")
def _(read):
    per = M.speed_stats(read("fixes")).join(M.positions(read("fixes")).select("id", "median_lat"), "id").join(read("animals"), "id")
    return per.groupBy("species").agg(F.count(F.lit(1)).alias("n_animals"), F.sum("n_steps").alias("n_steps"), r6(F.avg("mean_speed")).alias("mean_speed"), r6(F.avg("median_speed")).alias("median_speed"), r6(F.avg("std_speed")).alias("std_speed"), r6(F.max("max_speed")).alias("max_speed"), r6(F.avg("median_lat")).alias("mean_median_lat"))


@query("w01_absolute_dt", "W1 W4", f"WITH {steps_sql()} SELECT fix_id, id, round(dt0,6)+0.0 AS dt, round(dist,6)+0.0 AS dist FROM steps")
def _(read):
    return M.steps(read("fixes")).select("fix_id", "id", r6("dt").alias("dt"), r6("dist").alias("dist"))


CYCLIC = """d0 AS (SELECT *, dayofyear(date_time)-1+hour(date_time)/24+minute(date_time)/1440+CAST(floor(second(date_time)) AS DOUBLE)/86400 AS day, year(date_time) AS y,
      CASE WHEN (year(date_time)%4=0 AND year(date_time)%100<>0) OR year(date_time)%400=0 THEN 366.0 ELSE 365.0 END AS len FROM long_fixes),
    d1 AS (SELECT *, lead(day) OVER w - day AS d, lead(y) OVER w AS y2 FROM d0 WINDOW w AS (PARTITION BY id ORDER BY date_time, fix_id)),
    d2 AS (SELECT *, CASE WHEN d < 0 THEN d+len ELSE d END AS dt0 FROM d1),
    d3 AS (SELECT *, CASE WHEN dt0 < 1e-8 THEN coalesce(avg(CASE WHEN dt0 >= 1e-8 THEN dt0 END) OVER (PARTITION BY id), 0.11) ELSE dt0 END AS dt1 FROM d2)"""


@query("w01_cyclic_dt", "W1 W2 V12", f"WITH {CYCLIC} SELECT fix_id, id, round(CASE WHEN y2<>y AND d>=0 THEN dt1+len ELSE dt1 END, 6)+0.0 AS dt FROM d3")
def _(read):
    return M.cyclic_dt(read("long_fixes")).select("fix_id", "id", r6("dt").alias("dt"))


@query("w03_closest_dt", "W3", """WITH r AS (SELECT fix_id, id, date_trunc('day', date_time) AS date_time FROM fixes),
    s AS (SELECT *, (epoch_us(lead(date_time) OVER w) - epoch_us(date_time)) / 86400000000.0 AS dt FROM r WINDOW w AS (PARTITION BY id ORDER BY date_time, fix_id)),
    n AS (SELECT *, CASE WHEN dt >= 1e-8 THEN dt END AS x FROM s),
    f AS (SELECT *, last_value(x IGNORE NULLS) OVER (PARTITION BY id ORDER BY date_time, fix_id ROWS UNBOUNDED PRECEDING) AS b,
      first_value(x IGNORE NULLS) OVER (PARTITION BY id ORDER BY date_time, fix_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM n)
    SELECT fix_id, round(CASE WHEN dt < 1e-8 THEN coalesce((a+b)/2, b, a, 0.11) ELSE dt END, 6)+0.0 AS dt FROM f""")
def _(read):
    day = read("fixes").withColumn("date_time", F.date_trunc("DAY", "date_time"))
    return M.fill_zero_dt(M.steps(day), "closest").select("fix_id", r6("dt").alias("dt"))


@query("w05_displacement_velocity", "W5 W6 V3 V5", f"WITH {steps_sql()} SELECT fix_id, round(south/dt,6)+0.0 AS v_south, round(east/dt,6)+0.0 AS v_east, round(dist/dt,6)+0.0 AS speed FROM steps")
def _(read):
    return M.velocity(read("fixes")).select("fix_id", *[r6(c).alias(c) for c in ("v_south", "v_east", "speed")])


@query("w07_velocity_xyz", "W7", f"WITH {steps_sql()} SELECT fix_id, round((qx-px)/dt,6)+0.0 AS v_x, round((qy-py)/dt,6)+0.0 AS v_y, round((qz-pz)/dt,6)+0.0 AS v_z FROM steps")
def _(read):
    return M.velocity_xyz(read("fixes")).select("fix_id", *[r6(c).alias(c) for c in ("v_x", "v_y", "v_z")])


@query("w08_differences", "W8", """WITH d AS (SELECT fix_id, lead(env) OVER w - env AS d_env, lead(latitude) OVER w - latitude AS d_latitude, lead(date_time) OVER w AS n FROM fixes WINDOW w AS (PARTITION BY id ORDER BY date_time, fix_id))
    SELECT fix_id, round(d_env,6)+0.0 AS d_env, round(d_latitude,6)+0.0 AS d_latitude FROM d WHERE n IS NOT NULL""")
def _(read):
    return M.differences(read("fixes"), ["env", "latitude"]).select("fix_id", r6("d_env").alias("d_env"), r6("d_latitude").alias("d_latitude"))


ORIGIN = f"""{steps_sql()}, origin AS (SELECT fix_id, id, env, date_time, coalesce(sum(south) OVER b, 0.0) AS sn, coalesce(sum(east) OVER b, 0.0) AS we,
      (epoch_us(date_time) - min(epoch_us(date_time)) OVER (PARTITION BY id)) / 86400000000.0 AS t
      FROM steps WINDOW b AS (PARTITION BY id ORDER BY date_time, fix_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("w09_common_origin", "W9 W10", f"WITH {ORIGIN} SELECT fix_id, env, round(sn,6)+0.0 AS sn, round(we,6)+0.0 AS we, round(t,6)+0.0 AS t FROM origin")
def _(read):
    return M.common_origin(read("fixes"), keep=["env"]).select("fix_id", "env", *[r6(c).alias(c) for c in ("sn", "we", "t")])


@query("w11_shift_clock", "W11", f"WITH {CYCLIC} SELECT fix_id, round(((day - first_value(day) OVER (PARTITION BY id ORDER BY date_time, fix_id)) % len + len) % len, 6)+0.0 AS day0 FROM d0")
def _(read):
    return M.shift_clock(read("long_fixes")).select("fix_id", r6("day0").alias("day0"))


RUNS = """y0 AS (SELECT *, year(date_time) AS year FROM long_fixes),
    y1 AS (SELECT *, CASE WHEN year <> lag(year) OVER w THEN 1 ELSE 0 END AS fresh FROM y0 WINDOW w AS (PARTITION BY id ORDER BY date_time, fix_id)),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY date_time, fix_id) AS run FROM y1),
    spans AS (SELECT id, run, year, (max(epoch_us(date_time))-min(epoch_us(date_time)))/86400000000.0 AS span, count(*) AS n FROM runs GROUP BY id, run, year)"""


@query("w12_year_runs", "W12", f"WITH {RUNS} SELECT fix_id, CAST(year AS BIGINT) AS year, CAST(run AS BIGINT) AS run FROM runs")
def _(read):
    return M.year_runs(read("long_fixes")).select("fix_id", F.col("year").cast("long").alias("year"), F.col("run").cast("long").alias("run"))


@query("w13_drop_repeated_times", "W13", "SELECT min(fix_id) AS fix_id, id, d FROM (SELECT fix_id, id, CAST(date_time AS DATE) AS d FROM fixes) GROUP BY id, d")
def _(read):
    day = read("fixes").withColumn("date_time", F.col("date_time").cast("date"))
    return M.drop_repeated_times(day).select("fix_id", "id", F.col("date_time").alias("d"))


@query("w19_average_rank", "W19 L6", "SELECT fix_id, CAST(rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS DOUBLE) AS rank FROM (SELECT fix_id, round(env) AS x FROM fixes WHERE env IS NOT NULL)")
def _(read):
    return M.average_rank(read("fixes").filter("env is not null").select("fix_id", F.round("env").alias("x")), "x").select("fix_id", "rank")


#: Each track from (0, 0) on, a step a round: n is a step's length, k is sin(n) / n.
MOVED = f"""WITH RECURSIVE {steps_sql()}, nth AS (SELECT id, fix_id, row_number() OVER (PARTITION BY id ORDER BY date_time, fix_id) AS rn, south, east, sqrt(south*south+east*east) AS n FROM steps),
    st AS (SELECT id, fix_id, rn, south, east, cos(n) AS c, CASE WHEN n > 0 THEN sin(n)/n ELSE 1.0 END AS k FROM nth),
    pos AS (SELECT id, CAST(1 AS BIGINT) AS rn, CAST(0.0 AS DOUBLE) AS la, CAST(0.0 AS DOUBLE) AS lo FROM st WHERE rn = 1
      UNION ALL SELECT id, rn + 1, atan2(z, sqrt(x*x+y*y)), atan2(y, x) FROM (SELECT pos.id, pos.rn, (c*cos(la)+k*south*sin(la))*cos(lo)-k*east*sin(lo) AS x, (c*cos(la)+k*south*sin(la))*sin(lo)+k*east*cos(lo) AS y, c*sin(la)-k*south*cos(la) AS z
        FROM pos JOIN st ON st.id = pos.id AND st.rn = pos.rn AND st.south IS NOT NULL))
    SELECT fix_id, round(degrees(la),5)+0.0 AS latitude, round(degrees(lo),5)+0.0 AS longitude FROM pos JOIN st USING (id, rn)"""


@query("w20_translate_to_origin", "W20 V4 V6", MOVED)
def _(read):
    five = lambda c: (F.round(c, 5) + 0.0).alias(c)
    return M.translate_to_origin(read("fixes")).select("fix_id", five("latitude"), five("longitude"))


@query("w21_dead_reckoning", "W21 V4", "SELECT fix_id, round(latitude,5)+0.0 AS latitude, round(longitude,5)+0.0 AS longitude FROM fixes")
def _(read):
    # Integrating a track's own steps from its own start gives the track back.
    return M.dead_reckon(M.steps(read("fixes"))).select("fix_id", (F.round("latitude", 5) + 0.0).alias("latitude"), (F.round("longitude", 5) + 0.0).alias("longitude"))


@query("w22_rescaled_speed", "W22 U4", SPEED + """, sp AS (SELECT s.*, species FROM speeds s JOIN animals USING (id)),
    cap AS (SELECT species, avg(speed)+3*stddev_pop(speed) AS cap FROM sp GROUP BY species),
    lim AS (SELECT species, cap, min(least(speed,cap)) AS lo, max(least(speed,cap)) AS hi FROM sp JOIN cap USING (species) WHERE speed IS NOT NULL GROUP BY species, cap),
    sc AS (SELECT fix_id, id, date_time, CASE WHEN speed IS NULL THEN NULL ELSE greatest(0.0, least(1.0, (least(speed,cap)-lo)/(hi-lo))) END AS scaled, dist, dt, south, east, speed FROM sp JOIN lim USING (species))
    SELECT fix_id, round(scaled,6)+0.0 AS scaled, round(coalesce(sum(CASE WHEN speed>0 THEN south/dist*scaled*dt ELSE 0.0 END) OVER b,0.0),6)+0.0 AS sn FROM sc
    WINDOW b AS (PARTITION BY id ORDER BY date_time, fix_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(read):
    df = M.rescale_speed(read("fixes").join(read("animals"), "id"))
    return df.select("fix_id", r6(F.when(F.col("speed").isNotNull(), F.col("scaled"))).alias("scaled"), r6("sn").alias("sn"))


@query("w23_unit_square", "W23", f"WITH {ORIGIN} SELECT fix_id, round((we-min(we) OVER p)/(max(we) OVER p-min(we) OVER p),6)+0.0 AS x, round((sn-min(sn) OVER p)/(max(sn) OVER p-min(sn) OVER p),6)+0.0 AS y FROM origin JOIN animals USING (id) WINDOW p AS (PARTITION BY species)")
def _(read):
    return M.unit_square(M.common_origin(read("fixes")).join(read("animals"), "id"), "species").select("fix_id", r6("x").alias("x"), r6("y").alias("y"))


@query("w24_turning_angle", "W24", f"""WITH {steps_sql()}, u AS (SELECT fix_id, id, date_time, CASE WHEN sqrt(south*south+east*east) > 0 THEN south/sqrt(south*south+east*east) END AS s, CASE WHEN sqrt(south*south+east*east) > 0 THEN east/sqrt(south*south+east*east) END AS e FROM steps),
    v AS (SELECT *, lag(s) OVER w AS ps, lag(e) OVER w AS pe FROM u WINDOW w AS (PARTITION BY id ORDER BY date_time, fix_id))
    SELECT fix_id, round(CASE WHEN s*ps IS NULL THEN NULL ELSE acos(greatest(-1.0, least(1.0, s*ps+e*pe)))*sign(ps*e-pe*s) END, 5)+0.0 AS angle FROM v""")
def _(read):
    return M.turning_angle(read("fixes")).select("fix_id", (F.round("angle", 5) + 0.0).alias("angle"))


@query("v13_hours_since_start", "V13", "SELECT fix_id, round((epoch_us(date_time)-min(epoch_us(date_time)) OVER (PARTITION BY id))/3600000000.0,6)+0.0 AS hours FROM fixes")
def _(read):
    return M.hours_since_start(read("fixes")).select("fix_id", r6("hours").alias("hours"))


@query("a01_track_summary", "A1", "SELECT id, count(*) AS length, round(avg(latitude),6)+0.0 AS mean_lat, round(avg(longitude),6)+0.0 AS mean_lon, (min(year(date_time))+max(year(date_time)))/2.0 AS mean_year FROM long_fixes GROUP BY id")
def _(read):
    return M.track_summary(read("long_fixes")).select("id", "length", r6("mean_lat").alias("mean_lat"), r6("mean_lon").alias("mean_lon"), "mean_year")


@query("a02_days_in_track", "A2", f"""WITH {RUNS}, y AS (SELECT id, max(span) AS d FROM spans GROUP BY id), a AS (SELECT id, (max(epoch_us(date_time))-min(epoch_us(date_time)))/86400000000.0 AS d FROM long_fixes GROUP BY id)
    SELECT a.id, round(a.d,6)+0.0 AS days_all, round(y.d,6)+0.0 AS days_year FROM a JOIN y ON a.id=y.id""")
def _(read):
    df = read("long_fixes")
    return M.days_in_track(df).withColumnRenamed("days", "a").join(M.days_in_track(df, "year").withColumnRenamed("days", "y"), "id").select("id", r6("a").alias("days_all"), r6("y").alias("days_year"))


@query("a03_best_year_run", "A3 L7", f"""WITH {RUNS}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, run) AS rn FROM spans)
    SELECT id, CAST(year AS BIGINT) AS year, round(span,6)+0.0 AS span, n FROM n WHERE rn=1""")
def _(read):
    return M.best_year_run(read("long_fixes"), "n").select("id", F.col("year").cast("long").alias("year"), r6("span").alias("span"), "n")


@query("a04_speed_stats", "A4", SPEED + " SELECT id, round(avg(speed),6)+0.0 AS mean_speed, round(quantile_cont(speed,0.5),6)+0.0 AS median_speed, round(stddev_pop(speed),6)+0.0 AS std_speed, round(max(speed),6)+0.0 AS max_speed, count(speed) AS n_steps, arg_min(latitude, (date_time, fix_id)) AS start_lat FROM speeds GROUP BY id")
def _(read):
    return M.speed_stats(read("fixes")).select("id", *[r6(c).alias(c) for c in ("mean_speed", "median_speed", "std_speed", "max_speed")], "n_steps", "start_lat")


@query("a05_majority_cluster", "A5 L7", """WITH c AS (SELECT id, fix_id % 4 - 1 AS k, count(*) AS n FROM fixes GROUP BY id, k),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, CASE WHEN k<0 THEN 999 ELSE k END) AS rn, sum(n) OVER (PARTITION BY id) AS t FROM c)
    SELECT id, CAST(k AS BIGINT) AS cluster, round(n/t,6)+0.0 AS share FROM r WHERE rn=1""")
def _(read):
    return M.majority(read("fixes").withColumn("cluster", F.col("fix_id") % 4 - 1), "cluster").select("id", F.col("value").alias("cluster"), r6("share").alias("share"))


@query("a07_net_displacement", "A7", f"""WITH e AS (SELECT id, arg_min(latitude,(date_time,fix_id)) AS latitude, arg_min(longitude,(date_time,fix_id)) AS longitude, arg_max(latitude,(date_time,fix_id)) AS la2, arg_max(longitude,(date_time,fix_id)) AS lo2 FROM fixes GROUP BY id)
    SELECT id, round({hav('latitude', 'longitude', 'la2', 'lo2')},6)+0.0 AS dist FROM e""")
def _(read):
    return M.net_displacement(read("fixes")).select("id", r6("dist").alias("dist"))


@query("a08_extension", "A8", f"WITH {ORIGIN} SELECT id, round(max(abs(sn)),6)+0.0 AS sn_max, round(max(abs(we)),6)+0.0 AS we_max FROM origin GROUP BY id")
def _(read):
    return M.extension(read("fixes")).select("id", r6("sn_max").alias("sn_max"), r6("we_max").alias("we_max"))


@query("a09_positions", "A9", "SELECT id, count(*) AS n_obs, round(quantile_cont(latitude,0.5),6)+0.0 AS median_lat, round(quantile_cont(longitude,0.5),6)+0.0 AS median_lon, round(avg(year(date_time)),6)+0.0 AS mean_year FROM long_fixes GROUP BY id")
def _(read):
    return M.positions(read("long_fixes")).select("id", "n_obs", *[r6(c).alias(c) for c in ("median_lat", "median_lon", "mean_year")])


def covariate_sql(expr):
    return f"""WITH x AS (SELECT id, {expr} AS x FROM fixes), m AS (SELECT *, quantile_cont(x,0.5) OVER (PARTITION BY id) AS m FROM x)
    SELECT id, round(avg(x),9)+0.0 AS mean, round(avg(CASE WHEN x>0 THEN x END),9)+0.0 AS mean_positive, round(avg(CASE WHEN x>=m THEN x END),9)+0.0 AS mean_upper,
      round(quantile_cont(x,0.25),9)+0.0 AS p25, round(quantile_cont(x,0.5),9)+0.0 AS p50, round(quantile_cont(x,0.75),9)+0.0 AS p75, round(max(x),9)+0.0 AS max, round(stddev_pop(x),9)+0.0 AS std FROM m GROUP BY id"""


@query("a10_effort_stats", "A10", covariate_sql("coalesce(env, 0.0)"))
def _(read):
    df = M.covariate_stats(read("fixes"), "env", 0.0)
    return df.select("id", *[r9(c).alias(c) for c in df.columns[1:]])


@query("a11_covariate_stats", "A11 A12", covariate_sql("env"))
def _(read):
    df = M.covariate_stats(read("fixes"), "env")
    return df.select("id", *[r9(c).alias(c) for c in df.columns[1:]])


@query("a13_sampling_frequency", "A13", f"WITH {steps_sql()} SELECT id, round(avg(1/dt),4)+0.0 AS mean_freq, round(stddev_pop(1/dt),4)+0.0 AS std_freq FROM steps GROUP BY id")
def _(read):
    return M.sampling_frequency(read("fixes")).select("id", (F.round("mean_freq", 4) + 0.0).alias("mean_freq"), (F.round("std_freq", 4) + 0.0).alias("std_freq"))
