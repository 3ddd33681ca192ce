"""Hand-made cases and invariants of the operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import geo, times
from trackloom.operators import enrich, gridstats, models, motion, prune, report, resample, stages, stats
from trackloom.sources import io
from trackloom.streaming import rows as stream_rows


def fixes(spark, rows):
    """rows: (id, ISO time, lat, lon[, stage])."""
    data = [(i, r[0], dt.datetime.fromisoformat(r[1]), float(r[2]), float(r[3]), r[4] if len(r) > 4 else None, float(i)) for i, r in enumerate(rows)]
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.createDataFrame(data, "fix_id long, id long, date_time timestamp_ntz, latitude double, longitude double, stage string, env double")
    return df.withColumn("date_time", F.col("date_time").cast("timestamp"))


def test_year_wrap_and_leap_year(spark):
    df = fixes(spark, [(1, "2020-12-31T12:00", 0, 0), (1, "2021-01-01T12:00", 0, 1)])
    assert motion.steps(df).orderBy("fix_id").first().dt == 1.0
    assert motion.cyclic_dt(df).orderBy("fix_id").first().dt == pytest.approx(1.0)


def test_zero_steps(spark):
    df = fixes(spark, [(1, "2020-01-01T00:00", 0, 0), (1, "2020-01-01T00:00", 0, 0), (1, "2020-01-02T00:00", 0, 0), (1, "2020-01-04T00:00", 0, 0)])
    assert [r.dt for r in motion.fill_zero_dt(motion.steps(df)).orderBy("fix_id").collect()] == [1.5, 1.0, 2.0, None]
    df = fixes(spark, [(1, "2020-01-01T00:00", 0, 0), (1, "2020-01-01T00:00", 0, 0)])
    assert motion.fill_zero_dt(motion.steps(df)).orderBy("fix_id").first().dt == 0.11


def test_single_fix_and_antimeridian(spark):
    df = fixes(spark, [(1, "2020-01-01T00:00", 0, 0), (2, "2020-01-01T00:00", 0, 179.5), (2, "2020-01-02T00:00", 0, -179.5)])
    assert {r.id: r.days for r in motion.days_in_track(df).collect()} == {1: 0.0, 2: 1.0}
    step = motion.steps(df).filter("id = 2").orderBy("fix_id").first()
    assert step.dist == pytest.approx(math.radians(1)) and step.east == pytest.approx(math.radians(1))


def test_equal_points_have_no_displacement(spark):
    df = fixes(spark, [(1, "2020-01-01T00:00", 5, 5), (1, "2020-01-02T00:00", 5, 5)])
    r = motion.velocity(df).orderBy("fix_id").first()
    assert (r.speed, r.v_south, r.v_east) == (0.0, 0.0, 0.0)


def test_half_even_cells_and_bins(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (-0.5,)], "x double")
    assert [r[0] for r in df.select(geo.half_even_cell("x")).collect()] == [0, 2, 0]
    b = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (501.0,)], "x double")
    assert [r[0] for r in b.select(times.interval("x")).collect()] == [None, 0, 1, None]


def test_seam_of_the_grid(spark):
    g = spark.createDataFrame([(0, -180, None), (0, 180, 4.0), (1, -180, 2.0), (1, 180, 4.0)], "cell_lat long, cell_lon long, value double")
    got = {(r.cell_lat, r.cell_lon): r.value for r in enrich.complete_grid(g).filter("abs(cell_lon) = 180 and cell_lat in (0, 1)").collect()}
    assert got == {(0, -180): 4.0, (0, 180): 4.0, (1, -180): 3.0, (1, 180): 3.0}


def test_polygon_edges_and_notch(spark):
    ring = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (2.0, 2.0), (4.0, 0.0)]
    pts = spark.createDataFrame([(0.0, 2.0), (4.0, 4.0), (3.5, 2.0), (1.0, 2.0)], "y double, x double")
    assert [r[0] for r in pts.select(geo.in_polygon("y", "x", ring)).collect()] == [True, True, False, True]


def test_points_on_a_slanted_edge_are_inside(spark):
    ring = [(-40.0, -150.0), (-40.0, 100.0), (10.0, 100.0), (40.0, 150.0), (40.0, -150.0)]
    rows = [(y, 100.0 + (y - 10.0) * 50.0 / 30.0) for y in (10.0 + 3 * k / 500 for k in range(5001))]
    beyond = [(y, x + 1e-9) for y, x in rows if y < 40]
    pts = spark.createDataFrame([(y, x, True) for y, x in rows] + [(y, x, False) for y, x in beyond], "y double, x double, want boolean")
    assert pts.filter(geo.in_polygon("y", "x", ring) != F.col("want")).count() == 0


def test_longest_run_is_the_first_on_a_tie(spark):
    df = fixes(spark, [(1, f"2020-01-0{i + 1}T00:00", 1 if inside else 9, 1) for i, inside in enumerate([1, 1, 0, 1, 1])])
    ring = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)]
    assert prune.longest_inside(df, ring).first()[1:] == (1, 2)
    assert [r.fix_id for r in prune.keep_inside(df, ring).orderBy("fix_id").collect()] == [0, 1]


def test_vote_ties_go_to_the_lowest_class(spark):
    p = spark.createDataFrame([(1, 2), (1, 1), (1, 2), (1, 1)], "id long, pred int")
    assert models.majority_vote(p).first()[1:] == (1, 0.5)


def test_summed_probabilities_do_not_rest_on_the_layout(spark):
    rng = np.random.default_rng(5)
    rows = [(t, 100 * t + k, [int(v) / 33 for v in rng.permutation([1, 2, 3])]) for t in range(300) for k in range(12)]
    want = {}
    for t, _, probs in rows:
        want.setdefault(t, [0.0, 0.0, 0.0])
        want[t] = [s + p for s, p in zip(want[t], probs, strict=True)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "id long, fix_id long, probs array<double>").repartition(7)
    got = {r.id: r.pred for r in models.probability_vote(df).collect()}
    assert got == {t: s.index(max(s)) for t, s in want.items()}


def test_stage_runs(spark):
    df = fixes(spark, [(7, f"2020-01-0{i + 1}T00:00", 0, 0, s) for i, s in enumerate("AABA")])
    assert [tuple(r) for r in stages.run_days(stages.stage_runs(df)).select("new_id", "length").collect()] == [("7-A-1", 2)]


def test_maps_invert_each_other(spark):
    pts = spark.createDataFrame([(10.0, 20.0, -33.0, 151.0), (-60.0, -179.0, -61.0, 179.0)], "a double, b double, c double, d double")
    v = geo.log_map("a", "b", "c", "d")
    lat, lon = geo.exp_map("a", "b", v)
    for r in pts.select("c", "d", lat.alias("e"), lon.alias("f"), F.sqrt(sum(x * x for x in v)).alias("n"), geo.great_circle("a", "b", "c", "d").alias("g")).collect():
        assert (r.e, r.f) == (pytest.approx(r.c), pytest.approx(r.d)) and r.n == pytest.approx(r.g)


def test_dead_reckoning_returns_the_track_and_translation_keeps_steps(spark):
    df = fixes(spark, [(1, f"2020-01-0{i + 1}T00:00", 10 + i, 170 + 5 * i if i < 2 else -180 + i) for i in range(4)])
    back = {r.fix_id: r for r in motion.dead_reckon(motion.steps(df)).collect()}
    for r in df.collect():
        assert back[r.fix_id].latitude == pytest.approx(r.latitude) and back[r.fix_id].longitude == pytest.approx(r.longitude)
    moved = motion.translate_to_origin(df)
    assert moved.orderBy("fix_id").select("latitude", "longitude").first()[:] == (0.0, 0.0)
    a, b = ({r.fix_id: r.south for r in motion.steps(x).collect()} for x in (df, moved))
    assert all(a[k] is None or a[k] == pytest.approx(b[k]) for k in a)


def test_resampling_crosses_the_antimeridian(spark):
    df = fixes(spark, [(1, "2020-01-01T00:00", 0, 179.0), (1, "2020-01-03T00:00", 2, -179.0)])
    got = [(r.latitude, abs(r.longitude)) for r in resample.resample(df, 1).orderBy("slot").collect()]
    assert got == [(0.0, 179.0), (1.0, 180.0), (2.0, 179.0)]


def test_resampling_sorts_a_track_once(spark):
    rows = [(1, "2020-12-30T06:00", 1, 0), (1, "2020-12-30T06:00", 9, 9), (1, "2020-12-31T06:00", 3, 2), (1, "2021-01-02T06:00", 7, 7), (2, "2020-01-01T00:00", 5, 5)]
    found = resample.resample(fixes(spark, rows), 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1
    got = [(r.id, r.year, r.latitude, r.longitude) for r in found.orderBy("id", "slot").collect()]
    assert got == [(1, 2020, 1.5, 0.5), (1, 2020, 2.5, 1.5), (2, 2020, 5.0, 5.0)]


def test_nearest_site_reaches_far_and_over_the_pole(spark):
    pts = spark.createDataFrame([(1, 89.0, 0.0), (2, 0.0, 0.0)], "fix_id long, latitude double, longitude double")
    sites = spark.createDataFrame([(88.0, 180.0), (-80.0, 10.0)], "lat double, lon double")
    got = {r.fix_id: (r.site_lat, r.dist) for r in enrich.nearest_site(pts, sites).collect()}
    assert got[1] == (88.0, pytest.approx(math.radians(3))) and got[2][0] == -80.0


def test_folds_are_balanced_and_layout_does_not_matter(spark):
    df = spark.range(103).withColumn("k", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    n = {(r.k, r.fold): r["count"] for r in prune.folds(df, 5, "k").groupBy("k", "fold").count().collect()}
    for k in "ab":
        sizes = [v for (c, _), v in n.items() if c == k]
        assert max(sizes) - min(sizes) <= 1
    a, b = (sorted(map(tuple, prune.folds(df.repartition(p), 5, "k").collect())) for p in (1, 7))
    assert a == b


def test_confusion_rows_sum_to_one_and_intervals_hold_the_mean(spark):
    r = report.marked(spark.createDataFrame([(i, "ab"[i % 2], "ab"[(i * i % 3) % 2], 1) for i in range(60)], "id long, species string, predicted string, random_state int"))
    sums = report.confusion(r).groupBy("real").agg(F.sum("share").alias("s")).collect()
    assert all(x.s == pytest.approx(1.0) for x in sums)
    means = {x.species: x.m for x in r.groupBy("species").agg(F.avg("ok").alias("m")).collect()}
    for f in (stats.percentile_interval, stats.bca_interval):
        assert all(x.low <= means[x.species] <= x.high for x in f(r, "species", "ok").collect())


def test_probabilities():
    assert stats.t_test_p(0.0, 10) == pytest.approx(1.0)
    assert stats.t_test_p(0.6319, 10) == pytest.approx(0.05, abs=1e-3)  # published critical value


def test_chi_square_tail(spark):
    assert spark.range(1).select(report.chi_square_tail(F.lit(3.841459))).first()[0] == pytest.approx(0.05, abs=1e-6)


def test_vif_elimination(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 200))
    df = spark.createDataFrame([(float(x), float(y), float(x + y / 1000)) for x, y in zip(a, b, strict=True)], "a double, b double, c double")
    assert len(stats.eliminate_by_vif(df, ["a", "b", "c"])) == 2 and "a" in stats.eliminate_by_vif(df, ["a", "b", "c"], keep=["a"])


def test_transfer_statistics_of_accuracies_that_do_not_vary(spark):
    rows = [("S1", n, a) for n in (10, 20, 30) for a in (0.8,) * 12] + [("S2", n, 0.01 * n + d) for n in (10, 20, 30) for d in (0.1, 0.3)] + [("S3", 10, 0.5), ("S4", 10, None)]
    df = spark.createDataFrame(rows, "species_downsampled string, n long, accuracy double").repartition(5)
    got = {r.species_downsampled: (r.corr, r.slope, r["diff"]) for r in report.transfer_statistics(report.mean_accuracy(df), ["species_downsampled"]).collect()}
    assert math.isnan(got["S1"][0]) and got["S1"][1:] == (0.0, 0.0)
    assert got["S2"] == pytest.approx((1.0, 0.01, 0.2))
    assert math.isnan(got["S3"][0]) and math.isnan(got["S3"][1]) and got["S3"][2] == 0.0 and got["S4"] == (None, None, None)


def test_empty_tables(spark):
    df = fixes(spark, [(1, "2020-01-01T00:00", 0, 0)]).filter("id < 0")
    for f in (motion.speed_stats, motion.common_origin, motion.extension, motion.best_year_run, prune.track_table, enrich.time_bin_average):
        assert f(df).count() == 0
    assert gridstats.shares(df, "stage").count() == 0


def test_readers_and_materialised_tables(spark, tmp_path):
    (tmp_path / "f.csv").write_text("LATITUDE, LONGITUDE, DATE_TIME, ID, Stage\n1.5, 2.5, 2020-03-01 12:00:00, x, breeding\n")
    r = io.read_fixes(spark, str(tmp_path / "f.csv")).first()
    assert (r.ID, r.day, r.year, r.Stage) == ("x", 60.5, 2020, "breeding")
    (tmp_path / "m.csv").write_text("ID,Species,Taxa,Class\nx,S,T,Aves\n")
    assert io.read_metadata(spark, str(tmp_path / "m.csv"), ", Class string").first().COMMON_NAME == "S"
    (tmp_path / "e.txt").write_text("-1 2 3\n4 5 -6\n")
    assert {(r.i, r.j): r.elevation for r in io.read_matrix(spark, str(tmp_path / "e.txt")).collect()}[1, 2] == -6.0
    calls = []

    def make(n):
        calls.append(n)
        return spark.range(n)

    for n in (3, 3, 4):
        assert io.materialize(make, str(tmp_path), "t", spark, n=n).count() == n
    assert calls == [3, 4]
    io.append_results(spark.range(2).withColumn("random_state", F.lit(1)), str(tmp_path / "r"))
    io.append_results(spark.range(3).withColumn("random_state", F.lit(2)), str(tmp_path / "r"))
    schema = "id long, random_state int"
    assert [io.read_reports(spark, str(tmp_path / "r"), schema, random_state=s).count() for s in (1, 2, 9)] == [2, 3, 0]
    io.write_base(fixes(spark, [(1, "2020-01-01T00:00", 0, 0)]), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).columns == ["id", "date_time", "latitude", "longitude"]
    wide = spark.createDataFrame([(0.5, 1.0, 9999.0)], ["lat", "0.5", "1.5"])
    assert [r.value for r in io.melt_grid(wide, "lat", ["0.5", "1.5"]).orderBy("cell_lon").collect()] == [1.0, None]


def test_stream_of_fixes(spark, tmp_path):
    df = fixes(spark, [(1, "2020-01-01T00:00", 0, 0), (1, "2020-01-02T00:00", 1, 1)])
    df.write.parquet(str(tmp_path / "in"))
    grid = spark.createDataFrame([(0, 0, 5.0)], "cell_lat long, cell_lon long, value double")
    s = stream_rows.enrich_stream(stream_rows.stream_fixes(spark, str(tmp_path / "in"), df.schema), grid)
    q = s.writeStream.format("memory").queryName("enriched").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.fix_id, r.value) for r in spark.table("enriched").collect()) == [(0, 5.0), (1, None)]
