"""Operators that spread one group over many tasks, against plain versions with their blocks made small."""

import hashlib
import itertools
import math
import statistics
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import distances, enrich, models, motion, order, prune, stats
from trackloom.sources import io


def test_quantiles_are_those_of_percentile(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g) if g < 3 else None, float(v) if v < 9 else None) for g, v in zip(rng.integers(0, 4, 400), rng.integers(0, 10, 400), strict=True)]
    rows += [(9, 1.5), (8, None), (7, float("nan")), (7, 1.0), (7, -0.5)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    levels = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    want = {r.g: (r.n, r.q) for r in df.groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", levels).alias("q")).collect() if r.n}
    got = {r.g: (r.n, r.quantiles) for r in order.quantiles(df, "v", levels, "g").collect()}
    assert str(got) == str({k: want[k] for k in got}) and set(got) == set(want)
    one = order.quantiles(df.filter("g is null or g < 5"), "v", levels).first()
    assert one.quantiles == df.filter("g is null or g < 5").agg(F.percentile("v", levels)).first()[0]
    assert tuple(order.quantiles(df.filter("g = 8"), "v", levels).first()) == (0, [])
    pairs = order.quantiles(df.select(F.struct("g", F.lit(1).alias("s")).alias("key"), "v"), "v", [0.5], "key").collect()
    assert {r.key.g: r.quantiles for r in pairs}.keys() == want.keys()


def fold(lat, lon, steps):
    """Dead reckoning in plain Python."""
    out, at = [], (math.radians(lat), math.radians(lon))
    for s, e in steps:
        out.append(tuple(map(math.degrees, at)))
        if s is None:
            continue
        n = math.hypot(s, e)
        k = math.sin(n) / n if n else 1.0
        up = math.cos(n) * math.cos(at[0]) + k * s * math.sin(at[0])
        x, y = up * math.cos(at[1]) - k * e * math.sin(at[1]), up * math.sin(at[1]) + k * e * math.cos(at[1])
        at = math.atan2(math.cos(n) * math.sin(at[0]) - k * s * math.cos(at[0]), math.hypot(x, y)), math.atan2(y, x)
    return out


@pytest.mark.parametrize("stretch", [1, 7, 1024])
def test_dead_reckoning_in_stretches(spark, monkeypatch, stretch):
    monkeypatch.setattr(motion, "STRETCH", stretch)
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for track, (n, wide) in enumerate([(1, 0.1), (5, 0.5), (40, 0.02), (40, 0.6), (40, 3.0), (15, 0.0)]):
        steps = [(float(s), float(e)) for s, e in rng.normal(0, wide, (n, 2))]
        steps = [(None, None) if k % 9 == 8 or k == n - 1 else s for k, s in enumerate(steps)]
        lat, lon = float(rng.uniform(-85, 85)), float(rng.uniform(-180, 180))
        rows += [(track, 1000 * track + k, f"2024-01-01 {k // 2:02d}:{30 * (k % 2):02d}:00", lat if k == 0 else 0.0, lon if k == 0 else 0.0, s, e) for k, (s, e) in enumerate(steps)]
        want |= {1000 * track + k: p for k, p in enumerate(fold(lat, lon, steps))}
    df = spark.createDataFrame(rows, "id long, fix_id long, date_time string, latitude double, longitude double, south double, east double").withColumn("date_time", F.to_timestamp("date_time")).repartition(3)
    got = {r.fix_id: (r.latitude, r.longitude) for r in motion.dead_reckon(df).collect()}
    assert got.keys() == want.keys()
    for k, (lat, lon) in want.items():
        assert abs(got[k][0] - lat) < 1e-8
        assert abs((got[k][1] - lon + 180) % 360 - 180) * math.cos(math.radians(lat)) < 1e-7
    assert motion.dead_reckon(df.filter("id < 0")).count() == 0


@pytest.mark.parametrize("listed", [1, 10**6])
@pytest.mark.parametrize("level", [0.5, 0.9])
def test_pooled_quantiles_and_stress_of_all_pairs(spark, monkeypatch, listed, level):
    monkeypatch.setattr(distances, "LISTED", listed)
    monkeypatch.setattr(enrich, "BLOCK", 20)
    rng = np.random.default_rng(2)
    rows = [(k, "abc"[k % 3] if k % 17 else None, [float(x) for x in np.round(rng.normal(size=3), 1)]) for k in range(90)] + [(200, "a", None), (201, "a", [1.0, None, 2.0]), (202, "d", [0.0, 0.0, 0.0]), (203, "d", [1.0])]
    df = spark.createDataFrame(rows, "id long, species string, embedding array<double>")
    pools, changes, squares = {}, 0.0, 0.0
    for (_, s, v), (_, t, w) in itertools.combinations([r for r in rows if r[2] and None not in r[2]], 2):
        if len(v) == len(w):
            d, e = math.dist(v, w), math.dist(v[:2], w[:2])
            changes, squares = changes + (d - e) ** 2, squares + d * d
            if s and t:
                pools.setdefault((min(s, t), max(s, t)), []).append(d)
    got = {(r.sp_i, r.sp_j): (r.n, r.d) for r in distances.pooled_quantile(df, level=level).collect()}
    assert got.keys() == pools.keys()
    for k, d in pools.items():
        assert got[k][0] == len(d) and math.isclose(got[k][1], np.quantile(d, level), rel_tol=1e-12, abs_tol=1e-12)
    assert math.isclose(distances.stress(df.withColumn("cut", F.slice("embedding", 1, 2)), "cut").first().stress, changes / squares, rel_tol=1e-9)
    assert distances.pooled_quantile(df.filter("id < 0")).collect() == [] and distances.stress(df.filter("id < 0"), "embedding").first().stress is None


def test_feature_tables_in_one_plan(spark):
    rng = np.random.default_rng(4)
    n = 300
    x = {"a": rng.normal(size=n), "c": rng.integers(0, 5, n).astype(float), "e": rng.normal(size=n)}
    x["b"] = x["a"] * 2 + 0.01 * rng.normal(size=n)
    hide = {k: rng.random(n) < 0.1 for k in x}
    rows = [tuple(None if hide[k][i] else float(x[k][i]) for k in "abce") + ("xyz"[int(x["c"][i]) % 3],) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double, e double, label string")

    def edges(v):
        return np.quantile(v, [k / 4 for k in range(1, 4)])

    def information(i, j):
        both = np.array(list(zip(i, j, strict=True)))
        out = 0.0
        for p in {tuple(r) for r in both.tolist()}:
            m = (both == p).all(1).mean()
            out += m * math.log2(m / ((both[:, 0] == p[0]).mean() * (both[:, 1] == p[1]).mean()))
        return out

    bins = lambda v: (v[:, None] > edges(v)[None, :]).sum(1)
    got = {(r.a, r.b): r.mi for r in stats.feature_redundancy(df, list("abce"), 4).collect()}
    far = {(r.real, r.pred): r.d for r in stats.predictive_distances(df, list("abce"), 4).collect()}
    for a, b in itertools.combinations("abce", 2):
        m = ~hide[a] & ~hide[b]
        u, v = x[a][m], x[b][m]
        assert math.isclose(got[a, b], information(bins(u), bins(v)), abs_tol=1e-9)
        left = [sum(((q[bins(p) == k] - q[bins(p) == k].mean()) ** 2).sum() for k in set(bins(p))) / ((q - q.mean()) ** 2).sum() for p, q in ((u, v), (v, u))]
        assert math.isclose(far[a, b], min(left), abs_tol=1e-9)
    assert len(got) == len(far) == 6
    info = {r.feature: r.mi for r in stats.feature_information(df, list("abce"), "label", 4).collect()}
    label = np.array([ord(r[4]) for r in rows])
    for a in "abce":
        assert math.isclose(info[a], information(bins(x[a][~hide[a]]), label[~hide[a]]), abs_tol=1e-9)
    assert {r.cluster for r in models.feature_clusters(df.withColumnRenamed("label", "species"), ["a", "b", "e"], 0.3, 4).collect()} == {"a"}


def test_feature_plan_does_not_grow_with_features(spark):
    wide = spark.range(50).selectExpr(*[f"double((id * {k + 3}) % 17) as f{k}" for k in range(24)])
    depth = lambda k: stats.feature_pairs(wide, [f"f{i}" for i in range(k)], 4)._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert depth(24) <= depth(4)
    assert stats.feature_redundancy(wide, wide.columns, 4).count() == 24 * 23 // 2


def nearest(rows, k):
    rows = [(i, v) for i, v in rows if v is not None and i is not None and None not in v]
    out = {}
    for n, (i, v) in enumerate(rows):
        far = sorted((math.dist(v, w), j) for m, (j, w) in enumerate(rows) if m != n and j != i and len(w) == len(v))
        out.setdefault(i, []).extend((j, d) for d, j in far[:k])
    return out


@pytest.mark.parametrize("block, pivots", [(7, 5), (25, 16), (512, 32)])
def test_nearest_rows_by_pivots(spark, block, pivots):
    rng = np.random.default_rng(block)
    flat = [(i, [float(x) for x in np.round(rng.normal(100 * (i % 6), 10, 2))]) for i in range(150)]  # whole numbers: ties are exact
    wide = [(200 + i, [float(x) for x in rng.normal(size=9)]) for i in range(40)]
    rows = [*flat, *wide, (900, None), (None, [1.0, 2.0]), (901, [1.0, None]), (902, [7.0]), (903, [])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)
    got = {}
    for r in distances.nearest_rows(df, 3, block=block, pivots=pivots).collect():
        got.setdefault(r.id, []).append((r.other, r.d))
    want = {i: v for i, v in nearest(rows, 3).items() if v}
    assert got.keys() == want.keys()
    for i, v in want.items():
        near = sorted(got[i], key=lambda p: (p[1], p[0]))
        assert [j for j, _ in near] == [j for j, _ in v] and np.allclose([d for _, d in near], [d for _, d in v])
    assert distances.nearest_rows(df.filter("id < 0"), 3).count() == 0


@pytest.mark.parametrize("block", [6, 512])
def test_close_rows_and_closest_series(spark, block):
    rng = np.random.default_rng(block)
    rows = [(i, [float(x) for x in np.round(rng.normal(30 * (i % 4), 10, 3))]) for i in range(120)] + [(900, None), (None, [1.0, 2.0, 3.0]), (902, [7.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    whole = [r for r in rows if r[0] is not None and r[1]]
    want = {(i, j): math.dist(v, w) for (i, v), (j, w) in itertools.combinations(whole, 2) if len(v) == len(w) and sum((a - b) ** 2 for a, b in zip(v, w, strict=True)) <= 225}
    got = {(r.i, r.j): r.d for r in distances.close_rows(df, 15.0, block=block, pivots=4).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], d) for k, d in want.items())
    patterns = df.filter("id < 20").select("id", F.slice("embedding", 1, 2).alias("v"))
    series = df.select("id", F.col("embedding").alias("v"))
    best = {}
    for r in sorted(enrich.shapelet_distances(patterns, series).collect(), key=lambda r: (r.pid, r.d, r.id)):
        best.setdefault(r.pid, []).append((r.id, r.d))
    got = {}
    for r in sorted(enrich.shapelet_distances(patterns, series, k=4).collect(), key=lambda r: (r.pid, r.d, r.id)):
        got.setdefault(r.pid, []).append((r.id, r.d))
    assert got == {p: v[:4] for p, v in best.items()}


def test_pairs_of_blocks_are_neither_sent_nor_written(spark, monkeypatch):
    monkeypatch.setattr(enrich, "BLOCK", 20)
    monkeypatch.setattr(enrich, "GROUP", 2)
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(150)], "id long, embedding array<double>")
    s = df.select("id", F.col("embedding").alias("v"))
    plan = lambda found: found._jdf.queryExecution().sparkPlan().toString()
    for found in (enrich.distance_matrix(df), distances.close_rows(df, 1.0, block=20), enrich.shapelet_distances(s, s)):
        whole = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in whole and "Exchange" not in whole
    for found in (distances.stress(df, "embedding"), distances.nearest_rows(df, 2, block=20), enrich.shapelet_distances(s, s, k=2)):
        assert plan(found).count("MapInArrow") == 1 and "CartesianProduct" in plan(found)
    assert enrich.distance_matrix(df).count() == enrich.distance_matrix(df).select("i", "j").distinct().count() == 150 * 149 // 2
    # Far from the origin squares lose all digits of a distance.
    far = df.withColumn("embedding", F.transform("embedding", lambda x: x + 1e6))
    near = lambda df: {(r.pid, r.id): r.d for r in enrich.shapelet_distances(df.select("id", F.slice("embedding", 1, 2).alias("v")), df.select("id", F.col("embedding").alias("v"))).collect()}
    want, got = near(df), near(far)
    assert got.keys() == want.keys() and all(abs(got[p] - d) < 1e-6 for p, d in want.items())
    best = {(r.pid, r.id) for r in enrich.shapelet_distances(far.select("id", F.slice("embedding", 1, 2).alias("v")), far.select("id", F.col("embedding").alias("v")), k=1).collect()}
    assert best == {(i, i) for i in range(150)}


def test_pooled_means_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(enrich, "BLOCK", 20)
    monkeypatch.setattr(enrich, "HELD", 4)
    rng = np.random.default_rng(2)
    rows = [(k, "abc"[k % 3] if k % 17 else None, [float(x) for x in np.round(rng.normal(size=3), 1)]) for k in range(90)] + [(200, "a", None), (201, "a", [1.0, None, 2.0]), (202, "d", [0.0, 0.0, 0.0]), (203, "d", [1.0])]
    df = spark.createDataFrame(rows, "id long, species string, embedding array<double>")
    pools = {}
    for (_, s, v), (_, t, w) in itertools.combinations([r for r in rows if r[1] and r[2] and None not in r[2]], 2):
        if len(v) == len(w):
            pools.setdefault((min(s, t), max(s, t)), []).append(math.dist(v, w))
    got = {(r.sp_i, r.sp_j): (r.n, r.d) for r in distances.pooled_mean(df).collect()}
    assert got.keys() == pools.keys() and all(got[p][0] == len(d) and math.isclose(got[p][1], statistics.fmean(d), rel_tol=1e-9) for p, d in pools.items())
    assert distances.pooled_mean(df.filter("id < 0")).collect() == []


def test_pivots_leave_most_pairs_of_blocks_out_where_rows_lie_in_clusters(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(50 * (i % 40), 1, 2)]) for i in range(4000)]
    blocks = distances.metric_blocks(spark.createDataFrame(rows, "id long, embedding array<double>"), block=50, k=5)
    n = blocks.count()
    assert distances.block_pairs(blocks).count() < 0.2 * n * (n - 1) / 2


def test_close_pairs_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "ABCé"[i % 4], float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180)), float(rng.uniform(0, 10))) for i in range(150)]
    rows += [(500 + i, "AB"[i % 2], 10.0 + 0.001 * (i % 7), 179.99 + 0.001 * (i % 5), 5.0) for i in range(60)]  # a colony in one cube
    rows += [(900, None, 1.0, 1.0, 5.0), (901, "A", None, 1.0, 5.0), (902, "A", 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "fix_id long, species string, latitude double, longitude double, env double").repartition(3)
    want = {}
    for (a, s, la, lo, e), (b, t, lb, lp, f) in itertools.permutations([r for r in rows if None not in r and r[4] > 1], 2):
        h = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(lp - lo) / 2) ** 2
        d = 2 * math.asin(min(1.0, math.sqrt(h)))
        if s < t and d < 0.3 and min(e, f) / max(e, f) > 0.2:
            want[a, b] = d
    for crowd in (8, 1024):
        got = {(r.a, r.b): r.dist for r in enrich.close_pairs(df, 0.3, 0.2, 1.0, crowd=crowd).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], d, abs_tol=1e-12) for k, d in want.items())
    assert enrich.close_pairs(df.filter("fix_id < 0")).count() == 0


def test_blocks_of_close_fixes_are_neither_sent_nor_written(spark):
    df = spark.range(300).selectExpr("id AS fix_id", "concat('S', id % 3) AS species", "CAST(id % 50 AS double) AS latitude", "CAST(id % 40 AS double) AS longitude", "5.0D AS env")
    plan = enrich.close_pairs(df, crowd=8)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


@pytest.mark.parametrize("leaf", [1, 16])
def test_far_points_find_their_site_down_the_tree(spark, monkeypatch, leaf):
    monkeypatch.setattr(enrich, "LEAF", leaf)
    rng = np.random.default_rng(leaf)
    sites = [(float(a), float(b)) for a, b in zip(rng.normal(40, 5, 200), rng.normal(20, 5, 200), strict=True)] + [(-80.0, 0.0), (-80.0, 120.0), (-80.0, 120.0)]
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, 120), rng.uniform(-180, 180, 120), strict=True))] + [(500, -90.0, 0.0), (501, None, 3.0)]
    df = spark.createDataFrame(points, "fix_id long, latitude double, longitude double")
    place = spark.createDataFrame(sites, "lat double, lon double")
    for found in (enrich.nearest_site(df, place), enrich._descend(df.dropna(), place.distinct().toDF("site_lat", "site_lon"), leaf=leaf)):
        got = {r.fix_id: (r.dist, r.site_lat, r.site_lon) for r in found.collect()}
        assert len(got) == len(points) - 1
        for i, la, lo in points:
            if la is not None:
                d = enrich._haversine(*np.radians([[la], [lo]]), *np.radians(np.array(sites)).T)[0]
                assert math.isclose(got[i][0], d.min(), abs_tol=1e-7)
    assert enrich.nearest_site(df, place.limit(0)).count() == 0 and enrich.nearest_site(df.limit(0), place).count() == 0


def test_stored_tracks_need_no_exchange(spark):
    rows = [(i % 30, i, f"2024-01-{1 + i % 28:02d} 00:00:00", float(i % 80), float(i % 170)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, fix_id long, date_time string, latitude double, longitude double").withColumn("date_time", F.to_timestamp("date_time"))
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    first = io.store_tracks(df.filter("fix_id < 400"), "stored_tracks", f"{root}/t", buckets=4)
    stored = io.append_tracks(df.filter("fix_id >= 400"), "stored_tracks")
    assert first.columns == stored.columns and stored.count() == 600
    by_track = motion.steps(stored).groupBy("id").agg(F.sum("dist").alias("d"))
    assert "Exchange" not in by_track._jdf.queryExecution().executedPlan().toString()
    want = {r.id: r.d for r in motion.steps(df).groupBy("id").agg(F.sum("dist").alias("d")).collect()}
    assert {r.id: r.d for r in by_track.collect()} == pytest.approx(want)
    assert io.store_tracks(df, "more_tracks", f"{root}/u").count() == 600


def counts(row, replicates):
    """Poisson counts of a named row in plain Python."""
    x = int(hashlib.md5(row.encode()).hexdigest()[:8], 16) % stats.PRIME
    return [sum(x * stats.replicate_factor(r) % stats.PRIME >= t for t in stats.poisson_limits()) for r in range(replicates)]


def test_bootstraps_are_sums_over_counts(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "abc"[i % 3] if i else "lone", float(v)) for i, v in enumerate(np.round(rng.normal(5, 2, 200), 1))] + [(900, "a", None)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(6)
    replicates = 60
    weight = {i: counts(f"{g}-{i}", replicates) for i, g, _ in rows}
    means = {(r.g, r.rep): r["mean"] for r in stats.resampled_means(df, "g", "v", replicates).collect()}
    medians = {(r.g, r.rep): r.median for r in stats.resampled_medians(df, "g", "v", replicates).collect()}
    want_means, want_medians = {}, {}
    for g in ("a", "b", "c", "lone"):
        for r in range(replicates):
            drawn = [v for i, h, v in rows if h == g and v is not None for _ in range(weight[i][r])]
            if drawn:
                want_means[g, r], want_medians[g, r] = statistics.fmean(drawn), statistics.median(drawn)
    assert means == pytest.approx(want_means) and medians == pytest.approx(want_medians)
    # Counts are Poisson(1): their mean and variance are 1, and replicates and rows are as good as independent.
    c = np.array([counts(f"g-{i}", 200) for i in range(2000)])
    assert abs(c.mean() - 1) < 0.01 and abs(c.var() - 1) < 0.02
    assert np.abs(np.corrcoef(c.T) - np.eye(200)).max() < 0.15 and abs(np.corrcoef(c)[np.triu_indices(2000, 1)].mean()) < 0.005


def test_intervals_cover_and_bca_follows_its_definition(spark):
    normal = statistics.NormalDist()
    p = [1e-9, 1e-4, 0.01, 0.3, 0.5, 0.77, 0.999, 1 - 1e-9]
    for q, r in zip(p, spark.createDataFrame([(x,) for x in p], "p double").select(stats.normal_quantile(F.col("p")).alias("z")).collect(), strict=True):
        assert math.isclose(r.z, normal.inv_cdf(q), rel_tol=1e-8, abs_tol=1e-8)
    x = [-6.0, -2.0, -0.1, 0.0, 1.5, 5.0]
    for v, r in zip(x, spark.createDataFrame([(v,) for v in x], "x double").select(stats.normal_cdf(F.col("x")).alias("p")).collect(), strict=True):
        assert math.isclose(r.p, normal.cdf(v), rel_tol=2e-7)
    rng = np.random.default_rng(3)
    rows = [(g * 100 + i, g, float(v)) for g in range(60) for i, v in enumerate(rng.exponential(1, 40))]
    df = spark.createDataFrame(rows, "id long, g long, v double")
    plain = {r.g: (r.low, r.high) for r in stats.percentile_interval(df, "g", "v").collect()}
    bca = {r.g: (r.low, r.high) for r in stats.bca_interval(df, "g", "v").collect()}
    assert len(plain) == len(bca) == 60
    assert sum(low <= 1 <= high for low, high in plain.values()) >= 48 and sum(low <= 1 <= high for low, high in bca.values()) >= 48
    # Of a skewed sample the corrected interval lies further to the right.
    assert np.mean([bca[g][1] - plain[g][1] for g in plain]) > 0


def test_report_predicates(spark):
    df = spark.createDataFrame([(1, "A", "Wrong"), (1, "A", "Wrong"), (2, "B", "Correct"), (3, None, "Wrong"), (4, "C", None)], "id long, species string, prediction string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(prune.reported(df, "prediction = 'Wrong'")) == [1, 3]
    assert ids(prune.reported(df, F.col("prediction") == "Wrong", ("A", "C"))) == [1]
    assert ids(prune.reported(df, "true", df.filter("id in (2, 4)").select(F.col("species").alias("s")))) == [2, 4]
    assert ids(prune.reported(df, "true", ())) == []
