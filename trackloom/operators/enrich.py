"""Environment of fixes: lookups in grids, nearest sites, as-of matches, merges and imputation."""

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, times
from ..store import checkpoint

#: A table goes out by broadcast if it has at most so many bytes, by its rows and the usual width of its columns; larger ones are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def sized(df: DataFrame, most_bytes=BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if the table is small enough; a table with arrays, maps or structs is measured as strings."""
    plain = [f.dataType.typeName() not in ("array", "map", "struct", "variant", "string", "binary") for f in df.schema.fields]
    wide = [F.octet_length(F.col(f"`{f.name}`").cast("string")) + 16 for f, p in zip(df.schema.fields, plain, strict=True) if not p]
    fixed = 16 + 8 * sum(plain)
    if not wide:
        most = most_bytes // fixed
        return F.broadcast(df) if df.limit(most + 1).count() <= most else df
    # No more rows are measured than would be too many anyway.
    size = df.limit(most_bytes // (fixed + 16) + 1).agg(F.count(F.lit(1)) * fixed + F.coalesce(F.sum(sum((F.coalesce(w, F.lit(16)) for w in wide), F.lit(0))), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most_bytes else df


def with_metadata(fixes, animals, strict=True):
    """Fixes with their animal's metadata; each animal must be known and unique if ``strict``."""
    if strict:
        if animals.groupBy("id").count().filter("count > 1").limit(1).count():
            raise ValueError("an id has several metadata rows")
        if fixes.select("id").distinct().join(animals, "id", "left_anti").limit(1).count():
            raise ValueError("an id has no metadata")
    return fixes.join(sized(animals), "id")


def add_columns(left, right, on="id"):
    """Columns of another table by key; rows without a match keep nulls."""
    return left.join(right, on, "left")


def species_of(df, animals):
    return df.join(sized(animals.select("id", "species")), "id", "left")


def taxa_of(df, animals, species="species"):
    pairs = animals.select(F.col("species").alias(species), "taxa").distinct()
    return df.join(sized(pairs), species, "left")


def species_by_taxa(animals):
    return animals.groupBy("taxa").agg(F.sort_array(F.collect_set("species")).alias("species"))


def grid_lookup(fixes, grid, cell="half_even", name="value"):
    """Grid value of each fix: cells by rounding halves to even, or by their lower edge (180 joins the last cell)."""
    la, lo = (geo.half_even_cell("latitude"), geo.half_even_cell("longitude")) if cell == "half_even" else (geo.floor_cell("latitude"), geo.floor_cell("longitude", 179))
    df = fixes.withColumns({"cell_lat": la, "cell_lon": lo})
    return df.join(sized(grid.select("cell_lat", "cell_lon", F.col("value").alias(name))), ["cell_lat", "cell_lon"], "left").drop("cell_lat", "cell_lon")


def complete_grid(grid):
    """Every 1 degree cell, missing ones null, with both sides of the seam at 180 merged (mean, or the known one)."""
    spark = grid.sparkSession
    lat = spark.range(-90, 91).withColumnRenamed("id", "cell_lat")
    lon = spark.range(-180, 181).withColumnRenamed("id", "cell_lon")
    full = lat.crossJoin(lon).join(grid, ["cell_lat", "cell_lon"], "left")  # 181 x 361 cells, fixed
    seam = full.filter("abs(cell_lon) = 180").groupBy("cell_lat").agg(F.avg("value").alias("_seam"))
    return full.join(seam, "cell_lat").withColumn("value", F.when(F.abs("cell_lon") == 180, F.col("_seam")).otherwise(F.col("value"))).drop("_seam")


def depth(fixes, elevation, width=0.25, log=False, padding=None):
    """Elevation of the nearest cell centre, land as 0; or log10(depth + 1), land as -1 and padding rows as 0.

    ``elevation``: ``i`` (rows from +90 down), ``j`` (columns from -180), ``elevation`` (above 0: land).
    """
    df = fixes.withColumns({"i": geo.centred_cell("latitude", 90, width, down=True), "j": geo.centred_cell("longitude", -180, width)})
    df = df.join(sized(elevation), ["i", "j"], "left").drop("i", "j")
    e = F.col("elevation")
    if not log:
        return df.withColumn("elevation", F.when(e > 0, 0.0).otherwise(e))
    value = F.when(e > 0, -1.0).otherwise(F.log10(1 - e))
    return df.withColumn("elevation", value if padding is None else F.when(padding, 0.0).otherwise(value))


def nearest_l1(points, sites, radius=1.5, keys=(), block=1.0):
    """Nearest site with a value within an L1 distance in degrees: points with ``site_lat, site_lon, value, gap``, null without one.

    ``sites``: ``lat, lon, value`` and ``keys``. Sites, the smaller side, are copied to the blocks in reach; points are not.
    Ties go to the smaller (lat, lon).
    """
    reach = int(-(-radius // block))
    sites = sites.filter("value is not null").select(*keys, F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon"), "value")
    around = lambda c: F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: F.floor(F.col(c) / block) + k))
    sites = sites.withColumn("_bi", around("site_lat")).withColumn("_bj", around("site_lon"))
    pts = points.withColumns({"_bi": F.floor(F.col("latitude") / block), "_bj": F.floor(F.col("longitude") / block)})
    gap = F.abs(F.col("latitude") - F.col("site_lat")) + F.abs(F.col("longitude") - F.col("site_lon"))
    met = pts.join(sites, [*keys, "_bi", "_bj"]).withColumn("gap", gap).filter(F.col("gap") < radius)
    best = met.groupBy("fix_id").agg(F.min(F.struct("gap", "site_lat", "site_lon", "value")).alias("_b")).select("fix_id", "_b.*")
    return points.join(best, "fix_id", "left")


def _cells(lat, lon, width):
    return [F.floor(v / F.lit(width)) for v in geo.unit_vector(lat, lon)]


def _near(points, sites, chord):
    """Point-site pairs in neighbouring cubes of the given width: all pairs up to that chord are among them."""
    spread = sites
    for name, c in zip(("_cx", "_cy", "_cz"), _cells("site_lat", "site_lon", chord), strict=True):
        spread = spread.withColumn(name, F.explode(F.array(*[c + k for k in (-1, 0, 1)])))
    pts = points.withColumns(dict(zip(("_cx", "_cy", "_cz"), _cells("latitude", "longitude", chord), strict=True)))
    return pts.join(spread, ["_cx", "_cy", "_cz"]).drop("_cx", "_cy", "_cz")


#: Width of the coarsest cubes of the tree of sites; each level's cubes are a quarter as wide. Rounds with cubes of up to ``CLOSE`` come first.
ROOT, CLOSE = 0.5, 0.2
#: Sites in a leaf cube, unless the tree is ``DEEP`` levels deep.
LEAF, DEEP = 16, 7


def _bounds(point, cube, width):
    """Least and greatest chord from a point to a cube: structs or names of three columns."""
    low, high = F.lit(0.0), F.lit(0.0)
    for p, c in zip(point, cube, strict=True):
        a, b = c * F.lit(width) - p, p - (c + 1) * F.lit(width)
        low, high = low + F.pow(F.greatest(a, b, F.lit(0.0)), 2), high + F.pow(F.greatest(F.abs(a), F.abs(b)), 2)
    return F.sqrt(low), F.sqrt(high)


def _descend(points, sites, root=ROOT, leaf=LEAF, deep=DEEP):
    """``fix_id, dist, site_lat, site_lon``: each point's nearest site through a tree of cubes.

    The point carries the cubes that may hold its nearest site from level to level: those whose least distance is not beyond the smallest of
    the greatest distances. The cubes of the first level are at most a few hundred, in one row; the children of a cube are found by a join.
    """
    xyz, up = ("x", "y", "z"), ("px", "py", "pz")
    place = lambda lat, lon: [c.alias(n) for n, c in zip(("ux", "uy", "uz"), geo.unit_vector(lat, lon), strict=True)]
    pts = points.select("fix_id", "latitude", "longitude", *place("latitude", "longitude"))
    u = [F.col(c) for c in ("ux", "uy", "uz")]
    width, levels = root, []
    placed = checkpoint(sites.select("site_lat", "site_lon", *place("site_lat", "site_lon")))
    cells = lambda w: [F.floor(c / F.lit(w)).alias(n) for c, n in zip(u, xyz, strict=True)]
    while True:
        tree = placed.groupBy(*cells(width)).agg(F.count(F.lit(1)).alias("n"))
        levels.append((width, checkpoint(tree.select(*xyz, *[F.floor(F.col(c) / 4).alias(p) for c, p in zip(xyz, up, strict=True)], "n"))))
        if len(levels) == deep or not levels[-1][1].filter(F.col("n") > leaf).limit(1).count():
            break
        width /= 4
    # Rounding must not lose a site on a bound, nor one that ties.
    slack = 1 + 1e-9
    top = levels[0][1].agg(F.collect_list(F.struct(*xyz)).alias("cubes"))  # (4 / root) ** 3 cubes at most
    met = pts.crossJoin(F.broadcast(top))  # one row
    limit = F.array_min(F.transform("cubes", lambda c: _bounds(u, [c[n] for n in xyz], root)[1]))
    near = met.withColumn("_u", limit).withColumn("cubes", F.filter("cubes", lambda c: _bounds(u, [c[n] for n in xyz], root)[0] <= F.col("_u") * slack))
    near = near.select("fix_id", "latitude", "longitude", *("ux", "uy", "uz"), F.inline("cubes"))
    mine = Window.partitionBy("fix_id")
    for width, tree in levels[1:]:
        near = near.select("fix_id", "latitude", "longitude", *("ux", "uy", "uz"), *[F.col(c).alias(p) for c, p in zip(xyz, up, strict=True)]).join(sized(tree.drop("n")), list(up)).drop(*up)
        low, high = _bounds(u, [F.col(c) for c in xyz], width)
        near = near.withColumns({"_low": low, "_u": F.min(high).over(mine)}).filter(F.col("_low") <= F.col("_u") * slack).drop("_low", "_u")
        near = checkpoint(near)
    found = placed.select("site_lat", "site_lon", *cells(levels[-1][0]))
    met = near.drop("ux", "uy", "uz").join(found, list(xyz)).withColumn("dist", geo.great_circle("latitude", "longitude", F.col("site_lat"), F.col("site_lon")))
    return met.groupBy("fix_id").agg(F.min(F.struct("dist", "site_lat", "site_lon")).alias("_b")).select("fix_id", "_b.*")


def nearest_site(points, sites, chord=0.05):
    """``fix_id, dist, site_lat, site_lon``: the nearest site by great circle, whatever its distance; ties to the smaller (lat, lon).

    Points and sites meet in cubes of space, so poles and the antimeridian need no care. Points that meet none within the cube's width
    try again with one four times as wide; each round is a checkpoint, so none is computed again by the next. What is far from every
    site (beyond ``CLOSE``) goes down a tree of the sites' cubes instead (:func:`_descend`), so no point is compared with all sites.
    """
    sites = checkpoint(sites.select(F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon")).dropna().distinct())
    left, found = checkpoint(points.select("fix_id", "latitude", "longitude")), None
    d = geo.great_circle("latitude", "longitude", F.col("site_lat"), F.col("site_lon"))
    while chord <= CLOSE:
        met = _near(left, sites, chord).withColumn("dist", d).filter(2 * F.sin(F.col("dist") / 2) <= chord)
        best = checkpoint(met.groupBy("fix_id").agg(F.min(F.struct("dist", "site_lat", "site_lon")).alias("_b")).select("fix_id", "_b.*"))
        found = best if found is None else found.unionAll(best)
        left = checkpoint(left.join(best, "fix_id", "left_anti"))
        if left.isEmpty():
            return found
        chord *= 4
    best = _descend(left.dropna(), sites)
    return best if found is None else found.unionAll(best)


def nearest_level(df, levels, column="depth"):
    """Nearest level of a small table of them, the smaller on a tie."""
    levels = levels.agg(F.sort_array(F.collect_set("level")).alias("_levels"))  # one row
    nearest = F.array_min(F.transform("_levels", lambda v: F.struct(F.abs(v - F.col(column)).alias("g"), v.alias("v"))))
    return df.crossJoin(F.broadcast(levels)).withColumn("level", nearest["v"]).drop("_levels")


def depth_columns(df, keys, name, value, names):
    """Values by depth name as columns."""
    return df.groupBy(*keys).pivot(name, names).agg(F.first(value, True))


def valid_time(df, run="run_time", step="step"):
    """Time that a forecast step is valid for."""
    return df.withColumn("valid_time", F.col(run) + F.make_dt_interval(hours=F.col(step)))


def as_of_nearest(points, series, most_hours=0.5, step=1.0):
    """Nearest value in time within ``most_hours`` at the nearest cell of a grid of the given step.

    ``series``: ``ts, cell_lat, cell_lon, value``. Each value is copied to the hour buckets in reach;
    ties go to the earlier one.
    """
    us = int(most_hours * 3_600_000_000)
    hour = 3_600_000_000
    series = series.select("cell_lat", "cell_lon", times.micros("ts").alias("_t"), F.col("value").alias("matched"))
    series = series.withColumn("_h", F.explode(F.sequence(F.floor((F.col("_t") - us) / hour), F.floor((F.col("_t") + us) / hour))))
    cell = lambda c: F.bround(F.col(c) / step, 0).cast("long")
    pts = points.withColumns({"cell_lat": cell("latitude"), "cell_lon": cell("longitude"), "_p": times.micros("date_time")}).withColumn("_h", F.floor(F.col("_p") / hour))
    met = pts.join(series, ["cell_lat", "cell_lon", "_h"]).withColumn("gap", F.abs(F.col("_p") - F.col("_t"))).filter(F.col("gap") <= us)
    best = met.groupBy("fix_id").agg(F.min(F.struct("gap", "_t", "matched")).alias("_b")).select("fix_id", "_b.matched")
    return points.join(best, "fix_id", "left")


def match_occurrences(left, right, keys=("date_time", "latitude", "longitude"), order_left="fix_id", order_right="row_id", rounded=False):
    """Pairs of equal rows: the k-th one of a key on the left meets the k-th one on the right.

    ``rounded`` compares times by the second and coordinates to 9 decimals.
    """

    def prepared(df, order):
        if rounded:
            df = df.withColumns({"_k0": times.to_second(keys[0]), "_k1": F.round(keys[1], 9), "_k2": F.round(keys[2], 9)})
        else:
            df = df.withColumns({f"_k{i}": F.col(k) for i, k in enumerate(keys)})
        return df.withColumn("_n", F.row_number().over(Window.partitionBy("_k0", "_k1", "_k2").orderBy(order)))

    by = ["_k0", "_k1", "_k2", "_n"]
    return prepared(left, order_left).join(prepared(right, order_right).drop(*keys), by).drop(*by)


def merge_covariates(base, *tables, on="fix_id"):
    """Tables side by side by key; columns that came before are not repeated. Raises if a table lacks rows of the base."""
    for t in tables:
        if base.join(t, on, "left_anti").limit(1).count():
            raise ValueError("a table lacks rows of the base")
        base = base.join(t.select(on, *[c for c in t.columns if c not in base.columns]), on)
    return base


def cell_means(df, columns, width=0.25):
    return df.groupBy(geo.cell("latitude", width).alias("cell_lat"), geo.cell("longitude", width).alias("cell_lon")).agg(*[F.avg(c).alias(c) for c in columns])


def impute_nearest(df, column, width=0.25):
    """Nulls become their cell's mean, or the mean of the nearest cell (L1) that has one; ties to the smaller (lat, lon)."""
    means = checkpoint(cell_means(df, [column], width))
    known = means.filter(F.col(column).isNotNull()).select((F.col("cell_lat") * width).alias("lat"), (F.col("cell_lon") * width).alias("lon"), F.col(column).alias("value"))
    empty = means.filter(F.col(column).isNull()).select(F.struct("cell_lat", "cell_lon").alias("fix_id"), (F.col("cell_lat") * width).alias("latitude"), (F.col("cell_lon") * width).alias("longitude"))
    filled, radius = None, 4 * width
    while True:
        got = checkpoint(nearest_l1(empty, known, radius, block=radius).select(*empty.columns, "value"))
        done = got.filter("value is not null").select("fix_id", "value")
        filled = done if filled is None else filled.unionAll(done)
        empty = got.filter("value is null").drop("value")
        if radius > 540 or empty.isEmpty():
            break
        radius *= 8
    cells = means.filter(F.col(column).isNotNull()).select("cell_lat", "cell_lon", F.col(column).alias("_fill")).unionAll(filled.select("fix_id.cell_lat", "fix_id.cell_lon", "value"))
    df = df.withColumns({"cell_lat": geo.cell("latitude", width), "cell_lon": geo.cell("longitude", width)}).join(cells, ["cell_lat", "cell_lon"], "left")
    return df.withColumn(column, F.coalesce(column, "_fill")).drop("cell_lat", "cell_lon", "_fill")


#: Fixes in a block of a cube.
CROWD = 1024


def _haversine(lat1, lon1, lat2, lon2):
    """Central angles of all pairs of two arrays of places in radians."""
    h = np.sin((lat2[None, :] - lat1[:, None]) / 2) ** 2 + np.cos(lat1)[:, None] * np.cos(lat2)[None, :] * np.sin((lon2[None, :] - lon1[:, None]) / 2) ** 2
    return 2 * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def close_pairs(df, most=0.35, least_ratio=0.1, least_effort=0.0, crowd=CROWD):
    """Pairs of fixes of different species within a great circle distance, alike in effort and busy: ``a, b, dist, ratio``; ``a`` is of the smaller species.

    Fixes lie in cubes of space as wide as the distance. A cube's fixes are dealt out to blocks of about ``crowd``, and two
    blocks of the same or of neighbouring cubes meet once, where a task reads them both: fixes are not sent to the cubes around,
    and a colony that fills one cube is the work of many tasks. All close pairs are the result, which grows with the square of the fixes in a cube.
    Rows with a null in position, species or effort have no pairs.
    """
    pts = df.select(F.col("fix_id").cast("long").alias("k"), F.col("species").cast("string").alias("s"), F.radians("latitude").alias("la"), F.radians("longitude").alias("lo"), F.col("env").cast("double").alias("e"), *[c.cast("long").alias(n) for n, c in zip("xyz", _cells("latitude", "longitude", most), strict=True)])
    pts = pts.dropna().filter(F.col("e") > least_effort)
    counts = pts.groupBy(*"xyz").agg(F.ceil(F.count(F.lit(1)) / crowd).cast("int").alias("n"))
    counts = checkpoint(counts)
    pts = pts.join(sized(counts), [*"xyz"]).withColumn("block", F.pmod(F.xxhash64("k"), F.col("n")).cast("int"))
    blocks = pts.groupBy(*"xyz", "block").agg(F.collect_list(F.struct("k", "s", "la", "lo", "e")).alias("rows"))  # about ``crowd``
    blocks = _dealt(blocks.withColumn("number", F.monotonically_increasing_id()))
    left, right = (blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in (*"xyz", "number")], F.col("rows").alias(n)) for s, n in (("a", "_left"), ("b", "_right")))
    a, b = F.col("number_a"), F.col("number_b")
    near = _once(a, b)
    for n in "xyz":
        near = near & (F.abs(F.col(f"{n}_a") - F.col(f"{n}_b")) <= 1)

    def fields(rows):
        return [f.to_pylist() if i == 1 else f.to_numpy(zero_copy_only=False) for i, f in enumerate(rows.values.field(i) for i in range(5))]

    def pairs(ka, sa, la, loa, ea, kb, sb, lb, lob, eb, same):
        # Species as numbers that order as they do.
        code = np.unique(np.array([*sa, *sb], dtype=object).astype(str), return_inverse=True)[1]
        sa, sb = code[: len(ka)], code[len(ka) :]
        d = _haversine(la, loa, lb, lob)
        ratio = np.minimum(ea[:, None], eb[None, :]) / np.maximum(ea[:, None], eb[None, :])
        i, j = np.nonzero((d < most) & (ratio > least_ratio) & ((sa[:, None] < sb[None, :]) if same else (sa[:, None] != sb[None, :])))
        turned = sa[i] > sb[j]
        yield np.where(turned, kb[j], ka[i]), np.where(turned, ka[i], kb[j]), d[i, j], ratio[i, j]

    return _block_pairs(left, right, near, pairs, "a long, b long, dist double, ratio double", same=a == b, parts=fields)


def time_bin_average(fixes, rate=3.0, columns=("env",)):
    """Means of each (id, year, right-closed bin of 1/rate days); longitude is the median where signs mix, the stage the commonest one."""
    day = times.day_of_year("date_time")
    df = fixes.withColumns({"year": F.year("date_time"), "bin": F.ceil(day * rate).cast("long")}).filter("bin > 0")
    mixed = (F.max("longitude") > 0) & (F.min("longitude") < 0)
    lon = F.when(mixed, F.percentile("longitude", 0.5)).otherwise(F.avg("longitude"))
    return df.groupBy("id", "year", "bin").agg(F.avg("latitude").alias("latitude"), lon.alias("longitude"), F.mode("stage", True).alias("stage"), *[F.avg(c).alias(c) for c in columns]).withColumn("t", (F.col("bin") - 0.5) / rate)


# Overlap of tracks.


def occurrences(fixes, width=1.0):
    """Tracks of each species in each cell; a track counts once in a cell."""
    cells = fixes.select("id", "species", "taxa", geo.cell("latitude", width).alias("i"), geo.cell("longitude", width).alias("j")).distinct()
    return cells.groupBy("i", "j", "species", "taxa").agg(F.count(F.lit(1)).alias("n"))


def overlap(fixes, width=1.0, reduce=F.avg):
    """Other tracks that share a track's cells: of its species, of others, of others of its taxa; reduced over its cells."""
    counts = occurrences(fixes, width)
    total, taxa = Window.partitionBy("i", "j"), Window.partitionBy("i", "j", "taxa")
    counts = counts.withColumns({"same": F.col("n") - 1, "other": F.sum("n").over(total) - F.col("n"), "taxa_other": F.sum("n").over(taxa) - F.col("n")})
    own = fixes.select("id", "species", geo.cell("latitude", width).alias("i"), geo.cell("longitude", width).alias("j")).distinct()
    return own.join(counts, ["i", "j", "species"]).groupBy("id").agg(*[reduce(c).alias(c) for c in ("same", "other", "taxa_other")])


def species_overlap(tracks, reduce=F.avg):
    """Tracks' overlaps (of :func:`overlap`, with ``species``) reduced by species, and the ratios of the species' figures."""
    s = tracks.groupBy("species").agg(*[reduce(c).alias(c) for c in ("same", "other", "taxa_other")])
    return s.withColumns({"ratio": F.try_divide("same", "other"), "taxa_ratio": F.try_divide("same", "taxa_other")})


def overlap_vs_accuracy(fixes, accuracy, width=1.0):
    """Overlap ratio same / other, mean over a track, with its accuracy; a ratio without others is null and flagged."""
    o = overlap(fixes, width).withColumn("ratio", F.try_divide("same", "other")).withColumn("is_inf", (F.col("other") == 0) & (F.col("same") > 0))
    return o.join(accuracy, "id")


# Distances between rows of vectors and between sequences.

#: Vectors of a block; a pair of blocks is one row of work.
BLOCK = 512
#: Blocks of a partition at most where all pairs are met; a task reads two partitions.
GROUP = 64
#: Rows of results that a task holds before it merges them.
HELD = 1 << 20


def _blocks(df, key, vector):
    """``_size, _b, _n, _rows``: vectors of one length in blocks of about BLOCK, dealt out by a hash of the key."""
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("k").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    sizes = rows.groupBy(F.size("v").alias("_size")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_n"))
    rows = rows.withColumn("_size", F.size("v")).join(sized(sizes), "_size")
    return rows.groupBy("_size", "_n", F.pmod(F.xxhash64("k"), F.col("_n")).cast("int").alias("_b")).agg(F.collect_list(F.struct("k", "v")).alias("_rows"))


def _parts(rows):
    rows = rows.values
    keys = rows.field(0).to_numpy()
    return keys, rows.field(1).flatten().to_numpy().reshape(len(keys), -1)


def _spread(spark):
    """Tasks at least that work is dealt out to."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _dealt(blocks):
    """A checkpoint of blocks in partitions of GROUP at most: every two of them are a task, and there are enough of these."""
    blocks = checkpoint(blocks)
    n = blocks.count()
    return checkpoint(blocks.repartition(max(1, min(n, max(math.isqrt(3 * _spread(blocks.sparkSession)) + 1, -(-n // GROUP))))))


def _block_pairs(left, right, condition, fn, schema, merge=None, same=None, parts=None):
    """``fn(keys, vectors, keys, vectors, same block)`` of every pair of blocks that meets the condition; it yields columns.

    A task reads one partition of either side (of :func:`_dealt`) again from its checkpoint, so no pair of blocks is sent or written: what goes to
    disk grows with the rows, not with their pairs. ``merge`` makes fewer rows of columns; what a task holds before that is bounded by HELD.
    """
    names, read = [f.split()[0] for f in schema.split(", ")], parts or _parts
    made = lambda columns: pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    def run(batches):
        held, rows = [], 0
        for b in batches:
            for x, y, same in zip(b.column(0), b.column(1), b.column(2).to_pylist(), strict=True):
                for columns in fn(*read(x), *read(y), same):
                    if merge is None:
                        yield made(columns)
                        continue
                    held.append(columns)
                    rows += len(columns[0])
                    if rows > HELD:
                        held = [merge(*map(np.concatenate, zip(*held, strict=True)))]
                        rows = len(held[0][0])
                        if 2 * rows > HELD:
                            yield made(held[0])
                            held, rows = [], 0
        if held:
            yield made(merge(*map(np.concatenate, zip(*held, strict=True))))

    met = left.hint("shuffle_replicate_nl").join(right, condition)
    return met.select("_left", "_right", (F.lit(False) if same is None else same).alias("_same")).mapInArrow(run, schema)


def _closest(k, row, other, d):
    """The ``k`` smallest distances of each row, ties to the smaller other."""
    order = np.lexsort((other, d, row))
    row, other, d = row[order], other[order], d[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], other[keep], d[keep]


def _ranked(near, k, row, other):
    """The ``k`` smallest ``d`` of each row over all tasks."""
    w = Window.partitionBy(row).orderBy("d", other)
    return near.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def _once(a, b):
    """Whether a pair of numbered blocks is taken this way around: each two one way, and half of them in any two partitions."""
    return (a == b) | ((a < b) == ((a + b) % 2 == 0))


def _triangle(df, key, vector, fn, schema):
    """Every two blocks of equal vector length once."""
    return _triangle_of(_dealt(_blocks(df, key, vector)), fn, schema)


def _triangle_of(blocks, fn, schema, merge=None):
    """Every two of :func:`_blocks`, dealt out, of one vector length once."""
    left = blocks.select(F.col("_size").alias("_long"), F.col("_b").alias("_a"), F.col("_rows").alias("_left"))
    right = blocks.select("_size", "_b", F.col("_rows").alias("_right"))
    a, b = F.col("_a"), F.col("_b")
    return _block_pairs(left, right, (F.col("_long") == F.col("_size")) & _once(a, b), fn, schema, merge, a == b)


def _euclidean(x, y):
    """Distances by differences, a component and a few rows at a time, not by squares, which would lose digits."""
    out = np.zeros((len(x), len(y)))
    step = max(1, (1 << 15) // max(1, len(y)))
    left, right, held = np.ascontiguousarray(x.T)[:, :, None], np.ascontiguousarray(y.T), np.empty((step, len(y)))
    for i in range(0, len(x), step):
        part = out[i : i + step]
        d = held[: len(part)]
        for u, v in zip(left[:, i : i + step], right, strict=True):
            np.subtract(u, v, out=d)
            np.multiply(d, d, out=d)
            np.add(part, d, out=part)
    return np.sqrt(out, out=out)


#: Share of two vectors' squares under which the square of their distance, found by squares, has lost too many digits.
LOSS = 1e-3


def _by_squares(x, y):
    """Distances by squares, to about 12 digits; those that lose digits so are taken by differences."""
    centre = y.mean(axis=0)
    a, b = x - centre, y - centre
    whole = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)
    square = whole - 2 * (a @ b.T)
    lost = np.flatnonzero(~(square > LOSS * whole))
    for at in np.array_split(lost, -(-len(lost) // (1 << 15))) if len(lost) else ():
        i, j = np.divmod(at, len(y))
        square.flat[at] = ((x[i] - y[j]) ** 2).sum(axis=1)
    return np.sqrt(square, out=square)


def distance_matrix(df, key="id", vector="embedding"):
    """``i, j, d``: Euclidean distances of all pairs i < j of vectors of one length, a pair of blocks at a time.

    All pairs are the result, so it grows with the square of the rows. Rows with a null in key or vector have no pairs.
    """

    def pairs(ki, x, kj, y, same):
        d = _euclidean(x, y)
        a, b = np.broadcast_arrays(ki[:, None], kj[None, :])
        keep = a < b if same else np.ones(d.shape, bool)
        a, b, d = a[keep], b[keep], d[keep]
        yield np.minimum(a, b), np.maximum(a, b), d

    return _triangle(df, key, vector, pairs, "i long, j long, d double")


def _least(x, windows, kind):
    """Least squared distances of patterns over each series' windows (window, series, place), by squares in floats of a kind; and their rounding at most, by pattern."""
    own, part_of = (x * x).sum(axis=1), np.finfo(kind)
    x, windows = x.astype(kind), windows.astype(kind)
    w, m, n = windows.shape
    norms = (windows * windows).sum(axis=2)
    patterns = np.concatenate([-2 * x, np.ones((len(x), 1), kind)], axis=1)
    low = np.empty((len(x), m), kind)
    # Parts small enough for a core's own memory.
    few = max(1, (1 << 11) // w)
    for j in range(0, m, few):
        part = np.concatenate([windows[:, j : j + few], norms[:, j : j + few, None]], axis=2)
        part = np.ascontiguousarray(part.reshape(-1, n + 1).T)
        for i in range(0, len(x), 64):
            low[i : i + 64, j : j + few] = (patterns[i : i + 64] @ part).reshape(-1, w, part.shape[1] // w).min(axis=1)
    return low + own[:, None], 8 * part_of.eps * (n + 4) * (own + norms.max(initial=0)) + float(part_of.tiny)


def shapelet_distances(patterns, series, key="id", vector="v", k=None):
    """``pid, id, d``: least Euclidean distance of each pattern over each series' alignments, the last left out, by the square root of
    the pattern's length; the plain distance if both are as long, none if the pattern is longer.

    With ``k`` only each pattern's ``k`` closest series (ties to the smaller key): a task passes on k of them for each of its patterns at most, so the
    result grows with the patterns, not with patterns times series. Without ``k`` all pairs are the result.

    Distances are screened by squares, all windows of a few series in one product; what is kept, or so small that squares lose its digits, is measured.
    """
    p, s = _blocks(patterns, key, vector), _blocks(series, key, vector)
    left = _dealt(p.select(F.col("_size").alias("_short"), F.col("_rows").alias("_left")))
    right = _dealt(s.select(F.col("_size").alias("_long"), F.col("_rows").alias("_right")))

    def pairs(kp, x, ks, y, _):
        n, m = x.shape[1], y.shape[1]
        windows = np.lib.stride_tricks.sliding_window_view(y, n, axis=1)[:, : max(1, m - n)].transpose(1, 0, 2)
        square, slack = _least(x, windows, float if k is None else np.float32)
        if k is None:
            wanted = ~(square > slack[:, None] / LOSS**3)
        else:
            edge = np.partition(square, min(k, len(ks)) - 1, axis=1)[:, min(k, len(ks)) - 1]
            wanted = ~(square > (edge + 2 * slack)[:, None])
        i, j = np.nonzero(wanted)
        some = max(1, (1 << 20) // max(1, len(windows) * n))
        for a in range(0, len(i), some):
            u, v = i[a : a + some], j[a : a + some]
            square[u, v] = ((windows[:, v] - x[u]) ** 2).sum(axis=2).min(axis=0)
        if k is None:
            i, j = (c.ravel() for c in np.indices(square.shape))
        d = np.sqrt(square[i, j])
        out = kp[i], ks[j], d if n == m else d / np.sqrt(n)
        yield out if k is None else _closest(k, *out)

    out = _block_pairs(left, right, F.col("_short") <= F.col("_long"), pairs, "pid long, id long, d double", k and partial(_closest, k))
    return _ranked(out, k, "pid", "id") if k else out
