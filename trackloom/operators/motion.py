"""Steps, speeds and summaries of tracks.

A track is the rows of one ``id`` in order of ``date_time``, ties by ``fix_id``.  All windows share
that partition and order, so Spark sorts a track once.
"""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, times
from ..store import checkpoint, running_start

ORDER = ("date_time", "fix_id")
DEFAULT_STEP = 0.11
ZERO = 1e-8
DAY_US = 86_400_000_000


def track(by=("id",), order=ORDER):
    return Window.partitionBy(*by).orderBy(*order)


def whole(by=("id",)):
    return Window.partitionBy(*by)


def steps(df: DataFrame) -> DataFrame:
    """Add ``dt`` (days to the next fix), ``dist`` (radians), ``south``, ``east``; null at a track's last fix."""
    w = track()
    nxt = lambda c: F.lead(c).over(w)
    df = df.withColumns({"_la": nxt("latitude"), "_lo": nxt("longitude"), "dt": (nxt(times.micros("date_time")) - times.micros("date_time")) / DAY_US})
    south, east = geo.displacement("latitude", "longitude", F.col("_la"), F.col("_lo"))
    return df.withColumns({"dist": geo.great_circle("latitude", "longitude", F.col("_la"), F.col("_lo")), "south": south, "east": east}).drop("_la", "_lo")


def cyclic_dt(df: DataFrame) -> DataFrame:
    """``dt`` from days of the year alone: differences wrap at the year's end, zero steps are repaired first,
    and a year that changes without the day falling adds a year's length."""
    w = track()
    df = df.withColumns({"day": times.day_of_year("date_time"), "year": F.year("date_time")})
    df = df.withColumns({"_d": F.lead("day").over(w) - F.col("day"), "_y": F.lead("year").over(w)})
    length = times.year_days("year")
    df = df.withColumn("dt", F.when(F.col("_d") < 0, F.col("_d") + length).otherwise(F.col("_d")))
    df = fill_zero_dt(df)
    crossed = (F.col("_y") != F.col("year")) & (F.col("_d") >= 0)
    return df.withColumn("dt", F.when(crossed, F.col("dt") + length).otherwise(F.col("dt"))).drop("_d", "_y")


def fill_zero_dt(df: DataFrame, by="mean", default=DEFAULT_STEP) -> DataFrame:
    """Zero steps become the mean of the track's other steps, or of the nearest others before and after."""
    real = F.when(F.col("dt") >= ZERO, F.col("dt"))
    if by == "mean":
        fill = F.avg(real).over(whole())
    elif by == "closest":
        before = F.last(real, True).over(track().rowsBetween(Window.unboundedPreceding, 0))
        after = F.first(real, True).over(track().rowsBetween(0, Window.unboundedFollowing))
        fill = F.coalesce((before + after) / 2, before, after)
    else:
        raise ValueError("by is mean or closest")
    return df.withColumn("dt", F.when(F.col("dt") < ZERO, F.coalesce(fill, F.lit(default))).otherwise(F.col("dt")))


def velocity(df: DataFrame) -> DataFrame:
    """Add ``v_south``, ``v_east`` and ``speed`` in radians a day to :func:`steps` with repaired ``dt``."""
    df = fill_zero_dt(steps(df))
    return df.withColumns({"v_south": F.col("south") / F.col("dt"), "v_east": F.col("east") / F.col("dt"), "speed": F.col("dist") / F.col("dt")})


def velocity_xyz(df: DataFrame) -> DataFrame:
    df = fill_zero_dt(steps(df))
    out = {f"v_{n}": (F.lead(c).over(track()) - c) / F.col("dt") for n, c in zip("xyz", geo.unit_vector("latitude", "longitude"), strict=True)}
    return df.withColumns(out)


def differences(df: DataFrame, columns) -> DataFrame:
    """First differences of the columns; a track's last row goes."""
    w = track()
    df = df.withColumn("_has", F.lead("date_time").over(w).isNotNull())
    return df.withColumns({f"d_{c}": F.lead(c).over(w) - F.col(c) for c in columns}).filter("_has").drop("_has")


def common_origin(df: DataFrame, keep=()) -> DataFrame:
    """Displacement from a track's start, summed over its steps: ``sn``, ``we`` from (0, 0), and days ``t`` since the start."""
    before = track().rowsBetween(Window.unboundedPreceding, -1)
    first = F.first(times.micros("date_time")).over(track())
    return steps(df).select("id", "fix_id", "date_time", *keep, *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(n) for c, n in (("south", "sn"), ("east", "we"))], ((times.micros("date_time") - first) / DAY_US).alias("t"))


def hours_since_start(df: DataFrame) -> DataFrame:
    return df.withColumn("hours", (times.micros("date_time") - F.min(times.micros("date_time")).over(whole())) / 3_600_000_000)


def shift_clock(df: DataFrame) -> DataFrame:
    """Day of the year counted from the track's first fix, wrapped within a year."""
    day = times.day_of_year("date_time")
    return df.withColumn("day0", F.pmod(day - F.first(day).over(track()), times.year_days(F.year("date_time"))))


def year_runs(df: DataFrame) -> DataFrame:
    """Number the stretches of a track with one year: ``run`` from 0."""
    w = track()
    df = df.withColumn("year", F.year("date_time"))
    df = df.withColumn("_new", F.coalesce(F.col("year") != F.lag("year").over(w), F.lit(False)).cast("int"))
    return df.withColumn("run", F.sum("_new").over(w)).drop("_new")


def drop_repeated_times(df: DataFrame) -> DataFrame:
    """The first fix of each time of a track."""
    w = Window.partitionBy("id", "date_time").orderBy("fix_id")
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def turning_angle(df: DataFrame) -> DataFrame:
    """Signed angle between consecutive steps, positive to the left (counter-clockwise seen from above)."""
    w = track()
    df = steps(df)
    n = F.sqrt(F.col("south") ** 2 + F.col("east") ** 2)
    df = df.withColumns({"_s": F.when(n > 0, F.col("south") / n), "_e": F.when(n > 0, F.col("east") / n)})
    df = df.withColumns({"_ps": F.lag("_s").over(w), "_pe": F.lag("_e").over(w)})
    dot = F.col("_s") * F.col("_ps") + F.col("_e") * F.col("_pe")
    turn = F.signum(F.col("_ps") * F.col("_e") - F.col("_pe") * F.col("_s"))
    return df.withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) * turn).drop("_s", "_e", "_ps", "_pe")


def average_rank(df: DataFrame, column, by=(), name="rank") -> DataFrame:
    """Ranks from 1, ties sharing their mean. Without ``by`` equal values are counted first, and the counts summed up over a range exchange."""
    if by:
        order, ties = Window.partitionBy(*by).orderBy(column), Window.partitionBy(*by, column)
        return df.withColumn(name, F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2)
    counts = checkpoint(df.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    ranks = running_start(counts, ["_v"], F.col("_n")).select("_v", (F.col("_start") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, F.col(column).eqNullSafe(F.col("_v"))).drop("_v")


# Summaries, one row for each track.


def track_summary(df: DataFrame) -> DataFrame:
    """Length, mean position and the mean of the first and the last year."""
    first, last = F.min_by("date_time", F.struct(*ORDER)), F.max_by("date_time", F.struct(*ORDER))
    return df.groupBy("id").agg(F.count(F.lit(1)).alias("length"), F.avg("latitude").alias("mean_lat"), F.avg("longitude").alias("mean_lon"), ((F.year(first) + F.year(last)) / 2).alias("mean_year"))


def days_in_track(df: DataFrame, mode="all") -> DataFrame:
    """Days from first to last fix, or of the best stretch within one year."""
    us = times.micros("date_time")
    if mode == "all":
        return df.groupBy("id").agg(((F.max(us) - F.min(us)) / DAY_US).alias("days"))
    return year_spans(df).groupBy("id").agg(F.max("span").alias("days"))


def year_spans(df: DataFrame) -> DataFrame:
    us = times.micros("date_time")
    return year_runs(df).groupBy("id", "run", "year").agg(((F.max(us) - F.min(us)) / DAY_US).alias("span"), F.count(F.lit(1)).alias("n"))


def best_year_run(df: DataFrame, prune_by="span") -> DataFrame:
    """The longest stretch within one year, by days (``span``) or fixes (``n``); the first on a tie."""
    best = F.max_by(F.struct("run", "year", "span", "n"), F.struct(prune_by, -F.col("run")))
    return year_spans(df).groupBy("id").agg(best.alias("b")).select("id", "b.*")


def speed_stats(df: DataFrame) -> DataFrame:
    """Mean, median, population deviation and maximum of the speed, its count, and the start position."""
    first = lambda c: F.min_by(c, F.struct(*ORDER))
    return velocity(df).groupBy("id").agg(F.avg("speed").alias("mean_speed"), F.percentile("speed", 0.5).alias("median_speed"), F.stddev_pop("speed").alias("std_speed"), F.max("speed").alias("max_speed"), F.count("speed").alias("n_steps"), first("latitude").alias("start_lat"), first("longitude").alias("start_lon"))


def majority(df: DataFrame, column, by="id") -> DataFrame:
    """Most frequent value of a column for each key and its share; ties to the smallest value, negative (noise) ones last."""
    counts = df.groupBy(by, column).agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("n"), F.when(F.col(column) < 0, F.lit(-(1 << 40))).otherwise(-F.col(column)))
    return counts.groupBy(by).agg(F.max_by(column, order).alias("value"), (F.max("n") / F.sum("n")).alias("share"))


def net_displacement(df: DataFrame) -> DataFrame:
    """Absolute latitude and longitude components of the way from first to last fix, and its length."""
    end = lambda c, f: f(c, F.struct(*ORDER))
    ends = df.groupBy("id").agg(*[end(c, f).alias(n) for c, f, n in (("latitude", F.min_by, "la0"), ("longitude", F.min_by, "lo0"), ("latitude", F.max_by, "la1"), ("longitude", F.max_by, "lo1"))])
    south, east = geo.displacement("la0", "lo0", F.col("la1"), F.col("lo1"))
    return ends.select("id", F.abs(south).alias("sn"), F.abs(east).alias("we"), geo.great_circle("la0", "lo0", "la1", "lo1").alias("dist"))


def extension(df: DataFrame) -> DataFrame:
    """Largest absolute displacement from the start by component, over the whole path."""
    return common_origin(df).groupBy("id").agg(F.max(F.abs("sn")).alias("sn_max"), F.max(F.abs("we")).alias("we_max"))


def positions(df: DataFrame) -> DataFrame:
    return df.groupBy("id").agg(F.count(F.lit(1)).alias("n_obs"), F.percentile("latitude", 0.5).alias("median_lat"), F.percentile("longitude", 0.5).alias("median_lon"), F.avg(F.year("date_time")).alias("mean_year"))


def covariate_stats(df: DataFrame, column, null_as=None, by="id") -> DataFrame:
    """Mean, mean of positive values, mean of values at or above the median, quartiles, maximum, population deviation."""
    x = F.col(column) if null_as is None else F.coalesce(F.col(column), F.lit(null_as))
    df = df.select(by, x.alias("x"))
    df = df.withColumn("_m", F.percentile("x", 0.5).over(Window.partitionBy(by)))
    return df.groupBy(by).agg(
        F.avg("x").alias("mean"), F.avg(F.when(F.col("x") > 0, F.col("x"))).alias("mean_positive"), F.avg(F.when(F.col("x") >= F.col("_m"), F.col("x"))).alias("mean_upper"),
        *[F.percentile("x", q).alias(f"p{round(100 * q)}") for q in (0.25, 0.5, 0.75)], F.max("x").alias("max"), F.stddev_pop("x").alias("std"),
    )


def sampling_frequency(df: DataFrame) -> DataFrame:
    f = 1 / F.col("dt")
    return fill_zero_dt(steps(df)).groupBy("id").agg(F.avg(f).alias("mean_freq"), F.stddev_pop(f).alias("std_freq"))


# Dead reckoning: each step depends on the moved position before it.

#: Fixes of a track that are folded as one array.
STRETCH = 1024
#: Radians by which a stretch's start may still move when all starts count as found.
SETTLED = 1e-13


def _stretches(df, by):
    """``id, k, rows, lat, lon``: fixes of each stretch in order, with their step's parts; the first position of the track in radians."""
    n = F.hypot("south", "east")
    k = F.when(n > 0, F.sin(n) / n).otherwise(1.0)
    whole = F.col("south").isNotNull() & F.col("east").isNotNull() & ~F.isnan("south") & ~F.isnan("east")
    move = F.when(whole, F.struct(F.cos(n).alias("c"), (k * F.col("south")).alias("s"), (k * F.col("east")).alias("e")))
    placed = running_start(df.select("id", *reversed(ORDER), *by, move.alias("move")), ORDER, by="id")
    row = F.struct("_start", *reversed(ORDER), "move")
    first = lambda c: F.max(F.when(F.col("_start") == 0, F.col(c)))
    return placed.groupBy("id", F.expr(f"_start div {STRETCH}").alias("k")).agg(F.array_sort(F.collect_list(row)).alias("rows"), *[F.radians(first(c)).alias(n) for c, n in zip(by, ("lat", "lon"), strict=True)])


def _moved(at, m):
    """Latitude, longitude and slope (of the latitude reached by the latitude started from) after one step ``m``."""
    up = m.c * F.cos(at.lat) + m.s * F.sin(at.lat)  # along the meridian's direction in the equator's plane
    x, y = up * F.cos(at.lon) - m.e * F.sin(at.lon), up * F.sin(at.lon) + m.e * F.cos(at.lon)
    z, flat = m.c * F.sin(at.lat) - m.s * F.cos(at.lat), F.hypot(up, m.e)
    return {"lat": F.atan2(z, flat), "lon": F.atan2(y, x), "slope": at.slope * F.coalesce(F.try_divide(up, flat), F.lit(1.0))}


def _step(at, m, **more):
    """State after a step; a missing step stays."""
    fields = _moved(at, m)
    return F.struct(*[F.when(m.isNull(), at[n]).otherwise(v).alias(n) for n, v in fields.items()], *[v.alias(n) for n, v in more.items()])


def _state(lat, lon, **more):
    return F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), F.lit(1.0).alias("slope"), *[v.alias(n) for n, v in more.items()])


def _starts(parts):
    """``id, k, lat, lon`` of the stretches after the first of a track.

    Where a stretch ends follows from the latitude it starts from alone, as longitudes just add up. So all starts are guessed (steps to the
    south added up) and all stretches folded at once, each with the slope of its end; Newton's method then follows the
    chain of ends and slopes along the track. Slopes are at most 1, so guesses settle in a few rounds; as each round makes one more
    stretch exact from the front, there are never more rounds than stretches.
    """
    chain = Window.partitionBy("id").orderBy("k")
    south = F.aggregate("rows", F.lit(0.0), lambda a, r: a + F.coalesce(r.move.s, F.lit(0.0)))
    guess = F.first("lat").over(chain) - F.coalesce(F.sum(south).over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    known = parts.withColumns({"guess": F.greatest(F.lit(-math.pi / 2), F.least(F.lit(math.pi / 2), guess)), "first_lat": F.first("lat").over(chain), "first_lon": F.first("lon").over(chain)}).drop("lat", "lon")
    known = checkpoint(known)
    rounds = known.select("id", "k", "guess")
    while True:
        end = F.aggregate("rows", _state(F.col("guess"), F.lit(0.0)), lambda at, r: _step(at, r.move))
        ends = known.drop("guess").join(rounds, ["id", "k"]).select("id", "k", "guess", "first_lat", "first_lon", end.alias("end"))
        along = ends.groupBy("id").agg(F.first("first_lat").alias("lat"), F.first("first_lon").alias("lon"), F.array_sort(F.collect_list(F.struct("k", "guess", "end"))).alias("chain"))
        out = F.array().cast("array<struct<k:bigint,guess:double,lat:double,lon:double>>")
        follow = lambda at, p: F.struct((p.end.lat + p.end.slope * (at.lat - p.guess)).alias("lat"), (at.lon + p.end.lon).alias("lon"), F.array_append(at.out, F.struct(p.k.alias("k"), p.guess.alias("guess"), at.lat.alias("lat"), at.lon.alias("lon"))).alias("out"))
        start = F.struct("lat", "lon", out.alias("out"))
        found = checkpoint(along.select("id", F.inline(F.aggregate("chain", start, follow, lambda at: at.out))))
        if not found.filter(F.abs(F.col("lat") - F.col("guess")) > SETTLED).limit(1).count():
            return found.filter("k > 0").select("id", "k", "lat", "lon")
        limited = F.greatest(F.lit(-math.pi / 2), F.least(F.lit(math.pi / 2), F.col("lat")))
        rounds = found.select("id", "k", limited.alias("guess"))


def dead_reckon(df: DataFrame, start=None) -> DataFrame:
    """Positions from a start point and the local components of each step: ``id, fix_id, date_time, latitude, longitude``.

    ``df`` has ``south`` and ``east`` (radians, as from :func:`steps`); ``start`` is a (lat, lon) for all tracks, or each
    track starts at its first fix. A step without components stays in place. Rows are laid out along their track and cut into stretches of
    ``STRETCH`` fixes, which are folded as arrays inside expressions; a long track is the work of many tasks.
    """
    by = ("latitude", "longitude")
    if start is not None:
        df = df.withColumns({c: F.lit(float(x)) for c, x in zip(by, start, strict=True)})
    parts = checkpoint(_stretches(df, by))
    if parts.filter("k > 0").limit(1).count():
        long = parts.join(parts.filter("k = 1").select("id"), "id", "left_semi")
        found = _starts(long).select("id", "k", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
        parts = parts.join(found, ["id", "k"], "left").withColumns({"lat": F.coalesce("_lat", "lat"), "lon": F.coalesce("_lon", "lon")})
    none = F.array().cast("array<struct<latitude:double,longitude:double>>")
    here = lambda at: F.struct(F.degrees(at.lat).alias("latitude"), F.degrees(at.lon).alias("longitude"))
    wrapped = F.atan2(F.sin("lon"), F.cos("lon"))
    places = F.aggregate("rows", _state(F.col("lat"), F.when(F.col("k") == 0, F.col("lon")).otherwise(wrapped), out=none), lambda at, r: _step(at, r.move, out=F.array_append(at.out, here(at))), lambda at: at.out)
    out = parts.select("id", F.explode(F.arrays_zip(F.col("rows"), places.alias("places"))).alias("r"))
    return out.select("id", "r.rows.fix_id", "r.rows.date_time", "r.places.latitude", "r.places.longitude")


def translate_to_origin(df: DataFrame) -> DataFrame:
    """Each track moved to start at (0, 0), its steps' local components kept (step by step, by the north of each place)."""
    return dead_reckon(steps(df), (0.0, 0.0))


def rescale_speed(df: DataFrame, group="species", train=None) -> DataFrame:
    """Speeds capped at the group's mean + 3 population deviations, scaled to 0..1 by the group's range, direction kept, summed up again.

    ``train``: condition for the rows that give the group's figures.
    """
    df = velocity(df)
    base = df if train is None else df.filter(train)
    cap = base.groupBy(group).agg((F.avg("speed") + 3 * F.stddev_pop("speed")).alias("_cap"))
    capped = base.join(cap, group).groupBy(group).agg(F.first("_cap").alias("_cap"), F.min(F.least("speed", "_cap")).alias("_low"), F.max(F.least("speed", "_cap")).alias("_high"))
    df = df.join(capped, group)
    scaled = F.try_divide(F.least("speed", "_cap") - F.col("_low"), F.col("_high") - F.col("_low"))
    df = df.withColumn("scaled", F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))
    before = track().rowsBetween(Window.unboundedPreceding, -1)
    part = lambda c: F.when(F.col("speed") > 0, F.col(c) / F.col("dist") * F.col("scaled") * F.col("dt")).otherwise(0.0)
    return df.withColumns({"sn": F.coalesce(F.sum(part("south")).over(before), F.lit(0.0)), "we": F.coalesce(F.sum(part("east")).over(before), F.lit(0.0))}).drop("_cap", "_low", "_high")


def unit_square(df: DataFrame, group=None, train=None) -> DataFrame:
    """Common-origin tracks scaled to the unit square by the range of ``sn`` and ``we`` of the training rows."""
    keys = [group] if group else []
    base = df if train is None else df.filter(train)
    box = base.groupBy(*keys).agg(*[f(c).alias(f"_{n}{c}") for c in ("sn", "we") for f, n in ((F.min, "a"), (F.max, "b"))])
    df = df.join(box, keys) if keys else df.crossJoin(F.broadcast(box))  # one row
    unit = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_a{c}"), F.col(f"_b{c}") - F.col(f"_a{c}")), F.lit(0.0))
    return df.withColumns({"x": unit("we"), "y": unit("sn")}).drop("_asn", "_bsn", "_awe", "_bwe")
