"""Dates, cyclic time and labels as column expressions."""

import math

from pyspark.sql import functions as F

#: Words that stand for a missing value.
NULL_WORDS = ("unknown", "Unknown", "")
#: Edges of the classes of a track's days.
DAY_EDGES = (0, 1, 10, 50, 100, 200, 500)


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def is_leap(year):
    y = _c(year)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def year_days(year):
    return F.when(is_leap(year), 366.0).otherwise(365.0)


def micros(ts):
    return F.unix_micros(_c(ts).cast("timestamp"))


def day_of_year(ts):
    """Day of the year from 0, with its fraction."""
    t = _c(ts)
    return F.dayofyear(t) - 1 + F.hour(t) / 24 + F.minute(t) / 1440 + F.second(t) / 86400


def periodic_time(day, year):
    """Sine and cosine of the time of the year."""
    angle = F.lit(2 * math.pi) * _c(day) / year_days(year)
    return F.sin(angle), F.cos(angle)


def day_from_periodic(sine, cosine, days=365.0):
    """Day of the year from its sine and cosine."""
    turn = F.atan2(_c(sine), _c(cosine)) / F.lit(2 * math.pi)
    return F.pmod(turn, F.lit(1.0)) * F.lit(days)


def angle_to_sin_cos(degrees):
    return F.sin(F.radians(_c(degrees))), F.cos(F.radians(_c(degrees)))


def to_second(ts):
    """Rounded to the second, halves up."""
    return F.date_trunc("SECOND", F.timestamp_micros(micros(ts) + 500_000))


def sentinel_to_null(x, sentinel=9999.0):
    return F.nullif(_c(x), F.lit(sentinel))


def words_to_null(x, words=NULL_WORDS):
    return F.when(~_c(x).isin(*words), _c(x))


def interval(x, edges=DAY_EDGES):
    """Index of the right-closed interval (edge, next edge] that holds x; null outside."""
    out = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        out = F.when((_c(x) > a) & (_c(x) <= b), i).otherwise(out)
    return out


def month_of_day(day):
    return F.month(F.date_add(F.make_date(F.lit(2020), F.lit(1), F.lit(1)), F.floor(_c(day)).cast("int")))


def week_of_day(day):
    return F.floor(_c(day) / 7).cast("long")


def stage_type(stage):
    """Text before the colon, first letter upper."""
    head = F.split_part(_c(stage), F.lit(":"), F.lit(1))
    return F.concat(F.upper(F.substring(head, 1, 1)), F.substring(head, 2, 1000))


def sub_stage(stage):
    return F.nullif(F.split_part(_c(stage), F.lit(": "), F.lit(2)), F.lit(""))


def binary_stage(stage):
    """Breeding or non-breeding by keyword; missing words become null."""
    s = words_to_null(stage)
    return F.when(s.isNull(), None).when(F.lower(s).rlike("non-breeding|migration|hivernage"), "non-breeding").otherwise("breeding")


def collapse_breeding(stage):
    return F.when(_c(stage).startswith("breeding"), "breeding").otherwise(_c(stage))


def cohens_h(p, q):
    return 2 * F.asin(F.sqrt(_c(p))) - 2 * F.asin(F.sqrt(_c(q)))


def binary_entropy(p):
    p = _c(p)
    return F.when((p > 0) & (p < 1), -(p * F.ln(p) + (1 - p) * F.ln(1 - p))).otherwise(F.lit(0.0))


def chance_f1(p):
    return 2 * _c(p) / (_c(p) + 1)
