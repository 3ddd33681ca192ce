"""Geometry on the unit sphere as column expressions. Degrees in and out, distances in radians.

The latitude component of a local vector points south, as polar angles grow; ``north=True`` turns it.
"""

from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def _rad(x):
    return F.radians(_c(x))


def unit_vector(lat, lon):
    """Columns x, y, z of a point."""
    la, lo = _rad(lat), _rad(lon)
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)


def to_lat_lon(x, y, z):
    """Latitude and longitude of a vector."""
    x, y, z = _c(x), _c(y), _c(z)
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))


def great_circle(lat1, lon1, lat2, lon2):
    """Central angle by the haversine formula, guarded against rounding above 1."""
    a, b = _rad(lat1), _rad(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((_rad(lon2) - _rad(lon1)) / 2), 2)
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def to_local(lat, lon, vector, north=False):
    """Radial, latitude and longitude components of a vector at a point."""
    la, lo = _rad(lat), _rad(lon)
    x, y, z = vector
    radial = x * F.cos(la) * F.cos(lo) + y * F.cos(la) * F.sin(lo) + z * F.sin(la)
    south = x * F.sin(la) * F.cos(lo) + y * F.sin(la) * F.sin(lo) - z * F.cos(la)
    east = -x * F.sin(lo) + y * F.cos(lo)
    return radial, -south if north else south, east


def from_local(lat, lon, local, north=False):
    """Vector with the given radial, latitude and longitude components at a point."""
    la, lo = _rad(lat), _rad(lon)
    r, s, e = local
    s = -s if north else s
    return (
        r * F.cos(la) * F.cos(lo) + s * F.sin(la) * F.cos(lo) - e * F.sin(lo),
        r * F.cos(la) * F.sin(lo) + s * F.sin(la) * F.sin(lo) + e * F.cos(lo),
        r * F.sin(la) - s * F.cos(la),
    )


def log_map(lat1, lon1, lat2, lon2):
    """Tangent vector at the first point whose geodesic ends at the second; zero for equal points."""
    p, q = unit_vector(lat1, lon1), unit_vector(lat2, lon2)
    d = great_circle(lat1, lon1, lat2, lon2)
    k = F.when(F.sin(d) > 0, d / F.sin(d)).otherwise(F.lit(0.0))
    return tuple(k * (b - F.cos(d) * a) for a, b in zip(p, q, strict=True))


def exp_map(lat, lon, vector):
    """Latitude and longitude reached from a point along a tangent vector."""
    p = unit_vector(lat, lon)
    n = F.sqrt(sum(v * v for v in vector))
    k = F.when(n > 0, F.sin(n) / n).otherwise(F.lit(1.0))
    return to_lat_lon(*[F.cos(n) * a + k * v for a, v in zip(p, vector, strict=True)])


def displacement(lat1, lon1, lat2, lon2, north=False):
    """Latitude and longitude components of the way from one point to the next."""
    return to_local(lat1, lon1, log_map(lat1, lon1, lat2, lon2), north)[1:]


def transport(lat1, lon1, lat2, lon2, vector):
    """A vector at the first point with the same local components at the second."""
    return from_local(lat2, lon2, to_local(lat1, lon1, vector))


def cell(x, width):
    """Index of the right-closed cell that holds x."""
    return F.ceil(_c(x) / F.lit(float(width))).cast("long")


def cell_centre(x, width):
    return F.ceil(_c(x) / F.lit(float(width))) * F.lit(float(width)) - F.lit(width / 2)


def half_even_cell(x):
    """1 degree cell by rounding halves to even."""
    return F.bround(_c(x), 0).cast("long")


def floor_cell(x, most=None):
    """1 degree cell by its lower edge; ``most`` joins the upper edge to the last cell."""
    v = F.floor(_c(x)).cast("long")
    return v if most is None else F.least(v, F.lit(most).cast("long"))


def centred_cell(x, low, width, down=False):
    """Nearest cell of a regular grid whose first edge is ``low``; the earlier cell on a tie. ``down``: the axis falls."""
    offset = (F.lit(float(low)) - _c(x)) if down else (_c(x) - F.lit(float(low)))
    return F.greatest(F.ceil(offset / F.lit(float(width))) - 1, F.lit(0)).cast("long")


def equal_area_band(lat, n):
    """Band 0 .. n-1 from the south, all of the same area."""
    return F.least(F.floor(F.lit(n / 2) * (1 + F.sin(_rad(lat)))), F.lit(n - 1)).cast("long")


def longitude_band(lon, n):
    return F.least(F.floor((_c(lon) + 180) * F.lit(n / 360)), F.lit(n - 1)).cast("long")


def in_polygon(lat, lon, vertices):
    """Whether a point lies in a polygon of (lat, lon) vertices, its boundary included; one expression, no UDF.

    A point is on an edge if it is collinear with its ends, or at the longitude that the edge has at its latitude, as rounded.
    """
    y, x = _c(lat), _c(lon)
    crossings, edge = F.lit(0), F.lit(False)
    for (y1, x1), (y2, x2) in zip(vertices, [*vertices[1:], vertices[0]], strict=True):
        cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        on = cross == 0
        if y1 != y2:
            spans = (y >= min(y1, y2)) & (y < max(y1, y2))
            at = (y - y1) * F.lit(float(x2 - x1)) / F.lit(float(y2 - y1)) + x1
            on = on | (at == x)
            crossings = crossings + F.when(spans & (at > x), 1).otherwise(0)
        edge = edge | (on & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
    return edge | (crossings % 2 == 1)
