"""Row-local operators on streams.

Lookups, cells and encodings hold no state, so the same column expressions run on a streaming DataFrame;
grids join as static sides.
"""

from pyspark.sql import functions as F

from ..functions import geo, times
from ..operators import enrich


def stream_fixes(spark, path, schema, files_per_trigger=1):
    """Fixes from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def enrich_stream(fixes, grid, name="value"):
    """Unit vectors, time of the year and a grid's value for each arriving fix."""
    x, y, z = geo.unit_vector("latitude", "longitude")
    s, c = times.periodic_time(times.day_of_year("date_time"), F.year("date_time"))
    return enrich.grid_lookup(fixes.withColumns({"x": x, "y": y, "z": z, "sin_t": s, "cos_t": c}), grid, name=name)
