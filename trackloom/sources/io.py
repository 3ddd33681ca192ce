"""Readers and writers: fixes, metadata, grids, reports, derived tables."""

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times

FIXES = "LATITUDE double, LONGITUDE double, DATE_TIME timestamp, ID string, Stage string"
METADATA = "ID string, Species string, Taxa string"
EFFORT = "row long, dropped string, effort double, lat double, lon double"


def read_fixes(spark, path):
    """Fixes with ``day`` and ``year``; blanks after commas are dropped, the schema is fixed."""
    df = spark.read.csv(path, schema=FIXES, header=True, ignoreLeadingWhiteSpace=True)
    return df.withColumns({"day": times.day_of_year("DATE_TIME"), "year": F.year("DATE_TIME")})


def read_metadata(spark, path, extra=""):
    """Metadata of animals; ``extra`` adds optional columns to the schema."""
    return spark.read.csv(path, schema=METADATA + extra, header=True, ignoreLeadingWhiteSpace=True).withColumnRenamed("Species", "COMMON_NAME")


def clean_legacy(df):
    """Older fixes: numbers cast, ``>5`` satellites are 6, YEAR and MONTH added, DATE and TIME dropped."""
    sat = F.when(F.col("NumberOfSatellites") == ">5", "6").otherwise(F.col("NumberOfSatellites"))
    df = df.withColumn("NumberOfSatellites", sat)
    df = df.withColumns({c: F.expr(f"try_cast({c} as double)") for c in ("LATITUDE", "LONGITUDE", "NumberOfSatellites", "ResidualError")})
    return df.withColumns({"YEAR": F.year("DATE_TIME"), "MONTH": F.month("DATE_TIME")}).drop("DATE", "TIME")


def base_table(fixes):
    """What covariate lookups need of fixes, times floored to milliseconds."""
    return fixes.select("id", F.date_trunc("MILLISECOND", "date_time").alias("date_time"), "latitude", "longitude")


def write_base(fixes, path, csv=False, overwrite=False):
    w = base_table(fixes).write.mode("overwrite" if overwrite else "errorifexists")
    w.csv(path, header=True) if csv else w.option("compression", "zstd").parquet(path)


def clean_effort(df):
    """1 degree cells as whole numbers; no effort is unknown."""
    return df.select(F.col("lat").cast("long").alias("cell_lat"), F.col("lon").cast("long").alias("cell_lon"), F.nullif("effort", F.lit(0.0)).alias("effort"))


def read_effort(spark, path):
    return clean_effort(spark.read.csv(path, schema=EFFORT, header=True))


def read_biodiversity(spark, path):
    df = spark.read.csv(path, schema="EffectiveNorm double, Lat double, Lon double", header=True)
    return df.select(F.floor("Lat").cast("long").alias("cell_lat"), F.floor("Lon").cast("long").alias("cell_lon"), F.col("EffectiveNorm").alias("value"))


def read_matrix(spark, path):
    """``i, j, elevation`` of a blank-separated matrix in one text file; a file holds one grid."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.btrim("value", F.lit(" \n\r")), r"\r?\n")).alias("i", "line"))
    return lines.select("i", F.posexplode(F.split(F.btrim("line"), r"\s+")).alias("j", "v")).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("elevation"))


def melt_grid(wide, lat, columns):
    """Wide grid (a column for each longitude, named by it) to ``cell_lat, cell_lon, value``; masked cells are null."""
    long = wide.unpivot([lat], [f"`{c}`" for c in columns], "lon", "value")
    return long.select(F.floor(lat).cast("long").alias("cell_lat"), F.floor(F.replace("lon", F.lit("`"), F.lit("")).cast("double")).cast("long").alias("cell_lon"), times.sentinel_to_null("value").alias("value"))


def slice_time(df, year, month=None):
    """Rows of a year or month; on tables partitioned by ``year`` the filter prunes partitions."""
    y = F.col("year") if "year" in df.columns else F.year("date_time")
    df = df.filter(y == year)
    return df if month is None else df.filter(F.month("date_time") == month)


def years(df, wanted):
    y = F.col("year") if "year" in df.columns else F.year("date_time")
    return df.filter(y.isin(*wanted))


def materialize(df_or_fn, root, name, spark=None, **params) -> DataFrame:
    """A derived table under its name and parameters: read if it is complete there, else made and written.

    Completeness is Spark's ``_SUCCESS`` marker, looked up through the file system of ``root``.
    """
    key = hashlib.md5(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{root.rstrip('/')}/{name}-{key}"
    spark = spark or df_or_fn.sparkSession
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker):
        df = df_or_fn(**params) if callable(df_or_fn) else df_or_fn
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Rows that a bucket of stored tracks holds on average at most.
BUCKET_ROWS = 2_000_000
TRACK = ("id", "date_time", "fix_id")


def store_tracks(fixes, table, path=None, buckets=None, mode="overwrite"):
    """Store fixes as a table bucketed by track and sorted along it (``id, date_time, fix_id``), and return it read back.

    Windows, aggregates and joins by ``id`` on the stored table need no exchange, however often it is read; the one exchange is paid here. Each
    bucket is one file. ``buckets`` follows from the number of rows if it is not given; joins are free of an exchange between tables of as many buckets.
    """
    spark = fixes.sparkSession
    if buckets is None:
        buckets = max(1, -(-fixes.count() // BUCKET_ROWS))
    writer = fixes.repartition(buckets, "id").write.mode(mode).format("parquet").bucketBy(buckets, "id").sortBy(*TRACK)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return spark.table(table)


def append_tracks(fixes, table):
    """Append fixes to a table of :func:`store_tracks`, in its buckets. A bucket then has several files."""
    spark = fixes.sparkSession
    told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE FORMATTED {table}").collect()}
    buckets = int(told["Num Buckets"])
    fixes.select(*spark.table(table).columns).repartition(buckets, "id").write.mode("append").format("parquet").bucketBy(buckets, "id").sortBy(*TRACK).saveAsTable(table)
    return spark.table(table)


def append_results(df, path, by=("random_state",)):
    """Append to one report table, partitioned by the setting's columns."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def read_reports(spark, path, schema, **setting):
    """Rows of a setting of the report table; a setting that is not there gives no rows."""
    df = spark.read.schema(schema).parquet(path)
    for k, v in setting.items():
        df = df.filter(F.col(k) == v)
    return df


def add_missing(df, name, make):
    """``make(df)`` unless the column is there already."""
    return df if name in df.columns else make(df)
