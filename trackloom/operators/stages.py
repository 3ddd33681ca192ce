"""Stage runs and stage counts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times


def stage_runs(fixes: DataFrame) -> DataFrame:
    """Runs of one stage as tracks of their own, ``new_id`` = id-stage-k; runs of one fix go, missing stages are skipped.

    A track with a single stage keeps its id.
    """
    w = Window.partitionBy("id").orderBy("date_time", "fix_id")
    df = fixes.withColumn("stage", times.words_to_null("stage")).filter("stage is not null")
    df = df.withColumn("_new", F.coalesce(F.col("stage") != F.lag("stage").over(w), F.lit(True)).cast("int"))
    df = df.withColumn("_run", F.sum("_new").over(w))
    df = df.withColumns({"_k": F.dense_rank().over(Window.partitionBy("id", "stage").orderBy("_run")), "_n": F.count(F.lit(1)).over(Window.partitionBy("id", "_run")), "_runs": F.max("_run").over(Window.partitionBy("id"))})
    name = F.when(F.col("_runs") == 1, F.col("id").cast("string")).otherwise(F.concat_ws("-", F.col("id").cast("string"), "stage", F.col("_k").cast("string")))
    return df.filter("_n > 1").withColumn("new_id", name).drop("_new", "_run", "_k", "_n", "_runs")


def run_days(runs: DataFrame) -> DataFrame:
    us = times.micros("date_time")
    return runs.groupBy("new_id", "stage").agg(F.count(F.lit(1)).alias("length"), ((F.max(us) - F.min(us)) / 86_400_000_000).alias("days"))


def stage_by_bin(fixes: DataFrame, rate) -> DataFrame:
    """Most frequent stage of each day bin (1/rate days, right-closed); ties to the smallest name."""
    day = times.day_of_year("date_time")
    df = fixes.select("id", F.year("date_time").alias("year"), F.ceil(day * rate).cast("long").alias("bin"), "stage").filter("bin > 0 and stage is not null")
    counts = df.groupBy("id", "year", "bin", "stage").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("id", "year", "bin").agg(F.max("n").alias("n"))
    return counts.join(best, ["id", "year", "bin", "n"]).groupBy("id", "year", "bin").agg(F.min("stage").alias("stage"))


def stage_counts(fixes: DataFrame) -> DataFrame:
    """Distinct stages of each species and animals of each stage, sums over a species' stages included (level 0: stage, 1: species)."""
    df = fixes.filter("stage is not null")
    return df.rollup("species", "stage").agg(F.count_distinct("id").alias("n_animals"), F.count_distinct("stage").alias("n_stages"), F.grouping_id().alias("level")).filter("level < 3")


def stage_kinds(fixes: DataFrame) -> DataFrame:
    """Number of stages of each species and whether they are one, two or many."""
    n = F.count_distinct("stage")
    return fixes.groupBy("species").agg(n.alias("n_stages"), F.when(n <= 1, "one-class").when(n == 2, "binary").otherwise("multi").alias("kind"))
