"""Checkpoints that survive lost executors, and running sums over the whole of a distributed table."""

from uuid import uuid4

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark):
    """Use the shared folder that the cluster names; one beside the warehouse is set in local mode only."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and cut its lineage.

    Checkpoints go when nothing refers to them any more if ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set, as ``session.get_session`` does.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def folder(spark, name):
    """Path of a new folder beside the checkpoints, which the driver and all executors reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/{name}-{uuid4().hex}"


def running_start(df: DataFrame, order, amount=None, by=None) -> DataFrame:
    """Add ``_start``: the sum of ``amount`` (default 1 a row) over all earlier rows of the same ``by`` column.

    Rows are ordered by ``by``, then ``order``, then their place in the input, so equal rows get
    places of their own.  One range exchange deals the rows out, whatever key is hot; a small table
    with one row for each partition and group carries the sums across partitions.  Nulls in ``by``
    form one group.  The range exchange reads its input twice, to sample and to deal it out, so an input
    that is dear to compute is best a checkpoint. The result is a checkpoint, hence fixed even if the input is not.
    """
    keys = [F.col(by).asc_nulls_last()] if by else []
    group = F.col(by) if by else F.lit(0)
    laid = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*keys, *[F.col(c).asc_nulls_first() for c in order], F.col("_tie"))
        .sortWithinPartitions(*keys, *[F.col(c).asc_nulls_first() for c in order], F.col("_tie"))
        .withColumns({"_pid": F.spark_partition_id(), "_pos": F.monotonically_increasing_id(), "_amount": (amount if amount is not None else F.lit(1)).cast("long"), "_group": group})
    )
    laid = checkpoint(laid)
    parts = laid.groupBy("_pid", "_group").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy("_group").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("_pid", "_group").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    out = laid.withColumn("_in", F.coalesce(F.sum("_amount").over(inside), F.lit(0))).alias("l").join(
        parts.alias("p"), (F.col("l._pid") == F.col("p._pid")) & F.col("l._group").eqNullSafe(F.col("p._group"))
    )
    return out.select("l.*", (F.col("_in") + F.col("_before")).alias("_start")).drop("_tie", "_pid", "_pos", "_amount", "_group", "_in")
