"""Global positions, and the spreading of inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.session import cut_lineage


def with_position(df: DataFrame, order: list[Column], out: str = "position") -> DataFrame:
    """Number all rows 1..n in the given total order without gathering them in one task.

    The rows are range-partitioned and sorted, numbered inside their partition, and shifted by
    the sizes of the partitions before them. The sorted rows are checkpointed because both uses
    must see the same partition borders, also after an executor is lost. The offsets have one
    row per shuffle partition, so broadcasting them is bounded.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slot = F.monotonically_increasing_id()
    rows = cut_lineage(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_slot", slot))
    part = F.shiftright("_slot", 33).alias("_part")
    sizes = rows.groupBy(part).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        rows.withColumn("_part", F.shiftright("_slot", 33))
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + inside + 1)
        .drop("_part", "_offset", "_slot"))


#: Partitions for each task that runs at a time.
WAVES = 4


def spread(df: DataFrame, small: bool = False) -> DataFrame:
    """Deal a table to as many partitions as the session asks for in ``spark.sievemark.partitions``.

    For inputs of few large row groups on few machines; without the setting the splits of the files
    stay as they are, which is right for every large input. The exception are ``small`` rows, of which much larger
    ones are made: their files have few splits for the work that follows, so they are dealt anew for all tasks.
    """
    partitions = df.sparkSession.conf.get("spark.sievemark.partitions", None)
    if partitions is None and small:
        partitions = WAVES * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(int(partitions)) if partitions else df
