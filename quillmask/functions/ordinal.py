"""Numbers for rows in a total order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_ordinal(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``, 1 to n by ``order`` (nulls last): ranks within hash-free ranges, plus the ranges' counts.

    The range partitions are as many as the session's shuffle partitions; their counts, one row each, are summed.
    """
    by = [F.col(c).asc_nulls_last() for c in order]
    ranged = df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id())
    ranked = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*by))).persist()  # read twice; the session drops it when it needs the room
    sizes = sorted((r["_part"], r["count"]) for r in ranked.groupBy("_part").count().collect())
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "_part int, _before long")
    return ranked.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_rank") + F.col("_before")).drop("_part", "_rank", "_before")
