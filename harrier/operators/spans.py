"""Sums along one order of a whole table, without one task that has it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrier.operators.graph import step_table


def running_total(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """df with name: the sum of value over the row and all before it. Rows are ordered by a range shuffle and written once;
    what goes through one task are the sums of the written parts, a row each. order must tell rows apart."""
    ordered = df.withColumn("_v", value).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    held = step_table(df.sparkSession, ordered, "ordered")
    sums = held.groupBy("_part").agg(F.sum("_v").alias("_s"))
    before = sums.select("_part", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum("_v").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_own")).select(*df.columns, name)
