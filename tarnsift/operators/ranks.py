"""Ranks over a whole table without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, order: list[str], at: str, written: str) -> DataFrame:
    """rows with their number from 1 in the order of columns order, as the column at. Rows are dealt to ranges of the order and written to
    the folder written; each range is numbered by itself, after the rows of the ranges before it."""
    spark = rows.sparkSession
    rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(written)
    dealt = spark.read.parquet(written)
    before, starts = 0, []
    for part, n in sorted((r["_range"], r["n"]) for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect()):  # one row a range
        starts.append((part, before))
        before += n
    within: Column = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    offsets = F.broadcast(spark.createDataFrame(starts, "_range int, _before long"))
    return dealt.withColumn("_within", within).join(offsets, "_range").withColumn(at, F.col("_before") + F.col("_within")).drop("_range", "_before", "_within")
