"""Global order without a window over all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import write_table


def number_rows(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df with the number of each row, from 1, in a total order of all rows. Names of `df` must not be `__at` or `__range`.

    Rows are dealt by ranges of the order and sorted there; a row's number is its place in its range and the sizes of the ranges
    before it, of which there are as many as shuffle partitions.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the number that Spark gives holds the range above bit 33 and the place in it below; writing fixes both
    placed = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    held = write_table(placed, "ranges").withColumn("__range", F.shiftright("__at", 33))
    before, rows = 0, []
    for r in held.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect():
        rows.append((r["__range"], before))
        before += r["n"]
    starts = spark.createDataFrame(rows, "__range long, __before long")
    numbered = held.join(F.broadcast(starts), "__range")  # a row for each range
    return numbered.withColumn(name, (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int")).drop("__range", "__at", "__before")
