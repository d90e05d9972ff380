"""Numbers of rows in the order of their group, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.sources.tables import scratch


def numbered(df: DataFrame, by: str, *order, name: str = "place") -> DataFrame:
    """Rows with their number from 0 in the order of their group (nulls are one group); a group that fills many partitions is numbered by them side by side.

    Rows are dealt by range and written to the shared folder, since both the counts and the numbers rest on
    where they are.  Rows that are equal in the whole order have numbers in any order among themselves.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "ordered")
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    # a descending key keeps its direction: the range is dealt by it, and windows sort by it again
    df.repartitionByRange(F.col(by), *keys).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    sizes = rows.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy(by).orderBy("_part")) - F.col("_n")).select(F.col(by).alias("_by"), F.col("_part").alias("_p"), "_before")
    local = rows.withColumn("_local", F.row_number().over(W.partitionBy(by, "_part").orderBy(*keys)) - 1)
    both = local.join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")))
    return both.withColumn(name, F.col("_before") + F.col("_local")).drop("_part", "_before", "_local", "_by", "_p")
