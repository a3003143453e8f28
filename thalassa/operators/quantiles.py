"""Exact quantiles of groups of any size: ranks by ranges of values, so that no task sees all rows of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thalassa.sources.tables import stored


def quantiles(df: DataFrame, by: list[str], x: str, shares: dict[str, float]) -> DataFrame:
    """by and a column per share: the value at that share of a group's sorted values, on the line between neighbours.

    Rows are counted per distinct value first; counts are dealt by ranges of (by, value), summed per range and then
    within it. Null and NaN take no part; groups without values have no row.
    """
    spark = df.sparkSession
    v = F.col(x).cast("double")
    counts = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, v.alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written, not only planned, as two scans have to see the same ranges
    ranged = stored(counts.repartitionByRange(parts, *by, "_x").withColumn("_p", F.spark_partition_id()))
    over = Window.partitionBy(*by)
    sums = ranged.groupBy(*by, "_p").agg(F.sum("_n").alias("_t"))
    sums = sums.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_p").alias("_q"), (F.sum("_t").over(over.orderBy("_p")) - F.col("_t")).alias("_before"), F.sum("_t").over(over).alias("_all"))
    within = ranged.withColumn("_c", F.sum("_n").over(Window.partitionBy(*by, "_p").orderBy("_x")))
    ranks = within.join(sums, [F.col("_p") == F.col("_q"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]])
    ranks = ranks.withColumn("_hi", F.col("_before") + F.col("_c") - 1).withColumn("_lo", F.col("_hi") - F.col("_n") + 1)
    out = []
    for name, share in shares.items():
        at = F.lit(float(share)) * (F.col("_all") - 1)
        value = lambda r: F.max(F.when((F.col("_lo") <= r) & (F.col("_hi") >= r), F.col("_x")))
        low, high, rest = value(F.floor(at)), value(F.ceil(at)), F.max(at - F.floor(at))
        out.append((low + (high - low) * rest).alias(name))
    return ranks.groupBy(*by).agg(*out)
