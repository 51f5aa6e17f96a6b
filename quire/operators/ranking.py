"""Ranks without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def buckets_for(rows: int, per_bucket: int = 20_000, least: int = 16) -> int:
    """How many buckets keep each one's expected size under `per_bucket` rows."""
    return max(least, -(-rows // per_bucket))


def ranked(df: DataFrame, by: list[str], u: Column, order: list[Column], n: int, out: str) -> DataFrame:
    """`df` with the rank (from 0) of each row within `by`, ordered by `order`, which grows with `u` in [0, 1].

    Rows are counted in n buckets of u, counts are added up in order, and rows are ranked within their bucket only, so a group
    that holds a third of all rows is dealt over as many tasks as any other rows."""
    df = df.withColumn("_b", F.coalesce(F.least(F.floor(u * n), F.lit(n - 1)), F.lit(n - 1)).cast("int"))
    counts = df.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_b").alias("_kb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_b") == F.col("_kb")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    local = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order)) - 1
    return df.withColumn("_r", local).join(counts, same).withColumn(out, F.col("_before") + F.col("_r")).drop("_b", "_r", "_kb", "_before", *[f"_k_{c}" for c in by])
