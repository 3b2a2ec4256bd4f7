"""Numbers of rows in an order, without bringing all rows of a key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, by: list[str], bucket: Column, order: list[str], out: str = "t") -> DataFrame:
    """df with column out: 0, 1, ... for the rows of each `by` in this order.

    bucket is an expression that never falls as the order goes on (a day of a timestamp, an id by thousands): rows are numbered within their bucket, and
    only the counts of the buckets are added up in order.  Nothing depends on how rows are partitioned, so a lost task gives the same numbers again.
    The order must be total.
    """
    key = [*by, "__bucket"]
    rows = df.withColumn("__bucket", bucket)
    counts = rows.groupBy(*key).agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*by, F.lit(0)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*(F.col(k).alias(f"__{i}") for i, k in enumerate(key)), F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    inner = rows.withColumn("__t", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)
    both = inner.join(before, [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(key)])
    return both.select(*df.columns, (F.col("__t") + F.col("__before")).cast("long").alias(out))
