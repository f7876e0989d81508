"""Row numbering within a key that stays balanced when one key is huge.

``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one task; with a key
holding a third of all rows that task holds a third of the data.  Here the order is cut into
slices first (``slice`` must grow with the order), rows are numbered within (key, slice), and the counts of a
key's earlier slices are added.  Only those counts, one row per (key, slice), meet per key.
Built-in functions only, and the numbers depend on the rows alone, not on the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_within(df: DataFrame, key: str, order: list[str], name: str, slice: Column) -> DataFrame:
    """Add ``name`` = 1-based row number of each row within ``key`` ordered by ``order``.

    ``order`` should identify a row; ``slice`` never decreases along it.  Null keys form a key of their own.
    """
    cut = df.withColumn("_slice", slice)
    local = Window.partitionBy(key, "_slice").orderBy(*order)
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(F.col(key).alias("_key"), F.col("_slice").alias("_at"),
                            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = cut[key].eqNullSafe(F.col("_key")) & F.col("_slice").eqNullSafe(F.col("_at"))
    numbered = cut.withColumn("_local", F.row_number().over(local)).join(offsets, same)
    return numbered.select(*df.columns, (F.col("_local") + F.col("_before")).alias(name))
