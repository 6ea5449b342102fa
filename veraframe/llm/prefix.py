"""Running totals over a whole table without one task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a fine bucket holds on average, and fine buckets to a coarse one.
ROWS, FINE = 256, 1024


def running_offsets(df: DataFrame, group: list[str], order: list[str], value: str, n_rows: int, out: str = "start", spread: list | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group that come before.

    Rows are ordered by (hash bucket of ``spread``, ``order``), which is the same in each run; ``spread`` is ``order``
    unless given. Buckets grow in number with the table, so the windows see about ROWS rows, FINE buckets and, for
    each group, one row per ROWS * FINE rows. ``df`` should be a written table as it is read twice; rows alike in
    group and order are interchangeable.
    """
    buckets = max(1, n_rows // ROWS)
    rows = df.withColumn("_fine", F.pmod(F.xxhash64(*(spread or order)), F.lit(buckets))).withColumn("_coarse", F.floor(F.col("_fine") / FINE))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    fine = rows.groupBy(*group, "_coarse", "_fine").agg(F.sum(value).alias("_total"))
    coarse = fine.groupBy(*group, "_coarse").agg(F.sum("_total").alias("_sum"))
    coarse = coarse.withColumn("_base", F.coalesce(F.sum("_sum").over(before(*group).orderBy("_coarse")), F.lit(0))).drop("_sum")
    fine = fine.withColumn("_in", F.coalesce(F.sum("_total").over(before(*group, "_coarse").orderBy("_fine")), F.lit(0)))
    fine = fine.join(coarse, [*group, "_coarse"]).select(*group, "_coarse", "_fine", (F.col("_base") + F.col("_in")).alias("_off"))
    rows = rows.withColumn("_in", F.coalesce(F.sum(value).over(before(*group, "_coarse", "_fine").orderBy(*order)), F.lit(0)))
    return rows.join(fine, [*group, "_coarse", "_fine"]).withColumn(out, F.col("_off") + F.col("_in")).drop("_fine", "_coarse", "_in", "_off")
