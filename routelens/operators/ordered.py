"""Order-dependent helpers that stay parallel inside a hot key.

A window ``PARTITION BY key ORDER BY seq`` sorts every row of a key in one
task; if one run or job holds a third of all rows that task holds a third of
the data. These helpers cut each key's rows into order-preserving blocks
(``seq // block_width``): per-block counts/sums give each block its offset
(a window over blocks only - a handful of rows per block), and the per-row
work is a window inside a block. Results are identical to the plain window,
also for null keys (a group of their own) and a null order (a block of its own, first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 4096


def join_per_key(df: DataFrame, per: DataFrame, keys) -> DataFrame:
    """``df`` with the columns of ``per``, which has one row per ``keys``; null keys meet each other."""
    right = per.withColumnsRenamed({k: f"__per_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__per_{k}")) for k in keys]
    return df.join(right, on).drop(*(f"__per_{k}" for k in keys))


def _block(order_col: str, width: int) -> Column:
    return F.floor(F.col(order_col) / F.lit(width)).cast("long")


def blocked_rank(df: DataFrame, keys, order_col: str, out: str = "rk", width: int = DEFAULT_BLOCK) -> DataFrame:
    """1-based row number by ``order_col`` within ``keys`` (``order_col`` unique per key)."""
    keys = list(keys)
    d = df.withColumn("__blk", _block(order_col, width))
    per = d.groupBy(*keys, "__blk").agg(F.count(F.lit(1)).alias("__n"))
    wb = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__off", F.coalesce(F.sum("__n").over(wb), F.lit(0))).drop("__n")
    w = Window.partitionBy(*keys, "__blk").orderBy(order_col)
    return (join_per_key(d, per, [*keys, "__blk"]).withColumn(out, F.row_number().over(w) + F.col("__off"))
            .drop("__blk", "__off"))


def blocked_running_sum(df: DataFrame, keys, order_col: str, value: str, out: str, exclusive: bool = False,
                        width: int = DEFAULT_BLOCK) -> DataFrame:
    """Running sum of ``value`` in ``order_col`` order within ``keys``; ``exclusive``
    leaves out the current row (sum of the earlier rows, 0 for the first).
    """
    keys = list(keys)
    end = -1 if exclusive else 0
    d = df.withColumn("__blk", _block(order_col, width))
    per = d.groupBy(*keys, "__blk").agg(F.sum(value).alias("__s"))
    wb = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__off", F.coalesce(F.sum("__s").over(wb), F.lit(0))).drop("__s")
    w = Window.partitionBy(*keys, "__blk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, end)
    inner = F.coalesce(F.sum(value).over(w), F.lit(0))
    return join_per_key(d, per, [*keys, "__blk"]).withColumn(out, inner + F.col("__off")).drop("__blk", "__off")


def blocked_lag(df: DataFrame, keys, order_col: str, col: str, out: str, width: int = DEFAULT_BLOCK) -> DataFrame:
    """Value of ``col`` on the previous row in ``order_col`` order within ``keys``."""
    keys = list(keys)
    d = df.withColumn("__blk", _block(order_col, width))
    last = d.groupBy(*keys, "__blk").agg(F.max_by(col, F.struct(order_col)).alias("__last"))
    wb = Window.partitionBy(*keys).orderBy("__blk")
    prev = last.withColumn("__pblk", F.lag("__last").over(wb)).drop("__last")
    w = Window.partitionBy(*keys, "__blk").orderBy(order_col)
    inner = F.lag(col).over(w)
    first = F.row_number().over(w) == 1
    return (join_per_key(d, prev, [*keys, "__blk"])
            .withColumn(out, F.when(first, F.col("__pblk")).otherwise(inner)).drop("__blk", "__pblk"))
