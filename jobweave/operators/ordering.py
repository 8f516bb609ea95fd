"""Ranks and running totals over groups of any size.

A window partitioned by group puts a whole group into one task. Here the rows
are range-partitioned by (group, order), summed inside each range, and shifted
by the totals of the ranges before it, so a group that holds a third of all
rows is spread over a third of the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.session import shuffle_width, stage

RANK_BLOCK = 8192


def running_total(
    df: DataFrame, keys: list[str], order: list[str], weight: Column, name: str, ranges: Column | None = None
) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over the rows of the group up to this one.

    ``order`` must be a total order within a group. ``ranges`` may give a number
    that never falls along the order and has few rows per value; without it the
    rows are sampled and range-partitioned.
    """
    spread = df.withColumn("_weight", weight.cast("long"))
    if ranges is None:
        width = shuffle_width(df.sparkSession)
        spread = spread.repartitionByRange(width, *keys, *order).withColumn("_range", F.spark_partition_id())
    else:
        spread = spread.withColumn("_range", ranges)
    spread = stage(spread, "ranges")  # range bounds are sampled: fix them before using them twice
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        spread.groupBy("_range", *keys)
        .agg(F.sum("_weight").alias("_total"))
        .select("_range", *keys, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_shift"))
    )
    return (
        spread.withColumn("_inside", F.sum("_weight").over(inside))
        .join(shift, ["_range", *keys])
        .withColumn(name, F.col("_inside") + F.col("_shift"))
        .drop("_weight", "_inside", "_shift", "_range")
    )


def rank_rows(
    df: DataFrame, keys: list[str], order: list[str], name: str = "rank", ranges: Column | None = None
) -> DataFrame:
    """1-based position of each row in its group.

    Rows are sorted where the range shuffle puts them and numbered as they are
    written; the smallest number of a group in each range and the rows of the
    ranges before it turn that into the position, without another shuffle of the rows.
    """
    if ranges is not None:
        return running_total(df, keys, order, F.lit(1), name, ranges)
    sorted_rows = df.repartitionByRange(shuffle_width(df.sparkSession), *keys, *order).sortWithinPartitions(*keys, *order)
    rows = stage(sorted_rows.withColumns({"_range": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}), "ranges")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        rows.groupBy("_range", *keys)
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_total"))
        .select("_range", *keys, (F.coalesce(F.sum("_total").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    )
    return rows.join(shift, ["_range", *keys]).withColumn(name, F.col("_id") + F.col("_shift")).drop("_id", "_shift", "_range")


def rank_block(rank: str) -> Column:
    """Block of consecutive ranks a row lies in."""
    return F.floor(F.col(rank) / RANK_BLOCK)


def with_blocks(ranked: DataFrame, rank: str, reach: int) -> DataFrame:
    """Add ``_block``, a block of consecutive ranks; rows within ``reach`` of a cut are copied to both sides.

    A window over one block then sees all rows at most ``reach`` ranks away.
    ``own_block`` keeps one copy of each row afterwards.
    """
    at = F.col(rank)
    return ranked.withColumn(
        "_block", F.explode(F.array_distinct(F.array(*[F.floor(r / RANK_BLOCK) for r in (at - reach, at, at + reach)])))
    )


def own_block(rank: str) -> Column:
    return F.col("_block") == rank_block(rank)


def with_neighbours(ranked: DataFrame, keys: list[str], rank: str, value: str, reach: int, name: str) -> DataFrame:
    """Add ``name``: the values of the rows at most ``reach`` ranks away, the row's own included."""
    window = Window.partitionBy(*keys, "_block").orderBy(rank)
    near = [F.lag(value, i).over(window) for i in range(reach, 0, -1)] + [F.col(value)]
    near += [F.lead(value, i).over(window) for i in range(1, reach + 1)]
    return (
        with_blocks(ranked, rank, reach)
        .withColumn(name, F.array_compact(F.array(*near)))
        .where(own_block(rank))
        .drop("_block")
    )


def top_rows(df: DataFrame, keys: list[str], order: list[Column], limit: int, name: str = "rank") -> DataFrame:
    """First ``limit`` rows of every group.

    The filter on ``row_number`` lets Spark cut each map-side part to ``limit``
    rows per group before the shuffle, so hot groups stay small.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= limit)
