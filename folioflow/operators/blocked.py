"""Running computations over groups of any size.

A window partitioned by a group key puts the whole group into one task, and one
document may hold a third of all rows. Every helper here cuts a group into
blocks by a monotone block number, runs the window inside the blocks, and adds
what earlier blocks contribute. The second step only sees one row per block.
Blocks by value (``with_block``) are bounded where order values are spread, such
as positions that occur once; others need blocks by count.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.session import materialize

BLOCK = "_block"
BLOCK_SPAN = 1 << 16


def with_block(df: DataFrame, order: Column, span: int = BLOCK_SPAN) -> DataFrame:
    """Add the block number of a numeric order value."""
    return df.withColumn(BLOCK, F.floor(order / span))


def with_counted_block(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = BLOCK_SPAN) -> DataFrame:
    """Add block numbers so that a block holds about ``rows`` rows, however dense the order values are.

    The rows are range-partitioned by group and order, so a large group spreads
    over neighbouring partitions and these are its blocks. They are written
    out, which fixes the partition of each row.
    """
    parts = max(1, -(-df.count() // rows))
    dealt = df.repartitionByRange(parts, *keys, *order).withColumn(BLOCK, F.spark_partition_id().cast("bigint"))
    return materialize(dealt, "blocks")


def _carry(df: DataFrame, keys: Sequence[str], block_value: Column, over_blocks: Column,
           default: Column | None) -> DataFrame:
    """Per (keys, block): an aggregate of all earlier blocks."""
    blocks = df.groupBy(*keys, BLOCK).agg(block_value.alias("_value"))
    earlier = (
        Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = over_blocks.over(earlier)
    return blocks.select(
        *keys, BLOCK, (carried if default is None else F.coalesce(carried, default)).alias("_carry")
    )


def _inside(keys: Sequence[str], order: Sequence) -> Window:
    return Window.partitionBy(*keys, BLOCK).orderBy(*order)


def row_number(df: DataFrame, keys: Sequence[str], order: Sequence, out: str) -> DataFrame:
    """1-based position within the keys; ``df`` must carry block numbers."""
    before = _carry(df, keys, F.count("*"), F.sum("_value"), F.lit(0).cast("bigint"))
    return (
        df.join(before, [*keys, BLOCK])
        .withColumn(out, F.row_number().over(_inside(keys, order)) + F.col("_carry"))
        .drop("_carry")
    )


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence, value: Column, out: str,
                totals: dict[str, Column] | None = None) -> DataFrame:
    """Sum of ``value`` up to and including each row.

    ``totals`` names additive aggregates of the whole group that every row gets
    along with its carry, so no join on the (possibly hot) group key is needed.
    """
    totals = totals or {}
    df = df.withColumn("_term", value)
    blocks = df.groupBy(*keys, BLOCK).agg(
        F.sum("_term").alias("_value"), *[t.alias(name) for name, t in totals.items()]
    )
    group = Window.partitionBy(*keys)
    earlier = group.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(
        *keys, BLOCK, F.coalesce(F.sum("_value").over(earlier), F.lit(0)).alias("_carry"),
        *[F.sum(name).over(group).alias(name) for name in totals],
    )
    window = _inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.join(before, [*keys, BLOCK])
        .withColumn(out, F.sum("_term").over(window) + F.col("_carry"))
        .drop("_carry", "_term")
    )


def running_max_before(df: DataFrame, keys: Sequence[str], order: Sequence, value: Column,
                       out: str) -> DataFrame:
    """Greatest ``value`` of the earlier rows; NULL on a group's first row."""
    df = df.withColumn("_term", value)
    before = _carry(df, keys, F.max("_term"), F.max("_value"), None)
    window = _inside(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(before, [*keys, BLOCK])
        .withColumn(out, F.greatest(F.max("_term").over(window), F.col("_carry")))
        .drop("_carry", "_term")
    )


def break_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
               is_break: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """Number the runs of rows between breaks, from 0.

    ``is_break(before, here)`` compares the values of neighbouring rows. Breaks
    are counted inside the blocks; the break at a block's border is found from
    the last value of the block before, so one step over blocks is enough.
    """
    inside = _inside(keys, order)

    def flag(before: Column, here: Column) -> Column:
        return F.coalesce(is_break(before, here), F.lit(False)).cast("bigint")

    local = df.withColumn("_v", value).withColumn("_before", F.lag("_v").over(inside))
    local = local.withColumn("_flag", flag(F.col("_before"), F.col("_v")))
    place = F.struct(*order)
    blocks = local.groupBy(*keys, BLOCK).agg(
        F.min_by("_v", place).alias("_first"), F.max_by("_v", place).alias("_last"),
        F.sum("_flag").alias("_breaks"),
    )
    over_keys = Window.partitionBy(*keys).orderBy(BLOCK)
    earlier = over_keys.rowsBetween(Window.unboundedPreceding, -1)
    border = blocks.withColumn("_border", flag(F.lag("_last").over(over_keys), F.col("_first")))
    carried = border.select(
        *keys, BLOCK,
        (F.coalesce(F.sum(F.col("_breaks") + F.col("_border")).over(earlier), F.lit(0))
         + F.col("_border")).alias("_carry"),
    )
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        local.join(carried, [*keys, BLOCK])
        .withColumn(out, F.sum("_flag").over(upto) + F.col("_carry"))
        .drop("_v", "_before", "_flag", "_carry")
    )
