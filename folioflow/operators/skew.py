"""Joins on keys that may repeat for a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_SHARE = 1 / 1000
HEAVY_ROWS = 10_000
SALTS = 64


def heavy_keys(counts: DataFrame, keys: str | Sequence[str], share: float = HEAVY_SHARE,
               floor: int = HEAVY_ROWS, total: DataFrame | None = None) -> DataFrame:
    """Keys that hold more than ``share`` of all rows, and more than ``floor`` rows.

    At most ``1 / share`` keys can, so the result is safe to broadcast whatever
    the size of the data. ``counts`` has one row per key with its count ``n``;
    ``total``, one row with ``_all``, spares adding them up where it is cheaper to come by.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    total = counts.agg(F.sum("n").alias("_all")) if total is None else total  # one row
    limit = F.greatest(F.col("_all") * share, F.lit(floor))
    return counts.join(F.broadcast(total)).where(F.col("n") > limit).select(*keys)


def join_unique(rows: DataFrame, unique: DataFrame, keys: str | Sequence[str], heavy: DataFrame,
                spread_by: Sequence[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join many rows per key with at most one row per key; heavy keys are salted.

    The unique side of a heavy key is repeated once per salt: at most
    ``salts / share`` extra rows. Every row meets exactly one copy, so semi and
    anti joins keep their meaning.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    marked = F.broadcast(heavy.select(*keys).withColumn("_heavy", F.lit(True)))
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    left = rows.join(marked, keys, "left").withColumn(
        "_salt", F.when(F.col("_heavy"), salt).otherwise(0)
    )
    right = unique.join(marked, keys, "left").withColumn(
        "_salt",
        F.explode(F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1)))
                  .otherwise(F.array(F.lit(0)))),
    )
    return left.drop("_heavy").join(right.drop("_heavy"), [*keys, "_salt"], how).drop("_salt")
