"""Joins and numbering that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one row in this many; so there can be no more hot keys than this.
HOT_PARTS = 64

#: Below this many rows no key can make a task long, and looking for hot ones would cost more than it saves.
MIN_ROWS = 200_000


def hot_keys(df: DataFrame, key: str, parts: int = HOT_PARTS, min_rows: int | None = None) -> list:
    """The keys that hold more than ``1/parts`` of the rows: fewer than ``parts`` of them, whatever the data.

    Counted with map-side combining, so a hot key costs one row per partition.
    """
    if df.count() < (MIN_ROWS if min_rows is None else min_rows):
        return []
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total, most = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    if total < 10 * parts or most * parts <= total:
        return []
    return [r[0] for r in counts.where(F.col("_n") * parts > total).select(key).collect()]


def lookup(
    df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, out: str, hot: list | None = None
) -> DataFrame:
    """``df`` with column ``out``: ``table``'s ``value`` where ``table_key`` equals ``key``, else NULL.

    ``table_key`` is unique in ``table``. Rows of hot keys are joined to the
    broadcast rows of those keys, at most ``HOT_PARTS``, and are not shuffled by
    their key; all others are joined as usual. ``hot`` may bring the hot keys if they are known.
    """
    hot = hot_keys(df, key) if hot is None else hot
    right = table.select(F.col(table_key).alias("_lookup_key"), F.col(value).alias(out))
    if not hot:
        return df.join(right, F.col(key) == F.col("_lookup_key"), "left").drop("_lookup_key")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = df.where(~is_hot).join(right, F.col(key) == F.col("_lookup_key"), "left")
    # table_key is unique, so at most HOT_PARTS rows are sent to the tasks
    few = F.broadcast(right.where(F.col("_lookup_key").isin(hot)))
    warm = df.where(is_hot).join(few, F.col(key) == F.col("_lookup_key"), "left")
    return cold.unionByName(warm).drop("_lookup_key")
