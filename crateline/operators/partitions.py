"""Spreading rows over the cluster before work that costs far more than the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str, per_core: int = 3) -> DataFrame:
    """``df`` hash-partitioned by ``keys`` if its scan gives fewer partitions than the cluster has work for.

    A large table already comes in many splits and is left as it is; a small
    one would keep most cores idle. ``keys`` should be unique, so that the
    partitions are even and the same after a retry.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(per_core * cores, *keys)


def parallel(df: DataFrame, *keys: str, per_core: int = 3) -> DataFrame:
    """``df`` hash-partitioned by ``keys`` over all cores, for rows that are few bytes but much work.

    An explicit number keeps adaptive execution from joining the small
    partitions into one; larger tables keep the session's shuffle width.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(max(width, per_core * df.sparkSession.sparkContext.defaultParallelism), *keys)
