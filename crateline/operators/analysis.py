"""Pooling of analysis results: chunks into tracks, model outputs into tags; and sizing of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pool_chunks(chunks: DataFrame, key: str, weight: str, fields: list[str]) -> DataFrame:
    """(key, fields): weighted means of scalar features over chunks, unknown values left out."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
    means = [F.round(F.sum(F.col(f) * w) / F.sum(F.when(F.col(f).isNotNull(), w)), 6).alias(f) for f in fields]
    return chunks.groupBy(key).agg(*means)


def pool_vectors(chunks: DataFrame, key: str, weight: str | None, vector: str) -> DataFrame:
    """(key, vector): weighted means of vectors, cut to the shortest of each key.

    Positions are summed after exploding, so a key with many chunks is combined
    map-side and never gathered.
    """
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    rows = chunks.where(F.size(vector) > 0).select(F.col(key).alias("key"), w.alias("w"), F.size(vector).alias("n"), F.posexplode(vector).alias("p", "x"))
    sums = rows.groupBy("key", "p").agg(F.sum(F.col("x").cast("double") * F.col("w")).alias("s"), F.sum("w").alias("w"), F.min("n").alias("n"))
    packed = sums.groupBy("key").agg(F.min("n").alias("n"), F.sort_array(F.collect_list(F.struct("p", (F.col("s") / F.col("w")).alias("x")))).alias("v"))
    return packed.select(F.col("key").alias(key), F.slice(F.transform("v", lambda r: F.round(r["x"], 6)), F.lit(1), F.col("n")).alias("vector"))


def best_tags(tags: DataFrame) -> DataFrame:
    """(track_id, source, tag, score): the highest score of each tag."""
    return tags.groupBy("track_id", "source", "tag").agg(F.max("score").alias("score"))


def top_tags(tags: DataFrame, most: int, least: float = 0.0) -> DataFrame:
    """The best tags of each track and source, ties by tag."""
    own = Window.partitionBy("track_id", "source").orderBy(F.desc("score"), "tag")
    ranked = tags.where(F.col("score") >= least).withColumn("rank", F.row_number().over(own))
    return ranked.where(F.col("rank") <= most)


def resource_tier(memory_gb: float) -> str:
    """The tier of a machine by its memory."""
    return "low" if memory_gb < 16 else "balanced" if memory_gb < 24 else "high" if memory_gb < 32 else "full"


def resource_plan(memory_gb: float, cores: int, tier: str = "auto") -> dict[str, int | str]:
    """Batch sizes and workers of a tier (low, balanced, high, full), never more workers than cores allow."""
    tier = resource_tier(memory_gb) if tier == "auto" else tier
    workers = {"low": 1, "balanced": min(3, cores - 1), "high": min(4, cores // 2), "full": min(6, cores // 2)}[tier]
    rank = ("low", "balanced", "high", "full").index(tier)
    return {"tier": tier, "workers": max(1, workers), "embedding_batch": (8, 24, 32, 48)[rank], "tag_batch": (3, 8, 10, 14)[rank], "chunk_seconds": (60, 120, 300, 600)[rank]}
