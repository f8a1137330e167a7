"""Library statistics and index health: tag statistics, percentiles, coverage and state counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateline.functions import numeric as N

PERCENTILES = (0.25, 0.35, 0.45, 0.55, 0.65, 0.70, 0.75)
PERCENTILE_FIELDS = ("energy", "danceability", "aggression", "brightness")


def tag_statistics(tags: DataFrame) -> DataFrame:
    """(tag, tracks, avg_score, max_score, sources) per tag."""
    return tags.groupBy("tag").agg(
        F.count(F.lit(1)).alias("tracks"),
        F.round(F.avg("score"), 6).alias("avg_score"),
        F.round(F.max("score"), 6).alias("max_score"),
        F.concat_ws(",", F.sort_array(F.collect_set("source"))).alias("sources"),
    )


def feature_percentiles(features: DataFrame, fields: tuple[str, ...] = PERCENTILE_FIELDS) -> DataFrame:
    """(field, n, lowest, p25..p75, highest): exact percentiles by linear interpolation, perceived tempo among them."""
    values = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields],
        F.struct(F.lit("tempo_bpm").alias("field"), N.perceived_tempo(F.col("bpm")).alias("v")),
    )
    long = features.select(F.explode(values).alias("x")).select("x.field", "x.v").where(F.col("v").isNotNull() & ~F.isnan("v"))
    ranks = F.percentile("v", list(PERCENTILES)).alias("p")
    out = long.groupBy("field").agg(F.count("v").alias("n"), F.round(F.min("v"), 6).alias("lowest"), ranks, F.round(F.max("v"), 6).alias("highest"))
    points = [F.round(F.col("p")[i], 6).alias(f"p{round(q * 100)}") for i, q in enumerate(PERCENTILES)]
    return out.select("field", "n", "lowest", *points, "highest")


def state_counts(tracks: DataFrame) -> DataFrame:
    """One row: how many tracks there are in all, active, missing, failed and quarantined."""
    gone, held = F.col("missing_at").isNotNull(), F.col("quarantined_at").isNotNull()
    return tracks.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~gone & ~held).alias("active"),
        F.count_if(gone).alias("missing"),
        F.count_if(F.col("error_count") > 0).alias("failed"),
        F.count_if(held).alias("quarantined"),
    )


def coverage(tracks: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """(part, total_rows, covered, active, share): how many active tracks have a row in each derived table."""
    base = tracks.where(F.col("missing_at").isNull() & F.col("quarantined_at").isNull()).select(F.col("id").alias("track_id"))
    active = base.agg(F.count(F.lit(1)).alias("active"))
    out = None
    for name, rows in parts.items():
        joined = rows.select("track_id").join(base, "track_id", "left_semi")
        one = rows.agg(F.count(F.lit(1)).alias("total_rows")).crossJoin(joined.agg(F.count_distinct("track_id").alias("covered"))).crossJoin(active)
        one = one.select(F.lit(name).alias("part"), "total_rows", "covered", "active", F.round(N.ratio(F.col("covered"), F.col("active")), 6).alias("share"))
        out = one if out is None else out.unionByName(one)
    return out


def profile_health(profiles: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: how many stored profiles (track_id, source_fingerprint) are current, stale or absent."""
    now = profiles.select("track_id", F.col("source_fingerprint").alias("now"))
    then = stored.select("track_id", F.col("source_fingerprint").alias("stored"))
    return now.join(then, "track_id", "left").agg(
        F.count(F.lit(1)).alias("profiles"),
        F.count_if(F.col("stored") == F.col("now")).alias("current"),
        F.count_if(F.col("stored") != F.col("now")).alias("stale"),
        F.count_if(F.col("stored").isNull()).alias("absent"),
    )


def embedding_staleness(texts: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """(track_id, state): whether the stored embedding of (track_id, text) was made from the current text."""
    kept = stored.where(F.col("model") == model).select("track_id", F.col("text").alias("_stored"), F.lit(True).alias("_has"))
    state = F.when(F.col("_has").isNull(), "absent").when(F.col("text").eqNullSafe(F.col("_stored")), "current").otherwise("stale")
    return texts.join(kept, "track_id", "left").select("track_id", state.alias("state"))


def health_warnings(counts: dict[str, int], shares: dict[str, float]) -> list[str]:
    """Warning codes of a health report from its figures."""
    warnings = []
    if counts.get("total", 0) == 0:
        return ["no_tracks"]
    if counts.get("active", 0) == 0:
        warnings.append("no_active_tracks")
    warnings += [f"{k}_tracks" for k in ("missing", "failed", "quarantined") if counts.get(k, 0)]
    for part, share in sorted(shares.items()):
        if share == 0:
            warnings.append(f"no_{part}")
        elif share < 1:
            warnings.append(f"partial_{part}")
    return warnings
