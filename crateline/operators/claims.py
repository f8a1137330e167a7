"""Provenance of metadata: competing claims, metadata confidence, and repair from file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateline.functions import text as X

FALLBACK_CONFIDENCE = 0.40
SCORED_FIELDS = ("title", "artist", "album", "genre")


def claim_id(*parts: Column) -> Column:
    """A stable id from the fields of a claim."""
    return F.concat(F.lit("claim_"), F.substring(F.sha1(F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 32))


def best_claims(claims: DataFrame) -> DataFrame:
    """(track_id, field_name, claim, confidence): the claim of highest confidence per field, the latest of equals."""
    usable = claims.where(F.col("track_id").isNotNull() & F.col("field_name").isNotNull() & F.col("value_text").isNotNull())
    order = F.struct(F.coalesce("confidence", F.lit(0.0)), "created_at", "id")
    best = usable.groupBy("track_id", "field_name").agg(F.max_by(F.struct("value_text", "confidence"), order).alias("b"))
    return best.select("track_id", "field_name", F.col("b.value_text").alias("claim"), F.round("b.confidence", 6).alias("confidence"))


def metadata_confidence(tracks: DataFrame, claims: DataFrame) -> DataFrame:
    """(track_id, metadata_confidence): mean over title, artist, album and genre of the best claim that says what the track says."""
    said = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.lower(F.trim(F.col(f))).alias("v")) for f in SCORED_FIELDS]))
    fields = tracks.select(F.col("id").alias("track_id"), said.alias("s")).select("track_id", "s.field_name", "s.v").where(F.col("v") != "")
    backed = claims.where(F.col("confidence").between(0, 1)).select("track_id", "field_name", F.lower(F.trim("value_text")).alias("v"), "confidence")
    best = fields.join(backed, ["track_id", "field_name", "v"]).groupBy("track_id", "field_name").agg(F.max("confidence").alias("c"))
    return best.groupBy("track_id").agg(F.round(F.avg("c"), 6).alias("metadata_confidence"))


def selected_claims(tracks: DataFrame, claims: DataFrame) -> DataFrame:
    """All claims with ``selected`` set anew: per field the best claim that says what the track says, or a fallback claim made from the track."""
    said = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("v")) for f in (*SCORED_FIELDS, "date")]))
    fields = tracks.select(F.col("id").alias("track_id"), said.alias("s")).select("track_id", "s.field_name", F.col("s.v").alias("v"))
    fields = fields.withColumn("n", F.lower(X.strip(F.col("v")))).where(F.col("n") != "")
    base = claims.select("id", "track_id", "field_name", "value_text", "source", "confidence", "created_at").withColumn("n", F.lower(X.strip(F.col("value_text"))))
    agreeing = base.join(fields.drop("v"), ["track_id", "field_name", "n"])
    chosen = agreeing.groupBy("track_id", "field_name").agg(F.max_by("id", F.struct(F.coalesce("confidence", F.lit(0.0)), "created_at", "id")).alias("chosen"))
    kept = base.drop("n").join(chosen, ["track_id", "field_name"], "left")
    kept = kept.withColumn("selected", F.coalesce(F.col("id") == F.col("chosen"), F.lit(False))).drop("chosen")
    orphan = fields.join(chosen, ["track_id", "field_name"], "left_anti")
    made = orphan.select(
        claim_id(F.col("track_id"), F.col("field_name"), F.col("n"), F.lit("existing_database")).alias("id"), "track_id", "field_name", F.col("v").alias("value_text"),
        F.lit("existing_database").alias("source"), F.lit(FALLBACK_CONFIDENCE).alias("confidence"), F.lit(None).cast(base.schema["created_at"].dataType).alias("created_at"),
        F.lit(True).alias("selected"),
    )
    return kept.unionByName(made)


def inferred_metadata(tracks: DataFrame) -> DataFrame:
    """(id, path, artist, title, changed): blanks filled from the file name, with the names of the fields that changed."""
    parsed = X.parsed_title(X.filename(F.col("path")))
    title, artist = X.clean_value(F.col("title")), X.clean_value(F.col("artist"))
    rows = tracks.select("id", "path", title.alias("t"), artist.alias("a"), parsed.alias("p"))
    new_title, new_artist = F.coalesce("t", "p.title", X.filename(F.col("path"))), F.coalesce("a", "p.artist")
    changed = F.array_compact(
        F.array(F.when(~new_artist.eqNullSafe(F.col("a")), F.lit("artist")), F.when(~new_title.eqNullSafe(F.col("t")), F.lit("title")))
    )
    return rows.select("id", "path", new_artist.alias("artist"), new_title.alias("title"), F.array_join(changed, ",").alias("changed"))
