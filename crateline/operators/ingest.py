"""Incremental ingestion: snapshot diff, invalidation, quarantine, pruning and upserts as joins of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUARANTINE_AFTER = 3

#: The columns that a changed file makes stale.
STALE_COLUMNS = (
    "content_hash", "chromaprint", "fingerprint_duration", "title", "artist", "album", "album_artist", "genre", "date", "track_number",
    "disc_number", "duration_sec", "codec", "sample_rate", "bit_rate", "channels", "artist_title_norm", "analyzed_at",
)


def scan_diff(snapshot: DataFrame, state: DataFrame) -> DataFrame:
    """(path, status): added, modified, unchanged, returned or missing, from a snapshot (path, file_size, file_mtime_ns) and the stored rows."""
    new = snapshot.select("path", F.col("file_size").alias("s1"), F.col("file_mtime_ns").alias("m1"), F.lit(True).alias("seen"))
    old = state.select("path", F.col("file_size").alias("s0"), F.col("file_mtime_ns").alias("m0"), F.col("missing_at").isNotNull().alias("gone"), F.lit(True).alias("known"))
    both = old.join(new, "path", "full_outer")
    changed = ~(F.col("s0").eqNullSafe(F.col("s1")) & F.col("m0").eqNullSafe(F.col("m1")))
    status = (
        F.when(F.col("known").isNull(), "added").when(F.col("seen").isNull() & F.col("gone"), "still_missing").when(F.col("seen").isNull(), "missing")
        .when(changed, "modified").when(F.col("gone"), "returned").otherwise("unchanged")
    )
    return both.select("path", status.alias("status"))


def scan_summary(diff: DataFrame) -> DataFrame:
    """(status, files)."""
    return diff.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def mark_missing(state: DataFrame, diff: DataFrame, at: Column) -> DataFrame:
    """The stored rows with ``missing_at`` set where the file is gone and cleared where it is back."""
    rows = state.join(diff, "path", "left")
    when = F.when(F.col("status") == "missing", at).when(F.col("status").isin("returned", "modified", "unchanged"), None).otherwise(F.col("missing_at"))
    return rows.withColumn("missing_at", when.cast(state.schema["missing_at"].dataType)).drop("status")


def invalidate(state: DataFrame, diff: DataFrame) -> DataFrame:
    """The stored rows with everything derived from the file emptied where the file changed, failures forgiven."""
    changed = diff.where(F.col("status") == "modified").select("path", F.lit(True).alias("_changed"))
    rows = state.join(changed, "path", "left")
    stale = F.coalesce(F.col("_changed"), F.lit(False))
    emptied = {c: F.when(~stale, F.col(c)) for c in STALE_COLUMNS if c in state.columns}
    emptied["error_count"] = F.when(stale, 0).otherwise(F.col("error_count")).cast(state.schema["error_count"].dataType)
    emptied["quarantined_at"] = F.when(~stale, F.col("quarantined_at"))
    return rows.withColumns(emptied).drop("_changed")


def drop_derived(derived: DataFrame, key: str, state: DataFrame, diff: DataFrame) -> DataFrame:
    """A derived table without the rows of changed files."""
    changed = state.join(diff.where(F.col("status") == "modified"), "path", "left_semi").select(F.col("id").alias(key))
    return derived.join(changed, key, "left_anti")


def apply_outcomes(state: DataFrame, outcomes: DataFrame, at: Column) -> DataFrame:
    """The stored rows after outcomes (id, failed): failures count up to quarantine, success clears both."""
    last = outcomes.groupBy("id").agg(F.count_if("failed").alias("_failures"), F.bool_or(~F.col("failed")).alias("_ok"))
    rows = state.join(last, "id", "left")
    count = F.when(F.col("_ok"), 0).otherwise(F.coalesce("error_count", F.lit(0)) + F.coalesce("_failures", F.lit(0)))
    held = F.when(F.col("_ok"), None).when((count >= QUARANTINE_AFTER) & F.col("quarantined_at").isNull(), at).otherwise(F.col("quarantined_at"))
    touched = F.col("_failures").isNotNull()
    return rows.withColumns(
        {
            "error_count": F.when(touched, count).otherwise(F.col("error_count")).cast(state.schema["error_count"].dataType),
            "quarantined_at": F.when(touched, held.cast(state.schema["quarantined_at"].dataType)).otherwise(F.col("quarantined_at")),
        }
    ).drop("_failures", "_ok")


def prune_missing(tracks: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """All tables without the missing tracks and their rows elsewhere; the dead ids are joined, never collected."""
    dead = tracks.where(F.col("missing_at").isNotNull()).select(F.col("id").alias("_dead"))
    out = {"tracks": tracks.where(F.col("missing_at").isNull())}
    for name, (rows, key) in children.items():
        out[name] = rows.join(dead, F.col(key) == F.col("_dead"), "left_anti")
    return out


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row per key of both tables, by ``order``; a change wins over an equal stored row.

    One aggregation with map-side combining, no window and no sort.
    """
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "_new"]
    latest = F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order], F.col("_new"), F.xxhash64(*rest)))
    return both.groupBy(*keys).agg(latest.alias("_row")).select(*keys, "_row.*")


def replace_source(current: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Delete-then-insert: rows whose keys are delivered anew are dropped, then the new rows added."""
    return current.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)
