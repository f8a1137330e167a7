"""Browsing and work selection over the track table: pages, folders, counts and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateline.functions.text import browse_terms

#: Sortable columns of a page.
TEXT_SORTS = ("title", "artist", "album", "genre", "path")
NUMBER_SORTS = ("duration_sec", "bpm", "energy")

LISTED = ("title", "artist", "album", "album_artist", "genre", "path")


def live(tracks: DataFrame, include_missing: bool = False) -> DataFrame:
    """Rows whose file is present."""
    return tracks if include_missing else tracks.where(F.col("missing_at").isNull())


def active(tracks: DataFrame) -> DataFrame:
    """Rows that are present and not quarantined."""
    return tracks.where(F.col("missing_at").isNull() & F.col("quarantined_at").isNull())


def under_folder(path: Column, folder: str) -> Column:
    """Whether a path is a folder or lies in it; the folder's characters are taken literally."""
    folder = folder.rstrip("/")
    return (path == folder) | path.startswith(folder + "/")


def matches_terms(query: str) -> Column:
    """Whether every term of a browse query stands somewhere in the listed columns."""
    text = F.lower(F.concat_ws(" ", *[F.col(c) for c in LISTED]))
    hit = F.lit(True)
    for term in browse_terms(query):
        hit = hit & F.contains(text, F.lit(term))
    return hit


def sort_columns(key: str, descending: bool = False) -> list[Column]:
    """The ordering of a page: folded text, or numbers with unknown ones last; ties by title and path."""
    if key in TEXT_SORTS:
        column = F.lower(F.coalesce(F.col(key), F.lit("")))
        first = [column.desc() if descending else column.asc()]
    elif key in NUMBER_SORTS:
        first = [F.col(key).isNull().asc(), F.col(key).desc() if descending else F.col(key).asc()]
    else:
        raise ValueError(f"cannot sort by {key}")
    return [*first, F.lower(F.coalesce(F.col("title"), F.lit(""))).asc(), F.col("path").asc()]


def page(
    tracks: DataFrame, query: str = "", folder: str | None = None, sort: str = "title", descending: bool = False,
    limit: int = 200, offset: int = 0, include_missing: bool = False,
) -> DataFrame:
    """One page of tracks; ``limit`` is kept within 1..500."""
    rows = live(tracks, include_missing)
    if folder:
        rows = rows.where(under_folder(F.col("path"), folder))
    if query.strip():
        rows = rows.where(matches_terms(query))
    return rows.orderBy(*sort_columns(sort, descending)).offset(max(0, offset)).limit(max(1, min(500, limit)))


def child_folders(tracks: DataFrame, folder: str, include_missing: bool = False) -> DataFrame:
    """(name, tracks): the folders right below a folder with how many tracks they hold at any depth."""
    prefix = folder.rstrip("/") + "/"
    inside = live(tracks, include_missing).where(F.col("path").startswith(prefix))
    rest = F.substring(F.col("path"), len(prefix) + 1, 1_000_000)
    parts = F.split(rest, "/")
    deep = inside.where(F.size(parts) > 1)
    return deep.groupBy(F.get(parts, F.lit(0)).alias("name")).agg(F.count(F.lit(1)).alias("tracks"))


def root_counts(roots: DataFrame, tracks: DataFrame, include_missing: bool = False) -> DataFrame:
    """(id, path, tracks): every root with its number of tracks, empty ones too."""
    counts = live(tracks, include_missing).groupBy("root_id").agg(F.count(F.lit(1)).alias("n"))
    joined = roots.join(counts, roots["id"] == counts["root_id"], "left")
    return joined.select("id", "path", F.coalesce("n", F.lit(0)).alias("tracks"))


def failed_tracks(tracks: DataFrame) -> DataFrame:
    """Tracks with failures or in quarantine, quarantined ones first, then by failures."""
    bad = tracks.where((F.col("error_count") > 0) | F.col("quarantined_at").isNotNull())
    return bad.orderBy(F.col("quarantined_at").isNull().asc(), F.desc("error_count"), F.asc("path"))


def missing_tracks(tracks: DataFrame, roots: DataFrame, root: str | None = None) -> DataFrame:
    """Missing tracks with their root, latest first."""
    named = roots.select(F.col("id").alias("root_id"), F.col("path").alias("root_path"))
    gone = tracks.where(F.col("missing_at").isNotNull()).join(named, "root_id", "left")
    if root:
        gone = gone.where(F.col("root_path") == root)
    return gone.orderBy(F.desc("missing_at"), F.asc("path"))


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def incomplete_metadata(tracks: DataFrame, claims: DataFrame) -> DataFrame:
    """Active tracks that lack a title, artist or duration, or that no claim describes."""
    claimed = claims.select(F.col("track_id").alias("_claimed")).where(F.col("_claimed").isNotNull()).distinct()
    rows = active(tracks).join(claimed, F.col("id") == F.col("_claimed"), "left")
    lacking = blank(F.col("title")) | blank(F.col("artist")) | F.col("duration_sec").isNull() | F.col("_claimed").isNull()
    return rows.where(lacking).drop("_claimed")


def blank_fields(tracks: DataFrame, columns: list[str]) -> DataFrame:
    """Active tracks of which any of some fields is blank."""
    condition = F.lit(False)
    for c in columns:
        condition = condition | blank(F.col(c))
    return active(tracks).where(condition)


def lacking_fingerprint(tracks: DataFrame) -> DataFrame:
    """Active tracks without a fingerprint."""
    return active(tracks).where(F.col("chromaprint").isNull() | (F.col("chromaprint") == ""))


def lacking_analysis(tracks: DataFrame, features: DataFrame) -> DataFrame:
    """Active tracks that were not analysed or have no features."""
    done = features.select(F.col("track_id").alias("_done")).distinct()
    current = active(tracks).join(done, F.col("id") == F.col("_done"), "left")
    return current.where(F.col("_done").isNull() | F.col("analyzed_at").isNull()).drop("_done")


def keep_ids(df: DataFrame, column: str, ids: DataFrame, id_column: str) -> DataFrame:
    """Rows whose id is listed (semi-join)."""
    return df.join(ids.select(F.col(id_column).alias(column)).distinct(), column, "left_semi")


def drop_ids(df: DataFrame, column: str, ids: DataFrame, id_column: str) -> DataFrame:
    """Rows whose id is not listed (anti-join)."""
    return df.join(ids.select(F.col(id_column).alias(column)).distinct(), column, "left_anti")
