"""Sinks: playlists, CSV and JSON exports, append-only logs and swapped tables."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CSV_COLUMNS = ("rank", "track_id", "score", "title", "artist", "album", "path")


def rendered_path(path: Column, mode: str = "stored", base: str | None = None) -> Column:
    """The path as stored, absolute, or relative to a folder."""
    if mode == "stored":
        return path
    if mode not in ("absolute", "relative"):
        raise ValueError(f"unknown path mode {mode}")
    start = base or "/"

    @F.pandas_udf("string")
    def render(s: pd.Series) -> pd.Series:
        whole = s.map(lambda p: None if p is None else os.path.normpath(p if os.path.isabs(p) else os.path.join(start, p)))
        return whole if mode == "absolute" else whole.map(lambda p: None if p is None else os.path.relpath(p, start))

    return render(path)


def m3u_lines(results: DataFrame, mode: str = "stored", base: str | None = None) -> DataFrame:
    """(value): the lines of a playlist, in rank order. Results are at most one page long."""
    name = F.concat_ws(" - ", F.nullif(F.trim("artist"), F.lit("")), F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("path")))
    lines = results.orderBy("rank").select(F.concat(F.lit("#EXTINF:-1,"), name, F.lit("\n"), rendered_path(F.col("path"), mode, base)).alias("value"), "rank")
    head = results.sparkSession.createDataFrame([("#EXTM3U", 0)], "value string, rank int")
    return head.unionByName(lines.withColumn("rank", F.col("rank").cast("int"))).orderBy("rank").select("value")


def write_m3u(results: DataFrame, folder: str, **paths) -> None:
    m3u_lines(results, **paths).coalesce(1).write.mode("overwrite").text(folder)


def write_csv(results: DataFrame, folder: str) -> None:
    """Seven columns with a header, in rank order."""
    results.select(*CSV_COLUMNS).orderBy("rank").coalesce(1).write.mode("overwrite").csv(folder, header=True)


def json_rows(results: DataFrame) -> DataFrame:
    """(value): each result as a JSON object."""
    return results.orderBy("rank").select(F.to_json(F.struct(*[F.col(c) for c in results.columns])).alias("value"))


def write_json(results: DataFrame, folder: str) -> None:
    json_rows(results).write.mode("overwrite").text(folder)


def append(rows: DataFrame, folder: str) -> None:
    """Add rows to an append-only log."""
    rows.write.mode("append").parquet(folder)


def swap_table(rows: DataFrame, folder: str) -> None:
    """Replace a table that ``rows`` may itself read: written beside it, the old one renamed aside, the new one renamed in, the old one deleted.

    A crash between the renames leaves both tables whole under their side names.
    """
    spark = rows.sparkSession
    staged = f"{folder.rstrip('/')}__next"
    rows.write.mode("overwrite").parquet(staged)
    jvm = spark._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(staged)
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}__old")
    if fs.exists(old):
        fs.delete(aside, True)
        if not fs.rename(old, aside):
            raise OSError(f"cannot rename {folder} aside")
    if not fs.rename(new, old):
        fs.rename(aside, old)
        raise OSError(f"cannot rename {staged} to {folder}")
    fs.delete(aside, True)


def table_counts(tables: dict[str, DataFrame | None]) -> dict[str, int | None]:
    """Rows of each table, None for an absent one."""
    return {name: None if df is None else df.count() for name, df in tables.items()}
