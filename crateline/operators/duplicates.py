"""Duplicate groups by exact keys with anchored duration clusters, and repairs drawn from duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: titles that name nothing.
GENERIC_TITLES = ("intro", "outro", "untitled", "unknown", "track", "song", "live")
MIN_TITLE = 8


def anchored_clusters(rows: DataFrame, key: str, tolerance: float) -> DataFrame:
    """(key, cluster, id) for rows (key, id, duration): anchored clusters of each key, those of two or more only.

    A running fold over the sorted durations of a key. Keys are first cut where
    neighbouring durations lie more than ``tolerance`` apart: no cluster spans
    such a gap, so a key with a large share of the rows is folded in pieces.
    """
    rows = rows.select(F.col(key).alias("key"), F.col("id").cast("string").alias("id"), F.col("duration").cast("double").alias("duration"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    rows = rows.join(shared.drop("_n"), "key", "left_semi")
    # distinct durations per key and cell of the tolerance: one row each, however many members they have
    points = rows.where(F.col("duration").isNotNull()).select("key", "duration").distinct()
    near = Window.partitionBy("key").orderBy("duration")
    gap = F.col("duration") - F.lag("duration").over(near)
    points = points.withColumn("piece", F.sum(F.when(gap > tolerance, 1).otherwise(0)).over(near))
    packed = points.groupBy("key", "piece").agg(F.array_sort(F.collect_list("duration")).alias("durations"))
    acc_type = "array<double>"

    def step(acc: Column, d: Column) -> Column:
        opens = (F.size(acc) == 0) | (d - F.element_at(acc, -1) > tolerance)
        return F.when(opens, F.concat(acc, F.array(d))).otherwise(acc)

    starts = F.aggregate("durations", F.array().cast(acc_type), step)
    spans = packed.select("key", F.explode("durations").alias("duration"), starts.alias("starts"))
    spans = spans.select("key", "duration", F.array_max(F.filter("starts", lambda s: s <= F.col("duration"))).alias("anchor"))
    known = rows.where(F.col("duration").isNotNull()).join(spans, ["key", "duration"]).select("key", "id", "anchor")
    unknown = rows.where(F.col("duration").isNull()).select("key", "id", F.lit(None).cast("double").alias("anchor"))
    placed = known.unionByName(unknown)
    sizes = placed.groupBy("key", "anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    sizes = sizes.withColumnsRenamed({"key": "_key", "anchor": "_anchor"})
    kept = placed.join(sizes, (F.col("key") == F.col("_key")) & F.col("anchor").eqNullSafe(F.col("_anchor")))
    return kept.select("key", F.coalesce(F.format_number("anchor", 6), F.lit("unknown")).alias("cluster"), "id", "n")


def duration_of(tracks: DataFrame) -> Column:
    """The fingerprint's duration, else the file's."""
    return F.coalesce(tracks["fingerprint_duration"], tracks["duration_sec"])


def content_groups(tracks: DataFrame) -> DataFrame:
    """(key, id, missing, n): tracks that share their content hash."""
    rows = tracks.where(F.col("content_hash").isNotNull()).select(
        F.col("content_hash").alias("key"), "id", F.col("missing_at").isNotNull().alias("missing")
    )
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("missing").alias("gone")).where(F.col("n") > 1)
    return rows.join(shared, "key")


def content_duplicates(tracks: DataFrame) -> DataFrame:
    """(key, kind, members): groups by content hash; missing and present members together suggest a moved file."""
    rows = tracks.where(F.col("content_hash").isNotNull())
    grouped = rows.groupBy(F.col("content_hash").alias("key")).agg(
        F.count(F.lit(1)).alias("members"), F.count_if(F.col("missing_at").isNotNull()).alias("gone")
    )
    kind = F.when((F.col("gone") > 0) & (F.col("gone") < F.col("members")), "possible_move").otherwise("exact_duplicate")
    return grouped.where(F.col("members") > 1).select("key", kind.alias("kind"), "members")


def fingerprint_clusters(tracks: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Members of the duration clusters of equal fingerprints."""
    rows = tracks.where(F.col("chromaprint").isNotNull() & F.col("missing_at").isNull())
    rows = rows.select(F.col("chromaprint").alias("key"), "id", duration_of(rows).alias("duration"))
    return anchored_clusters(rows, "key", tolerance)


def metadata_key(tracks: DataFrame) -> Column:
    """Artist and title without case and outer blanks."""
    return F.concat_ws("\x1f", F.lower(F.trim("artist")), F.lower(F.trim("title")))


def metadata_clusters(tracks: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Members of the duration clusters of equal artist and title; the key needs one known duration."""
    named = tracks.where(F.col("missing_at").isNull() & (F.trim("artist") != "") & (F.trim("title") != ""))
    rows = named.select(metadata_key(named).alias("key"), "id", duration_of(named).alias("duration"))
    timed = rows.where(F.col("duration").isNotNull()).select("key").distinct()
    return anchored_clusters(rows.join(timed, "key", "left_semi"), "key", tolerance)


def duplicate_groups(tracks: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """(kind, key, cluster, id): groups of all three passes; a set of members found by an earlier pass is not repeated."""
    a = content_groups(tracks).select(F.lit(1).alias("pass"), "key", F.lit("all").alias("cluster"), F.col("id").cast("string").alias("id"))
    b = fingerprint_clusters(tracks, tolerance).select(F.lit(2).alias("pass"), "key", "cluster", "id")
    c = metadata_clusters(tracks, tolerance).select(F.lit(3).alias("pass"), "key", "cluster", "id")
    rows = a.unionByName(b).unionByName(c)
    # two groups have the same members if they agree in number and in an order-free sum of hashes
    wide = F.xxhash64("id").cast("decimal(38,0)")
    signs = rows.groupBy("pass", "key", "cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum(wide).alias("s"), F.min("id").alias("least"), F.max("id").alias("most")
    )
    first = Window.partitionBy("n", "s", "least", "most").orderBy("pass", "key", "cluster")
    kept = signs.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= 1).select("pass", "key", "cluster")
    kind = F.element_at(F.array(F.lit("content"), F.lit("fingerprint"), F.lit("metadata")), F.col("pass"))
    return rows.join(kept, ["pass", "key", "cluster"]).select(kind.alias("kind"), "key", "cluster", "id")


def repair_candidates(tracks: DataFrame, title_norm: Column) -> DataFrame:
    """(id, artist, donors): artists for tracks without one, from tracks of the same title, where all donors agree.

    Titles that are generic or shorter than eight characters say too little.
    """
    rows = tracks.where(F.col("missing_at").isNull() & F.col("quarantined_at").isNull()).select("id", "artist", title_norm.alias("t"))
    rows = rows.where(F.col("t").isNotNull() & (F.length("t") >= MIN_TITLE) & ~F.col("t").isin(list(GENERIC_TITLES)))
    known = F.trim("artist") != ""
    donors = rows.where(F.coalesce(known, F.lit(False))).groupBy("t").agg(
        F.min(F.lower(F.trim("artist"))).alias("a1"), F.max(F.lower(F.trim("artist"))).alias("a2"),
        F.min("artist").alias("artist"), F.count(F.lit(1)).alias("donors"),
    )
    agreed = donors.where(F.col("a1") == F.col("a2")).select("t", "artist", "donors")
    wanting = rows.where(~F.coalesce(known, F.lit(False))).select("id", "t")
    return wanting.join(agreed, "t").select("id", "artist", "donors")
