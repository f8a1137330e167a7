"""File sources: directory scans, hashes, probed metadata and evaluation files."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of audio files, and the spellings of a tag's name.
AUDIO_EXTENSIONS = ("mp3", "flac", "wav", "aiff", "aif", "m4a", "aac", "ogg", "opus", "wma", "alac")
TAG_NAMES = {
    "title": ("title", "tracktitle", "name"),
    "artist": ("artist", "artists", "performer"),
    "album": ("album",),
    "album_artist": ("album_artist", "albumartist", "album artist", "albumartists"),
    "genre": ("genre", "style"),
    "date": ("date", "year", "originaldate", "originalyear", "release_date"),
    "track_number": ("track", "tracknumber", "track_number", "track no", "trackno"),
    "disc_number": ("disc", "discnumber", "disc_number", "disk", "disknumber"),
}

PROBE_SCHEMA = (
    "format struct<duration: string, bit_rate: string, tags: map<string,string>>, "
    "streams array<struct<codec_type: string, codec_name: string, sample_rate: string, channels: int, tags: map<string,string>>>"
)


def scan_folder(spark: SparkSession, folder: str, extensions: tuple[str, ...] = AUDIO_EXTENSIONS) -> DataFrame:
    """(path, extension, file_size, file_mtime_ns) of the audio files below a folder; contents are not read."""
    pattern = "*.{" + ",".join([*extensions, *(e.upper() for e in extensions)]) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    path = F.regexp_replace("path", "^file:/+", "/")
    extension = F.concat(F.lit("."), F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)))
    return files.select(path.alias("path"), extension.alias("extension"), F.col("length").alias("file_size"), (F.unix_micros("modificationTime") * 1000).alias("file_mtime_ns"))


#: Bytes read at a time for a hash.
HASH_CHUNK = 1 << 20


def content_hashes(spark: SparkSession, folder: str, extensions: tuple[str, ...] = AUDIO_EXTENSIONS) -> DataFrame:
    """(path, content_hash): SHA-256 of every audio file below a folder, read in chunks; NULL for a file that cannot be read.

    Spark's file reader leaves empty files out, here and in ``scan_folder``.
    """
    pattern = "*.{" + ",".join([*extensions, *(e.upper() for e in extensions)]) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path")

    def digest(uri: str) -> str | None:
        try:
            if local := re.match("file:/+", uri):
                store, path = fs.LocalFileSystem(), "/" + uri[local.end() :]
            else:
                store, path = fs.FileSystem.from_uri(uri)
            total = hashlib.sha256()
            with store.open_input_stream(path) as stream:
                while chunk := stream.read(HASH_CHUNK):
                    total.update(chunk)
            return total.hexdigest()
        except OSError:
            return None

    @F.pandas_udf("string")
    def hashed(paths: pd.Series) -> pd.Series:
        return paths.map(digest)

    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), hashed("path").alias("content_hash"))


def path_hash(path: Column) -> Column:
    return F.sha2(path, 256)


def probed_metadata(probes: DataFrame, json_column: str = "probe") -> DataFrame:
    """The rows with flat metadata read from probe JSON: tags by any of their names, the container's before the streams', the first audio stream."""
    p = F.from_json(json_column, PROBE_SCHEMA)
    rows = probes.withColumn("_p", p)
    lowered = lambda m: F.coalesce(F.transform_keys(m, lambda k, v: F.lower(F.trim(k))), F.create_map().cast("map<string,string>"))
    audio = F.get(F.filter(F.col("_p.streams"), lambda s: s["codec_type"] == "audio"), F.lit(0))
    rows = rows.withColumn("_a", audio).withColumn("_f", lowered(F.col("_p.format.tags"))).withColumn("_s", lowered(F.col("_a.tags")))
    tag = lambda names: F.coalesce(*[F.nullif(F.trim(F.try_element_at(m, F.lit(n))), F.lit("")) for m in (F.col("_f"), F.col("_s")) for n in names])
    out = {name: tag(names) for name, names in TAG_NAMES.items()}
    out |= {
        "duration_sec": F.col("_p.format.duration").try_cast("double"),
        "codec": F.col("_a.codec_name"),
        "sample_rate": F.col("_a.sample_rate").try_cast("int"),
        "bit_rate": F.col("_p.format.bit_rate").try_cast("int"),
        "channels": F.col("_a.channels"),
    }
    return rows.withColumns(out).drop("_p", "_a", "_f", "_s")


def evaluation_cases(spark: SparkSession, path: str, kind: str = "queries") -> DataFrame:
    """One row per case of an evaluation file (``queries`` or ``matches``), its expectations as JSON text."""
    whole = spark.read.text(path, wholetext=True)
    cases = F.explode(F.from_json(F.get_json_object("value", f"$.{kind}"), "array<string>")).alias("case")
    rows = whole.select(cases)
    text = F.coalesce(F.get_json_object("case", "$.text"), F.get_json_object("case", "$.query"))
    return rows.select(
        F.get_json_object("case", "$.id").alias("id"), text.alias("text"), F.get_json_object("case", "$.category").alias("category"),
        F.get_json_object("case", "$.track_a").alias("track_a"), F.get_json_object("case", "$.track_b").alias("track_b"),
        F.get_json_object("case", "$.expectations").alias("expectations"),
    )


def track_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id) of a JSON array of ids."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "array<string>")).alias("id"))
