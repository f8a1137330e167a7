"""Registered queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crateline.llm import components, encoding, lookalikes, mojibake, names, neighbours, packing, survivor, webspam
from crateline.operators import multivalue
from crateline.operators.skew import lookup
from crateline.session import cut_lineage
from crateline.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can state it, its oracle."""

    def register(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


@query(
    "p2_found",
    """
    WITH RECURSIVE pairs AS (
      SELECT DISTINCT track_a AS a, track_b AS b FROM match_reports
      WHERE lower(trim(identity_decision)) = 'same' AND track_a <> track_b),
    edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
    reach(v, w) AS (
      SELECT a, b FROM edges UNION SELECT r.v, e.b FROM reach r JOIN edges e ON r.w = e.a)
    SELECT v AS track_id, least(v, min(w)) AS group_id FROM reach GROUP BY v
    """,
)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every track linked to another with the smallest track id of its group."""
    reports = load(spark, folder, "match_reports").select("track_a", "track_b", "identity_decision")
    said = F.lower(F.regexp_replace("identity_decision", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return components.connected_groups(reports.where(said == "same"), "track_a", "track_b", "track_id", "group_id")


_CLAIM_SQL = """
    WITH claims AS (
      SELECT c.*, replace(lower(trim(source, ' \t\n\r')), '-', '_') AS src,
        lower(trim(value_text, ' \t\n\r')) AS said FROM track_metadata_claims c),
    usable AS (
      SELECT * FROM claims WHERE value_text IS NOT NULL AND said <> ''
        AND NOT regexp_full_match(said, '[-–—_.?*~#…\\s/]+') AND said NOT IN ({words})),
    ranked AS (
      SELECT u.*, row_number() OVER (PARTITION BY track_id, field_name ORDER BY
        coalesce(selected, false) DESC,
        CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence ELSE 0 END DESC,
        coalesce(trust, -1) DESC, created_at DESC NULLS LAST, length(value_text) DESC, id) AS rn
      FROM usable u LEFT JOIN claim_sources s ON u.src = s.source),
    sizes AS (SELECT track_id, field_name, count(*) AS n FROM claims GROUP BY ALL)
""".replace("{words}", ", ".join("'" + w.replace("'", "''") + "'" for w in survivor.MISSING_WORDS))


@query(
    "p5_found",
    _CLAIM_SQL
    + """
    SELECT r.track_id, r.field_name, r.id AS claim_id FROM ranked r JOIN sizes USING (track_id, field_name)
    WHERE rn = 1 AND n >= 2
    """,
)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving claim of every track and field with several claims."""
    best = survivor.surviving_claims(load(spark, folder, "track_metadata_claims"), load(spark, folder, "claim_sources"))
    return best.select("track_id", "field_name", F.col("id").alias("claim_id"))


RECORD_FIELDS = ["title", "artist", "album", "genre", "date"]


@query(
    "p5_records",
    _CLAIM_SQL
    + """
    SELECT track_id, max(value_text) FILTER (field_name = 'title') AS title,
      max(value_text) FILTER (field_name = 'artist') AS artist, max(value_text) FILTER (field_name = 'album') AS album,
      max(value_text) FILTER (field_name = 'genre') AS genre, max(value_text) FILTER (field_name = 'date') AS date,
      count(*) FILTER (field_name IN ('title', 'artist', 'album', 'genre', 'date')) AS filled
    FROM ranked WHERE rn = 1 GROUP BY track_id
    """,
)
def p5_records(spark: SparkSession, folder: str) -> DataFrame:
    """One record per track built field by field from its surviving claims."""
    claims, sources = load(spark, folder, "track_metadata_claims"), load(spark, folder, "claim_sources")
    return survivor.surviving_records(claims, sources, RECORD_FIELDS)


@query("p8_ids")
def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The byte_bpe_50k ids of every document."""
    return encoding.token_ids(load(spark, folder, "documents"), "doc_id", "text")


#: Tokens of a container.
CAPACITY = 2048


@query("p9_containers")
def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of each document, or of each piece of a document above capacity, in byte_bpe_50k tokens."""
    counts = encoding.token_counts(load(spark, folder, "documents"), "doc_id", "text")
    items = counts.select(F.col("doc_id").alias("item_id"), F.col("n_tokens").alias("size"))
    packed = packing.pack(items, CAPACITY)
    return packed.select(
        F.col("item_id").alias("doc_id"),
        "piece",
        F.col("start").alias("token_start"),
        F.col("size").alias("n_tokens"),
        F.col("container").alias("container_id"),
    )


#: Neighbours of each track, and how far they may lie.
NEIGHBOURS, RADIUS = 5, 2.5


_LIST_SQL = r"^\s*\[\s*-?[0-9.eE+-]+\s*(,\s*-?[0-9.eE+-]+\s*){12}\]\s*$"


def _numbers_sql(column: str) -> str:
    return rf"CAST(string_split(regexp_replace({column}, '[\[\]\s]', '', 'g'), ',') AS DOUBLE[])"


@query(
    "p4_found",
    f"""
    WITH u AS (
      SELECT DISTINCT track_id, list_concat({_numbers_sql('mfcc_mean_json')}, {_numbers_sql('mfcc_std_json')}) AS v FROM audio_features
      WHERE regexp_matches(mfcc_mean_json, '{_LIST_SQL}') AND regexp_matches(mfcc_std_json, '{_LIST_SQL}') AND track_id IS NOT NULL),
    d AS (SELECT a.track_id AS a, b.track_id AS b, list_distance(a.v, b.v) AS d FROM u a JOIN u b ON a.track_id <> b.track_id WHERE list_distance(a.v, b.v) <= 2.5),
    k AS (SELECT a, b FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 5)
    SELECT DISTINCT least(a, b) AS track_a, greatest(a, b) AS track_b FROM k
    """,
)
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of tracks of which one is among the five nearest of the other, at most 2.5 apart."""
    vectors = neighbours.timbre_vectors(load(spark, folder, "audio_features"))
    return neighbours.near_pairs(neighbours.nearest(vectors, NEIGHBOURS, RADIUS))


def _garbled(spark: SparkSession, folder: str) -> DataFrame:
    tracks = load(spark, folder, "tracks").select("id", "title", "artist", "album")
    return mojibake.garbled_fields(mojibake.long_fields(tracks, "id", ["title", "artist", "album"]))


@query("p7_found")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The titles, artists and albums that were read in a wrong encoding."""
    return _garbled(spark, folder).select("track_id", "field_name")


@query("p7_restored")
def p7_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The garbled titles, artists and albums with the text that could be restored."""
    return _garbled(spark, folder)


def _consistent(spark: SparkSession, folder: str) -> DataFrame:
    tracks = load(spark, folder, "tracks").select("id", "title", "artist", "album")
    model = lookalikes.model_of(tracks, ["title", "artist", "album"])
    return lookalikes.consistent_fields(mojibake.long_fields(tracks, "id", ["title", "artist"]), model)


@query("p3_found")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The titles and artists with a character out of form."""
    return _consistent(spark, folder).select("track_id", "field_name")


@query("p3_forms")
def p3_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The titles and artists with a character out of form, with their consistent form."""
    return _consistent(spark, folder)


def _links(spark: SparkSession, folder: str) -> DataFrame:
    """(track_id, field_name, text, artist_id, cost) of the fields that hold one registered name in another spelling."""
    tracks = load(spark, folder, "tracks").select("id", "title", "artist", "album", "album_artist")
    registry = load(spark, folder, "artist_registry")
    fields = mojibake.long_fields(tracks, "id", ["artist", "album_artist"])
    links = names.linked_names(fields.select(F.col("text").alias("name")).distinct(), registry)
    model = lookalikes.model_of(tracks, ["title", "artist", "album"])
    grammar = multivalue.ARTIST_GRAMMAR

    @F.pandas_udf("single boolean, clean boolean")
    def kind(text: pd.Series, known: pd.Series) -> pd.DataFrame:
        restorer = mojibake.Restorer(model)
        own = [multivalue.Lexicon.of([x], grammar) for x in known]
        single = [len(multivalue.split_text(x, grammar, lex)) <= 1 for x, lex in zip(text, own, strict=True)]
        clean = [x.isascii() or not (lookalikes.out_of_form(x) or restorer.restore(x)[1]) for x in text]
        return pd.DataFrame({"single": single, "clean": clean})

    links = cut_lineage(links.withColumn("_k", kind("name", "known")).where("_k.single"))
    out = []
    for field, known in (("artist", links.where("_k.clean")), ("album_artist", links)):
        rows = fields.where(F.col("field_name") == field)
        out.append(lookup(rows, "text", known, "name", "artist_id", "artist_id").where(F.col("artist_id").isNotNull()))
    return out[0].unionByName(out[1])


@query("p6_found")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The artist and album artist fields that mean a registered artist in another spelling."""
    return _links(spark, folder).select("track_id", "field_name", "artist_id")


@query("p10_found")
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents made to be found rather than read."""
    scores = webspam.spam_scores(load(spark, folder, "documents"), load(spark, folder, "doc_labels"))
    return scores.where(webspam.is_spam()).select("doc_id")


@query("p10_quality")
def p10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """How the documents judged by hand are decided; their labels are not used here, not even for training."""
    scores = webspam.spam_scores(load(spark, folder, "documents"))
    decided = scores.select("doc_id", webspam.is_spam().alias("flagged"))
    labels = load(spark, folder, "doc_labels").where(F.col("doc_id").isNotNull())
    joined = labels.join(decided, "doc_id")
    return joined.groupBy("label", "flagged").agg(F.count(F.lit(1)).alias("documents"))
