"""Registered queries of the core library and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from crateline.functions import numeric as N
from crateline.functions import text as X
from crateline.operators import (
    analysis,
    browse,
    claims,
    derive,
    duplicates,
    evaluation,
    ingest,
    matching,
    multivalue,
    ranking,
    retrieval,
    statistics,
)
from crateline.plans.intent import mode_of, parse_query
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


def _values(spark: SparkSession, folder: str, min_values: int) -> DataFrame:
    fields = {
        "artist": (multivalue.ARTIST_GRAMMAR, load(spark, folder, "artist_registry").select("name")),
        "genre": (multivalue.GENRE_GRAMMAR, load(spark, folder, "genre_terms").select("name")),
    }
    tracks = load(spark, folder, "tracks").select("id", "artist", "genre")
    out = multivalue.split_values(tracks, "id", fields, min_values)
    return out.withColumnRenamed("id", "track_id")


@query("p1_found")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of the artist and genre fields that hold two or more."""
    return _values(spark, folder, 2)


@query("p1_values")
def p1_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of every artist and genre field."""
    return _values(spark, folder, 1)


# --- SQL building blocks of the oracles -------------------------------------------------------------------------------


def _rng(x: str, low: float | None, high: float | None, soft: float) -> str:
    gaps = ", ".join(g for g in (f"{low} - {x}" if low is not None else "", f"{x} - {high}" if high is not None else "", "0") if g)
    return f"(CASE WHEN {x} IS NULL THEN 0 ELSE greatest(1 - greatest({gaps}) / {soft}, 0) END)"


_TEMPO = "(CASE WHEN bpm IS NULL OR bpm <= 0 THEN NULL WHEN bpm >= 168 THEN bpm / 2 WHEN bpm < 62 THEN bpm * 2 ELSE bpm END)"
_FEATURES = "feats AS (SELECT DISTINCT * FROM audio_features WHERE track_id IS NOT NULL)"
_SOFT = {
    "low_aggr": _rng("aggression", None, 0.35, 0.35), "very_low_aggr": _rng("aggression", None, 0.22, 0.30),
    "med_energy": _rng("energy", 0.25, 0.68, 0.30), "low_mid_energy": _rng("energy", 0.18, 0.58, 0.30), "high_energy": _rng("energy", 0.62, None, 0.35),
    "dance": _rng("danceability", 0.58, None, 0.35), "groove": _rng("danceability", 0.42, 0.82, 0.30), "calm_dance": _rng("danceability", 0.20, 0.62, 0.35),
    "dark": _rng("brightness", None, 0.42, 0.35), "balanced": _rng("brightness", 0.30, 0.68, 0.30), "bright": _rng("brightness", 0.58, None, 0.35),
    "warm": _rng("brightness", 0.28, 0.58, 0.35), "dance_tempo": _rng(_TEMPO, 110, 132, 35), "mid_tempo": _rng(_TEMPO, 80, 124, 45),
    "fast_tempo": _rng(_TEMPO, 125, None, 45), "driving_tempo": _rng(_TEMPO, 85, 150, 45), "bg_energy": _rng("energy", 0.14, 0.52, 0.25),
    "soft_bright": _rng("brightness", None, 0.68, 0.30), "soft_dance": _rng("danceability", None, 0.68, 0.35), "pushing": _rng("aggression", 0.45, None, 0.45),
}
_SOFT["no_vocal"] = (
    f"(CASE WHEN vocalness IS NULL AND instrumentalness IS NULL THEN 0.35 ELSE greatest({_rng('vocalness', None, 0.20, 0.30)}, {_rng('instrumentalness', 0.70, None, 0.30)}) END)"
)
_SOFT["bg"] = f"({_SOFT['low_mid_energy']} * {_SOFT['low_aggr']})"
_SOFT["any_energy"] = f"greatest({_SOFT['med_energy']}, {_SOFT['high_energy']})"
_HEARD = "(vocalness IS NOT NULL OR instrumentalness IS NOT NULL)"


#: The contexts as the SQL states them, apart from the library's own table: evidence names with signals, and certainty.
_STATED = {
    "background": ((("low_aggression", "low_aggr"), ("background_energy", "bg_energy"), ("not_too_bright", "soft_bright"), ("not_too_danceable", "soft_dance")), 0.68),
    "lounge_bar": ((("low_aggression", "low_aggr"), ("medium_energy", "med_energy"), ("warmth", "warm"), ("groove", "groove"), ("mid_tempo", "mid_tempo")), 0.74),
    "warm_lounge": ((("warmth", "warm"), ("low_aggression", "low_aggr"), ("low_mid_energy", "low_mid_energy"), ("groove", "groove"), ("balanced_brightness", "balanced")), 0.74),
    "dinner": ((("low_aggression", "low_aggr"), ("low_mid_energy", "low_mid_energy"), ("warmth", "warm"), ("background", "bg")), 0.7),
    "cooking": ((("medium_energy", "med_energy"), ("low_aggression", "low_aggr"), ("groove", "groove"), ("balanced_brightness", "balanced")), 0.7),
    "focus": ((("very_low_aggression", "very_low_aggr"), ("low_mid_energy", "low_mid_energy"), ("calm_dance", "calm_dance"), ("low_vocal_or_instrumental", "no_vocal")), 0.78),
    "dark_ambient": ((("dark", "dark"), ("low_aggression", "low_aggr"), ("low_mid_energy", "low_mid_energy"), ("not_too_danceable", "calm_dance")), 0.72),
    "no_vocals_background": ((("low_vocal_or_instrumental", "no_vocal"), ("low_aggression", "low_aggr"), ("background_energy", "bg_energy"), ("background", "bg")), 0.82),
    "party": ((("high_energy", "high_energy"), ("danceable", "dance"), ("bright", "bright"), ("not_too_aggressive", "low_aggr")), 0.72),
    "club": ((("danceable", "dance"), ("dance_tempo", "dance_tempo"), ("high_energy", "high_energy"), ("not_too_aggressive", "low_aggr")), 0.76),
    "workout": ((("high_energy", "high_energy"), ("fast_tempo", "fast_tempo"), ("danceable", "dance"), ("aggression", "pushing")), 0.72),
    "driving": ((("medium_or_high_energy", "any_energy"), ("driving_tempo", "driving_tempo"), ("groove", "groove"), ("not_too_aggressive", "low_aggr")), 0.72),
}


def _evidence(name: str) -> list[tuple[str, str]]:
    return list(_STATED[name][0])


def _context(name: str) -> str:
    parts = [signal for _, signal in _evidence(name)]
    score = "((" + " + ".join(_SOFT[p] for p in parts) + f") / {float(len(parts))})"
    return f"(CASE WHEN {_HEARD} THEN {score} ELSE least({score}, 0.45) END)" if name == "no_vocals_background" else score


def _confidence(name: str) -> str:
    sure = _STATED[name][1]
    less = {"focus": 0.56, "no_vocals_background": 0.34}.get(name)
    return f"CAST(CASE WHEN {_HEARD} THEN {sure} ELSE {less} END AS DOUBLE)" if less else f"CAST({sure} AS DOUBLE)"


_FITS = "fits AS (" + " UNION ALL ".join(
    f"SELECT track_id, '{c}' AS context, round({_context(c)}, 6) AS score, {_confidence(c)} AS confidence FROM feats WHERE round({_context(c)}, 6) >= 0.05" for c in _STATED
) + ")"

_TAG_RULES = [
    ("low_energy", _rng("energy", None, 0.38, 0.35), 0.35), ("medium_energy", _rng("energy", 0.30, 0.70, 0.30), 0.35), ("high_energy", _SOFT["high_energy"], 0.35),
    ("danceable", _SOFT["dance"], 0.35), ("not_danceable", _rng("danceability", None, 0.42, 0.35), 0.35), ("low_aggression", _SOFT["low_aggr"], 0.35),
    ("aggressive", _rng("aggression", 0.62, None, 0.35), 0.75), ("dark", _SOFT["dark"], 0.35), ("bright", _SOFT["bright"], 0.35),
    ("slow", _rng(_TEMPO, None, 95, 45), 0.35), ("midtempo", _rng(_TEMPO, 85, 125, 45), 0.35), ("fast", _SOFT["fast_tempo"], 0.35),
    ("dance_tempo", _SOFT["dance_tempo"], 0.35), ("background_friendly", _context("background"), 0.85), ("focus_friendly", _context("focus"), 0.85),
    ("lounge_friendly", _context("lounge_bar"), 0.70), ("warm_lounge", _context("warm_lounge"), 0.70), ("club_friendly", _context("club"), 0.70),
    ("no_vocals_background", f"(CASE WHEN {_HEARD} THEN {_context('no_vocals_background')} ELSE 0 END)", 0.78),
]
_TAGS = "tags AS (" + " UNION ALL ".join(
    f"SELECT track_id, 'derived:features' AS source, '{t}' AS tag, round({x}, 6) AS score FROM feats WHERE {x} >= {least}" for t, x, least in _TAG_RULES
) + ")"


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return derive.one_row_per_track(load(spark, folder, "audio_features"))


def _tags(spark: SparkSession, folder: str) -> DataFrame:
    return derive.feature_tags(_features(spark, folder))


def _fits(spark: SparkSession, folder: str) -> DataFrame:
    return derive.context_fit(_features(spark, folder))


def _profiles(spark: SparkSession, folder: str) -> DataFrame:
    return derive.profiles(load(spark, folder, "tracks"), _features(spark, folder), _tags(spark, folder), _fits(spark, folder))


# --- browsing and selection ------------------------------------------------------------------------------------------


@query(
    "browse_page",
    """SELECT id, title, path FROM tracks WHERE missing_at IS NULL AND starts_with(path, '/srv/crates/main/')
       AND contains(lower(concat_ws(' ', title, artist, album, album_artist, genre, path)), 'the')
       ORDER BY lower(coalesce(title, '')), path LIMIT 200 OFFSET 10""",
)
def browse_page(spark, folder):
    """A page of tracks of one folder that hold a term."""
    return browse.page(load(spark, folder, "tracks"), "the", "/srv/crates/main", offset=10).select("id", "title", "path")


@query(
    "browse_by_duration",
    """SELECT id, duration_sec FROM tracks WHERE missing_at IS NULL
       ORDER BY duration_sec IS NULL, duration_sec DESC, lower(coalesce(title, '')), path LIMIT 50""",
)
def browse_by_duration(spark, folder):
    """The longest tracks, unknown durations last."""
    return browse.page(load(spark, folder, "tracks"), sort="duration_sec", descending=True, limit=50).select("id", "duration_sec")


@query(
    "browse_folders",
    """SELECT split_part(substr(path, 18), '/', 1) AS name, count(*) AS tracks FROM tracks
       WHERE missing_at IS NULL AND starts_with(path, '/srv/crates/main/') AND contains(substr(path, 18), '/') GROUP BY 1""",
)
def browse_folders(spark, folder):
    """The folders below one folder with their tracks."""
    return browse.child_folders(load(spark, folder, "tracks"), "/srv/crates/main")


@query(
    "root_counts",
    """SELECT r.id, r.path, count(t.id) AS tracks FROM library_roots r LEFT JOIN tracks t ON t.root_id = r.id AND t.missing_at IS NULL GROUP BY ALL""",
)
def root_counts(spark, folder):
    """Every root with its live tracks."""
    return browse.root_counts(load(spark, folder, "library_roots"), load(spark, folder, "tracks"))


@query("failed_list", "SELECT id, error_count, quarantined_at, path FROM tracks WHERE error_count > 0 OR quarantined_at IS NOT NULL")
def failed_list(spark, folder):
    """Tracks with failures or in quarantine."""
    return browse.failed_tracks(load(spark, folder, "tracks")).select("id", "error_count", "quarantined_at", "path")


@query(
    "missing_list",
    "SELECT t.id, t.path, r.path AS root_path, t.missing_at FROM tracks t LEFT JOIN library_roots r ON t.root_id = r.id WHERE t.missing_at IS NOT NULL",
)
def missing_list(spark, folder):
    """Missing tracks with their root."""
    return browse.missing_tracks(load(spark, folder, "tracks"), load(spark, folder, "library_roots")).select("id", "path", "root_path", "missing_at")


_ACTIVE = "missing_at IS NULL AND quarantined_at IS NULL"


@query(
    "incomplete_metadata",
    f"""SELECT id FROM tracks WHERE {_ACTIVE} AND (title IS NULL OR trim(title) = '' OR artist IS NULL OR trim(artist) = '' OR duration_sec IS NULL
        OR id NOT IN (SELECT track_id FROM track_metadata_claims WHERE track_id IS NOT NULL))""",
)
def incomplete_metadata(spark, folder):
    """Active tracks whose metadata is incomplete."""
    return browse.incomplete_metadata(load(spark, folder, "tracks"), load(spark, folder, "track_metadata_claims")).select("id")


@query(
    "blank_fields",
    f"SELECT id, title, artist FROM tracks WHERE {_ACTIVE} AND (title IS NULL OR trim(title) = '' OR artist IS NULL OR trim(artist) = '')",
)
def blank_fields(spark, folder):
    """Active tracks without a title or artist."""
    return browse.blank_fields(load(spark, folder, "tracks"), ["title", "artist"]).select("id", "title", "artist")


@query("fingerprint_work", f"SELECT id FROM tracks WHERE {_ACTIVE} AND (chromaprint IS NULL OR chromaprint = '')")
def fingerprint_work(spark, folder):
    """Active tracks without a fingerprint."""
    return browse.lacking_fingerprint(load(spark, folder, "tracks")).select("id")


@query(
    "analysis_work",
    f"SELECT id FROM tracks WHERE {_ACTIVE} AND (analyzed_at IS NULL OR id NOT IN (SELECT track_id FROM audio_features WHERE track_id IS NOT NULL))",
)
def analysis_work(spark, folder):
    """Active tracks without analysis."""
    return browse.lacking_analysis(load(spark, folder, "tracks"), load(spark, folder, "audio_features")).select("id")


@query("listed_tracks", "SELECT id, path FROM tracks WHERE id IN (SELECT track_id FROM feedback WHERE rating = 1)")
def listed_tracks(spark, folder):
    """Tracks of a list of ids, by a semi-join."""
    liked = load(spark, folder, "feedback").where("rating = 1").where("track_id IS NOT NULL")
    return browse.keep_ids(load(spark, folder, "tracks"), "id", liked, "track_id").select("id", "path")


@query("unlisted_tracks", "SELECT id FROM tracks WHERE id NOT IN (SELECT track_id FROM feedback WHERE track_id IS NOT NULL)")
def unlisted_tracks(spark, folder):
    """Tracks nobody rated, by an anti-join."""
    return browse.drop_ids(load(spark, folder, "tracks"), "id", load(spark, folder, "feedback").where("track_id IS NOT NULL"), "track_id").select("id")


# --- statistics and health -------------------------------------------------------------------------------------------


@query(
    "tag_stats",
    f"""WITH {_FEATURES}, {_TAGS} SELECT tag, count(*) AS tracks, round(avg(score), 6) AS avg_score, round(max(score), 6) AS max_score,
        string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM tags GROUP BY tag""",
)
def tag_stats(spark, folder):
    """Counts and scores per tag."""
    return statistics.tag_statistics(_tags(spark, folder))


@query(
    "feature_percentiles",
    f"""WITH {_FEATURES}, long AS ("""
    + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS v FROM feats" for f in ("energy", "danceability", "aggression", "brightness"))
    + f""" UNION ALL SELECT 'tempo_bpm', round({_TEMPO}, 6) FROM feats)
        SELECT field, count(v) AS n, round(min(v), 6) AS lowest, """
    + ", ".join(f"round(quantile_cont(v, {q}), 6) AS p{round(q * 100)}" for q in statistics.PERCENTILES)
    + ", round(max(v), 6) AS highest FROM long WHERE v IS NOT NULL GROUP BY field",
)
def feature_percentiles(spark, folder):
    """Percentiles of each feature and of the perceived tempo."""
    return statistics.feature_percentiles(_features(spark, folder))


@query(
    "track_counts",
    f"""SELECT count(*) AS total, count(*) FILTER ({_ACTIVE}) AS active, count(*) FILTER (missing_at IS NOT NULL) AS missing,
        count(*) FILTER (error_count > 0) AS failed, count(*) FILTER (quarantined_at IS NOT NULL) AS quarantined FROM tracks""",
)
def track_counts(spark, folder):
    """How many tracks are in which state."""
    return statistics.state_counts(load(spark, folder, "tracks"))


def _coverage_sql(name: str, table: str) -> str:
    return f"""SELECT '{name}' AS part, (SELECT count(*) FROM {table}) AS total_rows, count(DISTINCT x.track_id) AS covered, (SELECT count(*) FROM act) AS active,
      round(count(DISTINCT x.track_id) / (SELECT count(*) FROM act)::DOUBLE, 6) AS share FROM {table} x JOIN act ON x.track_id = act.id"""


@query(
    "coverage",
    f"WITH act AS (SELECT id FROM tracks WHERE {_ACTIVE}) " + _coverage_sql("features", "audio_features") + " UNION ALL " + _coverage_sql("claims", "track_metadata_claims") + " UNION ALL " + _coverage_sql("feedback", "feedback"),
)
def coverage(spark, folder):
    """How many active tracks each derived table covers."""
    parts = {"features": "audio_features", "claims": "track_metadata_claims", "feedback": "feedback"}
    return statistics.coverage(load(spark, folder, "tracks"), {n: load(spark, folder, t) for n, t in parts.items()})


@query("profile_health")
def profile_health(spark, folder):
    """Whether stored profiles match a rebuild; here the store holds the rebuild without the missing genres' tracks."""
    made = _profiles(spark, folder)
    return statistics.profile_health(made, made.where(F.contains("profile_text", F.lit("Genre: "))))


@query(
    "embedding_staleness",
    """WITH texts AS (SELECT id AS track_id, title AS text FROM tracks WHERE missing_at IS NULL),
       stored AS (SELECT track_id, value_text FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY created_at DESC, id DESC) AS rn
         FROM track_metadata_claims WHERE field_name = 'title' AND track_id IS NOT NULL) WHERE rn = 1)
       SELECT t.track_id, CASE WHEN s.track_id IS NULL THEN 'absent' WHEN t.text IS NOT DISTINCT FROM s.value_text THEN 'current' ELSE 'stale' END AS state
       FROM texts t LEFT JOIN stored s USING (track_id)""",
)
def embedding_staleness(spark, folder):
    """Whether a text stored per track (here its latest title claim) is the current one."""
    texts = browse.live(load(spark, folder, "tracks")).select(F.col("id").alias("track_id"), F.col("title").alias("text"))
    titles = load(spark, folder, "track_metadata_claims").where("field_name = 'title' AND track_id IS NOT NULL")
    stored = titles.groupBy("track_id").agg(F.max_by(F.struct("value_text"), F.struct("created_at", "id"))["value_text"].alias("text")).withColumn("model", F.lit("m"))
    return statistics.embedding_staleness(texts, stored, "m")


# --- duplicates ------------------------------------------------------------------------------------------------------


@query(
    "dup_content_hash",
    """SELECT content_hash AS key, CASE WHEN count(missing_at) BETWEEN 1 AND count(*) - 1 THEN 'possible_move' ELSE 'exact_duplicate' END AS kind, count(*) AS members
       FROM tracks WHERE content_hash IS NOT NULL GROUP BY content_hash HAVING count(*) > 1""",
)
def dup_content_hash(spark, folder):
    """Groups of equal content, moved files told apart."""
    return duplicates.content_duplicates(load(spark, folder, "tracks"))


def _cluster_sql(source: str) -> str:
    return f"""WITH RECURSIVE base AS ({source}), shared AS (SELECT key FROM base GROUP BY key HAVING count(*) > 1),
      r AS (SELECT b.*, row_number() OVER (PARTITION BY key ORDER BY duration, id) AS n FROM base b SEMI JOIN shared USING (key) WHERE duration IS NOT NULL),
      f AS (SELECT key, id, n, duration, duration AS anchor FROM r WHERE n = 1
        UNION ALL SELECT r.key, r.id, r.n, r.duration, CASE WHEN r.duration - f.anchor > 2.0 THEN r.duration ELSE f.anchor END FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1),
      placed AS (SELECT key, id, anchor FROM f UNION ALL SELECT key, id, NULL FROM base SEMI JOIN shared USING (key) WHERE duration IS NULL)
      SELECT id, count(*) OVER (PARTITION BY key, anchor) AS n FROM placed QUALIFY count(*) OVER (PARTITION BY key, anchor) > 1"""


@query(
    "dup_fingerprint_clusters",
    _cluster_sql("SELECT chromaprint AS key, id, coalesce(fingerprint_duration, duration_sec) AS duration FROM tracks WHERE chromaprint IS NOT NULL AND missing_at IS NULL"),
)
def dup_fingerprint_clusters(spark, folder):
    """Duration clusters of equal fingerprints."""
    return duplicates.fingerprint_clusters(load(spark, folder, "tracks")).select("id", "n")


_META = """SELECT * FROM (SELECT lower(trim(artist)) || chr(31) || lower(trim(title)) AS key, id, coalesce(fingerprint_duration, duration_sec) AS duration
  FROM tracks WHERE missing_at IS NULL AND trim(artist) <> '' AND trim(title) <> '') QUALIFY count(duration) OVER (PARTITION BY key) > 0"""


@query("dup_metadata_clusters", _cluster_sql(_META))
def dup_metadata_clusters(spark, folder):
    """Duration clusters of equal artist and title."""
    return duplicates.metadata_clusters(load(spark, folder, "tracks")).select("id", "n")


def _parts_sql(number: int) -> str:
    return f"""part{number} AS (SELECT key, coalesce(CAST(anchor AS VARCHAR), 'unknown') AS cluster, list(id ORDER BY id) AS ids FROM placed{number} GROUP BY key, anchor HAVING count(*) > 1)"""


def _placed_sql(number: int, source: str) -> str:
    """The steps of a cluster pass with numbered names, so that several fit in one statement."""
    return f"""base{number} AS ({source}), shared{number} AS (SELECT key FROM base{number} GROUP BY key HAVING count(*) > 1),
      r{number} AS (SELECT b.*, row_number() OVER (PARTITION BY key ORDER BY duration, id) AS n FROM base{number} b SEMI JOIN shared{number} USING (key) WHERE duration IS NOT NULL),
      f{number} AS (SELECT key, id, n, duration, duration AS anchor FROM r{number} WHERE n = 1
        UNION ALL SELECT r.key, r.id, r.n, r.duration, CASE WHEN r.duration - f.anchor > 2.0 THEN r.duration ELSE f.anchor END FROM f{number} f JOIN r{number} r ON r.key = f.key AND r.n = f.n + 1),
      placed{number} AS (SELECT key, id, anchor FROM f{number} UNION ALL SELECT key, id, NULL FROM base{number} SEMI JOIN shared{number} USING (key) WHERE duration IS NULL)"""


_PRINTS = "SELECT chromaprint AS key, id, coalesce(fingerprint_duration, duration_sec) AS duration FROM tracks WHERE chromaprint IS NOT NULL AND missing_at IS NULL"


@query(
    "dup_groups",
    "WITH RECURSIVE " + ", ".join([_placed_sql(2, _PRINTS), _placed_sql(3, _META), _parts_sql(2), _parts_sql(3)])
    + """, part1 AS (SELECT list(id ORDER BY id) AS ids FROM tracks WHERE content_hash IS NOT NULL GROUP BY content_hash HAVING count(*) > 1),
      every AS (SELECT 1 AS pass, 'content' AS kind, ids FROM part1 UNION ALL SELECT 2, 'fingerprint', ids FROM part2 UNION ALL SELECT 3, 'metadata', ids FROM part3),
      kept AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY ids ORDER BY pass) = 1)
      SELECT kind, ids[1] AS first_id, unnest(ids) AS id FROM kept""",
)
def dup_groups(spark, folder):
    """Duplicate groups of all passes under their smallest member, equal sets of members once."""
    found = duplicates.duplicate_groups(load(spark, folder, "tracks"))
    first = found.groupBy("kind", "key", "cluster").agg(F.min("id").alias("first_id"))
    return found.join(first, ["kind", "key", "cluster"]).select("kind", "first_id", "id")


@query(
    "dup_repair_candidates",
    f"""WITH t AS (SELECT id, artist, lower(trim(title)) AS k FROM tracks WHERE {_ACTIVE} AND title IS NOT NULL AND length(lower(trim(title))) >= 8
         AND lower(trim(title)) NOT IN ('intro','outro','untitled','unknown','track','song','live')),
       d AS (SELECT k, min(artist) AS artist, count(*) AS donors FROM t WHERE artist IS NOT NULL AND trim(artist) <> '' GROUP BY k HAVING min(lower(trim(artist))) = max(lower(trim(artist))))
       SELECT t.id, d.artist, d.donors FROM t JOIN d USING (k) WHERE t.artist IS NULL OR trim(t.artist) = ''""",
)
def dup_repair_candidates(spark, folder):
    """Artists that tracks without one can take over from tracks of the same title."""
    tracks = load(spark, folder, "tracks")
    return duplicates.repair_candidates(tracks, F.lower(F.trim("title")))


# --- derived signals -------------------------------------------------------------------------------------------------


@query("feature_tags", f"WITH {_FEATURES}, {_TAGS} SELECT track_id, source, tag, score FROM tags")
def feature_tags(spark, folder):
    """Threshold tags of every track."""
    return _tags(spark, folder)


@query("context_fit", f"WITH {_FEATURES}, {_FITS} SELECT track_id, context, score, confidence FROM fits")
def context_fit(spark, folder):
    """How well every track fits each context."""
    return _fits(spark, folder).drop("evidence")


@query(
    "context_evidence",
    f"WITH {_FEATURES} " + " UNION ALL ".join(
        f"SELECT track_id, '{c}' AS context, '{key}' AS signal, round({_SOFT[part]}, 6) AS value FROM feats WHERE round({_context(c)}, 6) >= 0.05"
        for c in _STATED for key, part in _evidence(c)
    ),
)
def context_evidence(spark, folder):
    """What every context score is made of."""
    return _fits(spark, folder).select("track_id", "context", F.explode("evidence").alias("signal", "value"))


@query("perceived_tempo", f"WITH {_FEATURES} SELECT track_id, round({_TEMPO}, 6) AS tempo FROM feats")
def perceived_tempo(spark, folder):
    """The tempo a listener feels."""
    return _features(spark, folder).select("track_id", N.perceived_tempo(F.col("bpm")).alias("tempo"))


def _band_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} < 0.33 THEN 'low' WHEN {c} < 0.66 THEN 'medium' ELSE 'high' END"


@query(
    "profile_bands",
    f"""WITH {_FEATURES} SELECT track_id, {_band_sql('energy')} AS energy_band, {_band_sql('brightness')} AS brightness_band,
        CASE WHEN {_TEMPO} IS NULL THEN NULL WHEN {_TEMPO} < 85 THEN 'slow' WHEN {_TEMPO} < 110 THEN 'midtempo' WHEN {_TEMPO} < 132 THEN 'dance'
        WHEN {_TEMPO} < 160 THEN 'fast' ELSE 'very_fast' END AS tempo_band FROM feats""",
)
def profile_bands(spark, folder):
    """Features as bands."""
    return _features(spark, folder).select(
        "track_id", N.band(F.col("energy")).alias("energy_band"), N.band(F.col("brightness")).alias("brightness_band"),
        N.tempo_band(N.perceived_tempo(F.col("bpm"))).alias("tempo_band"),
    )


@query("profile_documents")
def profile_documents(spark, folder):
    """Profile text and fingerprint of every live track."""
    return _profiles(spark, folder).select("track_id", "profile_text", F.to_json("profile").alias("profile_json"), "source_fingerprint")


# --- retrieval -------------------------------------------------------------------------------------------------------

_TERMS = ["guitar", "quiet", "tape"]


@query(
    "text_search_bm25",
    """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
       d AS (SELECT doc_id, w, len(w) AS length FROM w WHERE len(w) > 0),
       g AS (SELECT count(*) AS n, avg(length) AS mean FROM d),
       tf AS (SELECT doc_id, length, t, len(list_filter(w, lambda x: x = t)) AS tf FROM d, (SELECT unnest(['guitar', 'quiet', 'tape']) AS t)),
       df AS (SELECT t, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY t),
       s AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
         FROM tf JOIN df USING (t), g WHERE tf > 0 GROUP BY doc_id)
       SELECT doc_id, round(score, 6) AS score FROM s""",
)
def text_search_bm25(spark, folder):
    """BM25 of every document that holds a query term."""
    found = retrieval.bm25(load(spark, folder, "documents"), "doc_id", "text", _TERMS)
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query(
    "text_search_all_terms",
    """SELECT doc_id FROM documents WHERE list_has_all(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), ['guitar', 'tape'])""",
)
def text_search_all_terms(spark, folder):
    """Documents that hold every query term."""
    return retrieval.bm25(load(spark, folder, "documents"), "doc_id", "text", ["guitar", "tape"], every=True).select("doc_id")


@query(
    "term_statistics",
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents WHERE text IS NOT NULL)
       SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM w GROUP BY term""",
)
def term_statistics(spark, folder):
    """Occurrences and documents of every term of the inverted index."""
    index = retrieval.postings(load(spark, folder, "documents"), "doc_id", "text")
    return index.groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("documents"))


_QUERY_VECTOR = [((i * 37) % 64 - 32) / 32.0 for i in range(64)]
_COSINE = f"list_cosine_similarity(embedding::DOUBLE[], {_QUERY_VECTOR}::DOUBLE[])"


@query("semantic_topk", f"SELECT vec_id AS id, round({_COSINE}, 6) AS similarity FROM embeddings ORDER BY {_COSINE} DESC, vec_id LIMIT 20")
def semantic_topk(spark, folder):
    """The vectors nearest to a query vector."""
    top = retrieval.cosine_top(load(spark, folder, "embeddings"), "vec_id", "embedding", _QUERY_VECTOR, 20)
    return top.select("id", F.round("similarity", 6).alias("similarity"))


@query(
    "tag_score",
    f"""WITH {_FEATURES}, {_TAGS} SELECT track_id, round(greatest(0, least(1, sum(CASE WHEN tag IN ('dark') THEN (score - 0.2) / 0.8 ELSE 0 END
        - CASE WHEN tag IN ('aggressive', 'fast') THEN (score - 0.2) / 0.8 ELSE 0 END))), 8) AS tag_score FROM tags WHERE score >= 0.2 GROUP BY track_id""",
)
def tag_score(spark, folder):
    """Wanted tags less unwanted ones."""
    return retrieval.tag_scores(_tags(spark, folder), ["dark"], ["aggressive", "fast"])


@query(
    "context_score",
    f"""WITH {_FEATURES}, {_FITS} SELECT track_id, round(max(score * (0.65 + 0.35 * confidence)), 6) AS context_score FROM fits
        WHERE context IN ('focus', 'background') GROUP BY track_id""",
)
def context_score(spark, folder):
    """The best of two wanted contexts."""
    return retrieval.context_scores(_fits(spark, folder), ["focus", "background"])


@query(
    "feature_score",
    f"WITH {_FEATURES} SELECT track_id, round(({_rng('energy', 0.6, 1.0, 0.20)} + {_rng(f'round({_TEMPO}, 6)', 110, 130, 30)}) / 2, 6) AS feature_score FROM feats",
)
def feature_score(spark, folder):
    """Closeness to wanted ranges of energy and tempo."""
    wanted = {"energy": (0.6, 1.0), "tempo_bpm": (110.0, 130.0)}
    return _features(spark, folder).select("track_id", F.round(retrieval.feature_score(wanted), 6).alias("feature_score"))


def _metadata_sql(terms: list[str]) -> str:
    wanted = "[" + ", ".join(f"'{t}'" for t in terms) + "]"
    parts = []
    for field, weight in retrieval.METADATA_WEIGHTS.items():
        own = f"list_distinct(list_filter(regexp_extract_all(lower({field}), '[a-z0-9]+'), lambda w: length(w) > 1))"
        common = f"len(list_intersect({own}, {wanted}))"
        value = f"""CASE WHEN {field} IS NULL OR {common} = 0 THEN 0 WHEN {common} = len({own}) THEN 1.0 WHEN {common} = {len(terms)} THEN 0.85
          WHEN {common} / {float(len(terms))} >= 0.5 THEN 0.55 WHEN {common} >= 2 THEN 0.35 ELSE 0.30 END"""
        parts.append(f"{weight}::DOUBLE * ({value})::DOUBLE")
    return f"SELECT id, round(greatest({', '.join(parts)})::DOUBLE, 6) AS metadata_score FROM tracks"


@query("metadata_score", _metadata_sql(["anthony", "pobrustain", "techno"]))
def metadata_score(spark, folder):
    """How well each track's metadata matches three words."""
    return load(spark, folder, "tracks").select("id", F.round(retrieval.metadata_score(["anthony", "pobrustain", "techno"]), 6).alias("metadata_score"))


_RATED = """rated AS (SELECT id, any_value(search_event_id) AS search_event_id, any_value(track_id) AS track_id, greatest(-1, least(1, any_value(rating))) AS rating,
  any_value(created_at) AS created_at FROM (SELECT DISTINCT id, search_event_id, track_id, rating, created_at FROM feedback WHERE rating IS NOT NULL AND track_id IS NOT NULL) GROUP BY id)"""


@query(
    "feedback_score",
    f"""WITH {_RATED} SELECT r.track_id, round(greatest(-1, least(1, avg(CASE WHEN lower(trim(e.query)) = 'calm music for late work' THEN rating * 1.0 ELSE rating * 0.25 END)::DOUBLE)), 6) AS feedback_score
        FROM rated r LEFT JOIN search_events e ON r.search_event_id = e.id GROUP BY r.track_id""",
)
def feedback_score(spark, folder):
    """Mean rating per track, other queries at a quarter."""
    return retrieval.feedback_scores(load(spark, folder, "feedback"), load(spark, folder, "search_events"), "calm music for late work")


@query(
    "feedback_latest",
    f"""WITH {_RATED} SELECT track_id, arg_max(rating, (r.created_at, r.id)) AS rating FROM rated r JOIN search_events e ON r.search_event_id = e.id
        WHERE e.query = 'calm music for late work' GROUP BY track_id""",
)
def feedback_latest(spark, folder):
    """The last rating per track for one query."""
    return retrieval.latest_feedback(load(spark, folder, "feedback"), load(spark, folder, "search_events"), "calm music for late work")


@query(
    "feedback_summary",
    f"""WITH {_RATED} SELECT count(*) AS events, count(*) FILTER (rating > 0) AS positive, count(*) FILTER (rating = 0) AS neutral,
        count(*) FILTER (rating < 0) AS negative, count(DISTINCT track_id) AS tracks, count(DISTINCT search_event_id) AS searches FROM rated""",
)
def feedback_summary(spark, folder):
    """Counts over the feedback log."""
    return retrieval.feedback_summary(load(spark, folder, "feedback"))


# --- hybrid search ---------------------------------------------------------------------------------------------------


def _library(spark: SparkSession, folder: str) -> ranking.Library:
    """The catalogue with its derived tables written once, as an indexing run would leave them."""
    features = cut_lineage(_features(spark, folder))
    tags, fits = cut_lineage(derive.feature_tags(features)), cut_lineage(derive.context_fit(features))
    tracks = load(spark, folder, "tracks")
    made = cut_lineage(derive.profiles(tracks, features, tags, fits).select("track_id", "profile_text"))
    return ranking.Library(tracks, features, tags, fits, made, load(spark, folder, "feedback"), load(spark, folder, "search_events"))


def _search(spark: SparkSession, folder: str, text: str, limit: int | None = None) -> DataFrame:
    library = _library(spark, folder)
    points = {r["field"]: r.asDict() for r in statistics.feature_percentiles(library.features).collect()}
    weights = [(r["tag"], r["tracks"] + r["avg_score"]) for r in statistics.tag_statistics(library.tags).collect()]
    found = ranking.search(library, parse_query(text, points, weights, limit))
    return found.select("rank", "track_id", "title", "artist", "score", ranking.confidence_label().alias("confidence"))


for _name, _text in {
    "feature_sort": "fastest tracks highest bpm", "occasion": "songs for a long drive", "context_vibe": "calm music for late work",
    "tag_genre": "aggressive", "feature_filter": "energetic but not aggressive high energy", "metadata_exact": "Anthony Pobrustain", "fallback": "xylophone zither",
}.items():

    def _run(spark, folder, text=_text):
        return _search(spark, folder, text)

    _run.__doc__ = f"The ranked results of '{_text}'."
    query(f"hybrid_search_{_name}")(_run)


@query("hybrid_evidence_counts")
def hybrid_evidence_counts(spark, folder):
    """Which kinds of evidence support the results of a query."""
    return ranking.evidence_sources(ranking.search(_library(spark, folder), parse_query("calm music for late work")))


@query("query_modes")
def query_modes(spark, folder):
    """The mode of every distinct logged query; the text is compiled in the workers, batch by batch."""
    @F.pandas_udf("string")
    def mode(s: pd.Series) -> pd.Series:
        return s.map(lambda q: mode_of(parse_query(q)))

    queries_ = load(spark, folder, "search_events").where("query IS NOT NULL").select("query").distinct()
    return queries_.select("query", mode("query").alias("mode"))


# --- matching --------------------------------------------------------------------------------------------------------


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    reports = load(spark, folder, "match_reports").where("track_a IS NOT NULL AND track_b IS NOT NULL AND track_a <> track_b")
    return reports.select("track_a", "track_b").distinct()


def _status_sql(c: str) -> str:
    return f"CASE WHEN a.{c} IS NULL OR b.{c} IS NULL OR a.{c} = '' OR b.{c} = '' THEN 'missing' WHEN a.{c} = b.{c} THEN 'match' ELSE 'mismatch' END"


@query(
    "pair_keys",
    f"""WITH p AS (SELECT DISTINCT track_a, track_b FROM match_reports WHERE track_a <> track_b),
        g AS (SELECT p.*, a.*, b.*, {_status_sql('content_hash')} AS content_hash_status, {_status_sql('chromaprint')} AS chromaprint_status,
          {_status_sql('artist_title_norm')} AS artist_title_status,
          abs(CASE WHEN a.fingerprint_duration IS NOT NULL AND b.fingerprint_duration IS NOT NULL THEN a.fingerprint_duration - b.fingerprint_duration ELSE a.duration_sec - b.duration_sec END) AS gap
          FROM p JOIN tracks a ON p.track_a = a.id JOIN tracks b ON p.track_b = b.id)
        SELECT track_a, track_b, content_hash_status, chromaprint_status, artist_title_status,
          CASE WHEN gap IS NULL THEN 'missing' WHEN gap <= 2 THEN 'match' ELSE 'mismatch' END AS duration_status,
          round(coalesce(greatest(1 - gap / 12, 0), 0), 6) AS duration_score FROM g""",
)
def pair_keys(spark, folder):
    """Evidence from keys and durations of every reported pair."""
    sides = matching.with_sides(_pairs(spark, folder), load(spark, folder, "tracks"), _features(spark, folder))
    d = matching.duration_evidence()
    return sides.select(
        "track_a", "track_b", matching.key_status(F.col("a.content_hash"), F.col("b.content_hash")).alias("content_hash_status"),
        matching.key_status(F.col("a.chromaprint"), F.col("b.chromaprint")).alias("chromaprint_status"),
        matching.key_status(F.col("a.artist_title_norm"), F.col("b.artist_title_norm")).alias("artist_title_status"),
        d["status"].alias("duration_status"), F.round(d["score"], 6).alias("duration_score"),
    )


def _audio(spark: SparkSession, folder: str) -> DataFrame | None:
    """The audio embeddings of tracks, where the folder's embeddings are of tracks."""
    found = load(spark, folder, "embeddings")
    return found if {"track_id", "kind", "model", "vector"} <= set(found.columns) else None


@query("pair_reports")
def pair_reports(spark, folder):
    """Full evidence, decision and score of every reported pair."""
    found = matching.reports(_pairs(spark, folder), load(spark, folder, "tracks"), _features(spark, folder), audio=_audio(spark, folder))
    return found.select("track_a", "track_b", "decision", "identity_decision", "confidence", "confidence_score", "candidate_score", "candidate_kind")


def _first_id(spark: SparkSession, folder: str) -> str:
    return load(spark, folder, "tracks").where("missing_at IS NULL AND content_hash IS NOT NULL").agg(F.min("id")).first()[0]


@query("closest_matches")
def closest_matches(spark, folder):
    """The tracks most like one track."""
    found = matching.closest_matches(_first_id(spark, folder), load(spark, folder, "tracks"), _features(spark, folder), audio=_audio(spark, folder))
    return found.select("rank", "track_b", "decision", "candidate_score", "candidate_kind")


@query("frame_alignment")
def frame_alignment(spark, folder):
    """Aligned fingerprint similarity of copies; frames are read from the fingerprint text four characters at a time."""
    tracks = load(spark, folder, "tracks").where("chromaprint IS NOT NULL AND content_hash IS NOT NULL")
    at = F.sequence(F.lit(1), F.greatest(F.length("chromaprint") - 3, F.lit(1)))
    frames = F.transform(at, lambda i: F.conv(F.hex(F.substring(F.col("chromaprint"), i, F.lit(4))), 16, 10).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))
    rows = tracks.select("id", "content_hash", frames.alias("frames"))
    shared = rows.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1")
    other = rows.select(F.col("id").alias("first"), F.col("frames").alias("f0"))
    pairs = rows.join(shared, "content_hash").where(F.col("id") != F.col("first")).join(other, "first")
    return pairs.select(F.col("first").alias("track_a"), F.col("id").alias("track_b"), F.round(matching.frame_similarity("f0", "frames"), 6).alias("similarity"))


# --- ingestion -------------------------------------------------------------------------------------------------------


def _snapshot(tracks: DataFrame) -> DataFrame:
    """A directory listing made from the stored rows: one folder gone, FLAC files rewritten, one folder new."""
    present = tracks.where(~F.contains("path", F.lit("/a0/")))
    size = F.col("file_size") + F.when(F.col("extension") == ".flac", 1).otherwise(0)
    new = tracks.where(F.contains("path", F.lit("/b1/"))).withColumn("path", F.replace("path", F.lit("/b1/"), F.lit("/zz/")))
    return present.select("path", size.alias("file_size"), "file_mtime_ns").unionByName(new.select("path", "file_size", "file_mtime_ns"))


_SNAPSHOT = """snap AS (SELECT path, file_size + CASE WHEN extension = '.flac' THEN 1 ELSE 0 END AS s1, file_mtime_ns AS m1 FROM tracks WHERE NOT contains(path, '/a0/')
  UNION ALL SELECT replace(path, '/b1/', '/zz/'), file_size, file_mtime_ns FROM tracks WHERE contains(path, '/b1/')),
  diff AS (SELECT coalesce(t.path, s.path) AS path, CASE WHEN t.id IS NULL THEN 'added' WHEN s.path IS NULL AND t.missing_at IS NOT NULL THEN 'still_missing'
  WHEN s.path IS NULL THEN 'missing' WHEN t.file_size IS DISTINCT FROM s.s1 OR t.file_mtime_ns IS DISTINCT FROM s.m1 THEN 'modified'
  WHEN t.missing_at IS NOT NULL THEN 'returned' ELSE 'unchanged' END AS status FROM tracks t FULL JOIN snap s ON t.path = s.path)"""


@query("scan_diff", f"WITH {_SNAPSHOT} SELECT path, status FROM diff")
def scan_diff(spark, folder):
    """What changed between the stored rows and a directory listing."""
    tracks = load(spark, folder, "tracks")
    return ingest.scan_diff(_snapshot(tracks), tracks)


@query("scan_summary", f"WITH {_SNAPSHOT} SELECT status, count(*) AS files FROM diff GROUP BY status")
def scan_summary(spark, folder):
    """How many files changed in which way."""
    tracks = load(spark, folder, "tracks")
    return ingest.scan_summary(ingest.scan_diff(_snapshot(tracks), tracks))


@query(
    "mark_missing",
    f"""WITH {_SNAPSHOT} SELECT id, CASE WHEN d.status = 'missing' THEN TIMESTAMP '2025-01-01 00:00:00' WHEN d.status IN ('returned', 'modified', 'unchanged') THEN NULL
        ELSE missing_at END AS missing_at FROM tracks t LEFT JOIN diff d USING (path)""",
)
def mark_missing(spark, folder):
    """The stored rows after a scan."""
    tracks = load(spark, folder, "tracks")
    at = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    return ingest.mark_missing(tracks, ingest.scan_diff(_snapshot(tracks), tracks), at).select("id", "missing_at")


@query(
    "invalidate_stale",
    f"""WITH {_SNAPSHOT} SELECT id, CASE WHEN d.status IS DISTINCT FROM 'modified' THEN content_hash END AS content_hash,
        CASE WHEN d.status IS DISTINCT FROM 'modified' THEN title END AS title, CASE WHEN d.status = 'modified' THEN 0 ELSE error_count END AS error_count
        FROM tracks t LEFT JOIN diff d USING (path)""",
)
def invalidate_stale(spark, folder):
    """Derived columns emptied where the file changed."""
    tracks = load(spark, folder, "tracks")
    return ingest.invalidate(tracks, ingest.scan_diff(_snapshot(tracks), tracks)).select("id", "content_hash", "title", "error_count")


@query(
    "quarantine",
    """WITH o AS (SELECT id, count(*) FILTER (extension = '.wav') AS failures, bool_or(extension <> '.wav') AS ok FROM tracks WHERE extension IN ('.wav', '.ogg') GROUP BY id),
       n AS (SELECT t.id, t.error_count, t.quarantined_at, o.failures, o.ok, CASE WHEN o.ok THEN 0 ELSE coalesce(t.error_count, 0) + coalesce(o.failures, 0) END AS c FROM tracks t LEFT JOIN o USING (id))
       SELECT id, CAST(CASE WHEN failures IS NOT NULL THEN c ELSE error_count END AS INTEGER) AS error_count,
       CASE WHEN failures IS NULL THEN quarantined_at WHEN ok THEN NULL WHEN c >= 3 AND quarantined_at IS NULL THEN TIMESTAMP '2025-01-01 00:00:00' ELSE quarantined_at END AS quarantined_at FROM n""",
)
def quarantine(spark, folder):
    """Failures counted up to quarantine, success clearing both."""
    tracks = load(spark, folder, "tracks")
    outcomes = tracks.where("extension IN ('.wav', '.ogg')").select("id", (F.col("extension") == ".wav").alias("failed"))
    return ingest.apply_outcomes(tracks, outcomes, F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")).select("id", "error_count", "quarantined_at")


@query(
    "prune_cascade",
    """SELECT 'audio_features' AS part, count(*) AS kept FROM audio_features WHERE track_id NOT IN (SELECT id FROM tracks WHERE missing_at IS NOT NULL)
       UNION ALL SELECT 'feedback', count(*) FROM feedback WHERE track_id IS NULL OR track_id NOT IN (SELECT id FROM tracks WHERE missing_at IS NOT NULL)
       UNION ALL SELECT 'tracks', count(*) FROM tracks WHERE missing_at IS NULL""",
)
def prune_cascade(spark, folder):
    """Rows left in each table after pruning the missing tracks."""
    children = {n: (load(spark, folder, n), "track_id") for n in ("audio_features", "feedback")}
    kept = ingest.prune_missing(load(spark, folder, "tracks"), children)
    rows = [df.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(n).alias("part"), "kept") for n, df in kept.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "upsert_latest",
    """SELECT track_id, field_name, arg_max(value_text, (created_at, id)) FILTER (value_text IS NOT NULL) AS value_text, max(created_at) AS created_at
       FROM track_metadata_claims WHERE track_id IS NOT NULL AND value_text IS NOT NULL AND created_at IS NOT NULL GROUP BY track_id, field_name""",
)
def upsert_latest(spark, folder):
    """A claim table brought up to date by its later half, one row per track and field."""
    rows = load(spark, folder, "track_metadata_claims").where("track_id IS NOT NULL AND value_text IS NOT NULL AND created_at IS NOT NULL")
    rows = rows.select("track_id", "field_name", "id", "value_text", "created_at")
    late = F.col("created_at") >= F.lit("2024-01-01").cast("timestamp_ntz")
    return ingest.upsert(rows.where(~late), rows.where(late), ["track_id", "field_name"], ["created_at", "id"]).select("track_id", "field_name", "value_text", "created_at")


# --- claims and repair -----------------------------------------------------------------------------------------------


@query(
    "claim_selection",
    """SELECT track_id, field_name, arg_max(struct_pack(v := value_text, c := confidence), (coalesce(confidence, 0), created_at, id)).v AS claim,
       round(arg_max(struct_pack(v := value_text, c := confidence), (coalesce(confidence, 0), created_at, id)).c, 6) AS confidence
       FROM track_metadata_claims WHERE value_text IS NOT NULL AND track_id IS NOT NULL AND field_name IS NOT NULL GROUP BY ALL""",
)
def claim_selection(spark, folder):
    """The claim of highest confidence per track and field."""
    return claims.best_claims(load(spark, folder, "track_metadata_claims"))


@query(
    "metadata_confidence",
    """WITH f AS (SELECT id AS track_id, unnest([struct_pack(f := 'title', v := lower(trim(title))), struct_pack(f := 'artist', v := lower(trim(artist))),
         struct_pack(f := 'album', v := lower(trim(album))), struct_pack(f := 'genre', v := lower(trim(genre)))], recursive := true) FROM tracks),
       b AS (SELECT f.track_id, f.f, max(confidence) AS c FROM f JOIN track_metadata_claims m ON m.track_id = f.track_id AND m.field_name = f.f AND lower(trim(m.value_text)) = f.v
         WHERE f.v <> '' AND confidence BETWEEN 0 AND 1 GROUP BY ALL)
       SELECT track_id, round(avg(c), 6) AS metadata_confidence FROM b GROUP BY track_id""",
)
def metadata_confidence(spark, folder):
    """How well claims back what each track says."""
    return claims.metadata_confidence(load(spark, folder, "tracks"), load(spark, folder, "track_metadata_claims"))


# --- evaluation ------------------------------------------------------------------------------------------------------

_RESULTS = """res AS (SELECT id AS search_id, unnest(from_json(result_track_ids_json, '["VARCHAR"]')) AS track_id, generate_subscripts(from_json(result_track_ids_json, '["VARCHAR"]'), 1) AS rank
  FROM search_events WHERE result_track_ids_json IS NOT NULL)"""


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.distinct_feedback(load(spark, folder, "feedback")).select(F.col("search_event_id").alias("search_id"), "track_id", "rating")


@query(
    "eval_precision",
    f"""WITH {_RESULTS}, {_RATED}, good AS (SELECT DISTINCT search_event_id AS search_id, track_id FROM rated WHERE rating > 0),
        top AS (SELECT r.*, g.track_id IS NOT NULL AS good FROM res r LEFT JOIN good g USING (search_id, track_id) WHERE rank <= 5)
        SELECT search_id, count(*) AS returned, count(*) FILTER (good) AS relevant, round(count(*) FILTER (good) / count(*)::DOUBLE, 6) AS precision,
        round(coalesce(max(CASE WHEN good THEN 1.0::DOUBLE / rank END), 0), 6) AS reciprocal_rank FROM top GROUP BY search_id""",
)
def eval_precision(spark, folder):
    """Precision of every logged search against its ratings."""
    return evaluation.judged_precision(evaluation.result_rows(load(spark, folder, "search_events")), _judged(spark, folder))


@query(
    "eval_diversity",
    f"""WITH {_RESULTS}, j AS (SELECT search_id, lower(trim(artist)) AS a, lower(trim(title)) AS t FROM res JOIN tracks ON res.track_id = tracks.id)
        SELECT search_id, count(DISTINCT a) AS artists, round(1 - count(DISTINCT coalesce(a, '') || chr(31) || coalesce(t, '')) / count(*)::DOUBLE, 6) AS duplicate_rate FROM j GROUP BY search_id""",
)
def eval_diversity(spark, folder):
    """How varied the results of every logged search are."""
    return evaluation.diversity(evaluation.result_rows(load(spark, folder, "search_events")), load(spark, folder, "tracks"))


# --- pooling ---------------------------------------------------------------------------------------------------------


@query(
    "pooled_vectors",
    """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings)
       SELECT label, CAST(p - 1 AS INTEGER) AS pos, round(avg(x), 6) AS x FROM x GROUP BY label, p""",
)
def pooled_vectors(spark, folder):
    """Mean vector of every label."""
    pooled = analysis.pool_vectors(load(spark, folder, "embeddings"), "label", None, "embedding")
    return pooled.select("label", F.posexplode("vector").alias("pos", "x"))


@query(
    "pooled_scalars",
    """SELECT codec, round(sum(duration_sec * file_size) / sum(file_size) FILTER (duration_sec IS NOT NULL), 6) AS duration_sec
       FROM (SELECT codec, duration_sec, coalesce(file_size, 1)::DOUBLE AS file_size FROM tracks) GROUP BY codec""",
)
def pooled_scalars(spark, folder):
    """Mean duration per codec, weighted by file size."""
    return analysis.pool_chunks(load(spark, folder, "tracks"), "codec", "file_size", ["duration_sec"])


@query(
    "top_tags",
    f"""WITH {_FEATURES}, {_TAGS} SELECT track_id, tag, score FROM tags WHERE score >= 0.5
        QUALIFY row_number() OVER (PARTITION BY track_id, source ORDER BY score DESC, tag) <= 3""",
)
def top_tags(spark, folder):
    """The three best tags of every track."""
    return analysis.top_tags(analysis.best_tags(_tags(spark, folder)), 3, 0.5).select("track_id", "tag", "score")


@query(
    "eval_summary",
    f"""WITH {_RESULTS}, {_RATED}, good AS (SELECT DISTINCT search_event_id AS search_id, track_id FROM rated WHERE rating > 0),
        top AS (SELECT search_id, count(*) FILTER (g.track_id IS NOT NULL) > 0 AS passed FROM res r LEFT JOIN good g USING (search_id, track_id) WHERE rank <= 5 GROUP BY search_id)
        SELECT 'liked_in_top' AS "check", count(*) AS cases, count(*) FILTER (passed) AS passed, round(avg(passed::INT), 6) AS pass_rate FROM top""",
)
def eval_summary(spark, folder):
    """How many logged searches have a liked track among their first five."""
    scored = evaluation.judged_precision(evaluation.result_rows(load(spark, folder, "search_events")), _judged(spark, folder))
    return evaluation.summary(scored.select(F.lit("liked_in_top").alias("check"), (F.col("relevant") > 0).alias("passed")))
