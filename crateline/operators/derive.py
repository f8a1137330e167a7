"""Derived signals: threshold tags, context fit and profile documents, all as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateline.functions import numeric as N

#: Fixed value: where derived tags say they come from.
TAG_SOURCE = "derived:features"
PROFILE_VERSION = 2


def one_row_per_track(features: DataFrame) -> DataFrame:
    """Feature rows without repeated deliveries; of several rows of a track the latest."""
    columns = [c for c in features.columns if c != "track_id"]
    newest = F.max_by(F.struct(*columns), F.struct(F.col("updated_at"), F.xxhash64(*columns))).alias("r")
    return features.where(F.col("track_id").isNotNull()).groupBy("track_id").agg(newest).select("track_id", "r.*")


def _range(x: str, low: float | None, high: float | None, softness: float) -> str:
    """SQL of ``numeric.range_score``; one-sided where a bound is None."""
    gaps = [f"{low}D - {x}"] * (low is not None) + [f"{x} - {high}D"] * (high is not None)
    return f"CASE WHEN {x} IS NULL OR isnan({x}) THEN 0D ELSE greatest(1D - greatest({', '.join(gaps)}, 0D) / {softness}D, 0D) END"


#: The soft thresholds from which tags and context scores are built, as SQL over a row's features.
SOFT_SIGNALS = {
    "low_aggr": _range("aggression", None, 0.35, 0.35),
    "very_low_aggr": _range("aggression", None, 0.22, 0.30),
    "med_energy": _range("energy", 0.25, 0.68, 0.30),
    "low_mid_energy": _range("energy", 0.18, 0.58, 0.30),
    "high_energy": _range("energy", 0.62, None, 0.35),
    "dance": _range("danceability", 0.58, None, 0.35),
    "groove": _range("danceability", 0.42, 0.82, 0.30),
    "calm_dance": _range("danceability", 0.20, 0.62, 0.35),
    "dark": _range("brightness", None, 0.42, 0.35),
    "balanced": _range("brightness", 0.30, 0.68, 0.30),
    "bright": _range("brightness", 0.58, None, 0.35),
    "warm": _range("brightness", 0.28, 0.58, 0.35),
    "dance_tempo": _range("tempo", 110, 132, 35),
    "mid_tempo": _range("tempo", 80, 124, 45),
    "fast_tempo": _range("tempo", 125, None, 45),
    "driving_tempo": _range("tempo", 85, 150, 45),
    "bg_energy": _range("energy", 0.14, 0.52, 0.25),
    "soft_bright": _range("brightness", None, 0.68, 0.30),
    "soft_dance": _range("danceability", None, 0.68, 0.35),
    "pushing": _range("aggression", 0.45, None, 0.45),
    "no_vocal": (
        "CASE WHEN vocalness IS NULL AND instrumentalness IS NULL THEN 0.35D "
        f"ELSE greatest({_range('vocalness', None, 0.20, 0.30)}, {_range('instrumentalness', 0.70, None, 0.30)}) END"
    ),
    "heard": "vocalness IS NOT NULL OR instrumentalness IS NOT NULL",
}


#: The parts of each context score, under the names its evidence gives them, and how sure it is.
CONTEXTS: dict[str, tuple[dict[str, str], float]] = {
    "background": ({"low_aggression": "low_aggr", "background_energy": "bg_energy", "not_too_bright": "soft_bright", "not_too_danceable": "soft_dance"}, 0.68),
    "lounge_bar": ({"low_aggression": "low_aggr", "medium_energy": "med_energy", "warmth": "warm", "groove": "groove", "mid_tempo": "mid_tempo"}, 0.74),
    "warm_lounge": ({"warmth": "warm", "low_aggression": "low_aggr", "low_mid_energy": "low_mid_energy", "groove": "groove", "balanced_brightness": "balanced"}, 0.74),
    "dinner": ({"low_aggression": "low_aggr", "low_mid_energy": "low_mid_energy", "warmth": "warm", "background": "bg"}, 0.70),
    "cooking": ({"medium_energy": "med_energy", "low_aggression": "low_aggr", "groove": "groove", "balanced_brightness": "balanced"}, 0.70),
    "focus": ({"very_low_aggression": "very_low_aggr", "low_mid_energy": "low_mid_energy", "calm_dance": "calm_dance", "low_vocal_or_instrumental": "no_vocal"}, 0.78),
    "dark_ambient": ({"dark": "dark", "low_aggression": "low_aggr", "low_mid_energy": "low_mid_energy", "not_too_danceable": "calm_dance"}, 0.72),
    "no_vocals_background": ({"low_vocal_or_instrumental": "no_vocal", "low_aggression": "low_aggr", "background_energy": "bg_energy", "background": "bg"}, 0.82),
    "party": ({"high_energy": "high_energy", "danceable": "dance", "bright": "bright", "not_too_aggressive": "low_aggr"}, 0.72),
    "club": ({"danceable": "dance", "dance_tempo": "dance_tempo", "high_energy": "high_energy", "not_too_aggressive": "low_aggr"}, 0.76),
    "workout": ({"high_energy": "high_energy", "fast_tempo": "fast_tempo", "danceable": "dance", "aggression": "pushing"}, 0.72),
    "driving": ({"medium_or_high_energy": "any_energy", "driving_tempo": "driving_tempo", "groove": "groove", "not_too_aggressive": "low_aggr"}, 0.72),
}
KEPT_SCORE = 0.05


def with_signals(features: DataFrame) -> DataFrame:
    """(track_id, inputs, soft signals, scores of the contexts), each computed once and then named.

    Later steps refer to the names, so that the expressions do not multiply in the plan.
    """
    slim = features.select("track_id", "bpm", "energy", "danceability", "aggression", "brightness", "vocalness", "instrumentalness")
    out = slim.withColumn("tempo", N.perceived_tempo(F.col("bpm")))
    out = out.selectExpr("*", *[f"{sql} AS {name}" for name, sql in SOFT_SIGNALS.items()])
    out = out.selectExpr("*", "low_mid_energy * low_aggr AS bg", "greatest(med_energy, high_energy) AS any_energy")
    scores = {name: f"({' + '.join(parts.values())}) / {len(parts)}D" for name, (parts, _) in CONTEXTS.items()}
    quiet = scores["no_vocals_background"]
    scores["no_vocals_background"] = f"CASE WHEN heard THEN {quiet} ELSE least({quiet}, 0.45D) END"
    return out.selectExpr("*", *[f"{sql} AS fit_{name}" for name, sql in scores.items()])


def _confidence(context: str) -> str:
    """SQL of how sure a context score is; without vocal evidence some are less."""
    sure = CONTEXTS[context][1]
    unheard = {"focus": 0.56, "no_vocals_background": 0.34}.get(context)
    return f"{sure}D" if unheard is None else f"CASE WHEN heard THEN {sure}D ELSE {unheard}D END"


def context_fit(features: DataFrame) -> DataFrame:
    """(track_id, context, score, confidence, evidence) of scores of at least 0.05."""
    rows = []
    for name, (parts, _) in CONTEXTS.items():
        evidence = ", ".join(f"'{key}', round({signal}, 6)" for key, signal in parts.items())
        rows.append(f"named_struct('context', '{name}', 'score', round(fit_{name}, 6), 'confidence', {_confidence(name)}, 'evidence', map({evidence}))")
    exploded = with_signals(features).selectExpr("track_id", f"inline(array({', '.join(rows)}))")
    return exploded.where(F.col("score") >= KEPT_SCORE)


#: The derived tags, what they are read from and from when they count.
TAG_RULES = (
    ("low_energy", _range("energy", None, 0.38, 0.35), 0.35),
    ("medium_energy", _range("energy", 0.30, 0.70, 0.30), 0.35),
    ("high_energy", "high_energy", 0.35),
    ("danceable", "dance", 0.35),
    ("not_danceable", _range("danceability", None, 0.42, 0.35), 0.35),
    ("low_aggression", "low_aggr", 0.35),
    ("aggressive", _range("aggression", 0.62, None, 0.35), 0.75),
    ("dark", "dark", 0.35),
    ("bright", "bright", 0.35),
    ("slow", _range("tempo", None, 95, 45), 0.35),
    ("midtempo", _range("tempo", 85, 125, 45), 0.35),
    ("fast", "fast_tempo", 0.35),
    ("dance_tempo", "dance_tempo", 0.35),
    ("background_friendly", "fit_background", 0.85),
    ("focus_friendly", "fit_focus", 0.85),
    ("lounge_friendly", "fit_lounge_bar", 0.70),
    ("warm_lounge", "fit_warm_lounge", 0.70),
    ("club_friendly", "fit_club", 0.70),
    ("no_vocals_background", "CASE WHEN heard THEN fit_no_vocals_background ELSE 0D END", 0.78),
)


def feature_tags(features: DataFrame) -> DataFrame:
    """(track_id, source, tag, score): threshold tags and the tags of strong context scores."""
    rows = ", ".join(f"named_struct('tag', '{tag}', 's', {sql}, 'least', {least}D)" for tag, sql, least in TAG_RULES)
    exploded = with_signals(features).selectExpr("track_id", f"inline(array({rows}))").where("s >= least")
    return exploded.selectExpr("track_id", f"'{TAG_SOURCE}' AS source", "tag", "round(s, 6) AS score")


#: The groups in which a profile lists its tags.
TAG_GROUPS = {
    "energy": ("low_energy", "medium_energy", "high_energy"),
    "rhythm": ("danceable", "not_danceable", "slow", "midtempo", "fast", "dance_tempo"),
    "mood": ("low_aggression", "aggressive", "dark", "bright"),
    "context": ("background_friendly", "focus_friendly", "lounge_friendly", "warm_lounge", "club_friendly", "no_vocals_background"),
}


def profiles(tracks: DataFrame, features: DataFrame, tags: DataFrame, fits: DataFrame) -> DataFrame:
    """(track_id, profile_text, profile, source_fingerprint): one document per live track.

    ``profile`` is a struct; its SHA-256 tells whether a stored profile is stale.
    """
    t = tracks.where(F.col("missing_at").isNull()).select(
        F.col("id").alias("track_id"), "title", "artist", "album", "genre", "date", "duration_sec"
    )
    f = features.select("track_id", "bpm", "energy", "danceability", "aggression", "brightness", "vocalness", "instrumentalness")
    tag_list = tags.groupBy("track_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    fit_list = fits.where(F.col("score") >= 0.5).groupBy("track_id").agg(F.sort_array(F.collect_set("context")).alias("contexts"))
    rows = t.join(f, "track_id", "left").join(tag_list, "track_id", "left").join(fit_list, "track_id", "left")
    empty = F.array().cast("array<string>")
    rows = rows.withColumns({"tags": F.coalesce(F.col("tags"), empty), "contexts": F.coalesce(F.col("contexts"), empty), "tempo": N.perceived_tempo(F.col("bpm"), F.col("genre"))})
    tags_of, contexts_of, tempo = F.col("tags"), F.col("contexts"), F.col("tempo")
    rows = rows.withColumn(
        "bands",
        F.struct(
            N.band(F.col("aggression")).alias("aggression"), N.band(F.col("brightness")).alias("brightness"),
            N.band(F.col("danceability")).alias("danceability"), N.band(F.col("energy")).alias("energy"), N.tempo_band(tempo).alias("tempo"),
        ),
    )
    bands = F.col("bands")
    grouped = F.struct(*[F.array_intersect(tags_of, F.array(*[F.lit(t) for t in g])).alias(name) for name, g in sorted(TAG_GROUPS.items())])
    has = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c)) != "")
    quality = F.struct(
        N.completeness([F.col(c).isNotNull() for c in ("bpm", "energy", "danceability", "aggression", "brightness")], 5).alias("features"),
        N.completeness([has(c) for c in ("title", "artist", "album", "genre")], 4).alias("metadata"),
        F.least(F.size(tags_of) / 8.0, F.lit(1.0)).alias("tags"),
    )
    warnings = F.array_compact(
        F.array(
            F.when(~has("title"), F.lit("missing_title")),
            F.when(~has("artist"), F.lit("missing_artist")),
            F.when(F.col("energy").isNull(), F.lit("missing_features")),
            F.when(F.size(tags_of) == 0, F.lit("missing_tags")),
            F.when(F.col("vocalness").isNull() & F.col("instrumentalness").isNull(), F.lit("missing_vocal_evidence")),
        )
    )
    said = lambda label, c: F.when(c.isNotNull() & (F.trim(c.cast("string")) != ""), F.concat(F.lit(label), c))
    spoken = lambda c: F.when(F.size(c) > 0, F.translate(F.array_join(c, ", "), "_", " "))
    text = F.concat_ws(
        ". ",
        said("Title: ", F.col("title")), said("Artist: ", F.col("artist")), said("Album: ", F.col("album")), said("Genre: ", F.col("genre")),
        said("Tempo: ", bands["tempo"]), said("Energy: ", bands["energy"]), said("Tags: ", spoken(tags_of)), said("Fits: ", spoken(contexts_of)),
    )
    boost = F.array_distinct(F.concat(tags_of, contexts_of))
    profile = F.struct(
        bands.alias("bands"), boost.alias("boost_terms"), contexts_of.alias("contexts"), quality.alias("quality"),
        F.lit(PROFILE_VERSION).alias("schema_version"), grouped.alias("tag_groups"), warnings.alias("warnings"),
    )
    out = rows.select("track_id", text.alias("profile_text"), profile.alias("profile"))
    return out.withColumn("source_fingerprint", F.sha2(F.concat_ws("\x1f", "profile_text", F.to_json("profile")), 256))
