"""Hybrid ranking: signals joined by track, calibrated weights by mode, mode ordering and the evidence cascade."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crateline.functions import numeric as N
from crateline.operators import retrieval as R
from crateline.plans.intent import Intent, content_terms, mode_of

#: Weights of the components by mode, and what any feedback changes.
WEIGHTS = {
    "metadata_exact": {"semantic": 0.08, "metadata": 0.78, "context": 0.0, "tags": 0.08, "features": 0.0, "text": 0.34},
    "tag_genre": {"semantic": 0.16, "metadata": 0.42, "context": 0.06, "tags": 0.52, "features": 0.06, "text": 0.30},
    "feature_sort": {"semantic": 0.10, "metadata": 0.40, "context": 0.10, "tags": 0.30, "features": 0.34, "text": 0.22},
    "feature_filter": {"semantic": 0.18, "metadata": 0.42, "context": 0.12, "tags": 0.38, "features": 0.46, "text": 0.22},
}
VIBE = {"semantic": 0.42, "metadata": 0.42, "context": 0.32, "tags": 0.32, "features": 0.34, "text": 0.16}
MEANINGFUL, WEAK = 0.05, 0.12

#: The contexts that answer a wanted one.
FITS = {
    "bar": ("lounge_bar", "warm_lounge", "background"), "chill": ("background", "lounge_bar", "focus"),
    "background": ("background", "no_vocals_background"), "cooking": ("cooking", "dinner", "background"),
    "dinner": ("dinner", "warm_lounge", "lounge_bar", "background"), "focus": ("focus", "background", "no_vocals_background"),
    "ambient": ("dark_ambient", "background", "focus"), "dark": ("dark_ambient",),
    "no_vocals_background": ("no_vocals_background", "background", "focus"), "party": ("party", "club"),
    "wedding": ("party", "dinner", "warm_lounge", "lounge_bar"), "workout": ("workout", "club"), "shower": ("party", "club", "driving"),
    "driving": ("driving", "club"), "sleep": ("background", "dark_ambient"),
}


@dataclass
class Library:
    """The tables a search reads."""

    tracks: DataFrame
    features: DataFrame
    tags: DataFrame
    fits: DataFrame
    profiles: DataFrame
    feedback: DataFrame | None = None
    events: DataFrame | None = None


def weights_of(mode: str, semantic: bool, context: bool, feedback: bool) -> dict[str, float]:
    w = dict(WEIGHTS.get(mode, VIBE))
    w["semantic"] *= semantic
    w["context"] *= context
    w["feedback"] = 0.18 if feedback else 0.0
    if feedback:
        w["features"], w["text"] = max(0.0, w["features"] - 0.04), max(0.0, w["text"] - 0.03)
    return w


def calibrated(weights: dict[str, float]) -> Column:
    """The weighted mean of the components, within 0..1."""
    used = {k: v for k, v in weights.items() if v > 0}
    total = sum(used.values()) or 1.0
    parts = [F.lit(v) * F.col(k) for k, v in used.items()] or [F.lit(0.0)]
    return N.clamp(sum(parts[1:], parts[0]) / total)


def signals(library: Library, intent: Intent, similarity: DataFrame | None = None) -> DataFrame:
    """One row per live track with every component score.

    All signals are keyed by track id, so they share one partitioning.
    """
    tracks = library.tracks.where(F.col("missing_at").isNull())
    base = tracks.select(
        F.col("id").alias("track_id"), "path", "title", "artist", "album", "album_artist", "genre", F.round(R.metadata_score(content_terms(intent)), 6).alias("metadata")
    )
    felt = N.perceived_tempo(F.col("bpm"))
    scored = library.features.select(
        "track_id", F.round(R.feature_score(intent.ranges), 6).alias("features"), felt.alias("tempo_bpm"), "energy", "danceability", "aggression", "brightness"
    )
    text = R.reciprocal_ranks(R.bm25(library.profiles, "track_id", "profile_text", intent.terms))
    held = F.lit(0)
    for t in intent.terms:
        held = held + F.contains(F.lower("profile_text"), F.lit(t)).cast("int")
    share = library.profiles.select("track_id", (held / float(max(1, len(intent.terms)))).alias("_share"))
    text = share.join(text.select(F.col("doc_id").alias("track_id"), "text_score"), "track_id", "left")
    text = text.select("track_id", F.round(F.greatest(F.coalesce("text_score", F.lit(0.0)), "_share"), 6).alias("text"))
    tags = R.tag_scores(library.tags, intent.prefer, intent.avoid).withColumnRenamed("tag_score", "tags")
    wanted = sorted({f for c in intent.contexts for f in FITS.get(c, (c,))})
    fits = R.context_scores(library.fits, wanted).withColumnRenamed("context_score", "context")
    out = base.join(scored, "track_id", "left").join(text, "track_id", "left").join(tags, "track_id", "left").join(fits, "track_id", "left")
    if library.feedback is not None and library.events is not None:
        marks = R.feedback_scores(library.feedback, library.events, intent.query).withColumnRenamed("feedback_score", "feedback")
        out = out.join(marks, "track_id", "left")
    else:
        out = out.withColumn("feedback", F.lit(0.0))
    if similarity is not None:
        near = similarity.select(F.col("id").alias("track_id"), F.round(N.semantic_relevance(F.col("similarity")), 6).alias("semantic"))
        out = out.join(near, "track_id", "left")
    else:
        out = out.withColumn("semantic", F.lit(0.0))
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("metadata", "features", "text", "tags", "context", "feedback", "semantic")})


def mode_order(mode: str) -> list[Column]:
    """The ordering of a mode: all keys falling, the path rising last."""
    strong = (F.col("metadata") >= 0.65).cast("int")
    direct = ((F.col("metadata") > 0) | (F.col("tags") > 0) | (F.col("text") >= 1.0)).cast("int")
    other = ((F.col("metadata") > 0) | (F.col("tags") > 0) | (F.col("text") > 0) | (F.col("semantic") >= 0.45)).cast("int")
    keys = {
        "metadata_exact": [strong, F.col("metadata"), (F.col("text") >= 1.0).cast("int"), F.col("text"), F.col("score")],
        "tag_genre": [direct, F.col("tags"), F.col("text"), F.col("metadata"), F.col("semantic"), F.col("score")],
        "feature_filter": [F.col("features"), F.col("tags"), F.col("metadata"), F.col("text"), F.col("score")],
        "feature_sort": [other, F.col("tags"), F.col("metadata"), F.col("text"), F.col("semantic"), F.col("score")],
        "fallback_semantic": [(F.col("metadata") >= 0.8).cast("int"), F.col("score")],
    }.get(mode, [F.col("context"), F.col("tags"), F.col("features"), F.col("semantic"), F.col("score")])
    return [*[k.desc() for k in keys], F.col("path").asc()]


def keep_evident(rows: DataFrame, intent: Intent, mode: str) -> DataFrame:
    """The cascade of evidence: rows of the first rung that any row reaches.

    Which rungs are reached is one row of flags over all candidates, joined back
    by broadcast of that single row; candidates are never collected.
    """
    meaningful = F.col("score") >= MEANINGFUL
    evident = (F.col("metadata") > 0) | (F.col("tags") > 0) | (F.col("context") > 0) | (F.col("features") > 0) | (F.col("text") > 0) | (F.col("semantic") >= 0.45)
    if mode == "feature_sort":
        sortable = F.coalesce(*[F.col(f) for f, _ in intent.sorts]).isNotNull()
        content = (F.col("metadata") > 0) | (F.col("tags") > 0) | (F.col("text") > 0)
        rungs = [sortable & content, sortable & (F.col("semantic") >= 0.45), sortable] if content_terms(intent) else [sortable]
    elif mode == "metadata_exact":
        rungs = [meaningful & (F.col("metadata") >= 0.65), meaningful & (F.col("text") >= 1.0), meaningful]
    elif mode == "tag_genre":
        rungs = [meaningful & ((F.col("tags") > 0) | (F.col("metadata") > 0)), meaningful]
    elif intent.contexts or intent.prefer_tags:
        rungs = [meaningful & evident, meaningful]
    else:
        rungs = [meaningful]
    rungs.append((F.col("score") > 0) & evident)
    names = [f"_r{i}" for i in range(len(rungs))]
    marked = rows.withColumns(dict(zip(names, rungs, strict=True)))
    flags = marked.agg(*[F.bool_or(n).alias(f"_any{n}") for n in names])
    reached = F.lit(False)
    for n in reversed(names):
        reached = F.when(F.col(f"_any{n}"), F.col(n)).otherwise(reached)
    kept = marked.join(F.broadcast(flags), F.lit(True)).where(reached)
    return kept.drop(*names, *[f"_any{n}" for n in names])


def search(library: Library, intent: Intent, similarity: DataFrame | None = None) -> DataFrame:
    """The ranked results of a query: component scores, score and rank, at most ``intent.limit`` rows."""
    mode = mode_of(intent)
    rated = library.feedback is not None and not library.feedback.isEmpty()
    weights = weights_of(mode, similarity is not None, bool(intent.contexts), rated)
    rows = signals(library, intent, similarity).withColumn("score", F.round(calibrated(weights), 6))
    rows = keep_evident(rows, intent, mode)
    order = mode_order(mode)
    if intent.sorts:
        explicit = [x for f, d in intent.sorts for x in (F.col(f).isNull().asc(), F.col(f).desc() if d == "desc" else F.col(f).asc())]
        order = [*explicit, F.desc("score"), F.asc("path")]
    best = rows.orderBy(*order).limit(intent.limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def evidence_sources(results: DataFrame) -> DataFrame:
    """(source, tracks): how many results each kind of evidence supports."""
    kinds = ("metadata", "tags", "context", "features", "text", "semantic", "feedback")
    found = F.array_compact(F.array(*[F.when(F.col(k) > 0, F.lit(k)) for k in kinds]))
    return results.select(F.explode(found).alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("tracks"))


def confidence_label() -> Column:
    """high, medium or low, from the score and how many signals support it."""
    signals_ = sum(((F.col(k) > 0).cast("int") for k in ("tags", "context", "features", "text", "semantic")), (F.col("metadata") > 0).cast("int"))
    return F.when((F.col("score") >= 0.45) & (signals_ >= 2), "high").when((F.col("score") >= 0.25) & (F.col("metadata") > 0) | (F.col("score") >= 0.35) & (signals_ >= 1), "medium").otherwise("low")


def per_artist(results: DataFrame, most: int = 2) -> DataFrame:
    """Results with at most ``most`` tracks per artist, best first."""
    own = Window.partitionBy(F.lower(F.trim("artist"))).orderBy("rank")
    return results.withColumn("_n", F.row_number().over(own)).where((F.col("_n") <= most) | F.col("artist").isNull()).drop("_n")


def first_of_identity(results: DataFrame, keys: list[Column]) -> DataFrame:
    """Results without those that repeat any identity key of a better one."""
    out = results
    for i, key in enumerate(keys):
        first = Window.partitionBy(f"_k{i}").orderBy("rank")
        out = out.withColumn(f"_k{i}", key).withColumn("_n", F.row_number().over(first))
        out = out.where((F.col("_n") == 1) | F.col(f"_k{i}").isNull()).drop("_n", f"_k{i}")
    return out


def explanations() -> Column:
    """Array of sentences that say which evidence a result rests on, strongest component first."""
    said = {
        "metadata": "metadata matches the query", "tags": "tags match", "context": "fits the wanted context", "features": "features lie in the wanted range",
        "text": "the profile text matches", "semantic": "the description is similar", "feedback": "was rated well",
    }
    found = F.array_compact(
        F.array(*[F.when(F.col(k) > 0, F.struct((-F.col(k)).alias("o"), F.format_string(f"{text} (%.2f)", F.col(k)).alias("s"))) for k, text in said.items()])
    )
    return F.transform(F.array_sort(found), lambda r: r["s"])


def rank_reason() -> Column:
    """The component with the highest score."""
    kinds = ("metadata", "tags", "context", "features", "text", "semantic", "feedback")
    best = F.array_max(F.array(*[F.struct(F.col(k).alias("v"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(kinds)]))
    return F.when(best["v"] > 0, best["k"])
