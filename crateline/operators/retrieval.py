"""Retrieval signals: inverted index with BM25, vector search, and tag, context, feature and feedback scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crateline.functions import numeric as N

K1, B = 1.2, 0.75
TOP = 500


def words(c: Column) -> Column:
    """Array of the words of a text, lower case, letters and digits of any script."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def postings(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, term, tf, length): the inverted index; to be written bucketed by term and reused."""
    docs = documents.select(F.col(id_column).alias("doc_id"), words(F.col(text_column)).alias("w"))
    docs = docs.select("doc_id", "w", F.size("w").alias("length")).where(F.col("length") > 0)
    terms = docs.select("doc_id", "length", F.explode("w").alias("term"))
    return terms.groupBy("doc_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(documents: DataFrame, id_column: str, text_column: str, terms: list[str], every: bool = False) -> DataFrame:
    """(doc_id, score): BM25 of each document that holds any, or every, term.

    The terms of a query are few and known, so they are counted in the scan: no
    posting is shuffled, only sums over documents are gathered.
    """
    wanted = sorted({t.lower() for t in terms if t})
    docs = documents.select(F.col(id_column).alias("doc_id"), words(F.col(text_column)).alias("w"))
    docs = docs.select("doc_id", F.size("w").alias("length"), F.filter("w", lambda x: x.isin(wanted)).alias("hits")).where(F.col("length") > 0)
    tf = [(F.size("hits") - F.size(F.array_remove("hits", t))).alias(f"tf{i}") for i, t in enumerate(wanted)]
    docs = docs.select("doc_id", "length", *tf)
    if not wanted:
        return docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    figures = docs.agg(
        F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))]
    ).first()
    n, mean = figures["n"], figures["mean"] or 1.0
    score: Column = F.lit(0.0)
    holds = [F.col(f"tf{i}") > 0 for i in range(len(wanted))]
    for i in range(len(wanted)):
        df, count = figures[f"df{i}"], F.col(f"tf{i}")
        idf = math.log((n - df + 0.5) / (df + 0.5) + 1.0)
        score = score + idf * count * (K1 + 1) / (count + K1 * (1 - B + B * F.col("length") / mean))
    found = holds[0]
    for h in holds[1:]:
        found = (found & h) if every else (found | h)
    return docs.where(found).select("doc_id", score.alias("score"))


def reciprocal_ranks(scores: DataFrame, top: int = TOP) -> DataFrame:
    """(doc_id, score, rank, text_score): the best documents with 1/rank. Only ``top`` rows reach the ordering."""
    best = scores.orderBy(F.desc("score"), "doc_id").limit(top)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).withColumn("text_score", 1.0 / F.col("rank"))


def cosine_top(vectors: DataFrame, id_column: str, vector_column: str, query: list[float], top: int) -> DataFrame:
    """(id, similarity): the rows nearest to a query vector, ties by id; a scan and a top-k, no shuffle of vectors."""
    target = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(F.col(id_column).alias("id"), N.cosine(F.col(vector_column), target).alias("similarity"))
    return scored.where(F.col("similarity").isNotNull()).orderBy(F.desc("similarity"), "id").limit(top)


def concept_matches(tag: Column, concepts: list[str]) -> Column:
    """Whether a tag matches any concept by its words: all concept words in the tag, or its text within the tag's.

    A negative tag ("low_energy") never matches a concept without a negation.
    """
    terms = F.regexp_extract_all(F.translate(F.replace(F.lower(tag), F.lit("---"), F.lit(" ")), "_", " "), F.lit("([a-z0-9]+)"), 1)
    text = F.array_join(terms, " ")
    negations = ["low", "not", "no", "without"]
    negative = F.exists(terms, lambda t: t.isin(negations))
    hit = F.lit(False)
    for concept in concepts:
        own = [w for w in "".join(c if c.isalnum() else " " for c in concept.lower().replace("---", " ")).split() if w.isascii()]
        if not own:
            continue
        subset = F.size(F.array_except(F.array(*[F.lit(w) for w in own]), terms)) == 0
        inside = F.contains(text, F.lit(" ".join(own))) if all(len(w) >= 3 for w in own) else F.lit(False)
        match = subset | inside
        if not set(own) & set(negations):
            match = match & ~negative
        hit = hit | match
    return hit


def tag_scores(tags: DataFrame, prefer: list[str], avoid: list[str]) -> DataFrame:
    """(track_id, tag_score): rescaled scores of wanted tags less those of avoided ones, within 0..1."""
    strong = tags.where(F.col("score") >= 0.2)
    weight = (F.col("score") - 0.2) / 0.8
    liked, shunned = concept_matches(F.col("tag"), prefer), concept_matches(F.col("tag"), avoid) & ~F.col("tag").rlike(r"(^|_)(no|not|without)_|instrumental")
    total = F.sum(F.when(liked, weight).otherwise(0.0) - F.when(shunned, weight).otherwise(0.0))
    return strong.groupBy("track_id").agg(F.round(N.clamp(total), 8).alias("tag_score"))


def context_scores(fits: DataFrame, contexts: list[str]) -> DataFrame:
    """(track_id, context_score): the best wanted context, weighted by its confidence."""
    wanted = fits.where(F.col("context").isin(contexts))
    score = F.col("score") * (0.65 + 0.35 * F.col("confidence"))
    return wanted.groupBy("track_id").agg(F.round(F.max(score), 6).alias("context_score"))


def feature_score(ranges: dict[str, tuple[float, float]]) -> Column:
    """The mean closeness of a row's features to the wanted ranges."""
    if not ranges:
        return F.lit(0.0)
    parts = []
    for field, (low, high) in sorted(ranges.items()):
        value = N.perceived_tempo(F.col("bpm")) if field == "tempo_bpm" else F.col(field)
        parts.append(N.range_score(value, low, high, 30.0 if field == "tempo_bpm" else 0.20))
    return sum(parts[1:], parts[0]) / float(len(parts))


#: What a match in each metadata field is worth.
METADATA_WEIGHTS = {"artist": 1.0, "album_artist": 0.95, "title": 0.75, "album": 0.55, "genre": 0.45}


def metadata_score(terms: list[str]) -> Column:
    """The best field match of a row: all of a field's words in the query 1, all query words in it 0.85, some 0.55 or less."""
    wanted = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    scores = []
    for field, weight in METADATA_WEIGHTS.items():
        own = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.col(field)), F.lit("([a-z0-9]+)"), 1), lambda w: F.length(w) > 1))
        common = F.size(F.array_intersect(own, wanted))
        share = common / F.lit(float(max(1, len(terms))))
        value = (
            F.when(own.isNull() | (common == 0), 0.0).when(common == F.size(own), 1.0).when(common == len(terms), 0.85)
            .when(share >= 0.5, 0.55).when(common >= 2, 0.35).otherwise(0.30)
        )
        scores.append(F.coalesce(F.lit(weight) * value, F.lit(0.0)))
    return F.greatest(*scores)


def distinct_feedback(feedback: DataFrame) -> DataFrame:
    """Feedback without repeated deliveries, ratings within -1..1; rows without a rating or track say nothing."""
    rated = feedback.where(F.col("rating").isNotNull() & F.col("track_id").isNotNull())
    first = F.max_by(F.struct("search_event_id", "track_id", "rating", "created_at"), F.struct("ingested_at", F.xxhash64("track_id", "rating"))).alias("r")
    rows = rated.groupBy("id").agg(first).select("id", "r.*")
    return rows.withColumn("rating", F.least(F.greatest(F.col("rating"), F.lit(-1)), F.lit(1)))


def feedback_scores(feedback: DataFrame, events: DataFrame, query: str) -> DataFrame:
    """(track_id, feedback_score): mean rating, that of other queries at a quarter, within -1..1."""
    asked = events.select(F.col("id").alias("search_event_id"), F.lower(F.trim("query")).alias("q"))
    rows = distinct_feedback(feedback).join(asked, "search_event_id", "left")
    value = F.when(F.col("q") == query.strip().lower(), F.col("rating") * 1.0).otherwise(F.col("rating") * 0.25)
    return rows.groupBy("track_id").agg(F.round(N.clamp(F.avg(value), -1, 1), 6).alias("feedback_score"))


def latest_feedback(feedback: DataFrame, events: DataFrame, query: str) -> DataFrame:
    """(track_id, rating): the last rating of each track for exactly this query."""
    asked = events.where(F.col("query") == query).select(F.col("id").alias("search_event_id"))
    rows = distinct_feedback(feedback).join(asked, "search_event_id", "left_semi")
    return rows.groupBy("track_id").agg(F.max_by("rating", F.struct("created_at", "id")).alias("rating"))


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """One row of counts over the feedback log."""
    rows = distinct_feedback(feedback)
    return rows.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("rating") > 0).alias("positive"),
        F.count_if(F.col("rating") == 0).alias("neutral"),
        F.count_if(F.col("rating") < 0).alias("negative"),
        F.count_distinct("track_id").alias("tracks"),
        F.count_distinct("search_event_id").alias("searches"),
    )


def typo_candidates(query_terms: list[str], vocabulary: DataFrame, curated: list[str], least: float = 0.70) -> DataFrame:
    """(term, suggestion, confidence): the best correction of each query term that is not in the vocabulary (term)."""
    known = vocabulary.select(F.col("term").alias("word"), F.lit(False).alias("curated"))
    own = vocabulary.sparkSession.createDataFrame([(w, True) for w in sorted(set(curated))], "word string, curated boolean")
    words_ = known.unionByName(own).groupBy("word").agg(F.max("curated").alias("curated"))
    out = None
    for term in sorted(set(query_terms)):
        near = words_.where((F.abs(F.length("word") - len(term)) <= 2) & (F.col("word") != term))
        distance = F.levenshtein(F.col("word"), F.lit(term), 2)
        near = near.withColumn("d", distance).where((F.col("d") >= 0) & ((F.col("d") <= 1) | F.col("curated")))
        raw = 1.0 - F.col("d") / F.greatest(F.length("word"), F.lit(len(term))) + F.when(F.col("curated"), 0.12).otherwise(0.0)
        near = near.withColumn("confidence", F.round(F.least(raw, F.lit(0.98)), 6)).where(F.col("confidence") >= least)
        best = near.orderBy(F.desc("confidence"), "word").limit(1).select(F.lit(term).alias("term"), F.col("word").alias("suggestion"), "confidence")
        out = best if out is None else out.unionByName(best)
    return out
