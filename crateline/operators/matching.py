"""Pairwise evidence that two tracks are the same, the decision drawn from it, and ranked closest matches."""

from __future__ import annotations

import base64
import binascii
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crateline.functions import numeric as N
from crateline.functions import text as X
from crateline.operators.skew import hot_keys, lookup

#: What each source of evidence weighs, and from when it counts.
WEIGHTS = {
    "content_hash": 0.20, "chromaprint": 0.20, "fingerprint_similarity": 0.25, "name": 0.16, "duration": 0.07, "artist_similarity": 0.05,
    "artist_title_norm": 0.04, "album_similarity": 0.02, "filename_stem": 0.02, "feature_similarity": 0.03, "audio_embedding": 0.02,
}
FRAME_SIMILAR, FRAME_RELATED, MAX_OFFSET, MAX_BITS, TOP_OFFSETS = 0.42, 0.08, 120, 2, 32
FEATURE_SIMILAR, AUDIO_SIMILAR = 0.74, 0.85
FEATURE_FIELDS = (
    "bpm", "energy", "valence", "danceability", "acousticness", "instrumentalness", "vocalness", "speechiness", "aggression", "brightness",
)
INFORMATIVE, LEAST_RESULTS = 0.03, 5
AUDIO_KIND = "audio_clap"

SIDE = (
    "id", "path", "content_hash", "chromaprint", "fingerprint_duration", "title", "artist", "album", "duration_sec", "artist_title_norm",
)


def sides(tracks: DataFrame, features: DataFrame, audio: DataFrame | None = None) -> DataFrame:
    """(id, side): what is compared of every track.

    Decoded fingerprints are taken along where the tracks hold them (``chromaprint_frames``), audio embeddings
    (track_id, kind, model, vector) where they are given.
    """
    fields = [f for f in FEATURE_FIELDS if f in features.columns]
    side = tracks.select(*SIDE, *[c for c in ("chromaprint_frames",) if c in tracks.columns])
    side = side.join(features.select(F.col("track_id").alias("id"), *fields), "id", "left")
    if audio is not None:
        vectors = audio.where(F.col("kind") == AUDIO_KIND).groupBy(F.col("track_id").alias("id"))
        side = side.join(vectors.agg(F.collect_list(F.struct("model", "vector")).alias("audio")), "id", "left")
    return side.select("id", F.struct(*[F.col(c) for c in side.columns]).alias("side"))


def with_sides(
    pairs: DataFrame, tracks: DataFrame, features: DataFrame, a: str = "track_a", b: str = "track_b", audio: DataFrame | None = None
) -> DataFrame:
    """Pairs of ids with the columns of both tracks as structs ``a`` and ``b``; pairs of unknown tracks drop out."""
    packed = sides(tracks, features, audio)
    out = lookup(pairs, a, packed, "id", "side", "a").where(F.col("a").isNotNull())
    # the hot keys of the second column are those of the bare pairs
    return lookup(out, b, packed, "id", "side", "b", hot_keys(pairs, b)).where(F.col("b").isNotNull())


def key_status(a: Column, b: Column) -> Column:
    """match, mismatch or missing."""
    blank = a.isNull() | b.isNull() | (a == "") | (b == "")
    return F.when(blank, "missing").when(a == b, "match").otherwise("mismatch")


def evidence(status: Column, score: Column) -> Column:
    return F.struct(status.alias("status"), F.coalesce(score, F.lit(0.0)).alias("score"))


def key_evidence(a: Column, b: Column, worth: float) -> Column:
    status = key_status(a, b)
    return evidence(status, F.when(status == "match", worth).otherwise(0.0))


def duration_evidence(tolerance: float = 2.0) -> Column:
    """Closeness of durations, the fingerprint's before the file's."""
    both = F.col("a.fingerprint_duration").isNotNull() & F.col("b.fingerprint_duration").isNotNull()
    gap = F.abs(
        F.when(both, F.col("a.fingerprint_duration") - F.col("b.fingerprint_duration")).otherwise(F.col("a.duration_sec") - F.col("b.duration_sec"))
    )
    score = F.greatest(1.0 - gap / max(4 * tolerance, 12.0), F.lit(0.0))
    return evidence(F.when(gap.isNull(), "missing").when(gap <= tolerance, "match").otherwise("mismatch"), score)


def name_evidence() -> Column:
    """The better of title with title and artist-title with artist-title."""
    joined = [F.concat_ws(" ", F.col(f"{s}.artist"), F.col(f"{s}.title")) for s in "ab"]
    score = F.greatest(X.name_similarity(F.col("a.title"), F.col("b.title")), X.name_similarity(*joined))
    blank = F.col("a.title").isNull() | F.col("b.title").isNull()
    return evidence(F.when(blank, "missing").when(score >= 0.88, "match").when(score >= 0.45, "partial").otherwise("mismatch"), F.when(~blank, score))


def similarity_evidence(field: str) -> Column:
    a, b = F.col(f"a.{field}"), F.col(f"b.{field}")
    score = X.name_similarity(a, b)
    return evidence(F.when(score.isNull(), "missing").when(score >= 0.92, "match").when(score >= 0.70, "partial").otherwise("mismatch"), score)


def feature_evidence(fields: list[str]) -> Column:
    """Mean similarity of the features both tracks have."""
    values = F.array_compact(F.array(*[N.feature_similarity(f, F.col(f"a.{f}"), F.col(f"b.{f}")) for f in fields]))
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)
    none = F.size(values) == 0
    return evidence(F.when(none, "missing").when(mean >= FEATURE_SIMILAR, "similar").otherwise("dissimilar"), F.when(~none, F.round(mean, 6)))


def version_evidence() -> Column:
    """conflict where artist and base title agree and the named versions do not."""
    ta, tb = X.base_title(X.normalize_ascii(F.col("a.title"))), X.base_title(X.normalize_ascii(F.col("b.title")))
    same = (X.normalize_ascii(F.col("a.artist")) == X.normalize_ascii(F.col("b.artist"))) & (ta["base"] == tb["base"]) & (ta["base"] != "")
    differ = F.size(F.array_except(ta["versions"], tb["versions"])) + F.size(F.array_except(tb["versions"], ta["versions"])) > 0
    return evidence(F.when(F.coalesce(same & differ, F.lit(False)), "conflict").otherwise("none"), F.lit(0.0))


@lru_cache(maxsize=1)
def _popcount() -> np.ndarray:
    return np.array([bin(i).count("1") for i in range(65536)], dtype=np.uint8)


def align_frames(a: np.ndarray, b: np.ndarray) -> float:
    """The best share of frames that agree under one offset of at most ``MAX_OFFSET`` frames."""
    if not len(a) or not len(b):
        return 0.0
    a, b = a.astype(np.uint32), b.astype(np.uint32)
    bits, shorter, best = _popcount(), min(len(a), len(b)), 0
    reach = min(MAX_OFFSET, max(len(a), len(b)) - 1)
    offsets = list(range(-reach, reach + 1))
    places: dict[int, list[int]] = {}
    for j, frame in enumerate(b.tolist()):
        places.setdefault(frame, []).append(j)
    votes: dict[int, int] = {}
    for i, frame in enumerate(a.tolist()):
        for j in places.get(frame, ())[:64]:
            votes[j - i] = votes.get(j - i, 0) + 1
    offsets += [o for o, _ in sorted(votes.items(), key=lambda v: (-v[1], v[0]))[:TOP_OFFSETS] if abs(o) > reach]
    for offset in offsets:
        i, j = max(0, -offset), max(0, offset)
        n = min(len(a) - i, len(b) - j)
        if n <= best:
            continue
        x = a[i : i + n] ^ b[j : j + n]
        best = max(best, int((bits[x & 0xFFFF] + bits[x >> 16] <= MAX_BITS).sum()))
    return best / shorter


@F.pandas_udf(T.BinaryType())
def packed_frames(frames: pd.Series) -> pd.Series:
    """Frames as little-endian unsigned 32-bit numbers; NULL for none."""
    return frames.map(lambda x: None if x is None or not len(x) else (np.asarray(x, dtype=np.int64) & 0xFFFFFFFF).astype("<u4").tobytes())


@F.pandas_udf(T.ArrayType(T.LongType()))
def unpacked_frames(blob: pd.Series, count: pd.Series) -> pd.Series:
    """The frames of a packed value; none where its length is odd or not ``count``, if that is known."""

    def read(data: bytes | None, n: float | None) -> list[int]:
        if not data or len(data) % 4 or not (pd.isna(n) or int(n) == len(data) // 4):
            return []
        return np.frombuffer(bytes(data), dtype="<u4").astype(np.int64).tolist()

    return pd.Series([read(x, n) for x, n in zip(blob, count, strict=True)], dtype=object)


@F.pandas_udf(T.DoubleType())
def frame_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two decoded fingerprints; NULL where either is NULL or empty."""
    out = []
    for x, y in zip(a, b, strict=True):
        out.append(None if x is None or y is None or not len(x) or not len(y) else align_frames(np.asarray(x, dtype=np.int64), np.asarray(y, dtype=np.int64)))
    return pd.Series(out, dtype="float64")


@lru_cache(maxsize=4096)
def decode_frames(text: str | None) -> np.ndarray | None:
    """The frames of a compressed fingerprint; None where the text is not one.

    URL-safe base64 of the algorithm (1 byte), the number of frames (3 bytes) and, for each frame, the distances
    between the bits that differ from the frame before: 3 bits each, 0 ends a frame, what 7 leaves over follows
    behind all of them in 5 bits each.
    """
    try:
        plain = (text or "").encode("ascii")
        data = base64.b64decode(plain + b"=" * (-len(plain) % 4), altchars=b"-_", validate=True)
    except (UnicodeEncodeError, binascii.Error):
        return None
    n = int.from_bytes(data[1:4], "big")
    if len(data) < 4 or not n or (len(data) - 4) * 8 < 3 * n:
        return None
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=4), bitorder="little").astype(np.int64)
    steps = bits[: len(bits) // 3 * 3].reshape(-1, 3) @ np.array([1, 2, 4])
    ends = np.flatnonzero(steps == 0)
    if len(ends) < n:
        return None
    steps = steps[: ends[n - 1] + 1]
    rest = bits[-(-3 * len(steps) // 8) * 8 :]
    long = np.flatnonzero(steps == 7)
    if len(rest) < 5 * len(long):
        return None
    steps[long] += rest[: 5 * len(long)].reshape(-1, 5) @ np.array([1, 2, 4, 8, 16])
    frame = np.cumsum(steps == 0) - (steps == 0)
    at = np.cumsum(steps)
    at -= np.concatenate([[0], at[ends[: n - 1]]])[frame]
    if at.max() > 32:
        return None
    changed = np.zeros(n, dtype=np.int64)
    np.bitwise_or.at(changed, frame[steps > 0], 1 << (at[steps > 0] - 1))
    return np.bitwise_xor.accumulate(changed)


@F.pandas_udf(T.ArrayType(T.LongType()))
def decoded_frames(text: pd.Series) -> pd.Series:
    return text.map(lambda x: decode_frames(x) if isinstance(x, str) else None)


def _frames(side: str, fields: list[str]) -> Column:
    """The stored frames of a track before those of its fingerprint text."""
    decoded, stored = decoded_frames(F.col(f"{side}.chromaprint")), F.col(f"{side}.chromaprint_frames") if "chromaprint_frames" in fields else None
    return decoded if stored is None else F.when(F.size(stored) > 0, stored.cast("array<bigint>")).otherwise(decoded)


def frame_evidence(a: Column, b: Column, same: Column) -> Column:
    """Similarity of two decoded fingerprints; ``same`` where their texts are equal."""
    score = F.round(frame_similarity(a, b), 6)
    status = F.when(score.isNull(), "missing").when(F.coalesce(same, F.lit(False)), "same").when(score >= FRAME_SIMILAR, "similar")
    return evidence(status.when(score >= FRAME_RELATED, "related").otherwise("dissimilar"), score)


def audio_evidence(a: Column, b: Column) -> Column:
    """The best similarity of two lists of audio embeddings (model, vector) under one model of both."""
    own, other = [F.coalesce(x, F.array().cast("array<struct<model:string,vector:array<double>>>")) for x in (a, b)]
    shared = F.flatten(
        F.transform(own, lambda x: F.transform(F.filter(other, lambda y: y["model"] == x["model"]), lambda y: N.cosine(x["vector"], y["vector"])))
    )
    score = F.round(F.array_max(F.array_compact(shared)), 6)
    status = F.when(F.size(shared) == 0, "missing").when(score.isNull(), "error").when(score >= AUDIO_SIMILAR, "similar")
    return evidence(status.otherwise("dissimilar"), score)


def with_evidence(sides: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """One struct<status, score> per source of evidence."""
    held = sides.schema["a"].dataType.fieldNames()
    fields = [f for f in FEATURE_FIELDS if f in held]
    audio = audio_evidence(F.col("a.audio"), F.col("b.audio")) if "audio" in held else evidence(F.lit("missing"), F.lit(0.0))
    alike = F.col("a.chromaprint") == F.col("b.chromaprint")
    stems = [X.filename_stem(F.col(f"{s}.path")) for s in "ab"]
    return (
        sides.withColumn("content_hash", key_evidence(F.col("a.content_hash"), F.col("b.content_hash"), 1.0))
        .withColumn("chromaprint", key_evidence(F.col("a.chromaprint"), F.col("b.chromaprint"), 0.96))
        .withColumn("fingerprint_similarity", frame_evidence(_frames("a", held), _frames("b", held), alike))
        .withColumn("name", name_evidence())
        .withColumn("duration", duration_evidence(tolerance))
        .withColumn("artist_similarity", similarity_evidence("artist"))
        .withColumn("artist_title_norm", key_evidence(F.col("a.artist_title_norm"), F.col("b.artist_title_norm"), 0.55))
        .withColumn("album_similarity", similarity_evidence("album"))
        .withColumn("filename_stem", key_evidence(*stems, 0.35))
        .withColumn("feature_similarity", feature_evidence(fields))
        .withColumn("audio_embedding", audio)
        .withColumn("version", version_evidence())
    )


def decision() -> Column:
    """struct<decision, identity, confidence, score> of the first rule that holds; metadata alone never proves identity."""
    s = lambda source: F.col(f"{source}.status")

    def said(name: str, identity: str, confidence: str, score: float | Column) -> Column:
        value = score if isinstance(score, Column) else F.lit(float(score))
        return F.struct(F.lit(name).alias("decision"), F.lit(identity).alias("identity"), F.lit(confidence).alias("confidence"), value.alias("score"))

    timed = s("duration") == "match"
    return (
        F.when(s("content_hash") == "match", said("exact_duplicate", "same", "high", 1.0))
        .when((s("chromaprint") == "match") & s("duration").isin("match", "missing"), said("same_recording", "same", "high", 0.96))
        .when(s("chromaprint") == "match", said("possible_recording_match", "possible", "medium", 0.72))
        .when(s("version") == "conflict", said("related_version_not_duplicate", "unknown", "medium", 0.40))
        .when((s("content_hash") == "mismatch") | (s("chromaprint") == "mismatch"), said("no_identity_match", "unknown", "medium", 0.0))
        .when((s("artist_title_norm") == "match") & timed, said("possible_metadata_match", "possible", "medium", 0.68))
        .when(s("artist_title_norm") == "match", said("possible_metadata_match", "possible", "low", 0.45))
        .when((s("filename_stem") == "match") & timed, said("possible_metadata_match", "possible", "low", 0.52))
        .when(s("filename_stem") == "match", said("possible_metadata_match", "possible", "low", 0.25))
        .when(
            s("audio_embedding") == "similar",
            said("sound_similar_only", "unknown", "low", F.round(F.greatest(F.col("audio_embedding.score"), F.lit(0.0)) * 0.5, 6)),
        )
        .otherwise(said("insufficient_evidence", "unknown", "low", 0.0))
    )


#: Statuses whose score counts towards the candidate; of sources that measure a distance every score counts.
COUNTING = {"fingerprint_similarity": ("same", "similar", "related")}
MEASURED = frozenset({"duration", "feature_similarity", "audio_embedding"})


def source_score(source: str) -> Column:
    """What a source says for the pair, 0 to 1; 0 where it says nothing or speaks against it."""
    score = F.least(F.greatest(F.col(f"{source}.score"), F.lit(0.0)), F.lit(1.0))
    if source in MEASURED:
        return F.when(F.col(f"{source}.status").isin("missing", "error"), 0.0).otherwise(score)
    return F.when(F.col(f"{source}.status").isin(*COUNTING.get(source, ("match", "partial"))), score).otherwise(0.0)


def candidate_score(sources: list[str]) -> Column:
    """The weighted sum of the evidence, at most 1."""
    parts = [F.lit(WEIGHTS[x]) * source_score(x) for x in sources]
    return F.round(F.least(sum(parts[1:], parts[0]), F.lit(1.0)), 6)


def candidate_class() -> Column:
    """struct<kind, strength, summary>: what kind of relation the strongest evidence speaks for. Reads the columns
    ``decision`` and ``candidate_score`` besides those of the sources."""
    x = {source: source_score(source) for source in SOURCES}
    decided = lambda name: F.col("decision") == name
    titled, timed = x["name"] >= 0.88, x["duration"] >= 0.75
    rules = [
        (decided("exact_duplicate") | (x["content_hash"] >= 1.0), "exact_duplicate", "strong", "Exact duplicate: same content hash"),
        (decided("same_recording") | (x["chromaprint"] >= 0.95), "same_recording", "strong", "Same recording: exact fingerprint match"),
        (decided("possible_recording_match") | (x["fingerprint_similarity"] >= FRAME_SIMILAR), "possible_recording_match", "strong", "Possible recording match: close fingerprint"),
        (x["fingerprint_similarity"] >= FRAME_RELATED, "soundwave_related", "medium", "Soundwave-related: partial fingerprint overlap"),
        (decided("related_version_not_duplicate"), "related_version", "medium", "Related version/remix/live/edit, not a duplicate"),
        (titled & (x["artist_similarity"] >= 0.92) & (timed | (x["feature_similarity"] >= 0.90)), "same_title_artist", "strong", "Same/very close title and artist"),
        (titled & (x["artist_similarity"] >= 0.92), "same_title_artist", "medium", "Same/very close title and artist"),
        (titled & (x["artist_title_norm"] > 0), "same_title_metadata", "medium", "Same/very close title with metadata support"),
        (titled, "same_title", "medium", "Same/very close title"),
        (x["name"] >= 0.70, "close_title", "medium", "Close title match"),
        ((x["artist_similarity"] >= 0.92) & (timed | (x["album_similarity"] >= 0.80)), "same_artist_context", "medium", "Same artist with duration/album support"),
        (x["filename_stem"] >= 0.30, "filename_match", "medium", "Same/close filename"),
        (x["audio_embedding"] >= AUDIO_SIMILAR, "audio_similar", "weak", "Audio embedding similarity only"),
        (x["feature_similarity"] >= 0.90, "feature_similar", "weak", "Feature-similar fallback"),
        (timed, "duration_similar", "weak", "Duration-similar fallback"),
        (F.col("candidate_score") > 0, "nearest_fallback", "weak", "Weak nearest fallback"),
        (F.lit(True), "no_nearby_signal", "weak", "No strong nearby signal"),
    ]
    said = [(c, F.struct(F.lit(k).alias("kind"), F.lit(strength).alias("strength"), F.lit(text).alias("summary"))) for c, k, strength, text in rules]
    chain = F.when(*said[0])
    for rule in said[1:]:
        chain = chain.when(*rule)
    return chain


SOURCES = [
    "content_hash", "chromaprint", "fingerprint_similarity", "name", "duration", "artist_similarity", "artist_title_norm", "album_similarity", "filename_stem",
    "feature_similarity", "audio_embedding",
]


def reports(pairs: DataFrame, tracks: DataFrame, features: DataFrame, tolerance: float = 2.0, audio: DataFrame | None = None) -> DataFrame:
    """Evidence, decision, score and kind of every pair (track_a, track_b)."""
    return _reported(with_sides(pairs, tracks, features, audio=audio), tolerance)


def _reported(pairs: DataFrame, tolerance: float) -> DataFrame:
    rows = with_evidence(pairs, tolerance).withColumn("d", decision())
    rows = rows.select(
        "track_a", "track_b", *SOURCES, "version", F.col("d.decision").alias("decision"), F.col("d.identity").alias("identity_decision"),
        F.col("d.confidence").alias("confidence"), F.col("d.score").alias("confidence_score"), candidate_score(SOURCES).alias("candidate_score"),
    )
    rows = rows.withColumn("c", candidate_class())
    return rows.select("*", *[F.col(f"c.{x}").alias(f"candidate_{x}") for x in ("kind", "strength", "summary")]).drop("c")


def closest_matches(
    source_id: str, tracks: DataFrame, features: DataFrame, limit: int = 10, tolerance: float = 2.0, audio: DataFrame | None = None
) -> DataFrame:
    """The tracks most like one track: informative ones first, padded with the nearest to at least five.

    The source is a single row, read first and put into the plan as a literal, so
    the others are scored in one scan without a join. An unknown source has none.
    """
    packed = sides(tracks, features, audio)
    kind = packed.schema["side"].dataType
    source = packed.where(F.col("id") == source_id).select(F.to_json("side")).first()
    one = F.from_json(F.lit(source[0] if source else None).cast("string"), kind)
    present = tracks.where(F.col("missing_at").isNull() & F.lit(source is not None))
    others = sides(present, features, audio).where(F.col("id") != source_id)
    pairs = others.select(F.lit(source_id).alias("track_a"), F.col("id").alias("track_b"), one.alias("a"), F.col("side").alias("b"))
    found = _reported(pairs, tolerance)
    informative = (F.col("candidate_score") >= INFORMATIVE) | (F.col("confidence_score") > 0)
    order = [F.desc("informative"), F.desc("confidence_score"), F.desc("candidate_score"), F.desc("name.score"), F.asc("track_b")]
    best = found.withColumn("informative", informative).orderBy(*order).limit(max(limit, LEAST_RESULTS))
    place = F.row_number().over(Window.orderBy(*order))
    return best.withColumn("rank", place).where(F.col("informative") | (F.col("rank") <= min(LEAST_RESULTS, limit))).where(F.col("rank") <= limit)
