"""Numeric column functions: soft thresholds, tempo, vectors, bands and key estimation. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Styles that are fast by nature, and styles whose tempo is often measured at double speed.
FAST_STYLES = (
    "breakcore", "dnb", "drum and bass", "drum n bass", "drum bass", "drum&bass", "gabber", "happy hardcore",
    "hard techno", "hardcore techno", "hardstyle", "jungle", "speedcore",
)
DOUBLED_STYLES = (
    "boom bap", "conscious", "downtempo", "g funk", "gangsta", "hip hop", "hiphop", "instrumental hip hop", "rap",
    "screw", "thug rap", "trip hop",
)

#: Key profiles (Krumhansl and Kessler) and key names.
MAJOR_PROFILE = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR_PROFILE = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
KEY_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``value`` within [low, high]; NULL stays NULL."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0 or NULL."""
    return F.coalesce(F.when(whole > 0, part / whole), F.lit(0.0))


def range_score(value: Column, low: float, high: float, softness: float) -> Column:
    """1 inside [low, high], falling linearly to 0 over ``softness`` outside; NULL scores 0."""
    gap = F.greatest(F.lit(float(low)) - value, value - F.lit(float(high)), F.lit(0.0))
    return F.when(value.isNull() | F.isnan(value), 0.0).otherwise(F.greatest(1.0 - gap / F.lit(float(softness)), F.lit(0.0)))


def max_score(value: Column, most: float, softness: float) -> Column:
    """1 up to ``most``, then falling; NULL scores 0."""
    return range_score(value, -math.inf, most, softness)


def min_score(value: Column, least: float, softness: float) -> Column:
    """1 from ``least`` on, falling below; NULL scores 0."""
    return range_score(value, least, math.inf, softness)


def has_phrase(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether any phrase stands in a text of blank-separated words."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[\s_/-]+", " "), F.lit(" "))
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(padded, F.lit(f" {phrase} "))
    return F.coalesce(found, F.lit(False))


def perceived_tempo(bpm: Column, descriptors: Column | None = None) -> Column:
    """The tempo a listener feels: implausibly fast values are halved, implausibly slow ones doubled."""
    value = F.when((bpm > 0) & ~F.isnan(bpm), bpm)
    fast = has_phrase(descriptors, FAST_STYLES) if descriptors is not None else F.lit(False)
    doubled = has_phrase(descriptors, DOUBLED_STYLES) if descriptors is not None else F.lit(False)
    felt = (
        F.when((value >= 168) & ~fast, value / 2)
        .when((value >= 145) & ~fast & doubled, value / 2)
        .when(value < 62, value * 2)
        .otherwise(value)
    )
    return F.round(felt, 6)


def tempo_dance_score(bpm: Column) -> Column:
    """How danceable a tempo is: rising from 60 to 90, full to 130, gone at 170."""
    rising, falling = (bpm - 60) / 30.0, (170 - bpm) / 40.0
    score = F.when(bpm < 90, rising).when(bpm <= 130, 1.0).otherwise(falling)
    return F.when(bpm.isNull(), 0.0).otherwise(clamp(score))


def derived_features(rms: Column, centroid: Column, zero_crossings: Column, flatness: Column, onset: Column, bpm: Column) -> dict[str, Column]:
    """Energy, brightness, aggression and danceability from frame statistics."""
    energy = clamp(rms / 0.20)
    return {
        "energy": energy,
        "brightness": clamp(centroid / 5000.0),
        "aggression": clamp(0.45 * energy + 0.35 * clamp(zero_crossings) + 0.20 * clamp(flatness)),
        "danceability": clamp(0.45 * tempo_dance_score(bpm) + 0.35 * clamp(onset) + 0.20 * energy),
    }


def estimate_key(chroma: Column) -> Column:
    """struct<key, mode> of a 12-bin chroma profile; NULL where it is empty or of another length."""
    total = F.aggregate(chroma, F.lit(0.0), lambda a, x: a + x)
    scores = []
    for root in range(12):
        for rank, (mode, profile) in enumerate((("major", MAJOR_PROFILE), ("minor", MINOR_PROFILE))):
            turned = [profile[(i - root) % 12] for i in range(12)]
            score = sum((F.get(chroma, F.lit(i)) * turned[i] for i in range(1, 12)), F.get(chroma, F.lit(0)) * turned[0])
            scores.append(F.struct(score.alias("s"), F.lit(-(2 * root + rank)).alias("o"), F.lit(KEY_NAMES[root]).alias("key"), F.lit(mode).alias("mode")))
    best = F.array_max(F.array(*scores))
    return F.when((F.size(chroma) == 12) & (total > 0), F.struct(best["key"].alias("key"), best["mode"].alias("mode")))


def chunk_windows(duration: Column, chunk: float, most: int) -> Column:
    """Array of struct<start, length>: up to ``most`` evenly spread windows of ``chunk`` seconds."""
    count = F.greatest(F.ceil(duration / F.lit(float(chunk))), F.lit(1)).cast("int")
    wanted = F.least(count, F.lit(int(most)))
    at = F.transform(
        F.sequence(F.lit(0), wanted - 1),
        lambda i: F.when(wanted <= 1, F.lit(0)).otherwise(F.bround(i * (count - 1) / (wanted - 1)).cast("int")),
    )
    return F.when(
        duration > 0,
        F.transform(
            F.array_distinct(at),
            lambda i: F.struct((i * float(chunk)).alias("start"), F.least(F.lit(float(chunk)), duration - i * float(chunk)).alias("length")),
        ),
    )


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL for vectors of different length, empty, zero or with non-finite numbers."""
    value = dot(a, b) / (norm(a) * norm(b))
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(fits & ~F.isnan(value), value)


def semantic_relevance(similarity: Column) -> Column:
    """(cosine - 0.15) / 0.60 within 0..1."""
    return F.coalesce(clamp((similarity - 0.15) / 0.60), F.lit(0.0))


def frames_agree(a: Column, b: Column, most: int = 2) -> Column:
    """Whether two fingerprint frames differ in at most ``most`` bits."""
    return F.bit_count(a.bitwiseXOR(b)) <= most


def feature_similarity(field: str, a: Column, b: Column) -> Column:
    """1 - |difference|, tempo in units of 80 beats; NULL where either is NULL."""
    gap = F.abs(a - b) / (80.0 if field == "bpm" else 1.0)
    return F.when(a.isNotNull() & b.isNotNull(), 1.0 - F.least(gap, F.lit(1.0)))


def band(value: Column) -> Column:
    """low, medium or high at thirds."""
    return F.when(value.isNull(), None).when(value < 0.33, "low").when(value < 0.66, "medium").otherwise("high")


def tempo_band(bpm: Column) -> Column:
    """slow, midtempo, dance, fast or very_fast."""
    return (
        F.when(bpm.isNull(), None).when(bpm < 85, "slow").when(bpm < 110, "midtempo").when(bpm < 132, "dance")
        .when(bpm < 160, "fast").otherwise("very_fast")
    )


def completeness(present: list[Column], of: int) -> Column:
    """How many of some conditions hold, as a share of ``of``, at most 1."""
    total = sum((F.when(c, 1).otherwise(0) for c in present[1:]), F.when(present[0], 1).otherwise(0))
    return F.least(total / float(of), F.lit(1.0))
