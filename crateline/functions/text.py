"""Text column functions. What Spark has no function for is a vectorised UDF; the rest stays in the JVM."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that carry nothing in a query.
QUERY_STOP_WORDS = (
    "a", "an", "am", "and", "are", "bar", "bpm", "for", "give", "i", "im", "in", "is", "m", "me", "music", "my", "of", "play", "songs",
    "that", "the", "to", "track", "tracks", "want", "with", "without",
    "best", "by", "fastest", "find", "good", "great", "highest", "least", "library", "list", "local", "lowest", "most", "nice", "no", "not",
    "order", "please", "recommend", "recommendations", "show", "slowest", "some", "sort", "stuff", "top", "vibe", "vibes",
)

#: Words that carry nothing in a name; versions of a title with their common name.
NAME_STOP_WORDS = ("a", "an", "and", "at", "baby", "feat", "ft", "i", "in", "is", "it", "me", "my", "of", "on", "the", "to", "u", "you", "your")
VERSIONS = {
    "acoustic": "acoustic", "bootleg": "bootleg", "club mix": "club_mix", "cover": "cover", "edit": "edit",
    "extended mix": "extended_mix", "instrumental": "instrumental", "live": "live", "radio edit": "radio_edit",
    "remaster": "remaster", "remastered": "remaster", "remix": "remix", "rework": "rework", "version": "version", "vip": "vip",
}


def strip(c: Column) -> Column:
    """Without outer white space of any kind, not only U+0020."""
    return F.regexp_replace(c, r"^[\s\p{Z}\x{85}\x{1c}-\x{1f}]+|[\s\p{Z}\x{85}\x{1c}-\x{1f}]+$", "")


def clean_value(c: Column) -> Column:
    """Without outer white space; NULL where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


@lru_cache(maxsize=100_000)
def plain_words(value: str) -> str | None:
    """Folded letters and digits of any script, ``&`` as "and", other runs as one blank."""
    folded = unicodedata.normalize("NFKD", value).casefold()
    bare = "".join(c for c in folded if not unicodedata.combining(c)).replace("&", " and ")
    return re.sub(r"[^\w]+", " ", bare).strip() or None


@lru_cache(maxsize=100_000)
def ascii_words(value: str) -> str:
    """Folded ASCII letters and digits only."""
    folded = unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode().casefold()
    return re.sub(r"[^a-z0-9]+", " ", folded.replace("&", " and ")).strip()


def _mapped(function, type_: str = "string"):
    @F.pandas_udf(type_)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else function(x))

    return run


def normalize_text(c: Column) -> Column:
    """Comparable form of a text of any script; NULL where nothing is left."""
    return _mapped(plain_words)(c)


def normalize_ascii(c: Column) -> Column:
    """Comparable ASCII form of a text."""
    return _mapped(ascii_words)(c)


def identity_text(c: Column) -> Column:
    """A title without bracketed parts and words such as "official", "remaster" or "extended", in comparable form."""
    decoded = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    bare = F.regexp_replace(F.coalesce(decoded, c), r"\([^)]*\)|\[[^\]]*\]", " ")
    words = F.regexp_replace(normalize_ascii(bare), r"\b(official|video|audio|original|mix|remaster|remastered|extended)\b", " ")
    return F.trim(F.regexp_replace(words, r"\s+", " "))


def query_terms(c: Column) -> Column:
    """Array of the significant ASCII words of a query, in order."""
    words = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)
    return F.filter(words, lambda w: ~w.isin(list(QUERY_STOP_WORDS)) & ~w.rlike(r"^\d+$"))


def tag_terms(c: Column) -> Column:
    """Array of the words of a tag such as ``electronic---ambient``."""
    return F.regexp_extract_all(F.translate(F.replace(F.lower(c), F.lit("---"), F.lit(" ")), "_", " "), F.lit("([a-z0-9]+)"), 1)


def tag_key(c: Column) -> Column:
    """A tag as an identifier."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def filename(path: Column) -> Column:
    """The file name of a path without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def filename_stem(path: Column) -> Column:
    """Comparable form of the file name of a path."""
    return _mapped(lambda x: ascii_words(unquote(x)))(filename(path))


def parsed_title(text: Column) -> Column:
    """struct<artist, title> of "01 - Artist - Title" and the like; the artist is NULL without a spaced dash."""
    bare = F.trim(F.regexp_replace(F.translate(text, "_", " "), r"^\s*\d{1,3}\s*[-_.]\s*", ""))
    pattern = r"^(.+?)\s+[-–—]\s+(.+)$"
    artist, title = F.regexp_extract(bare, pattern, 1), F.regexp_extract(bare, pattern, 2)
    return F.struct(clean_value(artist).alias("artist"), F.coalesce(clean_value(title), clean_value(bare)).alias("title"))


def short_key(c: Column) -> Column:
    """The ends of a long key."""
    return F.when(F.length(c) > 24, F.concat(F.substring(c, 1, 12), F.lit("..."), F.substring(c, -8, 8))).otherwise(c)


def duration_text(seconds: Column) -> Column:
    """m:ss."""
    whole = F.round(seconds).cast("int")
    return F.when(seconds.isNotNull(), F.format_string("%d:%02d", F.floor(whole / 60).cast("int"), whole % 60))


def all_terms_in(text: Column, terms: list[str]) -> Column:
    """Whether a text holds every term, whatever the letter case."""
    hit = F.lit(True)
    for term in terms:
        hit = hit & F.contains(F.lower(text), F.lit(term.lower()))
    return hit


def browse_terms(text: str, most: int = 12) -> list[str]:
    """The terms of a browse query: words with apostrophes and dashes, at most ``most``."""
    return [t.lower() for t in re.findall(r"[\w'-]+", text)][:most]


def name_tokens(c: Column) -> Column:
    """Array of the distinct significant words of a comparable name."""
    words = F.split(c, " +")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(list(NAME_STOP_WORDS))))


def token_similarity(a: Column, b: Column) -> Column:
    """max(Jaccard, 0.92 x containment) of two token arrays; a single common word of several counts 0.42 at most."""
    common = F.size(F.array_intersect(a, b))
    jaccard = common / F.size(F.array_union(a, b))
    contained = 0.92 * common / F.least(F.size(a), F.size(b))
    score = F.greatest(jaccard, contained)
    capped = F.when((common == 1) & (F.least(F.size(a), F.size(b)) > 1), F.least(score, F.lit(0.42))).otherwise(score)
    return F.when((F.size(a) > 0) & (F.size(b) > 0) & (common > 0), capped).otherwise(0.0)


def base_title(c: Column) -> Column:
    """struct<base, versions>: a comparable title without version words and years, and the versions it names."""
    rest, found = F.concat(F.lit(" "), c, F.lit(" ")), []
    for phrase in sorted(VERSIONS, key=len, reverse=True):
        hit = F.contains(rest, F.lit(f" {phrase} "))
        found.append(F.when(hit, F.lit(VERSIONS[phrase])))
        rest = F.replace(rest, F.lit(f" {phrase} "), F.lit(" "))
    base = F.trim(F.regexp_replace(F.regexp_replace(rest, r"\b(19|20)\d\d\b", " "), r"\s+", " "))
    return F.struct(base.alias("base"), F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))).alias("versions"))


def _tokens(value: str) -> set[str]:
    return {w for w in value.split() if len(w) > 1 and w not in NAME_STOP_WORDS}


@lru_cache(maxsize=200_000)
def compare_names(a: str, b: str) -> float:
    """Similarity of two comparable names: equal, contained, common words or matching blocks."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    within = 0.0
    if len(min(a, b, key=len)) > 2 and (a in b or b in a):
        within = min(0.96, max(0.72, min(len(a), len(b)) / max(len(a), len(b))))
    x, y = _tokens(a), _tokens(b)
    words = 0.0
    if common := len(x & y):
        words = max(common / len(x | y), 0.92 * common / min(len(x), len(y)))
        if common == 1 and min(len(x), len(y)) > 1:
            words = min(words, 0.42)
    blocks = SequenceMatcher(None, a, b, autojunk=False).ratio()
    if not within and not words and blocks < 0.62:
        blocks = 0.0
    return max(within, words, blocks)


@F.pandas_udf(T.DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two names in any writing; NULL where either is NULL."""
    return pd.Series([None if x is None or y is None else compare_names(ascii_words(x), ascii_words(y)) for x, y in zip(a, b, strict=True)], dtype="float64")
