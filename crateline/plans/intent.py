"""Compiling a natural-language query on the driver: contexts, priors, ranges, sorts, limit, mode and plan.

Only the query text and small library statistics are read here; all per-row work
is left to the DataFrames that the compiled intent parametrises.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from crateline.functions.text import QUERY_STOP_WORDS
from crateline.plans.taxonomy import Taxonomy, default_taxonomy

#: Words of a query that direct the search instead of naming content.
DIRECTIVES = (
    "aggressive", "aggression", "bpm", "bright", "brightness", "dance", "danceability", "danceable", "danciest", "dark", "darkest",
    "energetic", "energy", "fast", "faster", "fastest", "hardest", "high", "highest", "least", "low", "lowest", "max", "maximum", "min",
    "minimum", "most", "quickest", "slow", "slower", "slowest", "softest", "tempo", "uptempo", "asc", "ascending", "by", "desc", "descending",
    "order", "sort",
)

#: Phrases that negate a quality, and the words they take out of the query.
NEGATIONS = (
    (("not aggressive", "less aggressive", "low aggression", "non aggressive"), ("aggressive", "aggression")),
    (("no vocals", "without vocals", "vocal free", "no singing"), ("vocal", "vocals", "singing", "singer")),
    (("not fast", "not too fast"), ("fast", "faster", "uptempo")),
    (("not slow", "not too slow"), ("slow", "slower", "downtempo")),
)

#: Superlatives by feature, falling and rising.
SUPERLATIVES = {
    "energy": (
        ("most energetic", "highest energy", "high energy", "max energy", "maximum energy"),
        ("least energetic", "lowest energy", "low energy", "minimum energy"),
    ),
    "danceability": (
        ("most danceable", "danciest", "highest danceability", "high danceability"),
        ("least danceable", "lowest danceability", "low danceability"),
    ),
    "aggression": (
        ("most aggressive", "hardest", "highest aggression", "high aggression"),
        ("least aggressive", "softest", "lowest aggression", "low aggression"),
    ),
    "brightness": (
        ("brightest", "highest brightness", "high brightness", "most bright"),
        ("darkest", "lowest brightness", "low brightness", "least bright"),
    ),
}
PERCENTILE_OF_LEVEL = {
    "very_low": ("lowest", "p25"), "low": ("lowest", "p35"), "low_mid": ("lowest", "p55"), "mid": ("p25", "p75"),
    "mid_high": ("p45", "highest"), "high": ("p65", "highest"), "very_high": ("p75", "highest"),
}


@dataclass
class Intent:
    """What a query asks for."""

    query: str
    limit: int = 10
    contexts: list[str] = field(default_factory=list)
    terms: list[str] = field(default_factory=list)
    prefer: list[str] = field(default_factory=list)
    avoid: list[str] = field(default_factory=list)
    prefer_tags: list[str] = field(default_factory=list)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    sorts: list[tuple[str, str]] = field(default_factory=list)
    semantic: bool = False


def unique(values) -> list[str]:
    return list(dict.fromkeys(v.strip().lower() for v in values if v and v.strip()))


def mentions(query: str, keyword: str) -> bool:
    """Whether a keyword stands in a query as whole words, dashes read as blanks."""
    pattern = r"\s+".join(map(re.escape, keyword.lower().replace("-", " ").split()))
    return bool(re.search(rf"\b{pattern}\b", query.lower().replace("-", " ")))


def mentions_loosely(query: str, phrase: str) -> bool:
    """Whether a phrase stands in a query, signs read as blanks and "I'm" as "im"."""
    apart = lambda x: re.sub("[^a-z0-9]+", " ", x)
    asked = re.sub(r"\bi\s*['’]\s*m\b", "im", query.casefold())
    return f" {apart(phrase.casefold())} " in f" {apart(asked)} "


def with_term_replaced(query: str, term: str, other: str) -> str:
    """A query with the first occurrence of a word written otherwise."""
    return re.sub(rf"(?i)\b{re.escape(term)}\b", lambda _: other, query, count=1)


def target_label(source: str) -> str:
    """What a wanted range was drawn from, for people: without the kinds of source and repetitions."""
    for kind in ("library_percentile:", "fallback:", "union:"):
        source = source.replace(kind, "")
    parts = unique_parts(re.split("[/+]", source))
    return "/".join(parts).replace("_", " ") or "requested"


def unique_parts(parts: list[str]) -> list[str]:
    return list(dict.fromkeys(p.strip() for p in parts if p.strip()))


def available_model(wanted: str, stored: list[str], default: str | None = None) -> str | None:
    """The stored model that a name means: the same, one with the same last part of its path, or for the default any."""
    leaf = lambda name: name.rstrip("/").rsplit("/", 1)[-1]
    if wanted in stored:
        return wanted
    alike = [m for m in stored if leaf(m) == leaf(wanted)]
    return alike[0] if alike else stored[0] if stored and wanted == default else None


def negated_terms(query: str) -> set[str]:
    return {w for phrases, words in NEGATIONS if any(mentions(query, p) for p in phrases) for w in words}


def parse_limit(query: str) -> int | None:
    """The first number of up to three digits."""
    m = re.search(r"\b(\d{1,3})\b", query)
    return int(m.group(1)) if m else None


def parse_sorts(query: str) -> list[tuple[str, str]]:
    """Up to three (field, direction), the first of each field."""
    text = " ".join(query.lower().split())
    found: list[tuple[str, str]] = []
    tempo = bool(re.search(r"\b(bpm|tempo)\b", text))
    if re.search(r"\b(fastest|quickest)\b", text) or (tempo and re.search(r"\b(highest|max(?:imum)?|(?:most|high|fast) (?:bpm|tempo))\b", text)):
        found.append(("tempo_bpm", "desc"))
    if re.search(r"\bslowest\b", text) or (tempo and re.search(r"\b(lowest|min(?:imum)?|(?:least|low|slow) (?:bpm|tempo))\b", text)):
        found.append(("tempo_bpm", "asc"))
    for name, (falling, rising) in SUPERLATIVES.items():
        found += [(name, "desc")] * any(mentions(text, p) for p in falling) + [(name, "asc")] * any(mentions(text, p) for p in rising)
    if m := re.search(r"\b(?:sort|order) by (bpm|tempo|energy|danceability|dance|aggression|brightness)\b(?: (asc|desc))?", text):
        name = {"bpm": "tempo_bpm", "tempo": "tempo_bpm", "dance": "danceability"}.get(m.group(1), m.group(1))
        found.append((name, m.group(2) or "desc"))
    first: dict[str, str] = {}
    for name, direction in found:
        first.setdefault(name, direction)
    return list(first.items())[:3]


def level_range(taxonomy: Taxonomy, percentiles: dict[str, dict], name: str, level: str) -> tuple[float, float]:
    """The range of a level in this library, or the fixed one where fewer than three values are known."""
    known = percentiles.get(name)
    if not known or known.get("n", 0) < 3:
        return taxonomy.ranges[name][level]
    low, high = PERCENTILE_OF_LEVEL[level]
    return known[low], known[high]


def merge_ranges(a: tuple[float, float] | None, b: tuple[float, float]) -> tuple[float, float]:
    """The common part of two ranges, else their hull."""
    if a is None:
        return b
    low, high = max(a[0], b[0]), min(a[1], b[1])
    return (low, high) if low <= high else (min(a[0], b[0]), max(a[1], b[1]))


def matching_tags(concepts: list[str], tags: list[tuple[str, float]]) -> list[str]:
    """Tags of the library (tag, weight) that a concept names, heaviest first."""
    negations = {"low", "not", "no", "without"}
    split = lambda x: re.findall("[a-z0-9]+", x.lower().replace("---", " ").replace("_", " "))
    wanted = [w for w in map(split, concepts) if w]
    hits = []
    for tag, weight in tags:
        words = split(tag)
        for own in wanted:
            if set(words) & negations and not set(own) & negations:
                continue
            if set(own) <= set(words) or (all(len(w) >= 3 for w in own) and " ".join(own) in " ".join(words)):
                hits.append((-weight, tag))
                break
    return unique(t for _, t in sorted(hits))


def parse_query(
    query: str, percentiles: dict[str, dict] | None = None, tags: list[tuple[str, float]] | None = None, limit: int | None = None,
    semantic: bool = False, taxonomy: Taxonomy | None = None,
) -> Intent:
    """The intent of a query against a library's percentiles {field: {n, lowest, p25..}} and tags."""
    taxonomy = taxonomy or default_taxonomy()
    negated = negated_terms(query)
    terms = [t for t in re.findall("[a-z0-9]+", query.lower()) if t not in QUERY_STOP_WORDS and not t.isdigit() and t not in negated]
    contexts = [c for c, p in taxonomy.contexts.items() if any(mentions(query, k) for k in p.keywords)]
    names = [n for n, p in taxonomy.priors.items() if any(mentions(query, k) for k in p.keywords)]
    names = [n for n in names if not (n == "aggressive" and "not_aggressive" in names) and not (n == "vocal" and "instrumental" in names)]
    active = [taxonomy.priors[n] for n in names] + [taxonomy.contexts[c] for c in contexts]
    avoid = unique(w for p in active for w in p.avoid)
    prefer = unique([w for p in active for w in p.prefer] + [t for t in terms if t not in avoid])
    sorts = parse_sorts(query)
    levels = [(f, lev) for p in active for f, lev in p.features.items()]
    levels += [(f, "very_high" if d == "desc" else "very_low") for f, d in sorts]
    ranges: dict[str, tuple[float, float]] = {}
    for name, level in levels:
        ranges[name] = merge_ranges(ranges.get(name), level_range(taxonomy, percentiles or {}, name, level))
    wanted = limit or parse_limit(query) or 10
    return Intent(
        query, max(1, min(100, wanted)), contexts, terms, prefer, avoid, matching_tags(prefer, tags or []), ranges, sorts, semantic
    )


def content_terms(intent: Intent) -> list[str]:
    return unique(t for t in intent.terms if t not in DIRECTIVES)


def names_tag(intent: Intent) -> bool:
    """Whether the content of a query names a tag of the library."""
    content = content_terms(intent)
    texts = [" ".join(re.findall("[a-z0-9]+", t.replace("_", " "))) for t in intent.prefer_tags]
    return bool(content) and any(c in t for t in texts for c in [*content, " ".join(content)])


def mode_of(intent: Intent, taxonomy: Taxonomy | None = None) -> str:
    """How a query is to be ranked."""
    occasions = (taxonomy or default_taxonomy()).occasions
    content = content_terms(intent)
    if intent.sorts:
        return "feature_sort"
    if any(c in occasions for c in intent.contexts):
        return "occasion"
    plain = [t for t in re.findall("[a-z0-9]+", intent.query.lower()) if t not in (*DIRECTIVES, "music", "song", "songs", "track", "tracks")]
    direct_tag = names_tag(intent) and not negated_terms(intent.query) and len(content) == 1 and plain == content
    if intent.contexts and not direct_tag:
        return "context_vibe"
    if names_tag(intent):
        return "tag_genre"
    if intent.contexts:
        return "context_vibe"
    if intent.ranges:
        return "feature_filter"
    if content:
        return "metadata_exact"
    return "fallback_semantic" if intent.semantic else "metadata_exact"


def semantic_role(intent: Intent, mode: str) -> str:
    """How vector similarity counts in a mode."""
    if not intent.semantic:
        return "disabled"
    if mode == "feature_sort":
        return "tie_breaker" if content_terms(intent) else "supporting_tie_breaker"
    return {"metadata_exact": "fallback", "tag_genre": "supporting", "feature_filter": "supporting"}.get(mode, "primary_evidence")


def clean_hints(hints: dict, taxonomy: Taxonomy | None = None) -> dict[str, list[str]]:
    """Advice from outside reduced to what may be used: known contexts (3), concepts (12 a side, 18 in all) of more than one letter."""
    known = (taxonomy or default_taxonomy()).contexts
    contexts = [c for c in unique(map(str, hints.get("contexts", ()))) if c in known][:3]
    sides = {}
    for side in ("prefer", "avoid"):
        sides[side] = [c for c in unique(map(str, hints.get(side, ()))) if len(c) > 1][:12]
    sides["avoid"] = sides["avoid"][: max(0, 18 - len(sides["prefer"]))]
    return {"contexts": contexts, **sides}


def explain(intent: Intent, taxonomy: Taxonomy | None = None) -> dict:
    """The plan of a query for people."""
    mode = mode_of(intent, taxonomy)
    return {
        "mode": mode, "semantic_role": semantic_role(intent, mode), "content_terms": content_terms(intent),
        "directives": [t for t in intent.terms if t in DIRECTIVES], "contexts": intent.contexts,
        "should": intent.prefer, "avoid": intent.avoid, "filters": intent.ranges, "sort_by": intent.sorts, "limit": intent.limit,
    }
