"""The vocabulary of queries: feature ranges, contexts, priors and stop words, built in small or loaded from a file."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

LEVELS = ("very_low", "low", "low_mid", "mid", "mid_high", "high", "very_high")

#: Feature ranges by level where a library has too few values for percentiles, as (low, high) by level.
_RANGES = {
    "energy": ((0, 0.25), (0, 0.4), (0, 0.65), (0.25, 0.75), (0.4, 1), (0.55, 1), (0.7, 1)),
    "danceability": ((0, 0.25), (0, 0.4), (0, 0.6), (0.3, 0.75), (0.45, 1), (0.6, 1), (0.75, 1)),
    "aggression": ((0, 0.2), (0, 0.35), (0, 0.55), (0.25, 0.7), (0.4, 1), (0.6, 1), (0.75, 1)),
    "brightness": ((0, 0.25), (0, 0.4), (0, 0.6), (0.25, 0.75), (0.4, 1), (0.6, 1), (0.75, 1)),
    "tempo_bpm": ((45, 80), (50, 95), (60, 115), (75, 125), (90, 150), (105, 180), (130, 210)),
}

#: Our own small vocabulary: keywords | wanted tags | unwanted tags | feature levels.
_CONTEXTS = {
    "chill": "chill,calm,laid back | calm,ambient,downtempo | aggressive,party | energy:low,aggression:low",
    "bar": "bar,lounge,cocktail | lounge,jazz,soul | aggressive | energy:low,aggression:low",
    "background": "background | background,ambient,instrumental | aggressive,vocal | energy:low_mid,aggression:low",
    "cooking": "cooking,kitchen | groove,warm | aggressive | energy:mid,danceability:mid",
    "dinner": "dinner,dining | warm,lounge | aggressive,workout | energy:low_mid,aggression:low",
    "no_vocals_background": "no vocals,without vocals | instrumental,ambient | vocal,speech | energy:low_mid",
    "driving": "driving,drive,road trip | groove,upbeat | sleep | energy:mid_high,tempo_bpm:mid_high",
    "shower": "shower,morning | happy,upbeat | sleep,sad | energy:high",
    "melancholic": "sad,melancholic | sad,dark | party | energy:low,brightness:low",
    "party": "party,dancefloor | party,house,disco | sleep,sad | energy:high,danceability:high",
    "wedding": "wedding,reception | romantic,happy,disco | aggressive,sleep | energy:mid,danceability:mid_high",
    "workout": "workout,gym,running | energetic,fast | sleep,soft | energy:very_high,tempo_bpm:high",
    "focus": "focus,study,work | ambient,minimal | aggressive,party | energy:low,aggression:low",
    "sleep": "sleep,night | calm,ambient,slow | party,fast | energy:very_low,tempo_bpm:low",
    "ambient": "ambient,atmospheric | ambient,soundscape | aggressive | aggression:low",
    "romantic": "romantic,love | romantic,soft | aggressive | energy:low_mid",
    "happy": "happy,uplifting | happy,upbeat | sad,dark | energy:mid_high",
    "dark": "dark,moody | dark,deep | happy,party | brightness:low",
}
_PRIORS = {
    "energetic": "energetic,high energy | energetic,upbeat | sleep,calm | energy:high",
    "low_energy": "low energy,quiet,mellow | calm,soft | aggressive | energy:low_mid,aggression:low",
    "danceable": "danceable,groovy | dance,groove | drone | danceability:high",
    "fast": "fast,uptempo,high bpm | fast | slow | tempo_bpm:high",
    "slow": "slow,downtempo,low bpm | slow | fast | tempo_bpm:low",
    "aggressive": "aggressive,heavy,brutal | aggressive,heavy | calm,soft | aggression:high",
    "not_aggressive": "not aggressive,less aggressive | calm,gentle | aggressive,heavy | aggression:low",
    "bright": "bright,sparkly | bright | dark | brightness:high",
    "dark": "dark,moody | dark,deep | bright | brightness:low",
    "instrumental": "instrumental,no vocals | instrumental | vocal | ",
    "vocal": "vocal,singing | vocal,song | instrumental | ",
    "lofi": "lofi,lo-fi | lo-fi,beats | aggressive | energy:low_mid",
}
OCCASIONS = ("driving", "party", "shower", "wedding", "workout")


@dataclass(frozen=True)
class Prior:
    """What the mention of a context or a quality asks for."""

    keywords: tuple[str, ...]
    prefer: tuple[str, ...] = ()
    avoid: tuple[str, ...] = ()
    features: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Taxonomy:
    ranges: dict[str, dict[str, tuple[float, float]]]
    contexts: dict[str, Prior]
    priors: dict[str, Prior]
    occasions: tuple[str, ...]


def _words(text: str) -> tuple[str, ...]:
    return tuple(w.strip() for w in text.split(",") if w.strip())


def _prior(line: str) -> Prior:
    keywords, prefer, avoid, features = (p.strip() for p in line.split("|"))
    return Prior(_words(keywords), _words(prefer), _words(avoid), dict(p.split(":") for p in _words(features)))


def default_taxonomy() -> Taxonomy:
    """The built-in vocabulary."""
    ranges = {f: {lev: (float(a), float(b)) for lev, (a, b) in zip(LEVELS, pairs, strict=True)} for f, pairs in _RANGES.items()}
    return Taxonomy(ranges, {k: _prior(v) for k, v in _CONTEXTS.items()}, {k: _prior(v) for k, v in _PRIORS.items()}, OCCASIONS)


def parse_taxonomy(data: dict[str, Any]) -> Taxonomy:
    """A vocabulary from nested mappings, checked: all levels present, known fields, no keyword twice, occasions among contexts."""
    for part in ("feature_ranges", "contexts", "query_priors"):
        if not isinstance(data.get(part), dict):
            raise ValueError(f"{part} is missing")
    ranges = {}
    for name, levels in data["feature_ranges"].items():
        if set(levels) != set(LEVELS):
            raise ValueError(f"feature_ranges.{name} must define {', '.join(LEVELS)}")
        ranges[name] = {k: (float(v[0]), float(v[1])) for k, v in levels.items()}

    def priors(part: str) -> dict[str, Prior]:
        out, seen = {}, set()
        for name, entry in data[part].items():
            words = tuple(str(w).lower() for w in entry.get("keywords", ()))
            if not words:
                raise ValueError(f"{part}.{name} has no keywords")
            if twice := [w for w in words if (name, w) in seen or words.count(w) > 1]:
                raise ValueError(f"{part}.{name} repeats {twice[0]}")
            for f, level in (entry.get("features") or {}).items():
                if f not in ranges or level not in LEVELS:
                    raise ValueError(f"{part}.{name} asks for unknown {f}:{level}")
            out[name] = Prior(words, tuple(entry.get("prefer", ())), tuple(entry.get("avoid", ())), dict(entry.get("features") or {}))
        return out

    contexts = priors("contexts")
    occasions = tuple(data.get("occasion_contexts", ()))
    if unknown := [o for o in occasions if o not in contexts]:
        raise ValueError(f"unknown occasion {unknown[0]}")
    return Taxonomy(ranges, contexts, priors("query_priors"), occasions)


def load_taxonomy(path: str) -> Taxonomy:
    """A vocabulary from a JSON file, or a YAML file where a YAML reader is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        return parse_taxonomy(yaml.safe_load(text))
    return parse_taxonomy(json.loads(text))
