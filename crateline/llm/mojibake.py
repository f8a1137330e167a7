"""Finding and restoring text that was decoded with the wrong character encoding.

Every word of a text is the start of a best-first search. An edge encodes the
word as some program may have decoded it and decodes the bytes as they should
have been, or undoes an escape. A state's cost is what its path cost so far plus
the implausibility of its characters; visited texts are kept by hash so that no
state is expanded twice. Since implausibility is never negative, the search may
stop as soon as the cheapest open path costs more than the best text found.

A word is garbled if a text cheaper than itself can be reached, or if it holds
marks that only a failed decoding leaves behind; the latter is reported even
where nothing can be restored.

Defined results: NULL, empty and plain ASCII texts without escapes are in order;
texts are taken whole, word by word, at any length.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The decoders that may have been used wrongly, and the encodings that may have been meant.
WRONG_DECODERS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251")
MEANT_SINGLE = ("cp1252", "cp1251", "koi8-r", "cp866", "cp1253", "cp1250")
MEANT_MULTI = ("cp932", "euc_jp", "cp949", "gb18030")

#: Cost of an edge. A word that is valid UTF-8 by chance is rare, one that is valid in a single-byte encoding is common.
UTF8_COST, LOWERED_COST, MULTI_COST, SINGLE_COST, ESCAPE_COST = 0.5, 1.0, 2.6, 2.6, 0.3

#: Letters of other scripts that look like Latin ones and so may be typed on purpose or by slip.
CYRILLIC_ALIKE = "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝүкмтвн"
GREEK_ALIKE = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοικνυ"
LATIN_ALIKE = "ABEKMHOPCTXYaeopcyxikSIJsjvu"
_ALIKE = set(CYRILLIC_ALIKE + GREEK_ALIKE + LATIN_ALIKE)

_RUSSIAN = set("абвгдежзийклмнопрстуфхцчшщъыьэюяё")
_OPENING, _CLOSING, _INNER = set("«“„‘‚‹¿¡(["), set("»”’›…“‘)]™®ºª²³¹°"), set("’‐‑·–—‧・")
_BEFORE_WORD = set("§©®£€¥$¢№°±×÷†‡•")


@lru_cache(maxsize=65_536)
def _plain(c: str) -> str:
    """A wide, narrow or styled letter or digit as its plain form; superscripts stay symbols."""
    kind = unicodedata.decomposition(c).split(" ")[0]
    if kind in ("<wide>", "<narrow>", "<font>", "<compat>") and unicodedata.category(c)[0] in "LN":
        return unicodedata.normalize("NFKC", c)[:1] or c
    return c


@lru_cache(maxsize=65_536)
def _script(c: str) -> str:
    """One letter for the script of a letter, '' for what is no letter."""
    if not c.isalpha() or c in "ƒªº" or unicodedata.decomposition(c).startswith("<"):
        return ""
    name = unicodedata.name(c, "")
    for word, mark in (("LATIN", "L"), ("CYRILLIC", "C"), ("GREEK", "G"), ("HANGUL", "K")):
        if name.startswith(word):
            return mark
    if name.startswith(("HIRAGANA", "KATAKANA", "CJK", "IDEOGRAPHIC")):
        return "H"
    return "X"


@lru_cache(maxsize=65_536)
def _rarity(c: str, mark: str) -> float:
    """What a single letter costs by itself."""
    if mark == "L":
        if c.isascii():
            return 0.0
        return 0.25 if ord(c) < 0x180 or "\u1e00" <= c <= "\u1eff" or c in "ȘșȚțƠơƯư" else 1.3
    if mark == "C":
        return 0.0 if c.lower() in _RUSSIAN or c in _ALIKE else 0.8
    if mark == "H":
        if "\u3040" <= c <= "\u30ff":
            return 0.02
        try:
            lead = c.encode("cp932")[0]  # the first level of the Japanese set holds the common signs
        except UnicodeEncodeError:
            lead = 0xFF
        return 0.3 if lead < 0x98 else 2.0
    if mark == "K":
        try:
            c.encode("euc_kr")
        except UnicodeEncodeError:
            return 2.0
        return 0.1
    return 0.0 if mark == "G" else 2.0


@dataclass(frozen=True)
class LetterModel:
    """Bits of a letter behind another, from counts of letter pairs over a whole table."""

    bits: dict[str, float] = field(default_factory=dict)
    unseen: float = 14.0

    @classmethod
    def of(cls, counts: dict[str, int]) -> LetterModel:
        from math import log2

        firsts: dict[str, int] = {}
        for pair, n in counts.items():
            firsts[pair[0]] = firsts.get(pair[0], 0) + n
        rare = sum(counts.values()) / 100  # a letter seen less often than this says little about what follows it
        bits = {p: log2((firsts[p[0]] + rare) / n) for p, n in counts.items()}
        return cls({p: min(14.0, b) for p, b in bits.items()})

    def cost(self, word: str) -> float:
        """Bits above four per letter, halved; 0 without a model."""
        if not self.bits or len(word) < 2:
            return 0.0
        marked = f"^{word}"
        total = sum(self.bits.get(marked[i : i + 2], self.unseen) for i in range(len(word)))
        return max(0.0, total - 4.0 * len(word)) / 2


def implausibility(word: str, model: LetterModel) -> float:
    """How little the characters of a word look like meant text; 0 for plain words of one script."""
    if word.isascii():
        return 0.0
    cost = 0.0
    for part in re.split(r"[^\S\x1c-\x1f\x85]+", unicodedata.normalize("NFC", word)):
        if not part.isascii():
            cost += _part_cost(part, model)
    return cost


def _part_cost(part: str, model: LetterModel) -> float:
    cost, visible = 0.0, []
    for c in part:
        kind = unicodedata.category(c)
        if kind == "Mn":
            cost += 1.5  # it does not combine with its letter
        elif kind in ("Co", "Cn"):
            cost += 5
        elif kind != "Cf":
            cost += 1.0 if "\uff61" <= c <= "\uff9f" else 0.0
            visible.append(_plain(c))
    scripts = [_script(c) for c in visible]
    for i, c in enumerate(visible):
        mark = scripts[i]
        before, after = (visible[i - 1] if i else ""), (visible[i + 1] if i + 1 < len(visible) else "")
        if c == "\ufffd":
            cost += 6
        elif "\x80" <= c <= "\x9f":
            cost += 4
        elif mark:
            cost += _rarity(c, mark)
            last = scripts[i - 1] if i else ""
            if last == mark == "L" and not c.isascii() and not before.isascii():
                cost += 1.2
            if last and last != mark and {last, mark} & set("LCG") and {last, mark} & set("HKX"):
                cost += 3
            if last in ("L", "C", "G") and before.islower() and c.isupper():
                cost += 1.0
        elif ord(c) > 0x7F and not c.isdecimal():
            cost += _sign_cost(c, before, after)
    letters = [(c, s) for c, s in zip(visible, scripts, strict=True) if s in ("L", "C", "G")]
    if letters:
        cost += _mixing_cost(letters)
        word = "".join(c for c, _ in letters)
        if all(s != "L" for _, s in letters):
            cost += model.cost(word)
            if len(word) > 2 and word[0].islower() and word[1:].isupper():
                cost += 2.0
    return cost


def _mixing_cost(letters: list[tuple[str, str]]) -> float:
    """What letters of several alphabets in one word cost: little if those of the rarer ones are look-alikes."""
    count = {mark: sum(s == mark for _, s in letters) for mark in "LCG"}
    if max(count.values()) == len(letters):
        return 0.0
    for main in "LCG":
        others = [c for c, s in letters if s != main]
        if all(c in _ALIKE for c in others) and (main == "L" or count[main] > count["L"]):
            return min(1.2, 0.5 + 0.2 * len(others))
    return 3.0 * sum(a[1] != b[1] for a, b in zip(letters, letters[1:], strict=False))


def _sign_cost(c: str, before: str, after: str) -> float:
    """The cost of a sign between two characters: small where people set it, high inside words."""
    starts, ends = not before.isalnum(), not after.isalnum()
    if ord(c) >= 0x2600 and not 0x3000 <= ord(c) <= 0x30FF:
        return 0.0  # pictures
    if 0x3000 <= ord(c) <= 0x30FF:
        return 0.05
    if c in _OPENING and starts or c in _CLOSING and ends and c not in "º²³¹°ª®":
        return 0.1
    if c in _INNER and before.isalnum() and after.isalnum() and (before.isascii() or after.isascii()):
        return 0.1
    if c in _BEFORE_WORD and starts and (not after or after.isdigit() or c == "°"):
        return 0.1
    if c in "°²³¹ºª®™" and before.isdigit():
        return 0.1
    return 3.2 if _script(before or " ") or _script(after or " ") or "\u2200" <= c <= "\u25ff" else 0.6


def _encode(word: str, codec: str) -> bytes | None:
    """The bytes a decoder read; bytes it has no character for pass through as control characters."""
    out = bytearray()
    for c in word:
        try:
            out += c.encode(codec)
        except UnicodeEncodeError:
            if not "\x80" <= c <= "\x9f":
                return None
            out.append(ord(c))
    return bytes(out)


#: A well-formed sequence of two to four bytes.
_SEQUENCE = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")


def _as_utf8(raw: bytes, codec: str) -> str | None:
    """``raw`` with its well-formed sequences decoded and the rest left as ``codec`` reads it; None without any."""
    out, at, found = [], 0, False
    for m in _SEQUENCE.finditer(raw):
        try:
            text = m.group().decode("utf-8")
        except UnicodeDecodeError:
            continue
        out += [_read(raw[at : m.start()], codec), text]
        at, found = m.end(), True
    return "".join(out) + _read(raw[at:], codec) if found else None


def _read(raw: bytes, codec: str) -> str:
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def _raised(word: str) -> str:
    """Lead characters of sequences in upper case, for text that was lower-cased after it was garbled."""
    out = list(word)
    for i in range(len(out) - 1):
        if "\xe0" <= out[i] <= "\xef" and out[i + 1] > "\x7f" and out[i + 1] not in "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ":
            out[i] = out[i].upper()
    return "".join(out)


def _edges(word: str) -> Iterator[tuple[float, str]]:
    """The texts one operation away, with its cost."""
    if "&" in word and (plain := html.unescape(word)) != word:
        yield ESCAPE_COST, plain
    if re.search(r"%[0-9A-Fa-f]{2}", word):
        try:
            yield ESCAPE_COST, unquote_to_bytes(word).decode("utf-8")
        except UnicodeDecodeError:
            pass
    if "\\u" in word:
        yield ESCAPE_COST, re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m.group(1), 16)), word)
    if word.isascii():
        return
    for codec in WRONG_DECODERS:
        raw = _encode(word, codec)
        if raw is None:
            continue
        if (text := _as_utf8(raw, codec)) is not None:
            yield UTF8_COST, text
        for meant in MEANT_MULTI:
            try:
                yield MULTI_COST, raw.decode(meant)
            except UnicodeDecodeError:
                pass
        for rank, meant in enumerate(MEANT_SINGLE):
            if meant != codec:
                try:
                    yield SINGLE_COST + 0.01 * rank, raw.decode(meant)
                except UnicodeDecodeError:
                    pass
    if (raised := _raised(word)) != word:
        raw = _encode(raised, "cp1252")
        if raw is not None and (text := _as_utf8(raw, "cp1252")) is not None:
            yield LOWERED_COST, text


def restore_word(word: str, model: LetterModel) -> tuple[str, bool]:
    """(the cheapest reachable text, whether the word is garbled)."""
    own = implausibility(word, model)
    escaped = len(re.findall(r"&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]{2,8});|%[0-9A-Fa-f]{2}|\\u[0-9a-fA-F]{4}", word))
    # a capital A with tilde behind a small letter is an accented a whose second half was taken for a blank
    broken = "\ufffd" in word or any("\x80" <= c <= "\x9f" for c in word) or (word.endswith("Ã") and word[-2:-1].islower())
    if own < 0.45 and not escaped:
        return word, broken
    best_cost, best = own + 0.8 * escaped, word
    visited = {hash(word)}
    queue: list[tuple[float, float, str]] = [(own, 0.0, word)]
    while queue:
        _, paid, state = heapq.heappop(queue)
        if paid >= best_cost:
            continue
        for price, text in _edges(state):
            if paid + price >= best_cost or hash(text) in visited:
                continue
            visited.add(hash(text))
            here = implausibility(text, model)
            if paid + price + here < best_cost:
                best_cost, best = paid + price + here, text
            heapq.heappush(queue, (paid + price + here, paid + price, text))
    return best, best != word or broken


class Restorer:
    """Restores texts word by word and remembers the words it has seen."""

    def __init__(self, model: LetterModel | None = None):
        self._word = lru_cache(maxsize=200_000)(lambda w: restore_word(w, model or LetterModel()))

    def restore(self, text: str | None) -> tuple[str | None, bool]:
        """(text with its garbled words restored where possible, whether any word is garbled)."""
        if text is None:
            return None, False
        words = [self._word(w) for w in text.split(" ")]
        return " ".join(w for w, _ in words), any(bad for _, bad in words)


#: What a text needs to hold to be looked at at all.
SUSPECT = r"[^\x00-\x7F]|&#?[A-Za-z0-9]+;|%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}"


def letter_pairs(texts: DataFrame, column: str) -> LetterModel:
    """The model of Greek and Cyrillic letter pairs over all rows of a text column.

    There are fewer than 400 x 400 such pairs, whatever the size of the table.
    """
    words = texts.where(F.col(column).rlike(r"[\x{0370}-\x{04FF}]{2}")).select(
        F.explode(F.regexp_extract_all(F.col(column), F.lit(r"([\x{0370}-\x{04FF}]{2,})"), 1)).alias("w")
    )
    words = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    at = F.explode(F.sequence(F.lit(1), F.length("w"))).alias("i")
    pairs = words.select(F.concat(F.lit("^"), "w").alias("w"), "n", at).select(F.expr("substring(w, i, 2)").alias("p"), "n")
    rows = pairs.groupBy("p").agg(F.sum("n").alias("n")).collect()
    return LetterModel.of({r["p"]: int(r["n"]) for r in rows})


RESTORED = T.StructType([T.StructField("text", T.StringType()), T.StructField("garbled", T.BooleanType())])


def restored(text: Column, model: LetterModel) -> Column:
    """Column of struct<text, garbled>."""

    @F.pandas_udf(RESTORED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(model)
        for batch in batches:
            yield pd.DataFrame([restorer.restore(x) for x in batch], columns=["text", "garbled"], index=batch.index)

    return run(text)


def long_fields(df: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """(track_id, field_name, text): the non-NULL fields of each row, one per row."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in columns])
    rows = df.select(F.col(id_column).alias("track_id"), F.explode(pairs).alias("f"))
    return rows.select("track_id", "f.field_name", "f.text").where(F.col("text").isNotNull())


def garbled_fields(fields: DataFrame) -> DataFrame:
    """(track_id, field_name, text, restored) of the garbled fields of (track_id, field_name, text)."""
    suspects = fields.where(F.col("text").rlike(SUSPECT))
    model = letter_pairs(suspects, "text")
    out = suspects.withColumn("_r", restored(F.col("text"), model)).where("_r.garbled")
    return out.select("track_id", "field_name", "text", F.col("_r.text").alias("restored"))
