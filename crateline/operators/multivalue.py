"""Splitting fields that hold several values into one row per value.

A quote-aware finite-state tokenizer walks each field once. It tracks the open
quote, escapes and bracket depth and cuts only at delimiters found outside
quotes and brackets. Names of a lexicon that themselves contain delimiters
("Tape/Loop", "A & B") act like quoted text. The rows of a table are handled
independently, so nothing is shuffled and a hot value costs nothing extra.

Defined results: NULL, empty and blank fields yield no value; empty pieces are
skipped and do not count for positions; repeated values stay; an unclosed quote
or bracket is ordinary text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crateline.operators.bounded import collect_if_small
from crateline.operators.skew import lookup
from crateline.session import cut_lineage

#: Lexicons above this size are joined to the candidate spans instead of shipped to the workers.
MAX_LEXICON = 200_000

_OPEN, _CLOSE = "([{", ")]}"


@dataclass(frozen=True)
class Grammar:
    """What separates values in a field.

    symbols: characters that always separate.
    spaced: characters that separate only between blanks.
    words: patterns of words that separate between blanks (or after an opening bracket, for guest lists).
    word_case: words that separate only as written.
    names: whether "Surname, Given" and "Name, The" are one value.
    """

    symbols: str = ";|\t\n\r\x00；｜"
    spaced: str = "·•‧/"
    words: tuple[str, ...] = ()
    word_case: tuple[str, ...] = ()
    guests: tuple[str, ...] = ()
    names: bool = False
    articles: frozenset[str] = frozenset()

    @lru_cache(maxsize=64)
    def delimiter(self) -> re.Pattern:
        parts = [r"\\\\+", r"\s*[" + re.escape(self.symbols) + r"]\s*"]
        if self.spaced:
            parts.append(r"\s+[" + re.escape(self.spaced) + r"]+\s+")
        if self.guests:
            parts.append(r"\s+(?i:" + "|".join(self.guests) + r")(?=\s|[(\"'])\s*")
        if self.words:
            parts.append(r"\s+(?i:" + "|".join(self.words) + r")(?=\s)\s*")
        if self.word_case:
            parts.append(r"\s+(?:" + "|".join(self.word_case) + r")(?=\s)\s*")
        return re.compile("|".join(parts))

    @lru_cache(maxsize=64)
    def guest_open(self) -> re.Pattern | None:
        return re.compile(r"\s*[(\[]\s*(?i:" + "|".join(self.guests) + r")\s+") if self.guests else None


#: How people join genres and artists.
GENRE_GRAMMAR = Grammar(symbols=";|/,·•‧\t\n\r\x00；｜／，、", spaced="")
ARTIST_GRAMMAR = Grammar(
    symbols=";|/,\t\n\r\x00；｜／，、",
    spaced="·•‧&+",
    words=("and", r"vs\.?", "with", "versus"),
    word_case=("x", "X", "×"),
    guests=(r"feat\.?", r"ft\.?", "featuring", "f/", "w/"),
    names=True,
    articles=frozenset({"the", "la", "le", "les", "los", "las", "el", "der", "die", "das", "il", "gli", "a", "an"}),
)


def lexicon_key(text: str) -> str:
    """Letters and digits of the compatibility form without accents and case."""
    folded = unicodedata.normalize("NFKD", text).casefold()
    return "".join(c for c in folded if c.isalnum())


def _deletions(key: str) -> set[str]:
    return {key} | {key[:i] + key[i + 1 :] for i in range(len(key))}


@dataclass
class Lexicon:
    """Known values; those that hold delimiters are also recognised with one typing slip."""

    exact: set[str] = field(default_factory=set)
    near: set[str] = field(default_factory=set)
    max_pieces: int = 1

    @classmethod
    def of(cls, names: Iterable[str], grammar: Grammar) -> Lexicon:
        lex = cls()
        for name in names:
            if not name or not (key := lexicon_key(name)):
                continue
            lex.exact.add(key)
            pieces = _pieces_of(name, grammar)
            if pieces > 1:
                lex.max_pieces = max(lex.max_pieces, pieces)
                if len(key) >= 8:
                    lex.near |= _deletions(key)
        return lex

    def holds(self, text: str) -> bool:
        return lexicon_key(text) in self.exact

    def holds_about(self, text: str) -> bool:
        key = lexicon_key(text)
        return key in self.exact or (len(key) >= 8 and not self.near.isdisjoint(_deletions(key)))


@dataclass
class _Piece:
    start: int
    end: int
    text: str
    quoted: bool
    after: str = ""  # the delimiter behind it


def _closing_quote(text: str, i: int, ends: re.Pattern) -> tuple[int, str] | None:
    """The place behind the quote that closes the one at ``i`` and the unescaped text between, if any."""
    quote, out, j, n = text[i], [], i + 1, len(text)
    while j < n:
        c = text[j]
        if c == "\\" and j + 1 < n and text[j + 1] in "\"'\\/nt":
            out.append({"n": "\n", "t": "\t"}.get(text[j + 1], text[j + 1]))
            j += 2
        elif c == "\\" and re.fullmatch(r"u[0-9a-fA-F]{4}", text[j + 1 : j + 6]):
            out.append(chr(int(text[j + 2 : j + 6], 16)))
            j += 6
        elif c == quote:
            if j + 1 < n and text[j + 1] == quote:
                out.append(quote)
                j += 2
                continue
            rest = text[j + 1 :]
            stripped = rest.lstrip()
            if not stripped or ends.match(rest) or stripped[0] in ")]}" or (rest[0].isspace() and stripped[0] == quote):
                return j + 1, "".join(out)
            if quote == '"':
                return None
            out.append(c)  # an apostrophe inside single quotes
            j += 1
        else:
            out.append(c)
            j += 1
    return None


def scan(text: str, grammar: Grammar) -> list[_Piece]:
    """One pass of the tokenizer: the raw pieces with their places and the delimiters behind them."""
    cut, guest = grammar.delimiter(), grammar.guest_open()
    pieces: list[_Piece] = []
    i, n = 0, len(text)
    listed = text.strip()
    closing = -1
    if len(listed) > 1 and listed[0] == "[" and listed[-1] == "]":
        i, closing = text.index("[") + 1, text.rindex("]")
        n = closing
    depth = guest_depth = 0
    start, out = i, []

    def flush(end: int, after: str) -> None:
        nonlocal out
        raw = "".join(out).strip()
        if raw:
            lead = len(text[start:end]) - len(text[start:end].lstrip())
            pieces.append(_Piece(start + lead, end, raw, False, after))
        elif pieces:
            pieces[-1].after = pieces[-1].after or after
        out = []

    while i < n:
        c = text[i]
        at_start = not "".join(out).strip()
        if at_start and c.isspace() and c not in grammar.symbols:
            i += 1
            continue
        if at_start and c in "\"'" and depth == 0 and (closed := _closing_quote(text[:n], i, cut)):
            end, value = closed
            if value.strip():
                pieces.append(_Piece(i, end, value.strip(), True))
            out, start = [], end
            i = end
            while i < n and text[i].isspace() and text[i] not in grammar.symbols and not cut.match(text, i, n):
                i += 1
            if (m := cut.match(text, i, n)) and m.end() > i:
                if pieces:
                    pieces[-1].after = m.group()
                i = m.end()
            elif pieces:
                pieces[-1].after = " "
            start = i
            continue
        if c == "\\" and i + 1 < n and text[i + 1] != "\\" and text[i + 1] in grammar.symbols:
            out.append(text[i + 1])
            i += 2
            continue
        if guest and depth == 0 and (m := guest.match(text, i, n)):
            flush(i, "feat")
            guest_depth += 1
            i = start = m.end()
            continue
        if guest_depth and depth == 0 and c in ")]":
            flush(i, " ")
            guest_depth -= 1
            i += 1
            start = i
            continue
        if depth == 0 and (m := cut.match(text, i, n)) and m.end() > i:
            flush(i, m.group())
            i = start = m.end()
            continue
        if c in _OPEN and any(x in text[i:n] for x in _CLOSE[_OPEN.index(c)]):
            depth += 1
        elif c in _CLOSE and depth:
            depth -= 1
        out.append(c)
        i += 1
    flush(n, "")
    return pieces


def _inverted(left: _Piece, right: _Piece, grammar: Grammar, lexicon: Lexicon) -> bool:
    """Whether two pieces around a comma are one name written surname first or with its article last."""
    if left.quoted or right.quoted or left.after.strip() not in (",", "，"):
        return False
    if right.text.casefold() in grammar.articles:
        return True
    turned = f"{right.text} {left.text}"
    if lexicon.holds(turned):
        return True
    words = len(right.text.split())
    if len(left.text.split()) == 1 and words <= 3:
        return not lexicon.holds(left.text) and not (words > 1 and lexicon.holds(right.text))
    return False


def split_text(text: str | None, grammar: Grammar, lexicon: Lexicon) -> list[str]:
    """The values of one field, in order."""
    if text is None or not text.strip():
        return []
    pieces = scan(text, grammar)
    if len(pieces) > 1 and lexicon.holds(text) and not pieces[0].quoted:
        return [text[pieces[0].start : pieces[-1].end].strip()]
    values: list[str] = []
    i = 0
    while i < len(pieces):
        taken = 1
        if not pieces[i].quoted:
            top = min(len(pieces), i + lexicon.max_pieces)
            for j in range(top - 1, i, -1):
                if any(p.quoted for p in pieces[i : j + 1]):
                    continue
                if lexicon.holds_about(text[pieces[i].start : pieces[j].end]):
                    taken = j - i + 1
                    break
            if taken == 1 and grammar.names and i + 1 < len(pieces) and _inverted(pieces[i], pieces[i + 1], grammar, lexicon):
                taken = 2
        values.append(pieces[i].text if taken == 1 else text[pieces[i].start : pieces[i + taken - 1].end].strip())
        i += taken
    return values


def value_array(text: Column, grammar: Grammar, lexicon: Lexicon) -> Column:
    """Column of ``array<string>`` with the values of ``text`` in order."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: split_text(x, grammar, lexicon))

    return split(text)


def split_values(
    df: DataFrame,
    id_column: str,
    fields: dict[str, tuple[Grammar, DataFrame]],
    min_values: int = 1,
    max_lexicon: int = MAX_LEXICON,
) -> DataFrame:
    """Rows (id, field_name, pos, val): one for each value of each field.

    ``fields`` maps a column to its grammar and a one-column DataFrame of known
    names. ``min_values=2`` keeps the fields that hold several values only. A
    field without any delimiter never reaches Python. A lexicon of more than
    ``max_lexicon`` names is not broadcast: the candidate spans of the fields
    are matched with it by a join first, and each row brings its own names.
    """
    parts = []
    for column, (grammar, names) in fields.items():
        base = df.select(F.col(id_column), F.lit(column).alias("field_name"), F.col(column).alias("_text"))
        base = base.where(F.trim("_text") != "")
        packed = base.where(F.col("_text").rlike(_any_delimiter(grammar)))
        names = names.toDF("_name").where(F.col("_name").isNotNull())
        rows = collect_if_small(names, max_lexicon)
        if rows is not None:
            lexicon = Lexicon.of((r[0] for r in rows), grammar)
            split = packed.withColumn("_values", value_array(F.col("_text"), grammar, lexicon))
        else:
            split = _split_with_join(packed, grammar, names)
        if min_values <= 1:
            plain = base.where(~F.col("_text").rlike(_any_delimiter(grammar)))
            split = split.unionByName(plain.withColumn("_values", F.array(F.trim("_text"))))
        split = split.where(F.size("_values") >= min_values)
        parts.append(
            split.select(id_column, "field_name", F.posexplode("_values").alias("_pos", "val")).select(
                id_column, "field_name", (F.col("_pos") + 1).alias("pos"), "val"
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _any_delimiter(grammar: Grammar) -> str:
    """A cheap pattern found in every field that may need the tokenizer (quotes and lists included)."""
    signs = "".join(sorted(set(grammar.symbols + grammar.spaced)))
    signs = "".join(f"\\x{{{ord(c):x}}}" for c in signs)
    words = "|".join([*grammar.words, *grammar.word_case, *grammar.guests])
    pattern = r"[\[\"'\\" + signs + "]"
    return f"{pattern}|(?i)[\\s(\\[](?:{words})\\s" if words else pattern


def _pieces_of(name: str, grammar: Grammar) -> int:
    return len([p for p in grammar.delimiter().split(name) if p and p.strip()])


def lexicon_keys(name: str, grammar: Grammar) -> list[str]:
    """What a known name is joined by: its key, and for names with delimiters the key with one slip."""
    key = lexicon_key(name)
    if not key:
        return []
    near = _deletions(key) if len(key) >= 8 and _pieces_of(name, grammar) > 1 else set()
    return ["=" + key, *sorted("~" + k for k in near)]


def candidate_spans(text: str, grammar: Grammar, widest: int) -> list[str]:
    """Keys of all runs of up to ``widest`` pieces, for matching with a lexicon too large to ship."""
    pieces = scan(text, grammar)
    keys, near = {lexicon_key(text)}, set()
    for i in range(len(pieces)):
        for j in range(i, min(len(pieces), i + widest)):
            key = lexicon_key(text[pieces[i].start : pieces[j].end])
            keys.add(key)
            if j > i and len(key) >= 8:
                near |= _deletions(key)
        if i + 1 < len(pieces):
            keys.add(lexicon_key(f"{pieces[i + 1].text} {pieces[i].text}"))
    return sorted("=" + k for k in keys if k) + sorted("~" + k for k in near)


def _split_with_join(packed: DataFrame, grammar: Grammar, names: DataFrame) -> DataFrame:
    pieces = F.pandas_udf(lambda s: s.map(lambda x: _pieces_of(x, grammar)), T.IntegerType())
    widest = names.agg(F.max(pieces("_name"))).first()[0] or 1
    strings = T.ArrayType(T.StringType())
    spans_of = F.pandas_udf(lambda s: s.map(lambda x: candidate_spans(x, grammar, widest)), strings)
    keys_of = F.pandas_udf(lambda s: s.map(lambda x: lexicon_keys(x, grammar)), strings)
    texts = packed.select("_text").distinct()
    spans = texts.select("_text", F.explode(spans_of("_text")).alias("_key"))
    keys = names.select(F.explode(keys_of("_name")).alias("_key")).distinct()
    known = spans.join(keys, "_key", "left_semi").groupBy("_text").agg(F.collect_set("_key").alias("_known"))

    @F.pandas_udf(strings)
    def split(text: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for value, keys in zip(text, known, strict=True):
            own = list(keys) if keys is not None else []
            exact, near = ({k[1:] for k in own if k[0] == sign} for sign in "=~")
            out.append(split_text(value, grammar, Lexicon(exact, near, widest)))
        return pd.Series(out)

    # every distinct text is split once, and its values go back to its rows without gathering a frequent text in one task
    done = texts.join(known, "_text", "left").withColumn("_values", split("_text", "_known")).select("_text", "_values")
    return lookup(packed, "_text", cut_lineage(done), "_text", "_values", "_values")
