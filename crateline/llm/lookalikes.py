"""Bringing text that looks the same into one consistent form.

Words of a table that are in form make up a vocabulary, kept as tries. Every
word with a character outside plain ASCII is read by a weighted edit automaton
that walks the trie and the word together: look-alike letters match, letters of
compatibility forms and letters with marks apart are composed, and ignorable
characters are skipped, all at no cost but counted as free steps; another case
or accent costs a part of an edit, and anything else is more than the budget.
The cheapest spelling, then the one with fewest free steps, then the most
frequent one is taken as canonical. A word is out of form if its reading took a
free step; a word in form is in the vocabulary and reads itself without any. A
word without a match is normalised and judged by table.

Tries are built per bucket of words. The bucket is a hash of the word's skeleton
(plain Latin letters of its look), which no free or cheap step of the automaton
changes, so a word and all its possible matches are always in one bucket, and
buckets are even because each distinct word is there once. Only words whose
skeleton some asked word has enter a trie, so a trie does not grow with the
plain part of the vocabulary.

Defined results: NULL texts stay out; empty and ASCII texts without control
characters are in form; punctuation, emoji sequences and whole words of another
script are in order; texts are taken whole; equal rows come out once.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crateline.llm.mojibake import LetterModel, letter_pairs, restored
from crateline.operators.skew import lookup
from crateline.session import cut_lineage

#: Letters of other alphabets and the Latin letters they look like.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХԌԚԜаеѕіјкорсухһԁԛԝ", "ABESIJKMHOPCTYXGQWaesijkopcyxhdqw", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳαικνορυϲ", "ABEZHIKMNOPTYXCjaiknopuc".replace("kno", "kvo"), strict=True))
OTHER = dict(zip("ՍՕօսհոցɑɡᎪᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᏃ", "UOouhngagAEGHJKLMPRSTVZ", strict=True))
LATIN_OF = CYRILLIC | GREEK | OTHER
CYRILLIC_OF = {v: k for k, v in CYRILLIC.items()}
GREEK_OF = {v: k for k, v in GREEK.items()}

#: Characters without a look of their own besides the format characters (ranges, inclusive).
_INVISIBLE = ((0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF))

#: What a step of the automaton costs, and the most a match may cost.
CASE_COST, ACCENT_COST, BUDGET = 0.3, 0.6, 0.95


@lru_cache(maxsize=65_536)
def is_invisible(c: str) -> bool:
    kind, code = unicodedata.category(c), ord(c)
    if kind == "Cf" or (kind == "Cc" and not c.isspace()):
        return True
    return any(a <= code <= b for a, b in _INVISIBLE)


@lru_cache(maxsize=65_536)
def is_compatibility(c: str) -> bool:
    """Whether a letter or digit is another one in disguise (wide, narrow, styled, ligature, ...)."""
    return unicodedata.category(c)[0] in "LN" and ord(c) > 0x7F and unicodedata.decomposition(c)[:1] not in ("",) and (
        unicodedata.decomposition(c).startswith("<") or len(unicodedata.decomposition(c).split()) == 1
    )


@lru_cache(maxsize=65_536)
def alphabet(c: str) -> str:
    """The alphabet of a letter; '' for marks, digits and signs; CJK scripts count as none."""
    if not c.isalpha():
        return ""
    name = unicodedata.name(c, "").split(" ")[0]
    return "" if name in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "KATAKANA-HIRAGANA", "IDEOGRAPHIC", "BOPOMOFO", "MODIFIER") else name


def _is_picture(c: str) -> bool:
    return ord(c) >= 0x1F000 or 0x2190 <= ord(c) <= 0x2BFF or c in "©®‼⁉™〰〽㊗㊙#*0123456789"


def _in_sequence(text: str, i: int) -> bool:
    """Whether the invisible character at ``i`` belongs to an emoji sequence or joins letters of a script that needs it."""
    c = text[i]
    before = text[i - 1] if i else ""
    if c in "︎️" or 0xE0020 <= ord(c) <= 0xE007F:
        return bool(before) and (_is_picture(before) or 0xE0020 <= ord(before) <= 0xE007F)
    if c in "‌‍" and before:
        after = text[i + 1] if i + 1 < len(text) else ""
        if c == "‍" and after and _is_picture(after) and (_is_picture(before) or before == "️"):
            return True
        joined = ("ARABIC", "DEVANAGARI", "BENGALI", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "GUJARATI", "SINHALA")
        return unicodedata.name(before, "").startswith(joined)
    return False


def out_of_form(text: str) -> bool:
    """Whether any character of a text is out of form."""
    if text.isascii() and text.isprintable():
        return False
    if unicodedata.normalize("NFC", text) != text:
        return True
    word: set[str] = set()
    for i, c in enumerate(text):
        if c.isspace():
            if c != " ":
                return True
            word = set()
        elif is_invisible(c):
            if not _in_sequence(text, i):
                return True
        elif c in "゛゜" and i and unicodedata.name(text[i - 1], "").startswith(("HIRAGANA", "KATAKANA")):
            return True
        elif is_compatibility(c):
            return True
        elif c.isalpha():
            word.add(alphabet(c))
            if len(word - {""}) > 1:
                return True
        elif unicodedata.category(c)[0] != "M":
            word = set()
    return False


def clusters(word: str) -> list[tuple[list[str], int]]:
    """What the automaton reads: (plain letters, free steps) of each character with the marks that belong to it.

    An ignorable character has no letters and is one free step; a letter in a
    compatibility form, or one with marks apart that compose, is one too.
    """
    out: list[tuple[list[str], int]] = []
    i, n = 0, len(word)
    while i < n:
        if is_invisible(word[i]) and not _in_sequence(word, i):
            out.append(([], 1))
            i += 1
            continue
        j = i + 1
        while j < n and _joins(word[j]) and not is_invisible(word[j]):
            j += 1
        written = word[i:j]
        plain = written[0] + written[1:].replace("゛", "゙").replace("゜", "゚")
        plain = "".join(unicodedata.normalize("NFKC", c) if is_compatibility(c) else c for c in plain)
        letters = unicodedata.normalize("NFC", plain)
        out.append((list(letters), int(letters != written)))
        i = j
    return out


@lru_cache(maxsize=65_536)
def _joins(c: str) -> bool:
    """Whether a character belongs to the letter before it: a mark, a voicing sign, a later part of a syllable."""
    return unicodedata.category(c)[0] == "M" or c in "゛゜ﾞﾟ" or 0x1161 <= ord(c) <= 0x11FF


def units(word: str) -> list[str]:
    """The visible letters of a word, each in plain form with its marks composed."""
    seen = "".join(c for i, c in enumerate(word) if not is_invisible(c) or _in_sequence(word, i))
    seen = seen.replace("゛", "゙").replace("゜", "゚")
    plain = "".join(unicodedata.normalize("NFKC", c) if is_compatibility(c) else c for c in seen)
    return list(unicodedata.normalize("NFC", plain))


@lru_cache(maxsize=65_536)
def look(c: str) -> str:
    """The letter in Latin look-alikes, case and accents kept."""
    parts = unicodedata.normalize("NFD", c)
    return unicodedata.normalize("NFC", LATIN_OF.get(parts[0], parts[0]) + parts[1:])


@lru_cache(maxsize=65_536)
def bare(c: str) -> str:
    """The look without accents and case."""
    parts = unicodedata.normalize("NFD", c)
    letter = "".join(x for x in parts if unicodedata.category(x) != "Mn") or parts
    return "".join(LATIN_OF.get(x, x) for x in letter).casefold()


def skeleton(word: str) -> str:
    return "".join(bare(c) for c in units(word))


class Trie:
    """A vocabulary with how often each word occurs."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = count

    def canonical(self, word: str) -> tuple[str, int] | None:
        """(the spelling that a word stands for, free steps), found by the weighted edit automaton; None without one."""
        # states of the automaton: (node, spelling, cost, free steps)
        states: list[tuple[dict, str, float, int]] = [(self.root, "", 0.0, 0)]
        for letters, free in clusters(word):
            if free:
                states = [(node, spelled, cost, steps + free) for node, spelled, cost, steps in states]
            for c in letters:
                following = []
                for node, spelled, cost, steps in states:
                    for letter, child in node.items():
                        if letter == "":
                            continue
                        step = _step(c, letter)
                        if cost + step <= BUDGET:
                            following.append((child, spelled + letter, cost + step, steps + (letter != c and not step)))
                states = following
                if not states:
                    return None
        ends = [(cost, steps, -node[""], spelled) for node, spelled, cost, steps in states if "" in node]
        if not ends:
            return None
        _, steps, _, spelled = min(ends)
        return spelled, steps


@lru_cache(maxsize=200_000)
def _step(c: str, letter: str) -> float:
    if c == letter or look(c) == look(letter):
        return 0.0
    if bare(c) != bare(letter):
        return 9.0
    same_accent = look(c).casefold() == look(letter).casefold()
    return CASE_COST if same_accent else ACCENT_COST


def by_table(word: str) -> str:
    """A word without a match in the vocabulary: plain letters, and strays in the alphabet of their neighbours."""
    out: list[str] = []
    run: list[str] = []
    for c in [*units(word), ""]:
        if c and (c.isalpha() or unicodedata.category(c[0])[0] == "M"):
            run.append(c)
        else:
            out += [_one_alphabet(run), c]
            run = []
    return "".join(out)


def _one_alphabet(run: list[str]) -> str:
    """A run of letters with those of other alphabets replaced by their look-alikes, if all have one."""
    count: dict[str, int] = {}
    for c in run:
        if name := alphabet(c):
            count[name] = count.get(name, 0) + 1
    if len(count) > 1:
        # the alphabet with most letters first
        for main in sorted(count, key=lambda n: (-count[n], n != "LATIN", n)):
            into = {"LATIN": LATIN_OF, "CYRILLIC": CYRILLIC_OF, "GREEK": GREEK_OF}.get(main)
            if into is not None and all(alphabet(c) in ("", main) or c in into for c in run):
                return "".join(c if alphabet(c) in ("", main) else into[c] for c in run)
    return "".join(run)


#: Texts with anything but printable ASCII, what parts words (all white space, as Python sees it), and spaces other than U+0020.
_ODD = r"[^\x20-\x7E]"
_BLANKS = r"(?U)[\s\x1c-\x1f]+"
_ODD_BLANK = r"(?U)[\s\x1c-\x1f&&[^ ]]"

DESCRIBED = T.StructType([T.StructField("key", T.StringType()), T.StructField("in_form", T.BooleanType())])


def read_word(trie: Trie, word: str) -> tuple[str, int]:
    """(form, free steps) of a word by the automaton, and by table where it finds no spelling."""
    found = trie.canonical(word)
    if found is not None:
        return found
    form = by_table(word)
    return form, int(form != word or out_of_form(word))


def vocabulary_words(fields: DataFrame) -> DataFrame:
    """(token, n, key, in_form): every distinct word of (text) with its skeleton; ASCII words never reach Python."""
    odd = F.col("text").rlike(_ODD)
    plain_words = fields.where(~odd).select(F.explode(F.split("text", " +")).alias("token"))
    other_words = fields.where(odd).select(F.explode(F.split("text", _BLANKS)).alias("token"))
    words = plain_words.unionByName(other_words).where(F.col("token") != "")
    words = words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))

    @F.pandas_udf(DESCRIBED)
    def described(token: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"key": [skeleton(t) for t in token], "in_form": [not out_of_form(t) for t in token]}, columns=["key", "in_form"])

    odd = F.col("token").rlike(_ODD)
    plain = words.where(~odd).select("token", "n", F.lower("token").alias("key"), F.lit(True).alias("in_form"))
    other = words.where(odd).withColumn("_d", described("token")).select("token", "n", "_d.key", "_d.in_form")
    return plain.unionByName(other)


def canonical_words(words: DataFrame, buckets: int) -> DataFrame:
    """(token, form, steps) of every word of ``words`` (token, n, key, in_form) outside ASCII, by those in form."""

    def match(known: pa.Table, asked: pa.Table) -> pa.Table:
        tokens = asked["token"].to_pylist()
        read: list[tuple[str, int]] = []
        if tokens:
            trie = Trie()
            for word, n in zip(known["word"].to_pylist(), known["n"].to_pylist(), strict=True):
                trie.add(word, n)
            read = [read_word(trie, token) for token in tokens]
        forms, steps = zip(*read, strict=True) if read else ((), ())
        columns = [pa.array(tokens, pa.string()), pa.array(forms, pa.string()), pa.array(steps, pa.int32())]
        return pa.table(columns, names=["token", "form", "steps"])

    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")
    asked = words.where(F.col("token").rlike(_ODD))
    known = words.where("in_form").join(asked.select("key").distinct(), "key", "left_semi")
    left = known.select(F.col("token").alias("word"), "n", bucket).groupBy("bucket")
    right = asked.select("token", bucket).groupBy("bucket")
    return left.cogroup(right).applyInArrow(match, "token string, form string, steps int")


def consistent_fields(fields: DataFrame, garbled_model: LetterModel | None = None) -> DataFrame:
    """(track_id, field_name, text, form) of the fields of (track_id, field_name, text) that are out of form.

    Those are the fields with a word that the automaton read with a free step,
    or with a space other than U+0020. With a letter model, fields that were
    decoded wrongly are left out.
    """
    spark = fields.sparkSession
    words = cut_lineage(vocabulary_words(fields))
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    changed = canonical_words(words, buckets).where("steps > 0").select("token", "form")
    odd = fields.where(F.col("text").rlike(_ODD)).select("track_id", "field_name", "text")
    tokens = odd.select("*", F.posexplode(F.split("text", _BLANKS)).alias("pos", "token")).where(F.col("token").rlike(_ODD))
    hits = lookup(tokens, "token", cut_lineage(changed), "token", "form", "form").where(F.col("form").isNotNull()).drop("token")
    blanks = odd.where(F.col("text").rlike(_ODD_BLANK)).select("*", F.lit(-1).alias("pos"), F.lit("").alias("form"))
    place = F.struct("pos", "form")
    found = hits.unionByName(blanks).groupBy("track_id", "field_name", "text").agg(F.map_from_entries(F.collect_set(place)).alias("_forms"))
    spelled = F.transform(F.split("text", _BLANKS), lambda w, i: F.coalesce(F.try_element_at("_forms", i), w))
    found = found.select("track_id", "field_name", "text", F.trim(F.array_join(spelled, " ")).alias("form"))
    if garbled_model is None:
        return found
    return found.where(~restored(F.col("text"), garbled_model)["garbled"])


def model_of(tracks: DataFrame, columns: list[str]) -> LetterModel:
    """The letter model of several columns together."""
    texts = F.explode(F.array(*[F.col(c) for c in columns])).alias("text")
    return letter_pairs(tracks.select(texts).where(F.col("text").isNotNull()), "text")
