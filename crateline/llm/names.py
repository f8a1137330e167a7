"""Linking the variant spellings of a name to the registered name they mean.

Both the registered names and the names as typed are rewritten in every
canonical way: words in one order, without middle initials, with nicknames,
ensemble and legal-form abbreviations taken for what they stand for, run
together, with the given name cut to its initial, with one letter of a word left
out, and with only the head or tail of a word. The rewritings are exploded and
joined on equality. A rewriting that few registered names have says more than a
common one: its rarity in bits, less what the reading of the other words costs,
is the score of a pair, and a typed name is linked to the one registered name
with the highest score. If two score the same the typed name is ambiguous and
not linked. Pairs whose words cannot be aligned at all are no candidates.

A rewriting that more than ``COMMON`` registered names share proposes a pair
only together with a key of another word (the word or what it is short for, its
first or last letter, the word without up to two letters at either end). Words
that can be aligned have such a key in common, so this changes how many pairs
are tried, but no result, whatever ``COMMON`` is.

Defined results: NULL and blank names and names that are letter for letter
registered are not linked; each distinct name is rewritten once, however often
it occurs, and looked up by balanced joins; names are rewritten and aligned
with all their words.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crateline.operators.partitions import parallel
from crateline.session import cut_lineage

#: Words that join the parts of a name and say nothing by themselves.
JOINING = frozenset({"the", "and", "with", "x", "vs", "versus", "und", "feat", "ft"})

#: Usual abbreviations of ensembles; others are found by rule. Legal forms are dropped.
ABBREVIATIONS = {
    "str": ("string",), "qt": ("quartet",), "qrt": ("quartet",), "quart": ("quartet",), "qnt": ("quintet",), "orch": ("orchestra",), "phil": ("philharmonic",),
    "voc": ("vocal",), "ens": ("ensemble",), "ch": ("choir", "chamber"), "cham": ("chamber",), "br": ("brass",), "coll": ("collective",), "snd": ("sound",),
    "sys": ("system",), "sym": ("symphony",), "bros": ("brothers",), "grp": ("group",),
}

#: Words that say what a group is, not which.
ENSEMBLES = frozenset(
    """band brass brothers chamber choir chorale chorus collective combo consort crew daughters duo ensemble group jazz octet orchestra philharmonic quartet quintet
    sextet singers sisters sons sound string strings symphony system trio vocal wind youth""".split()
)
LEGAL_FORMS = frozenset({"inc", "ltd", "llc", "gmbh", "co", "corp", "sa", "ag", "plc", "bv"})

#: Short forms of given names that are not simply their beginning.
NICKNAMES = {
    "joey": "joseph", "joe": "joseph", "jo": "joseph", "mike": "michael", "mick": "michael", "mickey": "michael", "jenny": "jennifer",
    "jen": "jennifer", "ella": "gabriella", "gabby": "gabriella", "gabi": "gabriella", "gaby": "gabriella", "bob": "robert", "bobby": "robert",
    "rob": "robert", "robbie": "robert", "bert": "robert", "bill": "william", "billy": "william", "will": "william", "willy": "william", "liam": "william",
    "dick": "richard", "rick": "richard", "richie": "richard", "ricky": "richard", "rich": "richard", "jim": "james", "jimmy": "james", "jamie": "james",
    "liz": "elizabeth", "lizzie": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "betsy": "elizabeth", "libby": "elizabeth",
    "kathy": "katherine", "kate": "katherine", "katie": "katherine", "kat": "katherine", "kitty": "katherine", "kit": "christopher katherine",
    "chuck": "charles", "charlie": "charles", "chas": "charles", "ted": "theodore edward", "teddy": "theodore edward", "theo": "theodore", "ned": "edward",
    "ed": "edward", "eddie": "edward", "eddy": "edward", "tony": "anthony", "ant": "anthony", "sue": "susan", "susie": "susan", "suzie": "susan", "suzy": "susan",
    "fred": "frederick", "freddy": "frederick", "freddie": "frederick", "fritz": "frederick", "sam": "samuel", "sammy": "samuel", "matt": "matthew", "matty": "matthew",
    "patty": "patricia", "pat": "patricia", "tricia": "patricia", "trish": "patricia", "patti": "patricia", "peggy": "margaret", "meg": "margaret",
    "maggie": "margaret", "marge": "margaret", "margie": "margaret", "rita": "margaret", "greta": "margaret", "daisy": "margaret", "chris": "christopher",
    "topher": "christopher", "nick": "nicholas", "nicky": "nicholas", "nico": "nicholas", "klaus": "nicholas", "deb": "deborah", "debbie": "deborah", "debby": "deborah",
    "ben": "benjamin", "benny": "benjamin", "benji": "benjamin", "tom": "thomas", "tommy": "thomas", "dan": "daniel", "danny": "daniel", "alex": "alexander",
    "sasha": "alexander", "sandy": "alexander", "xander": "alexander", "lex": "alexander", "vicky": "victoria", "vic": "victoria", "vickie": "victoria", "tori": "victoria",
    "becky": "rebecca", "becca": "rebecca", "bec": "rebecca", "fran": "francesca", "franny": "francesca", "cesca": "francesca", "frankie": "francesca", "nat": "nathaniel",
    "larry": "lawrence", "hank": "henry", "harry": "henry", "jack": "john", "johnny": "john", "steve": "stephen", "andy": "andrew", "drew": "andrew", "greg": "gregory",
    "ron": "ronald", "don": "donald", "ken": "kenneth", "tim": "timothy", "jeff": "jeffrey", "phil": "philip", "dave": "david", "pete": "peter", "ray": "raymond",
    "kris": "christopher", "lenny": "leonard", "ollie": "oliver", "val": "valerie", "cathy": "katherine", "nan": "nancy", "sally": "sarah", "molly": "mary", "polly": "mary",
    "cindy": "cynthia", "barb": "barbara", "sandra": "alexandra", "ozzie": "oscar", 
}

_LETTERS = str.maketrans({"ø": "o", "ł": "l", "æ": "ae", "œ": "oe", "ß": "ss", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})

#: The most edits a linked pair may have; bits that a whole edit costs; registered names that share a rewriting before other words are asked too.
MAX_EDITS, COST_BITS, COMMON = 2, 8.0, 12

_VOWELS = frozenset("aeiouy")


def _families() -> dict[str, str]:
    """Each short form and what it may stand for, under one word for all that are linked through them."""
    head: dict[str, str] = {}

    def top(w: str) -> str:
        while head.get(w, w) != w:
            w = head[w]
        return w

    for short, meant in [*ABBREVIATIONS.items(), *((k, v.split()) for k, v in NICKNAMES.items())]:
        for word in meant:
            x, y = sorted((top(short), top(word)))
            head[y] = head[x] = x
    return {w: top(w) for w in head}


FAMILY = _families()


@lru_cache(maxsize=200_000)
def words_of(name: str) -> tuple[str, ...]:
    """The words of a name in plain small letters, without joining words, legal forms and signs."""
    text = unicodedata.normalize("NFKC", name)
    text = "".join(" " + c if i and c.isupper() and text[i - 1].islower() else c for i, c in enumerate(text))
    text = unicodedata.normalize("NFD", text.casefold().translate(_LETTERS))
    text = "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Cf"))
    words = re.findall(r"[^\W_]+(?:\.(?=\s))?", text.replace("'", "").replace("’", ""))
    kept = [w.rstrip(".") for w in words if w not in JOINING and w.rstrip(".") not in LEGAL_FORMS]
    return tuple(kept or [w.rstrip(".") for w in words])


@lru_cache(maxsize=100_000)
def _without_one(word: str) -> tuple[str, ...]:
    return tuple({word} | {word[:i] + word[i + 1 :] for i in range(len(word))})


def _written_out(word: str) -> list[str]:
    """A word and what it may be short for."""
    return [word, *ABBREVIATIONS.get(word, ()), *NICKNAMES.get(word, "").split()]


def _pieces(words: tuple[str, ...], typed: bool) -> list[tuple[str, int]]:
    """(rewriting, place of the word it cuts): the families of all other words with only the head or tail of one."""
    long = [(i, w) for i, w in enumerate(words) if len(w) > 1]
    out = []
    for i, w in long:
        rest = " ".join(sorted(FAMILY.get(x, x) for j, x in long if j != i))
        for stem in _written_out(w) if typed else [w]:
            if len(stem) >= 4:
                out += [(f"g:{rest}|{stem[:3]}", i), (f"g:{rest}|{stem[-3:]}", i)]
    return out


def rewritings(name: str, typed: bool) -> list[str]:
    """Every canonical rewriting of a name. Of typed names each word may be the one that is abbreviated or misspelt."""
    words = words_of(name)
    if not words:
        return []
    long = [w for w in words if len(w) > 1]
    forms = {"c:" + "".join(words), "c:" + "".join(long), "c:" + "".join(sorted(long))}
    if len(long) > 1:
        forms |= {"c:" + "".join([*long[1:], long[0]]), "c:" + "".join([long[-1], *long[:-1]])}
    forms.add("w:" + " ".join(sorted(FAMILY.get(w, w) for w in long)))
    forms |= {form for form, _ in _pieces(words, typed)}
    for i, stem in enumerate(words):
        if len(stem) >= 4:
            initials = {w[0] for j, w in enumerate(words) if j != i}
            if not typed and len(long) != 2:
                initials = set()
            forms |= {f"i:{x}|{stem}" for x in initials}
            forms |= {"d:" + x for x in _without_one(stem)}
    return sorted(forms)


@lru_cache(maxsize=100_000)
def _word_keys(word: str, typed: bool) -> frozenset[str]:
    """Keys of which a typed word shares one with every registered word it may be aligned with."""
    keys = {"x:" + w for w in (_written_out(word) if typed else [word])} | {"a:" + word[0]}
    if len(word) >= 3:
        keys.add("z:" + word[-1])
    if len(word) >= (3 if typed else 5):
        # edits that leave neither the first nor the last letter are one at each end, and what is between stays
        keys |= {"m:" + word[i : len(word) - j] for i in range(3) for j in range(3) if i + j + 2 <= len(word)}
        if len(word) == 5:
            keys.add("q:" + word[2])
    return frozenset(keys)


def known_keys(name: str) -> list[str]:
    """The keys of all words of a registered name; '-' if it is one word but for initials."""
    words = words_of(name)
    keys = {k for w in words for k in _word_keys(w, False)}
    return sorted(keys | {"-"} if sum(len(w) > 1 for w in words) < 2 else keys)


def typed_keys(name: str, anchor: str) -> list[str]:
    """The keys of one more word of a typed name beside the one that an anchor is about.

    An anchor is a rewriting, or ``k:`` and the registered word that one of the
    words may be. Every typed word but initials must be aligned, so one more is
    enough: the longest that is neither a kind of ensemble nor a name with short
    forms. Without another word there are the initials and '-'.
    """
    words, kind, stem = words_of(name), anchor[:2], anchor[2:].split("|")[-1]
    keys: set[str] = set()
    if kind == "g:":
        for i in {i for f, i in _pieces(words, True) if f == anchor}:
            keys |= _word_keys(words[i], True)
        return sorted(keys)
    about = set(_without_one(stem)) if kind == "k:" else set()
    for i, w in enumerate(words):
        if w == stem if kind == "i:" else len(w) >= 4 and not about.isdisjoint(_without_one(w)):
            others = [x for j, x in enumerate(words) if j != i]
            if any(len(x) > 1 for x in others):
                keys |= _word_keys(max(others, key=lambda x: (x not in ENSEMBLES and x not in FAMILY, len(x), x)), True)
            else:
                keys |= {"-", *(k for x in others for k in _word_keys(x, True))}
    return sorted(keys)


@lru_cache(maxsize=500_000)
def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between two words; ``most + 1`` if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before2: list[int] = []
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before2[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before2, before = before, row
    return min(before[-1], most + 1)


def _abbreviates(typed: str, known: str) -> bool:
    """Whether a word is another one without its vowels and perhaps some consonants ("orch" is found as its beginning)."""
    if not 2 <= len(typed) <= len(known) - 2 or typed[0] != known[0] or not _VOWELS.isdisjoint(typed[1:]):
        return False
    rest = iter(known)
    return all(c in rest for c in typed)


def _endears(typed: str, known: str) -> bool:
    """Whether a word is the beginning of a name with an ending of endearment ("Ingie")."""
    for ending in ("ie", "ey", "y", "i"):
        if typed.endswith(ending):
            base = typed.removesuffix(ending)
            if len(base) > 2 and base[-1] == base[-2]:
                base = base[:-1]
            return len(base) >= 2 and known.startswith(base) and known != typed
    return False


@lru_cache(maxsize=500_000)
def _word_cost(typed: str, known: str, is_stem: bool) -> float:
    """What it costs to read a typed word as a known one; above ten if it cannot be."""
    if typed == known:
        return 0.0
    if known in _written_out(typed)[1:]:
        return 0.1
    if not is_stem and (len(typed) == 1 and known[0] == typed or 2 <= len(typed) < len(known) and known.startswith(typed)):
        return 0.5
    if not is_stem and (_abbreviates(typed, known) or _endears(typed, known)):
        return 0.5
    most = 0 if min(len(typed), len(known)) < 3 else 1 if len(known) < 5 else MAX_EDITS
    n = edits(typed, known, most)
    return float(n) if n <= most else 99.0


def alignment(typed: str, known: str) -> float | None:
    """The least cost of reading a typed name as a known one; None if it cannot be read so."""
    v, a = words_of(typed), words_of(known)
    if not v or not a or sum(len(w) > 1 for w in v) > len(a):
        return None
    joined = "".join(v)
    if len(v) != len(a) and joined in ("".join(a), "".join(w for w in a if len(w) > 1)):
        return 0.2
    long = [i for i, w in enumerate(a) if len(w) > 1] or list(range(len(a)))
    own = [i for i in long if a[i] not in ENSEMBLES] or long
    stem = own[-1] if len(long) == 2 else max(own, key=lambda i: len(a[i]))
    costs = []
    for i in sorted(range(len(a)), key=lambda i: -len(a[i])):  # long words rule out most pairs at once
        row = [_word_cost(x, a[i], i == stem) for x in v]
        if len(a[i]) > 1 and min(row) >= 10:
            return None
        costs.append((i, row))
    costs = [row for _, row in sorted(costs)]
    if any(len(x) > 1 and all(row[j] >= 10 for row in costs) for j, x in enumerate(v)):
        return None
    best = 99.0
    # least cost by (next registered word, typed words left), so no state is walked twice unless it got cheaper
    paid: dict[tuple, float] = {}
    todo: list[tuple[int, tuple[int, ...], float, float, bool]] = [(0, tuple(range(len(v))), 0.0, 0.0, False)]
    while todo:
        i, left, cost, typos, skipped = todo.pop()
        if cost >= best or typos > MAX_EDITS:
            continue
        if i == len(a):
            if all(len(v[j]) == 1 for j in left) and not (left and skipped):  # two middle initials that differ
                best = min(best, cost + 0.3 * len(left))
            continue
        state = (i, tuple(sorted(v[j] for j in left)), typos, skipped)
        if paid.get(state, 99.0) <= cost:
            continue
        paid[state] = cost
        if len(a[i]) == 1:
            todo.append((i + 1, left, cost + 0.3, typos, True))
        words: set[str] = set()
        for j in sorted(left, key=lambda j: -costs[i][j]):
            step = costs[i][j]
            if step < 10 and v[j] not in words:
                words.add(v[j])
                todo.append((i + 1, tuple(k for k in left if k != j), cost + step, typos + (step if step >= 1 else 0), skipped))
    return best if best < 99 else None


def _exploded(names: DataFrame, column: str, typed: bool) -> DataFrame:
    forms = F.pandas_udf(lambda s: s.map(lambda x: rewritings(x, typed)), T.ArrayType(T.StringType()))
    return names.withColumn("_form", F.explode(forms(column)))


def linked_names(typed: DataFrame, registry: DataFrame, common: int = COMMON) -> DataFrame:
    """(name, artist_id, known, cost, rarity): distinct typed names (name) linked to registered ones (artist_id, name)."""
    strings = T.ArrayType(T.StringType())
    keys_of_known = F.pandas_udf(lambda s: s.map(known_keys), strings)
    words_of_known = F.pandas_udf(lambda s: s.map(lambda x: sorted({w for w in words_of(x) if len(w) >= 4})), strings)
    shortened = F.pandas_udf(lambda s: s.map(lambda x: sorted({"d:" + y for y in _without_one(x)})), strings)

    @F.pandas_udf(strings)
    def keys_of_typed(name: pd.Series, anchor: pd.Series) -> pd.Series:
        return pd.Series([typed_keys(n, f) for n, f in zip(name, anchor, strict=True)], dtype=object)

    registry = registry.select("artist_id", F.col("name").alias("known")).where(F.trim("known") != "").distinct()
    total = registry.count()
    forms = cut_lineage(_exploded(registry, "known", False))
    shared = forms.groupBy("_form").agg(F.countDistinct("artist_id").alias("n"))
    asked = typed.select("name").distinct().where(F.trim("name") != "").join(registry, F.col("name") == F.col("known"), "left_anti").select("name")
    # only rewritings that some registered name has are kept, with the number of names that have them
    seen = cut_lineage(_exploded(parallel(asked, "name"), "name", True).join(shared, "_form"))
    # names that agree in all words or letters cannot be told apart by another word
    alone = (F.col("n") <= common) | F.col("_form").startswith("c:") | F.col("_form").startswith("w:")
    rare = seen.where(alone).join(forms, "_form")
    often = seen.where(~alone)
    # words that may be the same with a letter less are brought together as words first, so a pair is tried once, not once a letter
    held = registry.select("artist_id", "known", F.explode(words_of_known("known")).alias("_word"))
    words = held.select("_word").distinct().select(F.concat(F.lit("k:"), "_word").alias("_anchor"), F.explode(shortened("_word")).alias("_form"))
    shorter = F.col("_form").startswith("d:")
    anchored = often.where(shorter).join(words, "_form").groupBy("name", "_anchor").agg(F.min("n").alias("n"))
    anchored = anchored.unionByName(often.where(~shorter).select("name", F.col("_form").alias("_anchor"), "n"))
    asking = parallel(anchored, "name").withColumn("_second", F.explode(keys_of_typed("name", "_anchor")))
    anchors = held.select("artist_id", "known", F.concat(F.lit("k:"), "_word").alias("_anchor"))
    anchors = anchors.unionByName(forms.where(~shorter).join(shared.where(F.col("n") > common), "_form", "left_semi").select("artist_id", "known", F.col("_form").alias("_anchor")))
    keys = registry.select("known").distinct().withColumn("_second", F.explode(keys_of_known("known")))
    frequent = asking.join(anchors.join(keys, "known"), ["_anchor", "_second"])
    pairs = rare.select("name", "artist_id", "known", "n").unionByName(frequent.select("name", "artist_id", "known", "n"))
    pairs = pairs.groupBy("name", "artist_id", "known").agg(F.round(F.lit(math.log2(total + 1)) - F.log2(F.min("n")), 6).alias("rarity"))

    @F.pandas_udf("double")
    def cost(name: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([alignment(a, b) for a, b in zip(name, known, strict=True)], dtype="float64")

    read = parallel(pairs, "name").withColumn("cost", cost("name", "known")).where(F.col("cost").isNotNull() & ~F.isnan("cost"))
    read = read.withColumn("score", F.round(F.col("rarity") - F.lit(COST_BITS) * F.col("cost"), 6))
    # the two best tell whether the first stands alone; nothing but them is kept
    best = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "artist_id", "known"))
    best_two = read.withColumn("_at", best).where(F.col("_at") <= 2)
    first = F.max_by(F.struct("artist_id", "known", "cost", "rarity", "score"), -F.col("_at"))
    ranked = best_two.groupBy("name").agg(first.alias("r"), F.count(F.lit(1)).alias("_n"), F.min("score").alias("_next"))
    clear = (F.col("_n") == 1) | (F.col("_next") < F.col("r.score"))
    return ranked.where(clear).select("name", "r.artist_id", "r.known", "r.cost", "r.rarity")
