"""Keyword-stuffed and link-list pages.

Texts become sequences of function words and word classes: function words stand
for themselves, other words for their shape and for how many words ago the last
function word was. A trigram model with Witten-Bell smoothing is counted over
the prose of all documents, that is over their lines that read like sentences,
profiles or numbered lists; a second one over coarse classes, in which all
function words are one. Documents fall into two halves by a hash of their text
and each half is scored by the models of the other, so no text teaches the model
that judges it. What is abnormal is not set by hand but by quantiles of the
perplexity of the held-out prose: a window is abnormally high where it is above
``HIGH_SHARE`` of held-out prose and does not read as prose of another style
either, that is its coarse perplexity is above ``COARSE_SHARE`` of held-out prose,
fewer than ``LEAST_FUNCTION`` of its words are function words, or its content words
return so often that the cache model below needs less than ``STYLE_BITS``. That is where
words run on without the grammar of prose (keywords, tags, names, links). The
content words of a window are also scored by a cache model of the document
itself, whose pairs and words of the last ``REPEAT_REACH`` places are cheap, over
the ends of lines; their perplexity is abnormally low where a phrase keeps
returning, however fluent the rest. Lines of verse that return whole or but for a
few words are refrains, which the cache does not count. A page is flagged if most
of its words stand in abnormal windows.

Tokenising is the only per-token work in Python; it is done once, the class
numbers are written to the checkpoint folder, counting and scoring run on whole
arrays, and only a few figures per window are written for the decision. A model
has at most ``MAX_NGRAMS`` trigrams, the most frequent; the coarse one never has as
many.

Defined results: NULL, empty and blank texts and texts of fewer than
``MIN_WORDS`` words are never flagged; texts are taken whole; without any
held-out prose nothing is abnormally high.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateline.operators.partitions import spread
from crateline.session import cut_lineage

#: Function words of the four languages of the documents.
ENGLISH = """the a an and or of to in on at for with is was are it its this that as but not no by from be has had have they she he his
her their you we i so if than then when once where which who until till into over after before under out up down off all any some more most
never very just only own same other there here what how why because while about against between through during without within again would
could should can may might will do does did been being my our your me us them him""".split()
GERMAN = """der die das den dem des ein eine einer eines einem einen und oder aber nicht kein keine ist war sind es er sie wir ihr ich du
mich mir sich von zu zum zur im in am an auf aus bei mit nach für über unter vor durch gegen ohne um als wie wenn weil dass so doch nur noch
auch schon sehr mehr wird wurde werden hat haben hatte kann könnte was wer wo da dann bis seit jede jeder ihre ihren seine seiner sein""".split()
FRENCH = """le la les un une des du de et ou mais ne pas que qui quoi dont où est était sont été il elle ils elles nous vous je tu on se sa
son ses leur leurs ce cette ces cet à au aux en dans sur sous par pour avec sans plus moins très si comme quand tout toute tous toutes y a ont
avait l d j n s c qu m""".split()
SPANISH = """el la los las un una unos unas y o pero no ni que quien cuyo es era son fue ha han había se su sus lo le les me te nos yo tú él
ella en de del al a por para con sin sobre entre hasta desde como cuando donde muy más menos ya también así casi todo toda todos todas si este
esta esto ese esa eso""".split()
FUNCTION_WORDS = frozenset(ENGLISH + GERMAN + FRENCH + SPANISH)

_SIGNS = ".,;:!?-–—()[]|/<>=\"'«»“”…#*&+•·"
_SHAPES = "wWAMOU#N"
_GAPS = 7

_TOKEN = re.compile(
    r"""(?P<u>(?:https?://|www\.)[^\s"'<>()\[\]|]+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{3,8}(?:/[^\s"'<>()\[\]|]*|\b(?=\s*(?:["'\])|]|$))))
    |(?P<h>\#[\w-]+)|(?P<t>\d+:\d\d)|(?P<n>\d+(?:[.,]\d+)*)|(?P<o>\b(?:\w\.){2,}\w?)
    |(?P<w>[^\W\d_]+(?:[-'’][^\W\d_]+)*|\w+)|(?P<p>[^\w\s])""",
    re.X,
)
_KEYED = re.compile(r"(?:^|[.;] )[^\W\d_][\w ]{1,20}: ")
_NUMBERED = re.compile(r"^\s*\d{1,3}[.)]\s")

#: Class numbers: end of a line outside and inside the training text, then the rest by rule.
END, END_PROSE = 0, 1
CLASSES: dict[str, int] = {"$": END, "$prose": END_PROSE, "^": 2, "T": 3, "P": 4}
for _name in (
    *_SIGNS,
    *(f"{s}{g}" for s in _SHAPES for g in range(_GAPS)),
    *(f"f:{w}" for w in sorted(FUNCTION_WORDS)),
    *(f"e:{w}{k}" for w in sorted(FUNCTION_WORDS) for k in "fw"),
):
    CLASSES.setdefault(_name, len(CLASSES))
N_CLASSES = len(CLASSES)

#: Parameters of the decision.
WINDOW, MIN_WORDS, MAX_BITS, HIGH_SHARE, COARSE_SHARE, LEAST_FUNCTION = 20, 8, 10.0, 0.995, 0.95, 0.25
LOW_BITS, STYLE_BITS, LEAST_CONTENT, REPEAT_REACH, FLAG_SHARE = 4.0, 7.0, 5, 30, 0.5
#: Bits of a word in the cache model by mark: no content word, new, seen, seen behind the same word.
CACHE_BITS = np.array([0.0, 10.0, 5.0, 1.0])
MAX_NGRAMS, UNSEEN = 2_000_000, 1 / 600

_WORDLIKE = np.zeros(N_CLASSES, dtype=bool)
for _name, _number in CLASSES.items():
    _WORDLIKE[_number] = len(_name) > 1 and (_name[0] in _SHAPES and _name[1:].isdigit() or _name[:2] in ("f:", "e:"))


_FUNCTION = np.zeros(N_CLASSES, dtype=bool)
for _name, _number in CLASSES.items():
    _FUNCTION[_number] = _name[:2] in ("f:", "e:")


def _coarse_name(name: str) -> str:
    if name in ("$", "$prose", "^"):
        return name
    if name[:2] in ("f:", "e:"):
        return "F"
    if name[0] in _SHAPES and name[1:].isdigit():
        return ("w" if name[0] in "wWM" else name[0]) + name[1:]
    return "." if name in ".!?…" else "," if name in ",;:" else "P"


#: The coarse class of each class, numbered by its first member.
COARSE = np.zeros(N_CLASSES, dtype=np.int64)
_first: dict[str, int] = {}
for _name, _number in CLASSES.items():
    COARSE[_number] = _first.setdefault(_coarse_name(_name), _number)


def coarse_keys(keys: np.ndarray) -> np.ndarray:
    """The trigrams in coarse classes."""
    two = N_CLASSES * N_CLASSES
    return (COARSE[keys // two] * N_CLASSES + COARSE[keys // N_CLASSES % N_CLASSES]) * N_CLASSES + COARSE[keys % N_CLASSES]


def _gap_bucket(gap: int) -> int:
    return (0, 1, 2, 3, 4, 4, 5, 5, 5)[gap] if gap < 9 else 6


def _line(text: str, start_gap: int) -> tuple[list[int], list[tuple[int, str]], list[str], int, Counter]:
    """(classes, content words and their places, words, gap at the end, kinds) of a line."""
    classes, content, words, kinds = [], [], [], Counter()
    gap = start_gap
    for m in _TOKEN.finditer(text):
        kind, s = m.lastgroup, m.group()
        if kind == "p":
            classes.append(CLASSES.get(s, CLASSES["P"]) if s in _SIGNS else CLASSES["P"])
            continue
        if kind == "t":
            classes.append(CLASSES["T"])
            continue
        word = s.lower()
        if kind == "w" and word in FUNCTION_WORDS:
            classes.append(CLASSES["f:" + word])
            words.append(word)
            gap = 0
            continue
        if kind == "w" and ("'" in word or "’" in word):
            parts = re.split("['’]", word)
            if parts[0] in FUNCTION_WORDS:
                name = f"e:{parts[0]}{'f' if parts[-1] in FUNCTION_WORDS else 'w'}"
                classes.append(CLASSES[name])
                words.append(word)
                gap = 0
                continue
        if kind == "w":
            if s.islower():
                shape = "w"
            elif s.isupper() and len(s) > 1:
                shape = "A"
            elif s[:1].isupper():
                shape = "W"
            else:
                shape = "M" if s.upper() != word else "w"
        else:
            shape = {"o": "O", "u": "U", "h": "#", "n": "N"}[kind]
            kinds[shape] += 1
            word = word.replace(".", "") if shape == "O" else "" if shape in "UN" else word
        if shape not in "UN":
            content.append((len(classes), word))
        words.append(word)
        classes.append(CLASSES[f"{shape}{_gap_bucket(gap)}"])
        gap += 1
    return classes, content, words, gap, kinds


def _refrain(a: list[str], b: list[str]) -> bool:
    """Whether two lines have as many content words and at least half of them in the same places."""
    return len(a) == len(b) and 2 * sum(x == y for x, y in zip(a, b, strict=True)) >= len(a)


class _Cache:
    """The content words and pairs of a document with the places and lines they last stood in."""

    def __init__(self) -> None:
        self.last: dict = {}
        self.lines: list[list[str]] = []

    def marks(self, start: int, content: list[tuple[int, str]], verse: bool) -> list[int]:
        """The mark of each content word of the next line, which starts at a place of the document: 1 new, 2 seen, 3 seen behind the same word."""
        own, number, out, before = [w for _, w in content], len(self.lines), [], ""
        self.lines.append(own)
        refrains: dict[int, bool] = {}

        def seen(key: object, at: int) -> bool:
            place, line = self.last.get(key, (-1000, number))
            if at - place > REPEAT_REACH:
                return False
            if line != number and verse and line not in refrains:
                refrains[line] = _refrain(own, self.lines[line])
            return not refrains.get(line, False)

        for at, word in content:
            out.append(3 if seen((before, word), start + at) else 2 if seen(word, start + at) else 1)
            self.last[word] = self.last[before, word] = (start + at, number)
            before = word
        return out


def _is_prose(text: str, words: list[str], kinds: Counter, numbered: bool) -> bool:
    """Whether a line may teach the model: a sentence, a profile or an item of a numbered list."""
    n = len(words)
    if n < 3 or kinds["O"] or (kinds["U"] + kinds["#"]) * 10 > n:
        return False
    if len(_KEYED.findall(text)) >= 4 or (numbered and _NUMBERED.match(text)):
        return True
    grammar = sum(w in FUNCTION_WORDS or "'" in w or "’" in w for w in words)
    if grammar < 0.2 * n:
        return False
    pairs = Counter((a, b) for a, b in zip(words, words[1:], strict=False) if a not in FUNCTION_WORDS or b not in FUNCTION_WORDS)
    most = max(pairs.values(), default=0)
    if most >= 3 and most * 2 >= 0.1 * n:
        return False
    first = re.search(r"\w", text)
    return bool(first) and (first.group().isupper() or n >= 10)


def tokenise(text: str | None, may_teach: bool = True) -> tuple[list[int], list[int]]:
    """(classes, repetition marks) of a whole text; each line ends with END or END_PROSE."""
    classes: list[int] = []
    marks: list[int] = []
    gap, cache = 0, _Cache()
    lines = [x for x in re.split(r"[\n\r\x85\u2028\u2029]+", text or "") if x.strip()]
    numbered = sum(bool(_NUMBERED.match(x)) for x in lines) >= 3
    for line in lines:
        c, content, words, gap, kinds = _line(line, gap)
        found = cache.marks(len(classes), content, len(words) > len(content))
        stuffed = len(found) >= 3 and CACHE_BITS[found].mean() < LOW_BITS
        prose = may_teach and not stuffed and _is_prose(line, words, kinds, numbered)
        k = [0] * len(c)
        for (at, _), mark in zip(content, found, strict=True):
            k[at] = mark
        classes += [*c, END_PROSE if prose else END]
        marks += [*k, 0]
    content_marks = [k for k in marks if k]
    if len(content_marks) >= LEAST_CONTENT and CACHE_BITS[content_marks].mean() < LOW_BITS:
        classes = [END if c == END_PROSE else c for c in classes]
    return classes, marks


def _trigrams(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of the trigram ending at each place, number of the line of each place); contexts start anew at lines."""
    ends = classes <= END_PROSE
    line = np.concatenate([[0], np.cumsum(ends)[:-1]]) if len(classes) else np.zeros(0, dtype=np.int64)
    own = np.where(ends, END, classes).astype(np.int64)
    start = CLASSES["^"]
    one, two = np.full(len(own), start), np.full(len(own), start)
    one[1:] = np.where(line[1:] == line[:-1], own[:-1], start)
    two[2:] = np.where(line[2:] == line[:-2], own[:-2], start)
    return (two * N_CLASSES + one) * N_CLASSES + own, line


@dataclass
class ProseModel:
    """Witten-Bell trigram model over word classes, as sorted arrays."""

    keys: np.ndarray
    counts: np.ndarray

    def __post_init__(self) -> None:
        order = np.argsort(self.keys)
        self.keys, self.counts = self.keys[order], self.counts[order].astype(float)
        self._levels = []
        for depth in (1, 2, 3):
            grams, at = np.unique(self.keys % N_CLASSES**depth, return_inverse=True)
            n = np.bincount(at, weights=self.counts, minlength=len(grams)) if len(grams) else np.zeros(0)
            contexts, of = np.unique(grams // N_CLASSES, return_inverse=True)
            total = np.bincount(of, weights=n, minlength=len(contexts)) if len(grams) else np.zeros(0)
            kinds = np.bincount(of, minlength=len(contexts)).astype(float) if len(grams) else np.zeros(0)
            self._levels.append((grams, n, contexts, total, kinds))

    @staticmethod
    def _find(table: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        return np.where(table[at] == wanted, values[at], 0.0)

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Bits of the last class of each trigram behind its first two, at most ``MAX_BITS``."""
        p = np.full(len(keys), UNSEEN)
        for depth, (grams, n, contexts, total, kinds) in enumerate(self._levels, 1):
            gram = keys % N_CLASSES**depth
            context = gram // N_CLASSES
            seen, varied = self._find(contexts, total, context), self._find(contexts, kinds, context)
            better = (self._find(grams, n, gram) + varied * p) / np.maximum(seen + varied, 1.0)
            p = np.where(seen > 0, better, p)
        return np.minimum(-np.log2(p), MAX_BITS)


def windows(classes: np.ndarray, marks: np.ndarray, bits: np.ndarray, coarse: np.ndarray) -> tuple[int, float, dict[str, np.ndarray]]:
    """(words, mean bits, figures of each window) of one document.

    Figures: words that are this window's own, mean bits, mean coarse bits, mean
    cache bits of its content words, share of function words, all prose or not.
    """
    kept = classes > END_PROSE
    ends = np.flatnonzero(~kept)
    in_prose = np.zeros(len(classes) + 1)
    if len(ends):  # each place has the kind of the next end of line
        in_prose[: ends[-1] + 1] = (classes[ends] == END_PROSE)[np.searchsorted(ends, np.arange(ends[-1] + 1))]
    in_prose = in_prose[:-1][kept]
    classes, marks, bits, coarse = classes[kept], marks[kept], bits[kept], coarse[kept]
    n = len(classes)
    weight = _WORDLIKE[classes]
    starts = np.arange(0, n, WINDOW)
    a = np.maximum(0, np.minimum(starts, n - WINDOW))
    b = np.minimum(a + WINDOW, n)
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    inside = lambda x: total(x)[b] - total(x)[a]
    content, size = inside(marks > 0), np.maximum(b - a, 1)
    figures = {
        "own": total(weight)[np.minimum(starts + WINDOW, n)] - total(weight)[starts],
        "high": inside(bits) / size,
        "coarse": inside(coarse) / size,
        "cached": np.where(content >= LEAST_CONTENT, inside(CACHE_BITS[marks]) / np.maximum(content, 1), MAX_BITS),
        "grammar": inside(_FUNCTION[classes]) / np.maximum(inside(weight), 1),
        "prose": inside(in_prose) == b - a,
    }
    return int(weight.sum()), float(bits.mean()) if n else 0.0, figures


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets


def classified(documents: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(doc_id, classes, marks, half) of every document; documents labelled spam do not teach the model."""
    # copies of a text are in one half
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"))
    if labels is not None:
        spam = labels.where(F.lower(F.trim("label")) == "spam").select(F.col("doc_id").alias("_spam")).distinct()
        docs = docs.join(spam, F.col("doc_id") == F.col("_spam"), "left").select("doc_id", "text", F.col("_spam").isNull().alias("teach"), "half")
    else:
        docs = docs.select("doc_id", "text", F.lit(True).alias("teach"), "half")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                pairs = [tokenise(t, ok) for t, ok in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([c for c, _ in pairs], pa.list_(pa.int16())),
                        pa.array([m for _, m in pairs], pa.list_(pa.int8())),
                        part.column(3),
                    ],
                    ["doc_id", "classes", "marks", "half"],
                )

    return spread(docs, "doc_id").mapInArrow(run, "doc_id bigint, classes array<smallint>, marks array<tinyint>, half int")


def train(tokens: DataFrame, max_ngrams: int = MAX_NGRAMS) -> list[tuple[ProseModel, ProseModel]]:
    """For each half of the documents the models, fine and coarse, of the prose lines of the other half."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}
        for batch in batches:
            values, offsets = _lists(batch.column(0))
            half = np.repeat(batch.column(1).to_numpy(), np.diff(offsets))
            values = values[offsets[0] : offsets[-1]]
            if not len(values):
                continue
            keys, line = _trigrams(values)
            prose = np.zeros(line[-1] + 2, dtype=bool)
            prose[line[values == END_PROSE]] = True
            for side in (0, 1):
                found, n = np.unique(keys[prose[line] & (half == side)], return_counts=True)
                for k, x in zip(found.tolist(), n.tolist(), strict=True):
                    sums[side, k] = sums.get((side, k), 0) + x
        columns = [[h for h, _ in sums], [k for _, k in sums], list(sums.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["half", "key", "n"])

    grams = tokens.select("classes", "half").mapInArrow(count, "half int, key bigint, n bigint").groupBy("half", "key").agg(F.sum("n").alias("n"))
    rows = grams.orderBy(F.desc("n"), "half", "key").limit(max_ngrams).collect()
    models = []
    for side in (0, 1):
        keys = np.array([r[1] for r in rows if r[0] != side], dtype=np.int64)
        counts = np.array([r[2] for r in rows if r[0] != side], dtype=np.int64)
        coarse, at = np.unique(coarse_keys(keys), return_inverse=True)
        models.append((ProseModel(keys, counts), ProseModel(coarse, np.bincount(at, weights=counts, minlength=len(coarse)))))
    return models


_FIGURES = {"own": "int", "high": "float", "coarse": "float", "cached": "float", "grammar": "float", "prose": "boolean"}


def scored_windows(tokens: DataFrame, models: list[tuple[ProseModel, ProseModel]]) -> DataFrame:
    """(doc_id, words, bits, w: array of the figures of each window) of every document."""
    kinds = {"int": pa.int32(), "float": pa.float32(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _lists(batch.column(1))
            marks, _ = _lists(batch.column(2))
            keys, _ = _trigrams(values)
            half = np.repeat(batch.column(3).to_numpy(), np.diff(offsets))
            bits, coarse = np.zeros(len(keys)), np.zeros(len(keys))
            for side, (fine, rough) in enumerate(models):
                here = np.flatnonzero(half == side) + offsets[0]
                bits[here], coarse[here] = fine.bits(keys[here]), rough.bits(coarse_keys(keys[here]))
            rows = [windows(values[a:b], marks[a:b], bits[a:b], coarse[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            ends = np.cumsum([0, *(len(w["own"]) for _, _, w in rows)]).astype(np.int32)
            fields = [pa.array(np.concatenate([np.zeros(0), *(w[name] for _, _, w in rows)])).cast(kinds[kind]) for name, kind in _FIGURES.items()]
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, names=list(_FIGURES)))
            plain = [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays([*plain, listed], ["doc_id", "words", "bits", "w"])

    figures = ", ".join(f"{name}: {kind}" for name, kind in _FIGURES.items())
    return tokens.mapInArrow(run, f"doc_id bigint, words bigint, bits double, w array<struct<{figures}>>")


def prose_limits(scored: DataFrame) -> tuple[float, float]:
    """(bits, coarse bits) that ``HIGH_SHARE`` and ``COARSE_SHARE`` of the windows of held-out prose do not exceed.

    Counted in steps of 0.01 bits, so no more than about 2,000 rows come to the driver; infinite without prose.
    """
    prose = scored.select(F.explode("w").alias("w")).where("w.prose")
    step = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.ceil(F.col(f"w.{c}") * 100).cast("int").alias("at")) for c in ("high", "coarse")]))
    rows = prose.select(step.alias("s")).groupBy("s.kind", "s.at").agg(F.count(F.lit(1)).alias("n")).collect()
    limits = []
    for kind, share in (("high", HIGH_SHARE), ("coarse", COARSE_SHARE)):
        own = sorted((r["at"], r["n"]) for r in rows if r["kind"] == kind)
        below = np.cumsum([n for _, n in own])
        limits.append(own[int(np.searchsorted(below, share * below[-1]))][0] / 100 if own else float("inf"))
    return limits[0], limits[1]


def spam_scores(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, words, abnormal, bits): words of each document, those in abnormal windows, mean bits of a class."""
    tokens = cut_lineage(classified(documents, labels))
    scored = cut_lineage(scored_windows(tokens, train(tokens)))
    high, coarse = prose_limits(scored)

    def abnormal(w: Column) -> Column:
        other_style = (w["coarse"] <= coarse) & (w["grammar"] >= LEAST_FUNCTION) & (w["cached"] >= STYLE_BITS)
        return ((w["high"] > high) & ~other_style) | (w["cached"] < LOW_BITS)

    counted = F.aggregate("w", F.lit(0).cast("bigint"), lambda n, w: n + F.when(abnormal(w), w["own"]).otherwise(0))
    return scored.select("doc_id", "words", counted.alias("abnormal"), "bits")


def is_spam() -> Column:
    """Condition on the columns of ``spam_scores``."""
    return (F.col("words") >= MIN_WORDS) & (F.col("abnormal") >= FLAG_SHARE * F.col("words"))
