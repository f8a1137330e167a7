"""The tokenizer of fields that hold several values."""

import random

import pytest

from crateline.operators import multivalue as M

ARTISTS = ["A & B", "Sun, Moon & Daughters", "Ann Lee", "Joan Marsh", "The Tides"]
GENRES = ["Tape/Loop", "Swing, Old Time", "Jazz", "Dub"]


def split(text, grammar=M.ARTIST_GRAMMAR, names=ARTISTS):
    return M.split_text(text, grammar, M.Lexicon.of(names, grammar))


@pytest.mark.parametrize(
    ("text", "values"),
    [
        (None, []), ("", []), ("  ", []), (";;", []), ("Ann Lee", ["Ann Lee"]), ("Ann Lee;", ["Ann Lee"]),
        ("Ann Lee; Joan Marsh", ["Ann Lee", "Joan Marsh"]), ("A & B; Ann Lee", ["A & B", "Ann Lee"]), ("A & B", ["A & B"]),
        ("Sun, Moon & Daughters / A & B", ["Sun, Moon & Daughters", "A & B"]), ("Lee, Ann", ["Lee, Ann"]), ("Tides, The", ["Tides, The"]),
        ("Ann Lee feat. Joan Marsh", ["Ann Lee", "Joan Marsh"]), ("Ann Lee (ft. Joan Marsh, Bo Bee)", ["Ann Lee", "Joan Marsh", "Bo Bee"]),
        ('"Ann; Lee","Joan"', ["Ann; Lee", "Joan"]), ('["a \\"b\\"", "c"]', ['a "b"', "c"]), ("Ann Lee \\\\ Joan Marsh", ["Ann Lee", "Joan Marsh"]),
        ("Ann (x; y) Lee; Bo Bee", ["Ann (x; y) Lee", "Bo Bee"]), ('"Big" Ann Lee', ['"Big" Ann Lee']), ("Ann; Ann", ["Ann", "Ann"]),
        ('"Ann', ['"Ann']), ("Ann Lee with A & B with Bo Bee", ["Ann Lee", "A & B", "Bo Bee"]),
    ],
)
def test_artists(text, values):
    assert split(text) == values


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("Tape/Loop|Jazz", ["Tape/Loop", "Jazz"]), ("'Tape/Loop','Dub'", ["Tape/Loop", "Dub"]), ("Swing, Old Time, Jazz", ["Swing, Old Time", "Jazz"]),
        ('"Jazz" "Dub"', ["Jazz", "Dub"]), ("Jazz\tDub", ["Jazz", "Dub"]), ("Jazz · Dub·", ["Jazz", "Dub"]), ("jazz; ;dub", ["jazz", "dub"]),
    ],
)
def test_genres(text, values):
    assert split(text, M.GENRE_GRAMMAR, GENRES) == values


def test_joined_values_come_back():
    rng = random.Random(7)
    for _ in range(300):
        values = [rng.choice(["Jazz", "Dub", "Deep House", "Tape/Loop", "Swing, Old Time"]) for _ in range(rng.randint(2, 5))]
        quote, cut = rng.choice(['"', "'", ""]), rng.choice([";", " | ", ", ", "; ", " / ", "\\\\"])
        assert split(cut.join(f"{quote}{v}{quote}" for v in values), M.GENRE_GRAMMAR, GENRES) == values


def test_rows_and_fallback_join(spark):
    rows = spark.createDataFrame(
        [(1, "Ann Lee; A & B", None, "x"), (2, None, "Jazz|Tape/Loop", "x"), (3, "Ann Lee", "", "x"), (3, "Ann Lee", "", "x"), (4, "w; " * 5000, "Dub", "x"), (5, None, "Swing, Old Tme, Jazz", "x")],
        "id int, artist string, genre string, _text string",
    )
    fields = {
        "artist": (M.ARTIST_GRAMMAR, spark.createDataFrame([(n,) for n in ARTISTS], "name string")),
        "genre": (M.GENRE_GRAMMAR, spark.createDataFrame([(n,) for n in GENRES], "name string")),
    }
    small = sorted(map(tuple, M.split_values(rows, "id", fields, 2).collect()))
    joined = sorted(map(tuple, M.split_values(rows, "id", fields, 2, max_lexicon=1).collect()))
    assert small == joined
    assert [r for r in small if r[0] < 4] == [(1, "artist", 1, "Ann Lee"), (1, "artist", 2, "A & B"), (2, "genre", 1, "Jazz"), (2, "genre", 2, "Tape/Loop")]
    assert sum(r[0] == 4 for r in small) == 5000 and [r[3] for r in small if r[0] == 5] == ["Swing, Old Tme", "Jazz"]
    every = M.split_values(rows, "id", fields)
    assert every.where("id = 3").count() == 2
    assert M.split_values(rows.limit(0), "id", fields).count() == 0
