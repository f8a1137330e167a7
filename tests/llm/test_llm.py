"""Operators of the llm subpackage against brute force, round trips and edge cases."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from crateline.llm import components, encoding, lookalikes, mojibake, names, neighbours, packing, survivor, webspam

VOCABULARY = encoding.DEFAULT_VOCABULARY


# 2. groups


def brute_groups(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    return {x: find(x) for x in parent}


def groups(spark, pairs):
    rows = spark.createDataFrame(pairs, "a string, b string").withColumn("vertex", F.lit("clash"))
    return {r["vertex"]: r["group_id"] for r in components.connected_groups(rows, "a", "b").collect()}


def test_groups(spark):
    rng = random.Random(3)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    star = [("hub", f"s{rng.randrange(400):03}") for _ in range(700)]
    loose = [(f"v{rng.randrange(200):03}", f"v{rng.randrange(200):03}") for _ in range(90)]
    pairs = chain + star + loose + [("c000", "c000"), (None, "c001"), ("c005", None), ("c009", "c004"), ("c009", "c004")]
    rng.shuffle(pairs)
    assert groups(spark, pairs) == brute_groups(pairs)


def estimated_digits(df):
    """Of the planner's estimate of the size in bytes; as text, since Python turns at most 4,300 digits into a number."""
    size = df._jdf.queryExecution().optimizedPlan().stats().toString()
    power = re.search(r"E\+(\d+)", size)
    return int(power[1]) + 1 if power else 22


def test_estimated_sizes_stay_small_over_the_rounds(spark):
    """They had doubled their digits with every jump, on the driver, so a long chain took all of its memory."""
    pairs = [(f"c{i * 7 % 90:03}", f"c{(i + 1) * 7 % 90:03}") for i in range(89)]
    rows = spark.createDataFrame(pairs, "a string, b string")
    found = components.connected_groups(rows, "a", "b")
    assert {r["vertex"]: r["group_id"] for r in found.collect()} == brute_groups(pairs)
    assert estimated_digits(found) <= 40


def test_groups_of_nothing(spark):
    assert groups(spark, []) == {} and groups(spark, [("a", "a"), (None, None)]) == {}


# 3. look-alikes


@pytest.mark.parametrize(
    ("text", "bad", "form"),
    [
        ("Quiet Sea", False, None), ("Ｑｕｉｅｔ Sea", True, "Quiet Sea"), ("Café", True, "Café"), ("Café", False, None), ("Qu​iet", True, "Quiet"),
        ("Blue Sea", True, "Blue Sea"), ("Росa", True, "Роса"), ("Север Sea", False, None), ("👩‍🚀 Flight", False, None), ("100 °C", False, None),
        ("デンシャ", True, "デンシャ"), ("ﾃﾞﾝｼｬ", True, "デンシャ"), ("Reﬆless", True, "Restless"), ("Nаtt", True, "Natt"), ("“Quoted”", False, None), ("", False, None),
    ],
)
def test_forms(text, bad, form):
    assert lookalikes.out_of_form(text) == bad
    if bad:
        assert " ".join(lookalikes.by_table(w) for w in text.split()) == form


def test_canonical_spellings(spark):
    rows = [("1", "title", "Quiet Sea"), ("2", "title", "quiet sea"), ("3", "title", "Ｑuiet Ｓea"), ("4", "title", "Роса"), ("5", "title", "Росa"), ("6", "title", "Zｏrk"),
            ("7", "title", ""), ("8", "title", None), ("9", "title", "Ｑuiet " * 3000)]
    fields = spark.createDataFrame(rows, "track_id string, field_name string, text string").where("text IS NOT NULL")
    found = {r["track_id"]: r["form"] for r in lookalikes.consistent_fields(fields).collect()}
    assert {k: found[k] for k in "356"} == {"3": "Quiet Sea", "5": "Роса", "6": "Zork"} and len(found) == 4 and found["9"].count("Quiet") == 3000
    assert lookalikes.consistent_fields(fields.limit(0)).count() == 0


def test_automaton_agrees_with_scan_of_the_vocabulary():
    vocabulary = {"Роса": 5, "Poca": 1, "Quiet": 9, "quite": 4, "Café": 3, "Cafe": 1}
    trie = lookalikes.Trie()
    for w, n in vocabulary.items():
        trie.add(w, n)

    def brute(word):
        seen, best = lookalikes.units(word), []
        for w, n in vocabulary.items():
            if len(w) == len(seen):
                cost = sum(lookalikes._step(c, x) for c, x in zip(seen, w, strict=True))
                if cost <= lookalikes.BUDGET:
                    free = sum(a != b and not lookalikes._step(a, b) for a, b in zip(seen, w, strict=True))
                    best.append((cost, free + sum(n for _, n in lookalikes.clusters(word)), -n, w))
        return (min(best)[3], min(best)[1]) if best else None

    for word in ("Росa", "Ｑuiet", "qu​iet", "Café", "Ｃafe", "Ｚork", "QUITE", "Рoca"):
        assert trie.canonical(word) == brute(word)
    for word in vocabulary:
        assert trie.canonical(word) == (word, 0)


def test_automaton_decides_what_is_out_of_form():
    words = ["Ｑuiet", "Qu\u200biet", "Cafe\u0301", "Caf\u00e9", "\ufb01ne", "Рос\u0061", "Роса", "Poca", "デンシャ", "ﾃﾞﾝｼｬ", "テ゛ンシャ", "👩\u200d🚀",
             "\u1100\u1161\u11a8", "각", "\u212bngstr\u00f6m", "A\u030angstro\u0308m", "x\u0302", "कि", "Zoя", "Ⅷ", "²", "\u200b", "\u0301a"]
    trie = lookalikes.Trie()
    for w in [w for w in words if not lookalikes.out_of_form(w)] + ["fine", "Quiet"]:
        trie.add(w, 1)
    for w in words:
        assert (lookalikes.read_word(trie, w)[1] > 0) == lookalikes.out_of_form(w)
        assert "".join(x for letters, _ in lookalikes.clusters(w) for x in letters) == "".join(lookalikes.units(w))
    assert lookalikes.read_word(trie, "\ufb01ne") == ("fine", 1)


# 4. neighbours


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 30, (40, 26))
    x = np.round(np.concatenate([c + rng.normal(0, 0.25, (rng.integers(1, 9), 26)) for c in centres]), 4)
    x = np.concatenate([x, x[:12], np.repeat(x[:1], 40, axis=0)])
    ids = [f"t{i:04}" for i in range(len(x))]
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x, strict=True)], "id string, vector array<double>, class int")
    found = {tuple(r) for r in neighbours.near_pairs(neighbours.nearest(frame, 5, 2.5)).collect()}
    truth = set()
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        near = sorted((d[j], ids[j]) for j in range(len(x)) if j != i and d[j] <= 2.5)[:5]
        truth |= {tuple(sorted((ids[i], j))) for _, j in near}
    assert len(truth & found) >= 0.99 * len(truth) and len(found - truth) <= 0.01 * len(truth)


def test_usable_vectors(spark):
    good = str([1.0] * 13)
    rows = [("a", good, good), ("a", good, good), ("b", good, "[1,2]"), ("c", None, good), ("d", good, good[:-1]), ("e", good.replace("1.0", "NaN", 1), good),
            ("f", good.replace("1.0", '"x"', 1), good), ("g", good.replace("1.0", "1e999", 1), good), (None, good, good)]
    frame = spark.createDataFrame(rows, "track_id string, mfcc_mean_json string, mfcc_std_json string")
    assert [r["id"] for r in neighbours.timbre_vectors(frame).collect()] == ["a"]
    assert neighbours.near_pairs(neighbours.nearest(neighbours.timbre_vectors(frame.limit(0)), 5, 2.5)).count() == 0


def test_files_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(0, 0.3, (120, 26)), 3)
    frame = spark.createDataFrame([(f"t{i:03}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<double>")
    whole = set(map(tuple, neighbours.nearest(frame, 5, 2.5, kept=200).collect()))
    monkeypatch.setattr(neighbours, "FILE_ROWS", 25)
    assert set(map(tuple, neighbours.nearest(frame, 5, 2.5, kept=200).collect())) == whole


# 5. survivors


def test_survivors(spark):
    columns = "id string, track_id string, field_name string, value_text string, source string, confidence double, selected boolean, created_at timestamp_ntz, _trust int"
    at = "2024-01-01 00:00:00"
    rows = [
        ("c1", "t", "f", "Blue", "FFprobe ", 0.9, None, at, 0), ("c2", "t", "f", "Blue Sea", "x", 7.0, True, at, 0), ("c3", "t", "f", "n/a", "x", 1.0, True, at, 0),
        ("c4", "u", "f", "A", "derived", 0.5, False, at, 0), ("c5", "u", "f", "B", "ffprobe", 0.5, False, at, 0), ("c6", "v", "f", " ", "x", 1.0, True, at, 0),
        ("c7", "v", "f", None, "x", 1.0, True, at, 0), ("c8", "w", "f", "only", "x", 1.0, True, at, 0), ("c9", None, "f", "z", "x", 1.0, True, at, 0),
        ("d1", "x", "f", "same", "x", None, None, None, 0), ("d2", "x", "f", "same", "x", None, None, None, 0), ("d3", "x", "f", "y" * 100000, "q", float("nan"), None, None, 0),
    ]
    claims = spark.createDataFrame([r[:7] + (None,) + r[8:] for r in rows], columns).withColumn("created_at", F.lit(at).cast("timestamp_ntz"))
    sources = spark.createDataFrame([("ffprobe", 90), ("derived", 40)], "source string, trust int")
    found = {r["track_id"]: r["id"] for r in survivor.surviving_claims(claims, sources).collect()}
    assert found == {"t": "c2", "u": "c5", "x": "d3"}
    assert survivor.surviving_claims(claims.limit(0), sources.limit(0)).count() == 0
    record = survivor.surviving_records(claims.where("track_id = 'w'"), sources, ["f"]).first()
    assert (record["f"], record["filled"]) == ("only", 1)


# 6. names

KNOWN = [(1, "Joseph M. Blaren"), (2, "The Folmer Tides"), (3, "Koll & Stenner"), (4, "Varn String Quartet"), (5, "Greta Holm"), (6, "Gustav Holm"), (7, "Søren Ask")]


@pytest.mark.parametrize(
    ("typed", "artist"),
    [
        ("joseph blaren", 1), ("Blaren, Joseph M.", 1), ("Joe Blaren", 1), ("J. Blaren", 1), ("Jospeh M. Blarne", 1), ("JosephBlaren", 1), ("Joseph T. Blaren", None),
        ("Folmer Tides", 2), ("Tides, The Folmer", 2), ("folmer_tides", 2), ("Koll and Stenner", 3), ("Koll + Stener", 3), ("Varn Str. Qt.", 4), ("String Quartet Varn", 4),
        ("G. Holm", None), ("Greta Hoolm", 5), ("Soren Ask", 7), ("Zorba Quex", None), ("", None), (" ", None), ("Greta Holm", None), ("x" * 50000, None),
    ],
)
def test_names(spark, typed, artist, _cache={}):
    if not _cache:
        cases = [c[0] for c in test_names.pytestmark[0].args[1]]
        registry = spark.createDataFrame([(*k, "x") for k in KNOWN], "artist_id long, name string, known string")
        asked = spark.createDataFrame([(c, 1) for c in cases + [None, "joe blaren", "joe blaren"]], "name string, artist_id int")
        _cache["links"] = {r["name"]: r["artist_id"] for r in names.linked_names(asked, registry).collect()}
        assert names.linked_names(asked.limit(0), registry.limit(0)).count() == 0
    assert _cache["links"].get(typed) == artist


def test_common_rewritings_lose_no_link(spark):
    rng = random.Random(8)
    given = ["Joseph", "John", "Johan", "Josef", "Robert", "Roberta", "Margaret", "Maria", "Marion", "Edward", "Theodore", "Ingrid", "J", "Ana"]
    known = [(i, f"{g} {m}{s}") for i, (g, m, s) in enumerate((g, m, s) for s in ("Smith", "Smyth", "Smiths", "Holm") for g in given for m in ("", "Q. ", "Lee "))]
    typed = {"J Smith", "Joe Smith", "Jon Smith", "Smith, Bob", "Bob Q Smth", "Peggy Lee Smyht", "Ingie Holm", "Jospeh Lee Smiths", "Ted Smith", "Holm Ana", "Xngrid Holm"}
    for _, name in rng.sample(known, 60):
        i = rng.randrange(len(name))
        typed |= {name[:i] + name[i + 1 :], name[:i] + "e" + name[i:], " ".join(reversed(name.split())), name.upper()}
    registry = spark.createDataFrame(known, "artist_id long, name string")
    asked = spark.createDataFrame([(t,) for t in sorted(typed)], "name string")
    rows = [{tuple(r) for r in names.linked_names(asked, registry, common).collect()} for common in (0, 3, 10**9)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) > 100
    # the pair that shares the rarest rewriting is the link: brute force over all pairs
    forms = {n: set(names.rewritings(n, False)) for _, n in known}
    count = {}
    for f in forms.values():
        for x in f:
            count[x] = count.get(x, 0) + 1
    links = {r[0]: (r[1], r[4]) for r in rows[0]}
    for t in typed - {n for _, n in known}:
        scored = []
        for i, n in known:
            both, cost = set(names.rewritings(t, True)) & forms[n], names.alignment(t, n)
            if both and cost is not None:
                bits = round(np.log2(len(known) + 1) - np.log2(min(count[x] for x in both)), 6)
                scored.append((round(bits - names.COST_BITS * cost, 6), -i, bits))
        scored.sort(reverse=True)
        alone = scored and (len(scored) == 1 or scored[0][0] > scored[1][0])
        assert links.get(t) == ((-scored[0][1], scored[0][2]) if alone else None)


def test_words_that_align_share_a_key():
    rng = random.Random(4)
    tried = 0
    for _ in range(20000):
        known = "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))
        typed = list(known)
        for _ in range(rng.randint(0, 2)):
            i, kind = rng.randrange(len(typed) + 1), rng.randrange(4)
            typed[i : i + (kind < 2) + 2 * (kind == 3)] = [] if kind == 1 else typed[i : i + 2][::-1] if kind == 3 else [rng.choice("abc")]
        typed = "".join(typed) or "a"
        if names._word_cost(typed, known, False) < 10:
            tried += 1
            assert names._word_keys(typed, True) & names._word_keys(known, False), (typed, known)
    assert tried > 5000


def test_long_names_are_aligned_whole():
    long = "The Grand Old Northern Harbour Brass Sextet And Choir Of Upper Velm Town"
    assert names.alignment("grand old northern harbor brass sextet choir of upper velm town", long) == 1.0
    assert names.alignment("town velm upper of choir sextet brass harbour northern old grand", long) == 0.0
    assert names.alignment("grand old northern harbour brass sextet choir of upper zorq town", long) is None
    assert names.alignment("la " * 30, "La " * 30) == 0.0 and names.alignment("la " * 30 + "xo", "La " * 30 + "Yu") is None
    assert names.alignment("a b c d e f g h i j k l m n", "A B C D E F G H I J K L M O") is None  # two initials that differ
    assert [names._abbreviates(*p) for p in (("yth", "youth"), ("qt", "quartet"), ("jan", "jordan"), ("st", "sat"))] == [True, True, False, False]


def test_edits():
    assert [names.edits(a, b, 2) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "ab"), ("abcd", "badc"), ("abc", "xyz"))] == [0, 1, 1, 2, 3]


# 7. wrong decodings

TEXTS = ["Café Noir", "Größe und Über", "Ночной Север", "Источник света", "Μικρή πόλη", "よるのうみ", "Łąka Źródło", "It’s “Blue”"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("codec", ["cp1252", "mac_roman", "cp437", "cp1251"])
def test_restores_utf8_read_wrongly(text, codec):
    garbled = mojibake._read(text.encode(), codec)
    found, bad = mojibake.Restorer().restore(garbled)
    assert bad and found == text


@pytest.mark.parametrize("text", [*TEXTS, "100 °C", "§ 9", "© Ferry", "£20 Note", "«Détour»", "SÃO TELMIRO", "À Côté", "Â Meia-Luz", "Åå", "¿Dónde?", "Wolf 🐺 Song", "R&B", "", "Nаtt", "Сор", "Coup d’œil"])
def test_leaves_good_text(text):
    assert mojibake.Restorer().restore(text) == (text, False)


def test_garbled_fields(spark):
    rows = [(1, "CafÃ©", None, "&eacute;t&eacute;"), (2, "Caf�", "x", "Ñèíèé Ñíåã"), (3, None, "", "plain"), (3, None, "", "plain"), (4, "GrÃ¶ÃŸe " * 2000, "ok", None)]
    frame = spark.createDataFrame(rows, "id int, title string, artist string, album string")
    found = {(r["track_id"], r["field_name"]): r["restored"] for r in mojibake.garbled_fields(mojibake.long_fields(frame, "id", ["title", "artist", "album"])).collect()}
    assert set(found) == {(1, "title"), (1, "album"), (2, "title"), (2, "album"), (4, "title")}
    assert found[1, "title"] == "Café" and found[1, "album"] == "été" and found[2, "album"] == "Синий Снег" and found[4, "title"].startswith("Größe Größe")
    assert mojibake.Restorer().restore(None) == (None, False)
    assert mojibake.garbled_fields(mojibake.long_fields(frame.limit(0), "id", ["title"])).count() == 0


# 8. encoding


def test_tree_encoding_is_exact():
    rng = random.Random(1)
    alphabet = "aé1 \n\t'sdlve.,-漢字かな🙂‍́ <|endoftext|>"
    encoder = encoding.TreeEncoder(VOCABULARY, leaf_chars=7)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(400)] + ["a" * 5000, "漢" * 999, " " * 700, "x'll" * 300, None, ""]
    direct = encoder._direct([t or "" for t in texts])
    for text, ids, want in zip(texts, encoder.encode(texts), direct, strict=True):
        assert ids.tolist() == want.tolist() and encoder.decode(ids) == (text or "")


def test_token_ids_of_rows(spark):
    docs = spark.createDataFrame([(1, "hello world", [1]), (2, None, [1]), (3, "", [1]), (4, "a b " * 20000, [1])], "doc_id long, text string, ids array<int>")
    found = {r["doc_id"]: r["ids"] for r in encoding.token_ids(docs, "doc_id", "text").collect()}
    assert found[2] == found[3] == [] and encoding.TreeEncoder(VOCABULARY).decode(found[4]) == "a b " * 20000
    assert encoding.token_ids(docs.limit(0), "doc_id", "text").count() == 0


# 9. packing


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_item_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 2048])
    histogram = {rng.randint(1, capacity): rng.randint(1, 400) for _ in range(rng.randint(1, 60))}
    plan = packing.plan_packing(histogram, capacity)
    used = {}
    for pattern, copies in zip(plan.patterns, plan.copies, strict=True):
        assert sum(s * n for s, n in pattern.items()) <= capacity
        for s, n in pattern.items():
            used[s] = used.get(s, 0) + n * copies
    assert used == histogram


def test_packing_rows(spark):
    rng = random.Random(2)
    sizes = [rng.choice([5, 5, 5, 17, 40, 63, 64, 65, 200]) for _ in range(900)] + [0, 0, None]
    items = spark.createDataFrame(list(enumerate(sizes)), "item_id long, size long").withColumn("piece", F.lit(9))
    rows = packing.pack(items, 64, buckets=3).collect()
    load, parts = {}, {}
    for r in rows:
        load[r["container"]] = load.get(r["container"], 0) + r["size"]
        parts.setdefault(r["item_id"], []).append((r["start"], r["size"]))
    assert max(load.values()) <= 64
    for i, size in enumerate(sizes):
        own, at = sorted(parts[i]), 0
        for start, length in own:
            assert start == at
            at += length
        assert at == (size or 0) and (len(own) == 1 or size > 64)
    assert len(load) <= -(-sum(s or 0 for s in sizes) // 64) * 1.05 + 1
    assert packing.pack(items.limit(0), 64).count() == 0


# 10. spam


def test_spam(spark):
    prose = ["The drummer pulls against the metre, and I am glad that it does. The chorus was clearly added afterwards, as far as I can tell.",
             "My copy skips near the end, so I cannot say how the song resolves. For a late evening it sits well between something calm and something faster."]
    rows = [(i, prose[i % 2] + f" It was pressed in {1960 + i}.") for i in range(60)]
    rows += [(100, "cheap vinyl best mix free download cheap vinyl best mix free download " * 20), (101, "#dub #house #free #vinyl #mix " * 20), (102, "http://a.test/x http://b.test/y http://c.test/z " * 15)]
    rows += [(103, "The shop window said cheap vinyl, which made us laugh. " + prose[0]), (104, None), (105, ""), (106, "first!"), (107, " \n "), (108, "cheap vinyl " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("teach", F.lit(1))
    labels = spark.createDataFrame([(100, "spam"), (0, "ok"), (None, None)], "doc_id long, label string")
    scores = webspam.spam_scores(docs, labels)
    assert {r["doc_id"] for r in scores.where(webspam.is_spam()).collect()} == {100, 101, 102, 108}
    assert scores.count() == len(rows)
    assert webspam.spam_scores(docs.limit(0)).count() == 0


def test_model_matches_plain_counts():
    classes = np.array([5, 6, 7, webspam.END_PROSE, 5, 6, 8, webspam.END_PROSE, 9, webspam.END], dtype=np.int16)
    keys, line = webspam._trigrams(classes)
    found, n = np.unique(keys[line < 2], return_counts=True)
    model = webspam.ProseModel(found, n)
    a, b = model.bits(np.array([(5 * webspam.N_CLASSES + 6) * webspam.N_CLASSES + 7, (5 * webspam.N_CLASSES + 6) * webspam.N_CLASSES + 99]))
    assert a < 2 < b and line.tolist() == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]


def test_fluent_repetition_is_abnormally_low():
    def share(text):
        classes, marks = (np.array(x) for x in webspam.tokenise(text))
        words, _, w = webspam.windows(classes, marks, np.ones(len(classes)), np.ones(len(classes)))  # fluent everywhere
        return w["own"][w["cached"] < webspam.LOW_BITS].sum() / words

    within = "Our cheap vinyl is cheap vinyl, and the cheap vinyl you want is this cheap vinyl. " * 6
    lines = ["The cheap vinyl is here.", "We have cheap vinyl and more cheap vinyl.", "So what is cheap vinyl?", "This is the cheap vinyl you want, and it is cheap vinyl."] * 6
    verses = ["Leave the window open when you go", "And we were tender once again", "Hold the river, hold the line", "And we were distant once again"] * 6
    assert share(within) > webspam.FLAG_SHARE and share("\n".join(lines)) > webspam.FLAG_SHARE
    assert share("\n".join(verses)) == 0
    assert webspam.END_PROSE not in webspam.tokenise("\n".join(lines))[0] and webspam.END_PROSE in webspam.tokenise("\n".join(verses))[0]


#: Ordinary prose of other styles than the test tables.
PASSAGES = """The old man walked slowly down to the harbour, where a few boats were still waiting for the evening tide. He had not slept well.
Today I went to the market with my sister and we bought apples, bread and a little cheese. It rained the whole way home, but we laughed.
We propose a method for the estimation of sparse matrices from noisy observations. The estimator is consistent under mild assumptions.
It was the best of times, it was the worst of times, it was the age of wisdom, it was the age of foolishness.
The council met on Tuesday to discuss the new bridge, which will cost more than was expected when the plan was first drawn up.
If you want the dough to rise, leave it near the oven for an hour and do not open the door until it has doubled.
She asked me whether I had seen the letter, and I told her that it must have been lost with the rest of the papers.
Water boils at a lower temperature in the mountains because the pressure of the air is less than it is at the sea.
Als er am Morgen aus dem Haus ging, lag noch Schnee auf den Dächern, und die Straße war so still, dass er seine Schritte hörte.
Der Ausschuss hat den Antrag nach langer Beratung abgelehnt, weil die Kosten nicht gedeckt sind und niemand sie tragen wollte.
Man nimmt zwei Eier und etwas Mehl, rührt alles mit der Milch glatt und lässt den Teig eine halbe Stunde in der Küche stehen.
Ich habe dir doch gesagt, dass wir den Zug nicht mehr erreichen, wenn du noch einmal nach Hause gehst.
Le train avait du retard, et nous avons attendu sur le quai avec les autres voyageurs sans savoir ce qui se passait.
Dans cette étude, on montre que la méthode donne de bons résultats quand les données ne sont pas trop bruitées.
Il faut laisser la pâte dans un endroit chaud pendant une heure, puis la mettre au four avec un peu de beurre.
Ma grand-mère disait que la mer était plus belle en hiver, mais elle ne sortait plus de sa maison.
El barco llegó al puerto cuando ya era de noche, y los hombres que esperaban en el muelle no dijeron nada.
La reunión se celebró en la sala de la escuela, donde los vecinos hablaron de la carretera y de los árboles.
Si quieres que la salsa quede bien, no la dejes mucho tiempo en el fuego y añade la sal al final.
Mi hermano no sabía que la casa era tan vieja, pero le gustó el jardín y se quedó con nosotros hasta el lunes.""".split("\n")


DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="needs a corpus to learn prose from; a few made-up lines are too alike")
def test_ordinary_prose_is_left_alone(spark):
    spam = ["deep house mix vinyl promo dub techno label shop order rare press wax crate digger sale", "#dub #house #free #vinyl #mix #wax #rare #label #promo #shop #tape #disc"]
    rows = [(-1 - i, p) for i, p in enumerate(PASSAGES)] + [(-100 - i, t) for i, t in enumerate(spam)]
    corpus = spark.read.parquet(DOCUMENTS).select("doc_id", "text")
    scores = webspam.spam_scores(corpus.unionByName(spark.createDataFrame(rows, "doc_id long, text string")))
    found = {r["doc_id"] for r in scores.where(webspam.is_spam() & (F.col("doc_id") < 0)).collect()}
    assert len(PASSAGES) == 20 and found == {-100, -101}


def test_copies_do_not_teach_their_own_model(spark):
    docs = spark.createDataFrame([(i, "The wax is warm and the night is long.") for i in range(40)] + [(99, "So we play it until the end of the night, and then we sleep.")], "doc_id long, text string")
    halves = {r["half"] for r in webspam.classified(docs.where("doc_id < 40"), None).select("half").collect()}
    assert len(halves) == 1 and webspam.prose_limits(webspam.scored_windows(webspam.classified(docs.limit(0), None), [(webspam.ProseModel(np.zeros(0, int), np.zeros(0)),) * 2] * 2)) == (float("inf"),) * 2
