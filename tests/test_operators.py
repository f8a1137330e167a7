"""Core operators on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from crateline.functions import numeric as N
from crateline.functions import text as X
from crateline.operators import browse, derive, duplicates, evaluation, ingest, matching, retrieval
from crateline.operators.skew import hot_keys, lookup
from crateline.plans import intent as I
from crateline.plans.taxonomy import LEVELS, default_taxonomy, parse_taxonomy
from crateline.session import cut_lineage
from crateline.sources import files, sinks


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_soft_thresholds_stay_in_bounds(spark):
    x = F.col("x")
    rows = spark.createDataFrame([(v,) for v in (None, -5.0, 0.0, 0.3, 0.5, 1.0, 9.0, math.nan)], "x double")
    for score in (N.range_score(x, 0.3, 0.6, 0.2), N.max_score(x, 0.4, 0.3), N.min_score(x, 0.4, 0.3)):
        assert all(0 <= r[0] <= 1 for r in rows.select(score).collect())
    assert value(spark, N.range_score(F.lit(0.2), 0.3, 0.6, 0.2)) == pytest.approx(0.5)


@pytest.mark.parametrize(("bpm", "style", "felt"), [(172.0, "rock", 86.0), (174.0, "jungle", 174.0), (48.0, None, 96.0), (150.0, "hip-hop", 75.0), (0.0, None, None), (120.0, None, 120.0)])
def test_perceived_tempo(spark, bpm, style, felt):
    assert value(spark, N.perceived_tempo(F.lit(bpm), F.lit(style))) == felt


def test_key_vectors_and_names(spark):
    assert tuple(value(spark, N.estimate_key(F.array(*[F.lit(float(i == 2)) for i in range(12)])))) == ("D", "major")
    assert value(spark, N.estimate_key(F.array(F.lit(1.0)))) is None
    assert value(spark, N.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(math.sqrt(0.5))
    assert value(spark, N.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert value(spark, X.name_similarity(F.lit("The Tides"), F.lit("the tides!"))) == 1.0
    assert value(spark, X.parsed_title(F.lit("03 - Ann Lee - Blue Sea"))).asDict() == {"artist": "Ann Lee", "title": "Blue Sea"}
    assert value(spark, X.base_title(F.lit("blue sea radio edit 2011")))["versions"] == ["radio_edit"]
    assert value(spark, X.duration_text(F.lit(65.2))) == "1:05"


def test_lookup_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr("crateline.operators.skew.MIN_ROWS", 100)
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(3000)] + [(9999, None)], "id int, k string")
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 3000, 6)], "key string, v int")
    assert hot_keys(rows, "k") == ["hot"]
    found = {r["id"]: r["v"] for r in lookup(rows, "k", table, "key", "v", "v").collect()}
    assert len(found) == 3001 and found[1] == 1 and found[6] == 6 and found[3] is None and found[9999] is None


def test_cut_lineage_without_the_estimate(spark):
    rows = spark.createDataFrame([(1, "a", [1.5, None], None), (2, None, [], "x")], "id int, k string, v array<double>, t string").withColumn("n", F.struct("k", "id"))
    size = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert size(cut_lineage(spark.range(3))) == size(spark.range(3)) == 24
    kept = rows
    for _ in range(12):
        kept = cut_lineage(kept.join(kept.select(F.col("id").alias("other")), F.col("id") == F.col("other"), "left").drop("other"), keep_estimate=False)
        assert size(kept) < 2**63
    assert kept.schema == rows.schema and sorted(kept.collect()) == sorted(rows.collect())


def test_clusters_compare_with_their_first_duration(spark):
    rows = spark.createDataFrame([("k", str(i), d) for i, d in enumerate([10.0, 11.5, 12.5, 14.6, 30.0, None, None])] + [("x", "z", 1.0)], "key string, id string, duration double")
    found = {}
    for r in duplicates.anchored_clusters(rows, "key", 2.0).collect():
        found.setdefault(r["cluster"], set()).add(r["id"])
    assert sorted(map(sorted, found.values())) == [["0", "1"], ["5", "6"]] or sorted(map(sorted, found.values())) == [["0", "1"], ["2", "3"], ["5", "6"]]


def test_club_and_ambient_features(spark):
    columns = "track_id string, bpm double, energy double, danceability double, aggression double, brightness double, vocalness double, instrumentalness double"
    rows = spark.createDataFrame([("club", 124.0, 0.9, 0.9, 0.2, 0.7, 0.5, 0.1), ("amb", 90.0, 0.3, 0.3, 0.05, 0.2, 0.0, 0.9), ("none", *[None] * 7)], columns)
    fit = {(r["track_id"], r["context"]): r["score"] for r in derive.context_fit(rows).collect()}
    assert fit["club", "club"] > 0.85 and fit["club", "party"] > 0.8 and fit["amb", "dark_ambient"] > 0.8 and fit["amb", "background"] > 0.8
    tags = {(r["track_id"], r["tag"]) for r in derive.feature_tags(rows).collect()}
    assert ("club", "club_friendly") in tags and ("amb", "dark") in tags


def test_scan_cycle(spark):
    state = spark.createDataFrame([("a", "p1", 1, 1, None), ("b", "p2", 1, 1, None), ("c", "p3", 1, 1, None)], "id string, path string, file_size long, file_mtime_ns long, missing_at timestamp_ntz")
    snapshot = spark.createDataFrame([("p1", 1, 1), ("p2", 2, 1), ("p4", 1, 1)], "path string, file_size long, file_mtime_ns long")
    diff = {r["path"]: r["status"] for r in ingest.scan_diff(snapshot, state).collect()}
    assert diff == {"p1": "unchanged", "p2": "modified", "p3": "missing", "p4": "added"}
    again = ingest.upsert(snapshot.withColumn("v", F.lit(1)), snapshot.withColumn("v", F.lit(2)), ["path"], ["file_size"])
    assert {r["v"] for r in again.collect()} == {2}


def test_decisions(spark):
    track = "id string, path string, content_hash string, chromaprint string, fingerprint_duration double, title string, artist string, album string, duration_sec double, artist_title_norm string"
    rows = [("a", "/x/1.mp3", "h", "c", 10.0, "Blue", "Ann", None, 10.0, "ann blue"), ("b", "/y/2.mp3", "h", "d", 10.0, "Blue", "Ann", None, 10.0, "ann blue"),
            ("c", "/z/3.mp3", None, "c", 11.0, "Blue (Live)", "Ann", None, 11.0, "ann blue live"), ("d", "/z/4.mp3", None, None, 10.5, "Blue", "Ann", None, 10.5, "ann blue")]
    tracks = spark.createDataFrame(rows, track)
    features = spark.createDataFrame([], "track_id string, bpm double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("d", "zz")], "track_a string, track_b string")
    found = {(r["track_a"], r["track_b"]): (r["decision"], r["identity_decision"]) for r in matching.reports(pairs, tracks, features).collect()}
    assert found == {("a", "b"): ("exact_duplicate", "same"), ("a", "c"): ("same_recording", "same"), ("a", "d"): ("possible_metadata_match", "possible")}
    import numpy as np

    frames = np.random.default_rng(1).integers(0, 2**32, 400)
    assert matching.align_frames(frames, frames[37:]) == 1.0 and matching.align_frames(frames, np.array([])) == 0.0


def test_query_compiler():
    tax = default_taxonomy()
    assert len(tax.contexts) == 18 and len(tax.priors) == 12 and all(set(r) == set(LEVELS) for r in tax.ranges.values())
    assert I.mode_of(I.parse_query("highest bpm")) == "feature_sort" and I.parse_sorts("fastest, lowest energy") == [("tempo_bpm", "desc"), ("energy", "asc")]
    assert I.mode_of(I.parse_query("songs for a long drive")) == "occasion"
    assert "aggressive" not in I.parse_query("energetic but not aggressive").terms
    assert I.parse_query("25 quiet songs").limit == 25 and I.parse_query("").limit == 10
    assert I.merge_ranges((0, 0.5), (0.4, 1)) == (0.4, 0.5) and I.merge_ranges((0, 0.2), (0.4, 1)) == (0, 1)
    assert I.clean_hints({"contexts": ["party", "nowhere"], "prefer": ["x", "disco"]}) == {"contexts": ["party"], "prefer": ["disco"], "avoid": []}
    with pytest.raises(ValueError):
        parse_taxonomy({"feature_ranges": {"energy": {"low": [0, 1]}}, "contexts": {}, "query_priors": {}})


def test_retrieval_and_evaluation(spark):
    docs = spark.createDataFrame([(1, "tape tape guitar"), (2, "guitar"), (3, None), (4, "")], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in retrieval.bm25(docs, "doc_id", "text", ["tape", "guitar"]).collect()}
    assert scores[1] > scores[2] and set(scores) == {1, 2}
    assert retrieval.bm25(docs, "doc_id", "text", []).count() == 0
    results = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b")], "search_id string, rank int, track_id string")
    judged = spark.createDataFrame([("s", "b", 1)], "search_id string, track_id string, rating int")
    row = evaluation.judged_precision(results, judged).first()
    assert (row["precision"], row["reciprocal_rank"]) == (0.5, 0.5)
    passed = {c["check"]: c["passed"] for c in evaluation.check_query({"id": 1, "expectations": {"expected_mode": "x", "must_match_any": ["blue"]}}, {"mode": "x", "results": [{"title": "Blue"}]})}
    assert passed == {"expected_mode": True, "must_match_any": True}


def test_files_and_sinks(spark, tmp_path):
    music = tmp_path / "music" / "deep"
    music.mkdir(parents=True)
    (music / "a.mp3").write_bytes(b"x")
    (music / "b.txt").write_bytes(b"x")
    assert [r["extension"] for r in files.scan_folder(spark, str(tmp_path / "music")).collect()] == [".mp3"]
    probe = '{"format":{"duration":"3.5","tags":{"TITLE":"Blue"}},"streams":[{"codec_type":"video"},{"codec_type":"audio","codec_name":"mp3","channels":2,"tags":{"artist":"Ann"}}]}'
    row = files.probed_metadata(spark.createDataFrame([(probe,), ("broken",), (None,)], "probe string")).collect()
    assert (row[0]["title"], row[0]["artist"], row[0]["duration_sec"], row[0]["codec"]) == ("Blue", "Ann", 3.5, "mp3") and row[1]["title"] is None
    results = spark.createDataFrame([(1, "t", 0.5, "Blue", "Ann", None, "/m/a.mp3")], "rank int, track_id string, score double, title string, artist string, album string, path string")
    assert [r[0] for r in sinks.m3u_lines(results, "relative", "/m").collect()] == ["#EXTM3U", "#EXTINF:-1,Ann - Blue\na.mp3"]
    sinks.append(results, str(tmp_path / "log"))
    sinks.swap_table(spark.read.parquet(str(tmp_path / "log")).limit(1), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1
    rows = spark.createDataFrame([("/a/b/c", None), ("/a/bb", None), ("/a/b", None)], "path string, missing_at timestamp")
    assert rows.where(browse.under_folder(F.col("path"), "/a/b/")).count() == 2


def test_streams_agree_with_batch(spark, tmp_path):
    from crateline.streaming import catalogue

    columns = "id string, search_event_id string, track_id string, rating int, note string, created_at timestamp_ntz, ingested_at timestamp_ntz"
    rows = spark.sql("SELECT * FROM VALUES ('1','s','a',1,'',TIMESTAMP_NTZ'2024-01-01 00:00:00',TIMESTAMP_NTZ'2024-01-01 00:00:00'), ('1','s','a',1,'',TIMESTAMP_NTZ'2024-01-01 00:00:00',TIMESTAMP_NTZ'2024-01-01 00:00:00'), ('2','s','a',-1,'',TIMESTAMP_NTZ'2024-01-02 00:00:00',TIMESTAMP_NTZ'2024-01-01 00:00:00'), ('3','s','b',5,'',TIMESTAMP_NTZ'2024-01-01 00:00:00',TIMESTAMP_NTZ'2024-01-01 00:00:00')")
    rows.toDF(*[c.split()[0] for c in columns.split(", ")]).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = catalogue.feedback_stream(spark, str(tmp_path / "in"), columns)
    q = catalogue.run_incremental(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert seen == [3]


def test_hashes_are_read_in_chunks(spark, tmp_path, monkeypatch):
    import hashlib

    monkeypatch.setattr(files, "HASH_CHUNK", 7)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b.mp3").write_bytes(b"x" * 100)
    (tmp_path / "in" / "empty.flac").write_bytes(b"")
    (tmp_path / "in" / "notes.txt").write_bytes(b"y")
    found = {r["path"].rsplit("/", 1)[1]: r["content_hash"] for r in files.content_hashes(spark, str(tmp_path / "in")).collect()}
    assert {k.replace("%20", " "): v for k, v in found.items()} == {"a b.mp3": hashlib.sha256(b"x" * 100).hexdigest()}


def test_query_helpers():
    assert I.mentions_loosely("I’m in the mood-music", "im in the mood") and not I.mentions_loosely("calming", "calm")
    assert I.with_term_replaced("Tecno and tecno", "tecno", r"techno\\1") == r"techno\\1 and tecno"
    assert I.target_label("union:library_percentile:high_energy+fallback:party/party") == "high energy/party" and I.target_label("") == "requested"
    assert I.available_model("a/b", ["x/b", "a/c"]) == "x/b" and I.available_model("q", ["m"], "q") == "m" and I.available_model("q", ["m"]) is None


def test_packed_frames_are_checked(spark):
    rows = spark.createDataFrame([(1, bytes([1, 0, 0, 0, 255, 255, 255, 255]), 2), (2, b"abc", None), (3, b"abcd", 2), (4, None, None), (5, b"", 0)], "id int, b binary, n int")
    found = {r["id"]: r["f"] for r in rows.select("id", matching.unpacked_frames("b", "n").alias("f")).collect()}
    assert found == {1: [1, 0xFFFFFFFF], 2: [], 3: [], 4: [], 5: []}
    assert spark.createDataFrame([([],)], "f array<long>").select(matching.packed_frames("f")).first()[0] is None
