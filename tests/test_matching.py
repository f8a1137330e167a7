"""Fingerprint and audio evidence of pairs, and the kinds drawn from it."""

import base64

import numpy as np
import pytest

from crateline.operators import matching

TRACK = (
    "id string, path string, content_hash string, chromaprint string, fingerprint_duration double, title string, artist string, album string, duration_sec double, artist_title_norm string"
)


def fingerprint(frames) -> str:
    """The compressed text of frames."""
    small, long, before = [], [], 0
    for frame in map(int, frames):
        last = 0
        for bit in range(32):
            if (frame ^ before) >> bit & 1:
                step, last = bit + 1 - last, bit + 1
                small.append(min(step, 7))
                long += [step - 7] if step >= 7 else []
        small.append(0)
        before = frame
    pack = lambda values, width: np.packbits(np.array([v >> i & 1 for v in values for i in range(width)], dtype=np.uint8), bitorder="little").tobytes()
    data = bytes([1]) + len(frames).to_bytes(3, "big") + pack(small, 3) + pack(long, 5)
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


@pytest.mark.parametrize("frames", [[1], [0, 0, 2**32 - 1], [2**31, 2**31 + 5, 7, 7, 0]])
def test_fingerprints_decode(frames):
    assert matching.decode_frames(fingerprint(frames)).tolist() == frames
    assert matching.decode_frames(fingerprint(frames)[:6]) is None
    for text in (None, "", "AQAA", "AQAAAA", "é", "AQAAvblL1sqtrL8EUfTREef8ztcexNs5"):
        assert matching.decode_frames(text) is None


def test_fingerprint_and_audio_kinds(spark):
    frames = np.random.default_rng(2).integers(0, 2**32, 300)
    half, tenth = frames.copy(), frames.copy()
    half[150:], tenth[45:] = ~half[150:] & 0xFFFFFFFF, ~tenth[45:] & 0xFFFFFFFF
    prints = {"a": fingerprint(frames), "b": fingerprint(half), "c": fingerprint(tenth), "d": fingerprint(~frames & 0xFFFFFFFF), "e": "broken", "f": None, "g": None}
    words = dict(zip("abcdefg", ["oak", "brim", "duct", "fjpq", "vex", "kiwi", "lyz"], strict=True))
    tracks = spark.createDataFrame([(i, f"/x/{words[i]}.mp3", None, p, None, words[i], None, None, None, None) for i, p in prints.items()], TRACK)
    features = spark.createDataFrame([], "track_id string, bpm double")
    vectors = [("f", "audio_clap", "m", [1.0, 0.0]), ("g", "audio_clap", "m", [1.0, 0.1]), ("f", "audio_clap", "n", [1.0, 0.0]), ("g", "audio_clap", "n", [0.0, 1.0]),
               ("a", "audio_clap", "o", [1.0, 0.0]), ("e", "audio_clap", "m", [0.0, 0.0]), ("e", "text", "n", [1.0, 0.0])]
    audio = spark.createDataFrame(vectors, "track_id string, kind string, model string, vector array<float>")
    pairs = spark.createDataFrame([("a", x) for x in "bcdef"] + [("f", "g"), ("f", "e")], "track_a string, track_b string")
    found = {r["track_a"] + r["track_b"]: r for r in matching.reports(pairs, tracks, features, audio=audio).collect()}
    assert {k: (r["fingerprint_similarity"]["status"], r["audio_embedding"]["status"]) for k, r in found.items()} == {
        "ab": ("similar", "missing"), "ac": ("related", "missing"), "ad": ("dissimilar", "missing"), "ae": ("missing", "missing"), "af": ("missing", "missing"),
        "fg": ("missing", "similar"), "fe": ("missing", "error"),
    }
    assert (found["ab"]["candidate_kind"], found["ab"]["candidate_score"]) == ("possible_recording_match", 0.125)
    assert (found["ac"]["candidate_kind"], found["ac"]["candidate_strength"]) == ("soundwave_related", "medium")
    assert (found["ad"]["candidate_kind"], found["ad"]["candidate_score"]) == ("no_nearby_signal", 0.0)
    r = found["fg"]
    assert (r["decision"], r["candidate_kind"]) == ("sound_similar_only", "audio_similar") and r["confidence_score"] == pytest.approx(0.5 / 1.01**0.5, abs=1e-5)


def test_stored_frames_come_first(spark):
    frames = list(range(1000, 1300))
    rows = [(i, "/x", None, p, None, None, None, None, None, None, f) for i, p, f in [("a", "p", frames), ("b", "p", frames), ("c", fingerprint(frames), [])]]
    tracks = spark.createDataFrame(rows, TRACK + ", chromaprint_frames array<bigint>")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "track_a string, track_b string")
    found = matching.reports(pairs, tracks, spark.createDataFrame([], "track_id string, bpm double")).collect()
    assert {r["track_b"]: tuple(r["fingerprint_similarity"]) for r in found} == {"b": ("same", 1.0), "c": ("similar", 1.0)}
