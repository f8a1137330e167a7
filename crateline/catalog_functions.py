"""Registered queries that run single functions over whole tables, with the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from crateline.catalog import _FEATURES, _RESULTS, _TAGS, _features, _tags, query
from crateline.functions import numeric as N
from crateline.functions import text as X
from crateline.operators import claims, evaluation, matching, retrieval
from crateline.sources.tables import load



def _strip(c: str) -> str:
    """SQL of a text without outer white space."""
    return rf"regexp_replace({c}, '^[\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}]+|[\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}]+$', '', 'g')"


# --- text ------------------------------------------------------------------------------------------------------------

_STOP = """['a', 'an', 'am', 'and', 'are', 'bar', 'bpm', 'for', 'give', 'i', 'im', 'in', 'is', 'm', 'me', 'music', 'my', 'of', 'play', 'songs',
  'that', 'the', 'to', 'track', 'tracks', 'want', 'with', 'without', 'best', 'by', 'fastest', 'find', 'good', 'great', 'highest', 'least', 'library',
  'list', 'local', 'lowest', 'most', 'nice', 'no', 'not', 'order', 'please', 'recommend', 'recommendations', 'show', 'slowest', 'some', 'sort', 'stuff',
  'top', 'vibe', 'vibes']"""


@query(
    "fn_query_terms",
    f"""SELECT id, array_to_string(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda w: NOT list_contains({_STOP}, w)
        AND NOT regexp_full_match(w, '[0-9]+')), ' ') AS terms FROM search_events WHERE query IS NOT NULL""",
)
def fn_query_terms(spark, folder):
    """The significant words of every logged query."""
    events = load(spark, folder, "search_events").where("query IS NOT NULL")
    return events.select("id", F.array_join(X.query_terms(F.col("query")), " ").alias("terms"))


@query(
    "fn_tag_words",
    """SELECT id, array_to_string(regexp_extract_all(replace(replace(lower(genre), '---', ' '), '_', ' '), '[a-z0-9]+'), ' ') AS words,
       regexp_replace(regexp_replace(lower(genre), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS tag_key FROM tracks WHERE genre IS NOT NULL""",
)
def fn_tag_words(spark, folder):
    """Every genre as the words and as the identifier of a tag."""
    rows = load(spark, folder, "tracks").where("genre IS NOT NULL")
    return rows.select("id", F.array_join(X.tag_terms(F.col("genre")), " ").alias("words"), X.tag_key(F.col("genre")).alias("tag_key"))


@query("fn_clean_value", "SELECT id, " + ", ".join(f"nullif({_strip(c)}, '') AS {c}" for c in ("title", "artist", "genre")) + " FROM tracks")
def fn_clean_value(spark, folder):
    """Values without outer blanks, NULL where nothing is left."""
    return load(spark, folder, "tracks").select("id", *[X.clean_value(F.col(c)).alias(c) for c in ("title", "artist", "genre")])


@query(
    "fn_short_forms",
    """SELECT id, CASE WHEN length(content_hash) > 24 THEN substr(content_hash, 1, 12) || '...' || right(content_hash, 8) ELSE content_hash END AS short_key,
       CASE WHEN duration_sec IS NOT NULL THEN printf('%d:%02d', CAST(floor(round(duration_sec) / 60) AS INTEGER), CAST(round(duration_sec) % 60 AS INTEGER)) END AS length_text
       FROM tracks""",
)
def fn_short_forms(spark, folder):
    """Shortened keys and durations as minutes and seconds."""
    return load(spark, folder, "tracks").select("id", X.short_key(F.col("content_hash")).alias("short_key"), X.duration_text(F.col("duration_sec")).alias("length_text"))


_FILE = r"regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\.[^.]*$', '\1')"


@query("fn_filename", f"SELECT id, {_FILE} AS filename FROM tracks")
def fn_filename(spark, folder):
    """The file name of every path without its extension."""
    return load(spark, folder, "tracks").select("id", X.filename(F.col("path")).alias("filename"))


_WORDS = "trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
_VERSIONS = {
    "extended mix": "extended_mix", "instrumental": "instrumental", "radio edit": "radio_edit", "remastered": "remaster", "acoustic": "acoustic",
    "club mix": "club_mix", "remaster": "remaster", "bootleg": "bootleg", "version": "version", "remix": "remix", "rework": "rework", "cover": "cover",
    "edit": "edit", "live": "live", "vip": "vip",
}


def _version_sql() -> str:
    """Version phrases taken out one after the other, longest first, noting which were met."""
    steps = [f"s0 AS (SELECT id, ' ' || {_WORDS.format(c='title')} || ' ' AS rest, []::VARCHAR[] AS met FROM tracks WHERE title IS NOT NULL)"]
    for i, phrase in enumerate(sorted(_VERSIONS, key=len, reverse=True)):
        hit = f"contains(rest, ' {phrase} ')"
        steps.append(f"s{i + 1} AS (SELECT id, replace(rest, ' {phrase} ', ' ') AS rest, CASE WHEN {hit} THEN list_append(met, '{_VERSIONS[phrase]}') ELSE met END AS met FROM s{i})")
    return (
        "WITH " + ", ".join(steps) + rf" SELECT id, trim(regexp_replace(regexp_replace(rest, '\b(19|20)\d\d\b', ' ', 'g'), '\s+', ' ', 'g')) AS base,"
        f" array_to_string(list_sort(list_distinct(met)), ',') AS versions FROM s{len(_VERSIONS)}"
    )


@query("fn_base_title", _version_sql())
def fn_base_title(spark, folder):
    """Titles without version words and years, and the versions they name."""
    plain = F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " "))
    rows = load(spark, folder, "tracks").where("title IS NOT NULL").select("id", X.base_title(plain).alias("b"))
    return rows.select("id", "b.base", F.array_join("b.versions", ",").alias("versions"))


_NAME_STOP = "['a', 'an', 'and', 'at', 'baby', 'feat', 'ft', 'i', 'in', 'is', 'it', 'me', 'my', 'of', 'on', 'the', 'to', 'u', 'you', 'your']"


@query(
    "fn_token_similarity",
    f"""WITH t AS (SELECT id, list_distinct(list_filter(string_split({_WORDS.format(c='title')}, ' '), lambda w: length(w) > 1 AND NOT list_contains({_NAME_STOP}, w))) AS w FROM tracks WHERE title IS NOT NULL),
        p AS (SELECT DISTINCT track_a, track_b FROM match_reports WHERE track_a <> track_b),
        n AS (SELECT track_a, track_b, len(a.w) AS x, len(b.w) AS y, len(list_intersect(a.w, b.w)) AS c FROM p JOIN t a ON track_a = a.id JOIN t b ON track_b = b.id),
        s AS (SELECT *, CASE WHEN c > 0 THEN greatest(c / (x + y - c)::DOUBLE, 0.92::DOUBLE * c / least(x, y)) ELSE 0 END AS s FROM n)
        SELECT track_a, track_b, round(CASE WHEN c = 1 AND least(x, y) > 1 THEN least(s, 0.42::DOUBLE) ELSE s END, 6) AS similarity FROM s""",
)
def fn_token_similarity(spark, folder):
    """Similarity of the words of the titles of every reported pair."""
    tracks = load(spark, folder, "tracks").where("title IS NOT NULL")
    words = tracks.select("id", X.name_tokens(F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " "))).alias("w"))
    pairs = load(spark, folder, "match_reports").where("track_a <> track_b").select("track_a", "track_b").distinct()
    a, b = words.toDF("track_a", "wa"), words.toDF("track_b", "wb")
    both = pairs.join(a, "track_a").join(b, "track_b")
    return both.select("track_a", "track_b", F.round(X.token_similarity(F.col("wa"), F.col("wb")), 6).alias("similarity"))


@query("fn_claim_id", """SELECT id, 'claim_' || substr(sha1(coalesce(track_id, '') || chr(0) || coalesce(field_name, '') || chr(0) || coalesce(value_text, '')), 1, 32) AS claim_id
       FROM track_metadata_claims""")  # fmt: skip
def fn_claim_id(spark, folder):
    """A stable id of every claim from its contents."""
    return load(spark, folder, "track_metadata_claims").select("id", claims.claim_id(F.col("track_id"), F.col("field_name"), F.col("value_text")).alias("claim_id"))


_BARE = r"trim(regexp_replace(replace(f, '_', ' '), '^\s*\d{1,3}\s*[-_.]\s*', ''))"
_DASH = r"'^(.+?)\s+[-–—]\s+(.+)$'"


@query(
    "filename_inference",
    f"""WITH n AS (SELECT id, path, nullif({_strip('title')}, '') AS t, nullif({_strip('artist')}, '') AS a, {_FILE} AS f FROM tracks),
        b AS (SELECT *, {_BARE} AS bare FROM n),
        p AS (SELECT *, nullif({_strip(f'regexp_extract(bare, {_DASH}, 1)')}, '') AS pa, coalesce(nullif({_strip(f'regexp_extract(bare, {_DASH}, 2)')}, ''), nullif({_strip('bare')}, '')) AS pt FROM b),
        r AS (SELECT id, path, t, a, coalesce(a, pa) AS artist, coalesce(t, pt, f) AS title FROM p)
        SELECT id, path, artist, title, array_to_string(list_filter([CASE WHEN artist IS DISTINCT FROM a THEN 'artist' END, CASE WHEN title IS DISTINCT FROM t THEN 'title' END],
          lambda x: x IS NOT NULL), ',') AS changed FROM r""",
)
def filename_inference(spark, folder):
    """Blank titles and artists filled from file names."""
    return claims.inferred_metadata(load(spark, folder, "tracks"))


# --- numbers ---------------------------------------------------------------------------------------------------------

_UNIT = "greatest(0::DOUBLE, least(1::DOUBLE, {x}))"
_DANCE = "(CASE WHEN bpm IS NULL THEN 0 ELSE greatest(0::DOUBLE, least(1::DOUBLE, CASE WHEN bpm < 90 THEN (bpm - 60) / 30.0::DOUBLE WHEN bpm <= 130 THEN 1 ELSE (170 - bpm) / 40.0::DOUBLE END)) END)"


@query("fn_tempo_dance", f"WITH {_FEATURES} SELECT track_id, round({_DANCE}, 6) AS dance FROM feats")
def fn_tempo_dance(spark, folder):
    """How danceable every tempo is."""
    return _features(spark, folder).select("track_id", F.round(N.tempo_dance_score(F.col("bpm")), 6).alias("dance"))


@query(
    "fn_derived_features",
    f"""WITH {_FEATURES}, e AS (SELECT *, CASE WHEN energy IS NOT NULL THEN {_UNIT.format(x='energy / 0.20::DOUBLE')} END AS en,
          CASE WHEN dynamic_range IS NOT NULL THEN {_UNIT.format(x='dynamic_range * 100 / 5000.0::DOUBLE')} END AS br FROM feats),
        a AS (SELECT *, 0.45::DOUBLE * en + 0.35::DOUBLE * {_UNIT.format(x='aggression')} + 0.20::DOUBLE * {_UNIT.format(x='brightness')} AS ag,
          0.45::DOUBLE * {_DANCE} + 0.35::DOUBLE * {_UNIT.format(x='danceability')} + 0.20::DOUBLE * en AS da, aggression IS NULL OR brightness IS NULL AS na, danceability IS NULL AS nd FROM e)
        SELECT track_id, round(en, 9) AS energy, round(br, 9) AS brightness, CASE WHEN NOT na THEN round({_UNIT.format(x='ag')}, 9) + CASE WHEN en IS NULL THEN NULL ELSE 0 END END AS aggression,
          CASE WHEN NOT nd THEN round({_UNIT.format(x='da')}, 9) + CASE WHEN en IS NULL THEN NULL ELSE 0 END END AS danceability FROM a""",
)
def fn_derived_features(spark, folder):
    """The formulas for energy, brightness, aggression and danceability, with stored features in place of frame statistics."""
    f = _features(spark, folder)
    made = N.derived_features(F.col("energy"), F.col("dynamic_range") * 100, F.col("aggression"), F.col("brightness"), F.col("danceability"), F.col("bpm"))
    return f.select("track_id", *[F.round(c, 9).alias(n) for n, c in made.items()])


_MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
_MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]


@query(
    "fn_estimate_key",
    f"""WITH c AS (SELECT vec_id, list_transform(embedding[1:12], lambda x: abs(x)::DOUBLE) AS c FROM embeddings),
        k AS (SELECT root, mode, CASE WHEN mode = 'major' THEN {_MAJOR}::DOUBLE[] ELSE {_MINOR}::DOUBLE[] END AS p FROM range(12) t(root), (VALUES ('major'), ('minor')) m(mode)),
        s AS (SELECT vec_id, root, mode, list_sum(list_transform(range(12), lambda i: c[i + 1] * p[((i - root + 12) % 12) + 1])) AS s FROM c, k)
        SELECT vec_id, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][root + 1] AS key, mode FROM s
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, root, mode) = 1""",
)
def fn_estimate_key(spark, folder):
    """The key of a chroma profile, here the sizes of the first twelve numbers of each vector."""
    rows = load(spark, folder, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x.cast("double"))).alias("c"))
    return rows.select("vec_id", N.estimate_key(F.col("c")).alias("k")).select("vec_id", "k.key", "k.mode")


@query(
    "fn_chunk_windows",
    """WITH t AS (SELECT id, duration_sec AS d, greatest(ceil(duration_sec / 60.0), 1)::INT AS n FROM tracks WHERE duration_sec > 0),
       w AS (SELECT DISTINCT id, d, CASE WHEN least(n, 5) <= 1 THEN 0 ELSE round_even(i * (n - 1) / (least(n, 5) - 1)::DOUBLE, 0)::INT END AS k FROM t, range(5) r(i) WHERE i < least(n, 5))
       SELECT id, k * 60.0::DOUBLE AS start, round(least(60.0, d - k * 60.0)::DOUBLE, 6) AS length FROM w""",
)
def fn_chunk_windows(spark, folder):
    """Up to five evenly spread minutes of every track."""
    rows = load(spark, folder, "tracks").select("id", F.explode(N.chunk_windows(F.col("duration_sec"), 60.0, 5)).alias("w"))
    return rows.select("id", "w.start", F.round("w.length", 6).alias("length"))


_NEXT = "embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


@query(
    "fn_semantic_relevance",
    f"""SELECT a.vec_id, round(greatest(0, least(1, (list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) - 0.15) / 0.60)), 6) AS relevance FROM {_NEXT}""",
)
def fn_semantic_relevance(spark, folder):
    """Cosine of neighbouring vectors as a relevance."""
    rows = load(spark, folder, "embeddings").select("vec_id", "embedding")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(after, "vec_id").select("vec_id", F.round(N.semantic_relevance(N.cosine(F.col("embedding"), F.col("other"))), 6).alias("relevance"))


@query(
    "fn_feature_similarity",
    f"""WITH {_FEATURES}, p AS (SELECT DISTINCT track_a, track_b FROM match_reports WHERE track_a <> track_b)
        SELECT track_a, track_b, round(1 - least(abs(a.bpm - b.bpm) / 80.0, 1), 6) + CASE WHEN a.bpm IS NULL OR b.bpm IS NULL THEN NULL ELSE 0 END AS bpm,
        round(1 - least(abs(a.energy - b.energy), 1), 6) + CASE WHEN a.energy IS NULL OR b.energy IS NULL THEN NULL ELSE 0 END AS energy
        FROM p JOIN feats a ON a.track_id = track_a JOIN feats b ON b.track_id = track_b""",
)
def fn_feature_similarity(spark, folder):
    """How near tempo and energy of every reported pair are."""
    f = _features(spark, folder).select("track_id", "bpm", "energy")
    pairs = load(spark, folder, "match_reports").where("track_a <> track_b").select("track_a", "track_b").distinct()
    both = pairs.join(f.toDF("track_a", "b1", "e1"), "track_a").join(f.toDF("track_b", "b2", "e2"), "track_b")
    near = [F.round(N.feature_similarity(n, F.col(x), F.col(y)), 6).alias(n) for n, x, y in (("bpm", "b1", "b2"), ("energy", "e1", "e2"))]
    return both.select("track_a", "track_b", *near)


@query("fn_frames_agree", "SELECT event_id, bit_count(xor(user_id, event_id)) <= 2 AS agree FROM events")
def fn_frames_agree(spark, folder):
    """Whether two numbers differ in at most two bits."""
    return load(spark, folder, "events").select("event_id", N.frames_agree(F.col("user_id"), F.col("event_id")).alias("agree"))


@query("fn_packed_frames", """WITH x AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
       SELECT vec_id, CAST(pos AS INTEGER) AS pos, CAST(floor((x + 8) * 1000000) AS BIGINT) AS frame FROM x""")  # fmt: skip
def fn_packed_frames(spark, folder):
    """Frames packed into bytes and read back."""
    frames = F.transform("embedding", lambda x: F.floor((x + F.lit(8).cast("float")) * F.lit(1000000).cast("float")).cast("bigint"))
    rows = load(spark, folder, "embeddings").select("vec_id", matching.packed_frames(frames).alias("b"), F.size("embedding").alias("n"))
    return rows.select("vec_id", F.posexplode(matching.unpacked_frames(F.col("b"), F.col("n"))).alias("pos", "frame"))


_FAST = ["breakcore", "dnb", "drum and bass", "drum n bass", "drum bass", "drum&bass", "gabber", "happy hardcore", "hard techno", "hardcore techno", "hardstyle", "jungle", "speedcore"]
_DOUBLED = ["boom bap", "conscious", "downtempo", "g funk", "gangsta", "hip hop", "hiphop", "instrumental hip hop", "rap", "screw", "thug rap", "trip hop"]


def _named(phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains(said, ' {p} ')" for p in phrases) + ")"


@query(
    "fn_styled_tempo",
    rf"""WITH {_FEATURES}, s AS (SELECT f.track_id, f.bpm, coalesce(' ' || regexp_replace(lower(t.genre), '[\s_/-]+', ' ', 'g') || ' ', '') AS said FROM feats f JOIN tracks t ON t.id = f.track_id)
        SELECT track_id, round(CASE WHEN bpm IS NULL OR bpm <= 0 THEN NULL WHEN bpm >= 168 AND NOT {_named(_FAST)} THEN bpm / 2
          WHEN bpm >= 145 AND NOT {_named(_FAST)} AND {_named(_DOUBLED)} THEN bpm / 2 WHEN bpm < 62 THEN bpm * 2 ELSE bpm END, 6) AS tempo FROM s""",
)
def fn_styled_tempo(spark, folder):
    """The felt tempo, with styles that are fast by nature or measured at double speed told by the genre."""
    genres = load(spark, folder, "tracks").select(F.col("id").alias("track_id"), "genre")
    return _features(spark, folder).join(genres, "track_id").select("track_id", N.perceived_tempo(F.col("bpm"), F.col("genre")).alias("tempo"))


@query(
    "fn_completeness",
    """SELECT id, round(least(((title IS NOT NULL)::INT + (artist IS NOT NULL)::INT + (album IS NOT NULL)::INT + (genre IS NOT NULL)::INT) / 3.0, 1), 6)::DOUBLE AS completeness FROM tracks""",
)
def fn_completeness(spark, folder):
    """How many of four fields a track has, as a share of three."""
    present = [F.col(c).isNotNull() for c in ("title", "artist", "album", "genre")]
    return load(spark, folder, "tracks").select("id", F.round(N.completeness(present, 3), 6).alias("completeness"))


# --- claims, evaluation, search helpers ------------------------------------------------------------------------------


@query(
    "claims_reselected",
    f"""WITH said AS (SELECT id AS track_id, unnest([struct_pack(f := 'title', v := title), struct_pack(f := 'artist', v := artist), struct_pack(f := 'album', v := album),
         struct_pack(f := 'genre', v := genre), struct_pack(f := 'date', v := date)], recursive := true) FROM tracks),
       fields AS (SELECT track_id, f AS field_name, lower({_strip('v')}) AS n FROM said WHERE {_strip('v')} <> ''),
       agree AS (SELECT c.id, c.track_id, c.field_name, c.confidence, c.created_at FROM track_metadata_claims c JOIN fields f ON c.track_id = f.track_id AND c.field_name = f.field_name AND lower({_strip('c.value_text')}) = f.n),
       best AS (SELECT track_id, field_name, id FROM agree QUALIFY row_number() OVER (PARTITION BY track_id, field_name ORDER BY coalesce(confidence, 0) DESC, created_at DESC NULLS LAST, id DESC) = 1)
       SELECT c.id, c.track_id, c.field_name, b.id IS NOT NULL AS selected FROM track_metadata_claims c LEFT JOIN best b ON c.id = b.id
       UNION ALL SELECT 'claim_' || substr(sha1(f.track_id || chr(0) || f.field_name || chr(0) || f.n || chr(0) || 'existing_database'), 1, 32), f.track_id, f.field_name, true
         FROM fields f ANTI JOIN best USING (track_id, field_name)""",
)
def claims_reselected(spark, folder):
    """All claims with the selected one set anew, fallback claims added."""
    return claims.selected_claims(load(spark, folder, "tracks"), load(spark, folder, "track_metadata_claims")).select("id", "track_id", "field_name", "selected")


@query(
    "eval_tag_agreement",
    f"""WITH {_FEATURES}, {_TAGS}, {_RESULTS}, w AS (SELECT track_id, flatten(list(regexp_extract_all(replace(replace(lower(tag), '---', ' '), '_', ' '), '[a-z0-9]+'))) AS w FROM tags GROUP BY track_id),
        j AS (SELECT search_id, coalesce(w, []) AS w FROM res LEFT JOIN w USING (track_id))
        SELECT search_id, round((max(list_contains(w, 'dark')::INT) + max(list_contains(w, 'slow')::INT)) / 2.0::DOUBLE, 6) AS coverage,
        round(avg(list_contains(w, 'aggressive')::INT), 6) AS avoid_rate FROM j GROUP BY search_id""",
)
def eval_tag_agreement(spark, folder):
    """How far the results of every logged search carry expected tags."""
    return evaluation.tag_agreement(evaluation.result_rows(load(spark, folder, "search_events")), _tags(spark, folder), ["dark", "slow"], ["aggressive"])


@query(
    "eval_result_order",
    f"""WITH {_RESULTS}, v AS (SELECT search_id, rank, duration_sec FROM res JOIN tracks ON tracks.id = res.track_id),
        s AS (SELECT search_id, coalesce(duration_sec - lag(duration_sec) OVER (PARTITION BY search_id ORDER BY rank) > 1e-9, false) AS bad FROM v)
        SELECT search_id, NOT bool_or(bad) AS sorted FROM s GROUP BY search_id""",
)
def eval_result_order(spark, folder):
    """Whether the results of every logged search run from long to short."""
    results = evaluation.result_rows(load(spark, folder, "search_events"))
    lengths = load(spark, folder, "tracks").select(F.col("id").alias("track_id"), "duration_sec")
    return evaluation.is_sorted(results.join(lengths, "track_id"), "duration_sec")


@query(
    "typo_suggestions",
    """WITH v AS (SELECT word, bool_or(curated) AS curated FROM (SELECT DISTINCT unnest(regexp_extract_all(replace(replace(lower(name), '---', ' '), '_', ' '), '[a-z0-9]+')) AS word, false AS curated FROM genre_terms
         UNION ALL SELECT unnest(['ambient', 'techno', 'party']), true) GROUP BY word),
       d AS (SELECT t.term, v.word, v.curated, levenshtein(v.word, t.term) AS d FROM v, (SELECT unnest(['tecno', 'ambeint', 'shoegaz']) AS term) t WHERE v.word <> t.term AND abs(length(v.word) - length(t.term)) <= 2),
       c AS (SELECT term, word, round(least(1 - d / greatest(length(word), length(term))::DOUBLE + CASE WHEN curated THEN 0.12 ELSE 0 END, 0.98::DOUBLE), 6) AS confidence FROM d WHERE d <= 1 OR (d = 2 AND curated))
       SELECT term, word AS suggestion, confidence FROM c WHERE confidence >= 0.70 QUALIFY row_number() OVER (PARTITION BY term ORDER BY confidence DESC, word) = 1""",
)
def typo_suggestions(spark, folder):
    """Corrections of misspelt query words from the genres of the library."""
    terms = load(spark, folder, "genre_terms").select(F.explode(X.tag_terms(F.col("name"))).alias("term")).distinct()
    return retrieval.typo_candidates(["tecno", "ambeint", "shoegaz"], terms, ["ambient", "techno", "party"])
