"""The public commands as functions of a catalogue: one place to look for what a user can run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crateline.operators import browse, claims, derive, duplicates, ingest, matching, ranking, retrieval, statistics
from crateline.plans.intent import Intent, explain, parse_query
from crateline.sources import files, sinks
from crateline.sources.tables import load


@dataclass
class Catalogue:
    """A folder of catalogue tables. Derived tables are computed from it and written by the caller where they shall stay."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.folder, name)

    @property
    def tracks(self) -> DataFrame:
        return self.table("tracks")

    @property
    def features(self) -> DataFrame:
        return derive.one_row_per_track(self.table("audio_features"))

    def info(self) -> dict[str, int | None]:
        return sinks.table_counts({n: self.table(n) for n in ("tracks", "audio_features", "feedback", "search_events")})

    def scan(self, music: str) -> DataFrame:
        """Changes between the stored tracks and the files below a folder."""
        return ingest.scan_diff(files.scan_folder(self.spark, music), self.tracks)

    def browse(self, query: str = "", folder: str | None = None, **options) -> DataFrame:
        return browse.page(self.tracks, query, folder, **options)

    def folders(self, folder: str) -> DataFrame:
        return browse.child_folders(self.tracks, folder)

    def failed(self) -> DataFrame:
        return browse.failed_tracks(self.tracks)

    def missing(self) -> DataFrame:
        return browse.missing_tracks(self.tracks, self.table("library_roots"))

    def prune_missing(self, children: dict[str, str]) -> dict[str, DataFrame]:
        return ingest.prune_missing(self.tracks, {n: (self.table(n), key) for n, key in children.items()})

    def health(self) -> DataFrame:
        return statistics.coverage(self.tracks, {n: self.table(n) for n in ("audio_features", "track_metadata_claims")})

    def repair_metadata(self) -> DataFrame:
        return claims.inferred_metadata(browse.blank_fields(self.tracks, ["title", "artist"]))

    def tags(self) -> DataFrame:
        return derive.feature_tags(self.features)

    def context_fit(self) -> DataFrame:
        return derive.context_fit(self.features)

    def profiles(self) -> DataFrame:
        return derive.profiles(self.tracks, self.features, self.tags(), self.context_fit())

    def duplicates(self, tolerance: float = 2.0) -> DataFrame:
        return duplicates.duplicate_groups(self.tracks, tolerance)

    def compare(self, a: str, b: str) -> DataFrame:
        pair = self.spark.createDataFrame([(a, b)], "track_a string, track_b string")
        return matching.reports(pair, self.tracks, self.features)

    def match(self, track: str, limit: int = 10) -> DataFrame:
        return matching.closest_matches(track, self.tracks, self.features, limit)

    def parse(self, query: str) -> Intent:
        return parse_query(query)

    def plan(self, query: str) -> dict:
        return explain(parse_query(query))

    def search_text(self, query: str, limit: int = 10) -> DataFrame:
        found = retrieval.bm25(self.profiles(), "track_id", "profile_text", parse_query(query).terms, every=True)
        return retrieval.reciprocal_ranks(found, limit)

    def search_semantic(self, vector: list[float], limit: int = 10) -> DataFrame:
        return retrieval.cosine_top(self.table("embeddings"), "vec_id", "embedding", vector, limit)

    def search(self, query: str, limit: int | None = None) -> DataFrame:
        """Ranked results with explanations."""
        tags = self.tags()
        library = ranking.Library(
            self.tracks, self.features, tags, self.context_fit(), self.profiles(), self.table("feedback"), self.table("search_events")
        )
        points = {r["field"]: r.asDict() for r in statistics.feature_percentiles(self.features).collect()}
        weights = [(r["tag"], r["tracks"] + r["avg_score"]) for r in statistics.tag_statistics(tags).collect()]
        found = ranking.search(library, parse_query(query, points, weights, limit))
        return found.withColumns({"confidence": ranking.confidence_label(), "reasons": ranking.explanations()})

    def feedback(self) -> DataFrame:
        return retrieval.feedback_summary(self.table("feedback"))

    def export(self, results: DataFrame, folder: str, form: str = "m3u") -> None:
        {"m3u": sinks.write_m3u, "csv": sinks.write_csv, "json": sinks.write_json}[form](results, folder)


#: What people type for a rating.
RATINGS = {"good": 1, "up": 1, "+": 1, "yes": 1, "neutral": 0, "ok": 0, "skip": 0, "bad": -1, "down": -1, "-": -1, "no": -1}


def rating(text: str) -> int:
    """-1, 0 or 1 from a word or number."""
    word = text.strip().lower()
    if word in RATINGS:
        return RATINGS[word]
    return max(-1, min(1, int(word)))


def rating_row(spark: SparkSession, id_: str, search: str | None, track: str, value: str, note: str | None = None) -> DataFrame:
    """One feedback row, to be appended to the log."""
    row = spark.createDataFrame([(id_, search, track, rating(value), note)], "id string, search_event_id string, track_id string, rating int, note string")
    return row.withColumns({"created_at": F.current_timestamp(), "ingested_at": F.current_timestamp()})
