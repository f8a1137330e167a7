"""Search quality: judged metrics per query, structured checks and their aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crateline.functions.text import tag_terms


def result_rows(events: DataFrame) -> DataFrame:
    """(search_id, query, rank, track_id) of logged searches with a readable result list."""
    ids = F.from_json("result_track_ids_json", "array<string>")
    rows = events.select(F.col("id").alias("search_id"), "query", F.posexplode(ids).alias("p", "track_id"))
    return rows.select("search_id", "query", (F.col("p") + 1).alias("rank"), "track_id")


def judged_precision(results: DataFrame, judged: DataFrame, k: int = 5) -> DataFrame:
    """(search_id, returned, relevant, precision, reciprocal_rank) against judged (search_id, track_id, rating)."""
    good = judged.where(F.col("rating") > 0).select("search_id", "track_id").distinct().withColumn("good", F.lit(1))
    top = results.where(F.col("rank") <= k).join(good, ["search_id", "track_id"], "left")
    return top.groupBy("search_id").agg(
        F.count(F.lit(1)).alias("returned"),
        F.count("good").alias("relevant"),
        F.round(F.count("good") / F.count(F.lit(1)), 6).alias("precision"),
        F.round(F.coalesce(F.max(F.when(F.col("good") == 1, 1.0 / F.col("rank"))), F.lit(0.0)), 6).alias("reciprocal_rank"),
    )


def diversity(results: DataFrame, tracks: DataFrame) -> DataFrame:
    """(search_id, artists, duplicate_rate): distinct artists and the share of results that repeat artist and title."""
    t = tracks.select(F.col("id").alias("track_id"), F.lower(F.trim("artist")).alias("a"), F.lower(F.trim("title")).alias("t"))
    rows = results.join(t, "track_id")
    distinct = F.count_distinct(F.concat_ws("\x1f", F.coalesce("a", F.lit("")), F.coalesce("t", F.lit(""))))
    return rows.groupBy("search_id").agg(
        F.count_distinct("a").alias("artists"), F.round(1.0 - distinct / F.count(F.lit(1)), 6).alias("duplicate_rate")
    )


def tag_agreement(results: DataFrame, tags: DataFrame, expected: list[str], avoided: list[str]) -> DataFrame:
    """(search_id, coverage, avoid_rate): expected tags met by any result, and results with an avoided tag."""
    own = tags.groupBy("track_id").agg(F.array_distinct(F.flatten(F.collect_list(tag_terms(F.col("tag"))))).alias("w"))
    rows = results.join(own, "track_id", "left").withColumn("w", F.coalesce("w", F.array().cast("array<string>")))
    met = [F.max(F.array_contains("w", t.lower()).cast("int")) for t in expected]
    coverage = sum(met[1:], met[0]) / float(len(met)) if met else F.lit(0.0)
    bad = F.lit(False)
    for t in avoided:
        bad = bad | F.array_contains("w", t.lower())
    return rows.groupBy("search_id").agg(F.round(coverage, 6).alias("coverage"), F.round(F.avg(bad.cast("int")), 6).alias("avoid_rate"))


def is_sorted(results: DataFrame, value: str, descending: bool = True, tolerance: float = 1e-9) -> DataFrame:
    """(search_id, sorted): whether a value runs in order along the ranks."""
    before = F.lag(value).over(Window.partitionBy("search_id").orderBy("rank"))
    step = (F.col(value) - before) if descending else (before - F.col(value))
    return results.withColumn("_bad", F.coalesce(step > tolerance, F.lit(False))).groupBy("search_id").agg((~F.bool_or("_bad")).alias("sorted"))


def checks(rows: list[tuple[str, str, bool, str]]) -> list[dict]:
    """Check rows (case, check, passed, issue) as records."""
    return [{"case": c, "check": k, "passed": p, "issue_type": None if p else i} for c, k, p, i in rows]


def check_query(case: dict, outcome: dict) -> list[dict]:
    """The structured checks that a case asks for, against an outcome {mode, role, sorts, results, sources}."""
    want, top = case.get("expectations", {}), outcome.get("results", [])[: case.get("expectations", {}).get("top_k", 10)]
    said = [" ".join(str(r.get(k) or "") for k in ("title", "artist", "album", "genre", "tags")).lower() for r in top]
    out = []

    def add(name: str, passed: bool, issue: str) -> None:
        out.append((str(case.get("id", "")), name, bool(passed), issue))

    if "expected_mode" in want:
        add("expected_mode", outcome.get("mode") == want["expected_mode"], "wrong_mode")
    if "semantic_role" in want:
        add("semantic_role", outcome.get("role") == want["semantic_role"], "wrong_role")
    if "sort_by" in want:
        wanted = (want["sort_by"]["field"], want["sort_by"]["direction"])
        add("intent_sort_by", wanted in [tuple(s) for s in outcome.get("sorts", [])], "wrong_sort")
        values = [r.get(wanted[0]) for r in top]
        add("sort_feature_present", all(v is not None for v in values), "missing_sort_value")
        known = [v for v in values if v is not None]
        add("result_sort_order", known == sorted(known, reverse=wanted[1] == "desc"), "wrong_order")
    if "must_match_any" in want:
        add("must_match_any", any(w.lower() in s for w in want["must_match_any"] for s in said), "no_match")
    if "must_match_all" in want:
        add("must_match_all", all(any(w.lower() in s for w in want["must_match_all"]) for s in said), "unmatched_result")
    if "must_not_top" in want:
        add("must_not_top", not any(w.lower() in s for w in want["must_not_top"] for s in said), "unwanted_result")
    if "must_not_warnings_top" in want:
        add("must_not_warnings_top", not any(w in r.get("warnings", ()) for w in want["must_not_warnings_top"] for r in top), "warning_in_results")
    if "rank_reason_primary_top" in want:
        add("rank_reason_primary_top", bool(top) and top[0].get("reason") == want["rank_reason_primary_top"], "wrong_reason")
    if "must_have_evidence_sources_top" in want:
        add("must_have_evidence_sources_top", all(set(want["must_have_evidence_sources_top"]) <= set(r.get("sources", ())) for r in top), "missing_evidence")
    return checks(out)


def check_match(case: dict, report: dict) -> list[dict]:
    """The checks of a pair case against a match report."""
    want, out = case.get("expectations", {}), []
    for name in ("decision", "identity_decision", "confidence"):
        if name in want:
            out.append((str(case.get("id", "")), name, report.get(name) == want[name], f"wrong_{name}"))
    if "min_confidence_score" in want:
        out.append((str(case.get("id", "")), "min_confidence_score", (report.get("confidence_score") or 0) >= want["min_confidence_score"], "low_confidence"))
    if "must_have_evidence" in want:
        have = {k for k, v in report.items() if isinstance(v, dict) and v.get("status") in ("match", "same", "similar", "partial")}
        out.append((str(case.get("id", "")), "must_have_evidence", set(want["must_have_evidence"]) <= have, "missing_evidence"))
    if "must_have_warnings" in want:
        out.append((str(case.get("id", "")), "must_have_warnings", set(want["must_have_warnings"]) <= set(report.get("warnings") or ()), "missing_warning"))
    if want.get("must_not_decide_identity"):
        out.append((str(case.get("id", "")), "must_not_decide_identity", report.get("identity_decision") != "same", "decided_identity"))
    return checks(out)


def summary(check_rows: DataFrame) -> DataFrame:
    """(check, cases, passed, pass_rate) over check rows."""
    return check_rows.groupBy("check").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed"), F.round(F.avg(F.col("passed").cast("int")), 6).alias("pass_rate")
    )
