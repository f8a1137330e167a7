"""The best representative of each duplicate group.

Records are ranked by a window ordering with a full, deterministic tie-break
and the top record of each group is kept. The filter ``row_number <= 1`` lets
Spark cut each partition down to one candidate per group before the shuffle
(``WindowGroupLimit``), and group sizes are counted with map-side combining, so
a group holding a third of all rows moves a handful of rows.

Defined results: records with a NULL key belong to no group; a group without a
usable record has no survivor; equal records differ by the last ordering, the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crateline.operators.bounded import collect_if_small

#: What people and programs write where a value is missing, in several languages, lower case.
MISSING_WORDS = (
    "unknown", "<unknown>", "[unknown]", "(unknown)", "unknown artist", "unknown title", "unknown album",
    "n/a", "n.a.", "na", "n.a", "#n/a", "null", "(null)", "none", "(none)", "nil", "nan", "undefined", "not set",
    "not available", "not known", "no value", "no data", "missing", "empty value", "(empty)", "tba", "tbd", "t.b.a.",
    "t.b.d.", "inconnu", "inconnue", "artiste inconnu", "titre inconnu", "sans titre", "aucun", "aucune",
    "unbekannt", "unbekannter künstler", "ohne titel", "kein wert", "nicht gesetzt", "k.a.", "desconocido",
    "desconocida", "artista desconocido", "sin título", "sin titulo", "ninguno", "desconhecido", "desconhecida",
    "sem título", "sconosciuto", "sconosciuta", "senza titolo", "onbekend", "okänd", "ukjent", "ukendt",
    "nieznany", "neznámý", "неизвестно", "неизвестен", "неизвестный", "不明", "未知", "알 수 없음",
)

_BLANKS = r"[\s\p{Z}\x{200B}\x{FEFF}]"


def is_usable(value: Column) -> Column:
    """Whether a text is a real value: not NULL, blank or a stand-in for a missing one."""
    text = F.lower(F.regexp_replace(value, rf"^{_BLANKS}+|{_BLANKS}+$", ""))
    stand_in = (text == "") | text.isin(list(MISSING_WORDS)) | text.rlike(r"^[-–—_.?*~#…\s/]+$")
    return value.isNotNull() & ~stand_in


def rank_survivors(df: DataFrame, keys: list[str], order: list[Column], min_rows: int = 1, usable: Column | None = None) -> DataFrame:
    """The first row of each group by ``order``, of groups with at least ``min_rows`` rows in all."""
    grouped = df.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)))
    candidates = grouped if usable is None else grouped.where(usable)
    ranked = candidates.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    best = ranked.where(F.col("_rank") <= 1).drop("_rank")
    if min_rows <= 1:
        return best
    sizes = grouped.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= min_rows)
    return best.join(sizes.drop("_rows"), keys, "left_semi")


def normalised_source(source: Column) -> Column:
    """A source name without regard to case, outer blanks and the kind of dash."""
    return F.replace(F.lower(F.regexp_replace(source, rf"^{_BLANKS}+|{_BLANKS}+$", "")), F.lit("-"), F.lit("_"))


def with_trust(claims: DataFrame, sources: DataFrame, max_sources: int = 10_000) -> DataFrame:
    """``claims`` with column ``_trust``: the trust in its source, -1 for unknown sources.

    The trust table is looked up in a literal map while it has at most
    ``max_sources`` rows, else by a join.
    """
    table = sources.groupBy(normalised_source(F.col("source")).alias("_source")).agg(F.max("trust").alias("_trust"))
    claims = claims.withColumn("_source", normalised_source(F.col("source")))
    rows = collect_if_small(table.where(F.col("_source").isNotNull()), max_sources)
    if rows is None:
        out = claims.join(table, "_source", "left")
        return out.withColumn("_trust", F.coalesce("_trust", F.lit(-1))).drop("_source")
    if not rows:
        return claims.withColumn("_trust", F.lit(-1)).drop("_source")
    trust = F.create_map(*[F.lit(x) for r in rows for x in (r[0], int(r[1] if r[1] is not None else -1))])
    return claims.withColumn("_trust", F.coalesce(F.try_element_at(trust, F.col("_source")), F.lit(-1))).drop("_source")


def claim_order() -> list[Column]:
    """Selected, confidence, trust, recency, length of the value, then the smaller id."""
    confidence = F.when(F.isnan("confidence") | ~F.col("confidence").between(0, 1), 0.0).otherwise(F.col("confidence"))
    return [
        F.coalesce(F.col("selected"), F.lit(False)).desc(),
        F.coalesce(confidence, F.lit(0.0)).desc(),
        F.col("_trust").desc(),
        F.col("created_at").desc_nulls_last(),
        F.length("value_text").desc(),
        F.col("id").asc(),
    ]


def surviving_claims(claims: DataFrame, sources: DataFrame, min_rows: int = 2) -> DataFrame:
    """One claim per track and field with ``min_rows`` or more claims, at least one of them usable."""
    wanted = ["track_id", "field_name", "id", "value_text", "source", "confidence", "selected", "created_at"]
    slim = with_trust(claims.select(*wanted), sources)
    return rank_survivors(slim, ["track_id", "field_name"], claim_order(), min_rows, is_usable(F.col("value_text")))


def surviving_records(claims: DataFrame, sources: DataFrame, fields: list[str]) -> DataFrame:
    """One record per track, built field by field from the surviving claims, with how many fields it has."""
    best = surviving_claims(claims, sources, 1)
    picked = [F.max(F.when(F.col("field_name") == f, F.col("value_text"))).alias(f) for f in fields]
    filled = F.sum(F.col("field_name").isin(fields).cast("int")).cast("bigint").alias("filled")
    return best.groupBy("track_id").agg(*picked, filled)
