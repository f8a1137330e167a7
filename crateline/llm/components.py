"""Consolidating pairwise matches into groups.

Minimum labels are propagated over the edges and shortened by pointer jumping.
A round takes, for each vertex, the smallest id among itself and its neighbours
as its parent, jumps parents until all trees are stars, and replaces every edge
by the edge between the parents of its ends, without loops and repetitions. Only
vertices smaller than all their neighbours are left, no two of them neighbours,
so at most half of the vertices stay, or all but one around a hub, which is the
next round's root. Every round's tables are written to the checkpoint folder
(their sizes and whether a label changed are observed while writing) and read
without the planner's estimates, which would double their digits with each jump.
The end is reached when no edge is left, that is when no label would change any
more. A parent is never larger than its child, so the last label of a vertex is
the smallest id of its group.

Defined results: pairs with a NULL end and pairs of a record with itself link
nothing; repeated and reversed pairs count once; an empty table has no groups.
A vertex with any share of all pairs is handled by map-side combined minima and
by ``skew.lookup``; no component is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from crateline.operators import skew
from crateline.operators.skew import hot_keys, lookup
from crateline.session import cut_lineage


def link_edges(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct edges (lo, hi), lo < hi."""
    a, b = F.col(left), F.col(right)
    return (
        pairs.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
        .distinct()
    )


def _parents(edges: DataFrame) -> DataFrame:
    """(vertex, parent): the smallest id in the closed neighbourhood of each vertex."""
    ends = F.explode(
        F.array(
            F.struct(F.col("hi").alias("vertex"), F.col("lo").alias("parent")),
            F.struct(F.col("lo").alias("vertex"), F.col("lo").alias("parent")),
        )
    )
    return edges.select(ends.alias("e")).groupBy("e.vertex").agg(F.min("e.parent").alias("parent"))


def _written(df: DataFrame, changed: Column | None = None) -> tuple[DataFrame, int, bool]:
    """(``df`` in the checkpoint folder, its rows, whether any row is ``changed``); the figures cost no job of their own."""
    seen = Observation()
    change = F.coalesce(F.max(F.coalesce(changed, F.lit(False)).cast("int")), F.lit(0)) if changed is not None else F.lit(0)
    kept = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("n"), change.alias("changed")), keep_estimate=False)
    return kept, seen.get["n"], bool(seen.get["changed"])


def _hot(df: DataFrame, rows: int, key: str) -> list:
    return hot_keys(df, key, min_rows=0) if rows >= skew.MIN_ROWS else []


def _jump(edges: DataFrame) -> tuple[DataFrame, int]:
    """The parents of all ends of edges, replaced by their parents until every tree is a star, and their number."""
    parents, rows, changed = _written(_parents(edges))
    changed = rows > 0
    while changed:
        hot = _hot(parents, rows, "parent")
        jumped = lookup(parents, "parent", parents.select("vertex", "parent"), "vertex", "parent", "grand", hot)
        jumped, _, changed = _written(jumped, F.col("grand") != F.col("parent"))
        parents = jumped.select("vertex", F.col("grand").alias("parent"))
    return parents, rows


def connected_groups(pairs: DataFrame, left: str, right: str, vertex: str = "vertex", group: str = "group_id") -> DataFrame:
    """(vertex, group): every linked record with the smallest id of its group."""
    edges, n_edges, _ = _written(link_edges(pairs, left, right))
    labels, n_labels = None, 0
    while n_edges:
        parents, n_parents = _jump(edges)
        if labels is None:
            labels, n_labels = parents, n_parents
        else:
            moved = lookup(labels, "parent", parents, "vertex", "parent", "_next", _hot(labels, n_labels, "parent"))
            labels = cut_lineage(moved.select("vertex", F.coalesce("_next", "parent").alias("parent")), keep_estimate=False)
        hot = _hot(edges, n_edges, "lo"), _hot(edges, n_edges, "hi")  # both from the written edges, not from a join
        ends = lookup(edges, "lo", parents, "vertex", "parent", "a", hot[0])
        ends = lookup(ends, "hi", parents, "vertex", "parent", "b", hot[1])
        edges, n_edges, _ = _written(link_edges(ends.select("a", "b"), "a", "b"))
    if labels is None:
        labels = edges.select(F.col("lo").alias("vertex"), F.col("hi").alias("parent"))
    return labels.select(F.col("vertex").alias(vertex), F.col("parent").alias(group))
