"""Filling fixed-capacity containers with items of varying size.

The packing is planned on the histogram of sizes alone, which has at most
``capacity`` rows whatever the number of items. Patterns of few items whose
sizes add up to the capacity are enumerated, non-negative least squares fits how
often each should be repeated so that together they use up the histogram, the
counts are rounded down, and what is left is packed pattern by pattern, the
largest size first with the best fitting rest. The plan is then carried out in
one distributed pass: the items of a size are numbered and the number tells the
pattern and the copy.

Numbering never gathers a size in one task: items are counted per size and
bucket, buckets get offsets, and each bucket numbers its own.

Defined results: an item larger than the capacity is cut into full pieces and a
rest; items of size 0 go to the first container; items with a NULL size count as
size 0; an empty table needs no container.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crateline.session import cut_lineage


@dataclass
class Plan:
    """Patterns with the number of their copies: ``patterns[k]`` maps a size to how many a container takes."""

    capacity: int
    patterns: list[dict[int, int]] = field(default_factory=list)
    copies: list[int] = field(default_factory=list)

    @property
    def containers(self) -> int:
        return sum(self.copies)

    def add(self, pattern: dict[int, int], copies: int) -> None:
        if copies > 0:
            self.patterns.append(pattern)
            self.copies.append(copies)

    def places(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each size: first numbers, items per container and first containers of its intervals."""
        rows: dict[int, list[tuple[int, int, int]]] = {}
        used: dict[int, int] = {}
        base = 0
        for pattern, copies in zip(self.patterns, self.copies, strict=True):
            for size, times in pattern.items():
                rows.setdefault(size, []).append((used.get(size, 0), times, base))
                used[size] = used.get(size, 0) + times * copies
            base += copies
        return {s: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for s, r in rows.items()}


def enumerate_patterns(sizes: np.ndarray, counts: np.ndarray, capacity: int, per_size: int = 6) -> list[dict[int, int]]:
    """Patterns of few items that fill the capacity exactly, or nearly where no exact one is met.

    For each size, up to ``per_size`` patterns hold it one or more times, then
    take evenly spread other sizes by falling size, and close with the largest
    size that fits the rest.
    """
    order = np.sort(sizes)
    patterns: dict[tuple, dict[int, int]] = {}
    total = counts.sum()
    weights = np.cumsum(counts[np.argsort(sizes)]) / total
    for size in order[::-1]:
        for k in range(per_size):
            rest, pattern = capacity - int(size), {int(size): 1}
            step = 0
            while rest >= order[0] and step < 64:
                # a size drawn from the quantiles of the histogram, so that fillers are used as they occur
                want = (0.5 + 0.381966 * (step + 1) * (k + 1) + 0.137 * int(size)) % 1.0
                filler = int(order[np.searchsorted(weights, want)])
                fit = int(np.searchsorted(order, rest, side="right")) - 1
                if filler > rest or rest - filler < order[0] and rest != filler:
                    filler = int(order[fit])
                pattern[filler] = pattern.get(filler, 0) + 1
                rest -= filler
                step += 1
            patterns[tuple(sorted(pattern.items()))] = pattern
    return list(patterns.values())


def fit_copies(patterns: list[dict[int, int]], sizes: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: copies x >= 0 minimising |A x - counts|, by accelerated projected gradient.

    Column p of A holds how many items of each size pattern p takes.
    """
    row = {int(s): i for i, s in enumerate(sizes)}
    ri = np.array([row[s] for p in patterns for s in p])
    ci = np.array([k for k, p in enumerate(patterns) for _ in p])
    av = np.array([n for p in patterns for n in p.values()], dtype=float)
    scale = max(float(counts.max()), 1.0)
    b = counts / scale
    n_rows, n_cols = len(sizes), len(patterns)

    def forward(x):
        return np.bincount(ri, weights=av * x[ci], minlength=n_rows)

    def backward(r):
        return np.bincount(ci, weights=av * r[ri], minlength=n_cols)

    v = np.ones(n_cols)
    for _ in range(30):  # largest eigenvalue of A'A by power iteration, for the step length
        v = backward(forward(v))
        v /= np.linalg.norm(v)
    lipschitz = float(v @ backward(forward(v))) * 1.01
    x = y = np.zeros(n_cols)
    t = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0.0, y - backward(forward(y) - b) / lipschitz)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x * scale


def _fill_rest(plan: Plan, left: dict[int, int]) -> None:
    """Pack a histogram by repeating patterns: the largest size, then always the largest that fits."""
    while left:
        sizes = sorted(left, reverse=True)
        pattern, rest = {}, plan.capacity
        for size in sizes:
            if size > rest:
                continue
            times = min(rest // size, left[size])
            pattern[size] = times
            rest -= times * size
        copies = min(left[s] // n for s, n in pattern.items())
        plan.add(pattern, copies)
        for s, n in pattern.items():
            left[s] -= n * copies
            if not left[s]:
                del left[s]


def plan_packing(histogram: dict[int, int], capacity: int) -> Plan:
    """The packing of a histogram {size: count} with sizes in 1..capacity."""
    plan = Plan(capacity)
    left = {int(s): int(n) for s, n in histogram.items() if n > 0 and s > 0}
    if left:
        sizes = np.array(sorted(left), dtype=np.int64)
        counts = np.array([left[int(s)] for s in sizes], dtype=float)
        patterns = enumerate_patterns(sizes, counts, capacity)
        wished = np.floor(fit_copies(patterns, sizes, counts) + 1e-9).astype(np.int64)
        unused = capacity - np.array([sum(s * n for s, n in p.items()) for p in patterns])
        for k in np.lexsort((-wished, unused)):
            pattern = patterns[k]
            copies = min(int(wished[k]), *(left.get(s, 0) // n for s, n in pattern.items()))
            if copies <= 0:
                continue
            plan.add(pattern, copies)
            for s, n in pattern.items():
                left[s] -= n * copies
                if not left[s]:
                    del left[s]
        _fill_rest(plan, left)
    return plan


def cut_items(items: DataFrame, capacity: int) -> DataFrame:
    """(item_id, piece, start, size): items as they are, or cut into full pieces and a rest if above capacity."""
    size = F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)).cast("bigint")
    pieces = F.greatest(F.ceil(size / F.lit(capacity)), F.lit(1)).cast("int")
    cut = items.select("item_id", size.alias("total"), F.explode(F.sequence(F.lit(1), pieces)).alias("piece"))
    start = (F.col("piece") - 1).cast("bigint") * capacity
    return cut.select("item_id", "piece", start.alias("start"), F.least(F.col("total") - start, F.lit(capacity)).alias("size"))


def pack(items: DataFrame, capacity: int, buckets: int | None = None) -> DataFrame:
    """(item_id, piece, start, size, container) for items (item_id, size)."""
    spark = items.sparkSession
    buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    bucket = F.pmod(F.xxhash64("item_id", "piece"), F.lit(buckets)).cast("int")
    pieces = cut_lineage(cut_items(items, capacity).withColumn("bucket", bucket))
    cells = pieces.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["size"]: r["n"] for r in cells.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    plan = plan_packing(histogram, capacity)
    places = plan.places()

    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("size", "bucket").orderBy("item_id", "piece")
    numbered = (
        pieces.where(F.col("size") > 0)
        .withColumn("rn", F.row_number().over(own) - 1)
        .join(offsets, ["size", "bucket"])
        .withColumn("number", F.col("offset") + F.col("rn"))
    )

    @F.pandas_udf("bigint")
    def container(size: pd.Series, number: pd.Series) -> pd.Series:
        out = np.zeros(len(size), dtype=np.int64)
        sizes, numbers = size.to_numpy(), number.to_numpy()
        for s in np.unique(sizes):
            here = np.flatnonzero(sizes == s)
            starts, times, bases = places[int(s)]
            k = np.searchsorted(starts, numbers[here], side="right") - 1
            out[here] = bases[k] + (numbers[here] - starts[k]) // times[k]
        return pd.Series(out)

    placed = numbered.select("item_id", "piece", "start", "size", container("size", "number").alias("container"))
    blank = pieces.where(F.col("size") == 0).select("item_id", "piece", "start", "size", F.lit(0).cast("bigint").alias("container"))
    return placed.unionByName(blank)
