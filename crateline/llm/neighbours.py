"""The most similar vectors of every vector, by a permutation index.

Every vector is represented by its nearest pivots in order of distance. It is
posted in the inverted file of each pivot that is at most ``radius`` farther
than its nearest one. Two vectors within ``radius`` of each other therefore
always share a file: the pivot nearest to the middle between them is at most
``radius`` farther from either than its own nearest pivot. Within a file the
members are ranked for each vector by the footrule distance of the pivot
orders, the best are kept and reranked by their true distance. Those not kept are
reranked too where distances to a few members of the file cannot rule them out,
so the k nearest within the radius are found whole.

Pivots are a sample of the distinct vectors, about four times the square root
of their number and never more than ``MAX_PIVOTS``: a file that held a large
share of the vectors would almost surely hold a pivot inside it and be divided.
Equal vectors are indexed once, so copies cost nothing. A file of more than
``FILE_ROWS`` members is worked on in blocks of queries against blocks of
members, so none is gathered in one task, and nothing is dropped.

Defined results: a row is usable if both fields are JSON lists of exactly 13
finite numbers; other rows have no neighbours and are nobody's neighbour; equal
rows of a track count once; ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crateline.operators.partitions import spread
from crateline.operators.skew import lookup
from crateline.session import cut_lineage

#: Pivots at most, members of the order kept with a vector, members kept per file for the rerank, rows of a block.
MAX_PIVOTS, ORDER_LENGTH, KEPT, FILE_ROWS = 16_384, 8, 32, 8_192

#: Members of a file whose distances rule out what the footrule cut left aside.
GUIDES = 12

_NUMBER = r"\s*-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?\s*"


def number_list(text: Column, length: int) -> Column:
    """The numbers of a JSON list of exactly ``length`` finite numbers, else NULL."""
    valid = text.rlike(rf"^\s*\[{_NUMBER}(?:,{_NUMBER}){{{length - 1}}}\]\s*$")
    bare = F.regexp_replace(text, r"[\[\]\s]", "")
    numbers = F.split(bare, ",").cast("array<double>")
    finite = ~F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(valid & finite, numbers)


def timbre_vectors(features: DataFrame) -> DataFrame:
    """(id, vector) of the usable rows of ``audio_features``, equal rows of a track once."""
    mean, std = number_list(F.col("mfcc_mean_json"), 13), number_list(F.col("mfcc_std_json"), 13)
    rows = features.select(F.col("track_id").alias("id"), mean.alias("m"), std.alias("s"))
    usable = rows.where(F.col("id").isNotNull() & F.col("m").isNotNull() & F.col("s").isNotNull())
    return usable.select("id", F.concat("m", "s").alias("vector")).distinct()


def _rows(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(n, -1 if n else 0)


def choose_pivots(classes: DataFrame, count: int, max_pivots: int = MAX_PIVOTS) -> np.ndarray:
    """Pivots: the distinct vectors of smallest hash, about four times the root of their number."""
    wanted = min(max_pivots, max(16, math.ceil(4 * math.sqrt(count))))
    rows = classes.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(wanted).collect()
    return np.array([r[0] for r in rows], dtype=np.float64)


def post(classes: DataFrame, pivots: np.ndarray, radius: float, order_length: int = ORDER_LENGTH) -> DataFrame:
    """(class, vector, ranked, files): the order of the nearest pivots of each vector, and the files it is posted in."""
    middle = pivots.mean(axis=0)
    centred = (pivots - middle).astype(np.float32)
    norms = (centred**2).sum(axis=1)
    length = min(order_length, len(pivots))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 4_000_000 // len(centred))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = (_rows(part.column(1), np.float64) - middle).astype(np.float32)
                d2 = np.maximum((x**2).sum(axis=1)[:, None] + norms[None] - 2 * x @ centred.T, 0)
                near = np.argpartition(d2, length - 1, axis=1)[:, :length] if length < len(centred) else np.tile(np.arange(length), (len(x), 1))
                dist = np.take_along_axis(d2, near, axis=1)
                ranked = np.take_along_axis(near, np.lexsort((near, dist)), axis=1).astype(np.int32)
                reach = (np.sqrt(dist.min(axis=1)) * (1 + 1e-4) + radius + 0.05) ** 2
                row, file = np.nonzero(d2 <= reach[:, None])
                ends = np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, ranked.size + 1, length, dtype=np.int32)), pa.array(ranked.ravel())),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(file.astype(np.int32))),
                    ],
                    ["class", "vector", "ranked", "files"],
                )

    schema = "class string, vector array<double>, ranked array<int>, files array<int>"
    return spread(classes.select("class", "vector"), "class").mapInArrow(assign, schema)


def footrule_weights(ranked: np.ndarray, columns: int, index: np.ndarray) -> np.ndarray:
    """(columns, n) weights: length minus place of a pivot in a vector's order, 0 where it is absent."""
    n, length = ranked.shape
    weights = np.zeros((columns, n), dtype=np.uint8)
    weights[index, np.arange(n)[:, None]] = np.arange(length, 0, -1, dtype=np.uint8)[None]
    return weights


def search_file(
    q_ids: np.ndarray, q: np.ndarray, q_ranked: np.ndarray, x_ids: np.ndarray, x: np.ndarray, x_ranked: np.ndarray,
    k: int, radius: float, kept: int = KEPT,
) -> list[tuple[str, str, float]]:
    """(query, member, distance): the ``k`` nearest members within ``radius`` of each query, by footrule then distance.

    The ``kept`` best by footrule are reranked. The others are looked at again only
    where the triangle inequality leaves room for one of the ``k`` nearest, so the
    result does not depend on ``kept``.

    The footrule distance of two orders of length l is l(l+1) less twice the sum
    over common pivots of the smaller of their weights, so only that sum is computed.
    """
    pivots, index = np.unique(np.concatenate([q_ranked.ravel(), x_ranked.ravel()]), return_inverse=True)
    index = index.reshape(-1)
    q_index = index[: q_ranked.size].reshape(q_ranked.shape)
    weights = footrule_weights(x_ranked, len(pivots), index[q_ranked.size :].reshape(x_ranked.shape))
    own = np.arange(q_ranked.shape[1], 0, -1, dtype=np.uint8)[None, :, None]
    # distances to a few members: no two rows are nearer than these differ
    guides = x[np.linspace(0, len(x) - 1, min(GUIDES, len(x))).astype(int)]
    q_guide, x_guide = (np.sqrt(((y[:, None] - guides[None]) ** 2).sum(axis=2)).astype(np.float32) for y in (q, x))
    out: list[tuple[str, str, float]] = []
    step = max(1, 2_000_000 // max(1, len(x) * q_ranked.shape[1]))
    for at in range(0, len(q), step):
        common = np.minimum(weights[q_index[at : at + step]], own).sum(axis=1, dtype=np.uint16)
        n = len(common)
        if kept < len(x):
            best = np.argpartition(common, len(x) - kept, axis=1)[:, -kept:]
        else:
            best = np.tile(np.arange(len(x)), (n, 1))
        d = np.sqrt(((q[at : at + step, None, :] - x[best]) ** 2).sum(axis=2))
        other = q_ids[at : at + step, None] != x_ids[best]
        found = [(i, best[i, j], d[i, j]) for i, j in zip(*np.nonzero((d <= radius) & other), strict=True)]
        if kept < len(x):
            # what the footrule cut left out and the guides cannot rule out within the k-th distance so far
            near = np.sort(np.where(other, d, np.inf), axis=1)
            reach = np.minimum(near[:, k - 1] if near.shape[1] >= k else np.inf, radius).astype(np.float32) + 1e-3
            left = np.ones((n, len(x)), dtype=bool)
            np.put_along_axis(left, best, False, axis=1)
            for g in range(len(guides)):
                left &= np.abs(q_guide[at : at + step, g, None] - x_guide[None, :, g]) <= reach[:, None]
            i, j = np.nonzero(left)
            e = np.sqrt(((q[at + i] - x[j]) ** 2).sum(axis=1))
            ok = (e <= radius) & (q_ids[at + i] != x_ids[j])
            found += list(zip(i[ok], j[ok], e[ok], strict=True))
        out += [(q_ids[at + i], x_ids[j], float(dist)) for i, j, dist in found]
    out.sort(key=lambda r: (r[0], r[2], r[1]))
    seen, first = {}, []
    for r in out:
        seen[r[0]] = seen.get(r[0], 0) + 1
        if seen[r[0]] <= k:
            first.append(r)
    return first


def near_classes(classes: DataFrame, k: int, radius: float, max_pivots: int = MAX_PIVOTS, kept: int = KEPT) -> DataFrame:
    """(class, other, distance): the other distinct vectors among which the ``k`` nearest within ``radius`` are."""
    schema = "class string, other string, distance double"
    count = classes.count()
    if not count:
        return classes.sparkSession.createDataFrame([], schema)
    pivots = choose_pivots(classes, count, max_pivots)
    posted = cut_lineage(post(classes, pivots, radius))
    postings = posted.select("class", "vector", "ranked", F.explode("files").alias("file"))
    # one row per file, so no more than pivots: small enough to broadcast whatever the data
    sizes = posted.select(F.explode("files").alias("file")).groupBy("file").agg(F.ceil(F.count(F.lit(1)) / F.lit(FILE_ROWS)).cast("int").alias("blocks"))
    postings = postings.join(F.broadcast(sizes), "file")
    blocks = F.col("blocks")
    own = F.pmod(F.xxhash64("class"), blocks.cast("bigint")).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    roles = F.when(
        blocks == 1, F.array(F.struct(F.lit(0).alias("qb"), F.lit(0).alias("xb"), F.lit(3).alias("role")))
    ).otherwise(
        F.concat(
            F.transform(every, lambda b: F.struct(own.alias("qb"), b.cast("int").alias("xb"), F.lit(1).alias("role"))),
            F.transform(every, lambda b: F.struct(b.cast("int").alias("qb"), own.alias("xb"), F.lit(2).alias("role"))),
        )
    )
    placed = postings.select("class", "vector", "ranked", "file", F.explode(roles).alias("r"))
    placed = placed.select("class", "vector", "ranked", "file", "r.qb", "r.xb", "r.role")

    def search(table: pa.Table) -> pa.Table:
        role = table["role"].to_numpy()
        ids = np.array(table["class"].to_pylist(), dtype=object)
        vectors, ranked = _rows(table["vector"], np.float64), _rows(table["ranked"], np.int64)
        q, x = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        rows = []
        if len(q) and len(x) > (1 if role[0] == 3 else 0):
            rows = search_file(ids[q], vectors[q], ranked[q], ids[x], vectors[x], ranked[x], k, radius, kept)
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        types = [pa.string(), pa.string(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["class", "other", "distance"])

    return placed.groupBy("file", "qb", "xb").applyInArrow(search, schema).distinct()


def nearest(vectors: DataFrame, k: int, radius: float, max_pivots: int = MAX_PIVOTS, kept: int = KEPT) -> DataFrame:
    """(id, neighbour, distance): the ``k`` nearest other rows within ``radius`` of every row of (id, vector)."""
    vectors = cut_lineage(vectors.select("id", "vector"))
    # the k + 1 smallest ids of each distinct vector; the limit is applied before the shuffle too
    ranked = vectors.withColumn("_rank", F.row_number().over(Window.partitionBy("vector").orderBy("id")))
    members = ranked.where(F.col("_rank") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("first"))
    members = cut_lineage(members.select(F.col("first")[0].alias("class"), "vector", "first"))
    close = near_classes(members.select("class", "vector"), k, radius, max_pivots, kept)
    others = members.select(F.col("class").alias("other"), F.slice("first", 1, k).alias("ids"))
    room = members.select("class", (F.lit(k + 1) - F.size("first")).alias("room"), F.col("first").alias("own"))
    cross = close.join(others, "other").join(room.where(F.col("room") > 0), "class")
    cross = cross.select("class", "room", "own", "distance", F.explode("ids").alias("neighbour"))
    order = Window.partitionBy("class").orderBy("distance", "neighbour")
    cross = cross.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= F.col("room"))
    cross = cross.select(F.explode("own").alias("id"), "neighbour", "distance")
    copied = members.where(F.size("first") > 1).select("vector", "first")
    # copies are looked up by a hash of the vector, so that a vector shared by a third of the rows stays spread
    keyed = vectors.withColumn("_key", F.sha2(F.to_json(F.struct("vector")), 256)).drop("vector")
    firsts = copied.withColumn("_key", F.sha2(F.to_json(F.struct("vector")), 256)).select("_key", "first")
    same = lookup(keyed, "_key", firsts, "_key", "first", "first").where(F.col("first").isNotNull())
    twins = F.slice(F.filter(F.col("first"), lambda x: x != F.col("id")), 1, k)
    same = same.select("id", F.explode(twins).alias("neighbour"), F.lit(0.0).alias("distance"))
    return same.unionByName(cross)


def near_pairs(neighbours: DataFrame) -> DataFrame:
    """(track_a, track_b), track_a < track_b, of (id, neighbour), each once."""
    a, b = F.least("id", "neighbour"), F.greatest("id", "neighbour")
    return neighbours.where(F.col("id") != F.col("neighbour")).select(a.alias("track_a"), b.alias("track_b")).distinct()
