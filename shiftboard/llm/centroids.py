"""Centroid clustering of integer vectors with an incrementally kept distance matrix.

A vector's exact integer dot product with every centroid is stored beside it.  When centroids move, only the components
that changed are looked at: ``dot += v[i] * change[i]`` for every component i with a change other than 0.  The squared
distance is ``|v|^2 - 2 * dot + |c|^2``, and the nearest centroid is the one with the smallest ``|c|^2 - 2 * dot``.

A round is one pass: each task reads its rows, updates their dot products, assigns them and writes them, and closes with one
row for each centroid that sums what it assigned there (``held`` rows, chosen when the table is read back).  Next
centroids follow from those few rows.  The driver holds centroids only.  Each round's table is stored in the shared folder,
so a lost executor costs its tasks and no earlier round; the table before it is removed.

Defined results: a vector counts if it has exactly ``size`` components, none of them null, NaN or infinite; others are left
out.  A null id is assigned like others and never becomes a first centroid.  Rows that share an id, or repeat, count one
by one; of equal hashes the smaller vector comes first.  With fewer vectors than centroids there are as many centroids as
vectors.  Ties go to the smaller centroid.  An empty table gives an empty result; other columns are ignored.  Scaled
components of 2**27 or more raise, as sums would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import store
from .ship import map_arrow

LIMIT = float(1 << 27)
VECTOR = "id bigint, v array<int>"
STATE = "id bigint, v array<int>, dots array<bigint>, cluster int, distance bigint, held bigint, sums array<bigint>, inertia bigint"
ROWS = 4096  # rows handled at once


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of equal length as rows of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)[: n + 1]), pa.array(rows.ravel(), kind))


def whole_vectors(size: int, scale: int):
    """Keeps complete vectors, as floor(scale * x)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("x")
            right = pc.fill_null(pc.equal(pc.list_value_length(vectors), size), False)
            batch = batch.filter(right)
            vectors = batch.column("x")
            flat = vectors.flatten()
            known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, size)
            x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, size)
            whole = known.all(axis=1) & np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore"):
                x = np.floor(x[whole] * float(scale))
            if len(x) and np.abs(x).max() >= LIMIT:
                raise ValueError(f"scaled components must stay below {LIMIT:.0f}")
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(whole)), _lists(x.astype(np.int32), pa.int32())], ["id", "v"])

    return step


def moved_rows(centroids: np.ndarray, change: np.ndarray, fresh: bool):
    """One round over a part of the rows.

    ``change``: centroids x components, what was added since the stored dot products; ``fresh``: there are none stored yet.
    """
    k, size = centroids.shape
    norms = (centroids * centroids).sum(axis=1)
    changed = [np.flatnonzero(row) for row in change]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums, inertia = np.zeros(k, np.int64), np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                n = len(batch)
                v = _matrix(batch.column("v"), size)
                dots = np.zeros((n, k), np.int64) if fresh else _matrix(batch.column("dots"), k)
                for j, places in enumerate(changed):
                    if len(places):
                        dots[:, j] += v[:, places] @ change[j, places]
                apart = norms - 2 * dots
                cluster = apart.argmin(axis=1)
                distance = apart[np.arange(n), cluster] + (v * v).sum(axis=1)
                order = np.argsort(cluster, kind="stable")
                met, starts = np.unique(cluster[order], return_index=True)
                held += np.bincount(cluster, minlength=k)
                if n:
                    sums[met] += np.add.reduceat(v[order], starts, axis=0)
                    inertia[met] += np.add.reduceat(distance[order], starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"), batch.column("v"), _lists(dots, pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance),
                        pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64()),
                    ],
                    ["id", "v", "dots", "cluster", "distance", "held", "sums", "inertia"],
                )
        met = np.flatnonzero(held)
        if len(met):
            n = len(met)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64())), pa.array(met, pa.int32()), pa.nulls(n, pa.int64()),
                    pa.array(held[met]), _lists(sums[met], pa.int64()), pa.array(inertia[met]),
                ],
                ["id", "v", "dots", "cluster", "distance", "held", "sums", "inertia"],
            )

    return step


def _totals(state: DataFrame, size: int) -> list:
    """One row per centroid that has vectors: cluster, held, inertia, sums (a column per component)."""
    parts = state.filter(F.col("held").isNotNull()).groupBy("cluster")
    each = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(size)]
    return parts.agg(F.sum("held").alias("held"), F.sum("inertia").alias("inertia"), *each).collect()


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest SHA-256 after ``seed``."""
    drawn = vectors.filter(F.col("id").isNotNull()).withColumn("drawn", F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256))
    return np.array([r.v for r in drawn.orderBy("drawn", "v").limit(k).collect()], np.int64)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(
    embeddings: DataFrame,
    *,
    k: int = 8,
    rounds: int = 10,
    size: int = 64,
    scale: int = 1024,
    seed: str = "3:",
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """Per vector: id, cluster, distance (squared, to its centroid), cluster_inertia, inertia, centroid (its components)."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("x"))
    vectors = map_arrow(rows, whole_vectors(size, scale), VECTOR)
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        shape = "id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>"
        return spark.createDataFrame([], shape)
    change, state = centroids, None
    for done in range(rounds + 1):
        source = vectors if state is None else state.filter(F.col("held").isNull()).select("id", "v", "dots")
        before, state = state, store.keep(map_arrow(source, moved_rows(centroids, change, state is None), STATE), "distances")
        store.drop(spark, before)
        totals = _totals(state, size)
        if done == rounds:
            break
        moved = centroids.copy()
        for t in totals:
            moved[t.cluster] = [t[f"s{i}"] // t.held for i in range(size)]
        if (moved == centroids).all():
            break  # what follows would repeat this round
        change, centroids = moved - centroids, moved
    whole = sum(t.inertia for t in totals)
    shape = "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>"
    # one row per centroid
    found = spark.createDataFrame([(t.cluster, t.inertia, whole, centroids[t.cluster].tolist()) for t in totals], shape)
    assigned = state.filter(F.col("held").isNull()).select("id", "cluster", "distance")
    return assigned.join(F.broadcast(found), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
