"""Centroid clustering of integer vectors: a float32 screen with rounding-error intervals, then exact integers.

Components x become floor(64 * x). A batch of vectors is multiplied with all centroids in float32; every
approximate distance has an interval that the exact one can't leave. Centroids whose intervals reach below the
least upper end are measured again in exact integers, and the smallest number wins a tie. Sums of a round are
made in the tasks and merged by Spark; only k x dims sums reach the driver.

Defined cases: vectors that are null, of another length, or with a null or non-finite component are left out.
Fewer kept vectors than centroids give as many centroids as vectors; none gives no rows. Starts with equal
hashes (repeated vec_ids) go by their components; a null vec_id hashes as ``1:null``. Components beyond WIDE are
computed in unbounded integers; a distance or inertia that no long holds is null. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

SCALE = 64
#: Components up to this size have squared distances of 64 components that fit a long, exactly.
WIDE = 1 << 27
#: Bits of a limb in which larger sums travel.
LIMB = 40
LONG = (1 << 63) - 1


def kept_vectors(batch: pa.RecordBatch, dims: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and scaled vectors of a batch that count: an int64 matrix, or one of unbounded integers if any is wide."""
    ids, lists = batch.column(0), batch.column(1).cast(pa.list_(pa.float64()))
    whole = np.flatnonzero(np.asarray(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)) == dims)
    lists = lists.take(pa.array(whole))
    flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)  # a null becomes a nan
    good = np.isfinite(flat).all(axis=1)
    with np.errstate(over="ignore"):
        scaled = np.floor(flat[good] * SCALE)
    ids = ids.take(pa.array(whole[good]))
    if np.isfinite(scaled).all() and (np.abs(scaled) <= WIDE).all():
        return ids, scaled.astype(np.int64)
    exact = [[(n * SCALE) // d for n, d in map(float.as_integer_ratio, row)] for row in flat[good].tolist()]
    return ids, np.array(exact, dtype=object).reshape(-1, dims)


@dataclass
class Screen:
    """Nearest centroids of vectors. ``screened`` and ``measured`` count vectors and the pairs computed exactly."""

    centroids: list[list[int]]
    screened: int = 0
    measured: int = 0

    def __post_init__(self):
        self.exact = np.array(self.centroids, dtype=object)
        self.wide = not self.centroids or bool((np.abs(self.exact) > WIDE).any())
        if not self.wide:
            self.whole = self.exact.astype(np.int64)
            self.short = self.whole.astype(np.float32)
            self.square = (self.whole * self.whole).sum(axis=1).astype(np.float64)
            self.length = np.sqrt(self.square)

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """The number of the nearest centroid of each vector."""
        if self.wide or vectors.dtype == object:
            return np.array([min(range(len(self.exact)), key=lambda j, v=v: (((v - self.exact[j]) ** 2).sum(), j)) for v in vectors.astype(object)], dtype=np.int64)
        if not len(vectors):
            return np.zeros(0, np.int64)
        dims = vectors.shape[1]
        dots = (vectors.astype(np.float32) @ self.short.T).astype(np.float64)
        near = self.square - 2 * dots  # the distance without the vector's own square
        # A float32 product of n terms errs by at most n u / (1 - n u) times the sum of their sizes, which is at most
        # the product of the lengths; two units more for rounding the factors, and what float64 adds is covered twice over.
        units = (dims + 4) * 2.0**-24
        length = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        err = 2.0 * (units / (1 - units)) * length[:, None] * self.length * (1 + 1e-9) + (self.square + 2 * np.abs(dots)) * 2.0**-48 + 2.0**-60
        likely = near - err <= (near + err).min(axis=1)[:, None]
        best = likely.argmax(axis=1)
        open_ = np.flatnonzero(likely.sum(axis=1) > 1)
        self.screened += len(vectors)
        if len(open_):
            row, number = np.nonzero(likely[open_])
            apart = vectors[open_[row]] - self.whole[number]
            measured = np.full((len(open_), len(self.whole)), np.iinfo(np.int64).max)
            measured[row, number] = (apart * apart).sum(axis=1)
            best[open_] = measured.argmin(axis=1)  # the first of equal ones
            self.measured += len(row)
        return best

    def distance(self, vectors: np.ndarray, best: np.ndarray) -> list[int | None]:
        if self.wide or vectors.dtype == object:
            apart = vectors.astype(object) - self.exact[best]
            return [d if d <= LONG else None for d in (apart * apart).sum(axis=1)]
        apart = vectors - self.whole[best]
        return (apart * apart).sum(axis=1)


def _limbs(total: int) -> list[int]:
    sign, total = (-1, -total) if total < 0 else (1, total)
    out = []
    while True:
        out.append(sign * (total & ((1 << LIMB) - 1)))
        total >>= LIMB
        if not total:
            return out


def starts(vectors: DataFrame, k: int, dims: int, seed: int) -> list[list[int]]:
    """The k kept vectors with the least SHA-256 of ``seed:vec_id``: a list bounded by k."""

    def first(batches):
        least: list[tuple[str, list[int]]] = []
        for batch in batches:
            ids, scaled = kept_vectors(batch, dims)
            hashes = [hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest() for i in ids.to_pylist()]
            some = sorted(range(len(hashes)), key=hashes.__getitem__)
            bound = hashes[some[k - 1]] if len(some) > k else "g"
            least = sorted(least + [(h, scaled[n].tolist()) for n, h in enumerate(hashes) if h <= bound])[:k]
        yield pa.RecordBatch.from_pydict({"hash": [h for h, _ in least], "vector": [[str(x) for x in v] for _, v in least]}, schema=pa.schema([("hash", pa.string()), ("vector", pa.list_(pa.string()))]))

    found = [(r.hash, [int(x) for x in r.vector]) for r in vectors.mapInArrow(first, "hash string, vector array<string>").orderBy("hash", "vector").limit(4 * k).collect()]
    return [v for _, v in sorted(found)[:k]]


def means(vectors: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """Centroids after a round: floor(sum / count) of each component; an empty one stays."""

    def sums(batches):
        screen, counts, totals = Screen(centroids), [0] * len(centroids), [[0] * dims for _ in centroids]
        for batch in batches:
            _, scaled = kept_vectors(batch, dims)
            best = screen.nearest(scaled)
            for j in np.unique(best).tolist():
                own = scaled[best == j]
                counts[j] += len(own)
                totals[j] = [a + int(b) for a, b in zip(totals[j], own.sum(axis=0), strict=True)]
        rows = [(j, -1, 0, counts[j]) for j in range(len(centroids)) if counts[j]]
        rows += [(j, c, n, part) for j in range(len(centroids)) if counts[j] for c in range(dims) for n, part in enumerate(_limbs(totals[j][c])) if part]
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cluster", "component", "limb", "part"])

    parts = vectors.mapInArrow(sums, "cluster int, component int, limb int, part long")
    merged: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("cluster", "component", "limb").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("part")).collect():
        at = (r.cluster, r.component)
        merged[at] = merged.get(at, 0) + (int(r.part) << (LIMB * r.limb))
    return [[merged.get((j, c), 0) // n for c in range(dims)] if (n := merged.get((j, -1), 0)) else old for j, old in enumerate(centroids)]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    centroids = starts(rows, k, dims, seed)
    for _ in range(rounds if centroids else 0):
        centroids = means(rows, centroids, dims)
    final = centroids

    def assign(batches):
        screen = Screen(final)
        for batch in batches:
            ids, scaled = kept_vectors(batch, dims)
            if len(ids):
                best = screen.nearest(scaled)
                yield pa.RecordBatch.from_arrays([ids, pa.array(best, pa.int32()), pa.array(screen.distance(scaled, best), pa.int64())], ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(assign, "vec_id long, cluster int, distance long"), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Every vector with its cluster's inertia, that of all, and the digest of its final centroid."""
    spark = assigned.sparkSession
    assigned = settle(assigned, "assigned")
    whole = lambda c: F.when(F.count(F.lit(1)) == F.count(c), F.sum(F.col(c).cast("decimal(38,0)")))
    by = assigned.groupBy("cluster").agg(whole("distance").alias("part")).collect()  # a row for each centroid
    total = None if any(r.part is None for r in by) else sum(int(r.part) for r in by)
    fits = lambda x: None if x is None or x > LONG else int(x)
    known = [(r.cluster, fits(r.part), fits(total), hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in by]
    known = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
