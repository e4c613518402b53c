"""Centroid clustering by Yinyang's bounds, in integers.

Centroids are put into groups once. With every vector go its cluster, an upper bound on the
distance to its own centroid and, per group, a lower bound on the distances to the group's other
centroids. When centroids have moved, the bounds move by as much; a vector whose upper bound lies
below all its lower bounds keeps its cluster unread (the global filter), of the rest the upper
bound is made exact, and only groups whose lower bound doesn't lie above it are scanned, by exact
integer distances (the group filter). Bounds are held off by more than they are rounded, and a tie is no
clear case, so clusters are those of a plain search; ties go to the smaller number.

A round is one pass over a written table of the vectors with their bounds. Sums of the clusters are
kept up by what moved alone: tasks add up the vectors that came and went, so a round sends a row per
task, cluster and component. Centroids become the exact floor of sum / count.

Vectors that don't have ``WIDTH`` components, or have a null or non-finite one, are left out.
Components are held to +-2 ** 27, so that squared distances stay within 64 bits. A null id counts as the
empty string in the hash that chooses the first centroids; repeated rows are rows of their own. Of fewer
rows than centroids each row makes one; a table without rows gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import discard, materialize

SCALE, WIDTH, LIMIT = 64, 64, 1 << 27
CENTROIDS, ROUNDS = 16, 3
#: Centroids of a group, on average.
PER_GROUP = 4
_SLACK = 1e-9
_STATE = "vec_id long, x array<int>, cluster int, before int, upper double, lower array<double>, distance long"


@dataclass
class Centroids:
    """The centroids, each one's group, and how far each has just moved."""

    at: np.ndarray
    group: np.ndarray
    moved: np.ndarray

    @property
    def groups(self) -> int:
        return int(self.group.max()) + 1 if len(self.group) else 0


def kept(embeddings: DataFrame) -> DataFrame:
    """vec_id and x (array of integers) of the vectors that take part."""

    def whole(x: Column) -> Column:
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    held = F.transform("embedding", lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x.cast("double") * SCALE))).cast("int"))
    return embeddings.filter((F.size("embedding") == WIDTH) & F.forall("embedding", whole)).select(F.col("vec_id").cast("long").alias("vec_id"), held.alias("x"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all of c; through double where that is exact."""
    safe = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < 1 << 22
    kind = np.float64 if safe else np.int64
    x, c = x.astype(kind), c.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)


def grouped(at: np.ndarray, per_group: int = PER_GROUP, rounds: int = 5) -> np.ndarray:
    """The group of each centroid, by a few rounds of k-means among the centroids themselves."""
    t = max(1, len(at) // per_group)
    points = at.astype(float)
    means = points[:: max(1, len(at) // t)][:t].copy()
    own = np.zeros(len(at), np.int64)
    for _ in range(rounds):
        own = np.argmin(((points[:, None] - means) ** 2).sum(2), axis=1)
        for g in range(t):
            if (own == g).any():
                means[g] = points[own == g].mean(0)
    return np.unique(own, return_inverse=True)[1]


def first(x: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, squared distance and lower bounds of each row by a full scan."""
    d = squared(x, c.at)
    own = np.argmin(d, axis=1)
    rows = np.arange(len(x))
    best = d[rows, own]
    rest = d.astype(float)
    rest[rows, own] = np.inf
    lower = np.stack([np.sqrt(rest[:, c.group == g]).min(1) for g in range(c.groups)], axis=1) * (1 - _SLACK)
    return own, best, lower


def step(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
    """Cluster, upper and lower bounds after centroids moved, and what the filters passed over."""
    own, lower = own.copy(), lower.copy()
    upper = (upper + c.moved[own]) * (1 + _SLACK)
    for g in range(c.groups):
        lower[:, g] -= c.moved[c.group == g].max() * (1 + _SLACK) + _SLACK * np.abs(np.where(np.isfinite(lower[:, g]), lower[:, g], 0))
    counts = {"rows": len(x), "read": 0, "groups": 0}
    rows = np.flatnonzero(~(upper < lower.min(1)))
    counts["read"] = len(rows)
    if not len(rows):
        return own, upper, lower, counts
    best = _own_squared(x[rows], c.at[own[rows]])
    upper[rows] = np.sqrt(best.astype(float)) * (1 + _SLACK)
    was, best_was = own[rows], best.copy()
    found = []
    for g in range(c.groups):
        near = np.flatnonzero(~(upper[rows] < lower[rows, g]))
        counts["groups"] += len(near)
        if len(near):
            members = np.flatnonzero(c.group == g)
            d = squared(x[rows[near]], c.at[members])
            found.append((g, near, members, d))
    new = was.copy()
    for _, near, members, d in found:
        k = np.argmin(d, axis=1)
        value, who = d[np.arange(len(near)), k], members[k]
        better = (value < best[near]) | ((value == best[near]) & (who < new[near]))
        best[near[better]], new[near[better]] = value[better], who[better]
    for g, near, members, d in found:
        rest = np.where(members == new[near][:, None], np.inf, d.astype(float))
        lower[rows[near], g] = np.sqrt(rest.min(1)) * (1 - _SLACK)
    # the old centroid of a vector that went is now one of its group's others
    gone = np.flatnonzero(new != was)
    at = (rows[gone], c.group[was[gone]])
    lower[at] = np.minimum(lower[at], np.sqrt(best_was[gone].astype(float)) * (1 - _SLACK))
    own[rows], upper[rows] = new, np.sqrt(best.astype(float)) * (1 + _SLACK)
    return own, upper, lower, counts


def _own_squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x.astype(np.int64) - c.astype(np.int64)) ** 2).sum(1)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, WIDTH)


def _rows(batch: pa.RecordBatch, own: np.ndarray, before: np.ndarray, upper: np.ndarray, lower: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    t = lower.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(lower) + 1, dtype=np.int32) * t), pa.array(lower.reshape(-1)))
    cells = [batch.column("vec_id"), batch.column("x"), pa.array(own.astype(np.int32)), pa.array(before.astype(np.int32)), pa.array(upper), lists, pa.array(distance)]
    return pa.RecordBatch.from_arrays(cells, names=[c.split()[0] for c in _STATE.split(", ")])


def assigned(rows: DataFrame, c: Centroids, last: bool = False) -> DataFrame:
    """The table of vectors with their clusters and bounds; ``rows`` is such a table, or holds vec_id and x alone. ``last`` adds exact distances."""
    fresh = "cluster" not in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch)
            if not len(x):
                continue
            if fresh:
                own, best, lower = first(x, c)
                upper, before = np.sqrt(best.astype(float)) * (1 + _SLACK), np.full(len(x), -1)
            else:
                before = batch.column("cluster").to_numpy()
                own, upper, lower, _ = step(x, before, batch.column("upper").to_numpy(), batch.column("lower").flatten().to_numpy().reshape(len(x), -1), c)
            distance = _own_squared(x, c.at[own]) if last else np.zeros(len(x), np.int64)
            yield _rows(batch, own, before, upper, lower, distance)

    return rows.mapInArrow(run, _STATE)


def changes(state: DataFrame, k: int) -> np.ndarray:
    """By cluster: the count and the components that this round's moves add, as exact Python integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, WIDTH + 1), np.int64)
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows, np.int64), _vectors(batch)])
            for name, sign in (("cluster", 1), ("before", -1)):
                at = batch.column(name).to_numpy()
                for c in np.unique(at[at >= 0]):
                    total[c] += sign * x[at == c].sum(0)
        hit = np.flatnonzero(total.any(1))
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit].tolist(), pa.list_(pa.int64()))], names=["cluster", "sums"])

    parts = state.filter("cluster <> before").select("x", "cluster", "before").mapInArrow(run, "cluster int, sums array<long>")
    cells = parts.select("cluster", F.posexplode("sums").alias("at", "v")).groupBy("cluster", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out = np.zeros((k, WIDTH + 1), object)
    for r in cells.collect():  # k * (WIDTH + 1) rows at most
        out[r["cluster"], r["at"]] = int(r["v"])
    return out


def moved_to(c: Centroids, sums: np.ndarray) -> Centroids:
    """Centroids at the floor of their clusters' means; those of empty clusters stay."""
    at = c.at.copy()
    for k, (n, *total) in enumerate(sums):
        if n:
            at[k] = [t // n for t in total]
    return Centroids(at, c.group, np.sqrt(_own_squared(at, c.at).astype(float)) * (1 + _SLACK))


def clusters(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = "1") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance of every vector that takes part, and the final centroids."""
    rows = kept(embeddings)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = rows.select(name.alias("h"), "x").orderBy("h", "x").limit(k).collect()  # k rows
    at = np.array([r["x"] for r in start], np.int64).reshape(-1, WIDTH)
    if not len(at):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), at
    c = Centroids(at, grouped(at), np.zeros(len(at)))
    state, sums = materialize(assigned(rows, c), "clusters"), np.zeros((len(at), WIDTH + 1), object)
    for i in range(rounds):
        sums = sums + changes(state, len(at))
        c = moved_to(c, sums)
        was, state = state, materialize(assigned(state, c, i == rounds - 1), "clusters")
        discard(was)
    return state.select("vec_id", "cluster", "distance"), c.at


def clustered(embeddings: DataFrame, **settings: object) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part.

    Inertia is null where it leaves 64 bits.
    """
    rows, at = clusters(embeddings, **settings)
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in at]
    each = rows.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()  # a row per centroid
    inertia = {r["cluster"]: r["s"] for r in each}
    total = sum(inertia.values()) if None not in inertia.values() else None
    total = total if total is not None and total < 1 << 63 else None
    told = rows.sparkSession.createDataFrame([(i, inertia.get(i), total, h) for i, h in enumerate(names)], "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(told), F.col("cluster") == F.col("_cluster")).drop("_cluster")
