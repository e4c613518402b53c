"""Hard-negative mining by product quantisation with rigorous bounds and an exact rerank.

Vectors of integers are cut into ``SUBSPACES`` short pieces; each piece is coded by the nearest of
``CODES`` centroids of its subspace, and the length of what the codes leave over, the residual
norm, is stored with the row. The score of an anchor and a row is the sum of one looked-up number
per subspace, give or take the anchor's norm times the row's residual norm (Cauchy-Schwarz), so
a row whose interval misses what is asked for is passed over unread and no other is. The rest is
scored by the integer vectors themselves: results are exact, whatever the centroids are.

Rows lie in a written index of blocks of at most ``BLOCK`` rows. Anchors, a stated part of the rows,
are packed in blocks too; anchor blocks are copied to the parts of the index and meet its blocks
there one by one, so a task holds one block of each. Two passes are made: the first finds each
anchor's best rows of its own label, the second the best rows of other labels in the window that
each of these opens. A block gives its own best few, and the best of all are taken by a window
with a group limit.

Rows without a label, a vector or an id, or with a null or non-finite component, take no part. Components are
held to +-2 ** 26, so that scores of vectors of up to 1,024 components stay within 64 bits. A
missing component of a shorter vector counts as 0. Repeated rows are rows of their own; an
anchor's other rows are those of another id. The centroids are fitted on ``SAMPLE`` rows at most,
those with the smallest hashes of their ids; every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scratch import materialize

SCALE, LIMIT = 256, 1 << 26
SUBSPACES, CODES, SAMPLE, ROUNDS = 32, 256, 8192, 5
BLOCK, ANCHORS, TILE = 8192, 512, 512
EVERY, POSITIVES, NEGATIVES = 50, 5, 3
#: Hundredths of a positive's score between which its negatives' scores lie.
LOW, HIGH = 50, 95
#: Share of the norms that covers the rounding of sums in single precision.
_SLACK = 4e-6
_INDEX = "block long, n int, ids binary, labels binary, codes binary, left_over binary, ints binary"
_PACK = "anchors long, n_a int, a_keys binary, a_ids binary, a_labels binary, a_ints binary, a_scores binary"


def usable(embeddings: DataFrame) -> DataFrame:
    """id, label and x (array of integers) of the rows that take part."""

    def whole(x: Column) -> Column:
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    ok = embeddings.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", whole))
    held = F.transform("embedding", lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x.cast("double") * SCALE))).cast("int"))
    label = F.col("label").cast("long")
    return ok.select(F.col("vec_id").cast("long").alias("id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), held.alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a column as rows of one matrix, shorter ones filled up with 0."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(flat) == len(size) * width:
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), np.int32)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _cut(x: np.ndarray, width: int) -> np.ndarray:
    """(subspace, row, component) of rows; components are filled up to whole subspaces."""
    each = max(1, -(-width // SUBSPACES))
    parts = max(1, -(-width // each))
    out = np.zeros((len(x), parts * each), np.float64)
    out[:, :width] = x
    return out.reshape(len(x), parts, each).transpose(1, 0, 2)


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * (points @ centroids.T), axis=1)


def fit(sample: np.ndarray, width: int) -> np.ndarray:
    """Centroids (subspace, code, component) by a few rounds of k-means in each subspace."""
    books = []
    for points in _cut(sample, width):
        seen, first = np.unique(points, axis=0, return_index=True)
        c = points[np.sort(first)[:CODES]] if len(seen) else np.zeros((1, points.shape[1]))
        for _ in range(ROUNDS):
            at = _nearest(points, c) if len(points) else np.zeros(0, np.int64)
            n = np.bincount(at, minlength=len(c))
            sums = np.stack([np.bincount(at, points[:, k], len(c)) for k in range(points.shape[1])], axis=1)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        books.append(np.concatenate([c, np.repeat(c[:1], CODES - len(c), axis=0)]))
    return np.stack(books)


def build_index(rows: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """The rows in blocks: ids, labels, codes, residual norms and integer vectors of at most BLOCK rows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pack() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            x = _matrix(t.column("x").chunk(0), width) if width else np.zeros((t.num_rows, 0), np.int32)
            cut = _cut(x, width)
            codes = np.stack([_nearest(p, b) for p, b in zip(cut, books, strict=True)]).astype(np.uint8)
            rest = cut - np.stack([b[c] for b, c in zip(books, codes, strict=True)])
            r, n = np.sqrt((rest**2).sum((0, 2))), np.sqrt((x.astype(float) ** 2).sum(1))
            left = ((r + _SLACK * (n + r)) * (1 + 1e-6)).astype(np.float32)
            cells = [t.column("id").to_numpy().astype(np.int64), t.column("label").to_numpy().astype(np.int64), codes, left, x.astype(np.int32)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([t.num_rows], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in cells]], names=["n", "ids", "labels", "codes", "left_over", "ints"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                if held and sum(h.num_rows for h in held) + part.num_rows > BLOCK:
                    yield pack()
                held.append(part)
        if held:
            yield pack()

    blocks = rows.mapInArrow(run, _INDEX.split(", ", 1)[1])
    return materialize(blocks.select(F.monotonically_increasing_id().alias("block"), "*"), "index")


def pack_anchors(anchors: DataFrame, count: int, width: int) -> DataFrame:
    """Anchors (key, id, label, x, scores) in blocks; the scores of their positives, POSITIVES at most, are filled up with 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ANCHORS):
                b = batch.slice(at, ANCHORS)
                x = _matrix(b.column("x"), width) if width else np.zeros((b.num_rows, 0), np.int32)
                cells = [*[b.column(c).to_numpy().astype(np.int64) for c in ("key", "id", "label")], x.astype(np.int32), _matrix(b.column("scores"), POSITIVES).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in cells]], names=["n_a", "a_keys", "a_ids", "a_labels", "a_ints", "a_scores"])

    dealt = anchors.select("key", "id", "label", "x", "scores").repartition(max(1, -(-count // ANCHORS)))
    return dealt.mapInArrow(run, _PACK.split(", ", 1)[1])


def pairs(index: DataFrame, packed: DataFrame, parts: int) -> DataFrame:
    """Every block of the index beside every block of anchors; anchors are copied to the parts, the index lies still in its own."""
    left = index.withColumn("_part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")).repartition(parts, "_part")
    right = packed.withColumn("_part2", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(parts, "_part2")
    return left.join(right.hint("shuffle_hash"), F.col("_part") == F.col("_part2")).drop("_part", "_part2", "block")


class _Block:
    """One block of rows beside one of anchors."""

    def __init__(self, row: dict, books: np.ndarray, width: int) -> None:
        n, k = row["n"], row["n_a"]
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        self.codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, n)
        self.left = np.frombuffer(row["left_over"], np.float32)
        self.x = np.frombuffer(row["ints"], np.int32).reshape(n, width)
        self.keys, self.a_ids, self.a_labels = (np.frombuffer(row[c], np.int64) for c in ("a_keys", "a_ids", "a_labels"))
        self.a = np.frombuffer(row["a_ints"], np.int32).reshape(k, width)
        self.scores = np.frombuffer(row["a_scores"], np.int64).reshape(k, POSITIVES)
        self.books, self.width = books, width

    def bounds(self, rows: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score that each anchor (first axis) and row may have."""
        a = self.a[anchors].astype(float)
        table = np.stack([b @ p.T for b, p in zip(self.books, _cut(a, self.width), strict=True)]).astype(np.float32)
        sums, buf = np.zeros((len(rows), len(anchors)), np.float32), np.empty((TILE, len(anchors)), np.float32)
        for at in range(0, len(rows), TILE):
            codes, out = self.codes[:, rows[at : at + TILE]], sums[at : at + TILE]
            for t, c in zip(table, codes, strict=True):
                out += np.take(t, c, axis=0, out=buf[: len(c)], mode="clip")
        sums = np.ascontiguousarray(sums.T)
        norm = (np.sqrt((a**2).sum(1)) * (1 + 1e-6)).astype(np.float32)
        far = norm[:, None] * self.left[rows]
        return sums - far, sums + far

    def exact(self, anchor: int, rows: np.ndarray) -> np.ndarray:
        return self.x[rows].astype(np.int64) @ self.a[anchor].astype(np.int64)

    def best(self, anchor: int, rows: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, window: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows (100 * score within the window, if one is given); only rows that may be among them are scored."""
        sure = low
        if window:
            may = (high >= window[0] / 100) & (low <= window[1] / 100)
            rows, low, high = rows[may], low[may], high[may]
            sure = low[(low >= window[0] / 100) & (high <= window[1] / 100)]
        if len(sure) >= k:
            rows = rows[high >= np.partition(sure, len(sure) - k)[len(sure) - k]]
        score = self.exact(anchor, rows)
        if window:
            fits = (100 * score >= window[0]) & (100 * score <= window[1])
            rows, score = rows[fits], score[fits]
        order = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[order]], score[order]

    def positives(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for label in np.unique(self.a_labels):
            rows, anchors = np.flatnonzero(self.labels == label), np.flatnonzero(self.a_labels == label)
            low, high = self.bounds(rows, anchors)
            for i, a in enumerate(anchors):
                other = self.ids[rows] != self.a_ids[a]
                yield a, *self.best(a, rows[other], low[i][other], high[i][other], POSITIVES)

    def negatives(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        rows = np.arange(len(self.ids))
        low, high = self.bounds(rows, np.arange(len(self.a)))
        for a in range(len(self.a)):
            other = np.flatnonzero(self.labels != self.a_labels[a])
            lo, hi = low[a][other], high[a][other]
            for j, s in enumerate(self.scores[a].tolist()):
                if s >= 0:  # below 0 the window is empty
                    yield a, j, *self.best(a, other, lo, hi, NEGATIVES, (LOW * s, HIGH * s))


def _search(met: DataFrame, books: np.ndarray, width: int, negative: bool) -> DataFrame:
    """key, place (of the positive; 0 in the first pass), id and score: the best few of each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _Block({c: batch.column(c)[i].as_py() for c in batch.schema.names}, books, width)
                found = list(b.negatives() if negative else ((a, 0, ids, s) for a, ids, s in b.positives()))
                size = [len(f[2]) for f in found]
                if sum(size):
                    cells = [np.repeat(b.keys[[f[0] for f in found]], size), np.repeat([f[1] for f in found], size), np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], names=["key", "place", "id", "score"])

    return met.mapInArrow(run, "key long, place long, id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("key", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = usable(embeddings)
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("width"), F.count_if(F.col("id") % EVERY == 0).alias("anchors")).first()
    width, count = size["width"], size["anchors"]
    sample = rows.select("id", "x").orderBy(F.xxhash64("id"), "id", "x").limit(SAMPLE).toArrow().combine_chunks()
    x = _matrix(sample.column("x").chunk(0), width) if sample.num_rows and width else np.zeros((0, width), np.int32)
    books = fit(x, width)
    index = build_index(rows, books, width)
    spark = embeddings.sparkSession
    parts = max(1, min(index.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    anchors = materialize(rows.filter(F.col("id") % EVERY == 0).withColumn("key", F.monotonically_increasing_id()), "anchors")
    none = F.array().cast("array<long>")
    packed = pack_anchors(anchors.withColumn("scores", none), count, width)
    positives = materialize(_first(_search(pairs(index, packed, parts), books, width, False), POSITIVES), "positives")
    # an anchor's positives in their order, so that place j of the second pass is rank j + 1 of the first
    opened = positives.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("scores")).withColumnRenamed("key", "_key")
    unused = F.array(*[F.lit(-1).cast("long")] * POSITIVES)
    scored = anchors.join(opened, F.col("key") == F.col("_key")).withColumn("scores", F.slice(F.concat("scores", unused), 1, POSITIVES))
    packed = pack_anchors(scored, count, width)
    negatives = _first(_search(pairs(index, packed, parts), books, width, True), NEGATIVES)
    pos = positives.select(F.col("key").alias("_key"), (F.col("rank") - 1).alias("_place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.join(pos, (F.col("key") == F.col("_key")) & (F.col("place") == F.col("_place"))).join(anchors.select(F.col("key").alias("_own"), F.col("id").alias("anchor_id")), F.col("key") == F.col("_own"))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
