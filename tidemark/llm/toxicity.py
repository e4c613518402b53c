"""Toxicity as a severity grade, by cumulative-link ordinal regression on sparse text features.

Features are the presence of words and of word beginnings (lower case, split at punctuation).
The model has one weight per feature, shared by all grades, and ordered thresholds: the
probability of a grade above k is ``s(w x - t_k)``. Expected severity is the sum over k.

Labels say only whether a text is toxic. Toxic texts are graded 1 to ``GRADES`` by how many of
the tell-tale features they hold, that is those that toxic training texts hold far more often
than others; cuts are the quantiles among toxic texts. Others are grade 0.

The model is fitted on at most ``2 * SAMPLE`` labelled ids, about ``SAMPLE`` on average, drawn
by a hash of the id, and on at most ``MOST`` features, those with the largest z-scores. Texts'
features are counted where they lie; the driver gets the chosen features and which of them each
drawn text holds. Null labels teach nothing; repeated labels of an id count as toxic if any
is. Null and empty texts hold no feature. Without labels, or toxic ones, all severities are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import materialize
from tidemark.llm.words import pieces

SAMPLE, MOST, GRADES = 6000, 20_000, 3
HEADS = (5, 6, 7)
#: A feature must occur in so many sampled texts; a tell-tale has this least share of toxic ones and z-score.
LEAST_TEXTS, TELL_SHARE, LEAST_Z = 4, 0.8, 3.0
PENALTY, ROUNDS = 5e-5, 400
_U = np.uint64
#: Features (sorted hashes), their weights, thresholds.
Model = tuple[np.ndarray, np.ndarray, np.ndarray]


def _present(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For texts i..j: the hashes of all words and beginnings, and the text (from 0) of each."""
    for i, j, h, first in pieces(texts, lower=True, punctuation=True, heads=HEADS):
        owner = np.repeat(np.arange(j - i), np.diff(first) * (1 + len(HEADS)))
        flat = h.reshape(-1)
        real = flat != 0
        yield i, j, flat[real], owner[real]


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame | None:
    """node (hash of the text), toxic and the different features of the drawn texts; None without labels.

    Texts that repeat an id are drawn too, in order of their hashes, ``2 * size`` in all at most.
    """
    said = labels.filter("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    n = said.count()
    if not n:
        return None
    place = F.xxhash64(F.lit(11), "doc_id")
    drawn = said.filter(F.pmod(place, F.lit(1 << 30)) < int(min(1.0, size / n) * (1 << 30)))
    drawn = drawn.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(place, "doc_id").limit(2 * size)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(materialize(drawn, "drawn")), "doc_id").select(F.xxhash64("text").alias("node"), "toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, f, owner in _present(batch.column("text")):
                cut = np.searchsorted(owner, np.arange(j - i + 1))
                lists = [np.unique(f[a:b]).view(np.int64) for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, j - i), batch.column("toxic").slice(i, j - i), pa.array(lists, pa.list_(pa.int64()))], names=["node", "toxic", "features"])

    texts = materialize(rows.mapInArrow(run, "node long, toxic int, features array<long>"), "drawn_texts")
    each = texts.groupBy("node").agg(F.max("toxic").alias("_toxic")).orderBy("node").limit(2 * size).withColumnRenamed("node", "_node")
    return materialize(texts.dropDuplicates(["node"]).join(each, F.col("node") == F.col("_node")).select("node", F.col("_toxic").alias("toxic"), "features"), "sample")


def chosen(rows: DataFrame, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """The features that tell (hashes, ascending), and whether each is tell-tale of toxic texts; counted in Spark."""
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0))).first()
    if not bad:
        return np.zeros(0, _U), np.zeros(0, bool)
    rate = bad / n
    counts = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("df"), F.sum((F.col("toxic") > 0).cast("long")).alias("bad"))
    z = F.abs(F.col("bad") - F.col("df") * rate) / F.sqrt(F.col("df") * (rate * (1 - rate)) + 1e-9)
    told = counts.filter(F.col("df") >= LEAST_TEXTS).withColumn("z", z).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(most).toArrow()
    names = told.column("feature").to_numpy().view(_U)
    order = np.argsort(names)
    return names[order], (told.column("bad").to_numpy() >= TELL_SHARE * told.column("df").to_numpy())[order]


def held(rows: DataFrame, names: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each sampled text, in order of the nodes: the places in ``names`` of the features it holds, and whether it is toxic."""
    sent = rows.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            places = []
            for x in batch.column("features"):
                f = x.values.to_numpy().view(_U)
                at = np.minimum(np.searchsorted(known, f), len(known) - 1)
                places.append(at[known[at] == f].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("toxic"), pa.array(places, pa.list_(pa.int32()))], names=["node", "toxic", "places"])

    got = rows.mapInArrow(run, "node long, toxic int, places array<int>").toArrow().sort_by("node")
    return [x.values.to_numpy() for x in got.column("places").combine_chunks()], got.column("toxic").to_numpy() > 0


def grades(texts: list[np.ndarray], toxic: np.ndarray, tell: np.ndarray) -> np.ndarray:
    """Grades from 0: toxic texts by quantiles of their number of tell-tale features."""
    n = np.array([tell[x].sum() for x in texts])
    cuts = np.unique(np.quantile(n[toxic], np.arange(1, GRADES) / GRADES))
    return np.where(toxic, 1 + np.searchsorted(cuts, n, "left"), 0)


def loss(w: np.ndarray, t: np.ndarray, row: np.ndarray, column: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> float:
    """What ``ordinal`` makes least: the mean over texts of the grades' logistic losses, and the penalty."""
    score = np.bincount(row, w[column], minlength=len(y))
    sign = np.where(y[:, None] > np.arange(len(t)), 1, -1)
    return float(np.logaddexp(0, -sign * (score[:, None] - t)).sum() / len(y) + penalty * np.abs(w).sum())


def ordinal(row: np.ndarray, column: np.ndarray, width: int, y: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered thresholds of a cumulative logit, by accelerated proximal gradient.

    Text ``row[i]`` holds the feature ``column[i]``; ``y`` are grades from 0. The weights have an L1 penalty.
    """
    n, top = len(y), int(y.max())
    share = np.clip([(y > k).mean() for k in range(top)], 1e-6, 1 - 1e-6)
    w, t = np.zeros(width), -np.log(share / (1 - share))
    above = (y[:, None] > np.arange(top)).astype(float)
    # the step that the curvature allows, from the largest eigenvalue of X'X by power iteration
    u = np.ones(width)
    for _ in range(20):
        u = np.bincount(column, np.bincount(row, u[column], minlength=n)[row], minlength=width)
        u /= (size := np.linalg.norm(u))
    rate, v, old, s, was = 4.0 * n / (top * max(size, n) + n), w, w, t, t
    for i in range(rounds):
        score = np.bincount(row, v[column], minlength=n)
        p = 1 / (1 + np.exp(np.clip(s - score[:, None], -30, 30)))
        off = (p - above) / n
        new = v - rate * np.bincount(column, off.sum(1)[row], minlength=width)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        now = np.maximum.accumulate(s + rate * off.sum(0))
        v, s = new + i / (i + 3) * (new - old), now + i / (i + 3) * (now - was)
        old, was = new, now
    return old, was


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    none = np.zeros(0, _U), np.zeros(0), np.zeros(1)
    rows = sample(docs, labels)
    if rows is None:
        return none
    names, tell = chosen(rows)
    if not len(names):
        return none
    texts, toxic = held(rows, names)
    row, column = np.repeat(np.arange(len(texts)), [len(x) for x in texts]), np.concatenate(texts)
    w, t = ordinal(row, column, len(names), grades(texts, toxic, tell))
    kept = np.flatnonzero(w)
    return names[kept], w[kept], t


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, p_toxic (probability of a grade above 0), severity (expected grade) and grade of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, w, t = sent.value
        for batch in batches:
            for i, j, f, owner in _present(batch.column("text")):
                score = np.zeros(j - i)
                if len(names):
                    at = np.minimum(np.searchsorted(names, f), len(names) - 1)
                    hit = np.flatnonzero(names[at] == f)
                    once = np.unique(owner[hit] * len(names) + at[hit])
                    score = np.bincount(once // len(names), w[once % len(names)], minlength=j - i)
                    p = 1 / (1 + np.exp(np.clip(t - score[:, None], -30, 30)))
                else:
                    p = np.zeros((j - i, 1))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(p[:, 0].copy()), pa.array(p.sum(1)), pa.array((p >= 0.5).sum(1).astype(np.int32))], names=["doc_id", "p_toxic", "severity", "grade"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, p_toxic double, severity double, grade int")
