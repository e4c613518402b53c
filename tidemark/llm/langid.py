"""Language identification by a bidirectional gated recurrent network over bytes.

Every byte of a text is read, in windows of ``SPAN`` bytes; within a window one GRU runs
forward and one backward, both states label each byte with a distribution over the languages,
and the mean over all bytes of the text is its prediction. The network is trained in numpy by
backpropagation through time on spans of a bounded sample of labelled texts.

Only text and label of training rows are used; id, source and label never enter a prediction.
Texts that are null or have no letter are ``und`` with score 0. Without any training row
every text is ``und``. Null labels are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

HIDDEN = 8
SPAN = 64
#: Windows that run side by side.
SIDE = 4096
#: Training: texts per language, characters read of each at most, windows per step, steps.
SAMPLE, SAMPLE_BYTES, BATCH, STEPS = 250, 1024, 192, 220
#: Least score of a document that a corpus keeps.
SURE = 0.4
UND = "und"

Model = tuple[list[str], dict[str, np.ndarray]]


def sample(labelled: DataFrame, per_language: int = SAMPLE) -> tuple[list[bytes], list[str]]:
    """Texts and labels of about ``per_language`` different texts of each language, at most twice as many.

    Texts are drawn by their hashes, at a rate from the language's count, and a language that
    still has too many keeps those with the least hashes. The driver gets a row per language,
    then at most ``SAMPLE_BYTES`` characters from within each drawn text.
    """
    rows = labelled.filter("lang is not null and text is not null and length(text) > 0")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return [], []
    place = F.xxhash64(F.lit(7), "text")
    rate = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))]), F.col("lang"))
    start = F.greatest(F.lit(1), (F.pmod(F.xxhash64(F.lit(8), "text"), F.length("text"))).cast("int") - SAMPLE_BYTES // 2)
    drawn = rows.filter(F.pmod(place, F.lit(1 << 30)) / float(1 << 30) < rate).select("lang", place.alias("place"), F.substring(F.col("text"), start, F.lit(SAMPLE_BYTES)).alias("part"))
    # copies meet within tasks first
    drawn = drawn.groupBy("lang", "place").agg(F.min("part").alias("part"))
    nth = F.row_number().over(W.partitionBy("lang").orderBy("place"))
    got = sorted((r[1], r[0]) for r in drawn.withColumn("nth", nth).filter(F.col("nth") <= 2 * per_language).select("lang", "part").collect())
    return [p.encode() for p, _ in got], [k for _, k in got]


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), which stands for tanh: a few additions instead of an exponential."""
    return x / (1 + np.abs(x))


def _gate(x: np.ndarray) -> np.ndarray:
    return 0.5 * (_soft(x) + 1)


def _forward(p: dict[str, np.ndarray], d: str, x: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """States (T + 1, H, B) of one direction over bytes x (T, B), and what the way back needs."""
    e, u, b = p[f"E{d}"], p[f"U{d}"], p[f"b{d}"]
    h = np.zeros((len(x) + 1, HIDDEN, x.shape[1]), np.float32)
    kept = []
    for t in range(len(x)):
        a = np.take(e, x[t], axis=1)
        g = u @ h[t]
        zr = _gate(a[: 2 * HIDDEN] + g[: 2 * HIDDEN])
        z, r = zr[:HIDDEN], zr[HIDDEN:]
        inner = g[2 * HIDDEN :] + b
        n = _soft(a[2 * HIDDEN :] + r * inner)
        h[t + 1] = n + z * (h[t] - n)
        kept.append((z, r, n, inner))
    return h, kept


def _backward(p: dict[str, np.ndarray], d: str, x: np.ndarray, h: np.ndarray, kept: list, dh_out: np.ndarray, grad: dict[str, np.ndarray]) -> None:
    """Add the gradients of one direction, given those of its states."""
    u = p[f"U{d}"]
    carry = np.zeros_like(h[0])
    de, du, db = np.zeros((256, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros_like(p[f"b{d}"])
    for t in range(len(x) - 1, -1, -1):
        z, r, n, inner = kept[t]
        dh = dh_out[t] + carry
        dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
        dz = dh * (h[t] - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        dr = dn * inner * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        dg = np.concatenate([dz, dr, dn * r])
        carry = dh * z + u.T @ dg
        du += dg @ h[t].T
        db += dg[2 * HIDDEN :].sum(1, keepdims=True)
        np.add.at(de, x[t], np.concatenate([dz, dr, dn]).T)
    grad[f"E{d}"], grad[f"U{d}"], grad[f"b{d}"] = de.T.copy(), du, db


def loss_and_grad(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, live: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over the live bytes x (T, B) with window labels y (B,), and its gradient."""
    hf, kf = _forward(p, "f", x)
    hb, kb = _forward(p, "b", x[::-1])
    sf, sb = hf[1:], hb[1:][::-1]
    both = np.concatenate([sf, sb], axis=1)
    logits = np.einsum("ch,thb->tcb", p["W"], both) + p["c"]
    logits -= logits.max(1, keepdims=True)
    q = np.exp(logits)
    q /= q.sum(1, keepdims=True)
    total = live.sum()
    right = np.take_along_axis(q, np.broadcast_to(y, (len(x), 1, len(y))), 1)[:, 0]
    loss = float(-(np.log(right + 1e-9) * live).sum() / total)
    dl = q
    dl[np.arange(len(x))[:, None], y[None], np.arange(len(y))[None]] -= 1
    dl *= (live / total)[:, None].astype(np.float32)
    grad = {"W": np.einsum("tcb,thb->ch", dl, both), "c": dl.sum((0, 2))[:, None]}
    db = np.einsum("ch,tcb->thb", p["W"], dl)
    _backward(p, "f", x, hf, kf, db[:, :HIDDEN], grad)
    _backward(p, "b", x[::-1], hb, kb, db[::-1, HIDDEN:], grad)
    return loss, grad


def start(n_languages: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    def normal(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    p = {"W": normal(n_languages, 2 * HIDDEN, scale=0.3), "c": np.zeros((n_languages, 1), np.float32)}
    for d in "fb":
        p |= {f"E{d}": normal(3 * HIDDEN, 256, scale=0.5), f"U{d}": normal(3 * HIDDEN, HIDDEN, scale=0.35), f"b{d}": np.zeros((HIDDEN, 1), np.float32)}
    return p


def train(texts: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 1) -> Model:
    """Languages in order of their names and weights, by Adam over random spans."""
    names = sorted(set(labels))
    if not names:
        return [], {}
    rng = np.random.default_rng(seed)
    p = start(len(names), rng)
    by = [[t for t, k in zip(texts, labels, strict=True) if k == name] for name in names]
    m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        y = rng.integers(0, len(names), BATCH)
        x, live = np.full((SPAN, BATCH), 32, np.uint8), np.zeros((SPAN, BATCH), np.float32)
        for i, k in enumerate(y):
            t = by[k][rng.integers(len(by[k]))]
            at = rng.integers(0, max(1, len(t) - SPAN + 1))
            part = np.frombuffer(t[at : at + SPAN], np.uint8)
            x[: len(part), i], live[: len(part), i] = part, 1
        _, grad = loss_and_grad(p, x, y, live)
        rate = 0.03 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = np.clip(g, -1, 1)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return names, p


def _windows(p: dict[str, np.ndarray], x: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Sums (C, B) over the live bytes of windows x (T, B) of the labels' distributions."""
    span, side = x.shape
    logits = np.empty((span, len(p["W"]), side), np.float32)
    total = np.zeros((len(p["W"]), side), np.float32)
    for d, order in (("f", range(span)), ("b", range(span - 1, -1, -1))):
        e, u, b = p[f"E{d}"], p[f"U{d}"], p[f"b{d}"]
        w = p["W"][:, :HIDDEN] if d == "f" else p["W"][:, HIDDEN:]
        h = np.zeros((HIDDEN, side), np.float32)
        a, g, size = (np.empty((k * HIDDEN, side), np.float32) for k in (3, 3, 2))
        for t in order:
            if d == "b" and t + 1 < span and not live[t + 1].all():
                h *= live[t + 1]  # the way back begins at a window's last byte
            np.take(e, x[t], axis=1, out=a, mode="clip")
            np.matmul(u, h, out=g)
            zr = a[: 2 * HIDDEN]
            zr += g[: 2 * HIDDEN]
            np.abs(zr, out=size)
            size += 1
            zr /= size
            zr += 1
            zr *= 0.5
            n = g[2 * HIDDEN :]
            n += b
            n *= zr[HIDDEN:]
            n += a[2 * HIDDEN :]
            np.abs(n, out=size[:HIDDEN])
            size[:HIDDEN] += 1
            n /= size[:HIDDEN]
            h -= n
            h *= zr[:HIDDEN]
            h += n
            if d == "f":
                np.matmul(w, h, out=logits[t])
            else:
                s = logits[t]
                s += w @ h
                s += p["c"]
                np.exp(s, out=s)
                s *= live[t] / s.sum(0)
                total += s
    return total


def predict(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of each text by all its bytes; nulls must have been replaced."""
    names, p = model
    n = len(texts)
    if not names or not n:
        return [UND] * n, np.zeros(n)
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    size = np.diff(off)
    per = (size + SPAN - 1) // SPAN
    owner = np.repeat(np.arange(n), per)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    begin = off[owner] + nth * SPAN
    length = np.minimum(SPAN, off[owner + 1] - begin)
    pooled = np.zeros((n, len(names)))
    step = np.arange(SPAN)[:, None]
    for i in range(0, len(owner), SIDE):
        cut = slice(i, i + SIDE)
        live = step < length[cut]
        x = raw[np.minimum(begin[cut] + step, len(raw) - 1)]
        x[~live] = 32
        sums = _windows(p, x, live.astype(np.float32))
        first = np.flatnonzero(np.append(True, owner[cut][1:] != owner[cut][:-1]))
        pooled[owner[cut][first]] += np.add.reduceat(sums, first, axis=1).T
    pooled /= np.maximum(size, 1)[:, None]
    best = pooled.argmax(1)
    return [names[k] for k in best], np.clip(pooled[np.arange(n), best], 0, 1)


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """Whether a row is kept from training, by the checksum of its id; rows without id are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(False))


def fit(docs: DataFrame) -> Model:
    return train(*sample(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang")))


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` of every row with lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = docs.select(*carry).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = predict(batch.column("_text"), sent.value)
            rows = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(lang, pa.string()), pa.array(score)], names=[*carry, "_lang", "_score"])

    letters = F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).otherwise("")
    out = docs.select(*carry, letters.alias("_text"), (F.length(letters) > 0).alias("_any"))
    kind = fields.add("_any", "boolean").add("_lang", "string").add("_score", "double")
    carry = (*carry, "_any")
    fields = out.select(*carry).schema
    done = out.mapInArrow(run, kind)
    known = F.col("_any") & (F.col("_lang") != UND)
    return done.select(*carry[:-1], F.when(known, F.col("_lang")).otherwise(UND).alias("lang_pred"), F.when(known, F.col("_score")).otherwise(0.0).alias("score"))


def keep_known(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """The rows of ``docs`` whose language is predicted with at least the score ``sure``."""
    packed = docs.select(F.struct("*").alias("_doc"), "text")
    return identify(packed, fit(docs), ("_doc",)).filter((F.col("lang_pred") != UND) & (F.col("score") >= sure)).select("_doc.*")
