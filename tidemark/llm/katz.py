"""Scoring texts with a Katz backoff model of words, of any order.

Counts of all n-grams up to ``ORDER`` are discounted by Good-Turing, and what a history's seen
n-grams leave goes to its unseen words in proportion to the next lower order: the backoff
weight is what is left, divided by what those words have there, so each history's
probabilities sum to one over the vocabulary and one unknown word. A token is evaluated
recursively, from the longest n-gram down to the first one seen.

The corpus is cut into blocks of tokens, each a row with its own vocabulary. For each order a
block asks for its different n-grams once: its sorted 64-bit keys are cut by ranges of the key
into buckets, packed as byte planes of their differences, and shuffled by bucket. A bucket adds
up the counts of all blocks and answers each block with its n-grams' counts; then, order by
order, blocks send for each history what its n-grams add up to, each n-gram by one block only,
and get the weights. So a frequent n-gram is one key of a block however often it occurs, keys
are dealt evenly, a row never leaves more than a block or a bucket in one place, and rows
between blocks and buckets hold an n-gram each at least, so they never outnumber the tokens.

Weights are made for histories that back off somewhere or might have nothing left: those in
texts that are not learned from, and those seen more than ``MOST`` times.

Null texts are empty: they hold the end token alone. Rows without id train. Repeated rows are
texts of their own. If nothing trains, known counts are 0 and each token has the unknown
word's probability, which then is 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import discard, materialize
from tidemark.llm.words import mix, pieces

ORDER = 3
#: Tokens of a block, about; keys that a bucket is asked for, about; counts above MOST are taken as they are.
BLOCK, BUCKET, MOST = 1_500_000, 4_000_000, 5
_U = np.uint64
_TIMES = _U(0x9E3779B97F4A7C15)
END, START = mix(np.array([0x656E64, 0x7374617274], _U))
BLOCKS = "block long, doc_id array<long>, train array<boolean>, size array<long>, words long, vocab binary, tokens binary"
ASKED = "bucket long, block long, n long, keys binary, counts binary, held binary"
SUMS = "bucket long, block long, n long, keys binary, counts binary, f1 binary, f2 binary"
#: Answers to a block (-1: a part of the model): kind n for counts of n-grams, -n for weights of histories of order n.
TOLD = "kind int, bucket long, block long, n long, keys binary, answers binary, owner binary, held binary, stats array<long>"
_TOLD = [x.split()[0] for x in TOLD.split(", ")]


def pack(x: np.ndarray) -> bytes:
    """Numbers from 0 as planes of their bytes, lowest first, without upper planes that are all zero."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(-1, n).T
    return out.reshape(-1).view("<u8")


def steps(keys: np.ndarray) -> np.ndarray:
    """The differences of keys, small where they ascend; ``np.cumsum`` gives the keys back."""
    return np.diff(keys, prepend=_U(0))


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def blocks(docs: DataFrame) -> DataFrame:
    """Rows of about BLOCK tokens from doc_id, text and train: ids, sizes and places in the block's vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, nth = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []

        def row() -> pa.RecordBatch:
            vocab, tokens = np.unique(np.concatenate([x[3] for x in held]), return_inverse=True)
            cols = [pa.array([base + nth]), *[pa.array([sum((x[k] for x in held), [])], t) for k, t in ((0, pa.list_(pa.int64())), (1, pa.list_(pa.bool_())))]]
            size = pa.array([np.concatenate([x[2] for x in held])], pa.list_(pa.int64()))
            # the more frequent, the smaller its place; in classes that double in size, so that keys ascend in each
            rank, place = np.empty(len(vocab), np.int64), np.empty(len(vocab), np.int64)
            rank[np.argsort(-np.bincount(tokens), kind="stable")] = np.arange(len(vocab))
            order = np.argsort(np.log2(rank // 256 + 1).astype(int), kind="stable")
            place[order] = np.arange(len(vocab))
            packed = [pa.array([x], pa.binary()) for x in (pack(steps(vocab[order])), pack(place[tokens]))]
            return pa.RecordBatch.from_arrays([*cols, size, pa.array([len(vocab)]), *packed], names=["block", "doc_id", "train", "size", "words", "vocab", "tokens"])

        for batch in batches:
            for i, j, h, first in pieces(batch.column("text"), lower=True):
                ids, train = batch.column("doc_id").slice(i, j - i).to_pylist(), batch.column("train").slice(i, j - i).to_pylist()
                held.append((ids, train, np.diff(first) + 1, np.insert(h, first[1:], END)))
                if sum(len(x[3]) for x in held) >= BLOCK:
                    yield row()
                    held, nth = [], nth + 1
        if held:
            yield row()

    return docs.mapInArrow(run, BLOCKS)


class Grams:
    """A block's different n-grams of one order.

    ``keys`` are ascending, ``at`` is each token's n-gram, ``past`` and ``rest`` are places in the
    order below: of an n-gram's history (one past the last is the start of texts) and of what is
    left without its first word.
    """

    def __init__(self, keys: np.ndarray, below: Grams | None, first: np.ndarray) -> None:
        self.keys, where, self.at = np.unique(keys, return_index=True, return_inverse=True)
        if below is not None:
            past = np.empty_like(below.at)
            past[1:] = below.at[:-1]
            past[first] = len(below.keys)
            self.past, self.rest = past[where], below.at[where]


class Block:
    def __init__(self, row: dict) -> None:
        self.id, self.doc_id, self.train = row["block"], row["doc_id"], np.array(row["train"], bool)
        self.size = np.array(row["size"], np.int64)
        self.first = np.cumsum(self.size) - self.size
        vocab = np.cumsum(unpack(row["vocab"], int(row["words"])), dtype=_U)
        self.words = vocab[unpack(row["tokens"], int(self.size.sum()))]
        self.trains = np.repeat(self.train, self.size)

    def names(self, order: int) -> Iterator[tuple[np.ndarray, np.uint64]]:
        """For each order up to ``order``: the keys of the n-grams that end at each token, and of a text's start."""
        keys, start = self.words, START
        for n in range(1, order + 1):
            if n > 1:
                past = np.empty_like(keys)
                past[1:] = keys[:-1]
                past[self.first] = start
                with np.errstate(over="ignore"):
                    keys, start = mix(past * _TIMES + self.words), mix(start * _TIMES + START)
            yield keys, start

    def grams(self, order: int) -> list[Grams]:
        out: list[Grams] = []
        for keys, _ in self.names(order):
            out.append(Grams(keys, out[-1] if out else None, self.first))
        return out


def cut(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The buckets that ascending keys lie in: equal ranges of the key's upper half."""
    place = ((keys >> _U(32)) * _U(buckets)) >> _U(32)
    bounds = np.append(np.flatnonzero(np.diff(place, prepend=_U(buckets))), len(keys)).tolist()
    for a, b in zip(bounds, bounds[1:], strict=False):
        yield int(place[a]), slice(a, b)


def ask(held: DataFrame, n: int, order: int, buckets: int) -> DataFrame:
    """The n-grams of each block with their counts in its training texts, and which are histories in its other texts."""
    names = [x.split()[0] for x in ASKED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = Block(batch.slice(k, 1).to_pylist()[0])
                *_, (keys, _) = x.names(n)
                keys, at = np.unique(keys, return_inverse=True)
                counts = np.bincount(at[x.trains], minlength=len(keys))
                history = np.zeros(len(keys), bool)
                if n < order:
                    inner = ~x.trains
                    inner[x.first + x.size - 1] = False
                    history[at[inner]] = True
                rows = [(b, x.id, s.stop - s.start, pack(steps(keys[s])), pack(counts[s]), np.packbits(history[s]).tobytes()) for b, s in cut(keys, buckets)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return held.mapInArrow(run, ASKED)


def _keys(rows: pd.DataFrame) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket's rows: their sizes, different keys, where each is first, and the key of each number."""
    sizes = rows["n"].tolist()
    keys = np.concatenate([np.cumsum(unpack(k, n), dtype=_U) for k, n in zip(rows["keys"], sizes, strict=True)])
    return sizes, *np.unique(keys, return_index=True, return_inverse=True)


def _joined(column: pd.Series, sizes: list[int]) -> np.ndarray:
    return np.concatenate([unpack(x, n) for x, n in zip(column, sizes, strict=True)])


def tell(asked: DataFrame, n: int, keep: bool) -> DataFrame:
    """Per bucket, to each block: its n-grams' counts in all, for which it is the one to speak, which are histories in texts not learned from.

    The row of block -1 has ``stats``: the sum, the number of different n-grams, and how many
    have the counts 1, 2, ...; with ``keep`` the bucket's n-grams and counts too.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sizes, keys, first, place = _keys(rows)
        total = np.bincount(place, _joined(rows["counts"], sizes)).astype(np.int64)
        history = np.zeros(len(keys), bool)
        history[place[np.concatenate([_bits(b, k) for b, k in zip(rows["held"], sizes, strict=True)])]] = True
        owner = np.zeros(len(place), bool)
        owner[first] = True
        stats = [int(total.sum()), int((total > 0).sum()), *np.bincount(np.minimum(total, MOST + 2), minlength=MOST + 3)[1 : MOST + 2].tolist()]
        seen = total > 0
        own = (pack(steps(keys[seen])), pack(total[seen])) if keep else (None, None)
        out = [(n, key[0], -1, int(seen.sum()), *own, None, None, stats)]
        at = 0
        for block, size in zip(rows["block"], sizes, strict=True):
            s = slice(at, at + size)
            out.append((n, key[0], block, size, None, pack(total[place[s]]), np.packbits(owner[s]).tobytes(), np.packbits(history[place[s]]).tobytes(), None))
            at += size
        return pd.DataFrame(out, columns=_TOLD)

    return asked.groupBy("bucket").applyInPandas(run, TOLD)


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing factors for the counts 0, 1, ..., MOST + 1 (the last for all greater ones) from the counts' counts n[0] (of 1), ...

    Where too few counts are there for a factor between 0 and 1, it is (r - 1/2) / r.
    """
    d = np.ones(MOST + 2)
    d[0] = 0
    top = (MOST + 1) * n[MOST] / n[0] if n[0] else 1.0
    for r in range(1, MOST + 1):
        x = ((r + 1) * n[r] / (r * n[r - 1]) - top) / (1 - top) if n[r - 1] and top < 1 else -1.0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


class Facts:
    """What all tasks know: order, buckets, discounts, and how much of the lowest order is left for unknown words."""

    def __init__(self, order: int, buckets: int, stats: dict[int, list[int]]) -> None:
        self.order, self.buckets = order, buckets
        self.d = {n: discounts(s[2:]) for n, s in stats.items()}
        self.n, self.v, counts = stats[1][0], stats[1][1], stats[1][2:]
        left = sum((1 - self.d[1][r]) * r * counts[r - 1] for r in range(1, MOST + 1)) / self.n if self.n else 1.0
        self.unknown = max(left, 0.5 / (self.n + 1))
        # 1 unless the least share for unknown words binds; then known words give it in proportion
        self.scale = (1 - self.unknown) / (1 - left) if left < 1 else 0.0

    def words(self, c: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.full(len(c), self.unknown)
        return np.where(c > 0, self.discounted(1, c) / self.n * self.scale, self.unknown)

    def discounted(self, n: int, c: np.ndarray) -> np.ndarray:
        return self.d[n][np.minimum(c, MOST + 1)] * c


class Told:
    """A block's n-grams up to an order with what the buckets told of them."""

    def __init__(self, x: Block, order: int, facts: Facts, told: pd.DataFrame) -> None:
        self.x, self.facts, self.grams = x, facts, x.grams(order)
        self.told = {(r.kind, r.bucket): r for r in told.itertuples()}
        self.count, self.owner, self.held, self.weight = [], [], [], {}
        for n, g in enumerate(self.grams, 1):
            count, owner, held = np.zeros(len(g.keys), np.int64), np.zeros(len(g.keys), bool), np.zeros(len(g.keys), bool)
            for b, s in cut(g.keys, facts.buckets):
                r, size = self.told[n, b], s.stop - s.start
                count[s], owner[s], held[s] = unpack(r.answers, size), _bits(r.owner, size), _bits(r.held, size)
            self.count.append(count)
            self.owner.append(owner)
            self.held.append(held)
        self.starts = [start for _, start in x.names(order)]
        # at an end no n-gram goes on; all texts have one, and a start
        ends = np.append(x.first[1:], len(x.words)) - 1
        self.as_past = []
        for g, c in zip(self.grams, self.count, strict=True):
            past = np.append(c, self.count[0][self.grams[0].at[ends[0]]])
            past[g.at[ends]] = 0
            self.as_past.append(past)
        for n in range(1, order):
            if any(kind == -n for kind, _ in self.told):
                self.weight[n] = self._weights(n)

    def histories(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Histories of order n that have weights, in order of their keys, and the keys."""
        past, held = self.as_past[n - 1], np.append(self.held[n - 1], True)
        some = np.flatnonzero((past > 0) & (held | (past > MOST)))
        names = np.append(self.grams[n - 1].keys, self.starts[n - 1])[some]
        order = np.argsort(names)
        return some[order], names[order]

    def _weights(self, n: int) -> np.ndarray:
        some, names = self.histories(n)
        out = np.ones(len(self.as_past[n - 1]))
        for b, s in cut(names, self.facts.buckets):
            out[some[s]] = np.frombuffer(self.told[-n, b].answers, np.float64)
        return out

    def probability(self, n: int) -> np.ndarray:
        """Of each different n-gram of order n: its last word after its history."""
        if n == 1:
            return self.facts.words(self.count[0])
        g, c, past = self.grams[n - 1], self.count[n - 1], self.as_past[n - 2]
        weight = self.weight[n - 1][g.past] if n - 1 in self.weight else np.ones(len(c))
        whole = np.maximum(past[g.past] + (weight < 0), 1)
        return np.where(c > 0, self.facts.discounted(n, c) / whole, np.abs(weight) * self.probability(n - 1)[g.rest])


def sums(held: DataFrame, told: DataFrame, n: int, facts: Facts) -> DataFrame:
    """For the histories of order n - 1 of each block: how often they go on, and what the n-grams it speaks for add up to, discounted and one order lower."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x = Told(Block(left.iloc[0].to_dict()), n, facts, right)
        some, names = x.histories(n - 1)
        past, c = x.as_past[n - 2], x.count[n - 1]
        spoken = np.flatnonzero(x.owner[n - 1] & (c > 0))
        of = x.grams[n - 1].past[spoken]
        f1 = np.bincount(of, facts.discounted(n, c[spoken]), minlength=len(past))
        f2 = np.bincount(of, x.probability(n - 1)[x.grams[n - 1].rest[spoken]], minlength=len(past))
        rows = [(b, x.x.id, s.stop - s.start, pack(steps(names[s])), pack(past[some[s]]), f1[some[s]].tobytes(), f2[some[s]].tobytes()) for b, s in cut(names, facts.buckets)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SUMS.split(", ")])

    return held.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(run, SUMS)


def weights(summed: DataFrame, n: int, keep: bool) -> DataFrame:
    """Backoff weights of histories of order n, to each block those that it sent; with ``keep`` the model's part too.

    A weight is negative where all of a history's counts go to seen n-grams undiscounted; there
    one more event stands for all others.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sizes, keys, first, place = _keys(rows)
        count = _joined(rows["counts"], sizes)[first].astype(np.float64)
        f1, f2 = (np.bincount(place, np.frombuffer(b"".join(rows[k]), np.float64)) for k in ("f1", "f2"))
        left = (count - f1) / count
        tight = left < 1e-9
        left = np.where(tight, (count + 1 - f1) / (count + 1), left)
        weight = np.where(tight, -1, 1) * left / np.maximum(1 - f2, 1e-12)
        out = [(-n, key[0], -1, len(keys), pack(steps(keys)), weight.tobytes(), None, None, None)] if keep else []
        at = 0
        for block, size in zip(rows["block"], sizes, strict=True):
            out.append((-n, key[0], block, size, None, weight[place[at : at + size]].tobytes(), None, None, None))
            at += size
        return pd.DataFrame(out, columns=_TOLD)

    return summed.groupBy("bucket").applyInPandas(run, TOLD)


def scores(held: DataFrame, told: DataFrame, facts: Facts) -> DataFrame:
    """doc_id, train, n_tokens, n_known, base_score and score of every text."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x = Told(Block(left.iloc[0].to_dict()), facts.order, facts, right)
        b, c, at = x.x, x.count[0], x.grams[0].at
        base = np.log10((c + 0.1) / (facts.n + 0.1 * (facts.v + 1)))
        score = np.log10(x.probability(facts.order))[x.grams[-1].at]
        add = np.add.reduceat
        return pd.DataFrame(
            {
                "doc_id": pd.array(list(b.doc_id), dtype="Int64"),
                "train": b.train,
                "n_tokens": b.size,
                "n_known": add((c > 0)[at].astype(np.int64), b.first),
                "base_score": add(base[at], b.first),
                "score": add(score, b.first),
            }
        )

    return held.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(run, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")


def score_texts(docs: DataFrame, order: int = ORDER, keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """(scores, model) from doc_id, text and train (whether the text is learned from).

    The scores have train_tokens too. With ``keep`` the model has the packed n-gram counts and
    backoff weights by kind and bucket, that is by range of the key; without, only what the
    blocks need is stored, by block and range, and the model is empty.
    """
    held = materialize(blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "train")), "blocks", "zstd")
    buckets = max(8, held.count() * BLOCK // BUCKET)
    counts = [materialize(tell(ask(held, n, order, buckets), n, keep), f"counts{n}", "zstd") for n in range(1, order + 1)]
    told, stats = counts[0], {}
    for n, c in enumerate(counts, 1):
        told = told if n == 1 else told.union(c)
        found = c.filter("stats is not null").agg(*[F.coalesce(F.sum(F.get("stats", F.lit(i))), F.lit(0)) for i in range(MOST + 3)]).first()
        stats[n] = [int(v) for v in found]
    facts = Facts(order, buckets, stats)
    for n in range(2, order + 1):
        part = materialize(sums(held, told.filter((F.col("kind") <= n) & (F.col("block") >= 0)), n, facts), f"sums{n}", "zstd")
        told = told.union(materialize(weights(part, n - 1, keep), f"weights{n - 1}", "zstd"))
        discard(part)
    out = scores(held, told.filter("block >= 0"), facts)
    model = told.filter("block < 0 and keys is not null").select("kind", "bucket", "n", "keys", F.col("answers").alias("values"))
    return out.withColumn("train_tokens", F.lit(facts.n).cast("long")), model


def read_model(model: DataFrame) -> DataFrame:
    """kind, key and value (count or weight) of every n-gram and history of a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, n, keys, values in zip(*(batch.column(c).to_pylist() for c in ("kind", "n", "keys", "values")), strict=True):
                value = unpack(values, n).astype(float) if kind > 0 else np.frombuffer(values, np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.cumsum(unpack(keys, n), dtype=_U).view(np.int64)), pa.array(value)], names=["kind", "key", "value"])

    return model.mapInArrow(run, "kind int, key long, value double")
