"""Boosted regression trees for every fold and variant at once.

Features are binned once, into one byte each of a stored table of blocks of rows. All models (a fold of a
variant) grow their trees together. Where the bins of the columns that a tree draws have few enough
combinations (``_JOINT``), a pass over the table adds up residuals and rows by (model, combination) within each task,
the sums of a model meet in one shuffle, and hold all that its tree hangs on: a tree is one job. With more columns
trees grow level by level: a pass adds up by (model, node, feature, bin), and the best split of each node
comes back, a row per node, so a tree of depth 5 is five jobs. No row is copied for a fold.

Residuals are added as whole numbers, of a scale at which their sums are exact in double: results
don't hang on how rows are dealt to tasks, and a lost task gives the same sums again. A split's gain is
G_l^2 / (n_l + penalty) + G_r^2 / (n_r + penalty) - G^2 / (n + penalty); of equal gains the
smaller feature and bin win. Nodes of fewer than ``leaf_rows`` rows are not made, a leaf's value is
rate * G / (n + penalty), and trees start from the mean. Each tree draws its columns and rows.

Leaves' values are whole numbers of a unit so fine that sums of them are exact too, in any order. So what all
trees that drew the same columns say of a combination is one sum, and a row's prediction is a value for each choice of columns:
where these tables are few (``_TABLES``), predictions are made as the binned table is read, and it is never written again.
Else predictions so far lie in the table; it is written anew every ``keep`` trees, and newer trees are evaluated as it is
read. Missing features count as 0, the mean of a cell.

A level of a small table is all waiting for its job. Where the rows and features of a model are known to
be no more than ``whole`` bytes, each model is grown in a task of its own instead, by the same sums and
splits; as the sums are exact, the trees are the same to the last bit. There only the smaller child of a node is added
up, the other is what is left of the node.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import discard, materialize, settings_of

#: Combinations of bins that are added up at once, and the bytes that a block of rows has at most; a task holds a few blocks several times over, whatever the table's size.
_JOINT, _BLOCK = 1 << 18, 1 << 21
#: The binned table: small groups of blocks in its files, and a few blocks at a time to Python; the defaults count rows, by a hundred or more at a time.
_FILES = {"parquet.block.size": 1 << 24, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
_BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 22)}
#: In a task's process, what ``_Pass.values`` made for the pass before, by fit, model and columns: how many trees, and their sums.
_KEPT: dict[tuple[str, int, tuple[int, ...]], tuple[int, np.ndarray]] = {}
#: Bytes of the tables of trees' values that a task holds at most; the rows of a model in one task that are taken at a time, so that their arrays stay in a core's cache.
_TABLES, _CHUNK = 1 << 28, 1 << 15
_TREE = {"feature": np.int64, "cut": np.int64, "value": np.float64, "gain": np.float64}
_GROWN = "model int, " + ", ".join(f"{c} binary" for c in _TREE)
_BLOCKS = "days binary, id binary, y binary, x binary, told binary"
_HIST = "model int, node int, g binary, n binary"
_SPLIT = "model int, node int, total double, rows double, feature int, bin int, gain double, left_total double, left_rows double"


@dataclass(frozen=True)
class Settings:
    """How trees are grown: shallow, slowly learned, with large leaves.

    Leaves' values are whole numbers of ``unit``, which ``fit`` takes from the largest label (0: they stay as they come).
    """

    trees: int = 300
    rate: float = 0.03
    depth: int = 5
    leaves: int = 31
    leaf_rows: int = 200
    rows: float = 0.8
    columns: float = 0.6
    penalty: float = 5.0
    bins: int = 64
    seed: int = 7
    keep: int = 5
    whole: int = 5 << 27
    unit: float = 0.0


@dataclass
class Tree:
    """Nodes in heap order: feature (-1: a leaf), the last bin that goes left, value and gain."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return cls(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros(size))

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The node where each row ends, by its bins (feature, row)."""
        at = np.zeros(x.shape[1], np.int64)
        for _ in range(len(self.feature).bit_length() - 1):
            f = self.feature[at]
            down = np.flatnonzero(f >= 0)
            if not len(down):
                break
            at[down] = 2 * at[down] + 1 + (x[f[down], down] > self.cut[at[down]])
        return at


@dataclass
class Model:
    """One fold of one variant and its trees."""

    variant: str
    first_test: date
    last_test: date
    last_train: date
    allowed: np.ndarray
    mean: float = 0.0
    trees: list[Tree] = field(default_factory=list)


@dataclass
class Forest:
    features: list[str]
    cuts: list[np.ndarray]
    models: list[Model]
    unit: float = 1.0

    def importance(self) -> dict[str, tuple[float, int]]:
        """feature -> summed gain and number of splits over all models."""
        gain, splits = np.zeros(len(self.features)), np.zeros(len(self.features), int)
        for m in self.models:
            for t in m.trees:
                used = t.feature >= 0
                np.add.at(gain, t.feature[used], t.gain[used])
                np.add.at(splits, t.feature[used], 1)
        return {f: (float(g), int(s)) for f, g, s in zip(self.features, gain, splits, strict=True)}


def _day(at: date) -> int:
    return (at - date(1970, 1, 1)).days


def quantile_cuts(df: DataFrame, features: Sequence[str], bins: int, accuracy: int = 10_000) -> list[np.ndarray]:
    """The bounds between ``bins`` bins of each feature, by mergeable quantile sketches of one pass."""
    levels = [k / bins for k in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.coalesce(F.col(f).cast("double"), F.lit(0.0)), levels, accuracy).alias(f"_{i}") for i, f in enumerate(features)]).first()
    return [np.unique(np.asarray(row[i] or [], float)) for i in range(len(features))]


def even_cuts(features: Sequence[str], low: float, high: float, step: float) -> list[np.ndarray]:
    """The same bounds for every feature, ``step`` apart."""
    return [np.arange(round((high - low) / step) + 1) * step + low for _ in features]


def _binned(columns: Sequence[np.ndarray], cuts: Sequence[np.ndarray]) -> np.ndarray:
    """A byte per feature and row: how many bounds lie below the value."""
    return np.stack([np.searchsorted(c, np.nan_to_num(x), "left").astype(np.uint8) for x, c in zip(columns, cuts, strict=True)])


def _numbers(batch: pa.RecordBatch, features: int) -> list[np.ndarray]:
    return [batch.column(f"_f{i}").fill_null(0.0).to_numpy(zero_copy_only=False).astype(float) for i in range(features)]


def _drawn(ids: np.ndarray, tree: int, settings: Settings) -> np.ndarray:
    """Whether each row is in the tree's sample, by a hash of row and tree."""
    if settings.rows >= 1:
        return np.ones(len(ids), bool)
    with np.errstate(over="ignore"):
        h = ids.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(tree + 1 + settings.seed * 1_000_003)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) < settings.rows * 2.0**53


def drawn_columns(allowed: np.ndarray, tree: int, model: int, settings: Settings) -> np.ndarray:
    """The features that a model's tree may split by."""
    k = max(1, int(np.ceil(settings.columns * len(allowed))))
    return np.sort(np.random.default_rng([settings.seed, tree, model]).choice(allowed, k, replace=False)) if k < len(allowed) else allowed


def best_split(g: np.ndarray, n: np.ndarray, columns: np.ndarray, scale: float, settings: Settings) -> tuple:
    """total, rows, feature, bin, gain, left total and left rows of a node's best split from its sums by (feature, bin); feature -1 if there is none."""
    total, rows = float(g[0].sum()), float(n[0].sum())
    left, below = np.cumsum(g, axis=1)[:, :-1], np.cumsum(n, axis=1)[:, :-1]

    def part(total: np.ndarray | float, rows: np.ndarray | float) -> np.ndarray | float:
        return (total / scale) ** 2 / (rows + settings.penalty)

    gain = part(left, below) + part(total - left, rows - below) - part(total, rows)
    gain[(below < settings.leaf_rows) | (rows - below < settings.leaf_rows)] = -np.inf
    at = int(np.argmax(gain)) if gain.size else 0
    if not gain.size or not gain.flat[at] > 0:
        return total, rows, -1, 0, 0.0, 0.0, 0.0
    f, b = divmod(at, gain.shape[1])
    return total, rows, int(columns[f]), b, float(gain[f, b]), float(left[f, b]), float(below[f, b])


def _cells(columns: np.ndarray, bins: int) -> int:
    """How many combinations of bins the columns have."""
    return bins ** len(columns)


def _joined(x: np.ndarray, columns: np.ndarray, bins: int) -> np.ndarray:
    """The number of each row's combination."""
    out = x[columns[0]].astype(np.uint16 if len(columns) > 1 else np.int64)
    for i, f in enumerate(columns[1:]):
        out = out.astype(np.int64) if i else out  # two columns of bytes fit into 16 bits
        out *= bins
        out += x[f]
    return out.astype(np.int64, copy=False)


def _boxes(tree: Tree, columns: np.ndarray, bins: int) -> Iterator[tuple[int, tuple[slice, ...]]]:
    """Every leaf and the combinations that end there, as a range of bins of each column."""
    place = {int(f): j for j, f in enumerate(columns)}
    due = [(0, (slice(0, bins),) * len(columns))]
    while due:
        node, box = due.pop()
        if 2 * node + 1 >= len(tree.feature) or tree.feature[node] < 0:
            yield node, box
        else:
            due += _halves(node, box, place[int(tree.feature[node])], int(tree.cut[node]))


def _halves(node: int, box: tuple[slice, ...], j: int, cut: int) -> list[tuple[int, tuple[slice, ...]]]:
    """Both children of a node that splits column ``j`` after bin ``cut``."""
    at = box[j]
    return [(2 * node + 1, (*box[:j], slice(at.start, cut + 1), *box[j + 1 :])), (2 * node + 2, (*box[:j], slice(cut + 1, at.stop), *box[j + 1 :]))]


def _leaf_values(tree: Tree, columns: np.ndarray, bins: int) -> np.ndarray:
    """What the tree says of every combination."""
    out = np.empty((bins,) * len(columns))
    for node, box in _boxes(tree, columns, bins):
        out[box] = tree.value[node]
    return out.reshape(-1)


def _summed_values(trees: Sequence[Tree], columns: Sequence[int], bins: int, unit: float) -> np.ndarray:
    """What the trees, whose leaves are whole numbers of ``unit``, say of every combination, added up.

    Every leaf is put down as differences at the corners of its combinations, and running sums along each column fill them in.
    """
    feature, cut = (np.stack([getattr(t, c) for t in trees]) for c in ("feature", "cut"))
    units = np.rint(np.stack([t.value for t in trees]) / unit).astype(np.int64)
    k, (n, size) = len(columns), feature.shape
    low, high = np.zeros((n, size, k), np.int64), np.full((n, size, k), bins, np.int64)
    made, place = np.zeros((n, size), bool), np.zeros(max(columns) + 1, np.int64)
    made[:, 0], place[list(columns)] = True, np.arange(k)
    for node in range(size // 2):
        split = np.flatnonzero(made[:, node] & (feature[:, node] >= 0))
        j = place[feature[split, node]]
        for child, side in ((2 * node + 1, high), (2 * node + 2, low)):
            low[split, child], high[split, child], made[split, child] = low[split, node], high[split, node], True
            side[split, child, j] = cut[split, node] + 1
    leaves = made & (feature < 0)
    low, high, units = low[leaves], high[leaves], units[leaves]
    out = np.zeros((bins + 1,) * k, np.int64)
    for corner in itertools.product((0, 1), repeat=k):
        np.add.at(out, tuple(np.where(corner, high, low).T), units * (-1) ** sum(corner))
    out = np.ascontiguousarray(out[(slice(bins),) * k])
    for j in range(k):
        along = np.moveaxis(out, j, 0)
        for i in range(1, bins):
            along[i] += along[i - 1]
    return out.reshape(-1) * unit


def _tables(models: Sequence[Model], bins: int, s: Settings) -> int:
    """Bytes of what ``_Pass.values`` holds of all trees of the models."""
    drawn = [len(drawn_columns(m.allowed, 0, k, s)) for k, m in enumerate(models)]
    return sum(min(math.comb(len(m.allowed), c), s.trees) * bins**c * 8 for m, c in zip(models, drawn, strict=True))


def _grow_joint(g: np.ndarray, n: np.ndarray, columns: np.ndarray, bins: int, scale: float, s: Settings) -> Tree:
    """A tree from the sums of residuals and rows of every combination."""
    k, t, leaves = len(columns), Tree.empty(s.depth), 1
    both = [a.reshape((bins,) * k) for a in (g, n)]
    place = {int(f): j for j, f in enumerate(columns)}
    level = [(0, (slice(0, bins),) * k)]
    for _ in range(s.depth):
        found = []
        for node, box in level:
            sums = np.zeros((2, k, bins))
            for i, a in enumerate(both):
                for j, at in enumerate(box):
                    sums[i, j, at] = a[box].sum(axis=tuple(o for o in range(k) if o != j))
            if sums[1, 0].sum():
                found.append((node, *best_split(*sums, columns, scale, s)))
        was, leaves = leaves, _extend(t, found, leaves, scale, s)
        if leaves == was:
            break
        level = [half for node, box in level if t.feature[node] >= 0 for half in _halves(node, box, place[int(t.feature[node])], int(t.cut[node]))]
    return t


class _Pass:
    """What a task needs to know: models as they stand, and the part of them that the table doesn't hold yet."""

    def __init__(self, models: Sequence[Model], held: int, bins: int, scale: float, settings: Settings, fit: str = "") -> None:
        self.fit, self.held, self.ends = fit, held, [_day(m.last_train) for m in models]
        self.means = [m.mean for m in models]
        self.newer: list[dict[tuple[int, ...], list[Tree]]] = [{} for _ in models]  # by the columns that they drew
        for k, m in enumerate(models):
            for i, t in enumerate(m.trees[held:]):
                self.newer[k].setdefault(tuple(map(int, drawn_columns(m.allowed, held + i, k, settings))), []).append(t)
        self.bins, self.scale, self.settings = bins, scale, settings

    def __getstate__(self) -> dict:
        """Trees of the same columns go to tasks as one array each, since there are many."""
        return self.__dict__ | {"newer": [{c: tuple(np.stack([getattr(t, a) for t in own]) for a in ("feature", "cut", "value")) for c, own in newer.items()} for newer in self.newer]}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"newer": [{c: [Tree(*one, np.zeros(0)) for one in zip(*own, strict=True)] for c, own in newer.items()} for newer in state["newer"]]}

    def _value(self, k: int, c: tuple[int, ...], own: Sequence[Tree]) -> np.ndarray:
        """What trees say of every combination; those that the process has added up for an earlier pass are not added up again, as sums are exact."""
        known, out = _KEPT.get((self.fit, k, c), (0, None)) if self.fit and not self.held else (0, None)
        if known > len(own):
            known, out = 0, None
        if known < len(own):
            new = _summed_values(own[known:], c, self.bins, self.settings.unit)
            out = new if out is None else out + new
        if self.fit and not self.held:
            _KEPT[self.fit, k, c] = (len(own), out)
        return out

    def values(self) -> list[dict[tuple[int, ...], np.ndarray | None]]:
        """What a model's newer trees of the same columns say of every combination, where these are few; made once in a task."""
        for key in [key for key in _KEPT if key[0] != self.fit]:
            del _KEPT[key]
        return [{c: self._value(k, c, own) if _cells(c, self.bins) <= _JOINT else None for c, own in newer.items()} for k, newer in enumerate(self.newer)]

    def blocks(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
        """Of each block the days, which ascend as far as folds can tell, ids, labels, bins by (feature, row) and predictions by (model, row) as far as the table holds them."""
        for cells in zip(*(batch.column(c) for c in ("days", "id", "y", "x", "told")), strict=True):
            days, ids, y, x, told = (np.frombuffer(c.as_buffer(), kind) for c, kind in zip(cells, (np.int32, np.int64, np.float64, np.uint8, np.float64), strict=True))
            yield days, ids, y, x.reshape(-1, len(days)), told.reshape(-1, len(days)) if len(told) else None

    def add(self, out: np.ndarray, k: int, x: np.ndarray, values: list[dict[tuple[int, ...], np.ndarray | None]], cells: dict[tuple[int, ...], np.ndarray]) -> None:
        """Add to ``out`` what the newer trees of model ``k`` say of the first rows of ``x``; ``cells`` keeps the rows' combinations for other models."""
        for c, own in self.newer[k].items():
            if values[k][c] is None:
                for t in own:
                    out += t.value[t.leaf(x[:, : len(out)])]
            else:
                if c not in cells:
                    cells[c] = _joined(x, c, self.bins)
                out += values[k][c].take(cells[c][: len(out)], mode="clip")

    def read(self, batch: pa.RecordBatch, values: list[dict[tuple[int, ...], np.ndarray | None]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """As ``blocks``, with all predictions."""
        for days, ids, y, x, held in self.blocks(batch):
            told, cells = np.repeat(self.means, len(days)).reshape(-1, len(days)) if held is None else held.copy(), {}
            for k, own in enumerate(told):
                self.add(own, k, x, values, cells)
            yield days, ids, y, x, told


def _add(g: np.ndarray, n: np.ndarray, x: Sequence[np.ndarray], rest: np.ndarray, node: np.ndarray) -> None:
    """Add residuals and rows to the sums (feature, node, bin) of one level; ``x`` holds pairs of features, as ``_pairs`` makes them."""
    width, bins = g.shape[1:]
    for i, pair in enumerate(x):
        own = slice(2 * i, 2 * i + 2)
        if 2 * i + 1 == len(g):  # the last of an odd number
            cell = node * bins + pair
            g[own] += np.bincount(cell, rest, width * bins).reshape(1, width, bins)
            n[own] += np.bincount(cell, minlength=width * bins).reshape(1, width, bins)
            continue
        cell = node * bins**2 + pair
        for out, sums in ((g, np.bincount(cell, rest, width * bins**2)), (n, np.bincount(cell, minlength=width * bins**2))):
            sums = sums.reshape(width, bins, bins)
            out[2 * i] += sums.sum(axis=2)
            out[2 * i + 1] += sums.sum(axis=1)


def _pairs(x: np.ndarray, columns: np.ndarray, rows: np.ndarray, bins: int) -> list[np.ndarray]:
    """The bins of two columns at a time in one number; the last of an odd number alone."""
    own = [x[f][rows].astype(np.uint16) for f in columns]
    return [own[j] * np.uint16(bins) + own[j + 1] if j + 1 < len(own) else own[j] for j in range(0, len(own), 2)]


def _sums(table: DataFrame, state: _Pass, growing: Sequence[Tree], columns: Sequence[np.ndarray], level: int, tree: int) -> DataFrame:
    """model, node and its sums of residuals and rows by (feature, bin): one row per task, model and node."""
    first, width, settings, bins = 2**level - 1, 2**level, state.settings, state.bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, values = [(np.zeros((len(c), width, bins)), np.zeros((len(c), width, bins))) for c in columns], state.values()
        for batch in batches:
            for days, ids, y, x, told in state.read(batch, values):
                drawn = _drawn(ids, tree, settings)
                for k, t in enumerate(growing):
                    rows = np.flatnonzero((days <= state.ends[k]) & drawn)
                    node = t.leaf(x[:, rows]) - first if level else np.zeros(len(rows), np.int64)
                    rows, node = rows[node >= 0], node[node >= 0]  # others have ended in a leaf above
                    _add(*sums[k], _pairs(x, columns[k], rows, bins), np.rint((y[rows] - told[k, rows]) * state.scale), node)
        out = [(k, first + i, g[:, i].tobytes(), n[:, i].tobytes()) for k, (g, n) in enumerate(sums) for i in np.flatnonzero(n[0].sum(1))]
        for at in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 64], strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["model", "node", "g", "n"])

    return table.mapInArrow(run, _HIST)


def _joint_sums(table: DataFrame, state: _Pass, columns: Sequence[np.ndarray], tree: int) -> DataFrame:
    """model and the sums of residuals and rows of the combinations that a task has, in ``node`` their number: one row per task and model."""
    bins, drawn = state.bins, [tuple(map(int, c)) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[np.ndarray] = []  # residuals and rows as the parts of complex numbers
        for batch in batches:
            if not sums:  # a task without rows makes none of this
                sums, values = [np.zeros(_cells(c, bins), complex) for c in columns], state.values()
            for days, ids, y, x, told in state.blocks(batch):
                rows = np.flatnonzero(_drawn(ids, tree, state.settings))
                own, label, cells = np.stack([f.take(rows) for f in x]), y[rows], {}
                for k, n in enumerate(np.searchsorted(days[rows], state.ends, "right")):
                    rest = np.full(n, state.means[k]) if told is None else told[k][rows[:n]]
                    state.add(rest, k, own, values, cells)
                    rest = np.rint((label[:n] - rest) * state.scale)
                    if drawn[k] not in cells:
                        cells[drawn[k]] = _joined(own, drawn[k], bins)
                    np.add.at(sums[k], cells[drawn[k]][:n], rest + 1j)
        for k, both in enumerate(sums):
            g, n = both.real, both.imag
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in (used.astype(np.int32), g[used], n[used].astype(np.int32))]], names=["model", "cell", "g", "n"])

    return table.mapInArrow(run, "model int, cell binary, g binary, n binary")


def _packed(model: int, trees: Sequence[Tree]) -> pa.RecordBatch:
    """Trees of a model in one row."""
    return pa.RecordBatch.from_arrays([pa.array([model], pa.int32()), *[pa.array([b"".join(getattr(t, c).astype(kind).tobytes() for t in trees)], pa.binary()) for c, kind in _TREE.items()]], names=["model", *_TREE])


def _unpacked(grown: DataFrame, models: Sequence[Model], s: Settings) -> None:
    """Give the trees of ``_packed`` rows, which are collected, to their models."""
    for r in grown.collect():  # a row per model
        cells = [np.frombuffer(r[c], kind).reshape(-1, 2 ** (s.depth + 1) - 1) for c, kind in _TREE.items()]
        models[r["model"]].trees += [Tree(*own) for own in zip(*cells, strict=True)]


def _grown_joint(table: DataFrame, models: Sequence[Model], state: _Pass, columns: Sequence[np.ndarray], tree: int) -> None:
    """One tree more for each model, in one job: the sums of a model meet in a task of its own."""
    bins, scale, s = state.bins, state.scale, state.settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k, *cells in zip(*(batch.column(c) for c in ("model", "cell", "g", "n")), strict=True):
                used, g, n = (np.frombuffer(c.as_buffer(), kind) for c, kind in zip(cells, (np.int32, np.float64, np.int32), strict=True))
                size = _cells(columns[k.as_py()], bins)
                own = total.setdefault(k.as_py(), (np.zeros(size), np.zeros(size)))
                own[0][used] += g
                own[1][used] += n
        for k, (g, n) in total.items():
            yield _packed(k, [_grow_joint(g, n, columns[k], bins, scale, s)])

    _unpacked(_joint_sums(table, state, columns, tree).repartitionById(len(models), "model").mapInArrow(run, _GROWN), models, s)


def _splits(sums: DataFrame, parts: int, columns: Sequence[np.ndarray], bins: int, scale: float, settings: Settings) -> DataFrame:
    """The best split of every node: its sums meet in one task, which keeps one histogram per node of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for k, node, g, n in zip(*(batch.column(c).to_pylist() for c in ("model", "node", "g", "n")), strict=True):
                new = [np.frombuffer(b, np.float64).reshape(-1, bins) for b in (g, n)]
                total[k, node] = [a + b for a, b in zip(total[k, node], new, strict=True)] if (k, node) in total else new
        rows = [(k, node, *best_split(g, n, columns[k], scale, settings)) for (k, node), (g, n) in total.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i in (0, 1, 4, 5) else pa.float64()) for i, c in enumerate(zip(*rows, strict=True))], names=[c.split()[0] for c in _SPLIT.split(", ")])

    return sums.repartition(parts, "model", "node").mapInArrow(run, _SPLIT)


def _extend(tree: Tree, found: Sequence[tuple], leaves: int, scale: float, s: Settings) -> int:
    """Put the splits that a level found (node, then what ``best_split`` gives) into the tree, the best first while leaves are left; the number of leaves then."""
    def value(total: float, rows: float) -> float:
        out = s.rate * (total / scale) / (rows + s.penalty)
        return round(out / s.unit) * s.unit if s.unit else out

    for node, total, rows, feature, cut, gain, left, below in sorted(found, key=lambda r: (-r[5], r[0])):
        if node == 0:
            tree.value[0] = value(total, rows)
        if feature < 0 or leaves >= s.leaves:
            continue
        tree.feature[node], tree.cut[node], tree.gain[node] = feature, cut, gain
        tree.value[2 * node + 1] = value(left, below)
        tree.value[2 * node + 2] = value(total - left, rows - below)
        leaves += 1
    return leaves


def _grow(table: DataFrame, state: _Pass, columns: Sequence[np.ndarray], tree: int) -> list[Tree]:
    """One tree for each model, a level at a time: a job per level."""
    s, growing = state.settings, [Tree.empty(state.settings.depth) for _ in columns]
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = [1] * len(columns)
    for level in range(s.depth):
        sums = _sums(table, state, growing, columns, level, tree)
        found = _splits(sums, min(parts, len(columns) * 2**level), columns, state.bins, state.scale, s).collect()  # a row per model and node
        was = list(leaves)
        for k, t in enumerate(growing):
            leaves[k] = _extend(t, [tuple(r)[1:] for r in found if r["model"] == k], leaves[k], state.scale, s)
        if leaves == was:
            break
    return growing


def _grow_levels(x: np.ndarray, rest: np.ndarray, rows: np.ndarray, columns: np.ndarray, bins: int, scale: float, s: Settings) -> Tree:
    """A tree from its rows; of two children the smaller is added up, and the other is what is left of their parent.

    Two columns are added up at once, by their bins in one number, and residuals and rows in one pass as the parts of a complex number;
    so many rows at a time that all this stays in a core's cache. Each node keeps the places of its rows.
    """
    t, leaves, parts = Tree.empty(s.depth), 1, -(-len(columns) // 2)
    place = {int(f): j for j, f in enumerate(columns)}
    pairs, weights = np.empty((parts, len(rows)), np.uint16), rest + 1j
    table = np.empty((parts, bins**2), complex)

    def sums() -> tuple[np.ndarray, np.ndarray]:
        """The sums by (feature, bin) that lie in ``table``."""
        both = table.reshape(parts, bins, bins)
        out = np.stack([both.sum(2), both.sum(1)], 1).reshape(2 * parts, bins)[: len(columns)]
        return out.real.copy(), out.imag.copy()

    def added(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table[:] = 0
        for c in range(0, len(at), _CHUNK):
            own = at[c : c + _CHUNK]
            w = weights.take(own)
            for j in range(parts):
                np.add.at(table[j], pairs[j].take(own).astype(np.intp), w)
        return sums()

    def split(at: np.ndarray, f: int, cut: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows that go left and right."""
        j, second = divmod(place[f], 2)
        right = np.concatenate([(own % bins if second else own // bins) > cut for c in range(0, len(at), _CHUNK) for own in [pairs[j].take(at[c : c + _CHUNK])]])
        return at[~right], at[right]

    table[:] = 0
    for c in range(0, len(rows), _CHUNK):
        own, w = rows[c : c + _CHUNK], weights[c : c + _CHUNK]
        for j in range(parts):
            pair = x[columns[2 * j]].take(own).astype(np.uint16) * np.uint16(bins)
            if 2 * j + 1 < len(columns):
                pair += x[columns[2 * j + 1]].take(own)
            pairs[j, c : c + _CHUNK] = pair
            np.add.at(table[j], pair.astype(np.intp), w)
    level = {0: (np.arange(len(rows)), *sums())}
    for depth in range(s.depth):
        was, leaves = leaves, _extend(t, [(k, *best_split(g, n, columns, scale, s)) for k, (_, g, n) in level.items() if n[0].sum()], leaves, scale, s)
        if leaves == was or depth == s.depth - 1:
            break
        below = {}
        for k in [k for k in level if t.feature[k] >= 0]:
            at, g, n = level.pop(k)
            both = split(at, int(t.feature[k]), int(t.cut[k]))
            few = int(len(both[1]) < len(both[0]))
            own = added(both[few])
            below[2 * k + 1 + few] = (both[few], *own)
            below[2 * k + 2 - few] = (both[1 - few], g - own[0], n - own[1])
        level = below
    return t


def _follow(t: Tree, x: np.ndarray, told: np.ndarray) -> None:
    """Add to predictions what the tree says of each row."""
    for c in range(0, len(told), _CHUNK):
        due = [(0, np.arange(c, min(c + _CHUNK, len(told))))]
        while due:
            node, at = due.pop()
            if t.feature[node] < 0:
                told[at] += t.value[node]
            elif len(at):
                right = x[t.feature[node]].take(at) > t.cut[node]
                due += [(2 * node + 1, at[~right]), (2 * node + 2, at[right])]


def _grow_whole(x: np.ndarray, y: np.ndarray, ids: np.ndarray, mean: float, allowed: np.ndarray, model: int, bins: int, scale: float, s: Settings) -> list[Tree]:
    """All trees of one model from its rows."""
    told, out, newer = np.full(len(y), mean), [], ([], np.zeros(0))
    chunks = [slice(at, at + _CHUNK) for at in range(0, len(y), _CHUNK)]

    def follow(c: slice) -> None:
        """Bring the predictions of some rows up to the last tree that was grown from combinations."""
        if len(newer[1]):
            told[c] += newer[1].take(_joined(x[:, c], newer[0], bins), mode="clip")

    for i in range(s.trees):
        columns = drawn_columns(allowed, i, model, s)
        size = _cells(columns, bins)
        if size <= min(_JOINT, len(y) * s.depth):
            g, n = np.zeros(size), np.zeros(size)
            for c in chunks:
                follow(c)
                rows = np.flatnonzero(_drawn(ids[c], i, s))
                cell = _joined(x[:, c], columns, bins)[rows]
                np.add.at(g, cell, np.rint((y[c][rows] - told[c][rows]) * scale))
                np.add.at(n, cell, np.ones(len(rows)))
            t = _grow_joint(g, n, columns, bins, scale, s)
            newer = (columns, _leaf_values(t, columns, bins))
        else:
            for c in chunks:
                follow(c)
            rows = np.flatnonzero(_drawn(ids, i, s))
            t = _grow_levels(x, np.rint((y[rows] - told[rows]) * scale), rows, columns, bins, scale, s)
            _follow(t, x, told)
            newer = ([], np.zeros(0))
        out.append(t)
    return out


def _grown_whole(table: DataFrame, models: Sequence[Model], state: _Pass, sizes: Sequence[int]) -> None:
    """Fill in the trees of all models, each in a task; blocks are dealt to every model, which takes the rows of its training into arrays of their final size."""
    bins, scale, s = state.bins, state.scale, state.settings
    told = [(m.mean, m.allowed) for m in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, at, held = -1, 0, ()
        for batch in batches:
            for model, *cells in zip(*(batch.column(c) for c in ("model", "days", "y", "id", "x")), strict=True):
                k = model.as_py()
                days, *own = (np.frombuffer(c.as_buffer(), kind) for c, kind in zip(cells, (np.int32, np.float64, np.int64, np.uint8), strict=True))
                n = int(np.searchsorted(days, state.ends[k], "right"))  # days ascend
                own[2] = own[2].reshape(-1, len(days))
                if not held:
                    held = (np.empty(sizes[k]), np.empty(sizes[k], np.int64), np.empty((len(own[2]), sizes[k]), np.uint8))
                for out, more in zip(held, own, strict=True):
                    out[..., at : at + n] = more[..., :n]
                at += n
        if held:
            y, ids, x = held
            yield _packed(k, _grow_whole(x, y, ids, *told[k], k, bins, scale, s))

    each = F.explode(F.array(*[F.lit(k) for k in range(len(models))])).alias("model")
    _unpacked(table.select(each, "days", "id", "y", "x").repartitionById(len(models), "model").mapInArrow(run, _GROWN), models, s)


def _told(table: DataFrame, state: _Pass) -> DataFrame:
    """The table with the predictions of all trees so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = state.values()
        for batch in batches:
            for i, block in enumerate(state.read(batch, values)):
                own = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([pa.array([block[-1].tobytes()], pa.binary()) if c == "told" else own.column(c) for c in own.schema.names], names=own.schema.names)

    return table.mapInArrow(run, _BLOCKS)


def fit(df: DataFrame, features: Sequence[str], folds: DataFrame, variants: Mapping[str, Sequence[str]], least_rows: int = 1000, cuts: list[np.ndarray] | None = None, settings: Settings | None = None) -> Forest:
    """Trees for every fold (first_test, last_test, last_train) and variant (name -> the features it may use) of ``df`` (ym, features, y).

    Folds with fewer than ``least_rows`` training rows are left out. Without ``cuts``, bins are
    cut at quantiles of the first fold's training rows, which are in every fold's, so that no fold
    sees what lies after its training.
    """
    s, features = settings or Settings(), list(features)
    spans = sorted((r["last_train"], r["first_test"], r["last_test"]) for r in folds.collect())  # a row per fold
    key = ("stock_id", "ym") if "stock_id" in df.columns else ("ym", *features)  # what a tree's sample is drawn by
    rows = df.filter(F.col("y").isNotNull()).select("ym", F.xxhash64(*key).alias("id"), F.col("y").cast("double").alias("y"), *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)])
    sizes = rows.agg(*[F.count_if(F.col("ym") <= F.lit(end)).alias(f"n{i}") for i, (end, _, _) in enumerate(spans)], *[F.avg(F.when(F.col("ym") <= F.lit(end), F.col("y"))).alias(f"m{i}") for i, (end, _, _) in enumerate(spans)], F.max(F.abs("y")).alias("most"), F.count("*").alias("n")).first()
    used = [i for i in range(len(spans)) if sizes[f"n{i}"] >= least_rows]
    names = {f: i for i, f in enumerate(features)}
    models = [Model(v, spans[i][1], spans[i][2], spans[i][0], np.array(sorted(names[f] for f in own), np.int64), float(sizes[f"m{i}"])) for v, own in variants.items() for i in used if len(own)]
    if not models:
        return Forest(features, cuts or [np.zeros(0)] * len(features), [])
    train = rows.filter(F.col("ym") <= F.lit(max(m.last_train for m in models)))
    if cuts is None:
        cuts = quantile_cuts(train.filter(F.col("ym") <= F.lit(min(m.last_train for m in models))), [f"_f{i}" for i in range(len(features))], s.bins)
    bins = max(len(c) for c in cuts) + 1
    # predictions lie between the least and the largest label but for the rounding of leaves
    most = max(float(sizes["most"]), 1e-300)
    scale = 2.0 ** np.floor(np.log2(2.0**52 / (max(1, sizes["n"]) * 4 * most)))
    # a leaf's value is at most the rate times twice the largest label, so any sum of leaves and the mean is exact
    s = replace(s, unit=float(2.0 ** np.ceil(np.log2(most * (2 + 4 * s.rate * s.trees) / 2.0**52))))
    for m in models:
        m.mean = float(np.rint(m.mean * min(scale, 1 / s.unit)) / min(scale, 1 / s.unit))
    means = np.array([m.mean for m in models])
    whole = sizes["n"] * (len(features) + 32) <= s.whole
    joint = max(_cells(drawn_columns(m.allowed, 0, k, s), bins) for k, m in enumerate(models)) <= _JOINT
    bare = whole or (joint and _tables(models, bins, s) <= _TABLES)  # the table holds no predictions
    size = max(1024, _BLOCK // (20 + len(features) + (0 if bare else 8 * len(models))))

    # rows whose first column's bins are alike lie in the same blocks, in these by the second, so that what trees say of them lies close together
    near = sorted(range(len(features)), key=lambda f: -sum(f in m.allowed for m in models))[:2] if joint and not whole else []
    ends = np.array(sorted({_day(m.last_train) for m in models}))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                cells = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("ym", "id", "y")]
                held.append((cells[0].astype("datetime64[D]").astype(np.int32), *cells[1:], _binned(_numbers(batch, len(features)), cuts)))
                rows += batch.num_rows
            if held and (batch is None or rows >= size):
                block = [np.concatenate(c, axis=-1) for c in zip(*held, strict=True)]
                order = np.lexsort((block[-1][near[-1]], np.searchsorted(ends, block[0]))) if near else np.argsort(block[0], kind="stable")
                block = [*[c[..., order] for c in block], np.repeat(means, 0 if bare else rows)]
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in block], names=["days", "id", "y", "x", "told"])
                held, rows = [], 0

    parts = max(1, min(df.sparkSession.sparkContext.defaultParallelism, -(-sizes["n"] // size)))
    dealt = train.repartition(parts, "id")
    dealt = dealt.sortWithinPartitions(F.coalesce(f"_f{near[0]}", F.lit(0.0))) if near else dealt
    table, held = materialize(dealt.mapInArrow(start, _BLOCKS), "binned", "snappy", _FILES), 0
    fit = uuid.uuid4().hex
    with settings_of(df.sparkSession, _BATCH):
        if whole and s.trees:
            _grown_whole(table, models, _Pass(models, 0, bins, scale, s), [sizes[f"n{i}"] for _, own in variants.items() for i in used if len(own)])
        for t in range(len(models[0].trees), s.trees):
            if not bare and t - held >= s.keep:
                was, table = table, materialize(_told(table, _Pass(models, held, bins, scale, s)), "told", "snappy", _FILES)
                discard(was)
                held = t
            columns = [drawn_columns(m.allowed, t, k, s) for k, m in enumerate(models)]
            state = _Pass(models, held, bins, scale, s, fit)
            if joint:
                _grown_joint(table, models, state, columns, t)
                continue
            for m, tree in zip(models, _grow(table, state, columns, t), strict=True):
                m.trees.append(tree)
    discard(table)
    return Forest(features, cuts, models, s.unit)


def _by_columns(trees: Sequence[Tree], bins: int, most: int) -> dict[tuple[int, ...], list[Tree]]:
    """Trees by the columns whose combinations they are evaluated by: those that they split by, or more. By no column those that have too many, and all if their tables took more than ``most`` bytes."""
    split = [tuple(map(int, np.unique(t.feature[t.feature >= 0]))) or (0,) for t in trees]
    few = sorted({c for c in split if _cells(c, bins) <= _JOINT}, key=lambda c: (-len(c), c))
    found = {c: next((o for o in few if set(c) <= set(o)), ()) for c in set(split)}
    out: dict[tuple[int, ...], list[Tree]] = {}
    for c, t in zip(split, trees, strict=True):
        out.setdefault(found[c], []).append(t)
    return out if sum(_cells(c, bins) * 8 for c in out if c) <= most else {(): list(trees)}


def score(df: DataFrame, forest: Forest, out: Mapping[str, str]) -> DataFrame:
    """The rows of test months with a column per variant (variant -> column): what the trees of the row's fold say."""
    names = list(dict.fromkeys(m.variant for m in forest.models))
    packed = df.select(F.struct("*").alias("_row"), "ym", *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(forest.features)])
    tests = F.lit(False)
    for m in forest.models:
        tests = tests | F.col("ym").between(F.lit(m.first_test), F.lit(m.last_test))

    bins, most = max([len(c) for c in forest.cuts], default=0) + 1, _TABLES // max(1, len(forest.models))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values: dict[int, dict[tuple[int, ...], np.ndarray | list[Tree]]] = {}
        _KEPT.clear()
        for batch in batches:
            x = _binned(_numbers(batch, len(forest.features)), forest.cuts)
            days = batch.column("ym").to_numpy(zero_copy_only=False).astype("datetime64[D]")
            told = {v: np.full(batch.num_rows, np.nan) for v in names}
            for k, m in enumerate(forest.models):
                rows = np.flatnonzero((days >= np.datetime64(m.first_test, "D")) & (days <= np.datetime64(m.last_test, "D")))
                if k not in values and len(rows):
                    values[k] = {c: _summed_values(own, c, bins, forest.unit) if c else own for c, own in _by_columns(m.trees, bins, most).items()}
                total, own = np.full(len(rows), m.mean), x[:, rows]
                for c, v in values.get(k, {}).items():
                    if c:
                        total += v.take(_joined(own, c, bins), mode="clip")
                    else:
                        for t in v:
                            total += t.value[t.leaf(own)]
                told[m.variant][rows] = total
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *[pa.array(told[v], pa.float64(), from_pandas=True) for v in names]], names=["_row", *[f"_v{i}" for i in range(len(names))]])

    schema = packed.schema["_row"].dataType.simpleString()
    done = packed.filter(tests).mapInArrow(run, f"_row {schema}, " + ", ".join(f"_v{i} double" for i in range(len(names)))) if names else packed.limit(0)
    return done.select("_row.*", *[(F.col(f"_v{names.index(v)}") if v in names else F.lit(None).cast("double")).alias(c) for v, c in out.items()])
