"""Cross-sectional operators: statistics of a month or cell are aggregated first and joined back."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scratch import materialize


def _same(by: Sequence[str], nulls: bool = False) -> Column:
    out = F.lit(True)
    for k in by:
        out = out & (F.col(k).eqNullSafe(F.col(f"_{k}")) if nulls else F.col(k) == F.col(f"_{k}"))
    return out


def _stats_join(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join a row per cell; Spark broadcasts it where it is small enough."""
    renamed = stats.select(*[F.col(k).alias(f"_{k}") for k in by], *[c for c in stats.columns if c not in by])
    return df.join(renamed, _same(by), "left").drop(*[f"_{k}" for k in by])


#: Distances in rank, as shares of a group, at which a sketch offers bounds of a tail; the last takes the whole group.
_MARGINS = (0.001, 0.004, 0.016, 0.064, 0.256, 1.0)


def tail_quantiles(df: DataFrame, columns: Sequence[str], by: Sequence[str], low: float, high: float, accuracy: int = 4000) -> DataFrame:
    """by and, for each column c, ``_q_c``: its exact, linearly interpolated quantiles at ``low`` and ``high`` (up to and from the median).

    No map of a group's values is kept. One pass makes a count and a sketch of each group and
    column; the sketch gives a bound that the quantile's two neighbours can't lie beyond, since its
    ranks err by 1 / accuracy at most. A second pass takes only the values in these tails,
    all columns at once, counts equal ones within tasks first, and adds the counts up to the rank that is asked for. A
    tail that turned out too short would be taken anew from the whole group. ``df`` is read
    twice, so it should be a written table.
    """
    levels = [min(1.0, low + m) for m in _MARGINS] + [max(0.0, high - m) for m in _MARGINS]
    k = len(_MARGINS)
    values = [F.col(c).cast("double") for c in columns]
    sketch = df.groupBy(*by).agg(F.array(*[F.struct(F.count(v).alias("n"), F.percentile_approx(v, levels, accuracy).alias("at")) for v in values]).alias("_sketch"))

    def bound(s: Column, first: int) -> Column:
        """The tightest bound whose margin covers the sketch's error and both neighbours."""
        out = F.get(s["at"], F.lit(first + k - 1))
        for j in reversed(range(k - 1)):
            out = F.when((_MARGINS[j] - 2.0 / accuracy) * s["n"] >= 3, F.get(s["at"], F.lit(first + j))).otherwise(out)
        return out

    bounds = sketch.select(*[F.col(c).alias(f"_{c}") for c in by], F.transform("_sketch", lambda s: F.struct(s["n"].alias("n"), bound(s, 0).alias("low"), bound(s, k).alias("high"))).alias("_b"))
    bounds = materialize(bounds, "bounds")

    def picked(bounds: DataFrame) -> DataFrame:
        """by, c (place of the column), side, v (the quantile; null where a tail is too short) from the rows within the bounds."""
        rows = df.select(*by, F.array(*values).alias("_v")).join(bounds, _same(by, nulls=True)).drop(*[f"_{c}" for c in by])
        tails = F.flatten(F.transform(F.arrays_zip("_v", "_b"), lambda x, i: F.array(*[F.struct(i.alias("c"), F.lit(side).alias("side"), F.when(x["_v"] <= x["_b"]["low"] if side == 0 else x["_v"] >= x["_b"]["high"], x["_v"]).alias("v"), x["_b"]["n"].alias("n")) for side in (0, 1)])))
        cells = rows.select(*by, F.explode(F.filter(tails, lambda t: t["v"].isNotNull())).alias("t")).groupBy(*by, "t.c", "t.side", "t.v").agg(F.count("*").alias("m"), F.first("t.n").alias("n"))
        # ranks count from the outer end of each tail; the upper one is turned round
        cell = W.partitionBy(*by, "c", "side").orderBy(F.when(F.col("side") == 0, F.col("v")).otherwise(-F.col("v")))
        upto = cells.withColumn("upto", F.sum("m").over(cell.rowsBetween(W.unboundedPreceding, 0)))
        place = F.when(F.col("side") == 0, F.lit(low)).otherwise(F.lit(1 - high)) * (F.col("n") - 1)
        upto = upto.withColumn("place", F.round(place, 9))
        near = F.floor("place").cast("long")

        def at(rank: Column) -> Column:
            first = F.when(F.col("upto") >= rank, F.col("v"))
            return F.when(F.max("side") == 0, F.min(first)).otherwise(F.max(first))

        found = upto.groupBy(*by, "c", "side").agg(at(near + 1).alias("a"), at(F.least(near + 2, F.col("n"))).alias("b"), F.first("place").alias("place"))
        part = F.col("place") - F.floor("place")
        return found.select(*by, "c", "side", (F.col("a") + part * (F.col("b") - F.col("a"))).alias("v"))

    found = materialize(picked(bounds), "quantiles")
    done = found.filter("v is not null").groupBy(*[F.col(c).alias(f"_h{c}") for c in by]).agg(F.count("*").alias("_done"))
    same = [F.col(f"_{c}").eqNullSafe(F.col(f"_h{c}")) for c in by]
    due = 2 * F.size(F.filter("_b", lambda b: b["n"] > 0))
    again = bounds.join(done, same, "left").filter(F.coalesce("_done", F.lit(0)) < due).select(*bounds.columns)
    if not again.isEmpty():
        whole = again.withColumn("_b", F.transform("_b", lambda b: F.struct(b["n"].alias("n"), F.lit(float("inf")).alias("low"), F.lit(float("-inf")).alias("high"))))
        found = found.filter("v is not null").unionByName(materialize(picked(whole), "quantiles")).groupBy(*by, "c", "side").agg(F.first("v").alias("v"))
    q = [F.array(*[F.max(F.when((F.col("c") == i) & (F.col("side") == side), F.col("v"))) for side in (0, 1)]).alias(f"_q_{c}") for i, c in enumerate(columns)]
    return found.groupBy(*by).agg(*q)


#: From so many columns on, what Spark generates for an expression per column is too long to be compiled, and groups of up to ``IN_TASK`` values are done by numpy instead.
WIDE, IN_TASK = 9, 1 << 24
#: Values that a task holds at a time while it packs them.
_PACKED = 1 << 22


def _largest(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the largest group."""
    return df.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.max("_n").alias("n")).first()["n"] or 0


def _tail(values: np.ndarray, share: float, lower: bool) -> float:
    """The quantile that lies ``share`` from one end, as ``tail_quantiles`` counts and interpolates it."""
    place = round(share * (len(values) - 1), 9)
    near = math.floor(place)
    ranks = [near, min(near + 1, len(values) - 1)]
    a, b = np.partition(values, ranks if lower else [len(values) - 1 - r for r in ranks])[ranks if lower else [len(values) - 1 - r for r in ranks]]
    return float(a + (place - near) * (b - a))


def packed_quantiles(df: DataFrame, columns: Sequence[str], by: Sequence[str], low: float, high: float) -> DataFrame:
    """As ``tail_quantiles``, in one pass, for groups of which a task can hold a column: each task packs its values by group and column, and the arrays of one group and column meet in one group.

    Rows with a null key are left out.
    """
    types = {k: df.schema[k].dataType.simpleString() for k in by}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if held and (batch is None or rows * len(columns) >= _PACKED):
                table = pa.Table.from_batches(held)
                code = table.select(list(by)).to_pandas().groupby(list(by), sort=False).ngroup().to_numpy()
                order = np.argsort(code, kind="stable")
                first = order[np.flatnonzero(np.diff(code[order], prepend=-1))]
                keys, sorted_codes = table.select(list(by)).take(pa.array(first)), code[order]
                for i in range(len(columns)):
                    column = table.column(f"_v{i}").combine_chunks()
                    has = column.is_valid().to_numpy(zero_copy_only=False)[order]
                    values = column.fill_null(0.0).to_numpy(zero_copy_only=False)[order][has]
                    ends = np.concatenate([[0], np.cumsum(np.bincount(sorted_codes[has], minlength=len(first)))]) * 8
                    cells = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])
                    yield pa.RecordBatch.from_arrays([*[keys.column(k).combine_chunks() for k in by], pa.array(np.full(len(first), i, np.int32)), cells], names=[*by, "c", "v"])
                held, rows = [], 0

    def found(cell: tuple, table: pa.Table) -> pa.Table:
        values = np.concatenate([np.frombuffer(v.as_buffer(), np.float64) for v in table.column("v")])
        q = [_tail(values, low, True), _tail(values, 1 - high, False)] if len(values) else [None, None]
        return pa.table([*[pa.array([k.as_py()], k.type) for k in cell], pa.array([q], pa.list_(pa.float64()))], names=[*by, "c", "q"])

    keyed = ", ".join(f"`{k}` {t}" for k, t in types.items())
    packed = df.dropna(subset=list(by)).select(*by, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)]).mapInArrow(pack, f"{keyed}, c int, v binary")
    cells = packed.groupBy(*by, "c").applyInArrow(found, f"{keyed}, c int, q array<double>")
    every = cells.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("c", "q"))).alias("_all"))
    return every.select(*by, *[F.col("_all")[i].alias(f"_q_{c}") for i, c in enumerate(columns)])


def winsorize_by(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("ym",), low: float = 0.01, high: float = 0.99, accuracy: int | None = None) -> DataFrame:
    """Clip to the quantiles of the non-missing values of each group.

    Quantiles are exact and linearly interpolated, by ``tail_quantiles`` or, for many columns of
    groups that fit into a task, ``packed_quantiles``, and ``df`` is written once for its passes; with ``accuracy`` mergeable sketches of bounded size give them in one pass.
    """
    if accuracy is None:
        df = materialize(df, "unclipped")
        if len(columns) >= WIDE and _largest(df, by) <= IN_TASK:
            bounds = materialize(packed_quantiles(df, columns, by, low, high), "quantiles")
        else:
            bounds = tail_quantiles(df, columns, by, low, high)
    else:
        bounds = df.groupBy(*by).agg(*[F.percentile_approx(c, F.array(F.lit(low), F.lit(high)), accuracy).alias(f"_q_{c}") for c in columns])
    clip = {c: F.when(F.col(c).isNotNull(), F.greatest(F.get(f"_q_{c}", F.lit(0)), F.least(F.get(f"_q_{c}", F.lit(1)), F.col(c)))) for c in columns}
    return _stats_join(df, bounds, by).withColumns(clip).drop(*[f"_q_{c}" for c in columns])


def zscore_within(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("ym", "group"), least_share: float = 0.0) -> DataFrame:
    """(x - mean) / std of the cell; 0 where x is missing, the std is 0 or null, or too few of the cell's values are there.

    Rows with a null key belong to no cell and get 0. Many columns of cells that fit into a task are done there beside each
    other; ``df`` is then read three times, so it should be a written table.
    """
    if len(columns) >= WIDE and _largest(df.dropna(subset=list(by)), by) * len(columns) <= IN_TASK:
        return _zscore_cells(df, columns, by, least_share)
    aggs = [F.count("*").alias("_n")]
    for c in columns:
        aggs += [F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"), F.count(c).alias(f"_c_{c}")]
    stats = df.dropna(subset=list(by)).groupBy(*by).agg(*aggs)

    def z(c: str) -> Column:
        enough = F.col(f"_c_{c}") >= F.lit(least_share) * F.col("_n")
        return F.coalesce(F.when(enough, F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}"))), F.lit(0.0))

    return _stats_join(df, stats, by).withColumns({c: z(c) for c in columns}).drop("_n", *[f"_{k}_{c}" for c in columns for k in "msc"])


def _zscore_cells(df: DataFrame, columns: Sequence[str], by: Sequence[str], least_share: float) -> DataFrame:
    """``zscore_within`` by a group for each cell."""
    wide = df.withColumns({c: F.col(c).cast("double") for c in columns if dict(df.dtypes)[c] != "double"})

    def run(table: pa.Table) -> pa.Table:
        for c in columns:
            own = table.column(c).combine_chunks()
            has = own.is_valid().to_numpy(zero_copy_only=False)
            x, z = own.drop_null().to_numpy(), np.zeros(len(has))
            if len(x) > 1 and len(x) >= least_share * len(has) and not x.min() == x.max():
                away = x - x.mean()
                z[has] = away / np.sqrt(away @ away / (len(x) - 1))
            table = table.set_column(table.schema.get_field_index(c), c, pa.array(z))
        return table

    known = F.lit(True)
    for k in by:
        known = known & F.col(k).isNotNull()
    done = wide.filter(known).groupBy(*by).applyInArrow(run, wide.schema)
    return done.unionByName(wide.filter(~known).withColumns({c: F.lit(0.0) for c in columns}))


def demean_within(df: DataFrame, column: str, out: str, by: Sequence[str] = ("ym", "group")) -> DataFrame:
    """The column less its cell's mean."""
    stats = df.dropna(subset=list(by)).groupBy(*by).agg(F.avg(column).alias("_mean"))
    return _stats_join(df, stats, by).withColumn(out, F.col(column) - F.col("_mean")).drop("_mean")


def avg_rank(column: str, by: Sequence[str]) -> Column:
    """Rank from 1 with ties at their average; nulls must have been filtered."""
    w = W.partitionBy(*by)
    ties = F.count("*").over(W.partitionBy(*by, column))
    return F.rank().over(w.orderBy(column)) + (ties - 1) / 2.0


def pct_rank_avg(df: DataFrame, column: str, by: Sequence[str], out: str, parts: int = 16) -> DataFrame:
    """Average rank over the number of non-missing values; null stays null.

    Quantile sketches part each group into ranges of values, about equal in rows, so that no
    window holds a group: a rank is that within its range plus the rows of the ranges before.
    Where the sketches cut decides how even the ranges are, not the ranks. ``df`` is written
    once: cuts, sizes and ranks all read it, so pass the columns that are needed.
    """
    df = materialize(df, "ranked")
    known = df.filter(F.col(column).isNotNull())
    cuts = known.groupBy(*by).agg(F.percentile_approx(column, F.array(*[F.lit(k / parts) for k in range(1, parts)]), 1000).alias("_cuts"))
    place = F.size(F.filter("_cuts", lambda c: c < F.col(column)))
    ranged = df.join(cuts.select(*[F.col(k).alias(f"_{k}") for k in by], "_cuts"), _same(by, nulls=True), "left").drop(*[f"_{k}" for k in by]).withColumn("_part", F.when(F.col(column).isNotNull(), place)).drop("_cuts")
    sizes = ranged.filter("_part is not null").groupBy(*by, "_part").agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(k).alias(f"_{k}") for k in by], F.col("_part").alias("_p"), before.alias("_before"), F.sum("_k").over(W.partitionBy(*by)).alias("_n"))
    w = W.partitionBy(*by, "_part")
    ties = F.count("*").over(W.partitionBy(*by, "_part", column))
    rank = F.when(F.col(column).isNotNull(), F.rank().over(w.orderBy(column)) + (ties - 1) / 2.0)
    ranked = ranged.withColumn("_rank", rank).join(sizes, _same(by, nulls=True) & (F.col("_part") == F.col("_p")), "left")
    return ranked.withColumn(out, (F.col("_rank") + F.col("_before")) / F.col("_n")).drop("_rank", "_part", "_p", "_before", "_n", *[f"_{k}" for k in by])


def feature_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, coverage (share of rows that have it), from one aggregate."""
    shares = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return shares.unpivot([], list(columns), "feature", "coverage")


def covered_features(df: DataFrame, columns: Sequence[str], least: float = 0.3) -> list[str]:
    """The columns that more than ``least`` of the rows have, in the given order."""
    have = {r["feature"] for r in feature_coverage(df, columns).filter(F.col("coverage") > least).collect()}
    return [c for c in columns if c in have]


def column_fingerprints(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """feature, fingerprint: a sum over rows of hashes of keys and value, so equal columns agree in any row order."""
    sums = [F.sum(F.xxhash64(*keys, F.coalesce(F.col(c).cast("double").cast("string"), F.lit("null"))).cast("decimal(38,0)")).alias(c) for c in columns]
    return df.agg(*sums).unpivot([], list(columns), "feature", "fingerprint")


def duplicate_columns(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Groups of columns that are equal in all rows, missing values included."""
    prints = column_fingerprints(df, columns, keys)
    return prints.groupBy("fingerprint").agg(F.array_sort(F.collect_list("feature")).alias("features")).filter(F.size("features") > 1).select("features")
