"""Rank information coefficients of factors, per cell, month and split."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import materialize
from tidemark.operators.xsection import avg_rank


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; null, not an error, where a side does not vary."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def to_long(df: DataFrame, factors: Sequence[str], label: str, keys: Sequence[str] = ("ym", "group")) -> DataFrame:
    """A row per factor: keys, factor, x, y; pairs with a missing side or cell are dropped."""
    long = df.select(*keys, F.col(label).cast("double").alias("y"), *[F.col(f).cast("double").alias(f) for f in factors]).unpivot([*keys, "y"], list(factors), "factor", "x")
    return long.dropna(subset=["x", "y", *keys])


#: Values (rows by columns) of a cell that one task ranks in memory, 128 MB; larger cells are ranked by windows, which spill.
IN_MEMORY = 1 << 24


def _ranks(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Average ranks from 1 of values, whose sorted order is given."""
    ranked = x[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    ties = np.diff(np.append(first, len(x)))
    out = np.empty(len(x))
    out[order] = np.repeat(first + (ties + 1) / 2, ties)
    return out


def _correlations(x: Sequence[np.ndarray], y: np.ndarray, least: int) -> Iterator[tuple[int, int, float]]:
    """Place, pairs and Spearman's correlation of each column that has enough pairs with y and varies with it; y is sorted once."""
    by_y = np.argsort(y)
    for i, own in enumerate(x):
        has = ~np.isnan(own)
        n = int(has.sum())
        if n < max(least, 2):
            continue
        order = by_y if n == len(y) else (np.cumsum(has) - 1)[by_y[has[by_y]]]
        a, b = own[has], y[has]
        a, b = (_ranks(v, o) - (n + 1) / 2 for v, o in ((a, np.argsort(a)), (b, order)))
        spread = float(np.sqrt(a @ a) * np.sqrt(b @ b))
        if spread > 0:
            yield i, n, float(a @ b) / spread


def ic_by_cell(df: DataFrame, factors: Sequence[str], label: str = "fwd_ret_1m", least: int = 8, in_memory: int = IN_MEMORY) -> DataFrame:
    """factor, ym, group, n, ic: Spearman's correlation of cells with enough pairs that vary on both sides.

    ``df`` is written once. A cell of up to ``in_memory`` values is one group, whose columns are ranked beside each other and
    its label once for all of them; rows of larger cells become a row per factor and are ranked by windows.
    """
    factors, keys = list(factors), ["ym", "group"]
    number = {f"_x{i}": F.col(f"`{f}`").cast("double") for i, f in enumerate(factors)}
    rows = df.select(*keys, F.col(label).cast("double").alias("_y"), *[v.alias(k) for k, v in number.items()]).dropna(subset=["_y", *keys])
    rows = materialize(rows, "cells")
    large = materialize(rows.groupBy(*keys).agg(F.count("*").alias("_k")).filter(F.col("_k") * (len(factors) + 1) > in_memory).drop("_k"), "large")
    types, columns = {k: rows.schema[k].dataType.simpleString() for k in keys}, list(number)

    def run(cell: tuple, table: pa.Table) -> pa.Table:
        x = [table.column(c).to_numpy() for c in columns]
        found = [(factors[i], n, r) for i, n, r in _correlations(x, table.column("_y").to_numpy(), least)]
        names, sizes, values = zip(*found, strict=True) if found else ((), (), ())
        own = [pa.array([k.as_py()] * len(found), k.type) for k in cell]
        return pa.table([pa.array(names, pa.string()), *own, pa.array(sizes, pa.int64()), pa.array(values, pa.float64())], names=["factor", *keys, "n", "ic"])

    schema = f"factor string, ym {types['ym']}, `group` {types['group']}, n long, ic double"
    if large.isEmpty():
        return rows.groupBy(*keys).applyInArrow(run, schema)
    small, rest = (rows.join(large, keys, how) for how in ("left_anti", "left_semi"))
    return small.groupBy(*keys).applyInArrow(run, schema).unionByName(_ic_by_windows(rest.select(*keys, "_y", *[F.col(k).alias(f) for k, f in zip(number, factors, strict=True)]), factors, "_y", least))


def _ic_by_windows(df: DataFrame, factors: Sequence[str], label: str, least: int) -> DataFrame:
    cell = ["factor", "ym", "group"]
    ranked = to_long(df, factors, label).withColumns({"rx": avg_rank("x", cell), "ry": avg_rank("y", cell)})
    out = ranked.groupBy(*cell).agg(F.count("*").alias("n"), pearson(F.col("rx"), F.col("ry")).alias("ic"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return out.filter((F.col("n") >= least) & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))).select(*cell, "n", "ic")


def monthly_ic(cells: DataFrame) -> DataFrame:
    """factor, ym, ic: the mean over groups."""
    return cells.groupBy("factor", "ym").agg(F.avg("ic").alias("ic"))


def summarize_ic(series: DataFrame, by: Sequence[str] = ("factor",)) -> DataFrame:
    """ic_mean, ic_std, icir, t_stat, hit_rate, months of each series of monthly ICs."""
    mean, std, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    icir = F.try_divide(mean, std)
    return series.groupBy(*by).agg(mean.alias("ic_mean"), std.alias("ic_std"), icir.alias("icir"), (icir * F.sqrt(n)).alias("t_stat"), F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"), n.alias("months"))


def rank_factors(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.abs("icir").desc_nulls_last(), "factor")


def eval_split(cells: DataFrame, train_end: str, least_train: int = 12, least_test: int = 6) -> DataFrame:
    """Per factor: ic_mean_train, icir_train, t_train, icir_test, t_test; factors with too short a training part are left out."""
    split = F.when(F.col("ym") <= F.lit(train_end).cast("date"), "train").otherwise("test")
    s = summarize_ic(monthly_ic(cells).withColumn("split", split), ("factor", "split"))

    def pick(c: str, part: str, least: int) -> Column:
        return F.max(F.when((F.col("split") == part) & (F.col("months") >= least), F.col(c)))

    wide = s.groupBy("factor").agg(
        F.max(F.when(F.col("split") == "train", F.col("months"))).alias("_n"),
        pick("ic_mean", "train", least_train).alias("ic_mean_train"),
        pick("icir", "train", least_train).alias("icir_train"),
        pick("t_stat", "train", least_train).alias("t_train"),
        pick("icir", "test", least_test).alias("icir_test"),
        pick("t_stat", "test", least_test).alias("t_test"),
    )
    return wide.filter(F.col("_n") >= least_train).drop("_n")


def eval_split_groups(cells: DataFrame, train_end: str, least: int = 6) -> DataFrame:
    """factor, group, icir_train, icir_test of each group's own series."""
    split = F.when(F.col("ym") <= F.lit(train_end).cast("date"), "train").otherwise("test")
    s = summarize_ic(cells.withColumn("split", split), ("factor", "group", "split")).filter(F.col("months") >= least)
    return s.groupBy("factor", "group").agg(*[F.max(F.when(F.col("split") == p, F.col("icir"))).alias(f"icir_{p}") for p in ("train", "test")])


def broad_survivors(evaluated: DataFrame, least_t: float = 2.0, least_test: float = 0.2) -> DataFrame:
    return evaluated.filter((F.abs("t_train") > least_t) & (F.signum("icir_train") == F.signum("icir_test")) & (F.abs("icir_test") > least_test))


def group_survivors(evaluated: DataFrame, least_train: float = 0.3, least_test: float = 0.25) -> DataFrame:
    return evaluated.filter((F.abs("icir_train") > least_train) & (F.signum("icir_train") == F.signum("icir_test")) & (F.abs("icir_test") > least_test))


def top_factors(evaluated: DataFrame, by_group: DataFrame, groups: Sequence[str], show: int = 20) -> DataFrame:
    """The ``show`` factors of the largest abs(icir_train), with icir_train_g and icir_test_g of each of ``groups``."""
    top = evaluated.orderBy(F.abs("icir_train").desc_nulls_last(), "factor").limit(show)
    picks = [F.max(F.when(F.col("group") == g, F.col(f"icir_{p}"))).alias(f"icir_{p}_{g}") for g in groups for p in ("train", "test")]
    wide = by_group.groupBy(F.col("factor").alias("_f")).agg(*picks)
    return top.join(wide, F.col("factor") == F.col("_f"), "left").drop("_f")
