"""Walk-forward models: folds, ridge from monthly moments, boosted trees, evaluation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scratch import materialize
from tidemark.operators import trees
from tidemark.operators.ic import ic_by_cell, monthly_ic, summarize_ic
from tidemark.operators.perf import perf
from tidemark.operators.portfolio import strategy_returns
from tidemark.operators.xsection import demean_within, zscore_within


def numbered_months(df: DataFrame) -> DataFrame:
    """ym and its place ``i`` from 0 among the months of ``df``: one row per month."""
    return df.select("ym").distinct().withColumn("i", F.row_number().over(W.orderBy("ym")) - 1)


def walk_forward_folds(months: DataFrame, min_train: int = 48, step: int = 12, embargo: int = 1) -> DataFrame:
    """fold, first_test, last_test, last_train (months): test blocks of ``step`` months after an expanding training part.

    Training ends ``embargo`` months before the month that precedes the test block.
    """
    n = numbered_months(months)
    test = n.filter(F.col("i") >= min_train).withColumn("fold", F.floor((F.col("i") - min_train) / step).cast("int"))
    blocks = test.groupBy("fold").agg(F.min("ym").alias("first_test"), F.max("ym").alias("last_test"), F.min("i").alias("_i"))
    ends = n.select(F.col("i").alias("_j"), F.col("ym").alias("last_train"))
    return blocks.join(ends, F.col("_j") == F.col("_i") - 1 - embargo).select("fold", "first_test", "last_test", "last_train")


def prepare(df: DataFrame, features: Sequence[str], label: str = "fwd_ret_1m") -> DataFrame:
    """Rows with a label: features as z-scores of their cell, ``y`` the label less its cell's mean."""
    rows = df.filter(F.col(label).isNotNull() & F.col("group").isNotNull())
    return zscore_within(demean_within(rows, label, "y"), features)


def score_equal(df: DataFrame, features: Sequence[str], out: str = "s_equal") -> DataFrame:
    return df.withColumn(out, sum((F.col(f) for f in features), F.lit(0.0)) / len(features))


def _moments(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """ym, n and the sums of products of (1, features, y) per month: numpy within batches, sums after."""
    k = len(features) + 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for batch in batches:
            for ym, rows in batch.groupby("ym"):
                x = np.column_stack([np.ones(len(rows)), rows[[*features, "y"]].to_numpy(float)])
                total[ym] = total.get(ym, 0) + x.T @ x
        yield pd.DataFrame({"ym": list(total), "at": [list(range(k * k))] * len(total), "m": [g.reshape(-1).tolist() for g in total.values()]})

    parts = df.select("ym", *features, "y").mapInPandas(run, "ym date, at array<int>, m array<double>")
    cells = parts.select("ym", F.explode(F.arrays_zip("at", "m")).alias("c")).groupBy("ym", "c.at").agg(F.sum("c.m").alias("v"))
    return cells.groupBy("ym").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda c: c["v"]).alias("m"))


def ridge_weights(df: DataFrame, features: Sequence[str], folds: DataFrame, alpha: float = 10.0, least: int = 1000) -> DataFrame:
    """fold, first_test, last_test, w (intercept, then a weight per feature): ridge with a free intercept.

    One scan makes the moments of every month; a fold adds up those of its training months.
    Folds with fewer than ``least`` training rows are left out.
    """
    k = len(features)
    size = k + 2
    m = _moments(df, features)
    used = m.join(F.broadcast(folds), F.col("ym") <= F.col("last_train")).select("fold", "first_test", "last_test", F.posexplode("m").alias("at", "v"))
    sums = used.groupBy("fold", "first_test", "last_test", "at").agg(F.sum("v").alias("v")).groupBy("fold", "first_test", "last_test").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda c: c["v"]).alias("m"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                g = np.asarray(row.m).reshape(size, size)
                n, sx, sy = g[0, 0], g[0, 1:-1], g[0, -1]
                xx = g[1:-1, 1:-1] - np.outer(sx, sx) / n + alpha * np.eye(k)
                w = np.linalg.solve(xx, g[1:-1, -1] - sx * sy / n)
                out.append((row.fold, row.first_test, row.last_test, [float((sy - sx @ w) / n), *map(float, w)]))
            yield pd.DataFrame(out, columns=["fold", "first_test", "last_test", "w"])

    return sums.filter(F.get("m", F.lit(0)) >= least).mapInPandas(solve, "fold int, first_test date, last_test date, w array<double>")


#: Features that stand for an entity's size; the size-neutral variant of a model does without them.
SIZE_FEATURES = ("liq_amt", "neg_size")


def size_neutral(features: Sequence[str]) -> list[str]:
    return [f for f in features if f not in SIZE_FEATURES]


def score_ridge(df: DataFrame, features: Sequence[str], folds: DataFrame, alpha: float = 10.0, least: int = 1000, out: str = "s_ridge", train: DataFrame | None = None) -> DataFrame:
    """Out-of-sample scores: rows of test months, each by its fold's weights, which are learned from ``train`` (or ``df``)."""
    w = ridge_weights(df if train is None else train, features, folds, alpha, least)
    joined = df.join(F.broadcast(w), (F.col("ym") >= F.col("first_test")) & (F.col("ym") <= F.col("last_test")))
    score = sum((F.col(f) * F.get("w", F.lit(i + 1)) for i, f in enumerate(features)), F.get("w", F.lit(0)))
    return joined.withColumn(out, score).drop("w", "fold", "first_test", "last_test")


def fit_trees(df: DataFrame, features: Sequence[str], folds: DataFrame, variants: Mapping[str, Sequence[str]] | None = None, least: int = 1000, cuts: list[np.ndarray] | None = None, **settings: object) -> trees.Forest:
    """Boosted trees of all folds and variants (name -> features; by default one, ``gbt``, of all features) in one go."""
    own = {"gbt": features} if variants is None else variants
    return trees.fit(df, features, folds, own, least, cuts, trees.Settings(**settings))


def score_gbt(df: DataFrame, features: Sequence[str], folds: DataFrame, least: int = 1000, variants: Mapping[str, Sequence[str]] | None = None, cuts: list[np.ndarray] | None = None, **settings: object) -> DataFrame:
    """Out-of-sample scores of rows of test months, a column s_v for each variant v, by trees that are learned on a table written once."""
    df = materialize(df, "features")
    own = {"gbt": features} if variants is None else variants
    forest = fit_trees(df, features, folds, own, least, cuts, **settings)
    return trees.score(df, forest, {v: f"s_{v}" for v in own})


def score_ladder(df: DataFrame, features: Sequence[str], folds: DataFrame, least: int = 1000, **settings: object) -> DataFrame:
    """Rows of test months with the scores of all models: s_equal, s_ridge, s_gbt and s_gbt_neutral (trees without size features), learned in the same folds.

    ``df`` is read by every model, so it should be a written table.
    """
    variants = {"gbt": list(features), "gbt_neutral": size_neutral(features)}
    forest = fit_trees(df, features, folds, variants, least, **settings)
    out = score_ridge(score_equal(df, features), features, folds, least=least, train=df)
    return trees.score(out, forest, {v: f"s_{v}" for v in variants})


def feature_importance(df: DataFrame, features: Sequence[str], months: int = 49, show: int = 15, **settings: object) -> DataFrame:
    """The ``show`` most important features of one fit on the first months: how often each is split by, and its share of all gains."""
    df = df.select("ym", *[c for c in ("stock_id",) if c in df.columns], *features, "y")
    n = numbered_months(df)
    first = materialize(df.join(n.filter(F.col("i") < months).select("ym"), "ym", "left_semi"), "features")
    span = first.agg(F.max("ym").alias("last_train")).select("last_train", F.col("last_train").alias("first_test"), F.col("last_train").alias("last_test"))
    found = fit_trees(first, features, span.filter("last_train is not null"), least=0, **settings).importance()
    total = sum(g for g, _ in found.values()) or 1.0
    rows = [(f, g / total, n) for f, (g, n) in found.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, splits long").orderBy(F.desc("importance"), "feature").limit(show)


def evaluate_scores(scored: DataFrame, scores: Sequence[str], label: str = "fwd_ret_1m") -> DataFrame:
    """strategy, icir, cagr, sharpe, max_dd, turnover of each score column."""
    ic = summarize_ic(monthly_ic(ic_by_cell(scored, scores, label))).select(F.col("factor").alias("strategy"), "icir")
    returns = strategy_returns(scored, scores, label)
    good = perf(returns, "long", ("strategy",)).select("strategy", "cagr", "sharpe", "max_dd")
    return ic.join(good, "strategy", "left").join(returns.groupBy("strategy").agg(F.avg("turnover").alias("turnover")), "strategy", "left")
