"""Tests for overfitting: deflated Sharpe ratio and the probability of backtest overfitting."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations
from statistics import NormalDist

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scratch import materialize
from tidemark.operators.ic import ic_by_cell, monthly_ic
from tidemark.operators.portfolio import strategy_returns
from tidemark.operators.xsection import avg_rank

EULER = 0.5772156649


def oriented_strategies(df: DataFrame, factors: Sequence[str], label: str = "fwd_ret_1m", least_rows: int = 100, models: Sequence[str] = ()) -> DataFrame:
    """Returns of each factor as a strategy, turned round where its mean monthly IC is negative or missing, and of each model's scores as they are.

    Factors and models with fewer than ``least_rows`` usable rows are left out.
    """
    df = materialize(df.select("stock_id", "ym", "group", label, *factors, *models), "strategies")
    mean = monthly_ic(ic_by_cell(df, factors, label)).groupBy("factor").agg(F.avg("ic").alias("m"))
    sign = {r["factor"]: 1.0 if r["m"] >= 0 else -1.0 for r in mean.collect()}
    every = [*factors, *models]
    rows = df.agg(*[F.count_if(F.col(f).isNotNull() & F.col(label).isNotNull()).alias(f) for f in every]).first()
    used = [f for f in every if rows[f] >= least_rows]
    return strategy_returns(df.withColumns({f: F.col(f) * sign.get(f, -1.0) for f in used if f in factors}), used, label)


def sharpe_moments(series: DataFrame, value: str = "active", by: str = "strategy") -> DataFrame:
    """by, months, sharpe (per month), skew and kurt (not excess), both corrected for bias."""
    n = F.count(value).cast("double")
    g1, g2 = F.skewness(value), F.kurtosis(value)
    varies = F.stddev_samp(value) > 0
    skew = F.when(varies & (n > 2), g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    excess = F.when(varies & (n > 3), (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * g2 + 6))
    return series.filter(F.col(value).isNotNull()).groupBy(by).agg(F.count(value).alias("months"), F.try_divide(F.avg(value), F.stddev_samp(value)).alias("sharpe"), skew.alias("skew"), (excess + 3).alias("kurt"))


def probabilistic_sharpe(sharpe: float, target: float, months: int, skew: float, kurt: float) -> float:
    """The probability that the true ratio exceeds the target."""
    spread = math.sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2)
    return NormalDist().cdf((sharpe - target) * math.sqrt(months - 1) / spread)


def deflated_sharpe(series: DataFrame, value: str = "active", by: str = "strategy") -> DataFrame:
    """by, months, sharpe, target, n_trials, deflated: each series against the best ratio that so many trials give by chance."""
    own = materialize(sharpe_moments(series, value, by), "moments")
    trials = own.filter("sharpe is not null").agg(F.var_samp("sharpe").alias("v"), F.count("sharpe").alias("n_trials"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        normal = NormalDist()
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                target = p = None
                if r.n_trials > 1 and not math.isnan(r.v):
                    target = math.sqrt(r.v) * ((1 - EULER) * normal.inv_cdf(1 - 1 / r.n_trials) + EULER * normal.inv_cdf(1 - 1 / (r.n_trials * math.e)))
                    if r.months > 1 and not any(x is None or math.isnan(x) for x in (r.sharpe, r.skew, r.kurt)):
                        p = probabilistic_sharpe(r.sharpe, target, r.months, r.skew, r.kurt)
                rows.append((getattr(r, by), r.months, r.sharpe, target, r.n_trials, p))
            yield pd.DataFrame(rows, columns=[by, "months", "sharpe", "target", "n_trials", "deflated"])

    return own.join(F.broadcast(trials)).mapInPandas(run, f"{by} string, months long, sharpe double, target double, n_trials long, deflated double")


def block_splits(blocks: int) -> list[tuple[int, int]]:
    """(split, block) of the blocks in sample, for all ways to choose half of them."""
    return [(i, b) for i, chosen in enumerate(combinations(range(1, blocks + 1), blocks // 2)) for b in chosen]


def cscv_splits(series: DataFrame, blocks: int = 12, value: str = "active", by: str = "strategy") -> DataFrame:
    """split, best strategy in sample, its logit out of sample, for every half of the blocks of months.

    Months that a strategy lacks are left out. A strategy's sums per block are enough for all
    splits; the sums of the other half are the totals less these.
    """
    # a row per strategy and month, read three times
    rows = materialize(series.filter(F.col(value).isNotNull()).select(by, "ym", F.col(value).alias("r")), "series")
    n = rows.agg(F.count_distinct(by).alias("n"))
    full = rows.groupBy("ym").agg(F.count("*").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select("ym")
    place = full.withColumn("block", F.ntile(blocks).over(W.orderBy("ym")))
    part = rows.join(F.broadcast(place), "ym").groupBy(by, "block").agg(F.count("*").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    whole = part.groupBy(by).agg(*[F.sum(c).alias(f"all_{c}") for c in "nsq"])
    chosen = series.sparkSession.createDataFrame(block_splits(blocks), "split int, block int")
    inside = part.join(F.broadcast(chosen), "block").groupBy("split", by).agg(*[F.sum(c).alias(c) for c in "nsq"]).join(F.broadcast(whole), by)

    def sharpe(n, s, q):  # noqa: ANN001, ANN202
        var = F.greatest(F.lit(0.0), q - s * s / n) / (n - 1)
        return F.try_divide(s / n, F.sqrt(var))

    c = F.col
    rated = inside.select("split", by, sharpe(c("n"), c("s"), c("q")).alias("in_sample"), sharpe(c("all_n") - c("n"), c("all_s") - c("s"), c("all_q") - c("q")).alias("out_sample")).filter("out_sample is not null")
    rated = rated.withColumns({"rank": avg_rank("out_sample", ["split"]), "trials": F.count("*").over(W.partitionBy("split")), "_b": F.row_number().over(W.partitionBy("split").orderBy(F.desc("in_sample"), by))})
    omega = c("rank") / (c("trials") + 1)
    return rated.filter("_b = 1").select("split", c(by).alias("best"), F.log(omega / (1 - omega)).alias("logit"))


def cscv_pbo(series: DataFrame, blocks: int = 12, value: str = "active", by: str = "strategy") -> DataFrame:
    """One row: n_splits and pbo, the share of splits whose best strategy is at or below the median afterwards."""
    return cscv_splits(series, blocks, value, by).agg(F.count("*").alias("n_splits"), F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"))
