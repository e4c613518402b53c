"""Performance of monthly return series, alone and against benchmarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import month, ratio

YEAR = 12


def perf(series: DataFrame, value: str = "ret", by: Sequence[str] = ("series",), order: str = "ym", least: int = 6) -> DataFrame:
    """by, cagr, vol, sharpe, max_dd, win_rate, months of series with enough values.

    The drawdown is from the highest point of the curve since its first month.
    """
    rows = series.filter(F.col(value).isNotNull())
    past = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_curve", F.product(1 + F.col(value)).over(past))
    rows = rows.withColumn("_dd", F.col("_curve") / F.max("_curve").over(past) - 1)
    n, std = F.count(value), F.stddev_samp(value)
    return (
        rows.groupBy(*by)
        .agg(
            (F.pow(F.product(1 + F.col(value)), YEAR / n) - 1).alias("cagr"),
            (std * YEAR**0.5).alias("vol"),
            F.try_divide(F.avg(value) * YEAR, std * YEAR**0.5).alias("sharpe"),
            F.min("_dd").alias("max_dd"),
            F.avg((F.col(value) > 0).cast("double")).alias("win_rate"),
            n.alias("months"),
        )
        .filter(F.col("months") >= least)
    )


def excess_stats(active: Column) -> list[Column]:
    """Aggregates of an active return: ann_excess, ir, t_stat, win_rate, months."""
    mean, std, n = F.avg(active), F.stddev_samp(active), F.count(active)
    r = F.try_divide(mean, std)
    return [(mean * YEAR).alias("ann_excess"), (r * YEAR**0.5).alias("ir"), (r * F.sqrt(n)).alias("t_stat"), F.avg((active > 0).cast("double")).alias("win_rate"), n.alias("months")]


def active_stats(returns: DataFrame, leg: str = "long", benchmark: str = "benchmark", by: Sequence[str] = (), least: int = 6) -> DataFrame:
    active = F.col(leg) - F.col(benchmark)
    return returns.filter(active.isNotNull()).groupBy(*by).agg(*excess_stats(active)).filter(F.col("months") >= least)


def with_periods(df: DataFrame, train_end: str, order: str = "ym") -> DataFrame:
    """Each row twice: in the period full, and in train or test."""
    part = F.when(F.col(order) <= F.lit(train_end).cast("date"), "train").otherwise("test")
    return df.withColumn("period", F.explode(F.array(F.lit("full"), part)))


def leg_report(returns: DataFrame, train_end: str, legs: Sequence[str] = ("long", "long_short", "benchmark"), order: str = "ym") -> DataFrame:
    """leg, period and the performance of each, with the t value of its mean."""
    long = returns.select(order, *legs).unpivot([order], list(legs), "leg", "ret")
    rows = with_periods(long, train_end, order)
    out = perf(rows, "ret", ("leg", "period"), order)
    t = rows.groupBy("leg", "period").agg((F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * F.sqrt(F.count("ret"))).alias("t_stat"))
    return out.join(t, ["leg", "period"])


def monthly_last_return(prices: DataFrame, price: str, by: Sequence[str], date: str = "date") -> DataFrame:
    """by, ym, ret: change between the last non-null prices of successive months that have one."""
    last = prices.filter(F.col(price).isNotNull()).groupBy(*by, month(F.col(date)).alias("ym")).agg(F.max_by(price, date).alias("_p"))
    return last.withColumn("ret", ratio(F.col("_p"), F.lag("_p").over(W.partitionBy(*by).orderBy("ym"))) - 1).drop("_p")


def null_outlier_returns(df: DataFrame, value: str = "ret", limit: float = 0.4) -> DataFrame:
    return df.withColumn(value, F.when(F.abs(value) <= limit, F.col(value)))


def count_large_returns(df: DataFrame, by: Sequence[str], value: str = "ret", limit: float = 0.25) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(F.abs(value) > limit).alias("n_large"), F.count(value).alias("n"))


def benchmark_table(long: DataFrame, names: Sequence[str], name: str = "name", value: str = "ret") -> DataFrame:
    """One row per month of any benchmark, a column for each."""
    return long.groupBy("ym").agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])


def benchmark_compare(returns: DataFrame, benchmarks: DataFrame, names: Sequence[str], train_end: str, leg: str = "long", least: int = 6) -> DataFrame:
    """name, period: the benchmark's performance and the leg's excess over it, on months that both have."""
    long = benchmarks.select("ym", *names).unpivot(["ym"], list(names), "name", "bench").filter("bench is not null")
    both = with_periods(long.join(returns.filter(F.col(leg).isNotNull()).select("ym", leg), "ym"), train_end).filter("period <> 'train'")
    own = perf(both, "bench", ("name", "period"), "ym", least).select("name", "period", "cagr", "sharpe", "max_dd")
    return own.join(active_stats(both, leg, "bench", ("name", "period"), least).select("name", "period", "ann_excess", "t_stat", "months"), ["name", "period"])
