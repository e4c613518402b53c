"""Excess returns by market regime and year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.perf import excess_stats

REGIMES = ("all", "up", "down", "worst_quarter")


def regime_stats(returns: DataFrame, leg: str = "long", benchmark: str = "benchmark", by: Sequence[str] = (), least: int = 4) -> DataFrame:
    """by, regime: the excess in all months, those of a rising and of a falling benchmark, and its worst quarter (they overlap)."""
    b = F.col(benchmark)
    rows = returns.withColumn("active", F.col(leg) - b).filter("active is not null")
    cut = rows.groupBy(*by).agg(F.percentile(benchmark, F.lit(0.25)).alias("_q"))
    rows = rows.join(F.broadcast(cut), list(by)) if by else rows.join(F.broadcast(cut))
    regimes = F.filter(F.array(F.lit("all"), F.when(b > 0, "up").otherwise("down"), F.when(b <= F.col("_q"), "worst_quarter")), lambda r: r.isNotNull())
    return rows.withColumn("regime", F.explode(regimes)).groupBy(*by, "regime").agg(*excess_stats(F.col("active"))).filter(F.col("months") >= least)


def annual_excess(returns: DataFrame, leg: str = "long", benchmark: str = "benchmark", by: Sequence[str] = ()) -> DataFrame:
    """by, year, excess: compounded monthly excess."""
    rows = returns.withColumn("active", F.col(leg) - F.col(benchmark)).filter("active is not null")
    return rows.groupBy(*by, F.year("ym").alias("year")).agg((F.product(1 + F.col("active")) - 1).alias("excess"))
