"""How far returns depend on illiquid holdings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import thirds
from tidemark.functions.scratch import materialize
from tidemark.operators.perf import active_stats, perf
from tidemark.operators.portfolio import sweep, take
from tidemark.operators.xsection import pct_rank_avg


def holdings_attribution(df: DataFrame, q: float = 0.1, score: str = "score", label: str = "fwd_ret_1m", liquidity: str = "amt_21") -> DataFrame:
    """The top q of each cell, at equal weights: stock_id, ym, group, liq_pct, w, contribution. No least sizes here."""
    rows = pct_rank_avg(df.filter(F.col(score).isNotNull() & F.col(label).isNotNull() & F.col("group").isNotNull()), liquidity, ["ym"], "liq_pct")
    cell = W.partitionBy("ym", "group")
    rows = rows.withColumns({"_n": F.count("*").over(cell), "_p": F.row_number().over(cell.orderBy(F.col(score).desc(), "stock_id"))})
    held = rows.filter(F.col("_p") <= take("_n", q))
    sizes = held.groupBy(F.col("ym").alias("_ym")).agg((F.lit(1.0) / F.count("*")).alias("w"))
    held = held.join(sizes, F.col("ym") == F.col("_ym"))
    return held.select("stock_id", "ym", "group", "liq_pct", F.col(label).alias("ret"), "w", (F.col("w") * F.col(label)).alias("contribution"))


def tier_attribution(holdings: DataFrame) -> DataFrame:
    """tier (thirds of liquidity), n_holdings, share of all contribution, mean_ret, mean_pct."""
    tiers = holdings.withColumn("tier", thirds(F.col("liq_pct"))).filter("tier is not null").groupBy("tier").agg(F.count("*").alias("n_holdings"), F.sum("contribution").alias("_c"), F.avg("ret").alias("mean_ret"), F.avg("liq_pct").alias("mean_pct"))
    return tiers.withColumn("share", F.try_divide(F.col("_c"), F.sum("_c").over(W.partitionBy()))).drop("_c")


def top_contributors(holdings: DataFrame, names: DataFrame, show: int = 20) -> DataFrame:
    """The entities with the largest summed contribution, their mean liquidity and number of months, with names."""
    top = holdings.groupBy("stock_id").agg(F.sum("contribution").alias("contribution"), F.avg("liq_pct").alias("mean_pct"), F.count("*").alias("months")).orderBy(F.desc("contribution"), "stock_id").limit(show)
    return top.join(names.select("stock_id", "stock_name"), "stock_id", "left")


def liquidity_filter_sweep(df: DataFrame, floors: Sequence[float] = (0.0, 0.3, 0.5, 0.7), costs: Sequence[float] = (0.004, 0.008, 0.012), q: float = 0.1, liquidity: str = "amt_21", **names: object) -> DataFrame:
    """Performance and excess for each liquidity floor and cost: floor, cost, cagr, sharpe, ann_excess, ir, t_stat, turnover."""
    used = dict.fromkeys(["stock_id", "ym", names.get("group", "group"), names.get("label", "fwd_ret_1m"), names.get("score", "score"), liquidity])
    rows = pct_rank_avg(df.select(*used), liquidity, ["ym"], "liq_pct")
    each = rows.withColumn("floor", F.explode(F.filter(F.array(*[F.lit(float(f)) for f in floors]), lambda f: F.col("liq_pct") >= f)))
    returns = materialize(sweep(each, [q], costs, by=("floor", "ym"), **names), "returns")  # a row per floor, cost and month
    key = ["floor", "cost"]
    good = perf(returns, "long", key).select(*key, "cagr", "sharpe")
    extra = active_stats(returns, by=key).select(*key, "ann_excess", "ir", "t_stat")
    return good.join(extra, key).join(returns.groupBy(*key).agg(F.avg("turnover").alias("turnover")), key)
