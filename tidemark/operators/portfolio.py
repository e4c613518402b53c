"""Portfolios: selection, weights, turnover, returns. ``by`` holds what sets strategies apart, then the month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scratch import materialize

MONTH = "ym"


def rank_cells(df: DataFrame, score: str = "score", label: str = "fwd_ret_1m", by: Sequence[str] = (MONTH,), group: str = "group", least_month: int = 20, least_group: int = 8) -> DataFrame:
    """Rows with score and label in months and groups that are large enough, with n_group, place (1 = best) and place_low.

    Of equal scores the smaller entity comes first; the bottom is the same order reversed.
    """
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull() & F.col(group).isNotNull())
    cell = W.partitionBy(*by, group)
    order = cell.orderBy(F.col(score).desc(), "stock_id")
    sized = rows.withColumns({"n_group": F.count("*").over(cell), "place": F.row_number().over(order)})
    months = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least_month)
    out = sized.filter(F.col("n_group") >= least_group).join(months.drop("_n"), list(by), "left_semi")
    return out.withColumn("place_low", F.col("n_group") - F.col("place") + 1)


def take(n_group: str | Column, q: float | Column) -> Column:
    """How many a group of that size contributes: at least one."""
    n = F.col(n_group) if isinstance(n_group, str) else n_group
    return F.greatest(F.lit(1), F.floor(n * (F.lit(float(q)) if isinstance(q, float) else q)).cast("int"))


def select_top_bottom(df: DataFrame, q: float = 0.1, **names: object) -> DataFrame:
    """The ranked rows in the top or bottom q of their cell, with is_long and is_short."""
    ranked = rank_cells(df, **names)
    n = take("n_group", q)
    return ranked.withColumns({"is_long": F.col("place") <= n, "is_short": F.col("place_low") <= n}).filter("is_long or is_short")


def weights(longs: DataFrame, mode: str = "equal", by: Sequence[str] = (MONTH,)) -> DataFrame:
    """Add w: equal, or proportional to the average rank of the column ``mode`` among all longs of the month.

    A missing value weighs 0; if all are missing, or there is no such column, weights are equal.
    """
    own = W.partitionBy(*by)
    even = F.lit(1.0) / F.count("*").over(own)
    if mode == "equal" or mode not in longs.columns:
        return longs.withColumn("w", even)
    known = W.partitionBy(*by, F.col(mode).isNull())
    ties = F.count("*").over(W.partitionBy(*by, mode))
    df = longs.withColumn("_r", F.when(F.col(mode).isNotNull(), F.rank().over(known.orderBy(mode)) + (ties - 1) / 2.0))
    total = F.sum("_r").over(own)
    return df.withColumn("w", F.when(total.isNull(), even).otherwise(F.coalesce(F.col("_r") / total, F.lit(0.0)))).drop("_r")


def turnover(longs: DataFrame, by: Sequence[str] = (MONTH,), months: DataFrame | None = None) -> DataFrame:
    """by, turnover, nhold: the share of the union of this and the previous processed month's holdings that is in one only.

    Months are numbered per strategy over the months that have holdings (or as ``months`` says: some of ``by``, and ``_t``);
    an entity survives if its previous holding has the number before. No month is joined with another.
    """
    strategy = list(by[:-1])
    if months is None:
        months = longs.select(*by).distinct().withColumn("_t", F.row_number().over(W.partitionBy(*strategy).orderBy(by[-1])))
    held = longs.select(*by, "stock_id").join(months, [c for c in months.columns if c != "_t"])
    before = F.lag("_t").over(W.partitionBy(*strategy, "stock_id").orderBy("_t"))
    once = held.withColumn("_before", before).filter("_before is null or _before < _t")  # an entity counts once a month
    sizes = once.withColumn("_stays", (F.col("_before") == F.col("_t") - 1).cast("int")).groupBy(*by, "_t").agg(F.count("*").alias("nhold"), F.coalesce(F.sum("_stays"), F.lit(0)).alias("_both"))
    past = F.lag("nhold").over(W.partitionBy(*strategy).orderBy("_t"))
    union = F.col("nhold") + past - F.col("_both")
    return sizes.withColumn("turnover", F.when(past.isNull(), 1.0).otherwise((union - F.col("_both")) / union)).select(*by, "turnover", "nhold")


def _placed(df: DataFrame, score: str, label: str, by: Sequence[str], group: str, least_month: int, least_group: int, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Every row with score and label, with ``_y`` (label), ``_score``, n_group and place (null where the group can't be traded), and the months that can.

    The rows are ranked once and written, since means of months and holdings both read them;
    months (by, benchmark, _t: their number among the strategy's months with holdings) are a written table of a row each.
    """
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).select("stock_id", *by, F.col(group).alias("_group"), F.col(label).alias("_y"), F.col(score).alias("_score"), *[F.col(c) for c in dict.fromkeys(keep) if c not in ("stock_id", *by)])
    cell = W.partitionBy(*by, "_group")
    ranked = rows.withColumns({"n_group": F.count("*").over(cell), "place": F.row_number().over(cell.orderBy(F.col("_score").desc(), "stock_id"))})
    fits = F.col("_group").isNotNull() & (F.col("n_group") >= least_group)
    placed = materialize(ranked.withColumn("place", F.when(fits, F.col("place"))).drop("_group"), "placed")
    months = placed.groupBy(*by).agg(F.avg("_y").alias("benchmark"), F.count("*").alias("_n"), F.count("place").alias("_k")).filter((F.col("_n") >= least_month) & (F.col("_k") > 0))
    return placed, materialize(months.select(*by, "benchmark", F.row_number().over(W.partitionBy(*by[:-1]).orderBy(by[-1])).alias("_t")), "months")


def portfolio_returns(df: DataFrame, q: float = 0.1, weighting: str = "equal", cost: float = 0.004, score: str = "score", label: str = "fwd_ret_1m", by: Sequence[str] = (MONTH,), group: str = "group", least_month: int = 20, least_group: int = 8) -> DataFrame:
    """by, long, long_short, benchmark, turnover, nhold per processed month; costs are charged on turnover.

    Both legs are conditional means of one aggregate over the ranked rows; only weights other than equal need the longs apart.
    """
    weighted = weighting != "equal" and weighting in df.columns
    placed, months = _placed(df, score, label, by, group, least_month, least_group, [weighting] if weighted else [])
    n = take("n_group", q)
    longs = placed.filter(F.col("place") <= n)
    legs = placed.filter("place is not null").groupBy(*by).agg(F.avg(F.when(F.col("place") <= n, F.col("_y"))).alias("_long"), F.avg(F.when(F.col("n_group") - F.col("place") + 1 <= n, F.col("_y"))).alias("_short"))
    if weighted:
        gain = weights(longs, weighting, by).groupBy(*by).agg(F.sum(F.col("_y") * F.col("w")).alias("_long"))
        legs = legs.drop("_long").join(gain, list(by))
    out = legs.join(months.drop("_t"), list(by)).join(turnover(longs, by, months.drop("benchmark")), list(by))
    fee = F.lit(cost) * F.col("turnover")
    return out.select(*by, (F.col("_long") - fee).alias("long"), (F.col("_long") - F.col("_short") - fee).alias("long_short"), "benchmark", "turnover", "nhold")


def sweep(df: DataFrame, qs: Sequence[float], costs: Sequence[float], score: str = "score", label: str = "fwd_ret_1m", by: Sequence[str] = (MONTH,), group: str = "group", least_month: int = 20, least_group: int = 8) -> DataFrame:
    """Equal-weight returns for every concentration and cost: q, cost and by, then as portfolio_returns.

    Cells are ranked once; each long or short row is repeated for the parameters that take it,
    and costs are applied to the finished months.
    """
    placed, months = _placed(df, score, label, by, group, least_month, least_group)
    low = F.col("n_group") - F.col("place") + 1
    each = F.filter(F.array(*[F.lit(float(q)) for q in qs]), lambda q: (F.col("place") <= take("n_group", q)) | (low <= take("n_group", q)))
    picked = placed.filter("place is not null").withColumn("q", F.explode(each))
    n = take("n_group", F.col("q"))
    keys = ["q", *by]
    gain = picked.groupBy(*keys).agg(F.avg(F.when(F.col("place") <= n, F.col("_y"))).alias("_long"), F.avg(F.when(low <= n, F.col("_y"))).alias("_short"))
    out = gain.join(turnover(picked.filter(F.col("place") <= n), keys, months.drop("benchmark")), keys).join(months.drop("_t"), list(by)).withColumn("cost", F.explode(F.array(*[F.lit(float(c)) for c in costs])))
    fee = F.col("cost") * F.col("turnover")
    return out.select("cost", *keys, (F.col("_long") - fee).alias("long"), (F.col("_long") - F.col("_short") - fee).alias("long_short"), "benchmark", "turnover", "nhold")


def weight_sweep(df: DataFrame, qs: Sequence[float], weightings: Sequence[str], costs: Sequence[float] = (0.004,), score: str = "score", label: str = "fwd_ret_1m", by: Sequence[str] = (MONTH,), group: str = "group", least_month: int = 20, least_group: int = 8) -> DataFrame:
    """Long returns for every concentration, weighting and cost: cost, q, weighting and by, then long, benchmark, turnover, nhold.

    A weighting is ``equal`` or the column whose ranks among the longs of a month are the
    weights, as in ``weights``. Cells are ranked once; turnover does not depend on weights.
    """
    own = [F.col(m).cast("double").alias(f"_w{i}") for i, m in enumerate(weightings) if m != "equal"]
    placed, months = _placed(df.select("*", *own), score, label, by, group, least_month, least_group, [f"_w{i}" for i, m in enumerate(weightings) if m != "equal"])
    longs = placed.withColumn("q", F.explode(F.filter(F.array(*[F.lit(float(q)) for q in qs]), lambda q: F.col("place") <= take("n_group", q))))
    values = F.array(*[F.struct(F.lit(m).alias("weighting"), (F.lit(None) if m == "equal" else F.col(f"_w{i}")).cast("double").alias("_v")) for i, m in enumerate(weightings)])
    each = longs.withColumn("_m", F.explode(values)).withColumns({"weighting": F.col("_m.weighting"), "_v": F.col("_m._v")})
    gain = weights(each, "_v", ["q", "weighting", *by]).groupBy("q", "weighting", *by).agg(F.sum(F.col("_y") * F.col("w")).alias("_long"))
    out = gain.join(turnover(longs, ["q", *by], months.drop("benchmark")), ["q", *by]).join(months.drop("_t"), list(by)).withColumn("cost", F.explode(F.array(*[F.lit(float(c)) for c in costs])))
    return out.select("cost", "q", "weighting", *by, (F.col("_long") - F.col("cost") * F.col("turnover")).alias("long"), "benchmark", "turnover", "nhold")


def strategy_returns(df: DataFrame, scores: Sequence[str], label: str = "fwd_ret_1m", q: float = 0.1, cost: float = 0.004, group: str = "group", least_month: int = 20, least_group: int = 8) -> DataFrame:
    """Equal-weight returns of many score columns at once, with strategy and active = long - benchmark."""
    long = df.select("stock_id", MONTH, group, label, *[F.col(s).cast("double").alias(s) for s in scores]).unpivot(["stock_id", MONTH, group, label], list(scores), "strategy", "score")
    out = portfolio_returns(long, q, "equal", cost, "score", label, ("strategy", MONTH), group, least_month, least_group)
    return out.withColumn("active", F.col("long") - F.col("benchmark"))
