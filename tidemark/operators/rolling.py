"""Windows over an entity's rows: rolling statistics, snapshots, lags. All share one partitioning and order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import month, ratio


def rolling(agg: Callable[[Column], Column], column: str, n: int, least: int, key: str | Sequence[str] = "stock_id", order: str = "date") -> Column:
    """``agg`` over the last n rows; null with fewer than ``least`` values."""
    w = W.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(column).over(w) >= least, agg(F.col(column)).over(w))


#: The longest of the daily windows.
LONGEST = 252


#: Rows of a tile: all daily windows are so many rows or a multiple of that.
TILE = 21


def _merged(parts: Sequence[tuple[Column, Column, Column]], known: Column) -> tuple[Column, Column]:
    """Mean and squares about it of the rows of several parts, from each one's count, mean and squares; 0 where there are none.

    The mean is added up about a part's own, so that a series that doesn't vary has squares of exactly 0.
    """
    own = F.coalesce(*[F.when(n > 0, m) for n, m, _ in parts[:-1]], parts[-1][1])
    mean = own + sum((n * (m - own) for n, m, _ in parts[1:]), parts[0][0] * (parts[0][1] - own)) / F.greatest(known, F.lit(1.0))
    return mean, sum((q + n * (m - F.col("_mean")) * (m - F.col("_mean")) for n, m, q in parts), F.lit(0.0))


def _daily(daily: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """The daily windows from tiles of ``TILE`` rows, lagged by whole tiles, and running counts: the longest windows cost no more than a tile.

    Nothing is ever null between, which keeps the generated code short enough to be compiled.
    """
    c, zero = F.col, F.lit(0.0)
    order = W.partitionBy(*([key] if isinstance(key, str) else key)).orderBy("date")
    tile, past = order.rowsBetween(-(TILE - 1), 0), order.rowsBetween(W.unboundedPreceding, 0)
    spread = F.var_pop("ret").over(tile)
    mean = F.when(spread == 0, F.max(c("ret").cast("double")).over(tile)).otherwise(F.avg("ret").over(tile))  # an average of equal values may miss them by a bit
    sums = {"_m0": F.coalesce(mean, zero), "_v0": F.coalesce(spread, zero), "_amt": F.avg("amount").over(tile), "_h0": F.max("close").over(tile)}
    df = daily.withColumns(sums | {f"_{x}0": F.count(x).over(past).cast("double") for x in ("ret", "amount", "close")})

    def before(x: str, rows: int) -> Column:
        return F.lag(f"_{x}0", rows, 0.0).over(order)

    lagged = {f"_{x}{i}": before(x, i * TILE) for x in "mv" for i in (1, 2)} | {f"_ret{i}": before("ret", i * TILE) for i in (1, 2, 3, 6)}
    df = df.withColumns(lagged | {"_amount1": before("amount", TILE), "_close12": before("close", LONGEST)} | {f"_h{i}": F.lag("_h0", i * TILE).over(order) for i in range(1, LONGEST // TILE)})
    n = [c("_ret0") - c("_ret1"), c("_ret1") - c("_ret2"), c("_ret2") - c("_ret3")]
    mean, squares = _merged([(n[i], c(f"_m{i}"), n[i] * c(f"_v{i}")) for i in range(3)], c("_ret0") - c("_ret3"))
    df = df.withColumn("_mean", mean).withColumn("_s0", squares).withColumn("_a0", c("_mean"))
    df = df.withColumns({"_a3": before("a", 3 * TILE), "_s3": before("s", 3 * TILE)})
    mean, squares = _merged([(c("_ret0") - c("_ret3"), c("_a0"), c("_s0")), (c("_ret3") - c("_ret6"), c("_a3"), c("_s3"))], c("_ret0") - c("_ret6"))
    df = df.withColumn("_mean", mean).withColumn("_s6", squares)

    def deviation(known: Column, least: int, squares: Column) -> Column:
        return F.when(known >= least, F.sqrt(squares / (known - 1)))

    spans = {"vol_21": (n[0], 12, n[0] * c("_v0")), "vol_63": (c("_ret0") - c("_ret3"), 40, c("_s0")), "vol_126": (c("_ret0") - c("_ret6"), 80, c("_s6"))}
    out = {k: deviation(*own) for k, own in spans.items()} | {"amt_21": F.when(c("_amount0") - c("_amount1") >= 10, c("_amt")), "hi_252": F.when(c("_close0") - c("_close12") >= 120, F.greatest(*[c(f"_h{i}") for i in range(LONGEST // TILE)]))}
    return df.select(*[c(f"`{x}`") for x in daily.columns if x not in out], *[v.alias(k) for k, v in out.items()])


def add_rolling(daily: DataFrame, block: int | None = None, span: str = "year") -> DataFrame:
    """vol_21, vol_63, vol_126, amt_21, hi_252: one shuffle, one sort.

    With ``block`` an entity's rows are dealt in blocks of so many, each with the rows before it that its
    windows reach back to, so that an entity with most of all rows is many tasks.
    """
    if block is None:
        return _daily(daily, "stock_id")
    dealt = with_halo(numbered(daily, "stock_id", "date", span), "stock_id", block, LONGEST - 1)
    return _daily(dealt, ["stock_id", "_block"]).filter("not _halo").drop("_block", "_halo", "_i")


def numbered(df: DataFrame, key: str, order: str, span: str = "year") -> DataFrame:
    """Add ``_i``, the row's place from 0 among its entity's rows by day.

    Rows are counted per entity and span of time first; a row's place is its place within
    the span and the rows of the spans before. So no window holds an entity's rows: the one by
    entity has a row per span. ``df`` is read twice, the first time for key and day alone.
    Rows without a day come first.
    """
    at = F.coalesce(F.date_trunc(span, F.col(order)).cast("date"), F.lit("0001-01-01").cast("date"))
    counts = df.select(F.col(key).alias("_k"), at.alias("_s")).groupBy("_k", "_s").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_k").orderBy("_s").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("_k", "_s", F.coalesce(before, F.lit(0)).alias("_first"))
    placed = df.withColumn("_span", at).withColumn("_place", F.row_number().over(W.partitionBy(key, "_span").orderBy(order)) - 1)
    met = placed.join(counts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_span") == F.col("_s")))
    return met.withColumn("_i", F.col("_first") + F.col("_place")).drop("_span", "_place", "_k", "_s", "_first")


def with_halo(df: DataFrame, key: str, block: int, reach: int) -> DataFrame:
    """Rows with ``_i`` dealt to blocks of ``block`` rows of their entity, and copied (``_halo``) to as many later blocks as begin within ``reach`` rows after them."""
    own = F.floor(F.col("_i") / block).cast("long")
    last = F.floor((F.col("_i") + reach) / block).cast("long")
    return df.withColumn("_block", F.explode(F.sequence(own, last))).withColumn("_halo", F.col("_block") > own)


def month_end_snapshot(daily: DataFrame, key: str = "stock_id", date: str = "date") -> DataFrame:
    """The last row of each entity and month, with its month ``ym``.

    Rows are already dealt by entity for the rolling windows; that serves this window too.
    """
    df = daily.withColumn("ym", month(F.col(date)))
    last = W.partitionBy(key, "ym").orderBy(F.col(date).desc())
    return df.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def _lag(column: str | Column, k: int, key: str, order: str) -> Column:
    return F.lag(column, k).over(W.partitionBy(key).orderBy(order))


def pct_change(column: str, k: int, key: str = "stock_id", order: str = "ym") -> Column:
    """Change over k rows, whatever months lie between."""
    return ratio(F.col(column), _lag(column, k, key, order)) - 1


def skip_ratio(column: str, near: int, far: int, key: str = "stock_id", order: str = "ym") -> Column:
    return ratio(_lag(column, near, key, order), _lag(column, far, key, order)) - 1


def diff(column: str, k: int, key: str = "stock_id", order: str = "ym") -> Column:
    return F.col(column) - _lag(column, k, key, order)


def accel(df: DataFrame, column: str, k: int, out: str) -> DataFrame:
    """The change over k rows less that of k rows before."""
    return df.withColumn("_g", pct_change(column, k)).withColumn(out, diff("_g", k)).drop("_g")


def forward_return(close: str = "close", key: str = "stock_id", order: str = "ym") -> Column:
    """The next snapshot's return: the label."""
    return ratio(F.lead(close).over(W.partitionBy(key).orderBy(order)), F.col(close)) - 1
