"""Price cleaning, adjustment for corporate events, daily returns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio, to_number


def drop_nonpositive_prices(df: DataFrame, close: str = "close") -> DataFrame:
    return df.filter(F.col(close) > 0)


def coerce_numeric(df: DataFrame, columns: Sequence[str], fill: float | None = None) -> DataFrame:
    return df.withColumns({c: to_number(F.col(c), fill) for c in columns})


def back_adjust(prices: DataFrame, events: DataFrame, columns: Sequence[str] = ("open", "max", "min", "close")) -> DataFrame:
    """Add adj_factor and adj_<column>: the product of after / before over an entity's later events.

    An event counts for prices of strictly earlier dates; events with null or non-positive
    prices are ignored. Prices and events go through one window together, so an entity's
    history is sorted once and no pair of price and event is ever made.
    """
    marks = events.filter((F.col("before_price") > 0) & (F.col("after_price") > 0))
    marks = marks.select("stock_id", "date", (F.col("after_price") / F.col("before_price")).alias("_f"), F.lit(1).alias("_event"))
    rows = prices.withColumns({"_f": F.lit(1.0), "_event": F.lit(0)}).unionByName(marks, allowMissingColumns=True)
    # from the last day back; on one day prices come before events, so an event's own day is not adjusted
    later = W.partitionBy("stock_id").orderBy(F.col("date").desc(), "_event").rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("adj_factor", F.product("_f").over(later)).filter("_event = 0").drop("_f", "_event")
    return out.withColumns({f"adj_{c}": F.col(c) * F.col("adj_factor") for c in columns})


def prefer_source(primary: DataFrame, fallback: DataFrame, key: str = "stock_id", tags: tuple[str, str] = ("vendor", "self")) -> DataFrame:
    """All primary rows, and the fallback rows of entities without any; tagged in adj_source."""
    rest = fallback.join(primary.select(key).distinct(), key, "left_anti")
    return primary.withColumn("adj_source", F.lit(tags[0])).unionByName(rest.withColumn("adj_source", F.lit(tags[1])), allowMissingColumns=True)


def daily_return(df: DataFrame, close: str = "close", out: str = "ret") -> DataFrame:
    order = W.partitionBy("stock_id").orderBy("date")
    return df.withColumn(out, ratio(F.col(close), F.lag(close).over(order)) - 1)


#: Names of the price base and the columns they come from.
BASE_COLUMNS: Mapping[str, str] = {"volume": "Trading_Volume", "amount": "Trading_money", "open": "adj_open", "high": "adj_max", "low": "adj_min", "close": "adj_close", "close_raw": "close"}


def build_price_base(prices: DataFrame, universe: DataFrame) -> DataFrame:
    """Adjusted prices under their base names (those that are there), with returns, group and name of the universe."""
    base = prices.select("stock_id", "date", *[F.col(src).alias(new) for new, src in BASE_COLUMNS.items() if src in prices.columns])
    return daily_return(base).join(universe.select("stock_id", "group", "stock_name"), "stock_id", "left")
