"""Data-quality profiles and reconciliation of two sources."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio
from tidemark.functions.scratch import materialize


def table_overview(df: DataFrame, key: str = "stock_id", date: str = "date") -> DataFrame:
    """One row: n_rows, n_columns, n_entities, first and last day, rows that repeat a (key, day), nulls of each column."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns]
    top = df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.count_distinct(key).alias("n_entities"), F.min(date).alias("first_day"), F.max(date).alias("last_day"), *nulls)
    repeated = df.groupBy(key, date).agg((F.count("*") - 1).alias("_more")).agg(F.coalesce(F.sum("_more"), F.lit(0)).alias("n_duplicates"))
    return top.join(F.broadcast(repeated))


def coverage_report(df: DataFrame, days: int = 30, show: int | None = 30, key: str = "stock_id", date: str = "date") -> DataFrame:
    """first, last, n_days and ends_early of each entity; the ``show`` that end first (all if None)."""
    own = df.groupBy(key).agg(F.min(date).alias("first_day"), F.max(date).alias("last_day"), F.count_distinct(date).alias("n_days"))
    market = own.agg(F.max("last_day").alias("_end"))
    out = own.join(F.broadcast(market)).withColumn("ends_early", F.col("last_day") < F.date_sub("_end", days)).drop("_end")
    return out if show is None else out.orderBy("last_day", key).limit(show)


@dataclass(frozen=True)
class Profile:
    """What the reports need of a table's closed days, in two small tables that merge by adding up.

    ``days`` has a row per day: rows, rows that repeat an entity's day, nulls of each column (rows without a day are a row
    of their own). ``entities`` has a row per entity: first and last day, days, rows without a day.
    """

    days: DataFrame
    entities: DataFrame

    def merge(self, newer: Profile) -> Profile:
        """The profile of both tables together; their days must not overlap."""
        sums = [F.sum(c).alias(c) for c in self.days.columns if c != "day"]
        days = self.days.unionByName(newer.days).groupBy("day").agg(*sums)
        both = self.entities.unionByName(newer.entities).groupBy("entity")
        return Profile(days, both.agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.sum("n_days").alias("n_days"), F.sum("undated").alias("undated")))

    def written(self) -> Profile:
        return Profile(materialize(self.days, "days"), materialize(self.entities, "entities"))

    def overview(self) -> DataFrame:
        """As ``table_overview``."""
        nulls = [c for c in self.days.columns if c.startswith("null_")]
        top = self.days.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.lit(len(nulls)).alias("n_columns"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in nulls], F.coalesce(F.sum("n_duplicates"), F.lit(0)).alias("_more"))
        who = self.entities.agg(F.count("entity").alias("n_entities"), F.coalesce(F.sum(F.greatest(F.col("undated") - 1, F.lit(0))), F.lit(0)).alias("_undated"))
        return top.join(F.broadcast(who)).withColumn("n_duplicates", F.col("_more") + F.col("_undated")).drop("_more", "_undated")

    def coverage(self, days: int = 30, show: int | None = 30, key: str = "stock_id") -> DataFrame:
        """As ``coverage_report``."""
        market = self.days.agg(F.max("day").alias("_end"))
        own = self.entities.select(F.col("entity").alias(key), "first_day", "last_day", "n_days")
        out = own.join(F.broadcast(market)).withColumn("ends_early", F.col("last_day") < F.date_sub("_end", days)).drop("_end")
        return out if show is None else out.orderBy("last_day", key).limit(show)

    def gaps(self, show: int = 5, key: str = "stock_id") -> DataFrame:
        """As ``calendar_gaps``."""
        market = self.days.agg(F.count("day").alias("market_days"))
        return self.entities.select(F.col("entity").alias(key), "n_days").join(F.broadcast(market)).orderBy("n_days", key).limit(show)


def profile(df: DataFrame, key: str = "stock_id", date: str = "date") -> Profile:
    """The profile of ``df`` by one scan: rows are counted by entity and day, and the two tables add these counts up.

    The profile of a grown table is that of its new days merged into the one before, so older days are not read again.
    """
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns]
    cells = materialize(df.groupBy(F.col(key).alias("entity"), F.col(date).alias("day")).agg(F.count("*").alias("n"), *nulls), "cells")
    more = F.when(F.col("day").isNotNull(), F.col("n") - 1).otherwise(0)
    days = cells.groupBy("day").agg(F.sum("n").alias("n_rows"), F.sum(more).alias("n_duplicates"), *[F.sum(c).alias(c) for c in cells.columns if c.startswith("null_")])
    undated = F.sum(F.when(F.col("day").isNull(), F.col("n")).otherwise(0))
    return Profile(days, cells.groupBy("entity").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("day").alias("n_days"), undated.alias("undated")))


def source_distribution(df: DataFrame, column: str = "adj_source") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def price_anomalies(df: DataFrame, limit: float = 0.4, close: str = "close") -> DataFrame:
    """Rows with a non-positive close or a daily return beyond the limit, with ret and kind."""
    rows = df.withColumn("ret", ratio(F.col(close), F.lag(close).over(W.partitionBy("stock_id").orderBy("date"))) - 1)
    kind = F.when(F.col(close) <= 0, "non_positive").when(F.abs("ret") > limit, "jump")
    return rows.withColumn("kind", kind).filter("kind is not null").select("stock_id", "date", close, "ret", "kind")


def calendar_gaps(df: DataFrame, show: int = 5, key: str = "stock_id", date: str = "date") -> DataFrame:
    """The ``show`` entities with the fewest of the market's days, with both counts."""
    own = df.groupBy(key).agg(F.count_distinct(date).alias("n_days"))
    market = df.agg(F.count_distinct(date).alias("market_days"))
    return own.join(F.broadcast(market)).orderBy("n_days", key).limit(show)


def item_catalog(df: DataFrame, column: str = "type", show: int = 10) -> DataFrame:
    return df.select(column).distinct().orderBy(column).limit(show)


def samples_per_entity(df: DataFrame, ids: Sequence[str], n: int = 3, key: str = "stock_id", date: str = "date") -> DataFrame:
    """The first and last n rows by day of the given entities, with where (first / last; a short history is first)."""
    rows = df.filter(F.col(key).isin(*ids))
    w = W.partitionBy(key)
    rows = rows.withColumns({"_a": F.row_number().over(w.orderBy(date)), "_z": F.row_number().over(w.orderBy(F.col(date).desc()))})
    return rows.filter((F.col("_a") <= n) | (F.col("_z") <= n)).withColumn("where", F.when(F.col("_a") <= n, "first").otherwise("last")).drop("_a", "_z")


def reconcile(a: DataFrame, b: DataFrame, show: int | None = 10) -> DataFrame:
    """ym, a, b and difference of two series (ym, ret), the largest differences first."""
    both = a.select("ym", F.col("ret").alias("a")).join(b.select("ym", F.col("ret").alias("b")), "ym", "full").withColumn("difference", F.col("a") - F.col("b"))
    return both if show is None else both.orderBy(F.abs("difference").desc_nulls_last(), "ym").limit(show)


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Common months and correlation of two series; null where one does not vary."""
    both = reconcile(a, b, None).filter("difference is not null")
    return both.agg(F.count("*").alias("months"), F.try_divide(F.covar_samp("a", "b"), F.stddev_samp("a") * F.stddev_samp("b")).alias("correlation"))


def key_coverage(df: DataFrame, ids: DataFrame, cutoff: str, key: str = "stock_id", date: str = "date") -> DataFrame:
    """n_rows, first and last day of each requested id, empty ones kept; truncated if the last day is before the cutoff."""
    own = df.join(ids.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count("*").alias("n_rows"), F.min(date).alias("first_day"), F.max(date).alias("last_day"))
    out = ids.select(key).distinct().join(own, key, "left")
    return out.withColumns({"n_rows": F.coalesce("n_rows", F.lit(0)), "truncated": F.coalesce(F.col("last_day") < F.lit(cutoff).cast("date"), F.lit(True))})
