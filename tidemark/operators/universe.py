"""The entity dimension: filters, latest rows, classification by keywords."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_listed(info: DataFrame, markets: Sequence[str] = ("twse", "tpex"), pattern: str = "^[0-9]{4}$") -> DataFrame:
    """Rows of the allowed markets whose id matches the pattern as a whole."""
    return info.filter(F.col("type").isin(*markets) & F.col("stock_id").rlike(pattern))


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row per key; of equal ``order`` the greatest by the other columns. Partial aggregation, no sort."""
    rest = [c for c in df.columns if c not in (key, order)]
    row = F.struct(F.col(order).isNotNull().alias("_has"), order, *rest)
    return df.groupBy(key).agg(F.max(row).alias("_row")).select(*[key if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def classify_by_keywords(df: DataFrame, column: str, rules: Sequence[tuple[str, Sequence[str]]], out: str = "group") -> DataFrame:
    """The first rule in order any of whose keywords is part of the column; null if none."""
    tests = [F.when(F.greatest(*[F.col(column).contains(k) for k in (*keys, keys[0])]), group) for group, keys in rules]
    return df.withColumn(out, F.coalesce(*tests, F.lit(None).cast("string")))


def category_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col(column).asc_nulls_last())


def build_universe(info: DataFrame, rules: Sequence[tuple[str, Sequence[str]]], markets: Sequence[str] = ("twse", "tpex"), pattern: str = "^[0-9]{4}$") -> DataFrame:
    """Listed entities, their latest row, with a group; unclassified ones are dropped."""
    latest = latest_per_key(filter_listed(info, markets, pattern), "stock_id", "date")
    return classify_by_keywords(latest, "industry_category", rules).filter("group is not null").select("stock_id", "stock_name", "industry_category", "group", "type")
