"""The test tables seen as a market: suppliers are entities, shipped lines are trades.

Sums are rounded to the digits that they have, so that nothing hangs on the order of adding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.scalars import to_number

#: First match wins; here the keywords are region names.
GROUP_RULES = (("africa", ("AFRICA",)), ("america", ("AMERICA",)), ("asia", ("ASIA",)), ("europe", ("EUROPE",)))
#: Ids have four digits, or more from the 10,000th supplier on.
LISTED = "^[0-9]{4,}$"
QTY, EXT, DISC, TAX = "l_quantity", "l_extendedprice", "l_discount", "l_tax"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(column: str) -> Column:
    # lpad cuts what is longer than the width
    text = F.col(column).cast("string")
    return F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumns({"stock_id": _id("l_suppkey"), "date": F.col("l_shipdate").cast("date")})


def info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of every entity; the later one names the region."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    market = F.when(F.col("s_suppkey") % 10 == 9, "emerging").when(F.col("s_suppkey") % 2 == 0, "twse").otherwise("tpex")
    s = s.select(_id("s_suppkey").alias("stock_id"), F.col("s_name").alias("stock_name"), market.alias("type"), "n_name", "r_name")
    old = s.select("stock_id", "stock_name", F.col("n_name").alias("industry_category"), "type", F.make_date(F.lit(1995), F.lit(1), F.lit(1)).alias("date"))
    return old.unionByName(s.select("stock_id", "stock_name", F.concat_ws(" ", "r_name", "n_name").alias("industry_category"), "type", F.make_date(F.lit(2001), F.lit(1), F.lit(1)).alias("date")))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stock_id, group (region), stock_name of all entities."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.select(_id("s_suppkey").alias("stock_id"), F.col("r_name").alias("group"), F.col("s_name").alias("stock_name"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.col(EXT) / F.col(QTY)
    first = F.min_by(unit, F.struct("l_orderkey", "l_linenumber", "l_partkey"))
    return lines(spark, sf_dir).groupBy("stock_id", "date").agg(
        first.alias("open"), F.max(unit).alias("max"), F.min(unit).alias("min"), (F.round(F.sum(EXT), 2) / F.sum(QTY)).alias("close"), F.sum(QTY).alias("Trading_Volume"), F.round(F.sum(EXT), 2).alias("Trading_money")
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).filter((F.round(DISC, 2) == 0.1) & (F.round(TAX, 2) == 0))
    return rows.groupBy("stock_id", "date").agg(F.round(F.sum(EXT), 2).alias("before_price"), F.round(F.sum(F.col(EXT) * (1 - F.col(DISC))), 4).alias("after_price"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that prices, events and daily facts need of an entity's day, from one aggregate of the lines; write it, as several tables are projections of it."""
    unit, event = F.col(EXT) / F.col(QTY), (F.round(DISC, 2) == 0.1) & (F.round(TAX, 2) == 0)
    signed = F.when(F.col("l_linestatus") == "O", F.col(QTY)).when(F.col("l_linestatus") == "F", -F.col(QTY)).otherwise(0.0)

    def quantity(test: Column) -> Column:
        return F.sum(F.when(test, F.col(QTY)).otherwise(0))

    return lines(spark, sf_dir).groupBy("stock_id", "date").agg(
        F.min_by(unit, F.struct("l_orderkey", "l_linenumber", "l_partkey")).alias("open"), F.max(unit).alias("max"), F.min(unit).alias("min"), (F.round(F.sum(EXT), 2) / F.sum(QTY)).alias("close"),
        F.sum(QTY).alias("Trading_Volume"), F.round(F.sum(EXT), 2).alias("Trading_money"),
        F.round(F.sum(F.when(event, F.col(EXT))), 2).alias("before_price"), F.round(F.sum(F.when(event, F.col(EXT) * (1 - F.col(DISC)))), 4).alias("after_price"),
        *[F.coalesce(F.sum(F.when(F.col("l_returnflag") == flag, signed)), F.lit(0.0)).alias(f"net_{flag}") for flag in "AN"], F.coalesce(F.sum(F.when(~F.coalesce(F.col("l_returnflag").isin("A", "N"), F.lit(False)), signed)), F.lit(0.0)).alias("net_R"),
        F.sum(F.when(F.round(TAX, 2) == 0, to_number(F.col(QTY), 0.0))).alias("lent"), quantity(F.col("l_linestatus") == "O").alias("O"), quantity(F.col("l_linestatus") == "F").alias("F"),
        F.round(F.sum(DISC), 2).alias("d"), F.round(F.sum(TAX), 2).alias("t"), quantity(F.col("l_returnflag") == "R").alias("r"),
    )


def day_prices(days: DataFrame) -> DataFrame:
    """Prices of a day; those that ``days`` was written without are left out."""
    return days.select("stock_id", "date", *[c for c in ("open", "max", "min", "close", "Trading_Volume", "Trading_money") if c in days.columns])


def day_events(days: DataFrame) -> DataFrame:
    return days.filter("before_price is not null").select("stock_id", "date", "before_price", "after_price")


def day_facts(days: DataFrame) -> DataFrame:
    """The columns of flows (net, by category), lending, margin, holdings and valuation, a row per entity and day; as numbers, since text of so many rows takes time to make and to read."""
    past = W.partitionBy("stock_id").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    c = F.col
    return days.select(
        "stock_id", "date", c("net_A").alias("foreign"), c("net_N").alias("trust"), c("net_R").alias("dealer"), c("lent").alias("volume"),
        F.sum("O").over(past).alias("MarginPurchaseTodayBalance"), F.sum("F").over(past).alias("ShortSaleTodayBalance"),
        F.when(c("r") > 0, F.round(100 * c("r") / c("Trading_Volume"), 4)).alias("ForeignInvestmentSharesRatio"),
        (c("d") * 100 - 5).alias("PER"), (c("t") * 10).alias("PBR"), F.when(c("d") > 0, c("d")).alias("dividend_yield"),
    )


def revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lines(spark, sf_dir).groupBy("stock_id", F.year("date").alias("revenue_year"), F.month("date").alias("revenue_month"))
    return df.agg(F.round(F.sum(F.col(EXT) * (1 - F.col(DISC))), 4).alias("month_revenue"))


def quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all statements need of an entity's quarter; write it to make several of them."""
    net, fee = F.col(EXT) * (1 - F.col(DISC)), F.col(EXT) * (1 - F.col(DISC) - F.col(TAX))
    end = F.last_day(F.add_months(F.trunc("date", "quarter"), 2))

    def total(x: Column) -> Column:
        return F.round(F.coalesce(F.sum(x), F.lit(0.0)), 4)

    return lines(spark, sf_dir).groupBy("stock_id", end.alias("date")).agg(
        total(F.col(EXT)).alias("ext"), total(net).alias("net"), total(fee).alias("fee"), total(F.when(F.col("l_returnflag") != "R", fee)).alias("pre"),
        F.sum(QTY).alias("qty"), total(F.when(F.col("l_linestatus") == "F", net)).alias("cash"), total(F.col(EXT) * F.col(TAX)).alias("tax"),
        total(F.when(F.col("l_linestatus") == "O", F.col(EXT))).alias("open"), total(F.when(F.col("l_linestatus") == "F", F.col(EXT))).alias("closed"),
        *[total(F.when(F.col("l_returnflag") == k, F.col(EXT))).alias(f"flag_{k}") for k in "RAN"], total(F.when(F.col("l_linenumber") == 1, F.col(EXT))).alias("first"),
    )


def _stack(df: DataFrame, items: dict[str, Column]) -> DataFrame:
    wide = df.select("stock_id", "date", *[v.alias(k) for k, v in items.items()])
    return wide.unpivot(["stock_id", "date"], list(items), "type", "value")


INCOME = ("Revenue", "GrossProfit", "OperatingIncome", "PreTaxIncome", "NetIncome", "IncomeAfterTaxes", "EPS", "EquityAttributableToOwnersOfParent")
BALANCE = ("TotalAssets", "Equity", "Liabilities", "CapitalStock", "CurrentAssets", "CurrentLiabilities", "EquityAttributableToOwnersOfParent", "Inventories", "AccountsReceivableNet", "CashAndCashEquivalents", "PropertyPlantAndEquipment", "IntangibleAssets", "RetainedEarnings")
CASH = ("CashFlowsFromOperatingActivities", "PropertyAndPlantAndEquipment")


def financials(spark: SparkSession, sf_dir: str, quarters: DataFrame | None = None) -> DataFrame:
    c = F.col
    return _stack(quarterly(spark, sf_dir) if quarters is None else quarters, {"Revenue": c("ext"), "GrossProfit": c("net"), "OperatingIncome": c("fee"), "PreTaxIncome": c("pre"), "NetIncome": c("pre") * 0.8, "IncomeAfterTaxes": c("pre") * 0.8, "EquityAttributableToOwnersOfParent": c("net") * 0.9, "EPS": c("pre") * 0.8 / c("qty"), "-": c("ext"), "Revenue_per": c("ext") * 0 + 100})


def balance(spark: SparkSession, sf_dir: str, quarters: DataFrame | None = None) -> DataFrame:
    past = W.partitionBy("stock_id").orderBy("date").rowsBetween(W.unboundedPreceding, 0)

    def run(x: str) -> Column:
        return F.round(F.sum(x).over(past), 4)

    q = (quarterly(spark, sf_dir) if quarters is None else quarters).select("stock_id", "date", run("ext").alias("a"), run("net").alias("e"), run("qty").alias("k"), run("open").alias("ca"), run("closed").alias("cl"), run("flag_R").alias("r"), run("flag_A").alias("ar"), run("flag_N").alias("n"), run("tax").alias("t"), run("first").alias("i"))
    c = F.col
    return _stack(q, {"TotalAssets": c("a"), "Equity": c("e"), "Liabilities": c("a") - c("e"), "CapitalStock": c("k") * 10, "CurrentAssets": c("ca"), "CurrentLiabilities": c("cl"), "EquityAttributableToOwnersOfParent": c("e") * 0.9, "Inventories": c("r"), "AccountsReceivableNet": c("ar"), "CashAndCashEquivalents": c("n"), "PropertyPlantAndEquipment": c("t"), "IntangibleAssets": c("i"), "RetainedEarnings": c("e") * 0.3})


def cashflow(spark: SparkSession, sf_dir: str, quarters: DataFrame | None = None) -> DataFrame:
    return _stack(quarterly(spark, sf_dir) if quarters is None else quarters, {"CashFlowsFromOperatingActivities": F.col("cash"), "PropertyAndPlantAndEquipment": -F.col("tax")})


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("l_returnflag") == "A", "Foreign_Investor").when(F.col("l_returnflag") == "N", "Investment_Trust").otherwise("Dealer_self")
    df = lines(spark, sf_dir).groupBy("stock_id", "date", name.alias("name"))
    return df.agg(F.sum(F.when(F.col("l_linestatus") == "O", F.col(QTY)).otherwise(0)).cast("string").alias("buy"), F.sum(F.when(F.col("l_linestatus") == "F", F.col(QTY)).otherwise(0)).cast("string").alias("sell"))


def lending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).filter(F.round(TAX, 2) == 0).select("stock_id", "date", F.col(QTY).alias("volume"))


def margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running quantities of open and closed lines by day."""
    past = W.partitionBy("stock_id").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    df = lines(spark, sf_dir).groupBy("stock_id", "date").agg(*[F.sum(F.when(F.col("l_linestatus") == k, F.col(QTY)).otherwise(0)).alias(k) for k in "OF"])
    return df.select("stock_id", "date", F.sum("O").over(past).alias("MarginPurchaseTodayBalance"), F.sum("F").over(past).alias("ShortSaleTodayBalance"))


def valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price-like ratios by day, as text."""
    df = lines(spark, sf_dir).groupBy("stock_id", "date").agg(F.round(F.sum(DISC), 2).alias("d"), F.round(F.sum(TAX), 2).alias("t"))
    return df.select("stock_id", "date", (F.col("d") * 100 - 5).cast("string").alias("PER"), (F.col("t") * 10).cast("string").alias("PBR"), F.when(F.col("d") > 0, F.col("d").cast("string")).otherwise("-").alias("dividend_yield"))


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A share by day, as text: quantity returned of each hundred shipped; days without returns have none."""
    df = lines(spark, sf_dir).groupBy("stock_id", "date").agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col(QTY)).otherwise(0)).alias("r"), F.sum(QTY).alias("q"))
    return df.select("stock_id", "date", F.when(F.col("r") > 0, F.round(100 * F.col("r") / F.col("q"), 4).cast("string")).otherwise("").alias("ForeignInvestmentSharesRatio"))


def benchmark_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name (order priority), date, price: the mean order of a day."""
    df = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name"), F.col("o_orderdate").cast("date").alias("date"))
    return df.agg((F.round(F.sum("o_totalprice"), 2) / F.count("*")).alias("price"))


def part_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense cross-section: parts by month with unit price ``close``, ``amt_21`` (money) and their type as group."""
    df = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("ym"))
    months = df.agg((F.round(F.sum(EXT), 2) / F.sum(QTY)).alias("close"), F.round(F.sum(EXT), 2).alias("amt_21"), F.sum(QTY).alias("volume"), (F.round(F.sum(DISC), 2) / F.count("*")).alias("discount"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_p"), F.col("p_type").alias("group"), F.col("p_name").alias("stock_name"))
    out = months.join(part, F.col("l_partkey") == F.col("_p"))
    return out.select(F.col("l_partkey").cast("string").alias("stock_id"), "ym", "group", "stock_name", "close", "amt_21", "volume", "discount")
