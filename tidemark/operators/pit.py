"""Point-in-time alignment: when each fact became known, and as-of joins on that day."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import to_number
from tidemark.functions.scratch import materialize


def revenue_availability(revenue: DataFrame) -> DataFrame:
    """Monthly revenue is known on the 10th of the next month; rows without year or month are dropped."""
    known = F.date_add(F.add_months(F.make_date("revenue_year", "revenue_month", F.lit(1)), 1), 9)
    return revenue.filter("revenue_year is not null and revenue_month is not null").withColumn("rev_avail", known)


def statement_deadline(period_end: Column) -> Column:
    """Legal filing day of a quarter; 90 days after other period ends."""
    m, y = F.month(period_end), F.year(period_end)
    return (
        F.when(m == 3, F.make_date(y, F.lit(5), F.lit(15)))
        .when(m == 6, F.make_date(y, F.lit(8), F.lit(14)))
        .when(m == 9, F.make_date(y, F.lit(11), F.lit(14)))
        .when(m == 12, F.make_date(y + 1, F.lit(3), F.lit(31)))
        .otherwise(F.date_add(period_end, 90))
    )


def statement_to_wide(long: DataFrame, prefix: str, items: Sequence[str], drop_shares: bool = False, avail: str = "avail", seq: str | None = None) -> DataFrame:
    """One row per entity and period with a column per item: ``prefix_item``, ``prefix_period_end``, ``prefix_avail``.

    Types ``-`` are dropped, with ``drop_shares`` those ending in ``_per`` too. Of several
    non-null values of an item the first by ``seq`` counts, without one the smallest. Only the named items are aggregated.
    """

    def value(item: str) -> Column:
        own = F.when(F.col("type") == item, F.col("value"))
        return F.min(own) if seq is None else F.min_by(own, F.when(own.isNotNull(), F.col(seq)))

    rows = long.filter((F.col("type") != "-") & F.col("type").isin(*items))
    if drop_shares:
        rows = rows.filter(~F.col("type").endswith("_per"))
    wide = rows.groupBy("stock_id", F.col("date").alias(f"{prefix}_period_end")).agg(*[value(i).alias(f"{prefix}_{i}") for i in items])
    return wide.withColumn(f"{prefix}_{avail}", statement_deadline(F.col(f"{prefix}_period_end")))


def lag_availability(df: DataFrame, days: int = 1, date: str = "date") -> DataFrame:
    """Data published after the close is usable ``days`` later: column avail."""
    return df.withColumn("avail", F.date_add(date, days))


#: Words that tell a flow's category, in order of precedence.
FLOW_CATEGORIES = (("foreign", "Foreign"), ("trust", "Trust"), ("dealer", "Dealer"))


def net_flow_by_category(flows: DataFrame, categories: Sequence[tuple[str, str]] = FLOW_CATEGORIES) -> DataFrame:
    """Net buying (buy - sell) per entity, day and category; other names count for nothing, missing is 0."""
    kind = F.coalesce(*[F.when(F.col("name").contains(word), out) for out, word in categories])
    net = to_number(F.col("buy"), 0.0) - to_number(F.col("sell"), 0.0)
    df = flows.select("stock_id", "date", kind.alias("kind"), net.alias("net")).filter("kind is not null")
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == c, F.col("net"))), F.lit(0.0)).alias(f"inst_{c}_net") for c, _ in categories]
    return lag_availability(df.groupBy("stock_id", "date").agg(*sums))


def daily_measures(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Project daily data under new names as numbers, usable the next day (margin, holdings, valuation)."""
    return lag_availability(df.select("stock_id", "date", *[to_number(F.col(src)).alias(new) for new, src in columns.items()]))


def margin_balances(df: DataFrame) -> DataFrame:
    return daily_measures(df, {"margin_balance": "MarginPurchaseTodayBalance", "short_balance": "ShortSaleTodayBalance"})


def holding_ratio(df: DataFrame) -> DataFrame:
    return daily_measures(df, {"foreign_ratio": "ForeignInvestmentSharesRatio"})


def valuation_ratios(df: DataFrame) -> DataFrame:
    return daily_measures(df, {"per": "PER", "pbr": "PBR", "div_yield": "dividend_yield"})


def lending_volume(df: DataFrame) -> DataFrame:
    """Lent volume summed per entity and day."""
    return lag_availability(df.groupBy("stock_id", "date").agg(F.sum(to_number(F.col("volume"), 0.0)).alias("lending_vol")))


@dataclass(frozen=True)
class Source:
    """Facts of an as-of join: when they are known, what they bring, what breaks ties of one day, and (``where``) which rows are facts at all.

    Sources that name the same table, day and tie pass the join as one row for all of them.
    """

    df: DataFrame
    avail: str
    columns: tuple[str, ...]
    tie: str | None = None
    where: str | None = None


def _tagged(left: DataFrame, sources: Sequence[Source], by: str, on: str) -> DataFrame:
    """Left rows (``_left``, side 1) and the facts of all sources (``_s0``, ``_s1``, ..., side 0) with entity and day."""
    out = left.select(F.struct("*").alias("_left"), F.col(by).alias("_by"), F.col(on).cast("date").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("string").alias("_tie"))
    shared: dict[tuple, list[int]] = {}
    for i, s in enumerate(sources):
        shared.setdefault((id(s.df), s.avail, s.tie), []).append(i)
    for own in shared.values():
        s = sources[own[0]]
        tie = F.col(s.tie).cast("string") if s.tie else F.lit(None).cast("string")
        right = s.df.filter(F.col(s.avail).isNotNull() & F.col(by).isNotNull())
        facts = [(i, F.struct(*sources[i].columns), sources[i].where) for i in own]
        told = [(fact if where is None else F.when(F.expr(where), fact)).alias(f"_s{i}") for i, fact, where in facts]
        out = out.unionByName(right.select(*told, F.col(by).alias("_by"), F.col(s.avail).cast("date").alias("_at"), F.lit(0).alias("_side"), tie.alias("_tie")), allowMissingColumns=True)
    return out


def _told(rows: DataFrame, sources: Sequence[Source]) -> DataFrame:
    return rows.select("_left.*", *[F.col(f"_s{i}.{c}").alias(c) for i, s in enumerate(sources) for c in s.columns])


def asof_join_all(left: DataFrame, sources: Sequence[Source], by: str = "stock_id", on: str = "date", span: str | None = None) -> DataFrame:
    """Each left row with the latest row of every source known on or before its day.

    The whole row is taken, with its nulls; of rows known on one day the greatest by ``tie``.
    Left rows and all sources pass one union, one shuffle by entity and one sort; every source
    is a window over the same order. Rows without a day or entity match nothing.

    With ``span`` (year, quarter, month, week or day) an entity's rows are dealt by span as well, so that one
    with most of all rows is many tasks: the last fact of each source in each span, which partial
    aggregation finds, is carried on to later spans (a row per entity and span), and windows
    stay within a span. The union is then written, as both steps read it.
    """
    if span is not None:
        return _asof_spans(_tagged(left, sources, by, on), sources, span)
    past = W.partitionBy("_by").orderBy("_at", "_side", "_tie").rowsBetween(W.unboundedPreceding, 0)
    last = {f"_s{i}": F.last(f"_s{i}", ignorenulls=True).over(past) for i in range(len(sources))}
    return _told(_tagged(left, sources, by, on).withColumns(last).filter("_side = 1"), sources)


def _order() -> Column:
    """What ``max_by`` finds the last fact of a source by; where it is null (rows of others) it passes over a row."""
    return F.struct("_at", F.col("_tie").isNotNull().alias("known"), F.coalesce("_tie", F.lit("")).alias("tie"))


def _asof_spans(rows: DataFrame, sources: Sequence[Source], span: str) -> DataFrame:
    rows = materialize(rows.withColumn("_span", F.date_trunc(span, "_at").cast("date")), "facts")
    names = [f"_s{i}" for i in range(len(sources))]
    ends = rows.filter("_by is not null and _span is not null").groupBy("_by", "_span").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), _order())).alias(c) for c in names])
    earlier = W.partitionBy("_by").orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(F.col("_by").alias("_c"), F.col("_span").alias("_cs"), *[F.last(c, ignorenulls=True).over(earlier).alias(f"_c{c}") for c in names])
    past = W.partitionBy("_by", "_span").orderBy("_at", "_side", "_tie").rowsBetween(W.unboundedPreceding, 0)
    within = rows.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in names}).filter("_side = 1")
    met = within.join(carried, (F.col("_by") == F.col("_c")) & (F.col("_span") == F.col("_cs")), "left")
    return _told(met.withColumns({c: F.coalesce(F.col(c), F.col(f"_c{c}")) for c in names}), sources)


def advance_panel(left: DataFrame, sources: Sequence[Source], state: DataFrame | None = None, by: str = "stock_id", on: str = "date") -> tuple[DataFrame, DataFrame]:
    """New days aligned from the facts that came with them and the last facts of before; and the last facts now.

    ``state`` is what the call before returned (write it): a row per entity with each source's last
    fact, its day and tie. So a call reads the new rows and that table, no older ones, and calls over consecutive
    parts give the rows of one call over all. A fact that arrives late counts from the next call on, if it is
    later than the one that is known. Both results come from one written table.
    """
    new = _tagged(left, sources, by, on)
    if state is not None:
        for i in range(len(sources)):
            known = state.filter(f"_s{i} is not null").select("_by", F.col(f"_s{i}.at").alias("_at"), F.col(f"_s{i}.tie").alias("_tie"), F.col(f"_s{i}.fact").alias(f"_s{i}"), F.lit(0).alias("_side"))
            new = new.unionByName(known, allowMissingColumns=True)
    rows = materialize(new, "facts")
    names = [f"_s{i}" for i in range(len(sources))]
    past = W.partitionBy("_by").orderBy("_at", "_side", "_tie").rowsBetween(W.unboundedPreceding, 0)
    panel = _told(rows.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in names}).filter("_side = 1"), sources)
    facts = rows.filter("_side = 0 and _by is not null")
    last = [F.max_by(F.struct(F.col(c).alias("fact"), F.col("_at").alias("at"), F.col("_tie").alias("tie")), F.when(F.col(c).isNotNull(), _order())).alias(c) for c in names]
    return panel, facts.groupBy("_by").agg(*last)


def asof_join(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, columns: Sequence[str], tie: str | None = None, span: str | None = None) -> DataFrame:
    return asof_join_all(left, [Source(right, right_on, tuple(columns), tie)], by, left_on, span)


def asof_join_ranges(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, columns: Sequence[str], tie: str | None = None) -> DataFrame:
    """The same for a small right side: its rows become half-open ranges of days and are joined by entity and range."""
    order = W.partitionBy(by).orderBy(right_on)
    best = right.filter(F.col(right_on).isNotNull() & F.col(by).isNotNull()).groupBy(by, right_on).agg(F.max(F.struct(*([tie] if tie else []), *[c for c in columns if c != tie])).alias("_r"))
    ranges = best.select(F.col(by).alias("_by"), F.col(right_on).cast("date").alias("_from"), F.lead(F.col(right_on).cast("date")).over(order).alias("_to"), *[F.col(f"_r.{c}").alias(c) for c in columns])
    at = F.col(left_on).cast("date")
    inside = (F.col(by) == F.col("_by")) & (at >= F.col("_from")) & (F.col("_to").isNull() | (at < F.col("_to")))
    return left.join(ranges, inside, "left").drop("_by", "_from", "_to")


def build_panel(base: DataFrame, sources: Sequence[Source | None], span: str | None = None) -> DataFrame:
    """The price base with every source that is there, as known on each day; ``span`` as in ``asof_join_all``."""
    return asof_join_all(base, [s for s in sources if s is not None], span=span)


def panel_coverage(panel: DataFrame, column_sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """n_rows, n_entities and, for each set of columns, the share of rows with any of them."""
    shares = [F.avg(F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull().cast("double")).alias(f"{name}_share") for name, cols in column_sets.items()]
    return panel.agg(F.count("*").alias("n_rows"), F.count_distinct("stock_id").alias("n_entities"), *shares)
