import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import day
from tidemark.operators import adjust, pit, universe


def test_asof_takes_whole_rows_and_exact_days(spark):
    left = spark.createDataFrame([("a", day("2020-01-01")), ("a", day("2020-01-05")), ("a", day("2020-01-09")), ("b", day("2020-01-05")), ("c", day("2020-01-05")), (None, day("2020-01-05"))], "id string, date date")
    right = spark.createDataFrame([("a", day("2020-01-02"), 1, 1.0), ("a", day("2020-01-05"), 1, None), ("a", day("2020-01-05"), 0, 9.0), ("b", day("2020-01-06"), 1, 3.0)], "id string, known date, seq int, v double")
    for join in (pit.asof_join, pit.asof_join_ranges):
        got = {(r.id, str(r.date)): (r.seq, r.v) for r in join(left, right, "id", "date", "known", ("known", "seq", "v"), "seq").collect()}
        assert got[("a", "2020-01-01")] == (None, None)
        assert got[("a", "2020-01-05")] == (1, None), "the later tie's null stays null"
        assert got[("a", "2020-01-09")] == (1, None)
        assert got[("b", "2020-01-05")] == got[("c", "2020-01-05")] == got[(None, "2020-01-05")] == (None, None)


def test_asof_equals_brute_force_and_never_looks_ahead(spark):
    rng = random.Random(3)
    left = [(rng.choice("abc"), day(f"2020-0{rng.randint(1, 6)}-{rng.randint(10, 28)}"), i) for i in range(150)]
    right = list({(s, d): (s, d, float(i)) for i, (s, d) in enumerate((rng.choice("abcd"), day(f"2020-0{rng.randint(1, 6)}-{rng.randint(10, 28)}")) for _ in range(60))}.values())

    def run(facts):
        r = spark.createDataFrame(facts, "stock_id string, known date, v double")
        df = pit.asof_join(spark.createDataFrame(left, "stock_id string, date date, n int"), r, "stock_id", "date", "known", ("v",))
        return {x.n: x.v for x in df.collect()}

    got = run(right)
    for s, d, n in left:
        past = [(k, v) for t, k, v in right if t == s and k <= d]
        assert got[n] == (max(past)[1] if past else None)
    cut = day("2020-03-20")
    early = run([r for r in right if r[1] <= cut])
    assert all(early[n] == got[n] for s, d, n in left if d <= cut)


@pytest.mark.parametrize(("end", "due"), [("2020-03-31", "2020-05-15"), ("2020-06-30", "2020-08-14"), ("2020-09-30", "2020-11-14"), ("2020-12-31", "2021-03-31"), ("2020-02-29", "2020-05-29")])
def test_deadline(spark, end, due):
    assert spark.createDataFrame([(day(end),)], "d date").select(pit.statement_deadline(F.col("d"))).first()[0] == day(due)


def test_revenue_is_known_on_the_tenth(spark):
    df = spark.createDataFrame([("a", 2020, 12, 1.0), ("a", None, 1, 2.0)], "stock_id string, revenue_year int, revenue_month int, revenue double")
    assert [r.rev_avail for r in pit.revenue_availability(df).collect()] == [day("2021-01-10")]


def test_statement_to_wide_drops_marks_and_shares(spark):
    rows = [("a", day("2020-03-31"), t, v) for t, v in (("-", 1.0), ("X", None), ("X", 5.0), ("X_per", 9.0))]
    r = pit.statement_to_wide(spark.createDataFrame(rows, "stock_id string, date date, type string, value double"), "f", ("X", "X_per", "Y"), drop_shares=True).first()
    assert (r.f_X, r.f_X_per, r.f_Y, r.f_avail) == (5.0, None, None, day("2020-05-15"))


def test_net_flow_first_word_wins_and_text_counts(spark):
    rows = [("a", day("2020-01-01"), "Foreign_Dealer", "5", "2"), ("a", day("2020-01-01"), "Other", "9", "1"), ("a", day("2020-01-01"), "Trust", "x", "1")]
    r = pit.net_flow_by_category(spark.createDataFrame(rows, "stock_id string, date date, name string, buy string, sell string")).first()
    assert (r.inst_foreign_net, r.inst_trust_net, r.inst_dealer_net, r.avail) == (3.0, -1.0, 0.0, day("2020-01-02"))


def test_back_adjust_counts_strictly_later_events(spark):
    prices = spark.createDataFrame([("a", day(f"2020-01-0{i}"), 100.0, 100.0, 100.0, 100.0) for i in (1, 2, 3)] + [("b", day("2020-01-01"), 1.0, 1.0, 1.0, 1.0)], "stock_id string, date date, open double, max double, min double, close double")
    events = spark.createDataFrame([("a", day("2020-01-02"), 10.0, 9.0), ("a", day("2020-01-03"), 10.0, 5.0), ("a", day("2020-01-03"), 0.0, 5.0), ("b", day("2020-01-05"), None, 5.0)], "stock_id string, date date, before_price double, after_price double")
    got = {(r.stock_id, r.date.day): r.adj_factor for r in adjust.back_adjust(prices, events).collect()}
    assert got == {("a", 1): pytest.approx(0.45), ("a", 2): 0.5, ("a", 3): 1.0, ("b", 1): 1.0}


def test_prefer_source(spark):
    schema = "stock_id string, close double"
    got = adjust.prefer_source(spark.createDataFrame([("a", 1.0)], schema), spark.createDataFrame([("a", 2.0), ("b", 3.0)], schema))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1.0, "vendor"), ("b", 3.0, "self")]


def test_coerce_numeric(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("inf",)], "v string")
    assert [r.v for r in adjust.coerce_numeric(df, ["v"]).collect()] == [1.5, None, None, None]
    assert [r.v for r in adjust.coerce_numeric(df, ["v"], 0.0).collect()] == [1.5, 0.0, 0.0, 0.0]


def test_universe(spark):
    rows = [("1101", "A", "steel works", "twse", day("2020-01-01")), ("1101", "A2", "chip maker", "twse", day("2021-01-01")), ("11012", "B", "steel", "twse", day("2020-01-01")), ("2222", "C", "steel chips", "tpex", day("2020-01-01")), ("3333", "D", "steel", "other", day("2020-01-01")), ("4444", "E", None, "twse", day("2020-01-01"))]
    got = universe.build_universe(spark.createDataFrame(rows, "stock_id string, stock_name string, industry_category string, type string, date date"), (("metal", ("steel",)), ("tech", ("chip",))))
    assert sorted((r.stock_id, r.group, r.stock_name) for r in got.collect()) == [("1101", "tech", "A2"), ("2222", "metal", "C")]


def test_daily_return_of_zero_and_missing(spark):
    df = spark.createDataFrame([("a", day(f"2020-01-0{i + 1}"), v) for i, v in enumerate((2.0, 0.0, 1.0, None, 3.0))], "stock_id string, date date, close double")
    got = [r.ret for r in adjust.daily_return(df).orderBy("date").collect()]
    assert got == [None, -1.0, None, None, None]
    assert np.isfinite([g for g in got if g is not None]).all()


def test_sources_of_one_table_pass_as_one_row(spark):
    left = spark.createDataFrame([("a", day("2020-01-05")), ("a", day("2020-01-09")), ("b", day("2020-01-09"))], "stock_id string, date date")
    facts = spark.createDataFrame([("a", day("2020-01-01"), 1, 10), ("a", day("2020-01-07"), 2, None), ("b", day("2020-01-02"), None, 30)], "stock_id string, avail date, x int, z int")
    shared = [pit.Source(facts, "avail", ("x",)), pit.Source(facts, "avail", ("z",), where="z is not null")]
    assert pit._tagged(left, shared, "stock_id", "date").count() == left.count() + facts.count()
    for span in (None, "day"):
        got = {tuple(r) for r in pit.build_panel(left, shared, span).collect()}
        assert got == {("a", day("2020-01-05"), 1, 10), ("a", day("2020-01-09"), 2, 10), ("b", day("2020-01-09"), None, 30)}
