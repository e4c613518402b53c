"""As-of joins and rolling windows where one entity has most of all rows: equal to the plain way, and dealt to many tasks."""

import datetime
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import pit, rolling
from tidemark.sources import tables

START = datetime.date(2001, 1, 1)


def days(rng, n, length):
    return [START + datetime.timedelta(days=rng.randrange(length)) for _ in range(n)]


@pytest.fixture(scope="module")
def market(spark):
    """Nine tenths of all rows belong to one entity; some have no day or no entity, days repeat."""
    rng = random.Random(11)
    left = [("hot", d, float(i)) for i, d in enumerate(days(rng, 1800, 2500))] + [(f"e{rng.randrange(9)}", d, float(-i)) for i, d in enumerate(days(rng, 200, 2500))]
    left += [("hot", None, 1.0), (None, START, 2.0), (None, None, 3.0), ("alone", START, 4.0)]
    one = [("hot", d, rng.choice([None, float(i)]), f"t{i:04d}") for i, d in enumerate(days(rng, 300, 2500))] + [(f"e{rng.randrange(12)}", d, float(i), None) for i, d in enumerate(days(rng, 60, 2500))]
    one += [("hot", None, 5.0, "x"), (None, START, 6.0, "y")]
    two = [("hot", START + datetime.timedelta(days=d), d) for d in (5, 700, 2400)] + [("e1", START, 9)]
    return (
        spark.createDataFrame(left, "stock_id string, date date, v double").repartition(5),
        spark.createDataFrame(one, "stock_id string, known date, fact double, tie string"),
        spark.createDataFrame(two, "stock_id string, since date, other long"),
    )


@pytest.mark.parametrize("span", ["year", "month", "day"])
def test_spans_equal_one_window(spark, market, span):
    left, one, two = market
    sources = [pit.Source(one, "known", ("known", "fact"), "tie"), pit.Source(two, "since", ("since", "other"))]
    key = ["stock_id", "date", "v"]
    whole = pit.asof_join_all(left, sources).orderBy(*key).collect()
    dealt = pit.asof_join_all(left, sources, span=span)
    assert dealt.orderBy(*key).collect() == whole
    assert sum(r.known is not None for r in whole) > 1500 and any(r.known is not None and r.fact is None for r in whole)


def _window_keys(df):
    """What the windows of the plan that hold more than a row per entity and span are dealt by."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.split("\n") if "Window [" in line]


def test_no_window_of_rows_by_entity_alone(market):
    left, one, two = market
    dealt = pit.asof_join_all(left, [pit.Source(one, "known", ("known", "fact"), "tie")], span="year")
    keys = _window_keys(dealt)
    assert keys
    # the window over carried ends has a row per entity and span; that over facts is dealt by both
    assert sum("_at" in k for k in keys) == sum("_at" in k and "_span" in k.split("], [")[1] for k in keys) > 0
    daily = left.filter("date is not null").withColumns({"ret": F.col("v"), "amount": F.col("v"), "close": F.col("v")}).dropDuplicates(["stock_id", "date"])
    for k in _window_keys(rolling.add_rolling(daily, block=300)):
        part = k.split("], [")[1]
        assert "_span" in part or "_block" in part or "_k" in part, k


def test_blocks_equal_one_window(spark):
    rng = random.Random(12)
    rows = [("hot", START + datetime.timedelta(days=2 * i), *(rng.choice([None, *[rng.gauss(0, 1)] * 6]) for _ in range(3))) for i in range(1500)]
    rows += [(f"e{k}", START + datetime.timedelta(days=i), *(rng.gauss(0, 1) for _ in range(3))) for k in range(3) for i in range(50)]
    rows += [(None, START + datetime.timedelta(days=i), 1.0, 2.0, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "stock_id string, date date, ret double, amount double, close double").repartition(4)
    cols = ["vol_21", "vol_63", "vol_126", "amt_21", "hi_252"]
    whole = rolling.add_rolling(df).orderBy("stock_id", "date").collect()
    for block in (64, 251, 1000):  # blocks shorter than the longest window reach over several
        got = rolling.add_rolling(df, block=block, span="month")
        assert got.columns == df.columns + cols
        for a, b in zip(got.orderBy("stock_id", "date").collect(), whole, strict=True):
            assert tuple(a)[:5] == tuple(b)[:5]
            assert tuple(a)[5:] == pytest.approx(tuple(b)[5:], nan_ok=True)
    assert sum(r.hi_252 is not None for r in whole) > 1000


def test_numbers_are_places_by_day(spark):
    rng = random.Random(13)
    rows = [(rng.choice(["a", "b", None]), START + datetime.timedelta(days=i * 3)) for i in range(400)]
    got = rolling.numbered(spark.createDataFrame(rows, "stock_id string, date date"), "stock_id", "date", "quarter").collect()
    for key in ("a", "b", None):
        own = sorted((r.date, r._i) for r in got if r.stock_id == key)
        assert [i for _, i in own] == list(range(len(own)))


def test_runs_over_parts_equal_one_run(spark, market):
    """Facts and days arrive in three parts; each run reads its own part and the state of before."""
    left, one, two = market
    sources = [pit.Source(one, "known", ("known", "fact"), "tie"), pit.Source(two, "since", ("since", "other"))]
    left = left.filter("date is not null")
    cuts = [START + datetime.timedelta(days=k) for k in (0, 800, 801, 9999)]
    parts, state = [], None
    for a, b in zip(cuts, cuts[1:]):
        own = [pit.Source(s.df.filter((F.col(s.avail) >= F.lit(a)) & (F.col(s.avail) < F.lit(b))), s.avail, s.columns, s.tie) for s in sources]
        panel, state = pit.advance_panel(left.filter((F.col("date") >= F.lit(a)) & (F.col("date") < F.lit(b))), own, state)
        state = spark.createDataFrame(state.collect(), state.schema)
        parts.append(panel)
    got = parts[0].union(parts[1]).union(parts[2])
    key = ["stock_id", "date", "v"]
    assert got.orderBy(*key).collect() == pit.asof_join_all(left, sources).orderBy(*key).collect()
    assert state.count() == one.union(two.selectExpr("stock_id", "since", "other", "null")).filter("stock_id is not null and known is not null").select("stock_id").distinct().count()


def test_a_late_fact_counts_only_if_it_is_the_later_one(spark):
    left = spark.createDataFrame([("a", START + datetime.timedelta(days=50), 1.0)], "stock_id string, date date, v double")
    facts = spark.createDataFrame([("a", START + datetime.timedelta(days=k), float(k)) for k in (10, 20)], "stock_id string, known date, fact double")
    source = [pit.Source(facts.filter("fact = 20"), "known", ("known", "fact"))]
    _, state = pit.advance_panel(left.limit(0), source)
    late = [pit.Source(facts.filter("fact = 10"), "known", ("known", "fact"))]
    panel, state = pit.advance_panel(left, late, state)
    assert panel.first().fact == 20.0 and state.count() == 1


def test_a_table_in_buckets_needs_no_shuffle(spark, tmp_path):
    rows = [(f"e{i % 7}", START + datetime.timedelta(days=i), 0.1 * i, 1.0 * i, 2.0 * i) for i in range(400)]
    df = spark.createDataFrame(rows, "stock_id string, date date, ret double, amount double, close double")
    read = tables.write_bucketed(df, "bucketed_test", str(tmp_path / "b"), buckets=4)
    out = rolling.add_rolling(read)
    snap = rolling.month_end_snapshot(out)
    assert "Exchange" not in snap._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in rolling.add_rolling(df)._jdf.queryExecution().executedPlan().toString()
    cols = ["stock_id", "date", "vol_21", "hi_252"]
    for a, b in zip(out.select(*cols).orderBy("stock_id", "date").collect(), rolling.add_rolling(df).select(*cols).orderBy("stock_id", "date").collect(), strict=True):
        assert tuple(a)[:2] == tuple(b)[:2] and tuple(a)[2:] == pytest.approx(tuple(b)[2:], nan_ok=True)
    assert len(list((tmp_path / "b").glob("*.parquet"))) <= 4
    spark.sql("drop table bucketed_test")


def test_a_year_is_many_tasks(spark, tmp_path):
    df = spark.createDataFrame([(f"e{i}", START, float(i)) for i in range(200)], "stock_id string, date date, v double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or such small tasks are joined
    tables.write_by_year(df, str(tmp_path / "y"), tasks=8)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert 1 < len(list((tmp_path / "y" / "year=2001").glob("*.parquet"))) <= 8
    tables.write_by_year(df.drop("stock_id"), str(tmp_path / "z"), rows_per_file=10)
    assert len(list((tmp_path / "z" / "year=2001").glob("*.parquet"))) >= 20


def test_first_value_of_an_item_by_sequence(spark):
    rows = [("a", datetime.date(2020, 3, 31), "EPS", v, n) for v, n in ((None, 1), (5.0, 2), (3.0, 3))]
    df = spark.createDataFrame(rows, "stock_id string, date date, type string, value double, n int")
    assert pit.statement_to_wide(df, "f", ["EPS"], seq="n").first().f_EPS == 5.0
    assert pit.statement_to_wide(df, "f", ["EPS"]).first().f_EPS == 3.0


def test_daily_windows_cost_a_tile_and_equal_pandas(spark):
    rng = np.random.default_rng(3)
    rows = [(s, datetime.date(2015, 1, 1) + datetime.timedelta(days=i), *(None if rng.random() < 0.1 else v for v in ((0.1 if s == "flat" else float(rng.normal()) * (1e8 if i == 50 else 1)), 5.0, float(rng.integers(0, 999))))) for s in ("flat", "odd") for i in range(400)]
    out = rolling.add_rolling(spark.createDataFrame(rows, "stock_id string, date date, ret double, amount double, close double"))
    reach = [int(n) for n in re.findall(r"specifiedwindowframe\(RowFrame, -(\d+), currentrow", out._jdf.queryExecution().optimizedPlan().toString(), re.I)]
    assert reach and max(reach) < rolling.TILE
    got = out.orderBy("stock_id", "date").toPandas()
    for _, own in got.groupby("stock_id"):
        for n, least in ((21, 12), (63, 40), (126, 80)):
            want = [w.std() if w.count() >= least else np.nan for w in (own["ret"].iloc[max(0, i - n + 1) : i + 1] for i in range(len(own)))]
            np.testing.assert_allclose(own[f"vol_{n}"].to_numpy(float), want, rtol=1e-9, atol=1e-15)
        np.testing.assert_array_equal(own["hi_252"].to_numpy(float), own["close"].rolling(252, min_periods=120).max().to_numpy())
        np.testing.assert_allclose(own["amt_21"].to_numpy(float), own["amount"].rolling(21, min_periods=10).mean().to_numpy())
    assert set(got[got["stock_id"] == "flat"]["vol_126"].dropna()) == {0.0}
