import datetime
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import day
from tidemark.jobs import queries
from tidemark.operators import factors, formula, ic, model, ortho, overfit, perf, portfolio, rolling, trees, xsection


def months(n: int):
    return [d.date() for d in pd.date_range("2015-01-01", periods=n, freq="MS")]


def frame(n_months=30, n=40, seed=0, holes=0.1) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    rows = [(f"s{i:02d}", ym, "AB"[i % 2], *rng.normal(size=3).round(2)) for ym in months(n_months) for i in range(n)]
    df = pd.DataFrame(rows, columns=["stock_id", "ym", "group", "x", "z", "fwd_ret_1m"])
    df["fwd_ret_1m"] *= 0.05
    df.loc[rng.random(len(df)) < holes, "x"] = np.nan
    return df


def load(spark, pdf: pd.DataFrame):
    kinds = {"float64": "double", "int64": "long"}
    schema = ", ".join(f"`{c}` {'date' if c in ('ym', 'date') else kinds.get(str(t), 'string')}" for c, t in pdf.dtypes.items())
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), schema)


def test_rank_ic_equals_pandas(spark):
    pdf = frame()
    got = {(r.ym, r.group): r.ic for r in ic.ic_by_cell(load(spark, pdf), ["x"]).collect()}
    for (ym, g), part in pdf.dropna(subset=["x"]).groupby(["ym", "group"]):
        if len(part) >= 8:
            assert got[(ym, g)] == pytest.approx(np.corrcoef(part["x"].rank(), part["fwd_ret_1m"].rank())[0, 1])
        else:
            assert (ym, g) not in got


def test_constant_columns_and_small_cells_give_no_ic(spark):
    rows = [(f"s{i}", day("2020-01-01"), g, x, float(i)) for g, n, x in (("A", 9, 1.0), ("B", 7, None)) for i in range(n)]
    df = spark.createDataFrame(rows, "stock_id string, ym date, group string, x double, fwd_ret_1m double").withColumn("x", F.coalesce("x", "fwd_ret_1m"))
    assert ic.ic_by_cell(df, ["x"]).count() == 0


def test_rank_ic_in_memory_and_by_windows(spark):
    pdf = frame(6, 60).round({"x": 0})
    pdf.loc[pdf["ym"] == months(6)[2], "z"] = np.inf
    df = load(spark, pdf)

    def found(own):
        return {(r.factor, r.ym, r.group): (r.n, pytest.approx(r.ic)) for r in own.collect()}

    by_group = ic.ic_by_cell(df, ["x", "z"])
    plan = by_group._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Expand" not in plan  # rows are not repeated for factors
    want = found(ic._ic_by_windows(df, ["x", "z"], "fwd_ret_1m", 8))
    assert len(want) == 22 and found(by_group) == want
    assert found(ic.ic_by_cell(df.filter("`group` = 'A' or stock_id < 's31'"), ["x", "z"], in_memory=80)) == found(ic._ic_by_windows(df.filter("`group` = 'A' or stock_id < 's31'"), ["x", "z"], "fwd_ret_1m", 8))


def test_winsorize_equals_pandas_and_keeps_missing(spark):
    pdf = frame(3)
    got = xsection.winsorize_by(load(spark, pdf), ["x"]).toPandas().set_index(["ym", "stock_id"])["x"]
    for ym, part in pdf.groupby("ym"):
        want = part["x"].clip(part["x"].quantile(0.01), part["x"].quantile(0.99))
        np.testing.assert_allclose(got.loc[ym].loc[part["stock_id"]].to_numpy(float), want.to_numpy())
    empty = spark.createDataFrame([("a", day("2020-01-01"), None)], "stock_id string, ym date, x double")
    assert xsection.winsorize_by(empty, ["x"]).first().x is None


def test_zscore_coverage_gate(spark):
    rows = [("s", day("2020-01-01"), g, v) for g, have, n in (("A", 60, 100), ("B", 59, 100)) for v in [float(i) if i < have else None for i in range(n)]]
    df = spark.createDataFrame([*rows, ("s", day("2020-01-01"), "C", 1.0), ("s", day("2020-01-01"), None, 1.0)], "stock_id string, ym date, group string, x double")
    got = xsection.zscore_within(df, ["x"], least_share=0.6).groupBy("group").agg(F.max("x").alias("m")).collect()
    got = {r.group: r.m for r in got}
    assert got["A"] == pytest.approx((59 - 29.5) / np.std(range(60), ddof=1))
    assert got["B"] == got["C"] == got[None] == 0.0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.none(), st.integers(0, 4)), min_size=1, max_size=12))
def test_average_rank_equals_pandas(spark, values):
    df = spark.createDataFrame([(i, day("2020-01-01"), None if v is None else float(v)) for i, v in enumerate(values)], "i int, ym date, x double")
    got = [r.p for r in xsection.pct_rank_avg(df, "x", ["ym"], "p").orderBy("i").collect()]
    want = pd.Series(values, dtype="float64").rank(pct=True)
    assert [None if pd.isna(w) else pytest.approx(w) for w in want] == got


def test_duplicate_columns_see_missing_values(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, 1.0), (2, None, None, 0.0)], "k int, a double, b double, c double")
    assert [r.features for r in xsection.duplicate_columns(df, ["a", "b", "c"], ["k"]).collect()] == [["a", "b"]]


def test_orthonormal_columns_have_identity_gram(spark):
    pdf = frame(2, holes=0).assign(y=lambda d: d["x"] + d["z"])
    cols = ("x", "z", "fwd_ret_1m")
    got = ortho.symmetric_orthonormalize(load(spark, pdf), cols).toPandas()
    for _, part in got.groupby("ym"):
        m = part[list(cols)].to_numpy(float)
        np.testing.assert_allclose(m.T @ m, np.eye(3), atol=1e-3)
    score = ortho.composite_score(load(spark, pdf), cols).toPandas().sort_values(["ym", "stock_id"])["score"].to_numpy(float)
    np.testing.assert_allclose(score, got.sort_values(["ym", "stock_id"])[list(cols)].mean(axis=1).to_numpy(float))
    assert ortho.composite_score(load(spark, pdf).filter("stock_id < 's05'"), cols).filter("score is not null").count() == 0


def brute_returns(pdf: pd.DataFrame, q=0.1, cost=0.004):
    out, before = [], None
    for ym, g in pdf.dropna(subset=["score", "fwd_ret_1m"]).groupby("ym"):
        if len(g) < 20:
            continue
        longs, shorts = [], []
        for _, gg in g.groupby("group"):
            if len(gg) >= 8:
                n = max(1, int(len(gg) * q))
                r = gg.sort_values(["score", "stock_id"], ascending=[False, True])
                longs.append(r.head(n))
                shorts.append(r.tail(n))
        if longs:
            lo, sh = pd.concat(longs), pd.concat(shorts)
            now = set(lo["stock_id"])
            turn = 1.0 if before is None else len(now ^ before) / len(now | before)
            before = now
            out.append((ym, lo["fwd_ret_1m"].mean() - cost * turn, lo["fwd_ret_1m"].mean() - sh["fwd_ret_1m"].mean() - cost * turn, g["fwd_ret_1m"].mean(), turn, len(lo)))
    return out


def test_portfolio_returns_with_skipped_months_and_small_groups(spark):
    pdf = frame(12).rename(columns={"x": "score"})
    pdf = pdf[~((pdf["ym"] == months(12)[4]) & (pdf["stock_id"] > "s18"))]  # 19 rows: skipped
    pdf = pdf[~((pdf["ym"] == months(12)[7]) & (pdf["group"] == "B") & (pdf["stock_id"] > "s13"))]  # a group of 7
    got = [tuple(r) for r in portfolio.portfolio_returns(load(spark, pdf)).orderBy("ym").collect()]
    want = brute_returns(pdf)
    assert [g[0] for g in got] == [w[0] for w in want]
    np.testing.assert_allclose([g[1:] for g in got], [w[1:] for w in want])
    swept = portfolio.sweep(load(spark, pdf), [0.1, 0.3], [0.004]).filter("q = 0.3").orderBy("ym").collect()
    np.testing.assert_allclose([r.long for r in swept], [w[1] for w in brute_returns(pdf, 0.3)])


def test_weights_fall_back_and_sum_to_one(spark):
    pdf = frame(2, holes=0.3)
    longs = load(spark, pdf)
    for mode in ("equal", "x", "absent"):
        assert all(r.s == pytest.approx(1) for r in portfolio.weights(longs, mode).groupBy("ym").agg(F.sum("w").alias("s")).collect())
    none = longs.withColumn("x", F.lit(None).cast("double"))
    assert portfolio.weights(none, "x").select("w").distinct().count() == 1


def test_performance_and_its_least_length(spark):
    r = [-0.5, 0.1, 0.2, -0.1, 0.05, 0.02]
    df = spark.createDataFrame([("a", m, v) for m, v in zip(months(6), r, strict=True)] + [("b", m, v) for m, v in zip(months(5), r, strict=False)], "series string, ym date, ret double")
    (got,) = perf.perf(df).collect()
    curve = np.cumprod(1 + np.array(r))
    assert got.max_dd == pytest.approx((curve / np.maximum.accumulate(curve) - 1).min()), "the first month's loss is no drawdown"
    assert got.cagr == pytest.approx(curve[-1] ** 2 - 1)


@pytest.mark.parametrize(("n", "folds"), [(48, 0), (49, 1), (60, 1), (61, 2)])
def test_folds(spark, n, folds):
    df = spark.createDataFrame([(m,) for m in months(n)], "ym date")
    got = model.walk_forward_folds(df).orderBy("fold").collect()
    assert len(got) == folds
    if got:
        assert (got[0].first_test, got[0].last_train) == (months(n)[48], months(n)[46])


def test_ridge_equals_closed_form(spark):
    pdf = frame(60, holes=0)
    df = model.prepare(load(spark, pdf), ["x", "z"])
    got = model.score_ridge(df, ["x", "z"], model.walk_forward_folds(df), least=100).toPandas().set_index(["ym", "stock_id"])["s_ridge"]
    p = df.toPandas()
    train = p[p["ym"] <= months(60)[46]]
    x, y = train[["x", "z"]].to_numpy(float), train["y"].to_numpy(float)
    w = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + 10 * np.eye(2), (x - x.mean(0)).T @ (y - y.mean()))
    test = p[p["ym"] >= months(60)[48]]
    want = test[["x", "z"]].to_numpy(float) @ w + y.mean() - x.mean(0) @ w
    np.testing.assert_allclose(got.loc[list(zip(test["ym"], test["stock_id"], strict=True))].to_numpy(float), want, atol=1e-9)


def test_pbo_equals_direct_computation(spark):
    from itertools import combinations

    rng = np.random.default_rng(1)
    r = pd.DataFrame(rng.normal(size=(27, 5)), index=months(27), columns=list("abcde"))
    rows = [(s, m, float(r.loc[m, s])) for s in r for m in r.index][:-1]  # the last month of e is missing
    got = overfit.cscv_pbo(spark.createDataFrame(rows, "strategy string, ym date, active double"), blocks=6).first()
    full = r.iloc[:-1]
    blocks, logits = np.array_split(np.arange(26), 6), []
    for chosen in combinations(range(6), 3):
        i = np.concatenate([blocks[b] for b in chosen])
        o = np.setdiff1d(np.arange(26), i)
        inside, outside = full.iloc[i].mean() / full.iloc[i].std(), full.iloc[o].mean() / full.iloc[o].std()
        omega = outside.rank()[inside.idxmax()] / 6
        logits.append(np.log(omega / (1 - omega)))
    assert (got.n_splits, got.pbo) == (20, pytest.approx((np.array(logits) <= 0).mean()))


def test_deflated_sharpe(spark):
    rng = np.random.default_rng(2)
    rows = [(s, m, float(v)) for k, s in enumerate("abc") for m, v in zip(months(40), rng.normal(0.01 * k, 0.05, 40), strict=True)]
    pdf = pd.DataFrame(rows, columns=["strategy", "ym", "active"])
    got = {r.strategy: r for r in overfit.deflated_sharpe(spark.createDataFrame(rows, "strategy string, ym date, active double")).collect()}
    own = {s: v.mean() / v.std() for s, v in pdf.groupby("strategy")["active"]}
    assert got["c"].sharpe == pytest.approx(own["c"])
    assert got["a"].target == got["c"].target > 0
    v = pdf[pdf["strategy"] == "c"]["active"]
    assert got["c"].deflated == pytest.approx(overfit.probabilistic_sharpe(own["c"], got["c"].target, 40, v.skew(), v.kurt() + 3))


def test_rolling_needs_enough_values(spark):
    df = spark.createDataFrame([("a", day(f"2020-01-{i + 1:02d}"), float(i) if i != 3 else None) for i in range(10)], "stock_id string, date date, ret double")
    got = [r.v for r in df.select("date", rolling.rolling(F.stddev_samp, "ret", 4, 3).alias("v")).orderBy("date").collect()]
    want = pd.Series([i if i != 3 else np.nan for i in range(10)], dtype=float).rolling(4, min_periods=3).std()
    assert [None if pd.isna(w) else pytest.approx(w) for w in want] == got


def test_factor_library_is_whole_and_skips_missing_inputs(spark):
    assert len({f.name for f in factors.LIBRARY}) == len(factors.LIBRARY) == 86
    df = spark.createDataFrame([("a", m, float(c)) for m, c in zip(months(4), (1, 2, 0, 3), strict=True)], "stock_id string, ym date, close double")
    got = factors.add_factors(df).orderBy("ym")
    assert {"mom_1m", "mom_12_1"} <= set(got.columns) and "roe" not in got.columns
    assert [r.mom_1m for r in got.collect()] == [None, 1.0, -1.0, None]
    assert [r.fwd_ret_1m for r in got.collect()] == [1.0, -1.0, None, None]


def test_formulas(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-4.0, 2.0), (None, 1.0)], "a double, b double")
    trees = {"d": ("b", "div", ("var", "a"), ("var", "b")), "r": ("u", "sqrt", ("var", "a")), "l": ("u", "log", ("var", "b"))}
    got = formula.add_formulas(df, trees).collect()
    assert [r.d for r in got] == [1.0, -2.0, None]
    assert [r.r for r in got] == [1.0, 2.0, None]
    assert got[0].l == pytest.approx(np.log(1e-9))
    assert formula.render(trees["d"]) == "(a / b)" and formula.size(trees["d"]) == 3


def test_gbt_scores_test_months(spark):
    df = model.prepare(load(spark, frame(50, n=20, holes=0)), ["x", "z"])
    got = model.score_gbt(df, ["x", "z"], model.walk_forward_folds(df), least=100, trees=2, depth=2, leaf_rows=5)
    assert got.filter("s_gbt is not null").count() == 40
    top = model.feature_importance(df, ["x", "z"], trees=2, depth=2, leaf_rows=5).collect()
    assert {r.feature for r in top} == {"x", "z"}


def test_registered_boosted_trees_keep_the_surveyed_settings(spark, monkeypatch):
    seen = {}

    def record(df, features, folds, **settings):
        seen.update(vars(trees.Settings(**settings)))
        return df.withColumn("s_gbt", F.lit(0.0))

    monkeypatch.setattr(model, "score_gbt", record)
    queries.score_gbt(spark, "/root/testdata/sf0.001")
    assert (seen["trees"], seen["rate"], seen["depth"], seen["leaves"], seen["leaf_rows"], seen["rows"], seen["columns"], seen["penalty"]) == (300, 0.03, 5, 31, 200, 0.8, 0.6, 5.0)


def test_percent_ranks_equal_brute_force_with_ties_nulls_and_null_groups(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, 0.0, 1.0, 1.0, rng.random(), rng.random()])) for i in range(900)] + [(1000, "c", None), (1001, "d", 5.0)]
    got = {r.id: r.p for r in xsection.pct_rank_avg(spark.createDataFrame(rows, "id long, k string, x double"), "x", ["k"], "p").collect()}
    assert len(got) == len(rows)
    for i, k, x in rows:
        own = [v for _, q, v in rows if q == k and v is not None]
        want = None if x is None else (sum(v < x for v in own) + (sum(v == x for v in own) + 1) / 2) / len(own)
        assert got[i] == (want if want is None else pytest.approx(want))


def test_weight_sweep_equals_single_runs(spark):
    rng = random.Random(9)
    rows = [(f"{s:03d}", datetime.date(2000, m, 1), "g", rng.random(), rng.gauss(0, 1), rng.choice([None, rng.random()]) if m > 1 else None) for s in range(60) for m in range(1, 5)]
    df = spark.createDataFrame(rows, "stock_id string, ym date, `group` string, score double, fwd_ret_1m double, other double")
    swept = portfolio.weight_sweep(df, [0.1, 0.3], ["equal", "other", "score"], [0.0, 0.01]).collect()
    for q in (0.1, 0.3):
        for mode in ("equal", "other", "score"):
            for cost in (0.0, 0.01):
                want = {r.ym: (r.long, r.turnover, r.nhold) for r in portfolio.portfolio_returns(df, q, mode, cost).collect()}
                got = {r.ym: (r.long, r.turnover, r.nhold) for r in swept if (r.q, r.weighting, r.cost) == (q, mode, cost)}
                assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_normal_functions_of_the_statements():
    import duckdb
    from statistics import NormalDist

    from tidemark.jobs.oracles import normal_cdf, normal_quantile

    con = duckdb.connect()
    for x in (-6.5, -2.0, -0.3, 0.0, 0.7, 1.9, 5.0):
        assert con.sql(f"SELECT {normal_cdf('v')} FROM (SELECT {x}::double AS v)").fetchall()[0][0] == pytest.approx(NormalDist().cdf(x), abs=1e-14)
    for p in (0.5, 0.8, 0.92, 0.93, 0.99, 0.999999):
        assert con.sql(f"SELECT {normal_quantile('v')} FROM (SELECT {p}::double AS v)").fetchall()[0][0] == pytest.approx(NormalDist().inv_cdf(p), abs=1e-12)


def test_top_factors_are_wide(spark):
    whole = spark.createDataFrame([("a", 0.1, 0.2), ("b", -0.9, 0.3), ("c", None, 0.1)], "factor string, icir_train double, icir_test double")
    groups = spark.createDataFrame([("b", "g", 1.0, 2.0), ("a", "h", 3.0, None)], "factor string, `group` string, icir_train double, icir_test double")
    got = {r.factor: r for r in ic.top_factors(whole, groups, ["g", "h"], 2).collect()}
    assert set(got) == {"a", "b"} and got["b"].icir_test_g == 2.0 and got["a"].icir_train_h == 3.0 and got["a"].icir_train_g is None


def test_importances_of_a_telling_feature(spark):
    rng = random.Random(3)
    rows = [(f"{i}", datetime.date(2000 + m // 12, m % 12 + 1, 1), x := rng.gauss(0, 1), rng.gauss(0, 1), x + rng.gauss(0, 0.1)) for m in range(14) for i in range(60)]
    df = spark.createDataFrame(rows, "stock_id string, ym date, a double, b double, y double")
    got = model.feature_importance(df, ["a", "b"], months=12, trees=3, depth=3, leaf_rows=5, columns=1.0).collect()
    assert [r.feature for r in got] == ["a", "b"] and got[0].importance > 0.8
