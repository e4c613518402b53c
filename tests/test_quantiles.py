"""Exact tail quantiles against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import xsection


def check(spark, groups, low=0.01, high=0.99, **settings):
    rows = [(g, *(None if np.isnan(v) else float(v) for v in r)) for g, x in groups.items() for r in x]
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(5)
    got = {r.g: r for r in xsection.tail_quantiles(df, ["a", "b"], ["g"], low, high, **settings).collect()}
    for g, x in groups.items():
        for k, c in enumerate(("_q_a", "_q_b")):
            known = x[~np.isnan(x[:, k]), k]
            if len(known):
                assert got[g][c] == pytest.approx(list(np.quantile(known, [low, high])), rel=1e-12), (g, c)
            elif g in got:
                assert got[g][c] == [None, None]


def groups(seed=0):
    rng = np.random.default_rng(seed)
    out = {f"n{n}": rng.normal(size=(n, 2)) for n in (1, 2, 3, 5, 49, 50, 99, 100, 101, 1000, 20_000)}
    out["ties"] = np.column_stack([rng.integers(0, 3, 5000), np.where(rng.random(5000) < 0.4, 0.0, rng.normal(size=5000))]).astype(float)
    out["holes"] = np.where(rng.random((3000, 2)) < 0.7, np.nan, rng.lognormal(size=(3000, 2)))
    out["none"] = np.full((10, 2), np.nan)
    out["half"] = np.column_stack([np.full(40, np.nan), np.arange(40.0)])
    out[None] = rng.normal(size=(300, 2))
    return out


def test_quantiles_equal_numpy(spark):
    check(spark, groups())


def test_other_levels(spark):
    check(spark, groups(1), 0.25, 0.9)
    check(spark, groups(2), 0.5, 0.5)
    check(spark, groups(3), 0.0, 1.0)


def test_short_tails_are_taken_anew(spark, monkeypatch):
    """Sketches that lie far off: the result stays exact."""
    real = xsection.F.percentile_approx
    monkeypatch.setattr(xsection.F, "percentile_approx", lambda c, levels, accuracy: F.transform(real(c, levels, accuracy), lambda x, i: F.when(i < 6, x - 1.5).otherwise(x + 1.5)))
    check(spark, {k: v for k, v in groups(4).items() if k in ("n1000", "n20000", "n50", "ties")})


def test_no_map_of_values_and_no_window_of_a_month(spark):
    df = spark.createDataFrame([("m", float(i)) for i in range(100)], "ym string, x double")
    out = xsection.winsorize_by(df, ["x"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "Window" not in plan
    assert out.agg(F.min("x"), F.max("x")).first() == (pytest.approx(0.99), pytest.approx(98.01))


def test_many_columns_are_done_by_numpy_to_the_same_values(spark, monkeypatch):
    rng, columns = np.random.default_rng(5), [f"c{i}" for i in range(10)]
    rows = [(None if k % 40 == 7 else f"m{k % 3 if k < 900 else 3}", "ab"[k % 2], k, *(None if i < 9 and rng.random() < 0.3 else 0.5 if i == 9 else float(v) for i, v in enumerate(rng.normal(size=10).round(1)))) for k in range(903)]
    df = spark.createDataFrame(rows, "ym string, `group` string, k int, " + ", ".join(f"{c} double" for c in columns)).repartition(5)
    assert len(columns) >= xsection.WIDE

    def run():
        return [out.orderBy("k").collect() for out in (xsection.winsorize_by(df, columns), xsection.zscore_within(df, columns, least_share=0.6))]

    want = []
    with monkeypatch.context() as m:
        m.setattr(xsection, "IN_TASK", 0)  # groups that no task holds
        want = run()
    monkeypatch.setattr(xsection, "tail_quantiles", None)
    monkeypatch.setattr(xsection, "_stats_join", lambda df, stats, by, real=xsection._stats_join: real(df, stats, by) if list(by) == ["ym"] else None)
    got = run()
    assert got[0] == want[0]
    for a, b in zip(got[1], want[1], strict=True):
        assert tuple(a)[:3] == tuple(b)[:3] and list(a)[3:] == pytest.approx(list(b)[3:], abs=1e-12)
