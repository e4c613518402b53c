"""Boosted trees against a plain version, and the two ways to grow them against each other."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import model, trees

FEATURES = ["a", "b", "c"]
SMALL = {"trees": 6, "depth": 3, "leaf_rows": 15, "bins": 16, "rate": 0.2}


def month(i):
    return datetime.date(2000 + i // 12, i % 12 + 1, 1)


def rows(n_months=64, per_month=12, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for m in range(n_months):
        for k in range(per_month):
            a, b, c = rng.normal(size=3).round(2)
            y = a * (b > 0) + 0.3 * c + rng.normal() * 0.1
            out.append((str(k), month(m), *(None if rng.random() < 0.05 else float(v) for v in (a, b, c)), float(y)))
    return out


def table(spark, data):
    return spark.createDataFrame(data, "stock_id string, ym date, a double, b double, c double, y double")


def plain(data, fold, allowed, cuts, s):
    """One model by recursion over row sets: exhaustive search for the best bound, no sampling."""
    train = [r for r in data if r[1] <= fold["last_train"]]
    x = np.array([[0.0 if v is None else v for v in r[2:5]] for r in train])
    y = np.array([r[5] for r in train])
    mean, told, grown = y.mean(), np.full(len(y), y.mean()), []

    def node(at, rest, depth):
        value = s.rate * rest[at].sum() / (len(at) + s.penalty)
        if depth == s.depth:
            return value
        best = (0.0,)
        for f in allowed:
            for k, cut in enumerate(cuts[f]):
                left = x[at, f] <= cut
                n = left.sum()
                if min(n, len(at) - n) < s.leaf_rows:
                    continue
                g, total = rest[at[left]].sum(), rest[at].sum()
                gain = g**2 / (n + s.penalty) + (total - g) ** 2 / (len(at) - n + s.penalty) - total**2 / (len(at) + s.penalty)
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, f, cut)
        if len(best) == 1:
            return value
        _, f, cut = best
        left = x[at, f] <= cut
        return f, cut, node(at[left], rest, depth + 1), node(at[~left], rest, depth + 1)

    def value(t, row):
        while isinstance(t, tuple):
            t = t[2] if row[t[0]] <= t[1] else t[3]
        return t

    for _ in range(s.trees):
        t = node(np.arange(len(y)), y - told, 0)
        told = told + np.array([value(t, r) for r in x])
        grown.append(t)
    tests = [r for r in data if fold["first_test"] <= r[1] <= fold["last_test"]]
    return {(r[0], r[1]): mean + sum(value(t, [0.0 if v is None else v for v in r[2:5]]) for t in grown) for r in tests}


@pytest.mark.parametrize("whole", [0, 1 << 26])
def test_equal_to_plain_trees_in_every_fold_and_variant(spark, whole):
    data = rows()
    df = table(spark, data).repartition(3)
    folds = model.walk_forward_folds(df)
    cuts = trees.even_cuts(FEATURES, -2.0, 2.0, 0.5)
    settings = SMALL | {"rows": 1.0, "columns": 1.0, "whole": whole, "trees": 3, "keep": 2, "depth": 2}
    variants = {"all": FEATURES, "few": ["a", "b"]}
    got = model.score_gbt(df, FEATURES, folds, 100, variants, cuts, **settings).collect()
    assert len(got) == sum(1 for r in data if r[1] >= month(48))
    for name, allowed in (("s_all", [0, 1, 2]), ("s_few", [0, 1])):
        want = {}
        for fold in folds.collect():
            want |= plain(data, fold, allowed, cuts, trees.Settings(**settings))
        for r in got:
            assert r[name] == pytest.approx(want[r["stock_id"], r["ym"]], abs=1e-7)


def test_both_ways_and_any_partitioning_give_the_same_trees(spark):
    df = table(spark, rows(seed=3))
    folds = model.walk_forward_folds(df)
    one = model.fit_trees(df, FEATURES, folds, {"x": FEATURES, "y": FEATURES[:2]}, 100, whole=1 << 26, **SMALL)
    two = model.fit_trees(df.repartition(5), FEATURES, folds, {"x": FEATURES, "y": FEATURES[:2]}, 100, whole=0, keep=2, **SMALL)
    assert len(one.models) == len(two.models) == 4
    for m, k in zip(one.models, two.models):
        assert m.mean == k.mean and len(m.trees) == len(k.trees) == SMALL["trees"]
        for t, u in zip(m.trees, k.trees):
            for c in ("feature", "cut", "value", "gain"):
                assert np.array_equal(getattr(t, c), getattr(u, c))
    assert any((t.feature >= 0).sum() > 3 for m in one.models for t in m.trees)


def test_no_fold_sees_what_follows_its_training(spark):
    data = rows(seed=5)
    folds = model.walk_forward_folds(table(spark, data))
    end = month(47)  # of the first fold's training, and a month between
    changed = [r if r[1] < end else (*r[:5], r[5] * 100 - 3) for r in data]
    first = [model.score_gbt(table(spark, d), FEATURES, folds, 100, **SMALL).filter(F.col("ym") < F.lit(month(60))).orderBy("stock_id", "ym").collect() for d in (data, changed)]
    assert [(r["stock_id"], r["ym"]) for r in first[0]] == [(r["stock_id"], r["ym"]) for r in first[1]]
    # the scale of residuals follows the largest label, so the last bits may differ
    assert [r["s_gbt"] for r in first[0]] == pytest.approx([r["s_gbt"] for r in first[1]], abs=1e-6)


def test_leaves_are_capped_by_gain_and_large_enough(spark):
    df = table(spark, rows(seed=7))
    forest = model.fit_trees(df, FEATURES, model.walk_forward_folds(df), None, 100, **(SMALL | {"leaves": 6, "depth": 4, "leaf_rows": 40}))
    for m in forest.models:
        for t in m.trees:
            assert (t.feature >= 0).sum() <= 5
    found = forest.importance()
    assert sum(n for _, n in found.values()) == sum(int((t.feature >= 0).sum()) for m in forest.models for t in m.trees)


def test_too_few_rows_and_empty_tables_give_no_scores(spark):
    df = table(spark, rows(per_month=2))
    folds = model.walk_forward_folds(df)
    assert model.score_gbt(df, FEATURES, folds, least=1000, **SMALL).count() == 0
    none = df.limit(0)
    out = model.score_gbt(none, FEATURES, model.walk_forward_folds(none), **SMALL)
    assert out.count() == 0 and out.columns[-1] == "s_gbt"
    assert model.feature_importance(none, FEATURES, **SMALL).count() == 3


def test_ladder_has_every_model_and_trees_without_size(spark):
    data = [(*r, r[5]) for r in rows(seed=9)]
    df = spark.createDataFrame(data, "stock_id string, ym date, a double, b double, liq_amt double, y double, fwd_ret_1m double").withColumn("group", F.lit("g")).fillna(0.0)
    got = model.score_ladder(df, ["a", "b", "liq_amt"], model.walk_forward_folds(df), 100, **SMALL)
    assert {"s_equal", "s_ridge", "s_gbt", "s_gbt_neutral"} <= set(got.columns)
    moved = df.withColumn("liq_amt", -F.col("liq_amt") ** 3)
    again = model.score_ladder(moved, ["a", "b", "liq_amt"], model.walk_forward_folds(df), 100, **SMALL)
    key = ["stock_id", "ym"]
    a, b = ({tuple(r[c] for c in key): r for r in x.collect()} for x in (got, again))
    assert {k: r["s_gbt_neutral"] for k, r in a.items()} == {k: r["s_gbt_neutral"] for k, r in b.items()}
    assert any(r["s_gbt"] != b[k]["s_gbt"] for k, r in a.items())


def same(one, two):
    return len(one) == len(two) and all(np.array_equal(getattr(t, c), getattr(u, c)) for t, u in zip(one, two) for c in ("feature", "cut", "value", "gain"))


def test_few_combinations_take_one_job_a_tree(spark, monkeypatch):
    df = table(spark, rows(seed=11))
    folds, variants = model.walk_forward_folds(df), {"x": FEATURES, "y": FEATURES[:1]}
    by_level = trees._JOINT
    monkeypatch.setattr(trees, "_JOINT", 0)
    want = model.fit_trees(df, FEATURES, folds, variants, 100, whole=0, keep=2, **SMALL)
    monkeypatch.setattr(trees, "_JOINT", by_level)
    monkeypatch.setattr(trees, "_grow", None)  # what grows a tree by jobs for its levels
    got = model.fit_trees(df, FEATURES, folds, variants, 100, whole=0, keep=2, **SMALL)
    assert len(got.models) == len(want.models) == 4 and all(same(m.trees, k.trees) for m, k in zip(got.models, want.models))


@pytest.mark.parametrize("columns, bins", [(0.5, 16), (1.0, 6)])
def test_smaller_children_and_combinations_give_the_same_trees(monkeypatch, columns, bins):
    rng = np.random.default_rng(13)
    x = rng.integers(0, 16, (5, 3000)).astype(np.uint8)
    y, ids = x[0] * (x[1] > 4) - 0.5 * x[2] + rng.normal(size=3000), rng.integers(0, 1 << 60, 3000)
    s = trees.Settings(trees=5, depth=4, leaf_rows=10, leaves=11, columns=columns, bins=bins, rate=0.3)
    grown = []
    for joint in (0, 16**5):
        monkeypatch.setattr(trees, "_JOINT", joint)
        grown.append(trees._grow_whole(x % bins, y, ids, 0.0, np.arange(5), 0, bins, 2.0**20, s))
    assert same(*grown) and any((t.feature >= 0).sum() > 5 for t in grown[0])


def grid(columns, bins):
    """The bins of every combination of the columns, of three features."""
    x = np.zeros((3, bins ** len(columns)), np.uint8)
    x[columns] = np.indices((bins,) * len(columns)).reshape(len(columns), -1)
    return x


def test_passes_read_one_table_that_is_never_written_again(spark, monkeypatch):
    df = table(spark, rows(seed=17))
    folds, variants, written = model.walk_forward_folds(df), {"x": FEATURES, "y": FEATURES[:2]}, []

    def materialize(df, name, *more):
        written.append(name)
        return keep(df, name, *more)

    keep = trees.materialize
    monkeypatch.setattr(trees, "materialize", materialize)
    got = model.fit_trees(df, FEATURES, folds, variants, 100, whole=0, keep=2, **SMALL)
    assert written == ["binned"]
    monkeypatch.setattr(trees, "_TABLES", 0)  # predictions lie in the table, which is written every second tree
    want = model.fit_trees(df.repartition(3), FEATURES, folds, variants, 100, whole=0, keep=2, **SMALL)
    assert written == ["binned", "binned", "told", "told"]
    one = model.fit_trees(df, FEATURES, folds, variants, 100, **SMALL)
    assert all(same(a.trees, b.trees) and same(a.trees, c.trees) for a, b, c in zip(got.models, want.models, one.models, strict=True))


def test_trees_added_up_say_what_each_says(spark):
    df = table(spark, rows(seed=19))
    forest = model.fit_trees(df, FEATURES, model.walk_forward_folds(df), None, 100, **(SMALL | {"trees": 12, "depth": 4}))
    bins = max(len(c) for c in forest.cuts) + 1
    for m in forest.models:
        found = trees._by_columns(m.trees, bins, 1 << 28)
        assert () not in found and sum(len(own) for own in found.values()) == 12
        for c, own in found.items():
            said = [t.value[t.leaf(grid(list(c), bins))] for t in own]
            for order in (said, said[::-1]):
                assert np.array_equal(trees._summed_values(own, c, bins, forest.unit), sum(order))
        assert trees._by_columns(m.trees, bins, 0) == {(): m.trees}


def test_scores_by_sums_of_trees_equal_scores_by_each_tree(spark, monkeypatch):
    df = table(spark, rows(seed=23))
    forest = model.fit_trees(df, FEATURES, model.walk_forward_folds(df), None, 100, **SMALL)
    key, seen = ["stock_id", "ym"], []
    for most in (trees._TABLES, 0):
        monkeypatch.setattr(trees, "_TABLES", most)
        seen.append({tuple(r[c] for c in key): r["s"] for r in trees.score(df, forest, {"gbt": "s"}).collect()})
    assert seen[0] == seen[1] and len(set(seen[0].values())) > 20


def test_tasks_get_few_small_blocks_of_like_rows(spark, monkeypatch):
    df, seen, most = table(spark, rows(per_month=400, seed=29)), [], []
    real = trees._joint_sums

    def sums(binned, *more):
        if not seen:
            seen.extend(binned.collect())
        most.append(int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")))
        return real(binned, *more)

    monkeypatch.setattr(trees, "_joint_sums", sums)
    monkeypatch.setattr(trees, "_BLOCK", 1024 * 23)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        trees.fit(df, FEATURES, model.walk_forward_folds(df), {"x": FEATURES}, 100, settings=trees.Settings(**(SMALL | {"whole": 0, "trees": 1})))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert most and max(most) <= 1 << 22 and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    blocks = [np.frombuffer(r["x"], np.uint8).reshape(3, -1)[0] for r in seen]
    assert len(blocks) > 8 and sum(len(np.unique(b)) for b in blocks) < len(blocks) + 4 * 16


def test_sums_of_trees_are_kept_for_the_next_pass(monkeypatch):
    rng, s = np.random.default_rng(31), trees.Settings(unit=2.0**-40, depth=2, trees=9, bins=4, columns=1.0)
    m = trees.Model("x", month(0), month(0), month(0), np.arange(2))
    for _ in range(9):
        value = np.rint(rng.normal(size=7) / s.unit) * s.unit
        m.trees.append(trees.Tree(np.array([0, 1, 1, -1, -1, -1, -1]), np.array([1, 2, 0, 0, 0, 0, 0]), value, np.zeros(7)))
    added, real = [], trees._summed_values
    monkeypatch.setattr(trees, "_summed_values", lambda own, *more: added.append(len(own)) or real(own, *more))

    def values(n, fit):
        kept = trees.Model("x", month(0), month(0), month(0), np.arange(2), 0.0, m.trees[:n])
        return trees._Pass([kept], 0, 4, 1.0, s, fit).values()[0][0, 1]

    got = [values(n, "f") for n in (4, 9, 9, 6)]
    assert added == [4, 5, 6]
    assert all(np.array_equal(a, values(n, "")) for a, n in zip(got, (4, 9, 9, 6), strict=True))
