"""Factors given as expression trees.

A tree is ("var", name), ("const", number), ("u", op, tree) or ("b", op, left, right).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ic import eval_split, ic_by_cell, pearson, to_long
from tidemark.operators.xsection import avg_rank

Tree = tuple
BINARY = {"add": "+", "sub": "-", "mul": "*", "div": "/"}
UNARY = ("neg", "abs", "sqrt", "log")
TINY, COST, UNFIT = 1e-9, 0.0008, -9.0


def compile_formula(tree: Tree) -> Column:
    """One column expression; division by almost nothing is 1, roots and logarithms take absolute values."""
    kind = tree[0]
    if kind == "var":
        return F.col(tree[1]).cast("double")
    if kind == "const":
        return F.lit(float(tree[1]))
    if kind == "u":
        x = compile_formula(tree[2])
        return {"neg": -x, "abs": F.abs(x), "sqrt": F.sqrt(F.abs(x)), "log": F.log(F.abs(x) + TINY)}[tree[1]]
    a, b = compile_formula(tree[2]), compile_formula(tree[3])
    if tree[1] == "div":
        return F.when(F.abs(b) > TINY, a / F.when(F.abs(b) > TINY, b)).when(b.isNotNull() & a.isNotNull(), F.lit(1.0))
    return {"add": a + b, "sub": a - b, "mul": a * b}[tree[1]]


def size(tree: Tree) -> int:
    return 1 if tree[0] in ("var", "const") else 1 + sum(size(t) for t in tree[2:])


def render(tree: Tree) -> str:
    if tree[0] == "var":
        return str(tree[1])
    if tree[0] == "const":
        return f"{tree[1]:.3g}"
    if tree[0] == "u":
        return f"{tree[1]}({render(tree[2])})"
    return f"({render(tree[2])} {BINARY[tree[1]]} {render(tree[3])})"


def add_formulas(df: DataFrame, formulas: Mapping[str, Tree]) -> DataFrame:
    return df.withColumns({name: compile_formula(t) for name, t in formulas.items()})


def formula_fitness(df: DataFrame, formulas: Mapping[str, Tree], label: str = "fwd_ret_1m", least_rows: int = 200, least_values: int = 5, least_months: int = 12) -> DataFrame:
    """name, icir, fitness of a batch of formulas in one scan.

    A month's IC correlates the ranks within cells over all groups together. Formulas with too
    few values or months have the fitness ``UNFIT``; else it is |ICIR| less a cost for size.
    """
    cell = ["factor", "ym", "group"]
    long = to_long(add_formulas(df, formulas), list(formulas), label)
    usable = long.groupBy("factor").agg(F.count("*").alias("rows"), F.count_distinct("x").alias("values"))
    ranked = long.withColumns({"rx": avg_rank("x", cell), "ry": avg_rank("y", cell)})
    monthly = ranked.groupBy("factor", "ym").agg(pearson(F.col("rx"), F.col("ry")).alias("ic")).filter("ic is not null")
    s = monthly.groupBy("factor").agg(F.count("*").alias("months"), F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("icir"))
    cost = F.create_map(*[F.lit(v) for name, t in formulas.items() for v in (name, COST * size(t))])
    fit = (F.col("rows") >= least_rows) & (F.col("values") >= least_values) & (F.col("months") >= least_months) & F.col("icir").isNotNull()
    out = usable.join(s, "factor", "left")
    return out.select(F.col("factor").alias("name"), "icir", F.when(fit, F.abs("icir") - cost[F.col("factor")]).otherwise(UNFIT).alias("fitness"))


def formula_split_eval(df: DataFrame, formulas: Mapping[str, Tree], train_end: str, label: str = "fwd_ret_1m", least_test: float = 0.2) -> DataFrame:
    """factor, icir_train, icir_test, stable: same sign before and after, and strong enough after."""
    cells = ic_by_cell(add_formulas(df, formulas), list(formulas), label)
    out = eval_split(cells, train_end).select("factor", "icir_train", "icir_test")
    stable = (F.signum("icir_train") == F.signum("icir_test")) & (F.abs("icir_test") > least_test)
    return out.withColumn("stable", F.coalesce(stable, F.lit(False)))


def best_operand(df: DataFrame, operands: list[str], train_end: str, label: str = "fwd_ret_1m") -> DataFrame:
    """The single operand with the largest |ICIR| in training: the baseline of formulas."""
    out = eval_split(ic_by_cell(df, operands, label), train_end)
    return out.orderBy(F.abs("icir_train").desc_nulls_last(), "factor").limit(1).select("factor", "icir_train", "icir_test")
