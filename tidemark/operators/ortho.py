"""Symmetric orthogonalisation of factors and the composite score."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RIDGE, FLOOR = 1e-6, 1e-10


def gram(df: DataFrame, columns: Sequence[str], by: str = "ym") -> DataFrame:
    """n and, in ``g``, the upper triangle of F'F of each month, by partial sums."""
    pairs = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(columns) for b in columns[i:]]
    return df.groupBy(by).agg(F.count("*").alias("n"), F.array(*pairs).alias("g"))


def _inverse_root(g: Sequence[float], k: int) -> np.ndarray:
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = g
    m = m + m.T - np.diag(np.diag(m)) + RIDGE * np.eye(k)
    value, vector = np.linalg.eigh(m)
    return vector @ np.diag(1 / np.sqrt(np.maximum(value, FLOOR))) @ vector.T


def transforms(df: DataFrame, columns: Sequence[str], by: str = "ym", least: int = 10) -> DataFrame:
    """A row per month of at least ``least`` rows: the matrix (F'F + ridge)^(-1/2) as ``m``, row by row.

    Only k x k sums per month reach Python.
    """
    k = len(columns)
    sums = gram(df, columns, by).filter(F.col("n") >= least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({by: batch[by], "m": [_inverse_root(g, k).reshape(-1) for g in batch["g"]]})

    return sums.select(by, "g").mapInPandas(run, f"{by} {dict(df.dtypes)[by]}, m array<double>")


def symmetric_orthonormalize(df: DataFrame, columns: Sequence[str], by: str = "ym", least: int = 10) -> DataFrame:
    """Replace the columns by F (F'F + ridge)^(-1/2) of their month; null in months with too few rows."""
    k = len(columns)
    joined = df.join(transforms(df, columns, by, least), by, "left")
    new = {c: sum((F.col(a) * F.get("m", F.lit(i * k + j)) for i, a in enumerate(columns)), F.lit(0.0)) for j, c in enumerate(columns)}
    return joined.withColumns(new).drop("m")


def composite_score(df: DataFrame, columns: Sequence[str], by: str = "ym", least: int = 10, out: str = "score") -> DataFrame:
    """The mean of the orthogonalised columns: one weight per column and month is joined back."""
    k = len(columns)
    m = transforms(df, columns, by, least)
    w = m.select(by, *[(sum((F.get("m", F.lit(i * k + j)) for j in range(k)), F.lit(0.0)) / k).alias(f"_w{i}") for i in range(k)])
    score = sum((F.col(a) * F.col(f"_w{i}") for i, a in enumerate(columns)), F.lit(0.0))
    return df.join(w, by, "left").withColumn(out, score).drop(*[f"_w{i}" for i in range(k)])
