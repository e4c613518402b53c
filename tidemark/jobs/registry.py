"""All registered queries of the panel library with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.jobs.oracles import ORACLES
from tidemark.jobs.queries import QUERIES, ic_summary

flagship = ic_summary


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
