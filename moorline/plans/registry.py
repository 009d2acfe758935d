"""Registered queries by name, and their SQL forms."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package that hold QUERIES and ORACLE.
MODULES: tuple[str, ...] = ("q_grid", "q_ingest", "q_features", "q_models", "q_eval", "q_read", "q_stream", "q_merge")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        out |= importlib.import_module(f"moorline.plans.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= importlib.import_module(f"moorline.plans.{name}").ORACLE
    return out
