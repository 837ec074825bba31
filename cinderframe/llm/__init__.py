"""Operators for preparing training data at scale. Nothing outside this package imports it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES (name to a function of session and table folder) and SQL.
MODULES = ("substring_dedup", "decontaminate", "token_files", "fingerprints", "url_filter", "language_id", "chat_format", "lm_score", "source_mix", "near_dedup", "simhash", "centroids", "turn_repair")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f"{__name__}.{m}").SQL.items()}
