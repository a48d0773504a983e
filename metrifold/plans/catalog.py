"""Every registered query, with its SQL."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from metrifold.plans import registry

MODULES = ("basics", "shapes", "analysis", "views", "live", "exchange", "recordings")


def _load() -> None:
    for name in MODULES:
        import_module(f"metrifold.plans.{name}")


def queries() -> dict:
    _load()
    return registry.QUERIES


def oracle_sql() -> dict:
    _load()
    return registry.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flagship_rate_by_type_hourly"](spark, sf_dir)
