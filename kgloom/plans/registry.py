"""All registered queries of the graph engine and their SQL."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("relational", "graphs", "jobs", "whole")


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in import_module(f"kgloom.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in import_module(f"kgloom.plans.{m}").SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked missing links with names and types."""
    return queries()["l2_adamic_adar"](spark, sf_dir)
