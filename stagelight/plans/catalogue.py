"""All queries of the library by name, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stagelight.plans import basics, dedupe, health, ingest, listing, matching, rollups, scalars, search, streams  # noqa: F401
from stagelight.plans.registry import ORACLE, PLANS
from stagelight.sources.star import Star


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.listing_page(Star(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(PLANS)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
