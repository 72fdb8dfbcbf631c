"""Registers a plan with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stagelight.sources import star

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def plan(name: str, sql: str | None = None):
    """The decorated function takes a Star and gives a DataFrame; sql starts after the star's common table expressions."""

    def register(build: Callable[[star.Star], DataFrame]) -> Callable[[star.Star], DataFrame]:
        PLANS[name] = lambda spark, sf_dir: build(star.Star(spark, sf_dir))
        if sql:
            text = sql.strip()
            recursive = text.lower().startswith("with recursive ")
            rest = text[15 if recursive else 5 :]
            ORACLE[name] = f"with {'recursive ' * recursive}{star.SQL}{', ' + rest if text.lower().startswith('with ') else text}"
        return build

    return register
