"""The session that the library is meant for: UTC, adaptive execution, skewed joins split."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]


def session(name: str = "stagelight", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true", **conf,
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Spark's file server hand this package to the Python workers, once a context, unless PYTHONPATH does already."""
    sc = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_stagelight_shipped", False):
        return
    archive = f"{tempfile.mkdtemp(prefix='spark-')}/stagelight_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in [*sorted((ROOT / "stagelight").rglob("*.py")), *ROOT.glob("corpus_pipeline.py")]:
            out.write(path, path.relative_to(ROOT))
    sc.addPyFile(archive)
    sc._stagelight_shipped = True
