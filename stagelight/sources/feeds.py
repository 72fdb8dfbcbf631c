"""Feeds of venue chains: folders of JSON lines, one folder a chain, each line an entry whose details are JSON in a field of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DETAILS = "title string, starts string, url string, price double"
LINE = "venue_id long, chain string, details string, _broken string"


def write_feed(entries: DataFrame, path: str) -> None:
    """entries: chain, venue_id and the columns of DETAILS."""
    names = [c.split(" ")[0] for c in DETAILS.split(", ")]
    entries.select("chain", "venue_id", F.to_json(F.struct(*names)).alias("details")).write.mode("append").partitionBy("chain").json(path)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """chain, venue_id, the details' columns and broken: whether the line or its details are no JSON. A filter on chain skips other chains' folders."""
    lines = spark.read.schema(LINE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    parsed = lines.withColumn("d", F.from_json("details", DETAILS))
    broken = F.col("_broken").isNotNull() | F.col("venue_id").isNull() | F.col("d.title").isNull()
    return parsed.select("chain", "venue_id", "d.*", broken.alias("broken"))
