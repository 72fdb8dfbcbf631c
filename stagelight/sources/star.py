"""The listing star: works, showings, venues, source runs and user marks, read from the tables of a folder.

Column names are those of the listing model; each table is a projection of one file, so filters and pruning reach its scan.
The SQL twins are common table expressions for the same views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = r"""
works as (select p_partkey as work_id, p_name as title, lower(p_type) as genre, p_brand as maker, 1974 + p_size as year,
  60 + 3 * p_size as runtime, p_retailprice as popularity from part),
showings as (select l_orderkey * 8 + l_linenumber as showing_id, l_partkey as work_id, l_suppkey as venue_id,
  l_shipdate + to_minutes(((l_orderkey * 37 + l_linenumber * 11) % 1440)::int) as shows_at,
  case l_returnflag when 'A' then '35mm' when 'N' then 'digital' else 'imax' end as format, l_linestatus = 'F' as sold_out,
  case when l_quantity < 5 then '' else 'https://tickets.example/' || (l_orderkey % 20000) end as url,
  case when l_discount > 0.08 then null else 'src' || (l_orderkey % 5000) end as source_id,
  l_shipdate - to_days(l_quantity::int) as scraped_at, l_extendedprice as price from lineitem),
venues as (select s_suppkey as venue_id, s_name as name, n_name as chain, r_name as area, 51.3::double + (s_suppkey % 50) * 0.01::double as lat,
  -0.6::double + (s_suppkey % 90) * 0.01::double as lng, s_acctbal as rating from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
runs as (select event_id as run_id, user_id as venue_id, ts as started_at, case when event_type = 'error' then 'failed' else 'success' end as status,
  case when value < 20 then 0 else floor(value)::int end as found, event_type from events),
marks as (select o_custkey as user_id, o_orderkey % 997 as work_id, case o_orderstatus when 'F' then 'seen' when 'O' then 'want' else 'skip' end as status,
  o_orderdate as updated_at, o_orderkey as mark_id from orders)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("work_id"), F.col("p_name").alias("title"), F.lower("p_type").alias("genre"), F.col("p_brand").alias("maker"),
        (F.lit(1974) + F.col("p_size")).alias("year"), (F.lit(60) + 3 * F.col("p_size")).alias("runtime"), F.col("p_retailprice").alias("popularity"),
    )


def showings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("showing_id"), F.col("l_partkey").alias("work_id"), F.col("l_suppkey").alias("venue_id"),
        F.expr("timestampadd(MINUTE, cast((l_orderkey * 37 + l_linenumber * 11) % 1440 as int), l_shipdate)").alias("shows_at"),
        F.when(F.col("l_returnflag") == "A", "35mm").when(F.col("l_returnflag") == "N", "digital").otherwise("imax").alias("format"),
        (F.col("l_linestatus") == "F").alias("sold_out"),
        F.when(F.col("l_quantity") < 5, "").otherwise(F.concat(F.lit("https://tickets.example/"), F.col("l_orderkey") % 20000)).alias("url"),
        F.when(F.col("l_discount") > 0.08, None).otherwise(F.concat(F.lit("src"), F.col("l_orderkey") % 5000)).alias("source_id"),
        F.expr("timestampadd(DAY, -cast(l_quantity as int), l_shipdate)").alias("scraped_at"), F.col("l_extendedprice").alias("price"),
    )


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.col("s_suppkey").alias("venue_id"), F.col("s_name").alias("name"), F.col("n_name").alias("chain"), F.col("r_name").alias("area"),
        (51.3 + (F.col("s_suppkey") % 50) * 0.01).alias("lat"), (-0.6 + (F.col("s_suppkey") % 90) * 0.01).alias("lng"), F.col("s_acctbal").alias("rating"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("venue_id"), F.col("ts").alias("started_at"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        F.when(F.col("value") < 20, 0).otherwise(F.floor("value").cast("int")).alias("found"), "event_type",
    )


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 997).alias("work_id"),
        F.when(F.col("o_orderstatus") == "F", "seen").when(F.col("o_orderstatus") == "O", "want").otherwise("skip").alias("status"),
        F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("mark_id"),
    )


class Star:
    """The five tables of one folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    works = property(lambda self: works(self.spark, self.sf_dir))
    showings = property(lambda self: showings(self.spark, self.sf_dir))
    venues = property(lambda self: venues(self.spark, self.sf_dir))
    runs = property(lambda self: runs(self.spark, self.sf_dir))
    marks = property(lambda self: marks(self.spark, self.sf_dir))

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def listing(self) -> DataFrame:
        """Showings with their works and venues; Spark broadcasts a dimension where its size allows it."""
        return self.showings.join(self.works, "work_id").join(self.venues, "venue_id")
