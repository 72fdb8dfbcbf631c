"""Helpers shared by the corpus operators: durable intermediates, native text expressions and a blocked Bloom filter."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space that parts words, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session gets a folder of its own; a cluster is refused."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, name: str, rows_in_file: int = 0) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, so a lost executor costs no recomputation.

    Row ids made by monotonically_increasing_id are fixed from here on, which they are not in a plan that may run twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stagelight/{name}-{uuid.uuid4().hex}"
    # The result is in files, so what was shuffled for it can go at once.
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("maxRecordsPerFile", rows_in_file).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*dfs: DataFrame) -> None:
    """Delete the files of durable frames that nothing reads any more; others are left alone."""
    for df in dfs:
        spark, home = df.sparkSession, f"{shared_dir(df.sparkSession)}/stagelight/"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            # Spark writes file:/x for file:///x.
            if re.sub("^file:/+", "file:/", folder).startswith(re.sub("^file:/+", "file:/", home)):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shield(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but the needed ones renamed, so that no name clashes with a helper's; and what turns rows back."""
    columns = docs.columns
    hidden = {c: f"_col{i}" for i, c in enumerate(columns) if c not in needed}
    return docs.withColumnsRenamed(hidden), lambda df: df.select(*(F.col(hidden.get(c, c)).alias(c) for c in columns))


def rows(spark: SparkSession, values: list[dict], types: dict[str, str]) -> DataFrame:
    """A small literal table made by the JVM alone."""
    made = [F.struct(*(F.lit(v[c]).cast(t).alias(c) for c, t in types.items())) for v in values]
    if not made:
        return spark.range(0).select(*(F.lit(None).cast(t).alias(c) for c, t in types.items()))
    return spark.range(1).select(F.inline(F.array(*made)))


def text_of(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() does just that, and faster, where every character is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def fenced(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row.

    A generator of one element keeps the optimizer from copying the expression into each place, or lambda, that uses it.
    """
    for name, column in columns.items():
        df = df.select("*", F.explode_outer(F.array(column)).alias(name))
    return df


# ---- blocked Bloom filter -------------------------------------------------------------------------------------------

WORDS = 4  # of 64 bits in a block; each key sets one bit in each
#: A filter grows with its keys up to 2**19 blocks of 32 bytes, 16 MB, for 8 million keys; that is what is broadcast at most. A fuller
#: one passes more, never fewer: beyond some 10 times as many keys nearly all rows go on to the join, which is an ordinary one.
MAX_BLOCKS = 1 << 19
KEYS_A_BLOCK = 16


def _bit(hashed: str, word: int) -> Column:
    return F.expr(f"shiftleft(1L, cast(shiftrightunsigned({hashed}, {6 * word}) & 63 as int))")


def bloom(keys: DataFrame, key: Column, n_keys: int) -> tuple[DataFrame, int]:
    """The filter's blocks (block, w0..w3) and their number."""
    n = min(MAX_BLOCKS, 1 << max(0, (n_keys // KEYS_A_BLOCK).bit_length()))
    hashed = keys.select(F.xxhash64(key).alias("_h"), F.xxhash64(key, F.lit(7)).alias("_g"))
    return hashed.groupBy(F.pmod("_h", F.lit(n)).alias("_block")).agg(*(F.bit_or(_bit("_g", i)).alias(f"_w{i}") for i in range(WORDS))), n


def probe(df: DataFrame, key: Column, blocks: tuple[DataFrame, int], name: str) -> DataFrame:
    """Add a boolean column: false where the key is certainly not among the filter's keys. The broadcast side is bounded by MAX_BLOCKS."""
    filter_, n = blocks
    hashed = df.withColumn("_h", F.xxhash64(key)).withColumn("_g", F.xxhash64(key, F.lit(7))).withColumn("_block", F.pmod("_h", F.lit(n)))
    hit = F.lit(True)
    for i in range(WORDS):
        hit &= F.col(f"_w{i}").bitwiseAND(_bit("_g", i)) != 0
    out = hashed.join(F.broadcast(filter_), "_block", "left").withColumn(name, F.coalesce(hit, F.lit(False)))
    return out.drop("_h", "_g", "_block", *(f"_w{i}" for i in range(WORDS)))


def settled(tagged: DataFrame, told: DataFrame, same: list[tuple[str, str]]) -> DataFrame:
    """The rows that stay of tagged, given what is told (_kept, _n) of some keys: unknown rows, kept ones, and of kept rows alike in key one.

    Rows that the Bloom filter of told's keys does not know pass without a join, and so without a shuffle. `same` pairs the
    columns of the key with told's names for them; null keys are alike.
    """
    columns = tagged.columns
    here, there = F.xxhash64(*(a for a, _ in same)), F.xxhash64(*(b for _, b in same))
    probed = probe(tagged, here, bloom(told, there, told.count()), "_maybe")
    on = F.lit(True)
    for a, b in same:
        on &= F.col(a).eqNullSafe(F.col(b))
    met = probed.where("_maybe").join(told, on, "left")
    out = probed.where("not _maybe").select(columns).unionByName(met.where("_n is null or (_n = 1 and _kept)").select(columns))
    twice = met.where("_n > 1 and _kept").groupBy(*(b for _, b in same)).agg(F.min(F.struct(*columns)).alias("_one"))
    return out.unionByName(twice.select("_one.*"))


#: Into so many parts a key's rows are dealt where one key may hold a large share of them.
SALTS = 16


def salted_join(df: DataFrame, row: Column, few: DataFrame, by: list[str]) -> DataFrame:
    """A left join by a key that may be hot in df, with few, which has a row a key: each part of a key's rows meets a copy of that row."""
    salts = F.array(*map(F.lit, range(SALTS)))
    return df.withColumn("_salt", F.pmod(row, F.lit(SALTS)).cast("int")).join(few.withColumn("_salt", F.explode(salts)), [*by, "_salt"], "left").drop("_salt")
