"""Exact deduplication by progressive refinement: length, then hash of a prefix, then hash of the whole text.

The first scan counts lengths; only texts whose length another has go on. The second hashes their first PREFIX_CHARS characters
and counts (length, prefix hash); only groups of two or more go on. Either time the keys fill a blocked Bloom filter of bounded
size, so the third scan reads and hashes the whole text of surviving groups alone, and no text is shuffled. What the filters let
through by mistake is a group of one after the full hash. Only digests are grouped, with partial aggregation, and a group's rows
are dealt in SALTS parts when they learn of it, so a group that holds a third of all rows meets in no one task.

Null texts count as empty; texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest
doc_id stays; null doc_ids rank lowest, and of rows alike in doc_id too exactly one stays. Very long texts cost their length, in
one row. Other columns pass by untouched, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bloom, durable, probe, salted_join, settled, shield, text_of

PREFIX_CHARS = 64


def _prefix() -> Column:
    return F.xxhash64(ascii_lower(F.substring(text_of(), 1, PREFIX_CHARS)))


def _repeated_lengths(docs: DataFrame) -> tuple[DataFrame, int]:
    """A filter of the lengths that two texts or more have."""
    lengths = docs.groupBy(F.octet_length(text_of()).alias("n_bytes")).agg(F.count("*").alias("n")).where("n > 1")
    lengths = durable(lengths.select("n_bytes"), "lengths")
    return bloom(lengths, F.col("n_bytes"), lengths.count())


def exact_groups(docs: DataFrame, digest_all: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, prefix_hash, digest, keep_id, group_size, kept.

    digest is the binary SHA-256 of the normalised text of surviving groups; with digest_all of every row, for callers that report it.
    """
    text = text_of()
    sized = probe(docs.select("doc_id", "text", F.octet_length(text).alias("n_bytes")), F.col("n_bytes"), _repeated_lengths(docs), "met")
    keyed = sized.select("doc_id", "text", "n_bytes", F.when(F.col("met"), _prefix()).alias("prefix_hash"))
    groups = durable(keyed.where("prefix_hash is not null").groupBy("n_bytes", "prefix_hash").agg(F.count("*").alias("n")).where("n > 1"), "prefixes")
    shared = groups.select("n_bytes", "prefix_hash")
    key = F.xxhash64("n_bytes", "prefix_hash")
    flagged = probe(keyed, key, bloom(shared, key, shared.count()), "survives")
    hashed = F.unhex(F.sha2(ascii_lower(text), 256))
    rows = flagged.select("doc_id", "n_bytes", "prefix_hash", "survives", (hashed if digest_all else F.when(F.col("survives"), hashed)).alias("digest"))
    rows = durable(rows.withColumn("_row", F.monotonically_increasing_id()), "digests")
    by = ["n_bytes", "prefix_hash", "digest"]
    found = rows.where("survives").groupBy(*by).agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "_row")).alias("keep")).where("group_size > 1")
    met = salted_join(rows.where("survives"), F.col("_row"), durable(found, "groups"), by)
    joined = met.unionByName(rows.where("not survives"), allowMissingColumns=True)
    single = F.col("group_size").isNull()
    return joined.select(
        "doc_id", *by,
        F.when(single, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("_row") == F.col("keep._row"))).alias("kept"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    docs, restore = shield(docs, "doc_id", "text")
    judged = exact_groups(docs)
    # Only what goes, or repeats with its id, is looked up; only texts that may be among those are hashed again.
    by = ["doc_id", "n_bytes", "prefix_hash"]
    told = judged.where("group_size > 1").groupBy(*by, "digest").agg(F.max("kept").alias("_kept"), F.count("*").alias("_n")).where("_n > 1 or not _kept")
    told = durable(told.withColumnsRenamed({c: f"_{c}" for c in (*by, "digest")}), "copies")
    tagged = docs.select(*docs.columns, F.octet_length(text_of()).alias("n_bytes"), _prefix().alias("prefix_hash"))
    tagged = probe(tagged, F.xxhash64(*by), bloom(told, F.xxhash64(*(f"_{c}" for c in by)), told.count()), "_may")
    hashed = F.when(F.col("_may"), F.unhex(F.sha2(ascii_lower(text_of()), 256)))
    return restore(settled(tagged.withColumn("hashed", hashed).drop("_may"), told, [*((c, f"_{c}") for c in by), ("hashed", "_digest")]))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest_all=True)
    return judged.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = """
with t as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from t group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from t join g using (text_sha256)
"""
