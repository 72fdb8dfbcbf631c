"""A stored inverted index: posting lists of stems with packed positions, one index an entity, read back by term.

Layout: a row per entity, stem and document, with the places of the stem in it as integers 4 x place + class of its field.
Files are partitioned by entity and by `head`, the stem's first letters, so a lookup lists only the folders of its terms'
ranges; inside them rows are sorted by stem, so a file's row groups that cannot hold a term are not read either. A head with
many postings is dealt over several files by stem and document: no task writes a whole range alone.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelight.functions.stemming import stems_of
from stagelight.operators.search import CLASSES, WEIGHTS, words_of
from stagelight.sources.saved import shared_dir

HEAD = 2  # letters of a stem that name its range


def head(term: Column) -> Column:
    return F.substring(term, 1, HEAD)


@dataclass(frozen=True)
class Entity:
    """What is indexed of one kind: its rows, their key, and the class of each field that is read, in order."""

    rows: DataFrame
    key: str
    fields: dict[str, str]


def postings(name: str, entity: Entity) -> DataFrame:
    """entity, head, term, id, places of one kind. Words are stemmed once for all documents; stop words keep their place but are left out."""
    found = words_of(entity.rows, entity.key, entity.fields)
    packed = found.groupBy("word", F.col(entity.key).cast("string").alias("id")).agg(F.collect_list(4 * F.col("pos") + F.col("class")).alias("places"))
    stemmed = packed.join(stems_of(found), "word").groupBy(F.col("stem").alias("term"), "id").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
    return stemmed.select(F.lit(name).alias("entity"), head(F.col("term")).alias("head"), "term", "id", "places")


class TextIndex:
    """Posting lists in one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def write(spark: SparkSession, entities: dict[str, Entity], path: str) -> TextIndex:
        for name, entity in entities.items():
            rows = postings(name, entity)
            rows.repartitionByRange("head", "term", "id").sortWithinPartitions("head", "term", "id").write.mode("append").partitionBy("entity", "head").parquet(path)
        return TextIndex(spark, path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema("term string, id string, places array<int>, entity string, head string").parquet(self.path)

    def lookup(self, entity: str, terms: list[str]) -> DataFrame:
        """The posting lists of a few stems; other ranges' folders are not listed."""
        heads = sorted({t[:HEAD] for t in terms})
        return self.rows().where((F.col("entity") == entity) & F.col("head").isin(heads) & F.col("term").isin(terms))

    def positions(self, entity: str, key: str, terms: list[str], kind: str = "long", classes: str = CLASSES) -> DataFrame:
        """key, term, pos, weight of each place of the stems, in fields of the given classes."""
        flat = self.lookup(entity, terms).select(F.col("id").cast(kind).alias(key), "term", F.explode("places").alias("p"))
        weight = F.element_at(F.array(*(F.lit(WEIGHTS[c]) for c in CLASSES)), F.col("p") % 4 + 1)
        wanted = [CLASSES.index(c) for c in classes]
        return flat.where((F.col("p") % 4).isin(wanted)).select(key, "term", F.floor(F.col("p") / 4).cast("int").alias("pos"), weight.alias("weight"))

    def weighted(self, entity: str) -> DataFrame:
        """term, id, weight: the summed weights of all places."""
        weights = F.array(*(F.lit(WEIGHTS[c]) for c in CLASSES))
        return self.rows().where(F.col("entity") == entity).select("term", "id", F.aggregate("places", F.lit(0.0), lambda s, p: s + F.element_at(weights, p % 4 + 1)).alias("weight"))


_written: dict[tuple[str, str, int], str] = {}


def state_of(tables: list[DataFrame]) -> int:
    """A number for the files that tables are read from: their names, sizes and times of change."""
    seen = [t.select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("f")).distinct() for t in tables]
    return hash(tuple(s.agg(F.bit_xor("f")).first()[0] for s in seen))


def kept_index(spark: SparkSession, name: str, tables: list[DataFrame], entities: dict[str, Entity]) -> TextIndex:
    """The index of these tables, written once a session and again when their files change."""
    at = (spark.sparkContext.applicationId, name, state_of(tables))
    if at not in _written:
        path = f"{shared_dir(spark)}/index-{name}-{uuid.uuid4().hex}"
        TextIndex.write(spark, entities, path)
        _written[at] = path
    return TextIndex(spark, _written[at])
