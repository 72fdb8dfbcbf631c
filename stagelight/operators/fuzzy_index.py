"""Prefix and fuzzy search of a few stated queries over fields of documents, ranked by BM25+.

The vocabulary is indexed, not the documents: for prefixes each distinct word stands under its beginnings, and for spelling
under what is left when up to DELETED letters are left out. A word within that many edits of a term has such a rest in
common with it, so terms find their words by equality, and no word is compared that shares none. Longer terms may differ by
more edits: of as many pieces as edits and one more, one is untouched, so they meet words by equal pieces near their place.
What meets is verified by its edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelight.operators.search import terms

#: Letters left out of the words of the index, and edits at most.
DELETED, MOST = 3, 6
#: Weights of prefix and fuzzy hits, the part of a term's length that may differ, and the constants of BM25+.
PREFIX_WEIGHT, FUZZY_WEIGHT, TOLERANCE = 0.375, 0.45, 0.3
K, B, D = 1.2, 0.7, 0.5


def queries_of(spark: SparkSession, queries: list[str]) -> DataFrame:
    """query, k, term: the terms of a few stated queries."""
    return spark.createDataFrame([(q,) for q in queries], "query string").select("query", F.posexplode(terms(F.col("query"))).alias("k", "term"))


def field_words(docs: DataFrame, kind: str, key: str, boosts: dict[str, int]) -> DataFrame:
    """kind, id, field, boost, word: a row per word of each field; a field without words has none."""
    fields = F.array(*(F.struct(F.lit(c).alias("field"), F.lit(b).alias("boost"), terms(F.col(c)).alias("words")) for c, b in boosts.items()))
    flat = docs.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.explode(fields).alias("f"))
    return flat.select("kind", "id", "f.field", "f.boost", F.explode("f.words").alias("word"))


def allowed(term: Column) -> Column:
    """The edits by which a word may differ from a term."""
    return F.least(F.lit(MOST), F.round(TOLERANCE * F.length(term)).cast("int"))


def rests(word: Column, most: int = DELETED) -> Column:
    """What is left of a word without up to `most` letters, the word itself among it."""
    out, last = F.array(word), F.array(word)
    for _ in range(most):
        shorter = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
        last = F.array_distinct(F.flatten(F.transform(F.filter(last, lambda x: F.length(x) > 0), shorter)))
        out = F.concat(out, last)
    return F.array_distinct(out)


def edits_needed(length: Column) -> Column:
    """The most edits by which any term may differ from a word of this length, as far as the index goes."""
    longest = F.aggregate(F.sequence(F.lit(0), F.lit(MOST)), F.lit(0), lambda s, d: F.when(F.least(F.lit(MOST), F.round(TOLERANCE * (length + d))) >= d, F.greatest(s, d)).otherwise(s))
    return F.least(F.lit(DELETED), longest)


def deletion_index(vocabulary: DataFrame) -> DataFrame:
    """rest, word: each distinct word under all its rests, of as many letters left out as a term of any length may need."""
    sized = vocabulary.withColumn("_d", edits_needed(F.length("word")))
    each = [sized.where(F.col("_d") == d).select("word", F.explode(rests(F.col("word"), d)).alias("rest")) for d in range(1, DELETED + 1)]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out.select("rest", "word")


def near_words(vocabulary: DataFrame, asked: DataFrame) -> DataFrame:
    """term, word, edits: the words of the vocabulary that each term may stand for by its spelling."""
    sized = asked.select("term").distinct().withColumn("d", allowed(F.col("term")))
    short = sized.where(f"d between 1 and {DELETED}")
    shortened = [short.where(F.col("d") == d).select("term", "d", F.explode(rests(F.col("term"), d)).alias("rest")) for d in range(1, DELETED + 1)]
    met = deletion_index(vocabulary).join(shortened[0].unionByName(shortened[1]).unionByName(shortened[2]), "rest").select("term", "word", "d")
    # Terms that may differ by more edits than the index has letters left out.
    long_ = sized.where(f"d > {DELETED}").withColumn("n", F.length("term"))
    size = F.floor(F.col("n") / (F.col("d") + 1)).cast("int")
    pieces = long_.withColumn("p", F.explode(F.transform(F.sequence(F.lit(0), F.col("d")), lambda k: F.struct((k * size + 1).alias("at"), F.substring("term", k * size + 1, size).alias("piece")))))
    pieces = pieces.select("term", "d", "n", "p.*", F.length("p.piece").alias("len"))
    # Pieces have two or three letters at most lengths: words stand under all their parts of such a length.
    lengths = pieces.select("len").distinct()
    parts = vocabulary.join(lengths, F.length("word") >= F.col("len")).select("word", "len", F.explode(F.sequence(F.lit(1), F.length("word") - F.col("len") + 1)).alias("s"))
    parts = parts.select("word", F.col("s"), F.expr("substr(word, s, len)").alias("piece"))
    far = parts.join(pieces, "piece").where((F.abs(F.col("s") - F.col("at")) <= F.col("d")) & (F.abs(F.length("word") - F.col("n")) <= F.col("d"))).select("term", "word", "d")
    return met.unionByName(far).distinct().withColumn("edits", F.levenshtein("term", "word")).where("edits <= d").select("term", "word", "edits")


def derived(vocabulary: DataFrame, queries: DataFrame) -> DataFrame:
    """query, k, word, weight: the words that each term stands for: itself, those that begin with it, and those spelled nearly so."""
    asked = queries.select("term").distinct()
    begins = vocabulary.select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(F.col("word"), F.lit(1), i))).alias("term")).join(asked, "term")
    n = F.length("word")
    prefix = begins.select("term", "word", F.when(F.col("word") == F.col("term"), 1.0).otherwise(PREFIX_WEIGHT * n / (n + 0.3 * (n - F.length("term")))).alias("weight"))
    spelled = near_words(vocabulary, queries).where("edits > 0 and not startswith(word, term)").select("term", "word", (FUZZY_WEIGHT * n / (n + F.col("edits"))).alias("weight"))
    return queries.join(prefix.unionByName(spelled), "term").select("query", "k", "word", "weight")


def ranked_hits(words: DataFrame, sizes: DataFrame, queries: DataFrame) -> DataFrame:
    """query, kind, id, score of the documents that any term finds; documents are counted by kind (kind, documents), lengths and frequencies by kind and field."""
    counted = words.groupBy("kind", "id", "field", "boost", "word").agg(F.count("*").alias("tf"))
    lengths = counted.groupBy("kind", "id", "field").agg(F.sum("tf").alias("length"))
    means = lengths.groupBy("kind", "field").agg(F.sum("length").alias("total")).join(sizes, "kind").select("kind", "field", "documents", (F.col("total") / F.col("documents")).alias("mean"))
    met = counted.join(derived(words.select("word").distinct(), queries), "word")
    held = counted.join(met.select("word").distinct(), "word").groupBy("kind", "field", "word").agg(F.count("*").alias("df"))
    hit = met.join(held, ["kind", "field", "word"]).join(lengths, ["kind", "id", "field"]).join(means, ["kind", "field"])
    rare = F.log(1 + (F.col("documents") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    often = D + F.col("tf") * (K + 1) / (F.col("tf") + K * (1 - B + B * F.col("length") / F.col("mean")))
    return hit.groupBy("query", "kind", "id").agg((F.sum(F.col("weight") * F.col("boost") * rare * often) * F.count_distinct("k")).alias("score"))
