"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: how densely it uses words of an insult lexicon, how near such words are to the second person, how much
of it is capitals, punctuation and signs, and how many words are obfuscated (digits or signs for letters, drawn-out letters,
spaced-out letters), above all those that spell a listed word once undone. The lexicon is the fixed list below joined by
words that the training labels single out.

Labels are used only of rows whose crc32(doc_id as text) mod 5 is not 0, and of those SAMPLE at most, about, picked by a hash
of doc_id: one quarter calibrates, the rest grows the trees. Every document is scored from its whole text alone; lang,
source, doc_id and labels are never inputs. Without labels of both classes no trees are grown, and the score rises with the
number of lexicon words.

Null and empty texts have features of 0 and a score like any other. Repeated rows score alike. Of labels repeated for a
doc_id the larger counts. Very long texts take time in proportion to their length, whatever they are made of. Other columns pass
by untouched, whatever their names. No text is shuffled but those of the sample.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, fenced, shield, text_of

FOLDS = 5
#: Labelled rows that the classifier is fitted on, at most, about.
SAMPLE = 20_000
#: A learned word is that many times likelier in a toxic text than in another, in LEAST_SHARE of the toxic texts (3 at least), and after LEAST_COMPANY different words: copies of one text do not make one.
LEAST_RATIO, LEAST_SHARE, LEAST_COMPANY, MOST_WORDS = 20.0, 0.01, 6, 400
#: Letters of a stem; words are learned by themselves and, under a star, by stem.
STEM = 5
#: Common insults of four languages, and words of the second person.
INSULTS = """
idiot idiots moron morons stupid dumb scum trash garbage loser losers clown clowns pathetic worthless disgusting vermin
imbecile jerk bastard bitch asshole fuck fucking shit crap whore slut retard retarded freak filth filthy hate kill
dumm blöd trottel arschloch scheiße abschaum wertlos erbärmlich ekelhaft verlierer müll
imbécile connard connasse salaud merde ordure débile minable dégoûtant
estúpido idiota imbécil basura escoria inútil patético asqueroso perdedor mierda puta
""".split()
SECOND_PERSON = "you your yours yourself youre u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros vuestro tus".split()
#: Signs that stand for letters.
SIGNS = dict(zip("0134578@$!+", "oieastbasit", strict=True))

NEAR = 5  # words
FEATURES = ["hits", "density", "near_you", "near_rate", "disguised", "disguised_rate", "you_rate", "capital_rate", "shout_rate", "punctuation_rate", "mark_rate", "sign_rate", "mixed_rate", "drawn_rate", "spaced_rate", "log_words", "distinct_rate", "word_chars"]

TOKEN = re.compile(r"[^\W_]+")
#: Letters with digits or signs between them or before them. Runs are taken whole and never given back, so a text is read once.
MIXED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0-9@$!+*.-]++[^\W\d_]++)++|(?<![0-9@$])[0-9@$]++[^\W\d_]++")
SPACED = re.compile(r"(?<!\w)(?:[^\W_][ .*-]){3,}[^\W_](?!\w)")
SHOUT = re.compile(r"(?<!\w)[A-ZÀ-Þ]{3,}(?!\w)")
OTHER, SMALL, CAPITAL, DIGIT, PUNCTUATION, MARK, SIGN = range(7)


def _classes() -> np.ndarray:
    """The class of each code point below 0x3000; the last entry stands for all beyond."""
    kinds = {"Lu": CAPITAL, "Lt": CAPITAL, "L": SMALL, "N": DIGIT, "P": PUNCTUATION}
    out = np.zeros(0x3001, dtype=np.uint8)
    for c in range(0x3000):
        kind = unicodedata.category(chr(c))
        out[c] = kinds.get(kind, kinds.get(kind[0], OTHER))
    out[[ord(c) for c in "!?"]] = MARK
    out[[ord(c) for c in "#*$%&|<>@"]] = SIGN
    out[0x3000] = SMALL
    return out


CLASSES = _classes()


def _plain(word: str) -> str:
    """A word with signs turned into letters, other signs dropped, and drawn-out letters cut to one."""
    return re.sub(r"(.)\1\1+", r"\1", re.sub(r"[\W\d_]", "", "".join(SIGNS.get(c, c) for c in word)))


def measure(text: str, lexicon: frozenset[str], persons: frozenset[str], stems: frozenset[str] = frozenset()) -> list[float]:
    """The values of FEATURES."""
    low = text.lower()
    tokens = TOKEN.findall(low)
    n = max(1, len(tokens))
    at = [i for i, t in enumerate(tokens) if t in lexicon or t[:STEM] in stems]
    near = sum(1 for i in at if not persons.isdisjoint(tokens[max(0, i - NEAR) : i + NEAR + 1]))
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = CLASSES[np.minimum(code, 0x3000)]
    count = np.bincount(kinds, minlength=7)
    letters = max(1, int(count[SMALL] + count[CAPITAL]))
    mixed = MIXED.findall(low) if count[DIGIT] or count[SIGN] or count[MARK] or "+" in low else []
    drawn = []
    if len(code) > 2:
        thrice = np.flatnonzero((code[:-2] == code[1:-1]) & (code[1:-1] == code[2:]) & ((kinds[2:] == SMALL) | (kinds[2:] == CAPITAL)))
        if len(thrice):
            spans = np.array([m.span() for m in TOKEN.finditer(text)] + [(len(text), len(text))])
            over = np.unique(np.searchsorted(spans[:-1, 1], thrice, side="right"))
            inside = np.searchsorted(thrice, spans[over, 1]) > np.searchsorted(thrice, spans[over, 0])  # some signs beyond the table are no letters
            drawn = [text[a:b].lower() for a, b in spans[over[inside]]]
    singles = sum(map((1).__eq__, map(len, tokens)))
    spaced = SPACED.findall(low) if singles >= 4 else []
    disguised = sum(_plain(w) in lexicon for w in (*mixed, *spaced, *drawn))
    shouts = len(SHOUT.findall(text)) if count[CAPITAL] > 2 else 0
    return [
        min(len(at), 20), len(at) / n, min(near, 20), near / n, min(disguised, 20), disguised / n,
        sum(map(persons.__contains__, tokens)) / n, count[CAPITAL] / letters, shouts / n, count[PUNCTUATION] / n, count[MARK] / n, count[SIGN] / n,
        len(mixed) / n, len(drawn) / n, singles / n, float(np.log1p(len(tokens))), len(set(tokens)) / n, sum(map(len, tokens)) / n,
    ]


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0


def features(docs: DataFrame, lexicon: list[str]) -> DataFrame:
    """docs with a column for each of FEATURES."""
    listed, persons = frozenset(INSULTS) | {w for w in lexicon if w[-1] != "*"}, frozenset(SECOND_PERSON)
    stems = frozenset(w[:-1] for w in lexicon if w[-1] == "*")

    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            # One text at a time: the batch itself stays in Arrow's buffer.
            rows = np.array([measure(t.as_py() or "", listed, persons, stems) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.StructArray.from_arrays([pa.array(c) for c in rows.T], names=FEATURES)

    measured_udf = F.arrow_udf(measured, ", ".join(f"{f} double" for f in FEATURES))
    return docs.withColumn("_features", measured_udf(text_of())).select(*docs.columns, "_features.*")


def sample_of(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text and toxic of labelled rows outside the held-out fold; about `sample` at most."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = durable(marked.select(F.col("doc_id").alias("_id"), "toxic"), "marked")
    share = min(1.0, sample / max(1, marked.count()))
    picked = marked.where(F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(1_000_000)) < round(share * 1_000_000))
    # The broadcast side has about `sample` rows at most.
    return docs.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("doc_id", text_of().alias("text"), "toxic")


def learned_words(labelled: DataFrame) -> list[str]:
    """Words that mark toxic texts, and stems with a star: few, and bounded by MOST_WORDS."""
    n = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return []
    df = fenced(labelled.select("toxic", "text"), words=F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    pairs = F.transform("words", lambda w, i: F.struct(w.alias("word"), F.when(i > 0, F.get("words", i - 1)).alias("before")))
    toxic = fenced(df.where("toxic = 1"), pairs=pairs).select(F.explode("pairs").alias("p")).select("p.*").where("length(word) > 2")
    stem = F.concat(F.left("word", F.lit(STEM)), F.lit("*"))
    toxic = toxic.unionByName(toxic.where(F.length("word") > STEM).select(stem.alias("word"), "before"))
    df = df.withColumn("words", F.concat("words", F.transform(F.filter("words", lambda w: F.length(w) >= STEM), lambda w: F.concat(F.left(w, F.lit(STEM)), F.lit("*")))))
    company = toxic.groupBy("word").agg(F.approx_count_distinct("before").alias("company")).where(f"company >= {LEAST_COMPANY}")
    seen = df.select("toxic", F.explode(F.array_distinct("words")).alias("word"))
    counts = seen.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    ratio = (F.col("bad") / n[1]) / ((F.col("good") + 0.5) / n[0])
    found = counts.where((F.col("bad") >= max(3, n[1] * LEAST_SHARE)) & (ratio >= LEAST_RATIO)).join(company, "word", "left_semi")
    return sorted(r["word"] for r in found.orderBy(F.desc("bad"), "word").limit(MOST_WORDS).collect())


class Scorer:
    """Trees, calibration and lexicon, fitted on labelled rows (doc_id, text, toxic)."""

    def __init__(self, labelled: DataFrame, trees: int = 20, depth: int = 4):
        part = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(4))
        fit = durable(labelled.select("doc_id", "text", "toxic", part.alias("_part")), "labelled")
        self.lexicon = learned_words(fit.where("_part <> 0"))
        self.model = self.calibration = None
        rows = self._vectors(features(fit, self.lexicon)).select("doc_id", "_part", F.col("toxic").cast("double").alias("label"), "vector")
        rows = durable(rows.repartition(4, "doc_id").sortWithinPartitions("doc_id"), "features")
        grow = rows.where("_part <> 0")
        if grow.select("label").distinct().count() < 2:
            return
        self.model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, minInstancesPerNode=5).fit(grow)
        margins = durable(self._margin(rows.where("_part = 0")).select("label", "margin"), "margins")
        if not margins.isEmpty():
            self.calibration = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="calibrated").fit(margins)

    @staticmethod
    def _vectors(df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(df)

    def _margin(self, df: DataFrame) -> DataFrame:
        """The trees' margin: positive where toxic is likelier."""
        return self.model.transform(df).withColumn("margin", vector_to_array("rawPrediction")[1])

    def score(self, docs: DataFrame) -> DataFrame:
        """docs with score, from the text alone."""
        columns = docs.columns
        df = features(docs, self.lexicon)
        if self.model is None:
            return df.select(*columns, F.least(F.lit(1.0), F.col("hits") / 4).alias("score"))
        df = self._margin(self._vectors(df))
        chance = 1 / (1 + F.exp(-2 * F.col("margin")))
        if self.calibration is None:
            return df.select(*columns, chance.alias("score"))
        # A trace of the margin ranks the scores of one calibrated step.
        return self.calibration.transform(df).select(*columns, (0.98 * F.col("calibrated") + 0.02 * chance).alias("score"))


def without_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The documents that score below the limit, with all their columns."""
    work, restore = shield(docs, "doc_id", "text")
    scorer = Scorer(sample_of(work.select("doc_id", "text"), labels))
    return restore(scorer.score(work).where(F.col("score") < limit))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scorer = Scorer(sample_of(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scorer.score(docs).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
