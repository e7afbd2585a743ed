"""Toxicity: boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from auditlake.llm.common import free_name, slices, small_batches
from auditlake.session import materialize

#: Labelled documents that are learned from at most, and those of them the trees and the calibration are fitted on.
LEARNED, SAMPLE = 100_000, 20_000
#: Entries of the learned lexicon at most.
LEXICON = 600
STEMS = (4, 5)
NEAR = 5
SPAN = 50
SECOND_PERSON = frozenset("you your yours yourself ya u tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie ti tú tus usted ustedes "
                          "vosotros".split())
PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»„“”‘’…¡¿"
LEET = str.maketrans("013457@$!|", "oieastasil")
MIXED = re.compile(r"[^\W\d_][\d@$!|*#%&_.-]+[^\W\d_]|(.)\1\1")
REPEATED = re.compile(r"[!?.*#]{2,}")
FEATURES = ("lexicon_density", "lexicon_weight", "lexicon_hits", "densest_span", "near_second_person", "second_person", "capitals", "capital_words",
            "exclamations", "punctuation", "repeated_punctuation", "obfuscation", "obfuscated_hits", "length")


def tokens(word: str) -> list[str]:
    """Lexicon keys of a lower-cased word without punctuation around it: itself, and its stems."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def _tally(rows: DataFrame) -> DataFrame:
    """(token, toxic, clean): documents of each label that hold a token; added up per slice before anything is sent."""
    def run(batches):
        for part in slices(batches, "text"):
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                held = set()
                for word in set((text or "").lower().split()):
                    held.update(tokens(word.strip(PUNCTUATION)))
                for token in held:
                    counts.setdefault(token, [0, 0])[0 if toxic else 1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))],
                                             names=["token", "toxic", "clean"])

    return small_batches(rows).mapInArrow(run, "token string, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(rows: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """Tokens that mark toxic documents, with their smoothed log odds: at most ``size``, by significance, then by name.

    A token counts if its log odds are at least 2 and 3 standard errors from 0, over all learning rows.
    """
    toxic, clean = rows.agg(F.count(F.when(F.col("toxic") == 1, 1)), F.count(F.when(F.col("toxic") == 0, 1))).first()
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (toxic + 1.0)) - F.log(b / (clean + 1.0))
    scored = _tally(rows).where("toxic >= 3").select("token", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z"))
    best = scored.where("odds >= 2 AND z >= 3 AND token <> ''").orderBy(F.desc("z"), "token").limit(size)
    return {r.token: r.odds for r in best.collect()}


class _Words(dict):
    """Facts of raw words: (lexicon weight, second person, capitals only, obfuscated, weight once read through)."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def _weight(self, word: str) -> float:
        return max((self.lexicon.get(t, 0.0) for t in tokens(word)), default=0.0)

    def __missing__(self, raw: str):
        if len(self) > 100_000:
            self.clear()
        bare = raw.strip(PUNCTUATION)
        word = bare.lower()
        weight = self._weight(word)
        odd = bool(MIXED.search(bare))
        through = 0.0
        if odd and not weight:
            plain = word.translate(LEET)
            through = max(self._weight(re.sub(r"[\W\d_]", "", plain)), self._weight(re.sub(r"(.)\1+", r"\1", plain)))
        facts = self[raw] = (weight, word in SECOND_PERSON, len(bare) > 1 and bare.isupper(), odd, through)
        return facts


def features(text: str | None, words: _Words) -> list[float]:
    text = text or ""
    facts = [words[w] for w in text.split()]
    n, length = max(1, len(facts)), max(1, len(text))
    hits = [i for i, f in enumerate(facts) if f[0] or f[4]]
    persons = np.array([i for i, f in enumerate(facts) if f[1]])
    near = densest = 0
    if hits:
        at = np.array(hits)
        densest = int((np.searchsorted(at, at + SPAN) - np.arange(len(at))).max())
        if len(persons):
            k = np.searchsorted(persons, at)
            gap = np.minimum(np.abs(at - persons[np.minimum(k, len(persons) - 1)]), np.abs(at - persons[np.maximum(k - 1, 0)]))
            near = int((gap <= NEAR).sum())
    capitals = sum(map(str.isupper, text)) if not text.islower() else 0
    marks = sum(text.count(c) for c in "!?")
    return [len(hits) / n, sum(max(f[0], f[4]) for f in facts) / n, float(np.log1p(len(hits))), float(densest), near / max(1, len(hits)), len(persons) / n,
            capitals / length, sum(f[2] for f in facts) / n, marks / length, sum(map(text.count, PUNCTUATION)) / length,
            len(REPEATED.findall(text)) / n, sum(f[3] for f in facts) / n, sum(1 for f in facts if f[4]) / n, float(np.log1p(n))]


def with_features(docs: DataFrame, lexicon: dict[str, float], name: str) -> DataFrame:
    """``docs`` and column ``name``, an array of FEATURES of the text alone. The lexicon is bounded by LEXICON."""
    def run(batches):
        words = _Words(lexicon)
        for part in slices(batches, "text"):
            rows = [features(t, words) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.list_(pa.float64()))], names=[*part.schema.names, name])

    return small_batches(docs).mapInArrow(run, StructType([*docs.schema.fields, StructField(name, ArrayType(DoubleType()))]))


def held_out() -> Column:
    """Whether a row's label must not be learned from: crc32 of the doc_id as text, modulo 5, is 0 (null counts as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def learning_labels(labels: DataFrame, most: int = LEARNED, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic, fit) of at most ``most`` labelled documents that are not held out; ``fit`` marks ``sample`` of them.

    Of several labels of a document the largest counts. Documents are taken in the order of a hash of their ids, so the
    choice does not depend on how the table lies.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id", F.lit(9)), F.col("doc_id")]
    some = known.where(~held_out()).orderBy(*order).limit(most)
    return some.withColumn("fit", F.row_number().over(Window.orderBy(*order)) <= sample)


def learning_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, text, toxic, fit) of the documents in ``chosen``. At most LEARNED rows are broadcast, so no text is sent."""
    return docs.select("doc_id", "text").where(~held_out()).join(F.broadcast(chosen), "doc_id")


def score_toxicity(docs: DataFrame, labels: DataFrame, score: str = "score", learned: int = LEARNED, sample: int = SAMPLE) -> DataFrame:
    """``docs`` and column ``score``: the calibrated probability, 0 to 1, that a text is toxic. Nothing but the text is used.

    At most ``learned`` labelled documents are learned from: a lexicon with log odds from all of them, boosted trees over the
    dense features from three quarters of at most ``sample``, and the isotonic calibration from the other quarter. If the
    parts do not hold both labels, every text gets the share of toxic labels (0 without any). Null and empty texts have features like any other. Repeated rows get equal scores. An empty table
    gives no rows; other columns are unchanged, whatever their names.
    """
    rows = learning_rows(docs, materialize(learning_labels(labels, learned, sample), "learning-labels"))
    lexicon = learn_lexicon(rows)
    few = materialize(with_features(rows.where("fit").select("doc_id", "text", "toxic"), lexicon, "row").select(
        F.col("toxic").cast("double").alias("label"), "row", (F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(4)) == 0).alias("calibrate")), "features")
    few = few.coalesce(4).withColumn("vector", array_to_vector("row"))
    seen = {(r.calibrate, r.label): r["count"] for r in few.groupBy("calibrate", "label").count().collect()}
    name, raw, vector, probability = (free_name(docs, x) for x in ("features", "raw", "vector", "probability"))
    if not all(seen.get((part, label)) for part in (False, True) for label in (0.0, 1.0)):
        total = sum(seen.values())
        share = sum(n for (_, label), n in seen.items() if label == 1.0) / total if total else 0.0
        return docs.withColumn(score, F.lit(share))
    trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.2, seed=5, minInstancesPerNode=2).fit(few.where("NOT calibrate"))
    chance = vector_to_array(F.col("probability"))[1]
    isotonic = IsotonicRegression(featuresCol="chance", labelCol="label").fit(trees.transform(few.where("calibrate")).select("label", chance.alias("chance")))
    trees.setFeaturesCol(vector).setProbabilityCol(probability).setRawPredictionCol(raw).setPredictionCol("")
    isotonic.setFeaturesCol("chance").setPredictionCol(score)
    scored = with_features(docs, lexicon, name).withColumn(vector, array_to_vector(name))
    scored = trees.transform(scored)
    inner, out = free_name(docs, "chance"), free_name(docs, "calibrated")
    isotonic.setFeaturesCol(inner).setPredictionCol(out)
    scored = isotonic.transform(scored.withColumn(inner, vector_to_array(F.col(probability))[1]))
    return scored.select(*docs.columns, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(out))).alias(score))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score at or above ``threshold``."""
    score = free_name(docs, "score")
    return score_toxicity(docs, labels, score).where(F.col(score) < threshold).select(*docs.columns)
