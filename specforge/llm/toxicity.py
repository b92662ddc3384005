"""Toxicity by gradient-boosted trees over dense features of a text, with isotonic calibration.

The lexicon is learned: words and word openings (as written, and with look-alike digits and signs read as letters) that
stand in far more toxic than clean training documents, by the log-likelihood ratio. Each training document is described
with a lexicon learned from the other fold, so that the trees see how the lexicon does on texts it was not drawn from;
other documents are described with the lexicon of both folds. Features: lexicon density and weight, distinct hits,
hits near a second-person word, capitals, punctuation and obfuscation rates, length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, settle, small_batches, text_of

#: Labelled rows the classifier is fitted on at most, those with the smallest hash of their id.
MAX_TRAIN_ROWS = 20_000
#: Entries of a lexicon at most, those with the largest log-likelihood ratio, and the least ratio.
LEXICON_SIZE, LEAST_G2 = 4000, 12.0
#: Lengths of the word openings that can enter the lexicon.
OPENINGS = (4, 5, 6, 7)
#: Words between a lexicon word and a second-person word at most.
NEAR = 3
#: Words a Python worker remembers.
REMEMBERED = 100_000
#: Documents are rejected from this score on.
REJECT = 0.5
# Second-person words of the languages at hand.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner euch euer ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
# Signs that stand for letters in obfuscated words.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""}
FEATURES = ["density", "weight", "heaviest", "distinct_share", "hits", "near_you", "capitals", "punctuation", "obfuscated", "log_words"]

_PLAIN = str.maketrans(LOOKALIKES)
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def word_form(word: str) -> tuple[str, bool]:
    """The word without edge punctuation, in lower case and read through look-alikes; whether that reading changed it
    inside."""
    core = word.strip(_EDGE).lower()
    if core.isalpha():
        return core, False
    plain = core.translate(_PLAIN)
    return plain, plain != core and any(c.isalpha() for c in core)


def units(word: str) -> list[str]:
    """What a word can match in a lexicon: itself, and its openings (marked)."""
    return [word, *(word[:k] + "^" for k in OPENINGS if len(word) > k)] if len(word) >= 3 else []


class _Words(dict):
    """Word -> lexicon weight in thousandths, shifted over two flags: second person, obfuscated."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        form, hidden = word_form(word)
        weight = max((self.lexicon.get(u, 0.0) for u in units(form)), default=0.0)
        code = int(weight * 1000) << 2 | (form in SECOND_PERSON) << 1 | hidden
        if len(word) <= 40:
            self[word] = code
        return code


_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[33, 63, 35, 36, 37, 38, 42, 64]] = True  # ! ? # $ % & * @


def describe(text: str, words: _Words) -> list[float]:
    """The features of one text; an empty one has zeros."""
    split = text.split()
    if not split:
        return [0.0] * len(FEATURES)
    codes = np.fromiter(map(words.__getitem__, split), np.int64, len(split))
    weights = (codes >> 2) / 1000.0
    hits = np.flatnonzero(weights)
    you = np.flatnonzero(codes & 2)
    near = 0
    if len(hits) and len(you):
        at = np.searchsorted(you, hits)
        gap = np.minimum(np.abs(hits - you[np.minimum(at, len(you) - 1)]), np.abs(hits - you[np.maximum(at - 1, 0)]))
        near = int((gap <= NEAR).sum())
    content = np.frombuffer(text.encode(), np.uint8)
    letters = max(1, int(_LETTER[content].sum()))
    n = len(split)
    return [
        len(hits) / n,
        float(weights.sum()) / n,
        float(weights.max()),
        len({split[i] for i in hits}) / math.sqrt(n),
        float(len(hits)),
        near / n,
        int(_UPPER[content].sum()) / letters,
        int(_PUNCTUATION[content].sum()) / len(content),
        int((codes & 1).sum()) / n,
        math.log(n),
    ]


def features(docs: DataFrame, lexicons: dict[int, dict[str, float]], keep: list[str]) -> DataFrame:
    """The columns `keep` and the features of every row (text, lexicon: which of the lexicons to use)."""
    names = [*keep, *FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {k: _Words(v) for k, v in lexicons.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = np.array(
                    [describe(t, words[k]) for t, k in zip(part.column("text").to_pylist(), part.column("lexicon").to_pylist(), strict=True)]
                )
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), *(pa.array(x) for x in found.T)], names=names
                )

    small_batches(docs.sparkSession)
    rows = docs.select(*keep, "text", "lexicon")
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema]
    return rows.mapInArrow(run, ", ".join([*kept, *(f"{c} double" for c in FEATURES)]))


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """unit, fold and label of each document's distinct units, summed over each batch."""
    for batch in batches:
        counts: dict[tuple[str, int], list[int]] = {}
        for text, fold, toxic in zip(batch["text"], batch["fold"], batch["toxic"], strict=True):
            for u in {u for w in set(text.split()) for u in units(word_form(w)[0])}:
                c = counts.setdefault((u, fold), [0, 0])
                c[toxic] += 1
        yield pd.DataFrame(
            [(u, fold, *c) for (u, fold), c in counts.items()], columns=["unit", "fold", "clean", "toxic"]
        )


def _lexicon(counts: DataFrame, clean: int, toxic: int) -> dict[str, float]:
    """unit -> log odds, of the units that stand in toxic documents more often than by chance; counts: unit, clean, toxic."""
    if not clean or not toxic:
        return {}
    n = clean + toxic
    k = F.col("clean") + F.col("toxic")
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    cell = [
        term(F.col("toxic"), k * toxic / n),
        term(F.col("clean"), k * clean / n),
        term(toxic - F.col("toxic"), (n - k) * toxic / n),
        term(clean - F.col("clean"), (n - k) * clean / n),
    ]
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    best = (
        counts.select("unit", odds.alias("odds"), (2 * sum(cell[1:], cell[0])).alias("g2"))
        .filter((F.col("odds") > math.log(3)) & (F.col("g2") >= LEAST_G2))
        .orderBy(F.desc("g2"), "unit")
        .limit(LEXICON_SIZE)
    )
    return {r["unit"]: r["odds"] for r in best.collect()}


class Model:
    """A fitted classifier: lexicon, trees and calibration; or a constant where the labels hold one class only."""

    def __init__(self, lexicon: dict[str, float], trees=None, calibration=None, constant: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def score(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """The columns `keep` (read from docs, which has `text`) and score, one row for each input row."""
        rows = docs.withColumn("text", text_of()).withColumn("lexicon", F.lit(-1))
        if self.trees is None:
            return rows.select(*keep, F.lit(self.constant).alias("score"))
        found = self.trees.transform(_assembled(features(rows, {-1: self.lexicon}, keep)))
        found = self.calibration.transform(found.withColumn("margin", vector_to_array("probability")[1]))
        return found.select(*keep, F.least(F.greatest("prediction_score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)


def fit(docs: DataFrame, labels: DataFrame, iterations: int = 20, depth: int = 3, seed: int = 7) -> Model:
    """Fit on the labelled documents of `labels` (doc_id, toxic), at most MAX_TRAIN_ROWS of them.

    Rows with a null id or label are left out; of several labels of an id the largest counts, and of several texts of
    an id each is a row. Without both classes in every fold the model is a constant, the mean label (0 without labels).
    """
    labelled = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .dropna()
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MAX_TRAIN_ROWS)
    )
    rows = settle(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
        .join(F.broadcast(labelled), "doc_id")
        .withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2)).cast("int"))
        .repartition(docs.sparkSession.sparkContext.defaultParallelism)
    )
    sizes = {(r["fold"], r["toxic"]): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any((fold, toxic) not in sizes for fold in (0, 1) for toxic in (0, 1)):
        n = sum(sizes.values())
        return Model({}, constant=sum(v for (_, toxic), v in sizes.items() if toxic) / n if n else 0.0)
    counts = rows.select("text", "fold", "toxic").mapInPandas(_units, "unit string, fold int, clean long, toxic long")
    side = lambda fold, c: F.sum(F.when(F.col("fold") == fold, F.col(c)).otherwise(0)).alias(f"{c}{fold}")
    counts = settle(counts.groupBy("unit").agg(*(side(fold, c) for fold in (0, 1) for c in ("clean", "toxic"))).filter("toxic0 + toxic1 > 1"))
    lexicons = {}
    for use, folds in ((0, (1,)), (1, (0,)), (-1, (0, 1))):
        summed = counts.select("unit", *(sum((F.col(f"{c}{f}") for f in folds[1:]), F.col(f"{c}{folds[0]}")).alias(c) for c in ("clean", "toxic")))
        lexicons[use] = _lexicon(summed, *(sum(sizes[f, t] for f in folds) for t in (0, 1)))
    found = settle(features(rows.withColumn("lexicon", F.col("fold")), lexicons, ["doc_id", "toxic"]))
    calibrating = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(4)) == 0
    train = _assembled(found).withColumn("label", F.col("toxic").cast("double"))
    part = train.filter(~calibrating)
    if part.select("label").distinct().count() < 2 or train.filter(calibrating).select("label").distinct().count() < 2:
        part, calibrating = train, F.lit(True)
    trees = GBTClassifier(maxIter=iterations, maxDepth=depth, stepSize=0.3, seed=seed, maxBins=64, subsamplingRate=1.0).fit(part.select("features", "label"))
    margins = trees.transform(train.filter(calibrating)).select(vector_to_array("probability")[1].alias("margin"), "label")
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="prediction_score").fit(margins)
    return Model(lexicons[-1], trees, calibration)


def held_out(column: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def clean_only(docs: DataFrame, labels: DataFrame, known: DataFrame) -> DataFrame:
    """The documents whose score is below REJECT, with their columns; fitted on `known`, the labelled corpus."""
    model = fit(known, labels.filter(~held_out()))
    kept = list(docs.columns)
    renamed = docs.toDF(*(f"_{i}" for i in range(len(kept)))).withColumn("text", F.col(f"_{kept.index('text')}"))
    scored = model.score(renamed, renamed.columns[:-1])
    return scored.filter(F.col("score") < REJECT).drop("score").toDF(*kept)


def op6_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out()))
    scored = model.score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted")
    )
