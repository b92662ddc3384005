"""Text scores by a class-based bigram model whose classes come from exchange clustering.

Words of at least FREQUENT of the training tokens are clustered; every other word belongs to a class by its ending, so
each word has one. A round of the exchange counts, over all training text, how often every second clustered word stands
before and after each class; from these counts and the class bigrams it moves to the class where the likelihood of the
class bigram model gains most. Rounds end when the likelihood gains little; a round that lowers it is undone. A text's probability is that of its class transitions times its word emissions,
interpolated with add-one unigrams:

    p(w | v) = L * T(class v, class w) * c(w) / n(class w) + (1 - L) * (c(w) + 1) / (N + V + 1)

Frequent words (at most 1 / FREQUENT of them) are looked up where the
text is; each other token is sent with its factor L * T / n to the word's count by a join, and the logarithms are
summed for each text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, documents, settle, small_batches, text_of

#: Least share of the training tokens for a word to be looked up without a join, and to be clustered.
FREQUENT = 2e-6
#: Gain of the likelihood, for each token, below which the exchange ends.
LEAST_GAIN = 1e-4
#: Words whose counts travel together, and groups of tasks whose counts are summed first.
PART, SALTS = 256, 512
#: Classes of clustered words, classes by ending, rounds of the exchange.
CLASSES, ENDINGS, ROUNDS = 64, 16, 4
#: Weight of the class model where no token is unknown, and how fast it falls with the share of unknown ones; pseudo-count
#: by which transitions lean on class frequencies.
CLASS_WEIGHT, UNSEEN_COST, PRIOR = 0.8, 2.3, 20.0
_ALL = CLASSES + ENDINGS + 1
_END = _ALL - 1  # class of the end of a text; the start of the next one sees it too
_STOP = b"\n"  # stands for the end; no word holds a line break


def _ending(word: bytes) -> int:
    return CLASSES + zlib.crc32(word[-2:]) % ENDINGS


class _Lexicon:
    """Frequent words with their counts and classes."""

    def __init__(self, words: list[bytes], counts: np.ndarray, classes: np.ndarray, clustered: int):
        self.ids = {w: i for i, w in enumerate(words)} | {_STOP: len(words)}
        self.counts, self.classes, self.clustered = counts, np.append(classes, _END), clustered

    def read(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of the texts, one after another, each with its stop; their ids (-1: not frequent), classes, and the
        positions of the stops."""
        tokens: list[bytes] = []
        stops = []
        for text in texts:
            tokens += text.encode().lower().split()
            stops.append(len(tokens))
            tokens.append(_STOP)
        ids = np.fromiter(map(self.ids.get, tokens, repeat(-1)), np.int64, len(tokens))
        classes = self.classes[ids]
        rare = np.flatnonzero(ids < 0)
        classes[rare] = [_ending(tokens[i]) for i in rare]
        return tokens, ids, classes, np.array(stops, np.int64)


def _groups(batches: Iterator[pa.RecordBatch], most: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def _before(classes: np.ndarray) -> np.ndarray:
    return np.concatenate(([_END], classes[:-1]))


def _half(clustered: int, turn: int | None) -> int:
    """How many clustered words move in a turn: every second one, none without a turn."""
    return 0 if turn is None else (clustered - turn % 2 + 1) // 2


def _count(lexicon, turn: int | None) -> callable:
    """Of each task: class bigrams (part -1), and for each word that moves in this turn the classes behind and before it
    and how often it follows itself, in parts of PART words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        width = 2 * _ALL + 1
        table = np.zeros((_half(lex.clustered, turn), width), np.int32)
        bigrams = np.zeros(_ALL * _ALL, np.int64)
        for batch in _groups(batches):
            _, ids, classes, _ = lex.read(batch.column("text").to_pylist())
            if not len(ids):
                continue
            before = _before(classes)
            bigrams += np.bincount(before * _ALL + classes, minlength=_ALL * _ALL)
            if turn is None:
                continue
            flat = table.reshape(-1)
            here = np.flatnonzero((ids >= 0) & (ids < lex.clustered) & (ids % 2 == turn % 2))
            rows = ids[here] // 2 * width
            follows = np.concatenate((classes[1:], [_END]))
            same = np.concatenate(([False], ids[1:] == ids[:-1]))
            keys = np.concatenate((rows + follows[here], rows + _ALL + before[here], (rows + 2 * _ALL)[same[here]]))
            key, n = np.unique(keys, return_counts=True)
            flat[key] += n.astype(np.int32)
        out = [(-1, bigrams.tobytes())]
        out += [(k // PART, table[k : k + PART].astype(np.int64).tobytes()) for k in range(0, len(table), PART)]
        part, counts = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(counts, pa.binary())], names=["part", "counts"])

    return run


def _add(key: tuple, groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sum of a group's counts, which are read a batch at a time."""
    total = np.int64(0)
    for rows in groups:
        total = sum((np.frombuffer(x, np.int64) for x in rows["counts"]), total)
    yield pd.DataFrame({"part": [key[0]], "counts": [total.tobytes()]}).astype({"part": "int32"})


def _summed(counted: DataFrame) -> DataFrame:
    """part and counts, summed over tasks in two steps, so that no group holds what all tasks count."""
    salted = counted.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    step = salted.groupBy("part", "salt").applyInPandas(_add, "part int, counts binary")
    return step.groupBy("part").applyInPandas(_add, "part int, counts binary")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def best_class(own: int, behind: np.ndarray, ahead: np.ndarray, itself: int, bigrams: np.ndarray) -> int:
    """The class in which a word (class own, followed by class counts behind, preceded by ahead, itself: how often by
    itself) makes the class bigrams likeliest, given the bigrams with the word in its own class."""
    n = behind.sum()
    rest = bigrams.astype(float)
    rest[own] -= behind
    rest[:, own] -= ahead
    rest[own, own] += itself
    behind, ahead = behind.astype(float), ahead.astype(float)
    behind[own] -= itself
    ahead[own] -= itself
    k = np.arange(CLASSES)
    rows, columns = rest[:CLASSES], rest[:, :CLASSES].T
    gain = (_xlogx(rows + behind) - _xlogx(rows)).sum(1) + (_xlogx(columns + ahead) - _xlogx(columns)).sum(1)
    diagonal = rest[k, k]
    gain -= _xlogx(diagonal + behind[k]) + _xlogx(diagonal + ahead[k]) - _xlogx(diagonal)
    gain += _xlogx(diagonal + behind[k] + ahead[k] + itself)
    totals = rest.sum(1)[:CLASSES]
    return int(np.argmax(gain - 2 * (_xlogx(totals + n) - _xlogx(totals))))


def _move(bigrams: np.ndarray, classes: np.ndarray, turn: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for part, counts in zip(batch["part"], batch["counts"], strict=True):
                for slot, row in enumerate(np.frombuffer(counts, np.int64).reshape(-1, 2 * _ALL + 1), part * PART):
                    i = 2 * slot + turn % 2
                    if row[:_ALL].sum():
                        out.append((i, best_class(int(classes[i]), row[:_ALL], row[_ALL : 2 * _ALL], int(row[-1]), bigrams)))
            yield pd.DataFrame(out, columns=["word", "class"]).astype({"word": "int32", "class": "int32"})

    return run


def likelihood(bigrams: np.ndarray) -> float:
    """What depends on the classes in the log likelihood of the class bigram model, for each token."""
    n = bigrams.astype(float)
    return float((_xlogx(n).sum() - _xlogx(n.sum(0)).sum() - _xlogx(n.sum(1)).sum()) / max(1.0, n.sum()))


class Model:
    """Word counts (a table), frequent words with classes, class bigrams, the likelihood after each turn, and the sizes of
    the training corpus."""

    def __init__(self, counts: DataFrame, lexicon: _Lexicon, bigrams: np.ndarray, gains: list[float], tokens: int, types: int, texts: int, once: int):
        self.counts, self.lexicon, self.bigrams, self.likelihoods = counts, lexicon, bigrams, gains
        self.tokens, self.types, self.texts = tokens, types, texts
        #: Share of new text's tokens that are unknown, by Good and Turing. Each of them pays for the class model's
        #: weight, so that falls with their share.
        self.unseen = once / max(1, tokens)
        self.class_weight = CLASS_WEIGHT * max(0.1, 1 - UNSEEN_COST * self.unseen)


def train(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> Model:
    """Count and cluster the words of all texts; a null text is empty. Without rows the model knows no token."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(text_of(text_col).alias("text"))
    words = texts.select(F.explode(F.split(ascii_lower(F.col("text")), r"[\x20\x09-\x0D]+")).alias("word")).filter("word != ''")
    counts = settle(words.groupBy("word").agg(F.count(F.lit(1)).alias("c")))
    n_texts = texts.count()
    total, types, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("c") == 1)).first()
    tokens, types = total + n_texts, types + (n_texts > 0)
    frequent = counts.filter(F.col("c") >= FREQUENT * tokens).orderBy(F.desc("c"), "word").collect()  # at most 1 / FREQUENT
    seen = np.array([r["c"] for r in frequent], np.int64)
    spelled = [r["word"].encode() for r in frequent]
    clustered = len(spelled)
    classes = np.arange(clustered) % CLASSES
    best, reached = None, []
    for turn in [*range(rounds if clustered else 0), None]:
        lexicon = _Lexicon(spelled, seen, classes, clustered)
        sent = spark.sparkContext.broadcast(lexicon)
        summed = settle(_summed(texts.mapInArrow(_count(sent, turn), "part int, counts binary")))
        bigrams = np.zeros((_ALL, _ALL), np.int64)
        for row in summed.filter("part = -1").collect():  # one row, of fixed size
            bigrams = np.frombuffer(row["counts"], np.int64).reshape(_ALL, _ALL)
        now = likelihood(bigrams)
        if best and now < reached[-1]:  # words that moved together have hindered each other
            lexicon, bigrams = best
            break
        gain = now - reached[-1] if len(reached) > 1 else np.inf
        best, reached = (lexicon, bigrams), [*reached, now]
        if turn is None or gain < LEAST_GAIN:
            break
        # by themselves these few MB would be one task, but each word takes a millisecond
        spread = summed.filter("part >= 0").repartition(spark.sparkContext.defaultParallelism, "part")
        moved = spread.mapInPandas(_move(bigrams, classes, turn), "word int, class int").collect()
        classes = classes.copy()
        for r in moved:  # at most 1 / FREQUENT
            classes[r["word"]] = r["class"]
    return Model(counts, lexicon, bigrams, reached, tokens, types, n_texts, once)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row: token counts and log10 probabilities of the text by
    add-one unigrams and by the model. A null text is empty: one token, its end. Other columns are not read."""
    spark = docs.sparkSession
    weight = model.class_weight
    denominator = float(model.tokens + model.types + 1)
    into = model.bigrams.sum(0)
    transitions = (model.bigrams + PRIOR * into / max(1, into.sum())) / (model.bigrams.sum(1, keepdims=True) + PRIOR)
    factors = weight * transitions / np.maximum(into, 1)
    sent = spark.sparkContext.broadcast((model.lexicon, factors))
    n_texts = model.texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, factor = sent.value
        counts = np.append(lexicon.counts, n_texts)
        for batch in _groups(batches):
            tokens, ids, classes, stops = lexicon.read(batch.column("text").to_pylist())
            starts = np.concatenate(([0], stops[:-1] + 1))
            a = factor[_before(classes), classes]
            c = np.where(ids >= 0, counts[ids], 0)
            met = ids >= 0
            unigram = (c + 1) / denominator
            base = np.where(met, np.log10(unigram), 0.0)
            own = np.where(met, np.log10(a * c + (1 - weight) * unigram), 0.0)
            rare = np.flatnonzero(~met)
            ends = np.concatenate(([0], np.searchsorted(rare, stops))).astype(np.int32)
            listed = lambda values: pa.ListArray.from_arrays(pa.array(ends), values)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("rid"),
                    pa.array(stops - starts + 1),
                    pa.array(np.add.reduceat((met & (c > 0)).astype(np.int64), starts)),
                    pa.array(np.add.reduceat(base, starts)),
                    pa.array(np.add.reduceat(own, starts)),
                    listed(pa.array([tokens[i].decode() for i in rare], pa.string())),
                    listed(pa.array(a[rare].astype(np.float32))),
                ],
                names=["doc_id", "rid", "n_tokens", "n_known", "base", "own", "words", "factors"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), text_of(text_col).alias("text")
    )
    found = settle(
        rows.mapInArrow(
            run,
            "doc_id long, rid long, n_tokens long, n_known long, base double, own double, words array<string>, factors array<float>",
        )
    )
    rare = found.select("rid", F.explode(F.arrays_zip("words", "factors")).alias("x")).select(
        "rid", F.col("x.words").alias("word"), F.col("x.factors").alias("a")
    )
    seen = F.coalesce("c", F.lit(0))
    unigram = (seen + 1) / F.lit(denominator)
    rest = (
        rare.join(model.counts.filter(F.col("c") < FREQUENT * model.tokens), "word", "left")
        .groupBy("rid")
        .agg(
            F.sum((seen > 0).cast("long")).alias("more_known"),
            F.sum(F.log10(unigram)).alias("more_base"),
            F.sum(F.log10(F.col("a").cast("double") * seen + (1 - weight) * unigram)).alias("more_own"),
        )
    )
    zero = F.lit(0)
    return found.drop("words", "factors").join(rest, "rid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", zero)).alias("n_known"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("own") + F.coalesce("more_own", zero)).alias("score"),
    )


def held_out(column: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def op5_language_model(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = train(docs.filter(~held_out()))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
