"""Repeated and nearly repeated paragraphs, removed from all documents but the first that holds them.

Two kinds of unit are compared. A natural paragraph is a line of at least LEAST_WORDS words, or what shorter lines that
follow each other, without a blank line between them, hold together, if that is as much (hard-wrapped text); less, such
as a heading, is no paragraph. Paragraphs carry MinHash bands of their five-word shingles; those that collide are
verified by exact Jaccard similarity. Text that is pasted inside another paragraph has no such borders, so passages of
PASSAGE words are picked by their content as well: of every WINDOW consecutive passages that with the smallest hash. A
run of PASSAGE + WINDOW - 1 words that two documents share holds a passage that both pick, wherever it stands. Passages
are equal where two independent hashes of their words, 128 bits together, are. Equal units are one node; components of
nodes keep their unit in the document with the smallest id, there the first, and lose the others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, Scratch, documents, id_back, id_key, small_batches, text_of
from .links import Sets, link, mix, pieces, words_of

LEAST_WORDS, SHINGLE, PERCENT = 20, 5, 80
#: Bands of three MinHash values: a pair with a similarity of 0.8 shares none with a probability of 9e-5.
BANDS, ROWS = 13, 3
PASSAGE, WINDOW = 20, 30
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(1, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, at least n."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            table = np.full(2 * n, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table)
    return _powers


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` values."""
    n = len(values)
    if n < size:
        return np.empty(0, np.uint64)
    up, down = _power_tables(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[:n])))
    return mix((sums[size:] - sums[:-size]) * down[: n - size + 1])


def sliding(values: np.ndarray, size: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each run of `size` values, by doubling."""
    span = 1
    while 2 * span <= size:
        values = best(values[:-span], values[span:])
        span *= 2
    return best(values[: len(values) - (size - span)], values[size - span :]) if size > span else values


def picked(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions that have the smallest hash of some `window` consecutive ones; of fewer, the smallest of all."""
    n = len(hashes)
    if n <= window:
        return np.flatnonzero(hashes == hashes.min()) if n else np.empty(0, np.int64)
    least = sliding(hashes, window, np.minimum)
    edge = np.zeros(window - 1, np.uint64)
    return np.flatnonzero(sliding(np.concatenate((edge, least, edge)), window, np.maximum) == hashes)


_NEWLINE = 10


def paragraphs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """The natural paragraphs of the texts, for `links`: hashes of all words, each one's unit or -1, the number of units,
    the text of each unit."""
    hashes, text, unit, owner = _words(texts)[:4]
    return hashes, unit, len(owner), owner


def _words(texts: list[bytes]):
    """hashes and text number of all words, paragraph of each (or -1), text and first word of each paragraph."""
    content = b"\n".join(texts)
    starts, ends, hashes = words_of(content)
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    breaks = np.flatnonzero(np.frombuffer(content, np.uint8) == _NEWLINE)
    line = np.searchsorted(breaks, starts)
    if not len(line):
        return hashes, text, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.diff(line, prepend=-1))  # word that starts a line
    length = np.diff(np.append(first, len(line)))
    number, of = line[first], text[first]
    # a line joins the one before if both are short, next to each other and of one text
    short = length < LEAST_WORDS
    joins = np.zeros(len(first), bool)
    joins[1:] = short[1:] & short[:-1] & (np.diff(number) == 1) & (of[1:] == of[:-1])
    block = np.cumsum(~joins) - 1
    size = np.bincount(block, weights=length).astype(np.int64)
    kept = size >= LEAST_WORDS
    numbers = np.where(kept, np.cumsum(kept) - 1, -1)
    begins = first[~joins]
    return hashes, text, np.repeat(numbers[block], length), of[~joins][kept], begins[kept]


def _bands(sets: Sets) -> np.ndarray:
    """(units, BANDS) hashes of the bands; no set is empty."""
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sets.n), BANDS)).copy()
    for i in range(BANDS * ROWS):
        band = i // ROWS
        out[:, band] = mix(out[:, band] + np.minimum.reduceat(sets.values * _MULTIPLY[i] + _ADD[i], sets.ends[:-1]))
    return out


def _passages(hashes: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the picked passages, and two hashes of each."""
    values = window_hashes(hashes, PASSAGE)
    n = len(values)
    inside = text[:n] == text[PASSAGE - 1 :][:n]
    size = np.bincount(text[:n][inside], minlength=texts)  # passages of each text
    picks = np.zeros(n, bool)
    if n >= WINDOW:
        least = sliding(values, WINDOW, np.minimum)
        span = WINDOW + PASSAGE - 1
        least[text[: len(least)] != text[span - 1 :][: len(least)]] = 0  # windows that leave the text pick nothing
        edge = np.zeros(WINDOW - 1, np.uint64)
        picks = (sliding(np.concatenate((edge, least, edge)), WINDOW, np.maximum) == values) & inside
    begins = np.searchsorted(text, np.arange(texts))
    for t in np.flatnonzero((size > 0) & (size < WINDOW)).tolist():  # fewer passages than a window: the smallest of all
        part = values[begins[t] : begins[t] + size[t]]
        picks[begins[t] : begins[t] + size[t]] = part == part.min()
    chosen = np.flatnonzero(picks)
    return chosen, values[chosen], window_hashes(mix(hashes ^ np.uint64(_BASE)), PASSAGE)[chosen]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        did, digest = (batch.column(c).to_numpy() for c in ("did", "digest"))
        for at, texts in pieces(batch.column("text")):
            hashes, text, unit, owner, begins = _words(texts)
            if not len(hashes):
                continue
            before = np.searchsorted(text, np.arange(len(texts)))  # words of the texts before
            chosen, key, check = _passages(hashes, text, len(texts))
            sets = Sets(hashes, unit, len(owner), SHINGLE)
            bands = _bands(sets) if len(owner) else np.empty((0, BANDS), np.uint64)
            of = np.concatenate((text[chosen], owner))
            length = np.bincount(unit[unit >= 0], minlength=len(owner))
            ends = np.concatenate((np.zeros(len(chosen) + 1, np.int64), BANDS * np.arange(1, len(owner) + 1))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(did[at + of]),
                    pa.array(digest[at + of]),
                    pa.array((np.concatenate((chosen, begins)) - before[of]).astype(np.int32)),
                    pa.array(np.concatenate((np.full(len(chosen), PASSAGE), length)).astype(np.int32)),
                    pa.array(np.concatenate((key.view(np.int64), sets.key))),
                    pa.array(np.concatenate((check.view(np.int64), np.zeros(len(owner), np.int64)))),
                    pa.array(np.concatenate((np.zeros(len(chosen), np.int64), sets.n)).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.reshape(-1).view(np.int64))),
                ],
                names=["did", "digest", "first", "n", "k", "check", "members", "bands"],
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            out = []
            for did, text, units in zip(*(part.column(c).to_pylist() for c in ("did", "text", "units")), strict=True):
                if not units:
                    out.append((did, len(text.encode().split()), 0, [], [], text))
                    continue
                words = [m.span() for m in _WORD.finditer(text)]
                gone, seen, origins = np.zeros(len(words) + 1, np.int64), set(), set()
                for u in sorted(units or [], key=lambda u: (u["first"], u["n"])):
                    if u["origin"] != did or u["label"] in seen:
                        gone[u["first"]] += 1
                        gone[u["first"] + u["n"]] -= 1
                        origins.add(u["origin"])
                    seen.add(u["label"])
                covered = np.concatenate(([0], (np.cumsum(gone)[:-1] > 0).astype(np.int64), [0]))
                starts, ends = np.flatnonzero(np.diff(covered) == 1), np.flatnonzero(np.diff(covered) == -1)
                spans = [(words[a][0], words[b - 1][1]) for a, b in zip(starts, ends, strict=True)]
                kept, done = [], 0
                for a, b in spans:
                    kept.append(text[done:a])
                    done = b
                kept.append(text[done:])
                out.append((did, len(words), int(covered.sum()), spans, sorted(origins), "".join(kept)))
            yield pa.RecordBatch.from_arrays(_arrays(out), names=["did", "n_words", "n_removed", "spans", "origins", "kept"])


def _arrays(out: list[tuple]) -> list[pa.Array]:
    did, n_words, n_removed, spans, origins, kept = zip(*out, strict=True)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    named = [[{"start": a, "end": b} for a, b in s] for s in spans]
    return [
        pa.array(did, pa.int64()),
        pa.array(n_words, pa.int64()),
        pa.array(n_removed, pa.int64()),
        pa.array(named, pa.list_(span)),
        pa.array(origins, pa.list_(pa.int64())),
        pa.array(kept, pa.string()),
    ]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed (words), spans (array of start and end in characters, removed), origins (ids of the
    documents where the removed units stay), kept (the rest of the text); one row for each input row.

    A null or short text loses nothing. A null doc_id counts as smaller than any other. Rows that repeat both id and
    text are one document, listed twice, and are cut alike. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    base = docs.select(id_key().alias("did"), text_of().alias("text"))
    fields = "did long, digest long, first int, n int, k long, check long, members int, bands array<long>"
    units = scratch.settle(base.withColumn("digest", F.xxhash64("text")).mapInArrow(_units, fields))
    natural = units.filter("members > 0")
    inner = Scratch(docs.sparkSession)
    labels = scratch.settle(link(natural.select("k", F.col("members").cast("long").alias("n"), "did", "bands"), base, paragraphs, SHINGLE, PERCENT, inner))
    inner.drop()
    place = ["did", "digest", "first", "n"]
    placed = natural.select(*place, "k").join(labels.hint("merge"), "k", "left").select(*place, F.coalesce("label", "k").alias("label"), F.lit(0).cast("long").alias("check"), F.lit(True).alias("natural"))
    placed = placed.unionByName(units.filter("members = 0").select(*place, F.col("k").alias("label"), "check", F.lit(False).alias("natural")))
    unit = ["label", "check", "natural"]
    origin = placed.groupBy(*unit).agg(F.min("did").alias("origin"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    repeated = scratch.settle(placed.join(scratch.settle(origin).hint("merge"), unit))
    by_doc = repeated.groupBy("did", "digest").agg(F.collect_set(F.struct("first", "n", "label", "origin")).alias("units"))
    span = "array<struct<start: long, end: long>>"
    cut = (
        base.withColumn("digest", F.xxhash64("text"))
        .join(by_doc.hint("merge"), ["did", "digest"], "left")
        .select("did", "text", "units")
        .mapInArrow(_cut, f"did long, n_words long, n_removed long, spans {span}, origins array<long>, kept string")
    )
    return cut.select(id_back("did").alias("doc_id"), "n_words", "n_removed", "spans", F.transform("origins", lambda o: F.nullif(o, F.lit(NO_ID))).alias("origins"), "kept")


def op10_paragraphs(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.size("spans").cast("long").alias("n_spans"), "origins", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )
