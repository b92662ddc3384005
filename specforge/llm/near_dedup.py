"""Near duplicates by SetSketch registers.

A document's word shingles fill the registers of a SetSketch: register values are truncated, exponentially spaced minima,
so that sketches of parts merge by the maximum, and two sketches agree in a register about as often as the sets are
alike. Bands of registers bring candidates together; the similarity that makes the counts of larger, smaller and equal
registers likeliest, given both set sizes, screens them; full sets confirm the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, aside, documents, id_back, id_key, settle, small_batches, text_of
from .links import Sets, link, mix, pieces, whole

#: Registers (a prime), base of the spacing, rate, and largest value.
M, BASE, RATE, TOP = 241, 1.001, 20.0, 65534
#: Bands of registers: at a similarity of 0.8 a pair shares none with a probability of 5e-6.
BANDS, ROWS = 40, 6
#: Pairs are screened out when their likeliest similarity is so far below the one asked for (about 6 standard errors).
SLACK = 0.15

_GAMMA = np.append(np.log1p(np.arange(M) / (M - np.arange(M))) / RATE, np.inf)


def sketch(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Registers (n, M) of n sets; values are hashes of members, owner the number of each one's set.

    Member by member, the j-th value lies in the j-th interval of the exponential distribution and goes to the j-th
    register of a permutation that the hash selects, so a register that has a value needs no later one.
    """
    least = np.full(n * M, np.inf)
    at, step = values % np.uint64(M), np.uint64(1) + (values >> np.uint64(32)) % np.uint64(M - 1)
    values, owner = values.copy(), owner.astype(np.int64)
    for j in range(M):
        place = owner * M + at.astype(np.int64)
        free = np.flatnonzero(np.isinf(least[place]))
        if len(free):
            u = (mix(values[free] + np.uint64(j + 1)) >> np.uint64(11)).astype(float) / 2.0**53
            width = 1.0 if j == M - 1 else -np.expm1(-RATE * (_GAMMA[j + 1] - _GAMMA[j]))
            np.minimum.at(least, place[free], _GAMMA[j] - np.log1p(-u * width) / RATE)
        at = (at + step) % np.uint64(M)
        if j < 8 or j % 8 == 0:  # sets whose registers are all filled are done
            stay = np.isinf(least).reshape(n, M).any(1)[owner]
            if not stay.all():
                at, step, values, owner = at[stay], step[stay], values[stay], owner[stay]
            if not len(values):
                break
    registers = np.floor(1 - np.log(np.maximum(least, 1e-300)) / np.log(BASE)) + 32768
    return np.clip(np.where(np.isinf(least), 0, registers), 0, TOP).astype(np.uint16).reshape(n, M)


def bands_of(registers: np.ndarray) -> np.ndarray:
    """(n, BANDS) hashes of the bands."""
    rows = registers[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(40), rows.shape[:2]).copy()
    for i in range(ROWS):
        out = mix(out + rows[:, :, i])
    return out.view(np.int64)


def likeliest(u: np.ndarray, v: np.ndarray, nu: np.ndarray, nv: np.ndarray, steps: int = 101) -> np.ndarray:
    """Similarity of each pair of sketches that makes their registers likeliest, given the sizes of the sets."""
    more, fewer = (u > v).sum(1)[:, None], (u < v).sum(1)[:, None]
    equal = u.shape[1] - more - fewer
    x = (nu / (nu + nv))[:, None]
    y = 1 - x
    j = np.minimum(x / y, y / x) * np.linspace(0, 1, steps)
    p = lambda z: -np.log1p(-np.maximum(z, 0) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(x - y * j), p(y - x * j)
    log = lambda z: np.log(np.maximum(z, 1e-9))
    best = np.argmax(more * log(up) + fewer * log(down) + equal * log(1 - up - down), 1)
    return j[np.arange(len(j)), best]


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch.column("text")):
                hashes, unit, units, _ = whole(texts)
                sets = Sets(hashes, unit, units, size)
                registers = sketch(sets.values, sets.owner, units)
                ends = pa.array(np.cumsum(np.concatenate(([0], np.where(sets.n > 0, BANDS, 0)))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("did").slice(first, units),
                        pa.array(sets.n.astype(np.int64)),
                        pa.array(sets.key),
                        pa.ListArray.from_arrays(ends, pa.array(bands_of(registers)[sets.n > 0].reshape(-1))),
                        pa.array([r.tobytes() for r in registers], pa.binary()),
                    ],
                    names=["did", "n", "k", "bands", "sketch"],
                )

    return run


def _unlike(percent: int):
    """Drops pairs that are not alike by the likelihood of their registers, but keeps those that other nodes depend on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                u, v = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("ru", "rv"))
                near = likeliest(u, v, part.column("nu").to_numpy(), part.column("nv").to_numpy()) >= percent / 100 - SLACK
                near |= part.column("several").to_numpy(zero_copy_only=False)
                yield part.select(["a", "b", "several"]).filter(pa.array(near))

    return run


def near_classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component (smallest doc_id reachable over links), one row for each input row.

    size: words of a shingle; percent: least similarity in hundredths. A document without words is linked with nothing.
    A null doc_id counts as smaller than any other. Rows that share an id are one document with several texts: where
    any of them is linked, its component is the smallest id of that row's component. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    base = docs.select(id_key().alias("did"), text_of().alias("text"))
    units = scratch.settle(base.mapInArrow(_sketches(size), "did long, n long, k long, bands array<long>, sketch binary"))
    labels = link(units, base, whole, size, percent, scratch, _unlike(percent))
    labelled = units.filter("n > 0").select("did", "n", "k").join(labels.hint("merge"), "k", "left").withColumn("label", F.coalesce("label", "k"))
    labelled = scratch.settle(labelled.select("did", "n", "label"))
    smallest = labelled.groupBy("label").agg(F.min("did").alias("component"), F.count(F.lit(1)).alias("rows"))
    # a component of one row needs no lookup
    found = labelled.join(smallest.filter("rows > 1").hint("merge"), "label", "left")
    rows = found.select("did", "n", F.coalesce("component", "did").alias("component"))
    empty = units.filter("n = 0").select("did", "n", F.col("did").alias("component"))
    out = settle(rows.unionByName(empty))
    scratch.drop()
    return out.select(id_back("did").alias("doc_id"), F.col("n").alias("n_shingles"), id_back("component").alias("component"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, that with the smallest id, with the columns of the input. Of rows that share
    that id all stay."""
    (did,) = aside(docs.columns, "did")
    kept = near_classes(docs, size, percent).filter(F.col("doc_id").eqNullSafe(F.col("component"))).select(id_key().alias(did)).distinct()
    return docs.withColumn(did, id_key()).join(kept, did, "left_semi").select(*docs.columns)


def op2_near_dedup(spark, sf_dir):
    return near_classes(documents(spark, sf_dir), size=2).select(
        "doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept")
    )
