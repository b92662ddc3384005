"""Links between units of text (documents, paragraphs) whose shingle sets are alike, and their components.

A unit's shingle set is known by a 64-bit hash, so that copies are one node. Nodes that share a band have met there, and
every pair that met is compared or already connected, whatever the size of a bucket:

1. Each bucket names a reference, a node that meets many others, and its nodes are compared with that one on full sets.
   Of a node alone with its reference a sketch is asked first. The components of these links are found.
2. A pair that met shares a reference, and what is left are pairs of different components. There a node is described by
   how it differs from the reference: the symmetric difference of the two sets. If |a| and |b| are the sizes of two sets
   and ta and tb those of their differences from the reference, a similarity of p needs

       |a xor b| <= (|a| + |b|) (1 - p) / (1 + p), so at least (ta + tb - that) / 2 differences in common,

   and among the rarest differences of each, in an order that both follow, the first common one must leave enough behind
   it. Only nodes that have such a difference in common, outside their bucket's largest component, are candidates. Two
   nodes so near the reference that they need none in common are both linked to it.
3. Candidates are confirmed on full sets. So a bucket of thousands of related texts makes few comparisons, and none is
   left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fits

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Ids that are broadcast at most, with the keys of their units (some 40 bytes each), to fetch their texts; beyond it
#: the texts are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Bytes of texts, and texts, that a task works on at once; a longer text is a piece by itself.
PIECE_BYTES, PIECE_TEXTS = 1 << 20, 256
#: Bytes of words hashed at once, and of a word that are hashed as a run; a longer word is hashed as a whole, too.
_SLICE, _LONG = 1 << 20, 1 << 12

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(4).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.cumprod(np.full(_LONG, _A, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble uint64 values."""
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def words_of(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (bytes) and 64-bit hashes of the words of a text, which is lower-cased before."""
    data = np.frombuffer(content, np.uint8)
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    lengths = ends - starts
    short = np.minimum(lengths, _LONG)
    out = np.empty(len(starts), np.uint64)
    total = np.cumsum(short)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _SLICE, "right")))
        n = short[at:to]
        begin = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(begin, n)
        out[at:to] = np.add.reduceat(_BYTE[data[np.repeat(starts[at:to], n) + inside]] * _POWER[inside], begin)
        at = to
    for i in np.flatnonzero(lengths > _LONG).tolist():
        out[i] += np.uint64(xxhash.xxh64_intdigest(content[starts[i] : ends[i]]))
    return starts, ends, mix(out + lengths.astype(np.uint64))


def pieces(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in lower case (A-Z), a bounded number of bytes at once, with the number of the first."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text.as_py().encode().lower())
        size += len(held[-1])
        if size >= PIECE_BYTES or len(held) >= PIECE_TEXTS:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def runs(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` values."""
    n = max(0, len(values) - size + 1)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mix(out + values[i : i + n])
    return out


class Sets:
    """Shingle sets of units, one after another: values (sorted within a unit), owner of each value, n (sizes) and key (a
    64-bit hash of the set, signed). A unit of fewer words than a shingle has the whole sequence as one; without words
    its set is empty."""

    def __init__(self, hashes: np.ndarray, unit: np.ndarray, units: int, size: int):
        """hashes: of the words; unit: number of each word's unit, ascending, or -1 for a word outside units."""
        values = runs(hashes, size)
        owner = unit[: len(values)]
        inside = (owner == unit[size - 1 : size - 1 + len(owner)]) & (owner >= 0)
        values, owner = values[inside], owner[inside]
        lengths = np.bincount(unit[unit >= 0], minlength=units)
        few = np.flatnonzero((lengths > 0) & (lengths < size))
        if len(few):
            at = np.searchsorted(unit, few) if (unit >= 0).all() else np.array([np.argmax(unit == u) for u in few])
            more = [runs(hashes[a : a + lengths[u]], int(lengths[u])) for a, u in zip(at.tolist(), few.tolist(), strict=True)]
            values, owner = np.concatenate((values, *more)), np.concatenate((owner, few))
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        self.values, self.owner = values[fresh], owner[fresh]
        self.n = np.bincount(self.owner, minlength=units)
        self.ends = np.concatenate(([0], np.cumsum(self.n)))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(self.values ^ _B))))
        self.key = mix(sums[self.ends[1:]] - sums[self.ends[:-1]] + self.n.astype(np.uint64)).view(np.int64)

    def of(self, unit: int) -> np.ndarray:
        return self.values[self.ends[unit] : self.ends[unit + 1]]


#: A function that cuts lower-cased texts into units: (hashes of all words, number of each one's unit or -1, the number
#: of units, the text that each unit belongs to).
Cut = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, int, np.ndarray]]


def whole(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Every text is a unit."""
    starts, _, hashes = words_of(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(ends, starts, "right"), len(texts), np.arange(len(texts))


def _full_sets(docs: DataFrame, wanted: DataFrame, cut: Cut, size: int) -> DataFrame:
    """k and members (its set, sorted) for each k of `wanted` (k, did); docs has did, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("ks").to_pylist()
            for first, texts in pieces(batch.column("text")):
                hashes, unit, units, owner = cut(texts)
                sets = Sets(hashes, unit, units, size)
                ks = [set(asked[first + i]) for i in range(len(texts))]
                found = [u for u, (k, o) in enumerate(zip(sets.key.tolist(), owner.tolist(), strict=True)) if k in ks[o]]
                made = [sets.of(u) for u in found]
                ends = pa.array(np.cumsum([0, *map(len, made)]).astype(np.int32))
                values = pa.array(np.concatenate(made).view(np.int64) if made else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(sets.key[found]), pa.ListArray.from_arrays(ends, values)], names=["k", "members"])

    asked = wanted.groupBy("did").agg(F.collect_set("k").alias("ks"))
    asked = F.broadcast(asked) if fits(asked, BROADCAST_IDS) else asked.hint("merge")
    texts = docs.select("did", "text").join(asked, "did").select("text", "ks")
    return texts.mapInArrow(run, "k long, members array<long>").dropDuplicates(["k"])


def _compare(percent: int):
    """near: whether the sets x and y are alike; members: how x differs from y, where `several` asks for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sides = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (part.column("x"), part.column("y"))]
                near, delta = [], []
                for i, several in enumerate(part.column("several").to_pylist()):
                    x, y = (values[ends[i] : ends[i + 1]] for values, ends in sides)
                    apart = np.setxor1d(x, y, assume_unique=True)
                    both = (len(x) + len(y) - len(apart)) // 2
                    near.append(100 * both >= percent * (len(x) + len(y) - both))
                    delta.append(apart if several else apart[:0])
                ends = pa.array(np.cumsum([0, *map(len, delta)]).astype(np.int32))
                values = pa.array(np.concatenate(delta) if delta else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(near), pa.ListArray.from_arrays(ends, values)], names=["a", "b", "near", "members"])

    return run


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, near, members of the pairs (a, b, several)."""
    left = sets.select(F.col("k").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("k").alias("b"), F.col("members").alias("y"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return both.select("a", "b", "several", "x", "y").mapInArrow(_compare(percent), "a long, b long, near boolean, members array<long>")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node and label (the component's smallest node) of every node of the edges (a, b).

    Each round takes the smallest label among a node's neighbours, then the label of that label; rounds end when no
    label changes. Labels are written to the shared folder after each round.
    """
    both = scratch.settle(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = scratch.settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        stepped = scratch.settle(stepped.join(jump, "label").select("node", "old", F.least("label", "jump").alias("label")))
        if stepped.filter("old != label").isEmpty():
            return stepped.select("node", "label")
        labels = stepped.select("node", "label")


def _met(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """band and k of the rows (band, k) whose bucket holds several nodes, each once."""
    crowded = rows.groupBy("band").agg(F.min("k").alias("low"), F.max("k").alias("high")).filter("low != high").select("band")
    return scratch.settle(scratch.settle(rows.join(crowded.hint("merge"), "band", "left_semi")).distinct())


def _references(met: DataFrame, scratch: Scratch) -> DataFrame:
    """a and b for each node a and each reference b of its buckets, a != b.

    A node that meets many others leads its bucket; a node's own choice is the leader it meets most often, and a bucket
    takes the choice of most of its nodes, so that a crowd refers to few nodes near its middle.
    """
    sizes = met.groupBy("band").agg(F.count(F.lit(1)).alias("size"))
    scores = met.join(sizes.hint("merge"), "band").groupBy("k").agg(F.sum("size").alias("score"))
    leaders = met.join(scores.hint("merge"), "k").groupBy("band").agg(F.max_by("k", F.struct("score", "k")).alias("leader"))
    led = met.join(leaders.hint("merge"), "band").groupBy("k", "leader").agg(F.count(F.lit(1)).alias("times"))
    choices = scratch.settle(led.groupBy("k").agg(F.max_by("leader", F.struct("times", "leader")).alias("choice")))
    chosen = met.join(choices.hint("merge"), "k").groupBy("band", "choice").agg(F.count(F.lit(1)).alias("times"))
    references = chosen.groupBy("band").agg(F.max_by("choice", F.struct("times", "choice")).alias("b"))
    pairs = met.join(references.hint("merge"), "band").select(F.col("k").alias("a"), "b")
    return scratch.settle(pairs.filter("a != b").distinct())


def _candidates(described: DataFrame, labels: DataFrame, sizes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of one reference and different components that may be alike; described: a, b (the reference),
    members; sizes: k, n."""
    placed = described.join(labels.withColumnRenamed("node", "a").hint("merge"), "a", "left").withColumn("label", F.coalesce("label", "a"))
    placed = scratch.settle(placed.join(sizes.withColumnRenamed("k", "a").hint("merge"), "a"))
    groups = placed.groupBy("b", "label").agg(F.count(F.lit(1)).alias("nodes"))
    groups = groups.groupBy("b").agg(F.max_by("label", F.struct("nodes", "label")).alias("largest"), F.count(F.lit(1)).alias("labels"))
    groups = groups.filter("labels > 1").drop("labels")
    tokens = placed.join(groups.hint("merge"), "b").select("b", "a", "n", "label", "largest", F.size("members").alias("t"), F.explode("members").alias("token"))
    tokens = scratch.settle(tokens)
    # a difference of one component only counts as a place in the order, but brings no pair
    df = tokens.groupBy("b", "token").agg(F.count(F.lit(1)).alias("df"), (F.min("label") != F.max("label")).alias("mixed"))
    ordered = tokens.join(df.hint("merge"), ["b", "token"]).groupBy("b", "a").agg(
        *(F.first(c).alias(c) for c in ("n", "label", "largest", "t")), F.sort_array(F.collect_list(F.struct("df", "token", "mixed"))).alias("m")
    )
    p = percent / 100
    reach = (1 - p) / (1 + p)
    # a partner has at most n / p members, so the first common difference stands within this many
    most = F.floor(F.col("n") * (1 + 1 / p) * reach + 1e-6).cast("int") + 1
    rows = ordered.select("b", "a", "n", "label", "largest", "t", F.posexplode(F.slice("m", 1, most)).alias("at", "m")).filter("m.mixed")
    rows = scratch.settle(rows.select(F.col("b").alias("ref"), F.col("m.token").alias("token"), "a", "n", "label", "largest", "t", "at"))
    x = rows.filter("label != largest").select("ref", "token", "a", F.col("n").alias("na"), F.col("label").alias("la"), "largest", F.col("t").alias("ta"), F.col("at").alias("i"))
    y = rows.select(F.col("ref").alias("ref_"), F.col("token").alias("token_"), F.col("a").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"), F.col("t").alias("tb"), F.col("at").alias("j"))
    sized = (F.col("na") >= F.col("nb") * p - 1e-6) & (F.col("nb") >= F.col("na") * p - 1e-6)
    common = (F.col("ta") + F.col("tb") - (F.col("na") + F.col("nb")) * reach) / 2
    enough = F.least(F.col("ta") - F.col("i"), F.col("tb") - F.col("j")) >= common - 1e-6
    once = (F.col("lb") == F.col("largest")) | (F.col("a") < F.col("b"))
    found = x.join(y, (F.col("ref") == F.col("ref_")) & (F.col("token") == F.col("token_")) & (F.col("la") != F.col("lb")) & sized & enough & once)
    return scratch.settle(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def link(units: DataFrame, docs: DataFrame, cut: Cut, size: int, percent: int, scratch: Scratch, unlike: Callable | None = None) -> DataFrame:
    """k and label of every node linked to another one.

    units: k, n (size of the set), did, bands (array of long; none for an empty set) and, where `unlike` is given,
    sketch; from settled files. unlike: drops pairs (a, b, several, nu, nv, ru, rv: sizes and sketches) that the sketches show to
    be unlike, before full sets are fetched.
    """
    met = _met(units.select(F.explode("bands").alias("band"), "k"), scratch)
    nodes = met.select("k").distinct().hint("merge")
    held = ["n", "sketch"] if unlike else ["n"]
    known = units.select("k", "did", *held).join(nodes, "k", "left_semi")
    known = scratch.settle(known.groupBy("k").agg(F.min("did").alias("did"), *(F.first(c).alias(c) for c in held)))

    def screened(pairs: DataFrame) -> DataFrame:
        if not unlike:
            return pairs
        side = lambda node, x: known.select(F.col("k").alias(node), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"r{x}")).hint("merge")
        return scratch.settle(pairs.join(side("a", "u"), "a").join(side("b", "v"), "b").mapInArrow(unlike, "a long, b long, several boolean"))

    references = _references(met, scratch)
    groups = references.groupBy("b").agg((F.count(F.lit(1)) > 1).alias("several"))
    pairs = screened(references.join(groups.hint("merge"), "b").select("a", "b", "several"))
    nodes = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct().hint("merge")
    sets = scratch.settle(_full_sets(docs, known.select("k", "did").join(nodes, "k", "left_semi"), cut, size))
    described = scratch.settle(_compared(pairs, sets, percent))
    labels = components(described.filter("near"), scratch)
    more = _candidates(described.filter(F.size("members") > 0).select("a", "b", "members"), labels, known.select("k", "n"), percent, scratch)
    more = screened(more.withColumn("several", F.lit(False)))
    more = scratch.settle(_compared(more, sets, percent).filter("near").select("a", "b"))
    if not more.isEmpty():
        labels = _joined(labels, more, scratch)
    return labels.select(F.col("node").alias("k"), "label")


def _joined(labels: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels after links (a, b) between components: these are single nodes of a smaller graph now."""
    at = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))
    ends = more.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    over = components(ends.filter("a != b").distinct(), scratch)
    renamed = over.select(F.col("node").alias("label"), F.col("label").alias("above"))
    old = labels.join(renamed, "label", "left").select("node", F.coalesce("above", "label").alias("label"))
    return old.unionByName(over.join(labels, "node", "left_anti").select("node", "label"))
