"""Set-similarity self-join of word shingles by prefix trees.

Shingles are put in one global order, rare ones first, and a document's set becomes a string in that order. Two sets of
sizes x and y with a similarity of p share at least p / (1 + p) (x + y) shingles, so they share one among the first
x - ceil(p x) + 1 of each.

1. A shingle that only one set has can bring no pair. A set with more of those than it may miss has no partner. To see
   that for most sets, the quarter of the shingles with the smallest hashes is counted, whole.
2. The shingles of the rest are counted exactly and give the order. Sets that share a shingle among their first ones,
   and may be near in size, are one cluster.
3. The sets of a cluster form a prefix tree. A set goes down the tree with the overlap so far, which all sets below a
   node share, and leaves a subtree that cannot reach the overlap with what remains of both, or that is connected to it
   already. Clusters follow each other in sorted partitions, one in memory at a time.
4. A cluster of more than BLOCK sets is dealt in blocks. Each block is joined with itself, then one set of each
   component found; the sets outside the largest component are then sent down the trees of all blocks. So a crowd of
   like texts costs its size, and no pair is left out or written.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, id_back, id_key, settle, small_batches, text_of
from .links import Sets, _full_sets, components, pieces, whole

#: Sets of one tree, and numbers in their strings, at about; larger clusters are dealt in blocks.
BLOCK, BLOCK_TOKENS = 1000, 2_000_000
#: The part of the shingles (by hash) that is counted to find sets without a partner.
PART = 4


def _nodes(size: int):
    """did, n, k (hash of the set) and low: its shingles in the counted part."""
    limit = np.uint64(2**64 // PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch.column("text")):
                hashes, unit, units, _ = whole(texts)
                sets = Sets(hashes, unit, units, size)
                low = sets.values < limit
                ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(sets.owner[low], minlength=units)))).astype(np.int32))
                lows = pa.ListArray.from_arrays(ends, pa.array(sets.values[low].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("did").slice(first, units), pa.array(sets.n.astype(np.int64)), pa.array(sets.key), lows], names=["did", "n", "k", "low"])

    return run


def _least(n: str, percent: int):
    """How many shingles of a set of n are shared at least with any partner."""
    return F.ceil(F.col(n) * percent / 100 - 1e-9)


class Tree:
    """The prefix tree of sets, as strings of numbers. Node v covers the sorted rows lo[v] to hi[v] and has the places
    begin[v] to end[v] of their strings on the edge above it; row[v] is the row that ends at it, or -1."""

    def __init__(self, strings: list[np.ndarray], sizes: np.ndarray):
        # big-endian numbers compare as bytes do
        self.order = np.array(sorted(range(len(strings)), key=lambda i: strings[i].astype(">u4").tobytes()))
        self.strings, self.sizes = [strings[i] for i in self.order], sizes[self.order]
        self.lo, self.hi, self.row, self.begin, self.end, self.children = [], [], [], [], [], []
        n = len(strings)
        open_nodes = [self._node(0, -1, 0, 0)]
        for i in range(n):
            common = self._common(i)
            cut = -1
            while self.end[open_nodes[-1]] > common:
                v = open_nodes.pop()
                self.hi[v] = i
                if self.begin[v] < common:
                    cut = v
                else:
                    self.children[open_nodes[-1]].append(v)
            if cut >= 0:  # the new string leaves inside this edge
                upper = self._node(self.lo[cut], -1, self.begin[cut], common)
                self.begin[cut] = common
                self.children[upper].append(cut)
                open_nodes.append(upper)
            open_nodes.append(self._node(i, i, common, len(self.strings[i])))
        while len(open_nodes) > 1:
            v = open_nodes.pop()
            self.hi[v] = n
            self.children[open_nodes[-1]].append(v)
        self.hi[0] = n
        lengths = np.array([len(x) for x in self.strings])
        below = lambda f, values: [int(f(values[a:b])) for a, b in zip(self.lo, self.hi, strict=True)]
        self.small, self.large, self.deep = below(np.min, self.sizes), below(np.max, self.sizes), below(np.max, lengths)

    def _node(self, lo: int, row: int, begin: int, end: int) -> int:
        for held, value in ((self.lo, lo), (self.hi, lo), (self.row, row), (self.begin, begin), (self.end, end), (self.children, [])):
            held.append(value)
        return len(self.lo) - 1

    def _common(self, i: int) -> int:
        if not i:
            return 0
        a, b = self.strings[i - 1], self.strings[i]
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        return int(differ[0]) if len(differ) else m

    def near(self, query: np.ndarray, size: int, percent: int, passed: Callable[[int, int], bool]) -> Iterator[int]:
        """Rows whose sets share enough with a query (its string and its set's size); passed(lo, hi): leave these out.

        100 s >= p (x + y - s) is (100 + p) s >= p (x + y), so a subtree must reach it for its smallest possible y.
        """
        smallest = (percent * size + 99) // 100
        stack = [(0, 0)]
        while stack:
            v, shared = stack.pop()
            if self.large[v] < smallest or self.small[v] * percent > size * 100 or passed(self.lo[v], self.hi[v]):
                continue
            a, b = self.begin[v], self.end[v]
            behind = len(query)
            if b > a:
                edge = self.strings[self.lo[v]][a:b]
                at = np.searchsorted(query, edge)
                shared += int((query[np.minimum(at, len(query) - 1)] == edge).sum())
                behind -= int(np.searchsorted(query, edge[-1], "right"))
            most = shared + min(behind, self.deep[v] - b)
            if most * (100 + percent) < percent * (size + max(self.small[v], smallest)):
                continue
            row = self.row[v]
            if row >= 0 and shared * (100 + percent) >= percent * (size + int(self.sizes[row])) and not passed(row, row + 1):
                yield row
            stack += [(c, shared) for c in self.children[v]]


def forest(sizes: np.ndarray, strings: list[np.ndarray], home: np.ndarray, asks: np.ndarray, labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (as positions) between sets that ask and sets at home that connect all that their links connect; labels: of
    components known before, which need no link."""
    rows = np.flatnonzero(home)
    if not len(rows) or not asks.any():
        return []
    tree = Tree([strings[i] for i in rows], sizes[rows])
    rows = rows[tree.order]
    label, asked = labels.copy(), asks[rows]
    place = {int(x): i for i, x in enumerate(rows)}
    out, left = [], len(np.unique(label))
    for q in np.flatnonzero(asks).tolist():
        if left == 1:
            break
        done = place.get(q, -1)  # pairs of sets that both ask and are at home meet once

        def passed(lo: int, hi: int, q=q, done=done) -> bool:
            gone = label[rows[lo:hi]] == label[q]
            if lo <= done:
                gone[: done + 1 - lo] |= asked[lo : min(hi, done + 1)]
            return bool(gone.all())

        for row in tree.near(strings[q], int(sizes[q]), percent, passed):
            out.append((q, int(rows[row])))
            label[label == label[rows[row]]] = label[q]
            left -= 1
    return out


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column, without a copy of each number as an object."""
    out = []
    for chunk in column.chunks:
        values, ends = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return out


def _joined(percent: int):
    """a and b of the links of each group (cluster, part), whose rows follow each other."""

    def links(group: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(group)
        tokens, df = _arrays(table["tokens"]), _arrays(table["df"])
        known, first, number = np.unique(np.concatenate(tokens), return_index=True, return_inverse=True)
        order = np.lexsort((known, np.concatenate(df)[first]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        strings = np.split(rank[number], np.cumsum([len(t) for t in tokens])[:-1])
        flag = lambda c: table[c].to_numpy().astype(bool)
        found = forest(table["n"].to_numpy(), strings, flag("home"), flag("asks"), table["label"].to_numpy(), percent)
        ks = table["k"].to_numpy()
        ends = [pa.array(ks[np.array([pair[side] for pair in found], np.int64)]) for side in (0, 1)]
        return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("cluster", "part")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in pairwise(cuts):
                key = tuple(keys[a].tolist())
                if key != last and held:
                    yield links(held)
                    held = []
                last = key
                held.append(batch.slice(a, b - a))
        if held:
            yield links(held)

    return run


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """a and b of the links found inside each (cluster, part)."""
    dealt = rows.repartition("cluster", "part").sortWithinPartitions("cluster", "part")
    return dealt.select("cluster", "part", "k", "n", "tokens", "df", "home", "asks", "label").mapInArrow(_joined(percent), "a long, b long")


def _ordered_sets(docs: DataFrame, nodes: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """k, n, first (how many of its first shingles other sets may share), tokens and df: the shingles that other sets
    have, too, in the global order. Only of sets that may have a partner; nodes: k, did, n, low."""
    may_miss = F.col("n") - _least("n", percent)
    counted = nodes.select("k", F.explode("low").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("sets"), F.first("k").alias("k"))
    alone = counted.filter("sets = 1").groupBy("k").agg(F.count(F.lit(1)).alias("alone"))
    left = nodes.select("k", "did", "n").join(alone.hint("merge"), "k", "left").filter(F.coalesce("alone", F.lit(0)) <= may_miss)
    left = scratch.settle(left.select("k", "did", "n"))
    sets = scratch.settle(_full_sets(docs, left.select("k", "did"), whole, size))
    each = sets.select("k", F.explode("members").alias("token"))
    shared = scratch.settle(each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    # a list is bounded by its set's own size
    placed = each.join(shared.hint("merge"), "token").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("m"))
    ordered = left.select("k", "n").join(placed.hint("merge"), "k").withColumn("first", (may_miss + 1 - (F.col("n") - F.size("m"))).cast("int"))
    return scratch.settle(ordered.filter("first > 0").select("k", "n", "first", F.col("m.token").alias("tokens"), F.col("m.df").alias("df")))


def _clusters(ordered: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """node and label of sets that share one of their first shingles and may be near in size: both fall into one of two
    neighbouring classes of sizes."""
    width = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9
    kind = F.floor(F.log("n") / width)
    rows = ordered.select("k", F.explode(F.array(kind, kind + 1)).alias("kind"), F.slice("tokens", F.lit(1), F.col("first")).alias("tokens"))
    rows = rows.select("k", "kind", F.explode("tokens").alias("token"))
    edges = rows.withColumn("a", F.min("k").over(Window.partitionBy("token", "kind"))).filter("a != k").select("a", F.col("k").alias("b")).distinct()
    return components(scratch.settle(edges), scratch)


def _blocks(sets: str, tokens: str) -> Column:
    return F.ceil(F.greatest(F.col(sets) / BLOCK, F.col(tokens) / BLOCK_TOKENS)).cast("int")


def _large(rows: DataFrame, found: DataFrame, percent: int, scratch: Scratch) -> list[DataFrame]:
    """Links between the blocks of large clusters; rows: their sets (part: the block, blocks: how many), found: the links
    inside blocks."""
    ends = rows.select("k")
    inside = found.join(ends.withColumnRenamed("k", "a").hint("merge"), "a", "left_semi")

    def labelled(links: DataFrame) -> DataFrame:
        labels = components(links, scratch).select(F.col("node").alias("k"), F.col("label").alias("known"))
        return scratch.settle(rows.join(labels.hint("merge"), "k", "left").withColumn("label", F.coalesce("known", "k")).drop("known"))

    now = labelled(inside)
    speaks = now.groupBy("cluster", "part", "label").agg(F.min("k").alias("k")).select("k")
    speaks = scratch.settle(now.join(speaks.hint("merge"), "k", "left_semi"))
    sized = speaks.groupBy("cluster").agg(F.count(F.lit(1)).alias("sets"), F.sum(F.size("tokens")).alias("numbers"))
    dealt = speaks.join(sized, "cluster").withColumn("part", F.pmod(F.xxhash64("k", F.lit(1)), _blocks("sets", "numbers")).cast("int"))
    across = scratch.settle(_links(dealt, percent))
    now = labelled(inside.unionByName(across))
    groups = now.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("sets"))
    main = groups.groupBy("cluster").agg(F.max_by("label", F.struct("sets", "label")).alias("main"))
    strays = scratch.settle(now.join(main, "cluster").filter("label != main").drop("main"))
    sized = strays.groupBy("cluster").agg(_groups().alias("groups"))
    strays = strays.join(sized, "cluster").withColumn("group", F.pmod(F.xxhash64("k", F.lit(2)), F.col("groups")).cast("int"))
    to = lambda block, group: (block * F.col("groups") + group).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asking = strays.withColumn("block", every(F.col("blocks"))).withColumn("part", to(F.col("block"), F.col("group")))
    at_home = now.join(sized, "cluster").withColumn("group", every(F.col("groups"))).withColumn("part", to(F.col("part"), F.col("group")))
    columns = ["cluster", "part", "k", "n", "tokens", "df", "label"]
    both = asking.select(*columns, F.lit(False).alias("home"), F.lit(True).alias("asks"))
    both = both.unionByName(at_home.select(*columns, F.lit(True).alias("home"), F.lit(False).alias("asks")))
    return [across, scratch.settle(_links(both, percent))]


def _groups() -> Column:
    return F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.size("tokens")) / BLOCK_TOKENS)).cast("int")


def similar_sets(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component (smallest doc_id reachable over links), one row for each input row.

    size: words of a shingle; percent: least similarity in hundredths (over 0). A document without words (null, empty or
    white space) has the empty set and is linked with nothing; one of fewer words than `size` has them all as one
    shingle. A null doc_id counts as smaller than any other. Rows that share an id are one document with several texts:
    each keeps its own component. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    base = docs.select(id_key().alias("did"), text_of().alias("text"))
    rows = scratch.settle(base.mapInArrow(_nodes(size), "did long, n long, k long, low array<long>"))
    some = rows.filter("n > 0")
    nodes = scratch.settle(some.groupBy("k").agg(F.min("did").alias("did"), F.first("n").alias("n"), F.first("low").alias("low"), F.count(F.lit(1)).alias("times")))
    ordered = _ordered_sets(base, nodes, size, percent, scratch)
    clusters = _clusters(ordered, percent, scratch)
    clustered = scratch.settle(ordered.drop("first").join(clusters.select(F.col("node").alias("k"), F.col("label").alias("cluster")).hint("merge"), "k"))
    sized = clustered.groupBy("cluster").agg(_groups().alias("blocks"))
    dealt = clustered.join(sized.hint("merge"), "cluster").withColumns(
        {"part": F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"), "label": F.col("k"), "home": F.lit(True), "asks": F.lit(True)}
    )
    dealt = scratch.settle(dealt)
    found = [scratch.settle(_links(dealt, percent))]
    large = dealt.filter("blocks > 1")
    if not large.isEmpty():
        found += _large(large, found[0], percent, scratch)
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    labels = components(links, scratch).select(F.col("node").alias("k"), "label")
    # only sets with a link or a copy have another component than their own
    heads = nodes.select("k", "did", "times").join(labels.hint("merge"), "k", "left").withColumn("label", F.coalesce("label", "k"))
    heads = scratch.settle(heads)
    smallest = heads.groupBy("label").agg(F.min("did").alias("component"), F.sum("times").alias("held")).filter("held > 1")
    named = heads.join(smallest.hint("merge"), "label").select("k", "component")
    linked = some.select("did", "n", "k").join(named.hint("merge"), "k", "left").select("did", "n", F.coalesce("component", "did").alias("component"))
    out = settle(linked.unionByName(rows.filter("n = 0").select("did", "n", F.col("did").alias("component"))))
    scratch.drop()
    return out.select(id_back("did").alias("doc_id"), F.col("n").alias("n_shingles"), id_back("component").alias("component"))


def op11_jaccard_join(spark, sf_dir):
    return similar_sets(documents(spark, sf_dir), size=4, percent=85).withColumnRenamed("component", "component_id")


OP11_SQL = """
WITH RECURSIVE
docs AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM docs),
one AS MATERIALIZED (SELECT doc_id, s, len(s) AS n, min(doc_id) OVER (PARTITION BY list_sort(s)) AS node FROM sets),
grams AS MATERIALIZED (SELECT doc_id, n, hash(unnest(s)) AS gram FROM one WHERE doc_id = node),
counted AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY gram) AS df FROM grams),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY df, gram) AS place FROM counted),
first AS MATERIALIZED (SELECT * FROM ranked WHERE df > 1 AND place <= n - ceil(0.85 * n - 1e-9) + 1),
met AS MATERIALIZED (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM first a JOIN first b ON a.gram = b.gram AND a.doc_id < b.doc_id AND a.n * 100 >= 85 * b.n AND b.n * 100 >= 85 * a.n),
link AS MATERIALIZED (SELECT a, b FROM (SELECT m.a, m.b, m.na, m.nb, count(*) AS x FROM met m JOIN counted g ON g.doc_id = m.a JOIN counted h ON h.doc_id = m.b AND h.gram = g.gram GROUP BY ALL) WHERE 100 * x >= 85 * (na + nb - x)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS node, doc_id AS to_ FROM one WHERE doc_id = node UNION SELECT r.node, e.b FROM reach r JOIN edge e ON e.a = r.to_),
component AS (SELECT node, min(to_) AS component_id FROM reach GROUP BY node)
SELECT o.doc_id, o.n AS n_shingles, CASE WHEN o.n = 0 THEN o.doc_id ELSE c.component_id END AS component_id FROM one o JOIN component c USING (node)
"""
