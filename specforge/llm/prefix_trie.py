"""A z-fast trie of conversations: which share their first turns, and what sharing them would save.

A conversation is a string of turns. Prefixes are known by a 128-bit sum of hashes of (place, turn), so that a prefix of
any length is one key and running sums give all of them, in pieces, whatever the length of a conversation.

Only the compacted trie is built: a node where conversations part or end (its extent), with the edge above it. Each is
found under its handle, the prefix whose length is the 2-fattest number on the edge (the one with the most zeros at its
end in binary). A conversation's exit is located by fat binary search: of the lengths that are left the 2-fattest is
looked up, a hit goes on below the extent that was found, a miss above. So a conversation makes as many look-ups as its
length has binary digits, and only what lies behind its exit is grouped. Conversations are inserted in batches: the first
small one makes the trie that the next ones are located in. At the end edges are expanded to a node for each turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, settle, small_batches

#: Parts of the conversations (by hash, in 64ths) that are inserted in one batch, one after the other.
BATCHES = (8, 64)

def _root() -> Column:
    """The key of the root, the empty prefix."""
    return F.lit(bytearray(b""))


def _fattest(a: Column, b: Column) -> Column:
    """The number in (a, b] that ends in most zeros in binary."""
    drop = F.length(F.bin(a.bitwiseXOR(b))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", b, drop), drop)


def _turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """c, piece, i (place from 1), turn (hash of role and text) and chars of every turn. Conversations are cut into
    pieces by ranges of rows, so one of many turns is spread over tasks; equal rows are told apart by where they stand."""
    parts = max(1, int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), F.monotonically_increasing_id().alias("row")
    )
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    hashed = F.md5(F.encode(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), "UTF-8"))
    ordered = scratch.settle(
        ordered.select("c", F.spark_partition_id().alias("piece"), F.monotonically_increasing_id().alias("at"), hashed.alias("turn"), F.length("text").cast("long").alias("chars"))
    )
    pieces = ordered.groupBy("c", "piece").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("c").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumn("before", before).select("c", "piece", "start", "before")
    return ordered.join(pieces.hint("merge"), ["c", "piece"]).select("c", "piece", (F.col("at") - F.col("start") + F.col("before") + 1).alias("i"), "turn", "chars")


def _rebuilt(turns: DataFrame, every: int, most: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(c, size) of every conversation, and (c, piece, depth, turn, chars) of its turns, the first h of them replaced by
    those of the conversation c - c % every; h is the checksum of c modulo `most`."""
    turns = scratch.settle(turns)
    own = turns.groupBy("c").agg(F.count(F.lit(1)).alias("own"))
    own = own.withColumns({"h": F.crc32(F.encode(F.col("c").cast("string"), "UTF-8")) % most, "base": F.col("c") - F.col("c") % every})
    first = turns.filter((F.col("i") < most) & (F.col("c") % every == 0)).groupBy(F.col("c").alias("base")).agg(F.sort_array(F.collect_list(F.struct("i", "turn", "chars"))).alias("first"))
    heads = own.join(first, "base", "left").withColumn("first", F.slice(F.coalesce("first", F.array().cast("array<struct<i:bigint,turn:string,chars:bigint>>")), F.lit(1), F.col("h").cast("int")))
    heads = scratch.settle(heads.withColumn("shift", F.size("first") - F.col("h")))
    given = heads.select("c", F.lit(-1).alias("piece"), F.posexplode("first").alias("pos", "x")).select("c", "piece", (F.col("pos") + 1).cast("long").alias("depth"), "x.turn", "x.chars")
    kept = turns.join(heads.select("c", "h", "shift").hint("merge"), "c").filter("i > h").select("c", "piece", (F.col("i") + F.col("shift")).alias("depth"), "turn", "chars")
    sizes = heads.select("c", (F.size("first") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("size"))
    return sizes, given.unionByName(kept)


def _prefixes(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """c, depth, key (of the prefix) and cum (its code points) of every prefix of every conversation."""
    digest = F.md5(F.encode(F.concat_ws(":", F.col("depth").cast("string"), "turn"), "UTF-8"))
    words = {f"s{k}": F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)}
    held = [*words, "chars"]
    rows = scratch.settle(rows.withColumns(words).drop("turn"))
    ends = rows.groupBy("c", "piece").agg(*(F.sum(x).alias(x) for x in held))
    earlier = Window.partitionBy("c").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("c", "piece", *(F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}_before") for x in held))
    so_far = Window.partitionBy("c", "piece").orderBy("depth")
    summed = rows.join(ends.hint("merge"), ["c", "piece"]).select("c", "depth", *((F.sum(x).over(so_far) + F.col(f"{x}_before")).alias(x) for x in held))
    key = F.unhex(F.md5(F.encode(F.concat_ws(":", "depth", *words), "UTF-8")))
    return scratch.settle(summed.select("c", "depth", key.alias("key"), F.col("chars").alias("cum")))


class Trie:
    """Compacted nodes, as a table: depth and key of the extent, parent (depth of the node above), rep (a conversation that
    goes through), f and f_key (the handle), c_key (the first prefix of the edge), p_key (the parent's extent)."""

    def __init__(self, prefixes: DataFrame, scratch: Scratch):
        self.prefixes, self.scratch, self.nodes = prefixes, scratch, None

    def _key(self, rows: DataFrame, c: str, depth: str, name: str, how: str = "left") -> DataFrame:
        """The rows with the key of the prefix of that length of conversation c (null: none so long)."""
        known = self.prefixes.select(F.col("c").alias("_c"), F.col("depth").alias("_depth"), F.col("key").alias(name))
        return rows.join(known.hint("merge"), (F.col(c) == F.col("_c")) & (F.col(depth) == F.col("_depth")), how).drop("_c", "_depth")

    def _exits(self, batch: DataFrame) -> DataFrame:
        """c, size, e (how many turns it shares with the trie), e_key and, where it leaves inside an edge, the node below
        (y_depth, y_key)."""
        scratch, nodes = self.scratch, self.nodes
        if nodes is None:
            none = F.lit(None)
            return batch.select("c", "size", F.lit(0).cast("long").alias("e"), _root().alias("e_key"), none.cast("long").alias("y_depth"), none.cast("binary").alias("y_key"))
        handles = nodes.select("f", F.col("f_key").alias("_key"), F.col("depth").alias("n_depth"), F.col("key").alias("n_key"), F.col("rep").alias("n_rep"))
        null = F.lit(None)
        at = batch.withColumns({"lo": F.lit(0).cast("long"), "hi": F.col("size"), "w_depth": F.lit(0).cast("long"), "w_key": _root(), "w_rep": null.cast("long"), "w_f": F.lit(0).cast("long")})
        done, fields = [], at.columns
        while True:
            done.append(at.filter("lo >= hi"))
            open_ = at.filter("lo < hi")
            if open_.isEmpty():
                break
            asked = self._key(open_.withColumn("f", _fattest(F.col("lo"), F.col("hi"))), "c", "f", "_key").join(handles.hint("merge"), ["f", "_key"], "left")
            hit = F.col("n_depth").isNotNull()
            asked = asked.select(
                "c", "size", F.when(hit, F.col("n_depth")).otherwise(F.col("lo")).alias("lo"), F.when(hit, F.col("hi")).otherwise(F.col("f") - 1).alias("hi"),
                *(F.when(hit, F.col(new)).otherwise(F.col(old)).alias(old) for new, old in (("n_depth", "w_depth"), ("n_key", "w_key"), ("n_rep", "w_rep"), ("f", "w_f"))),
            )
            at = scratch.settle(asked.select(*fields))
        found = done[0]
        for more in done[1:]:
            found = found.unionByName(more)
        found = self._key(found, "c", "w_depth", "at_key")
        whole = (F.col("w_depth") == 0) | F.coalesce(F.col("at_key") == F.col("w_key"), F.lit(False))
        found = self._key(found.withColumns({"whole": whole, "next": F.col("w_depth") + 1}), "c", "next", "next_key")
        child = nodes.select(F.col("parent").alias("w_depth"), F.col("c_key").alias("next_key"), F.col("depth").alias("y_depth"), F.col("key").alias("y_key"), F.col("rep").alias("y_rep"))
        found = found.join(child.hint("merge"), ["w_depth", "next_key"], "left")
        # a conversation that passes the whole extent may go on along the edge of a child whose handle it does not reach
        y = lambda child, own: F.when(F.col("whole"), F.col(child)).otherwise(F.col(own))
        found = found.select("c", "size", "whole", "w_depth", y("y_depth", "w_depth").alias("y_depth"), y("y_key", "w_key").alias("y_key"), y("y_rep", "w_rep").alias("y_rep"), "w_f")
        lo = F.when(~F.col("whole"), F.col("w_f")).when(F.col("y_depth").isNotNull(), F.col("w_depth") + 1).otherwise(F.col("w_depth"))
        at = found.withColumn("lo", lo).withColumn("hi", F.coalesce(F.least("size", "y_depth"), F.col("lo"))).drop("whole", "w_depth", "w_f")
        done, fields = [], at.columns
        while True:  # how far it goes along the edge
            done.append(at.filter("lo >= hi"))
            open_ = at.filter("lo < hi")
            if open_.isEmpty():
                break
            asked = self._key(self._key(open_.withColumn("mid", F.ceil((F.col("lo") + F.col("hi")) / 2)), "c", "mid", "x"), "y_rep", "mid", "z")
            same = F.coalesce(F.col("x") == F.col("z"), F.lit(False))
            asked = asked.withColumns({"lo": F.when(same, F.col("mid")).otherwise(F.col("lo")), "hi": F.when(same, F.col("hi")).otherwise(F.col("mid") - 1)})
            at = scratch.settle(asked.select(*fields))
        found = done[0]
        for more in done[1:]:
            found = found.unionByName(more)
        found = self._key(found.withColumn("e", F.col("lo")), "c", "e", "e_key").withColumn("e_key", F.coalesce("e_key", _root()))
        inside = lambda c: F.when(F.col("e") < F.col("y_depth"), F.col(c)).alias(c)
        return found.select("c", "size", "e", "e_key", inside("y_depth"), inside("y_key"))

    def insert(self, batch: DataFrame) -> None:
        """Insert conversations (c, size), all of them different."""
        scratch, old = self.scratch, self.nodes
        exits = scratch.settle(self._exits(batch))
        behind = self.prefixes.join(exits.select("c", "e").hint("merge"), "c").filter("depth > e").select("c", "depth", "key")
        rows = scratch.settle(behind.withColumn("leaves", F.lit(False)).unionByName(exits.select("c", F.col("e").alias("depth"), F.col("e_key").alias("key"), F.lit(True).alias("leaves"))))
        along = Window.partitionBy("c").orderBy("depth")
        rows = scratch.settle(rows.withColumn("next", F.lead("key").over(along)))
        stops = rows.filter("depth > 0").groupBy("depth", "key").agg(
            F.min("c").alias("rep"), F.max(F.col("next").isNull() | F.col("leaves")).alias("ends"), (F.min("next") != F.max("next")).alias("parts")
        )
        stops = scratch.settle(stops.filter(F.col("ends") | F.coalesce("parts", F.lit(False))).select("depth", "key", "rep"))
        path = rows.select("c", "depth", "key", "leaves").join(stops.select("depth", "key").hint("merge"), ["depth", "key"], "left_semi")
        path = path.unionByName(rows.filter("depth = 0").select("c", "depth", "key", "leaves")).withColumn("parent", F.lag("depth").over(along))
        fresh = path.filter("parent is not null").groupBy("depth", "key").agg(F.first("parent").alias("parent"), F.min("c").alias("rep"))
        if old is not None:
            # exits inside an edge cut it: the edge's node and its new nodes follow each other
            cut = exits.filter("y_depth is not null").groupBy("y_depth", "y_key", F.col("e").alias("depth"), F.col("e_key").alias("key")).agg(F.min("c").alias("rep"))
            cut = scratch.settle(cut.filter("depth > 0"))
            above = old.select(F.col("depth").alias("y_depth"), F.col("key").alias("y_key"), F.col("parent").alias("top"))
            lower = Window.partitionBy("y_depth", "y_key").orderBy("depth")
            placed = cut.join(above.hint("merge"), ["y_depth", "y_key"]).withColumn("parent", F.coalesce(F.lag("depth").over(lower), F.col("top")))
            moved = cut.groupBy(F.col("y_depth").alias("depth"), F.col("y_key").alias("key")).agg(F.max("depth").alias("moved"))
            kept = old.select("depth", "key", "parent", "rep").join(moved.hint("merge"), ["depth", "key"], "left")
            kept = kept.select("depth", "key", F.coalesce("moved", "parent").alias("parent"), "rep")
            known = kept.select("depth", "key")
            fresh = fresh.join(known.unionByName(placed.select("depth", "key")).hint("merge"), ["depth", "key"], "left_anti")
            fresh = kept.unionByName(placed.select("depth", "key", "parent", "rep")).unionByName(fresh)
        fresh = scratch.settle(fresh.select("depth", "key", "parent", "rep").withColumn("f", _fattest(F.col("parent"), F.col("depth"))))
        named = self._key(fresh, "rep", "f", "f_key").withColumn("below", F.col("parent") + 1)
        named = self._key(self._key(named, "rep", "below", "c_key"), "rep", "parent", "p_key")
        self.nodes = scratch.settle(named.withColumn("p_key", F.coalesce("p_key", _root())).drop("below"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined numbers of each key, whose rows follow each other in order; of any number."""
    last, state = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends"])

    for batch in batches:
        for key, c in zip(batch.column("key").to_pylist(), batch.column("c").to_pylist(), strict=True):
            if key != last or state is None:
                if state is not None:
                    yield out()
                last, state = key, hashlib.sha256(str(c).encode())
            else:
                state.update(f",{c}".encode())
    if state is not None:
        yield out()


def _statistics(trie: Trie, heads: DataFrame, scratch: Scratch) -> DataFrame:
    """For the extent of each compacted node and the root: depth, key, parent, p_key, rep, n (members), low (smallest
    one), total (code points of all members), leaves, below (code points of the distinct turns further down), children.

    heads: c, size, total, copies; one for each different conversation.
    """
    nodes = trie.nodes
    children = scratch.settle(nodes.groupBy(F.col("parent").alias("depth"), F.col("p_key").alias("key")).agg(F.count(F.lit(1)).alias("children")))
    nodes = scratch.settle(nodes.join(children.hint("merge"), ["depth", "key"], "left").withColumn("children", F.coalesce("children", F.lit(0))))
    rows = trie.prefixes.join(heads.hint("merge"), "c").join(nodes.select("depth", "key", "rep", "children").hint("merge"), ["depth", "key"])
    root = heads.join(F.broadcast(children.filter("depth = 0").agg(F.coalesce(F.max("children"), F.lit(0)).alias("children"))))
    none = F.lit(None).cast("long")
    root = root.select("c", F.lit(0).cast("long").alias("depth"), _root().alias("key"), F.lit(0).cast("long").alias("cum"), "size", "total", "copies", none.alias("rep"), "children")
    rows = rows.select(*root.columns).unionByName(root)
    along = Window.partitionBy("c").orderBy("depth")
    edge = F.when(F.col("rep") == F.col("c"), F.col("cum") - F.lag("cum").over(along)).otherwise(0)
    leaf = F.max(((F.col("depth") == F.col("size")) & (F.col("children") == 0)).cast("long")).over(Window.partitionBy("c"))
    rows = rows.withColumns({"edge": edge, "leaf": leaf})
    further = F.coalesce(F.sum("edge").over(along.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    rows = rows.withColumn("further", further)
    sums = rows.groupBy("depth", "key").agg(
        F.sum("copies").alias("n"), F.min("c").alias("low"), F.sum(F.col("copies") * F.col("total")).alias("total"), F.sum("leaf").alias("leaves"), F.sum("further").alias("below"), F.first("children").alias("children")
    )
    return sums.join(nodes.drop("children").hint("merge"), ["depth", "key"], "left")


def prefix_trie(conversations: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), then role and text, so repeated turns have an order; a null role or text is
    empty. Rows without a conv_id belong to no conversation and are left out. The first h turns of c are replaced by
    those of c - c % every (none if it is absent), h being the checksum of c modulo `most`. An empty table has no nodes.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    sizes, rows = _rebuilt(_turns(conversations, scratch), every, most, scratch)
    prefixes = _prefixes(rows, scratch)
    ends = prefixes.select("c", F.col("depth").alias("size"), "key", F.col("cum").alias("total"))
    whole = sizes.join(ends.hint("merge"), ["c", "size"], "left").withColumns({"key": F.coalesce("key", _root()), "total": F.coalesce("total", F.lit(0))})
    whole = scratch.settle(whole)
    heads = scratch.settle(whole.groupBy("size", "key").agg(F.min("c").alias("c"), F.first("total").alias("total"), F.count(F.lit(1)).alias("copies")).drop("key"))
    different = scratch.settle(prefixes.join(heads.select("c").hint("merge"), "c", "left_semi"))
    trie = Trie(different, scratch)
    slot, done = F.pmod(F.xxhash64("c"), F.lit(64)), 0
    for to in BATCHES:
        trie.insert(heads.filter((slot >= done) & (slot < to) & (F.col("size") > 0)).select("c", "size"))
        done = to
    nodes = scratch.settle(_statistics(trie, heads, scratch))
    digests = whole.select("key", "c").repartition("key").sortWithinPartitions("key", "c").mapInArrow(_digests, "key binary, ends string")
    above = nodes.select(F.col("depth").alias("parent"), F.col("key").alias("p_key"), F.col("low").alias("parent_low"))
    nodes = nodes.join(above.hint("merge"), ["parent", "p_key"], "left").join(digests.hint("merge"), "key", "left")
    # a turn on an edge has one child and no end; what is saved from it on follows from the extent
    levels = F.when(F.col("depth") > 0, F.sequence(F.col("parent") + 1, F.col("depth"))).otherwise(F.array(F.lit(0).cast("long")))
    each = nodes.withColumn("cum_end_depth", F.col("depth")).withColumn("d", F.explode(levels)).withColumn("d_before", F.col("d") - 1)
    cum = different.select(F.col("c").alias("rep"), F.col("depth").alias("_d"), F.col("cum").alias("_cum"))
    at = lambda rows, d, name: rows.join(cum.withColumnRenamed("_d", d).withColumnRenamed("_cum", name).hint("merge"), ["rep", d], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    each = at(at(each, "d_before", "before"), "cum_end_depth", "full")
    bottom = F.col("d") == F.col("depth")
    saved = F.col("total") - F.col("n") * F.col("before") - F.col("below") - (F.col("full") - F.col("before"))
    parent = F.when(F.col("d") == F.col("parent") + 1, F.col("parent_low")).when(F.col("d") > 0, F.col("low"))
    out = each.select(
        F.col("low").alias("conv_id"), F.col("d").alias("depth"), parent.alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(bottom, F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"),
        F.coalesce(F.when(bottom, F.col("ends")), F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    out = settle(out)
    scratch.drop()
    return out


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP12_SQL = """
WITH
crc(t) AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b::UBIGINT], range(8)::UBIGINT[]),
           lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END))),
turns AS MATERIALIZED (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
convs AS MATERIALIZED (SELECT c, c - c % 100 AS base, (xor(4294967295::UBIGINT, list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
           lambda acc, b: xor(acc >> 8, t[((xor(acc, b) & 255) + 1)::BIGINT]))) % 6)::BIGINT AS h FROM (SELECT DISTINCT c FROM turns), crc),
merged AS (SELECT v.c, t.i, t.role, t.text FROM convs v JOIN turns t ON t.c = v.base AND t.i <= v.h UNION ALL SELECT v.c, t.i + 1000000, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c AND t.i > v.h),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, length(text) AS chars, md5(length(role) || ':' || role || ':' || text) AS h FROM merged),
keyed AS MATERIALIZED (SELECT c, d, chars, string_agg(h, ',') OVER (PARTITION BY c ORDER BY d) AS k FROM placed UNION ALL SELECT c, 0, 0, '' FROM convs),
parents AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS pk, count(*) OVER (PARTITION BY c) - 1 = d AS ends FROM keyed),
nodes AS MATERIALIZED (SELECT d, k, min(pk) AS pk, min(c) AS low, count(*) AS n, min(chars) AS chars,
           sha256(coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends FROM parents GROUP BY d, k),
children AS (SELECT d - 1 AS d, pk AS k, count(*) AS m FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_nodes AS MATERIALIZED (SELECT n.*, coalesce(c.m, 0) AS m FROM nodes n LEFT JOIN children c ON n.d = c.d AND n.k = c.k),
sums AS (SELECT a.d, a.k, sum((w.n - 1) * w.chars)::BIGINT AS saved, count(*) FILTER (w.m = 0) AS leaves FROM full_nodes w JOIN keyed a ON a.c = w.low AND a.d <= w.d GROUP BY 1, 2)
SELECT n.low AS conv_id, n.d AS depth, p.low AS parent_conv_id, n.n AS n_convs, n.m AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, n.ends AS ends_sha256
FROM full_nodes n JOIN sums s ON n.d = s.d AND n.k = s.k LEFT JOIN nodes p ON p.d = n.d - 1 AND p.k = n.pk
"""
