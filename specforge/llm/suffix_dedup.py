"""Repeated substrings by a distributed merge sort of suffixes that never compares a known prefix again.

A string of LENGTH bytes contains LENGTH - ANCHOR + 1 anchors (substrings of ANCHOR bytes); the leftmost one with the
smallest hash represents it, so equal strings are represented at the same place in them. Only these anchors' suffixes
are sorted, about one in thirty bytes, and only where an anchor occurs again at all:

1. Blocks of documents send their anchors' fingerprints, Golomb coded, to owners, and get bitmaps of those that repeat.
2. A block sorts the suffixes at its repeating anchors and sends them, front-coded, to owners by fingerprint; of equal
   pieces of one block only the first is sent. An anchor that many blocks have (a line of many documents) is hot: its
   strings are cut into classes by their reach to the left, and each class is dealt by the bytes that all its strings
   hold, so that pieces meet only where they agree in nearly a whole string.
3. An owner merges the sorted runs with a loser tree whose matches start from the known common prefixes, which leaves
   the suffixes in order with the common prefix of neighbours. Strings that reach o bytes left of the anchor are equal
   where neighbours share LENGTH - o bytes to the right and have the same o bytes to the left; all but the first in
   order of (document, position) are repeats. Nothing is taken as equal by its hash.
4. Blocks mark the repeats' bytes and cut them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, id_back, id_key, text_of
from .exact_dedup import _bases, _owner, golomb_decode, golomb_encode
from .links import mix
from .paragraphs import sliding, window_hashes

LENGTH, ANCHOR = 100, 40
#: Bytes of a block, least and most; between them there are BLOCKS blocks.
LEAST_BYTES, MOST_BYTES, BLOCKS = 2 << 20, 32 << 20, 2000
#: An anchor of more blocks than this is hot; a class holds the strings of so many neighbouring reaches.
HOT_BLOCKS, CLASS = 16, 15
#: Bytes of blocks that a task works on, one after another.
TASK_BYTES = 64 << 20
_SLICE = 1 << 18
_BYTE = np.random.default_rng(1).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64((1 << 20) - 1)


class Block:
    """The documents of a block, in order of (id, text), as one run of bytes."""

    def __init__(self, table: pa.Table):
        ids, texts = table.column("did").to_pylist(), table.column("content").to_pylist()
        order = sorted(range(len(ids)), key=lambda r: (ids[r], texts[r]))
        self.ids = np.array([ids[r] for r in order], np.int64)
        texts = [texts[r] for r in order]
        self.ends = np.cumsum([len(t) for t in texts]) if texts else np.empty(0, np.int64)
        self.text = b"".join(texts)
        self.bytes = np.frombuffer(self.text, np.uint8)

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each representing anchor: its place, the first and last start of the strings it represents, and its
        fingerprint."""
        out = []
        n = len(self.bytes)
        anchors = LENGTH - ANCHOR + 1
        for a in range(0, max(0, n - LENGTH + 1), _SLICE):
            b = min(a + _SLICE, n - LENGTH + 1)
            hashes = window_hashes(_BYTE[self.bytes[a : b + LENGTH - 1]], ANCHOR)
            placed = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
            least = (sliding(placed, anchors, np.minimum) & _PLACE).astype(np.int64)
            starts = np.arange(a, b)
            inside = np.flatnonzero(self.ends[np.searchsorted(self.ends, starts, "right")] - starts >= LENGTH)
            if not len(inside):
                continue
            at = least[inside]
            cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(inside) != 1)) + 1
            first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(at)])) - 1
            place = at[first]
            out.append((place + a, inside[first] + a, inside[last] + a, hashes[place]))
        if not out:
            return *(np.empty(0, np.int64),) * 3, np.empty(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _fingerprints(owners: int):
    bases = _bases(owners)
    schema = pa.schema([("owner", pa.int32()), ("sender", pa.int32()), ("n", pa.int32()), ("k", pa.int32()), ("quotients", pa.binary()), ("remainders", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        values = np.unique(Block(table).pieces()[3])
        cuts = np.searchsorted(_owner(values, owners), np.arange(owners + 1, dtype=np.uint64))
        rows = []
        for o in range(owners):
            part = values[cuts[o] : cuts[o + 1]]
            if len(part):
                k, quotients, remainders = golomb_encode(part - bases[o])
                rows.append({"owner": o, "sender": block, "n": len(part), "k": k, "quotients": quotients, "remainders": remainders})
        return pa.Table.from_pylist(rows, schema)

    return run


def _pack(*arrays: np.ndarray) -> bytes:
    packer = zstandard.ZstdCompressor(level=1)
    parts = [packer.compress(np.ascontiguousarray(a).tobytes()) for a in arrays]
    return np.array([len(p) for p in parts], np.int32).tobytes() + b"".join(parts)


def _unpack(blob: bytes, *types) -> list[np.ndarray]:
    sizes = np.frombuffer(blob[: 4 * len(types)], np.int32)
    ends = 4 * len(types) + np.cumsum(sizes)
    unpacker = zstandard.ZstdDecompressor()
    return [np.frombuffer(unpacker.decompress(blob[e - s : e]), t) for s, e, t in zip(sizes, ends, types, strict=True)]


_RUN = (np.int64, np.int64, np.uint8, np.uint8, np.uint8, np.uint8, np.uint8)
_FOUND = pa.schema([("owner", pa.int32()), ("block", pa.int32()), ("run", pa.binary())])


def front_code(block: Block, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> bytes:
    """A sorted, front-coded run of pieces: ids, places, strings' reach to the left (most, least), common prefix with
    the suffix before, the rest of the suffixes, the bytes left of the anchors."""
    right = [block.text[p : h + LENGTH] for p, h in zip(place.tolist(), high.tolist(), strict=True)]
    order = sorted(range(len(right)), key=right.__getitem__)
    right = [right[r] for r in order]
    place, low, high = place[order], low[order], high[order]
    sizes = np.array([len(r) for r in right])
    padded = np.frombuffer(b"".join(r.ljust(LENGTH, b"\0") for r in right), np.uint8).reshape(-1, LENGTH)
    same = np.cumprod(padded[1:] == padded[:-1], axis=1, dtype=np.uint8).sum(1, dtype=np.int64)
    common = np.concatenate(([0], np.minimum(same, np.minimum(sizes[1:], sizes[:-1]))))
    column = np.arange(LENGTH)
    rest = padded[(column >= common[:, None]) & (column < sizes[:, None])]
    left = np.frombuffer(b"".join(block.text[a:p] for a, p in zip(low.tolist(), place.tolist(), strict=True)), np.uint8)
    ids = block.ids[np.searchsorted(block.ends, place, "right")]
    return _pack(ids, place, (place - low).astype(np.uint8), (place - high).astype(np.uint8), common.astype(np.uint8), rest, left)


def _send(owners: int):
    def run(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _FOUND.empty_table()
        number = table.column("block")[0].as_py()
        block = Block(table)
        place, low, high, fp = block.pieces()
        values, back, times = np.unique(fp, return_inverse=True, return_counts=True)
        cuts = np.searchsorted(_owner(values, owners), np.arange(owners + 1, dtype=np.uint64))
        again, hot = times > 1, np.zeros(len(values), bool)
        for o, bitmap, heat in zip(*(answers.column(c).to_pylist() for c in ("owner", "bitmap", "hot")), strict=True):
            for flags, bits in ((again, bitmap), (hot, heat)):
                flags[cuts[o] : cuts[o + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=cuts[o + 1] - cuts[o]).astype(bool)
        keep = np.flatnonzero(again[back])
        place, low, high, fp, hot = place[keep], low[keep], high[keep], fp[keep], hot[back][keep]
        # pieces are in order of (document, place): the first of equal ones stays, the others repeat it
        seen: set = set()
        first = np.zeros(len(place), bool)
        for r, (a, p, h) in enumerate(zip(low.tolist(), place.tolist(), high.tolist(), strict=True)):
            piece = (p - a, block.text[a : h + LENGTH])
            if piece not in seen:
                seen.add(piece)
                first[r] = True
        rows = []
        rest = ~first
        if rest.any():
            bits = _bits(place[rest] - high[rest], place[rest] - low[rest])
            rows.append({"owner": -1 - number, "block": number, "run": _pack(place[rest], bits)})
        place, low, high, fp, hot = place[first], low[first], high[first], fp[first], hot[first]
        place, low, high, fp = _classed(block, place, low, high, fp, hot)
        owner = (mix(fp) % np.uint64(owners)).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(owners + 1))
        for o in np.unique(owner).tolist():
            part = order[cuts[o] : cuts[o + 1]]
            rows.append({"owner": o, "block": number, "run": front_code(block, place[part], low[part], high[part])})
        return pa.Table.from_pylist(rows, _FOUND)

    return run


def _classed(block: Block, place: np.ndarray, low: np.ndarray, high: np.ndarray, fp: np.ndarray, hot: np.ndarray) -> tuple:
    """The pieces, those of hot anchors cut into classes of reaches, with what deals each: the fingerprint, or for a class
    a hash of the bytes that its strings share."""
    cold = ~hot
    out = [(place[cold], low[cold], high[cold], fp[cold])]
    place, low, high = place[hot], low[hot], high[hot]
    for k in range(0, LENGTH - ANCHOR + 1, CLASS):
        a, b = np.maximum(low, place - (k + CLASS - 1)), np.minimum(high, place - k)
        some = np.flatnonzero(a <= b)
        shared = (block.text[p - k : p - k + LENGTH - CLASS + 1] for p in place[some].tolist())
        dealt = np.fromiter((xxhash.xxh64_intdigest(s, k) for s in shared), np.uint64, len(some))
        out.append((place[some], a[some], b[some], dealt))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _answer(runs: pd.DataFrame) -> pd.DataFrame:
    """For each run of an owner which of its fingerprints other blocks have, too, and which many have."""
    values = [golomb_decode(*x) for x in zip(runs["n"], runs["k"], runs["quotients"], runs["remainders"], strict=True)]
    seen, times = np.unique(np.concatenate(values), return_counts=True)
    among = lambda kept: [np.packbits(np.isin(v, kept, assume_unique=True)).tobytes() for v in values]
    return pd.DataFrame({"owner": runs["owner"], "block": runs["sender"], "bitmap": among(seen[times > 1]), "hot": among(seen[times > HOT_BLOCKS])})


def _bits(least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Masks with the bits least..most set."""
    ones = ~np.uint64(0)
    return (ones << least.astype(np.uint64)) & (ones >> (np.uint64(63) - most.astype(np.uint64)))


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that share `known` bytes."""
    low, high = known, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs (strings, common prefix of each with the one before): the run that each output string comes
    from, and its common prefix with the output before.

    A head carries its common prefix with the last output. In a match the head with the longer one is smaller; only
    heads with equal ones are compared, from there on, and the loser takes the common prefix with the winner.
    """
    k = 1 << max(0, len(runs) - 1).bit_length()
    strings = [r[0] for r in runs] + [[]] * (k - len(runs))
    prefixes = [r[1] for r in runs] + [[]] * (k - len(runs))
    at = [0] * k
    head: list[bytes | None] = [s[0] if s else None for s in strings]
    known = [0] * k
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = head[a], head[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        p, q = known[a], known[b]
        if p > q:
            return a, b
        if q > p:
            return b, a
        c = _common(x, y, p)
        if c == len(x) == len(y):
            known[max(a, b)] = c
            return (a, b) if a < b else (b, a)
        if x[c : c + 1] < y[c : c + 1]:
            known[b] = c
            return a, b
        known[a] = c
        return b, a

    winners = list(range(k))
    while len(winners) > 1:
        half = len(winners) // 2
        played = [play(winners[2 * i], winners[2 * i + 1]) for i in range(half)]
        for i, (_, lost) in enumerate(played):
            loser[half + i] = lost
        winners = [won for won, _ in played]
    won = winners[0]
    source, common = [], []
    while head[won] is not None:
        source.append(won)
        common.append(known[won])
        i = at[won] = at[won] + 1
        if i < len(strings[won]):
            head[won], known[won] = strings[won][i], prefixes[won][i]
        else:
            head[won] = None
        node = (k + won) // 2
        while node:
            won, loser[node] = play(won, loser[node])
            node //= 2
    return source, common


def _decode(blob: bytes) -> tuple:
    ids, place, most, least, common, rest, left = _unpack(blob, *_RUN)
    strings, text, done, before = [], rest.tobytes(), 0, b""
    prefixes = common.tolist()
    for c, o in zip(prefixes, least.tolist(), strict=True):
        n = LENGTH - o - c
        before = before[:c] + text[done : done + n]
        done += n
        strings.append(before)
    return strings, prefixes, ids, place, most.astype(np.int64), least.astype(np.int64), left


def _settle_group(table: pa.Table) -> pa.Table:
    """What step 3 does with the runs of one owner."""
    owner = table.column("owner")[0].as_py()
    blocks, blobs = table.column("block").to_pylist(), table.column("run").to_pylist()
    if owner < 0:  # repeats within a block, on their way back
        return table.select(["block", "run"])
    runs = [_decode(b) for b in blobs]
    source, common = merge_runs([(r[0], r[1]) for r in runs])
    sizes = np.array([len(r[0]) for r in runs])
    source, common = np.array(source), np.array(common)
    offset = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    merged = np.empty(len(source), np.int64)  # the row, in input order, of each output
    merged[np.argsort(source, kind="stable")] = np.arange(len(source))
    ids, place, most, least = (np.concatenate([r[i] for r in runs])[merged] for i in (2, 3, 4, 5))
    from_left = np.concatenate([r[6] for r in runs])
    left_end = np.cumsum(np.concatenate([r[4] for r in runs]))[merged]
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((place, ids))] = np.arange(len(ids))
    behind = np.zeros(len(ids), np.int64)  # number of the bytes left of the anchor, the same for the same bytes
    masks = np.zeros(len(ids), np.uint64)
    for o in range(LENGTH - ANCHOR + 1):
        if o:
            far = np.flatnonzero(most >= o)
            _, behind[far] = np.unique(behind[far] << 8 | from_left[left_end[far] - o], return_inverse=True)
        here = np.flatnonzero((least <= o) & (o <= most))
        if len(here) < 2:
            continue
        group = np.cumsum(common < LENGTH - o)[here]
        left = behind[here]
        order = np.lexsort((rank[here], left, group))
        same = (left[order][1:] == left[order][:-1]) & (group[order][1:] == group[order][:-1])
        repeat = np.concatenate(([False], same))
        masks[here[order[repeat]]] |= np.uint64(1 << o)
    run = np.searchsorted(offset, merged, "right") - 1
    rows = []
    for r in np.unique(run[masks > 0]).tolist():
        mine = (run == r) & (masks > 0)
        rows.append({"block": blocks[r], "run": _pack(place[mine], masks[mine])})
    return pa.Table.from_pylist(rows, pa.schema([("block", pa.int32()), ("run", pa.binary())]))


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_CUT = pa.schema([("did", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(_SPAN)), ("kept", pa.binary())])


def _cut(key, table: pa.Table, found: pa.Table) -> pa.Table:
    if not table.num_rows:
        return _CUT.empty_table()
    block = Block(table)
    n = len(block.bytes)
    starts = np.zeros(n + 1, bool)
    for blob in found.column("run").to_pylist():
        place, masks = _unpack(blob, np.int64, np.uint64)
        for o in range(LENGTH - ANCHOR + 1):
            starts[place[(masks >> np.uint64(o)) & np.uint64(1) == 1] - o] = True
    at = np.flatnonzero(starts)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + LENGTH, -1)
    gone = np.cumsum(change)[:n] > 0
    rows = []
    begin = 0
    for did, end in zip(block.ids.tolist(), block.ends.tolist(), strict=True):
        mine = gone[begin:end]
        edges = np.diff(np.concatenate(([0], mine.view(np.int8), [0])))
        spans = [{"start": a, "end": b} for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True)]
        rows.append({"did": did, "n_bytes": end - begin, "spans": spans, "kept": block.bytes[begin:end][~mine].tobytes()})
        begin = end
    return pa.Table.from_pylist(rows, _CUT)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (array of start and end in bytes, removed) and kept (the remaining bytes).

    A byte is removed if a string of LENGTH bytes that covers it also starts earlier, in a document with a smaller id or
    before it in the same one; strings do not cross documents, and are judged on the input. A null text is empty. A
    null id is smaller than any other; rows that share an id are in order of their texts. Every row gives one row.
    Other columns are not read.
    """
    spark = docs.sparkSession
    base = docs.select(id_key().alias("did"), F.encode(text_of(), "utf-8").alias("content"))
    size = base.agg(F.coalesce(F.sum(F.length("content")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / min(max(size / BLOCKS, LEAST_BYTES), MOST_BYTES)))
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks // 4)
    # as many tasks as the bytes need, however few partitions a shuffle has by itself
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TASK_BYTES))
    dealt = base.withColumn("block", F.pmod(F.xxhash64("did"), F.lit(blocks)).cast("int")).repartition(parts, "block")
    runs = dealt.groupBy("block").applyInArrow(
        _fingerprints(owners), "owner int, sender int, n int, k int, quotients binary, remainders binary"
    )
    answers = runs.groupBy("owner").applyInPandas(_answer, "owner int, block int, bitmap binary, hot binary")
    sent = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_send(owners), "owner int, block int, run binary")
    found = sent.repartition(parts, "owner").groupBy("owner").applyInArrow(_settle_group, "block int, run binary")
    cut = dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        _cut, "did long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    )
    return cut.select(id_back("did").alias("doc_id"), "n_bytes", "spans", "kept")


def op1_suffix_dedup(spark, sf_dir):
    removed = F.col("n_bytes") - F.length("kept")
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )

