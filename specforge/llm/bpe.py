"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

A text is cut by the vocabulary's pattern, and every match is merged by itself. The pending pairs of a match stand in a
segment tree over its byte positions: a node holds the smallest pair rank below it with the leftmost position, so the
root is the next merge, and a merge changes three leaves (the pair, its left and its right neighbour), each in
logarithmic time. A node has FAN children, so that a short match is a root over its leaves.
One match of n bytes takes O(n log n), however long it is.

Most of the time goes to short matches that were not seen before. Those of a piece of the texts are merged together: a
column of an array holds the leaves of one match, and each round makes the next merge of every match at its root.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches, text_of

#: Encoded matches that a Python worker remembers, of so many characters at most (some 15 MB), besides those of the texts
#: it is at; beyond it, it forgets the oldest of the others.
REMEMBERED, LONGEST = 80_000, 32
#: Characters of texts encoded at once.
PIECE = 1 << 20
#: Children of a node of the segment tree.
FAN_BITS = 4
FAN = 1 << FAN_BITS
#: Short matches merged at once.
TOGETHER = 4096
_NONE = 1 << 62
_NO_PAIR = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of one match."""
    if piece in ranks:
        return [ranks[piece]]
    n, get = len(piece), ranks.get
    after = list(range(1, n + 1))  # start of the part behind the one that starts here
    before = list(range(-1, n - 1))
    leaves = [_NONE] * n
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            leaves[i] = rank << 32 | i
    levels = [leaves]  # leaves first, the root's children last
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[k : k + FAN]) for k in range(0, len(below), FAN)])
    top, inner = levels[-1], levels[1:]
    while (least := min(top)) != _NONE:
        i = least & 0xFFFFFFFF
        j = after[i]  # the part at j joins the one at i
        k = after[i] = after[j]
        leaves[i] = leaves[j] = _NONE
        if k < n:
            before[k] = i
            rank = get(piece[i : after[k]])
            if rank is not None:
                leaves[i] = rank << 32 | i
        h = before[i]
        if h >= 0:
            rank = get(piece[h:k])
            leaves[h] = _NONE if rank is None else rank << 32 | h
        if inner:
            changed, below = {max(h, 0), i, j}, leaves
            for level in inner:
                changed = {at >> FAN_BITS for at in changed}
                for at in changed:
                    level[at] = min(below[at << FAN_BITS : (at + 1) << FAN_BITS])
                below = level
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Pairs:
    """Ranks of the pairs of tokens that make a token, by any cut of it."""

    def __init__(self, ranks: dict[bytes, int]):
        get = ranks.get
        found = [(a << 32 | b, rank) for token, rank in ranks.items() for k in range(1, len(token)) if (a := get(token[:k])) is not None and (b := get(token[k:])) is not None]
        table = np.array(sorted(found), np.int64).reshape(-1, 2)
        self.keys, self.ranks = np.append(table[:, 0], _NONE), np.append(table[:, 1], _NO_PAIR).astype(np.int32)
        self.bytes = np.array([get(bytes([c]), -1) for c in range(256)], np.int32)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NO_PAIR for none; a negative id stands for no token."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], _NO_PAIR)


def merge_short(pieces: list[bytes], pairs: Pairs) -> list[bytes]:
    """The ids of matches of at most FAN bytes, as packed 32-bit integers: `merge` for all of them at once."""
    n, size = np.array([len(p) for p in pieces]), len(pieces)
    place = np.arange(FAN)[:, None]
    after = np.minimum(place + 1, n).ravel()  # start of the part behind the one that starts here
    before = np.repeat(np.arange(-1, FAN - 1), size)
    parts = np.full((FAN + 1, size), -1, np.int32)  # nothing stands behind the last part
    parts[:FAN] = pairs.bytes[np.array(pieces, f"S{FAN}").view(np.uint8).reshape(size, FAN).T]
    parts[:FAN][place >= n] = -1
    leaves = np.full((FAN, size), _NO_PAIR)
    for i in range(FAN - 1):
        rank = pairs(parts[i], parts[i + 1])
        leaves[i] = np.where(rank == _NO_PAIR, _NO_PAIR, rank << FAN_BITS | i)
    part, leaf, columns = parts.reshape(-1), leaves.reshape(-1), np.arange(size)
    while True:
        least = (leaves if len(columns) == size else leaves[:, columns]).min(axis=0)
        going = least != _NO_PAIR
        columns, least = columns[going], least[going]
        if not len(columns):
            break
        at = (least & (FAN - 1)) * size + columns
        j = after[at]  # the part at j joins the one at i
        behind = j * size + columns
        k = after[behind]
        after[at] = k
        part[at], part[behind], leaf[behind] = least >> FAN_BITS, -1, _NO_PAIR
        inside = np.flatnonzero(k < FAN)
        before[k[inside] * size + columns[inside]] = least[inside] & (FAN - 1)
        rank = pairs(part[at], part[k * size + columns])
        leaf[at] = np.where(rank == _NO_PAIR, _NO_PAIR, rank << FAN_BITS | least & (FAN - 1))
        h = before[at]
        first = np.flatnonzero(h >= 0)
        left = h[first] * size + columns[first]
        rank = pairs(part[left], part[at[first]])
        leaf[left] = np.where(rank == _NO_PAIR, _NO_PAIR, rank << FAN_BITS | h[first])
    ids = parts[:FAN].T
    cuts = np.cumsum([0, *(ids >= 0).sum(axis=1) * 4]).tolist()
    packed = ids[ids >= 0].tobytes()
    return [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class Encoder:
    """Encodes lists of texts and remembers matches with their ids as packed 32-bit integers."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pairs = Pairs(self.ranks)
        self.short = FAN if self.pairs.bytes.min() >= 0 else 0  # a part that is no token has no pairs
        self.find = regex.compile(pattern).findall
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.known: dict[str, bytes] = {}

    def learn(self, matches: list[str]) -> None:
        short, pieces = [], []
        for match in matches:
            piece = match.encode("utf-8", "surrogatepass")
            if len(piece) > self.short or piece in self.ranks:
                self.known[match] = np.array(merge(piece, self.ranks), np.int32).tobytes()
            else:
                short.append(match)
                pieces.append(piece)
        for a in range(0, len(short), TOGETHER):
            self.known.update(zip(short[a : a + TOGETHER], merge_short(pieces[a : a + TOGETHER], self.pairs), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        found = [self.find(t) for t in texts]
        here = set(chain.from_iterable(found))
        new = [m for m in here if m not in self.known]
        if (over := len(self.known) + len(new) - REMEMBERED) > 0:  # those not met here go, the oldest first
            others = [m for m in self.known if m not in here]
            seen = {m: self.known[m] for m in self.known if m in here}
            self.known = {m: self.known[m] for m in others[over:]} | seen
        self.learn(new)
        packed = [b"".join(map(self.known.__getitem__, matches)) for matches in found]
        for match in new:
            if len(match) > LONGEST:
                del self.known[match]
        return packed

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows, so many characters of texts (or ids) at once; a longer one is by itself."""
    column = batch.column(1)
    sizes = np.diff(column.offsets.to_numpy()) if pa.types.is_list(column.type) else pc.utf8_length(column).to_numpy()
    part = np.cumsum(sizes) // PIECE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _encoded(encoder: Encoder, texts: list[str]) -> pa.ListArray:
    packed = encoder.encode(texts)
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _decoded(encoder: Encoder, ids: pa.ListArray) -> pa.Array:
    values, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    return pa.array([encoder.decode(values[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int), one row for each input row; a null or empty text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for part in (part for batch in batches for part in _parts(batch)):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _encoded(encoder, part.column("text").to_pylist())], names=["doc_id", "ids"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and content (binary), the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for part in (part for batch in batches for part in _parts(batch)):
            ids = part.column("ids")
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, _decoded(encoder, ids)], names=["doc_id", "ids", "content"])

    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, content binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What `decode` makes of `encode`, in one step, so that a core has one Python worker with one vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for part in (part for batch in batches for part in _parts(batch)):
            ids = _encoded(encoder, part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, _decoded(encoder, ids)], names=["doc_id", "ids", "content"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, content binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes."""
    return round_trip(docs, path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("content", 256).alias("decoded_sha256"),
    )


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op7_bpe(spark, sf_dir):
    return digests(documents(spark, sf_dir), *public_vocabulary())
