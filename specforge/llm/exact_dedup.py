"""Exact duplicates by a Golomb-coded exchange of fingerprints.

Every input partition (a sender) sorts the 64-bit fingerprints of its texts, cuts them by range into one run for each
owner and sends the runs Golomb-Rice coded. An owner decodes the runs of its range and answers each with a bitmap that
says which fingerprints another sender has too. Only rows whose fingerprint occurs again (the suspects) have their whole
texts shuffled; grouping by the text itself, with partial aggregation on the map side, is the byte verification, so a
hash collision cannot join two texts and a text with millions of copies reaches the shuffle once for each map task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, fits, id_back, id_key, settle, shared_dir, text_of

#: Fingerprints an owner receives on average at most.
OWNER_ROWS = 500_000
#: Distinct suspect fingerprints that are broadcast at most (8 bytes each); beyond it the texts are joined by a shuffle.
BROADCAST_FINGERPRINTS = 1_000_000
#: Parts into which the copies of one text are dealt when they look up the row that stays.
SALTS = 16


def golomb_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Rice parameter, unary quotients and fixed-width remainders of the gaps between sorted uint64 values."""
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = int(values[-1]) // len(values) if len(values) else 0
    k = max(0, mean.bit_length() - 1)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    shifts = np.arange(k, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(rest).tobytes()


def golomb_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    gaps = quotients << np.uint64(k)
    bits = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * k).reshape(n, k)
    for j in range(k):
        gaps |= bits[:, j].astype(np.uint64) << np.uint64(j)
    return np.cumsum(gaps, dtype=np.uint64)


def _owner(values: np.ndarray, owners: int) -> np.ndarray:
    """Owners hold ranges of the fingerprints' upper 32 bits."""
    return ((values >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def _bases(owners: int) -> np.ndarray:
    """The smallest fingerprint of each owner, taken off before the gaps are coded."""
    return np.array([-(-(o << 32) // owners) << 32 for o in range(owners)], np.uint64)


def _send(owners: int):
    bases = _bases(owners)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for sender, rows in batch.groupby("sender"):
                held.setdefault(int(sender), []).append(np.unique(rows["fp"].to_numpy(np.int64).view(np.uint64)))
        for sender, parts in held.items():
            values = np.unique(np.concatenate(parts))
            cuts = np.searchsorted(_owner(values, owners), np.arange(owners + 1, dtype=np.uint64))
            rows = []
            for o in range(owners):
                run = values[cuts[o] : cuts[o + 1]]
                if len(run):
                    rows.append((o, sender, len(run), *golomb_encode(run - bases[o])))
            yield pd.DataFrame(rows, columns=["owner", "sender", "n", "k", "quotients", "remainders"])

    return send


def _own(runs: pd.DataFrame) -> pd.DataFrame:
    values = [golomb_decode(*x) for x in zip(runs["n"], runs["k"], runs["quotients"], runs["remainders"], strict=True)]
    seen, times = np.unique(np.concatenate(values), return_counts=True)
    again = seen[times > 1]
    bitmaps = [np.packbits(np.isin(v, again, assume_unique=True)).tobytes() for v in values]
    return pd.DataFrame({"owner": runs["owner"], "sender": runs["sender"], "bitmap": bitmaps})


def _flag(owners: int):
    def flag(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        fps = rows["fp"].to_numpy(np.int64).view(np.uint64)
        values, back, times = np.unique(fps, return_inverse=True, return_counts=True)
        cuts = np.searchsorted(_owner(values, owners), np.arange(owners + 1, dtype=np.uint64))
        again = times > 1
        for o, bitmap in zip(answers["owner"], answers["bitmap"], strict=True):
            n = cuts[o + 1] - cuts[o]
            again[cuts[o] : cuts[o + 1]] |= np.unpackbits(np.frombuffer(bitmap, np.uint8), count=n).astype(bool)
        return rows.assign(suspect=again[back])

    return flag


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, sha (of the text), keep_id, group_size, kept.

    Texts are equal when their bytes are; a null text is the empty text. Of equal texts the row with the largest id
    stays; a null id is smaller than any other. Of rows that repeat both id and text exactly one is kept. An empty
    table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    base = docs.select(id_key(id_col).alias("did"), text_of(text_col).alias("text"))
    rows = base.select(
        "did",
        F.xxhash64("text").alias("fp"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
        F.spark_partition_id().alias("sender"),
        F.monotonically_increasing_id().alias("rid"),
    ).checkpoint()
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / OWNER_ROWS))
    runs = rows.select("sender", "fp").mapInPandas(
        _send(owners), "owner int, sender int, n int, k int, quotients binary, remainders binary"
    )
    answers = runs.groupBy("owner").applyInPandas(_own, "owner int, sender int, bitmap binary")
    flagged = settle(
        rows.groupBy("sender")
        .cogroup(answers.groupBy("sender"))
        .applyInPandas(_flag(owners), "did long, fp long, sha string, sender int, rid long, suspect boolean")
        .drop("sender")
    )
    suspects = flagged.filter("suspect")
    wanted = suspects.select("fp").distinct()
    if fits(wanted, BROADCAST_FINGERPRINTS):
        wanted = F.broadcast(wanted)
    groups = (
        base.withColumn("fp", F.xxhash64("text"))
        .join(wanted, "fp", "left_semi")
        .groupBy("text")
        .agg(F.max("did").alias("keep_did"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select(F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "keep_did", "group_size")
    )
    keepers = (
        suspects.join(groups, (suspects["sha"] == groups["sha"]) & (suspects["did"] == groups["keep_did"]))
        .groupBy(groups["sha"])
        .agg(F.min("rid").alias("keep_rid"), F.first("keep_did").alias("keep_did"), F.first("group_size").alias("group_size"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    looked_up = suspects.withColumn("salt", F.pmod("rid", F.lit(SALTS)).cast("int")).join(keepers, ["sha", "salt"], "left")
    alone = F.lit(None).cast("long")
    return (
        flagged.filter("not suspect")
        .select("did", "sha", "rid", alone.alias("keep_rid"), alone.alias("keep_did"), alone.alias("group_size"))
        .unionByName(looked_up.select("did", "sha", "rid", "keep_rid", "keep_did", "group_size"))
        .select(
            id_back("did").alias("doc_id"),
            "sha",
            F.when(F.col("keep_rid").isNull(), id_back("did")).otherwise(id_back("keep_did")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            F.coalesce(F.col("rid") == F.col("keep_rid"), F.lit(True)).alias("kept"),
        )
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without repeats of a text; the columns stay as they are."""
    did, sha = aside(docs.columns, "did", "sha")
    kept = mark(docs).filter("kept").select(id_key().alias(did), F.col("sha").alias(sha))
    keyed = docs.withColumns({did: id_key(), sha: F.sha2(text_of().cast("binary"), 256)})
    return keyed.join(kept, [did, sha], "left_semi").dropDuplicates([did, sha]).select(*docs.columns)


def op8_exact_dedup(spark, sf_dir):
    from .common import documents

    return mark(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )


OP8_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
