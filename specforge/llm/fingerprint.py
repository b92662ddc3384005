"""Document fingerprints by consistent weighted sampling, in DataFrame expressions only.

The terms of a text are its words (ASCII lower case), weighted by how often they occur. For each of REPS independent
draws a term falls into one of BINS registers by its hash, and there it makes the gamma-based sample of improved
consistent weighted sampling: with r, c ~ Gamma(2, 1) and b ~ U(0, 1) from the term's hash and weight w,
t = floor(ln w / r + b), ln y = r (t - b), ln a = ln c - ln y - r. The register keeps the (term, t) of the smallest a.
Two texts agree in a register that one of them fills with probability equal to the generalised Jaccard similarity
sum(min(w)) / sum(max(w)) of the terms that fall there, so the share of agreements estimates that of the texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, documents, id_back, id_key, settle, text_of

REPS, BINS = 8, 32
#: A term's weight is cut into parts of at most so much, each a term of its own. Minima and maxima of weights add up over
#: the parts, so the similarity stays the same, and a frequent word does not count as one register's worth.
PART = 2
#: Rows of a partition, on average at most.
PART_ROWS = 2048
#: Rows of a bucket; neighbours in the order of ids are looked up within a bucket.
BUCKET_ROWS = 512
#: Bits of a place within a range of ids.
PLACE = 33
#: Characters of a text that order rows of one id.
KEY = 64
_SIG, _Q = 12, 44
_PLACES = (1 << PLACE) - 1


def _samples(terms: DataFrame, keys: list[str]) -> DataFrame:
    """keys, register and v for each term and draw; v packs a (44 bits) over the hash of (term, t) (12 bits)."""
    low = lambda x: (F.col(x).bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(0.5)) / F.lit(2.0**32)
    high = lambda x: (F.shiftrightunsigned(x, 32) + F.lit(0.5)) / F.lit(2.0**32)
    return (
        terms.select(*keys, "term", F.log("weight").alias("ln_w"), F.explode(F.array(*map(F.lit, range(REPS)))).alias("rep"))
        .select("*", *(F.xxhash64("term", F.col("rep") * 3 + i).alias(f"h{i}") for i in range(3)))
        .select("*", (-F.log(low("h0") * high("h0"))).alias("r"), F.log(-F.log(low("h1") * high("h1"))).alias("ln_c"), high("h2").alias("b"))
        .withColumn("t", F.floor(F.col("ln_w") / F.col("r") + F.col("b")))
        .withColumn("ln_a", F.col("ln_c") - F.col("r") * (F.col("t") - F.col("b")) - F.col("r"))
        .select(
            *keys,
            (F.col("rep") * BINS + F.pmod(F.col("h2").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(BINS)).cast("int")).alias("register"),
            F.shiftleft(F.least(F.greatest(F.floor((F.col("ln_a") + 64.0) * F.lit(2.0 ** (_Q - 7))), F.lit(0)), F.lit(2**_Q - 1)).cast("long"), _SIG)
            .bitwiseOR(F.xxhash64("term", "t", "rep").bitwiseAND(F.lit(2**_SIG - 1)))
            .alias("v"),
        )
    )


def _registers(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, registers: sorted array of register * 4096 + hash. Texts (keys, t) without words have no row."""
    words = F.explode(F.split(ascii_lower(F.col("t")), r"[\x20\x09-\x0D]+")).alias("word")
    terms = (
        texts.select(*keys, words)
        .filter("word != ''")
        .select(*keys, F.xxhash64("word").alias("term"))
        .groupBy(*keys, "term")
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    part = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("weight") - 1).cast("long"), F.lit(PART).cast("long")))
    terms = terms.select(*keys, "term", "weight", part.alias("part")).select(
        *keys,
        F.xxhash64("term", "part").alias("term"),
        F.least(F.col("weight") - F.col("part"), F.lit(PART)).cast("double").alias("weight"),
    )
    least = _samples(terms, keys).groupBy(*keys, "register").agg(F.min("v").alias("v"))
    value = F.col("register").cast("long") * F.lit(2**_SIG) + F.col("v").bitwiseAND(F.lit(2**_SIG - 1))
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("registers"))


def likeness(a: str, b: str) -> Column:
    """Share of the registers that either text fills where both hold the same; 1 for two texts without words."""
    a, b = (F.coalesce(F.col(x), F.array().cast("array<long>")) for x in (a, b))
    place = lambda x: F.transform(x, lambda v: F.shiftright(v, _SIG))
    both, filled = F.size(F.array_intersect(a, b)), F.size(F.array_union(place(a), place(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(both / F.greatest(filled, F.lit(1)))


def as_text(registers: str) -> Column:
    """Five hexadecimal digits for each filled register: its number and what it holds."""
    digits = F.transform(registers, lambda v: F.lower(F.lpad(F.hex(v), 5, "0")))
    return F.coalesce(F.array_join(digits, ""), F.lit(""))


def fingerprints(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """key, registers and fingerprint of every text, for any table with a unique key; a text without words has no
    registers, and a null text is empty. Other columns are not read."""
    rows = docs.select(F.col(key).alias("key"), text_of(text_col).alias("t"))
    found = _registers(rows, ["key"])
    return (
        rows.select("key").join(found, "key", "left").select(F.col("key").alias(key), "registers", as_text("registers").alias("fingerprint"))
    )


def _placed(rows: DataFrame, parts: int) -> DataFrame:
    """The rows (did, text) with bucket and rn, written to the shared folder: their range of ids (PLACE bits up) with the
    number of a bucket of BUCKET_ROWS rows that follow each other, and the place in the bucket.

    The order is by descending id, then by the first KEY characters of the texts, descending, then by their hash; rows
    that are wholly equal are dealt at random, so that neither an id nor a text with many rows fills one range.
    """
    keyed = rows.select("did", "text", F.substring("text", 1, KEY).alias("start"), F.xxhash64("text").alias("hash"), F.rand(1).alias("salt"))
    order = [F.desc("did"), F.desc("start"), F.col("hash"), F.col("salt")]
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the id of a row is the number of its task, 33 bits up, and its place in what the task writes
    dealt = settle(dealt.select("did", "text", F.monotonically_increasing_id().alias("at")))
    place = F.col("at").bitwiseAND(F.lit(_PLACES))
    bucket = (F.col("at") - place + F.floor(place / BUCKET_ROWS)).alias("bucket")
    return dealt.select(bucket, (place % BUCKET_ROWS).cast("int").alias("rn"), "did", "text")


def _firsts(rows: DataFrame) -> DataFrame:
    """text of the first row of each bucket, and the bucket before it in the order (before the first one, the last).

    Within a range the bucket before has the number before; only the first row of each range looks its one up, by a
    window over one row for each range (a task's output).
    """
    starts = rows.filter("rn = 0").select("bucket", "text")
    part = F.shiftright("bucket", PLACE)
    last = starts.groupBy(part.alias("part")).agg(F.max("bucket").alias("last"))
    before = F.coalesce(F.lag("last").over(Window.orderBy("part")), F.max("last").over(Window.partitionBy()))
    opening = F.col("bucket").bitwiseAND(F.lit(_PLACES)) == 0
    # other rows carry a part of their own that no range has, so that they meet nothing and are dealt over all tasks
    starts = starts.withColumn("part", F.when(opening, part).otherwise(-1 - F.col("bucket")))
    joined = starts.join(last.select("part", before.alias("ahead")), "part", "left")
    return joined.select(F.coalesce("ahead", F.col("bucket") - 1).alias("bucket"), "text")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprint every text and its edited text, and compare it with both the edited and the next document's text.

    The order is by descending doc_id; rows that share an id follow each other by the start of their texts, then by a
    hash (`_placed`), and a null id comes last. A null text is empty. Documents are sorted over ranges and bucketed by
    their place, so that a neighbour is found within a bucket or is the first row of the next one; only those first rows
    are joined, and nothing that grows with the documents passes the driver. Every row gives one row; an empty table
    gives none; other columns are not read.
    """
    rows = docs.select(id_key().alias("did"), text_of().alias("text"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / PART_ROWS))
    rows = _placed(rows, parts)
    first = settle(_firsts(rows))
    found = fingerprints(first, "bucket").select("bucket", F.col("registers").alias("first_registers"))
    behind = settle(first.withColumnRenamed("text", "first_text").join(found, "bucket"))

    # did changes nothing in this order, but makes both sides below read the same columns, so that texts are dealt once
    order = Window.partitionBy("bucket").orderBy(F.desc("did"), "rn")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    numbered = (
        rows.repartition(parts, "bucket")
        .withColumn("next", F.lead("text").over(order))
        .join(behind, "bucket", "left")
        .withColumn("n_chars", F.length("text"))
        .withColumn(
            "edited",
            F.concat(
                F.substring("text", F.lit(1), F.col("n_chars") - half),
                F.substring(F.coalesce("next", "first_text"), F.lit(1), half),
            ),
        )
    )
    sides = numbered.select("bucket", "rn", F.posexplode(F.array("text", "edited")).alias("side", "t"))
    found = _registers(sides, ["bucket", "rn", "side"])
    facts = numbered.select(
        "bucket",
        "rn",
        "did",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.when(F.col("next").isNull(), F.col("first_registers")).alias("outside"),
        F.lit(None).cast("array<long>").alias("own"),
        F.lit(None).cast("array<long>").alias("edit"),
    )
    side = lambda i: F.when(F.col("side") == i, F.col("registers"))
    found = found.select("bucket", "rn", side(0).alias("own"), side(1).alias("edit"))
    # both are dealt by bucket, so neither their union nor what follows deals them out again
    merged = facts.unionByName(found, allowMissingColumns=True).groupBy("bucket", "rn")
    merged = merged.agg(*(F.first(c, ignorenulls=True).alias(c) for c in facts.columns[2:]))
    by_rn = Window.partitionBy("bucket").orderBy("rn")
    last = F.lead("rn").over(by_rn).isNull()
    return (
        merged.withColumn("following", F.when(last, F.col("outside")).otherwise(F.lead("own").over(by_rn)))
        .select(
            id_back("did").alias("doc_id"),
            F.col("n_chars").cast("long").alias("n_chars"),
            "edited_sha256",
            as_text("own").alias("fingerprint"),
            as_text("edit").alias("edited_fingerprint"),
            likeness("own", "edit").alias("near_edited"),
            likeness("own", "following").alias("near_next"),
        )
    )


def op3_fingerprint(spark, sf_dir):
    return compare_edited(documents(spark, sf_dir))
