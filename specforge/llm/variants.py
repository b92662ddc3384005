"""Spelling variants grouped by pairs of trie nodes.

The words of a vocabulary stand in two tries, one read from the front and one from the back. A node is numbered by its
first word in code-point order and its depth, so that two words share a number exactly if they share that prefix or
suffix. Nodes near the roots, through which most words go, are numbered by their few code points instead. A word that skips its i-th code point is the pair (node of the prefix before it, node of the suffix behind it);
a word cut at i without skipping is the pair of the nodes on both sides. Words that skip to the same pair differ by one
replaced code point; a word that skips to the pair at which another one is cut has one more. So all neighbours come from
equality of integers, and none is lost.

A pair holds a word for each code point that can stand in the gap, and at most one that is cut there: groups are bounded
by the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, documents, settle, small_batches, text_of

#: A word of the texts.
RUN = "[A-Za-zÀ-ÿ]+"
#: Words are kept from this length and this number of occurrences on.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One occurrence in so many, by checksum, loses a code point before words are counted.
EVERY = 97
#: A form has at least so many times the occurrences of the word that it stands for.
TIMES = 2

#: Nodes up to this depth are numbered by their code points (21 bits each), which spreads their words.
TOP = 3

_MOD, _BASE = 2**127 - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835


def spoken(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """word: every run of letters of the texts, A-Z in lower case; where `every` divides the checksum of
    "<doc_id>:<word>" the code point at the checksum modulo the length is left out. A null doc_id counts as empty."""
    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("did"), text_of().alias("text"))
    runs = named.select("did", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).withColumn("run", ascii_lower(F.col("run")))
    h = F.crc32(F.encode(F.concat("did", F.lit(":"), "run"), "UTF-8"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(h % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n (occurrences) of the words that are long and frequent enough."""
    counts = words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= least_count)


def _prefixes(word: str) -> tuple[list[int | None], list[bytes | None]]:
    """For each prefix, the empty one first: a negative number for one of TOP code points at most, else a 127-bit
    polynomial hash."""
    h, top, hashes, numbers = 1, 0, [None], [-1]
    for depth, c in enumerate(word, 1):
        h = (h * _BASE + ord(c) + 1) % _MOD
        if depth <= TOP:
            top = top << 21 | ord(c)
        numbers.append(-1 - top if depth <= TOP else None)
        hashes.append(None if depth <= TOP else h.to_bytes(16, "big"))
    return numbers, hashes


_PLACES = {"no": pa.int64(), "i": pa.int32(), "j": pa.int32(), "prefix": pa.binary(), "prefix_no": pa.int64(), "suffix": pa.binary(), "suffix_no": pa.int64(), "fresh": pa.bool_()}


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each place i of a word (its length included): the prefix before and the suffix from i on, as numbers or hashes,
    with their lengths, and whether the code point at i differs from the one before."""
    made = lambda columns: pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in _PLACES.items()], names=list(_PLACES))
    for batch in batches:
        columns = {c: [] for c in _PLACES}
        for no, word in zip(batch.column("no").to_pylist(), batch.column("word").to_pylist(), strict=True):
            size = len(word)
            columns["no"] += [no] * (size + 1)
            columns["i"] += range(size + 1)
            columns["j"] += range(size, -1, -1)
            for node, text, step in (("prefix", word, 1), ("suffix", word[::-1], -1)):
                numbers, hashes = _prefixes(text)
                columns[f"{node}_no"] += numbers[::step]
                columns[node] += hashes[::step]
            columns["fresh"] += [i == 0 or i == size or word[i] != word[i - 1] for i in range(size + 1)]
            if len(columns["no"]) > 50_000:
                yield made(columns)
                columns = {c: [] for c in _PLACES}
        yield made(columns)


def _numbered(places: DataFrame, node: str, number: str) -> DataFrame:
    """Replace a prefix or suffix by its number: the one given near the root, else the first word that has it. A node with
    a single word gets none (a pair with it has no other word)."""
    own = Window.partitionBy(F.coalesce(node, F.encode(F.col("no").cast("string"), "UTF-8")))  # rows with a given number are spread by word
    out = places.withColumns({"_first": F.min("no").over(own), "_last": F.max("no").over(own)})
    shared = F.when(F.col("_first") != F.col("_last"), F.col("_first"))
    return out.withColumn(number, F.when(F.col(node).isNull(), F.col(f"{node}_no")).otherwise(shared)).drop(node, f"{node}_no", "_first", "_last")


def _pairs(vocab: DataFrame) -> DataFrame:
    """no, n, skips, fresh and the pair of nodes (p, i, s, j) of each skip and cut that other words may share."""
    places = vocab.select("no", "word").mapInArrow(_places, "no long, i int, j int, prefix binary, prefix_no long, suffix binary, suffix_no long, fresh boolean")
    behind = _numbered(places, "suffix", "s")
    following = F.lead("s").over(Window.partitionBy("no").orderBy("i"))
    both = behind.withColumn("next", following)
    kind = lambda skips, s, j: F.struct(F.lit(skips).alias("skips"), s.alias("s"), j.cast("int").alias("j"))
    kinds = F.filter(F.array(kind(True, F.col("next"), F.col("j") - 1), kind(False, F.col("s"), F.col("j"))), lambda x: x["s"].isNotNull())
    held = ["no", "i", "prefix", "prefix_no", "fresh"]
    cuts = both.select(*held, F.explode(kinds).alias("x")).select(*held, "x.*")
    return _numbered(cuts, "prefix", "p").filter("p is not null")


def neighbours(vocab: DataFrame) -> DataFrame:
    """no, n_near (how many words differ by one inserted, deleted or replaced code point), best_n and best (of those the
    one of largest n, then of smallest number); vocab: no, word, n. Words without a neighbour have no row."""
    pairs = _pairs(vocab).join(vocab.select("no", "n").hint("merge"), "no")
    member = F.struct(F.col("n"), (-F.col("no")).alias("order"), "no", "skips", "fresh")
    groups = pairs.groupBy("p", "i", "s", "j").agg(F.collect_list(member).alias("members")).filter(F.size("members") > 1)
    # a deletion inside a run of equal letters gives the same word wherever it is made, and counts at the first of them
    partners = lambda a: F.filter("members", lambda b: (a["no"] != b["no"]) & ((a["skips"] & b["skips"]) | (a["skips"] & a["fresh"] & ~b["skips"]) | (~a["skips"] & b["skips"] & b["fresh"])))
    met = groups.select(F.explode(F.transform("members", lambda a: F.struct(a["no"].alias("no"), partners(a).alias("near")))).alias("a"))
    met = met.filter(F.size("a.near") > 0).select("a.no", F.size("a.near").alias("near"), F.array_max("a.near").alias("best"))
    return met.groupBy("no").agg(F.sum("near").alias("n_near"), F.max(F.struct("best.n", "best.order", "best.no")).alias("best")).select(
        "no", "n_near", F.col("best.n").alias("best_n"), F.col("best.no").alias("best")
    )


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """no and root of every word with a form; forms: no, form. Each round doubles the steps taken; a form has at least
    TIMES the occurrences of its word, so chains are short and have no cycles."""
    at = scratch.settle(forms.select("no", F.col("form").alias("root")))
    while True:
        above = at.select(F.col("no").alias("root"), F.col("root").alias("next"))
        stepped = scratch.settle(at.join(above.hint("merge"), "root", "left").select("no", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = stepped.select("no", "root")
        if stepped.filter("moved").isEmpty():
            return at


def spelling_variants(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of a table (word, one row for each occurrence; null: none).

    form: the neighbour of largest n (ties: the smallest in code-point order) if it has `times` the occurrences of the
    word; root: the end of the chain of forms, the word itself if it has no form. Empty tables give none. Words of any
    length are taken whole.
    """
    spark = words.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    counted = scratch.settle(vocabulary(words, least_length, least_count))
    # numbers grow in code-point order: partitions are ranges of words, and rows within them are sorted
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = counted.repartitionByRange(parts, "word").sortWithinPartitions("word")
    vocab = scratch.settle(ordered.withColumn("no", F.monotonically_increasing_id()))
    near = scratch.settle(neighbours(vocab))
    facts = scratch.settle(vocab.join(near.hint("merge"), "no", "left").withColumn("form", F.when(F.col("best_n") >= times * F.col("n"), F.col("best"))))
    roots = _roots(facts.filter("form is not null").select("no", "form"), scratch)
    named = lambda no, word: vocab.select(F.col("no").alias(no), F.col("word").alias(word)).hint("merge")
    formed = facts.filter("form is not null").join(roots.withColumnRenamed("root", "root_no").hint("merge"), "no")
    formed = formed.join(named("form", "form_word"), "form").join(named("root_no", "root"), "root_no")
    out = formed.select("word", F.col("form_word").alias("form"), "root", "n", "n_near", F.col("best_n").alias("form_n"))
    none = F.lit(None)
    alone = facts.filter("form is null").select(
        "word", none.cast("string").alias("form"), F.col("word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), none.cast("long").alias("form_n")
    )
    result = settle(out.unionByName(alone))
    scratch.drop()
    return result


def op13_variants(spark, sf_dir):
    return spelling_variants(spoken(documents(spark, sf_dir)))


#: The checksum's table follows from its polynomial; rows of a text, runs, counts, pairs by the skipped place, chains.
OP13_SQL = """
WITH RECURSIVE
crc(t) AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b::UBIGINT], range(8)::UBIGINT[]),
           lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END))),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
         FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2),
bytes AS (SELECT *, list_transform(string_split(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), ''), lambda x: (strpos('0123456789ABCDEF', x) - 1)::UBIGINT) AS half FROM runs),
summed AS (SELECT run, times, xor(4294967295::UBIGINT, list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, len(half), 2), lambda k: half[k] * 16 + half[k + 1])),
           lambda acc, b: xor(acc >> 8, t[((xor(acc, b) & 255) + 1)::BIGINT]))) AS h FROM bytes, crc),
words AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM summed),
vocab AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
places AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab),
skips AS MATERIALIZED (SELECT word, n, left(word, (i - 1)::INT) AS p, substr(word, (i + 1)::INT) AS s FROM places),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS other_n FROM skips a JOIN skips b ON a.p = b.p AND a.s = b.s AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM skips a JOIN vocab b ON b.word = a.p || a.s
  UNION SELECT b.word, a.word, a.n FROM skips a JOIN vocab b ON b.word = a.p || a.s),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS most FROM near GROUP BY word),
form AS MATERIALIZED (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 2 * v.n THEN b.most END AS form_n,
                CASE WHEN b.most >= 2 * v.n THEN (SELECT min(x.other) FROM near x WHERE x.word = v.word AND x.other_n = b.most) END AS form
         FROM vocab v LEFT JOIN best b ON v.word = b.word),
chain AS (SELECT word, word AS root, 0 AS step FROM form UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN form f ON f.word = c.root WHERE f.form IS NOT NULL),
last AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM form f JOIN last l ON f.word = l.word
"""
