"""Joins that are no equality: set similarity, containment of all stems, digit substrings. All are equality joins on
selective pieces, then a check of the pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import digit_grams, jaccard
from .storage import settled

#: Members that count as common: those in more than this share of the right side's sets, so many of them at most. They
#: only bound the overlap of a pair.
COMMON_SHARE, COMMON = 0.01, 512
#: Parts into which the common members are dealt; how many of each part two sets hold bounds what they share.
PARTS = 8


def _frequencies(sets: DataFrame) -> DataFrame:
    return sets.select(F.explode("members").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))


def _by_rarity(sets: DataFrame, frequencies: DataFrame) -> DataFrame:
    """id, n and the members in order of their frequency, rarest first."""
    members = sets.select("id", F.explode("members").alias("gram"))
    weighed = members.join(frequencies, "gram", "left").select("id", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram").alias("m"))
    return weighed.groupBy("id").agg(F.array_sort(F.collect_list("m")).alias("m")).withColumn("n", F.size("m"))


def _split(sets: DataFrame, common: list[str]) -> DataFrame:
    """id, no (a number in place of the id), members, n, common members in the order given, rare members, f (how many are
    common), held (how many of each part, a byte each)."""
    literal = lambda grams: F.split(F.lit("\x1f".join(grams)), "\x1f") if grams else F.array().cast("array<string>")
    listed = literal(common)
    out = sets.filter(F.size("members") > 0).select("id", F.monotonically_increasing_id().alias("no"), "members", F.size("members").alias("n"))
    out = out.withColumn("common", F.array_intersect(listed, "members")).withColumn("rare", F.array_except("members", "common"))
    held = sum((F.size(F.array_intersect("common", literal(common[k::PARTS]))).cast("long") * F.lit(1 << k * (64 // PARTS)) for k in range(PARTS)), F.lit(0).cast("long"))
    return settled(out.withColumn("f", F.size("common")).withColumn("held", held))


def _shareable(a: str, b: str) -> Column:
    """How many common members two sets can share at most."""
    part = lambda c, k: F.shiftrightunsigned(c, k * (64 // PARTS)).bitwiseAND(F.lit(2 ** (64 // PARTS) - 1))
    return sum((F.least(part(a, k), part(b, k)) for k in range(1, PARTS)), F.least(part(a, 0), part(b, 0)))


def _overlap(na: str, nb: str, threshold: float) -> Column:
    """What two sets of these sizes must have in common."""
    return (F.col(na) + F.col(nb)) * F.lit(threshold / (1 + threshold)) - 1e-6


def _by_rare_members(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """Pairs (i, j) with a rare member in common whose rare members in common, with all common members that both could
    share, are enough.

    A left set that needs at least two rare members in common, whatever the other set, is looked up by pairs of its rare
    members, which few sets share; the others by single ones. How many pairs meet tells how many members do.
    """
    smallest = b.agg(F.min("n")).first()[0] or 0
    needed = F.ceil((F.col("n") + F.greatest(F.col("n") * threshold, F.lit(float(smallest)))) * F.lit(threshold / (1 + threshold)) - 1e-6) - F.col("f")
    pairs = F.flatten(
        F.transform("rare", lambda x, i: F.transform(F.slice("rare", i + 2, F.size("rare")), lambda y: F.xxhash64(F.least(x, y), F.greatest(x, y))))
    )
    sized = (F.col("nb") >= F.col("na") * threshold - 1e-6) & (F.col("na") >= F.col("nb") * threshold - 1e-6)

    def met(left: DataFrame, key: Column, shared: Column) -> DataFrame:
        x = left.select(F.col("no").alias("i"), F.col("n").alias("na"), F.col("held").alias("ha"), F.explode(key).alias("key"))
        y = b.select(F.col("no").alias("j"), F.col("n").alias("nb"), F.col("held").alias("hb"), F.explode(key).alias("key"))
        found = x.join(y, "key").filter(sized).groupBy("i", "j", "na", "nb", "ha", "hb").agg(F.count(F.lit(1)).alias("meetings"))
        return found.filter(shared + _shareable("ha", "hb") >= _overlap("na", "nb", threshold)).select("i", "j")

    several = met(a.filter(needed >= 2), pairs, (1 + F.sqrt(1 + 8 * F.col("meetings"))) / 2)
    return several.unionByName(met(a.filter(needed < 2), F.col("rare"), F.col("meetings")))


def _by_common_members(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """Pairs (i, j) whose common members alone are enough. Sets with the same common members and size are one; only
    those with so many of them can have such a partner."""

    def side(df: DataFrame, no: str, n: str, c: str, at: str) -> tuple[DataFrame, DataFrame]:
        able = df.filter(F.col("f") >= F.col("n") * threshold - 1e-6)
        kinds = able.select(F.col("common").alias(c), F.col("n").alias(n)).distinct()
        # the first common member of such a pair, in any order that both follow, leaves enough behind it
        prefix = F.slice(c, 1, F.size(c) - F.ceil(F.col(n) * threshold - 1e-6).cast("int") + 1)
        return able.select(F.col("no").alias(no), F.col("common").alias(c), F.col("n").alias(n)), kinds.select(c, n, F.posexplode(prefix).alias(at, "gram"))

    left, x = side(a, "i", "na", "ca", "pa")
    right, y = side(b, "j", "nb", "cb", "pb")
    behind = F.least(F.size("ca") - F.col("pa"), F.size("cb") - F.col("pb"))
    kinds = x.join(y, "gram").filter(behind >= _overlap("na", "nb", threshold)).select("ca", "na", "cb", "nb").distinct()
    kinds = kinds.filter(F.size(F.array_intersect("ca", "cb")) >= _overlap("na", "nb", threshold))
    return left.join(kinds, ["ca", "na"]).join(right, ["cb", "nb"]).select("i", "j")


class SetIndex:
    """The right side of set similarity joins, (id, members), prepared once for several of them."""

    def __init__(self, right: DataFrame):
        ranked = _frequencies(right).filter(F.col("df") > COMMON_SHARE * right.count()).orderBy(F.desc("df"), "gram").limit(COMMON)
        self.common = [r["gram"] for r in ranked.collect()][::-1]  # rarest first
        self.sets = _split(right, self.common)


def set_similarity_join(left: DataFrame, right: DataFrame | SetIndex, threshold: float) -> DataFrame:
    """Pairs (left_id, right_id, score) of sets (id, members) whose Jaccard similarity is at least the threshold.

    Members in most sets bring no pair together: either the rare members that two sets share, with all common ones that
    both could share, are as many as the sizes imply, or the common ones alone are. Both kinds of pairs come from
    equality joins, and the few that remain are verified. No pair is lost. Empty sets match nothing; ids must be unique
    on each side.
    """
    index = right if isinstance(right, SetIndex) else SetIndex(right)
    a, b = _split(left, index.common), index.sets
    common = settled(_by_common_members(a, b, threshold))
    pairs = settled(_by_rare_members(a, b, threshold).unionByName(common).distinct())
    score = jaccard(F.col("x"), F.col("y"))
    return (
        pairs.join(a.select(F.col("no").alias("i"), F.col("id").alias("left_id"), F.col("members").alias("x")), "i")
        .join(b.select(F.col("no").alias("j"), F.col("id").alias("right_id"), F.col("members").alias("y")), "j")
        .select("left_id", "right_id", score.alias("score"))
        .filter(F.col("score") >= threshold - 1e-9)
    )


def containment_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (left_id, right_id) where the right set holds every member of the left one (id, members). Each left set is
    looked up by its rarest member only. Empty left sets match nothing."""
    frequencies = _frequencies(right)
    rarest = _by_rarity(left, frequencies).select(F.col("id").alias("left_id"), F.element_at("m", 1)["gram"].alias("gram"))
    found = right.select(F.col("id").alias("right_id"), F.explode("members").alias("gram"), F.col("members").alias("y"))
    return (
        rarest.join(found, "gram")
        .join(left.select(F.col("id").alias("left_id"), F.col("members").alias("x")), "left_id")
        .filter(F.size(F.array_except("x", "y")) == 0)
        .select("left_id", "right_id")
    )


def digit_substring_join(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (token, name) where the name contains the run of at least five digits; distinct inputs."""
    keyed = tokens.select("token", F.substring("token", 1, 5).alias("gram"))
    grams = names.select("name", F.explode(digit_grams(F.col("name"))).alias("gram"))
    return keyed.join(grams, "gram").filter(F.col("name").contains(F.col("token"))).select("token", "name")


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    from pyspark.sql import Window

    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") <= n).drop("_rn")
