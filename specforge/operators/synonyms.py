"""Synonym pairs learned from what was chosen for requested lines: word alignment by expectation maximisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..plans.storage import settled

#: Decisions in which two words must stand against each other to be a pair at all.
LEAST = 3
ROUNDS = 5
#: Likelihood ratio of the pair's 2 x 2 table: chi square with one degree of freedom at a chance of one in a thousand.
SIGNIFICANT = 10.83
PROBABLE = 0.5


def synonym_pairs(decisions: DataFrame, rounds: int = ROUNDS, least: int = LEAST, significant: float = SIGNIFICANT, probable: float = PROBABLE) -> DataFrame:
    """query_word, chosen_word, together (decisions), probability and likelihood_ratio of words that stand for each other
    in decisions (query: the line's text, chosen: the name of the item chosen for it).

    Words that a line and its item share explain themselves, and words with digits are codes: both are left out, as are
    lines that have no word left on either side (no text included). Of the rest each word of the line is taken to stand
    for one word of the item, with a probability that depends on the two words only; it is estimated by `rounds` steps of
    expectation maximisation from equal shares. Pairs seen together in fewer than `least` decisions take no part. A pair
    is reported if its likelihood ratio is significant, it is seen more often than chance has it, and at least the share
    `probable` of what stands for the chosen word is the query word. Repeated decisions count as often as they occur.

    Equal left-overs are counted first and the steps run on (query word, words of the item) with their counts, so that
    a frequent word is as many rows as it has different surroundings. Names bound the pairs within a line: names are
    short, and words of one line meet all words of its item. Other columns are not read; an empty table gives none.
    """
    words = lambda c: F.array_distinct(F.filter(S.words(F.col(c)), lambda w: ~w.rlike(r"\p{N}")))
    sides = decisions.select(words("query").alias("a"), words("chosen").alias("b"))
    left = lambda x, y: F.array_sort(F.array_except(x, y))
    lines = sides.select(left("a", "b").alias("q"), left("b", "a").alias("c")).filter("size(q) > 0 and size(c) > 0")
    lines = settled(lines.groupBy("q", "c").agg(F.count(F.lit(1)).alias("n")))
    around = lines.select(F.explode("q").alias("q"), F.col("c").alias("words"), "n").groupBy("q", "words").agg(F.sum("n").alias("n"))
    around = settled(around.withColumn("around", F.monotonically_increasing_id()))
    met = around.select("around", "n", "q", F.explode("words").alias("c"))
    together = settled(met.groupBy("q", "c").agg(F.sum("n").alias("together")).filter(F.col("together") >= least))
    links = settled(met.join(together.select("q", "c"), ["q", "c"]))

    table = _shares(together.select("q", "c", F.lit(1.0).alias("x")))
    for _ in range(rounds):
        scored = settled(links.join(table, ["q", "c"]))
        sums = scored.groupBy("around").agg(F.sum("t").alias("all"))
        expected = scored.join(sums, "around").groupBy("q", "c").agg(F.sum(F.col("n") * F.col("t") / F.col("all")).alias("x"))
        table = settled(_shares(expected))

    total = lines.agg(F.sum("n").alias("lines"))
    by_q = around.groupBy("q").agg(F.sum("n").alias("n_q"))
    by_c = lines.select(F.explode("c").alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n_c"))
    facts = together.join(table, ["q", "c"]).join(by_q, "q").join(by_c, "c").crossJoin(F.broadcast(total))
    cell = lambda o, row, col: f"if({o} > 0, {o} * ln(({o}) / (double({row}) * ({col})) * lines), 0.0)"
    rest_q, rest_c = "lines - n_q", "lines - n_c"
    ratio = F.expr(
        f"2 * ({cell('together', 'n_q', 'n_c')} + {cell('(n_q - together)', 'n_q', rest_c)}"
        f" + {cell('(n_c - together)', rest_q, 'n_c')} + {cell('(lines - n_q - n_c + together)', rest_q, rest_c)})"
    )
    found = facts.select(
        F.col("q").alias("query_word"), F.col("c").alias("chosen_word"), "together", F.round("t", 6).alias("probability"), F.round(ratio, 4).alias("likelihood_ratio"),
        (F.col("together").cast("double") * F.col("lines") > F.col("n_q").cast("double") * F.col("n_c")).alias("attracted"),
    )
    return found.filter(F.col("attracted") & (F.col("likelihood_ratio") >= significant) & (F.col("probability") >= probable)).drop("attracted")


def _shares(weights: DataFrame) -> DataFrame:
    """q, c and t: the share of x (q, c, x) among all q of the same c."""
    return weights.join(weights.groupBy("c").agg(F.sum("x").alias("all")), "c").select("q", "c", (F.col("x") / F.col("all")).alias("t"))
