"""Trigrams, stems and digit grams of names, and the scores computed from them; native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each padded with two spaces before and one behind."""
    padded = F.transform(words(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(
        padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))
    )
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct arrays; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(0.0)).otherwise(both / F.greatest(either, F.lit(1)))


def similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


# Frequent words that carry no meaning in a product name.
STOP_WORDS = "и в во не на с со к ко по для из от до у о об при или но а же бы the a an of for and with in on to".split()
# Endings removed from Russian words, longest first, and the plural of English ones.
_RU_ENDING = r"(иями|ями|ами|иях|ях|ах|ого|его|ому|ему|ыми|ими|ая|яя|ое|ее|ые|ие|ый|ий|ой|ей|ым|им|ом|ем|ую|юю|ов|ев|ия|ию|ии|ам|ям|а|я|о|е|ы|и|у|ю|ь)$"


def stem(word: Column) -> Column:
    """A light stem: Russian inflection endings are cut if three letters stay, and the s of English plurals."""
    russian = word.rlike("[а-яё]")
    cut = F.regexp_replace(word, r"(?<=\p{L}{3})" + _RU_ENDING, "")
    plural = F.regexp_replace(word, r"(?<=[a-z]{3})(?<!s)s$", "")
    return F.when(russian, cut).otherwise(plural)


def stems(text: Column) -> Column:
    """Distinct stems of the words that are not stop words."""
    kept = F.filter(words(text), lambda w: ~w.isin(STOP_WORDS))
    return F.array_distinct(F.transform(kept, stem))


def text_rank(query_stems: Column, name_stems: Column) -> Column:
    """A tenth of the share of the name's stems that the query has, squashed by r / (r + 1)."""
    r = F.lit(0.1) * F.size(F.array_intersect(query_stems, name_stems)) / F.greatest(F.size(name_stems), F.lit(1))
    return r / (r + 1)


def digit_grams(text: Column, size: int = 5) -> Column:
    """Distinct runs of `size` digits inside longer ones."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(\d{{{size},}})"), F.lit(1))
    grams = F.transform(
        runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - (size - 1)), lambda i: F.substring(r, i, F.lit(size)))
    )
    return F.array_distinct(F.flatten(grams))
