"""Scalar functions on the text, numbers and codes of items and requests; all are native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Invisible characters read as spaces (no-break, narrow no-break, thin, zero-width, byte order mark).
INVISIBLE = "\u00a0\u202f\u2009\u200b\ufeff"
# Openings of boilerplate behind a product's name.
MARKERS = [
    r"комплектаци\w*",
    r"опци\w*",
    r"аттестат\w*",
    r"накс",
    r"свидетельств\w*",
    r"соответстви\w*",
    r"требовани\w*",
    r"завод\w*",
    r"гост",
    r"ту\s*\d",
    r"рд\s*\d",
    r"упаковк\w*",
    r"напряжение\s+сети",
    r"температур\w*",
    r"габарит\w*",
    r"исполнени\w*",
    r"категори\w*\s+помещени\w*",
]
# Units of measure that end a dimension, not an article.
DIMENSIONS = "мм см дм км м кг гр г мг т л мл шт компл уп вт квт в ма а гц".split()
# A head of boilerplate this short is taken for the product itself.
LEAST_HEAD_CHARS, LEAST_HEAD_WORDS = 10, 2
# What is stripped from the end of a name's head, and from the ends of an article candidate.
HEAD_EDGES, CANDIDATE_EDGES = " .,:;–—-+/", " .,:;"
_MARKER = r"(?iU)\b(?:" + "|".join(MARKERS) + r")\b"
_DIMENSION = r"(?iU)(?:" + "|".join(DIMENSIONS) + r")$"


def null_if_empty(text: Column) -> Column:
    return F.when(text != "", text)


def clean_string(text: Column) -> Column:
    """Invisible characters and runs of white space become one space; nothing left is null."""
    shown = F.translate(text, INVISIBLE, " " * len(INVISIBLE))
    return null_if_empty(F.trim(F.regexp_replace(shown, r"(?U)\s+", " ")))


def normalize_article(text: Column) -> Column:
    """Upper case without the separators that articles are written with."""
    return null_if_empty(F.upper(F.regexp_replace(clean_string(text), r"(?U)[\s\-./*\\]+", "")))


def normalize_name(text: Column) -> Column:
    return F.lower(clean_string(text))


def normalize_label(text: Column) -> Column:
    """Units and manufacturers: lower case, trimmed."""
    return null_if_empty(F.lower(F.trim(text)))


def strip(text: Column, characters: str) -> Column:
    return F.btrim(text, F.lit(characters))


def denoise_name(text: Column) -> Column:
    """The name up to its first boilerplate marker, unless too little is left of it."""
    whole = clean_string(text)
    at = F.regexp_instr(whole, F.lit(_MARKER))
    head = strip(F.substring(whole, F.lit(1), at - 1), HEAD_EDGES)
    words = F.size(F.split(F.trim(head), r"(?U)\s+"))
    short = (F.length(head) < LEAST_HEAD_CHARS) | (words < LEAST_HEAD_WORDS)
    return F.when((at == 0) | short, whole).otherwise(head)


def article_candidates(text: Column) -> Column:
    """Words that look like an article or model, as normalised articles in order of appearance."""
    words = F.transform(F.split(clean_string(text), r"(?U)[\s,;()\[\]]+"), lambda w: strip(w, CANDIDATE_EDGES))
    digits = lambda w: F.length(F.regexp_replace(w, "[^0-9]", ""))
    wanted = lambda w: (digits(w) > 0) & ~w.rlike(_DIMENSION) & (w.rlike(r"\p{L}") | (digits(w) >= 5))
    found = F.filter(F.transform(F.filter(words, wanted), normalize_article), lambda a: F.length(a) >= 3)
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def code_tokens(text: Column) -> Column:
    """Distinct runs of at least five digits, in order of appearance."""
    found = F.array_distinct(F.regexp_extract_all(clean_string(text), F.lit(r"(\d{5,})"), F.lit(1)))
    return F.coalesce(found, F.array().cast("array<string>"))


def parse_decimal(text: Column) -> Column:
    """The first number-like run of a text as a decimal. Of comma and point the later one is decimal; a single comma is
    decimal, several commas or points separate thousands, as spaces do; of a range the left number counts."""
    token = F.regexp_extract(clean_string(text), r"(?:[≈~±]\s*)?([+-]?[\d .,]*\d)", 1)
    token = F.regexp_replace(token, " ", "")

    def number(t: Column, digits: Column) -> Column:
        sign = F.when(t.startswith("-"), "-").otherwise("")
        count = lambda c: F.length(digits) - F.length(F.replace(digits, F.lit(c), F.lit("")))
        no = lambda c: F.replace(digits, F.lit(c), F.lit(""))
        comma_last = F.locate(",", F.reverse(digits)) < F.locate(".", F.reverse(digits))
        point = lambda x: F.replace(x, F.lit(","), F.lit("."))
        plain = (
            F.when((count(",") > 0) & (count(".") > 0), F.when(comma_last, point(no("."))).otherwise(no(",")))
            .when(count(",") == 1, point(digits))
            .when(count(",") > 1, no(","))
            .when(count(".") > 1, no("."))
            .otherwise(digits)
        )
        return F.concat(sign, plain).try_cast("decimal(38,10)")

    # bound once: written out, the expressions of the token would be evaluated for each of these uses
    return _bound(token, lambda t: _bound(F.regexp_replace(t, r"^[+-]", ""), lambda digits: number(t, digits)))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_int(text: Column) -> Column:
    """parse_decimal without its fraction."""
    return parse_decimal(text).try_cast("bigint")


def search_text(name: Column, attributes: Column) -> Column:
    """What codes and brands are looked for in: the name with its attributes."""
    return clean_string(F.concat_ws(" ", name, attributes))


def lexical_query(name: Column, attributes: Column) -> Column:
    """What names are searched by: the name without boilerplate, with its attributes, in lower case."""
    return normalize_name(F.concat_ws(" ", denoise_name(name), attributes))


def manual_article(query: Column) -> Column:
    """The article form of a typed search: upper case, letters and digits only."""
    return null_if_empty(F.regexp_replace(F.upper(query), r"[^\p{L}\p{N}]", ""))


def decimal_text(number: Column) -> Column:
    """A decimal without trailing zeros."""
    text = number.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def key_label(code: Column, article: Column, brand: Column) -> Column:
    """How an identity key is shown in reports."""
    return (
        F.when(code.isNotNull(), F.concat(F.lit("code "), code))
        .when(article.isNotNull() & brand.isNotNull(), F.concat(F.lit("article "), article, F.lit(" / "), brand))
        .when(article.isNotNull(), F.concat(F.lit("article "), article))
    )


def source_label(source_type: Column, name: Column) -> Column:
    # Labels of the result table.
    return F.when(source_type == "company_catalog", "Каталог компании").when(
        source_type.isNotNull(), F.concat(F.lit("Прайс: "), name)
    )


def capitalized(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def explanation_text(e: Column) -> Column:
    """The sentence that explains a candidate's score, from its explanation struct."""
    two = lambda x: F.round(x.cast("decimal(10,6)"), 2).cast("decimal(4,2)").cast("string")
    code = F.coalesce(e["extracted_code"], F.lit("код"))
    # Wording of the explanations.
    parts = F.concat_ws(
        ", ",
        F.when(e["article_match"] == "exact_after_normalization", "артикул совпал точно").when(
            e["article_match"] == "fuzzy", F.concat(F.lit("артикул похож (similarity="), two(e["article_similarity"]), F.lit(")"))
        ),
        F.when(e["extracted_code_match"] == "exact", F.concat(F.lit("код из наименования совпал ("), code, F.lit(")")))
        .when(e["extracted_code_match"] == "in_name", F.concat(F.lit("код найден в наименовании каталога ("), code, F.lit(")")))
        .when(e["extracted_code_match"] == "fuzzy", "код из наименования похож"),
        F.when(e["lexical_score"] > 0, F.concat(F.lit("наименование близко (score="), two(e["lexical_score"]), F.lit(")"))),
        F.when(e["brand_match"], "совпал бренд"),
        F.when(e["unit_match"], "совпала единица измерения"),
    )
    return F.when(parts == "", "слабое совпадение").otherwise(capitalized(parts))
