import pytest
from pyspark.sql import functions as F

from specforge.functions import similarity as S
from specforge.functions import text as T


def values(spark, rows, expression, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(expression(F.col("v")).alias("x")).collect()]


@pytest.mark.parametrize(
    "function, cases",
    [
        (T.clean_string, {"хомут Д16": "хомут Д16", "  a \t b ": "a b", "﻿": None, "": None}),
        (T.normalize_article, {"scr-t25-080-br": "SCRT25080BR", "Д16*9": "Д169", "QRS.678/90": "QRS67890", "  a-b-c  ": "ABC", "": None, "--": None}),
        (T.normalize_name, {"Хомут Д16×9 ART207": "хомут д16×9 art207"}),
        (T.manual_article, {"clp-д16 *9": "CLPД169", "--": None}),
        (T.decimal_text, {"10.5000": "10.5", "10.0000": "10", "100": "100"}),
    ],
)
def test_string_functions(spark, function, cases):
    assert values(spark, cases, function) == list(cases.values())


def test_parse_decimal(spark):
    cases = {
        "10,5": 10.5, "1 234,5": 1234.5, "≈10": 10, "10 шт": 10, "10-12": 10, "1,234.56": 1234.56, "1.234,56": 1234.56, "1,234,567": 1234567, "-10": -10,
        "по запросу": None, "": None, "1 000": 1000, "+5": 5, "1.2.3": 123,
    }
    got = values(spark, cases, T.parse_decimal)
    assert [None if x is None else float(x) for x in got] == list(cases.values())
    assert values(spark, ["10,9", "-3.7", None], T.parse_int) == [10, -3, None]


def test_codes_from_names(spark):
    names = ["Узел T30 стойка T30 модель QRS678", "Ножницы садовые 310мм", "Обогреватель ТОВ-18K7, 2 квт", None]
    assert values(spark, names, T.article_candidates) == [["T30", "QRS678"], [], ["ТОВ18K7"], []]
    assert values(spark, ["3л Н2-7715020-60 РИТМ 7715020", "1234", None], T.code_tokens) == [["7715020"], [], []]


def test_denoise(spark):
    cases = {
        "Сварочный аппарат ММА 250 комплектация полная": "Сварочный аппарат ММА 250",
        "Электрод сварочный, завод ESAB в городе": "Электрод сварочный",
        "Труба стальная 57х3 ГОСТ 8732-78": "Труба стальная 57х3",
        "Датчик температуры": "Датчик температуры",
        "Кабель силовой медный": "Кабель силовой медный",
        "опционал": "опционал",
    }
    assert values(spark, cases, T.denoise_name) == list(cases.values())


def test_trigrams(spark):
    row = spark.range(1).select(S.similarity(F.lit("word"), F.lit("two words")), S.similarity(F.lit(""), F.lit("")), S.similarity(F.lit("Хомут"), F.lit("хомут"))).first()
    assert round(row[0], 4) == 0.3636 and row[1] == 0 and row[2] == 1


def test_stems_join_inflections(spark):
    a, b = values(spark, ["Хомуты латунные для шлангов", "хомут латунный шланга"], S.stems)
    assert set(a) == set(b)


def test_explanations(spark):
    e = F.struct(
        F.lit("fuzzy").alias("article_match"), F.lit(0.8).alias("article_similarity"), F.lit(0.5).alias("lexical_score"), F.lit(True).alias("brand_match"),
        F.lit(False).alias("unit_match"), F.lit("in_name").alias("extracted_code_match"), F.lit("7715020").alias("extracted_code"),
    )
    text = spark.range(1).select(T.explanation_text(e)).first()[0]
    assert text == "Артикул похож (similarity=0.80), код найден в наименовании каталога (7715020), наименование близко (score=0.50), совпал бренд"


def test_a_number_is_looked_for_once(spark):
    rows = spark.createDataFrame([("-1 234,5 руб",), ("5-10",), ("нет",), (None,), ("1,234.5",)], "s string").select(T.parse_decimal(F.col("s")).alias("n"))
    assert [r["n"] if r["n"] is None else float(r["n"]) for r in rows.collect()] == [-1234.5, 5.0, None, None, 1234.5]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 2
