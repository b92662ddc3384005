"""The labelled set and what it says about the matcher."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Label statuses.
FOUND, ANALOG, NOT_FOUND, DOUBTFUL = "найдено", "аналог", "не найдено", "сомнительно"


# Headers of a labelled file, fields in order of priority.
GOLD_HEADERS = {
    "row_num": ("№", "номер"),
    "source_file": ("файл-источник", "файл источник"),
    "name": ("наименование (как у клиента)", "наименование клиент", "наименование"),
    "article": ("артикул (как у клиента)", "артикул клиент", "артикул"),
    "manufacturer": ("производитель (как у клиента)", "производитель клиент", "производитель"),
    "attributes": ("характеристика (как у клиента)", "характеристики (как у клиента)", "характеристика", "характеристики"),
    "quantity": ("кол-во", "количество", "к-во"),
    "unit": ("ед. изм.", "ед.изм", "ед изм", "единица"),
    "expected_article": ("→ правильный артикул каталога", "правильный артикул", "артикул каталога"),
    "expected_code_1c": ("→ код 1с каталога", "→ правильный код 1с", "правильный код 1с", "код 1с каталога", "код каталога"),
    "expected_name": ("→ правильное наименование каталога", "правильное наименование"),
    "label_status": ("статус разметки", "статус"),
    "labeler_notes": ("примечание разметчика", "примечание"),
    "result_article": ("результат матчера: артикул", "результат: артикул"),
    "result_code_1c": ("результат матчера: код 1с", "результат: код 1с"),
    "result_confidence": ("результат матчера: уверенность", "результат: уверенность"),
    "result_matched": ("совпало? (да/нет)", "совпало"),
}
#: Rows searched for the header, and fields it must have.
HEADER_ROWS, NEEDED = 5, ("name", "label_status")
#: Fields that a labelled row keeps.
GOLD_FIELDS = [f for f in GOLD_HEADERS if not f.startswith("result_")]


def detect_gold_headers(cells: DataFrame) -> DataFrame:
    """file_id, header_row, field, col_idx of labelled files (file_id, row_idx, col_idx, value): of the first HEADER_ROWS
    rows that which names most fields, and the name, the first such one. A header is a synonym, or starts with one at a
    border. Files whose header lacks a needed field have no row."""
    text = T.normalize_name(F.col("value"))
    field = F.coalesce(*(F.when(text.rlike("^(?:" + "|".join(map(re.escape, words)) + r")(?:$|[ :\-.,/(])"), name) for name, words in GOLD_HEADERS.items()))
    named = cells.filter(F.col("row_idx") < HEADER_ROWS).withColumn("field", field).filter("field is not null")
    first = named.groupBy("file_id", "row_idx", "field").agg(F.min("col_idx").alias("col_idx"))
    rows = first.groupBy("file_id", "row_idx").agg(F.map_from_entries(F.collect_list(F.struct("field", "col_idx"))).alias("columns"))
    rows = rows.filter(F.map_contains_key("columns", F.lit("name")))
    best = rows.groupBy("file_id").agg(F.max_by(F.struct("row_idx", "columns"), F.struct(F.size("columns"), -F.col("row_idx"))).alias("h"))
    for name in NEEDED:
        best = best.filter(F.map_contains_key("h.columns", F.lit(name)))
    return best.select("file_id", F.col("h.row_idx").alias("header_row"), F.explode("h.columns").alias("field", "col_idx"))


def read_gold_rows(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """file_id, row_idx and GOLD_FIELDS as cleaned text (row_num a number, label_status in lower case) of the rows below
    the header that have a name."""
    located = cells.join(headers, ["file_id", "col_idx"]).filter(F.col("row_idx") > F.col("header_row"))
    wide = located.groupBy("file_id", "row_idx").pivot("field", GOLD_FIELDS).agg(T.clean_string(F.first("value")))
    return wide.filter("name is not null").withColumns({"row_num": T.parse_int(F.col("row_num")), "label_status": F.lower(F.coalesce("label_status", F.lit("")))})


def gold_inputs(gold: DataFrame) -> DataFrame:
    """Gold rows as requested lines, to be matched as any other."""
    return gold.select(
        F.col("gold_id").alias("spec_item_id"), F.col("article").alias("article_raw"), F.col("name").alias("name_raw"),
        F.col("attributes").alias("attributes_raw"), F.col("manufacturer").alias("manufacturer_raw"), F.col("unit").alias("unit_raw"),
    )


def first_hit_ranks(gold: DataFrame, candidates: DataFrame, items: DataFrame) -> DataFrame:
    """gold_id, label_status, whether anything was found, and the rank of the first candidate with the expected article
    or code."""
    facts = items.select("item_id", "article_normalized", "code_1c")
    expected = gold.select(
        "gold_id", F.lower("label_status").alias("label_status"),
        T.normalize_article(F.col("expected_article")).alias("expected_article"), T.clean_string(F.col("expected_code_1c")).alias("expected_code"),
    )
    found = candidates.select(F.col("spec_item_id").alias("gold_id"), "item_id", "rank").join(facts, "item_id")
    hit = (F.col("article_normalized") == F.col("expected_article")) | (F.col("code_1c") == F.col("expected_code"))
    return (
        expected.join(found, "gold_id", "left")
        .groupBy("gold_id", "label_status", "expected_article", "expected_code")
        .agg(F.min(F.when(hit, F.col("rank"))).alias("hit_rank"), F.count("item_id").alias("candidates"))
    )


def metrics(ranks: DataFrame, k: int = 5) -> DataFrame:
    """One row: total, skipped (doubtful), applicable (found or analog, with an expectation), recall at k, precision at
    1, mean reciprocal rank, and how many lines labelled not found have no candidate."""
    expects = F.col("expected_article").isNotNull() | F.col("expected_code").isNotNull()
    applicable = F.col("label_status").isin(FOUND, ANALOG) & expects
    absent = F.col("label_status") == NOT_FOUND
    n = F.count_if(applicable)
    share = lambda c: F.when(n > 0, F.count_if(applicable & c) / F.greatest(n, F.lit(1)))
    return ranks.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("label_status") == DOUBTFUL).alias("skipped"),
        n.alias("applicable"),
        F.round(share(F.col("hit_rank") <= k), 6).alias("recall_at_k"),
        F.round(share(F.col("hit_rank") == 1), 6).alias("precision_at_1"),
        F.round(F.when(n > 0, F.sum(F.when(applicable, F.coalesce(1 / F.col("hit_rank"), F.lit(0.0)))) / F.greatest(n, F.lit(1))), 6).alias("mrr"),
        F.count_if(absent).alias("not_found"),
        F.count_if(absent & (F.col("candidates") == 0)).alias("not_found_right"),
    )


def status_counts(gold: DataFrame) -> DataFrame:
    return gold.groupBy(F.lower("label_status").alias("label_status")).agg(F.count(F.lit(1)).alias("rows"))


def metric_report(measured: DataFrame) -> DataFrame:
    """The metrics as rows of (metric, value)."""
    doubles = measured.select(*(F.col(c).cast("double").alias(c) for c in measured.columns))
    return doubles.unpivot([], doubles.columns, "metric", "value")


def result_columns(ranks: DataFrame, candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Of each gold row the top candidate and whether the expectation was met (yes, no, or blank without one)."""
    top = candidates.filter("rank = 1 and source_type = 'company_catalog'").select(F.col("spec_item_id").alias("gold_id"), "item_id", "confidence")
    top = top.join(items.select("item_id", F.col("article_raw").alias("top_article"), F.col("code_1c").alias("top_code_1c")), "item_id")
    expects = F.col("expected_article").isNotNull() | F.col("expected_code").isNotNull()
    matched = F.when(~expects, "").when(F.col("hit_rank").isNotNull(), "yes").otherwise("no")
    return ranks.join(top, "gold_id", "left").select("gold_id", "top_article", "top_code_1c", "confidence", matched.alias("matched"))


def from_lines(lines: DataFrame, verifications: DataFrame, items: DataFrame, explicit: DataFrame) -> DataFrame:
    """Gold rows from lines (explicit: spec_item_id, expected_item_id, label_status). The explicit item goes before the
    chosen one, the explicit status before the one that follows from the decision."""
    derived = F.when(F.col("decision") == "confirmed", FOUND).when(F.col("decision") == "not_found", NOT_FOUND).otherwise(DOUBTFUL)
    card = items.select(
        F.col("item_id").alias("target"), F.col("article_raw").alias("expected_article"), F.col("code_1c").alias("expected_code_1c"), F.col("name").alias("expected_name")
    )
    joined = lines.join(explicit, "spec_item_id").join(verifications.select("spec_item_id", "decision", "chosen_item_id"), "spec_item_id", "left")
    joined = joined.withColumn("target", F.coalesce("expected_item_id", "chosen_item_id"))
    return joined.join(card, "target", "left").select(
        F.col("spec_item_id").alias("gold_id"), "spec_item_id", F.col("name_raw").alias("name"), F.col("article_raw").alias("article"),
        F.col("manufacturer_raw").alias("manufacturer"), F.col("attributes_raw").alias("attributes"), F.col("unit_raw").alias("unit"),
        "expected_article", "expected_code_1c", "expected_name", F.coalesce("label_status", derived).alias("label_status"),
    )


def with_snapshot(gold: DataFrame, items: DataFrame) -> DataFrame:
    """Create or update gold rows that name an expected item (expected_item_id): fields that are given stay, the others
    come from the item."""
    card = items.select(F.col("item_id").alias("expected_item_id"), F.col("article_raw").alias("a"), F.col("code_1c").alias("c"), F.col("name").alias("n"))
    filled = {"expected_article": "a", "expected_code_1c": "c", "expected_name": "n"}
    out = gold.join(card, "expected_item_id", "left").withColumns({k: F.coalesce(k, v) for k, v in filled.items()})
    return out.drop("a", "c", "n")


def by_status(gold: DataFrame, status: str) -> DataFrame:
    return gold.filter(F.lower("label_status") == status).orderBy("created_at", "gold_id")


def export_table(gold: DataFrame) -> DataFrame:
    """The gold set as a table to be filled in: numbered, with empty result columns."""
    from pyspark.sql import Window

    # numbering one labelled set, which people fill in by hand
    number = F.row_number().over(Window.partitionBy("source_file").orderBy("gold_id"))
    empty = F.lit(None).cast("string")
    return gold.select(
        number.alias("row_num"), "source_file", "name", "article", "manufacturer", "attributes", "unit", "expected_article", "expected_code_1c", "expected_name",
        "label_status", *(empty.alias(c) for c in ("top_article", "top_code_1c", "confidence", "matched")),
    )
