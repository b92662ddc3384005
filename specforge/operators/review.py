"""Review of matched lines: decisions, auto-confirmation, segments, counters, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

DECISIONS = ("confirmed", "rejected", "not_found", "new_item_requested", "forwarded")
HIGH, LOW = 0.9, 0.5
# Labels of decisions in the result table.
DECISION_LABELS = {
    "confirmed": "Подтверждено",
    "not_found": "Не найдено (отметка менеджера)",
    "rejected": "Отклонено",
    "new_item_requested": "Требуется новая позиция каталога",
    "forwarded": "Передано в МОС",
}
UNVERIFIED_LABEL, NO_CANDIDATE_LABEL = "Не верифицировано", "Не найдено (нет кандидатов)"


def current_decisions(log: DataFrame, spec_items: DataFrame, items: DataFrame) -> DataFrame:
    """The last decision of each line (decided_at, then event_id); only a confirmation keeps its item. Entries of unknown
    lines, and confirmations of unknown items, do not count; an entry with a null decision undoes what was decided."""
    known = log.join(spec_items.select("spec_item_id"), "spec_item_id", "left_semi")
    present = items.select(F.col("item_id").alias("chosen_item_id")).distinct().withColumn("present", F.lit(True))
    valid = known.join(present, "chosen_item_id", "left").filter("decision is null or decision != 'confirmed' or present")
    kept = ["decision", "decided_by", "decided_at", "chosen_item_id"]
    last = valid.groupBy("spec_item_id").agg(F.max_by(F.struct(*kept), F.struct("decided_at", "event_id")).alias("d"))
    out = last.select("spec_item_id", *(F.col(f"d.{c}").alias(c) for c in kept)).filter("decision is not null")
    return out.withColumn("chosen_item_id", F.when(F.col("decision") == "confirmed", F.col("chosen_item_id")))


def _catalog_first() -> Column:
    return (F.col("source_type") != "company_catalog").cast("int")


def best_candidates(candidates: DataFrame) -> DataFrame:
    """The candidate each line is confirmed with: of rank 1 the catalog card, else the supplier item."""
    order = Window.partitionBy("spec_item_id").orderBy(_catalog_first(), F.desc("confidence"), F.col("item_id"))
    first = candidates.filter("rank = 1").withColumn("rn", F.row_number().over(order))
    return first.filter("rn = 1").drop("rn")


def auto_confirm(candidates: DataFrame, verifications: DataFrame, threshold: float = HIGH, only_unverified: bool = True) -> DataFrame:
    """Confirmations for lines whose best candidate reaches the threshold: spec_item_id, chosen_item_id, confidence."""
    best = best_candidates(candidates).filter(F.col("confidence") >= F.lit(threshold).cast("decimal(5,4)"))
    if only_unverified:
        best = best.join(verifications.select("spec_item_id"), "spec_item_id", "left_anti")
    return best.select("spec_item_id", F.col("item_id").alias("chosen_item_id"), "confidence", F.lit("confirmed").alias("decision"))


def auto_confirm_counts(spec_items: DataFrame, candidates: DataFrame, verifications: DataFrame, threshold: float = HIGH) -> DataFrame:
    """What auto-confirmation would do, as one row: lines, already verified, without candidate, below, confirmed."""
    best = best_candidates(candidates).select("spec_item_id", F.col("confidence").alias("best"))
    done = verifications.select("spec_item_id").distinct().withColumn("done", F.lit(True))
    joined = spec_items.select("spec_item_id").join(best, "spec_item_id", "left").join(done, "spec_item_id", "left")
    open_, limit = F.col("done").isNull(), F.lit(threshold).cast("decimal(5,4)")
    count = lambda c: F.count_if(c)
    return joined.agg(
        F.count(F.lit(1)).alias("lines"),
        count(~open_).alias("already_verified"),
        count(open_ & F.col("best").isNull()).alias("no_candidate"),
        count(open_ & (F.col("best") < limit)).alias("below_threshold"),
        count(open_ & (F.col("best") >= limit)).alias("confirmed"),
    )


def bulk_decide(chosen: DataFrame, candidates: DataFrame, decision: str) -> DataFrame:
    """One decision for chosen lines (spec_item_id); to confirm needs a candidate."""
    best = best_candidates(candidates).select("spec_item_id", F.col("item_id").alias("chosen_item_id"))
    lines = chosen.select("spec_item_id").distinct()
    if decision == "confirmed":
        return lines.join(best, "spec_item_id").withColumn("decision", F.lit(decision))
    return lines.select("spec_item_id", F.lit(None).cast("string").alias("chosen_item_id"), F.lit(decision).alias("decision"))


def line_states(spec_items: DataFrame, candidates: DataFrame, verifications: DataFrame, high: float = HIGH, low: float = LOW) -> DataFrame:
    """spec_item_id, spec_id, line_number, best (largest confidence of rank 1 over both source types), decision and
    band: high, mid, low or no_candidate."""
    best = candidates.filter("rank = 1").groupBy("spec_item_id").agg(F.max("confidence").alias("best"))
    out = spec_items.select("spec_item_id", "spec_id", "line_number").join(best, "spec_item_id", "left")
    out = out.join(verifications.select("spec_item_id", "decision"), "spec_item_id", "left")
    at = lambda x: F.col("best") >= F.lit(x).cast("decimal(5,4)")
    return out.withColumn("band", F.when(F.col("best").isNull(), "no_candidate").when(at(high), "high").when(at(low), "mid").otherwise("low"))


SEGMENTS = {
    "all": "true",
    "pending": "decision is null",
    "confirmed": "decision = 'confirmed'",
    "rejected": "decision = 'rejected'",
    "forwarded": "decision = 'forwarded'",
    "high": "band = 'high'",
    "mid": "band = 'mid'",
    "low": "band = 'low'",
    "no_candidate": "band = 'no_candidate'",
}


def segment(states: DataFrame, name: str) -> DataFrame:
    return states.filter(SEGMENTS[name])


def sorted_lines(states: DataFrame, by_confidence: bool = False, descending: bool = True) -> DataFrame:
    """By line, or by best confidence with lines without one last; ties by line."""
    best = F.col("best").desc_nulls_last() if descending else F.col("best").asc_nulls_last()
    return states.orderBy(*([best] if by_confidence else []), "spec_id", "line_number")


def nested_lines(states: DataFrame, candidates: DataFrame, verifications: DataFrame, gold: DataFrame) -> DataFrame:
    """A line with its candidates of both source types, chosen item, and the latest gold row made from it."""
    listed = F.sort_array(F.collect_list(F.struct("rank", "item_id", "confidence", "match_type")))
    by_type = candidates.groupBy("spec_item_id", "source_type").agg(listed.alias("list"))
    both = by_type.groupBy("spec_item_id").agg(
        F.first(F.when(F.col("source_type") == "company_catalog", F.col("list")), ignorenulls=True).alias("catalog"),
        F.first(F.when(F.col("source_type") == "supplier_pricelist", F.col("list")), ignorenulls=True).alias("suppliers"),
    )
    latest = gold.groupBy("spec_item_id").agg(F.max_by("gold_id", F.struct("created_at", "gold_id")).alias("gold_id"))
    return (
        states.join(both, "spec_item_id", "left")
        .join(verifications.select("spec_item_id", "chosen_item_id"), "spec_item_id", "left")
        .join(latest, "spec_item_id", "left")
    )


def counters(states: DataFrame) -> DataFrame:
    """Counters of each specification by band and decision."""
    band = lambda b: F.count_if(F.col("band") == b)
    return states.groupBy("spec_id").agg(
        F.count(F.lit(1)).alias("total"),
        band("high").alias("high"),
        band("mid").alias("medium"),
        band("low").alias("low"),
        band("no_candidate").alias("no_candidate"),
        (band("low") + band("no_candidate")).alias("not_found"),
        F.count("decision").alias("verified"),
        F.count_if(F.col("decision").isNull()).alias("pending"),
        *(F.count_if(F.col("decision") == d).alias(f"decided_{d}") for d in DECISIONS),
    )


def derived_status(states: DataFrame) -> DataFrame:
    """A specification is verified when every line is decided, else in review."""
    done = F.count("decision") == F.count(F.lit(1))
    return states.groupBy("spec_id").agg(F.when(done, "verified").otherwise("reviewing").alias("status"))


def specification_list(specifications: DataFrame, counted: DataFrame) -> DataFrame:
    """Specifications with their counters; newest first when it is sorted by created_at and spec_id."""
    return specifications.join(counted, "spec_id", "left").fillna(0, [c for c in counted.columns if c != "spec_id"])


def supplier_list(suppliers: DataFrame, items: DataFrame) -> DataFrame:
    active = items.groupBy(F.col("source_id").alias("supplier_id")).agg(F.count_if("is_active").alias("active_items"))
    return suppliers.select("supplier_id", "name").join(active, "supplier_id", "left").fillna(0, ["active_items"])


def catalog_summary(items: DataFrame) -> DataFrame:
    return items.filter("source_id = 'catalog'").agg(F.count_if("is_active").alias("active"), F.count(F.lit(1)).alias("total"))


def item_snapshot(items: DataFrame) -> DataFrame:
    return items.agg(F.count_if("is_active").alias("active"), F.count(F.lit(1)).alias("total"))


def client_list(clients: DataFrame, specifications: DataFrame, part_of_name: str = "") -> DataFrame:
    counted = specifications.groupBy("client_id").agg(F.count(F.lit(1)).alias("specs"))
    found = clients.filter(F.contains(F.lower("client_name"), F.lit(part_of_name.lower())))
    return found.join(counted, "client_id", "left").fillna(0, ["specs"])


def band_distribution(candidates: DataFrame, high: float = HIGH, low: float = LOW) -> DataFrame:
    """Rank-1 candidates by confidence band, and the best confidence."""
    at = lambda x: F.col("confidence") >= F.lit(x).cast("decimal(5,4)")
    return candidates.filter("rank = 1").agg(
        F.count_if(at(high)).alias("high"), F.count_if(~at(high) & at(low)).alias("mid"), F.count_if(~at(low)).alias("low"), F.max("confidence").alias("best")
    )


def winners(spec_items: DataFrame, candidates: DataFrame, verifications: DataFrame) -> DataFrame:
    """spec_item_id, item_id, decision label: the confirmed item, else none for other decisions, else the top candidate,
    catalog first."""
    order = Window.partitionBy("spec_item_id").orderBy(_catalog_first(), "rank", "item_id")
    top = candidates.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("spec_item_id", F.col("item_id").alias("top"))
    joined = spec_items.select("spec_item_id").join(verifications.select("spec_item_id", "decision", "chosen_item_id"), "spec_item_id", "left").join(top, "spec_item_id", "left")
    labels = F.create_map(*(F.lit(x) for pair in DECISION_LABELS.items() for x in pair))
    falls_through = F.col("decision").isNull() | ((F.col("decision") == "confirmed") & F.col("chosen_item_id").isNull())
    return joined.select(
        "spec_item_id",
        F.when(falls_through, F.col("top")).when(F.col("decision") == "confirmed", F.col("chosen_item_id")).alias("item_id"),
        F.when(~falls_through, labels[F.col("decision")]).when(F.col("top").isNotNull(), UNVERIFIED_LABEL).otherwise(NO_CANDIDATE_LABEL).alias("decision"),
    )


def export_rows(spec_items: DataFrame, candidates: DataFrame, verifications: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """The result table: one row for each line with what was chosen for it and why."""
    columns = ["item_id", "source_id", "article_raw", "code_1c", "name", "manufacturer", "price", "unit"]
    optional = [c for c in ("supplier_sku", "category_path", "currency", "linked_catalog_item_id") if c in items.columns]
    chosen = items.select(*(F.col(c).alias(f"chosen_{c}") for c in columns + optional))
    label = sources.select(F.col("source_id").alias("chosen_source_id"), T.source_label(F.col("source_type"), F.col("source_name")).alias("source"))
    scored = candidates.groupBy("spec_item_id", "item_id").agg(F.max("confidence").alias("confidence"), F.min("match_type").alias("match_type"))
    won = winners(spec_items, candidates, verifications)
    out = (
        spec_items.join(won, "spec_item_id")
        .join(scored, ["spec_item_id", "item_id"], "left")
        .join(chosen, F.col("item_id") == F.col("chosen_item_id"), "left")
        .join(label, "chosen_source_id", "left")
    )
    if "linked_catalog_item_id" in optional:
        cards = items.select(F.col("item_id").alias("card_id"), F.coalesce("code_1c", "article_raw").alias("catalog_card"))
        out = out.join(cards, F.col("chosen_linked_catalog_item_id") == F.col("card_id"), "left")
    else:
        out = out.withColumn("catalog_card", F.lit(None).cast("string"))
    given = lambda c: F.col(f"chosen_{c}") if c in optional else F.lit(None).cast("string")
    return out.select(
        "spec_item_id", "spec_id", "line_number", "name_raw", "article_raw", "manufacturer_raw",
        T.decimal_text(F.col("quantity")).alias("quantity"), "unit_raw", T.decimal_text(F.col("price_raw")).alias("price_raw"), "decision", "source",
        given("category_path").alias("category_path"), F.col("chosen_article_raw").alias("chosen_article"), "chosen_code_1c",
        given("supplier_sku").alias("chosen_supplier_sku"), "catalog_card", "chosen_name", "chosen_manufacturer",
        T.decimal_text(F.col("chosen_price")).alias("chosen_price"), given("currency").alias("chosen_currency"), "chosen_unit",
        F.round("confidence", 3).cast("decimal(4,3)").cast("string").alias("confidence"), "match_type",
    )


def write_csv(rows: DataFrame, path: str) -> None:
    """Semicolon-separated files with a header; nulls are empty."""
    rows.write.option("sep", ";").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
