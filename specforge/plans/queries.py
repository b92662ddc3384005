"""Queries over the driver's tables, one for each operator, and the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..operators import attributes as A
from ..operators import cells as C
from ..operators import gold as G
from ..operators import hybrid as H
from ..operators import importer as I
from ..operators import insights as X
from ..operators import matching as M
from ..operators import quality as Q
from ..operators import review as R
from ..operators import search as E
from ..operators import synonyms as Y
from ..operators import transform as C2
from ..operators import units as U
from ..operators import vectors as V
from ..sources import files as L
from ..sources import tables as D
from ..streaming import jobs as J
from ..streaming.store import ItemStore
from .storage import settled, shared_path

QUERIES: dict = {}
SQL: dict[str, str] = {}
_WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}]"
_CLEAN = rf"nullif(trim(regexp_replace(translate(%s, chr(160)||chr(8239)||chr(8201)||chr(8203)||chr(65279), '     '), '{_WS}+', ' ', 'g')), '')"


def clean(column: str) -> str:
    return _CLEAN % column


def article(column: str) -> str:
    return rf"nullif(upper(regexp_replace({clean(column)}, '[\s\-./*\\]+', '', 'g')), '')"


def query(name: str, sql: str | None = None, tables: bool = True):
    """Register a query; sql is preceded by the common table expressions unless it stands alone."""

    def add(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = (D.TABLES_SQL if tables else "") + sql
        return run

    return add


# --- delimited files ---------------------------------------------------------------------------------------------------


@query("a1_delimited", """ SELECT partkey::varchar AS partkey, replace(p_name, ' ', chr(10)) || ' "' || brand || '"' AS name, full_name || ';' AS other, (partkey % 50)::varchar AS stock FROM parts_""")
def a1(spark, d):
    """Parts written as files with line breaks, quotes and delimiters inside quotes, and read again in pieces."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    name = quoted(F.concat(F.translate("p_name", " ", "\n"), F.lit(' "'), "brand", F.lit('"')))
    path = shared_path(spark)
    D.parts(spark, d).select(F.concat_ws(";", F.col("partkey").cast("string"), name, quoted(F.concat("full_name", F.lit(";"))), (F.col("partkey") % 50).cast("string")).alias("value")).write.text(path)
    rows = L.read_delimited(spark, path, delimiter=";").groupBy("file_id", "row_idx").agg(F.map_from_entries(F.collect_list(F.struct("col_idx", "value"))).alias("x"))
    return rows.select(*(F.col("x")[i].alias(name) for i, name in enumerate(("partkey", "name", "other", "stock"))))


# --- scalar functions -------------------------------------------------------------------------------------------------


@query("b1_clean_string", f"SELECT doc_id, md5({clean('text')}) AS cleaned FROM documents", tables=False)
def b1(spark, d):
    return D.read(spark, d, "documents").select("doc_id", F.md5(T.clean_string(F.col("text")).cast("binary")).alias("cleaned"))


@query("b2_normalize_article", f", r AS (SELECT spec_item_id, article_raw AS a FROM spec_items_) SELECT spec_item_id, {article('a')} AS article FROM r")
def b2(spark, d):
    return D.spec_items(spark, d).select("spec_item_id", T.normalize_article(F.col("article_raw")).alias("article"))


@query("b3_normalize_name", f"SELECT doc_id, md5(lower({clean('text')})) AS name FROM documents", tables=False)
def b3(spark, d):
    return D.read(spark, d, "documents").select("doc_id", F.md5(T.normalize_name(F.col("text")).cast("binary")).alias("name"))


_MARK = "|".join(m.replace(r"\w", r"[\p{L}\p{N}_]").replace("\\s", r"\s") for m in T.MARKERS)
_DENOISED = rf"""
  h AS (SELECT spec_item_id, {clean('name_raw')} AS s,
          CASE WHEN regexp_matches({clean('name_raw')}, '(?i)(^|[^\p{{L}}\p{{N}}_])(?:{_MARK})([^\p{{L}}\p{{N}}_]|$)')
            THEN trim(regexp_extract({clean('name_raw')}, '(?is)^(|.*?[^\p{{L}}\p{{N}}_])(?:{_MARK})([^\p{{L}}\p{{N}}_]|$)', 1), ' .,:;–—-+/') END AS head FROM spec_items_),
  denoised AS (SELECT spec_item_id, CASE WHEN head IS NULL OR length(head) < 10 OR len(string_split(head, ' ')) < 2 THEN s ELSE head END AS name FROM h)"""


@query("b4_denoise_name", f", {_DENOISED} SELECT spec_item_id, name FROM denoised")
def b4(spark, d):
    return D.spec_items(spark, d).select("spec_item_id", T.denoise_name(F.col("name_raw")).alias("name"))


_CANDIDATES = rf"""list_filter(list_transform(list_filter(list_transform(regexp_split_to_array({{0}}, '[\s,;()\[\]]+'), lambda w: trim(w, ' .,:;')),
   lambda w: regexp_matches(w, '[0-9]') AND NOT regexp_matches(w, '(?i)({'|'.join(T.DIMENSIONS)})$')
     AND (regexp_matches(w, '\p{{{{L}}}}') OR length(regexp_replace(w, '[^0-9]', '', 'g')) >= 5)),
   lambda w: upper(regexp_replace(w, '[\s\-./*\\]+', '', 'g'))), lambda a: length(a) >= 3)"""


@query("b5_article_candidates", ", r AS (SELECT spec_item_id, name_raw FROM spec_items_) SELECT spec_item_id, array_to_string(list_sort(list_distinct(" + _CANDIDATES.format("name_raw") + ")), ',') AS candidates FROM r")
def b5(spark, d):
    return D.spec_items(spark, d).select("spec_item_id", F.array_join(F.array_sort(T.article_candidates(F.col("name_raw"))), ",").alias("candidates"))


@query("b6_code_tokens", r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]{5,}'))), ',') AS tokens FROM documents", tables=False)
def b6(spark, d):
    return D.read(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(T.code_tokens(F.col("text"))), ",").alias("tokens"))


_WRITTEN = r"""r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_linenumber,
  CASE l_partkey % 7 WHEN 0 THEN l_extendedprice::decimal(18,2)::varchar WHEN 1 THEN replace(l_extendedprice::decimal(18,2)::varchar, '.', ',')
   WHEN 2 THEN '≈ ' || l_quantity::int || ' шт' WHEN 3 THEN l_quantity::int || '-' || (l_quantity::int + 5) WHEN 4 THEN 'по запросу'
   WHEN 5 THEN '1,' || lpad((l_partkey % 1000)::varchar, 3, '0') || '.5' ELSE '-' || l_quantity::int || ' 000,25' END AS written,
  CASE l_partkey % 7 WHEN 0 THEN l_extendedprice::decimal(38,10) WHEN 1 THEN l_extendedprice::decimal(38,10) WHEN 2 THEN l_quantity::decimal(38,10)
   WHEN 3 THEN l_quantity::decimal(38,10) WHEN 5 THEN (1000 + l_partkey % 1000 + 0.5)::decimal(38,10) WHEN 6 THEN (-(l_quantity * 1000 + 0.25))::decimal(38,10) END AS value FROM lineitem)"""


def _written(spark, d):
    q, price = F.col("l_quantity").cast("int"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    n = F.col("l_partkey") % 7
    text = (
        F.when(n == 0, price).when(n == 1, F.replace(price, F.lit("."), F.lit(","))).when(n == 2, F.concat(F.lit("≈ "), q, F.lit(" шт")))
        .when(n == 3, F.concat(q, F.lit("-"), q + 5)).when(n == 4, "по запросу")
        .when(n == 5, F.concat(F.lit("1,"), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"), F.lit(".5"))).otherwise(F.concat(F.lit("-"), q, F.lit(" 000,25")))
    )
    return D.read(spark, d, "lineitem").withColumn("written", text)


@query("b7_parse_decimal", f"WITH {_WRITTEN} SELECT written, value::double AS value, count(*) AS n FROM r GROUP BY 1, 2", tables=False)
def b7(spark, d):
    return _written(spark, d).select("written", T.parse_decimal(F.col("written")).cast("double").alias("value")).groupBy("written", "value").agg(F.count(F.lit(1)).alias("n"))


@query("b8_parse_int", f"WITH {_WRITTEN} SELECT written, trunc(value)::bigint AS value, count(*) AS n FROM r GROUP BY 1, 2", tables=False)
def b8(spark, d):
    return _written(spark, d).select("written", T.parse_int(F.col("written")).alias("value")).groupBy("written", "value").agg(F.count(F.lit(1)).alias("n"))


@query("b9_normalize_label", "SELECT item_id, lower(trim(manufacturer)) AS manufacturer, lower(trim(unit)) AS unit FROM items_")
def b9(spark, d):
    return D.items(spark, d).select("item_id", T.normalize_label(F.col("manufacturer")).alias("manufacturer"), T.normalize_label(F.col("unit")).alias("unit"))


@query("b10_lexical_query", f", {_DENOISED} SELECT spec_item_id, lower(name) AS query FROM denoised")
def b10(spark, d):
    return D.spec_items(spark, d).select("spec_item_id", T.lexical_query(F.col("name_raw"), F.col("attributes_raw")).alias("query"))


@query("b11_match_inputs", f", {_DENOISED}" + ", r AS (SELECT * FROM spec_items_) SELECT spec_item_id, " + article("article_raw") + " AS article, lower(denoised.name) AS lexical_query, CASE WHEN article_raw IS NULL THEN array_to_string(list_sort(list_distinct(" + _CANDIDATES.format("name_raw") + ")), ',') ELSE '' END AS candidates, lower(manufacturer_raw) AS manufacturer, unit_raw AS unit FROM r JOIN denoised USING (spec_item_id)")
def b11(spark, d):
    return M.match_inputs(D.spec_items(spark, d)).select("spec_item_id", "article", "lexical_query", F.array_join(F.array_sort("article_candidates"), ",").alias("candidates"), "manufacturer", "unit")


_GRAMS = r"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i::bigint, 3)))))"


@query("b12_trigram_similarity", f", g AS (SELECT partkey, {_GRAMS.format('full_name')} AS g FROM parts_) SELECT a.partkey, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS similarity FROM g a JOIN g b ON b.partkey = a.partkey + 1")
def b12(spark, d):
    p = D.parts(spark, d)
    n = p.select((F.col("partkey") - 1).alias("partkey"), F.col("full_name").alias("other"))
    return p.join(n, "partkey").select("partkey", F.round(S.similarity(F.col("full_name"), F.col("other")), 6).alias("similarity"))


_RU = S._RU_ENDING
_STEMS = r"list_distinct(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '' AND NOT list_contains({1}, w)), lambda w: CASE WHEN regexp_matches(w, '[а-яё]') THEN regexp_replace(w, '^(.*?\p{{L}}{{3}}){2}', '\1') ELSE regexp_replace(w, '([a-z]{{2}}[a-rt-z])s$', '\1') END))"


@query("b13_stems", f", r AS (SELECT DISTINCT name_raw FROM spec_items_) SELECT name_raw, array_to_string(list_sort({_STEMS.format('name_raw', S.STOP_WORDS, _RU)}), ',') AS stems FROM r")
def b13(spark, d):
    return D.spec_items(spark, d).select("name_raw").distinct().select("name_raw", F.array_join(F.array_sort(S.stems(F.col("name_raw"))), ",").alias("stems"))


@query("b14_text_rank", f", r AS (SELECT partkey, {_STEMS.format('p_name', S.STOP_WORDS, _RU)} AS q, {_STEMS.format('full_name', S.STOP_WORDS, _RU)} AS n FROM parts_), x AS (SELECT partkey, 0.1 * len(list_intersect(q, n)) / len(n) AS r FROM r) SELECT partkey, round(r / (r + 1), 6) AS rank FROM x")
def b14(spark, d):
    return D.parts(spark, d).select("partkey", F.round(S.text_rank(S.stems(F.col("p_name")), S.stems(F.col("full_name"))), 6).alias("rank"))


@query("b15_decimal_text", r"SELECT spec_item_id, regexp_replace(price_raw::varchar, '\.?0+$', '') AS price, regexp_replace(quantity::varchar, '\.?0+$', '') AS quantity FROM spec_items_")
def b15(spark, d):
    return D.spec_items(spark, d).select("spec_item_id", T.decimal_text(F.col("price_raw")).alias("price"), T.decimal_text(F.col("quantity")).alias("quantity"))


@query("b17_key_label", "SELECT item_id, CASE WHEN code_1c IS NOT NULL THEN 'code ' || code_1c WHEN article_normalized IS NOT NULL THEN 'article ' || article_normalized || ' / ' || manufacturer_normalized END AS label FROM items_")
def b17(spark, d):
    return D.items(spark, d).select("item_id", T.key_label(F.col("code_1c"), F.col("article_normalized"), F.col("manufacturer_normalized")).alias("label"))


@query("b18_source_label", "SELECT source_id, CASE WHEN source_type = 'company_catalog' THEN 'Каталог компании' ELSE 'Прайс: ' || source_name END AS label FROM sources_")
def b18(spark, d):
    return D.sources(spark, d).select("source_id", T.source_label(F.col("source_type"), F.col("source_name")).alias("label"))


@query("b19_manual_article", r"SELECT DISTINCT name_raw, nullif(regexp_replace(upper(name_raw), '[^\p{L}\p{N}]', '', 'g'), '') AS article FROM spec_items_")
def b19(spark, d):
    return D.spec_items(spark, d).select("name_raw", T.manual_article(F.col("name_raw")).alias("article")).distinct()


# --- supplier transformations -----------------------------------------------------------------------------------------

_ROWS = """, rows_ AS (SELECT partkey, suppkey, 'S' || suppkey AS supplier_id, CASE WHEN partkey % 2 = 0 THEN full_name || ' // ' || brand ELSE full_name END AS name,
  CASE WHEN partkey % 3 = 0 THEN brand END AS manufacturer, offer AS price, CASE WHEN partkey % 4 = 0 THEN 'м' ELSE '' END AS unit
  FROM (SELECT l_partkey AS partkey, l_suppkey AS suppkey, min(l_extendedprice)::decimal(18,4) AS offer FROM lineitem GROUP BY 1, 2) JOIN parts_ USING (partkey))"""


def _transformed(spark, d):
    offers = D.read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey")).agg(F.min("l_extendedprice").cast("decimal(18,4)").alias("price"))
    rows = offers.join(D.parts(spark, d).drop("price"), "partkey").select(
        "partkey", "suppkey", F.concat(F.lit("S"), "suppkey").alias("supplier_id"),
        F.when(F.col("partkey") % 2 == 0, F.concat("full_name", F.lit(" // "), "brand")).otherwise(F.col("full_name")).alias("name"),
        F.when(F.col("partkey") % 3 == 0, F.col("brand")).alias("manufacturer"), "price",
        F.when(F.col("partkey") % 4 == 0, "м").otherwise("").alias("unit"), F.lit(None).cast("string").alias("currency"),
    )
    settings = D.suppliers(spark, d).drop("name", "prefix")
    return C2.apply(rows, settings)


_SPLIT = "suppkey % 6 = 0 AND manufacturer IS NULL AND contains(name, ' // ')"


@query("c1_brand_from_name", _ROWS + f" SELECT partkey, suppkey, CASE WHEN {_SPLIT} THEN split_part(name, ' // ', 1) ELSE name END AS name FROM rows_")
def c1(spark, d):
    return _transformed(spark, d).select("partkey", "suppkey", "name")


@query("c2_vat_removal", _ROWS + " SELECT partkey, suppkey, CASE WHEN suppkey % 3 = 0 THEN round_even((price / 1.2)::decimal(28,10), 4) ELSE price END::double AS price FROM rows_")
def c2(spark, d):
    return _transformed(spark, d).select("partkey", "suppkey", F.col("price").cast("double").alias("price"))


@query("c3_defaults", _ROWS + " SELECT partkey, suppkey, CASE WHEN unit <> '' THEN unit WHEN suppkey % 5 = 0 THEN 'шт' END AS unit, 'RUB' AS currency FROM rows_")
def c3(spark, d):
    return _transformed(spark, d).select("partkey", "suppkey", "unit", "currency")


@query("c4_forced_manufacturer", _ROWS + f" SELECT partkey, suppkey, CASE WHEN suppkey % 7 = 0 THEN 'Forced' WHEN {_SPLIT} THEN split_part(name, ' // ', 2) ELSE manufacturer END AS manufacturer FROM rows_")
def c4(spark, d):
    return _transformed(spark, d).select("partkey", "suppkey", "manufacturer")


@query("c5_settings", "SELECT 'S' || s_suppkey AS supplier_id, CASE WHEN s_suppkey % 4 = 0 THEN 20.0::double END AS vat_rate, s_suppkey % 4 <> 0 AS is_noop FROM supplier", tables=False)
def c5(spark, d):
    raw = F.when(F.col("s_suppkey") % 4 == 0, '{"vat_rate": 20, "default_currency": "RUB"}').when(F.col("s_suppkey") % 4 == 1, "{broken").when(F.col("s_suppkey") % 4 == 2, "{}")
    texts = D.read(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("supplier_id"), raw.alias("settings"))
    return C2.is_noop(C2.load_settings(texts)).select("supplier_id", F.col("vat_rate").cast("double").alias("vat_rate"), "is_noop")


@query("c7_settings_by_name", "SELECT n_name AS name FROM nation UNION ALL SELECT s_name || 'x' FROM supplier WHERE s_suppkey % 2 = 1", tables=False)
def c7(spark, d):
    given = D.read(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("AAA").alias("prefix"))
    own = D.read(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 2 == 1, F.concat("s_name", F.lit("x"))).otherwise(F.col("s_name")).alias("name"), F.lit("BBB").alias("prefix"))
    return C2.import_settings(given.unionByName(own), D.suppliers(spark, d))[1]


@query("c8_force_stored", "SELECT item_id, CASE WHEN is_active AND source_id <> 'catalog' AND substr(source_id, 2)::int % 7 = 0 THEN 'Forced' ELSE manufacturer END AS manufacturer FROM items_")
def c8(spark, d):
    return C2.force_manufacturer(D.items(spark, d), D.suppliers(spark, d)).select("item_id", "manufacturer")


# --- import -----------------------------------------------------------------------------------------------------------

_KEY = "CASE WHEN code_1c IS NOT NULL THEN 'C|' || code_1c WHEN {a} IS NOT NULL THEN 'A|' || {a} || '|' || coalesce(lower(manufacturer), '') END"
_IN = ", incoming AS (SELECT *, " + _KEY.format(a=article("article_raw")) + " AS key FROM new_lists_), firsts AS (SELECT * FROM incoming WHERE key IS NULL OR true QUALIFY key IS NULL OR row_number() OVER (PARTITION BY source_id, key ORDER BY line_number) = 1)"
_OLD = ", keyed AS (SELECT *, " + _KEY.format(a="article_normalized") + " AS key FROM stored_)"


@query("d1_validate", " SELECT source_id, line_number, 'name is empty' AS error FROM new_lists_ WHERE trim(name) = ''")
def d1(spark, d):
    return I.validate(D.new_price_lists(spark, d))[1]


@query("d2_incoming_key", _IN + " SELECT source_id, line_number, key FROM incoming")
def d2(spark, d):
    return I.incoming_key(D.new_price_lists(spark, d)).select("source_id", "line_number", "key")


@query("d3_stored_key", _OLD + " SELECT item_id, key FROM keyed")
def d3(spark, d):
    return I.stored_key(D.stored_items(spark, d)).select("item_id", "key")


@query("d4_drop_repeats", _IN + " SELECT source_id, line_number FROM firsts")
def d4(spark, d):
    return I.drop_repeats(D.new_price_lists(spark, d)).select("source_id", "line_number")


@query("d5_repeats", _IN + " SELECT source_id, key, min(line_number) AS first_line, count(*) - 1 AS others FROM incoming WHERE key IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def d5(spark, d):
    return I.repeats(D.new_price_lists(spark, d)).select("source_id", "key", "first_line", F.size("other_lines").cast("long").alias("others"))


def _upserted(spark, d, mode):
    rows = I.validate(D.new_price_lists(spark, d))[0]
    return I.upsert(D.stored_items(spark, d), rows, mode)


_VALID = _IN.replace("FROM new_lists_)", "FROM new_lists_ WHERE trim(name) <> '')") + _OLD
_UPSERT = """, touched AS (SELECT DISTINCT source_id FROM firsts),
 target AS (SELECT * FROM keyed SEMI JOIN touched USING (source_id) WHERE key IS NOT NULL {only} QUALIFY row_number() OVER (PARTITION BY source_id, key ORDER BY is_active DESC, item_id) = 1),
 hit AS (SELECT t.item_id, f.* FROM target t JOIN firsts f USING (source_id, key)),
 done AS (SELECT k.source_id, k.item_id, coalesce(h.price, k.price) AS price, CASE WHEN h.item_id IS NOT NULL THEN 'updated' WHEN {retire} THEN 'deactivated' ELSE 'kept' END AS change
   FROM keyed k LEFT JOIN hit h USING (item_id) UNION ALL
   SELECT source_id, NULL, price, 'inserted' FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.source_id = f.source_id AND hit.line_number = f.line_number))"""  # fmt: skip
_MERGE_SQL = _VALID + _UPSERT.format(only="AND is_active", retire="false")
_REPLACE_SQL = _VALID + _UPSERT.format(only="", retire="k.is_active AND k.source_id IN (SELECT source_id FROM touched)")


def _changes(df):
    return df.select("source_id", F.when(F.col("change") != "inserted", F.col("item_id")).alias("item_id"), F.col("price").cast("double").alias("price"), "change")


@query("d6_upsert_merge", _MERGE_SQL + " SELECT source_id, item_id, price::double AS price, change FROM done")
def d6(spark, d):
    return _changes(_upserted(spark, d, I.MERGE))


@query("d7_upsert_replace", _REPLACE_SQL + " SELECT source_id, item_id, price::double AS price, change FROM done")
def d7(spark, d):
    return _changes(_upserted(spark, d, I.REPLACE))


@query("d8_import_report", _REPLACE_SQL + """, c AS (SELECT source_id, count(*) FILTER (change = 'inserted') AS inserted, count(*) FILTER (change = 'updated') AS updated,
  count(*) FILTER (change = 'deactivated') AS deactivated FROM done GROUP BY 1) SELECT source_id, count(*) AS rows_read, count(*) FILTER (trim(name) = '') AS errors,
  coalesce(max(inserted), 0) AS inserted, coalesce(max(updated), 0) AS updated, coalesce(max(deactivated), 0) AS deactivated FROM new_lists_ LEFT JOIN c USING (source_id) GROUP BY 1""")  # fmt: skip
def d8(spark, d):
    return I.report(_upserted(spark, d, I.REPLACE), D.new_price_lists(spark, d))




def _numbered(spark, d):
    suppliers = D.suppliers(spark, d).withColumn("prefix", F.when(F.substring("supplier_id", 2, 9).cast("long") % 5 == 0, "OLD").when(F.col("prefix").isNotNull(), F.concat(F.lit("P"), F.substring("supplier_id", 2, 9))))
    return I.assign_sku(D.stored_items(spark, d), suppliers)


_SKU_SQL = _OLD + """, s AS (SELECT k.*, CASE WHEN s_suppkey % 5 = 0 THEN 'OLD' WHEN s_suppkey % 4 <> 3 THEN 'P' || s_suppkey END AS prefix FROM keyed k LEFT JOIN supplier ON 'S' || s_suppkey = source_id),
 res AS (SELECT source_id, key, supplier_sku AS reserved FROM s WHERE supplier_sku IS NOT NULL AND key IS NOT NULL
   QUALIFY row_number() OVER (PARTITION BY source_id, key ORDER BY is_active DESC, supplier_sku) = 1),
 hi AS (SELECT source_id, coalesce(max(regexp_extract(supplier_sku, '-([0-9]+)$', 1)::bigint) FILTER (starts_with(supplier_sku, prefix || '-')), 0) AS highest FROM s GROUP BY 1),
 st AS (SELECT s.*, reserved, highest, CASE WHEN supplier_sku IS NULL AND prefix IS NOT NULL AND is_active THEN CASE WHEN reserved IS NOT NULL THEN 1 ELSE 2 END ELSE 0 END AS state
   FROM s LEFT JOIN res USING (source_id, key) JOIN hi USING (source_id)),
 nth AS (SELECT *, row_number() OVER (PARTITION BY source_id, state ORDER BY created_s, article_raw NULLS FIRST, item_id) AS n FROM st)
 SELECT item_id, CASE state WHEN 1 THEN reserved WHEN 2 THEN prefix || '-' || CASE WHEN highest + n > 999999 THEN (highest + n)::varchar ELSE lpad((highest + n)::varchar, 6, '0') END ELSE supplier_sku END AS supplier_sku FROM nth"""  # fmt: skip


@query("d9_assign_sku", _SKU_SQL)
def d9(spark, d):
    return _numbered(spark, d).select("item_id", "supplier_sku")


@query("d13_backfill_sku", _SKU_SQL.replace("SELECT item_id, CASE state", "SELECT item_id, source_id, CASE state") + " WHERE state > 0")
def d13(spark, d):
    before = D.stored_items(spark, d).filter("supplier_sku is null").select("item_id")
    return _numbered(spark, d).filter("supplier_sku is not null").join(before, "item_id", "left_semi").select("item_id", "source_id", "supplier_sku")


_LINK_SQL = """, cards AS (SELECT * FROM stored_ WHERE source_id = 'catalog' AND is_active),
 b AS (SELECT article_normalized, manufacturer_normalized, item_id AS card FROM cards WHERE article_normalized IS NOT NULL QUALIFY row_number() OVER (PARTITION BY article_normalized, manufacturer_normalized ORDER BY created_s, item_id) = 1),
 a AS (SELECT article_normalized, item_id AS card FROM cards WHERE article_normalized IS NOT NULL QUALIFY row_number() OVER (PARTITION BY article_normalized ORDER BY created_s, item_id) = 1),
 o AS (SELECT s.*, source_id <> 'catalog' AND is_active AND catalog_link_source IS DISTINCT FROM 'manual' AS open_, coalesce(b.card, a.card) AS card
   FROM stored_ s LEFT JOIN b USING (article_normalized, manufacturer_normalized) LEFT JOIN a USING (article_normalized)),
 linked AS (SELECT item_id, CASE WHEN open_ THEN card ELSE linked_catalog_item_id END AS linked_catalog_item_id,
   CASE WHEN open_ THEN CASE WHEN card IS NOT NULL THEN 'auto' END ELSE catalog_link_source END AS catalog_link_source, card, open_, source_id, is_active FROM o)"""  # fmt: skip


@query("d10_link_to_catalog", _LINK_SQL + " SELECT item_id, linked_catalog_item_id, catalog_link_source FROM linked")
def d10(spark, d):
    return I.link_to_catalog(D.stored_items(spark, d)).select("item_id", "linked_catalog_item_id", "catalog_link_source")


# price-list rows that hold a code: of a card, of none, or of a card other than the one their article leads to
_CODED = "(SELECT * REPLACE (CASE WHEN source_id = 'catalog' THEN code_1c WHEN key_ % 7 = 2 THEN 'C' || (key_ + 3) WHEN key_ % 7 = 4 THEN 'C' || key_ WHEN key_ % 7 = 5 THEN 'X' || key_ END AS code_1c) FROM stored_)"


@query("d10_link_by_code", f""", coded AS MATERIALIZED {_CODED}, cards AS (SELECT * FROM coded WHERE source_id = 'catalog' AND is_active),
 k AS (SELECT code_1c, item_id AS card FROM cards WHERE code_1c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code_1c ORDER BY created_s, item_id) = 1),
 b AS (SELECT article_normalized, manufacturer_normalized, item_id AS card FROM cards WHERE article_normalized IS NOT NULL AND manufacturer_normalized IS NOT NULL QUALIFY row_number() OVER (PARTITION BY article_normalized, manufacturer_normalized ORDER BY created_s, item_id) = 1),
 a AS (SELECT article_normalized, item_id AS card FROM cards WHERE article_normalized IS NOT NULL QUALIFY row_number() OVER (PARTITION BY article_normalized ORDER BY created_s, item_id) = 1)
 SELECT c.item_id, coalesce(k.card, b.card, a.card) AS linked_catalog_item_id, CASE WHEN coalesce(k.card, b.card, a.card) IS NOT NULL THEN 'auto' END AS catalog_link_source
 FROM coded c LEFT JOIN k USING (code_1c) LEFT JOIN b ON b.article_normalized = c.article_normalized AND b.manufacturer_normalized = c.manufacturer_normalized LEFT JOIN a ON a.article_normalized = c.article_normalized
 WHERE c.source_id <> 'catalog' AND c.is_active AND c.key_ % 10 <> 0""")  # fmt: skip
def d10_by_code(spark, d):
    """Links of price-list items without a link by hand, where some hold a code: the code goes before the article."""
    key = F.regexp_extract("item_id", r"^[cp](\d+)", 1).cast("long")
    listed, n = F.col("source_id") != "catalog", key % 7
    code = F.when(~listed, F.col("code_1c")).when(n == 2, F.concat(F.lit("C"), key + 3)).when(n == 4, F.concat(F.lit("C"), key)).when(n == 5, F.concat(F.lit("X"), key))
    linked = I.link_to_catalog(D.stored_items(spark, d).withColumn("code_1c", code))
    return linked.filter(listed & F.col("is_active") & (key % 10 != 0)).select("item_id", "linked_catalog_item_id", "catalog_link_source")


@query("p2_price_list_feed", _REPLACE_SQL + """ SELECT done.source_id, done.item_id, done.price::double AS price, CASE change WHEN 'kept' THEN s.is_active ELSE change <> 'deactivated' END AS is_active
 FROM done LEFT JOIN stored_ s ON s.item_id = done.item_id""")
def p2(spark, d):
    """The new price lists as a feed into the versioned store, delivered twice: the second delivery changes nothing."""
    stored, rows = settled(D.stored_items(spark, d)), D.new_price_lists(spark, d)
    base = shared_path(spark)
    rows.write.parquet(f"{base}/feed")
    store = ItemStore(spark, f"{base}/store", stored.schema)
    store.update("first", 0, [r[0] for r in stored.select("source_id").distinct().collect()], lambda _: stored)  # names of suppliers
    for progress in ("p1", "p2"):
        # files_a_batch: all lists in one batch
        J.store_price_lists(spark, f"{base}/feed", rows.schema, f"{base}/{progress}", store, D.suppliers(spark, d), files_a_batch=1_000_000).awaitTermination()
    known = stored.select("item_id").withColumn("known", F.lit(True))
    after = store.items().join(known, "item_id", "left")
    return after.select("source_id", F.when(F.col("known"), F.col("item_id")).alias("item_id"), F.col("price").cast("double").alias("price"), "is_active")


def _overrides(items):
    key = F.regexp_extract("item_id", r"^p(\d+)", 1).try_cast("long")
    card = F.when(key % 2 == 0, F.concat(F.lit("c"), (key + 1).cast("string"))).when(key % 3 == 0, "nothing")
    return items.filter("source_id != 'catalog'").filter(key % 6 != 5).select("item_id", card.alias("card_id"))


@query("d11_set_links", """, o AS (SELECT item_id, key_, CASE WHEN key_ % 2 = 0 THEN 'c' || (key_ + 1) WHEN key_ % 3 = 0 THEN 'nothing' END AS card FROM stored_ WHERE source_id <> 'catalog' AND key_ % 6 <> 5),
 v AS (SELECT * FROM o WHERE card IS NULL OR card IN (SELECT item_id FROM stored_ WHERE source_id = 'catalog'))
 SELECT item_id, CASE WHEN v.item_id IS NOT NULL THEN card ELSE linked_catalog_item_id END AS linked_catalog_item_id, CASE WHEN v.item_id IS NOT NULL THEN 'manual' ELSE catalog_link_source END AS catalog_link_source FROM stored_ LEFT JOIN v USING (item_id)""")  # fmt: skip
def d11(spark, d):
    items = D.stored_items(spark, d)
    return I.set_links(items, _overrides(items)).select("item_id", "linked_catalog_item_id", "catalog_link_source")


@query("d12_reset_links", _LINK_SQL + """ SELECT item_id, CASE WHEN catalog_link_source = 'manual' THEN CASE WHEN is_active THEN card END ELSE linked_catalog_item_id END AS linked_catalog_item_id,
 CASE WHEN catalog_link_source = 'manual' THEN CASE WHEN is_active AND card IS NOT NULL THEN 'auto' END ELSE catalog_link_source END AS catalog_link_source FROM linked""")  # fmt: skip
def d12(spark, d):
    items = D.stored_items(spark, d)
    manual = items.filter("catalog_link_source = 'manual'").select("item_id")
    return I.reset_links(items, manual).select("item_id", "linked_catalog_item_id", "catalog_link_source")


@query("d14_purge", " SELECT item_id FROM items_ WHERE is_active OR item_id IN (SELECT item_id FROM candidates_) OR item_id IN (SELECT chosen_item_id FROM decisions_)")
def d14(spark, d):
    return I.purge(D.items(spark, d), D.candidates(spark, d), D.decisions(spark, d)).select("item_id")


@query("d15_sources", """, im AS (SELECT 'S' || (user_id % 150) AS source_id, max(ts) AS last_synced_at FROM events GROUP BY 1)
 SELECT source_id, coalesce(source_type, 'supplier_pricelist') AS source_type, coalesce(source_name, 'new') AS source_name, coalesce(status, 'active') AS status, last_synced_at FROM sources_ FULL JOIN im USING (source_id)""")  # fmt: skip
def d15(spark, d):
    imports = D.read(spark, d, "events").select(F.concat(F.lit("S"), F.col("user_id") % 150).alias("source_id"), F.lit(D.PRICE_LIST).alias("source_type"), F.lit("new").alias("source_name"), F.col("ts").alias("at"))
    return I.synced_sources(D.sources(spark, d), imports)


@query("d16_client_ids", "SELECT left(sha256(c_name), 16) AS client_id, c_name AS client_name, count(*) AS specs FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 2", tables=False)
def d16(spark, d):
    named = D.specifications(spark, d).join(D.clients(spark, d), "client_id").drop("client_id")
    return I.client_ids(named)[1].groupBy("client_id", "client_name").agg(F.count(F.lit(1)).alias("specs"))


# --- search and matching ----------------------------------------------------------------------------------------------

_POOLED = ", pooled AS (SELECT i.*, source_type, source_name FROM items_ i JOIN sources_ USING (source_id) WHERE is_active AND status = 'active')"


def _pooled(spark, d):
    return E.searchable(D.items(spark, d), D.sources(spark, d))


_EXACT = _POOLED + f""", asked AS (SELECT DISTINCT {article('article_raw')} AS query FROM spec_items_ WHERE article_raw IS NOT NULL),
 exact AS (SELECT query, item_id, source_type, manufacturer_normalized, unit, name FROM asked JOIN pooled ON query = article_normalized
   QUALIFY row_number() OVER (PARTITION BY query ORDER BY source_type, name, item_id) <= 20)"""


def _articles(spark, d):
    return D.spec_items(spark, d).select(T.normalize_article(F.col("article_raw")).alias("query")).filter("query is not null").distinct()


@query("e1_exact_article", _EXACT + " SELECT query, item_id FROM exact")
def e1(spark, d):
    return E.exact_article(_articles(spark, d), _pooled(spark, d)).select("query", "item_id")


def _alike_sql(name: str, asked: str, known: str, threshold: float) -> str:
    """CTE `name` (query, key, score): all pairs of the values of two tables of one column that share enough trigrams."""
    grams = lambda c: _GRAMS.format(c)
    return f""", {name}_q AS MATERIALIZED (SELECT row_number() OVER () AS i, v, {grams('v')} AS g FROM {asked}), {name}_k AS MATERIALIZED (SELECT row_number() OVER () AS j, v, {grams('v')} AS g FROM {known}),
 {name}_p AS (SELECT i, j, na, nb, count(*) AS c FROM (SELECT i, len(g) AS na, unnest(g) AS w FROM {name}_q) JOIN (SELECT j, len(g) AS nb, unnest(g) AS w FROM {name}_k) USING (w)
   WHERE nb >= {threshold} * na AND na >= {threshold} * nb GROUP BY ALL HAVING count(*)::double / (na + nb - count(*)) >= {threshold}::double - 1e-9),
 {name} AS (SELECT q.v AS query, k.v AS key, c::double / (na + nb - c) AS score FROM {name}_p JOIN {name}_q q USING (i) JOIN {name}_k k USING (j))"""


def _best_sql(name: str, hits: str, column: str) -> str:
    return f", {name} AS MATERIALIZED (SELECT query, item_id, score FROM {hits} JOIN pooled ON {column} = key QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, name, item_id) <= 20)"


_NAMES_SQL = f""", asked_names AS (SELECT DISTINCT lower(name) AS v FROM denoised WHERE name IS NOT NULL), known_names AS (SELECT DISTINCT name_normalized AS v FROM pooled WHERE name_normalized IS NOT NULL){_alike_sql('alike', 'asked_names', 'known_names', E.NAME_SIMILARITY)},
 qs AS (SELECT v, {_STEMS.format('v', S.STOP_WORDS, _RU)} AS s FROM asked_names), ks AS (SELECT v, {_STEMS.format('v', S.STOP_WORDS, _RU)} AS s FROM known_names),
 held AS (SELECT query, key, any_value(nq) AS nq, any_value(nk) AS nk FROM (SELECT v AS query, len(s) AS nq, unnest(s) AS w FROM qs) JOIN (SELECT v AS key, len(s) AS nk, unnest(s) AS w FROM ks) USING (w) GROUP BY 1, 2 HAVING count(*) = any_value(nq)),
 held_scores AS (SELECT query, key, 1e-1 * nq / nk AS r, len(list_intersect(q.g, k.g))::double / len(list_distinct(list_concat(q.g, k.g))) AS sim FROM held JOIN alike_q q ON q.v = query JOIN alike_k k ON k.v = key),
 name_hits AS (SELECT query, key, max(score) AS score FROM (SELECT query, key, score FROM alike UNION ALL SELECT query, key, greatest(r / (r + 1), sim) FROM held_scores) GROUP BY 1, 2){_best_sql('lexical', 'name_hits', 'name_normalized')}"""  # fmt: skip


@query("e2_fuzzy_article", _EXACT + ", asked_articles AS (SELECT query AS v FROM asked), known_articles AS (SELECT DISTINCT article_normalized AS v FROM pooled WHERE article_normalized IS NOT NULL)" + _alike_sql("near", "asked_articles", "known_articles", E.ARTICLE_SIMILARITY) + _best_sql("fuzzy", "near", "article_normalized") + " SELECT query, item_id, round(score, 6) AS score FROM fuzzy")
def e2(spark, d):
    return E.fuzzy_article(_articles(spark, d), settled(_pooled(spark, d))).withColumn("score", F.round("score", 6))


@query("e3_lexical_name", f", {_DENOISED}" + _POOLED + _NAMES_SQL + " SELECT query, item_id, round(score, 6) AS score FROM lexical")
def e3(spark, d):
    asked = D.spec_items(spark, d).select(T.lexical_query(F.col("name_raw"), F.col("attributes_raw")).alias("query")).distinct()
    return E.lexical_name(asked, settled(_pooled(spark, d))).withColumn("score", F.round("score", 6))


@query("e4_code_in_name", _POOLED + """, t AS (SELECT DISTINCT unnest(regexp_extract_all(name_raw, '[0-9]{5,}')) AS query FROM spec_items_), n AS (SELECT DISTINCT name_normalized FROM pooled WHERE regexp_matches(name_normalized, '[0-9]{5}')),
 h AS (SELECT query, name_normalized FROM t JOIN n ON contains(name_normalized, query))
 SELECT query, item_id FROM h JOIN pooled USING (name_normalized) QUALIFY row_number() OVER (PARTITION BY query ORDER BY name, item_id) <= 20""")  # fmt: skip
def e4(spark, d):
    tokens = D.spec_items(spark, d).select(F.explode(T.code_tokens(F.col("name_raw"))).alias("query")).distinct()
    return E.code_in_name(tokens, settled(_pooled(spark, d))).select("query", "item_id")


@query("e5_manufacturers", _POOLED + " SELECT DISTINCT manufacturer_normalized AS brand FROM pooled WHERE manufacturer_normalized <> ''")
def e5(spark, d):
    return E.known_manufacturers(_pooled(spark, d))


@query("e6_linked_cards", " SELECT s.item_id, s.linked_catalog_item_id AS card_id FROM stored_ s JOIN stored_ c ON c.item_id = s.linked_catalog_item_id AND c.is_active")
def e6(spark, d):
    return E.linked_cards(D.stored_items(spark, d))


@query("e7_source_filter", _POOLED + " SELECT item_id, source_type FROM pooled WHERE source_type = 'supplier_pricelist'")
def e7(spark, d):
    return E.searchable(D.items(spark, d), D.sources(spark, d), E.SourceFilter(types=(D.PRICE_LIST,))).select("item_id", "source_type")


_TYPED = "(SELECT CASE partkey % 3 WHEN 0 THEN coalesce(article, p_name) WHEN 1 THEN substr(full_name, 3, CASE WHEN partkey % 200 = 0 THEN 2 ELSE 12 END) ELSE 'C' || partkey END AS query FROM parts_ WHERE partkey % 100 = 0 GROUP BY 1)"


@query("e8_manual_search", f""", it AS (SELECT * FROM items_ JOIN sources_ USING (source_id) WHERE is_active), q AS (SELECT query, {clean('query')} AS q FROM {_TYPED}), q2 AS (SELECT *, nullif(regexp_replace(upper(q), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '') AS a FROM q)
 SELECT query, item_id, row_number() OVER (PARTITION BY query ORDER BY coalesce(code_1c = q, false) DESC, coalesce(article_normalized = a, false) DESC, source_type, name, item_id) AS place
 FROM q2 JOIN it ON code_1c = q OR article_normalized = a OR contains(lower(name), lower(q)) QUALIFY place <= 20""")  # fmt: skip
def e8(spark, d):
    n = F.col("partkey") % 3
    typed = D.parts(spark, d).filter("partkey % 100 = 0").select(
        F.when(n == 0, F.coalesce("article", "p_name")).when(n == 1, F.substring("full_name", F.lit(3), F.when(F.col("partkey") % 200 == 0, 2).otherwise(12))).otherwise(F.concat(F.lit("C"), "partkey")).alias("query")
    )
    items = D.items(spark, d).filter("is_active").join(D.sources(spark, d), "source_id").withColumn("supplier_sku", F.lit(None).cast("string"))
    return E.manual_search(typed, settled(items)).withColumn("place", F.col("place").cast("long"))


@query("e9_semantic_search", """WITH v AS (SELECT vec_id AS id, embedding::double[] AS e FROM embeddings WHERE list_dot_product(embedding::double[], embedding::double[]) > 0)
 SELECT q.id AS query, v.id, round(list_cosine_similarity(q.e, v.e), 6) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.e, v.e), 6) DESC, v.id) AS rank
 FROM v q JOIN v ON q.id % 100 = 0 QUALIFY rank <= 10""", tables=False)
def e9(spark, d):
    """The ten vectors nearest to each hundredth one, exactly."""
    vectors = D.read(spark, d, "embeddings")
    asked = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "embedding")
    return V.nearest(V.vector_index(vectors), asked).withColumn("rank", F.col("rank").cast("long"))


@query("e10_hybrid_search", f""", n AS (SELECT count(*) AS n FROM embeddings), v AS (SELECT vec_id, embedding::double[] AS e FROM embeddings),
 q AS (SELECT partkey AS query, {_GRAMS.format("p_name")} AS qg, {_STEMS.format("p_name", S.STOP_WORDS, _RU)} AS qs, e AS qe FROM parts_, n JOIN v ON vec_id = (partkey * 7 + 3) % n WHERE partkey % 100 = 0),
 k AS (SELECT partkey AS id, {_GRAMS.format("full_name")} AS kg, {_STEMS.format("full_name", S.STOP_WORDS, _RU)} AS ks, e AS ke FROM parts_, n JOIN v ON vec_id = partkey % n),
 x AS (SELECT query, id, len(list_intersect(qg, kg))::double / len(list_distinct(list_concat(qg, kg))) AS alike, len(list_intersect(qs, ks)) = len(qs) AS held, 1e-1 * len(qs) / len(ks) AS r,
   round(list_cosine_similarity(qe, ke), 6) AS semantic FROM q, k),
 y AS (SELECT query, id, round(CASE WHEN held THEN greatest(r / (r + 1), alike) WHEN alike >= 0.3::double - 1e-9 THEN alike ELSE 0 END, 6) AS lexical, semantic FROM x)
 SELECT query, id, lexical, semantic, round(0.5::double * lexical + 0.5::double * semantic, 9) AS score, row_number() OVER (PARTITION BY query ORDER BY round(0.5::double * lexical + 0.5::double * semantic, 9) DESC, id) AS rank
 FROM y QUALIFY rank <= 10""")
def e10(spark, d):
    """Each hundredth part's name with a vector, against the full names and vectors of all parts."""
    parts, vectors = settled(D.parts(spark, d).select("partkey", F.lower("p_name").alias("asked"), F.lower("full_name").alias("name_normalized"))), D.read(spark, d, "embeddings")
    n = vectors.count()
    given = lambda key: parts.withColumn("vec_id", key).join(vectors, "vec_id")
    queries = given((F.col("partkey") * 7 + 3) % n).filter("partkey % 100 = 0").select(F.col("partkey").alias("query"), "asked", "embedding")
    hits = E.lexical_hits(queries.select(F.col("asked").alias("query")), parts).withColumnsRenamed({"query": "asked", "key": "name_normalized"})
    hits = queries.select("query", "asked").join(hits, "asked").join(parts.select(F.col("partkey").alias("id"), "name_normalized"), "name_normalized")
    index = V.vector_index(given(F.col("partkey") % n), key="partkey")
    return H.hybrid_search(index, queries, hits.select("query", "id", "score")).withColumn("rank", F.col("rank").cast("long"))


@query("f1_brands", _POOLED + rf""", b AS (SELECT DISTINCT manufacturer_normalized AS brand FROM pooled WHERE length(manufacturer_normalized) >= 3 AND NOT regexp_matches(manufacturer_normalized, '[^\p{{L}}\p{{N}}_]')),
 w AS (SELECT spec_item_id, unnest(regexp_extract_all(lower(name_raw), '[\p{{L}}\p{{N}}_]+')) AS brand, generate_subscripts(regexp_extract_all(lower(name_raw), '[\p{{L}}\p{{N}}_]+'), 1) AS pos FROM spec_items_ WHERE manufacturer_raw IS NULL),
 f AS (SELECT spec_item_id, arg_min(brand, pos) AS found FROM w JOIN b USING (brand) GROUP BY 1)
 SELECT spec_item_id, coalesce(lower(manufacturer_raw), found) AS brand FROM spec_items_ LEFT JOIN f USING (spec_item_id)""")  # fmt: skip
def f1(spark, d):
    inputs = settled(M.match_inputs(D.spec_items(spark, d)))
    brands = M.detect_brands(inputs.dropDuplicates(["qid"]), _pooled(spark, d))
    return inputs.join(brands, "qid").select("spec_item_id", "brand")


@query("f2_exact_lines", _EXACT + f""", l AS (SELECT spec_item_id, {article('article_raw')} AS query, lower(manufacturer_raw) AS brand FROM spec_items_ WHERE article_raw IS NOT NULL),
 c AS (SELECT spec_item_id, item_id, source_type, name, 0.95 + CASE WHEN brand = manufacturer_normalized THEN 0.03 ELSE 0 END + CASE WHEN unit = 'шт' THEN 0.02 ELSE 0 END AS confidence FROM l JOIN exact USING (query))
 SELECT spec_item_id, item_id, confidence::double AS confidence, row_number() OVER (PARTITION BY spec_item_id, source_type ORDER BY confidence DESC, name, item_id) AS rank FROM c QUALIFY rank <= 5""")  # fmt: skip
def f2(spark, d):
    """Lines whose article hits exactly: the short cut of the cascade, scored and ranked. A line without a stated brand
    and whose name holds none gets no brand bonus."""
    lines = D.spec_items(spark, d).filter("article_raw is not null")
    inputs = settled(M.match_inputs(lines))
    queries = settled(inputs.drop("spec_item_id").dropDuplicates(["qid"]))
    pooled = settled(_pooled(spark, d))
    asked = queries.select("qid", F.col("article").alias("query"))
    hits = asked.join(E.exact_article(asked.select("query").distinct(), pooled), "query").select("qid", "item_id", F.lit("exact").alias("channel"), "score", F.lit(None).cast("string").alias("code"))
    ranked = M.rank(M.score(M.merge_hits(hits), queries, M.detect_brands(queries, pooled), pooled))
    return inputs.select("spec_item_id", "qid").join(ranked, "qid").select("spec_item_id", "item_id", F.col("confidence").cast("double").alias("confidence"), F.col("rank").cast("long").alias("rank"))


def _round_sql(x: str, digits: int) -> str:
    """Half up on the shortest decimal that reads back as the double, as Spark rounds."""
    return f"round((({x})::double)::varchar::decimal(38,18), {digits})"


_CANDS = _CANDIDATES.format("name_raw")
#: The whole match over the item store: channels, merged hits, scores, ranks, promoted cards. The stages are named as the functions are.
_MATCH_SQL = rf""", {_DENOISED}, pooled AS MATERIALIZED (SELECT i.*, source_type FROM stored_ i JOIN sources_ USING (source_id) WHERE is_active AND status = 'active'),
 known_brands AS (SELECT DISTINCT manufacturer_normalized AS brand FROM pooled WHERE length(manufacturer_normalized) >= 3 AND NOT regexp_matches(manufacturer_normalized, '[^\p{{L}}\p{{N}}_]')),
 named AS (SELECT spec_item_id, arg_min(brand, pos) AS found FROM (SELECT spec_item_id, unnest(regexp_extract_all(lower(name_raw), '[\p{{L}}\p{{N}}_]+')) AS brand, generate_subscripts(regexp_extract_all(lower(name_raw), '[\p{{L}}\p{{N}}_]+'), 1) AS pos FROM spec_items_ WHERE manufacturer_raw IS NULL) JOIN known_brands USING (brand) GROUP BY 1),
 lines AS MATERIALIZED (SELECT spec_item_id, {article('article_raw')} AS article, lower(denoised.name) AS lexical_query, name_raw, coalesce(lower(trim(manufacturer_raw)), found) AS brand, lower(trim(unit_raw)) AS unit FROM spec_items_ JOIN denoised USING (spec_item_id) LEFT JOIN named USING (spec_item_id)),
 all_articles AS (SELECT article_normalized AS code, item_id FROM pooled WHERE article_normalized IS NOT NULL QUALIFY row_number() OVER (PARTITION BY article_normalized ORDER BY source_type, name, item_id) <= 20),
 exact_hits AS MATERIALIZED (SELECT spec_item_id, item_id FROM lines JOIN all_articles ON article = code),
 rest AS MATERIALIZED (SELECT * FROM lines ANTI JOIN exact_hits USING (spec_item_id)),
 mined AS MATERIALIZED (SELECT spec_item_id, unnest(list_distinct({_CANDS})) AS code FROM rest WHERE article IS NULL),
 mined_exact AS (SELECT spec_item_id, code, item_id FROM mined JOIN all_articles USING (code)),
 mined_left AS (SELECT * FROM mined ANTI JOIN mined_exact USING (spec_item_id, code)),
 asked_articles AS (SELECT article AS v FROM rest WHERE article IS NOT NULL UNION SELECT code FROM mined_left), known_articles AS (SELECT DISTINCT article_normalized AS v FROM pooled WHERE article_normalized IS NOT NULL){_alike_sql('near', 'asked_articles', 'known_articles', E.ARTICLE_SIMILARITY)}{_best_sql('fuzzy', 'near', 'article_normalized')}{_NAMES_SQL.replace("FROM denoised WHERE name IS NOT NULL", "FROM denoised SEMI JOIN rest USING (spec_item_id) WHERE name IS NOT NULL")},
 tokens AS (SELECT spec_item_id, unnest(list_distinct(regexp_extract_all(name_raw, '[0-9]{{5,}}'))) AS code FROM rest),
 token_hits AS (SELECT query, name_normalized AS key, 1.0::double AS score FROM (SELECT DISTINCT code AS query FROM tokens) JOIN (SELECT DISTINCT name_normalized FROM pooled WHERE regexp_matches(name_normalized, '[0-9]{{5}}')) ON contains(name_normalized, query)){_best_sql('in_names', 'token_hits', 'name_normalized')},
 hits AS MATERIALIZED (SELECT spec_item_id, item_id, 'exact' AS channel, 1.0::double AS score, NULL AS code FROM exact_hits
   UNION ALL SELECT spec_item_id, item_id, 'fuzzy', score, NULL FROM rest JOIN fuzzy ON query = article
   UNION ALL SELECT spec_item_id, item_id, 'lexical', score, NULL FROM rest JOIN lexical ON query = lexical_query
   UNION ALL SELECT spec_item_id, item_id, 'code_exact', 1.0, code FROM mined_exact
   UNION ALL SELECT spec_item_id, item_id, 'code_fuzzy', score, code FROM mined_left JOIN fuzzy ON query = code
   UNION ALL SELECT spec_item_id, item_id, 'code_name', 1.0, code FROM tokens JOIN in_names ON query = code),
 merged AS (SELECT spec_item_id, item_id, coalesce(max(score) FILTER (channel = 'exact'), 0) AS exact, coalesce(max(score) FILTER (channel = 'fuzzy'), 0) AS fuzzy, coalesce(max(score) FILTER (channel = 'lexical'), 0) AS lexical,
   max(score) FILTER (channel = 'code_exact') AS c_exact, max(score) FILTER (channel = 'code_fuzzy') AS c_fuzzy, max(score) FILTER (channel = 'code_name') AS c_name,
   min({{'s': -CASE channel WHEN 'code_exact' THEN 3.0 WHEN 'code_fuzzy' THEN 1.0 + score ELSE 1.0 END, 'code': code}}) FILTER (code IS NOT NULL) AS coded FROM hits GROUP BY 1, 2),
 facts AS (SELECT m.*, p.source_type, p.name, l.article, coalesce(lower(trim(l.brand)) = lower(trim(p.manufacturer_normalized)) AND trim(l.brand) <> '', false) AS brand_match,
   coalesce(lower(trim(l.unit)) = lower(trim(p.unit)) AND trim(l.unit) <> '', false) AS unit_match,
   CASE WHEN exact >= 1 THEN 'none' WHEN c_exact >= 1 THEN 'exact' WHEN c_name >= 1 THEN 'in_name' WHEN c_fuzzy > 0 THEN 'fuzzy' ELSE 'none' END AS how
   FROM merged m JOIN pooled p USING (item_id) JOIN lines l USING (spec_item_id)),
 scored AS (SELECT *, CASE WHEN exact >= 1 THEN 0.95::double + CASE WHEN brand_match THEN 0.03 ELSE 0 END::double + CASE WHEN unit_match THEN 0.02 ELSE 0 END::double
   ELSE CASE WHEN article IS NOT NULL THEN 0.5::double * fuzzy + 0.5::double * lexical ELSE lexical END + CASE WHEN brand_match THEN 0.1 ELSE 0 END::double + CASE WHEN unit_match THEN 0.05 ELSE 0 END::double
     + CASE how WHEN 'exact' THEN 0.25::double WHEN 'in_name' THEN 0.18::double WHEN 'fuzzy' THEN 0.12::double * c_fuzzy ELSE 0 END END AS total FROM facts),
 typed AS (SELECT spec_item_id, item_id, source_type, name, {_round_sql('greatest(0, least(1, total))', 4)}::decimal(5,4) AS confidence,
   CASE WHEN exact >= 1 THEN 'exact_article' WHEN fuzzy > 0 THEN CASE WHEN fuzzy >= lexical THEN 'fuzzy_article' ELSE 'lexical' END WHEN how <> 'none' AND lexical < 0.5 THEN 'fuzzy_article' ELSE 'lexical' END AS match_type,
   concat_ws(', ', CASE WHEN exact >= 1 THEN 'артикул совпал точно' WHEN fuzzy > 0 THEN 'артикул похож (similarity=' || {_round_sql('fuzzy', 6)}::decimal(10,6)::decimal(4,2)::varchar || ')' END,
     CASE how WHEN 'exact' THEN 'код из наименования совпал (' || coded.code || ')' WHEN 'in_name' THEN 'код найден в наименовании каталога (' || coded.code || ')' WHEN 'fuzzy' THEN 'код из наименования похож' END,
     CASE WHEN lexical > 0 THEN 'наименование близко (score=' || {_round_sql('lexical', 6)}::decimal(10,6)::decimal(4,2)::varchar || ')' END,
     CASE WHEN brand_match THEN 'совпал бренд' END, CASE WHEN unit_match THEN 'совпала единица измерения' END) AS why FROM scored),
 ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY spec_item_id, source_type ORDER BY confidence DESC, name, item_id) AS rank FROM typed QUALIFY rank <= 5),
 own_cards AS (SELECT * FROM ranked WHERE source_type = 'company_catalog'),
 promoted AS (SELECT b.spec_item_id, b.card_id AS item_id, 'company_catalog' AS source_type, c.name, b.b.confidence, 'hybrid' AS match_type, b.b.why
   FROM (SELECT spec_item_id, s.linked_catalog_item_id AS card_id, arg_max({{'confidence': confidence, 'why': why}}, {{'confidence': confidence, 'item_id': r.item_id}}) AS b
         FROM ranked r JOIN stored_ s USING (item_id) WHERE source_type = 'supplier_pricelist' AND s.linked_catalog_item_id IS NOT NULL GROUP BY 1, 2) b
   JOIN stored_ c ON c.item_id = b.card_id AND c.is_active ANTI JOIN own_cards o ON o.spec_item_id = b.spec_item_id AND o.item_id = b.card_id),
 cards_again AS (SELECT spec_item_id, item_id, source_type, name, confidence, match_type, why, row_number() OVER (PARTITION BY spec_item_id ORDER BY confidence DESC, name, item_id) AS rank
   FROM (SELECT spec_item_id, item_id, source_type, name, confidence, match_type, why FROM own_cards UNION ALL SELECT * FROM promoted) QUALIFY rank <= 5),
 matched AS (SELECT spec_item_id, item_id, source_type, confidence, match_type, rank, CASE WHEN why = '' THEN 'слабое совпадение' ELSE upper(left(why, 1)) || substr(why, 2) END AS why FROM cards_again
   UNION ALL SELECT spec_item_id, item_id, source_type, confidence, match_type, rank, CASE WHEN why = '' THEN 'слабое совпадение' ELSE upper(left(why, 1)) || substr(why, 2) END FROM ranked WHERE source_type = 'supplier_pricelist')"""  # fmt: skip


def _matched(spark, d):
    return M.match(D.spec_items(spark, d), D.stored_items(spark, d), D.sources(spark, d))


@query("f13_match", _MATCH_SQL + " SELECT spec_item_id, item_id, source_type, rank, confidence::double AS confidence, match_type, why AS human_readable FROM matched")
def f13(spark, d):
    return _matched(spark, d).select("spec_item_id", "item_id", "source_type", F.col("rank").cast("long").alias("rank"), F.col("confidence").cast("double").alias("confidence"), "match_type", "human_readable")


def _hits(spark, d):
    """Lines, their queries, the pool and the hits of all channels."""
    lines = settled(M.match_inputs(D.spec_items(spark, d)))
    queries = settled(lines.drop("spec_item_id").dropDuplicates(["qid"]))
    pooled = settled(E.searchable(D.stored_items(spark, d), D.sources(spark, d)).select(*M.POOLED))
    return lines.select("spec_item_id", "qid"), queries, pooled, settled(M.all_hits(queries, pooled))


@query("f4_channel_hits", _MATCH_SQL + " SELECT spec_item_id, item_id, channel, round(score, 6) AS score, code FROM hits")
def f4(spark, d):
    lines, _, _, hits = _hits(spark, d)
    return lines.join(hits, "qid").select("spec_item_id", "item_id", "channel", F.round("score", 6).alias("score"), "code")


@query("f6_merged_hits", _MATCH_SQL + " SELECT spec_item_id, item_id, round(exact, 6) AS exact, round(fuzzy, 6) AS fuzzy, round(lexical, 6) AS lexical, coded.code AS code FROM merged")
def f6(spark, d):
    lines, _, _, hits = _hits(spark, d)
    score = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c)
    return lines.join(M.merge_hits(hits), "qid").select("spec_item_id", "item_id", *map(score, ("exact", "fuzzy", "lexical")), F.col("coded.code").alias("code"))


@query("f10_scored_hits", _MATCH_SQL + " SELECT spec_item_id, item_id, confidence::double AS confidence, match_type, md5(why) AS why FROM typed WHERE why <> ''")
def f10(spark, d):
    """Every merged hit with its score, type and explanation, before ranks cut them."""
    lines, queries, pooled, hits = _hits(spark, d)
    scored = M.score(M.merge_hits(hits), queries, M.detect_brands(queries, pooled), pooled)
    why = T.explanation_text(F.col("explanation"))
    lowered = F.concat(F.lower(F.substring(why, 1, 1)), F.substring(why, F.lit(2), F.length(why)))
    return lines.join(scored.filter(why != "слабое совпадение"), "qid").select("spec_item_id", "item_id", F.col("confidence").cast("double").alias("confidence"), "match_type", F.md5(lowered.cast("binary")).alias("why"))


@query("f12_promoted_cards", _MATCH_SQL + " SELECT spec_item_id, item_id, rank, confidence::double AS confidence FROM matched WHERE match_type = 'hybrid'")
def f12(spark, d):
    return _matched(spark, d).filter("match_type = 'hybrid'").select("spec_item_id", "item_id", F.col("rank").cast("long").alias("rank"), F.col("confidence").cast("double").alias("confidence"))


_CONFIRMED_SQL = ", confirmed AS (SELECT * FROM candidates_ WHERE spec_item_id % 3 = 0)"


def _rematched(spark, d):
    """The stored candidates after all lines were matched again but every third, which is confirmed."""
    lines, stored = D.spec_items(spark, d), D.candidates(spark, d)
    done = lines.filter("spec_item_id % 3 = 0").select("spec_item_id", F.lit("confirmed").alias("decision"))
    return M.rematch_open(lines, D.stored_items(spark, d), D.sources(spark, d), stored, done)[0]


@query("f14_rematch_open", _MATCH_SQL + _CONFIRMED_SQL + " SELECT spec_item_id, item_id, confidence::double AS confidence, match_type FROM confirmed UNION ALL SELECT spec_item_id, item_id, confidence::double, match_type FROM matched WHERE spec_item_id % 3 <> 0")
def f14(spark, d):
    return _rematched(spark, d).select("spec_item_id", "item_id", F.col("confidence").cast("double").alias("confidence"), "match_type")


_BANDED = "count(*) FILTER (confidence >= 0.9) AS high, count(*) FILTER (confidence < 0.9 AND confidence >= 0.5) AS mid, count(*) FILTER (confidence < 0.5) AS low, max(confidence)::double AS best"


@query("f15_band_changes", _MATCH_SQL + _CONFIRMED_SQL + f", after_ AS (SELECT confidence, rank FROM confirmed UNION ALL SELECT confidence, rank FROM matched WHERE spec_item_id % 3 <> 0) SELECT 'before' AS moment, {_BANDED} FROM candidates_ WHERE rank = 1 UNION ALL SELECT 'after', {_BANDED} FROM after_ WHERE rank = 1")
def f15(spark, d):
    return M.band_changes(D.candidates(spark, d), settled(_rematched(spark, d))).withColumn("best", F.col("best").cast("double"))


@query("f16_persisted", _MATCH_SQL + " SELECT spec_item_id, item_id, confidence::double AS confidence, match_type, rank FROM matched")
def f16(spark, d):
    return M.persisted(_matched(spark, d)).select("spec_item_id", "item_id", F.col("confidence").cast("double").alias("confidence"), "match_type", F.col("rank").cast("long").alias("rank"))


_IMPORTED_SQL = """, imported_ AS MATERIALIZED (SELECT * REPLACE (CASE WHEN renamed THEN name || ' new' ELSE name END AS name, CASE WHEN renamed THEN name_normalized || ' new' ELSE name_normalized END AS name_normalized,
   is_active AND NOT (source_id <> 'catalog' AND key_ % 40 = 1) AS is_active) FROM (SELECT *, source_id = 'catalog' AND key_ % 40 = 0 AS renamed FROM stored_))"""


def _imported(items):
    """The item store after an import that renames some cards and drops some offers."""
    key, card = F.split_part(F.substring("item_id", F.lit(2), F.length("item_id")), F.lit("-"), F.lit(1)).cast("long"), F.col("source_id") == "catalog"
    renamed = lambda c: F.when(card & (key % 40 == 0), F.concat(c, F.lit(" new"))).otherwise(F.col(c))
    return items.withColumns({"name": renamed("name"), "name_normalized": renamed("name_normalized"), "is_active": F.col("is_active") & ~(~card & (key % 40 == 1))})


@query("f17_rematch_import", _IMPORTED_SQL + _MATCH_SQL.replace("stored_ ", "imported_ ") + " SELECT spec_item_id, item_id, rank, confidence::double AS confidence, match_type FROM matched")
def f17(spark, d):
    """Candidates after an import, by matching again only the lines that it can reach."""
    items, sources = settled(D.stored_items(spark, d)), D.sources(spark, d)
    imported = settled(_imported(items))
    before = settled(_matched(spark, d))
    after = M.rematch_changed(D.spec_items(spark, d), (items, sources), (imported, sources), before)
    return after.select("spec_item_id", "item_id", F.col("rank").cast("long").alias("rank"), F.col("confidence").cast("double").alias("confidence"), "match_type")


_EXPLAINED = "CASE WHEN rank = 1 THEN 'Артикул совпал точно' WHEN confidence = 0 THEN 'слабое совпадение' ELSE 'Наименование близко (score=' || round(confidence, 2)::decimal(3,2)::varchar || ')' END"


@query("b16_explanation", f" SELECT spec_item_id, item_id, {_EXPLAINED} AS sentence FROM candidates_")
def b16(spark, d):
    first = F.col("rank") == 1
    e = F.struct(
        F.when(first, "exact_after_normalization").otherwise("none").alias("article_match"), F.lit(1.0).alias("article_similarity"),
        F.when(first, 0.0).otherwise(F.col("confidence").cast("double")).alias("lexical_score"), F.lit(False).alias("brand_match"), F.lit(False).alias("unit_match"),
        F.lit("none").alias("extracted_code_match"), F.lit(None).cast("string").alias("extracted_code"),
    )
    return D.candidates(spark, d).withColumn("e", e).select("spec_item_id", "item_id", T.explanation_text(F.col("e")).alias("sentence"))


@query("f11_rank", " SELECT spec_item_id, item_id, row_number() OVER (PARTITION BY spec_item_id, source_type ORDER BY confidence DESC, item_id) AS rank FROM candidates_")
def f11(spark, d):
    c = D.candidates(spark, d).drop("rank").withColumns({"qid": F.col("spec_item_id"), "name": F.lit("")})
    return M.rank(c).select("spec_item_id", "item_id", F.col("rank").cast("long").alias("rank"))


_CUR = """, known AS (SELECT dc.* FROM decisions_ dc SEMI JOIN spec_items_ USING (spec_item_id) WHERE decision <> 'confirmed' OR chosen_item_id IN (SELECT item_id FROM items_)),
 cur AS (SELECT spec_item_id, decision, decided_by, CASE WHEN decision = 'confirmed' THEN chosen_item_id END AS chosen_item_id FROM known QUALIFY row_number() OVER (PARTITION BY spec_item_id ORDER BY decided_at DESC, event_id DESC) = 1)"""  # fmt: skip


def _current(spark, d):
    return R.current_decisions(D.decisions(spark, d), D.spec_items(spark, d), D.items(spark, d))


# --- review -----------------------------------------------------------------------------------------------------------


@query("g1_current_decisions", _CUR + " SELECT * FROM cur")
def g1(spark, d):
    return _current(spark, d).drop("decided_at")


@query("g2_undo", _CUR.replace("FROM decisions_ dc", "FROM (SELECT * REPLACE (CASE WHEN user_undo THEN NULL ELSE decision END AS decision) FROM (SELECT *, event_id % 3 = 0 AS user_undo FROM decisions_)) dc").replace("WHERE decision <> 'confirmed' OR", "WHERE decision IS NULL OR decision <> 'confirmed' OR") + " SELECT spec_item_id, decision FROM cur WHERE decision IS NOT NULL")
def g2(spark, d):
    log = D.decisions(spark, d).withColumn("decision", F.when(F.col("event_id") % 3 != 0, F.col("decision")))
    return R.current_decisions(log, D.spec_items(spark, d), D.items(spark, d)).select("spec_item_id", "decision")


_BEST = ", best AS (SELECT * FROM candidates_ WHERE rank = 1 QUALIFY row_number() OVER (PARTITION BY spec_item_id ORDER BY source_type <> 'company_catalog', confidence DESC, item_id) = 1)"


@query("g3_best_candidate", _BEST + " SELECT spec_item_id, item_id, confidence::double AS confidence FROM best")
def g3(spark, d):
    return R.best_candidates(D.candidates(spark, d)).select("spec_item_id", "item_id", F.col("confidence").cast("double").alias("confidence"))


@query("g4_auto_confirm", _CUR + _BEST + " SELECT spec_item_id, item_id AS chosen_item_id, confidence::double AS confidence FROM best ANTI JOIN cur USING (spec_item_id) WHERE confidence >= 0.9")
def g4(spark, d):
    return R.auto_confirm(D.candidates(spark, d), _current(spark, d)).select("spec_item_id", "chosen_item_id", F.col("confidence").cast("double").alias("confidence"))


@query("g4_auto_confirm_counts", _CUR + _BEST + """ SELECT count(*) AS lines, count(cur.spec_item_id) AS already_verified, count(*) FILTER (cur.spec_item_id IS NULL AND confidence IS NULL) AS no_candidate,
 count(*) FILTER (cur.spec_item_id IS NULL AND confidence < 0.9) AS below_threshold, count(*) FILTER (cur.spec_item_id IS NULL AND confidence >= 0.9) AS confirmed
 FROM spec_items_ LEFT JOIN best USING (spec_item_id) LEFT JOIN cur USING (spec_item_id)""")  # fmt: skip
def g4c(spark, d):
    return R.auto_confirm_counts(D.spec_items(spark, d), D.candidates(spark, d), _current(spark, d))


@query("g5_bulk_decision", _BEST + " SELECT spec_item_id, item_id AS chosen_item_id, 'confirmed' AS decision FROM best JOIN spec_items_ USING (spec_item_id) WHERE line_number % 3 = 0")
def g5(spark, d):
    return R.bulk_decide(D.spec_items(spark, d).filter("line_number % 3 = 0"), D.candidates(spark, d), "confirmed")


_STATES = _CUR + """, states AS (SELECT s.spec_item_id, s.spec_id, s.line_number, best, decision,
   CASE WHEN best IS NULL THEN 'no_candidate' WHEN best >= 0.9 THEN 'high' WHEN best >= 0.5 THEN 'mid' ELSE 'low' END AS band
 FROM spec_items_ s LEFT JOIN (SELECT spec_item_id, max(confidence) AS best FROM candidates_ WHERE rank = 1 GROUP BY 1) USING (spec_item_id) LEFT JOIN cur USING (spec_item_id))"""


def _states(spark, d):
    return R.line_states(D.spec_items(spark, d), D.candidates(spark, d), _current(spark, d))


@query("g6_segments", _STATES + " SELECT segment, spec_item_id FROM states, LATERAL (SELECT unnest([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in R.SEGMENTS.items()) + "]) AS segment) WHERE segment IS NOT NULL")
def g6(spark, d):
    states = settled(_states(spark, d))
    named = F.array_compact(F.array(*(F.when(F.expr(c), n) for n, c in R.SEGMENTS.items())))
    return states.select(F.explode(named).alias("segment"), "spec_item_id")


@query("g7_sorted_lines", _STATES + " SELECT spec_item_id, row_number() OVER (ORDER BY best DESC NULLS LAST, spec_id, line_number) - 1 AS place FROM states")
def g7(spark, d):
    ordered = R.sorted_lines(_states(spark, d), by_confidence=True).select("spec_item_id")
    return _numbered_in_order(settled(ordered.withColumn("at", F.monotonically_increasing_id())))


def _numbered_in_order(df):
    """Consecutive numbers for rows whose ids `at` come partition by partition: an offset for each partition is added."""
    part = F.shiftright("at", 33)
    sizes = df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    offsets = sizes.select("part", before.alias("before"))
    return df.withColumn("part", part).join(offsets, "part").select("spec_item_id", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


@query("g9_nested_lines", _STATES + """, ct AS (SELECT spec_item_id, count(*) FILTER (source_type = 'company_catalog') AS catalog, count(*) FILTER (source_type <> 'company_catalog') AS suppliers FROM candidates_ GROUP BY 1),
 gl AS (SELECT spec_item_id, max(gold_id) AS gold_id FROM gold_ GROUP BY 1)
 SELECT spec_item_id, coalesce(catalog, 0) AS catalog, coalesce(suppliers, 0) AS suppliers, chosen_item_id, gold_id FROM states LEFT JOIN ct USING (spec_item_id) LEFT JOIN gl USING (spec_item_id) LEFT JOIN (SELECT spec_item_id, chosen_item_id FROM cur) USING (spec_item_id)""")  # fmt: skip
def g9(spark, d):
    nested = R.nested_lines(_states(spark, d), D.candidates(spark, d), _current(spark, d), D.gold_rows(spark, d))
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long").alias(c)
    return nested.select("spec_item_id", size("catalog"), size("suppliers"), "chosen_item_id", "gold_id")


@query("g10_counters", _STATES + """ SELECT spec_id, count(*) AS total, count(*) FILTER (band = 'high') AS high, count(*) FILTER (band = 'mid') AS medium, count(*) FILTER (band = 'low') AS low, count(*) FILTER (band = 'no_candidate') AS no_candidate,
 count(*) FILTER (band IN ('low', 'no_candidate')) AS not_found, count(decision) AS verified, count(*) FILTER (decision IS NULL) AS pending, """ + ", ".join(f"count(*) FILTER (decision = '{x}') AS decided_{x}" for x in R.DECISIONS) + " FROM states GROUP BY 1")  # fmt: skip
def g10(spark, d):
    return R.counters(_states(spark, d))


_WON = _CUR + """, top AS (SELECT * FROM candidates_ QUALIFY row_number() OVER (PARTITION BY spec_item_id ORDER BY source_type <> 'company_catalog', rank, item_id) = 1),
 won AS (SELECT s.spec_item_id, CASE WHEN decision IS NULL OR (decision = 'confirmed' AND chosen_item_id IS NULL) THEN top.item_id WHEN decision = 'confirmed' THEN chosen_item_id END AS item_id,
  CASE decision WHEN 'confirmed' THEN 'Подтверждено' WHEN 'not_found' THEN 'Не найдено (отметка менеджера)' WHEN 'rejected' THEN 'Отклонено' WHEN 'new_item_requested' THEN 'Требуется новая позиция каталога'
   WHEN 'forwarded' THEN 'Передано в МОС' ELSE CASE WHEN top.item_id IS NOT NULL THEN 'Не верифицировано' ELSE 'Не найдено (нет кандидатов)' END END AS decision
  FROM spec_items_ s LEFT JOIN cur USING (spec_item_id) LEFT JOIN top USING (spec_item_id))"""  # fmt: skip


@query("g12_winners", _WON + " SELECT * FROM won")
def g12(spark, d):
    return R.winners(D.spec_items(spark, d), D.candidates(spark, d), _current(spark, d))


@query("g13_card_labels", " SELECT s.item_id, coalesce(c.code_1c, c.article_raw) AS label FROM stored_ s LEFT JOIN stored_ c ON c.item_id = s.linked_catalog_item_id")
def g13(spark, d):
    items = D.stored_items(spark, d)
    cards = items.select(F.col("item_id").alias("card_id"), F.coalesce("code_1c", "article_raw").alias("label"))
    return items.join(cards, F.col("linked_catalog_item_id") == F.col("card_id"), "left").select("item_id", "label")


@query("g14_status", _STATES + " SELECT spec_id, CASE WHEN count(decision) = count(*) THEN 'verified' ELSE 'reviewing' END AS status FROM states GROUP BY 1")
def g14(spark, d):
    return R.derived_status(_states(spark, d))


@query("g15_specifications", _STATES + " SELECT spec_id, client_id, coalesce(total, 0) AS total, coalesce(high, 0) AS high, coalesce(pending, 0) AS pending FROM specifications_ LEFT JOIN (SELECT spec_id, count(*) AS total, count(*) FILTER (band = 'high') AS high, count(*) FILTER (decision IS NULL) AS pending FROM states GROUP BY 1) USING (spec_id)")
def g15(spark, d):
    return R.specification_list(D.specifications(spark, d), R.counters(_states(spark, d))).select("spec_id", "client_id", "total", "high", "pending")


@query("g16_suppliers", " SELECT 'S' || s_suppkey AS supplier_id, s_name AS name, (SELECT count(*) FROM items_ WHERE is_active AND source_id = 'S' || s_suppkey) AS active_items FROM supplier")
def g16(spark, d):
    return R.supplier_list(D.suppliers(spark, d), D.items(spark, d))


@query("g17_catalog_summary", " SELECT count(*) FILTER (is_active) AS active, count(*) AS total FROM items_ WHERE source_id = 'catalog'")
def g17(spark, d):
    return R.catalog_summary(D.items(spark, d))


@query("g18_clients", " SELECT client_id, client_name, (SELECT count(*) FROM specifications_ s WHERE s.client_id = c.client_id) AS specs FROM clients_ c WHERE contains(lower(client_name), '#00')")
def g18(spark, d):
    return R.client_list(D.clients(spark, d), D.specifications(spark, d), "#00")


@query("g19_bands", " SELECT count(*) FILTER (confidence >= 0.9) AS high, count(*) FILTER (confidence < 0.9 AND confidence >= 0.5) AS mid, count(*) FILTER (confidence < 0.5) AS low, max(confidence)::double AS best FROM candidates_ WHERE rank = 1")
def g19(spark, d):
    return R.band_distribution(D.candidates(spark, d)).withColumn("best", F.col("best").cast("double"))


@query("g20_snapshot", " SELECT count(*) FILTER (is_active) AS active, count(*) AS total FROM items_")
def g20(spark, d):
    return R.item_snapshot(D.items(spark, d))


@query("a18_export", _WON + r""" SELECT s.spec_item_id, s.line_number, s.name_raw, won.decision, regexp_replace(s.quantity::varchar, '\.?0+$', '') AS quantity, i.name AS chosen_name, i.code_1c AS chosen_code_1c,
 regexp_replace(i.price::varchar, '\.?0+$', '') AS chosen_price, CASE WHEN source_type = 'company_catalog' THEN 'Каталог компании' WHEN source_type IS NOT NULL THEN 'Прайс: ' || source_name END AS source,
 round(c.confidence, 3)::decimal(4,3)::varchar AS confidence, c.match_type
 FROM spec_items_ s JOIN won USING (spec_item_id) LEFT JOIN items_ i ON i.item_id = won.item_id LEFT JOIN (SELECT source_id, source_type, source_name FROM sources_) so USING (source_id)
 LEFT JOIN (SELECT spec_item_id, item_id, max(confidence) AS confidence, min(match_type) AS match_type FROM candidates_ GROUP BY 1, 2) c ON c.spec_item_id = s.spec_item_id AND c.item_id = won.item_id""")  # fmt: skip
def a18(spark, d):
    rows = R.export_rows(D.spec_items(spark, d), D.candidates(spark, d), _current(spark, d), D.items(spark, d), D.sources(spark, d))
    return rows.select("spec_item_id", "line_number", "name_raw", "decision", "quantity", "chosen_name", "chosen_code_1c", "chosen_price", "source", "confidence", "match_type")


# --- labelled set -----------------------------------------------------------------------------------------------------

_RANKS = f""", hr AS (SELECT g.gold_id, lower(label_status) AS label_status, {article('g.expected_article')} AS expected_article, expected_code_1c AS expected_code,
  min(CASE WHEN i.article_normalized = {article('g.expected_article')} OR i.code_1c = expected_code_1c THEN c.rank END) AS hit_rank, count(c.item_id) AS candidates
  FROM gold_ g LEFT JOIN candidates_ c ON c.spec_item_id = g.gold_id LEFT JOIN items_ i USING (item_id) GROUP BY ALL)"""


def _ranks(spark, d):
    return G.first_hit_ranks(D.gold_rows(spark, d), D.candidates(spark, d), D.items(spark, d))


@query("h1_gold_headers", " SELECT DISTINCT source_file AS file_id, 1 AS header_row, unnest(['row_num', 'name', 'article', 'expected_article', 'expected_code_1c', 'label_status']) AS field, unnest([0, 1, 2, 3, 4, 5]) AS col_idx FROM gold_")
def h1(spark, d):
    return G.detect_gold_headers(D.gold_cells(spark, d))


@query("h2_gold_rows", " SELECT file_id, row_num, name, article, expected_article, expected_code_1c, lower(label_status) AS label_status FROM (SELECT source_file AS file_id, row_number() OVER (PARTITION BY source_file ORDER BY gold_id) AS row_num, * FROM gold_) WHERE gold_id % 37 <> 0")
def h2(spark, d):
    cells = D.gold_cells(spark, d)
    return G.read_gold_rows(cells, G.detect_gold_headers(cells)).select("file_id", "row_num", "name", "article", "expected_article", "expected_code_1c", "label_status")


@query("h3_gold_inputs", " SELECT gold_id AS spec_item_id, name AS name_raw, article AS article_raw FROM gold_")
def h3(spark, d):
    return G.gold_inputs(D.gold_rows(spark, d)).select("spec_item_id", "name_raw", "article_raw")


@query("h4_first_hit", _RANKS + " SELECT gold_id, hit_rank, candidates FROM hr")
def h4(spark, d):
    return _ranks(spark, d).select("gold_id", "hit_rank", "candidates")


_METRICS = _RANKS + """, a AS (SELECT *, label_status IN ('найдено', 'аналог') AND (expected_article IS NOT NULL OR expected_code IS NOT NULL) AS ok FROM hr),
 m AS (SELECT count(*) AS total, count(*) FILTER (label_status = 'сомнительно') AS skipped, count(*) FILTER (ok) AS applicable, round(count(*) FILTER (ok AND hit_rank <= 5) / count(*) FILTER (ok), 6) AS recall_at_k,
 round(count(*) FILTER (ok AND hit_rank = 1) / count(*) FILTER (ok), 6) AS precision_at_1, round(sum(CASE WHEN ok THEN coalesce(1 / hit_rank, 0) END) / count(*) FILTER (ok), 6) AS mrr,
 count(*) FILTER (label_status = 'не найдено') AS not_found, count(*) FILTER (label_status = 'не найдено' AND candidates = 0) AS not_found_right FROM a)"""  # fmt: skip


@query("h5_metrics", _METRICS + " SELECT * FROM m")
def h5(spark, d):
    return G.metrics(_ranks(spark, d))


@query("h5_status_counts", " SELECT lower(label_status) AS label_status, count(*) AS rows FROM gold_ GROUP BY 1")
def h5s(spark, d):
    return G.status_counts(D.gold_rows(spark, d))


@query("h6_result_columns", _RANKS + """ SELECT gold_id, top_article, top_code_1c, CASE WHEN expected_article IS NULL AND expected_code IS NULL THEN '' WHEN hit_rank IS NOT NULL THEN 'yes' ELSE 'no' END AS matched
 FROM hr LEFT JOIN (SELECT spec_item_id AS gold_id, article_raw AS top_article, code_1c AS top_code_1c FROM candidates_ c JOIN items_ USING (item_id) WHERE rank = 1 AND source_type = 'company_catalog') USING (gold_id)""")  # fmt: skip
def h6(spark, d):
    return G.result_columns(_ranks(spark, d), D.candidates(spark, d), D.items(spark, d)).drop("confidence")


@query("h7_metric_report", _METRICS + " UNPIVOT (SELECT " + ", ".join(f"{c}::double AS {c}" for c in "total skipped applicable recall_at_k precision_at_1 mrr not_found not_found_right".split()) + " FROM m) ON COLUMNS(*) INTO NAME metric VALUE value")
def h7(spark, d):
    return G.metric_report(G.metrics(_ranks(spark, d)))


_FROM_LINES = _CUR + """, ex AS (SELECT spec_item_id, CASE WHEN spec_item_id % 3 = 0 THEN 'c' || partkey END AS expected_item_id, CASE WHEN spec_item_id % 4 = 0 THEN 'аналог' END AS status FROM spec_items_ WHERE line_number <= 3)
 SELECT ex.spec_item_id AS gold_id, i.name AS expected_name, i.code_1c AS expected_code_1c, coalesce(status, CASE decision WHEN 'confirmed' THEN 'найдено' WHEN 'not_found' THEN 'не найдено' ELSE 'сомнительно' END) AS label_status
 FROM ex LEFT JOIN cur USING (spec_item_id) LEFT JOIN items_ i ON i.item_id = coalesce(expected_item_id, chosen_item_id)"""  # fmt: skip


@query("h8_gold_from_lines", _FROM_LINES)
def h8(spark, d):
    lines = D.spec_items(spark, d)
    explicit = lines.filter("line_number <= 3").select("spec_item_id", F.when(F.col("spec_item_id") % 3 == 0, F.concat(F.lit("c"), "partkey")).alias("expected_item_id"), F.when(F.col("spec_item_id") % 4 == 0, "аналог").alias("label_status"))
    return G.from_lines(lines, _current(spark, d), D.items(spark, d), explicit).select("gold_id", "expected_name", "expected_code_1c", "label_status")


@query("h9_snapshot", " SELECT gold_id, coalesce(expected_name, i.name) AS expected_name, coalesce(expected_code_1c, i.code_1c) AS expected_code_1c FROM gold_ g LEFT JOIN items_ i ON i.item_id = 'c' || (g.gold_id % 100)")
def h9(spark, d):
    gold = D.gold_rows(spark, d).withColumn("expected_item_id", F.concat(F.lit("c"), (F.col("gold_id") % 100).cast("string")))
    return G.with_snapshot(gold, D.items(spark, d)).select("gold_id", "expected_name", "expected_code_1c")


@query("h10_by_status", " SELECT gold_id, name FROM gold_ WHERE lower(label_status) = 'не найдено'")
def h10(spark, d):
    return G.by_status(D.gold_rows(spark, d), G.NOT_FOUND).select("gold_id", "name")


@query("a20_gold_export", " SELECT row_number() OVER (PARTITION BY source_file ORDER BY gold_id) AS row_num, source_file, name, expected_name, label_status FROM gold_")
def a20(spark, d):
    return G.export_table(D.gold_rows(spark, d)).select("row_num", "source_file", "name", "expected_name", "label_status")


# --- checks -----------------------------------------------------------------------------------------------------------


@query("j1_repeated_codes", " SELECT source_id, upper(left(name, 3)) AS code_1c, count(*) AS rows FROM items_ WHERE is_active GROUP BY 1, 2 HAVING count(*) > 1")
def j1(spark, d):
    return Q.repeated_codes(D.items(spark, d).withColumn("code_1c", F.upper(F.substring("name", 1, 3))))


@query("j2_repeated_articles", " SELECT source_id, left(article_normalized, 5) AS article_normalized, lower(coalesce(manufacturer, '')) AS brand, count(*) AS rows FROM items_ WHERE is_active AND code_1c IS NULL AND article_normalized IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1")
def j2(spark, d):
    return Q.repeated_articles(D.items(spark, d).withColumn("article_normalized", F.substring("article_normalized", 1, 5)))


@query("j3_repeated_skus", " SELECT source_id, left(supplier_sku, 9) AS supplier_sku, count(*) AS rows FROM stored_ WHERE is_active AND supplier_sku IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def j3(spark, d):
    return Q.repeated_skus(D.stored_items(spark, d).withColumn("supplier_sku", F.substring("supplier_sku", 1, 9)))


@query("j3_bad_prefixes", " SELECT left(n_name, 3) AS prefix, count(*) AS suppliers FROM nation GROUP BY 1 HAVING count(*) > 1 OR NOT regexp_full_match(left(n_name, 3), '[A-Z0-9]{3}')".strip(), tables=False)
def j3p(spark, d):
    return Q.bad_prefixes(D.read(spark, d, "nation").select(F.substring("n_name", 1, 3).alias("prefix")))


@query("j4_repeated_lines", "SELECT l_orderkey AS spec_id, l_linenumber AS line_number, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", tables=False)
def j4(spark, d):
    return Q.repeated_lines(D.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("spec_id"), F.col("l_linenumber").alias("line_number")))


@query("j4_repeated_verifications", " SELECT decided_by AS spec_item_id, count(*) AS rows FROM decisions_ GROUP BY 1 HAVING count(*) > 1")
def j4v(spark, d):
    return Q.repeated_verifications(D.decisions(spark, d).select(F.col("decided_by").alias("spec_item_id")))


@query("j5_orphans", " SELECT spec_item_id, count(*) AS rows FROM decisions_ ANTI JOIN spec_items_ USING (spec_item_id) GROUP BY 1")
def j5(spark, d):
    return Q.orphans(D.decisions(spark, d), "spec_item_id", D.spec_items(spark, d), "spec_item_id")


# --- cells ------------------------------------------------------------------------------------------------------------

_OFFERS = """, o AS (SELECT 'f' || suppkey AS file_id, partkey + 4 AS row_idx, partkey, offer, quantity, article, full_name FROM (SELECT l_partkey AS partkey, l_suppkey AS suppkey, min(l_extendedprice)::decimal(18,2) AS offer, max(l_quantity)::int AS quantity FROM lineitem GROUP BY 1, 2) JOIN parts_ USING (partkey)),
 named AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY row_idx) AS line_number FROM o WHERE partkey % 40 <> 7)"""  # fmt: skip


def _headers(cells):
    return C.detect_headers(cells, ("code_1c",))


@query("a6_headers", "SELECT DISTINCT 'f' || l_suppkey AS file_id, 3 AS header_row, unnest(['article', 'name', 'quantity', 'price']) AS field, unnest([0, 1, 2, 3]) AS col_idx FROM lineitem", tables=False)
def a6(spark, d):
    return _headers(D.cells(spark, d))


@query("a11_rows", _OFFERS + """ SELECT file_id, line_number, article, full_name AS name, CASE WHEN partkey % 31 <> 5 THEN quantity::double END AS quantity,
 CASE WHEN partkey % 4 NOT IN (0, 1) AND partkey % 23 = 2 THEN NULL ELSE offer::double END AS price FROM named""")
def a11(spark, d):
    cells = D.cells(spark, d)
    rows = C.extract_rows(cells, _headers(cells))
    return rows.select("file_id", F.col("line_number").cast("long").alias("line_number"), "article", "name", F.col("quantity_value").cast("double").alias("quantity"), F.col("price_value").cast("double").alias("price"))


@query("a12_raw_rows", _OFFERS + " SELECT file_id, line_number, 3 + CASE WHEN article IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN partkey % 3 = 0 THEN 1 ELSE 0 END AS cells FROM named")
def a12(spark, d):
    cells = D.cells(spark, d)
    return C.extract_rows(cells, _headers(cells)).select("file_id", F.col("line_number").cast("long").alias("line_number"), F.size("raw").cast("long").alias("cells"))


@query("a13_warnings", _OFFERS + """ SELECT file_id, line_number, 'quantity' AS field, 'много' AS value FROM named WHERE partkey % 31 = 5
 UNION ALL SELECT file_id, line_number, 'price', 'по запросу' FROM named WHERE partkey % 4 NOT IN (0, 1) AND partkey % 23 = 2""")
def a13(spark, d):
    cells = D.cells(spark, d)
    return C.parse_warnings(C.extract_rows(cells, _headers(cells))).withColumn("line_number", F.col("line_number").cast("long"))


@query("a14_price_columns", "SELECT DISTINCT 'f' || l_suppkey AS file_id, unnest([3, 4]) AS col_idx, unnest(['Цена без НДС', 'Цена с НДС']) AS label, unnest(['net', 'gross']) AS vat, unnest(['Цены со скидкой', 'РРЦ']) AS tier FROM lineitem", tables=False)
def a14(spark, d):
    cells = settled(D.cells(spark, d))
    return C.price_columns(cells, _headers(cells))


@query("a16_prices", _OFFERS + """, p AS (SELECT *, NOT (partkey % 4 NOT IN (0, 1) AND partkey % 23 = 2) AS has_net, partkey % 3 = 0 AS has_gross FROM o)
 SELECT file_id, row_idx, has_net::int + has_gross::int AS prices, offer::double AS preferred FROM p WHERE has_net OR has_gross""")
def a16(spark, d):
    cells = D.cells(spark, d)
    header = settled(_headers(cells))
    found = C.price_entries(cells, C.price_columns(cells, header), header)
    return found.select("file_id", "row_idx", F.size("prices").alias("prices"), F.col("preferred").cast("double").alias("preferred"))


@query("a10_templates", "SELECT DISTINCT 'f' || l_suppkey AS file_id, unnest(CASE WHEN l_suppkey % 2 = 0 THEN ['name', 'price'] ELSE ['article', 'name', 'quantity', 'price'] END) AS field, unnest(CASE WHEN l_suppkey % 2 = 0 THEN [1, 4] ELSE [0, 1, 2, 3] END) AS col_idx FROM lineitem", tables=False)
def a10(spark, d):
    cells = settled(D.cells(spark, d))
    files = cells.select("file_id", F.substring("file_id", 2, 12).alias("source_id")).distinct()
    even = files.filter(F.col("source_id").cast("int") % 2 == 0)
    templates = even.select("source_id", F.lit(3).alias("header_row"), F.explode(F.create_map(F.lit("name"), F.lit(1), F.lit("price"), F.lit(4))).alias("field", "col_idx"))
    return C.with_templates(_headers(cells), files, templates).select("file_id", "field", "col_idx")


@query("a5_merged_cells", _OFFERS + " SELECT file_id, row_idx, count(*) AS cells, min(article) AS value FROM o, (SELECT unnest([0, 1, 2]) AS c) WHERE article IS NOT NULL GROUP BY 1, 2")
def a5(spark, d):
    cells = settled(D.cells(spark, d).filter("row_idx > 3"))
    corners = cells.filter("col_idx = 0").select("file_id", "sheet", F.col("row_idx").alias("top"), F.col("row_idx").alias("bottom"), F.lit(0).alias("left"), F.lit(2).alias("right"))
    filled = C.expand_merged(cells.filter("col_idx < 3"), corners)
    merged = filled.join(corners.select("file_id", F.col("top").alias("row_idx")), ["file_id", "row_idx"], "left_semi")
    return merged.groupBy("file_id", "row_idx").agg(F.count(F.lit(1)).alias("cells"), F.min("value").alias("value"))


@query("a4_sheets", "SELECT DISTINCT 'f' || l_suppkey AS file_id, CASE WHEN l_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS sheet FROM lineitem", tables=False)
def a4(spark, d):
    cells = D.cells(spark, d)
    even = F.substring("file_id", 2, 12).cast("int") % 2 == 0
    named = cells.withColumn("sheet", F.when(F.col("row_idx") == 0, "A").otherwise(F.when(even, "A").otherwise("B")))
    return C.choose_sheet(named).select("file_id", "sheet").distinct()


# --- extensions -------------------------------------------------------------------------------------------------------


@query("r1_price_list_changes", _OLD + _IN + """, a AS (SELECT source_id, key, min(name) AS name, min(price) AS price FROM keyed WHERE key IS NOT NULL AND is_active AND source_id <> 'catalog' GROUP BY 1, 2),
 b AS (SELECT source_id, key, name, price FROM firsts WHERE key IS NOT NULL)
 SELECT source_id, key, CASE WHEN a.name IS NULL THEN 'new' WHEN b.name IS NULL THEN 'gone' WHEN a.price IS DISTINCT FROM b.price THEN 'price' WHEN a.name <> b.name THEN 'renamed' ELSE 'same' END AS change FROM a FULL JOIN b USING (source_id, key)""")  # fmt: skip
def r1(spark, d):
    old = I.stored_key(D.stored_items(spark, d)).filter("key is not null and is_active and source_id != 'catalog'").groupBy("source_id", "key").agg(F.min("name").alias("name"), F.min("price").alias("price"))
    new = I.drop_repeats(D.new_price_lists(spark, d)).filter("key is not null").select("source_id", "key", "name", "price")
    return X.price_list_changes(old, new).select("source_id", "key", "change")


@query("r2_possible_analogs", " SELECT spec_item_id, item_id FROM candidates_ WHERE confidence >= 0.3 AND confidence < 0.5")
def r2(spark, d):
    return X.possible_analogs(D.candidates(spark, d)).select("spec_item_id", "item_id")


@query("r3_key_figures", _STATES + """, i AS (SELECT * FROM items_ WHERE is_active AND article_normalized IS NOT NULL)
 SELECT round(count(*) FILTER (band = 'high') / count(*), 6) AS auto_confirm_rate, round(count(*) FILTER (band = 'high' AND decision <> 'confirmed') / count(*) FILTER (band = 'high' AND decision IS NOT NULL), 6) AS false_auto_confirm_rate,
 (SELECT round(count(*) FILTER (article_normalized IN (SELECT article_normalized FROM i WHERE source_id <> 'catalog')) / count(*), 6) FROM i WHERE source_id = 'catalog') AS catalog_coverage FROM states""")  # fmt: skip
def r3(spark, d):
    return X.key_figures(_states(spark, d), D.items(spark, d))


@query("r4_unfound_names", _STATES + " SELECT name_raw, count(*) AS lines FROM spec_items_ JOIN states USING (spec_item_id) WHERE band IN ('low', 'no_candidate') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def r4(spark, d):
    return X.unfound_names(D.spec_items(spark, d), _states(spark, d))


@query("p3_decision_stream", " SELECT spec_item_id, decision FROM decisions_ QUALIFY row_number() OVER (PARTITION BY spec_item_id ORDER BY decided_at DESC, event_id DESC) = 1")
def p3(spark, d):
    """The decision log as a stream: its changes are written as they come, and the last of each line is read back."""
    from ..streaming import jobs

    log = settled(D.decisions(spark, d))
    folder = log.inputFiles()[0].rsplit("/", 1)[0]
    out = f"{folder}-changes"
    store = lambda df, number: df.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)
    jobs.run_decisions(spark, folder, log.schema, f"{folder}-progress", store).awaitTermination()
    last = spark.read.parquet(out).groupBy("spec_item_id").agg(F.max_by("decision", F.struct("decided_at", "batch")).alias("decision"))
    return last


# --- attributes in names ---------------------------------------------------------------------------------------------

_SIZED = ", sized AS (SELECT 'c' || p_partkey AS item_id, p_name, p_size AS dia, p_partkey % 400 AS len, 100 + p_partkey % 30 AS std FROM part)"


def _sized(spark, d):
    """Parts with their size, a length and a standard written into the name, in several ways."""
    n, size = F.col("p_partkey"), F.col("p_size").cast("string")
    length, std = (n % 400).cast("string"), (100 + n % 30).cast("string")
    text = (
        F.when(n % 3 == 0, F.concat(F.lit(" Д"), size, F.lit("х"), length, F.lit(" мм ГОСТ "), std))
        .when(n % 3 == 1, F.concat(F.lit(" Ø "), size, F.lit(" L="), length, F.lit(" din "), std))
        .otherwise(F.concat(F.lit(" диаметр "), size, F.lit(",0мм длина "), length, F.lit("см, ГОСТ Р "), std))
    )
    return D.read(spark, d, "part").select(F.concat(F.lit("c"), "p_partkey").alias("item_id"), F.concat("p_name", text).alias("name"))


@query("r6_attributes", _SIZED + """ SELECT item_id, 'diameter' AS kind, dia::double AS value, NULL::varchar AS text FROM sized
 UNION ALL SELECT item_id, 'length', (len * CASE WHEN substr(item_id, 2)::bigint % 3 = 2 THEN 10 ELSE 1 END)::double, NULL FROM sized
 UNION ALL SELECT item_id, 'standard', NULL, CASE WHEN substr(item_id, 2)::bigint % 3 = 1 THEN 'din ' ELSE 'гост ' END || std FROM sized""")
def r6(spark, d):
    return A.attributes(_sized(spark, d)).drop("name")


@query("r6_near_attributes", _SIZED + """, n AS (SELECT item_id, p_name || CASE substr(item_id, 2)::bigint % 3 WHEN 0 THEN ' Д' || dia || 'х' || len || ' мм ГОСТ ' || std WHEN 1 THEN ' Ø ' || dia || ' L=' || len || ' din ' || std
   ELSE ' диаметр ' || dia || ',0мм длина ' || len || 'см, ГОСТ Р ' || std END AS name, dia::double AS diameter, (len * CASE WHEN substr(item_id, 2)::bigint % 3 = 2 THEN 10 ELSE 1 END)::double AS length FROM sized),
 held AS (SELECT item_id, name, 'diameter' AS kind, diameter AS v FROM n UNION ALL SELECT item_id, name, 'length', length FROM n),
 asked AS (SELECT DISTINCT 'length' AS kind, round(l_extendedprice / 10, 1) AS value FROM lineitem UNION SELECT DISTINCT 'diameter', l_quantity + 0.5::double FROM lineitem)
 SELECT kind, value, item_id, round(abs(value - v), 9) AS distance FROM asked JOIN held USING (kind) WHERE round(abs(value - v), 9) <= 2.5::double
 QUALIFY row_number() OVER (PARTITION BY kind, value ORDER BY round(abs(value - v), 9), name, item_id) <= 20""")  # fmt: skip
def r6_near(spark, d):
    """Parts whose diameter or length is within 2.5 mm of those asked, the 20 closest of each."""
    lines = D.read(spark, d, "lineitem")
    asked = lines.select(F.lit("length").alias("kind"), F.round(F.col("l_extendedprice") / 10, 1).alias("value")).union(lines.select(F.lit("diameter"), F.col("l_quantity") + 0.5))
    return A.near_attributes(asked.distinct(), settled(_sized(spark, d)), 2.5, 20)


# --- units and synonyms ------------------------------------------------------------------------------------------------

_UNITS = """WITH o AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s, p_size AS size FROM lineitem JOIN part ON l_partkey = p_partkey),
 bad AS (SELECT DISTINCT p FROM o WHERE (s + p) % 50 = 0),
 u AS (SELECT 'a' || p AS unit, p, 1 AS factor FROM o UNION SELECT 'b' || p, p, size FROM o UNION SELECT 'c' || s || '-' || p, p, size * (s % 7 + 2) FROM o),
 closed AS (SELECT unit, 'a' || p AS canonical, CASE WHEN bad.p IS NULL THEN factor::double END AS factor, bad.p IS NULL AS consistent FROM u LEFT JOIN bad USING (p))"""


def _closed_units(spark, d):
    """Pieces, boxes and suppliers' pallets of each part that is ordered; some pallets are also given in pieces, and some
    of those with a wrong number."""
    part = D.read(spark, d, "part").select(F.col("p_partkey").alias("p"), F.col("p_size").alias("size"))
    o = settled(D.read(spark, d, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).distinct().join(part, "p"))
    piece, box = F.concat(F.lit("A"), "p"), F.concat(F.lit(" b"), "p")
    pallet, boxes = F.concat(F.lit("c"), "s", F.lit("-"), "p"), F.col("s") % 7 + 2
    direct = o.filter("(s + p) % 5 = 0").select(pallet.alias("unit"), piece.alias("other"), (boxes * F.col("size") + F.when((F.col("s") + F.col("p")) % 50 == 0, 1).otherwise(0)).alias("factor"))
    given = o.select(box.alias("unit"), piece.alias("other"), F.col("size").alias("factor")).union(o.select(pallet, box, boxes)).union(direct)
    return U.unit_closure(given)


@query("r5_unit_closure", _UNITS + " SELECT unit, canonical, round(factor, 6) AS factor, consistent FROM closed", tables=False)
def r5(spark, d):
    return _closed_units(spark, d).withColumn("factor", F.round("factor", 6))


@query("r5_canonical_quantities", _UNITS + """, l AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'a' || l_partkey WHEN 1 THEN 'b' || l_partkey ELSE 'c' || l_suppkey || '-' || l_partkey END AS unit, l_quantity, l_extendedprice FROM lineitem)
 SELECT CASE WHEN consistent THEN canonical ELSE unit END AS canonical_unit, count(*) AS lines, sum(l_quantity * coalesce(factor, 1)) AS quantity, min(l_extendedprice / coalesce(factor, 1)) AS least_price
 FROM l JOIN closed USING (unit) GROUP BY 1""", tables=False)  # fmt: skip
def r5_quantities(spark, d):
    """Order lines in pieces, boxes and pallets, added up by canonical unit."""
    line, third = D.read(spark, d, "lineitem"), F.col("l_linenumber") % 3
    unit = F.when(third == 0, F.concat(F.lit("a"), "l_partkey")).when(third == 1, F.concat(F.lit("B"), "l_partkey")).otherwise(F.concat(F.lit("c"), "l_suppkey", F.lit("-"), "l_partkey"))
    lines = line.select(unit.alias("unit"), "l_quantity", "l_extendedprice")
    told = U.in_canonical_units(lines, settled(_closed_units(spark, d)), quantity=F.col("l_quantity"), price=F.col("l_extendedprice"))
    return told.groupBy("canonical_unit").agg(F.count(F.lit(1)).alias("lines"), F.sum("canonical_quantity").alias("quantity"), F.min("canonical_price").alias("least_price"))


_SHARES = "SELECT q, c, x / sum(x) OVER (PARTITION BY c) AS t FROM "
_ALIGNED = "".join(
    f""", s{i} AS (SELECT id, q, c, n, t, sum(t) OVER (PARTITION BY id) AS whole FROM links JOIN t{i - 1} USING (q, c)),
 t{i} AS MATERIALIZED ({_SHARES} (SELECT q, c, sum(n * t / whole) AS x FROM s{i} GROUP BY 1, 2))"""
    for i in range(1, Y.ROUNDS + 1)
)


def _cell_sql(o: str, row: str, col: str) -> str:
    return f"CASE WHEN {o} > 0 THEN {o} * ln({o} / (({row})::double * ({col})) * lines) ELSE 0 END"


@query("r8_synonym_pairs", f"""WITH x AS (SELECT string_split(reverse(b.p_name), ' ') AS a, string_split(lower(a.p_name || ' ' || a.p_type), ' ') AS b
   FROM lineitem JOIN part b ON b.p_partkey = l_partkey JOIN part a ON a.p_partkey = CASE WHEN l_orderkey % 10 = 0 THEN l_suppkey ELSE l_partkey END),
 w AS (SELECT list_sort(list_distinct(list_filter(a, lambda v: NOT list_contains(b, v)))) AS q, list_sort(list_distinct(list_filter(b, lambda v: NOT list_contains(a, v)))) AS c FROM x),
 l AS MATERIALIZED (SELECT q, c, count(*) AS n FROM w WHERE len(q) > 0 AND len(c) > 0 GROUP BY 1, 2),
 e AS (SELECT u.q AS q, c AS words, sum(n)::bigint AS n FROM l, unnest(l.q) AS u(q) GROUP BY 1, 2),
 r AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM e),
 m AS (SELECT id, n, q, u.c AS c FROM r, unnest(r.words) AS u(c)),
 together AS MATERIALIZED (SELECT q, c, sum(n)::bigint AS together FROM m GROUP BY 1, 2 HAVING sum(n) >= {Y.LEAST}),
 links AS MATERIALIZED (SELECT m.* FROM m JOIN together USING (q, c)),
 t0 AS ({_SHARES} (SELECT q, c, 1::double AS x FROM together)){_ALIGNED},
 nq AS (SELECT q, sum(n)::bigint AS n_q FROM r GROUP BY 1), nc AS (SELECT u.c AS c, sum(n)::bigint AS n_c FROM l, unnest(l.c) AS u(c) GROUP BY 1),
 f AS (SELECT q, c, together, t, n_q, n_c, (SELECT sum(n)::bigint FROM l) AS lines FROM together JOIN t{Y.ROUNDS} USING (q, c) JOIN nq USING (q) JOIN nc USING (c)),
 g AS (SELECT *, round(t, 6) AS probability, round(2 * ({_cell_sql('together', 'n_q', 'n_c')} + {_cell_sql('(n_q - together)', 'n_q', 'lines - n_c')}
   + {_cell_sql('(n_c - together)', 'lines - n_q', 'n_c')} + {_cell_sql('(lines - n_q - n_c + together)', 'lines - n_q', 'lines - n_c')}), 4) AS likelihood_ratio FROM f)
 SELECT q AS query_word, c AS chosen_word, together, probability, likelihood_ratio FROM g
 WHERE together::double * lines > n_q::double * n_c AND likelihood_ratio >= {Y.SIGNIFICANT} AND probability >= {Y.PROBABLE}""", tables=False)  # fmt: skip
def r8(spark, d):
    """Lines that name their part in another language (words written backwards), one in ten chosen wrongly."""
    part = D.read(spark, d, "part")
    asked = part.select(F.col("p_partkey").alias("l_partkey"), F.reverse("p_name").alias("query"))
    cards = part.select(F.col("p_partkey").alias("card"), F.concat_ws(" ", "p_name", "p_type").alias("chosen"))
    line = D.read(spark, d, "lineitem").withColumn("card", F.when(F.col("l_orderkey") % 10 == 0, F.col("l_suppkey")).otherwise(F.col("l_partkey")))
    return Y.synonym_pairs(line.join(asked, "l_partkey").join(cards, "card"))


# --- figures of the decision stream --------------------------------------------------------------------------------------

# a window or session is given once the stream's time, its last event less an hour (in milliseconds), has passed its end
_CLOSED = ", now_ AS (SELECT date_trunc('milliseconds', max(decided_at)) - INTERVAL 1 HOUR AS t FROM decisions_)"


def _streamed(spark, d, results):
    """The decision log as a stream through `results`, read back from where it is appended. The log's times have no zone:
    they are read as UTC, whatever the session's zone, and given back without one."""
    utc = F.to_timestamp_ltz(F.concat(F.col("decided_at").cast("string"), F.lit("Z")))
    log = settled(D.decisions(spark, d).withColumn("decided_at", utc))
    stream = spark.readStream.schema(log.schema).parquet(log.inputFiles()[0].rsplit("/", 1)[0])
    out, shown = shared_path(spark), results(stream)
    J.append_results(shown, out, f"{out}-progress").awaitTermination()
    times = [c for c, kind in shown.dtypes if kind == "timestamp"]
    return spark.read.schema(shown.schema).parquet(out).withColumns({c: F.expr(f"timestampadd(MICROSECOND, unix_micros({c}), timestamp_ntz'1970-01-01')") for c in times})


@query("r4_decision_windows", _CLOSED + """ SELECT date_trunc('day', decided_at) AS window_start, count(*) AS decisions, count(*) FILTER (decision = 'confirmed') AS confirmed, count(*) FILTER (decision = 'not_found') AS not_found
 FROM decisions_, now_ WHERE date_trunc('day', decided_at) + INTERVAL 1 DAY <= t GROUP BY 1""")
def r4_windows(spark, d):
    return _streamed(spark, d, J.decision_windows).select("window_start", "decisions", "confirmed", "not_found")


@query("r4_unfound_by_day", """, now_ AS (SELECT date_trunc('milliseconds', max(decided_at)) - INTERVAL 1 HOUR AS t FROM decisions_ WHERE decision = 'not_found')
 SELECT date_trunc('day', decided_at) AS window_start, name_raw, count(*) AS decisions FROM decisions_ JOIN spec_items_ USING (spec_item_id), now_
 WHERE decision = 'not_found' AND date_trunc('day', decided_at) + INTERVAL 1 DAY <= t GROUP BY 1, 2""")
def r4_unfound(spark, d):
    lines = D.spec_items(spark, d)
    return _streamed(spark, d, lambda log: J.unfound_in_windows(log, lines))


@query("r4_work_sessions", _CLOSED + """, g AS (SELECT *, coalesce(decided_at - lag(decided_at) OVER (PARTITION BY decided_by ORDER BY decided_at) > INTERVAL 24 HOUR, true) AS first_ FROM decisions_),
 s AS (SELECT *, count(*) FILTER (first_) OVER (PARTITION BY decided_by ORDER BY decided_at RANGE UNBOUNDED PRECEDING) AS nth FROM g),
 x AS (SELECT decided_by, min(decided_at) AS started, max(decided_at) AS ended, count(*) AS decisions FROM s GROUP BY decided_by, nth)
 SELECT x.*, round((epoch_us(ended) - epoch_us(started)) / 1e6::double / nullif(decisions - 1, 0), 3) AS mean_seconds FROM x, now_ WHERE ended + INTERVAL 24 HOUR <= t""")
def r4_sessions(spark, d):
    return _streamed(spark, d, lambda log: J.work_sessions(log, gap="24 hours"))


# the link columns are read from the items themselves
for _name in ("d10_link_to_catalog", "d11_set_links", "d12_reset_links", "e6_linked_cards", "g13_card_labels"):
    SQL[_name] = SQL[_name].replace("stored_ AS MATERIALIZED", "stored_ AS NOT MATERIALIZED")
