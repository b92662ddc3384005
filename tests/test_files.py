"""Files to cells to rows, and the streaming jobs."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from specforge.operators import cells as C
from specforge.operators.review import write_csv
from specforge.sources import files
from specforge.sources import tables as D
from specforge.streaming import jobs

PRICE = "Прайс\n;;\nАртикул;Наименование;Кол-во;Цена без НДС\nA-1;\"Хомут; М10\";10 шт;12,5\n;;;\nA-2;Гайка;много;по запросу\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("files")
    (path / "a.csv").write_bytes(PRICE.encode("cp1251"))
    (path / "b.csv").write_bytes(b"\xef\xbb\xbf" + "name,code,qty\nbolt,7,3\nnut,8,\n".encode())
    (path / "c.txt").write_bytes("Товар\tМодель\nКлюч\tX1\n".encode())
    return str(path)


def test_encoding_delimiter_header_rows(spark, folder):
    cells = files.read_delimited(spark, folder)
    rows = C.extract_rows(cells, C.detect_headers(cells)).withColumn("file", F.element_at(F.split("file_id", "/"), -1))
    got = {(r["file"], r["line_number"]): (r["article"], r["name"], r["quantity_value"] and float(r["quantity_value"]), r["price_value"] and float(r["price_value"])) for r in rows.collect()}
    assert got == {
        ("a.csv", 1): ("A-1", "Хомут; М10", 10.0, 12.5), ("a.csv", 2): ("A-2", "Гайка", None, None),
        ("b.csv", 1): (None, "bolt", 3.0, None), ("b.csv", 2): (None, "nut", None, None), ("c.txt", 1): ("X1", "Ключ", None, None),
    }
    assert {(r["field"], r["value"]) for r in C.parse_warnings(rows).collect()} == {("quantity", "много"), ("price", "по запросу")}


def by_hand(text, delimiter):
    rows = csv.reader(io.StringIO(text, newline=None), delimiter=delimiter)
    return [row or [""] for row in rows]


def cells_read(spark, path, **options):
    rows = {}
    for r in files.read_delimited(spark, path, **options).collect():
        rows.setdefault(os.path.basename(r["file_id"]), {}).setdefault(r["row_idx"], {})[r["col_idx"]] = r["value"]
    return {f: [[row[c] for c in sorted(row)] for _, row in sorted(x.items())] for f, x in rows.items()}


@pytest.mark.parametrize("delimiter", [",", "\t"])
def test_files_are_cut_into_pieces_and_records(spark, tmp_path, delimiter):
    """Quoted delimiters, quotes and line breaks, stray quotes, a break at the end, over many pieces of a file."""
    r = random.Random(8)
    texts = {}
    for n in range(3):
        value = lambda: "".join(r.choice(["a", "é", delimiter, '"', "\n", " ", "bc"]) for _ in range(r.randrange(6)))
        out = io.StringIO()
        writer = csv.writer(out, delimiter=delimiter, lineterminator="\n")
        for i in range(400):
            writer.writerow([str(i), *(value() for _ in range(r.randrange(1, 4)))])
        text = out.getvalue() + f'5" pipe{delimiter}a"b"c{delimiter}"x""y"z{delimiter}""\n' * 3
        texts[f"{n}.csv"] = text + (f'9{delimiter}"never closed\n{delimiter}"" on\n1{delimiter}2' if n == 2 else "")
        (tmp_path / f"{n}.csv").write_text(texts[f"{n}.csv"])
    settings = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert files.read_lines(spark, str(tmp_path)).select("file_id", "block").distinct().count() > 12
        got = cells_read(spark, str(tmp_path), delimiter=delimiter)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {name: by_hand(text, delimiter) for name, text in texts.items()}


def test_overrides(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Наименование;a,b\nболт;1,2\n".encode("cp1251"))
    assert cells_read(spark, str(tmp_path), encoding="windows-1251", delimiter=",") == {"a.csv": [["Наименование;a", "b"], ["болт;1", "2"]]}
    (tmp_path / "a.csv").write_text("name,code,qty\nНаименование,Артикул,шт\nболт,7,3\n")
    cells = files.read_delimited(spark, str(tmp_path))
    assert {r["header_row"] for r in C.detect_headers(cells, header_row=1).collect()} == {1}


@pytest.mark.parametrize(
    "header, excluded, want",
    [
        (["Артикул", "Модель"], (), {"article": 0, "name": 1}), (["Код", "Название"], ("code_1c",), {"article": 0, "name": 1}), (["Код", "Название"], (), {"code_1c": 0, "name": 1}),
        (["Код ТНВЭД", "Товар", "Ед. изм."], (), {"name": 1, "unit": 2}), (["Цена за единицу", "Наименование товара"], (), {"price": 0, "name": 1}), (["Цена", "Кол-во"], (), {}),
    ],
)
def test_headers(spark, header, excluded, want):
    cells = spark.createDataFrame([("f", "", 0, i, h) for i, h in enumerate(header)], "file_id string, sheet string, row_idx int, col_idx int, value string")
    assert {r["field"]: r["col_idx"] for r in C.detect_headers(cells, excluded).collect()} == want


def test_price_words(spark):
    cases = {"цена без ндс": (True, "net"), "c ндс": (True, "gross"), "ррц": (True, "unknown"), "ставка ндс, %": (False, None), "сумма": (False, None), "price w/o vat": (True, "net")}
    df = spark.createDataFrame([(c,) for c in cases], "v string").select("v", C.is_price(F.col("v")).alias("p"), C.vat_basis(F.col("v")).alias("b"))
    assert {r["v"]: (r["p"], r["b"] if r["p"] else None) for r in df.collect()} == cases


def test_csv_sink(spark, tmp_path):
    write_csv(spark.createDataFrame([(1, "a;b", None)], "x int, y string, z string").coalesce(1), str(tmp_path / "out"))
    name = next(p for p in os.listdir(tmp_path / "out") if p.endswith(".csv"))
    assert (tmp_path / "out" / name).read_text() == 'x;y;z\n1;"a;b";\n'


def test_intake_reads_each_file_once(spark, folder, tmp_path):
    seen = []
    for _ in range(2):
        jobs.intake(spark, folder, str(tmp_path / "progress"), lambda df, n: seen.extend(r["name"] for r in df.collect())).awaitTermination()
    assert sorted(seen) == ["bolt", "nut", "Гайка", "Ключ", "Хомут; М10"]


def test_price_list_feed_imports_in_order(spark, tmp_path):
    """Three lists of one supplier: a new item, a changed price, then another item in its place."""
    stored = D.stored_items(spark, "/root/testdata/sf0.001").limit(0)
    schema = "source_id string, line_number long, article_raw string, code_1c string, name string, manufacturer string, price decimal(18,4), unit string"
    for price, article in ((1, "A-1"), (2, "A-1"), (3, "B-2")):
        rows = spark.createDataFrame([("S1", 1, article, None, "thing", None, price, None)], schema.replace("decimal(18,4)", "int"))
        rows.select("*").withColumn("price", F.col("price").cast("decimal(18,4)")).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    suppliers = spark.createDataFrame([("S1", "ABC")], "supplier_id string, prefix string")
    store, reports = [stored], []

    def keep(after, report, number):
        store.append(spark.createDataFrame(after.collect(), stored.schema))
        reports.append(tuple(report.first()[c] for c in ("inserted", "updated", "deactivated")))

    jobs.price_list_feed(spark, str(tmp_path / "feed"), schema, str(tmp_path / "p"), lambda: store[-1], suppliers, keep).awaitTermination()
    assert reports == [(1, 0, 0), (0, 1, 0), (1, 0, 1)]
    got = sorted((r["article_raw"], float(r["price"]), r["is_active"], r["supplier_sku"]) for r in store[-1].collect())
    assert got == [("A-1", 2.0, False, "ABC-000001"), ("B-2", 3.0, True, "ABC-000002")]


def test_first_sheet_by_number_and_price_fallback(spark):
    cells = spark.createDataFrame([("f", "B", 0, 0, 0, "x"), ("f", "B", 0, 3, 0, "y"), ("f", "A", 1, 0, 0, "z"), ("f", "A", 1, 4, 0, "z")], "file_id string, sheet string, sheet_no int, row_idx int, col_idx int, value string")
    assert {r["sheet"] for r in C.choose_sheet(cells).collect()} == {"B"}
    assert {r["sheet"] for r in C.choose_sheet(cells.drop("sheet_no")).collect()} == {"A"}
    rows = spark.createDataFrame([("f", 1, 5.0), ("f", 2, 6.0)], "file_id string, row_idx int, price_value double").withColumn("price_value", F.col("price_value").cast("decimal(18,4)"))
    entries = spark.createDataFrame([("f", 1, 7.0)], "file_id string, row_idx int, preferred double").withColumn("preferred", F.col("preferred").cast("decimal(18,4)"))
    assert {r["row_idx"]: float(r["price_value"]) for r in C.with_prices(rows, entries).collect()} == {1: 7.0, 2: 6.0}


def test_templates_learned_from_files(spark):
    mapping = spark.createDataFrame([("f1", 2, "name", 0), ("f2", 3, "name", 1), ("f3", 1, "name", 2)], "file_id string, header_row int, field string, col_idx int")
    files = spark.createDataFrame([("f1", "S1"), ("f2", "S1"), ("f3", "S2")], "file_id string, source_id string")
    known = spark.createDataFrame([("S2", 0, "name", 0)], "source_id string, header_row int, field string, col_idx int")
    assert [tuple(r) for r in C.new_templates(mapping, files, known).collect()] == [("S1", 2, "name", 0)]
