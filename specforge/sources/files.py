"""Delimited files of unknown encoding and delimiter as one long table of cells.

A file is read in pieces by many tasks, so a line break inside quotes is found without reading the file in order. A line
maps the state before it (outside or inside a quoted field) to the state behind it: it keeps the state, turns it, or
sets it whatever it was. Such maps compose, so a running composition inside each piece, and one over the pieces of a
file, give the state before every line; a record begins where that is outside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import settled

#: Delimiters tried, in order of preference.
DELIMITERS = [",", ";", "\t", "|"]
#: Lines of a file that its delimiter is inferred from.
LOOKED_AT = 20
_HIGH = bytes(range(128, 256))
_LATIN = _HIGH.decode("latin-1")
_CYRILLIC = "".join(bytes([b]).decode("cp1251", "replace") for b in _HIGH)
#: What stands between quotes: doubled quotes are part of it.
_QUOTED = '[^"]*+(?:""[^"]*+)*+'


def _from_cyrillic(content: Column) -> Column:
    return F.translate(F.decode(content, "ISO-8859-1"), _LATIN, _CYRILLIC)


def decoded(content: Column) -> Column:
    """Text of a file: UTF-8 where its bytes are valid, else Windows-1251; without a byte order mark."""
    utf8 = content.cast("string")
    return F.regexp_replace(F.when(F.is_valid_utf8(utf8), utf8).otherwise(_from_cyrillic(content)), "^\ufeff", "")


def read_lines(spark: SparkSession, path: str, pattern: str = "*.{csv,tsv,txt}", encoding: str | None = None) -> DataFrame:
    """file_id, block (where the piece of the file begins), at (order inside it), line of every delimited file under a
    path. encoding: "utf-8" or "windows-1251" for all files; else UTF-8 where all bytes of a file are."""
    raw = spark.read.option("pathGlobFilter", pattern).text(path).select(
        F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("raw")
    )
    raw = settled(raw)
    utf8 = F.col("raw").cast("string")
    if encoding:
        named = {"utf-8": utf8, "windows-1251": _from_cyrillic(F.col("raw"))}
        lines = raw.withColumn("line", named[encoding.lower()])
    else:
        whole = raw.groupBy("file_id").agg(F.min(F.is_valid_utf8(utf8)).alias("utf8"))
        lines = raw.join(whole, "file_id").withColumn("line", F.when(F.col("utf8"), utf8).otherwise(_from_cyrillic(F.col("raw"))))
    unmarked = F.when(F.col("block") == 0, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line"))
    return lines.select("file_id", "block", "at", unmarked.alias("line"))


def _escaped(delimiter: Column) -> Column:
    return F.concat(F.lit("\\"), delimiter)


def _fields(record: Column, delimiter: Column) -> Column:
    """The fields of a record. A delimiter inside double quotes does not count; doubled quotes stand for one; a quote
    inside a field that does not begin with one is a character."""
    d = _escaped(delimiter)
    pattern = F.concat(F.lit("(?s)"), d, F.lit(f'("{_QUOTED}"[^'), d, F.lit(']*+|"' + _QUOTED + '$|(?!")[^'), d, F.lit("]*+)"))
    parts = F.regexp_extract_all(F.concat(delimiter, record), pattern, F.lit(1))
    quoted = rf'(?s)^"({_QUOTED})"?(.*)$'
    bare = lambda f: F.when(f.startswith('"'), F.concat(F.replace(F.regexp_extract(f, quoted, 1), F.lit('""'), F.lit('"')), F.regexp_extract(f, quoted, 2))).otherwise(f)
    return F.transform(parts, bare)


def infer_delimiters(lines: DataFrame, delimiter: str | None = None) -> DataFrame:
    """file_id and delimiter: the one given, or of those tried the one that cuts the first lines into most columns (by the
    median), then with the least spread, then the first."""
    if delimiter:
        return lines.select("file_id").distinct().withColumn("delimiter", F.lit(delimiter))
    full = lines.filter((F.trim("line") != "") & (F.col("block") == 0))
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy("at"))
    head = full.withColumn("n", rank).filter(F.col("n") <= LOOKED_AT)
    tried = head.select("file_id", "line", F.posexplode(F.array(*map(F.lit, DELIMITERS))).alias("nth", "delimiter"))
    sized = tried.withColumn("columns", F.size(_fields(F.col("line"), F.col("delimiter"))))
    scored = sized.groupBy("file_id", "nth", "delimiter").agg(
        F.percentile("columns", 0.5).alias("median"), (F.max("columns") - F.min("columns")).alias("spread")
    )
    return scored.groupBy("file_id").agg(F.max_by("delimiter", F.struct("median", -F.col("spread"), -F.col("nth"))).alias("delimiter"))


def _maps(line: Column, delimiter: Column) -> tuple[Column, Column]:
    """Whether a line ends inside quotes if it begins outside, and if it begins inside."""
    d = _escaped(delimiter)
    fields = F.concat(F.lit(f'(?:(?:"{_QUOTED}"[^'), d, F.lit(']*+|(?!")[^'), d, F.lit("]*+)"), d, F.lit(f')*+"{_QUOTED}$'))
    outside = F.regexp_like(line, F.concat(F.lit("^"), fields))
    inside = line.rlike(f"^{_QUOTED}$") | F.regexp_like(line, F.concat(F.lit(f'^{_QUOTED}"[^'), d, F.lit("]*+"), d, fields))
    return outside, inside


def _composed(rows: DataFrame, own: list[str], order: str) -> DataFrame:
    """Adds set_ and turned: what the rows before each one make of the state: set_ (null: not set) else the state before
    the first row, turned if turned is 1. Rows: outside, inside."""
    before = Window.partitionBy(*own).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sets, turns = F.col("outside") == F.col("inside"), (F.col("outside") & ~F.col("inside")).cast("int")
    turns_before = F.coalesce(F.sum(turns).over(before), F.lit(0)) % 2
    rows = rows.withColumn("turned", turns_before)
    # a state that is set counts as if it had been there from the start
    mark = F.when(sets, F.col("outside").cast("int").bitwiseXOR(F.col("turned").cast("int")))
    return rows.withColumn("_mark", mark).withColumn("set_", F.last("_mark", ignorenulls=True).over(before)).drop("_mark")


def _inside(first: Column) -> Column:
    """The state before a row (1: inside quotes), from the one before the first row."""
    return F.coalesce("set_", first).bitwiseXOR(F.col("turned").cast("int"))


def records(lines: DataFrame, delimiters: DataFrame) -> DataFrame:
    """file_id, row_idx, line, delimiter: the records of the files; one that runs over several lines holds them with line
    feeds between. Quotes that are never closed take the rest of their file."""
    piece = ["file_id", "block"]
    joined = lines.join(delimiters, "file_id")
    outside, inside = _maps(F.col("line"), F.col("delimiter"))
    placed = settled(_composed(joined.withColumns({"outside": outside, "inside": inside}), piece, "at"))
    # what a whole piece makes of the state follows from its last row
    last = F.max_by(F.struct("set_", "turned", "outside", "inside"), "at").alias("x")
    behind = lambda start: F.when(F.coalesce("x.set_", F.lit(start)).bitwiseXOR(F.col("x.turned").cast("int")) == 1, F.col("x.inside")).otherwise(F.col("x.outside"))
    pieces = placed.groupBy(*piece).agg(last).select(*piece, behind(0).alias("outside"), behind(1).alias("inside"))
    pieces = _composed(pieces, ["file_id"], "block").select(*piece, _inside(F.lit(0)).alias("first"))
    started = placed.join(pieces, piece).withColumn("starts", (_inside(F.col("first")) == 0).cast("long")).select(*piece, "at", "line", "delimiter", "starts")
    started = settled(started)
    counts = started.groupBy(*piece).agg(F.sum("starts").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    along = Window.partitionBy(*piece).orderBy("at")
    counts = counts.withColumn("offset", offset).select(*piece, "offset")
    numbered = started.withColumns({"row_idx": F.sum("starts").over(along), "alone": (F.col("starts") == 1) & (F.lead("starts").over(along) == 1)})
    numbered = numbered.join(counts, piece).withColumn("row_idx", (F.col("row_idx") + F.col("offset") - 1).cast("int"))
    single = numbered.filter("alone").select("file_id", "row_idx", "line", "delimiter")
    # records over several lines, and the last of each piece, which may go on in the next
    rest = numbered.filter(~F.coalesce("alone", F.lit(False))).groupBy("file_id", "row_idx", "delimiter").agg(F.sort_array(F.collect_list(F.struct("block", "at", "line"))).alias("lines"))
    return single.unionByName(rest.select("file_id", "row_idx", F.array_join(F.col("lines.line"), "\n").alias("line"), "delimiter"))


def cells_of(lines: DataFrame, delimiters: DataFrame) -> DataFrame:
    """file_id, sheet, row_idx, col_idx, value of every cell; lines as read_lines gives them."""
    whole = records(lines, delimiters)
    return whole.select("file_id", F.lit("").alias("sheet"), "row_idx", F.posexplode(_fields(F.col("line"), F.col("delimiter"))).alias("col_idx", "value"))


def read_delimited(spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None) -> DataFrame:
    """Cells of the files under a path; an encoding or a delimiter that is given holds for all of them."""
    lines = read_lines(spark, path, encoding=encoding)
    return cells_of(lines, infer_delimiters(lines, delimiter))
