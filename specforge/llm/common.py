"""Pieces shared by the operators of this subpackage."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a missing doc_id inside the operators; it sorts before every other id.
NO_ID = -(2**63)
#: Rows that Spark hands to a Python worker at once. Spark's own 10,000 whole texts, held in several copies on the way,
#: would take hundreds of MB of an executor.
BATCH_ROWS = 500


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def id_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def id_back(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(NO_ID))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Only a local session, as in tests, may go without one
    and gets a new folder; elsewhere a folder of one machine would lose what other machines write."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def _written(df: DataFrame) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Write a result that is used more than once to the shared folder and read it back, so that a lost executor
    costs no recomputation and every use sees the same rows."""
    return _written(df)[1]


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows per batch to BATCH_ROWS; a lower setting stays."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, BATCH_ROWS)


class Scratch:
    """Settled tables that are deleted together after their last use."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def settle(self, df: DataFrame) -> DataFrame:
        path, read = _written(df)
        self.paths.append(path)
        return read

    def drop(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths = []


def fits(df: DataFrame, most: int) -> bool:
    """Whether a table has at most so many rows; it stops counting there."""
    return df.limit(most + 1).count() <= most


def aside(columns: list[str], *names: str) -> list[str]:
    """Names for helper columns that none of the columns has."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out
