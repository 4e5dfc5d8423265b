"""Files as tables: foreign tables, COPY in and out, staging in the shared folder, JDBC."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, read from the session.

    Only where it is unset and the master is of this machine alone (tests), a new folder here is taken;
    it goes when the interpreter ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_OPENED: set[str] = set()


def _drop(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before the interpreter
        return


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; all that this application put there goes when it ends."""
    top = f"{shared_folder(spark)}/quern-{spark.sparkContext.applicationId}"
    if top not in _OPENED:
        _OPENED.add(top)
        atexit.register(_drop, spark, top)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends here,
    work is not repeated, and a lost executor costs nothing that was written."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, kind: str, partition_by: list[str] | None = None, **options: str) -> str:
    """Writes df to a new path of the shared folder and returns the path."""
    path = new_path(df.sparkSession, "stage")
    writer = df.write.format(kind).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    return path


def foreign_table(spark: SparkSession, path: str, kind: str, schema: StructType | str, **options: str) -> DataFrame:
    """A flat file as a table; filters and columns are pushed into formats that take them."""
    return spark.read.format(kind).schema(schema).options(**options).load(path)


def copy_to(df: DataFrame, path: str, kind: str = "csv", delimiter: str = ",", null: str = "", header: bool = False) -> None:
    """COPY (query) TO path: text (tab, \\N) or CSV."""
    if kind == "text":
        delimiter, null = "\t", "\\N"
    df.write.option("header", header).option("delimiter", delimiter).option("nullValue", null).option("emptyValue", "").csv(path)


def copy_from(spark: SparkSession, path: str, schema: StructType | str, kind: str = "csv", delimiter: str = ",", null: str = "", header: bool = False) -> DataFrame:
    """COPY table FROM path; a row that does not fit the schema is an error, as in the reference."""
    if kind == "text":
        delimiter, null = "\t", "\\N"
    reader = spark.read.schema(schema).option("header", header).option("delimiter", delimiter).option("nullValue", null).option("mode", "FAILFAST")
    return reader.csv(path)


def remote_query(spark: SparkSession, url: str, text: str, driver: str | None = None, fetch_size: int = 10_000) -> DataFrame:
    """A remote SQL source (foreign table or dblink): filters, aggregates and limits are pushed over JDBC."""
    reader = spark.read.format("jdbc").option("url", url).option("query", text).option("fetchsize", fetch_size)
    return (reader.option("driver", driver) if driver else reader).load()


def remote_table(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int) -> DataFrame:
    """A remote table read by key ranges in parallel."""
    options = {"url": url, "dbtable": table, "partitionColumn": column, "lowerBound": low, "upperBound": high, "numPartitions": parts, "pushDownAggregate": "true", "pushDownLimit": "true"}
    return spark.read.format("jdbc").options(**{k: str(v) for k, v in options.items()}).load()
