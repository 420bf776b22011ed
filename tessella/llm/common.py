"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters between words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def arrow_batches(spark: SparkSession) -> None:
    """Texts, vectors and token sets can be long: batches between Spark and Python are bounded by bytes, not only by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors can reach.

    Where the setting is absent, a temporary folder becomes the session's checkpoint folder, in local mode only: on a
    cluster each executor would write to a disk of its own, so there the setting is required.
    """
    arrow_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessella/{uuid.uuid4().hex}"


class Scratch:
    """The tables that a job writes between its steps, in one new shared folder; each can be dropped when its readers are written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, shared_dir(spark), 0
        self.paths: dict[str, str] = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Write df as Parquet and read it again: lineage ends there, and lost executors cost nothing."""
        self.n += 1
        self.paths[name] = path = f"{self.path}/{self.n}_{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.paths.pop(name))


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again. The table stays."""
    return Scratch(df.sparkSession).put(name, df)


def numbered(scratch: Scratch, df: DataFrame, order: list, name: str) -> DataFrame:
    """df with its rows' places in ``order``, from 1, as column ``name``, at any size: ranges of the order are written and counted,
    and each range numbers its rows after those of the ranges before it."""
    dealt = scratch.put("dealt", df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before, starts = 0, []
    for r in sorted(dealt.groupBy("__range").count().collect(), key=lambda r: r["__range"]):  # one row a range
        starts.append((r["__range"], before))
        before += r["count"]
    first = F.broadcast(scratch.spark.createDataFrame(starts, "__range int, __before long"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.join(first, "__range").withColumn(name, (F.col("__before") + place).cast("long")).drop("__range", "__before")


#: Under this size a core, a Parquet table is often a single row group, which one task would read.
SMALL = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table documents; the rows of a small one are dealt to all cores, those of a large one stay where its files have them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(cores) if size < cores * SMALL else docs


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def py_crc_mod(value: object, n: int) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode()) % n


def utf8(column) -> list[bytes]:
    """The values of an Arrow string column as UTF-8; null counts as empty."""
    import pyarrow as pa

    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]
