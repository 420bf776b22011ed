"""Sinks: tables in two formats published at once, ordered for repeatable output, and keyed upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish(spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, list[str]], path: str, overwrite: bool = False) -> None:
    """Write every table as zstd Parquet and CSV below a folder beside `path`, then rename it into place.

    Rows are ordered by their keys across files, so that the same data gives the same content. Nothing appears at
    `path` before all tables are whole, and a failure leaves what was there. Empty tables still write their schema.
    """
    fs, goal = _fs(spark, path)
    if fs.exists(goal) and not overwrite:
        raise FileExistsError(path)
    temp = f"{path.rstrip('/')}.tmp-{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            # ranges keep the order across files without bringing a table into one task
            ordered = df.repartitionByRange(*keys[name]).sortWithinPartitions(*keys[name]) if keys.get(name) else df
            ordered.write.option("compression", "zstd").parquet(f"{temp}/{name}.parquet")
            # from what was written, so that the two agree whatever made the table
            again = spark.read.schema(ordered.schema).parquet(f"{temp}/{name}.parquet")
            again = again.repartitionByRange(*keys[name]).sortWithinPartitions(*keys[name]) if keys.get(name) else again
            again.write.option("header", True).csv(f"{temp}/{name}.csv")
        old = None
        if fs.exists(goal):
            old = _fs(spark, f"{temp}-old")[1]
            fs.rename(goal, old)
        if not fs.rename(_fs(spark, temp)[1], goal):
            if old is not None:
                fs.rename(old, goal)
            raise OSError(f"could not publish {path}")
        if old is not None:
            fs.delete(old, True)
    except BaseException:
        fs.delete(_fs(spark, temp)[1], True)
        raise


def content_hash(df: DataFrame) -> str:
    """A hash of a table's rows that depends on neither their order nor the files they lie in."""
    row = F.xxhash64(*[F.to_json(F.struct("*"))])
    r = df.select(row.alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return f"{r['n']}-{r['x']}-{r['s']}"


def insert_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table and those rows whose keys it lacks; of rows with one key, one."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """table with rows put in place of those with the same keys, if their version is at least as high."""
    both = table.withColumn("__new", F.lit(0)).unionByName(rows.select(*table.columns).withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last(), F.col("__new").desc())
    return both.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "__new")
