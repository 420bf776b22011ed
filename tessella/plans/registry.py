"""Queries by name: a function of (spark, sf_dir), and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Bytes a core under which a table of texts counts as small.
SMALL = 4 << 20


def stored_bytes(table: DataFrame) -> int:
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


class Tables:
    """The Parquet tables below a folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        """Texts take long to work on: the rows of a small table, which is often a single row group that one task would read, are dealt
        to all cores; those of a large one stay where its files have them."""
        docs = self.spark.read.parquet(f"{self.sf_dir}/documents.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        return docs.repartition(cores) if stored_bytes(docs) < cores * SMALL else docs


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a function of Tables under a name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return f

    return add
