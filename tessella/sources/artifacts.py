"""JSON and JSONL artifacts read as they come: a run reads only files that no run before has read, and parses only what is new or changed.

Files are a stream with a checkpoint of its own, so Spark keeps which were read. Each batch adds its rows to two tables and rewrites nothing:
`seen` tells of every address in the batch whether it is new, changed or the same, and `parsed` holds the parts of new and changed ones. A
batch that is run again after a failure replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.relational import best

from . import shared


def read_json(spark: SparkSession, path: str, schema: str, lines: bool | None = None) -> DataFrame:
    """Rows of JSON files: one object a line, or objects and arrays of them over many lines; told by the name's end (.jsonl, .ndjson) unless given."""
    each = path.rstrip("/").endswith((".jsonl", ".ndjson")) if lines is None else lines
    return spark.read.schema(schema).option("multiLine", not each).json(path)


class ArticleIndex:
    """Addresses and what stood there, in a folder. Rows are (url, body, fetched); a row without an address is left out."""

    SCHEMA = "url string, body string, fetched timestamp"

    def __init__(self, spark: SparkSession, path: str, parse: Callable[[DataFrame], DataFrame]):
        """`parse` takes (url, body) and gives url and further columns, a row an address."""
        self.spark, self.path, self.parse = spark, path.rstrip("/"), parse
        self.rows_read = 0

    def _table(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{name}") if shared.exists(self.spark, f"{self.path}/{name}") else None

    def _batch(self, rows: DataFrame, number: int) -> None:
        rows = rows.persist()  # a batch is read once, however often its rows are used
        try:
            self.rows_read += rows.count()
            self._add(rows, number)
        finally:
            rows.unpersist()

    def _add(self, rows: DataFrame, number: int) -> None:
        now = best(rows.filter("url IS NOT NULL"), ["url"], F.col("fetched").desc_nulls_last(), F.sha2(F.coalesce("body", F.lit("")), 256))
        now = now.withColumn("hash", F.sha2(F.coalesce("body", F.lit("")), 256))
        seen = self._table("seen")
        before = seen.filter(F.col("batch") < number) if seen is not None else None
        if before is not None:
            last = best(before, ["url"], F.col("batch").desc()).select("url", F.col("hash").alias("__hash"))
            now = now.join(last, "url", "left")
        else:
            now = now.withColumn("__hash", F.lit(None).cast("string"))
        change = F.when(F.col("__hash").isNull(), "new").when(F.col("__hash") != F.col("hash"), "changed").otherwise("same")
        now.select("url", "hash", "fetched", change.alias("change")).write.mode("overwrite").parquet(f"{self.path}/seen/batch={number}")
        todo = now.filter(change != "same").select("url", "body")
        self.parse(todo).write.mode("overwrite").parquet(f"{self.path}/parsed/batch={number}")

    def ingest(self, folder: str, lines: bool = True) -> int:
        """Read what is new in a folder, all of it, and give the number of its rows."""
        stream = self.spark.readStream.schema(self.SCHEMA).option("multiLine", not lines).option("recursiveFileLookup", True).json(folder)
        name, self.rows_read = "lines" if lines else "objects", 0
        q = stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.path}/read-{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return self.rows_read

    def changes(self) -> DataFrame | None:
        """Every address of every batch: url, hash, fetched, change, batch."""
        return self._table("seen")

    def current(self) -> DataFrame | None:
        """The latest parts of each address, with when it was seen last and how often it was parsed."""
        seen, parsed = self._table("seen"), self._table("parsed")
        if seen is None or parsed is None:
            return None
        about = seen.groupBy("url").agg(F.max("fetched").alias("last_seen"), F.count_if(F.col("change") != "same").alias("times_parsed"))
        return best(parsed, ["url"], F.col("batch").desc()).drop("batch").join(about, "url")
