"""File sources: string-typed CSV with required columns, caret-separated legacy text, and source manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessella.functions.ids import zero_filled


def require_unique(df: DataFrame, key: str, label: str) -> DataFrame:
    """df, or an error that names offending keys if the key is null, blank or repeated."""
    bad = df.groupBy(key).count().filter((F.col("count") > 1) | F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")).limit(5).collect()
    if bad:
        raise ValueError(f"{label}: {key} is not unique: {[r[key] for r in bad]}")
    return df


def read_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV with a header (a byte order mark is dropped), all columns as text, blanks as null; extra columns stay.

    Raises ValueError if a required column is missing.
    """
    d = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    d = d.toDF(*[c.lstrip("﻿") for c in d.columns])
    missing = sorted(set(required) - set(d.columns))
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    return d.select([F.when(F.trim(F.col(f"`{c}`")) != "", F.col(f"`{c}`")).alias(c) for c in d.columns])


def read_caret_text(spark: SparkSession, path: str, columns: list[str], code: str, width: int = 5) -> DataFrame:
    """A legacy table: fields parted by ^, quoted by ~, Latin-1, no header; the code is filled with zeros up to a width.

    Raises ValueError if a code is blank or repeated, and Spark's error for a line with another number of fields.
    """
    schema = StructType([StructField(c, StringType()) for c in columns])
    d = spark.read.option("sep", "^").option("quote", "~").option("encoding", "ISO-8859-1").option("mode", "FAILFAST").schema(schema).csv(path)
    return require_unique(d.withColumn(code, zero_filled(F.trim(code), width)), code, path)


def number(c: Column) -> Column:
    """A finite number, or null for blanks; text that is no number is null as well (count it with `bad_number`)."""
    x = F.trim(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def bad_number(c: Column) -> Column:
    """Whether a text that isn't blank is no finite number."""
    return (F.coalesce(F.trim(c), F.lit("")) != "") & number(c).isNull()


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, bytes and SHA-256 of each file below a folder."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return d.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def tree_hash(files: DataFrame) -> str:
    """One SHA-256 over a manifest: names and hashes in order of name. A row for each source file, not for each record."""
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "sha256"))), lambda x: F.concat(x["name"], F.lit("\0"), x["sha256"], F.lit("\0"))), "")
    return files.agg(F.sha2(parts, 256)).first()[0]


def pages(c: Column) -> Column:
    """(page, text) of a text whose pages end in form feeds."""
    return F.posexplode(F.split(c, "\f"))
