"""Every query of the library by name, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.operators import autocomplete, documents, events, evidence, figures, layout, lexical, mentions, planning, relational, release, resolve, review, text_index, vector_index, vectors, wording, workflow
from tessella.streaming import queries as streams

from .registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked prefix search with BM25 and tiers."""
    return QUERIES["search_ranked"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


MODULES = (autocomplete, documents, events, evidence, figures, layout, lexical, mentions, planning, relational, release, resolve, review, streams, text_index, vector_index, vectors, wording, workflow)
