"""Bounded samples of labelled rows, chosen by hash, for classifiers that are trained on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, scratch: common.Scratch) -> DataFrame:
    """doc_id, text, label, weight: at most ``per_class`` labelled documents of each of the classes 0 and 1.

    ``weight`` is the rows of a class that each sampled one stands for. Null ids, texts and labels teach nothing; of
    several labels of one document the largest counts. Labels of documents that aren't there take no place (those of
    documents whose text is null do: for that, all texts would have to be read). The table is ``sample`` of the scratch, to be
    dropped once the model is there.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    texts = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = scratch.put("known", known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    place = F.xxhash64("doc_id", F.lit(label))
    parts = [known.filter(F.col("label") == k).orderBy(place, "doc_id").limit(per_class).withColumn("weight", F.lit(max(sizes.get(k, 0) / per_class, 1.0))) for k in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * per_class rows
    sample = scratch.put("sample", texts.join(chosen, "doc_id").dropDuplicates(["doc_id"]))
    scratch.drop("known")
    return sample
