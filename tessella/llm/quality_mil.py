"""Operator 8: quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes, all of it. A passage's raw features are shares of byte classes, runs
and changes between classes, and how many distinct pairs and quads of bytes it has. A dense layer encodes each passage;
gated attention (tanh and sigmoid branches) weighs a document's passages; a logistic layer scores the weighted sum of
their codes. Labels are of documents only: the attention is learnt from them by backpropagation (numpy, Adam), on a sample
of at most 2 * ``per_class`` labelled rows, whose passage features (not texts) come to the driver: whole documents, in the
order of a hash, while they have ``most_passages`` passages together and none more than an eighth of that.

Defined results: null and empty texts are one passage of zeros; equal texts get equal scores; without labels of both
classes every score is the share of class 1 (0.5 without any label); an empty table gives no rows; other columns are
ignored; null doc_ids stay null and count as not held out by their crc of the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .sampling import labelled_sample

PASSAGE = 256
_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\t\r\x0b\x0c", b"#*$%&", b"|<>", b"!", b".", b",", b"?;:'\"()-_")
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _i, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _i
_CLASS[128:] = len(_CLASSES) + 1
_CLASS[0] = len(_CLASSES) + 2
_N = len(_CLASSES) + 3
DIM = _N - 1 + 6


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, and where each text's passages begin (one more at the end)."""
    n = [max(-(-len(t) // PASSAGE), 1) for t in texts]
    b = np.frombuffer(b"".join(t.ljust(k * PASSAGE, b"\0") for t, k in zip(texts, n)), np.uint8).reshape(-1, PASSAGE)
    c = _CLASS[b]
    row = np.arange(len(b))[:, None]
    counts = np.bincount((row * _N + c).ravel(), minlength=len(b) * _N).reshape(-1, _N).astype(np.float32)
    size = np.maximum(PASSAGE - counts[:, -1:], 1)
    real = (b[:, 1:] > 0)
    same = ((b[:, 1:] == b[:, :-1]) & real).sum(1, keepdims=True)
    change = ((c[:, 1:] != c[:, :-1]) & real).sum(1, keepdims=True)
    pair = b[:, :-1].astype(np.uint16) * np.uint16(251) + b[:, 1:]
    quad = pair[:, :-2] * np.uint16(31421) + pair[:, 2:]
    distinct = []
    for h in (pair, quad):
        h = np.sort(h, 1)
        distinct.append((h[:, 1:] != h[:, :-1]).sum(1, keepdims=True) + 1)
    begins = np.cumsum([0, *n])
    first = np.zeros((len(b), 1), np.float32)
    first[begins[:-1]] = 1
    f = np.concatenate((counts[:, :-1] / size, same / size, change / size, distinct[0] / size, distinct[1] / size, np.log(size) / 6, first), 1)
    return np.minimum(f, 2).astype(np.float32), begins


@dataclass
class Model:
    params: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    prior: float


def _forward(p: dict, x: np.ndarray, begins: np.ndarray) -> dict:
    h = np.tanh(x @ p["we"] + p["be"])
    t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-np.clip(h @ p["u"], -30, 30)))
    a = (t * s) @ p["w"]
    top = np.maximum.reduceat(a, begins[:-1])
    size = np.diff(begins)
    e = np.exp(a - np.repeat(top, size))
    a = e / np.repeat(np.add.reduceat(e, begins[:-1]), size)
    z = np.add.reduceat(a[:, None] * h, begins[:-1], 0)
    y = 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["c"], -30, 30)))
    return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": y}


def train(bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, code: int = 16, gate: int = 8, rounds: int = 500, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 1e-2
    bags = [(b - mean) / scale for b in bags]
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"we": init(DIM, code), "be": np.zeros(code, np.float32), "v": init(code, gate), "u": init(code, gate), "w": init(gate), "o": init(code), "c": np.zeros((), np.float32)}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    chance = weights / weights.sum()
    for step in range(1, rounds + 1):
        pick = rng.choice(len(bags), batch, p=chance)
        x = np.concatenate([bags[i] for i in pick]).astype(np.float32)
        size = np.array([len(bags[i]) for i in pick])
        begins = np.concatenate(([0], np.cumsum(size)))
        f = _forward(p, x, begins)
        dy = (f["y"] - labels[pick]) / batch
        g = {"o": f["z"].T @ dy, "c": dy.sum()}
        dz = np.repeat(dy[:, None] * p["o"], size, 0)
        da = (dz * f["h"]).sum(1)
        da = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, begins[:-1]), size))
        g["w"] = (f["t"] * f["s"]).T @ da
        dt, ds = da[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2), da[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        g["v"], g["u"] = f["h"].T @ dt, f["h"].T @ ds
        dh = (f["a"][:, None] * dz + dt @ p["v"].T + ds @ p["u"].T) * (1 - f["h"] ** 2)
        g["we"], g["be"] = x.T @ dh, dh.sum(0)
        for k in p:
            grad = g[k] + decay * p[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad**2
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(p, mean, scale, float((labels * weights).sum() / weights.sum()))


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    x, begins = passages(texts)
    return _forward(model.params, ((x - model.mean) / model.scale).astype(np.float32), begins)["y"]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, begins = passages(common.utf8(batch.column("text")))
        raw = [x[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), batch.column("weight"), pa.array(raw, pa.binary())], names=["doc_id", "label", "weight", "bag"])


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 2000, most_passages: int = 400_000) -> Model | None:
    """A model from labels(doc_id, quality). All passages of a sampled document teach."""
    scratch = common.Scratch(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", per_class, scratch)
    n = F.greatest(F.ceil(F.octet_length("text") / PASSAGE), F.lit(1))
    sample = sample.withColumn("n", n).filter(8 * F.col("n") <= most_passages)
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over the sample's rows alone
    sizes = sample.select("doc_id", "n").withColumn("upto", upto).filter(F.col("upto") <= most_passages).select("doc_id")
    sample = sample.join(F.broadcast(sizes), "doc_id")  # at most 2 * per_class rows
    rows = sample.mapInArrow(_bags, "doc_id long, label int, weight double, bag binary").orderBy("doc_id").collect()
    scratch.drop("sample")
    if not rows:
        return None
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, DIM) for r in rows]
    y, w = np.array([r["label"] for r in rows], np.float32), np.array([r["weight"] for r in rows])
    if len(set(y.tolist())) < 2:
        return Model({}, np.zeros(0), np.zeros(0), float(y.mean()))
    return train(bags, y, w)


def _score(batches: Iterator[pa.RecordBatch], model: Model | None, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            if model is None or not model.params:
                y = np.full(part.num_rows, 0.5 if model is None else model.prior)
            else:
                y = scores(model, common.utf8(part.column("text"))).astype(np.float64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(y, pa.float64()), pa.array((y >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for docs(doc_id, text, held_out)."""
    return docs.select(F.col("doc_id").cast("long"), "text", "held_out").mapInArrow(lambda it: _score(it, model, threshold), "doc_id long, held_out boolean, score double, predicted int")


def op8_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", (common.crc_mod("doc_id", 4) == 2).alias("held_out"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(common.crc_mod("doc_id", 4) != 2)
    return score(docs, learn(docs.filter("NOT held_out"), labels))
