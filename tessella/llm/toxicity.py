"""Operator 9: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of lexicon words (insults given as a parameter, and words and word beginnings that the
training rows show to be much more frequent in toxic documents), how near they stand to second-person words, capitals,
punctuation, and obfuscation (digits and signs for letters, spaced letters) with the lexicon words it hides. Term counts
come from a Spark aggregation over the sample; at most ``most_terms`` terms are kept. Trees are grown in numpy on the
features of at most 2 * ``per_class`` labelled rows, two thirds of them, which the terms come from as well; the others, whose labels
nothing before has seen, calibrate the score by pooling adjacent violators, weighted to the classes' real shares. (With fewer than three
rows of a class in either part, all rows do both, and scores are too sure.)

Defined results: null and empty texts have features 0; very long texts are read whole; equal texts get equal scores; without labels of both classes every
score is 0; an empty table gives no rows; other columns are ignored (``drop_toxic`` keeps them); null doc_ids stay null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common
from .sampling import labelled_sample

INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "fool", "dumb", "ugly", "hate", "vermin", "filth", "garbage", "jerk", "freak")
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre vos usted ustedes tú ti tus vosotros".split())
_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[^\W\d_][0-9@$*!|+._\-]+[^\W\d_]")
_SPACED = re.compile(r"\b(?:[^\W\d_][ .\-_*]){3,}[^\W\d_]\b")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "*": None, ".": None, "_": None, "-": None})
_RUNS = re.compile(r"[!?]{2,}")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SHOUT = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
STARTS = (4, 5, 6)
DIM = 16


@dataclass
class Lexicon:
    words: frozenset
    starts: frozenset

    def hit(self, w: str) -> bool:
        return w in self.words or (len(w) >= 4 and (w[:4] in self.starts or w[:5] in self.starts or w[:6] in self.starts))


def features(text: str, lex: Lexicon) -> list[float]:
    if not text:
        return [0.0] * DIM
    low = text.lower()
    words = _WORD.findall(low)
    n = max(len(words), 1)
    in_words, starts = lex.words, lex.starts
    at = [i for i, w in enumerate(words) if w in in_words or w[:4] in starts or w[:5] in starts or w[:6] in starts]
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0.0
    if at and you:
        k = np.searchsorted(you, at)
        y = np.array(you)
        left = np.abs(np.array(at) - y[np.maximum(k - 1, 0)])
        right = np.abs(y[np.minimum(k, len(y) - 1)] - np.array(at))
        near = float((1 / (1 + np.minimum(left, right))).sum())
    hidden, mixed = 0, 0
    if _MIXED.search(low):
        for w in low.split():
            if _MIXED.search(w):
                mixed += 1
                hidden += lex.hit(w.translate(_LEET)) and not any(map(lex.hit, _WORD.findall(w)))
    spaced = [re.sub(r"[^\w]|_", "", w) for w in _SPACED.findall(low)]
    hidden += sum(map(lex.hit, spaced))
    hits = len(at)
    distinct = len({words[i] for i in at})
    chars = len(text)
    return [
        hits / n, np.log1p(hits), distinct, hidden, hidden / n, near, near / n, len(you) / n, len(_UPPER.findall(text)) / chars, len(_SHOUT.findall(text)) / n,
        text.count("!") / n, text.count("?") / n, len(_RUNS.findall(text)) / n, (mixed + len(spaced)) / n, chars / n, np.log1p(len(words)),
    ]


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 4.0) -> list:
    """Boosted regression trees on the logistic loss. A tree: feature, cut and value of each node, in heap order."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    b = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)
    f = np.full(len(y), 0.0)
    out = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = w * (y - p), w * p * (1 - p)
        node = np.zeros(len(y), int)
        size = 2 ** (depth + 1) - 1
        feat, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        for k in range(size):
            mine = np.flatnonzero(node == k)
            if not len(mine):
                continue
            gs, hs = g[mine].sum(), h[mine].sum()
            value[k] = rate * gs / (hs + 1)
            if k >= size // 2 or len(mine) < 2 * least:
                continue
            best = (1e-6, -1, 0)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                gl = np.cumsum(np.bincount(b[mine, j], g[mine], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(b[mine, j], h[mine], len(c) + 1))[:-1]
                nl = np.cumsum(np.bincount(b[mine, j], minlength=len(c) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(nl < least) | (len(mine) - nl < least)] = 0
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], j, i)
            if best[1] >= 0:
                feat[k], cut[k] = best[1], cuts[best[1]][best[2]]
                node[mine] = 2 * k + 1 + (x[mine, best[1]] > cut[k])
        f = f + value[node]
        out.append((feat, cut, value))
    return out


def margin(trees: list, x: np.ndarray) -> np.ndarray:
    f = np.zeros(len(x))
    rows = np.arange(len(x))
    for feat, cut, value in trees:
        node = np.zeros(len(x), int)
        while True:
            k = feat[node]
            inner = k >= 0
            if not inner.any():
                break
            node = np.where(inner, 2 * node + 1 + (x[rows, np.maximum(k, 0)] > cut[node]), node)
        f += value[node]
    return f


def isotonic(f: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block middles and their non-decreasing means, for linear interpolation."""
    order = np.argsort(f, kind="stable")
    blocks: list[list[float]] = []
    for i in order:
        blocks.append([y[i] * w[i], w[i], f[i], f[i]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, t, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += t
            blocks[-1][3] = hi
    return np.array([x for _, _, a, b in blocks for x in (a, b)]), np.array([x for s, t, _, _ in blocks for x in (s / t, s / t)])


@dataclass
class Model:
    lexicon: Lexicon
    trees: list = field(default_factory=list)
    knots: np.ndarray = field(default_factory=lambda: np.zeros(1))
    values: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.trees or not texts:
            return np.zeros(len(texts))
        x = np.array([features(t, self.lexicon) for t in texts], float)
        return np.interp(margin(self.trees, x), self.knots, self.values)


def _terms(sample: DataFrame, most_terms: int) -> DataFrame:
    """Words and word beginnings that toxic documents of the sample hold much more often than the others."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)[^\W\d_]+"), F.lit(0)))
    d = sample.repartition(64, "doc_id").select("label", words.alias("w"))
    # strings, unlike structs, are made distinct by hashing
    start = lambda k: F.array_distinct(F.transform(F.filter("w", lambda x: F.length(x) >= k), lambda x: F.concat(F.lit(str(k)), F.substring(x, 1, k))))
    terms = F.concat(F.transform("w", lambda x: F.concat(F.lit("0"), x)), *(start(k) for k in STARTS))
    t = d.select("label", F.explode(terms).alias("t")).groupBy("t").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    t = t.select(F.substring("t", 1, 1).cast("int").alias("kind"), F.expr("substring(t, 2)").alias("term"), "toxic", "clean")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = max(sizes.get(1, 0), 1), max(sizes.get(0, 0), 1)
    p, k, m = n1 / (n1 + n0), F.col("toxic"), F.col("clean")
    both = k + m
    # log-likelihood ratio: so high a bar that chance words of a large vocabulary stay out
    g = 2 * (k * F.log(k / (both * p)) + F.when(m > 0, m * F.log(m / (both * (1 - p)))).otherwise(0))
    odds = (k / n1) / ((m + 0.5) / n0)
    return t.filter((k > 0) & (odds >= 10)).withColumn("g", g).filter(F.col("g") >= 28).orderBy(F.col("g").desc(), "kind", "term").limit(most_terms)


def _sample_features(batches: Iterator[pa.RecordBatch], lex: Lexicon) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t, lex) for t in batch.column("text").to_pylist()]
        kept = ("doc_id", "label", "weight", "rest")
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(x, pa.list_(pa.float64()))], names=[*kept, "x"])


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 2000, most_terms: int = 200, insults: tuple[str, ...] = INSULTS) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, toxic)."""
    scratch = common.Scratch(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", per_class, scratch).withColumn("rest", F.crc32(F.concat(F.lit("calibrate "), F.col("doc_id").cast("string")).cast("binary")) % 3 == 0)
    parts = {(r["label"], r["rest"]): r["count"] for r in sample.groupBy("label", "rest").count().collect()}
    apart = min(parts.get((k, rest), 0) for k in (0, 1) for rest in (False, True)) >= 3
    terms = _terms(sample.filter("NOT rest") if apart else sample, most_terms).collect()
    lex = Lexicon(frozenset(insults) | {r["term"] for r in terms if r["kind"] == 0}, frozenset(r["term"] for r in terms if r["kind"]))
    rows = sample.mapInArrow(lambda it: _sample_features(it, lex), "doc_id long, label int, weight double, rest boolean, x array<double>").orderBy("doc_id").collect()
    scratch.drop("sample")
    if len({r["label"] for r in rows}) < 2:
        return Model(lex)
    x, y, w = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float), np.array([r["weight"] for r in rows])
    rest = np.array([r["rest"] for r in rows]) if apart else np.ones(len(y), bool)
    fit = ~rest if apart else rest
    trees = grow(x[fit], y[fit], w[fit] / w[fit].mean())
    return Model(lex, trees, *isotonic(margin(trees, x[rest]), y[rest], w[rest]))


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            y = model.scores(part.column("text").to_pylist())
            kept = [c for c in part.schema.names if c != "text"]  # texts don't come back
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(y, pa.float64())], names=[*kept, "__toxicity"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The other columns of docs(text, ...) with the column __toxicity."""
    schema = StructType([*(f for f in docs.schema.fields if f.name != "text"), StructField("__toxicity", DoubleType())])
    return docs.mapInArrow(lambda it: _score(it, model), schema)


def _mild(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            texts = part.column(0).field("text").cast(pa.string()).to_pylist()
            yield part.filter(pa.array(model.scores(texts) < threshold))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs with a lower score, with the columns of docs, which may have any names.

    Whole rows go to Python and back: a scalar function would get the texts alone, but Spark keeps the rows beside it, which took
    a third more of an executor's memory.
    """
    packed = docs.select(F.struct("*").alias("row"))
    return packed.mapInArrow(lambda it: _mild(it, model, threshold), packed.schema).select("row.*")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text", (common.crc_mod("doc_id", 5) == 0).alias("held_out"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(common.crc_mod("doc_id", 5) != 0)
    scored = score(docs, learn(docs.filter("NOT held_out").drop("held_out"), labels))
    return scored.select("doc_id", "held_out", F.col("__toxicity").alias("score"), (F.col("__toxicity") >= 0.5).cast("int").alias("predicted"))
