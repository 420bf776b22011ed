"""Operator 4: language identification by a bidirectional gated recurrent network over bytes.

Training: a bounded sample of labelled rows (``per_lang`` rows of each language, chosen by hash; where the languages are
many, an equal share of ``most_rows``, but one row of each at least) gives ``windows_per_text`` windows of ``steps`` bytes for each row,
which executors draw at seeded places of the whole texts, longer texts more of them, and only which come to the driver. A small network (a forward and a backward GRU, whose states label every position) is trained in numpy by backpropagation
through time with Adam. Scoring: every text is cut into windows of ``steps`` bytes, all of them are labelled at every position,
many windows at a time, and a document's probabilities are the mean of its positions' log probabilities, normalised.

Defined results: texts that are null or have no letters (Unicode category L) are `und` with score 0; bytes 0 are bytes like others; languages that are null teach nothing; equal
texts get equal results; without any labelled row every text is `und`; an empty table gives no rows; other columns are
ignored; texts of any length are read whole, in windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

STEPS, HIDDEN, BROADCAST_ROWS = 64, 8, 10_000


@dataclass
class Model:
    langs: list[str]
    params: dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def _run(x: np.ndarray, table: np.ndarray, u: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States of a GRU over x (steps, batch) of byte values. table: a byte's part of update gate, reset gate, candidate."""
    h_n = u.shape[0]
    h = np.zeros((x.shape[1], h_n), np.float32)
    states, saved = np.empty((*x.shape, h_n), np.float32), []
    for t in range(x.shape[0]):
        e = table[x[t]]
        g = _sigmoid(e[:, : 2 * h_n] + h @ u[:, : 2 * h_n])
        z, r = g[:, :h_n], g[:, h_n:]
        c = np.tanh(e[:, 2 * h_n :] + (r * h) @ u[:, 2 * h_n :])
        if keep:
            saved.append((h, z, r, c))
        h = h + z * (c - h)
        states[t] = h
    return states, saved


def _back(x: np.ndarray, u: np.ndarray, saved: list, d_states: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of table and u from those of the states, backwards through time."""
    h_n = u.shape[0]
    d_table, d_u = np.zeros_like(table), np.zeros_like(u)
    dh = np.zeros_like(d_states[0])
    for t in range(len(saved) - 1, -1, -1):
        h, z, r, c = saved[t]
        dh = dh + d_states[t]
        dc = dh * z * (1 - c * c)
        dz = dh * (c - h) * z * (1 - z)
        drh = dc @ u[:, 2 * h_n :].T
        dr = drh * h * r * (1 - r)
        d_e = np.concatenate((dz, dr, dc), 1)
        np.add.at(d_table, x[t], d_e)
        d_u[:, : 2 * h_n] += h.T @ d_e[:, : 2 * h_n]
        d_u[:, 2 * h_n :] += (r * h).T @ dc
        dh = dh * (1 - z) + drh * r + d_e[:, : 2 * h_n] @ u[:, : 2 * h_n].T
    return d_table, d_u


def _outputs(p: dict[str, np.ndarray], f: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probabilities at every position."""
    y = f @ p["wf"] + b @ p["wb"] + p["bias"]
    y -= y.max(-1, keepdims=True)
    return y - np.log(np.exp(y).sum(-1, keepdims=True))


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], hidden: int = HIDDEN, rounds: int = 240, batch: int = 96, rate: float = 0.02, seed: int = 7) -> Model:
    """windows: (n, steps) bytes; labels: (n,) language numbers. Every position is to name the window's language."""
    rng = np.random.default_rng(seed)
    n_lang = len(langs)
    init = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    p = {"tf": init(256, 3 * hidden), "uf": init(hidden, 3 * hidden), "tb": init(256, 3 * hidden), "ub": init(hidden, 3 * hidden), "wf": init(hidden, n_lang), "wb": init(hidden, n_lang), "bias": np.zeros(n_lang, np.float32)}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    by_lang = [np.flatnonzero(labels == k) for k in range(n_lang)]
    by_lang = [x for x in by_lang if len(x)]
    for step in range(1, rounds + 1):
        pick = np.concatenate([rng.choice(x, max(batch // len(by_lang), 1)) for x in by_lang])
        x, y = windows[pick].T, labels[pick]
        f, sf = _run(x, p["tf"], p["uf"], True)
        b, sb = _run(x[::-1], p["tb"], p["ub"], True)
        d = np.exp(_outputs(p, f, b[::-1]))
        d[:, np.arange(len(y)), y] -= 1
        d /= d.shape[0] * d.shape[1]
        g = {"wf": np.einsum("tbh,tbl->hl", f, d), "wb": np.einsum("tbh,tbl->hl", b[::-1], d), "bias": d.sum((0, 1))}
        g["tf"], g["uf"] = _back(x, p["uf"], sf, d @ p["wf"].T, p["tf"])
        g["tb"], g["ub"] = _back(x[::-1], p["ub"], sb, (d @ p["wb"].T)[::-1], p["tb"])
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(langs, p)


def log_odds(model: Model, texts: list[bytes], steps: int = STEPS, at_once: int = 4096) -> np.ndarray:
    """For each text the sum of log probabilities over all its positions, and its number of positions, in the last column."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n = -(-sizes // steps)
    doc = np.repeat(np.arange(len(texts)), n)
    x = np.frombuffer(b"".join(t.ljust(k * steps, b"\0") for t, k in zip(texts, n.tolist())), np.uint8).reshape(-1, steps)
    rest = sizes[doc] - steps * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
    out = np.zeros((len(texts), len(model.langs) + 1))
    p = model.params
    for a in range(0, len(x), at_once):
        w = np.ascontiguousarray(x[a : a + at_once].T)
        f, _ = _run(w, p["tf"], p["uf"], False)
        b, _ = _run(w[::-1], p["tb"], p["ub"], False)
        y = _outputs(p, f, b[::-1])
        real = (np.arange(steps)[:, None] < rest[a : a + at_once]).astype(np.float32)  # the filling has no say
        np.add.at(out, doc[a : a + at_once], np.concatenate((np.einsum("tbl,tb->bl", y, real), real.sum(0)[:, None]), 1))
    return out


def _predict(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            texts = part.column("text").to_pylist()
            lettered = [t is not None and any(map(str.isalpha, t)) for t in texts]
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            at = [j for j, x in enumerate(lettered) if x]
            if model and at:
                sums = log_odds(model, [texts[j].encode() for j in at])
                mean = sums[:, :-1] / np.maximum(sums[:, -1:], 1)
                prob = np.exp(mean - mean.max(1, keepdims=True))
                prob /= prob.sum(1, keepdims=True)
                for j, k, s in zip(at, prob.argmax(1).tolist(), prob.max(1).tolist()):
                    lang[j], score[j] = model.langs[k], s
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def _windows(batches: Iterator[pa.RecordBatch], steps: int, seed: int) -> Iterator[pa.RecordBatch]:
    """``n`` windows of each text, at places that depend on the text alone; none of an empty one."""
    for batch in batches:
        out = []
        for t, n in zip(common.utf8(batch.column("text")), batch.column("n").to_pylist()):
            starts = np.random.default_rng([seed, zlib.crc32(t)]).integers(0, max(len(t) - steps, 0) + 1, n).tolist() if t else []
            out.append(b"".join(t[a : a + steps].ljust(steps, b"\0") for a in starts))
        yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("lang"), pa.array(out, pa.binary())], names=["place", "lang", "windows"])


def learn(labelled: DataFrame, per_lang: int = 150, most_rows: int = 3000, windows_per_text: int = 8, steps: int = STEPS, seed: int = 7) -> Model | None:
    """A model from labelled(doc_id, text, lang). Only windows of the sample named above come to the driver.

    A language's windows, ``windows_per_text`` times its sampled texts in all, are dealt to these texts by their lengths, one at least.
    """
    scratch = common.Scratch(labelled.sparkSession)
    counts = scratch.put("counts", labelled.groupBy("lang").count())
    n_langs = counts.count()
    share = min(per_lang, max(most_rows // max(n_langs, 1), 1))
    if n_langs <= BROADCAST_ROWS:  # else a shuffled join, in which a frequent language is a large group that Spark splits
        counts = F.broadcast(counts)
    place = F.abs(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "lang") % 1_000_000)
    rows = labelled.join(counts, "lang").withColumn("place", place).filter(F.col("place") * F.col("count") < F.lit(2 * share + 50) * 1_000_000)
    # the filter leaves each language some more rows than its share, so that the windows are small
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))).filter(F.col("nth") <= share)
    mine = Window.partitionBy("lang")  # as many rows as the sample has of it
    share_of_all = F.octet_length("text") * F.count("*").over(mine) * windows_per_text / F.greatest(F.sum(F.octet_length("text")).over(mine), F.lit(1))
    rows = rows.withColumn("n", F.greatest(F.round(share_of_all), F.lit(1)).cast("int"))
    drawn = rows.select("place", "lang", "text", "n").mapInArrow(lambda it: _windows(it, steps, seed), "place long, lang string, windows binary")
    rows = drawn.orderBy("place", "lang", "windows").collect()
    scratch.drop("counts")
    langs = sorted({r["lang"] for r in rows if r["windows"]})
    x = [np.frombuffer(r["windows"], np.uint8).reshape(-1, steps) for r in rows if r["windows"]]
    y = [np.full(len(r["windows"]) // steps, langs.index(r["lang"])) for r in rows if r["windows"]]
    return train(np.concatenate(x), np.concatenate(y), langs, seed=seed) if x else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for docs(doc_id, text, held_out)."""
    return docs.select(F.col("doc_id").cast("long"), "text", "held_out").mapInArrow(lambda it: _predict(it, model), "doc_id long, held_out boolean, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang", (common.crc_mod("doc_id", 5) == 0).alias("held_out"))
    model = learn(docs.filter("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang"))
    return identify(docs, model)
