"""The models' scores against plain loops, and that held-out labels teach nothing."""

import math
import shutil
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessella.llm import languages, quality_mil, registry, toxicity

rng = np.random.default_rng(8)


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def plain_gru(text, table, u):
    """States at every position of one window, one number after the other."""
    n = u.shape[0]
    h, out = [0.0] * n, []
    for byte in text:
        e = table[byte]
        z = [sigmoid(e[j] + sum(h[i] * u[i, j] for i in range(n))) for j in range(n)]
        r = [sigmoid(e[n + j] + sum(h[i] * u[i, n + j] for i in range(n))) for j in range(n)]
        c = [math.tanh(e[2 * n + j] + sum(r[i] * h[i] * u[i, 2 * n + j] for i in range(n))) for j in range(n)]
        h = [h[j] + z[j] * (c[j] - h[j]) for j in range(n)]
        out.append(h)
    return out


def test_every_position_is_labelled_as_by_a_plain_network():
    n, langs, steps = 3, ["a", "b"], 5
    g = lambda *s: rng.standard_normal(s).astype(np.float32)
    p = {"tf": g(256, 3 * n), "uf": g(n, 3 * n), "tb": g(256, 3 * n), "ub": g(n, 3 * n), "wf": g(n, 2), "wb": g(n, 2), "bias": g(2)}
    texts = [b"", b"x", b"hello", b"with \0 inside it", bytes(range(23))]
    got = languages.log_odds(languages.Model(langs, p), texts, steps)
    for t, row in zip(texts, got):
        want = np.zeros(2)
        for a in range(0, len(t), steps):
            w = t[a : a + steps].ljust(steps, b"\0")
            f, b = plain_gru(w, p["tf"], p["uf"]), plain_gru(w[::-1], p["tb"], p["ub"])[::-1]
            for k in range(len(t[a : a + steps])):
                y = [sum(f[k][i] * p["wf"][i, j] + b[k][i] * p["wb"][i, j] for i in range(n)) + p["bias"][j] for j in range(2)]
                want += np.array(y) - math.log(sum(map(math.exp, y)))
        assert np.allclose(row[:2], want, atol=1e-3) and row[2] == len(t)


def test_output_layer_gradient_lowers_the_loss_to_the_plain_minimum():
    windows = np.concatenate([rng.integers(97, 110, (60, 16)), rng.integers(105, 120, (60, 16))]).astype(np.uint8)
    labels = np.repeat([0, 1], 60)
    loss = lambda rounds: -sum(languages.log_odds(languages.train(windows, labels, ["a", "b"], 4, rounds, 40, 0.02), [w.tobytes()], 16)[0, y] for w, y in zip(windows, labels)) / windows.size
    assert loss(60) < 0.6 * loss(1)


@pytest.mark.parametrize("text,und", [("²½①", True), ("12 !?", True), ("", True), (None, True), ("é", False), ("ª", False), ("3 日", False)])
def test_texts_without_letters_have_no_language(text, und):
    model = languages.Model(["xx"], languages.train(np.zeros((4, 8), np.uint8), np.zeros(4, int), ["xx"], 2, 2).params)
    batch = pa.record_batch([pa.array([1]), pa.array([text], pa.string()), pa.array([True])], names=["doc_id", "text", "held_out"])
    (got,) = languages._predict([batch], model)
    assert got.column("lang_pred").to_pylist() == ["und" if und else "xx"] and 0 <= got.column("score")[0].as_py() <= 1


def test_attention_scores_equal_plain_loops():
    dim, code, gate = quality_mil.DIM, 4, 3
    g = lambda *s: rng.standard_normal(s).astype(np.float32)
    p = {"we": g(dim, code), "be": g(code), "v": g(code, gate), "u": g(code, gate), "w": g(gate), "o": g(code), "c": np.float32(0.3)}
    model = quality_mil.Model(p, np.zeros(dim), np.ones(dim), 0.5)
    texts = [b"", b"Some text.", b"Long one " * 200, b"\xc3\xa9!" * 90]
    for t, y in zip(texts, quality_mil.scores(model, texts)):
        bag, _ = quality_mil.passages([t])
        codes = [[math.tanh(sum(x[i] * p["we"][i, j] for i in range(dim)) + p["be"][j]) for j in range(code)] for x in bag]
        raw = [sum(math.tanh(sum(h[i] * p["v"][i, k] for i in range(code))) * sigmoid(sum(h[i] * p["u"][i, k] for i in range(code))) * p["w"][k] for k in range(gate)) for h in codes]
        weights = [math.exp(a) / sum(map(math.exp, raw)) for a in raw]
        z = [sum(a * h[j] for a, h in zip(weights, codes)) for j in range(code)]
        assert abs(y - sigmoid(sum(z[j] * p["o"][j] for j in range(code)) + p["c"])) < 1e-4


def test_attention_gradients_equal_differences(monkeypatch):
    """One Adam step of one parameter has the sign of the loss's plain difference quotient."""
    bags = [rng.standard_normal((k, quality_mil.DIM)).astype(np.float32) for k in (1, 3, 2, 4)]
    y, w = np.array([0, 1, 1, 0], np.float32), np.ones(4)
    before = quality_mil.train(bags, y, w, 3, 2, rounds=0)
    after = quality_mil.train(bags, y, w, 3, 2, rounds=1, batch=4000, rate=1e-3, decay=0.0)
    every = np.concatenate([(b - before.mean) / before.scale for b in bags]).astype(np.float64)
    begins = np.cumsum([0, *map(len, bags)])

    def loss(p):
        out = quality_mil._forward(p, every, begins)["y"]
        return -np.mean(y * np.log(out) + (1 - y) * np.log(1 - out))

    for name, value in before.params.items():
        p = {k: v.astype(np.float64) for k, v in before.params.items()}
        for at in np.ndindex(value.shape):
            slope = 0.0
            for sign in (1, -1):
                q = {k: v.copy() for k, v in p.items()}
                q[name][at] += sign * 1e-4
                slope += sign * loss(q) / 2e-4
            if abs(slope) > 5e-3:  # the batch is drawn, so small slopes may differ in sign
                assert np.sign(after.params[name][at] - value[at]) == -np.sign(slope), (name, at)


def test_trees_are_walked_as_by_plain_loops_and_lower_the_loss():
    x = rng.standard_normal((300, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    trees = toxicity.grow(x, y, np.ones(300))
    got = toxicity.margin(trees, x)
    for row, f in zip(x[:50], got):
        total = 0.0
        for feat, cut, value in trees:
            node = 0
            while feat[node] >= 0:
                node = 2 * node + 1 + int(row[feat[node]] > cut[node])
            total += value[node]
        assert abs(total - f) < 1e-9
    assert np.mean((got > 0) == (y > 0)) > 0.95


def test_isotonic_equals_the_best_monotone_fit():
    for _ in range(20):
        n = int(rng.integers(2, 9))
        f, y, w = np.sort(rng.standard_normal(n)), rng.integers(0, 2, n).astype(float), rng.integers(1, 4, n).astype(float)
        # min over upper sets of max over lower sets of weighted means: the classical form of the solution
        want = [max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        knots, values = toxicity.isotonic(f, y, w)
        assert np.allclose(np.interp(f, knots, values), want)


@pytest.fixture(scope="module")
def relabelled(sf_dir, tmp_path_factory):
    """The tables with every held-out language and label turned round, by the modulus of its query."""

    def make(mod, rest):
        d = tmp_path_factory.mktemp("tables")
        held = lambda t: [zlib.crc32(str(i).encode()) % mod == rest for i in t["doc_id"].to_pylist()]
        for name, columns in (("documents", {"lang": lambda v: "zz", "source": lambda v: "other"}), ("labels", {"quality": lambda v: 1 - v, "toxic": lambda v: 1 - v})):
            t = pq.read_table(f"{sf_dir}/{name}.parquet")
            mask = held(t)
            for c, turn in columns.items():
                i = t.schema.get_field_index(c)
                t = t.set_column(i, t.schema.field(i), pa.array([turn(v) if m and v is not None else v for v, m in zip(t[c].to_pylist(), mask)], t.schema.field(i).type))
            pq.write_table(t, d / f"{name}.parquet")
        return str(d)

    return make


@pytest.mark.parametrize("name,mod,rest", [("op4_language_id", 5, 0), ("op8_quality_attention", 4, 2), ("op9_toxicity", 5, 0)])
def test_held_out_labels_have_no_influence(spark, sf_dir, relabelled, name, mod, rest):
    d = relabelled(mod, rest)
    run = lambda at: sorted(map(tuple, registry.QUERIES[name](spark, at).collect()))
    assert run(sf_dir) == run(d)
    shutil.rmtree(d)


@pytest.mark.parametrize("name", ["op4_language_id", "op8_quality_attention", "op9_toxicity"])
def test_clashing_columns_repeated_rows_and_long_texts(spark, sf_dir, tmp_path, name):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    more = docs.limit(3).withColumns({"doc_id": F.col("doc_id") + 1_000_000, "text": F.repeat("text", 300)})
    docs = docs.unionByName(docs.limit(20)).unionByName(more).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))
    docs.withColumns({c: F.lit(1) for c in ("held_out", "score", "label", "weight", "n", "upto", "place", "count", "nth", "row", "__toxicity")}).write.parquet(f"{tmp_path}/documents.parquet")
    labels.unionByName(labels.limit(9)).withColumns({c: F.lit(1) for c in ("text", "label", "score")}).write.parquet(f"{tmp_path}/labels.parquet")
    got = registry.QUERIES[name](spark, str(tmp_path))
    assert got.columns[:2] == ["doc_id", "held_out"]
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    by_id = {}
    for r in rows:
        assert by_id.setdefault(r["doc_id"], tuple(r)) == tuple(r)
