import re
from collections import Counter

from tessella.llm import mixing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = {x for x, n in Counter(windows).items() if n > 1}
    covered = {j for i, x in enumerate(windows) if x in often for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_counts_and_base_rule(docs, rows):
    got = quality_rules.measure(docs).collect()
    have = sorted((str(r["doc_id"]), r["q_n_words"], r["q_word_chars"], r["q_n_symbols"], r["q_n_dup_lines"], r["q_n_repeat_words"], r["q_base_failed"]) for r in got)
    want = []
    for doc_id, text, *_ in rows:
        c = counts(text)
        want.append((str(doc_id), *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    assert have == sorted(want)


def test_good_documents_stay_with_their_columns(wide, empty, spark):
    kept = quality_rules.keep_good(wide)
    assert kept.columns == wide.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert len(ids & set(range(60))) >= 57 and not ids & {300, 301, 302, 303, 307}
    assert quality_rules.keep_good(empty).count() == 0


def test_sketches_merge(docs):
    m = quality_rules.measure(docs)
    one = sorted(map(tuple, quality_rules.sketches(m).collect()), key=str)
    a, b = (quality_rules.sketches(m.filter(f"coalesce(doc_id, 0) % 2 = {i}")) for i in (0, 1))
    both = a.unionByName(b).groupBy("lang", "source", "measure", "bin").sum("n")
    assert sorted(map(tuple, both.collect()), key=str) == one


def level(sizes, weights, total):
    """Targets by dealing the excess again and again."""
    full = {k: 2.0 * v for k, v in sizes.items()}
    capped = set()
    while True:
        free = [k for k in sizes if k not in capped]
        rest = total - sum(full[k] for k in capped)
        got = {k: rest * weights[k] / sum(weights[f] for f in free) for k in free}
        over = {k for k in free if got[k] > full[k] + 1e-9}
        if not over:
            return {**{k: full[k] for k in capped}, **got}
        capped |= over


def test_mix_meets_its_targets(docs, rows):
    got = mixing.mix(docs, shard_words=500).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert len(got) == len(rows) and Counter(r["size"] for r in got) == Counter(len(WORD.findall(t or "")) for _, t, *_ in rows)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = level(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 16 + 1
    again = mixing.mix(docs.repartition(5), shard_words=500).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_texts_have_the_taken_words(wide, docs, empty):
    m = Counter()
    for r in mixing.mix(docs).collect():
        m[r["doc_id"]] += r["taken"]
    out = mixing.apply_mix(wide)
    assert out.columns == wide.columns
    have = Counter()
    for r in out.collect():
        have[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert +have == +m
    assert mixing.apply_mix(empty).count() == 0
