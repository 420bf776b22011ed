"""Quotation linking against a plain version, on generated conversations with nested quotes."""

import random
import re

from pyspark.sql import functions as F

from tessella.llm import quotations

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3)))
    rows = []
    for c in range(n):
        said = []  # (turn, passage)
        texts = []
        for turn in range(rng.randint(1, 9)):
            lines = []
            if said and rng.random() < 0.7:
                source = rng.choice(texts) if rng.random() < 0.4 else rng.choice(said)[1]
                body = source.split("\n")
                if rng.random() < 0.4:
                    body = re.split(r"(?<=[.!?]) ", source)[:1]
                if rng.random() < 0.3:
                    lines.append("On Friday x wrote:")
                lines += [("> " if not b.startswith(">") else ">") + b for b in body]
            own = ". ".join(" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3))) + rng.choice(".!?")
            if rng.random() < 0.3:
                own += "\n- " + word() + "\n- " + word()
            lines.append(own)
            said.append((turn, own))
            texts.append("\n".join(lines))
            rows.append((c, turn, rng.choice("ab"), texts[-1]))
    return rows


def plain(rows):
    """conv_id, turn -> (thread, reply_to, n_linked), message by message."""
    out = {}
    for c in {r[0] for r in rows}:
        heard = {}  # words of a piece -> latest turn that said it
        for _, turn, _, text in sorted(r for r in rows if r[0] == c):
            _, own, quoted = quotations.parse(text)
            best = {}
            for level, passage in quoted:
                for h, n, sentences in quotations.pieces(passage):
                    if h in heard:
                        for s in sentences:
                            best[level, s] = max(best.get((level, s), (0, -1)), (n, heard[h]))
            votes = {}
            for (level, _), (_, source) in best.items():
                votes[level, source] = votes.get((level, source), 0) + 1
            parent = max(votes, key=lambda k: (-k[0], votes[k], k[1]), default=(None, None))[1]
            out[c, turn] = (turn if parent is None else out[c, parent][0], parent, sum(votes.values()))
            heard.update((h, turn) for p in own for h, _, _ in quotations.pieces(p))
    return out


def test_links_equal_a_plain_reading(spark):
    rows = conversations(4, 60)
    got = {(r["conv_id"], r["turn"]): (r["thread"], r["reply_to"], r["n_linked"]) for r in quotations.link_quotations(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = plain(rows)
    assert got == want and sum(v[1] is not None for v in want.values()) > 60


def test_odd_rows(spark):
    long = "A word or two here. " * 30_000
    rows = [(1, 0, "a", long), (1, 1, "b", "> A word or two here.\nYes."), (2, 0, "a", "One here."), (2, 0, "a", "One here."), (2, 1, "b", "> One here.\nTwo."), (2, 1, "c", "> One here.\nThree."), (3, None, "a", "> One here."), (None, 1, "a", "x")]
    d = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("thread", "depth", "parent", "up", "hash", "level", "q", "n_quotes", "own", "quotes", "source")})
    got = [(r["conv_id"], r["turn"], r["role"], r["thread"], r["reply_to"]) for r in quotations.link_quotations(d).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, "a", 0, None), (1, 1, "b", 0, 0), (2, 0, "a", 0, None), (2, 0, "a", 0, None), (2, 1, "b", 0, 0), (2, 1, "c", 0, 0), (3, None, "a", None, None), (None, 1, "a", 1, None)], key=str)
