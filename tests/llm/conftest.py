import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_rows(seed=5, n=60):
    """Prose of a few hundred words with exact and near copies, odd texts, nulls and repeated rows."""
    rng = random.Random(seed)
    vocab = {k: ["".join(rng.choice(s) for _ in range(rng.randint(1, 4))) for _ in range(300)] for k, s in {"en": ["the", "ing", "tion", "ou", "er"], "de": ["sch", "ung", "ä", "keit", "ver"], "fr": ["eau", "è", "ment", "que", "ou"]}.items()}
    rows = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        words = [rng.choice(vocab[lang]) for _ in range(rng.randint(25, 160))]
        rows.append((i, " ".join(words) + ".\nSecond line here.", lang, f"s{i % 4}" if i % 7 else None, 0))
    for i in range(12):  # near copies of the first documents: one word changed, now and then in a chain
        words = rows[i % 3][1].split(" ")
        words[5 + i] = f"new{i}"
        rows.append((100 + i, " ".join(words), "en", "s0", 0))
    rows += [(200 + i, rows[7][1], "en", "s1", 0) for i in range(15)]
    rows += [
        (300, None, None, None, None), (301, "", "en", "s0", 0), (302, " \n\t ", "en", "s0", 0), (303, "One", "en", "s0", 3), (304, "one", None, "s9", 3), (305, "Two words", "en", "s0", 9), (305, "Two words", "en", "s0", 9),
        (None, "A text without an id, here it is, with a few words more than five", "en", "s0", 9), (306, "it's  two   blanks\n\nand  lines\t tab 'll 12,3 <|endoftext|> é İstanbul", "en", "s2", 1),
        (307, "same same " * 60, "en", "s2", 1), (308, "x" * 20_000, "en", "s2", 1), (309, " ".join(f"w{i}" for i in range(9000)), "en", "s3", 1),
    ]
    return [(a, b, c, d, None if b is None else len(b)) for a, b, c, d, _ in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def wide(docs):
    """docs with more columns, whose names operators use inside."""
    from pyspark.sql import functions as F

    names = ("q_kept", "q_row", "row", "size", "taken", "sid", "root", "key", "words", "part", "d0", "t0", "count", "rank", "score")
    return docs.withColumns({n: F.lit(i) for i, n in enumerate(names)})
