import json

from pyspark.sql import functions as F

from tessella.sources import artifacts


def drop(path, name, rows, array=False):
    path.mkdir(parents=True, exist_ok=True)
    rows = [{"url": u, "body": b, "fetched": f"2024-01-0{d}T00:00:00Z"} for u, b, d in rows]
    (path / name).write_text(json.dumps(rows, indent=1) if array else "".join(json.dumps(r) + "\n" for r in rows))


def test_a_run_reads_new_files_and_parses_changes_only(spark, tmp_path):
    parsed = []

    def parse(d):
        parsed.append(sorted(r["url"] for r in d.collect()))
        return d.select("url", F.upper("body").alias("text"))

    index = artifacts.ArticleIndex(spark, f"file://{tmp_path}/index", parse)
    assert index.current() is None
    drop(tmp_path / "in", "a.jsonl", [("u1", "one", 1), ("u2", "two", 1), ("u2", "two later", 2), (None, "x", 1)])
    drop(tmp_path / "in", "b.jsonl", [("u3", None, 1)])
    assert index.ingest(f"file://{tmp_path}/in") == 5 and parsed == [["u1", "u2", "u3"]]
    assert index.ingest(f"file://{tmp_path}/in") == 0 and len(parsed) == 1
    drop(tmp_path / "in" / "more", "c.jsonl", [("u1", "one", 3), ("u2", "two", 3), ("u4", "four", 3)])
    again = artifacts.ArticleIndex(spark, f"file://{tmp_path}/index", parse)  # another process
    assert again.ingest(f"file://{tmp_path}/in") == 3 and parsed[1:] == [["u2", "u4"]]
    got = {r["url"]: (r["text"], r["times_parsed"], r["last_seen"].day) for r in again.current().collect()}
    assert got == {"u1": ("ONE", 1, 3), "u2": ("TWO", 2, 3), "u3": (None, 1, 1), "u4": ("FOUR", 1, 3)}
    assert sorted((r["batch"], r["url"], r["change"]) for r in again.changes().collect()) == [(0, "u1", "new"), (0, "u2", "new"), (0, "u3", "new"), (1, "u1", "same"), (1, "u2", "changed"), (1, "u4", "new")]


def test_a_batch_that_failed_is_done_again(spark, tmp_path):
    broken = artifacts.ArticleIndex(spark, f"file://{tmp_path}/index", lambda d: 1 / 0)
    drop(tmp_path / "in", "a.jsonl", [("u1", "one", 1)])
    try:
        broken.ingest(f"file://{tmp_path}/in")
        raise AssertionError("it should have failed")
    except AssertionError:
        raise
    except Exception:
        pass
    index = artifacts.ArticleIndex(spark, f"file://{tmp_path}/index", lambda d: d.select("url", F.col("body").alias("text")))
    index.ingest(f"file://{tmp_path}/in")
    assert [(r["url"], r["text"], r["times_parsed"]) for r in index.current().collect()] == [("u1", "one", 1)]


def test_json_of_both_kinds(spark, tmp_path):
    drop(tmp_path, "a.jsonl", [("u1", "one", 1), ("u2", "two\nlines", 2)])
    drop(tmp_path, "b.json", [("u1", "one", 1), ("u2", "two\nlines", 2)], array=True)
    a, b = (artifacts.read_json(spark, f"{tmp_path}/{n}", artifacts.ArticleIndex.SCHEMA).orderBy("url").collect() for n in ("a.jsonl", "b.json"))
    assert a == b and [r["body"] for r in a] == ["one", "two\nlines"]
