from pathlib import Path
from types import SimpleNamespace

import pytest

from tessella.llm import common, token_store
from tessella.llm.tokens import tokenizer_path


def session(master, folder=None):
    kept = {} if folder is None else {"spark.checkpoint.dir": folder}
    conf = SimpleNamespace(get=lambda k, d=None: kept.get(k, d), set=kept.__setitem__)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k, d=None: d)))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,3000]", "k8s://x"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session(master))
    assert common.shared_dir(session(master, "s3://bucket/x/")).startswith("s3://bucket/x/tessella/")


def test_local_mode_makes_one():
    for master in ("local", "local[*]", "local[4]"):
        s = session(master)
        first, second = common.shared_dir(s), common.shared_dir(s)
        assert first.startswith("file:///") and first != second and first.rpartition("/")[0] == second.rpartition("/")[0]


def test_scratch_tables_go_when_dropped(spark):
    scratch = common.Scratch(spark)
    a, b = scratch.put("a", spark.range(5).toDF("x")), scratch.put("b", spark.range(3).toDF("x"))
    folder = Path(scratch.path.removeprefix("file:").replace("//", "/"))
    assert a.count() == 5 and len(list(folder.iterdir())) == 2
    scratch.drop("a")
    assert len(list(folder.iterdir())) == 1 and b.count() == 3


def test_token_shards_of_a_table_with_clashing_columns(spark, wide, docs):
    got = []
    for d in (wide.withColumnRenamed("rank", "shard").withColumnRenamed("count", "part2"), docs):
        path = common.shared_dir(spark) + "/t"
        token_store.write_tokens(d, path, tokenizer_path("byte_bpe_50k.json"), shard_tokens=2000)
        got.append(sorted(map(str, token_store.read_tokens(spark, path).collect())))
    assert got[0] == got[1]
