import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import relational, release
from tessella.sources import files, sinks
from tessella.streaming import quotas


def test_csv_drops_byte_order_mark_and_checks_columns(spark, tmp_path):
    p = tmp_path / "food.csv"
    p.write_bytes("﻿id,name,extra\n1,Milk,x\n2, ,y\n".encode())
    rows = files.read_csv(spark, str(p), ["id", "name"]).collect()
    assert [(r["id"], r["name"]) for r in rows] == [("1", "Milk"), ("2", None)]
    with pytest.raises(ValueError, match="amount"):
        files.read_csv(spark, str(p), ["id", "amount"])


def test_caret_text(spark, tmp_path):
    p = tmp_path / "des.txt"
    p.write_bytes("~1001~^~Crème~\n~2~^~x~\n".encode("latin-1"))
    assert [tuple(r) for r in files.read_caret_text(spark, str(p), ["code", "name"], "code").orderBy("code").collect()] == [("00002", "x"), ("01001", "Crème")]


def test_numbers(spark):
    d = spark.createDataFrame([("1.5",), (" ",), ("abc",), ("NaN",), (None,)], "x string").select(files.number(F.col("x")), files.bad_number(F.col("x")))
    assert [tuple(r) for r in d.collect()] == [(1.5, False), (None, False), (None, True), (None, True), (None, False)]


def test_publish_is_whole_or_nothing(spark, tmp_path):
    d = spark.range(10).withColumn("v", F.col("id") * 2)
    out = str(tmp_path / "release")
    sinks.publish(spark, {"t": d, "empty": d.limit(0)}, {"t": ["id"]}, out)
    assert spark.read.parquet(f"{out}/t.parquet").count() == 10 and spark.read.parquet(f"{out}/empty.parquet").columns == ["id", "v"]
    with pytest.raises(FileExistsError):
        sinks.publish(spark, {"t": d}, {}, out)
    with pytest.raises(Exception):
        sinks.publish(spark, {"t": d.withColumn("x", F.raise_error(F.lit("no")))}, {}, out, overwrite=True)
    assert spark.read.parquet(f"{out}/t.parquet").count() == 10
    assert sorted(p.name for p in tmp_path.iterdir()) == ["release"]
    assert sinks.content_hash(d) == sinks.content_hash(d.orderBy(F.col("id").desc()).repartition(3))


def test_manifest_and_tree_hash(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1")
    (tmp_path / "b.csv").write_text("2")
    m = files.manifest(spark, str(tmp_path), "*.csv")
    assert {r["name"]: r["bytes"] for r in m.collect()} == {"a.csv": 1, "b.csv": 1}
    h = files.tree_hash(m)
    (tmp_path / "b.csv").write_text("3")
    assert files.tree_hash(files.manifest(spark, str(tmp_path), "*.csv")) != h


def test_upserts(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, ver int")
    n = spark.createDataFrame([(1, "A", 1), (2, "B", 4), (3, "C", 1)], "k int, v string, ver int")
    assert sorted(tuple(r) for r in sinks.upsert(t, n, ["k"], "ver").collect()) == [(1, "A", 1), (2, "b", 5), (3, "C", 1)]
    assert sorted(tuple(r) for r in sinks.insert_new(t, n, ["k"]).collect()) == [(1, "a", 1), (2, "b", 5), (3, "C", 1)]


def test_release_statuses(spark):
    food = spark.createDataFrame([("1", "Milk, raw", "10"), ("2", "Yogurt, NFS", "10"), ("3", "Milk, human", None)], "fdc_id string, description string, category_id string")
    cat = spark.createDataFrame([("10", "Dairy")], "category_id string, name string")
    seen = spark.createDataFrame([("1", "208"), ("1", "203"), ("2", "208")], "fdc_id string, nutrient_code string")
    got = {r["fdc_id"]: r for r in release.foods(food, cat, seen, ["203", "208"], "r1").collect()}
    assert {k: (r["quality_status"], r["is_searchable"], r["search_priority"]) for k, r in got.items()} == {"1": ("complete", True, 115), "2": ("ambiguous", True, 80), "3": ("excluded", False, 0)}
    import uuid

    assert got["1"]["food_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "food|r1|1"))
    with pytest.raises(ValueError, match="not unique"):
        relational.require_unique(food.unionByName(food), "fdc_id", "food")
    with pytest.raises(ValueError, match="no category_id"):
        relational.require_parents(food.filter("category_id is not null"), "category_id", cat.limit(0), "category_id", "food")


def test_amounts_and_portions(spark):
    rows = spark.createDataFrame([("1", "2.5"), ("2", ""), ("3", "-1"), ("4", "x")], "id string, amount string")
    ok, bad = release.audit_amounts(rows, "amount")
    assert [r["amount"] for r in ok.collect()] == [2.5] and {r["id"]: r["reject_reason"] for r in bad.collect()} == {"2": "blank", "3": "negative", "4": "not_a_number"}
    with pytest.raises(ValueError):
        release.audit_amounts(rows, "amount", "fail")
    p = spark.createDataFrame([("1", "9", "244", "1", None, None), ("2", "9", "0", "1", "cup", None)], "id string, measure_unit_id string, gram_weight string, amount string, portion_description string, modifier string")
    ok, bad = release.portions(p, spark.createDataFrame([("9", "cup")], "id string, name string"))
    assert [r["portion_description"] for r in ok.collect()] == ["1 cup"] and bad.count() == 1


def reference_fold(rows, limits):
    """One request after the other, all admissions kept in one list."""
    taken, opened, out = [], {}, {}
    for user, event, ts, releases in sorted(rows, key=lambda r: (r[2], r[1])):
        if releases is not None:
            if opened.get(user, (None,))[0] == releases:
                del opened[user]
            continue
        if user in opened and limits.open_seconds is not None and opened[user][1] < ts - dt.timedelta(seconds=limits.open_seconds):
            del opened[user]
        own = [t for u, t in taken if u == user]
        if limits.open_seconds is not None and user in opened:
            why = "request_in_progress"
        elif sum(t >= ts - dt.timedelta(minutes=1) for t in own) >= limits.per_minute:
            why = "user_minute_limit"
        elif sum(t.date() == ts.date() for t in own) >= limits.per_day:
            why = "user_daily_limit"
        elif limits.all_per_day is not None and sum(t.date() == ts.date() for _, t in taken) >= limits.all_per_day:
            why = "all_daily_limit"
        else:
            why = None
            taken.append((user, ts))
            opened[user] = (event, ts)
        out[event] = why
    return out


START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
REQUESTS = "user_id long, event_id long, ts timestamp, releases long"
LIMITS = [quotas.Limits(2, 4), quotas.Limits(3, 5, 40.0), quotas.Limits(2, 6, None, 9), quotas.Limits(2, 6, 300.0, 7)]


def requests(seed=1, n=260):
    """Two users with fixed times, then bursts of several around midnights; some rows end the request before them."""
    rows = [(u, 100 * u + i, START + dt.timedelta(seconds=s), None) for u in (1, 2) for i, s in enumerate((0, 10, 20, 59, 60, 61, 75, 4000, 86390, 86400, 86405))]
    rng = random.Random(seed)
    for i in range(n):
        day, at = rng.randrange(3), rng.choice([rng.uniform(0, 200), rng.uniform(86_200, 86_399), rng.uniform(0, 86_400)])
        rows.append((rng.randrange(1, 9), 1000 + i, START + dt.timedelta(days=day, milliseconds=int(at * 1000)), 1000 + rng.randrange(i) if i and rng.random() < 0.2 else None))
    return rows


@pytest.mark.parametrize("limits", LIMITS)
def test_quota_batch_equals_loop(spark, limits):
    rows = requests()
    got = quotas.admit(spark.createDataFrame(rows, REQUESTS).repartition(5), limits).collect()
    assert {r["event_id"]: r["reason"] for r in got} == reference_fold(rows, limits)
    assert all(r["admitted"] == (r["reason"] is None) for r in got)


def test_quota_limits_must_be_positive_and_tables_may_be_empty(spark):
    with pytest.raises(ValueError):
        quotas.Limits(0, 1)
    assert quotas.admit(spark.createDataFrame([], REQUESTS), quotas.Limits(1, 1, 1.0, 1)).count() == 0


@pytest.mark.parametrize("limits", LIMITS[1::2])
def test_quota_stream_equals_loop_whatever_the_order(spark, tmp_path, limits):
    """Shuffled rows in many small batches; a last row far ahead lets the watermark pass all others."""
    rows = requests()
    mixed = rows[:]
    random.Random(3).shuffle(mixed)
    src = str(tmp_path / "in")
    for i, part in enumerate([mixed[:90], mixed[90:100], mixed[100:], [(99, 1, START + dt.timedelta(days=30), None)], [(99, 2, START + dt.timedelta(days=60), None)]]):
        spark.createDataFrame(part, REQUESTS).coalesce(1).write.mode("append").parquet(f"{src}/{i}")
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(src)
    q = quotas.admit_stream(stream, limits, late="4 days").writeStream.format("memory").queryName(f"admitted{limits.per_minute}").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["event_id"]: r["reason"] for r in spark.table(f"admitted{limits.per_minute}").collect()}
    assert {k: v for k, v in got.items() if k > 50} == reference_fold(rows, limits)


def test_quota_shards_never_exceed_the_day(spark, tmp_path):
    rows, limits = requests(), quotas.Limits(5, 50, None, 7)
    src = str(tmp_path / "in")
    spark.createDataFrame([*rows, (99, 1, START + dt.timedelta(days=30), None)], REQUESTS).coalesce(1).write.parquet(src)
    q = quotas.admit_stream(spark.readStream.schema(REQUESTS).parquet(src), limits, shards=3).writeStream.format("memory").queryName("sharded").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    days = {}
    for r in spark.table("sharded").filter("admitted AND event_id > 50").collect():
        days[r["ts"].date()] = days.get(r["ts"].date(), 0) + 1
    assert days and max(days.values()) <= 7
