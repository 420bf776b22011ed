"""Quota admission in batch and as a stream: per subject and minute, per subject and day, one open request at a time, and for all together a day.

Requests count in the order of their times and numbers. A refused request leaves no trace, so what is admitted depends on that order;
the stream therefore holds rows until the watermark has passed them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

DAY, MINUTE = 86_400, 60
OUT = StructType([StructField("user_id", LongType()), StructField("event_id", LongType()), StructField("ts", TimestampType()), StructField("admitted", BooleanType()), StructField("reason", StringType())])


@dataclass(frozen=True)
class Limits:
    """Admissions a subject has a minute and a UTC day, seconds after which an open request no longer counts (None: requests are not open
    for any time), and admissions of all subjects a day (None: any number)."""

    per_minute: int = 2
    per_day: int = 20
    open_seconds: float | None = None
    all_per_day: int | None = None

    def __post_init__(self):
        if any(x is not None and x <= 0 for x in (self.per_minute, self.per_day, self.open_seconds, self.all_per_day)):
            raise ValueError("limits must be positive")


@dataclass
class Subject:
    """What a subject's admissions leave: the times of the last minute, the day's number, and the open request."""

    recent: list[float] = field(default_factory=list)
    day: int = -1
    in_day: int = 0
    open_id: int | None = None
    open_at: float = 0.0

    def refusal(self, at: float, limits: Limits) -> str | None:
        """Why a request at a time is refused, but for the limit of all together."""
        if self.open_id is not None and limits.open_seconds is not None and self.open_at < at - limits.open_seconds:
            self.open_id = None
        self.recent = [x for x in self.recent if x >= at - MINUTE]
        if int(at // DAY) != self.day:
            self.day, self.in_day = int(at // DAY), 0
        if limits.open_seconds is not None and self.open_id is not None:
            return "request_in_progress"
        if len(self.recent) >= limits.per_minute:
            return "user_minute_limit"
        return "user_daily_limit" if self.in_day >= limits.per_day else None

    def take(self, at: float, request: int) -> None:
        self.recent.append(at)
        self.in_day += 1
        self.open_id, self.open_at = request, at

    def release(self, request: int) -> None:
        if self.open_id == request:
            self.open_id = None


def _pass(requests: DataFrame, limits: Limits) -> DataFrame:
    """requests(user_id, event_id, ts, at, releases, cut_at, cut_id) with reason; `all_daily_limit` from the day's cut on.

    Each task reads its subjects' requests in order and keeps one subject's state at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state = None, Subject()
        for rows in batches:
            out = []
            for u, i, at, releases, cut_at, cut_id in zip(*(rows[c].tolist() for c in ("user_id", "event_id", "at", "releases", "cut_at", "cut_id"))):
                if u != user:
                    user, state = u, Subject()
                if releases == releases:  # not NaN: a release, which is no request
                    state.release(int(releases))
                    out.append("release")
                    continue
                why = state.refusal(at, limits)
                if why is None and (at, i) > (cut_at, cut_id):
                    why = "all_daily_limit"
                if why is None:
                    state.take(at, i)
                out.append(why)
            yield rows.assign(reason=out)[["user_id", "event_id", "ts", "at", "reason"]]

    d = requests.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id")
    return d.mapInPandas(run, "user_id long, event_id long, ts timestamp, at double, reason string")


def admit(requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """requests(user_id, event_id, ts and, if given, releases) of a finished table: user_id, event_id, ts, admitted, reason.

    A row with a number in ``releases`` is no request but ends the open request of that number. With a limit for all together, each day has
    a cut, the admission that reaches it. Cuts are found by passes: a pass finds the first day's cut whatever follows, and each later
    day's once those before are right; it ends when no cut changes, after two or three passes as a rule.
    """
    d = requests.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("releases") if "releases" in requests.columns else F.lit(None)).cast("double").alias("releases"))
    d = d.withColumn("at", F.unix_micros("ts") / 1e6).withColumn("day", F.floor(F.col("at") / DAY))
    end = (F.lit(float("inf")).alias("cut_at"), F.lit(0).cast("long").alias("cut_id"))
    if limits.all_per_day is None:
        done = _pass(d.select("*", *end), limits)
    else:
        cuts: dict[int, tuple[float, int]] = {}
        while True:
            table = requests.sparkSession.createDataFrame([(k, *v) for k, v in cuts.items()], "day long, cut_at double, cut_id long")  # a row a day
            done = _pass(d.join(F.broadcast(table), "day", "left").fillna({"cut_at": float("inf"), "cut_id": 0}), limits)
            would = done.filter("reason IS NULL OR reason = 'all_daily_limit'").withColumn("day", F.floor(F.col("at") / DAY))
            place = F.row_number().over(Window.partitionBy("day").orderBy("at", "event_id"))
            # tasks cut to the limit before a day's rows meet
            last = would.withColumn("place", place).filter(F.col("place") <= limits.all_per_day).filter(F.col("place") == limits.all_per_day)
            now = {r["day"]: (r["at"], r["event_id"]) for r in last.select("day", "at", "event_id").collect()}
            if now == cuts:
                break
            cuts = now
    return done.filter("reason IS NULL OR reason <> 'release'").select("user_id", "event_id", "ts", F.col("reason").isNull().alias("admitted"), "reason")


class Admission(StatefulProcessor):
    """The same over a stream, for a shard of the subjects: rows wait for the watermark and then count in order."""

    def __init__(self, limits: Limits, shards: int):
        self.limits, self.shards = limits, shards

    def init(self, handle: StatefulProcessorHandle) -> None:
        row = StructType([StructField("user_id", LongType()), StructField("event_id", LongType()), StructField("at", DoubleType()), StructField("releases", DoubleType())])
        subject = StructType([StructField("recent", ArrayType(DoubleType())), StructField("day", LongType()), StructField("in_day", LongType()), StructField("open_id", LongType()), StructField("open_at", DoubleType())])
        self.handle = handle
        self.waiting = handle.getListState("waiting", row)
        self.subjects = handle.getMapState("subjects", StructType([StructField("user_id", LongType())]), subject)
        self.lease = handle.getValueState("lease", StructType([StructField("day", LongType()), StructField("used", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            for u, i, at, releases in zip(batch["user_id"].tolist(), batch["event_id"].tolist(), batch["at"].tolist(), batch["releases"].tolist()):
                self.waiting.appendValue((u, i, at, None if releases != releases else releases))
                first = at if first is None else min(first, at)
        if first is not None:
            self.handle.registerTimer(max(int(first * 1000) + 1, timerValues.getCurrentWatermarkInMs() + 1))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() / 1000
        held = [tuple(r) for r in self.waiting.get()]
        due, later = sorted((r for r in held if r[2] <= mark), key=lambda r: (r[2], r[1])), [r for r in held if r[2] > mark]
        if not due:
            return iter([])
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(int(min(r[2] for r in later) * 1000) + 1)
        else:
            self.waiting.clear()
        day, used = self.lease.get() or (-1, 0)
        mine = self._share(key[0])
        states: dict[int, Subject] = {}
        out = []
        for u, i, at, releases in due:
            state = states.get(u)
            if state is None:
                kept = self.subjects.getValue((u,)) if self.subjects.containsKey((u,)) else None
                state = states[u] = Subject(list(kept[0]), *kept[1:]) if kept else Subject()
            if releases is not None:
                state.release(int(releases))
                continue
            if int(at // DAY) != day:
                day, used = int(at // DAY), 0
            why = state.refusal(at, self.limits)
            if why is None and mine is not None and used >= mine:
                why = "all_daily_limit"
            if why is None:
                state.take(at, i)
                used += 1
            out.append((u, i, pd.Timestamp(round(at * 1e6), unit="us", tz="UTC"), why is None, why))
        for u, s in states.items():
            self.subjects.updateValue((u,), (s.recent, s.day, s.in_day, s.open_id, s.open_at))
        if day >= 0:
            if (self.lease.get() or (-1, 0))[0] != day:  # a new day: subjects without an admission since the one before are forgotten
                for (u,) in [k for k, v in self.subjects.iterator() if v[1] < day - 1 and v[3] is None]:
                    self.subjects.removeKey((u,))
            self.lease.update((day, used))
        if not out:
            return iter([])
        return iter([pd.DataFrame(out, columns=[f.name for f in OUT])])

    def _share(self, shard: int) -> int | None:
        if self.limits.all_per_day is None:
            return None
        return self.limits.all_per_day // self.shards + (shard < self.limits.all_per_day % self.shards)

    def close(self) -> None:
        pass


def admit_stream(requests: DataFrame, limits: Limits = Limits(), shards: int = 1, late: str = "10 minutes") -> DataFrame:
    """The rows of `admit` for a stream of requests(user_id, event_id, ts and, if given, releases), given out once the watermark has passed them.

    Subjects are dealt into ``shards``, each with a part of the day's admissions of all together: these are never exceeded, but a
    shard can have used its part up before others; with one shard, or without that limit, rows are those of the finished table. Rows later than
    ``late`` are not admitted and not given out. Needs the RocksDB state store, which is set here.
    """
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    releases = F.col("releases") if "releases" in requests.columns else F.lit(None)
    d = requests.withWatermark("ts", late).select(F.pmod(F.xxhash64("user_id"), F.lit(shards)).alias("shard"), "user_id", "event_id", "ts", (F.unix_micros("ts") / 1e6).alias("at"), releases.cast("double").alias("releases"))
    return d.groupBy("shard").transformWithStateInPandas(Admission(limits, shards), OUT, "Append", "EventTime")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by event time window and type, for a stream or a table; late rows beyond the watermark are left out of a stream."""
    d = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        d = d.withWatermark("ts", late)
    return d.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
