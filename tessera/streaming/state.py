"""Keyed state and joins of streams: sessions with a verdict per user, and what follows an event within some time.

Both keep no more than the watermark lets be open: sessions leave the state when a timer finds that no event can join them
any more, and join sides are evicted by the time bound. A query takes up its state from its checkpoint after a restart.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OPEN = "started bigint, last bigint, n bigint, errors bigint"
CLOSED = "user_id bigint, started bigint, last bigint, n bigint, errors bigint"
STORE = "spark.sql.streaming.stateStore.providerClass"


def micros(ts: str) -> Column:
    """Microseconds of a timestamp since 1970, of one without a time zone as it stands."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def moment(us: str | Column) -> Column:
    """The timestamp, without a time zone, of microseconds since 1970."""
    return F.timestamp_add("MICROSECOND", F.col(us) if isinstance(us, str) else us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def instant(ts: str) -> Column:
    """The same microseconds as a timestamp that can bear a watermark, whatever the session's time zone."""
    return F.timestamp_micros(micros(ts))


def merged(sessions: list[tuple[int, int, int, int]], gap: int) -> list[tuple[int, int, int, int]]:
    """Sessions (started, last, n, errors) with those made one that lie no further apart than the gap."""
    out: list[tuple[int, int, int, int]] = []
    for s in sorted(sessions):
        if out and s[0] - out[-1][1] <= gap:
            a = out.pop()
            s = (a[0], max(a[1], s[1]), a[2] + s[2], a[3] + s[3])
        out.append(s)
    return out


class Sessions(StatefulProcessor):
    """Holds a user's open sessions. An event may extend one, begin one, or join two that it lies between, whatever the order
    of arrival. A timer stands at the moment at which the earliest of them can grow no more."""

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", OPEN)

    def closes(self, session: tuple) -> int:
        """The first whole millisecond past the last event that could join a session."""
        return (session[1] + self.gap) // 1000 + 1

    def keep(self, sessions: list[tuple]) -> None:
        if sessions:
            self.open.put(sessions)
            self.handle.registerTimer(min(map(self.closes, sessions)))
        else:
            self.open.clear()

    def held(self) -> list[tuple]:
        return [tuple(s) for s in self.open.get()] if self.open.exists() else []

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.keep(merged(self.held() + [(r.at, r.at, 1, int(r.failed)) for r in rows], self.gap))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now, sessions = timerValues.getCurrentWatermarkInMs(), self.held()
        self.keep([s for s in sessions if self.closes(s) > now])
        for s in sessions:
            if self.closes(s) <= now:
                yield Row(user_id=key[0], started=s[0], last=s[1], n=s[2], errors=s[3])

    def close(self) -> None:
        pass


def judged(sessions: DataFrame) -> DataFrame:
    """Closed sessions with their verdict."""
    verdict = F.when(2 * F.col("errors") >= F.col("n"), "failing").when(F.col("errors") > 0, "watch").otherwise("clean")
    return sessions.select("user_id", moment("started").alias("started"), moment("last").alias("ended"), "n", "errors", verdict.alias("verdict"))


def session_verdicts(events: DataFrame, gap_minutes: int = 30, late: str = "3 hours") -> DataFrame:
    """A row for each session of a stream of events (ts, user_id, event_type), once it is over. Events without a user or a
    time belong to none; events later than `late` are dropped, as the watermark has it."""
    source = events.where("user_id IS NOT NULL AND ts IS NOT NULL").withColumn("time", instant("ts")).withWatermark("time", late)
    rows = source.select("time", "user_id", micros("ts").alias("at"), F.coalesce(F.col("event_type") == "error", F.lit(False)).alias("failed"))
    closed = rows.groupBy("user_id").transformWithState(Sessions(gap_minutes * 60_000_000), CLOSED, "Append", "EventTime")
    return judged(closed)


def followed(first: DataFrame, then: DataFrame, within: str = "10 minutes", late: str = "3 hours") -> DataFrame:
    """Each row of one stream (event_id, user_id, ts) with those of another that follow within some time for the same user, or,
    once none can come any more, with none."""
    a = first.select(F.col("event_id").alias("first_id"), "user_id", instant("ts").alias("first_ts")).withWatermark("first_ts", late)
    b = then.select(F.col("event_id").alias("then_id"), F.col("user_id").alias("then_user"), instant("ts").alias("then_ts")).withWatermark("then_ts", late)
    near = (F.col("user_id") == F.col("then_user")) & (F.col("then_ts") >= F.col("first_ts")) & (F.col("then_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    back = lambda c: moment(F.unix_micros(c)).alias(c)
    return a.join(b, near, "left_outer").select("first_id", "user_id", back("first_ts"), "then_id", back("then_ts"))


def in_portions(events: DataFrame, portions: int = 3, late_seconds: int = 7200) -> list[DataFrame]:
    """A table of events as it might arrive: in portions by time, where each event is up to some time late, by a hash of it; the
    last portion ends with a sign of life some days on, of no user, which lets the watermark pass all that is open."""
    arrival = micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(late_seconds)) * 1_000_000
    span = events.agg(F.min(micros("ts")).alias("low"), F.max(micros("ts")).alias("high")).first()
    width = (span.high - span.low) // portions + 1
    number = F.least(F.floor((arrival - span.low) / width), F.lit(portions - 1))
    out = [events.where(number == i) for i in range(portions)]
    day = 86_400_000_000
    signs = events.sparkSession.range(2).select(
        *[(moment(F.lit(span.high + 3 * day)) if f.name == "ts" else F.lit(-1) if f.name == "user_id" else F.element_at(F.array(F.lit("purchase"), F.lit("error")), F.col("id").cast("int") + 1) if f.name == "event_type" else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema]
    )
    out[-1] = out[-1].unionByName(signs)
    return out


def replayed(portions: list[DataFrame], work: Callable[[DataFrame], DataFrame], folder: str, columns: list[str] | None = None) -> DataFrame:
    """What a stream gives for portions that arrive one after the other in a folder. For each the query starts anew from its
    checkpoint and ends when all that is there is worked off; its sink is a table in the folder."""
    spark = portions[0].sparkSession
    home = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for portion in portions:
            portion.write.mode("append").parquet(f"{home}/in")
            out = work(spark.readStream.schema(portions[0].schema).parquet(f"{home}/in"))
            out.writeStream.format("parquet").option("checkpointLocation", f"{home}/checkpoint").option("path", f"{home}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
    return spark.read.schema(out.schema).parquet(f"{home}/out")
