"""The schedule of targets as a stateful stream: a timer for each target instead of a scan for due ones.

Events are (id, at, kind): `ok` and `failed` say how a run of a target ended, `clock` only moves time
on. The state of a target is its schedule, its next time and how often it has been tried again.
Timers run in event time, so the same events give the same answers at any speed: a target is asked
for when its time has come, and again with each tick until an outcome comes. After an `ok` it waits
an hour or a day. After a failure it is tried again twice, a minute apart, and then with the next
tick. Targets that are not enabled have no timer.

Targets are kept in BUCKETS groups by a hash of their id. The state of a group is one array with a row
for each of its targets, and it has one timer, that of the target whose time comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from offerlake.operators.schedule import HOURLY

from .cycle import MINUTES

#: How often a failed run is tried again, and the minutes in between.
RETRIES, RETRY_MINUTES = 2, 1
#: What comes out: `due` and `retry` ask for a run, `marked` says that one has ended well, `given up` that none of its tries has.
SCHEMA = "id long, at timestamp, what string, next_scrape_at timestamp, last_scraped_at timestamp, tries int"
EVENTS = "id long, at timestamp, kind string"
#: Groups of targets; a checkpoint holds to the number that it was begun with.
BUCKETS = 4096
#: One target of a group: times in microseconds, that of its timer in milliseconds.
_ROW = np.dtype([("id", "<i8"), ("next", "<i8"), ("last", "<i8"), ("wait", "<i8"), ("type", "<i4"), ("tries", "<i4")])
#: A time that is null, and that of no timer.
_NONE, _NEVER = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_SAID = "id long, at long, what string, next long, last long, tries int"
_MINUTE = 60_000_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Targets(StatefulProcessor):
    """The schedules of a group of targets."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("targets", "targets binary")

    def _load(self) -> np.ndarray:
        """Targets by id."""
        return np.frombuffer(self.state.get()[0], _ROW).copy() if self.state.exists() else np.empty(0, _ROW)

    def _store(self, targets: np.ndarray) -> None:
        self.state.update((targets.tobytes(),))
        timers, first = list(self.handle.listTimers()), int(targets["wait"].min())
        for old in timers:
            if old != first:
                self.handle.deleteTimer(old)
        if first != _NEVER and first not in timers:
            self.handle.registerTimer(first)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        new = np.zeros(len(initialState), _ROW)
        for c in ("id", "next", "last", "type"):
            new[c] = initialState[c]
        new["wait"] = np.where(initialState["enabled"] & (new["next"] != _NONE), new["next"] // 1000, _NEVER)
        both = np.concatenate([self._load(), new])  # a group may come in several pieces
        both = both[np.argsort(both["id"], kind="stable")]
        self._store(both[np.append(both["id"][1:] != both["id"][:-1], True)])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        said = pd.concat([r[r["kind"].isin(["ok", "failed"])] for r in rows])
        if said.empty or not self.state.exists():
            return
        targets, out = self._load(), []
        said = said.sort_values(["us", "kind"])
        places = np.searchsorted(targets["id"], said["id"].to_numpy(np.int64))
        for id_, at, kind, k in zip(said["id"].tolist(), said["us"].tolist(), said["kind"], places.tolist()):
            if k == len(targets) or targets["id"][k] != id_:
                continue
            t = targets[k]
            if kind == "ok":
                what, t["tries"], t["last"] = "marked", 0, at
                t["next"] = wait = at + (60 if t["type"] == HOURLY else 24 * 60) * _MINUTE
            elif t["tries"] < RETRIES:
                what, t["tries"], wait = "failed", t["tries"] + 1, at + RETRY_MINUTES * _MINUTE
            else:
                what, t["tries"], wait = "given up", 0, at + MINUTES * _MINUTE
            t["wait"] = wait // 1000
            out.append((id_, at, what, int(t["next"]), int(t["last"]), int(t["tries"])))
        if out:
            self._store(targets)
            yield pd.DataFrame(out, columns=["id", "at", "what", "next", "last", "tries"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        targets, now = self._load(), timerValues.getCurrentWatermarkInMs()
        come = targets["wait"] <= now
        t = targets[come]
        # No outcome by then: the next tick asks again. Ticks that time has run past are not made up.
        targets["wait"][come] = now + MINUTES * _MINUTE // 1000
        self._store(targets)
        yield pd.DataFrame({"id": t["id"], "at": t["wait"] * 1000, "what": np.where(t["tries"] > 0, "retry", "due"), "next": t["next"], "last": t["last"], "tries": t["tries"]})


def _bucket() -> Column:
    return F.pmod(F.hash("id"), F.lit(BUCKETS)).alias("bucket")


def requests(events: DataFrame, targets: DataFrame, late: str = "0 seconds") -> DataFrame:
    """The stream of requests and marks (SCHEMA) of a stream of events (EVENTS).

    targets is what the state starts from: (id, enabled, schedule_type, next_scrape_at, last_scraped_at).
    """
    spark = events.sparkSession
    spark.conf.set(_PROVIDER, _ROCKS)  # the only state store with timers
    micros = lambda c: F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(_NONE))
    start = targets.filter("id is not null").select(
        _bucket(), "id", F.coalesce("enabled", F.lit(False)).alias("enabled"), F.coalesce("schedule_type", F.lit(-1)).cast("int").alias("type"),
        micros("next_scrape_at").alias("next"), micros("last_scraped_at").alias("last"),
    )
    timed = events.filter("at is not null").withWatermark("at", late).select(_bucket(), F.coalesce("id", F.lit(-1)).alias("id"), "at", F.unix_micros("at").alias("us"), "kind").groupBy("bucket")
    said = timed.transformWithStateInPandas(_Targets(), _SAID, "Update", "EventTime", initialState=start.groupBy("bucket"))
    time = lambda c: F.timestamp_micros(F.nullif(F.col(c), F.lit(_NONE)))
    return said.select("id", time("at").alias("at"), "what", time("next").alias("next_scrape_at"), time("last").alias("last_scraped_at"), "tries")


def events(spark: SparkSession, path: str) -> DataFrame:
    """New files of a folder as a stream of events, one file a batch so that time moves on in between."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)


def marked(targets: DataFrame, said: DataFrame) -> DataFrame:
    """targets as the stream leaves them: with the times of their last mark, if it has marked them."""
    last = said.filter("what = 'marked'").groupBy("id").agg(F.max_by(F.struct("next_scrape_at", "last_scraped_at"), "at").alias("m"))
    plain = lambda c: F.coalesce(F.col(f"m.{c}").cast(dict(targets.dtypes)[c]), c)
    return targets.join(last, "id", "left").withColumns({c: plain(c) for c in ("next_scrape_at", "last_scraped_at")}).drop("m")
