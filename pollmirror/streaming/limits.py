"""Submission rate limit per key, and access counts per window."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LIMIT, WINDOW_SECONDS = 60, 3600
#: Keyed list state and timers need a store that can hold several states per key.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
DECIDED = "id long, api_key long, submitted_at timestamp, allowed boolean"


class RateLimiter(StatefulProcessor):
    """Accepted times of one key as list state, in order, and one event-time timer that clears them.

    Times in order are appended; the list is written anew only when a late row was put between
    others or old times left the reach of the watermark.
    """

    def __init__(self, limit: int, seconds: int) -> None:
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "t double")
        self.timer = handle.getValueState("timer", "ms long")

    def _load(self, watermark_ms: int) -> tuple[list[float], bool]:
        """The times that a row within the watermark can still reach, and whether others were left out."""
        held = [t for (t,) in self.times.get()] if self.times.exists() else []
        kept = held[bisect_left(held, watermark_ms / 1000 - self.seconds) :]
        return kept, len(kept) < len(held)

    def _store(self, times: list[float], was: int, rewritten: bool) -> None:
        if not times:
            self.times.clear()
        elif rewritten:
            self.times.put([(t,) for t in times])
        elif len(times) > was:
            self.times.appendList([(t,) for t in times[was:]])

    def _wake(self, times: list[float], watermark_ms: int) -> None:
        """One timer, when the last time leaves the window."""
        due = max(int((times[-1] + self.seconds) * 1000) + 1, watermark_ms + 1) if times else None
        set_ = self.timer.get()[0] if self.timer.exists() else None
        if set_ == due:
            return
        if set_ is not None and set_ > watermark_ms:
            self.handle.deleteTimer(set_)
        if due is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = max(timerValues.getCurrentWatermarkInMs(), 0)
        times, rewritten = self._load(watermark)
        was = len(times)
        frame = pd.concat(rows).sort_values(["submitted_at", "id"], kind="stable")
        flags = []
        for ts in (frame["submitted_at"].astype("datetime64[us]").astype("int64") / 1e6).tolist():
            end = bisect_right(times, ts)
            ok = end - bisect_left(times, ts - self.seconds) < self.limit
            if ok:
                rewritten |= end < len(times)
                times.insert(end, ts)
            flags.append(ok)
        self._store(times, was, rewritten)
        self._wake(times, watermark)
        yield frame.assign(allowed=flags)[["id", "api_key", "submitted_at", "allowed"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        times, rewritten = self._load(max(timerValues.getCurrentWatermarkInMs(), 0))
        self._store(times, len(times), rewritten)
        self._wake(times, max(timerValues.getCurrentWatermarkInMs(), 0))
        yield pd.DataFrame({"id": pd.Series(dtype="int64"), "api_key": pd.Series(dtype="int64"), "submitted_at": pd.Series(dtype="datetime64[ns]"), "allowed": pd.Series(dtype="bool")})

    def close(self) -> None:
        pass


def rate_limit(stream: DataFrame, limit: int = LIMIT, seconds: int = WINDOW_SECONDS, delay: str = "1 hour") -> DataFrame:
    """Mark each submission allowed or not: refused once ``limit`` accepted ones lie in the trailing window.

    The count is taken before the new row, and refused rows do not count. A key's rows of a
    micro-batch are decided in time order (ties by id), however many Arrow batches they come in;
    a late row counts the accepted ones in its own trailing window. A key's state holds the
    accepted times that a row within the watermark can still reach: at most ``limit`` per window
    of the allowed delay, and nothing once they have left it. Rows later than the delay are not
    decided. Runs with the settings of ``STORE``. ``stream``: id, api_key, submitted_at.
    """
    return (
        stream.withWatermark("submitted_at", delay).groupBy("api_key")
        .transformWithStateInPandas(RateLimiter(limit, seconds), DECIDED, "append", "EventTime")
    )


def busy_windows(stream: DataFrame, limit: int = LIMIT, seconds: int = WINDOW_SECONDS, slide: int = WINDOW_SECONDS // 12, delay: str = "1 hour") -> DataFrame:
    """api_key, start, n, over: submissions per sliding window, the approximate form of the limit.

    Counts all submissions, refused ones too, at window ends ``slide`` apart, so a key over the limit is
    noticed at most one slide late. State is one count per key and open window; counts are merged
    before the shuffle.
    """
    span = F.window("submitted_at", f"{seconds} seconds", f"{slide} seconds")
    counts = stream.withWatermark("submitted_at", delay).groupBy(span.alias("w"), "api_key").agg(F.count("*").alias("n"))
    return counts.select("api_key", F.col("w.start").alias("start"), "n", (F.col("n") > limit).alias("over"))


def trailing_counts(rows: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Earlier submissions of the same key in the trailing window, as a batch job.

    Rows are cut into window-long slices and copied to the next one, so a hot key is
    ordered slice by slice instead of in one task.
    """
    at = F.unix_micros(F.col("submitted_at").cast("timestamp"))
    span = seconds * 1_000_000
    d = rows.withColumn("_t", at).withColumn("_own", F.floor(F.col("_t") / span).cast("bigint"))
    d = d.withColumn("_slice", F.explode(F.array("_own", F.col("_own") + 1)))
    w = Window.partitionBy("api_key", "_slice").orderBy("_t").rangeBetween(-span, -1)
    return d.withColumn("recent", F.count("*").over(w)).where(F.col("_slice") == F.col("_own")).drop("_t", "_own", "_slice")


def access_counts(stream: DataFrame, by: list[str], width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Accesses per tumbling window and key; late rows within the delay are counted."""
    return (
        stream.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), *by)
        .agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")
    )
