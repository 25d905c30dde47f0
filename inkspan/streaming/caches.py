"""Streaming twins of the state operators. Expiry goes by event time, so replays give the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkspan.operators.state import breaker_step, rate_limit


def limited_rate(events: DataFrame, limit: int = 10, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Requests of a user in tumbling windows, and those over the limit; later rows than the watermark are dropped."""
    return rate_limit(events.withWatermark("ts", late), limit, seconds)


def first_reports(requests: DataFrame, key: str = "report_key", late: str = "7 days") -> DataFrame:
    """Requests whose content and sensitivity weren't asked for within the time a report is kept."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def breaker(log: DataFrame, threshold: int = 3, open_s: float = 60.0) -> DataFrame:
    """(provider, ts, seq, ok) -> allowed, as `state.circuit_breaker` has it; state is two numbers a provider.

    Rows of one micro-batch are put in order; a row that comes in a later batch counts as later.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, until = state.get if state.exists else (0, 0.0)
        now = (failures, until or None)
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        out = []
        for t, ok in zip(rows.ts, rows.ok):
            now, let = breaker_step(now, t.timestamp(), bool(ok), threshold, open_s)
            out.append(let)
        if now == (0, None):
            state.remove()  # as if the provider had never failed
        else:
            state.update((now[0], now[1] or 0.0))
        yield rows.assign(allowed=out)[["provider", "ts", "seq", "ok", "allowed"]]

    return log.select("provider", "ts", "seq", "ok").groupBy("provider").applyInPandasWithState(step, "provider string, ts timestamp, seq long, ok boolean, allowed boolean", "failures int, until double", "append", GroupStateTimeout.NoTimeout)


def cached(lookups: DataFrame, seconds: float, late: str = "10 minutes") -> DataFrame:
    """(key, ts, value) -> hit, negative: whether a lookup finds its key's value still fresh; a stored null is a hit, too.

    A key's state goes when the watermark has passed its expiry, and rows later than the watermark are dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until, empty = state.get if state.exists else (0.0, False)
        rows = pd.concat(list(frames)).sort_values("ts")
        hits, negative = [], []
        for t, value in zip(rows.ts, rows.value):
            at = t.timestamp()
            hits.append(at <= until)
            if at > until:
                until, empty = at + seconds, value is None
            negative.append(bool(hits[-1] and empty))
        state.update((until, empty))
        state.setTimeoutTimestamp(max(int(until * 1000), state.getCurrentWatermarkMs()) + 1)
        yield rows.assign(hit=hits, negative=negative)[["key", "ts", "hit", "negative"]]

    return lookups.select("key", "ts", "value").withWatermark("ts", late).groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, hit boolean, negative boolean", "until double, empty boolean", "append", GroupStateTimeout.EventTimeTimeout)


class BoundedCache(StatefulProcessor):
    """A cache of at most `capacity` entries that live for `seconds`, one for each key of the grouping.

    A lookup that finds no live entry stores its value. At capacity a store first drops the entry that came first, also
    if it then overwrites another; an overwritten entry keeps its place. Expired entries count until they are looked
    up. Entries are a map state; the order in which they came is a second one, from number to key, read from a moving
    first number on. State per cache is bounded by the capacity.
    """

    def __init__(self, capacity: int, seconds: float) -> None:
        self.capacity, self.seconds = capacity, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "key string", "number long, until double, empty boolean")
        self.order = handle.getMapState("order", "number long", "key string")
        self.counts = handle.getValueState("counts", "first long, next long, size long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, next_, size = self.counts.get() if self.counts.exists() else (0, 0, 0)
        table = pd.concat(list(rows)).sort_values(["ts", "seq"])
        hits, negative = [], []
        for k, t, value in zip(table.key, table.ts, table.value):
            at = t.timestamp()
            entry = self.entries.getValue((k,)) if self.entries.containsKey((k,)) else None
            if entry is not None and entry[1] < at:  # expired: it goes
                self.entries.removeKey((k,))
                self.order.removeKey((entry[0],))
                size, entry = size - 1, None
            hits.append(entry is not None)
            negative.append(bool(entry and entry[2]))
            if entry is not None:
                continue
            if size >= self.capacity:
                while not self.order.containsKey((first,)):
                    first += 1
                self.entries.removeKey(self.order.getValue((first,)))
                self.order.removeKey((first,))
                first, size = first + 1, size - 1
            self.entries.updateValue((k,), (next_, at + self.seconds, pd.isna(value)))
            self.order.updateValue((next_,), (k,))
            next_, size = next_ + 1, size + 1
        self.counts.update((first, next_, size))
        yield table.assign(hit=hits, negative=negative)[["cache", "key", "ts", "seq", "hit", "negative"]]

    def close(self) -> None:
        pass


def bounded_cache(lookups: DataFrame, capacity: int = 500, seconds: float = 1800.0) -> DataFrame:
    """(cache, key, ts, seq, value) -> hit, negative, as the batch form `state.bounded_cache` has it. Needs the RocksDB state store."""
    grouped = lookups.select("cache", "key", "ts", "seq", "value").groupBy("cache")
    return grouped.transformWithStateInPandas(BoundedCache(capacity, seconds), "cache string, key string, ts timestamp, seq long, hit boolean, negative boolean", "Append", "None")


def job_states(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The last status of every job so far, an unfinished one as of its last event."""
    return events.withWatermark("ts", late).groupBy("job_id").agg(F.max(F.struct("ts", "seq", "status")).alias("last")).select("job_id", "last.ts", "last.status")
