"""State over event logs, as batch queries: breakers, rate limits, jobs, caches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rate_limit(events: DataFrame, limit: int = 10, seconds: int = 60) -> DataFrame:
    """Requests of a user in tumbling windows, and those over the limit."""
    w = F.window("ts", f"{seconds} seconds")
    out = events.groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("requests"))
    return out.select("user_id", F.col("w.start").alias("window_start"), "requests", F.greatest(F.lit(0), F.col("requests") - limit).alias("refused"))


def latest_state(events: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The last row of every key, combined before the shuffle."""
    last = F.max_by(F.struct(*events.columns), F.struct(ts, tie))
    return events.groupBy(F.col(key).alias("by")).agg(last.alias("row")).select("row.*")


def stale_jobs(jobs: DataFrame, now, minutes: int = 10) -> DataFrame:
    """Jobs that process for longer than allowed become errors."""
    old = (F.col("status") == "processing") & (F.lit(now).cast("timestamp") - F.col("ts") > F.expr(f"INTERVAL {minutes} MINUTES"))
    return jobs.withColumn("status", F.when(old, "error").otherwise(F.col("status")))


def fresh_cache(entries: DataFrame, now) -> DataFrame:
    """Entries not expired; a stored null stays apart from a missing key."""
    return entries.where(F.col("expires_at") >= F.lit(now).cast("timestamp")).withColumn("negative", F.col("value").isNull())


def breaker_step(state: tuple[int, float | None], at: float, ok: bool, threshold: int, open_s: float) -> tuple[tuple[int, float | None], bool]:
    """The state after an outcome, and whether the call was let through."""
    failures, until = state
    if until is not None and at < until:
        return state, False
    if until is not None:
        failures, until = 0, None
    if ok:
        return (0, None), True
    failures += 1
    return (failures, at + open_s if failures >= threshold else None), True


def outcomes(log: DataFrame, threshold: int = 3, open_s: float = 60.0) -> DataFrame:
    """(provider, ts, seq, ok, timed_out, results) -> a row of counters for every task; one that the breaker stopped wasn't attempted."""
    allowed = circuit_breaker(log, threshold, open_s).select("provider", "seq", "allowed")
    n = lambda c: c.cast("int")
    went, ok = F.col("allowed"), F.col("ok")
    d = log.join(allowed, ["provider", "seq"])
    return d.select("provider", "seq", n(went).alias("attempted"), n(went & ok).alias("succeeded"), n(went & ~ok).alias("failed"), n(went & ~ok & F.col("timed_out")).alias("timed_out"), F.when(went & ok, F.col("results")).otherwise(0).alias("results"), F.when(~went, "тимчасово призупинено після повторних помилок").alias("skipped_reason"))


def circuit_breaker(log: DataFrame, threshold: int = 3, open_s: float = 60.0) -> DataFrame:
    """(provider, ts, seq, ok) -> allowed: replays each provider's log in order, streaming through sorted partitions."""

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}  # providers of one partition; a state is two numbers
        for rows in batches:
            out = []
            for provider, t, ok in zip(rows.provider, rows.ts, rows.ok):
                states[provider], let = breaker_step(states.get(provider, (0, None)), t.timestamp(), bool(ok), threshold, open_s)
                out.append(let)
            yield rows.assign(allowed=out)

    ordered = log.select("provider", "ts", "seq", "ok").repartition("provider").sortWithinPartitions("provider", "ts", "seq")
    return ordered.mapInPandas(replay, "provider string, ts timestamp, seq long, ok boolean, allowed boolean")


def bounded_cache(lookups: DataFrame, capacity: int = 500, seconds: float = 1800.0) -> DataFrame:
    """(cache, key, ts, seq, value) -> hit, negative: replays each cache's lookups in order, at most `capacity` entries in memory a cache.

    A lookup that finds no live entry stores its value; at capacity the entry that came first goes before. A cache's
    lookups depend on one another, so a cache is one ordered log; more caches are more tasks.
    """

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, entries = None, {}  # rows come by cache: only the last one's entries are held
        for rows in batches:
            hits, negative = [], []
            for cache, key, t, value in zip(rows.cache, rows.key, rows.ts, rows.value):
                if cache != name:
                    name, entries = cache, {}
                at = t.timestamp()
                if key in entries and entries[key][0] < at:
                    del entries[key]
                hits.append(key in entries)
                negative.append(bool(hits[-1] and entries[key][1]))
                if not hits[-1]:
                    if len(entries) >= capacity:
                        del entries[next(iter(entries))]
                    entries[key] = (at + seconds, pd.isna(value))
            yield rows.drop(columns="value").assign(hit=hits, negative=negative)

    ordered = lookups.select("cache", "key", "ts", "seq", "value").repartition("cache").sortWithinPartitions("cache", "ts", "seq")
    return ordered.mapInPandas(replay, "cache string, key string, ts timestamp, seq long, hit boolean, negative boolean")


def as_of(lookups: DataFrame, reads: DataFrame, seconds: int) -> DataFrame:
    """lookups(key, ts, seq) with the state of what reads(key, ts, seq, value) left: hit, negative, read_at of the last read that is still fresh.

    A read is fresh for `seconds`, so it can serve lookups of its own time bucket of that length and of the next. Both
    sides meet by (key, bucket), in one window over the times: a key with many lookups is spread over its buckets, and
    no pair of rows is made. A read at a lookup's time serves it; of reads of one time the last by seq counts.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bucket = F.floor(micros("ts") / (seconds * 1_000_000))
    r = reads.select("key", "ts", "seq", F.struct(F.col("ts").alias("at"), "value").alias("read"), F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    both = lookups.select("key", "ts", "seq", F.lit(None).cast(dict(r.dtypes)["read"]).alias("read"), bucket.alias("bucket"), F.lit(1).alias("kind"))
    both = both.unionByName(r.withColumn("kind", F.lit(0)))
    last = F.last("read", ignorenulls=True).over(W.partitionBy("key", "bucket").orderBy("ts", "kind", "seq").rowsBetween(W.unboundedPreceding, W.currentRow))
    d = both.withColumn("last", last).where("kind = 1")
    hit = F.coalesce(micros("ts") < micros("last.at") + seconds * 1_000_000, F.lit(False))
    return d.select("key", "ts", "seq", hit.alias("hit"), (hit & F.col("last.value").isNull()).alias("negative"), F.when(hit, F.col("last.at")).alias("read_at"))
