"""Extensions for event streams: session islands, a cache kept as deduplication, and thinning by distance with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def sessions(events: DataFrame, by: list[str], ts: str, gap: str, late: str, metrics: dict[str, Column] | None = None) -> DataFrame:
    """Islands in time as they close: rows (by, start, end, n, metrics); rows later than the watermark are dropped."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = timed.groupBy(*by, F.session_window("_ts", gap).alias("_w")).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in (metrics or {}).items()])
    return out.select(*by, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n", *(metrics or {}))


def first_of_key(rows: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """Each key once within the watermark, as a response cache lets a request through once."""
    return rows.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark([key]).drop("_ts")


class _Thinning(StatefulProcessor):
    """Of one group's tokens in order of time, each that lies nearer than radius to the last kept replaces it if longer, else goes."""

    def __init__(self, keys: list[str], radius: float):
        self.keys, self.radius = keys, radius

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, token string")
        self.kept = handle.getValueState("kept", "at long, token string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            self.waiting.appendList([(int(t), k) for t, k in zip(batch["thin_at"], batch["thin_token"], strict=True)])
            for t in sorted(set(batch["thin_at"])):
                # from then on nothing can come before a row, nor near enough to replace it
                for due in (int(t) // 1000 + 1, int(t) // 1000 + int(self.radius * 1000) + 2):
                    self.handle.registerTimer(due)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen, radius = timerValues.getCurrentWatermarkInMs() * 1000, int(self.radius * 1_000_000)
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready, later = sorted(r for r in rows if r[0] < seen), [r for r in rows if r[0] >= seen]
        last, out = tuple(self.kept.get()) if self.kept.exists() else None, []
        for r in ready:
            if last is None or r[0] - last[0] >= radius:
                out += [last] if last else []
                last = r
            elif len(r[1]) > len(last[1]):
                last = r
        if last and seen >= last[0] + radius:
            out.append(last)
            last = None
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        self.kept.update(last) if last else self.kept.clear()
        if out:
            yield pd.DataFrame({**{k: [v] * len(out) for k, v in zip(self.keys, key, strict=True)}, "at": [r[0] for r in out], "token": [r[1] for r in out]})

    def close(self) -> None:
        pass


def proximity_dedup(tokens: DataFrame, by: list[str], ts: str, token: str, radius: float, late: str) -> DataFrame:
    """Rows (by, at, token) as they become certain: proximity_dedup of coverage with the time in microseconds as the place, and the radius in seconds.

    A row waits until the watermark passes it, so that any order of arrival within `late` gives the batch's rows; what comes later is dropped. A group's
    state holds what has come within `late`, and the last row kept. Rows with a null time or token are left out. Needs the RocksDB state store.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = tokens.where(F.col(ts).isNotNull() & F.col(token).isNotNull()).select(*by, F.col(ts).cast("timestamp").alias("thin_ts"), at.alias("thin_at"), F.col(token).alias("thin_token")).withWatermark("thin_ts", late)
    types = dict(tokens.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in by) + ", at long, token string"
    return rows.groupBy(*by).transformWithStateInPandas(_Thinning(by, radius), schema, "Append", "EventTime")
