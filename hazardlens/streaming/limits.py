"""Requests admitted by a sliding-window limit for each client, on tables and on streams.

A request is turned away if the client had `most` admitted ones in the last
`seconds`, or `most_sensitive` sensitive ones and is itself sensitive. Only
admitted requests count. So whether one is admitted rests on those before it: a
client's requests are taken in their order, holding `most` of them at once.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SECONDS, MOST, MOST_SENSITIVE = 60, 120, 20
MICROS = 1_000_000
COLUMNS = "client string, request string, ts timestamp, sensitive boolean, admitted boolean, reason string"


class Admission:
    """The admitted requests of one client in the last seconds."""

    def __init__(self, seconds: int, most: int, most_sensitive: int, held: list[tuple[int, bool]] | None = None):
        self.length, self.most, self.most_sensitive = seconds * MICROS, most, most_sensitive
        self.held = deque(held or [])

    def reason(self, at: int, sensitive: bool) -> str | None:
        """None if the request is admitted, which it then counts; else why not. Requests come in their order."""
        while self.held and self.held[0][0] <= at - self.length:
            self.held.popleft()
        if len(self.held) >= self.most:
            return "too many requests"
        if sensitive and sum(s for _, s in self.held) >= self.most_sensitive:
            return "too many sensitive requests"
        self.held.append((at, sensitive))
        return None


def requests(events: DataFrame, client: str, request: str, ts: str, sensitive) -> DataFrame:
    """Events as requests: client (null: unknown), request id, time, whether sensitive (null: not)."""
    return events.select(
        F.coalesce(F.col(client).cast("string"), F.lit("unknown")).alias("client"), F.col(request).cast("string").alias("request"), F.col(ts).cast("timestamp").alias("ts"),
        F.coalesce(sensitive, F.lit(False)).alias("sensitive"),
    ).filter("ts IS NOT NULL")


def admitted(rows: DataFrame, seconds: int = SECONDS, most: int = MOST, most_sensitive: int = MOST_SENSITIVE) -> DataFrame:
    """Requests with `admitted` and `reason`, for a table. Requests of one time go by their id; a request without a time has no row.

    Where a client makes no request for a whole span of `seconds`, what follows doesn't
    depend on what was before: such runs are dealt out apart, so a busy client is
    shared by tasks at every pause. Runs are sorted by Spark and read through.
    """
    span = F.floor(F.unix_micros("ts") / (seconds * MICROS)).cast("long")
    spans = rows.select("client", span.alias("span")).distinct()
    order = Window.partitionBy("client").orderBy("span")
    fresh = F.coalesce(F.col("span") - F.lag("span").over(order) > 1, F.lit(True))
    runs = spans.withColumn("run", F.sum(fresh.cast("int")).over(order))
    dealt = rows.withColumn("span", span).join(runs, ["client", "span"]).repartition("client", "run").sortWithinPartitions("client", "run", "ts", "request")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            reasons = []
            cols = [batch.column(c).to_pylist() for c in ("client", "run", "sensitive")]
            for client, run, sensitive, at in zip(*cols, batch.column("ts").cast(pa.int64()).to_pylist(), strict=True):
                if (client, run) != now:
                    now, state = (client, run), Admission(seconds, most, most_sensitive)
                reasons.append(state.reason(at, sensitive))
            yield pa.RecordBatch.from_pydict({
                "client": batch.column("client"), "request": batch.column("request"), "ts": batch.column("ts"), "sensitive": batch.column("sensitive"),
                "admitted": pa.array([r is None for r in reasons], pa.bool_()), "reason": pa.array(reasons, pa.string()),
            })

    return dealt.select("client", "run", "request", "ts", "sensitive").mapInArrow(read, COLUMNS)


def admitted_stream(rows: DataFrame, seconds: int = SECONDS, most: int = MOST, most_sensitive: int = MOST_SENSITIVE, late: str = "1 minute") -> DataFrame:
    """The same for a stream: a client's admitted requests are its state, which goes once the watermark is `seconds` past the last one.

    The requests of a batch are taken in their order of time; one that is later than a batch before it counts from then on.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, flags = state.get if state.exists else ([], [])
        limit = Admission(seconds, most, most_sensitive, list(zip(times, flags, strict=True)))
        batch = pd.concat(list(frames)).sort_values(["ts", "request"], kind="stable")
        micros = batch["ts"].astype("datetime64[us]").astype("int64")
        # A late request is judged at the time of the newest one held.
        reasons = [limit.reason(max(at, limit.held[-1][0] if limit.held else at), bool(s)) for at, s in zip(micros, batch["sensitive"], strict=True)]
        state.update(([t for t, _ in limit.held], [s for _, s in limit.held]))
        ends = max(limit.held[-1][0] if limit.held else 0, int(micros.max())) // 1000 + seconds * 1000
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield batch.assign(admitted=[r is None for r in reasons], reason=reasons)[["client", "request", "ts", "sensitive", "admitted", "reason"]]

    watched = rows.withWatermark("ts", late).groupBy("client")
    return watched.applyInPandasWithState(step, COLUMNS, "times array<bigint>, flags array<boolean>", "append", GroupStateTimeout.EventTimeTimeout)
