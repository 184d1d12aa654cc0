"""How long each spread was quoted, as a stream: quotes wait as state until nothing can change how long they lasted.

A quote lasts until the next one of its day that has a spread, but no longer than ``longest`` seconds. Quotes are dealt to buckets of some
minutes, so a busy symbol is many groups; a quote soon after a bucket's start is also told to the bucket before, whose last
quote it may end. A timer at the bucket's end plus ``longest`` closes it: by then the watermark has passed every quote
that counts. What comes later than the watermark is left out. State is the quotes of open buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidemark.sources.tape import POINT

QUOTE = "ts long, event_id long, points long, mark boolean"
OUT = "symbol string, ts_utc timestamp_ntz, spread_points long, seconds double, ticks long"
DAY = 86_400_000_000


class Durations(StatefulProcessor):
    """One group is a bucket of a symbol."""

    def __init__(self, minutes: int, longest: float):
        self.width, self.longest = minutes * 60_000_000, longest

    def init(self, handle) -> None:
        self.handle = handle
        self.quotes = handle.getListState("quotes", QUOTE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end = ((key[1] + 1) * self.width) // 1000 + int(self.longest * 1000)
        if end > timerValues.getCurrentWatermarkInMs():  # else the bucket is closed, and what comes is late
            fresh = not self.quotes.exists()
            for pdf in rows:
                self.quotes.appendList([(int(t), int(i), int(p), bool(m)) for t, i, p, m in zip(pdf["ts"], pdf["event_id"], pdf["points"], pdf["mark"])])
            if fresh:
                self.handle.registerTimer(end)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        quotes = sorted(self.quotes.get()) if self.quotes.exists() else []
        self.quotes.clear()
        found: dict[tuple[int, int], list] = {}
        for (ts, _, points, mark), later in zip(quotes, [*quotes[1:], None]):
            if mark:
                continue
            held = (later[0] - ts) / 1e6 if later is not None and later[0] // DAY == ts // DAY else self.longest
            sums = found.setdefault((ts // 60_000_000, points), [0.0, 0])
            sums[0] += min(max(held, 0.001), self.longest)
            sums[1] += 1
        if found:
            minutes = pd.to_datetime([m * 60_000_000 for m, _ in found], unit="us")
            yield pd.DataFrame({"symbol": key[0], "ts_utc": minutes, "spread_points": [p for _, p in found], "seconds": [s for s, _ in found.values()], "ticks": [n for _, n in found.values()]})

    def close(self) -> None:
        pass


def durations(ticks: DataFrame, minutes: int = 5, longest: float = 60.0, late: str = "1 minute", point: float = POINT) -> DataFrame:
    """symbol, ts_utc (minute), spread_points, seconds, ticks of the buckets that are closed. The session needs the RocksDB state store."""
    width = minutes * 60_000_000
    q = ticks.where((F.col("bid") > 0) & (F.col("ask") > 0)).withColumn("event_ts", F.col("ts_utc").cast("timestamp")).withWatermark("event_ts", late)
    q = q.withColumns({"ts": F.unix_micros("event_ts"), "points": F.bround((F.col("ask") - F.col("bid")) / point, 0).cast("long")}).where("points > 0")
    own = F.floor(F.col("ts") / width)
    here = F.struct(own.alias("bucket"), F.lit(False).alias("mark"))
    before = F.when(F.col("ts") - own * width < int(longest * 1_000_000), F.struct((own - 1).alias("bucket"), F.lit(True).alias("mark")))
    q = q.withColumn("b", F.explode(F.filter(F.array(here, before), lambda x: x.isNotNull())))
    q = q.select("symbol", F.col("b.bucket").alias("bucket"), "event_ts", "ts", "event_id", "points", F.col("b.mark").alias("mark"))
    return q.groupBy("symbol", "bucket").transformWithStateInPandas(Durations(minutes, longest), OUT, "append", "eventTime")
