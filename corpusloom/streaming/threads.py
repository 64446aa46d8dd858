"""Comment threads that arrive page by page: held until all replies that the platform states have come, then handed on.

Arbitrary state by thread (``transformWithState``): the items of a thread lie in a map of the state store, so a long
thread need not fit in memory, and a restart goes on with what was held. A thread that has waited for longer than the hold,
by the clock, is handed on as it is. Items that came before, in this run or an earlier one, are not handed on again; no
item is too late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ITEMS = "thread_id string, comment_id string, source_type string, author string, raw_text string, published_at timestamp, n_replies_stated long"
HELD = "comment_id string, source_type string, author string, raw_text string, published_at timestamp"
OUT = f"thread_id string, {HELD}, n_replies_stated long, complete boolean"
_COLUMNS = [c.split(" ")[0] for c in HELD.split(", ")]
#: Rows of a thread in one piece of what is handed on.
PIECE = 1000


class _Holder(StatefulProcessor):
    def __init__(self, hold_ms: int):
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "comment_id string", "source_type string, author string, raw_text string, published_at timestamp")
        self.given = handle.getMapState("given", "comment_id string", "reply boolean")
        self.known = handle.getValueState("known", "stated long, replies long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stated, replies, timer = self.known.get() if self.known.exists() else (0, 0, -1)
        for part in rows:
            for r in part.itertuples(index=False):
                stated = max(stated, 0 if pd.isna(r.n_replies_stated) else int(r.n_replies_stated))
                if r.comment_id is None or self.given.containsKey((r.comment_id,)):
                    continue
                reply = r.source_type == "reply"
                replies += reply
                self.given.updateValue((r.comment_id,), (reply,))
                self.held.updateValue((r.comment_id,), (r.source_type, r.author, r.raw_text, None if pd.isna(r.published_at) else r.published_at.to_pydatetime()))
        done = replies >= stated
        if timer >= 0:
            self.handle.deleteTimer(timer)
        timer = -1 if done else timerValues.getCurrentProcessingTimeInMs() + self.hold_ms
        if not done:
            self.handle.registerTimer(timer)
        self.known.update((stated, replies, timer))
        if done:
            yield from self._handed(key, stated, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        stated, replies, _ = self.known.get()
        self.known.update((stated, replies, -1))
        yield from self._handed(key, stated, False)

    def _handed(self, key, stated: int, complete: bool) -> Iterator[pd.DataFrame]:
        rows = []
        for (comment_id,), value in self.held.iterator():
            rows.append((key[0], comment_id, *value, stated, complete))
            if len(rows) == PIECE:
                yield self._frame(rows)
                rows = []
        if rows:
            yield self._frame(rows)
        self.held.clear()

    def _frame(self, rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["thread_id", *_COLUMNS, "n_replies_stated", "complete"])

    def close(self) -> None:
        pass


def whole_threads(items: DataFrame, hold: str = "1 hour") -> DataFrame:
    """A stream of items (as ``ITEMS``) as a stream of the same items once their thread is complete or its hold is over.

    An item whose id came before is no new item; those without a thread or an id are left out. A thread's stated total is
    the largest one seen. Replies that come after it was handed on are handed on at once if the total is reached, or
    held anew; the hold begins anew with each page of a thread. The session must keep state in RocksDB, as ``hand_on`` sets it.
    """
    hold_ms = int(pd.Timedelta(hold).total_seconds() * 1000)
    rows = items.where("thread_id IS NOT NULL AND comment_id IS NOT NULL")
    return rows.groupBy("thread_id").transformWithStateInPandas(statefulProcessor=_Holder(hold_ms), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime")


def hand_on(items: DataFrame, path: str, checkpoint: str, hold: str = "1 hour") -> None:
    """Append what ``whole_threads`` hands on to a Parquet table, for all that is there now; the next call goes on from the checkpoint.

    Holds that are over are seen with the next data: a run that waited for the clock alone would not end.
    """
    spark = items.sparkSession
    conf = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        whole_threads(items, hold).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def batch_threads(items: DataFrame) -> DataFrame:
    """The same for a table that is whole: every item once, and whether its thread is complete."""
    once = items.where("thread_id IS NOT NULL AND comment_id IS NOT NULL").groupBy("thread_id", "comment_id").agg(F.min(F.struct("source_type", "author", "raw_text", "published_at")).alias("x"), F.max("n_replies_stated").alias("stated"))
    totals = once.groupBy("thread_id").agg(F.count_if(F.col("x.source_type") == "reply").alias("n"), F.coalesce(F.max("stated"), F.lit(0)).alias("n_replies_stated"))
    return once.join(totals, "thread_id").select("thread_id", "comment_id", "x.*", "n_replies_stated", (F.col("n") >= F.col("n_replies_stated")).alias("complete"))
