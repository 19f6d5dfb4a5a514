"""Pages of a source that arrive in parts: held in keyed state until the source is whole, or a time without news is over.

Each source is a key of the stream. Its pages lie one by one in a map in the state store (RocksDB: on the executor's disk,
its changes in the checkpoint), so what a task has in memory is one Arrow batch, not a source. Beside the map a source has one
row of state: how many pages are there, how many there have to be, and its timer. State goes when a source is given out, so
it is as large as the pages of the sources that are not whole yet, plus one row each.

A page that comes again before the source is whole replaces the one before; of a page that comes twice in one batch the last
one that the task reads counts. ``total_pages`` is the largest that came; while it is null or 0 only time gives a source out.
Pages beyond the total count like others. A source that was given out begins anew with its next page.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A batch puts its changes into the checkpoint, not the whole store, and only the last two versions stay.
_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
}
#: Timers that follow the clock make Spark plan a batch without data after every other one, so a run over what is there
#: would never end.
_WITH_DATA = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}
GATHERED = "source string, page int, total_pages int, page_content string, complete boolean"
#: Pages of one output batch.
ROWS = 256


@contextmanager
def keyed_state(spark: SparkSession, available_now: bool = True):
    """Queries that start inside have their state in RocksDB, which keyed state with timers needs. With ``available_now``
    timers are looked at in batches that bring data, otherwise all the time."""
    settings = _ROCKS | (_WITH_DATA if available_now else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class _Gather(StatefulProcessor):
    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page int", "page_content string")
        self.known = handle.getValueState("known", "pages long, total int, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total, timer = self.known.get() or (0, 0, None)
        for batch in rows:
            total = max(total, int(batch["total_pages"].fillna(0).max()))
            latest = batch.drop_duplicates("page", keep="last")
            for page, content in zip(latest["page"].tolist(), latest["page_content"].tolist(), strict=True):
                n += not self.pages.containsKey((page,))
                self.pages.updateValue((page,), (content,))
        if timer is not None:
            self.handle.deleteTimer(timer)
        if total and n >= total:
            yield from self._given(key, total, True)
            return
        timer = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
        self.handle.registerTimer(timer)
        self.known.update((n, total, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.known.get()
        if known is not None:
            yield from self._given(key, known[1], False)

    def _given(self, key, total: int, complete: bool) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for (page,), (content,) in self.pages.iterator():
            rows.append((key[0], page, total or None, content, complete))
            if len(rows) == ROWS:
                yield self._frame(rows)
                rows = []
        if rows:
            yield self._frame(rows)
        self.pages.clear()
        self.known.clear()

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[f.split()[0] for f in GATHERED.split(", ")]).astype({"total_pages": "Int32"})

    def close(self) -> None:
        pass


def gathered_pages(pages: DataFrame, timeout: float = 3600.0) -> DataFrame:
    """A stream of ``pages`` (source, page, total_pages, page_content) as a stream of whole sources' pages with
    ``complete``: true where all pages had come, false where for ``timeout`` seconds none did. Rows without a source
    or a page number are left out. Start it inside ``keyed_state``."""
    rows = pages.select("source", F.col("page").cast("int").alias("page"), F.col("total_pages").cast("int").alias("total_pages"), "page_content")
    keyed = rows.where("source IS NOT NULL AND page IS NOT NULL").groupBy("source")
    return keyed.transformWithStateInPandas(_Gather(int(timeout * 1000)), GATHERED, "append", "processingTime")
