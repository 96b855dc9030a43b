"""Streaming forms: redaction of arriving files, admission control, incremental summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sedimenta import rules
from sedimenta.functions import paths, text
from sedimenta.operators.cache import SummaryCache, incremental_changed
from sedimenta.operators.ratelimit import MICROS, Admitted, checked_limit, micros


def stream_redact(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Readable arriving files with prepared text and findings: stateless, append only."""
    located = files.withColumn("path", paths.normalized(F.col("path")))
    readable = located.filter((paths.ignored_prefix(F.col("path")) == "") & paths.skip_reason(F.col("path")).isNull())
    prepared = readable.select("project", "path", "size", text.head_tail_truncate(F.col("content"), max_chars).alias("_content"))
    return text.with_redaction(prepared, "_content").select("project", "path", "size", "redacted_text", "findings")


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
# such workers get columns whose names begin with an underscore under other names
TIME = "admission_us"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Admission(StatefulProcessor):
    """Admission of one key: its latest admitted times as a list, and a timer after which they count no more.

    Events of a key that come in several chunks are laid down in the state store by ``stretch`` of time first and
    decided stretch by stretch, so that no more than a chunk and a stretch is in memory.
    """

    def __init__(self, key: str, event_id: str, id_type: str, limit: int, window_seconds: int, stretch: int):
        self._key, self._id, self._id_type = key, event_id, id_type
        self._limit, self._window, self._stretch = limit, window_seconds, stretch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._times = handle.getListState("times", "us bigint")
        self._timer = handle.getValueState("timer", "ms bigint")
        self._held = handle.getMapState("held", "stretch bigint, part bigint", f"us array<bigint>, id array<{self._id_type}>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        admitted = Admitted(self._limit, self._window, [t for (t,) in self._times.get()] if self._times.exists() else ())
        latest = 0
        for us, ids in self._stretches(rows):
            order = np.lexsort((ids, us))
            decided = admitted.walk(us[order])
            latest = max(latest, int(us[order[-1]]))
            yield pd.DataFrame({self._key: key[0], self._id: ids[order], "admitted": decided[0], "retry_after": decided[1]})
        if latest:
            self._times.put([(t,) for t in admitted.times()])
            self._expire_after(latest // 1000 + 1000 * (self._window + 1))

    def _stretches(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        chunks = (c for c in rows if len(c))
        first, second = next(chunks, None), next(chunks, None)
        if second is None:
            if first is not None:
                yield first[TIME].to_numpy(), first[self._id].to_numpy()
            return
        parts: dict[int, int] = {}
        for chunk in chain((first, second), chunks):
            us, ids = chunk[TIME].to_numpy(), chunk[self._id].to_numpy()
            at = us // self._stretch
            order = np.argsort(at, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                stretch = int(at[part[0]])
                n = parts.get(stretch, 0)
                self._held.updateValue((stretch, n), (us[part].tolist(), ids[part].tolist()))
                parts[stretch] = n + 1
        for stretch in sorted(parts):
            held = [self._held.getValue((stretch, n)) for n in range(parts[stretch])]
            for n in range(parts[stretch]):
                self._held.removeKey((stretch, n))
            yield tuple(np.concatenate([np.asarray(h[k]) for h in held]) for k in (0, 1))

    def _expire_after(self, ms: int) -> None:
        old = self._timer.get() if self._timer.exists() else None
        if old is not None:
            ms = max(ms, old[0])
            self._handle.deleteTimer(old[0])
        self._handle.registerTimer(ms)
        self._timer.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._times.clear()
        self._timer.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_admit(
    events: DataFrame, key: str, ts: str, event_id: str, limit: object = rules.RATE_LIMIT,
    window_seconds: int = rules.RATE_WINDOW_SECONDS, delay: str = "10 minutes", stretch_seconds: float = 1.0,
) -> DataFrame:
    """Admission per key on a stream; state is at most ``limit`` times per key, and goes when the key was idle for a window.

    Events are ordered by (time, id) inside a micro-batch, however many a key has there: they go through the state store,
    and ``stretch_seconds`` of them are in memory. Rows later than the watermark ``delay`` are dropped; decisions already
    made are not revised. The session's state store must be the one on RocksDB, which is set here where none is chosen.
    """
    limit = checked_limit(limit)
    schema = T.StructType([
        events.schema[key], events.schema[event_id],
        T.StructField("admitted", T.BooleanType()), T.StructField("retry_after", T.LongType()),
    ])
    timed = events.withColumn(TIME, micros(events, ts)).withColumn("admission_ts", F.timestamp_micros(TIME)).withWatermark("admission_ts", delay)
    timed = timed.select(key, event_id, "admission_ts", TIME)
    if limit <= 0:
        return timed.select(key, event_id, F.lit(True).alias("admitted"), F.lit(0).cast("bigint").alias("retry_after"))
    spark = events.sparkSession
    if not spark.conf.get(STATE_STORE).endswith("RocksDBStateStoreProvider"):
        spark.conf.set(STATE_STORE, ROCKS_DB)
    kind = events.schema[event_id].dataType.simpleString()
    processor = _Admission(key, event_id, kind, limit, window_seconds, int(stretch_seconds * MICROS))
    return timed.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def incremental_sink(cache: SummaryCache, mode: str, describe: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: describes only files whose key is not cached and stores the result.

    Replaying a batch after a failure finds its keys in the cache and adds nothing.
    """

    def sink(batch: DataFrame, _batch_id: int) -> None:
        changed = incremental_changed(batch, cache.read(), mode)
        cache.save(describe(changed))

    return sink
