"""Sliding-window admission and trailing request counts per key."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta import rules
from sedimenta.operators.skew import salted_join
from sedimenta.session import written

MICROS = 1_000_000


def checked_limit(raw: object, default: int = rules.RATE_LIMIT) -> int:
    """A malformed limit falls back to the default."""
    try:
        return int(raw)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return default


class Admitted:
    """The latest ``limit`` admitted times of one key, each in place of the one it has outlived.

    The place of the next admitted time holds the ``limit``-th latest one; an event is admitted if that lies before the
    window, or if there is none yet.
    """

    def __init__(self, limit: int, window_seconds: int, times: Sequence[int] = ()):
        self._limit, self._seconds = limit, window_seconds
        self._slots, self._count = [*times, *[0] * (limit - len(times))], len(times)

    def walk(self, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(admitted, seconds to wait) of ordered times in microseconds. A stretch of refused events is one step."""
        limit, slots, width, count = self._limit, self._slots, self._seconds * MICROS, self._count
        at, n, i = times.tolist(), len(times), 0
        first, behind, holding = [], [], []
        while i < n:
            now, place = at[i], count % limit
            if count >= limit and slots[place] >= now - width:
                first.append(i)
                holding.append(slots[place])
                i = bisect_right(at, slots[place] + width, i + 1)
                behind.append(i)
            else:
                slots[place] = now
                count += 1
                i += 1
        self._count = count
        wait = np.zeros(n, np.int64)
        if not first:
            return np.ones(n, bool), wait
        edges = np.zeros(n + 1, np.int8)
        edges[first], edges[behind] = 1, -1
        refused = np.cumsum(edges[:n], dtype=np.int8).astype(bool)
        held = np.repeat(np.array(holding, np.int64), np.subtract(behind, first))
        wait[refused] = np.maximum(1, (self._seconds + 1 - (times[refused] - held) / MICROS).astype(np.int64))
        return ~refused, wait

    def times(self) -> list[int]:
        """Oldest first."""
        at = self._count % self._limit
        return self._slots[at:] + self._slots[:at] if self._count >= self._limit else self._slots[:self._count]


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970. A time without zone is taken as it stands, whatever the zone of the session is."""
    c = F.col(ts)
    if isinstance(df.schema[ts].dataType, T.TimestampType):
        return F.unix_micros(c)
    c = c.cast("timestamp_ntz")
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = (days * 24 + F.hour(c)) * 3600 + F.minute(c) * 60
    return seconds * MICROS + (F.date_part(F.lit("SECOND"), c) * MICROS).cast("bigint")


# cells of a window by which events are counted and blocks are cut
CELLS = 16
# windows before a block whose events a guess of its entering state looks at
WARM_UP = 2
BLOCK_EVENTS = 200_000
ROUNDS = 6


def _cells(timed: DataFrame, key: str, window_seconds: int, block_events: int) -> DataFrame:
    """(key, _cell, _run, _block, _next): runs have no empty window inside, blocks hold about ``block_events`` events.

    After an idle window nothing admitted earlier counts, so runs are independent. ``_next`` is the first cell of the
    block behind. All of it comes from pre-aggregated counts of the (key, cell) pairs there are.
    """
    cells = timed.groupBy(key, "_cell").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(key).orderBy("_cell")
    # nothing for a whole window between the end of one cell and the start of the next
    new = F.coalesce(F.col("_cell") - F.lag("_cell").over(order) > CELLS, F.lit(True)).cast("int")
    runs = cells.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    inside = Window.partitionBy(key, "_run").orderBy("_cell")
    before = F.coalesce(F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = runs.withColumn("_block", F.floor(before / F.lit(block_events)))
    # one row a block, so that the block behind is the next row
    starts = blocks.groupBy(key, "_run", "_block").agg(F.min("_cell").alias("_start"))
    starts = starts.withColumn("_next", F.lead("_start").over(Window.partitionBy(key, "_run").orderBy("_block")))
    starts = starts.withColumn("_follows", F.row_number().over(Window.partitionBy(key, "_run").orderBy("_block")))
    return blocks.join(starts.drop("_start"), [key, "_run", "_block"]).select(key, "_cell", "_run", F.col("_follows").cast("bigint").alias("_block"), "_next")


def _starts(parts: Sequence[np.ndarray]) -> np.ndarray:
    """Where the sorted rows of another group begin."""
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([p[1:] != p[:-1] for p in parts])]) if len(parts[0]) else np.zeros(0, np.int64)


def _values(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _walk_keys(key: str, event_id: str, limit: int, window_seconds: int):
    """Decisions of events sorted by key, time and id; a batch of many short keys gives one batch."""
    width = window_seconds * MICROS

    def admit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            keys, us = pdf[key].to_numpy(), pdf["_us"].to_numpy()
            n, new = len(pdf), _starts([keys])
            admitted, wait = np.ones(n, bool), np.zeros(n, np.int64)
            # only an event that has ``limit`` others of its key in the window before it can be refused
            crowded = np.zeros(n, bool)
            crowded[limit:] = (keys[limit:] == keys[:-limit]) & (us[:-limit] >= us[limit:] - width)
            crowds = np.logical_or.reduceat(crowded, new) if n else crowded
            for start, end, crowd in zip(new.tolist(), [*new[1:].tolist(), n], crowds.tolist()):
                same = state is not None and keys[start] == current
                if not (same or crowd or end == n):
                    continue
                if not same:
                    current, state = keys[start], Admitted(limit, window_seconds)
                admitted[start:end], wait[start:end] = state.walk(us[start:end])
            yield pdf[[key, event_id]].assign(admitted=admitted, retry_after=wait)

    return admit


def _walk_blocks(key: str, event_id: str, limit: int, window_seconds: int):
    """Decisions of sorted blocks of events, and a row for each block with the states it was entered and left in.

    Rows of one block: those before it (``_warm``) or the state it is entered in (``_head``, ``_enter``), then its events.
    """
    width = window_seconds * MICROS
    names, states = [key, "_run", "_block", event_id, "_us"], pa.list_(pa.int64())
    columns = [*names, "admitted", "retry_after", "_first", "_entered", "_left"]

    def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, entered, first, mark, closed, kinds = None, None, None, None, None, [], None

        def summaries() -> pa.RecordBatch:
            rows = [pa.array([*c], kind) for c, kind in zip(zip(*closed), [*kinds, pa.int64(), states, states])]
            n = len(closed)
            closed.clear()
            return pa.RecordBatch.from_arrays([*rows[:5], pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64()), rows[4], *rows[5:]], columns)

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in names[:4]]
            parts = [_values(batch, c) for c in names[:3]]
            new, n = _starts(parts), batch.num_rows
            us, warm = _values(batch, "_us"), _values(batch, "_warm")
            enter, ids = batch.column(batch.schema.get_field_index("_enter")), batch.column(batch.schema.get_field_index(event_id))
            given = _values(batch, "_head")
            admitted, wait, decided = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, bool)
            for start, end in zip(new.tolist(), [*new[1:].tolist(), n]):
                name = tuple(p[start] for p in parts)
                if name != current:
                    if current is not None and first is not None:
                        closed.append((*current, mark, first, entered, state.times()))
                    current, entered, first = name, None, None
                    state = Admitted(limit, window_seconds)
                if given[start]:
                    state = Admitted(limit, window_seconds, enter[start].as_py())
                    start += 1
                own = start + int(np.argmin(warm[start:end])) if start < end and not warm[start:end].all() else end
                if own > start:
                    state.walk(us[start:own])
                if own == end:
                    continue
                if first is None:
                    first, mark = int(us[own]), ids[own].as_py()
                    entered = [t for t in state.times() if t >= first - width]
                admitted[own:end], wait[own:end] = state.walk(us[own:end])
                decided[own:end] = True
            out = batch.select(names).filter(pa.array(decided))
            n = out.num_rows
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(admitted[decided]), pa.array(wait[decided]), pa.nulls(n, pa.int64()), pa.nulls(n, states), pa.nulls(n, states)], columns)
            if closed:
                yield summaries()
        if current is not None and first is not None:
            closed.append((*current, mark, first, entered, state.times()))
            yield summaries()

    return admit


def _walk_states(key: str, limit: int, window_seconds: int):
    """The state each block is entered in, from the times of one run after another; a run's first state comes before them."""
    width, names = window_seconds * MICROS, [key, "_run", "_block"]

    def enter_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            parts = [_values(batch, c) for c in names]
            us, enter = _values(batch, "_us"), batch.column(batch.schema.get_field_index("_enter"))
            given = _values(batch, "_head")
            new, found = _starts(parts), []
            for start, end in zip(new.tolist(), [*new[1:].tolist(), batch.num_rows]):
                name = tuple(p[start] for p in parts)
                if given[start]:
                    state = Admitted(limit, window_seconds, enter[start].as_py())
                    start += 1
                if start == end:
                    continue
                if name != current:
                    found.append((*name, [t for t in state.times() if t >= us[start] - width]))
                    current = name
                state.walk(us[start:end])
            if found:
                kinds = [*[batch.schema.field(c).type for c in names], pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([*c], kind) for c, kind in zip(zip(*found), kinds)], [*names, "_enter"])

    return enter_blocks


@dataclass
class Admission:
    """Decisions, and what finding them took: rounds, blocks run again, and runs that were finished in one piece."""

    rows: DataFrame
    rounds: int = 0
    reruns: int = 0
    in_sequence: int = 0


def admission(
    events: DataFrame, key: str, ts: str, event_id: str, limit: object = rules.RATE_LIMIT,
    window_seconds: int = rules.RATE_WINDOW_SECONDS, block_events: int = BLOCK_EVENTS, rounds: int = ROUNDS,
) -> Admission:
    """(key, event_id, admitted, retry_after): admit while fewer than ``limit`` admitted events lie in the window.

    Each decision depends on earlier ones. Keys of up to ``block_events`` events are sorted and streamed, many to a task.
    Of larger keys a run of events without an idle window is one sequence. Runs of more than ``block_events`` events are
    cut into blocks that start from a guess, the state after the two windows before them taken by themselves. A block
    whose guess is not the state its predecessor left is run again from that state, until all agree. What still differs
    after ``rounds`` rounds, or once a round leaves more than half of the blocks before it, is settled in order: one task
    a run streams the bare times for the state each block is entered in, and the blocks are decided from these side by
    side. At most ``limit`` times are held; a key is never gathered. Events without key or time get no decision.
    """
    limit = checked_limit(limit)
    timed = events.select(key, event_id, micros(events, ts).alias("_us"))
    if limit <= 0:
        return Admission(timed.select(key, event_id, F.lit(True).alias("admitted"), F.lit(0).cast("bigint").alias("retry_after")))
    width = window_seconds * MICROS
    timed = timed.filter(F.col(key).isNotNull() & F.col("_us").isNotNull())
    out = [key, event_id, "admitted", "retry_after"]
    by_key = _walk_keys(key, event_id, limit, window_seconds)
    kinds = T.StructType([events.schema[key], events.schema[event_id], T.StructField("admitted", T.BooleanType()), T.StructField("retry_after", T.LongType())])
    streamed = lambda df: df.repartition(key).sortWithinPartitions(key, "_us", event_id).mapInPandas(by_key, kinds)
    large = written(timed.groupBy(key).count().filter(F.col("count") > block_events).select(key), "admission-large")
    if large.isEmpty():
        return Admission(streamed(timed))

    small = streamed(timed.join(large, key, "left_anti"))
    timed = timed.join(large, key, "left_semi").withColumn("_cell", F.floor(F.col("_us") / F.lit(width // CELLS)))
    cells = written(_cells(timed, key, window_seconds, block_events), "admission-cells")
    cut = not cells.filter(F.col("_next").isNotNull()).isEmpty()
    placed = salted_join(timed, cells, [key, "_cell"], [event_id])
    own = F.struct(F.col("_block"), F.lit(False).alias("warm"))
    ahead = F.struct((F.col("_block") + 1).alias("_block"), F.lit(True).alias("warm"))
    near = F.col("_next") - F.col("_cell") <= WARM_UP * CELLS
    copies = F.explode(F.when(near, F.array(own, ahead)).otherwise(F.array(own))) if cut else F.explode(F.array(own))
    # an empty array, no null: Spark's Arrow writer takes time by the square of a batch's null arrays
    no_state = (F.lit(False).alias("_head"), F.array().cast("array<bigint>").alias("_enter"))
    rows = placed.select(key, "_run", event_id, "_us", copies.alias("c")).select(
        key, "_run", F.col("c._block").alias("_block"), event_id, "_us", F.col("c.warm").alias("_warm"), *no_state
    )
    schema = T.StructType([
        events.schema[key], T.StructField("_run", T.LongType()), T.StructField("_block", T.LongType()), T.StructField(event_id, events.schema[event_id].dataType),
        T.StructField("_us", T.LongType()), T.StructField("admitted", T.BooleanType()), T.StructField("retry_after", T.LongType()),
        T.StructField("_first", T.LongType()), T.StructField("_entered", T.ArrayType(T.LongType())), T.StructField("_left", T.ArrayType(T.LongType())),
    ])
    names = [key, "_run", "_block"]
    walk = _walk_blocks(key, event_id, limit, window_seconds)
    # a state comes before the events of its block
    in_order = lambda df: df.repartition(*names).sortWithinPartitions(*names, F.desc("_head"), "_us", event_id).mapInArrow(walk, schema)
    decided = lambda df: df.filter("admitted IS NOT NULL")
    if not cut:
        return Admission(decided(in_order(rows)).select(*out).unionByName(small))

    done = Admission(None)
    tables = [written(in_order(rows), "admitted")]
    states = written(tables[0].filter("_first IS NOT NULL").select(*names, event_id, "_first", "_entered", "_left"), "admission-states")
    latest, before_n = states.select(*names, F.lit(0).alias("_round")), None
    while True:
        before = states.select(key, "_run", (F.col("_block") + 1).alias("_block"), F.col("_left").alias("_came"))
        came = F.filter("_came", lambda t: t >= F.col("_first") - width)
        met = states.join(before, names).withColumn("_enter", came)
        wrong = written(met.filter(F.col("_enter") != F.col("_entered")).select(*names, event_id, "_enter"), "admission-wrong")
        n = wrong.count()
        if not n:
            break
        done.rounds += 1
        last = done.rounds > rounds or (before_n is not None and 2 * n > before_n)
        before_n = n
        events_of = tables[0].filter("admitted IS NOT NULL")
        if last:
            # all from the first wrong block of a run on; the state of that one is known
            first = wrong.groupBy(key, "_run").agg(F.min(F.struct("_block", "_enter")).alias("w")).select(key, "_run", F.col("w._block").alias("_from"), F.col("w._enter").alias("_enter"))
            first = written(first, "admission-first")
            times = events_of.join(first.select(key, "_run", "_from"), [key, "_run"]).filter("_block >= _from").select(*names, "_us", *no_state)
            heads = first.select(key, "_run", F.col("_from").alias("_block"), F.lit(0).cast("bigint").alias("_us"), F.lit(True).alias("_head"), "_enter")
            sequence = times.unionByName(heads).repartition(key, "_run").sortWithinPartitions(*names, F.desc("_head"), "_us")
            states_schema = T.StructType([f for f in schema if f.name in names] + [T.StructField("_enter", T.ArrayType(T.LongType()))])
            wrong = written(sequence.mapInArrow(_walk_states(key, limit, window_seconds), states_schema), "admission-wrong")
            done.in_sequence = first.count()
        else:
            done.reruns += n
        again = events_of.select(*names, event_id, "_us").join(wrong.select(*names), names)
        again = again.select(*names, event_id, "_us", F.lit(False).alias("_warm"), *no_state)
        no_event = F.lit(None).cast(events.schema[event_id].dataType).alias(event_id)
        heads = wrong.select(*names, no_event, F.lit(0).cast("bigint").alias("_us"), F.lit(False).alias("_warm"), F.lit(True).alias("_head"), "_enter")
        tables.append(written(in_order(again.unionByName(heads)), "admitted"))
        latest = written(latest.join(wrong.select(*names), names, "left_anti").unionByName(wrong.select(*names, F.lit(done.rounds).alias("_round"))), "admission-latest")
        if last:
            break
        fresh = tables[-1].filter("_first IS NOT NULL").select(*names, event_id, "_first", "_entered", "_left")
        states = written(states.join(wrong.select(*names), names, "left_anti").unionByName(fresh), "admission-states")
    parts = [decided(t).join(latest.filter(F.col("_round") == k).select(*names), names, "left_semi").select(*out) for k, t in enumerate(tables)]
    done.rows = small
    for part in parts:
        done.rows = done.rows.unionByName(part)
    return done


def rate_limit_admit(
    events: DataFrame, key: str, ts: str, event_id: str, limit: object = rules.RATE_LIMIT,
    window_seconds: int = rules.RATE_WINDOW_SECONDS, block_events: int = BLOCK_EVENTS,
) -> DataFrame:
    """The decisions of ``admission`` alone."""
    return admission(events, key, ts, event_id, limit, window_seconds, block_events).rows


def window_request_count(
    events: DataFrame, key: str, ts: str, event_id: str, window_seconds: int = rules.RATE_WINDOW_SECONDS, splits: int = 24
) -> DataFrame:
    """(key, event_id, n_requests): events of the key in [ts - window, ts].

    The window is cut into ``splits`` cells. Whole cells in the middle come from pre-aggregated cell counts; only
    the two cells at the ends look at single events. The largest group is one key's events in one cell, instead of
    all events of the key.
    """
    width = window_seconds * MICROS
    cell_width = width // splits
    if cell_width * splits != width:
        raise ValueError("splits must divide the window")
    us, cell = F.col("_us"), F.floor(F.col("_us") / F.lit(cell_width))
    timed = events.select(key, event_id, micros(events, ts).alias("_us"))
    # an event is a data row of its own cell and asks a question in the cell one window earlier
    rows = timed.select(key, event_id, F.explode(F.array(
        F.struct(cell.alias("cell"), us.alias("at"), F.lit(1).alias("is_data")),
        F.struct((cell - splits).alias("cell"), (us - width).alias("at"), F.lit(0).alias("is_data")),
    )).alias("r")).select(key, event_id, "r.*")
    in_cell = Window.partitionBy(key, "cell").orderBy("at")
    upto = F.sum("is_data").over(in_cell.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    onward = F.sum("is_data").over(in_cell.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    edges = rows.select(key, event_id, "cell", "is_data", F.when(F.col("is_data") == 1, upto).otherwise(onward).alias("n"))
    middle_frame = Window.partitionBy(key).orderBy("cell").rangeBetween(-(splits - 1), -1)
    middle = timed.groupBy(key, cell.alias("cell")).agg(F.count("*").alias("_n")).select(
        key, "cell", F.coalesce(F.sum("_n").over(middle_frame), F.lit(0)).alias("_middle")
    )
    counted = edges.join(middle, [key, "cell"], "left").withColumn(
        "n", F.col("n") + F.when(F.col("is_data") == 1, F.col("_middle")).otherwise(0)
    )
    return counted.groupBy(key, event_id).agg(F.sum("n").cast("bigint").alias("n_requests"))
