"""Streams with state of their own (X4, X5) on ``transformWithState``.

Rows may come in any order and more than once.  A key keeps the rows the
watermark has not passed yet (list state), and an event-time timer at the
earliest of them; when the watermark passes, they are taken in time order
through a small machine whose state is a few rows.  A row at or before the
time already passed is late (or a replay) and changes nothing.  So the stream
gives what the batch operator gives on all rows within the watermark's delay,
and a key's state does not grow with its past.

Times are positive (Spark takes rows at or before its first watermark, the
epoch, for late).  The state store must be RocksDB (``use_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT_TIME = "_event_time"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class InOrder(StatefulProcessor):
    """Takes rows in order of their time (milliseconds) once the watermark
    has passed them.  Subclasses have ``rows``: columns after the time, with
    their SQL types, ``begin``/``take``/``idle``/``end`` and an output frame."""

    def __init__(self, ts: str, rows: Sequence[tuple[str, str]], out: Sequence[str]):
        self.ts, self.rows, self.out = ts, list(rows), list(out)

    def init(self, handle) -> None:
        self.handle = handle
        schema = ", ".join(["t long", *[f"{c} {kind}" for c, kind in self.rows]])
        self.pending = handle.getListState("pending", schema)
        self.passed = handle.getValueState("passed", "t long")
        self.states(handle)

    def _passed(self) -> int | None:
        return self.passed.get()[0] if self.passed.exists() else None

    @staticmethod
    def _values(column: pd.Series, kind: str) -> list:
        """Plain values; pandas gives whole numbers with nulls as floats."""
        value = {"long": int, "double": float}.get(kind, lambda x: x)
        return [None if null else value(x) for x, null in zip(column.tolist(), column.isna().tolist())]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, new = self._passed(), []
        for pdf in rows:
            part = [self._values(pdf[c], kind) for c, kind in [(self.ts, "long"), *self.rows]]
            new += [r for r in zip(*part) if r[0] is not None and (passed is None or r[0] > passed)]
        if new:
            self.pending.appendList(new)
            self.handle.registerTimer(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, passed = timerValues.getCurrentWatermarkInMs(), self._passed()
        held = sorted((tuple(r) for r in self.pending.get()), key=lambda r: r[0]) if self.pending.exists() else []
        ready = [r for r in held if r[0] <= mark]
        wait = held[len(ready):]
        found: list[tuple] = []
        self.begin()
        for r in ready:
            if passed is None or r[0] > passed:  # of rows with one time the first is taken
                found += self.rest(passed, r[0]) + self.take(r)
                passed = r[0]
        if ready:
            self.passed.update((passed,))
            self.pending.clear()
            if wait:
                self.pending.appendList(wait)
        if wait:
            self.handle.registerTimer(int(wait[0][0]))
        else:
            found += self.idle(mark, passed)
        self.end()
        if found:
            yield pd.DataFrame([(*key, *r) for r in found], columns=self.out)

    def states(self, handle) -> None:
        """More state variables."""

    def begin(self) -> None:
        """Read state before the first row."""

    def take(self, row: tuple) -> list[tuple]:
        raise NotImplementedError

    def rest(self, passed: int | None, time: int) -> list[tuple]:
        """Between two rows."""
        return []

    def idle(self, mark: int, passed: int | None) -> list[tuple]:
        """When no row waits."""
        return []

    def end(self) -> None:
        """Write state after the last row."""

    def close(self) -> None:
        pass


def _in_order(df: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str], watermark: str,
              processor: InOrder, schema: T.StructType) -> DataFrame:
    use_state_store(df.sparkSession)
    return (df.select(*keys, F.col(ts).cast("long").alias(ts), *columns)
            .withColumn(EVENT_TIME, F.timestamp_millis(F.col(ts))).withWatermark(EVENT_TIME, watermark)
            .groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "eventTime"))


def _fields(df: DataFrame, columns: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(c, df.schema[c].dataType) for c in columns]


# ---- X4 -------------------------------------------------------------------------------
class ShotChanges(InOrder):
    """State besides pending rows: the last accepted time."""

    def __init__(self, keys: Sequence[str], ts: str, min_gap: int):
        super().__init__(ts, [], [*keys, ts])
        self.min_gap = min_gap

    def states(self, handle) -> None:
        self.last = handle.getValueState("last", "t long")

    def begin(self) -> None:
        self.at = self.last.get()[0] if self.last.exists() else 0

    def take(self, row: tuple) -> list[tuple]:
        if row[0] - self.at <= self.min_gap:
            return []
        self.at = row[0]
        return [(row[0],)]

    def end(self) -> None:
        self.last.update((self.at,))


def shot_changes(candidates: DataFrame, keys: Sequence[str] = ("video_id",), ts: str = "ts_ms",
                 min_gap: int = 1100, watermark: str = "10 seconds") -> DataFrame:
    """The streaming W11; ``ts`` are milliseconds, as a number."""
    schema = T.StructType([*_fields(candidates, keys), T.StructField(ts, T.LongType())])
    return _in_order(candidates, keys, ts, [], watermark, ShotChanges(keys, ts, min_gap), schema)


# ---- X5 -------------------------------------------------------------------------------
class Segments(InOrder):
    """The segmentation W8 with two rows of look-ahead.

    A row is smoothed when the next one is known and tagged when the next
    smoothed one is.  State besides pending rows: the last two raw and the
    last two smoothed rows, the number of runs so far, the open run, and how
    often each offset step occurs in it."""

    TAIL = "place int, start long, end long, label long, offset double"
    RUN = "runs long, open boolean, label long, start long, end long, n long, nulls long"

    def __init__(self, keys: Sequence[str], columns: Sequence[str], label: str, min_chunks: int, half_diff: bool,
                 close_after: int):
        start, end, label_col, offset = columns
        super().__init__(start, [(end, "long"), (label_col, "long"), (offset, "double")],
                         [*keys, "match_id", label, start, end, "invalid_mode"])
        self.min_chunks, self.half_diff, self.close_after = min_chunks, half_diff, close_after

    def states(self, handle) -> None:
        self.tail = handle.getListState("tail", self.TAIL)
        self.run = handle.getValueState("run", self.RUN)
        self.steps = handle.getMapState("steps", "step double", "n long")

    def begin(self) -> None:
        self.raw, self.smooth = [None, None], [None, None]
        for place, *row in (self.tail.get() if self.tail.exists() else ()):
            (self.raw if place < 2 else self.smooth)[place % 2] = tuple(row)
        self.now = dict(zip(("runs", "open", "label", "start", "end", "n", "nulls"),
                            self.run.get() if self.run.exists() else (0, False, None, None, None, 0, 0)))
        self.seen = {k[0]: v[0] for k, v in self.steps.iterator()} if self.now["open"] else {}

    def end(self) -> None:
        rows = [(i, *r) for i, r in enumerate([*self.raw, *self.smooth]) if r is not None]
        if rows:
            self.tail.put(rows)
        else:
            self.tail.clear()
        self.run.update(tuple(self.now.values()))
        self.steps.clear()
        for step, n in self.seen.items() if self.now["open"] else ():
            self.steps.updateValue((step,), (n,))

    @staticmethod
    def _same(a: tuple | None, b: tuple | None) -> bool:
        """Labels are equal; null equals nothing."""
        return a is not None and b is not None and a[2] is not None and a[2] == b[2]

    def _smoothed(self, before, row, after):
        if row is None or not self._same(before, after) or self._same(before, row):
            return row
        x, y = before[3], after[3]
        offset = None if x is None or y is None else (y - x if self.half_diff else y + x) / 2
        return row[0], row[1], before[2], offset

    def _tagged(self, before, row, after) -> list[tuple]:
        """Close, go on with, or open a run at a smoothed row."""
        left, right = self._same(before, row), self._same(row, after)
        if not left and not right:
            return []
        if not left:
            self.now |= {"runs": self.now["runs"] + 1, "open": True, "label": row[2], "start": row[0], "end": row[1],
                         "n": 0, "nulls": 0}
            self.seen = {}
            step = None
        else:
            step = None if row[3] is None or before[3] is None else float(round(row[3] - before[3])) + 0.0
        self.now |= {"start": min(self.now["start"], row[0]), "end": max(self.now["end"], row[1]), "n": self.now["n"] + 1}
        if step is None:
            self.now["nulls"] += 1
        else:
            self.seen[step] = self.seen.get(step, 0) + 1
        if right:
            return []
        top = max(self.seen.values(), default=0)
        modes = sum(n == top for n in self.seen.values()) + (0 if top > 1 else self.now["nulls"])
        run, self.now["open"] = dict(self.now), False
        if run["n"] < self.min_chunks:
            return []
        return [(run["runs"], run["label"], run["start"], run["end"], 0 if modes == 1 else 1)]

    def _push(self, row: tuple | None) -> list[tuple]:
        smooth = self._smoothed(self.raw[0], self.raw[1], row)
        self.raw = [self.raw[1], row]
        found = self._tagged(self.smooth[0], self.smooth[1], smooth) if self.smooth[1] is not None else []
        self.smooth = [self.smooth[1], smooth]
        return found

    def take(self, row: tuple) -> list[tuple]:
        return self._push(row)

    def _closed(self) -> list[tuple]:
        found = self._push(None) + self._push(None)
        self.raw, self.smooth = [None, None], [None, None]
        return found

    def rest(self, passed: int | None, time: int) -> list[tuple]:
        return self._closed() if passed is not None and time >= passed + self.close_after else []

    def idle(self, mark: int, passed: int | None) -> list[tuple]:
        """A timeline without new rows for ``close_after`` ends."""
        if passed is None or (self.raw[1] is None and self.smooth[1] is None):
            return []
        if mark < passed + self.close_after:
            self.handle.registerTimer(int(passed + self.close_after))
            return []
        return self._closed()


def segments(chunks: DataFrame, keys: Sequence[str] = ("video_id",), start: str = "start", end: str = "end",
             label: str = "song_id", offset: str = "offset_seconds", min_chunks: int = 3,
             offset_mode: str = "half_diff", watermark: str = "10 seconds",
             close_after: str | int = 3_600_000) -> DataFrame:
    """The streaming W8; rows of the batch operator, each as soon as its
    segment is certain.  A timeline that rests for ``close_after`` ms ends
    there: the chunks before and after are no neighbours."""
    if offset_mode not in ("half_diff", "mean"):
        raise ValueError(f"unknown offset_mode {offset_mode!r}")
    long = T.LongType()
    schema = T.StructType([*_fields(chunks, keys), T.StructField("match_id", long), T.StructField(label, long),
                           T.StructField(start, long), T.StructField(end, long),
                           T.StructField("invalid_mode", T.IntegerType())])
    columns = [F.col(end).cast("long").alias(end), F.col(label).cast("long").alias("label"),
               F.col(offset).cast("double").alias("offset")]
    processor = Segments(keys, [start, end, "label", "offset"], label, min_chunks, offset_mode == "half_diff",
                         int(close_after))
    return _in_order(chunks, keys, start, columns, watermark, processor, schema)
