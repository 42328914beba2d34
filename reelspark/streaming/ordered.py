"""Folds along the rows of a key in order of time, the same for a table and for a stream.

The original keeps such state in one loop over frames; a key's state takes its place here.
Rows without a key, time or id are left out. Rows of equal time go by id.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
PLAIN = {"long": int, "int": int, "string": str, "boolean": bool, "double": float, "binary": bytes}


def parts(schema: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in schema.split(", ")]


class Fold:
    """What goes along a key's rows. Times are microseconds; schemas name columns of the types above."""

    columns = "id long"  #: of a row, after its time; the first is the id
    state = "n long"  #: of the rows in which the state is kept
    out = "id long"  #: of what is handed on, after the key

    def new(self, held: list[tuple]):
        """The state from the rows it was kept in; none at the start."""
        raise NotImplementedError

    def held(self, state) -> list[tuple]:
        """The rows to keep the state in; none if it is as new."""
        raise NotImplementedError

    def walk(self, state, rows: list[tuple]) -> list[tuple]:
        """Takes rows in order: time and columns. Returns rows to hand on."""
        raise NotImplementedError

    def end(self, state) -> int | None:
        """The time from which on the state makes no difference to any row."""
        raise NotImplementedError


def usable(rows: DataFrame, key: str, fold: Fold) -> DataFrame:
    kinds = parts(fold.columns)
    given = rows.select(key, "ts", *[F.col(c).cast(kind).alias(c) for c, kind in kinds])
    return given.where(F.col(key).isNotNull() & F.col("ts").isNotNull() & F.col(kinds[0][0]).isNotNull())


def out_schema(rows: DataFrame, key: str, fold: Fold) -> str:
    return f"`{key}` {rows.schema[key].dataType.simpleString()}, {fold.out}"


def along(rows: DataFrame, key: str, fold: Fold) -> DataFrame:
    """The fold over a table with columns key, ts and those of the fold.

    A key's rows pass through one task in order, an Arrow batch at a time, with the state
    as the only memory; keys are dealt out by hash.
    """
    given = usable(rows, key, fold)
    names = [c for c, _ in parts(fold.out)]

    def run(batches):
        now, state = None, None
        for batch in batches:
            keys, out, outs = batch.column(0), [], []
            own_keys = keys.to_pylist()
            columns = [batch.column(1).cast(pa.int64()), *batch.columns[2:]]
            whole = list(zip(*(c.to_pylist() for c in columns)))
            at = 0
            while at < len(whole):
                end = at
                while end < len(whole) and own_keys[end] == own_keys[at]:
                    end += 1
                if own_keys[at] != now:
                    now, state = own_keys[at], fold.new([])
                made = fold.walk(state, whole[at:end])
                out += made
                outs += [now] * len(made)
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(outs, keys.type), *(pa.array([r[k] for r in out], ARROW[kind]) for k, (_, kind) in enumerate(parts(fold.out)))], [key, *names])

    dealt = given.repartition(key).sortWithinPartitions(key, "ts", parts(fold.columns)[0][0])
    return dealt.mapInArrow(run, out_schema(given, key, fold))


class FoldProcessor(StatefulProcessor):
    """Rows wait in state until the watermark has passed them, so that they are walked in order however they arrive."""

    def __init__(self, fold: Fold, key: str):
        self.fold, self.key = fold, key
        self.kinds = [int, *(PLAIN[kind] for _, kind in parts(fold.columns))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", self.fold.state)
        self.waiting = handle.getListState("waiting", f"ts long, {self.fold.columns}")

    def plain(self, row) -> tuple:
        return tuple(None if v is None or v != v else kind(v) for kind, v in zip(self.kinds, row))

    def handleInputRows(self, key, rows, timerValues):
        latest = None
        for part in rows:
            times = part["ts"].astype("datetime64[us]").astype("int64")
            columns = [times, *(part[c] for c, _ in parts(self.fold.columns))]
            self.waiting.appendList([self.plain(r) for r in zip(*columns)])
            latest = max(latest or 0, int(times.max()))
        if latest is not None:
            self.handle.registerTimer(latest // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        state = self.fold.new([tuple(r) for r in self.kept.get()] if self.kept.exists() else [])
        rows = [self.plain(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready, later = sorted((r for r in rows if r[0] < now), key=lambda r: r[:2]), [r for r in rows if r[0] >= now]
        made = self.fold.walk(state, ready)
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        end = self.fold.end(state)
        held = self.fold.held(state) if end is not None and end > now else []
        self.kept.put(held) if held else self.kept.clear()
        if held and ready:
            self.handle.registerTimer(end // 1000 + 1)
        names = [self.key, *(c for c, _ in parts(self.fold.out))]
        yield pd.DataFrame([(key[0], *r) for r in made], columns=names, dtype=object)

    def close(self) -> None:
        pass


def along_stream(rows: DataFrame, key: str, fold: Fold, late: str = "10 seconds") -> DataFrame:
    """The fold over a stream. Rows later than `late` are dropped; results come once the watermark has passed their rows.

    The session's state store must be RocksDB's, which transformWithState asks for.
    """
    given = usable(rows, key, fold).withWatermark("ts", late)
    return given.groupBy(key).transformWithStateInPandas(FoldProcessor(fold, key), out_schema(given, key, fold), "Append", "EventTime")
