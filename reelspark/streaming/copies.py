"""Near copies along time, and exact ones, in a table and in a stream. Proposed: the original drops copies from a finished pool only."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .ordered import Fold, along, along_stream


@dataclass
class Recent:
    """Kept hashes of one key, oldest first, and their ids by the values of their segments."""

    kept: deque
    found: dict


@dataclass(frozen=True)
class NearCopies(Fold):
    """A row is a copy if a kept row less than `within` seconds before it differs in at most `most` of 64 bits; of several the one kept first is named.

    Two hashes that differ in at most `most` bits agree in one of most + 1 segments, so
    only kept rows that share a segment are compared. A row without a hash is kept and
    nobody's copy has it as original. Kept rows leave the state after `within` seconds.
    """

    most: int = 8
    within: float = 60.0

    columns = "id long, known boolean, hash long"
    state = "ts long, id long, hash long"
    out = "id long, copy_of long"

    def segments(self, value: int) -> list[tuple[int, int]]:
        value, count = value % 2**64, min(self.most + 1, 64)
        edges = [64 * k // count for k in range(count + 1)]
        return [(a, value >> a & ((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]

    def add(self, state: Recent, row: tuple) -> None:
        state.kept.append(row)
        for s in self.segments(row[2]):
            state.found.setdefault(s, deque()).append(row)

    def new(self, held: list[tuple]) -> Recent:
        state = Recent(deque(), {})
        for row in held:
            self.add(state, row)
        return state

    def held(self, state: Recent) -> list[tuple]:
        return list(state.kept)

    def end(self, state: Recent) -> int | None:
        return state.kept[-1][0] + round(self.within * 1e6) if state.kept else None

    def walk(self, state: Recent, rows: list[tuple]) -> list[tuple]:
        made = []
        for ts, i, known, value in rows:
            while state.kept and state.kept[0][0] + round(self.within * 1e6) <= ts:
                old = state.kept.popleft()
                for s in self.segments(old[2]):
                    state.found[s].popleft()  # lists of a segment are as old as the whole, so the oldest stands first
                    if not state.found[s]:
                        del state.found[s]
            original = None
            if known:
                near = lambda r: ((r[2] ^ value) & (2**64 - 1)).bit_count() <= self.most
                # of each segment's rows the first that is near, as they stand in the order they were kept
                first = [r for s in self.segments(value) if (r := next(filter(near, state.found.get(s, ())), None))]
                if first:
                    original = min(first)[1]
                else:
                    self.add(state, (ts, i, value))
            made.append((i, original))
        return made


def _given(rows: DataFrame) -> DataFrame:
    return rows.selectExpr("*", "hash IS NOT NULL AS known").na.fill(0, ["hash"])


def near_copies(rows: DataFrame, key: str, most: int = 8, within: float = 60.0) -> DataFrame:
    """key, id and copy_of (null if kept) of each row of a table with key, ts, id and hash."""
    return along(_given(rows.select(key, "ts", "id", "hash")), key, NearCopies(most, within))


def near_copies_stream(rows: DataFrame, key: str, most: int = 8, within: float = 60.0, late: str = "10 seconds") -> DataFrame:
    """The same of a stream, whatever the order of its rows up to `late`."""
    return along_stream(_given(rows.select(key, "ts", "id", "hash")), key, NearCopies(most, within), late)


def first_of_equal(rows: DataFrame, keys: list[str], late: str = "10 seconds") -> DataFrame:
    """Rows of a stream, of those with equal keys within `late` of each other the first that arrives; null keys are equal."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
