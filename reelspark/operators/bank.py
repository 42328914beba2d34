"""Growth of a bank of reference vectors along each video: a sequential fold whose state is the bank itself."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming.ordered import Fold, along, along_stream


def grown(rows: DataFrame, group: str, near: float = 0.45, apart: float = 0.968, pause: int = 5, most: int = 64) -> DataFrame:
    """Proposed: group and id of the rows added to a group's bank. Columns: id, at (order), fd, vec.

    A row is added if its distance is at most `near`, at least `pause` rows of the group
    came since the last addition, no vector of the bank has a cosine of `apart` or more
    with it, and the bank has room. A group is one video's hits; groups run in parallel.
    """
    kind = rows.schema[group].dataType.simpleString()

    def walk(own: pa.Table) -> pa.Table:
        own = own.sort_by([("at", "ascending"), ("id", "ascending")])
        bank, added, last = [], [], -pause
        for i, (fd, vec) in enumerate(zip(own.column("fd").to_pylist(), own.column("vec").to_pylist())):
            if fd is None or vec is None or fd > near or i - last < pause or len(bank) >= most:
                continue
            unit = np.asarray(vec, float)
            unit = unit / max(float(np.linalg.norm(unit)), 1e-6)
            if all(float(unit @ b) < apart for b in bank):
                bank.append(unit)
                added.append(i)
                last = i
        return own.select([group, "id"]).take(added)

    return rows.select(group, "id", "at", "fd", "vec").groupBy(group).applyInArrow(walk, f"{group} {kind}, id long")


@dataclass
class Bank:
    """The rows of a bank, how alike they are, and where the walk stands."""

    rows: list  # time, id, distance, quality and unit vector
    alike: np.ndarray  # cosine of each pair, -1 on the diagonal and where there is no row
    seen: int = 0
    changed: int | None = None
    last: int | None = None


@dataclass(frozen=True)
class BankSpec(Fold):
    """Proposed: a bank that also gives rows up for better ones. Only the settings are known of the original.

    A row is a candidate if its distance is at most `near`, its vector is there, and
    `pause` rows of the key came since the bank last changed. Its worth, like that of a
    row of the bank, is the weighted sum of 1 - distance, 1 - the largest cosine to the
    (other) rows of the bank (1 if there are none), and quality (0 if null).

    - If it is as like a row of the bank as `apart`, it takes that row's place (the most alike one's) if its worth beside the others is higher by `margin`.
    - Else it is added while there is room for `most`.
    - Else it takes the place of the row of least worth, if its own beside the others is higher by `margin`.

    Ties go to the row that has been in its place longer. After `idle` seconds without a
    row the bank is empty again. Vectors of other lengths than the bank's first are no candidates.
    """

    near: float = 0.45
    apart: float = 0.968
    pause: int = 5
    most: int = 64
    margin: float = 0.01
    weights: tuple[float, float, float] = (0.7, 0.25, 0.05)
    idle: float = 3600.0

    columns = "id long, fd double, q double, vec binary"
    state = "place long, ts long, id long, fd double, q double, vec binary, seen long, changed long, last long"
    out = "id long, kind string, instead_of long"

    def new(self, held: list[tuple]) -> Bank:
        bank = Bank([], np.full((self.most, self.most), -1.0))
        for _, ts, i, fd, q, vec, bank.seen, bank.changed, bank.last in sorted(held, key=lambda r: r[0]):
            if i is not None:
                self.put(bank, len(bank.rows), (ts, i, fd, q, np.frombuffer(vec)))
        return bank

    def held(self, bank: Bank) -> list[tuple]:
        after = (bank.seen, bank.changed, bank.last)
        return [(k, ts, i, fd, q, vec.tobytes(), *after) for k, (ts, i, fd, q, vec) in enumerate(bank.rows)] or [(-1, None, None, None, None, None, *after)]

    def end(self, bank: Bank) -> int | None:
        return None if bank.last is None else bank.last + round(self.idle * 1e6)

    def put(self, bank: Bank, place: int, row: tuple) -> None:
        bank.rows[place : place + 1] = [row]
        near = np.array([row[4] @ r[4] for r in bank.rows])
        bank.alike[place, : len(near)] = bank.alike[: len(near), place] = near
        bank.alike[place, place] = -1.0

    def worth(self, fd, q, alike):
        a, b, c = self.weights
        return a * (1 - fd) + b * np.where(alike <= -1.0, 1.0, 1 - alike) + c * q

    def walk(self, bank: Bank, rows: list[tuple]) -> list[tuple]:
        made = []
        for ts, i, fd, q, vec in rows:
            if bank.last is not None and ts - bank.last >= self.idle * 1e6:
                bank.__init__([], np.full((self.most, self.most), -1.0))
            bank.last, bank.seen = ts, bank.seen + 1
            if fd is None or vec is None or fd > self.near or bank.changed is not None and bank.seen - bank.changed < self.pause:
                continue
            unit = np.frombuffer(vec)
            unit = unit / max(float(np.linalg.norm(unit)), 1e-6)
            if not len(unit) or bank.rows and len(unit) != len(bank.rows[0][4]):
                continue
            n, row = len(bank.rows), (ts, i, fd, q or 0.0, unit)
            near = np.array([unit @ r[4] for r in bank.rows])
            kind, place = "add", n
            if n and near.max() >= self.apart or n == self.most:
                fds, qs = (np.array([r[k] for r in bank.rows]) for k in (2, 3))
                worth = self.worth(fds, qs, bank.alike[:n, :n].max(axis=1))
                place = int(near.argmax()) if near.max() >= self.apart else int(worth.argmin())
                beside = np.delete(near, place).max(initial=-1.0)
                if not self.worth(fd, row[3], beside) >= worth[place] + self.margin:
                    continue
                kind = "replace"
            made.append((i, kind, bank.rows[place][1] if kind == "replace" else None))
            self.put(bank, place, row)
            bank.changed = bank.seen
        return made


def _bytes(vec: Column) -> Column:
    """A vector of numbers as bytes, eight each; null if it or one of its numbers is null."""

    @F.pandas_udf("binary")
    def packed(vecs: pd.Series) -> pd.Series:
        return vecs.map(lambda v: None if v is None or any(x is None or x != x for x in v) else np.asarray(v, float).tobytes())

    return packed(vec.cast("array<double>"))


def managed(rows: DataFrame, key: str, spec: BankSpec = BankSpec()) -> DataFrame:
    """key, id, kind (add or replace) and instead_of of each change of each key's bank. Columns: key, ts, id, fd, q and vec."""
    return along(rows.select(key, "ts", "id", "fd", "q", _bytes(rows["vec"]).alias("vec")), key, spec)


def managed_stream(rows: DataFrame, key: str, spec: BankSpec = BankSpec(), late: str = "10 seconds") -> DataFrame:
    """The same of a stream, whatever the order of its rows up to `late`."""
    return along_stream(rows.select(key, "ts", "id", "fd", "q", _bytes(rows["vec"]).alias("vec")), key, spec, late)
