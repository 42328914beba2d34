"""Packing of token sequences into windows: bounded-space online best fit.

Every partition streams its documents and keeps a fixed number of open windows. A
piece goes into the open window that it fills best; when none has room, the fullest
is emitted, after its gap was filled by cutting the piece if the gap is worth it.
What is open at a partition's end is merged afterwards, in rounds over groups of
partitions that each fit one task, until one group is left; its last windows are cut
to whole windows and to powers of two, which need no padding.

Cases: a null text is an empty one, so its document is the end id alone. Repeated
rows are packed each. Long texts are tokenised whole and cut at window ends. An
empty table gives no pieces. Extra columns pass through `keep` only; one that bears
the name of a result column comes back with "_input" appended.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, kept_names, materialise, table


@dataclass(frozen=True)
class Spec:
    window: int = 2048
    open_windows: int = 32
    #: A gap of at least this many tokens is filled by cutting a piece, a smaller one is padded.
    least_cut: int = 16
    end_id: int = 1
    #: Partitions whose open windows one task merges.
    fan_in: int = 64
    #: Words whose ids a worker remembers: at most twice as many, those used last, and a tenth as many with marks.
    memory: int = 400_000


#: Letters up to U+00FF, then marks without an apostrophe or a tag's bracket.
_PLAIN = re.compile(r"([a-zÀ-ÖØ-öø-ÿ]*)([!.,?;:]*)")
#: How byte-level vocabularies show the bytes that are not printable characters of Latin-1.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_SHOWN = {b: 256 + i for i, b in enumerate(_HIDDEN)}


class Ids(dict):
    """From a lower-cased chunk between blanks to its ids as little-endian bytes; the tokenizer never joins ids across a blank."""

    def __init__(self, path: str, most: int):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.older, self.marked = Tokenizer.from_file(path), most, {}, {}
        self.model = self.tokenizer.model

    def __missing__(self, chunk: bytes) -> bytes:
        if (found := self.marked.get(chunk)) is not None:
            return found
        if known := self.older.get(chunk):
            self[chunk] = known
            return known
        parts = _PLAIN.fullmatch(word := chunk.decode())
        if parts and parts[1] and parts[2]:  # a run of marks after letters is a piece of its own
            found = self[parts[1].encode()] + self[parts[2].encode()]
            if len(self.marked) * 10 >= self.most:
                self.marked.clear()
            self.marked[chunk] = found
            return found
        if parts and parts[1]:  # letters that normalising only lower-cases: one piece for the model
            ids = [t.id for t in self.model.tokenize(word if word.isascii() else word.lower().encode().decode("latin-1").translate(_SHOWN))]
            found = pack_ids(f"<{len(ids)}I", *ids)
        else:
            found = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[chunk] = found
        return found

    def of(self, text: str) -> bytes:
        if "<|" in text:  # may hold special tokens, which are told apart by case
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.encode().lower().split()))


_ids: dict[str, Ids] = {}
PIECE = "start long, length long, doc_tokens long, ids binary"
OWN = ("start", "length", "doc_tokens", "sequence_id", "offset")
PLACE = "sequence_id long, offset long, closed boolean"


class Windows:
    """Open windows of one task. A piece is (carried columns, start, ids, doc_tokens); place() yields what a full window holds."""

    def __init__(self, spec: Spec, task: int):
        self.spec, self.next, self.open = spec, task << 32, []

    def _new(self) -> list:
        self.open.append([0, self.next, []])
        self.next += 1
        return self.open[-1]

    def _put(self, window: list, piece: tuple) -> None:
        window[2].append((piece, window[0]))
        window[0] += len(piece[2]) // 4

    def _emit(self, window: list) -> tuple:
        self.open = [w for w in self.open if w is not window]
        return window[1], window[2]

    def place(self, carried, start: int, ids: bytes, total: int) -> Iterator[tuple]:
        limit = self.spec.window
        while ids:
            n = len(ids) // 4
            if n >= limit:  # a whole window of its own
                window = self._new()
                self._put(window, (carried, start, ids[: 4 * limit], total))
                yield self._emit(window)
                start, ids = start + limit, ids[4 * limit :]
                continue
            room = [w for w in self.open if w[0] + n <= limit]
            if room:
                window = max(room, key=lambda w: w[0])
                self._put(window, (carried, start, ids, total))
                if window[0] == limit:
                    yield self._emit(window)
                return
            if len(self.open) < self.spec.open_windows:
                self._put(self._new(), (carried, start, ids, total))
                return
            window = max(self.open, key=lambda w: w[0])
            gap = limit - window[0]
            if gap >= self.spec.least_cut:
                self._put(window, (carried, start, ids[: 4 * gap], total))
                start, ids = start + gap, ids[4 * gap :]
            yield self._emit(window)

    def finish(self) -> Iterator[tuple]:
        """Closes all: whole windows, then powers of two, then one padded window of fewer than least_cut tokens."""
        rest = [p for w in sorted(self.open, key=lambda w: -w[0]) for p, _ in w[2]]
        left, self.open = sum(len(p[2]) // 4 for p in rest), []
        window, size = None, 0
        for carried, start, ids, total in rest:
            while ids:
                if window is None:
                    size = self.spec.window if left >= self.spec.window else left if left < self.spec.least_cut else 1 << (left.bit_length() - 1)
                    window = self._new()
                take = min(len(ids) // 4, size - window[0])
                self._put(window, (carried, start, ids[: 4 * take], total))
                start, ids, left = start + take, ids[4 * take :], left - take
                if window[0] == size:
                    yield self._emit(window)
                    window = None


def pack(docs: DataFrame, keep: list[str], tokenizer: str, text: str = "text", spec: Spec = Spec(), derive: dict[str, Column] | None = None) -> DataFrame:
    """keep, start, length, doc_tokens, sequence_id, offset and ids (binary, little-endian) for every piece.

    derive: columns computed from a piece (its ids among them) that replace the ids in
    the result, so that the token bytes of closed windows need not be stored.
    """
    names, wanted = [f"k{i}" for i in range(len(keep))], derive or {"ids": F.col("ids")}
    out = [F.col(k).alias(c) for c, k in zip(kept_names(keep, (*OWN, *wanted)), names)] + [F.col(c) for c in OWN]
    bounded_batches(docs.sparkSession)
    given = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, names)], F.col(text).alias("t"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])

    def batch(found: list[tuple], types) -> pa.RecordBatch:
        """found: (carried, start, ids, total, sequence, offset, closed)"""
        own = [pa.array([f[0][i] for f in found], types[i]) for i in range(len(names))]
        rest = [
            pa.array([f[1] for f in found], pa.int64()), pa.array([len(f[2]) // 4 for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.binary()),
            pa.array([f[4] for f in found], pa.int64()), pa.array([f[5] for f in found], pa.int64()), pa.array([f[6] for f in found], pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(own + rest, [*names, "start", "length", "doc_tokens", "ids", "sequence_id", "offset", "closed"])

    def rows(emitted, closed: bool) -> list[tuple]:
        return [(*piece, sequence, offset, closed) for sequence, pieces in emitted for piece, offset in pieces]

    def first(batches):
        if tokenizer not in _ids:
            _ids[tokenizer] = Ids(tokenizer, spec.memory)
        ids = _ids[tokenizer]
        own, end, types, found, size = Windows(spec, TaskContext.get().partitionId()), np.array([spec.end_id], "<u4").tobytes(), None, [], 0
        for b in batches:
            types = [c.type for c in b.columns[:-1]]
            for carried, body in zip(zip(*[c.to_pylist() for c in b.columns[:-1]]), b.column(b.num_columns - 1).to_pylist()):
                got = ids.of(body or "") + end
                size += len(got)
                found += rows(own.place(carried, 0, got, len(got) // 4), True)
                if size > 8_000_000:
                    if found:
                        yield batch(found, types)
                    found, size = [], 0
        if types is not None:
            yield batch(found + rows(((w[1], w[2]) for w in own.open), False), types)

    def merging(last: bool, level: int):
        def merge(key, whole):
            own = Windows(spec, (1 << 20 | level << 24) + key[0].as_py())
            types = [whole.column(n).type for n in names]
            whole = whole.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
            held = {n: whole.column(n).to_pylist() for n in [*names, "start", "ids", "doc_tokens"]}
            found = []
            for i in range(whole.num_rows):
                found += rows(own.place(tuple(held[n][i] for n in names), held["start"][i], held["ids"][i], held["doc_tokens"][i]), True)
            found += rows(own.finish(), True) if last else rows(((w[1], w[2]) for w in own.open), False)
            return pa.Table.from_batches([batch(found, types)])

        return merge

    schema = f"{kinds}{PIECE}, {PLACE}"
    derived = [c.alias(f"d{i}") for i, c in enumerate(wanted.values())]

    def stored(pieces: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
        """Closed pieces with what is derived from them; open ones, which alone keep their ids in the store."""
        kept = materialise(pieces.select(*names, "start", "length", "doc_tokens", "sequence_id", "offset", "closed", *derived, F.when(~F.col("closed"), F.col("ids")).alias("ids")), tag)
        return kept.where("closed"), kept.where("NOT closed").select(*names, "start", "length", "doc_tokens", "ids", "sequence_id", "offset")

    closed, open_ = stored(given.mapInArrow(first, schema), "pack")
    results, level, unit = [closed], 0, F.shiftright("sequence_id", 32)
    groups = open_.agg(F.countDistinct(unit)).first()[0]
    while groups:
        level, last = level + 1, groups <= spec.fan_in
        group = F.lit(0) if last else F.pmod(F.xxhash64(unit), F.lit(-(-groups // spec.fan_in)).cast("long"))
        merged = open_.withColumn("g", group.cast("long")).groupBy("g").applyInArrow(merging(last, level), schema)
        closed, open_ = stored(merged, f"pack-merge-{level}")
        results.append(closed)
        groups = 0 if last else open_.agg(F.countDistinct(unit)).first()[0]
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    return whole.select(*out, *[F.col(f"d{i}").alias(n) for i, n in enumerate(wanted)])


def op3_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), ["doc_id"], public_tokenizers.path("word_bpe_49k.json"), derive={"ids_crc32": F.crc32("ids")}).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


QUERIES = {"op3_packing": op3_packing}
