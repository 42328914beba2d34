"""Removal of repeated passages by merging Burrows-Wheeler transforms of shards of text.

A window is a string of `length` bytes inside one document. Each byte covered by a window
that also starts earlier (smaller doc_id, or same document and earlier start) goes.

1. Every window has a key, the least hash of the grams inside it, so equal windows have
   equal keys. Neighbouring windows with one and the same least gram form a segment. A key
   that only one segment has cannot hold a repeated window; such segments go no further.
2. Of equal segments the first one stands for all, and the later ones are removed whole.
3. The different segments of a key meet in one task. Each shard of them gets its transform:
   its suffixes in order, the bytes before each, and the row of the suffix that these
   bytes lead to. The transforms are merged by refining their interleaving: a round sorts
   it, stably, by the bytes before each suffix and so has it sorted by a prefix that is
   longer by as many bytes; suffixes of different shards are never compared, nor sorted
   again. An interval ends where two neighbours part, so that the intervals left at
   `length` are the repeated windows.
4. Keys with more than `most` different segments, such as a very common line in ever
   different surroundings, are settled by grouping their windows instead.

Everything between the steps is a slim table that Spark deals by key; whole texts are
shuffled twice, to cut segments and to remove spans. A task holds one key's segments (at
most `most`) and one document.

Cases: a null or empty text has no spans. A row without doc_id comes after all others.
Of rows that share a doc_id an earlier start comes first, at one start the text of smaller
hash; repeated rows lose the same bytes. Repeats inside a document, overlapping ones
too, count. An empty table gives an empty result. Extra columns pass through `keep` only;
one that bears the name of a result column comes back with "_input" appended. What is left
of a text is binary, since a span can end inside a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, discard, kept_names, materialise, table

OWN = ("spans", "kept")
#: Positions that are hashed at a time.
CHUNK = 1 << 16
#: Stands for a doc_id that is null.
LAST = (1 << 63) - 1
_U = np.uint64


def _odd(n: int) -> int:
    return int.from_bytes(hashlib.sha256(b"gram %d" % n).digest()[:8], "big") | 1


def _hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes (a power of two) from each position on."""
    h, width = data.astype(_U) + _U(1), 1
    while width < gram:
        h, width = h[:-width] * _U(_odd(width)) + h[width:], 2 * width
    h ^= h >> _U(32)
    h *= _U(_odd(0))
    return h ^ (h >> _U(29))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of `width` values from each position on."""
    got = 1
    while 2 * got <= width:
        h, got = np.minimum(h[:-got], h[got:]), 2 * got
    return np.minimum(h[: len(h) - (width - got)], h[width - got :]) if got < width else h


def gram_of(length: int) -> int:
    """The length of grams: the largest power of two up to a third of a window."""
    return 1 << max(0, (length // 3).bit_length() - 1)


def segments(data: np.ndarray, end: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Start, number of windows, key and hash of all segments; end holds, for each byte, where its document ends."""
    gram = gram_of(length)
    total, a = len(data) - length + 1, 0
    while a < total:
        b = min(a + CHUNK, total)
        h = _hashes(data[a : b + length - 1], gram)
        least = _least(h, length - gram + 1)
        inside = end[a:b] >= np.arange(a + length, b + length)
        new = np.ones(b - a, bool)
        new[1:] = (least[1:] != least[:-1]) | (h[: b - a - 1] == least[:-1]) | (end[a + 1 : b] != end[a : b - 1]) | (inside[1:] != inside[:-1])
        start = np.flatnonzero(new)
        n = np.diff(start, append=b - a)
        after = b
        if b < total and len(start) > 1:  # the last one may go on
            after, start, n = a + int(start[-1]), start[:-1], n[:-1]
        held = inside[start]
        start, n = start[held], n[held]
        mark, size = n.astype(_U), n + length - 1
        for k in range(0, int(size.max(initial=0)), gram):
            mark = mark * _U(_odd(1 << 20)) + h[start + np.minimum(k, size - gram)]
        yield start + a, n, least[start], mark ^ (mark >> _U(31))
        a = after


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, and where each begins and ends."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = column.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[at[0] : at[-1]] if whole is not None and len(column) else np.zeros(0, np.uint8)
    return data, at - at[0]


class Shard:
    """The transform of some strings: their suffixes in order, the `step` bytes before each, and the row of the suffix that begins there (-1: none)."""

    def __init__(self, strings: list[bytes], length: int, step: int):
        data = np.frombuffer(b"\0".join(bytes(s).translate(_UP) for s in strings) + b"\0", np.uint8)
        n = len(data)
        sizes = np.array([len(s) + 1 for s in strings])
        self.string = np.repeat(np.arange(len(strings), dtype=np.int32), sizes)
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.offset = np.arange(n) - begin
        left = np.repeat(sizes - 1, sizes) - self.offset
        padded = np.zeros(n + 8, _U)
        padded[:n] = data
        word, width = padded, 1
        while width < 8:
            word = word[:-width] << _U(8 * width) | np.where(word[:-width] & _U(255), word[width:], _U(0))
            width *= 2
        rank, place = self._ranked(word[:n])
        while width < length and rank.max() + 1 < n:
            rest = np.where(left >= width, rank[np.minimum(np.arange(n) + width, n - 1)], 0)
            rank, place = self._ranked(rank.astype(_U) << _U(32) | rest.astype(_U))
            width *= 2
        row = np.empty(n, np.int64)
        row[place] = np.arange(n)
        before = np.zeros(n, _U)
        padded = np.concatenate([np.zeros(step, np.uint8), data])
        for k in range(step):
            before = before << _U(8) | padded[k : k + n]
        back = np.where(self.offset >= step, row[np.maximum(np.arange(n) - step, 0)], -1)
        self.before, self.back, self.string, self.offset = before[place], back[place], self.string[place], self.offset[place]

    @staticmethod
    def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.argsort(key)
        held = key[place]
        rank = np.empty(len(key), np.int64)
        rank[place] = np.concatenate([[0], np.cumsum(held[1:] != held[:-1])])
        return rank, place


#: Bytes of UTF-8 are below 255, so that 0 is free for the end of a string.
_UP = bytes((b + 1) % 256 for b in range(256))


def step_of(length: int) -> int:
    """The bytes by which a round lengthens the sorted prefix: the largest divisor of length that fits a sort key beside a row number."""
    return max(d for d in range(1, 6) if length % d == 0)


def merged(shards: list[Shard], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of at least `length` bytes, in order: shard, string and offset of each, and the number of its interval of equal prefixes of that length."""
    step = step_of(length)
    sizes = [len(s.back) for s in shards]
    base = np.cumsum([0, *sizes])
    assert base[-1] < 1 << 24, "too many bytes for one merge"
    before = np.concatenate([s.before for s in shards])
    back = np.concatenate([np.where(s.back < 0, -1, s.back + b) for s, b in zip(shards, base)])
    rows, interval = np.arange(base[-1]), np.zeros(base[-1], np.int64)
    for _ in range(length // step):
        longer = back[rows] >= 0
        rows, interval = rows[longer], interval[longer]
        key = before[rows] << _U(24) | np.arange(len(rows), dtype=_U)
        key.sort()
        place, word = (key & _U((1 << 24) - 1)).astype(np.int64), key >> _U(24)
        interval = interval[place]
        parted = np.zeros(len(rows), bool)
        parted[1:] = (word[1:] != word[:-1]) | (interval[1:] != interval[:-1])
        interval = np.cumsum(parted)
        rows = back[rows[place]]
    shard = np.searchsorted(base, rows, "right") - 1
    return shard, np.concatenate([s.string for s in shards])[rows], np.concatenate([s.offset for s in shards])[rows], interval


def later_windows(strings: list[bytes], document: np.ndarray, mark: np.ndarray, at: np.ndarray, length: int, shard_bytes: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """String and offset of every window that also starts earlier, in order; a string is the text of a document from at on.

    Earlier is what has the smaller document, of one document the smaller start, of one start the smaller mark.
    """
    assert len(strings) < 1 << 16, "too many strings for one merge"
    shards, first, held = [], [0], 0
    for i, s in enumerate(strings):
        held += len(s) + 1
        if held >= shard_bytes or i + 1 == len(strings):
            shards.append(Shard(strings[first[-1] : i + 1], length, step_of(length)))
            first.append(i + 1)
            held = 0
    shard, string, offset, interval = merged(shards, length)
    if not len(string):
        return string, offset
    string = np.array(first)[shard] + string
    rank = lambda values: np.unique(values, return_inverse=True)[1].astype(np.int64)[string]
    place = rank(document) << 47 | (at[string] + offset) << 16 | rank(mark)
    least = np.minimum.reduceat(place, np.flatnonzero(np.diff(interval, prepend=-1)))
    later = place > least[interval]
    string, offset = string[later], offset[later]
    order = np.lexsort((offset, string))
    return string[order], offset[order]


def _spans(string: np.ndarray, offset: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, start and end of the runs that windows in order cover."""
    new = np.ones(len(string), bool)
    new[1:] = (string[1:] != string[:-1]) | (offset[1:] > offset[:-1] + length)
    start = np.flatnonzero(new)
    return string[start], offset[start], offset[np.append(start[1:], len(string))[: len(start)] - 1] + length


def repeated_spans(docs: DataFrame, length: int = 100, most: int = 4096, merge_bytes: int = 1 << 19) -> DataFrame:
    """doc, mark, start and finish (bytes) of repeated passages; spans of a document may overlap. Columns: doc (long), mark (of the row's text) and text (binary)."""

    def find(batches):
        for batch in batches:
            data, at = _joined(batch.column(2))
            doc, mark = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for start, n, key, own in segments(data, np.repeat(at[1:], np.diff(at)), length):
                i = np.searchsorted(at, start, "right") - 1
                yield pa.RecordBatch.from_arrays([key.view(np.int64), own.view(np.int64), doc[i], mark[i], (start - at[i]).astype(np.int32), n.astype(np.int32)], ["key", "segment", "doc", "mark", "at", "n"])

    found = docs.select("doc", "mark", "text").mapInArrow(find, "key long, segment long, doc long, mark int, at int, n int")
    again = materialise(found.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "keys", "zstd")
    met = materialise(found.join(again, "key", "left_semi"), "segments", "zstd")
    discard(again)
    firsts = materialise(met.groupBy("key", "segment").agg(F.min(F.struct("doc", "at", "mark", "n")).alias("first"), F.count(F.lit(1)).alias("copies")), "firsts", "zstd")
    copied = met.join(firsts.where("copies > 1").select("key", "segment", "first"), ["key", "segment"])
    whole = copied.where(F.struct("doc", "at", "mark") != F.struct("first.doc", "first.at", "first.mark")).select("doc", "mark", F.col("at").alias("start"), (F.col("at") + F.col("n") + length - 1).alias("finish"))

    shared = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key", (F.col("c") > most).alias("common"))
    asked = firsts.select("key", "first.*").join(shared, "key").groupBy("doc", "mark").agg(F.collect_set(F.struct("at", "n", "key", "common")).alias("asked"))

    def cut(batches):
        for batch in batches:
            data, at = _joined(batch.column(2))
            view, rows = memoryview(data), [[], [], [], [], [], []]
            for d, m, begin, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), at.tolist(), batch.column(3).to_pylist()):
                for x in wanted:
                    for column, value in zip(rows, (x["key"], d, m, x["at"], x["common"], bytes(view[begin + x["at"] : begin + x["at"] + x["n"] + length - 1]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()))], ["key", "doc", "mark", "at", "common", "body"])

    texts = docs.join(asked.hint("shuffle_hash"), ["doc", "mark"]).select("doc", "mark", "text", "asked")
    pieces = materialise(texts.mapInArrow(cut, "key long, doc long, mark int, at int, common boolean, body binary"), "pieces", "zstd")

    def settle(keys, doc, mark, at, body):
        doc, mark, at = np.array(doc, np.int64), np.array(mark, np.int32), np.array(at, np.int64)
        string, offset = later_windows(body, doc, mark, at, length)
        i, start, finish = _spans(string, offset, length)
        doc, mark, at = doc[i], mark[i], at[i]
        return pa.RecordBatch.from_arrays([doc, mark, (at + start).astype(np.int32), (at + finish).astype(np.int32)], ["doc", "mark", "start", "finish"])

    def merge(batches):
        """Keys come in order; whole ones are merged once they have merge_bytes."""
        held, size = [[], [], [], [], []], 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if size >= merge_bytes and row[0] != held[0][-1]:
                    yield settle(*held)
                    held, size = [[], [], [], [], []], 0
                for column, value in zip(held, row):
                    column.append(value)
                size += len(row[4])
        if held[0]:
            yield settle(*held)

    kind = "doc long, mark int, start int, finish int"
    merged_ = pieces.where("NOT common").select("key", "doc", "mark", "at", "body").repartition("key").sortWithinPartitions("key", "doc", "at", "mark").mapInArrow(merge, kind)

    def windows(batches):
        for batch in batches:
            for d, m, a, s in zip(*[c.to_pylist() for c in batch.columns]):
                n = len(s) - length + 1
                found = [hashlib.blake2b(s[i : i + length], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([d] * n, pa.int64()), pa.array([m] * n, pa.int32()), pa.array(range(a, a + n), pa.int32())], ["window", "doc", "mark", "at"])

    single = pieces.where("common").select("doc", "mark", "at", "body").mapInArrow(windows, "window binary, doc long, mark int, at int")
    earliest = single.groupBy("window").agg(F.min(F.struct("doc", "at", "mark")).alias("first"))
    common = single.join(earliest, "window").where(F.struct("doc", "at", "mark") != F.col("first")).select("doc", "mark", F.col("at").alias("start"), (F.col("at") + length).alias("finish"))
    return whole.unionByName(merged_).unionByName(common)


def without_repeats(docs: DataFrame, keep: list[str], id: str = "doc_id", text: str = "text", length: int = 100, most: int = 4096) -> DataFrame:
    """keep, spans (start and finish of each maximal removed run, in order) and kept (the bytes that remain) for every row of docs."""
    bounded_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(LAST)).alias("doc"), F.hash(body).alias("mark"), body.alias("text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    spans = repeated_spans(slim, length, most).groupBy(F.col("doc").alias("s_doc"), F.col("mark").alias("s_mark")).agg(F.collect_set(F.struct("start", "finish")).alias("found"))
    given = slim.join(spans.hint("shuffle_hash"), (F.col("doc") == F.col("s_doc")) & (F.col("mark") == F.col("s_mark")), "left").select(*[f"k{i}" for i in range(len(keep))], "text", F.col("found.start").alias("start"), F.col("found.finish").alias("finish"))

    def remove(batches):
        for batch in batches:
            rows, spans = [], []
            for body, start, finish in zip(*[c.to_pylist() for c in batch.columns[-3:]]):
                runs, left, end = [], [], 0
                for a, b in sorted(zip(start or [], finish or [])):
                    if runs and a <= runs[-1]["finish"]:
                        runs[-1]["finish"] = max(b, runs[-1]["finish"])
                    else:
                        runs.append({"start": a, "finish": b})
                for r in runs:
                    left.append(body[end : r["start"]])
                    end = r["finish"]
                rows.append(b"".join([*left, body[end:]]))
                spans.append(runs)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("finish", pa.int32())]))), pa.array(rows, pa.binary())], [*[f"k{i}" for i in range(len(keep))], *OWN])

    kinds = "".join(f"k{i} {f.dataType.simpleString()}, " for i, f in enumerate(given.schema.fields[: len(keep)]))
    done = given.mapInArrow(remove, f"{kinds}spans array<struct<start: int, finish: int>>, kept binary")
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept_names(keep, OWN))], *OWN)


def op12_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), ["doc_id", "n_bytes"])
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["finish"] - s["start"]))
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op12_suffix_dedup": op12_suffix_dedup}
