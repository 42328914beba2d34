"""Toxicity by a convolutional text classifier, trained on every labelled document.

Labelled documents are dealt to shards of some thousand rows. The first one warms the model up; then rounds follow
in which each shard goes on from the same model and what the shards changed is averaged, each row of a table over
the shards that changed it. Thresholds are read from counts of all rows kept back from training.

A word's embedding is the sum of a hashed row for the word and one for its first
characters. Filters of several widths run over the whole text, each keeps its
largest response, and a logistic layer joins them. Thresholds are calibrated by
language, which is guessed from the text's function words; scores are then bent so
that each language's threshold becomes 0.5.

Cases: null and empty texts are scored like texts of no known word. Repeated label
rows count once (toxic if any says so); rows that share a labelled doc_id each train.
Equal scores of several cuts: the middle of the best cuts is the threshold. Without both classes among the labels every
score is 0. Long texts are scored whole, in time linear in their words. Extra
columns pass through `keep` only; one that bears the
name of a result column comes back with "_input" appended.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_profiles import remainder
from .shared import bounded_batches, kept_names, materialise, table

#: Function words by which a text's language is guessed (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to is that it for was with are this from",
    "de": "der die das und den mit ist nicht zu von dem ein im sich",
    "fr": "les des une est dans pour et du pas qui sur au avec",
    "es": "el los las una del con por y se para como su",
}
LANGUAGES = ["", *FUNCTION_WORDS]
_STOP = {w.encode(): i for i, k in enumerate(LANGUAGES) if k for w in FUNCTION_WORDS[k].split()}
#: Lower-cased ASCII letters, digits and bytes beyond ASCII stay; the rest parts words.
_PARTS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


@dataclass(frozen=True)
class Spec:
    word_rows: int = 1 << 15
    prefix_rows: int = 1 << 13
    prefix_chars: int = 4
    width: int = 8
    filter_widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    #: Labelled documents of a shard, which one task holds; all shards are trained on.
    shard_rows: int = 8000
    epochs: int = 6
    #: Passes over all shards after the first one's epochs, if there is more than one.
    rounds: int = 3
    #: Steps of a score at which thresholds may lie.
    grid: int = 10_000
    #: Small samples are passed over more often, until as many steps are taken.
    least_steps: int = 600
    batch: int = 64
    rate: float = 0.08
    #: Fewest calibration rows of each class for a threshold of a language's own.
    least_rows: int = 15
    seed: int = 7


class Words(dict):
    """From a word to its two rows and the language of which it is a function word, in one number; it forgets all when full."""

    def __init__(self, spec: Spec, most: int = 100_000):
        super().__init__()
        self.spec, self.most = spec, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        start = word.decode("utf-8", "replace")[: self.spec.prefix_chars].encode()
        rows = 1 + zlib.crc32(word) % (self.spec.word_rows - 1), 1 + zlib.crc32(start, 1) % (self.spec.prefix_rows - 1)
        self[word] = found = rows[0] | rows[1] << 20 | _STOP.get(word, 0) << 40
        return found

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().encode().translate(_PARTS).split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


_words: dict[Spec, Words] = {}


def words(spec: Spec) -> Words:
    return _words.setdefault(spec, Words(spec))


def language(coded: np.ndarray) -> int:
    return int(np.argmax(np.bincount(coded >> 40, minlength=len(LANGUAGES))[1:]) + 1) if (coded >> 40).any() else 0


@dataclass
class Model:
    spec: Spec
    word: np.ndarray
    prefix: np.ndarray
    kernels: list[np.ndarray]  # by filter width: [offset, embedding, filter]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: list[float]  # by LANGUAGES

    def responses(self, rows: list[np.ndarray]) -> np.ndarray:
        """Largest response of every filter in every text."""
        gap = np.zeros(max(self.spec.filter_widths), np.int64)
        joined = np.concatenate([x for r in rows for x in (r, gap)] + [gap])
        starts = np.cumsum([0] + [len(r) + len(gap) for r in rows])[:-1]
        tables = [np.concatenate([t @ k[j] for k in self.kernels for j in range(len(k))], axis=1) for t in (self.word, self.prefix)] if not hasattr(self, "_tables") else self._tables
        self._tables = tables
        lit = tables[0][joined & 0xFFFFF] + tables[1][joined >> 20 & 0xFFFFF]
        n, at, found = len(joined) - len(gap), 0, []
        for k in self.kernels:
            total = sum(lit[j : n + j, at + j * k.shape[2] : at + (j + 1) * k.shape[2]] for j in range(len(k)))
            found.append(np.maximum.reduceat(total, starts, axis=0))
            at += len(k) * k.shape[2]
        return np.concatenate(found, axis=1)

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.maximum(self.responses(rows) + self.bias, 0) @ self.out + self.out_bias, -30, 30)))

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        raw, cut = self.raw(rows), np.array([self.thresholds[language(r)] for r in rows])
        return np.where(raw < cut, 0.5 * raw / cut, 0.5 + 0.5 * (raw - cut) / (1 - cut))


def fresh(spec: Spec) -> Model:
    rng = np.random.default_rng(spec.seed)
    total = spec.filters * len(spec.filter_widths)
    model = Model(
        spec, rng.normal(0, 0.1, (spec.word_rows, spec.width)), rng.normal(0, 0.1, (spec.prefix_rows, spec.width)),
        [rng.normal(0, 0.4, (w, spec.width, spec.filters)) for w in spec.filter_widths], np.zeros(total), rng.normal(0, 0.5, total), 0.0, [0.5] * len(LANGUAGES),
    )
    model.word[0] = model.prefix[0] = 0
    return model


def train(rows: list[np.ndarray], labels: np.ndarray, model: Model, held: dict[str, np.ndarray], epochs: int, seed: int) -> None:
    """Adagrad on the logistic loss, in place; rows of the embedding are updated only where a filter's largest response lay. held: sums of squared slopes."""
    spec, rng = model.spec, np.random.default_rng(seed)

    def step(name: str, value: np.ndarray, slope: np.ndarray, at=slice(None)) -> None:
        seen = held.setdefault(name, np.full(value.shape, 1e-4))
        seen[at] += slope**2
        value[at] -= spec.rate * slope / np.sqrt(seen[at])

    gap, out_bias = np.zeros(max(spec.filter_widths), np.int64), np.array([model.out_bias])
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for begin in range(0, len(order), spec.batch):
            chosen = order[begin : begin + spec.batch]
            joined = np.concatenate([x for i in chosen for x in (rows[i], gap)] + [gap])
            starts = np.cumsum([0] + [len(rows[i]) + len(gap) for i in chosen])
            word, prefix = joined & 0xFFFFF, joined >> 20 & 0xFFFFF
            x, n = model.word[word] + model.prefix[prefix], starts[-1]
            where, peak = [], []
            for k in model.kernels:
                z = sum(x[j : n + j] @ k[j] for j in range(len(k)))
                best = np.stack([z[a:b].argmax(axis=0) + a for a, b in zip(starts[:-1], starts[1:])])
                where.append(best)
                peak.append(np.take_along_axis(z, best, axis=0))
            best, top = np.concatenate(where, axis=1), np.concatenate(peak, axis=1) + model.bias
            active = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(active @ model.out + out_bias, -30, 30)))
            miss = (p - labels[chosen]) / len(chosen)
            down = miss[:, None] * model.out * (top > 0)
            step("out", model.out, active.T @ miss + 1e-4 * model.out)
            step("out_bias", out_bias, np.array([miss.sum()]))
            step("bias", model.bias, down.sum(axis=0))
            touched, slopes = [], []
            for w, k in enumerate(model.kernels):
                cut = slice(w * spec.filters, (w + 1) * spec.filters)
                slope = np.zeros_like(k)
                for j in range(len(k)):
                    at = best[:, cut] + j
                    slope[j] = np.einsum("bfd,bf->df", x[at], down[:, cut])
                    touched.append(at.ravel())
                    slopes.append((down[:, cut, None] * k[j].T[None]).reshape(-1, spec.width))
                step(f"kernel {w}", k, slope)
            touched, slopes = np.concatenate(touched), np.concatenate(slopes)
            for name, value, ids in (("word", model.word, word[touched]), ("prefix", model.prefix, prefix[touched])):
                own, back = np.unique(ids, return_inverse=True)
                summed = np.zeros((len(own), spec.width))
                np.add.at(summed, back, slopes)
                summed[own == 0] = 0
                step(name, value, summed, own)
    model.out_bias = float(out_bias[0])


def parameters(model: Model) -> dict[str, np.ndarray]:
    """What is learned, by the names of its sums in train()."""
    return {"word": model.word, "prefix": model.prefix, "bias": model.bias, "out": model.out, "out_bias": np.array([model.out_bias]), **{f"kernel {w}": k for w, k in enumerate(model.kernels)}}


WIDE = 8
CHANGED = "name string, place int, " + ", ".join(f"{c}{i} double" for c in "vs" for i in range(WIDE))


def _lines(value: np.ndarray) -> np.ndarray:
    """Numbers in lines of WIDE, the last one filled up with zeros."""
    flat = value.ravel()
    return np.concatenate([flat, np.zeros(-len(flat) % WIDE)]).reshape(-1, WIDE)


def changes(before: dict[str, np.ndarray], model: Model, held: dict[str, np.ndarray]) -> pa.Table:
    """The lines that differ from before, with their sums of squared slopes."""
    made = []
    for name, value in parameters(model).items():
        new, old = _lines(value), _lines(before[name])
        at = np.flatnonzero((new != old).any(axis=1))
        sums = _lines(held.get(name, np.full(value.shape, 1e-4)))[at]
        made.append(pa.table([pa.array([name] * len(at)), pa.array(at, pa.int32()), *(pa.array(np.ascontiguousarray(c)) for part in (new[at], sums) for c in part.T)], ["name", "place", *(f"{c}{i}" for c in "vs" for i in range(WIDE))]))
    return pa.concat_tables(made)


def take(model: Model, held: dict[str, np.ndarray], averaged: pa.Table) -> None:
    """Puts averaged lines in the place of the model's own."""
    names, place = np.array(averaged.column("name").to_pylist(), object), averaged.column("place").to_numpy()
    both = [np.stack([averaged.column(f"{c}{i}").to_numpy() for i in range(WIDE)], axis=1).reshape(-1, WIDE) for c in "vs"]
    for name, value in parameters(model).items():
        mine, sums = names == name, held.setdefault(name, np.full(value.shape, 1e-4))
        for target, lines in ((value, both[0]), (sums, both[1])):
            table_ = _lines(target)
            table_[place[mine]] = lines[mine]
            target[...] = table_.ravel()[: target.size].reshape(target.shape)
        if name == "out_bias":
            model.out_bias = float(value[0])


def calibrate(model: Model, counts: np.ndarray) -> None:
    """The threshold of best F1 for each language with enough rows, else that of all rows. counts: by language, label and step of the score."""
    steps = counts.shape[2]
    cuts = np.arange(steps) / (steps - 1)
    inside = (cuts >= 0.02) & (cuts <= 0.98)

    def best(own: np.ndarray) -> float:
        false, hit = own[:, ::-1].cumsum(axis=1)[:, ::-1]  # rows at each step or beyond
        f1 = 2 * hit / np.maximum(hit + false + own[1].sum(), 1e-9)
        top = cuts[inside & (f1 >= f1[inside].max() - 1e-9)]
        return float((top[0] + top[-1]) / 2)

    whole = counts.sum(axis=0)
    overall = best(whole) if whole.sum(axis=1).all() else 0.5
    model.thresholds = [best(own) if own.sum(axis=1).min() >= model.spec.least_rows else overall for own in counts]


def fit(docs: DataFrame, labels: DataFrame, spec: Spec = Spec(), key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """Trains and calibrates on all labelled documents: four fifths, by a hash of the key, train, the others set thresholds; labels of other documents are not read.

    Of rows that share a labelled key the one of least text hash is taken; of labels of one key the largest.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    one = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("y"))

    def coded(batches):
        for batch in batches:
            found = [words(spec).of(t) for t in batch.column(2).to_pylist()]
            ends = pa.array(np.cumsum([0] + [len(x) for x in found]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))], ["id", "y", "rows"])

    met = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).join(one, "id")
    joined = met.groupBy("id", "y").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t")).select("id", "y", "t")  # one row an id, however often it is repeated
    late = F.pmod(F.xxhash64("id", F.lit(spec.seed)), F.lit(5)) == 0
    known = materialise(joined.mapInArrow(coded, "id long, y int, rows array<long>").withColumn("late", late), "toxicity-labelled")
    sizes = {(r["y"], r["late"]): r["n"] for r in known.groupBy("y", "late").agg(F.count(F.lit(1)).alias("n")).collect()}
    if {y for y, _ in sizes} != {0, 1}:
        return None
    shards = max(1, -(-sum(n for (_, behind), n in sizes.items() if not behind) // spec.shard_rows))
    dealt = known.where("NOT late").select("id", "y", "rows", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
    if shards > 1:
        dealt = dealt.repartitionById(shards, "shard").persist(StorageLevel.DISK_ONLY)  # every round finds its shards where the first one sent them

    def unpacked(own: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
        own = own.sort_by("id")
        held = own.column("rows").combine_chunks()
        ends, flat = held.offsets.to_numpy(), held.values.to_numpy()  # views: no object for each word
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])], own.column("y").to_numpy()

    def learning(state, first: bool, seed: int):
        def learn(own: pa.Table) -> pa.Table:
            model, held = pickle.loads(state.value)
            before = {c: v.copy() for c, v in parameters(model).items()}
            rows, y = unpacked(own)
            train(rows, y, model, held, max(spec.epochs, -(-spec.least_steps * spec.batch // max(1, len(rows)))) if first else 1, seed)
            return changes(before, model, held)

        return learn

    model, held, numbers = fresh(spec), {}, [f"{c}{i}" for c in "vs" for i in range(WIDE)]
    for turn in range(1 + (spec.rounds if shards > 1 else 0)):
        state = spark.sparkContext.broadcast(pickle.dumps((model, held)))
        given = dealt.where("shard = 0") if turn == 0 else dealt
        made = given.groupBy("shard").applyInArrow(learning(state, turn == 0, spec.seed + turn), CHANGED)
        summed = made.groupBy("name", "place").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in numbers])  # one count a line; avg() would send one with each number
        averaged = summed.select("name", "place", *[(F.col(c) / F.col("n")).alias(c) for c in numbers])
        take(model, held, averaged.toArrow())  # no more than the model itself
    dealt.unpersist()
    model.word, model.prefix = model.word.astype(np.float32), model.prefix.astype(np.float32)
    model.kernels = [k.astype(np.float32) for k in model.kernels]
    state = spark.sparkContext.broadcast(pickle.dumps(model))

    def placed(batches):
        own = pickle.loads(state.value)
        for batch in batches:
            rows, y = unpacked(pa.Table.from_batches([batch]))
            for at in range(0, len(rows), 256):
                some = rows[at : at + 256]
                yield pa.RecordBatch.from_arrays([pa.array([language(r) for r in some], pa.int32()), pa.array(y[at : at + 256], pa.int32()), pa.array((own.raw(some) * spec.grid).astype(np.int32))], ["language", "y", "step"])

    counts = np.zeros((len(LANGUAGES), 2, spec.grid + 1))
    found = known.where("late").select("id", "y", "rows").mapInArrow(placed, "language int, y int, step int").groupBy("language", "y", "step").agg(F.count(F.lit(1)).alias("n")).toArrow()
    np.add.at(counts, tuple(found.column(c).to_numpy() for c in ("language", "y", "step")), found.column("n").to_numpy())
    calibrate(model, counts)
    return model


def score(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text", words_at_once: int = 60_000) -> DataFrame:
    """keep, score and predicted."""

    def run(batches):
        for batch in batches:
            found, held, size = [], [], 0
            for body in batch.column(batch.num_columns - 1).to_pylist() if model else ():
                held.append(words(model.spec).of(body))
                size += len(held[-1])
                if size > words_at_once:
                    found.append(model.scores(held))
                    held, size = [], 0
            if held:
                found.append(model.scores(held))
            values = np.concatenate(found).astype(np.float64) if found else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.clip(values, 0, 1))], [*[f"k{i}" for i in range(len(keep))], "score"])

    bounded_batches(docs.sparkSession)
    given = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("t"))
    kinds = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(given.schema.fields[:-1]))
    done = given.mapInArrow(run, f"{kinds}, score double")
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept_names(keep, ("score", "predicted")))], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return score(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])


QUERIES = {"op5_toxicity": op5_toxicity}
