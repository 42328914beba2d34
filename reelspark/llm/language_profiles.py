"""Language identification by rank-order n-gram profiles and out-of-place distance.

A profile is a language's `size` most frequent letter n-grams (one to three
characters, words padded with a blank) in order of frequency. A document is given
the language whose profile is nearest to its own order: each of its n-grams adds
the distance between both ranks, or `size` if the profile lacks it.

Cases: a null text, or one without a letter, gets `und` and score 0. Ties go to the
alphabetically first language. A language with one training row is learned; rows
without a language teach nothing. Long texts cost n log n. If nothing could be
learned, all rows get `und`. Extra columns pass through `keep` only; one that bears the
name of a result column comes back with "_input" appended.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, kept_names, table

OWN = ("lang_pred", "score")
BLANK = 1  # stands for whatever is not a letter; no letter has this code point
_letters: list[np.ndarray] = []


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    codes: np.ndarray  # all n-grams of all profiles, ascending
    ranks: np.ndarray  # [language, n-gram]; `size` where a profile lacks the n-gram
    size: int


def letters() -> np.ndarray:
    """For each code point, whether it is a letter; made once in a worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's n-grams, as numbers in ascending order, and how often each occurs."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    points = np.where(letters()[points], points, BLANK)
    points = np.concatenate(([BLANK], points, [BLANK]))
    points = points[np.concatenate(([True], (points[1:] != BLANK) | (points[:-1] != BLANK)))]
    pairs = points[:-1] << 21 | points[1:]
    inner = points[1:-1] != BLANK
    triples = (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[inner]
    return np.unique(np.concatenate((points[points != BLANK], pairs[pairs != (BLANK << 21 | BLANK)], triples)), return_counts=True)


def ranked(text: str, size: int) -> np.ndarray:
    codes, counts = ngrams(text)
    return codes[np.argsort(-counts, kind="stable")[:size]]


def out_of_place(order: np.ndarray, profiles: Profiles) -> np.ndarray:
    """The distance to each language."""
    at = np.minimum(np.searchsorted(profiles.codes, order), len(profiles.codes) - 1)
    known = profiles.codes[at] == order
    ranks = profiles.ranks[:, at[known]]
    moved = np.where(ranks < profiles.size, np.abs(ranks - np.flatnonzero(known)), profiles.size)
    return moved.sum(axis=1) + profiles.size * int((~known).sum())


def fit(docs: DataFrame, size: int = 300, docs_per_language: int = 2000, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Profiles:
    """Learns from all given rows with a language, or from about docs_per_language of each language, picked by a hash of key and text."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    found = {r[lang]: r["n"] for r in labelled.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not found:
        return Profiles([], np.zeros(0, np.int64), np.zeros((0, 0), np.int64), size)
    share = F.create_map(*[F.lit(x) for k, n in found.items() for x in (k, min(1.0, docs_per_language / n))])
    chosen = labelled.where(F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1_000_000)) < F.element_at(share, F.col(lang)) * 1_000_000)

    bounded_batches(docs.sparkSession)

    def count(batches):
        for batch in batches:
            held: dict[str, list] = {}
            for language, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(language, []).append(body)
            for language, bodies in held.items():
                codes, counts = ngrams(" ".join(bodies))
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(codes)), pa.array(codes), pa.array(counts.astype(np.int64))], ["lang", "code", "n"])

    totals = chosen.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = totals.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size).select("lang", "code", "rank").collect()
    languages = sorted({r["lang"] for r in top})
    codes = np.unique(np.array([r["code"] for r in top], np.int64))
    ranks = np.full((len(languages), len(codes)), size, np.int64)
    for r in top:
        ranks[languages.index(r["lang"]), np.searchsorted(codes, r["code"])] = r["rank"]
    return Profiles(languages, codes, ranks, size)


def identify(docs: DataFrame, profiles: Profiles, keep: list[str], text: str = "text") -> DataFrame:
    """keep, lang_pred and score. The score is how much nearer the best language is than the second, as a share of the second's distance."""

    def guess(batches):
        for batch in batches:
            names, scores = [], []
            for body in batch.column(batch.num_columns - 1).to_pylist():
                order = ranked(body, profiles.size) if body and profiles.languages else ()
                if not len(order):
                    names.append("und")
                    scores.append(0.0)
                    continue
                far = out_of_place(order, profiles)
                best = int(np.argmin(far))
                rest = np.delete(far, best)
                second = int(rest.min()) if len(rest) else profiles.size * len(order)
                names.append(profiles.languages[best])
                scores.append(float(second - far[best]) / max(second, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*[f"k{i}" for i in range(len(keep))], "lang_pred", "score"])

    bounded_batches(docs.sparkSession)
    given = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("t"))
    kinds = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(given.schema.fields[:-1]))
    done = given.mapInArrow(guess, f"{kinds}, lang_pred string, score double")
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept_names(keep, OWN))], "lang_pred", "score")


def remainder(key: Column, by: int) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(by))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    profiles = fit(docs.where(~held_out))
    return identify(docs.withColumn("held_out", held_out), profiles, ["doc_id", "held_out"])


QUERIES = {"op7_language_id": op7_language_id}
