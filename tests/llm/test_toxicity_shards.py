"""Training over several shards, against the same rounds by hand, and the plans of the rounds."""

import copy
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelspark.llm import toxicity

SPEC = toxicity.Spec(word_rows=256, prefix_rows=64, shard_rows=40, epochs=2, rounds=2, least_steps=1, batch=16)
SCHEMA = "doc_id long, text string, toxic int"


@pytest.fixture
def rows():
    rng = random.Random(3)
    found = [(i, " ".join(rng.choices(["ash", "bark", "cane", "dell", "elm", "fern"], k=9) + ["vile"] * (i % 3 == 0)), int(i % 3 == 0)) for i in range(200)]
    found[7], found[8] = (7, None, 0), (8, "", 1)
    return [*found, *found[20:30], *found[20:30], (None, "vile ash", 1), (None, "elm", 0), (500, "vile", None)]  # rows that come again, null ids, no label


def by_hand(spark, rows):
    """The model before its numbers are made single, from one row an id, shard by shard."""
    one = {i: (t, y) for i, t, y in rows if i is not None and y is not None}
    hashes = {r["i"]: r for r in spark.createDataFrame([(i,) for i in one], "i long").select("i", F.xxhash64("i").alias("h"), F.xxhash64("i", F.lit(SPEC.seed)).alias("late")).collect()}
    used = sorted(i for i in one if hashes[i]["late"] % 5)
    shards = -(-len(used) // SPEC.shard_rows)
    model, held = toxicity.fresh(SPEC), {}
    for turn in range(1 + SPEC.rounds):
        made = []
        for shard in range(shards if turn else 1):
            own, sums = copy.deepcopy((model, held))
            ids = [i for i in used if hashes[i]["h"] % shards == shard]
            toxicity.train([toxicity.words(SPEC).of(one[i][0]) for i in ids], np.array([one[i][1] for i in ids]), own, sums, 1 if turn else SPEC.epochs, SPEC.seed + turn)
            made.append(toxicity.changes(toxicity.parameters(model), own, sums))
        averaged = pa.concat_tables(made).to_pandas().groupby(["name", "place"], as_index=False).mean()
        toxicity.take(model, held, pa.Table.from_pandas(averaged, preserve_index=False))
    return shards, model


def test_rounds_over_shards_equal_rounds_by_hand(spark, rows, monkeypatch):
    """Rows are sent to their shards once: no later round's plan has an exchange by shard, and nothing stays kept."""
    docs = spark.createDataFrame(rows, SCHEMA)
    plans, kind = [], type(docs)
    first = kind.toArrow

    def seen(self):
        found = first(self)
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(kind, "toArrow", seen)
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"), SPEC)
    shards, want = by_hand(spark, rows)
    assert shards > 2
    for name, value in toxicity.parameters(model).items():
        np.testing.assert_allclose(value, toxicity.parameters(want)[name], rtol=1e-4, atol=1e-6, err_msg=name)
    rounds = [p for p in plans if "FlatMapGroupsInArrow" in p]
    assert len(rounds) == 1 + SPEC.rounds and not [p for p in rounds[1:] if "hashpartitioning(shard" in p]
    assert not [p for p in rounds if "avg(" in p]  # a line of changes is sent with one count, not with one for each number
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_one_shard_is_not_kept(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(type(docs), "persist", lambda *_: pytest.fail("one shard is read once"))
    assert toxicity.fit(docs, docs.select("doc_id", "toxic"), toxicity.Spec(word_rows=256, prefix_rows=64, epochs=1, least_steps=1)) is not None


def test_empty_tables_train_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert toxicity.fit(none, none.select("doc_id", "toxic"), SPEC) is None
