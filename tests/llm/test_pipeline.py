"""The pipeline's stages, each on its own input, against plain Python; and the pipeline as a whole."""

import re

import numpy as np
import pytest

import corpus_pipeline
from reelspark.llm import mixing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, extra string, kept string, score double, mix_slot int"


def sentence(rng, words, n):
    return " ".join(rng.choice(words, n)).capitalize() + "."


@pytest.fixture(scope="session")
def corpus(spark):
    rng = np.random.default_rng(11)
    spoken = {"en": ["the", "and", "house", "river", "with", "that", "wind", "hill", "boat", "stone", "water", "which", "through"], "de": ["der", "und", "nicht", "schön", "straße", "über", "zwischen", "jahr", "wurde", "fluss", "hügel", "doch"]}
    rows = []
    for i in range(240):
        lang = "en" if i % 3 else "de"
        words = [f"{w}{x}" for w in spoken[lang] for x in ("", "a", "en", "er", "ing")]
        text = "\n".join(sentence(rng, words, int(rng.integers(14, 40))) for _ in range(4))
        rows.append([i, text, lang if i % 5 else None, "hot" if i % 3 == 0 else f"s{i % 4}", len(text), "x", "k", 0.5, 7])
    for i in range(240, 280):  # near copies of the first ones
        rows.append([i, rows[i - 240][1] + " Added.", "en", None, 9, None, None, None, None])
    menu = "\n".join(f"Home | News | Sport | {k}" for k in range(30))
    rows += [[300, None, None, None, None, None, None, None, None], [301, "", "en", "s1", 0, "", "", 0.0, 0], [302, menu, "en", "s1", 3, "", "", 0.0, 0], [303, "12 34 56. " * 30, "en", "s1", 3, "", "", 0.0, 0]]
    rows += [rows[3], rows[3], [None, *rows[4][1:]], [None, *rows[4][1:]], [400, " ".join(f"word{k % 977}x{k % 31}" for k in range(40_000)) + ".", "en", "s2", 1, "", "", 0.0, 0]]
    return spark.createDataFrame([tuple(r) for r in rows], COLUMNS)


def brute_groups(rows, size=5):
    """The smallest id that can be reached by pairs of at least 80 % similarity."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = {i: i for i in sets}
    for _ in sets:
        before = dict(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    return root


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_near_copies_with_clashing_names(spark):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, text, 5, 6, "x"), (2, text + " more", 5, 6, "y"), (3, "other words", 1, 2, "z"), (3, "other words", 0, 2, "z"), (None, "n", 1, 1, "n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept_id long, kept_rows long, c0 string")
    got = corpus_pipeline.near_copies(spark, frame, "")
    assert got.columns == frame.columns and rows_of(got) == sorted([rows[0], rows[3], rows[4]], key=repr)


def test_quality_stage(corpus, spark):
    got = corpus_pipeline.quality(spark, corpus, "")
    assert got.columns == corpus.columns
    ids = [r.doc_id for r in got.collect()]
    assert not {300, 301, 302, 303} & set(ids) and ids.count(3) == 3 and {*range(280), 400} <= set(ids)
    assert {r.doc_id: r.text for r in got.collect()}[5] == {r.doc_id: r.text for r in corpus.collect()}[5]
    assert corpus_pipeline.quality(spark, corpus.where("false"), "").count() == 0


def test_language_stage(corpus, spark):
    got = corpus_pipeline.language(spark, corpus, "")
    assert got.columns == corpus.columns
    assert rows_of(got) == [r for r in rows_of(corpus) if r[1] and any(c.isalpha() for c in r[1])]
    assert corpus_pipeline.language(spark, corpus.where("false"), "").count() == 0


def test_near_dedup_stage(corpus, spark):
    got = corpus_pipeline.near_copies(spark, corpus, "")
    known = {(r.doc_id, r.text) for r in corpus.collect() if r.doc_id is not None and r.doc_id != 400}
    root = brute_groups(known)
    want = {i for i, r in root.items() if i == r} | {400}
    ids = [r.doc_id for r in got.collect()]
    assert got.columns == corpus.columns and ids.count(None) == 2
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert corpus_pipeline.near_copies(spark, corpus.where("false"), "").count() == 0


def test_mixing_stage(corpus, spark):
    got = corpus_pipeline.mixed(spark, corpus, "")
    assert got.columns == corpus.columns and rows_of(got) == rows_of(corpus)
    assert corpus_pipeline.mixed(spark, corpus.where("false"), "").count() == 0


@pytest.mark.parametrize("run_rows", [16, 64, 10_000])
def test_arranged_rows_are_in_the_order_of_the_mix(spark, run_rows):
    frame = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN null ELSE cast(id % 5 AS string) END AS source")
    spec = mixing.Spec(block_rows=4, range_rows=200, run_rows=run_rows)
    places = {r.doc_id: (r.mix_slot, r.mix_place) for r in mixing.mix(frame, ["doc_id"], spec=spec).collect()}
    parts = [[r.doc_id for r in p] for p in mixing.arranged(frame, ["doc_id"], spec=spec).rdd.glom().collect()]
    assert sorted(i for p in parts for i in p) == list(range(3000))
    run_of = lambda i: places[i][0] * 4 // run_rows
    seen = []
    for p in parts:
        assert [(run_of(i), places[i]) for i in p] == sorted((run_of(i), places[i]) for i in p)
        seen += {run_of(i) for i in p}
    assert len(seen) == len(set(seen))  # no run is in two partitions


def test_arranged_repeated_rows(spark):
    frame = spark.createDataFrame([(i % 3, "s" if i % 2 else None) for i in range(100)], "doc_id long, source string")
    got = mixing.arranged(frame, ["doc_id"], spec=mixing.Spec(block_rows=2, range_rows=10, run_rows=8))
    assert rows_of(got) == rows_of(frame)


def pieces_join(pieces, want):
    """Whether the pieces make up the wanted ids of each document, and each sequence has no gap."""
    for doc_id, ids in want.items():
        own = sorted((r for r in pieces if r.doc_id == doc_id), key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == ids and [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
    by = {}
    for r in pieces:
        assert len(r.ids) == 4 * r.length
        by.setdefault(r.sequence_id, []).append(r)
    for found in by.values():
        found.sort(key=lambda r: r.offset)
        assert [r.offset for r in found] == [0, *np.cumsum([r.length for r in found])[:-1]] and sum(r.length for r in found) <= 2048


def test_packing_stage_and_whole(corpus, spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    ids_of = lambda t: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
    some = corpus.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    pieces_join(corpus_pipeline.packed(spark, some, "").collect(), {r.doc_id: ids_of(r.text) for r in some.collect()})

    corpus.write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = {(r.doc_id, r.text) for r in corpus.collect() if r.doc_id is not None and r.text and re.search("[^|0-9 .]", r.text) and "Home |" not in r.text}
    root = brute_groups(d for d in docs if d[0] != 400)
    kept = {i for i, r in root.items() if i == r} | {400}
    pieces_join(pieces, {i: ids_of(t) for i, t in docs if i in kept})
    assert {r.doc_id for r in pieces} == kept | {None}
    corpus.where("false").write.mode("overwrite").parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
