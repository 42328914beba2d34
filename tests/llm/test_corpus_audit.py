"""Filter audit, removal of repeated passages and clustering, against loops written from their definitions."""

import hashlib
from itertools import permutations

import duckdb
import numpy as np
import pytest

from reelspark.llm import elkan_clusters, filter_audit, suffix_dedup

SF = "/root/testdata/sf0.001"
AUDIT = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def by_name(rows, columns):
    return sorted(tuple(getattr(r, c) for c in columns) for r in rows)


@pytest.mark.parametrize("module,name,tables", [(filter_audit, "op11_filter_audit", "documents labels"), (elkan_clusters, "op13_centroid_clusters", "embeddings")])
def test_query_equals_sql(spark, module, name, tables):
    con = duckdb.connect()
    for t in tables.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(module.ORACLE[name]).df()
    got = module.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert by_name(got.itertuples(), got.columns) == by_name(want.itertuples(), got.columns)


def audit_loops(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    found, first = {}, {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = []
    for i, t, lang in docs:
        t, words = t or "", (t or "").split()
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t]}
        rows.append((lang or "", fails, any(a is not None and a == i and q == 1 for a, q, _ in labels), any(a is not None and a == i and x == 1 for a, _, x in labels)))
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        totals = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                later = [r for r in own if r[1][f] and not any(r is x for x in left)]
                left = [r for r in left if not r[1][f]]
                totals[f] += len(gone)
                found[part, order, step] = [len(left), len(gone), len(later), sum(r[1][f] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
        for key, row in found.items():
            if key[0] == part:
                row[-1] = totals[row[-1]]
    return found


def test_filter_audit_equals_loops(spark):
    rng = np.random.default_rng(4)
    pool = [" ".join(rng.choice(["aa", "bb", "CC", "d#", "EEEE"], n)) for n in (1, 3, 120)] + [" ".join(f"w{k}" for k in range(n)) for n in (40, 130)] + ["", None, "A", "x\ty\x0bz"]
    docs = [(int(rng.integers(0, 30)) if rng.random() > 0.1 else None, pool[rng.integers(len(pool))], [None, "", "en", "de"][rng.integers(4)]) for _ in range(60)]
    labels = [(int(rng.integers(0, 30)), [0, 1, None][rng.integers(3)], [0, 1, None][rng.integers(3)]) for _ in range(25)] + [(None, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, lang string, mask int, n int")  # names that clash
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for limit in (1000, 0):
        got = filter_audit.audited(filter_audit.histograms(frame, told, broadcast_rows=limit)).collect()
        assert {tuple(r[:3]): list(r[3:]) for r in got} == audit_loops(docs, labels)
    assert filter_audit.audited(filter_audit.histograms(frame.where("false"), told)).count() == 0
    assert {r.good_lost for r in filter_audit.audited(filter_audit.histograms(frame, told.where("false"))).collect()} == {0}


def passages_loops(docs, length, marks=None):
    """docs: (doc_id, text), marks: what orders texts of one doc_id; spans and kept bytes of each."""
    first = {}
    bodies = [((1 << 63) - 1 if i is None else i, (t or "").encode(), m) for (i, t), m in zip(docs, marks or [0] * len(docs))]
    for i, b, m in bodies:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, (i, p, m)), (i, p, m))
    found = []
    for i, b, m in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if (i, p, m) > first[b[p : p + length]]:
                gone[p : p + length] = True
        edge = np.diff(np.concatenate([[0], gone[:-1].astype(int), [0]])) if len(b) else np.zeros(1, int)
        found.append((list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())), bytes(np.frombuffer(b, np.uint8)[~gone[:-1]]) if b else b""))
    return found


def planted(rng, n, length):
    letters = list("abcdefghij éß\x00\n")
    word = lambda k: "".join(rng.choice(letters, k))
    passages = [word(int(k)) for k in rng.integers(length // 2, 4 * length, 5)]
    texts = [None, "", "a" * (3 * length), "ab" * length, "a" * (length - 1), word(length), word(3 * length) * 3]
    for _ in range(n):
        parts = [passages[rng.integers(5)] if rng.random() < 0.4 else word(int(rng.integers(1, 2 * length))) for _ in range(rng.integers(1, 6))]
        texts.append("".join(parts))
    texts += [texts[k] for k in rng.integers(7, len(texts), n // 4)]
    texts += [texts[-1][:-3] + "z", texts[-2] + "z"]
    found = [(None if rng.random() < 0.05 else int(rng.integers(0, len(texts))) if rng.random() < 0.2 else k, t) for k, t in enumerate(texts)]
    return [*found, *((i, t + "z") for i, t in found[10:20])]  # two texts of one doc_id


@pytest.mark.parametrize("length,most", [(20, 4096), (20, 2), (100, 4096), (7, 3), (100, 1)])
def test_passages_equal_loops(spark, length, most):
    rng = np.random.default_rng(length + most)
    docs = planted(rng, 60, length)
    frame = spark.createDataFrame([(k, i, t, "x", "y") for k, (i, t) in enumerate(docs)], "row int, doc_id long, text string, kept string, spans string")
    got = {r.row: r for r in suffix_dedup.without_repeats(frame, ["row", "doc_id", "kept"], length=length, most=most).collect()}
    marks = [r.m for r in frame.selectExpr("row", "hash(CAST(coalesce(text, '') AS BINARY)) AS m").orderBy("row").collect()]
    want = passages_loops(docs, length, marks)
    for k in range(len(docs)):
        assert ([tuple(s) for s in got[k].spans], bytes(got[k].kept)) == want[k], (k, docs[k])
        assert (got[k].doc_id, got[k].kept_input) == (docs[k][0], "x")
    assert suffix_dedup.without_repeats(frame.where("false"), ["doc_id"]).count() == 0


def test_merged_transforms_equal_sorted_suffixes():
    rng = np.random.default_rng(9)
    for length in (5, 12, 20):
        strings = [bytes(rng.choice(list(b"ab"), int(k)).astype(np.uint8)) for k in rng.integers(length, 60, 30)]
        parts = [strings[k : k + 7] for k in range(0, 30, 7)]
        shard, string, offset, interval = suffix_dedup.merged([suffix_dedup.Shard(p, length, suffix_dedup.step_of(length)) for p in parts], length)
        rows = [parts[a][b][c : c + length] for a, b, c in zip(shard, string, offset)]
        assert rows == sorted(s[p : p + length] for s in strings for p in range(len(s) - length + 1))
        assert [a == b for a, b in zip(rows, rows[1:])] == (np.diff(interval) == 0).tolist()


def test_query_of_passages_on_the_given_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in suffix_dedup.op12_suffix_dedup(spark, SF).collect()}
    assert len(got) == len(docs)
    for (i, t), (spans, kept) in zip(docs, passages_loops(docs, 100)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len((t or "").encode()), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())


def clusters_loops(vectors, k, rounds):
    """vectors: (id, integers); number of the centroid and squared distance of each, in exact Python integers."""
    order = sorted(vectors, key=lambda x: (x[0] is None, hashlib.sha256(f"3:{x[0]}".encode()).hexdigest(), x[1]))
    centroids = [v for _, v in order[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((apart(v, c), j) for j, c in enumerate(centroids))[::-1]
    for _ in range(rounds):
        own = [nearest(v)[0] for _, v in vectors]
        for j in range(len(centroids)):
            mine = [v for (_, v), c in zip(vectors, own) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return [nearest(v) for _, v in vectors], centroids


@pytest.mark.parametrize("spread,n", [(0.004, 120), (1.0, 200), (60_000.0, 60), (1.0, 5)])
def test_clusters_equal_loops(spark, spread, n):
    """Small spreads make many ties."""
    rng = np.random.default_rng(n)
    rows = [(k if k % 17 else None, [float(np.float32(x)) for x in rng.normal(0, spread / 4, 64).clip(-spread, spread)]) for k in range(n)]
    rows += rows[: n // 4] + [(999, rows[0][1])]
    bad = [(1000, None), (1001, [1.0] * 63), (1002, [None] + [1.0] * 63), (1003, [float("nan")] * 64), (1004, [float("inf")] + [0.0] * 63), (1005, [])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in [*rows, *bad]], "vec_id long, embedding array<double>, cluster string, v int")
    vectors = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    want, centres = clusters_loops(vectors, 8, 10)
    found, centroids = elkan_clusters.clustered(frame, ["vec_id", "cluster"])
    got = found.collect()
    assert centroids == centres and {r.cluster_input for r in got} == {"x"}
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got) == sorted((str(i), *w) for (i, _), w in zip(vectors, want))
    none, centroids = elkan_clusters.clustered(frame.where("vec_id >= 1000"), ["vec_id"])
    assert (none.count(), centroids) == (0, [])


def test_clusters_skip_distances(spark):
    rng = np.random.default_rng(2)
    frame = spark.createDataFrame([(k, [float(x) for x in rng.normal(3 * (k % 8), 0.1, 64)]) for k in range(400)], "vec_id long, embedding array<double>")
    computed = elkan_clusters.clustered(frame, ["vec_id"])[0].agg({"computed": "sum"}).first()[0]
    assert computed < 0.35 * 400 * 8 * 11
    with pytest.raises(Exception, match="2\\^17"):
        elkan_clusters.clustered(spark.createDataFrame([(1, [1e6] * 64)], "vec_id long, embedding array<double>"), ["vec_id"])
