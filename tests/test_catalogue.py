import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from reelspark.plans import catalogue
from reelspark.plans.bridge import view

SF = "/root/testdata/sf0.001"
TABLES = "lineitem embeddings part events".split()


def rows(frame: pd.DataFrame) -> list:
    plain = lambda x: None if pd.isna(x) else float(x) if isinstance(x, (int, float)) or hasattr(x, "__index__") else str(x)
    return sorted(repr(tuple(plain(x) for x in r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(catalogue.oracle_sql()[name]).df()
    got = catalogue.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_selection_respects_quotas(spark):
    got = catalogue.queries()["curate_select"](spark, SF).toPandas()
    assert (got.groupby("pool")["rank"].max() == got.groupby("pool").size()).all()
    assert not got.duplicated(["pool", "id"]).any()


def test_mmr_equals_loops(spark):
    got = catalogue.queries()["mmr_order"](spark, SF).toPandas()
    vecs = view(spark, SF, "v_vec").toPandas()
    for scene, g in vecs.groupby("scene_hint"):
        left = {r.id: (r.q, np.array(r.embedding, np.float64)) for r in g.sort_values("id").itertuples()}
        want, picked = [], []
        while left and len(want) < 10:
            worth = {i: 0.75 * q - 0.25 * max([0.0, *[float(p @ v) for p in picked]]) for i, (q, v) in left.items()}
            best = max(worth, key=lambda i: (worth[i], -i))
            want.append(best)
            picked.append(left.pop(best)[1])
        assert list(got[got.scene_hint == scene].sort_values("rank")["id"]) == want
