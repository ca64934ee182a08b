"""Every query of the catalogue at the smallest scale against its SQL."""

import os
from datetime import datetime

import numpy as np
import pytest

from kindred.operators import sgd
from kindred.plans import catalogue
from plain import fold_loop

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(None if x != x else (float(x) if isinstance(x, float) else x) for x in r) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    if name not in catalogue.oracle_sql():
        assert len(got)
        return
    want = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_sgd_fold_takes_all_events(spark, tmp_path):
    rng = np.random.default_rng(11)
    n = 2500
    users, posts, errors = rng.integers(0, 40, n), rng.integers(0, 60, n), rng.random(n) < 0.3
    users[-1], posts[-1] = 40, 60  # met by the last event only
    ev = [(i, datetime(2023 + i % 3, 1, 1), int(u), "error" if e else "click", f'{{"k": {p}}}') for i, (u, p, e) in enumerate(zip(users, posts, errors))]
    spark.createDataFrame(ev, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, props string").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    vecs = [np.stack([sgd.start_vector(kind, k, 64, 42) for k in range(size)]) for kind, size in enumerate((41, 61))]
    fold_loop(*vecs, users, posts, np.where(errors, -1, 1), 0.01, 0.001, 10.0)
    want = {(name, k): np.linalg.norm(v.astype(np.float64)) for name, vs in zip(("user", "post"), vecs) for k, v in enumerate(vs)}
    got = {(r.kind, r.id): r.norm for r in catalogue.q_sgd_fold(spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 6
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
