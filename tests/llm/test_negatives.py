"""Operator 13 against SQL and bounds against exact scores."""

import random

import duckdb
import numpy as np
import pytest

pytest.importorskip("kmerloom.llm")
from kmerloom.llm import negatives as n  # noqa: E402


def both(spark, where, files=""):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{where}/embeddings.parquet{files}')")
    want = con.sql(n.OP13_SQL)
    got = n.op13_hard_negatives(spark, where)
    assert got.columns == want.columns
    return sorted(map(tuple, got.collect())), sorted(want.fetchall())


def test_sql(spark, sf):
    for where in (sf, "/root/testdata/sf0.1"):
        got, want = both(spark, where)
        assert got == want and len(got) > 100


def odd(rng, count):
    rows = []
    for i in range(count):
        vec = [rng.choice([-0.5, 0.25, 1.0, rng.random()]) for _ in range(rng.choice([20, 20, 20, 3, 0]))]
        rows.append([i % 450, vec, rng.randrange(3), "x"])
    for at, vec in ((3, None), (5, [None, 1.0]), (6, [float("nan")]), (8, [float("inf"), 1.0]), (9, [-float("inf")])):
        rows[at][1] = vec
    rows[11][2], rows[12][0] = None, None
    return [tuple(r) for r in rows + [rows[20]] * 40]


def test_odd_rows(spark, tmp_path, monkeypatch):
    rows = odd(random.Random(3), 700)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, `row` string").repartition(3)
    frame.write.parquet(f"{tmp_path}/odd/embeddings.parquet")
    for per in (8 << 20, 3 * 32 * 8):  # one block, and several
        monkeypatch.setattr(n, "ANCHOR_BYTES", per)
        monkeypatch.setattr(n, "ANCHOR_CHUNK", 2)
        got, want = both(spark, f"{tmp_path}/odd", "/*.parquet")
        assert got == want and got
    frame.limit(0).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert n.op13_hard_negatives(spark, f"{tmp_path}/none").count() == 0
    assert n.hard_negatives(n.prepared(frame, "vec_id", "label", "embedding"), n.F.col("id") == -1).count() == 0


@pytest.mark.parametrize("spread", [1, 0.1, 1e4])
def test_bounds_lose_nothing(spread):
    rng = np.random.default_rng(4)
    side = lambda v: n.Side(v, *n.summary(v))
    a, x = (np.floor(spread * (rng.normal(size=(m, 1)) * 200 + rng.normal(size=(m, 64)) * 60)) for m in (40, 500))
    exact, allowed = a @ x.T, rng.random((40, 500)) < 0.7
    for share in (0.5, 0.99):
        low, high = np.quantile(exact, share, axis=1), np.quantile(exact, min(1, share + 0.3), axis=1)
        i, j, score = n.candidates(side(a), side(x), allowed, low, high)
        want = allowed & (exact >= low[:, None]) & (exact <= high[:, None])
        assert set(zip(i, j, strict=True)) == set(zip(*np.nonzero(want), strict=True)) and (score == exact[i, j]).all()
    i, j, score = n.candidates(side(a), side(x), allowed, np.full(40, -np.inf), np.full(40, np.inf), best=5)
    for row in range(40):
        top = np.sort(np.where(allowed[row], exact[row], -np.inf))[-5:]
        assert (np.sort(score[i == row])[-5:] == top).all() and len(i) < allowed.sum()


def test_scores_beyond_64_bits(spark):
    frame = spark.createDataFrame([(0, [3e38], 1), (1, [3e38], 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="64 bits"):
        n.hard_negatives(n.prepared(frame, "vec_id", "label", "embedding"), n.F.col("id") == 0).count()
