"""Probabilities at the border between two whole numbers are the SQL's."""

import duckdb
import numpy as np

from kmerloom.plans import registry
from test_queries import value


def test_products_near_a_half_round_as_in_sql(spark, tmp_path):
    rng = np.random.default_rng(5)
    near = ((np.arange(-300, 300) + 0.5) / 1000).astype(np.float32)
    rows = [[float(x) for x in rng.choice(near, 64)] for _ in range(200)]
    frame = spark.createDataFrame([(i, r, 0) for i, r in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    frame.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("e13_clamp", "e10_delta_mean", "e11_min_max"):
        got = registry.QUERIES[name](spark, str(tmp_path))
        columns = ", ".join(got.columns)
        want = con.sql(f"select {columns} from ({registry.ORACLE[name]})").fetchall()
        assert sorted(tuple(map(value, r)) for r in got.collect()) == sorted(tuple(map(value, r)) for r in want)
