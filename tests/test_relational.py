"""The relational descent where reads stand against the tables' one, and its queries where ids repeat."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.functions.names import LEVELS
from kmerloom.operators import kernel, profile, relational, windows
from kmerloom.plans import registry

K = 3


@pytest.mark.parametrize("threshold", [0.6, 0.2])
@pytest.mark.parametrize("held", [0, 1 << 22])
def test_reads_descend_as_in_tables(spark, monkeypatch, threshold, held):
    """Names with several parents, equal scores, reads without k-mers and a low threshold, at which several children are active."""
    monkeypatch.setattr(relational, "HELD", held)
    rng = random.Random(6)
    texts = ["".join(rng.choice("acgtacgtxyz ") for _ in range(rng.choice([20, 80, 200]))) for _ in range(60)] + ["a" * 80, ""]
    rows = [(i, t, *(f"{level}{rng.randrange(2 + n)}" for n, level in enumerate(LEVELS))) for i, t in enumerate(texts)]
    rows += [(100, "ccccgggg" * 12, "domain0", "phylumA", "group0", "order0", "family0"), (101, "ccccgggg" * 12, "domain0", "phylumB", "group0", "order0", "family1")]
    docs = spark.createDataFrame(rows, f"read_id long, text string, {', '.join(f'`{name}` string' for name in LEVELS)}").cache()
    seq = registry.fs.derived_sequence(F.col("text"))
    packed = relational.vectors(profile.with_codes(profile.kmer_profile(windows.windows(docs.select("read_id", seq.alias("seq")), 30, 5), ["read_id", "win_idx"], K, [1] * K)), ["read_id", "win_idx"], K)
    source = kernel.Texts("plain", 30, 5)
    leaf = relational.leaf_sums(packed.join(docs, "read_id"))
    mine = relational.leaf_sums_in_rows(docs, source, K)
    assert sorted(map(tuple, leaf.collect())) == sorted(map(tuple, mine.collect()))
    weights = relational.node_weights(leaf, K).checkpoint(eager=True)
    want = relational.descend(packed, weights, threshold)
    got = relational.descend_in_rows(docs, source, weights, threshold, K)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.where("level_idx = 4").count()


def test_a_window_meets_its_parents_scores_once():
    """Ties go to the first name; a read with no window has no votes."""
    nodes = {(0, "Root"): (["a", "b"], np.array([[1.0, 1.0], [0.0, 2.0]])), (1, "b"): (["c"], np.ones((2, 1)))}
    got = [(i, p, who.tolist(), child, votes.tolist()) for i, p, who, child, votes in relational._voted(nodes, np.array([0, 0, 1]), np.array([[1.0, 0], [0, 1], [0, 1]]), 0.5)]
    assert got == [(0, "Root", [0, 0, 1], ["a", "b", "b"], [1, 1, 1]), (1, "b", [1], ["c"], [1])]


@pytest.mark.parametrize("name", ["m5_descent_relational", "p3_flows", "a10_totals", "j5_endpoints", "j6_hierarchy", "p3_flows_accepted", "k5_taxon_counts", "k3_report"])
def test_texts_are_counted_where_they_stand(spark, sf, monkeypatch, name):
    """No query explodes its k-mers into rows."""
    monkeypatch.setattr(profile, "kmer_profile", None)
    assert registry.QUERIES[name](spark, sf).count()


def test_repeated_ids_take_the_tables(spark, sf, monkeypatch, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(map(tuple, registry.m5(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(registry, "own_ids", lambda *_: False)
    assert want == sorted(map(tuple, registry.m5(spark, str(tmp_path)).collect()))
