"""Operator 12 against SQL and a plain tree."""

import hashlib
import zlib

import duckdb
import pytest

pytest.importorskip("kmerloom.llm")
from kmerloom.llm import merkle  # noqa: E402

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(digests):
    """Root, and each one's siblings as (left, right) level by level."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, p in enumerate(paths):
            run = at[i] // 8 * 8
            p.append(("".join(level[run : at[i]]), "".join(level[at[i] + 1 : run + 8])))
            at[i] //= 8
        level = [sha("".join(level[j : j + 8])) for j in range(0, len(level), 8)]
    return level[0], paths


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((mine, *climb([leaf(r) for r in mine])))
    root, tops = climb([t[1] for t in trees])
    out = []
    for (mine, sub, paths), top in zip(trees, tops, strict=True):
        for r, path in zip(mine, paths, strict=True):
            whole = path + top
            bad = r[4] is not None and zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 3 == 0
            acc = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if bad else leaf(r)
            for a, b in whole:
                acc = sha(a + acc + b)
            out.append((r[0], leaf(r), sub, root, sha("".join(a + b for a, b in whole)), acc, acc == root))
    return sorted(map(str, out))


def run(spark, tmp_path, rows, name, extra=False):
    frame = spark.createDataFrame(rows, SCHEMA)
    if extra:
        frame = frame.selectExpr("*", "1 as key", "2 as rank", "'x' as `a.b`", "struct(1 as `a b`) as digest")
    frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    return merkle.op12_merkle_manifest(spark, f"{tmp_path}/{name}")


ODD = [(i, None if i % 5 == 0 else f"s{i % 3}", (None, "en", "de", "é", "z")[i % 5 if i % 7 else 1], i if i % 4 else None, (None, "", "Abc É", "x" * 5000, "plain")[i % 5]) for i in range(700)]
ODD += [(None, "s", "en", 1, "No id"), (None, "s", "en", 1, "No id"), (3, "t", "en", 3, "same id"), (4, None, "solo", None, "A")] + [(9, "c", "en", 1, "Copy")] * 300


@pytest.mark.parametrize("levels", [3, 1])
def test_against_a_plain_tree(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)  # one level: several tiers
    monkeypatch.setattr(merkle, "BLOCK", 8**levels)
    for name, rows in (("odd", ODD), ("one", [(7, "s", "en", 1, "A")]), ("nine", [(i, "s", "en", 1, "b") for i in range(9)])):
        got = run(spark, tmp_path, rows, name, extra=True).collect()
        assert sorted(map(str, map(tuple, got))) == plain(rows), name
    assert run(spark, tmp_path, [], "none").count() == 0


def test_sql(spark, tmp_path, sf):
    for where in (sf, None):
        if where is None:
            where = f"{tmp_path}/odd"
            got = run(spark, tmp_path, ODD, "odd")
        else:
            got = merkle.op12_merkle_manifest(spark, where)
        con = duckdb.connect()
        con.sql(f"create view documents as select * from read_parquet('{where}/documents.parquet{'' if where == sf else '/*.parquet'}')")
        want = con.sql(merkle.OP12_SQL)
        assert got.columns == want.columns
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_proofs_hold_only_for_their_leaf(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "ab"[i % 2], f"t{i}") for i in range(100)], "`my.id` int, g string, text string")
    rows = merkle.manifest(docs, ["my.id", "text"], "my.id", "g")
    ok = rows.select("id", (merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("own"), (merkle.folded(F.sha2("leaf", 256), F.col("path")) == F.col("root")).alias("other"))
    assert {(r.own, r.other) for r in ok.collect()} == {(True, False)} and rows.count() == 100
