"""Operator 1 against a brute-force search."""

import hashlib
import random
import re

import pytest

pytest.importorskip("kmerloom.llm")
from kmerloom.llm import decontam  # noqa: E402

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def brute(docs, items):
    windows = {}
    for i, text in items:
        w = words(text)
        for at in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[at : at + 13]), set()).add(i)
    lengths = sorted({len(w) for w in windows})
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for at in range(len(w) - n + 1):
                if (key := tuple(w[at : at + n])) in windows:
                    hit |= set(range(at, at + n))
                    found |= {str(i) for i in windows[key] if i is not None}
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_small_cases(spark, tmp_path):
    rng = random.Random(3)
    vocab = ["ab", "Ab", "c", "é", "dd9", "x"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "-"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 5, 13, 14, 30]))) for i in range(12)] + [(90, None), (91, ""), (None, text(20)), (3, text(15)), (92, "rare " * 3)]
    docs = [(i, text(rng.choice([0, 3, 40, 200]))) for i in range(60)]
    docs += [(100 + k, f"{text(9)} {t} {text(k * 30)}") for k, (_, t) in enumerate(items) if t] + [(300, None), (301, ""), (302, items[4][1]), (302, items[4][1])]
    spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n_hit int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = decontam.op1_decontamination(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = decontam.decontaminate(frame, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert kept.columns == frame.columns and kept.count() == sum(not r[5] for r in brute(docs, items))
    assert decontam.find_matches(frame.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_blocks_and_table(spark, sf, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute(docs, items)
    assert any(r[5] for r in want)
    assert sorted((tuple(r) for r in decontam.op1_decontamination(spark, sf).collect()), key=str) == want
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 4000)
    assert sorted((tuple(r) for r in decontam.op1_decontamination(spark, sf).collect()), key=str) == want


def test_locations(spark):
    w = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, "p q " + " ".join(w[5:30]) + " r")], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(w))], "item_id long, text string")
    (m,) = decontam.find_matches(docs, items).first()["__matches"]
    assert (m.item_id, m.doc_start, m.item_start, m.words) == ("7", 2, 5, 25)


def test_clashing_names_and_long_text(spark, monkeypatch):
    w = [f"w{i}" for i in range(40)]
    long = " ".join(f"x{i % 977}" for i in range(300_000))
    rows = [(1, " ".join(w[5:30]), 1), (2, f"{long} {' '.join(w)} {long}", 2), (3, "", 3), (None, None, 4)]
    names = ("__spans", "__words", "__matches", "__key", "k", "m", "h")
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").select("*", *(decontam.F.col("n").alias(x) for x in names))
    items = spark.createDataFrame([(7, " ".join(w)), (8, long[:3000])], "item_id long, text string")
    for size in (8 << 20, 1000):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        kept = decontam.decontaminate(docs, items)
        assert kept.columns == docs.columns and sorted(r["n"] for r in kept.collect()) == [3, 4]
        assert all({r[x] for x in names} == {r["n"]} for r in kept.collect())
