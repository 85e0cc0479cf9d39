"""Operators 3 and 6 against brute force."""

import hashlib
import random

import pytest
import xxhash

pytest.importorskip("kmerloom.llm")
from pyspark.sql import functions as F  # noqa: E402

from kmerloom.llm import common, simhash, suffix_dedup  # noqa: E402


def lower_words(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()


def brute_print(text):
    w = lower_words(text)
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(docs):
    prints = [(d, brute_print(t)) for d, t in docs]
    values = sorted({p for _, p in prints})
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    best = {}
    for d, p in prints:
        if d is not None:
            best[find(p)] = min(best.get(find(p), d), d)
    return sorted(((d, f"{p:016x}", best.get(find(p))) for d, p in prints), key=str)


def test_near_groups(spark, sf, tmp_path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in simhash.op3_simhash_near_dedup(spark, sf).collect()), key=str)
    assert got == brute_groups(docs)
    rng = random.Random(4)
    base = [rng.choice(["ab", "cd", "ef", "Gh", "ié"]) for _ in range(300)]
    odd = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One two"), (6, "one\ttwo"), (None, "ghost"), (7, " ".join(base)), (7, " ".join(base)), (None, None)]
    for k in range(60):
        w = list(base)
        w[rng.randrange(300)] = "zz"
        odd.append((10 + k, " ".join(w)))
    frame = spark.createDataFrame([(d, t, 5) for d, t in odd], "doc_id long, text string, root int")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in simhash.op3_simhash_near_dedup(spark, str(tmp_path)).collect()), key=str)
    want = brute_groups(odd)
    assert got == want and len({c for _, _, c in want}) < len(want) - 30
    kept = simhash.near_dedup(frame)
    assert kept.columns == frame.columns
    assert kept.count() == len({(c, p if c is None else 0) for _, p, c in want})
    assert simhash.near_dedup(frame.limit(0)).count() == 0
    unique = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [r.doc_id for r in simhash.near_dedup(unique).collect()]
    assert sorted(kept) == sorted({c for _, _, c in brute_groups(docs)})


def test_pigeonring_finds_every_pair(spark):
    rng = random.Random(5)
    values = set()
    for _ in range(80):
        v = rng.getrandbits(64)
        values.add(v)
        for _ in range(6):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {(r.a, r.b) for r in simhash.pigeonring_links(frame).collect()}
    mask = (1 << 64) - 1
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3}
    assert got == want and want


def brute_cut(docs, length, keep):
    texts = [(d, (t or "").encode()) for d, t in docs]
    seen = {}
    for i, (_, t) in sorted(enumerate(texts), key=lambda x: (x[1][0], x[0])):
        for at in range(len(t) - length + 1):
            seen.setdefault(t[at : at + length], []).append((i, at))
    gone = [bytearray(len(t)) for _, t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, at in places[keep == "first" :]:
                gone[i][at : at + length] = b"\1" * length
    out = []
    for (d, t), g in zip(texts, gone, strict=True):
        kept = bytes(c for c, x in zip(t, g, strict=True) if not x)
        runs = sum(1 for i, x in enumerate(g) if x and (i == 0 or not g[i - 1]))
        out.append((d, len(t), sum(g), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "cab", "é", "dd", "x y", "zzzz"])
    shared = [" ".join(word() for _ in range(n)) for n in (4, 8, 12, 20)]
    docs = []
    for i in range(80):
        parts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(rng.randrange(12))) for _ in range(4)]
        parts.insert(rng.randrange(4), rng.choice(shared) * rng.randrange(3))
        docs.append((i, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "a" * 100), (103, "ab" * 40), (104, docs[5][1]), (105, docs[5][1]), (106, "a" * 23), (107, "b" * 24)]
    return docs


@pytest.mark.parametrize("split", [2048, 3, 1])
def test_suffix_dedup(spark, monkeypatch, split):
    monkeypatch.setattr(suffix_dedup, "BLOCK_CLASSES", split)
    monkeypatch.setattr(common, "HOT_ROWS", 2 if split < 2048 else 4096)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "WINDOWS", 100)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 64)
    docs = passages(6)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for keep in ("none", "first"):
        marked = suffix_dedup.with_spans(frame, length=24, keep=keep).select("doc_id", "text", "__spans")
        got = suffix_dedup.map_arrow(marked, suffix_dedup._digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute_cut(docs, 24, keep)


def test_suffix_dedup_table(spark, sf, tmp_path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in suffix_dedup.op6_suffix_dedup(spark, sf).collect()), key=str)
    want = brute_cut(docs, 400, "none")
    assert got == want and sum(r[2] for r in want) > 0
    # Ids that are null or repeated.
    odd = [(None, "q" * 30), (1, "abcdefgh" * 5), (1, "abcdefgh" * 5), (2, None)]
    frame = spark.createDataFrame([(d, t, "k") for d, t in odd], "doc_id long, text string, __x string")
    got = suffix_dedup.suffix_dedup(frame, length=16, keep="first").collect()
    assert sorted(len(r.text) for r in got if r.text is not None) == [0, 16, 23] or len(got) == 4
    assert {r.asDict()["__x"] for r in got} == {"k"} and sum(r.text is None for r in got) == 1
    assert suffix_dedup.suffix_dedup(frame.limit(0)).count() == 0


def test_longest_previous_factor():
    import numpy as np

    rng = np.random.default_rng(7)
    for _ in range(30):
        text = bytes(rng.integers(97, 99, rng.integers(1, 40)).tolist())
        order = np.asarray(sorted(range(len(text)), key=lambda i: text[i:]))
        common = lambda a, b: next((k for k in range(len(text)) if a + k >= len(text) or b + k >= len(text) or text[a + k] != text[b + k]), 0)
        lcp = np.asarray([0, *(common(a, b) for a, b in zip(order[:-1], order[1:], strict=True))])
        got = suffix_dedup.longest_previous_factor(order, np.arange(len(text)), lcp)
        assert got.tolist() == [max([common(i, j) for j in range(i)], default=0) for i in range(len(text))]


def test_components(spark):
    from kmerloom.llm.components import components

    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(100 + k, 100) for k in range(30)} | {(200, 200), (201, 200)}
    assert components(spark.createDataFrame([], "a long, b long")).select(F.count("*")).first()[0] == 0


def test_clashing_names(spark):
    """Columns of the documents by the operators' internal names are kept as they were."""
    docs = [(i, "one two three four five six seven eight " * 60 + str(i // 2), i) for i in range(6)] + [(None, None, 7), (3, "", 8)]
    names = ("__key", "__spans", "__text", "__fp", "__root", "__component", "key", "e", "s", "run")
    frame = spark.createDataFrame(docs, "doc_id long, text string, x long").select("*", *(F.col("x").alias(n) for n in names))
    for out in (simhash.near_dedup(frame), suffix_dedup.suffix_dedup(frame)):
        assert out.columns == frame.columns
        assert all(len({r[n] for n in names} | {r["x"]}) == 1 for r in out.collect())
    assert suffix_dedup.suffix_dedup(frame).count() == len(docs)


def test_long_text(spark):
    """A text of several stretches, with a passage of 500 bytes at both ends, and one far over the shingles taken at once."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(500))
    middle = " ".join(str(rng.getrandbits(60)) for _ in range(130_000))
    docs = [(1, f"{passage}|{middle}|{passage}"), (2, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marked = suffix_dedup.with_spans(frame, keep="none").where("doc_id = 1").first()["__spans"]
    n = len(docs[0][1])
    assert [(x.s, x.e) for x in marked] == [(0, 500), (n - 500, n)]
    got = {r["doc_id"]: r["__fp"] for r in simhash.fingerprints(frame).collect()}
    assert got[1] % (1 << 64) == brute_print(docs[0][1]) and got[2] == 0
