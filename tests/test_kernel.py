"""The counter within a row against the plain models and the tables' counter."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.operators import kernel, profile, windows
from test_functions import model_counter


def words_of(r):
    return [bytes(w).decode() for w in r.words.spelled(r.code)]


def block(texts):
    length = np.array([len(t) for t in texts])
    padded = b"".join(t.encode().ljust(int(length.max()), b"\xff") for t in texts)
    return np.frombuffer(padded, np.uint8).reshape(len(texts), -1), length


def spell(rank, k):
    return "".join("ACGT"[rank >> 2 * (k - 1 - i) & 3] for i in range(k))


@pytest.mark.parametrize("semantics", ["reference", "clean"])
@pytest.mark.parametrize("mask", [[1, 1, 1, 1], [1, 1, 0, 1, 1], [1, 0, 1, 1], [1] * 9, [1, 0, 1, 1, 0, 1, 1, 1, 0, 1]])
@pytest.mark.parametrize("letters", ["ACGT", "ACGTURYKMSWBVDHN"])
def test_profile_against_a_model(mask, semantics, letters):
    rng, k = random.Random(len(mask)), sum(mask)
    texts = ["".join(rng.choice("ACGT" * 4 + letters) for _ in range(rng.choice([3, 6, 12, 60]))) for _ in range(60)] + ["A" * 40, "T" * 12]
    if k > 6:  # few ambiguous letters: each stands for several
        texts = [t.translate(str.maketrans("RYKMSWBVDHN", "ACGTACGTACG")) for t in texts]
    want = [model_counter(t, k, mask, semantics) for t in texts]
    got = [{} for _ in texts]
    wins, length = block(texts)
    for row, rank, cnt in zip(*kernel.profiled(wins, length, mask, semantics), strict=True):
        got[row][spell(int(rank), k)] = int(cnt)
    assert got == want


@pytest.mark.parametrize("semantics", ["reference", "clean"])
def test_every_step_is_the_tables(spark, semantics):
    rng = random.Random(3)
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([5, 7, 50]))) for letters in ("ACGT", "ACGTURYN", "AU") for _ in range(10)]
    wins, length = block(texts)
    frame = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(texts)], "id int, win binary")
    for pattern in ([1, 1, 1, 1], [1, 1, 0, 1, 1]):
        r = kernel.counted(wins, length, len(pattern), semantics)
        table = profile.count_kmers(windows.kmers(frame, len(pattern), semantics), ["id"])
        assert Counter(zip((s := kernel.stranded(wins, length, len(pattern), semantics)).row.tolist(), words_of(s), s.cnt.tolist(), strict=True)) == Counter(
            map(tuple, profile.merge_strands(table, ["id"], semantics).drop("ord").collect()))
        rows = lambda r, *c: Counter(zip(r.row.tolist(), words_of(r), *(x.tolist() for x in c), strict=True))
        assert rows(r, r.cnt, r.ord) == Counter(map(tuple, table.collect()))
        r, table = kernel.stranded(wins, length, len(pattern), semantics, True), profile.merge_strands(table, ["id"], semantics)
        assert rows(r, r.cnt) == Counter(map(tuple, table.drop("ord").collect()))
        r, table = kernel.masked(r, pattern, semantics), profile.apply_pattern_counts(table, ["id"], pattern, semantics)
        assert rows(r, r.cnt) == Counter(map(tuple, table.collect()))
        row, rank, cnt = kernel.expanded(r)
        got = Counter(zip(row.tolist(), [spell(x, 4) for x in rank.tolist()], cnt.tolist(), strict=True))
        assert got == Counter(map(tuple, profile.sum_expanded(table, ["id"]).collect()))


def test_long_words_and_large_blocks(monkeypatch):
    """Words beyond 62 bits and sums beyond DENSE give the same."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("ACGT") for _ in range(rng.choice([20, 90]))) for _ in range(20)]
    wins, length = block(texts)
    for width in (12, 33):
        r = kernel.stranded(wins, length, width, "clean")
        for i, t in enumerate(texts):
            own = Counter(t[j : j + width] for j in range(len(t) - width + 1))
            both = own + Counter({s[::-1].translate(str.maketrans("ACGT", "TGCA")): n for s, n in own.items()})
            mine = np.flatnonzero(r.row == i)
            assert dict(zip([words_of(r)[j] for j in mine], r.cnt[mine].tolist(), strict=True)) == both
    each = [(p, s) for p in ([1, 1, 1, 1], [1, 1, 0, 1, 1]) for s in ("reference", "clean")]
    dense = [kernel.profiled(wins, length, *x) for x in each]
    monkeypatch.setattr(kernel, "DENSE", 0)
    assert all((a == b).all() for d, x in zip(dense, each, strict=True) for a, b in zip(d, kernel.profiled(wins, length, *x), strict=True))


def test_windows_of_texts(spark):
    """The windows cut from texts are derived_sequence()'s and windows()'; null, short and foreign texts too; a window in a row too."""
    from kmerloom.functions.sequence import derived_sequence

    rng = random.Random(4)
    texts = [None, "", "zu kurz", *("".join(rng.choice("abcXYZ wéß\n9") for _ in range(rng.choice([40, 90, 400]))) for _ in range(30))]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for fold in ("plain", "iupac"):
        cut = windows.windows(frame.select("id", derived_sequence(F.col("text"), fold).alias("seq")), 30, 7)
        want = Counter((r.id, r.win_idx, bytes(r.win).decode()) for r in cut.collect())
        f = lambda b: (None, [kernel.spelled(b.wins)])
        assert Counter(map(tuple, kernel.mapped(frame, kernel.Texts(fold, 30, 7), ["id"], "win string", f, True).collect())) == want
        rows = kernel.mapped(cut, kernel.Windows(), ["id", "win_idx"], "win string", f)
        assert Counter(map(tuple, rows.collect())) == want
