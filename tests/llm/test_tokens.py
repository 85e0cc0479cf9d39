"""Operators 4 and 5 against the tokenizers library and round trips."""

import random
import zlib

import numpy as np
import pytest

pytest.importorskip("kmerloom.llm")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from kmerloom.llm import bitpack, packing  # noqa: E402
from kmerloom.llm.tokens import TextEncoder  # noqa: E402

ODD = ["", " ", "a", "\n", "a\nb", "a\n\nb", "a \nb", "a\n b", " a", "a ", "It's  me", "ÀÉÎ don't, Don't. 12,5 3.", "x<|endoftext|>y",
       "a\tb c", "\x1ca b\x1f c", "İstanbul İ. ǅ", "é́ ́b", "日本 語,。x", "a.b., c..", "... ,, ."]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name):
    own, lib, rng = TextEncoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name)), random.Random(1)
    texts = ODD + ["".join(rng.choice("ab AB.,'\n\t  éÉİ1𝒳s") for _ in range(30)) for _ in range(2000)]
    for t in texts * 2:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("vocab", [2, 100, 49408, 65536, 65537, 1 << 20])
def test_bits_round_trip(vocab):
    rng, width = np.random.default_rng(1), bitpack.bit_width(vocab)
    counts = [0, 1, 5000, 3, 4096, 9000]
    ids = rng.integers(0, vocab, sum(counts), dtype=np.uint32)
    got = bitpack.TokenFile(bitpack.file_bytes([3, None, 4, 5, 6, 7], counts, ids, width))
    assert got.doc_ids == [3, None, 4, 5, 6, 7]
    for i, at in enumerate(np.cumsum([0, *counts[:-1]])):
        assert (got.document(i) == ids[at : at + counts[i]]).all()
    assert (got.ids(4090, 20) == ids[4090:4110]).all()


def rows(spark):
    texts = ["b c d e", None, "", "a a", "a a", "long " * 9000, "x\ny"]
    data = [(i, t, "s" if i % 3 else None, 1) for i, t in enumerate(texts)] + [(None, "no id", "s", 1), (3, "a a", "s", 1)]
    return spark.createDataFrame(data, "doc_id long, text string, source string, start int")


def test_bit_packed_files(spark):
    from kmerloom.llm.common import shared_dir

    path = f"file://{shared_dir(spark)}/own-{random.random()}"
    tok = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(tok)
    files = bitpack.write_tokens(rows(spark), path, tok, 2)
    got = sorted(bitpack.read_tokens(spark, path, files).collect(), key=lambda r: r["start"])
    want = sorted(((r.doc_id, r.text or "") for r in rows(spark).collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r["doc_id"] for r in got] == [d for d, _ in want]
    start = 0
    for r, (_, text) in zip(got, want, strict=True):
        ids = np.asarray(lib.encode(text, add_special_tokens=False).ids + [2], dtype="<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    empty = rows(spark).limit(0)
    path += "-empty"
    assert bitpack.read_tokens(spark, path, bitpack.write_tokens(empty, path, tok, 2)).count() == 0


def check_pieces(docs, pieces, size):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((np.asarray(lib.encode(r.text or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes(), str(r.doc_id)) for r in docs)
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(str(p["doc_id"]), []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    assert {d for _, d in want} == set(by_doc)
    for d, ps in by_doc.items():
        texts = [np.frombuffer(b, "<u4") for b, x in want if x == d]
        assert sum(p["length"] for p in ps) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for p in sorted(ps, key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(texts[0])
                at += p["length"]
                assert p["ids_crc32"] == zlib.crc32(texts[0][p["start"] : at].tobytes())
    sizes = []
    for s in sorted(by_seq):
        at = 0
        for p in sorted(by_seq[s], key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        sizes.append(at)
    assert sorted(by_seq) == list(range(len(by_seq))) and all(n == size for n in sizes[:-1]) and 0 < sizes[-1] <= size


def test_packing(spark, sf):
    tok = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack_documents(rows(spark), tok, size=64).collect()
    check_pieces(rows(spark).collect(), got, 64)
    assert packing.pack_documents(rows(spark).limit(0), tok).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    got = packing.pack_documents(docs, tok, targets={"src1": 0.4, "src2": 0.3}).collect()
    check_pieces(docs.collect(), got, 2048)


def test_deficits_stay_below_a_token():
    rng = np.random.default_rng(2)
    totals = rng.integers(0, 100000, 30)
    drr = packing.DeficitRoundRobin(totals, totals, 512)
    w = np.arange(drr.windows() + 1)
    sent = drr.sent(w)
    assert (np.diff(sent, axis=0) >= 0).all() and (sent.sum(1) == np.minimum(w * 512, totals.sum())).all()
    assert (sent[-1] == totals).all()
    assert np.abs(sent[:-1] - w[:-1, None] * 512 * (totals / totals.sum())).max() < 1.01
    # Against a round-robin run token by token: the queue with the earliest due time sends.
    totals, shares = [7, 40, 13], [0.5, 0.3, 0.2]
    drr, n, step = packing.DeficitRoundRobin(totals, shares, 8), [0, 0, 0], []
    for _ in range(60):
        q = min((i for i in range(3) if n[i] < totals[i]), key=lambda i: ((n[i] + 0.5) / shares[i], i))
        n[q] += 1
        step.append(list(n))
    assert drr.sent(np.arange(1, 8)).tolist() == [step[8 * w - 1] for w in range(1, 8)]
