"""Operator 11 against the sentencepiece library."""

import hashlib
import random

import pyarrow as pa
import pytest

pytest.importorskip("kmerloom.llm")
import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402

from kmerloom.llm import pieces  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", "\n", "a\nb", "a\n\nb", " a", "a ", "It's  me", "a    b", "<s>x</s><unk><0x0A>", "▁a ▁▁ b▁", "\t\x00\x7f", "日本 語,。x", "é́ ́b",
       "ｶﾞＡ ①x", "ﬁ ½ ㌔ ¨ ​ 　x", "🙂👩‍👩‍👧 𝒳", "x" * 300, "ab" * 200 + " " * 40 + "c"]


def texts(n=1500):
    rng = random.Random(5)
    return ODD + ["".join(rng.choice("ab the ing AB.,'\n\t  éÉİ1𝒳ｶﾞ①▁日") for _ in range(rng.randrange(60))) for _ in range(n)]


def with_map(rule, **flags):
    """The model file's bytes with another normaliser: the pieces stay, the character map is one of the library's own."""
    raw, spec = open(PATH, "rb").read(), sentencepiece.SentencePieceNormalizer(rule_name=rule, **flags).serialized_normalizer_spec()
    size = b""
    n = len(spec)
    while True:
        size += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            break
    return raw + b"\x1a" + size + spec  # of equal fields, the last one counts


def check(raw, given):
    own, lib = pieces.PieceModel(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    ids, begins, ends, counts = own.encode(pa.array(given, pa.string()))
    decoded = own.decode(ids.astype("int64"), counts)
    decoded = decoded if isinstance(decoded, list) else decoded.to_pylist()
    at = 0
    for t, n, d in zip(given, counts.tolist(), decoded, strict=True):
        want = lib.encode(t or "", return_type="proto").pieces
        assert ids[at : at + n].tolist() == [p.id for p in want], t
        assert list(zip(begins[at : at + n].tolist(), ends[at : at + n].tolist(), strict=True)) == [(p.begin, p.end) for p in want], t
        assert d.decode() == lib.decode([p.id for p in want]), t
        at += n
    assert at == len(ids)


def test_pieces_are_the_library_s():
    check(open(PATH, "rb").read(), [*texts(), None, *texts(5)])


@pytest.mark.parametrize("flags", [{"add_dummy_prefix": p, "escape_whitespaces": True, "remove_extra_whitespaces": r} for p in (True, False) for r in (True, False)])
@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_pieces_through_a_character_map(rule, flags):
    check(with_map(rule, **flags), texts(500))


def test_any_ids_are_decoded_as_the_library_does():
    raw, rng = open(PATH, "rb").read(), random.Random(2)
    own, lib = pieces.PieceModel(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    import numpy as np

    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, 13, 3 + 0xE2, 3 + 0x96, 3 + 0x81, 3 + 0xF0, 300, 259, 264, rng.randrange(32000)]) for _ in range(rng.randrange(8))]
        got = own.decode(np.array(ids, np.int64), np.array([len(ids)]))
        assert (got if isinstance(got, list) else got.to_pylist())[0].decode() == lib.decode(ids), ids
    with pytest.raises(ValueError):
        own.decode(np.array([32000]), np.array([1]))


def test_frames(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    given = [*ODD, None, "long words here " * 20000, "same", "same"]
    rows = [(i if i % 5 else None, t, i, "x", (1,)) for i, t in enumerate(given)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids int, `a.b``c` string, s struct<`a b`: int>")
    coded = pieces.encode_pieces(frame, PATH)
    assert coded.columns == [*frame.columns, "ids_", "begins", "ends"]
    got = {r["ids"]: r for r in pieces.decode_pieces(coded, PATH, "ids_").collect()}
    assert len(got) == len(given)
    for i, t in enumerate(given):
        want = lib.encode(t or "")
        assert got[i].ids_ == want and got[i].decoded == lib.decode(want) and got[i].doc_id == rows[i][0] and got[i].s == (1,)
        raw, spans = (t or "").encode(), list(zip(got[i].begins, got[i].ends, strict=True))
        assert b"".join(raw[a:b] for a, b in spans) == raw
    assert pieces.encode_pieces(frame.limit(0), PATH).count() == 0


def test_query(spark, sf):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = lib.encode(r.text or "")
        want[r.doc_id] = (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), lib.decode(ids))))
    got = pieces.op11_sentence_pieces(spark, sf).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)
