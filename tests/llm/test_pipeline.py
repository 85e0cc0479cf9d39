"""The pipeline, stage by stage, against the operators' brute-force versions."""

import duckdb
import pytest

pytest.importorskip("kmerloom.llm")
pytest.importorskip("corpus_pipeline")
from test_decontam import brute as brute_hits  # noqa: E402
from test_near import brute_cut, brute_groups  # noqa: E402
from test_tokens import check_pieces  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from kmerloom.llm.common import stored  # noqa: E402
from kmerloom.llm.quality import OP9_SQL  # noqa: E402


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, pairs = docs.columns, lambda frame: [(r.doc_id, r.text) for r in frame.collect()]
    after = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), "test-stage")
        assert docs.columns == columns, name
        after.append(sorted(pairs(docs)))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    keep = {d for d, k in con.sql(f"select doc_id, kept from ({OP9_SQL})").fetchall() if k}
    every = pairs(spark.read.parquet(f"{sf}/documents.parquet"))
    quality, near, cut, clean = after
    assert quality == sorted((d, t) for d, t in every if d in keep)
    firsts = {c for _, _, c in brute_groups(quality)}
    assert near == sorted((d, t) for d, t in quality if d in firsts) and len(near) < len(quality)
    removed = {d: n for d, _, n, _, _ in brute_cut(near, corpus_pipeline.PASSAGE_BYTES, "first")}
    for (d, new), (e, old) in zip(cut, near, strict=True):
        assert d == e and abs(len(old.encode()) - removed[d] - len(new.encode())) <= 6 and (removed[d] or new == old)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_hits(cut, items) if r[5]}
    assert clean == [(d, t) for d, t in cut if d not in bad]
    assert docs.where("n_chars <> char_length(text)").isEmpty()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    check_pieces(docs.collect(), pieces, 2048)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_odd_tables(spark, sf, tmp_path):
    """Null ids, texts, languages and sources, repeated ids and rows, a very long text, columns by internal names, and no rows."""
    import random

    rng = random.Random(5)
    passage, texts = prose(rng, 80), [prose(rng, 120) for _ in range(60)]
    items = [(1, prose(rng, 30)), (None, prose(rng, 20)), (2, None)]
    rows = [(i, f"{t} {passage} {prose(rng, 30)}" if i % 9 == 0 else t, "en" if i % 7 else None, "s1" if i % 5 else None) for i, t in enumerate(texts)]
    rows += [(None, texts[1], "en", "s1"), (3, texts[2], "en", "s1"), (3, prose(rng, 100), "en", "s1"), (None, prose(rng, 90), None, None), (70, None, "en", "s1"), (71, "", "en", "s1")]
    rows += [(80, prose(rng, 90_000), "en", "s1"), (81, items[0][1] + " " + prose(rng, 60), "en", "s1")]
    names = ("__key", "__text", "__fp", "__root", "__component", "__spans", "__words", "__matches", "__id", "kept", "key")
    frame = spark.createDataFrame([(*r, len(r[1] or ""), i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, row long")
    frame = frame.select("*", *(F.col("row").alias(n) for n in names))
    frame.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {r.row: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path)), "odd-stage")
        assert docs.columns == frame.columns, name
        got = docs.collect()
        assert len({r.row for r in got}) == len(got) and all({r[n] for n in names} == {r.row} for r in got), name
    left = {r.row: r for r in got}
    gone = {i for i, r in enumerate(rows) if not r[1]} | {61, len(rows) - 1}
    assert {60, 61} & left.keys() == set() and 1 in left and not gone - {61} & left.keys()
    assert all(left[i].doc_id == seen[i].doc_id and left[i].n_chars == len(left[i].text) for i in left)
    assert len(rows) - 2 in left and sum(passage in r.text for r in left.values()) == 1
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(p.length for p in pieces if p.start == 0) > 0 and {p.doc_id for p in pieces} == {r.doc_id for r in left.values()}
    frame.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("ids", ["string", "double", "long"])
def test_odd_names_and_types(spark, tmp_path, ids):
    """Names with dots, backticks and blanks, by case alone different, nested ones too; maps; ids that aren't whole numbers, null or repeated."""
    import random

    rng = random.Random(8)
    passage, texts = prose(rng, 80), [prose(rng, 120) for _ in range(30)]
    value = {"string": lambda i: f"doc/{i:03}", "double": lambda i: i + 0.25, "long": lambda i: i}[ids]
    rows = [(value(i), f"{t} {passage}" if i in (4, 9) else t, "en", "s1") for i, t in enumerate(texts)]
    rows += [(value(40), texts[0], "en", "s1"), (value(5), texts[1] + " more", "en", "s1"), (None, prose(rng, 100), "en", None)]
    frame = spark.createDataFrame([(*r, len(r[1]), i) for i, r in enumerate(rows)], f"doc_id {ids}, text string, lang string, source string, n_chars long, row long")
    row = F.col("row")
    more = {"meta.url": row, "a`b": row, "c d": row, "Text": row, "s": F.struct(row.alias("a b"), F.struct(row.alias("x.y")).alias("n")), "m": F.create_map(F.lit("k k"), row)}
    frame = frame.select("*", *(c.alias(n) for n, c in more.items()))
    spark.conf.set("spark.sql.caseSensitive", "true")  # only so that the table of the test can be written and read by name
    try:
        frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(1, texts[7][:200])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, str(tmp_path)), "odd-names")
            assert docs.columns == frame.columns and docs.schema.simpleString() == frame.schema.simpleString(), name
            for r in docs.collect():
                assert {r["meta.url"], r["a`b"], r["c d"], r["Text"], r["s"]["a b"], r["s"]["n"]["x.y"], r["m"]["k k"]} == {r["row"]}
        left = {r["row"]: r for r in docs.collect()}
        assert 7 not in left and len({0, 30} & left.keys()) == 1 and 32 in left and sum(passage in r["text"] for r in left.values()) == 1
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert pieces.schema["doc_id"].dataType == frame.schema["doc_id"].dataType
        assert {p.doc_id for p in pieces.collect()} == {r["doc_id"] for r in left.values()}
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
