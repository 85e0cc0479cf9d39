"""Queries that count within their windows: one exchange, of documents, and the SQL's rows where ids repeat or are null."""

import duckdb
import pytest

from kmerloom.plans import registry
from test_queries import value

NAMES = [
    "e3_kmers",
    "a5_profile_clean",
    "a3_pattern_reference",
    "a3_pattern_clean",
    "a5_profile",
    "e20_vector",
    "e8_iupac",
    "a2_strands",
    "f3_homopolymer",
    "e19_count_map",
]


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """Documents of which some share an id, have none, no text or an empty one."""
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 30")
    again = docs.where("doc_id % 7 = 0").selectExpr("doc_id", "reverse(text) as text", "lang", "source", "n_chars")
    others = docs.where("doc_id in (1, 2, 4)").selectExpr("if(doc_id = 4, null, doc_id + 100) as doc_id", "case doc_id when 1 then null when 2 then '' else text end as text", "lang", "source", "n_chars")
    docs.unionByName(again).unionByName(others).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_no_kmer_is_a_row_before_it_is_counted(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1


#: Where two windows share their keys, the SQL leaves open which k-mer of one place comes first.
OPEN = {"e3_kmers": ("first_kmer", "last_kmer"), "a3_pattern_reference": ("cnt",)}


@pytest.mark.parametrize("name", NAMES)
def test_ids_that_repeat(spark, odd, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{odd}/documents.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, odd).drop(*OPEN.get(name, ()))
    columns = ", ".join(got.columns)
    want = con.sql(f"select {columns} from ({registry.ORACLE[name]})").fetchall()
    assert want and sorted((tuple(map(value, r)) for r in got.collect()), key=str) == sorted((tuple(map(value, r)) for r in want), key=str)
