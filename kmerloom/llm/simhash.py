"""Operator 3: SimHash near-dedup with pigeonring filtering.

Fingerprint: words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, 3-word shingles with repeats, each hashed by XXH64 with
seed 42; a bit is 1 if it is set in over half of the hashes.  Fewer than 3 words: the whole sequence is the one shingle.
No words, or a null text: fingerprint zero, linked like any other.

Two fingerprints link at 3 or fewer differing bits.  The 64 bits are a ring of 4 segments.  By the pigeonring principle a
pair within 3 has a segment from which the differences of 1, 2, 3 and 4 consecutive segments stay within 0, 1, 2 and 3
(each the whole part of its proportional budget).  Chains are sought by an equi-join: one side gives segment i and the next
as they are, the other also with each single bit of the next one flipped, so the first two budgets hold in the join
itself, on 32 bits.  The third is checked next and the full distance last.  Only distinct fingerprints take part:
copies of any number are one row.

Equal ids: the rows are taken one by one.  A component's id is its smallest non-null doc_id, null if it has none.
An empty table gives no rows; other columns are not read by fingerprints() and are kept by near_dedup().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, map_arrow, masked, slices, small_side, stored, text_bytes, texts_of, with_fields
from .components import components

BITS, SEGMENTS, DISTANCE = 64, 4, 3
WIDTH = BITS // SEGMENTS


def fingerprint(text: bytes, words: int = 3) -> int:
    """The 64-bit fingerprint as a signed integer."""
    w = text.translate(LOWER).split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[words - 1 :].tolist() if len(w) >= words else [len(joined)]
    counts = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        h = np.fromiter(
            (digest(joined[s:e], 42) for s, e in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)),
            dtype="<u8",
        )
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "little", signed=True)


def _add_fingerprints(text: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            prints = pa.array([fingerprint(t) for t in texts_of(batch, text)], pa.int64())
            at = batch.schema.get_field_index(text)
            keep = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), prints], names=[*(batch.schema.names[i] for i in keep), name])

    return run


def fingerprints(docs: DataFrame, text: str = "text", name: str = "__fp") -> DataFrame:
    """Stored table of docs' other columns and the fingerprint; a column of docs with its name must not be there."""
    other = [f for f in docs.schema if f.name != text]
    return stored(map_arrow(docs, _add_fingerprints(text, name), with_fields(other, f"`{name}` long")), "fingerprints")


def _turned(value: Column, i: int) -> Column:
    """value with segment i in the lowest place."""
    if i == 0:
        return value
    return F.shiftrightunsigned(value, WIDTH * i).bitwiseOR(F.shiftleft(value, BITS - WIDTH * i))


def _chain_key(value: Column, i: int) -> Column:
    """Start i with its segment and the next one."""
    return _turned(value, i).bitwiseAND(F.lit((1 << 2 * WIDTH) - 1)) + F.lit(i << 2 * WIDTH)


def pigeonring_links(prints: DataFrame) -> DataFrame:
    """prints(fp), distinct -> (a, b) with a < b at DISTANCE or fewer differing bits; a pair may come more than once."""
    keys = [_chain_key(F.col("fp"), i) for i in range(SEGMENTS)]
    left = prints.select(F.col("fp").alias("a"), F.explode(F.array(*keys)).alias("k"))
    flips = [F.lit(0).cast("long"), *(F.lit(1 << (WIDTH + j)).cast("long") for j in range(WIDTH))]
    right = prints.select(F.col("fp").alias("b"), F.explode(F.array(*(k.bitwiseXOR(f) for k in keys for f in flips))).alias("k"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    start = F.shiftright("k", 2 * WIDTH)
    three = F.lit(False)
    for i in range(SEGMENTS):
        chain = _turned(x, i).bitwiseAND(F.lit((1 << 3 * WIDTH) - 1))
        three = three | ((start == i) & (F.bit_count(chain) <= 3 * DISTANCE // SEGMENTS))
    # By merging: the planner takes the exploded side for as small as its source and would broadcast it.
    found = left.hint("merge").join(right.hint("merge"), "k").where((F.col("a") < F.col("b")) & three & (F.bit_count(x) <= DISTANCE))
    return found.select("a", "b")


def near_groups(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """prints(id_col, __fp) -> one stored row per fingerprint: __fp, root, component_id."""
    distinct = stored(prints.groupBy(F.col("__fp").alias("fp")).agg(F.min(id_col).alias("doc")), "distinct-fingerprints")
    comp = components(pigeonring_links(distinct.select("fp")))
    named = distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", "doc", F.coalesce("root", "fp").alias("root"))
    best = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    return stored(named.join(best, "root").select(F.col("fp").alias("__fp"), "root", "component_id"), "near-groups")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate component: that with the smallest id; its columns as they were.

    Ids may be of any type that has an order; other columns may have any names and types.
    """
    work = masked(docs, doc_id=id_col, text=text)
    prints = fingerprints(work.select("doc_id", "text"))
    groups = near_groups(prints)
    rows, ids = prints.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows == ids:
        lost = prints.select("doc_id", "__fp").join(groups, "__fp").where(F.col("doc_id") != F.col("component_id")).select("doc_id")
        kept = work.join(small_side(stored(lost, "near-copies"), text_bytes("doc_id")), "doc_id", "left_anti")
    else:
        # Null or repeated ids: rows carry their fingerprint themselves, and one row of each component is kept.
        carried = fingerprints(work.withColumn("__text", F.col("text")), "__text")
        kept = carried.join(groups, "__fp").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).dropDuplicates(["root"])
    return kept.select(*work.columns).toDF(*docs.columns)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    prints = fingerprints(docs)
    return prints.join(near_groups(prints), "__fp").select(
        "doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
