"""Operator 13: hard negatives for contrastive training, by exact inner products behind bounds of segment summaries.

Vectors of whole numbers are cut into segments; each segment's mean m and deviation s are stored with the vector.  Over a segment of w
components the product of two vectors is w (m m' + c), where c lies within s s' of 0.  The sum over the segments bounds a pair's score from
both sides.  Coarse segments come first, as two matrix products; pairs that may still matter are bounded by fine segments, and what is
left is scored exactly.

Anchors are read in blocks of bounded size, and each block meets all rows where they are; rows are never shuffled.  A task
keeps its best partners for each anchor, and its worst of those raises the bound; tasks' bests are merged by anchor.

* Positives: an anchor's best other rows of its label.  The bounds from below say what its last one has at least.
* Negatives: for each positive the best rows of other labels, with a score from `low` to `high` hundredths of the positive's.

Rows with a null id, label or vector, or with a null or non-finite component, take no part.  Higher scores come first, equal scores by smaller id.
Rows with equal ids are rows of their own; each is another row than its copies.  Short vectors count as if zeros followed.
Fewer partners than asked for: all of them; an anchor without positives, or a positive without negatives, has no row.  A negative
positive score leaves no room between the limits.  Scores that 64 bits can't hold raise an error.  An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, map_arrow, ranked, shared_dir, stored

#: Components of a fine segment, and fine segments of a coarse one.
FINE, GROUP = 4, 4
#: Bytes of the anchors' vectors in a block, and anchors that meet a batch of rows at once.
ANCHOR_BYTES, ANCHOR_CHUNK = 8 << 20, 1024
#: Pairs that are gathered at once.
PAIRS = 1 << 14
LEAST = np.iinfo(np.int64).min


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Lists as rows of `width` numbers, zeros behind short ones; what is beyond the width is left out."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = at < width
    out[row[inside], at[inside]] = values[inside]
    return out


def padded(dim: int) -> int:
    """A vector's length, filled up to whole coarse segments."""
    return -(-dim // (FINE * GROUP)) * FINE * GROUP


def summary(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each fine segment."""
    parts = vectors.reshape(len(vectors), -1, FINE)
    return parts.mean(axis=2), parts.std(axis=2)


class Side:
    """Vectors with their summaries, scaled by the root of the segments' length, so that bounds are plain products."""

    def __init__(self, vectors: np.ndarray, means: np.ndarray, devs: np.ndarray):
        self.vectors = vectors
        self.reach = float(np.sqrt((vectors**2).sum(axis=1)).max(initial=0.0))
        m, s = (x.reshape(len(vectors), -1, GROUP) for x in (means, devs))
        middle = m.mean(axis=2)
        spread = np.sqrt(np.maximum((s**2 + m**2).mean(axis=2) - middle**2, 0))
        self.levels = [tuple(x * np.sqrt(FINE * GROUP) for x in (middle, spread)), tuple(x * np.sqrt(FINE) for x in (means, devs))]

    def take(self, at: np.ndarray) -> Side:
        out = object.__new__(Side)
        out.vectors, out.reach, out.levels = self.vectors[at], self.reach, [(m[at], s[at]) for m, s in self.levels]
        return out


def _dots(a: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows i of a with rows j of x."""
    parts = [np.einsum("ij,ij->i", a[i[k : k + PAIRS]], x[j[k : k + PAIRS]]) for k in range(0, len(i), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0, a.dtype)


def candidates(a: Side, x: Side, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, best: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) and scores of allowed pairs with a score from low to high, of a's each row; none of them is missing.

    best: only the so many highest of each row are wanted, which raises low.
    """
    scale = a.reach * x.reach
    if scale >= 2.0**63:
        raise ValueError("scores beyond 64 bits")
    slack = 0.5 + 1e-9 * scale
    keep, low = allowed.copy(), low.astype(np.float64)
    for number, ((am, asd), (xm, xsd)) in enumerate(zip(a.levels, x.levels, strict=True)):
        if number == 0 or 8 * np.count_nonzero(keep) > keep.size:
            middle, around = am @ xm.T, asd @ xsd.T + slack
            if best and keep.shape[1] >= best:
                sure = np.where(keep, middle - around, -np.inf)
                low = np.maximum(low, np.partition(sure, -best, axis=1)[:, -best])
            keep &= (middle + around >= low[:, None]) & (middle - around <= high[:, None])
        else:
            i, j = np.nonzero(keep)
            middle, around = _dots(am, xm, i, j), _dots(asd, xsd, i, j) + slack
            out = (middle + around < low[i]) | (middle - around > high[i])
            keep[i[out], j[out]] = False
    i, j = np.nonzero(keep)
    av, xv = (a.vectors, x.vectors) if scale < 2.0**53 else (a.vectors.astype(np.int64), x.vectors.astype(np.int64))
    score = (av @ xv.T)[i, j] if 8 * len(i) > keep.size else _dots(av, xv, i, j)
    score = score.astype(np.int64)
    ok = (score >= low[i]) & (score <= high[i])
    return i[ok], j[ok], score[ok]


class Best:
    """The k best partners of each group so far: higher scores first, then smaller ids."""

    def __init__(self, groups: int, k: int):
        self.k, self.last = k, np.full(groups, LEAST)
        self.group, self.score, self.id, self.row = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, group: np.ndarray, score: np.ndarray, id: np.ndarray, row: np.ndarray) -> None:
        new = score >= self.last[group]
        if not new.any():
            return
        group, score, id, row = (np.concatenate([old, x[new]]) for old, x in ((self.group, group), (self.score, score), (self.id, id), (self.row, row)))
        order = np.lexsort((id, -score, group))
        group = group[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        order, group = order[place < self.k], group[place < self.k]
        self.group, self.score, self.id, self.row = group, score[order], id[order], row[order]
        full = place[place < self.k] == self.k - 1
        self.last[group[full]] = self.score[full]


class Block:
    """A block of anchors, with the positives found so far."""

    def __init__(self, rows: pa.Table, dim: int):
        col = lambda n: rows.column(n).combine_chunks()
        num = lambda n: col(n).to_numpy(zero_copy_only=False).astype(np.int64)
        self.width = padded(dim)
        vectors = matrix(col("vec"), self.width)
        self.side = Side(vectors, *summary(vectors))
        self.row, self.id, self.label = num("row"), num("id"), num("label")
        self.limits: tuple[np.ndarray, ...] = ()

    def chunks(self) -> Iterator[np.ndarray]:
        for at in range(0, len(self.row), ANCHOR_CHUNK):
            yield np.arange(at, min(at + ANCHOR_CHUNK, len(self.row)))


def _batches(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Side]]:
    for batch in batches:
        if batch.num_rows:
            segments = block.width // FINE
            side = Side(matrix(column(batch, "vec"), block.width), matrix(column(batch, "means"), segments), matrix(column(batch, "devs"), segments))
            yield *(column(batch, n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("row", "id", "label")), side


def _positives(block: Block, k: int, batches: Iterator[pa.RecordBatch]) -> Best:
    best = Best(len(block.row), k)
    for row, id, label, side in _batches(batches, block):
        for value in np.intersect1d(label, block.label):
            own, mine = np.flatnonzero(block.label == value), np.flatnonzero(label == value)
            rows = side.take(mine)
            for at in range(0, len(own), ANCHOR_CHUNK):
                a = own[at : at + ANCHOR_CHUNK]
                allowed = block.row[a][:, None] != row[mine][None, :]
                i, j, score = candidates(block.side.take(a), rows, allowed, best.last[a], np.full(len(a), np.inf), k)
                best.add(a[i], score, id[mine[j]], row[mine[j]])
    return best


def _negatives(block: Block, k: int, batches: Iterator[pa.RecordBatch]) -> Best:
    score, low, high = block.limits  # by anchor and positive; low is above high where there is no such positive
    slots = score.shape[1]
    best = Best(low.size, k)
    for row, id, label, side in _batches(batches, block):
        for a in block.chunks():
            allowed = block.label[a][:, None] != label[None, :]
            least = np.maximum(low[a], best.last.reshape(low.shape)[a])
            none = low[a] > high[a]
            least = np.where(none, np.iinfo(np.int64).max, least).min(axis=1)
            most = np.where(none, LEAST, high[a]).max(axis=1)
            i, j, got = candidates(block.side.take(a), side, allowed, least, most.astype(np.float64))
            for slot in range(slots):
                inside = (got >= low[a[i], slot]) & (got <= high[a[i], slot])
                best.add(a[i[inside]] * slots + slot, got[inside], id[j[inside]], row[j[inside]])
    return best


FOUND = "group_no long, score long, id long, row long"


def _search(items: DataFrame, block: Block, k: int, how) -> DataFrame:
    """Each task's best partners of the block's groups."""
    shared = items.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = how(shared.value, k, batches)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (best.group, best.score, best.id, best.row)], names=["group_no", "score", "id", "row"])

    found = map_arrow(items, run, FOUND)
    order = Window.partitionBy("group_no").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def prepared(vectors: DataFrame, id: str, label: str, vector: str, scale: int = 256) -> DataFrame:
    """row, id, label, vec (floor of `scale` times each component), means, devs: rows that take part, stored."""
    x = F.col(vector)
    fit = F.col(id).isNotNull() & F.col(label).isNotNull() & x.isNotNull()
    sound = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    vec = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    rows = vectors.where(fit & sound).select(
        F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), vec.alias("vec")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column(batch, "vec")
            width = padded(int(np.max(lists.value_lengths().to_numpy(zero_copy_only=False), initial=0)))
            got = [x.ravel() for x in summary(matrix(lists, width))]
            ends = pa.array(np.arange(batch.num_rows + 1) * (width // FINE), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in got)], names=[*batch.schema.names, "means", "devs"])

    schema = "row long, id long, label long, vec array<long>, means array<double>, devs array<double>"
    return stored(map_arrow(rows, run, schema), "vectors")


def hard_negatives(items: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """items as prepared() gives them -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: the condition that makes a row an anchor.
    """
    spark = items.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    chosen = items.where(anchors).select(F.lit("").alias("key"), "id", "label", "vec", "row", F.col("row").alias("tie"))
    chosen = stored(ranked(chosen, ["id"]).select("rank", "row", "id", "label", "vec"), "anchors")
    count, dim = chosen.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    per = max(1, ANCHOR_BYTES // (8 * max(1, padded(dim))))
    out = f"{shared_dir(spark)}/hard-negatives-{uuid.uuid4().hex}"
    for number, at in enumerate(range(0, count, per)):
        block = Block(chosen.where((F.col("rank") >= at) & (F.col("rank") < at + per)).orderBy("rank").toArrow(), dim)
        found = stored(_search(items, block, positives, _positives), "positives")
        got = found.toArrow()  # of one block: `positives` rows for each of its anchors at most
        num = lambda n, got=got: got.column(n).to_numpy().astype(np.int64)
        shape = (len(block.row), positives)
        score, lo, hi = np.zeros(shape, np.int64), np.ones(shape, np.int64), np.zeros(shape, np.int64)
        group, slot, ps = num("group_no"), num("rank") - 1, num("score")
        score[group, slot] = ps
        lo[group, slot], hi[group, slot] = -(-low * ps // 100), high * ps // 100
        block.limits = (score, lo, hi)
        best = _search(items, block, negatives, _negatives)
        ids = spark.createDataFrame([(int(i), int(x)) for i, x in enumerate(block.id)], "anchor_no long, anchor_id long")
        known = found.select((F.col("group_no") * positives + F.col("rank") - 1).alias("group_no"), F.col("group_no").alias("anchor_no"),
                             F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        rows = best.join(F.broadcast(known.join(ids, "anchor_no")), "group_no")  # as bounded as the block
        rows = rows.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        rows.write.parquet(f"{out}/block={number}")
    if not count:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, block long").parquet(out).drop("block")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    items = prepared(rows.select("vec_id", noisy.alias("label"), "embedding"), "vec_id", "label", "embedding")
    return hard_negatives(items, F.col("id") % 100 == 0)


OP13_SQL = """with r as materialized (select row_number() over () as n, vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
  [floor(256 * x::double)::bigint for x in embedding] as v from embeddings where vec_id is not null and label is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as materialized (select a.n as an, a.id as anchor_id, a.label = b.label as same, b.n as bn, b.id,
  coalesce(list_sum([x[1] * x[2] for x in list_zip(a.v, b.v) if x[1] is not null and x[2] is not null]), 0)::bigint as score from r a join r b on a.n <> b.n where a.id % 100 = 0),
 p as (select an, anchor_id, bn, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by an order by score desc, id, bn) <= 5),
 g as (select p.*, s.id as negative_id, s.score as negative_score, row_number() over (partition by p.an, p.bn order by s.score desc, s.id) as rank
  from p join s on s.an = p.an and not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from g where rank <= 10"""
