"""A multinomial scorer in plain tables: it trains and scores all nodes of the taxonomy in one job."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import LEVELS
from ..functions.sequence import code_rank
from . import kernel
from .profile import filled

#: A level's weights of at most this many bytes are broadcast.
BROADCAST_BYTES = 32 << 20
#: Cells of sums by leaf that a task holds before it gives them away, and of vectors that are scored at once.
HELD = 1 << 22


def vectors(profile: DataFrame, keys: list[str], k: int) -> DataFrame:
    """profile(keys, code, cnt) -> keys, x: dense counts by rank of the code."""
    ranked = profile.select(*keys, code_rank(F.col("code"), k).alias("r"), F.col("cnt").cast("long").alias("c"))
    packed = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("r", "c"))).alias("cells"))
    return packed.select(*keys, filled("cells", "r", "c", 4**k).alias("x"))


def leaf_sums(windows: DataFrame) -> DataFrame:
    """windows(x, five names) -> five names, code_rank, n: counts by leaf."""
    cells = windows.select(*LEVELS, F.posexplode("x").alias("code_rank", "cnt")).where("cnt > 0")
    return cells.groupBy(*LEVELS, "code_rank").agg(F.sum("cnt").alias("n"))


def leaf_sums_in_rows(df: DataFrame, source: kernel.Texts | kernel.Windows, k: int) -> DataFrame:
    """df(source's column, five names) -> leaf_sums() of its windows: a task adds up its leaves' counts before they are exchanged."""
    size = 4**k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def given() -> pa.RecordBatch:
            names = [pa.array([leaf[i] for leaf in held], pa.string()) for i in range(len(LEVELS))]
            x = pa.ListArray.from_arrays(np.arange(0, (len(held) + 1) * size, size, dtype=np.int32), pa.array(np.concatenate([*held.values()])))
            return pa.RecordBatch.from_arrays([*names, x], [*LEVELS, "x"])

        for batch in batches:
            leaves = list(zip(*(batch.column(name).to_pylist() for name in LEVELS), strict=True))
            for block in source.blocks(batch):
                row, rank, cnt = kernel.profiled(block.wins, block.length, [1] * k)
                place: dict[tuple, int] = {}
                own = np.array([place.setdefault(leaves[i], len(place)) for i in block.at])
                x = np.bincount(own[row] * size + rank, cnt, len(place) * size).astype(np.int64).reshape(-1, size)
                for leaf, i in place.items():
                    held[leaf] = held[leaf] + x[i] if leaf in held else x[i]
                if len(held) * size > HELD:
                    yield given()
                    held.clear()
        if held:
            yield given()

    schema = ", ".join([*(f"`{name}` string" for name in LEVELS), "x array<bigint>"])
    return leaf_sums(df.select(*LEVELS, source.column).mapInArrow(run, schema))


def node_weights(leaf: DataFrame, k: int) -> DataFrame:
    """leaf_sums() -> one row per inner node: level_idx, parent, kids, an array in the order of names of (child, w) with
    w the array of round(1e6 ln((n + 1) / (total + 4^k))) by rank of the code."""
    size = 4**k
    per = []
    for i, level in enumerate(LEVELS):
        per.append(F.struct(F.lit(i).alias("level_idx"), (F.col(LEVELS[i - 1]) if i else F.lit("Root")).alias("parent"), F.col(level).alias("child")))
    counts = leaf.select(F.inline(F.array(*per)), "code_rank", "n").groupBy("level_idx", "parent", "child", "code_rank").agg(F.sum("n").alias("n"))
    node = counts.groupBy("level_idx", "parent", "child").agg(
        F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("code_rank", "n"))).alias("cells")
    )
    weight = lambda n: F.round(F.ln((n + 1) / (F.col("total") + size)) * 1e6).cast("long")
    node = node.select("level_idx", "parent", "child", F.transform(filled("cells", "code_rank", "n", size), weight).alias("w"))
    return node.groupBy("level_idx", "parent").agg(F.sort_array(F.collect_list(F.struct("child", "w"))).alias("kids"))


def small(weights: DataFrame) -> bool:
    """Whether nodes are counted to be few enough for a broadcast."""
    size = weights.agg(F.coalesce(F.sum(F.aggregate("kids", F.lit(0), lambda n, x: n + 8 * F.size(x["w"]) + 32)), F.lit(0))).first()[0]
    return size <= BROADCAST_BYTES


def _level_weights(weights: DataFrame, level: int) -> DataFrame:
    """One level's nodes, broadcast if they are counted to be small."""
    mine = weights.where(F.col("level_idx") == level).drop("level_idx")
    return F.broadcast(mine) if small(mine) else mine


def descend(windows: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """windows(read_id, win_idx, x) dealt by read_id, node_weights() stored -> read_id, level_idx, parent, child, votes.

    At each level every window votes for the child of the highest score (the first name where equal) under each active
    parent; children with more than a share of their parent's votes are active next.  A window meets one row per active
    parent and adds up its scores inside it.  Windows stay where they are dealt, and each level's votes are cut off from
    their lineage.
    """
    dot = lambda w: F.aggregate(F.zip_with("x", w, lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b)
    active = windows.select("read_id").distinct().withColumn("parent", F.lit("Root"))
    out = None
    for i in range(len(LEVELS)):
        met = windows.join(active, "read_id").join(_level_weights(weights, i), "parent")
        scored = F.array_min(F.transform("kids", lambda c: F.struct((-dot(c["w"])).alias("s"), c["child"].alias("child"))))
        won = met.select("read_id", "parent", scored["child"].alias("child"))
        votes = won.groupBy("read_id", "parent", "child").agg(F.count("*").alias("votes")).withColumn("level_idx", F.lit(i))
        votes = votes.select("read_id", "level_idx", "parent", "child", "votes").checkpoint(eager=True)
        total = F.sum("votes").over(Window.partitionBy("read_id", "parent"))
        active = votes.withColumn("total", total).where(F.col("votes") > F.lit(threshold) * F.col("total"))
        active = active.select("read_id", F.col("child").alias("parent")).distinct()
        out = votes if out is None else out.unionByName(votes)
    return out


def _voted(nodes: dict, read: np.ndarray, x: np.ndarray, threshold: float) -> Iterator[tuple[int, str, np.ndarray, list[str], np.ndarray]]:
    """descend() of some reads, whose windows are x's rows: level_idx, parent, reads, children and votes.

    Scores are whole numbers below 2^53, so that they are exact as doubles.
    """
    reads = int(read.max(initial=-1)) + 1
    active = {"Root": np.arange(len(read))}
    for i in range(len(LEVELS)):
        below: dict[str, np.ndarray] = {}
        for parent, mine in active.items():
            if (i, parent) not in nodes:
                continue
            kids, weights = nodes[i, parent]
            child = (x[mine] @ weights).argmax(axis=1)  # the first of equal ones
            pairs, votes = np.unique(read[mine] * len(kids) + child, return_counts=True)
            who, what = pairs // len(kids), pairs % len(kids)
            yield i, parent, who, [kids[c] for c in what], votes
            kept = votes > threshold * np.bincount(read[mine], minlength=reads)[who]
            for c in np.unique(what[kept]):
                on = below.setdefault(kids[c], np.zeros(reads, bool))
                on[who[kept & (what == c)]] = True
        active = {name: np.flatnonzero(on[read]) for name, on in below.items()}


def descend_in_rows(df: DataFrame, source: kernel.Texts | kernel.Windows, weights: DataFrame, threshold: float, k: int) -> DataFrame:
    """descend() of df(read_id, source's column), a row for each read, with small() weights: a read's five levels are taken where it stands."""
    nodes = weights.select("level_idx", "parent", "kids.child", F.flatten("kids.w").alias("w")).toArrow()
    table = {
        (i, parent): (kids, w.values.to_numpy().reshape(len(kids), -1).T.astype(np.float64))
        for i, parent, kids, w in zip(*(nodes.column(c).to_pylist() for c in ("level_idx", "parent", "child")), nodes.column("w"), strict=True)
    }
    sent, size = df.sparkSession.sparkContext.broadcast(table), 4**k
    id_ = df.schema["read_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[np.ndarray] = []
            vectors: list[np.ndarray] = []

            def given() -> Iterator[pa.RecordBatch]:
                own, read = np.unique(np.concatenate(at), return_inverse=True)
                ids = batch.column("read_id")
                for i, parent, who, child, votes in _voted(sent.value, read, np.concatenate(vectors), threshold):
                    cells = [ids.take(pa.array(own[who])), pa.array(np.full(len(who), i, np.int32)), pa.array([parent] * len(who)), pa.array(child), pa.array(votes)]
                    yield pa.RecordBatch.from_arrays(cells, ["read_id", "level_idx", "parent", "child", "votes"])

            for block in source.blocks(batch):
                row, x = kernel.dense(*kernel.profiled(block.wins, block.length, [1] * k), k)
                if len(row):
                    at.append(block.at[row])
                    vectors.append(x.astype(np.float64))
                if sum(map(len, at)) * size > HELD:
                    yield from given()
                    at.clear()
                    vectors.clear()
            if at:
                yield from given()

    return df.select("read_id", source.column).mapInArrow(run, f"read_id {id_}, level_idx int, parent string, child string, votes bigint")
