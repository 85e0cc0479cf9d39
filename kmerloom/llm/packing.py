"""Operator 4: mixture-controlled packing of documents into fixed windows of tokens.

Sources are queues.  Deficit round-robin serves them: a window of `size` tokens adds size * share to each queue's
deficit, the queue sends that many whole tokens, and what it couldn't send stays as its deficit for the next window.
The order that this gives is that of the tokens' due times: token t of a queue with share p is due at (t + 0.5) / p,
queues in their order where times are equal, and a queue that runs dry leaves its time to the others.  So the tokens
that a queue has sent before window w follow from w and the queues' totals alone, by bisection on the due time: every task finds the state of every window for itself,
and deficits carry over windows and partitions without a pass in one place.

Within a queue, documents stand in the order of the stored table.  Cuts are free: a document goes on in the next window.
All windows but the last are full.
Null text: no ids but the end id.  Null source: a queue of its own.  Repeated rows: packed each.  No rows: no pieces.
Shares default to the queues' tokens, so that all run dry together; targets for some queues may be given.
Every source is a queue of its own.  Beyond MAX_QUEUES of them no task holds all.  Queues with more than a MAX_QUEUES-th of the tokens or
of the shares, at most twice MAX_QUEUES, are still served in closed form.  The tokens of the others, of which a window has one or two a queue, are
rows that are sorted by due time; the closed form gives the large queues' tokens before each.  So the windows know how many of
their tokens are the small queues', and the rest is the large ones'.  Runs are joined with the documents by stretches of the queue.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import column, map_arrow, masked, ranked, slices, small_side, stored

#: With more queues than these, the small ones' tokens are sorted, and each task holds shares and totals of the large ones only.
MAX_QUEUES = 1024
#: Windows of a block, whose states are worked out at once for all queues; bytes of blocks that a task keeps.
WINDOWS = 256
KEEP_BYTES = 32 << 20
#: Tokens between two documents of a batch beyond which the windows between them are not looked at.
GAP = 1 << 14
#: Tokens of small queues that are placed among those of large ones at once.
AT_ONCE = 512


class DeficitRoundRobin:
    """Where each queue stands at any window, for queue totals and shares of equal length.  whole: the shares' sum, if these aren't all queues."""

    def __init__(self, totals, shares, size: int, whole: float | None = None):
        self.totals, self.size = np.asarray(totals, dtype=np.int64), size
        p = np.asarray(shares, dtype=np.float64)
        self.p = np.where(self.totals > 0, p / (p.sum() if whole is None else whole), 1.0)
        self.all = int(self.totals.sum())
        self.end = float(np.max((self.totals + 1) / self.p, initial=1.0)) * 2

    def _due(self, v: np.ndarray) -> np.ndarray:
        """Tokens of each queue due by time v, as an array times x queues."""
        n = np.floor(np.asarray(v, dtype=np.float64)[:, None] * self.p[None, :] + 0.5)
        return np.minimum(self.totals[None, :], n).astype(np.int64)

    def sent(self, windows: np.ndarray) -> np.ndarray:
        """Tokens that each queue has sent before each window: windows x queues, rows summing to window * size."""
        return self.sent_of(np.minimum(np.asarray(windows, dtype=np.int64) * self.size, self.all))

    def sent_of(self, want: np.ndarray) -> np.ndarray:
        """Tokens that each queue has sent when all have sent as many as wanted."""
        lo, hi = np.zeros(len(want)), np.where(want > 0, self.end, 0.0)
        while True:  # lo: fewer than wanted are due; hi: enough are
            mid = (lo + hi) / 2
            open_ = (mid > lo) & (mid < hi)
            if not open_.any():
                break
            enough = self._due(mid).sum(1) >= want
            lo, hi = np.where(open_ & ~enough, mid, lo), np.where(open_ & enough, mid, hi)
        below, above = self._due(lo), self._due(hi)
        left = want - below.sum(1)
        below = np.where((left < 0)[:, None], 0, below)  # nothing is wanted before the first window
        left = np.where(left < 0, want, left)
        extra = above - below
        taken = np.clip(left[:, None] - (np.cumsum(extra, 1) - extra), 0, extra)
        return below + taken

    def before(self, due: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Tokens of these queues that go before others, due at these times, of queues that stand behind the first `place` of these."""
        out, order, queues = np.zeros(len(due), dtype=np.int64), np.lexsort((place, due)), np.arange(len(self.p))
        for some in (order[i : i + AT_ONCE] for i in range(0, len(order), AT_ONCE)):
            v, k = due[some], place[some]
            low = np.maximum(self._due(v[:1])[0] - 1, 0)
            many = np.minimum(self._due(v[-1:])[0] + 1, self.totals) - low
            if many.sum() * 8 <= len(v) * len(queues):  # few are due in this time: all are put in order
                q = np.repeat(queues, many)
                t = np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many) + low[q]
                both = np.lexsort((np.concatenate([2 * q + 1, 2 * k]), np.concatenate([(t + 0.5) / self.p[q], v])))
                ahead = np.cumsum(both < len(q))
                out[some[both[both >= len(q)] - len(q)]] = low.sum() + ahead[both >= len(q)]
                continue
            n = self._due(v)
            last, following = (n - 0.5) / self.p, (n + 0.5) / self.p
            v, behind = v[:, None], queues[None, :] >= k[:, None]
            n -= (n > 0) & ((last > v) | ((last == v) & behind))
            n += (n < self.totals) & ((following < v) | ((following == v) & ~behind))
            out[some] = n.sum(1)
        return out

    def windows(self) -> int:
        return -(-self.all // self.size)

    def window_of(self, queues: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The window that holds each token of a queue: near its rank by due time, found by bisection."""
        last = self.windows()
        near = self._due((tokens + 0.5) / self.p[queues]).sum(1) // self.size
        lo, hi = np.clip(near - 2, 0, last - 1), np.clip(near + 3, 1, last)
        at = lambda w: self.sent(w)[np.arange(len(w)), queues]
        lo, hi = np.where(at(lo) <= tokens, lo, 0), np.where(at(hi) > tokens, hi, last)
        while (hi - lo > 1).any():
            mid = (lo + hi) // 2
            below = at(mid) <= tokens
            lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        return lo


class Schedule:
    """Blocks of windows' states, of which a bounded number of bytes is kept."""

    def __init__(self, drr: DeficitRoundRobin):
        self.drr, self.known = drr, {}
        self.most = max(2, KEEP_BYTES // ((WINDOWS + 1) * len(drr.totals) * 16))

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens sent by each queue before windows b * WINDOWS and on, and what earlier queues put into each window."""
        if b not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            sent = self.drr.sent(np.arange(b * WINDOWS, (b + 1) * WINDOWS + 1))
            part = np.diff(sent, axis=0)
            self.known[b] = sent, np.cumsum(part, 1) - part
        return self.known[b]


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Stored table: part, queue, doc_id, ids (little-endian, `width` bytes each), n_tokens, before (tokens of the queue
    ahead in this part)."""
    rows = masked(docs, doc_id="doc_id", text="text", source="source").select("doc_id", "text", F.col("source").cast("string").alias("source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .tokens import encoder

        enc = encoder(tokenizer)
        kind = "<u2" if max(enc.vocab, end_id + 1) <= 1 << 16 else "<u4"
        part, ahead = TaskContext.get().partitionId(), {}
        for batch in slices(batches, "text", 2 << 20):
            sources = column(batch, "source").to_pylist()
            ids, counts = enc.encode_closed(column(batch, "text"), end_id)
            ids = np.ascontiguousarray(ids.astype(kind))
            ends = np.concatenate([[0], np.cumsum(counts) * ids.itemsize]).astype(np.int32)
            before = []
            for source, n in zip(sources, counts.tolist(), strict=True):
                before.append(ahead.get(source, 0))
                ahead[source] = before[-1] + n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(counts), pa.int32()),
                    pa.array(sources, pa.string()),
                    column(batch, "doc_id"),
                    pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(ids)]),
                    pa.array([ids.itemsize] * len(counts), pa.int32()),
                    pa.array(counts, pa.int64()),
                    pa.array(before, pa.int64()),
                ],
                names=["part", "queue", "doc_id", "ids", "width", "n_tokens", "before"],
            )

    kinds = "part int, queue string, doc_id long, ids binary, width int, n_tokens long, before long"
    return stored(map_arrow(rows, run, with_id(kinds, rows)), "pack-ids")


def with_id(schema: str, docs: DataFrame) -> StructType:
    """The schema with doc_id of the type that it has in docs."""
    own = docs.schema["doc_id"].dataType
    return StructType([StructField(f.name, own if f.name == "doc_id" else f.dataType) for f in StructType.fromDDL(schema)])


def _cut(queues: list, totals: list[int], shares: list[float], size: int):
    index = {q: i for i, q in enumerate(queues)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Schedule(DeficitRoundRobin(totals, shares, size))
        for big in batches:
            for batch in slices(iter([big]), "ids"):
                yield _pieces(batch, plan, index)

    return run


def _pieces(batch: pa.RecordBatch, plan: Schedule, index: dict) -> pa.RecordBatch:
    """Pieces of a batch of placed documents: where the windows' bounds of its queue cut each."""
    queue = np.asarray([index[s] for s in column(batch, "queue").to_pylist()], dtype=np.int64)
    n, first = (column(batch, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n_tokens", "first"))
    order = np.lexsort((first, queue))
    q, starts, stops = queue[order], first[order], (first + n)[order]
    # Documents of a queue mostly follow each other here; a gap begins another run of windows.
    new = np.flatnonzero((np.diff(q) != 0) | (starts[1:] - stops[:-1] > GAP)) + 1
    runs = np.concatenate([[0], new, [len(q)]])
    lo, hi = plan.drr.window_of(q[runs[:-1]], starts[runs[:-1]]), plan.drr.window_of(q[runs[1:] - 1], stops[runs[1:] - 1] - 1)
    found = []
    for i in range(len(lo)):
        mine, own = slice(runs[i], runs[i + 1]), order[runs[i] : runs[i + 1]]
        for b in range(int(lo[i]) // WINDOWS, int(hi[i]) // WINDOWS + 1):
            sent, ahead = (x[:, q[runs[i]]] for x in plan.block(b))
            s, e = starts[mine], stops[mine]
            f = np.maximum(np.searchsorted(sent, s, "right") - 1, 0)
            z = np.minimum(np.searchsorted(sent, e, "left"), WINDOWS)
            many = np.maximum(z - f, 0)
            k = np.repeat(np.arange(len(own)), many)
            v = f[k] + np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many)
            begin, end = np.maximum(s[k], sent[v]), np.minimum(e[k], sent[v + 1])
            ok = begin < end
            k, v, begin, end = k[ok], v[ok], begin[ok], end[ok]
            found.append((own[k], begin - s[k], end - begin, b * WINDOWS + v, ahead[v] + begin - sent[v]))
    row, start, length, window, offset = (np.concatenate(x) for x in zip(*found, strict=True))
    ids = column(batch, "ids").cast(pa.large_binary())
    ends = np.frombuffer(ids.buffers()[1], dtype=np.int64)[ids.offset : ids.offset + len(ids)]
    data, width = ids.buffers()[2], column(batch, "width")[0].as_py()
    whole = np.frombuffer(data, dtype=f"<u{width}", offset=int(ends[0]) % width, count=(len(data) - int(ends[0]) % width) // width)
    low = (ends[row] - int(ends[0]) % width) // width + start
    crc = zlib.crc32
    crcs = [crc(whole[a : a + m].astype("<u4")) for a, m in zip(low.tolist(), length.tolist(), strict=True)]
    rows = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [column(batch, "doc_id").take(rows), column(batch, "queue").take(rows), *(pa.array(x) for x in (start, length)), pa.array(crcs, pa.int64()),
         *(pa.array(x) for x in (n[row], window, offset))],
        names=["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    )


#: Tokens of a queue to a row while queues are spread out.
BLOCK = 4096
#: Tokens of a stretch, by which documents meet runs.
STRETCH = 256
#: Blocks of windows whose states are filled in together.
GROUP = 4096


def _small_tokens(shares: DataFrame, whole: float, drr: DeficitRoundRobin, names: list) -> DataFrame:
    """shares(queue, n, share) of small queues -> stored (queue, t, rank, window), a row for each of their tokens: rank is
    its place among all these tokens, window what follows from it and from the large queues' tokens before it."""
    spark = shares.sparkSession
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(shares.agg(F.sum("n").alias("n")).first()["n"] or 0) // 4_000_000))
    blocks = shares.select("queue", "n", (F.col("share") / F.lit(whole)).alias("p"), blocks.alias("b")).repartition(parts)
    tokens = F.sequence(F.col("b") * BLOCK, F.least(F.col("n"), (F.col("b") + 1) * BLOCK) - 1)
    tokens = blocks.select("queue", "p", F.explode(tokens).alias("tie"))
    tokens = tokens.select(F.lit("").alias("key"), "queue", "tie", ((F.col("tie") + 0.5) / F.col("p")).alias("due"))
    tokens = ranked(tokens, ["due", "queue"], parts).select("queue", F.col("tie").alias("t"), "due", "rank")
    size, keys = drr.size, [(q is not None, q) for q in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = column(batch, "queue").dictionary_encode()
            place = np.array([*(bisect_left(keys, (True, q)) for q in coded.dictionary.to_pylist()), 0])
            place = place[coded.indices.fill_null(len(place) - 1).to_numpy()]  # a null queue is the first
            rank = column(batch, "rank").to_numpy()
            window = (rank + drr.before(column(batch, "due").to_numpy(), place)) // size
            yield pa.RecordBatch.from_arrays([column(batch, "queue"), column(batch, "t"), pa.array(rank), pa.array(window)], names=["queue", "t", "rank", "window"])

    return stored(map_arrow(tokens, run, "queue string, t long, rank long, window long"), "pack-small")


def _large_runs(small: DataFrame, every: int, drr: DeficitRoundRobin, names: list) -> DataFrame:
    """runs(queue, window, start, count) of the large queues, of which a window holds what the small ones leave."""
    spark, size = small.sparkSession, drr.size
    last = -(-every // size)
    counts = small.groupBy("window").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    counts = counts.groupBy(F.floor(F.col("window") / WINDOWS).alias("block")).agg(F.min("first").alias("first"), F.collect_list(F.struct("window", "n")).alias("counts"))
    blocks = spark.range(-(-last // WINDOWS)).withColumnRenamed("id", "block").join(counts, "block", "left").withColumn("group", F.floor(F.col("block") / GROUP))
    blocks = stored(blocks, "pack-blocks")
    # A block without small tokens has before it all that go before the next one there is; one row a group of blocks is in one place.
    behind = lambda w: w.rowsBetween(1, Window.unboundedFollowing)
    groups = blocks.groupBy("group").agg(F.min("first").alias("f"))
    groups = groups.select("group", F.min("f").over(behind(Window.orderBy("group"))).alias("later"))
    near = F.min("first").over(behind(Window.partitionBy("group").orderBy("block")))
    blocks = blocks.withColumn("near", near).join(groups, "group")
    blocks = blocks.select("block", F.coalesce("first", "near", "later", F.lit(every - drr.all)).alias("ahead"), "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ahead, counts in zip(*(column(batch, c).to_pylist() for c in ("block", "ahead", "counts")), strict=True):
                windows = np.arange(block * WINDOWS, min(last, (block + 1) * WINDOWS) + 1)
                mine = np.zeros(len(windows), dtype=np.int64)
                for c in counts or ():
                    mine[c["window"] - windows[0] + 1] = c["n"]
                sent = drr.sent_of(np.minimum(windows * size, every) - ahead - np.cumsum(mine))
                part = np.diff(sent, axis=0)
                at, queue = np.nonzero(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()).take(pa.array(queue)), *(pa.array(x) for x in (windows[at], sent[at, queue], part[at, queue]))],
                    names=["queue", "window", "start", "count"],
                )

    return map_arrow(blocks, run, "queue string, window long, start long, count long")


def _queue_runs(totals: DataFrame, targets: dict | None, size: int) -> DataFrame:
    """totals(queue, n) -> stored runs(queue, window, start, count, offset): the tokens of each queue in each window, by their due times."""
    spark = totals.sparkSession
    every = totals.agg(F.sum("n").alias("n")).first()["n"]
    given = spark.createDataFrame([(q, float(x)) for q, x in (targets or {}).items()], "q string, share double")
    shares = totals.join(F.broadcast(given), F.col("queue").eqNullSafe(F.col("q")), "left")
    shares = stored(shares.select("queue", "n", F.coalesce("share", F.col("n") / F.lit(float(every))).alias("share")), "pack-shares")
    whole = shares.agg(F.sum("share").alias("s")).first()["s"]
    is_large = (F.col("n") * MAX_QUEUES > every) | (F.col("share") * MAX_QUEUES > whole)
    large = sorted(shares.where(is_large).collect(), key=lambda r: (r["queue"] is not None, r["queue"]))  # at most 2 * MAX_QUEUES
    names, drr = [r["queue"] for r in large], DeficitRoundRobin([r["n"] for r in large], [r["share"] for r in large], size, whole)
    small = _small_tokens(shares.where(~is_large), whole, drr, names)
    runs = small.groupBy("window", "queue").agg(F.min("t").alias("start"), F.count("*").alias("count"))
    if large:
        runs = runs.unionByName(_large_runs(small, every, drr, names))
    before = Window.partitionBy("window").orderBy(F.asc_nulls_first("queue")).rowsBetween(Window.unboundedPreceding, -1)
    return stored(runs.withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0).cast("long"))), "pack-runs")


def _cut_many(placed: DataFrame, totals: DataFrame, targets: dict | None, size: int) -> DataFrame:
    """What _cut() gives, for any number of queues.  A document is known by its queue and first token, as each has a token."""
    runs = _queue_runs(totals, targets, size)
    stretches = lambda at, n: F.explode(F.sequence(F.floor(at / STRETCH), F.floor((at + n - 1) / STRETCH))).alias
    docs = placed.select("queue", "first", "n_tokens", stretches(F.col("first"), F.col("n_tokens"))("b"))
    runs = runs.select(F.col("queue").alias("q"), "window", "start", "count", "offset", stretches(F.col("start"), F.col("count"))("rb"))
    begin, end = F.greatest("first", "start"), F.least(F.col("first") + F.col("n_tokens"), F.col("start") + F.col("count"))
    # Both meet in each stretch that they share; the one where their common part begins counts.
    met = docs.join(runs, docs["queue"].eqNullSafe(runs["q"]) & (docs["b"] == runs["rb"])).where((begin < end) & (F.col("b") == F.floor(begin / STRETCH)))
    piece = F.struct((begin - F.col("first")).alias("at"), (end - begin).alias("length"), "window", (F.col("offset") + begin - F.col("start")).alias("offset"))
    cuts = met.groupBy(F.col("queue").alias("q"), F.col("first").alias("f")).agg(F.collect_list(piece).alias("cuts"))
    whole = placed.join(cuts, placed["queue"].eqNullSafe(cuts["q"]) & (placed["first"] == cuts["f"])).drop("q", "f")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(iter([big]), "ids"):
                out = []
                for source, doc, raw, width, n, cuts in zip(
                    *(column(batch, c).to_pylist() for c in ("queue", "doc_id", "ids", "width", "n_tokens", "cuts")), strict=True
                ):
                    ids = np.frombuffer(raw, dtype=f"<u{width}").astype("<u4")
                    out += [
                        (doc, source, c["at"], c["length"], zlib.crc32(ids[c["at"] : c["at"] + c["length"]]), n, c["window"], c["offset"])
                        for c in cuts
                    ]
                kinds = [column(batch, "doc_id").type, pa.string(), *[pa.int64()] * 6]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, kind) for v, kind in zip(zip(*out, strict=True), kinds, strict=True)],
                    names=["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )

    return map_arrow(whole, run, with_id(PIECES, placed))


PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048, targets: dict | None = None) -> DataFrame:
    """Pieces of documents in windows of `size` tokens: doc_id, source, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.  Ids may be of any type.  targets: shares by source (any positive numbers); sources without one share by their tokens."""
    spark = docs.sparkSession
    ids = encode_documents(docs, tokenizer, end_id)
    parts = ids.groupBy("part", "queue").agg(F.sum("n_tokens").alias("n"))
    parts = parts_n = stored(parts, "pack-parts")
    ahead = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", "queue", F.coalesce(F.sum("n").over(ahead), F.lit(0).cast("long")).alias("ahead"))
    parts = small_side(stored(parts, "pack-starts"), 64)
    placed = ids.join(parts, (ids["part"] == parts["part"]) & ids["queue"].eqNullSafe(parts["queue"]), "inner").select(
        ids["queue"], "doc_id", "ids", "width", "n_tokens", (F.col("before") + F.col("ahead")).alias("first")
    )
    totals = stored(parts_n.groupBy("queue").agg(F.sum("n").alias("n")), "pack-queues")
    if totals.count() > MAX_QUEUES:
        return _cut_many(placed, totals, targets, size)
    # Bounded by MAX_QUEUES rows.
    found = sorted(totals.collect(), key=lambda r: (r["queue"] is not None, r["queue"]))
    queues, sums = [r["queue"] for r in found], [r["n"] for r in found]
    shares = [float((targets or {}).get(q, n / max(1, sum(sums)))) for q, n in zip(queues, sums, strict=True)]
    schema = with_id(PIECES, ids)
    return map_arrow(placed, _cut(queues, sums, shares, size), schema) if queues else spark.createDataFrame([], schema)


def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
