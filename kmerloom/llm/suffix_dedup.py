"""Operator 6: exact substring dedup with suffix order and longest-previous-factor arrays.

A byte is repeated if a window of `length` bytes over it also starts elsewhere.  Equal windows select equal places: of all
runs of `gram` = length / 2 bytes in a window, that with the least hash (all of them, where equal) is an anchor, at the
same distance in each copy of the window.  So:

1. Each document's anchors are found with sliding minima: about one in a hundred bytes at length 400.
2. Anchors whose run occurs once in all the corpus are dropped.  The context of an anchor is all that windows over it can
   reach.  Anchors with equal contexts are copies throughout; one of each such class goes on, as does each
   anchor with a context of its own, where its run has several classes.  These are the borders of repeated passages.
3. Contexts of the same runs meet in a task, in batches of bounded size.  There the suffixes at their anchors are sorted,
   which puts their windows in suffix order; previous and next smaller positions give each window's longest earlier
   match up to `length` (the longest-previous-factor array), and windows that have one, or are one, are marked.
   A run with more than BLOCK_CLASSES classes is first cut into blocks of its suffix order: windows that begin lo to hi bytes
   before the anchor can only match if the lo bytes before and the length - hi bytes behind it are equal, so contexts are
   dealt by those; blocks that are still too large are halved in lo..hi.  Where the contexts of a block are equal in all
   that its windows cover, each window is the longest match of all the others.
4. Marked windows of a document are joined into spans.

Positions are ordered by (key, byte), so "first" is in the document with the smallest id.  keep="first" removes later copies only, keep="none" every copy.
Null text: empty.  Texts shorter than `length` have no windows.  Matches never cross documents.  Ids that are null or
repeated are replaced by row numbers inside; equal rows are separate documents.  Other columns are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, fresh, join_counted, map_arrow, masked, slices, small_side, stored, texts_of

#: Bytes of text of which anchors are found at once.
STRETCH = 1 << 20
#: Context bytes that are sorted at once.
SORT_BYTES = 1 << 20
#: Most contexts that are sorted together, some 20 MB of text at length 400; runs with more are cut into blocks.
BLOCK_CLASSES = 32768
#: Windows that are put in order at once.
WINDOWS = 1 << 18

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_MULT = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def run_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every run of `gram` bytes, by doubling."""
    power, size, done, width = _BYTE[data], 1, None, 0
    level = 0
    while True:
        if gram & size:
            if done is None:
                done, width = power, size
            else:
                n = len(power) - width
                done = done[:n] * _MULT[32 + level] + power[width : width + n]
                width += size
        if size * 2 > gram:
            break
        power = power[:-size] * _MULT[level] + power[size:]
        size, level = size * 2, level + 1
    out = done[: len(data) - gram + 1].copy()
    out ^= out >> np.uint64(29)
    out *= _MULT[63]
    out ^= out >> np.uint64(32)
    return out


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of every `width` neighbours."""
    out, size = values, 1
    while size * 2 <= width:
        out, size = best(out[:-size], out[size:]), size * 2
    if size < width:
        n = len(values) - width + 1
        out = best(out[:n], out[width - size : width - size + n])
    return out


def anchors(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchor runs of a text."""
    if len(text) < length:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    width = length - gram + 1
    places, hashes = [], []
    data = np.frombuffer(text, dtype=np.uint8)
    for at in range(0, len(text) - length + 1, STRETCH):
        h = run_hashes(data[at : at + STRETCH + length - 1], gram)
        low = _sliding(h, width, np.minimum)
        pad = np.zeros(width - 1, dtype=np.uint64)
        reach = _sliding(np.concatenate([pad, low, pad]), width, np.maximum)
        got = np.flatnonzero(h == reach)
        places.append(got + at)
        hashes.append(h[got])
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def _anchor_rows(length: int, gram: int):
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            keys, places, runs, contexts, spans = [], [], [], [], []
            for key, text in zip(column(batch, "key").to_pylist(), texts_of(batch, "text"), strict=True):
                place, hashes = anchors(text, length, gram)
                keys.append(np.full(len(place), key, dtype=np.int64))
                places.append(place)
                runs.append(hashes.view(np.int64))
                spans.append(np.minimum(len(text) - place, length))
                contexts += [
                    xxhash.xxh3_64_intdigest(text[max(0, p - reach) : p + length], min(p, reach)) for p in place.tolist()
                ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(keys)),
                    pa.array(np.concatenate(places)),
                    pa.array(np.concatenate(spans).astype(np.int32)),
                    pa.array(np.concatenate(runs)),
                    pa.array(np.asarray(contexts, dtype=np.uint64).view(np.int64)),
                ],
                names=["key", "p", "span", "run", "context"],
            )

    return run


def sorted_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes (as byte + 1, 0 behind the end) in lexicographic order, and each one's common length with the one before."""
    order = np.argsort(np.ascontiguousarray(rows.astype(">u2")).view(f"S{2 * rows.shape[1]}").ravel(), kind="stable")
    common = np.zeros(len(order), dtype=np.int32)
    for at in range(1, len(order), 4096):
        a, b = rows[order[at - 1 : at + 4095]], rows[order[at : at + 4096]]
        differ = (a[: len(b)] != b) | (b == 0)
        common[at : at + 4096] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return order, common


class RangeMin:
    """Minima of ranges of an array, by a sparse table."""

    def __init__(self, values: np.ndarray):
        self.table = [values]
        while 2 ** len(self.table) <= len(values):
            last, size = self.table[-1], 2 ** (len(self.table) - 1)
            self.table.append(np.minimum(last[:-size], last[size:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """min of values[lo..hi], for lo <= hi."""
        out = np.empty(len(lo), dtype=self.table[0].dtype)
        level = np.frexp(hi - lo + 1)[1] - 1
        for k in np.unique(level):
            m = np.flatnonzero(level == k)
            out[m] = np.minimum(self.table[k][lo[m]], self.table[k][hi[m] - 2**k + 1])
        return out


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value to the left of each, -1 for none, by pointer jumping."""
    guess = np.arange(-1, len(values) - 1)
    while True:
        bad = np.flatnonzero((guess >= 0) & (values[guess] >= values))
        if not len(bad):
            return guess
        guess[bad] = guess[guess[bad]]


def longest_previous_factor(order: np.ndarray, place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For suffixes in suffix order: the longest match with one at a smaller place, from the previous and next smaller.

    order: suffixes; place: their places; lcp[i]: common length of order[i - 1] and order[i], capped at what callers need.
    """
    n = len(order)
    at = place[order]
    prev, nxt = nearest_smaller(at), n - 1 - nearest_smaller(at[::-1])[::-1]
    least, i = RangeMin(lcp), np.arange(n)
    best = np.zeros(n, dtype=lcp.dtype)
    ok = prev >= 0
    best[ok] = least(prev[ok] + 1, i[ok])
    ok = nxt < n
    best[ok] = np.maximum(best[ok], least(i[ok] + 1, nxt[ok]))
    out = np.zeros(n, dtype=lcp.dtype)
    out[order] = best
    return out


def marked_windows(
    texts: list[bytes], docs: np.ndarray, starts: np.ndarray, at: np.ndarray, runs: np.ndarray, length: int, gram: int,
    least_x: np.ndarray | None = None, most_x: np.ndarray | None = None,
) -> tuple[np.ndarray, ...]:
    """Windows over the anchors of contexts that are repeated in contexts of the same run (or block of a run).

    Only windows that begin least_x to most_x bytes before their anchors are looked at, where these are given.  Context i is a part of document docs[i] from byte starts[i]; its anchor lies at byte at[i] of it.  Returns document,
    byte, has an earlier match, in the order of document and byte.

    The suffixes at the anchors are sorted (a sparse suffix array), and so are the texts before them, read backwards.
    Windows that start x bytes before their anchors are in suffix order once they are grouped by the x bytes (equal places
    in the backward order) and sorted by the anchors' suffixes.
    """
    n, reach = len(texts), length - gram
    sizes = np.asarray([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    base = np.cumsum(sizes) - sizes
    group = np.unique(runs, return_inverse=True)[1]
    tags = np.stack([group // 32768 + 1, group % 32768 + 1], axis=1).astype(np.uint16)

    def rows(from_anchor: np.ndarray) -> np.ndarray:
        """A row per context: its tags, then the bytes at these distances from its anchor, plus 1; 0 outside."""
        out = np.zeros((n, 2 + len(from_anchor)), dtype=np.uint16)
        out[:, :2] = tags
        for i in range(0, n, 2048):
            offset = at[i : i + 2048, None] + from_anchor
            inside = (offset >= 0) & (offset < sizes[i : i + 2048, None])
            out[i : i + 2048, 2:] = np.where(inside, data[np.where(inside, base[i : i + 2048, None] + offset, 0)].astype(np.uint16) + 1, 0)
        return out

    order_r, lcp_r = sorted_rows(rows(np.arange(length)))
    order_l, lcp_l = sorted_rows(rows(-1 - np.arange(reach)))
    # The tags are two places ahead of the bytes; other runs share nothing.
    lcp_r, lcp_l = np.maximum(lcp_r - 2, 0), np.maximum(lcp_l - 2, 0)
    rank_r, rank_l = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    rank_r[order_r] = rank_l[order_l] = np.arange(n)
    near = lambda lcp, rank: np.maximum(lcp, np.append(lcp[1:], 0))[rank]
    # No window can match that needs more on a side than the nearest neighbour there has in common.
    first = np.maximum(length - near(lcp_r, rank_r), 0)
    last = np.minimum(np.minimum(near(lcp_l, rank_l), reach), at)
    if least_x is not None:
        first, last = np.maximum(first, least_x), np.minimum(last, most_x)
    least, where = RangeMin(lcp_r), (np.unique(docs, return_inverse=True)[1] << 40) + starts + at
    per_x = np.bincount(first[first <= last], minlength=reach + 2) - np.bincount(last[first <= last] + 1, minlength=reach + 2)
    due, found = np.cumsum(np.cumsum(per_x)), []
    x0 = 0
    while x0 <= reach:  # windows of as many distances as make about WINDOWS of them; distances don't meet
        x1 = max(x0 + 1, int(np.searchsorted(due, (due[x0 - 1] if x0 else 0) + WINDOWS, "right")))
        lo, hi = np.maximum(first, x0), np.minimum(last, x1 - 1)
        many = np.maximum(hi - lo + 1, 0)
        owner = np.repeat(np.arange(n), many)
        x = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + lo[owner]
        depths, x0 = np.arange(x0, min(x1, reach + 1)), x1
        if not len(x):
            continue
        # Of each depth and place in the backward order: where the run of texts with the same bytes to that depth begins.
        head = np.maximum.accumulate(np.where(lcp_l[None, :] < depths[:, None], np.arange(n, dtype=np.int32), 0), axis=1)
        same = x * n + head[x - depths[0], rank_l[owner]]
        order = np.argsort(same * n + rank_r[owner], kind="stable")
        lcp = np.zeros(len(order), dtype=np.int32)
        pair = np.flatnonzero(np.diff(same[order]) == 0)
        before, after = rank_r[owner[order[pair]]], rank_r[owner[order[pair + 1]]]
        lcp[pair + 1] = np.minimum(x[order[pair]] + least(before + 1, after), length)
        place = where[owner] - x
        later = longest_previous_factor(order, place, lcp) >= length
        run = np.cumsum(lcp < length) - 1
        repeated = np.zeros(len(order), dtype=bool)
        repeated[order] = np.bincount(run)[run] > 1
        keep = np.flatnonzero(repeated)
        found.append((place[keep], owner[keep], (starts + at)[owner[keep]] - x[keep], later[keep]))
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=bool)
    place, owner, byte, later = (np.concatenate(f) for f in zip(*found, strict=True))
    order = np.argsort(place, kind="stable")
    return docs[owner[order]], byte[order], later[order]


def spans_of(doc: np.ndarray, byte: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, in the order of (doc, byte), joined where they touch: document, start, end."""
    if not len(doc):
        return doc, byte, byte
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(byte) > length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], byte[first], byte[last] + length


def _sort_contexts(length: int, gram: int, later_only: bool):
    names = ("block", "key", "start", "at", "lo", "hi", "context_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, size
            *numbers, texts = zip(*rows, strict=True)
            blocks, docs, starts, at, lo, hi = (np.asarray(x) for x in numbers)
            doc, byte, later = marked_windows(list(texts), docs, starts, at, blocks, length, gram, lo, hi)
            if later_only:
                doc, byte = doc[later], byte[later]
            rows, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in spans_of(doc, byte, length)], names=["key", "s", "e"])

        for batch in batches:
            for row in zip(*(column(batch, c).to_pylist() for c in names), strict=True):
                if size >= SORT_BYTES and rows[-1][0] != row[0]:
                    yield flush()
                rows.append(row)
                size += len(row[-1])
        if rows:
            yield flush()

    return run


def _contexts(length: int, gram: int):
    """Context texts of the anchors listed in `need`."""
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            runs, keys, starts, places, texts = [], [], [], [], []
            for key, text, need in zip(column(batch, "key").to_pylist(), texts_of(batch, "text"), column(batch, "need").to_pylist(), strict=True):
                for x in need:
                    s = max(0, x["p"] - reach)
                    runs.append(x["run"])
                    keys.append(key)
                    starts.append(s)
                    places.append(x["p"] - s)
                    texts.append(text[s : x["p"] + length])
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in (runs, keys, starts, places)), pa.array(texts, pa.binary())],
                names=["block", "key", "start", "at", "context_text"],
            )

    return run


def _halves(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """rows(block, key, start, at, context_text, lo, hi) -> two rows each, for the halves of lo..hi: `block` says what windows
    need to be equal there, and `all` what the half's windows cover in all, as hashes."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    half = lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))
    both = F.when(F.col("lo") == F.col("hi"), F.array(half(F.col("lo"), F.col("hi")))).otherwise(
        F.array(half(F.col("lo"), middle), half(middle + 1, F.col("hi")))
    )
    rows = rows.withColumn("h", F.explode(both)).drop("lo", "hi").select("*", "h.*").drop("h")
    lo, hi, at, size = F.col("lo"), F.col("hi"), F.col("at").cast("int"), F.octet_length("context_text")
    rows = rows.where((at >= lo) & (size - at >= length - hi))  # a window fits
    far, end = F.least(hi, at), F.least(F.lit(length) - lo, size - at)
    part = lambda back, ahead: F.xxhash64("block", lo, F.substring(F.col("context_text"), at - back + 1, back + ahead), back)
    return rows.withColumn("all", part(far, end)).withColumn("block", part(lo, F.lit(length) - hi))


def _large_runs(rows: DataFrame, length: int, gram: int, keep: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Contexts of runs with more than BLOCK_CLASSES of them -> (contexts in blocks of at most so many, or None; spans of
    repeated windows, or None)."""
    few, spans = None, None
    rows = stored(rows.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(length - gram)), "large-runs")
    while not rows.isEmpty():
        rows = stored(_halves(rows, length, gram), "blocks")
        first = F.min(F.struct("key", (F.col("start") + F.col("at")).alias("p"))).alias("first")
        blocks = rows.groupBy("block").agg(F.count("*").alias("n"), (F.min("all") == F.max("all")).alias("same"), first)
        blocks = stored(blocks.where("n > 1"), "block-sizes")
        rows = stored(join_counted(rows, blocks, ["block"], "n", rows.count()), "block-rows")
        same = rows.where("same")
        if keep == "first":
            same = same.where(F.struct("key", F.col("start") + F.col("at")) != F.struct("first.key", "first.p"))
        size = F.octet_length("context_text") - F.col("at")
        p = F.col("start") + F.col("at")
        same = same.select(
            "key", (p - F.least("hi", "at")).alias("s"), (p - F.greatest(F.col("lo"), F.lit(length) - size) + length).alias("e")
        )
        mixed = rows.where("not same").select("block", "key", "start", "at", "context_text", "lo", "hi", "n")
        small = mixed.where(F.col("n") <= BLOCK_CLASSES).drop("n")
        spans = same if spans is None else spans.unionByName(same)
        few = small if few is None else few.unionByName(small)
        rows = stored(mixed.where(F.col("n") > BLOCK_CLASSES).drop("n"), "large-blocks")
    return few, spans


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for spans in column(batch, "spans").to_pylist():
            spans = sorted((x["s"], x["e"]) for x in spans)
            merged: list[list[int]] = []
            for s, e in spans:
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            out.append([{"s": s, "e": e} for s, e in merged])
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        yield pa.RecordBatch.from_arrays([column(batch, "key"), pa.array(out, kind)], names=["key", "spans"])


def repeated_spans(docs: DataFrame, length: int = 400, keep: str = "none") -> DataFrame:
    """docs(key, text) with unique non-null keys -> stored table (key, spans: merged byte ranges to remove)."""
    gram = length // 2
    reach = length - gram
    found = stored(map_arrow(docs, _anchor_rows(length, gram), "key long, p long, span int, run long, context long"), "anchors")
    often = stored(found.groupBy("run").agg(F.count("*").alias("n")).where("n > 1"), "repeated-runs")
    found = stored(join_counted(found, often, ["run"], "n", found.count()).drop("n"), "repeated-anchors")
    classes = found.groupBy("run", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "p")).alias("first"))
    classes = stored(classes, "context-classes")
    copies = join_counted(found, stored(classes.where("n > 1"), "copied-contexts"), ["run", "context"], "n", found.count())
    if keep == "first":
        copies = copies.where(F.struct("key", "p") != F.col("first"))
    whole = copies.select("key", F.greatest(F.lit(0), F.col("p") - reach).alias("s"), (F.col("p") + F.col("span")).alias("e"))

    borders = stored(classes.groupBy("run").agg(F.count("*").alias("kinds")).where("kinds > 1"), "run-kinds")
    borders = join_counted(classes.select("run", "first"), borders, ["run"], "kinds", classes.count())
    borders = stored(borders.select("run", "kinds", "first.key", "first.p"), "borders")

    def contexts(part: DataFrame) -> DataFrame:
        need = part.groupBy("key").agg(F.collect_list(F.struct("p", "run")).alias("need"))
        # No broadcast: borders grow with the corpus, and the plan is to be the same at every size.
        need = stored(need, "context-needs").hint("merge")
        schema = "block long, key long, start long, at long, context_text binary"
        return map_arrow(docs.join(need, "key").select("key", "text", "need"), _contexts(length, gram), schema)

    few = contexts(borders.where(F.col("kinds") <= BLOCK_CLASSES)).withColumn("lo", F.lit(0)).withColumn("hi", F.lit(reach))
    large = borders.where(F.col("kinds") > BLOCK_CLASSES)
    more = None
    if not large.isEmpty():
        blocks, more = _large_runs(contexts(large), length, gram, keep)
        few = few.unionByName(blocks.select(*few.columns))
    few = few.repartition("block").sortWithinPartitions("block")
    spans = map_arrow(few, _sort_contexts(length, gram, keep == "first"), "key long, s long, e long")
    if more is not None:
        spans = spans.unionByName(more)
    spans = spans.unionByName(whole)
    lists = spans.groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return stored(map_arrow(lists, _merge, "key long, spans array<struct<s:long,e:long>>"), "repeated-spans")


def with_spans(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 400, keep: str = "none", name: str = "__spans"
) -> DataFrame:
    """docs with one more column: the byte ranges of their texts to remove, null for none."""
    (key,) = fresh(docs, "__key")
    whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    rows, ids = docs.agg(F.count("*"), F.count_distinct(id_col)).first() if whole else (1, 0)
    if rows == ids:
        docs = docs.withColumn(key, F.col(id_col).cast("long"))
    else:
        docs = stored(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    spans = repeated_spans(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), length, keep)
    spans = small_side(spans.select(F.col("key").alias(key), F.col("spans").alias(name)), 24 + 16 * F.size(name))
    return docs.join(spans, key, "left").drop(key)


def cut(text: bytes, spans: list[dict] | None) -> bytes:
    """text without its spans."""
    if not spans:
        return text
    out, at = [], 0
    for x in spans:
        out.append(text[at : x["s"]])
        at = x["e"]
    return b"".join([*out, text[at:]])


def suffix_dedup(docs: DataFrame, length: int = 400, keep: str = "first", text: str = "text") -> DataFrame:
    """docs with later copies (or, keep="none", all copies) cut out of the text; other columns as they were.

    A character that a cut splits is dropped whole, so texts stay valid UTF-8.  Rows are known by their ids if these are whole numbers
    and all different, else by numbers of their own; other columns may have any names and types.
    """
    work, name = masked(docs, doc_id="doc_id", text=text), "__spans"
    marked = with_spans(work, length=length, keep=keep, name=name).select(*work.columns, name)
    at, text = work.columns.index("text"), "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = column(batch, text).cast(pa.binary()).to_pylist()
            spans = column(batch, name).to_pylist()
            new = [t.decode() if t is not None and not s else t and cut(t, s).decode("utf-8", "ignore") for t, s in zip(texts, spans, strict=True)]
            new = ["" if x == b"" else x for x in new]
            arrays = [pa.array(new, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names[:-1])

    return map_arrow(marked, run, work.schema).toDF(*docs.columns)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts, spans = texts_of(batch, "text"), column(batch, "__spans").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                column(batch, "doc_id"),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([sum(x["e"] - x["s"] for x in s or ()) for s in spans], pa.int64()),
                pa.array([len(s or ()) for s in spans], pa.int64()),
                pa.array([hashlib.sha256(cut(t, s)).hexdigest() for t, s in zip(texts, spans, strict=True)], pa.string()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = with_spans(docs, keep="none").select("doc_id", "text", "__spans")
    return map_arrow(marked, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
