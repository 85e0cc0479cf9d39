"""Operator 1: benchmark decontamination with suffix arrays over the training texts.

Training text is read in shards (a bounded run of a task's documents).  A shard's words become numbers of the
benchmark's vocabulary, 0 for any other word and between documents.  Its suffix array holds, in sorted order, the
suffixes that can begin with a benchmark window at all: those whose first words, as many as the shortest window has,
are all in the vocabulary.  Every benchmark suffix is then sought by binary search; the range of suffixes that begin with
its window gives all places, and windows that follow each other at one distance join into the longest verbatim match.

The benchmark is taken in blocks of at most BLOCK_BYTES of text, each against all documents, so what is broadcast is
bounded whatever the benchmark's size.  Documents are never shuffled by their texts: with several blocks each pass but the first
returns only a row's key and its matches, where it has some.

Words: `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.  A window is 13 consecutive words of an item; a shorter
item with words is one window.  Null texts and null items have no words.  Items with a null id make words hit but
aren't listed; equal item ids count once.  Each row of the documents gives one row, repeated rows too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_ALNUM, column, fresh, map_arrow, masked, slices, small_side, stored, texts_of, with_fields

#: Words of a window.
WINDOW = 13
#: Benchmark text that one pass over the documents holds.
BLOCK_BYTES = 8 << 20

MATCH = "array<struct<item_id:string,doc_start:long,item_start:long,words:long>>"
SPANS = "array<struct<s:long,e:long>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER_ALNUM).split()


class Probe:
    """One block of the benchmark: its vocabulary and its windows as sorted search keys."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.window = window
        self.ids = [i for i, _ in items]
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(items):
            codes = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            for at in range(max(1, len(codes) - window + 1) if codes else 0):
                found.setdefault(tuple(codes[at : at + window]), []).append((k, at))
        self.kind = ">u2" if len(self.vocab) < 65535 else ">u4"
        self.width = self.window * int(self.kind[2])
        windows = list(found)
        self.lengths = np.asarray([len(w) for w in windows], dtype=np.int64)
        self.least = int(self.lengths.min()) if windows else 0
        self.owners = list(found.values())
        full = np.zeros((len(windows), window), dtype=self.kind)
        for i, w in enumerate(windows):
            full[i, : len(w)] = w
        self.low = full.view(f"S{self.width}").ravel()
        top = full.copy()
        for i, w in enumerate(windows):
            top[i, len(w) :] = np.iinfo(self.kind).max
        self.high = top.view(f"S{self.width}").ravel()

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of all texts as numbers, a 0 after each text; each text's first place; its number of words."""
        get, codes, counts = self.vocab.get, [], []
        for text in texts:
            words = words_of(text)
            counts.append(len(words))
            codes.append(np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words)))
            codes.append(np.zeros(1, dtype=np.int64))
        sizes = np.asarray(counts, dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        return np.concatenate(codes) if codes else np.empty(0, dtype=np.int64), starts, sizes

    def suffix_array(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the suffixes that can begin with a window, in suffix order, and their first words as keys."""
        stops = np.flatnonzero(codes == 0)
        run = np.repeat(stops, np.diff(stops, prepend=-1)) - np.arange(len(codes))
        places = np.flatnonzero(run >= max(1, self.least))
        offset = np.arange(self.window)
        padded = np.concatenate([codes, np.zeros(self.window, dtype=np.int64)])
        keys = np.where(offset < run[places, None], padded[places[:, None] + offset], 0).astype(self.kind)
        keys = np.ascontiguousarray(keys).view(f"S{self.width}").ravel()
        order = np.argsort(keys, kind="stable")
        return places[order], keys[order]

    def matches(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[dict]], list[list[dict]]]:
        """Per text: number of words, longest matches with every item, and the hit words as spans."""
        codes, starts, sizes = self.encode(texts)
        empty: tuple[list, list] = ([[] for _ in texts], [[] for _ in texts])
        if not self.least or not len(codes):
            return sizes, *empty
        places, keys = self.suffix_array(codes)
        lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        hits = [
            (places[lo[u] : hi[u]], k, at, int(self.lengths[u]))
            for u in np.flatnonzero(hi > lo)
            for k, at in self.owners[u]
        ]
        if not hits:
            return sizes, *empty
        place = np.concatenate([h[0] for h in hits])
        reps = [len(h[0]) for h in hits]
        item, at, length = (np.repeat([h[j] for h in hits], reps) for j in (1, 2, 3))
        doc = np.searchsorted(starts, place, "right") - 1
        order = np.lexsort((place, place - at, item, doc))
        place, item, at, length, doc = (x[order] for x in (place, item, at, length, doc))
        new = np.ones(len(place), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(place) != 1) | (np.diff(at) != 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place)) - 1
        found, spans = empty
        for f, z in zip(first.tolist(), last.tolist(), strict=True):
            d = int(doc[f])
            s, e = int(place[f] - starts[d]), int(place[z] + length[z] - starts[d])
            found[d].append({"item_id": self.ids[item[f]], "doc_start": s, "item_start": int(at[f]), "words": e - s})
            spans[d].append({"s": s, "e": e})
        return sizes, found, [union(s) for s in spans]


def union(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for x in sorted(spans, key=lambda x: x["s"]):
        if out and x["s"] <= out[-1]["e"]:
            out[-1]["e"] = max(out[-1]["e"], x["e"])
        else:
            out.append(dict(x))
    return out


_ITEM = pa.struct([("item_id", pa.string()), *((n, pa.int64()) for n in ("doc_start", "item_start", "words"))])
_SPAN = pa.struct([("s", pa.int64()), ("e", pa.int64())])


def _scan(items: list[tuple[str | None, bytes]], text: str, window: int, names: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = Probe(items, window)
        for batch in slices(batches, text):
            sizes, found, spans = probe.matches(texts_of(batch, text))
            arrays = [batch.column(i) for i in range(batch.num_columns)]
            arrays += [pa.array(sizes, pa.int64()), pa.array(found, pa.list_(_ITEM)), pa.array(spans, pa.list_(_SPAN))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *names])

    return run


def _scan_more(items: list[tuple[str | None, bytes]], text: str, window: int, key: str):
    """Only keys and matches, of rows that have some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = Probe(items, window)
        for batch in slices(batches, text):
            _, found, spans = probe.matches(texts_of(batch, text))
            hit = [i for i, m in enumerate(found) if m]
            yield pa.RecordBatch.from_arrays(
                [column(batch, key).take(pa.array(hit, pa.int64())), pa.array([found[i] for i in hit], pa.list_(_ITEM)),
                 pa.array([spans[i] for i in hit], pa.list_(_SPAN))],
                names=["k", "m", "h"],
            )

    return run


def _merged(spans: Column) -> Column:
    """Spans joined where they overlap or touch."""
    none = F.array().cast(SPANS)
    last = lambda acc: F.element_at(acc, -1)
    joined = lambda acc, x: F.concat(
        F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["s"].alias("s"), F.greatest(last(acc)["e"], x["e"]).alias("e")))
    )
    step = lambda acc, x: F.when((F.size(acc) > 0) & (x["s"] <= F.try_element_at(acc, F.lit(-1))["e"]), joined(acc, x)).otherwise(
        F.concat(acc, F.array(x))
    )
    return F.aggregate(F.array_sort(spans), none, step)


def find_matches(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, names: tuple = ("__words", "__matches", "__spans")
) -> DataFrame:
    """docs with three more columns, by these names: words (count), matches (item_id, doc_start, item_start, words: longest
    verbatim matches of at least a window) and spans (hit words as merged [s, e)).  Columns of docs with these names are
    replaced; other names never clash."""
    docs = docs.select(*(c for c in docs.columns if c.lower() not in {n.lower() for n in names}))
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("t is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES) * (2 if size > BLOCK_BYTES else 1))
    more_fields = ", ".join(f"`{n}` {k}" for n, k in zip(names, ("long", MATCH, SPANS), strict=True))
    schema = with_fields(docs.schema.fields, more_fields)

    def block(b: int) -> list[tuple]:
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        return [(r["i"], r["t"].encode()) for r in mine.collect()]  # bounded by BLOCK_BYTES and one item

    if blocks == 1:
        return map_arrow(docs, _scan(block(0), text, window, names), schema)
    key, k, more_m, more_h = fresh(docs, "__key", "__k", "__m", "__h")
    keyed = stored(docs.withColumn(key, F.monotonically_increasing_id()), "decontam")
    more = None
    for b in range(1, blocks):
        part = stored(map_arrow(keyed.select(key, text), _scan_more(block(b), text, window, key), f"k long, m {MATCH}, h {SPANS}"), "decontam-block")
        more = part if more is None else more.unionByName(part)
    more = more.groupBy("k").agg(F.flatten(F.collect_list("m")).alias(more_m), F.flatten(F.collect_list("h")).alias(more_h))
    more = small_side(stored(more.withColumnRenamed("k", k), "decontam-hits"), 64 + 64 * F.size(more_m))
    n, m, h = names
    schema = with_fields(keyed.schema.fields, more_fields)
    out = map_arrow(keyed, _scan(block(0), text, window, names), schema)
    out = out.join(more, out[key] == more[k], "left")
    both = lambda old, new: F.when(F.col(k).isNull(), F.col(old)).otherwise(new)
    return out.select(*docs.columns, n, both(m, F.concat(m, more_m)).alias(m), both(h, _merged(F.concat(h, more_h))).alias(h))


def hit_words(spans: str = "__spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])


def contaminated(words: str = "__words", spans: str = "__spans") -> Column:
    """At least one word hit, and hit words at least a twentieth of the document's."""
    return (F.size(spans) > 0) & (20 * hit_words(spans) >= F.col(words))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones; its columns as they were, whatever their names and types."""
    work = masked(docs, text="text")
    return find_matches(work, benchmark).where(~contaminated()).select(*work.columns).toDF(*docs.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.array_sort(F.array_distinct(F.filter(F.transform("__matches", lambda m: m["item_id"]), lambda i: i.isNotNull())))
    return found.select(
        "doc_id",
        F.col("__words").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
