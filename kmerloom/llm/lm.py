"""Operator 8: language-model scores by a weighted backoff automaton of word trigrams.

Model.  Tokens are words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, then one end per document.  With counts c of the training
documents, p1(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), p2(w | v) = (c(v w) + k2 p1(w)) / (c(v) + k2) and
p3(w | u v) = (c(u v w) + k3 p2(w | v)) / (c(u v) + k3): Dirichlet priors of k2 and k3 pseudo-counts (PRIORS).  As an automaton: a state
per seen word (and the start), and one per pair of words seen at least LEAST times in a row; an arc for each seen word that
follows, with weight log10 p; a failure arc with weight log10(k3 / (c(u v) + k3)) from a pair to its last word, and one with
log10(k2 / (c(v) + k2)) from there to the root, whose arcs weigh log10 p1.  A text is read once from left to right: the state is the two
words before; where there is no arc, failure arcs are taken until there is one, and the weights are added.

Counting and lookup at scale.  No task holds the model.
1. Each task turns its documents into parts of at most PART_TOKENS tokens: local word numbers and the words' hashes, stored.
2. A part's distinct words and bigrams, as sorted hashes with training counts, are cut by hash range into buckets, as many
   as the corpus has BUCKET_TOKENS tokens; one packed row per part and bucket that it has entries of.  A frequent word is one entry per part.
3. A bucket adds up its entries over all parts and answers each part with the totals of that part's entries.
4. A part and its answers meet by the part's number.  Now it knows the pairs that are states, and its trigrams behind these
   go the same way, out and back.
5. The part's slice of the automaton scores its documents.
Hashes of words have 64 bits.  Those of bigrams and trigrams have as many as make two of the corpus alike with a chance
below 2^-ERROR_BITS for each, so what moves per entry hardly grows with the corpus.
What moves is in proportion to the parts' distinct n-grams.  Rows are independent; null text is the end alone; a null id is in the
training fold by the crc32 of the empty text.  Equal rows are counted and scored each.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, column, map_arrow, slices, stored, texts_of, train_fold

#: Pseudo-counts of the shorter history's distribution, behind one word and behind two.
PRIORS = (100.0, 20.0)
#: Times that two words must follow each other to be a state.
LEAST = 2
#: Pseudo-count of a word in the unigram distribution.
ADD = 0.1
#: Tokens after which a part is closed.
PART_TOKENS = 2 << 20
#: Tokens of the corpus to a bucket.
BUCKET_TOKENS = 2 << 20
#: Most tasks of a step; with more parts or buckets a task takes several, one after another.
MOST_TASKS = 20_000
#: Bits of an n-gram's hash beyond those that number the corpus's tokens.
ERROR_BITS = 24
#: No word holds a space, so these stand for no word.
END, START = xxhash.xxh3_64_intdigest(b" end"), xxhash.xxh3_64_intdigest(b" start")

_PART = "part long, n_tokens long, doc_ids array<long>, train binary, counts binary, ids binary, words binary"


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, so that compression finds the zeros."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    width = int(kind[2])
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _encode(part_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seq = TaskContext.get().partitionId(), 0
        numbers: dict[bytes, int] = {}
        docs: list[int | None] = []
        train: list[bool] = []
        ids: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal numbers, docs, train, ids, total, seq
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in numbers), dtype="<u8", count=len(numbers))
            row = {
                "part": pa.array([(task << 24) + seq], pa.int64()),
                "n_tokens": pa.array([total], pa.int64()),
                "doc_ids": pa.array([docs], pa.list_(pa.int64())),
                "train": pa.array([np.asarray(train, dtype=np.uint8).tobytes()]),
                "counts": pa.array([np.asarray([len(x) for x in ids], dtype="<i8").tobytes()]),
                "ids": pa.array([zstandard.compress(_planes(np.concatenate(ids).astype("<i4")), 3)]),
                "words": pa.array([hashes.tobytes()]),
            }
            numbers, docs, train, ids, total, seq = {}, [], [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays(list(row.values()), names=list(row))

        for batch in slices(batches, "text"):
            for doc, fold, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "train").to_pylist(), texts_of(batch, "text"), strict=True):
                words = text.translate(LOWER).split()
                got = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int32, count=len(words))
                docs.append(doc)
                train.append(bool(fold))
                ids.append(got)
                total += len(got) + 1
                if total >= part_tokens:
                    yield flush()
        if docs:
            yield flush()

    return run


def _pack(values: np.ndarray) -> bytes:
    return zstandard.compress(_planes(values), 1)


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    return _from_planes(zstandard.decompress(raw), kind)


def _mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of a history's hash and a word's."""
    x = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Part:
    """A stored part: tokens with the end of each document, states, distinct words, bigrams and trigrams with their hashes."""

    def __init__(self, row: dict):
        counts = np.frombuffer(row["counts"], dtype="<i8")
        words = np.frombuffer(row["words"], dtype="<u8")
        self.hashes = np.concatenate([words, np.asarray([END, START], dtype="<u8")])
        end, start = len(words), len(words) + 1
        self.sizes = counts + 1
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.tokens = np.full(int(self.sizes.sum()), end, dtype=np.int32)
        inside = np.ones(len(self.tokens), dtype=bool)
        inside[self.first + counts] = False
        self.tokens[inside] = _from_planes(zstandard.decompress(row["ids"]), "<i4")
        self.states = np.empty_like(self.tokens)
        self.states[1:] = self.tokens[:-1]
        self.states[self.first] = start
        self.train = np.repeat(np.frombuffer(row["train"], dtype=np.uint8).astype(bool), self.sizes)
        pairs, pair = np.unique(self.states.astype(np.int64) * len(self.hashes) + self.tokens, return_inverse=True)
        self.pair = pair.astype(np.int32)
        self.pairs = _mixed(self.hashes[pairs // len(self.hashes)], self.hashes[pairs % len(self.hashes)])

    def add_trigrams(self, pairs: np.ndarray, least: int) -> None:
        """Trigrams behind the bigrams that are states, by the bigrams' training counts: `triple` is a token's, -1 for none."""
        before = np.concatenate([[0], self.pair[:-1]])
        at = pairs[before] >= least
        at[self.first] = False
        at = np.flatnonzero(at)
        self.triple = np.full(len(self.tokens), -1, dtype=np.int32)
        triples, self.triple[at] = np.unique(before[at].astype(np.int64) * len(self.hashes) + self.tokens[at], return_inverse=True)
        self.behind = triples // len(self.hashes)
        self.triples = _mixed(self.pairs[self.behind], self.hashes[triples % len(self.hashes)])

    def entries(self, kind: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes in rising order and the place of each in the part's own order: kind 0 words with the end, 1 bigrams, 2 trigrams."""
        keys = (self.hashes[:-1], self.pairs, getattr(self, "triples", None))[kind]
        keys = keys if kind == 0 or bits == 64 else keys >> np.uint64(64 - bits)
        order = np.argsort(keys, kind="stable")
        return keys[order], order

    def training_counts(self, kind: int) -> np.ndarray:
        of, size = ((self.tokens, len(self.hashes) - 1), (self.pair, len(self.pairs)), (getattr(self, "triple", None), len(getattr(self, "triples", ()))))[kind]
        return np.bincount(of[self.train & (of >= 0)], minlength=size)


_ENTRIES = "bucket int, part long, kind int, keys binary, counts binary"


def _bucket_rows(kinds: tuple, bits: int, level: int, least: int):
    """Entries of parts in 2^level buckets by the upper bits of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                part = Part(row)
                if 2 in kinds:
                    part.add_trigrams(_unpack(row["pair_totals"], "<u8").astype(np.int64), least)
                for kind in kinds:
                    keys, order = part.entries(kind, bits)
                    counts = part.training_counts(kind)[order].astype("<u4")
                    width = 64 if kind == 0 else bits
                    bucket = (keys >> np.uint64(width - level)).astype(np.int64) if level else np.zeros(len(keys), dtype=np.int64)
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, dtype=np.int64)
                    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(bucket[cuts[:-1]] if len(keys) else [], pa.int32()),
                            pa.array([row["part"]] * len(spans), pa.int64()),
                            pa.array([kind] * len(spans), pa.int32()),
                            pa.array([_planes(np.diff(keys[lo:hi], prepend=np.uint64(0)).astype("<u8")) for lo, hi in spans], pa.binary()),
                            pa.array([_pack(counts[lo:hi]) for lo, hi in spans], pa.binary()),
                        ],
                        names=["bucket", "part", "kind", "keys", "counts"],
                    )

    return run


_TOTALS = "part long, kind int, bucket int, totals binary, n long, v long"


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and kind -> each part's totals; n and v (training tokens, distinct) on a bucket's first row."""
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    now: tuple[int, int] | None = None

    def flush() -> pa.RecordBatch:
        keys = np.concatenate([k for _, k, _ in held])
        every, where = np.unique(keys, return_inverse=True)
        total = np.bincount(where, weights=np.concatenate([c for _, _, c in held]), minlength=len(every)).astype(np.int64)
        cuts = np.cumsum([0, *(len(k) for _, k, _ in held)])
        rows = len(held)
        out = [
            pa.array([p for p, _, _ in held], pa.int64()),
            pa.array([now[1]] * rows, pa.int32()),
            pa.array([now[0]] * rows, pa.int32()),
            pa.array([_pack(total[where[a:b]].astype("<u8")) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
            pa.array([int(total.sum()), *[0] * (rows - 1)], pa.int64()),
            pa.array([int((total > 0).sum()), *[0] * (rows - 1)], pa.int64()),
        ]
        held.clear()
        return pa.RecordBatch.from_arrays(out, names=["part", "kind", "bucket", "totals", "n", "v"])

    for batch in batches:
        for b, part, kind, keys, counts in zip(*(column(batch, c).to_pylist() for c in ("bucket", "part", "kind", "keys", "counts")), strict=True):
            if now != (b, kind):
                if held:
                    yield flush()
                now = (b, kind)
            held.append((part, np.cumsum(_from_planes(keys, "<u8"), dtype=np.uint64), _unpack(counts, "<u4")))
    if held:
        yield flush()


def _own_totals(part: Part, answers: pa.Table, kind: int, bits: int) -> np.ndarray:
    """The totals of a part's entries of a kind, in the part's own order."""
    got = sorted((b, t) for k, b, t in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "totals")), strict=True) if k == kind)
    order = part.entries(kind, bits)[1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.concatenate([_unpack(t, "<u8") for _, t in got]) if got else 0
    return out


def score_part(part: Part, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, n: int, v: int, priors: tuple) -> tuple[np.ndarray, ...]:
    """words, pairs, triples: training totals in the part's own order.  Per document: known tokens, base score, score."""
    k2, k3 = priors
    states = np.concatenate([words, [words[-1]]])  # the start occurs as often as the end
    p1 = (words + ADD) / (n + ADD * (v + 1))
    one = np.empty(len(pairs), dtype=np.int64)  # any place at which each bigram stands
    one[part.pair] = np.arange(len(part.pair))
    history = states[part.states[one]]
    root = p1[part.tokens[one]]
    # Of each bigram: its arc, or the failure arc to the root and the root's.
    two = np.where(pairs > 0, np.log10((pairs + k2 * root) / (history + k2)), np.log10(k2 / (history + k2)) + np.log10(root))
    weight = two[part.pair]
    at = np.flatnonzero(part.triple >= 0)
    if len(at):
        count, behind, shorter = triples[part.triple[at]], pairs[part.behind[part.triple[at]]], weight[at]
        arc = np.log10((count + k3 * 10.0**shorter) / (behind + k3))
        weight[at] = np.where(count > 0, arc, np.log10(k3 / (behind + k3)) + shorter)
    total = lambda x: np.add.reduceat(x, part.first)
    return total((words[part.tokens] > 0).astype(np.int64)), total(np.log10(p1)[part.tokens]), total(weight)


_COUNTED = f"{_PART}, word_totals binary, pair_totals binary"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mean_score double"


def _count(bits: int):
    """A part with its answers -> the part with its words' and bigrams' totals."""
    binary = ("train", "counts", "ids", "words", "word_totals", "pair_totals")
    schema = pa.schema([("part", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in binary)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        row = left.slice(0, 1).to_pylist()[0]
        part = Part(row)
        row["word_totals"], row["pair_totals"] = (_pack(_own_totals(part, right, kind, bits).astype("<u8")) for kind in (0, 1))
        return pa.Table.from_pylist([row], schema=schema)

    return run


def _score(n: int, v: int, priors: tuple, bits: int, least: int):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
                        ("base_score", pa.float64()), ("score", pa.float64()), ("mean_score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        row = left.slice(0, 1).to_pylist()[0]
        part = Part(row)
        words, pairs = (_unpack(row[c], "<u8").astype(np.int64) for c in ("word_totals", "pair_totals"))
        part.add_trigrams(pairs, least)
        known, base, score = score_part(part, words, pairs, _own_totals(part, right, 2, bits), n, v, priors)
        held = ~np.frombuffer(row["train"], dtype=np.uint8).astype(bool)
        found = (row["doc_ids"], held, part.sizes, known, [n] * len(held), base, score, score / part.sizes)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(found, schema, strict=True)], schema=schema)

    return run


def score_documents(docs: DataFrame, priors: tuple = PRIORS, least: int = LEAST, part_tokens: int = PART_TOKENS) -> DataFrame:
    """docs(doc_id, text, train) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mean_score (a token's)."""
    parts = stored(map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "train"), _encode(part_tokens), _PART), "lm-parts")
    n_parts, tokens = parts.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    level = max(3, (-(-tokens // BUCKET_TOKENS)).bit_length())
    bits = min(64, max(32, int(tokens).bit_length() + ERROR_BITS))

    def totals_of(table: DataFrame, kinds: tuple) -> DataFrame:
        rows = map_arrow(table, _bucket_rows(kinds, bits, level, least), _ENTRIES)
        rows = rows.repartition(min(MOST_TASKS, 1 << level), "bucket").sortWithinPartitions("bucket", "kind", "part")
        return stored(map_arrow(rows, _add_up, _TOTALS), "lm-totals")

    # A task holds one part at a time, so its memory doesn't grow with the corpus.
    by_part = lambda df: df.repartition(max(1, min(MOST_TASKS, n_parts)), "part").groupBy("part")
    totals = totals_of(parts, (0, 1))
    n, v = totals.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    answers = totals.select("part", "kind", "bucket", "totals")
    counted = stored(by_part(parts).cogroup(by_part(answers)).applyInArrow(_count(bits), _COUNTED), "lm-counted")
    answers = totals_of(counted, (2,)).select("part", "kind", "bucket", "totals")
    return by_part(counted).cogroup(by_part(answers)).applyInArrow(_score(int(n), int(v), priors, bits, least), _SCORES)


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs.select("doc_id", "text", train_fold("doc_id", 10, 0).alias("train")))
