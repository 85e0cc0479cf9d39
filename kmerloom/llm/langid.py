"""Operator 2: language identification with blended-spectrum presence kernels, Nystroem landmarks and ridge regression.

A text's features are the sets of its letter n-grams of 1 to 3 (word ends included).  The kernel of two texts is the number of
n-grams in both, over the root of the product of their numbers (blended spectrum, presence, normalised).  LANDMARKS
(or, if more, as many as there are languages) training texts span the Nystroem features K(x, landmarks) K_mm^(-1/2); a ridge regression with targets 1 and -1 per language is one-versus-rest
kernel ridge regression in that space.  Scoring is two matrix products per batch of texts: presence by landmarks, then
by weights.

Training reads only text and non-null language of the training fold.  It takes at most SAMPLE_PER_LANGUAGE texts of each of at most
MAX_LANGUAGES languages, the first ones by a hash of the text, of SHORT_BYTES to SAMPLE_BYTES each; these bounds are parameters.
Copies count once.  A language with fewer such texts is filled up from its shorter texts and from stretches at the beginning
of its longer ones, so each of these languages is learned.  Every text is scored whole.

Letters beyond the ALPHABET most common of the sample share the remaining codes by code point.  `und` with score 0: a
text that is null, has no letter, or where nothing could be learned.  Equal texts get equal predictions; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, map_arrow, quoted, slices, train_fold, with_fields

SAMPLE_PER_LANGUAGE = 400
SHORT_BYTES, SAMPLE_BYTES = 200, 8192
MAX_LANGUAGES = 200
LANDMARKS = 160
ALPHABET = 96
CODES = 128  # 0: between words; 1..ALPHABET: common letters; the rest: other letters by code point
RIDGE = 1e-3
#: Code points that a long text is cut into for counting, so that work arrays stay small.
STRETCH = 1 << 20
_SLOTS = CODES + CODES**2 + CODES**3


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of every code point: is it a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")


def has_letter(text: str | None) -> bool:
    return bool(text) and bool(_letters()[_points(text)].any())


class Spectrum:
    """Sets of n-grams as sorted-free arrays of slots, for a given alphabet."""

    def __init__(self, alphabet: list[int]):
        self.table = np.zeros(0x110000, dtype=np.int32)
        letters = np.flatnonzero(_letters())
        self.table[letters] = ALPHABET + 1 + letters % (CODES - ALPHABET - 1)
        self.table[alphabet] = np.arange(1, len(alphabet) + 1)
        self.last = np.zeros(_SLOTS, dtype=np.int32)

    def slots(self, text: str) -> np.ndarray:
        """Distinct n-grams of a text, or nothing if it has no letter."""
        codes = self.table[_points(text)]
        codes = np.concatenate([[0], codes, [0]]).astype(np.int32)
        codes = codes[(codes != 0) | np.concatenate([[True], codes[:-1] != 0])]  # one mark between words
        if len(codes) < 3:
            return np.empty(0, dtype=np.int32)
        parts = []
        for at in range(0, len(codes), STRETCH):
            c = codes[at : at + STRETCH + 2]
            two = c[:-1] * CODES + c[1:]
            three = two[:-1] * CODES + c[2:]
            got = np.concatenate([c, CODES + two, CODES + CODES**2 + three])
            here = np.arange(len(got), dtype=np.int32)
            self.last[got] = here
            parts.append(got[self.last[got] == here])
        return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


class Model:
    """Landmark presence matrix and regression weights; bounded by the sample's bounds."""

    def __init__(self, texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.langs = sorted(set(langs))
        if not texts:
            return
        count = Counter(c for t in texts for c in t.lower() if c.isalpha())
        self.alphabet = [ord(c) for c, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:ALPHABET]]
        spectrum = Spectrum(self.alphabet)
        sets = [spectrum.slots(t) for t in texts]
        # Landmarks: in turn from each language, in the sample's order.
        by = {lang: [i for i, x in enumerate(langs) if x == lang and len(sets[i])] for lang in self.langs}
        turn = [i for row in zip(*([*v, *[None] * (len(texts) - len(v))] for v in by.values()), strict=True) for i in row if i is not None]
        chosen = turn[: max(landmarks, len(self.langs))]  # at least one of each language
        if not chosen:
            self.langs = []
            return
        self.vocab = np.unique(np.concatenate([sets[i] for i in chosen]))
        self.marks = np.zeros((len(self.vocab), len(chosen)), dtype=np.float32)
        for j, i in enumerate(chosen):
            self.marks[np.searchsorted(self.vocab, sets[i]), j] = 1
        self.norms = np.sqrt(np.asarray([len(sets[i]) for i in chosen], dtype=np.float32))
        self._ready(spectrum)
        k = np.concatenate([self.kernel(sets[at : at + 256]) for at in range(0, len(sets), 256)]).astype(np.float64)
        mm = self.kernel([sets[i] for i in chosen]).astype(np.float64)
        value, vector = np.linalg.eigh((mm + mm.T) / 2)
        ok = value > 1e-6 * value.max()
        root = vector[:, ok] / np.sqrt(value[ok])
        z = np.concatenate([k @ root, np.ones((len(k), 1))], axis=1)
        y = np.where(np.asarray(langs)[:, None] == np.asarray(self.langs)[None, :], 1.0, -1.0)
        w = np.linalg.solve(z.T @ z + ridge * len(z) * np.eye(z.shape[1]), z.T @ y)
        self.weights, self.bias = (root @ w[:-1]).astype(np.float32), w[-1].astype(np.float32)

    def _ready(self, spectrum: Spectrum | None = None) -> None:
        self.spectrum = spectrum or Spectrum(self.alphabet)
        self.row = np.full(_SLOTS, -1, dtype=np.int32)
        self.row[self.vocab] = np.arange(len(self.vocab))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("spectrum", "row")}

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Normalised kernel of texts with the landmarks, as one matrix product."""
        present = np.zeros((len(sets), len(self.vocab)), dtype=np.float32)
        for i, s in enumerate(sets):
            rows = self.row[s]
            present[i, rows[rows >= 0]] = 1
        size = np.sqrt(np.maximum([len(s) for s in sets], 1)).astype(np.float32)
        return present @ self.marks / size[:, None] / self.norms[None, :]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        if "row" not in self.__dict__:
            self._ready()
        sets = [self.spectrum.slots(t) if t else np.empty(0, dtype=np.int32) for t in texts]
        f = self.kernel(sets) @ self.weights + self.bias
        best = f.argmax(1)
        score = np.clip((f[np.arange(len(f)), best].astype(np.float64) + 1) / 2, 0, 1)
        known = [len(s) > 0 for s in sets]
        return (
            [self.langs[b] if ok else "und" for b, ok in zip(best, known, strict=True)],
            [float(s) if ok else 0.0 for s, ok in zip(score, known, strict=True)],
        )


def fit(labelled: DataFrame) -> Model:
    """labelled(text, lang): the training fold. What reaches the driver is bounded by the sample's parameters."""
    usable = labelled.where("text is not null and lang is not null")
    langs = [r["lang"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()]
    shared = max(8, min(SAMPLE_PER_LANGUAGE, 8192 // max(1, len(langs))))
    far = ~F.octet_length("text").between(SHORT_BYTES, SAMPLE_BYTES)
    ranked = usable.where(F.col("lang").isin(langs)).select("lang", "text", far.alias("far"), F.xxhash64("text").alias("h"))
    # Distinct texts of each language within and beyond the lengths; copies don't count.
    counts: dict[str, dict[bool, int]] = {}
    for r in ranked.groupBy("lang", "far").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect():
        counts.setdefault(r["lang"], {})[r["far"]] = r["n"]
    shares = []
    for lang, n in sorted(counts.items()):
        shares.append((lang, False, min(1.0, 4.0 * shared / max(1, n.get(False, 0)))))
        if n.get(False, 0) < 2 * shared:  # beyond the lengths only where within them there may be too few
            shares.append((lang, True, min(1.0, 4.0 * shared / max(1, n.get(True, 0)))))
    share = labelled.sparkSession.createDataFrame(shares, "lang string, far boolean, share double")
    # A hash keeps about four times the sample, which then is sorted.
    near = ranked.join(F.broadcast(share), ["lang", "far"]).where(F.pmod(F.col("h"), F.lit(1 << 30)) < F.col("share") * float(1 << 30))
    # A long text's stretch: so many letters are at most SAMPLE_BYTES in UTF-8.
    stretch = F.when(F.octet_length("text") > SAMPLE_BYTES, F.substring("text", 1, SAMPLE_BYTES // 4)).otherwise(F.col("text"))
    near = near.select("lang", "far", "h", stretch.alias("text")).dropDuplicates(["lang", "h"])
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("far", "h"))).where(F.col("r") <= shared)
    rows = sorted((r["lang"], r["h"], r["text"]) for r in top.select("lang", "h", "text").collect())
    return Model([t for _, _, t in rows], [lang for lang, _, _ in rows])


def _predict(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(model)
        for batch in slices(batches, "text"):
            texts = column(batch, "text").to_pylist()
            langs, scores = [], []
            for at in range(0, len(texts), 128):
                a, b = m.predict(texts[at : at + 128])
                langs += a
                scores += b
            at = batch.schema.get_field_index("text")
            keep = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*(batch.schema.names[i] for i in keep), "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs(text, others) -> the others with lang_pred and score."""
    other = [f for f in docs.schema if f.name not in ("text", "lang_pred", "score")]
    schema = with_fields(other, "lang_pred string, score double")
    return map_arrow(docs.select(*(quoted(f.name) for f in other), "text"), _predict(pickle.dumps(model)), schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = train_fold("doc_id", 3, 1)
    model = fit(docs.where(train).select("text", "lang"))
    return identify(docs.select("doc_id", (~train).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
