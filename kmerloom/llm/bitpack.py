"""Operator 5: token ids written in a fixed-width bit-packed file format, and read back.

File: magic `TOKBITS1`, then little-endian uint32 width and uint64 counts of documents, ids and blocks; doc ids
(int64, with a byte per document that is 1 for null), id counts (uint64), block offsets (uint64, in bytes of the
payload), then the payload.  Every block holds BLOCK_IDS ids (the last one fewer) of `width` bits each, lowest bit first, and starts on a
byte, so any id is found from its index alone and a block unpacks with a few numpy operations.

write_tokens: documents are range-partitioned by id; each task encodes its texts and writes files named by partition and sequence.
A file is first written under a name of its own and then renamed, so a repeated task leaves the same files.
Null texts are empty; a null doc_id sorts first; rows with equal ids are each written, in the order of their texts.
An empty table gives no file and no rows.  Other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, map_arrow, shared_dir, slices, small_side, stored

MAGIC = b"TOKBITS1"
#: Ids of a block; a multiple of 8, so that full blocks end on a byte at any width.
BLOCK_IDS = 4096
#: A task starts another file after about this many ids; readers take a file whole.
FILE_IDS = 1 << 22


def bit_width(vocab: int) -> int:
    """Bits that hold every id of a vocabulary."""
    return max(1, int(vocab - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> tuple[bytes, np.ndarray]:
    """Payload and the blocks' byte offsets."""
    parts, offsets, at = [], [], 0
    for start in range(0, len(ids), BLOCK_IDS):
        block = np.ascontiguousarray(ids[start : start + BLOCK_IDS], dtype="<u4")
        if width == 16:
            raw = block.astype("<u2").tobytes()
        else:
            bits = np.unpackbits(block.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
            raw = np.packbits(bits.ravel(), bitorder="little").tobytes()
        parts.append(raw)
        offsets.append(at)
        at += len(raw)
    return b"".join(parts), np.asarray(offsets, dtype="<u8")


def unpack(raw: bytes | memoryview, width: int, n: int) -> np.ndarray:
    """The first n ids of a block's bytes."""
    if width == 16:
        return np.frombuffer(raw, dtype="<u2", count=n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), bitorder="little")[: n * width].reshape(n, width)
    out = np.zeros((n, 32), dtype=np.uint8)
    out[:, :width] = bits
    return np.packbits(out, axis=1, bitorder="little").view("<u4").ravel()


def file_bytes(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, width: int) -> bytes:
    payload, offsets = pack(ids, width)
    head = MAGIC + struct.pack("<IQQQ", width, len(doc_ids), len(ids), len(offsets))
    nulls = bytes(x is None for x in doc_ids)
    docs = np.asarray([x or 0 for x in doc_ids], dtype="<i8").tobytes()
    return b"".join([head, nulls, docs, np.asarray(counts, dtype="<u8").tobytes(), offsets.tobytes(), payload])


class TokenFile:
    """One file's content: document table and random access to ids."""

    def __init__(self, content: bytes):
        view = memoryview(content)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a bit-packed token file")
        self.width, docs, self.n_ids, blocks = struct.unpack_from("<IQQQ", view, 8)
        at = 8 + struct.calcsize("<IQQQ")
        nulls, at = np.frombuffer(view, np.uint8, docs, at), at + docs
        values, at = np.frombuffer(view, "<i8", docs, at), at + 8 * docs
        self.doc_ids = [None if n else int(v) for n, v in zip(nulls, values, strict=True)]
        self.counts, at = np.frombuffer(view, "<u8", docs, at).astype(np.int64), at + 8 * docs
        self.offsets, at = np.frombuffer(view, "<u8", blocks, at).astype(np.int64), at + 8 * blocks
        self.payload = view[at:]
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])

    def ids(self, start: int, length: int) -> np.ndarray:
        """Any run of ids; only the blocks that hold it are unpacked."""
        if length <= 0:
            return np.empty(0, dtype="<u4")
        first, last = start // BLOCK_IDS, (start + length - 1) // BLOCK_IDS
        parts = []
        for b in range(first, last + 1):
            lo = int(self.offsets[b])
            hi = int(self.offsets[b + 1]) if b + 1 < len(self.offsets) else len(self.payload)
            parts.append(unpack(self.payload[lo:hi], self.width, min(BLOCK_IDS, self.n_ids - b * BLOCK_IDS)))
        return np.concatenate(parts)[start - first * BLOCK_IDS :][:length]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.counts[i]))


def _write_files(path: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        from .tokens import encoder

        enc = encoder(tokenizer)
        width = bit_width(max(enc.vocab, end_id + 1))
        store, root = fs.FileSystem.from_uri(path)
        part, seq = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        counts: list[int] = []
        raw: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, counts, raw, total, seq
            name = f"part-{part:07d}-{seq:05d}.tok"
            temp = f"{root}/_{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(temp) as out:
                out.write(file_bytes(docs, counts, np.concatenate(raw), width))
            store.move(temp, f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({"file": [name], "docs": [len(docs)], "ids": [total]})
            docs, counts, raw, total, seq = [], [], [], 0, seq + 1
            return row

        for batch in slices(batches, "text", 2 << 20):
            ids, sizes = enc.encode_closed(column(batch, "text"), end_id)
            doc, ends, at = column(batch, "doc_id").to_pylist(), np.cumsum(sizes), 0
            while at < len(doc):  # as many documents as fill the file
                before = int(ends[at - 1]) if at else 0
                to = min(len(doc), int(np.searchsorted(ends, before + FILE_IDS - total)) + 1)
                docs += doc[at:to]
                counts += sizes[at:to].tolist()
                raw.append(ids[before : ends[to - 1]])
                total, at = total + int(ends[to - 1]) - before, to
                if total >= FILE_IDS:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write doc_id and text in ascending doc_id order under path; the stored list of files: file, docs, ids, start."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    tie = F.xxhash64("text")  # spreads an id that many rows share
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), tie, "text"
    )
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    files = stored(map_arrow(rows, _write_files(path, tokenizer, end_id), "file string, docs long, ids long"), "token-files")
    # One row per file of millions of ids: a running sum over the list of files is small at any size.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long")))


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, start, content in zip(
            column(batch, "file").to_pylist(), column(batch, "start").to_pylist(), column(batch, "content"), strict=True
        ):
            got = TokenFile(content.as_py())
            crcs = [zlib.crc32(got.document(i).tobytes()) for i in range(len(got.doc_ids))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(got.doc_ids, pa.int64()),
                    pa.array(got.starts[:-1] + start, pa.int64()),
                    pa.array(got.counts, pa.int64()),
                    pa.array(crcs, pa.int64()),
                    pa.array([name] * len(crcs), pa.string()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32", "file"],
            )


def read_tokens(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, file."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tok").load(path)
    raw = raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    starts = small_side(stored(files.select("file", "start"), "token-starts"), 64)
    return map_arrow(
        raw.join(starts, "file").select("file", "start", "content"),
        _read_files,
        "doc_id long, start long, n_tokens long, ids_crc32 long, file string",
    )


def op5_bit_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    uri = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write_tokens(docs, uri, public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_tokens(spark, uri, files).select("doc_id", "start", "n_tokens", "ids_crc32")
