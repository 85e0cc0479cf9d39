"""Shared pieces of the corpus operators: shared-folder tables, size checks and word splitting."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: bytes.translate table that lower-cases A-Z and leaves every other byte.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-cases A-Z and turns all ASCII bytes that are neither digits nor letters into spaces.
LOWER_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: White space of the word rule `[^\x20\x09-\x0D]+`, for SQL regular expressions.
BLANK = "[\\x20\\x09-\\x0D]"
#: A side of at most this many bytes may be broadcast; larger sides take the shuffle path.
BROADCAST_BYTES = 32 << 20
#: Rows of an Arrow batch.
BATCH_CONF, ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "2000"
#: A key with more than this share of a table's rows, and more than so many, is joined by broadcast.
HOT_SHARE, HOT_ROWS = 0.001, 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it.

    Where it names none, a local session gets one of its own; on a cluster there is no safe place then.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df (already stored) with a broadcast hint if its size stays within the limit, else as it is.

    row_bytes: a bound of a row's size, or a column that gives each row's.
    """
    if isinstance(row_bytes, Column):
        size = df.agg(F.coalesce(F.sum(row_bytes), F.lit(0))).first()[0]
    else:
        size = df.count() * row_bytes
    return F.broadcast(df) if size <= limit else df


def join_counted(rows: DataFrame, side: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """rows inner join side, one row per key with the number n of its rows, where few keys may hold most of the rows.

    Keys of more than a HOT_SHARE of all rows are at most 1 / HOT_SHARE, so they are broadcast and their rows stay where
    they are; the others are joined as usual, and none is large.
    """
    bound = max(HOT_ROWS, int(total * HOT_SHARE))
    hot = side.where(F.col(n) > bound)
    if hot.isEmpty():
        return rows.join(side, keys)
    met = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(side.where(F.col(n) <= bound), keys)
    return met.unionByName(rest)


def quoted(name: str) -> str:
    """A column's name as Spark's expressions take it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def masked(docs: DataFrame, **roles: str) -> DataFrame:
    """docs with plain names: the columns that play a role get its name, all others a number, so that none clashes or needs quoting.

    Undone by toDF(*docs.columns), as the order stays.
    """
    names = {name: role for role, name in roles.items()}
    missing = set(names) - set(docs.columns)
    if missing:
        raise ValueError(f"no column {sorted(missing)}")
    return docs.toDF(*(names.get(c, f"__{i}") for i, c in enumerate(docs.columns)))


def with_fields(fields: Iterable[StructField], more: str) -> StructType:
    """A schema of the fields, whatever their names and types, and further ones as DDL."""
    return StructType([*fields, *StructType.fromDDL(more).fields])


def text_bytes(name: str) -> Column:
    """Bytes of a value as text, as a bound for a row of it."""
    return F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)) + 24


def ranked(nodes: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """nodes(key, order, tie, others) with rank, from 0 in the key's order, and n, the key's number of nodes; `tie` parts equal rows.
    parts: ranges, if not the session's number.

    Rows are sorted by range; a rank is the place in its range and the counts of the ranges before, one row per range and key.
    """
    keys = ["key", *order, "tie"]
    placed = (nodes.repartitionByRange(parts, *keys) if parts else nodes.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    placed = stored(placed.withColumn("part", F.spark_partition_id()).withColumn("spot", F.monotonically_increasing_id()), "ranked")
    runs = placed.groupBy("key", "part").agg(F.min("spot").alias("first"), F.count("*").alias("many"))
    whole = Window.partitionBy("key")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("key", "part", "first", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("ahead"), F.sum("many").over(whole).alias("n"))
    runs = small_side(stored(runs, "ranges"), F.octet_length("key") + 48)
    return placed.join(runs, ["key", "part"]).withColumn("rank", F.col("spot") - F.col("first") + F.col("ahead"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many `_` behind it as df's columns make necessary."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow in batches of few rows, as texts are long; what a task has freed goes back to the system at its end, as idle
    Python workers stay.  Columns may have any names: Spark sees numbers in their place, and fn the names.

    Spark takes the rows of a batch from the session when the plan runs, so the session gets ROWS_PER_BATCH if it names
    no number itself.
    """
    conf = df.sparkSession.conf
    if BATCH_CONF not in conf.getAll:
        conf.set(BATCH_CONF, ROWS_PER_BATCH)

    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batch.rename_columns(names) for batch in batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
        if trim:
            trim(0)

    return df.toDF(*(f"_{i}" for i in range(len(names)))).mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches where the text column exceeds about `limit` bytes, so memory follows bytes, not rows."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        size = batch.column(batch.schema.get_field_index(column)).nbytes
        step = max(1, n if size <= limit else int(n * limit / size))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def train_fold(id_col: str, folds: int, held: int):
    """crc32 of the id written as text, modulo folds, differs from held; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds) != held
