"""Windows of sequences and their k-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def min_length_genomes(df: DataFrame, size: int) -> DataFrame:
    """Genomes of at least a window's length; others are left out silently."""
    return df.where(F.length("seq") >= size)


def reject_short_reads(df: DataFrame, size: int) -> DataFrame:
    """Every read with its status: REJECTED where shorter than a window, else null."""
    return df.withColumn("status", F.when(F.length("seq") < size, F.lit("REJECTED")))


def windows(df: DataFrame, size: int, sampling: int) -> DataFrame:
    """df(seq, others) -> others, win_idx, start (from 0), win (binary): `sampling` windows at even steps, never at the end.

    Sequences are sliced as binary, which takes constant time; they go no further than here.
    """
    shift = F.expr(f"int((length(seq) - {size}) div {sampling})")
    others = [c for c in df.columns if c != "seq"]
    cut = df.where(F.length("seq") >= size).select(*others, F.col("seq").cast("binary").alias("__seq"), shift.alias("__shift"))
    cut = cut.select(*others, "__seq", "__shift", F.explode(F.sequence(F.lit(0), F.lit(sampling - 1))).alias("win_idx"))
    start = F.col("win_idx") * F.col("__shift")
    return cut.select(*others, "win_idx", start.alias("start"), F.expr(f"substring(__seq, win_idx * __shift + 1, {size})").alias("win"))


def stretch_windows(stretches: DataFrame, keys: list[str], size: int, sampling: int) -> DataFrame:
    """stretches(keys, at, seq, length) -> keys, win_idx, start, win: windows() of sequences that come in stretches.

    at: a stretch's place in its sequence of that length.  Each stretch gives its part of every window that it meets; a window's
    parts are put together by place.  So windows are moved, not sequences, and no row is longer than a stretch.
    """
    shift = F.expr(f"(length - {size}) div {sampling}").alias("shift")
    rows = stretches.where((F.col("length") >= size) & (F.length("seq") > 0)).select(*keys, "at", F.col("seq").cast("binary").alias("seq"), shift)
    end = F.col("at") + F.length("seq")
    # Windows i with i * shift < end and i * shift + size > at.
    last = F.when(F.col("shift") == 0, sampling - 1).otherwise(F.least(F.lit(sampling - 1), F.expr("(at + length(seq) - 1) div shift")))
    first = F.when(F.col("shift") == 0, 0).otherwise(F.when(F.col("at") < size, 0).otherwise(F.expr(f"(at - {size}) div shift + 1")))
    some = (first <= last) & ((F.col("shift") > 0) | (F.col("at") < size))
    met = rows.withColumn("end", end).where(some).select("*", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("win_idx"))
    begin = F.greatest("at", F.col("win_idx") * F.col("shift"))
    stop = F.least("end", F.col("win_idx") * F.col("shift") + size)
    part = F.substring(F.col("seq"), (begin - F.col("at") + 1).cast("int"), (stop - begin).cast("int"))
    parts = met.select(*keys, "win_idx", (F.col("win_idx") * F.col("shift")).alias("start"), begin.alias("begin"), part.alias("part"))
    whole = parts.groupBy(*keys, "win_idx", "start").agg(F.sort_array(F.collect_list(F.struct("begin", F.col("part").cast("string").alias("part")))).alias("p"))
    return whole.select(*keys, "win_idx", F.col("start").cast("int").alias("start"), F.array_join("p.part", "").cast("binary").alias("win"))


def deal(wins: DataFrame, *keys: str) -> DataFrame:
    """Windows dealt by keys over as many tasks as the session shuffles into.

    The number is given, as one row becomes hundreds behind the exchange: by their bytes, few tasks would get them all.
    """
    return wins.repartition(int(wins.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def kmers(df: DataFrame, width: int, semantics: str = "reference") -> DataFrame:
    """df(win, others) -> others, pos (from 1), kmer.  The reference semantics leave out a window's last two."""
    short = 2 if semantics == "reference" else 0
    others = [c for c in df.columns if c != "win"]
    whole = df.where(F.length("win") >= width + short)
    last = F.length("win") - (width + short) + 1
    return whole.select(*others, "win", F.explode(F.sequence(F.lit(1), last)).alias("pos")).select(
        *others, "pos", F.expr(f"cast(substring(win, pos, {width}) as string)").alias("kmer")
    )
