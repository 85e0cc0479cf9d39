"""From class probabilities of windows to votes of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import accepts, argmax, ladder, score_min_max


def consensus(
    df: DataFrame, keys: list[str], func: str = "delta_mean", threshold: float = 0.8, semantics: str = "reference", codes: str | None = None, size: int | None = None
) -> DataFrame:
    """df(keys, win_idx, p) -> keys, win_idx, class, vote: vote is null for a rejected window.

    codes, size: p holds only the classes of these codes, in rising order, out of `size`; the others have probability 0.

    The threshold is relaxed for a group until some window is accepted (in the reference semantics, one with a class other
    than 0), by a fixed ladder: each window's first accepting step, and the least of them per group, say all.
    """
    steps = ladder(threshold)
    best = argmax(F.col("p"))
    out = df.withColumn("class", best if codes is None else F.get(codes, best))
    if func not in ("delta_mean", "min_max", "delta_sum") or not steps:
        return out.select(*keys, "win_idx", "class", F.col("class").alias("vote"))
    rungs = F.array(*(F.lit(t) for t in steps))
    out = out.withColumn("step", F.array_position(F.transform(rungs, lambda t: F.coalesce(accepts(func, F.col("p"), t, size), F.lit(False))), F.lit(True)))
    out = out.withColumn("step", F.when(F.col("step") > 0, F.col("step")))
    flat = score_min_max(F.col("p"), size).isNull() if func == "min_max" else F.lit(False)
    counts = (F.col("class") != 0) if semantics == "reference" else F.lit(True)
    group = Window.partitionBy(*keys)
    out = out.withColumn("least", F.min(F.when(counts, F.col("step"))).over(group)).withColumn("flat", F.max(flat).over(group))
    vote = F.when(F.col("flat") | F.col("least").isNull() | (F.col("step") <= F.col("least")), F.col("class"))
    return out.select(*keys, "win_idx", "class", vote.alias("vote"))


def count_votes(df: DataFrame, keys: list[str], semantics: str = "reference") -> DataFrame:
    """keys, vote, votes: accepted windows per class.

    In the reference semantics, class 0 and rejection share one counter; the first of them in a group's windows decides
    whether it counts for class 0 or is left out.
    """
    if semantics == "clean":
        return df.where("vote is not null").groupBy(*keys, "vote").agg(F.count("*").alias("votes"))
    shared = df.withColumn("zero", F.coalesce(F.col("vote") == 0, F.lit(True)))
    group = shared.groupBy(*keys, F.when(F.col("zero"), F.lit(0)).otherwise(F.col("vote")).alias("vote")).agg(
        F.count("*").alias("votes"), F.min_by(F.col("vote").isNotNull(), "win_idx").alias("counts")
    )
    return group.where("counts").drop("counts")


def share_of_parent(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("total", F.sum("votes").over(Window.partitionBy(*keys)))


def keep_taxa(df: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Classes with more than a share of their parent's votes."""
    return share_of_parent(df, keys).where(F.col("votes") > F.lit(threshold) * F.col("total"))
