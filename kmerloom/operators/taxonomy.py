"""Taxonomy tables from the names of genomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import ALL_LEVELS, LEVELS


def _pairs(df: DataFrame, order: str) -> DataFrame:
    """One row per genome and level: level_idx (1..5), level, name, parent."""
    rows = [
        F.struct(F.lit(i + 1).alias("level_idx"), F.lit(level).alias("level"), F.col(level).alias("name"), (F.col(LEVELS[i - 1]) if i else F.lit("Root")).alias("parent"))
        for i, level in enumerate(LEVELS)
    ]
    return df.select(F.col(order).alias("ord"), F.inline(F.array(*rows)))


def taxa_codes(df: DataFrame, order: str = "file_ord") -> DataFrame:
    """level, name, code: names of a level numbered from 0 in the order in which they come first, over all parents."""
    first = _pairs(df, order).groupBy("level", "name").agg(F.min("ord").alias("first_ord"))
    # One window per level over its distinct names, which are few.
    rank = F.row_number().over(Window.partitionBy("level").orderBy("first_ord", "name")) - 1
    return first.select("level", "name", rank.alias("code"))


def taxa_counts(codes: DataFrame) -> DataFrame:
    return codes.groupBy("level").agg(F.count("*").alias("number_taxa"))


def taxa_tree(df: DataFrame, order: str = "file_ord") -> DataFrame:
    """level_idx, level, node_id, name, parent, parent_id: nodes by lower-cased name and level; first spelling and parent win."""
    nodes = _pairs(df, order).groupBy("level_idx", "level", F.lower("name").alias("key")).agg(
        F.min_by("name", "ord").alias("name"), F.min_by("parent", "ord").alias("parent")
    )
    root = df.sparkSession.createDataFrame([(0, "root", "root", "Root", None)], "level_idx int, level string, key string, name string, parent string")
    every = root.unionByName(nodes)
    parent_level = F.element_at(F.array(*map(F.lit, ALL_LEVELS)), F.col("level_idx"))
    return every.select(
        "level_idx", "level", F.concat_ws("_", "key", "level").alias("node_id"), "name", "parent",
        F.when(F.col("level_idx") > 0, F.concat_ws("_", F.lower("parent"), parent_level)).alias("parent_id"),
    )


def conflicting_names(df: DataFrame, order: str = "file_ord") -> DataFrame:
    """Nodes with several spellings or several parents: level, key, spellings, parents."""
    return (
        _pairs(df, order).groupBy("level", F.lower("name").alias("key"))
        .agg(F.count_distinct("name").alias("spellings"), F.count_distinct(F.lower("parent")).alias("parents"))
        .where("spellings > 1 or parents > 1")
    )


def nodes_per_level(taxa: DataFrame) -> DataFrame:
    """Inner nodes: those for which a model is trained."""
    return taxa.where("level_idx <= 4").select("level_idx", "level", "name")


def label_rows(df: DataFrame, codes: DataFrame, level: str) -> DataFrame:
    """df with the code of its name at a level; a missing name fails the job."""
    dim = codes.where(F.col("level") == level).select(F.col("name").alias("__name"), F.col("code").alias("label"))
    out = df.join(dim, df[level] == dim["__name"], "left").drop("__name")
    return out.where(F.assert_true(F.col("label").isNotNull(), F.concat(F.lit("no code for "), F.col(level))).isNull())
