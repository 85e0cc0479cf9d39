"""Genome manifests: assembly summaries and lineages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import lineage_names, manifest_fields


def representative_only(df: DataFrame, start: int = 0) -> DataFrame:
    """Lines after `start` that name a representative genome."""
    return df.where((F.col("i") > start) & F.contains("line", F.lit("representative genome")))


def manifest_urls(df: DataFrame) -> DataFrame:
    """df(i, line) -> i, accession, url, fna_url; a line without a url fails the job."""
    accession, url, fna = manifest_fields(F.col("line"))
    out = df.select("i", "line", accession.alias("accession"), url.alias("url"), fna.alias("fna_url"))
    return out.where(F.assert_true(F.col("url").isNotNull(), F.concat(F.lit("no url in "), F.col("line"))).isNull()).drop("line")


def lineage_to_taxonomy(df: DataFrame) -> DataFrame:
    """df(lineage, organism, others) -> others, six names, file_name; genomes without an order are dropped."""
    others = [c for c in df.columns if c not in ("lineage", "organism")]
    out = df.select(*others, lineage_names(F.col("lineage"), F.col("organism")).alias("n")).select(*others, "n.*")
    out = out.where(F.col("order").isNotNull())
    return out.withColumn("file_name", F.concat(F.concat_ws("_", "domain", "phylum", "group", "order", "genus", "species"), F.lit(".fna")))
