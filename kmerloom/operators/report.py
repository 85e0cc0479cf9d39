"""Flow tables and totals from prediction reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import flow_percent


def report_rows(report: DataFrame) -> DataFrame:
    """report(read_id, status, levels) -> read_id, level_idx, source, target, value."""
    return (
        report.where("status is null")
        .select("read_id", F.posexplode("levels").alias("level_idx", "level"))
        .select("read_id", "level_idx", F.explode("level").alias("source", "votes"))
        .select("read_id", "level_idx", "source", F.explode("votes").alias("target", "value"))
    )


def flow_cutoff(rows: DataFrame, taxa: DataFrame, cutoff: int = 50) -> DataFrame:
    """Rows of at least `cutoff` votes whose target is a known node at its depth."""
    known = taxa.select(F.col("name").alias("target"), (F.col("level_idx") - 1).alias("level_idx"))
    return rows.where(F.col("value") >= cutoff).join(known, ["target", "level_idx"], "left_semi").select(*rows.columns)


def rejected_flows(report: DataFrame, reads_per_sample: int = 100) -> DataFrame:
    return report.where("status = 'REJECTED'").select(
        "read_id", F.lit(0).alias("level_idx"), F.lit("Root").alias("source"), F.lit("REJECTED").alias("target"), F.lit(reads_per_sample).cast("long").alias("value")
    )


def flows(rows: DataFrame, report: DataFrame, taxa: DataFrame, cutoff: int = 50, reads_per_sample: int = 100, show_rejected: bool = False) -> DataFrame:
    """read_id, level_idx, source, target, value, percent."""
    out = flow_cutoff(rows, taxa, cutoff)
    if show_rejected:
        out = out.unionByName(rejected_flows(report, reads_per_sample))
    return out.withColumn("percent", flow_percent(F.col("value"), reads_per_sample))


def taxon_totals(flow: DataFrame, taxa: DataFrame) -> DataFrame:
    """depth, node, value: sums per target; targets that are no node count as REJECTED."""
    known = taxa.select(F.col("name").alias("__n"), F.col("level_idx").alias("__d"))
    joined = flow.join(known, (flow["target"] == known["__n"]) & (flow["level_idx"] + 1 == known["__d"]), "left")
    node = F.coalesce("__n", F.lit("REJECTED"))
    return joined.groupBy(F.coalesce("__d", F.lit(0)).alias("depth"), node.alias("node")).agg(F.sum("value").alias("value"))


def flow_endpoints(flow: DataFrame, taxa: DataFrame) -> DataFrame:
    """flow with the node ids of its source and target."""
    s = taxa.select(F.col("name").alias("source"), F.col("level_idx"), F.col("node_id").alias("source_id"))
    t = taxa.select(F.col("name").alias("target"), (F.col("level_idx") - 1).alias("level_idx"), F.col("node_id").alias("target_id"))
    return flow.join(s, ["source", "level_idx"], "left").join(t, ["target", "level_idx"], "left").select(*flow.columns, "source_id", "target_id")


def hierarchy_totals(taxa: DataFrame, totals: DataFrame) -> DataFrame:
    """node, depth, parent, value for every node below the root and for REJECTED; 0 where nothing flows."""
    nodes = taxa.where("level_idx > 0").select(F.col("name").alias("node"), F.col("level_idx").alias("depth"), "parent")
    lost = taxa.sparkSession.createDataFrame([("REJECTED", 0, "Root")], "node string, depth int, parent string")
    every = nodes.unionByName(lost)
    return every.join(totals, ["node", "depth"], "left").select("node", "depth", "parent", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
