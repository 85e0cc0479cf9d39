"""Prediction of reads as their files arrive: each batch of new files runs through the batch plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.params import Params
from ..plans.pipelines import predict

#: Files that one reader takes.
FILES = 10_000


def predict_stream(spark: SparkSession, db: str, folder: str, out: str, checkpoint: str, params: Params):
    """A streaming query over new read files under folder; reports are written under out, a folder per batch and file.

    A batch that runs again replaces its own folders, so reports are written once.
    """
    files = spark.readStream.format("text").option("lineSep", "\n>").option("recursiveFileLookup", True).load(folder)
    named = files.select(F.col("_metadata.file_path").alias("file"))

    def batch(rows: DataFrame, number: int) -> None:
        paths = [r["file"] for r in rows.distinct().collect()]  # new files of one trigger
        if paths:
            from ..sources.fasta import read_reads

            # One reader for a group of files, so the plan doesn't grow with their number.
            groups = [read_reads(spark, paths[at : at + FILES]) for at in range(0, len(paths), FILES)]
            reads = reduce(DataFrame.unionByName, groups)
            predict(spark, db, reads, out, params, batch=number)

    return named.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
