"""Column functions on paths, headers, lineages and report keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("domain", "phylum", "group", "order", "family")
ALL_LEVELS = ("root", *LEVELS)


def name_tokens(path: Column) -> Column:
    """Parts of a file's stem without the last one; only the last suffix is cut."""
    stem = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    tokens = F.split(stem, "_")
    return F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))


def parse_taxonomy(path: Column, on_bad: str = "error") -> Column:
    """Struct of five names from a file name; other token counts fail, or give null with on_bad='drop'."""
    t = name_tokens(path)
    names = F.struct(*(F.get(t, F.lit(i)).alias(level) for i, level in enumerate(LEVELS)))
    if on_bad == "drop":
        return F.when(F.size(t) == 5, names)
    message = F.concat(F.lit("five names are needed before the last one in "), path)
    return F.when(F.size(t) == 5, names).otherwise(F.when(F.raise_error(message).isNull(), names))


def accession_of_header(line: Column) -> Column:
    """A FASTA header up to the first dot, without its mark."""
    return F.substr(F.substring_index(line, ".", 1), F.lit(2))


def manifest_fields(line: Column) -> tuple[Column, Column, Column]:
    """Accession, url and genome file url of an assembly summary line."""
    tokens = F.split(line, r"\s+")
    url = F.get(F.filter(tokens, lambda x: F.startswith(x, F.lit("https"))), F.lit(0))
    last = F.element_at(F.split(url, "/"), -1)
    return F.get(tokens, F.lit(0)), url, F.concat(url, F.lit("/"), last, F.lit("_genomic.fna.gz"))


def lineage_names(lineage: Column, organism: Column) -> Column:
    """Struct of domain, phylum, group, order, genus, species; order is null where no name ends in `ales`."""
    ales = F.filter(lineage, lambda x: F.endswith(x, F.lit("ales")))
    third, second = F.get(lineage, F.lit(2)), F.get(lineage, F.lit(1))
    words = F.split(organism, " ")
    return F.struct(
        F.get(lineage, F.lit(0)).alias("domain"),
        second.alias("phylum"),
        F.when(F.endswith(third, F.lit("ales")), second).otherwise(third).alias("group"),
        F.try_element_at(ales, F.lit(-1)).alias("order"),
        F.get(words, F.lit(0)).alias("genus"),
        F.get(words, F.lit(1)).alias("species"),
    )


def node_key(name: Column, depth: Column) -> Column:
    return F.concat_ws("_", name, depth.cast("string"))


def flow_percent(value: Column, reads_per_sample: int = 100) -> Column:
    return value / F.lit(float(reads_per_sample)) * 100
