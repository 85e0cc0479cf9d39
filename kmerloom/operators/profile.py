"""The k-mer counter of a window: both strands, spaced patterns, ambiguity letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import code_rank, encode_kmer, expand_iupac, is_homopolymer, pattern_filter, revcomp
from .windows import deal as deal_windows
from .windows import kmers


def count_kmers(df: DataFrame, keys: list[str]) -> DataFrame:
    """df(keys, pos, kmer) -> keys, kmer, cnt, first_pos."""
    return df.groupBy(*keys, "kmer").agg(F.count("*").alias("cnt"), F.min("pos").alias("first_pos"))


def merge_strands(df: DataFrame, keys: list[str], semantics: str = "reference") -> DataFrame:
    """Adds each k-mer's count to its reverse complement's, in one pass: keys, kmer, cnt, ord.

    Where several k-mers share a reverse complement, the reference semantics take the last one's count, else the sum.
    ord is the place at which a key would be met: own strand first, then by position.
    """
    row = lambda s, k: F.struct(F.lit(s).alias("s"), k.alias("k"), F.col("cnt").alias("c"), F.col("first_pos").alias("o"))
    both = df.select(*keys, F.inline(F.array(row(0, F.col("kmer")), row(1, revcomp(F.col("kmer"))))))
    other = "max_by(c, o)" if semantics == "reference" else "sum(c)"
    return both.groupBy(*keys, "k").agg(
        F.expr(f"coalesce(sum(c) filter (where s = 0), 0) + coalesce({other} filter (where s = 1), 0)").alias("cnt"),
        F.min(F.struct("s", "o")).alias("ord"),
    ).withColumnRenamed("k", "kmer")


def apply_pattern_counts(df: DataFrame, keys: list[str], pattern: list[int], semantics: str = "reference") -> DataFrame:
    """Filters k-mers by the mask; those that fall together keep the last one's count (reference) or the sum."""
    if 0 not in pattern:
        return df.select(*keys, "kmer", "cnt")
    how = F.max_by("cnt", "ord") if semantics == "reference" else F.sum("cnt")
    return df.withColumn("kmer", pattern_filter(F.col("kmer"), pattern)).groupBy(*keys, "kmer").agg(how.alias("cnt"))


def drop_homopolymers(df: DataFrame, k: int) -> DataFrame:
    return df.where(~is_homopolymer(F.col("kmer"), k))


def sum_expanded(df: DataFrame, keys: list[str]) -> DataFrame:
    """Ambiguous k-mers become plain ones, each with the whole part of its share; counts of equal ones are added."""
    words = F.when(F.col("kmer").rlike("[^ACGT]"), expand_iupac(F.col("kmer"))).otherwise(F.array("kmer"))
    spread = df.select(*keys, F.col("cnt"), words.alias("__w")).select(
        *keys, F.explode("__w").alias("kmer"), F.expr("cnt div size(__w)").alias("cnt")
    )
    return spread.groupBy(*keys, "kmer").agg(F.sum("cnt").alias("cnt"))


def count_canonical(df: DataFrame, keys: list[str], width: int, semantics: str = "reference") -> DataFrame:
    """df(keys, win) -> keys, kmer, n: places at which a k-mer or its reverse complement stands, by the lesser of the two.

    Each window is turned once, so that both are slices of bytes.
    """
    short = 2 if semantics == "reference" else 0
    text = F.col("win").cast("string")
    whole = df.where(F.length("win") >= width + short).select(*keys, "win", revcomp(text).cast("binary").alias("back"))
    last = F.length("win") - (width + short) + 1
    at = whole.select(*keys, "win", "back", F.explode(F.sequence(F.lit(1), last)).alias("pos"))
    both = F.least(F.expr(f"substring(win, pos, {width})"), F.expr(f"substring(back, length(win) - pos - {width - 2}, {width})"))
    return at.select(*keys, both.cast("string").alias("kmer")).groupBy(*keys, "kmer").agg(F.count("*").alias("n"))


def both_strands(df: DataFrame, keys: list[str]) -> DataFrame:
    """count_canonical() -> keys, kmer, cnt: each k-mer's count and its reverse complement's, added."""
    row = lambda k, n: F.struct(k.alias("kmer"), n.alias("cnt"))
    turned = revcomp(F.col("kmer"))
    own = F.when(turned == F.col("kmer"), F.array(row(F.col("kmer"), 2 * F.col("n")))).otherwise(F.array(row(F.col("kmer"), F.col("n")), row(turned, F.col("n"))))
    return df.select(*keys, F.inline(own))


def kmer_profile(
    wins: DataFrame, keys: list[str], k: int, pattern: list[int], semantics: str = "reference", deal: list[str] | None = None
) -> DataFrame:
    """wins(keys, win) -> keys, kmer, cnt: the full counter.

    Windows are dealt once, by their keys or by `deal`, some of these; every aggregate after that finds its rows in place.
    In a window without the one letter that shares its complement with another (U), a k-mer and its reverse complement belong to each
    other alone, so both strands are counted in one aggregate.  Windows with it, and masks in the reference semantics, where the last of
    several k-mers counts, take the general way; each way is one exchange of its own windows.
    """
    if sum(pattern) != k:
        raise ValueError("a pattern keeps as many places as k")
    rows = wins.select(*keys, "win")
    paired = F.instr(F.col("win").cast("string"), "U") == 0
    simple = 0 not in pattern or semantics == "clean"

    def finished(merged: DataFrame) -> DataFrame:
        out = sum_expanded(drop_homopolymers(merged, k), keys)
        return drop_homopolymers(out, k) if semantics == "clean" else out

    def general(some: DataFrame) -> DataFrame:
        dealt = deal_windows(some, *(deal or keys))
        counted = count_kmers(kmers(dealt, len(pattern), semantics), keys)
        return finished(apply_pattern_counts(merge_strands(counted, keys, semantics), keys, pattern, semantics))

    if not simple:
        return general(rows)
    dealt = deal_windows(rows.where(paired), *(deal or keys))
    merged = both_strands(count_canonical(dealt, keys, len(pattern), semantics), keys)
    if 0 in pattern:
        merged = merged.withColumn("kmer", pattern_filter(F.col("kmer"), pattern)).groupBy(*keys, "kmer").agg(F.sum("cnt").alias("cnt"))
    return finished(merged).unionByName(general(rows.where(~paired)))


def add_counters(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two count tables, equal keys added."""
    return a.unionByName(b).groupBy(*keys).agg(F.sum("cnt").alias("cnt"))


def count_map(df: DataFrame, keys: list[str]) -> DataFrame:
    """One sparse code -> count map per key; a map holds at most 4^k entries."""
    return df.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("code", "cnt")))).alias("counts"))


def explode_map(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.explode("counts").alias("code", "cnt"))


def filled(cells: str | Column, rank: str, count: str, size: int) -> Column:
    """An array of `size` counts from an array of (rank, count) in rising order of ranks; 0 where there is none.

    Each entry gives its zeros and itself; they are joined once, so the work is in proportion to the array.
    """
    last = F.struct(F.lit(size).alias(rank), F.lit(0).cast("long").alias(count))
    every = F.concat(F.transform(cells, lambda e: F.struct(e[rank].cast("int").alias(rank), e[count].cast("long").alias(count))), F.array(last))
    before = F.concat(F.array(F.lit(-1)), F.transform(cells, lambda e: e[rank].cast("int")))
    piece = lambda e, b: F.concat(F.array_repeat(F.lit(0).cast("long"), e[rank] - b - 1), F.array(e[count]))
    return F.slice(F.flatten(F.zip_with(every, before, piece)), 1, size)


def ranked_counts(counts: Column, k: int) -> Column:
    """(r, c) of a code -> count map in rising order of the codes' ranks."""
    return F.sort_array(F.transform(F.map_entries(counts), lambda e: F.struct(code_rank(e["key"], k).alias("r"), e["value"].cast("long").alias("c"))))


def dense_counts(counts: Column, k: int) -> Column:
    """Array of all 4^k counts of a code -> count map, by rank of the code."""
    return filled(ranked_counts(counts, k), "r", "c", 4**k)


def with_codes(df: DataFrame) -> DataFrame:
    return df.withColumn("code", encode_kmer(F.col("kmer")))
