"""Column functions on nucleotide sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The complement table (S and W map to each other, which results depend on) and the letters' bases.
LETTERS = "ACGTURYKMSWBVDHN"
COMPLEMENTS = "TGCAAYRMKWSVBHDN"
BASES = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "GA", "Y": "CT", "K": "GT", "M": "AC",
    "S": "GC", "W": "AT", "B": "GTC", "D": "GTA", "H": "ATC", "V": "GAC",
}
ANY_BASE = "ATCG"
DIGITS = {"A": 0, "C": 1, "G": 2, "T": 3}

#: How letters of prose stand for bases in the derived test sequences.
FOLDS = {"plain": "ACGTACGTACGTACGTACGTACGTAC", "iupac": "ACGTACGTACGTACGTACGTACRYNN"}


def derived_sequence(text: Column, fold: str = "plain") -> Column:
    """A nucleotide sequence from prose: its ASCII letters, each replaced by a base."""
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", FOLDS[fold])


def revcomp(kmer: Column) -> Column:
    """Reverse complement."""
    return F.reverse(F.translate(kmer, LETTERS, COMPLEMENTS))


def unknown_letters(seq: Column) -> Column:
    """Whether a sequence holds a letter outside the complement table."""
    return seq.rlike(f"[^{LETTERS}]")


def pattern_filter(kmer: Column, pattern: list[int]) -> Column:
    """The characters at which the mask is 1."""
    if set(pattern) - {0, 1}:
        raise ValueError("a pattern holds only 0 and 1")
    if 0 not in pattern:
        return kmer
    return F.concat(*(F.substring(kmer, i + 1, 1) for i, keep in enumerate(pattern) if keep))


def encode_kmer(kmer: Column) -> Column:
    """Base digits read as a decimal number; null for other letters."""
    return F.translate(kmer, "".join(DIGITS), "".join(map(str, DIGITS.values()))).try_cast("bigint")


def code_rank(code: Column, k: int) -> Column:
    """The place of a code among all codes of k digits, from 0."""
    return F.conv(code.cast("string"), 4, 10).cast("int")


def encoder(spark: SparkSession, k: int) -> DataFrame:
    """All words of k bases with code and rank."""
    digits = F.lpad(F.conv(F.col("id").cast("string"), 10, 4), k, "0")
    word = F.translate(digits, "".join(map(str, DIGITS.values())), "".join(DIGITS))
    return spark.range(4**k).select(word.alias("kmer"), digits.cast("bigint").alias("code"), F.col("id").cast("int").alias("code_rank"))


def expand_iupac(kmer: Column) -> Column:
    """All plain words that an ambiguous one stands for."""
    bases = F.create_map(*(x for letter, b in BASES.items() for x in (F.lit(letter), F.array(*map(F.lit, b)))))
    other = F.array(*map(F.lit, ANY_BASE))
    letters = F.transform(F.sequence(F.lit(1), F.length(kmer)), lambda i: kmer.substr(i, F.lit(1)))
    return F.aggregate(
        letters,
        F.array(F.lit("")),
        lambda words, c: F.flatten(F.transform(words, lambda w: F.transform(F.coalesce(F.try_element_at(bases, c), other), lambda b: F.concat(w, b)))),
    )


def is_homopolymer(kmer: Column, k: int) -> Column:
    return reduce(lambda a, b: a | b, (kmer == letter * k for letter in "ATCG"))
