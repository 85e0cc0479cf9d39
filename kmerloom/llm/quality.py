"""Operator 9: quality rules with thresholds from mergeable quantile sketches per language and source.

Each document's measures are rates that don't grow with its length.  A KLL sketch of each measure is built per language
and source in one aggregate (partial sketches are merged, so a hot source is no single task), and the same sketches are
merged again per language and over all.  The fences of a measure are its far-out ones: the third quartile plus, and the
first less, REACH times the spread between the quartiles, the spread being at least a floor that a measure states.  A
group of fewer than LEAST documents takes its language's fences, and a language with fewer those of all.  Fences are
joined to the documents by language and source, and a document is kept if it passes the base rules and lies within all of them.

Everything is DataFrame functions.  Null text: no words (it fails the base rules); null language or source: a group of
its own.  Sketches hold up to SKETCH items exactly; beyond that ranks are off by a small fraction of the documents.
Rows are judged one by one, equal rows too; an empty table gives no rows.  Other columns are kept by apply_rules().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, masked, small_side, stored, text_bytes

#: KLL parameter k: a group of at most so many documents has exact quantiles.
SKETCH = 4096
#: Fewest documents of a group that sets its own fences.
LEAST = 50
#: Times the quartile spread that a fence lies off the quartile.
REACH = 6.0
#: Measure -> (least spread, has a lower fence, has an upper fence).
MEASURES = {
    "mean_word": (0.5, True, True),
    "symbol_rate": (0.01, False, True),
    "dup_line_rate": (0.1, False, True),
    "repeat_rate": (0.05, False, True),
}


def _n(column: Column) -> Column:
    return column.cast("long")


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Repeated windows: if all 3-word windows (as 64-bit hashes) are distinct there are none.  Otherwise windows are sorted with
    their places, those equal to a neighbour are repeated, and each adds the words that the one before hasn't covered.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.greatest(F.size("__h") - 2, F.lit(0))
    pairs = F.zip_with(F.slice("__h", 1, n), F.slice("__h", 2, n), lambda a, b: F.xxhash64(a, b))
    triples = F.zip_with(pairs, F.slice("__h", 3, n), lambda a, b: F.xxhash64(a, b))
    placed = F.sort_array(F.transform("__g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    m = F.size("__p") - 1
    same = F.zip_with(F.slice("__p", 1, m), F.slice("__p", 2, m), lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])))
    places = F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end")),
        lambda acc, i: F.struct((acc["n"] + i + 3 - F.greatest(acc["end"], i)).alias("n"), (i + 3).alias("end")),
        lambda acc: acc["n"],
    )
    return (
        docs.withColumn("__w", F.filter(F.split(t, f"{BLANK}+"), lambda w: w != ""))
        .withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
        .withColumn("__g", triples)
        .withColumn("__p", F.when(F.size("__g") > F.size(F.array_distinct("__g")), placed))
        .withColumn("n_words", _n(F.size("__w")))
        .withColumn("word_chars", _n(F.aggregate("__w", F.lit(0), lambda n, w: n + F.length(w))))
        .withColumn("n_symbols", _n(F.length(F.regexp_replace(t, "[^#*$%&|<>]+", ""))))
        .withColumn("__l", F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
        .withColumn("n_dup_lines", _n(F.size("__l") - F.size(F.array_distinct("__l"))))
        .withColumn("n_repeat_words", _n(F.when(F.col("__p").isNull(), F.lit(0)).otherwise(covered)))
        .drop("__w", "__h", "__g", "__p", "__l")
    )


def rates(measured: DataFrame) -> DataFrame:
    """The measures that fences are set on; null where a document has no words."""
    words = F.when(F.col("n_words") > 0, F.col("n_words").cast("double"))
    return (
        measured.withColumn("mean_word", F.col("word_chars") / words)
        .withColumn("symbol_rate", F.col("n_symbols") / (F.col("word_chars") + 1.0))
        .withColumn("dup_line_rate", F.col("n_dup_lines") / words)
        .withColumn("repeat_rate", F.col("n_repeat_words") / words)
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _fences(sketches: DataFrame, tag: str) -> list[Column]:
    """Fence columns of one level of merged sketches."""
    out = []
    for m, (floor, low, high) in MEASURES.items():
        q1, q3 = (F.kll_sketch_get_quantile_double(f"s_{m}", F.lit(q)) for q in (0.25, 0.75))
        spread = REACH * F.greatest(q3 - q1, F.lit(floor))
        out.append((q1 - spread if low else F.lit(float("-inf"))).alias(f"{tag}_{m}_low"))
        out.append((q3 + spread if high else F.lit(float("inf"))).alias(f"{tag}_{m}_high"))
    return out


def thresholds(rated: DataFrame) -> DataFrame:
    """rated(lang, source, measures) -> stored table per lang and source: m_low, m_high for each measure m."""
    sketch = [F.kll_sketch_agg_double(F.col(m), F.lit(SKETCH)).alias(f"s_{m}") for m in MEASURES]
    merge = [F.kll_merge_agg_double(F.col(f"s_{m}"), F.lit(SKETCH)).alias(f"s_{m}") for m in MEASURES]
    group = rated.where("n_words > 0").groupBy("lang", "source").agg(F.count("*").alias("n"), *sketch)
    group = stored(group, "sketches")
    by_lang = group.groupBy("lang").agg(F.sum("n").alias("n"), *merge)
    over_all = group.agg(F.sum("n").alias("n"), *merge).where("n > 0")  # an empty sketch has no quantiles
    g = group.select("lang", "source", F.col("n").alias("g_n"), *_fences(group, "g"))
    ln = by_lang.select(F.col("lang").alias("l_lang"), F.col("n").alias("l_n"), *_fences(by_lang, "l"))
    a = over_all.select(F.lit(1).alias("one"), *_fences(over_all, "a"))
    joined = g.join(ln, g["lang"].eqNullSafe(ln["l_lang"])).withColumn("one", F.lit(1)).join(F.broadcast(a), "one")
    pick = lambda x: F.when(F.col("g_n") >= LEAST, F.col(f"g_{x}")).when(F.col("l_n") >= LEAST, F.col(f"l_{x}")).otherwise(F.col(f"a_{x}"))
    return stored(joined.select("lang", "source", *(pick(f"{m}_{e}").alias(f"{m}_{e}") for m in MEASURES for e in ("low", "high"))), "fences")


def judged(measured: DataFrame) -> DataFrame:
    """measured(lang, source, the five counts, ...) with base_failed and kept; it is read twice, so store it if costly."""
    rated = rates(measured)
    fences = thresholds(rated)
    fences = fences.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *(c for c in fences.columns if c not in ("lang", "source")))
    joined = rated.join(
        small_side(fences, 256), rated["lang"].eqNullSafe(fences["__lang"]) & rated["source"].eqNullSafe(fences["__source"]), "left"
    )
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high"))
    out = joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
    return out.select(*measured.columns, "base_failed", "kept")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured_table(docs: DataFrame, *keep: str) -> DataFrame:
    """Stored counts of all documents, without their texts."""
    return stored(base_measures(docs).select(*keep, "lang", "source", *COUNTS), "measures")


def apply_rules(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs that are kept; columns as they were, whatever their names and types.  Rows are found again by id and text."""
    named = masked(docs, doc_id=id_col, text="text", lang="lang", source="source")
    work = named.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__t"), "text", "lang", "source")
    bad = stored(judged(measured_table(work, "__id", "__t")).where("not kept").select("__id", "__t"), "rejected").distinct()
    bad = small_side(bad, text_bytes("__id"))
    same = named["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(named["text"]) == bad["__t"])
    return named.join(bad, same, "left_anti").toDF(*docs.columns)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(measured_table(docs, "doc_id")).select("doc_id", *COUNTS, "base_failed", "kept")


_BLANK_SQL = "[\\x20\\x09-\\x0D]"


def _sql_fences() -> str:
    """DuckDB expressions of one level's fences over grouped rows."""
    out = []
    for m, (floor, low, high) in MEASURES.items():
        q1, q3 = (f"quantile_disc({m}, {q})" for q in (0.25, 0.75))
        spread = f"{REACH} * greatest({q3} - {q1}, {floor})"
        out.append(f"{f'{q1} - {spread}' if low else "'-inf'::double"} as {m}_low")
        out.append(f"{f'{q3} + {spread}' if high else "'inf'::double"} as {m}_high")
    return ", ".join(out)


#: Exact quantiles: equal to the sketches as long as no group has more than SKETCH documents.
OP9_SQL = f"""
with w as (select doc_id, lang, source, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK_SQL}+'), lambda x: x <> '') as ws from documents),
 l as (select doc_id, t, lang, source, ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from w),
 g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as w3 from w, unnest(range(1, len(ws) - 1)) as r(i)),
 d as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, w3) as n from g) where n > 1),
 r as (select doc_id, count(distinct i + k) as n from d, unnest([0, 1, 2]) as o(k) group by doc_id),
 m as (select doc_id, lang, source, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
    coalesce(r.n, 0)::bigint as n_repeat_words from l left join r using (doc_id)),
 x as (select *, word_chars / nullif(n_words, 0)::double as mean_word, n_symbols / (word_chars + 1.0::double) as symbol_rate,
    n_dup_lines / nullif(n_words, 0)::double as dup_line_rate, n_repeat_words / nullif(n_words, 0)::double as repeat_rate from m),
 fg as (select lang, source, count(*) as n, {_sql_fences()} from x where n_words > 0 group by all),
 fl as (select lang, count(*) as n, {_sql_fences()} from x where n_words > 0 group by all),
 fa as (select {_sql_fences()} from x where n_words > 0),
 j as (select x.*, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    {' and '.join(f"{m} between {f'case when fg.n >= {LEAST} then fg.{m}_low when fl.n >= {LEAST} then fl.{m}_low else fa.{m}_low end'} and {f'case when fg.n >= {LEAST} then fg.{m}_high when fl.n >= {LEAST} then fl.{m}_high else fa.{m}_high end'}" for m in MEASURES)} as inside
   from x left join fg on x.lang is not distinct from fg.lang and x.source is not distinct from fg.source
   left join fl on x.lang is not distinct from fl.lang cross join fa)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(inside, false) as kept from j
"""
