"""Registered queries over the given tables, and their DuckDB SQL.

Sequences are derived from the documents' texts, taxonomy from their languages and sources, probabilities from the
embeddings, assembly summaries from the pages.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as fn
from ..functions import sequence as fs
from ..functions.scores import accepts, argmax, clamp_threshold, clamped, ladder
from ..operators import classify, consensus, ensembles, kernel, manifest, models, profile, relational, report, taxonomy
from ..operators import windows as w
from ..operators.storage import shared_path, stored
from ..sources import fasta, tables
from . import pipelines
from .params import Params, accepted

SIZE, K = 300, 4
MASK = [1, 1, 0, 1, 1]
#: Windows of a sequence.
MANY = 10
KEYS = ["doc_id", "win_idx"]


# ---- inputs ----------------------------------------------------------------------------------------------------------
def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def dna(spark: SparkSession, sf: str, fold: str = "plain") -> DataFrame:
    return docs(spark, sf).select("doc_id", fs.derived_sequence(F.col("text"), fold).alias("seq"))


def wins(spark: SparkSession, sf: str, fold: str = "plain", sampling: int = MANY) -> DataFrame:
    return w.windows(dna(spark, sf, fold), SIZE, sampling)


def _n():
    return F.expr("cast(substr(source, 4) as int)")


def genome_names(spark: SparkSession, sf: str, *others: str) -> DataFrame:
    """Names by language and source, with other columns of the documents."""
    n, block = _n(), F.expr("doc_id div 20") % 2
    name = F.concat_ws("_", "lang", F.concat("lang", F.lit("p"), n % 2), F.concat("lang", F.lit("g"), n % 4), F.concat("lang", F.lit("o"), n),
                       F.concat("lang", F.lit("f"), n, F.lit("x"), block), F.concat(F.lit("sp"), "doc_id"))
    return docs(spark, sf).select("doc_id", F.concat(F.lit("x/"), name, F.lit(".fna")).alias("path"), *others)


def named(spark: SparkSession, sf: str, *others: str) -> DataFrame:
    got = genome_names(spark, sf, *others).select("doc_id", F.col("doc_id").alias("file_ord"), fn.parse_taxonomy(F.col("path")).alias("t"), *others)
    return got.select("doc_id", "file_ord", "t.*", *others)


def probs(spark: SparkSession, sf: str) -> DataFrame:
    """Probabilities of eight classes from all elements of a vector: an element's class is its place modulo eight."""
    add = lambda v: F.aggregate(v, F.lit(0).cast("bigint"), lambda a, y: a + y)
    # A float by a float: by an integer the product would be a double here, and near a half it would round the other way than in SQL.
    e = F.transform("embedding", lambda x: F.round(x * F.lit(1000).cast("float")).cast("bigint"))
    q = F.transform(e, lambda x: x * x * x * x)
    parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: add(F.filter(q, lambda _, i: i % 8 == c)))
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(
        F.expr("vec_id div 10").alias("read_id"), (F.col("vec_id") % 10).alias("win_idx"), F.transform(parts, lambda x: x.cast("double") / add(q).cast("double")).alias("p")
    )


def doc_profile(spark: SparkSession, sf: str, fold: str = "plain", sampling: int = MANY, pattern: list[int] | None = None, semantics: str = "reference", deal=None):
    return profile.kmer_profile(wins(spark, sf, fold, sampling), KEYS, K, pattern or [1] * K, semantics, deal)


def dealt(spark: SparkSession, sf: str, fold: str = "plain") -> DataFrame:
    """Windows dealt by their keys, so that counters of k-mers find their rows in place."""
    return w.deal(wins(spark, sf, fold).select(*KEYS, "win"), *KEYS)


def own_ids(spark: SparkSession, sf: str) -> bool:
    """Whether no two documents share an id, so that a document's windows have keys of their own."""
    return not docs(spark, sf).groupBy("doc_id").count().where("count > 1").limit(1).count()


def texts(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    """Documents dealt by id."""
    return w.deal(docs(spark, sf).select("doc_id", "text", *names), "doc_id")


def in_rows(spark: SparkSession, sf: str, fold: str, columns: str, f) -> DataFrame:
    """doc_id, win_idx and f's columns of the windows' blocks; ids have to be own_ids()."""
    return kernel.mapped(texts(spark, sf), kernel.Texts(fold, SIZE, MANY), ["doc_id"], columns, f, numbered=True)


def word_counts(r: kernel.Rows) -> tuple:
    return r.row, [kernel.spelled(r.words.spelled(r.code)), r.cnt]


def plain_counts(row, rank, cnt, code: bool = False) -> tuple:
    word, number = kernel.plain_words(rank, K)
    return row, [word, cnt, number] if code else [word, cnt]


# ---- SQL pieces --------------------------------------------------------------------------------------------------------
def sql_dna(fold: str = "plain") -> str:
    return f"""dna as (select doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')),
 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{fs.FOLDS[fold]}') as seq from documents)"""


def sql_wins(fold: str = "plain", sampling: int = MANY) -> str:
    return f"""{sql_dna(fold)}, wins as (select doc_id, i::int as win_idx, (((length(seq) - {SIZE}) // {sampling}) * i)::int as start,
 substr(seq, ((length(seq) - {SIZE}) // {sampling}) * i + 1, {SIZE}) as win from dna, unnest(range({sampling})) as r(i) where length(seq) >= {SIZE})"""


def sql_kmers(width: int = K, fold: str = "plain", sampling: int = MANY, short: int = 2) -> str:
    last = SIZE - width - short + 1
    return f"""{sql_wins(fold, sampling)}, kmers as (select doc_id, win_idx, j::int as pos, substr(win, j, {width}) as kmer
 from wins, unnest(range(1, {last} + 1)) as s(j))"""


def sql_rc(col: str) -> str:
    return f"reverse(translate({col}, '{fs.LETTERS}', '{fs.COMPLEMENTS}'))"


def sql_mask(col: str, pattern: list[int]) -> str:
    return " || ".join(f"substr({col}, {i + 1}, 1)" for i, keep in enumerate(pattern) if keep)


def sql_counts(width: int = K, fold: str = "plain", sampling: int = MANY, short: int = 2) -> str:
    return f"""{sql_kmers(width, fold, sampling, short)}, counted as (select doc_id, win_idx, kmer, count(*) as cnt, min(pos) as first_pos
 from kmers group by all)"""


def sql_merged(width: int = K, fold: str = "plain", sampling: int = MANY, semantics: str = "reference") -> str:
    other = "arg_max(c, o)" if semantics == "reference" else "sum(c)"
    return f"""{sql_counts(width, fold, sampling, 2 if semantics == "reference" else 0)},
 strands as (select doc_id, win_idx, 0 as s, kmer as k, cnt as c, first_pos as o from counted
  union all select doc_id, win_idx, 1, {sql_rc("kmer")}, cnt, first_pos from counted),
 merged as (select doc_id, win_idx, k as kmer, (coalesce(sum(c) filter (s = 0), 0) + coalesce({other} filter (s = 1), 0))::bigint as cnt,
  min(s * 1000000 + o) as ord from strands group by all)"""


def sql_masked(pattern: list[int], fold: str = "plain", sampling: int = MANY, semantics: str = "reference") -> str:
    before = sql_merged(len(pattern), fold, sampling, semantics)
    if 0 not in pattern:
        return f"{before}, masked as (select doc_id, win_idx, kmer, cnt from merged)"
    how = "arg_max(cnt, ord)" if semantics == "reference" else "sum(cnt)"
    return f"""{before}, masked as (select doc_id, win_idx, k2 as kmer, {how}::bigint as cnt
 from (select *, {sql_mask("kmer", pattern)} as k2 from merged) group by all)"""


def sql_bases(col: str) -> str:
    cases = " ".join(f"when '{c}' then '{b}'" for c, b in fs.BASES.items())
    return f"string_split(case {col} {cases} else '{fs.ANY_BASE}' end, '')"


HOMO = ", ".join(f"'{c * K}'" for c in "ATCG")


def sql_expanded(source: str) -> str:
    """CTEs from `source`(doc_id, win_idx, kmer, cnt) of plain k-mers with counts."""
    steps, at = [], f"(select doc_id, win_idx, kmer, cnt from {source} where regexp_matches(kmer, '[^ACGT]'))"
    steps.append(f"x0 as (select doc_id, win_idx, kmer, cnt, '' as word, 1 as n from {at})")
    for i in range(K):
        b = sql_bases(f"substr(kmer, {i + 1}, 1)")
        steps.append(f"x{i + 1} as (select doc_id, win_idx, kmer, cnt, word || unnest({b}) as word, n * len({b}) as n from x{i})")
    steps.append(f"""expanded as (select doc_id, win_idx, kmer, sum(cnt)::bigint as cnt from
 (select doc_id, win_idx, word as kmer, cnt // n as cnt from x{K} union all select doc_id, win_idx, kmer, cnt from {source} where not regexp_matches(kmer, '[^ACGT]'))
 group by all)""")
    return ", ".join(steps)


def sql_profile(fold: str = "plain", sampling: int = MANY, pattern: list[int] | None = None, semantics: str = "reference") -> str:
    out = f"""{sql_masked(pattern or [1] * K, fold, sampling, semantics)}, kept as (select * from masked where kmer not in ({HOMO})), {sql_expanded("kept")}"""
    where = f" where kmer not in ({HOMO})" if semantics == "clean" else ""
    return f"{out}, profile as (select *, translate(kmer, 'ACGT', '0123')::bigint as code from expanded{where})"


SQL_NAMES = """named as (select doc_id, doc_id as file_ord, lang as domain, lang || 'p' || n % 2 as phylum, lang || 'g' || n % 4 as "group",
 lang || 'o' || n as "order", lang || 'f' || n || 'x' || (doc_id // 20) % 2 as family
 from (select *, cast(substr(source, 4) as int) as n from documents))"""
SQL_PAIRS = f"""{SQL_NAMES}, pairs as (
 select file_ord as ord, 1 as level_idx, 'domain' as level, domain as name, 'Root' as parent from named
 union all select file_ord, 2, 'phylum', phylum, domain from named
 union all select file_ord, 3, 'group', "group", phylum from named
 union all select file_ord, 4, 'order', "order", "group" from named
 union all select file_ord, 5, 'family', family, "order" from named)"""
SQL_TREE = f"""{SQL_PAIRS}, nodes as (select level_idx, level, lower(name) as key, arg_min(name, ord) as name, arg_min(parent, ord) as parent from pairs group by all),
 tree as (select level_idx, level, key || '_' || level as node_id, name, parent,
  lower(parent) || '_' || (['root', 'domain', 'phylum', 'group', 'order', 'family'])[level_idx] as parent_id from nodes
  union all select 0, 'root', 'root_root', 'Root', null, null)"""
SQL_CODES = f"""{SQL_PAIRS}, codes as (select level, name, (row_number() over (partition by level order by first_ord, name) - 1)::int as code
 from (select level, name, min(ord) as first_ord from pairs group by all))"""
SQL_PROBS = """probs as (select vec_id // 10 as read_id, vec_id % 10 as win_idx, list_transform(s, lambda x: x::double / list_sum(q)::double) as p
 from (select vec_id, q, [coalesce(list_sum([q[i] for i in range(c + 1, len(q) + 1, 8)]), 0) for c in range(8)] as s
 from (select vec_id, list_transform(list_transform(embedding, lambda x: round(x * 1000)::bigint), lambda x: x * x * x * x) as q from embeddings)))"""


def sql_consensus(func: str, t: float = 0.8, semantics: str = "reference") -> str:
    rungs = "[" + ", ".join(f"{x!r}::double" for x in ladder(t)) + "]"
    total, top = "list_reduce(p, lambda a, x: a + x)", "list_max(p)"
    second = f"list_max(list_filter(p, lambda x: x <> {top}))"
    test = {
        "delta_mean": f"{top} - {total} / len(p) > t",
        "min_max": f"coalesce({top} - {second} > t, false)",
        "delta_sum": f"{top} > ({total} - {top}) + t",
    }[func]
    flat = f"{second} is null" if func == "min_max" else "false"
    least = "min(step) filter (class <> 0) over g" if semantics == "reference" else "min(step) over g"
    votes = """select read_id, case when vote is null or vote = 0 then 0 else vote end as vote, count(*) as votes, arg_min(vote is not null, win_idx) as counts
  from voted group by read_id, case when vote is null or vote = 0 then 0 else vote end"""
    if semantics == "clean":
        votes = "select read_id, vote, count(*) as votes, true as counts from voted where vote is not null group by all"
    return f"""{SQL_PROBS}, stepped as (select read_id, win_idx, (list_position(p, {top}) - 1)::int as class,
  nullif(coalesce(list_position(list_transform({rungs}, lambda t: {test}), true), 0), 0) as step, {flat} as flat from probs),
 voted as (select read_id, win_idx, class, case when bool_or(flat) over g or {least} is null
  or step <= {least} then class end as vote from stepped window g as (partition by read_id)),
 votes as ({votes})"""


LEVEL_COLUMNS = ['domain', 'phylum', '"group"', '"order"', 'family']


def sql_descent(threshold: float) -> str:
    n = 4**K
    pairs = " union all ".join(
        f"select {i} as level_idx, {LEVEL_COLUMNS[i - 1] if i else repr('Root')} as parent, {c} as child, code, cnt from leaf" for i, c in enumerate(LEVEL_COLUMNS)
    )
    out = f"""{sql_profile()}, {SQL_NAMES},
 leaf as (select domain, phylum, "group", "order", family, code, sum(cnt) as cnt from profile join named using (doc_id) group by all),
 cells as (select level_idx, parent, child, code, sum(cnt) as n from ({pairs}) group by all),
 kids as (select level_idx, parent, child, sum(n) as total, round(1e6 * ln(1 / (sum(n) + {n})))::bigint as rest from cells group by all),
 weights as materialized (select c.level_idx, c.parent, c.child, c.code, round(1e6 * ln((c.n + 1) / (k.total + {n})))::bigint as wt, k.rest
  from cells c join kids k using (level_idx, parent, child)),
 feats as materialized (select doc_id as read_id, win_idx, code, cnt from profile),
 act0 as (select distinct read_id, 'Root' as parent from feats)"""
    for i in range(5):
        out += f""",
 sc{i} as (select f.read_id, f.win_idx, k.parent, k.child, sum(f.cnt * coalesce(g.wt, k.rest)) as score
  from act{i} a join kids k on k.level_idx = {i} and k.parent = a.parent join feats f on f.read_id = a.read_id
  left join weights g on g.level_idx = {i} and g.parent = k.parent and g.child = k.child and g.code = f.code group by all),
 bs{i} as (select read_id, win_idx, parent, arg_min(child, struct_pack(s := -score, c := child)) as child from sc{i} group by all),
 vt{i} as materialized (select read_id, {i} as level_idx, parent, child, count(*) as votes from bs{i} group by all),
 act{i + 1} as (select distinct read_id, child as parent from (select *, sum(votes) over (partition by read_id, parent) as total from vt{i}) where votes > {threshold!r}::double * total)"""
    return out + ", descent as (" + " union all ".join(f"select * from vt{i}" for i in range(5)) + ")"


SQL_FLOWS = f"""{sql_descent(0.6)}, {SQL_TREE.replace(SQL_NAMES + ", ", "")},
 flow as (select d.read_id, d.level_idx, d.parent as source, d.child as target, d.votes::bigint as value from descent d
  where d.votes >= 2 and exists (select 1 from tree t where t.name = d.child and t.level_idx = d.level_idx + 1)
  union all select doc_id, 0, 'Root', 'REJECTED', {MANY} from dna where length(seq) < {SIZE}),
 totals as (select coalesce(t.level_idx, 0) as depth, coalesce(t.name, 'REJECTED') as node, sum(value)::bigint as value
  from flow f left join tree t on t.name = f.target and t.level_idx = f.level_idx + 1 group by all)"""

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# ---- scalar functions --------------------------------------------------------------------------------------------------
@query("e1_parse_taxonomy", f"with {SQL_NAMES} select doc_id, domain, phylum, \"group\", \"order\", family from named")
def e1(spark, sf):
    return named(spark, sf).drop("file_ord")


@query("e2_windows", f"with {sql_wins('plain', MANY)} select doc_id, win_idx, start, win from wins")
def e2(spark, sf):
    return wins(spark, sf, "plain", MANY).withColumn("win", F.col("win").cast("string"))


@query("e3_kmers", f"""with {sql_kmers()} select doc_id, win_idx, count(*) as n, count(distinct kmer) as kinds, arg_min(kmer, pos) as first_kmer,
 arg_max(kmer, pos) as last_kmer, max(pos) as last_pos from kmers group by all""")
def e3(spark, sf):
    if own_ids(spark, sf):
        def f(b):
            r = kernel.counted(b.wins, b.length, K)
            n = np.bincount(r.row, r.cnt, len(b.wins)).astype(np.int64)
            some = np.flatnonzero(n)
            last = (n[some, None] - 1) + np.arange(K)
            ends = kernel.spelled(b.wins[some, :K]), kernel.spelled(np.take_along_axis(b.wins[some], last, 1))
            return some, [n[some], np.bincount(r.row, minlength=len(b.wins))[some], *ends, n[some].astype(np.int32)]

        return in_rows(spark, sf, "plain", "n bigint, kinds bigint, first_kmer string, last_kmer string, last_pos int", f)
    return w.kmers(wins(spark, sf), K).groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.count_distinct("kmer").alias("kinds"), F.min_by("kmer", "pos").alias("first_kmer"),
        F.max_by("kmer", "pos").alias("last_kmer"), F.max("pos").alias("last_pos"),
    )


@query("e4_revcomp", f"with {sql_wins('iupac')} select doc_id, win_idx, {sql_rc('win')} as rc from wins")
def e4(spark, sf):
    return wins(spark, sf, "iupac").select(*KEYS, fs.revcomp(F.col("win").cast("string")).alias("rc"))


@query("e5_pattern", f"with {sql_kmers(5)} select kmer, {sql_mask('kmer', MASK)} as masked, count(*) as n from kmers group by all")
def e5(spark, sf):
    k = w.kmers(wins(spark, sf), 5).groupBy("kmer").agg(F.count("*").alias("n"))
    return k.select("kmer", fs.pattern_filter(F.col("kmer"), MASK).alias("masked"), "n")


@query("e6_encode", f"with {sql_kmers()} select kmer, translate(kmer, 'ACGT', '0123')::bigint as code, count(*) as n from kmers group by all")
def e6(spark, sf):
    k = w.kmers(wins(spark, sf), K).groupBy("kmer").agg(F.count("*").alias("n"))
    return k.select("kmer", fs.encode_kmer(F.col("kmer")).alias("code"), "n")


SQL_ENCODER = """words as (select i::int as code_rank, (i // 64) * 1000 + (i // 16 % 4) * 100 + (i // 4 % 4) * 10 + i % 4 as code,
 substr('ACGT', (i // 64) % 4 + 1, 1) || substr('ACGT', (i // 16) % 4 + 1, 1) || substr('ACGT', (i // 4) % 4 + 1, 1) || substr('ACGT', i % 4 + 1, 1) as kmer
 from unnest(range(256)) as r(i))"""


@query("e7_encoder", f"""with {sql_kmers()}, {SQL_ENCODER} select w.kmer, code, code_rank, count(k.kmer) as n from words w left join kmers k on w.kmer = k.kmer group by all""")
def e7(spark, sf):
    k = w.kmers(wins(spark, sf), K).groupBy("kmer").agg(F.count("*").alias("n"))
    return F.broadcast(fs.encoder(spark, K)).join(k, "kmer", "left").select("kmer", "code", "code_rank", F.coalesce("n", F.lit(0)).alias("n"))


@query("e8_iupac", f"""with {sql_counts(K, 'iupac')}, {sql_expanded('counted')} select doc_id, win_idx, kmer, cnt from expanded""")
def e8(spark, sf):
    if own_ids(spark, sf):
        return in_rows(spark, sf, "iupac", "kmer string, cnt bigint", lambda b: plain_counts(*kernel.expanded(kernel.counted(b.wins, b.length, K))))
    c = profile.count_kmers(w.kmers(dealt(spark, sf, "iupac"), K), KEYS)
    return profile.sum_expanded(c, KEYS)


@query("e9_argmax", f"with {SQL_PROBS} select read_id, win_idx, (list_position(p, list_max(p)) - 1)::int as class from probs")
def e9(spark, sf):
    return probs(spark, sf).select("read_id", "win_idx", argmax(F.col("p")).alias("class"))


SQL_STEP = "list_reduce(p, lambda a, x: a + x)"


@query("e10_delta_mean", f"with {SQL_PROBS} select read_id, win_idx, round(list_max(p) - {SQL_STEP} / len(p), 9) as score, list_max(p) - {SQL_STEP} / len(p) > 0.5::double as ok from probs")
def e10(spark, sf):
    from ..functions.scores import score_delta_mean

    p, t = F.col("p"), F.lit(clamp_threshold(0.5))
    return probs(spark, sf).select("read_id", "win_idx", F.round(score_delta_mean(p), 9).alias("score"), accepts("delta_mean", p, t).alias("ok"))


@query("e11_min_max", f"with {SQL_PROBS} select read_id, win_idx, round(list_max(p) - list_max(list_filter(p, lambda x: x <> list_max(p))), 9) as score from probs")
def e11(spark, sf):
    from ..functions.scores import score_min_max

    return probs(spark, sf).select("read_id", "win_idx", F.round(score_min_max(F.col("p")), 9).alias("score"))


@query("e12_delta_sum", f"with {SQL_PROBS} select read_id, win_idx, list_max(p) > ({SQL_STEP} - list_max(p)) + 0.2::double as ok from probs")
def e12(spark, sf):
    return probs(spark, sf).select("read_id", "win_idx", accepts("delta_sum", F.col("p"), F.lit(0.2)).alias("ok"))


@query("e13_clamp", f"with {SQL_PROBS} select read_id, win_idx, least(1.0::double, greatest(0.01::double, p[1] * 8 - 0.5::double)) as t from probs")
def e13(spark, sf):
    return probs(spark, sf).select("read_id", "win_idx", clamped(F.get("p", F.lit(0)) * 8 - F.lit(0.5)).alias("t"))


SQL_MANIFEST = """lines as (select page_id as i, concat_ws(chr(9), concat('GCF_', page_id), case when page_id % 3 = 0 then 'representative genome' else 'na' end,
 concat('https://ftp.example.org/all/GCF_', page_id, '_v', page_id % 4)) as line from pages)"""


@query("e14_manifest", f"""with {SQL_MANIFEST} select i, 'GCF_' || i as accession, 'https://ftp.example.org/all/GCF_' || i || '_v' || i % 4 as url,
 'https://ftp.example.org/all/GCF_' || i || '_v' || i % 4 || '/GCF_' || i || '_v' || i % 4 || '_genomic.fna.gz' as fna_url from lines where i > 0 and line like '%representative genome%'""")
def e14(spark, sf):
    return manifest.manifest_urls(manifest.representative_only(_lines(spark, sf), 0))


def _lines(spark, sf):
    line = F.concat_ws("\t", F.concat(F.lit("GCF_"), "page_id"), F.when(F.col("page_id") % 3 == 0, F.lit("representative genome")).otherwise(F.lit("na")),
                       F.concat(F.lit("https://ftp.example.org/all/GCF_"), "page_id", F.lit("_v"), F.col("page_id") % 4))
    return spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("i"), line.alias("line"))


@query("p4_manifest", f"""with {SQL_MANIFEST}, named4 as (select doc_id, lang || '_Ph' || n % 2 || '_Gr' || n % 4 || '_Or' || n || 'ales_Gen' || n || '_sp' || doc_id || '.fna' as file_name
  from (select *, cast(substr(source, 4) as int) as n from documents))
 select 'GCF_' || i as accession, 'https://ftp.example.org/all/GCF_' || i || '_v' || i % 4 || '/GCF_' || i || '_v' || i % 4 || '_genomic.fna.gz' as fna_url, file_name
 from lines join named4 on doc_id = i where i > 0 and line like '%representative genome%'""")
def p4(spark, sf):
    """The manifest command on a written summary and the lineages of the documents with the pages' numbers."""
    path = shared_path(spark, "summary")
    tables.write_manifest(_lines(spark, sf), path)
    n, lit = _n(), F.lit
    lineage = F.array(F.col("lang"), F.concat(lit("Ph"), n % 2), F.concat(lit("Gr"), n % 4), F.concat(lit("Or"), n, lit("ales")))
    organism = F.concat(lit("Gen"), n, lit(" sp"), "doc_id")
    rows = docs(spark, sf).select(F.concat(lit("GCF_"), "doc_id").alias("accession"), lineage.alias("lineage"), organism.alias("organism"))
    return pipelines.genome_manifest(spark, path, rows).select("accession", "fna_url", "file_name")


@query("e15_lineage", """with l as (select doc_id, lang as domain, 'Ph' || n % 2 as phylum,
  case when doc_id % 3 = 0 then 'Gr' || n % 4 || 'ales' else 'Gr' || n % 4 end as third, case when doc_id % 5 = 0 then 'none' else 'Or' || n || 'ales' end as fourth,
  'Gen' || n as genus, 'sp' || doc_id as species from (select *, cast(substr(source, 4) as int) as n from documents)),
 m as (select doc_id, domain, phylum, case when third like '%ales' then phylum else third end as "group",
  case when fourth like '%ales' then fourth when third like '%ales' then third end as "order", genus, species from l)
 select *, concat_ws('_', domain, phylum, "group", "order", genus, species) || '.fna' as file_name from m where "order" is not null""")
def e15(spark, sf):
    n = _n()
    lineage = F.array(F.col("lang"), F.concat(F.lit("Ph"), n % 2),
                      F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Gr"), n % 4, F.lit("ales"))).otherwise(F.concat(F.lit("Gr"), n % 4)),
                      F.when(F.col("doc_id") % 5 == 0, F.lit("none")).otherwise(F.concat(F.lit("Or"), n, F.lit("ales"))))
    rows = docs(spark, sf).select("doc_id", lineage.alias("lineage"), F.concat(F.lit("Gen"), n, F.lit(" sp"), "doc_id").alias("organism"))
    return manifest.lineage_to_taxonomy(rows)


@query("e16_accession", "select doc_id, source || '_' || doc_id as accession, lang || '_' || doc_id % 5 as node from documents")
def e16(spark, sf):
    header = F.concat(F.lit(">"), "source", F.lit("_"), "doc_id", F.lit(".1 sequence of "), "lang")
    return docs(spark, sf).select("doc_id", fn.accession_of_header(header).alias("accession"), fn.node_key(F.col("lang"), F.col("doc_id") % 5).alias("node"))


@query("e19_count_map", f"with {sql_profile()} select doc_id, win_idx, count(*) as entries, sum(cnt)::bigint as total, sum(code * cnt)::bigint as weighted from profile group by all")
def e19(spark, sf):
    if own_ids(spark, sf):
        # A window's map is made where it is counted, and its sums are taken from the map.
        maps = in_rows(spark, sf, "plain", "cells array<struct<code:bigint,cnt:bigint>>", lambda b: kernel.listed(*kernel.profiled(b.wins, b.length, [1] * K), K))
        maps = maps.select(*KEYS, F.map_from_entries("cells").alias("counts"))
        sum_ = lambda f: F.aggregate(F.map_entries("counts"), F.lit(0).cast("long"), lambda a, e: a + f(e))
        return maps.select(*KEYS, F.size("counts").cast("long").alias("entries"), sum_(lambda e: e["value"]).alias("total"), sum_(lambda e: e["key"] * e["value"]).alias("weighted"))
    maps = profile.count_map(profile.with_codes(doc_profile(spark, sf)), KEYS)
    return profile.explode_map(maps, KEYS).groupBy(*KEYS).agg(
        F.count("*").alias("entries"), F.sum("cnt").alias("total"), F.sum(F.col("code") * F.col("cnt")).alias("weighted")
    )


@query("e20_vector", f"""with {sql_profile()}, {SQL_ENCODER} select doc_id, win_idx, sum(code_rank * cnt)::bigint as ranked, sum(cnt * cnt)::bigint as squares
 from profile join words using (code) group by all""")
def e20(spark, sf):
    if own_ids(spark, sf):
        def f(b):
            row, x = kernel.dense(*kernel.profiled(b.wins, b.length, [1] * K), K)
            return row, [x @ np.arange(4**K), (x * x).sum(axis=1)]

        return in_rows(spark, sf, "plain", "ranked bigint, squares bigint", f)
    vec = relational.vectors(profile.with_codes(doc_profile(spark, sf)), KEYS, K)
    total = lambda f: F.aggregate(F.transform("x", f), F.lit(0).cast("long"), lambda a, b: a + b)
    return vec.select(*KEYS, total(lambda x, i: x * i).alias("ranked"), total(lambda x, i: x * x).alias("squares"))


# ---- filters -----------------------------------------------------------------------------------------------------------
@query("f1_min_length", f"with {sql_dna()} select doc_id, length(seq) as len from dna where length(seq) >= {SIZE}")
def f1(spark, sf):
    return w.min_length_genomes(dna(spark, sf), SIZE).select("doc_id", F.length("seq").alias("len"))


@query("f2_rejected", f"with {sql_dna()} select doc_id, case when length(seq) < {SIZE} then 'REJECTED' end as status from dna")
def f2(spark, sf):
    return w.reject_short_reads(dna(spark, sf), SIZE).select("doc_id", "status")


@query("f3_homopolymer", f"with {sql_masked([1] * K)} select doc_id, win_idx, kmer, cnt from masked where kmer not in ({HOMO})")
def f3(spark, sf):
    if own_ids(spark, sf):
        return in_rows(spark, sf, "plain", "kmer string, cnt bigint", lambda b: word_counts(kernel.without_homopolymers(kernel.stranded(b.wins, b.length, K), K)))
    c = profile.count_kmers(w.kmers(dealt(spark, sf), K), KEYS)
    return profile.drop_homopolymers(profile.merge_strands(c, KEYS).select(*KEYS, "kmer", "cnt"), K)


# ---- counters ----------------------------------------------------------------------------------------------------------
@query("a1_count", f"with {sql_counts()} select doc_id, win_idx, kmer, cnt, first_pos from counted")
def a1(spark, sf):
    return profile.count_kmers(w.kmers(dealt(spark, sf), K), KEYS)


@query("a2_strands", f"with {sql_merged(K, 'iupac')} select doc_id, win_idx, kmer, cnt from merged")
def a2(spark, sf):
    if own_ids(spark, sf):
        return in_rows(spark, sf, "iupac", "kmer string, cnt bigint", lambda b: word_counts(kernel.stranded(b.wins, b.length, K)))
    c = profile.count_kmers(w.kmers(dealt(spark, sf, "iupac"), K), KEYS)
    return profile.merge_strands(c, KEYS).drop("ord")


def _a3(semantics):
    def run(spark, sf):
        if own_ids(spark, sf):
            both = lambda b: kernel.stranded(b.wins, b.length, len(MASK), semantics, semantics == "reference")
            return in_rows(spark, sf, "plain", "kmer string, cnt bigint", lambda b: word_counts(kernel.masked(both(b), MASK, semantics)))
        c = profile.count_kmers(w.kmers(dealt(spark, sf), len(MASK), semantics), KEYS)
        return profile.apply_pattern_counts(profile.merge_strands(c, KEYS, semantics), KEYS, MASK, semantics)

    return run


for _s in ("reference", "clean"):
    query(f"a3_pattern_{_s}", f"with {sql_masked(MASK, 'plain', MANY, _s)} select doc_id, win_idx, kmer, cnt from masked")(_a3(_s))


def _a5(spark, sf, *how):
    return in_rows(spark, sf, "iupac", "kmer string, cnt bigint, code bigint", lambda b: plain_counts(*kernel.profiled(b.wins, b.length, *how), True))


@query("a5_profile", f"with {sql_profile('iupac', MANY)} select doc_id, win_idx, kmer, cnt, code from profile")
def a5(spark, sf):
    if own_ids(spark, sf):
        return _a5(spark, sf, [1] * K)
    return profile.with_codes(doc_profile(spark, sf, "iupac", MANY))


@query("a5_profile_clean", f"with {sql_profile('iupac', MANY, MASK, 'clean')} select doc_id, win_idx, kmer, cnt, code from profile")
def a5_clean(spark, sf):
    if own_ids(spark, sf):
        return _a5(spark, sf, MASK, "clean")
    return profile.with_codes(doc_profile(spark, sf, "iupac", MANY, MASK, "clean"))


@query("u1_add_counters", f"with {sql_profile()} select kmer, (sum(cnt) * 2)::bigint as cnt from profile group by all")
def u1(spark, sf):
    c = doc_profile(spark, sf).groupBy("kmer").agg(F.sum("cnt").alias("cnt"))
    return profile.add_counters(c, c, ["kmer"])


# ---- taxonomy ----------------------------------------------------------------------------------------------------------
@query("a6_codes", f"with {SQL_CODES} select c.level, name, code, n.number_taxa from codes c join (select level, count(*) as number_taxa from codes group by all) n using (level)")
def a6(spark, sf):
    codes = taxonomy.taxa_codes(named(spark, sf))
    return codes.join(taxonomy.taxa_counts(codes), "level")


@query("a7_tree", f"with {SQL_TREE} select * from tree")
def a7(spark, sf):
    return taxonomy.taxa_tree(named(spark, sf))


@query("a11_nodes", f"with {SQL_TREE} select level_idx, level, name from tree where level_idx <= 4")
def a11(spark, sf):
    return taxonomy.nodes_per_level(taxonomy.taxa_tree(named(spark, sf)))


@query("j1_labels", f"with {SQL_CODES} select doc_id, family, code as label from named join codes on codes.level = 'family' and codes.name = named.family")
def j1(spark, sf):
    n = named(spark, sf)
    return taxonomy.label_rows(n, taxonomy.taxa_codes(n), "family").select("doc_id", "family", "label")


@query("f4_node_rows", f"with {SQL_NAMES} select doc_id, domain, phylum from named where domain = 'en'")
def f4(spark, sf):
    return models.node_training_rows(named(spark, sf), "domain", "en").select("doc_id", "domain", "phylum")


# ---- votes -------------------------------------------------------------------------------------------------------------
def _m4(func):
    return lambda spark, sf: consensus.consensus(probs(spark, sf), ["read_id"], func)


for _f in ("delta_mean", "min_max", "delta_sum"):
    query(f"m4_{_f}", f"with {sql_consensus(_f)} select read_id, win_idx, class, vote from voted")(_m4(_f))


@query("a8_votes", f"with {sql_consensus('delta_mean')} select read_id, vote, votes, (sum(votes) over (partition by read_id))::bigint as total from votes where counts")
def a8(spark, sf):
    votes = consensus.count_votes(consensus.consensus(probs(spark, sf), ["read_id"]), ["read_id"])
    return consensus.share_of_parent(votes, ["read_id"])


@query("a8_votes_clean", f"with {sql_consensus('delta_mean', 0.8, 'clean')} select read_id, vote, votes from votes")
def a8_clean(spark, sf):
    voted = consensus.consensus(probs(spark, sf), ["read_id"], semantics="clean")
    return consensus.count_votes(voted, ["read_id"], "clean")


@query("f6_keep", f"""with {sql_consensus('delta_mean')} select * from (select read_id, vote, votes, (sum(votes) over (partition by read_id))::bigint as total
 from votes where counts) where votes > 0.3::double * total""")
def f6(spark, sf):
    votes = consensus.count_votes(consensus.consensus(probs(spark, sf), ["read_id"]), ["read_id"])
    return consensus.keep_taxa(votes, ["read_id"], 0.3)


@query("q3_zero_class", f"with {sql_consensus('delta_sum', 0.2)} select read_id, vote, votes from votes where counts and vote = 0")
def q3(spark, sf):
    voted = consensus.consensus(probs(spark, sf), ["read_id"], "delta_sum", 0.2)
    return consensus.count_votes(voted, ["read_id"]).where("vote = 0")


@query("j4_decode_votes", f"""with {sql_consensus('delta_mean')}, {SQL_CODES} select read_id, name as child, votes from votes join codes on level = 'phylum' and code = vote where counts""")
def j4(spark, sf):
    votes = consensus.count_votes(consensus.consensus(probs(spark, sf), ["read_id"]), ["read_id"])
    return classify.decode_votes(votes, taxonomy.taxa_codes(named(spark, sf)), "phylum").select("read_id", "child", "votes")


# ---- models and pipelines ----------------------------------------------------------------------------------------------
def _votes(spark, sf):
    """Votes of the relational descent: windows are counted where their document stands, once for the weights and once for the votes."""
    if own_ids(spark, sf):
        source = kernel.Texts("plain", SIZE, MANY)
        rows = w.deal(named(spark, sf, "text"), "doc_id")
        weights = relational.node_weights(relational.leaf_sums_in_rows(rows, source, K), K).checkpoint(eager=True)
        if relational.small(weights):
            return relational.descend_in_rows(texts(spark, sf).withColumnRenamed("doc_id", "read_id"), source, weights, 0.6, K).checkpoint(eager=True)
    prof = profile.with_codes(doc_profile(spark, sf, deal=["doc_id"]))
    packed = relational.vectors(prof, KEYS, K).withColumnRenamed("doc_id", "read_id").persist()
    rows = packed.join(named(spark, sf).withColumnRenamed("doc_id", "read_id"), "read_id")
    weights = relational.node_weights(relational.leaf_sums(rows), K).checkpoint(eager=True)
    votes = relational.descend(packed, weights, 0.6)
    packed.unpersist()
    return votes


@query("m5_descent_relational", f"with {sql_descent(0.6)} select read_id, level_idx, parent, child, votes from descent")
def m5(spark, sf):
    return _votes(spark, sf)


def _model_rows(spark, sf):
    counts = profile.count_map(profile.with_codes(doc_profile(spark, sf, deal=["doc_id"])), KEYS)
    return stored(models.to_vector(counts.join(named(spark, sf), "doc_id"), K), "model-rows")


# ---- sources and sinks: derived rows written to the shared folder and read back -----------------------------------------
def _genome_files(spark, sf):
    """The derived sequences as FASTA files of two records, named by taxonomy; their folder."""
    rows = dna(spark, sf).join(genome_names(spark, sf), "doc_id").where("seq != ''")
    half = F.expr("int(length(seq) / 2)")
    body = lambda x: F.regexp_replace(x, "(.{70})(?=.)", "$1\n")
    content = F.concat(F.lit(">a first\n"), body(F.lower(F.substring("seq", F.lit(1), half))), F.lit("\n>b second\n"), body(F.substring("seq", half + 1, F.length("seq"))), F.lit("\n"))
    folder = shared_path(spark, "genomes")
    fasta.write_fasta(rows.select(F.substring_index("path", "/", -1).alias("file"), content.alias("content")), folder).collect()
    return folder


def _read_files(spark, sf):
    """The derived sequences as FASTA files of reads, every tenth with an earlier record of its id; their folder."""
    rows = dna(spark, sf).select(F.concat(F.lit("r"), "doc_id", F.lit(" of documents")).alias("read_id"), "seq", "doc_id")
    again = F.concat(F.lit("AC\n>"), F.col("read_id"), F.lit("\n"), F.col("seq"))
    folder = shared_path(spark, "reads")
    fasta.write_reads(rows.withColumn("seq", F.when(F.col("doc_id") % 10 == 0, again).otherwise(F.col("seq"))), folder)
    return folder


SQL_FILES = f"""{SQL_NAMES}, {sql_dna()}, files as (select doc_id, concat_ws('_', domain, phylum, "group", "order", family, 'sp' || doc_id) || '.fna' as file, seq
 from named join dna using (doc_id) where seq <> '')"""


@query("s1_genomes", f"with {SQL_FILES} select file, row_number() over (order by file) - 1 as file_ord, length(seq)::int as len, md5(seq) as sum from files")
def s1(spark, sf):
    got = fasta.read_genomes(spark, _genome_files(spark, sf))
    return got.select(F.substring_index("path", "/", -1).alias("file"), "file_ord", F.length("seq").alias("len"), F.md5("seq").alias("sum"))


@query("s2_reads", f"with {sql_dna()} select 'r' || doc_id as read_id, length(seq)::int as len, md5(seq) as sum from dna")
def s2(spark, sf):
    got = fasta.read_reads(spark, _read_files(spark, sf))
    return got.select("read_id", F.length("seq").alias("len"), F.md5("seq").alias("sum"))


@query("k1_features", f"""with {sql_profile()}, {SQL_NAMES} select domain, family, win_idx, count(*) as entries, sum(cnt)::bigint as total, sum(code * cnt)::bigint as weighted
 from profile join named using (doc_id) group by all""")
def k1(spark, sf):
    counts = profile.count_map(profile.with_codes(doc_profile(spark, sf)), KEYS).join(named(spark, sf), "doc_id")
    db = shared_path(spark, "features")
    tables.write_features(counts, db)
    rows = profile.explode_map(tables.read_features(spark, db), ["domain", "family", "win_idx"])
    return rows.groupBy("domain", "family", "win_idx").agg(F.count("*").alias("entries"), F.sum("cnt").alias("total"), F.sum(F.col("code") * F.col("cnt")).alias("weighted"))


@query("k2_libsvm", f"""with {sql_profile()}, {SQL_CODES}, {SQL_ENCODER}, l as (select doc_id, code as label from named join codes on level = 'family' and name = family)
 select label, count(distinct (doc_id, win_idx)) as n, sum(cnt)::bigint as total, sum(code_rank * cnt)::bigint as ranked from profile join words using (code) join l using (doc_id) group by all""")
def k2(spark, sf):
    names = named(spark, sf)
    rows = taxonomy.label_rows(_model_rows(spark, sf), taxonomy.taxa_codes(names), "family")
    path = shared_path(spark, "libsvm")
    tables.write_libsvm(rows, path)
    x = tables.read_libsvm(spark, path, 4**K).select(F.col("label").cast("int").alias("label"), vector_to_array("features").alias("x"))
    total = lambda f: F.aggregate(F.transform("x", f), F.lit(0.0), lambda a, b: a + b).cast("long")
    return x.groupBy("label").agg(F.count("*").alias("n"), F.sum(total(lambda v: v)).alias("total"), F.sum(total(lambda v, i: v * i)).alias("ranked"))


@query("k3_report", f"""with {sql_descent(0.6)} select 'r' || read_id as read_id, 'OK' as status, level_idx, parent, child, votes::bigint as votes from descent
 union all select 'r' || doc_id, 'REJECTED', null, null, null, null from dna where length(seq) < {SIZE}""")
def k3(spark, sf):
    path = shared_path(spark, "report")
    tables.write_report(_report(spark, sf), path)
    rows = tables.read_report(spark, path)
    name = F.concat(F.lit("r"), "read_id").alias("read_id")
    found = report.report_rows(rows).select(name, F.lit("OK").alias("status"), "level_idx", F.col("source").alias("parent"), F.col("target").alias("child"), F.col("value").alias("votes"))
    return found.unionByName(rows.where("status is not null").select(name, "status"), allowMissingColumns=True)


@query("k5_taxon_counts", f"with {SQL_FLOWS} select * from totals")
def k5(spark, sf):
    path = shared_path(spark, "taxon-counts")
    tables.write_taxon_counts(report.taxon_totals(*_flows(spark, sf)), path)
    return spark.read.schema("depth int, node string, value long").json(path)


@query("s6_manifest", f"with {SQL_MANIFEST} select row_number() over (order by i) - 1 as i, line from lines")
def s6(spark, sf):
    path = shared_path(spark, "manifest")
    tables.write_manifest(_lines(spark, sf), path)
    return tables.read_manifest(spark, path)


# ---- parameters -------------------------------------------------------------------------------------------------------
@query("p0_params", """with sets as (select doc_id, (n_chars % 12)::int as read_size, (doc_id % 5 + 1)::int as ksize, (doc_id % 7 - 1)::int as sampling,
  list_transform(range(doc_id % 6 + 1), lambda i: case when doc_id % 11 = 0 and i = 1 then 2 else ((doc_id // (2 ** i)::bigint) % 2)::int end) as pattern from documents)
 select *, list_sum(pattern) = ksize and len(list_filter(pattern, lambda x: x not in (0, 1))) = 0 and sampling > 0 and read_size >= len(pattern) + 2 as ok from sets""")
def p0(spark, sf):
    """Parameter sets of the documents' numbers, and whether the guard takes them."""
    bit = lambda i: F.when((F.col("doc_id") % 11 == 0) & (i == 1), 2).otherwise(F.floor(F.col("doc_id") / F.pow(F.lit(2), i)) % 2).cast("int")
    sets = docs(spark, sf).select(
        "doc_id", (F.col("n_chars") % 12).cast("int").alias("read_size"), (F.col("doc_id") % 5 + 1).cast("int").alias("ksize"),
        (F.col("doc_id") % 7 - 1).cast("int").alias("sampling"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 6), bit).alias("pattern"),
    )
    return sets.withColumn("ok", accepted(*(F.col(c) for c in ("read_size", "ksize", "pattern", "sampling"))))


# ---- commands ----------------------------------------------------------------------------------------------------------
PARAMS = Params(read_size=SIZE, ksize=K, sampling=MANY, semantics="clean")
#: Databases built in this process, by session and input.
_BUILT: dict[tuple[str, str], str] = {}


def _database(spark, sf):
    """The path of a database built from the FASTA files by the build command, at its own rounds and depth.

    The queries below share one for each session and input; the first of them builds it.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUILT:
        db = shared_path(spark, "database")
        pipelines.build(spark, _genome_files(spark, sf), db, PARAMS)
        _BUILT[key] = db
    return _BUILT[key]


SQL_BUILT = f"""{SQL_FILES}, used as (select n.*, f.file from named n join files f using (doc_id) where length(seq) >= {SIZE}),
 pairs as (select 'root' as level, 'Root' as name, domain as child from used union all select 'domain', domain, phylum from used union all select 'phylum', phylum, "group" from used
  union all select 'group', "group", "order" from used union all select 'order', "order", family from used),
 kids as (select distinct level, name, child from pairs),
 nodes as (select level, name, count(*) as kids, min(child) as child from kids group by all)"""


@query("p1_build", f"""with {SQL_BUILT}, leaves as (select distinct 'family' as level, family as name from used)
 select level, name, kids > 1 as trained, case when kids = 1 then child end as only_child from nodes union all select level, name, false, null from leaves""")
def p1(spark, sf):
    registry = spark.read.parquet(f"{_database(spark, sf)}/registry")
    return registry.select("level", "name", F.col("model_path").isNotNull().alias("trained"), "only_child")


@query("m1_fit", f"""with {SQL_BUILT} select k.level, k.name, k.child, 10 as trees, true as grown, true as shallow
 from kids k join nodes n on n.level = k.level and n.name = k.name where n.kids > 1""")
def m1(spark, sf):
    """Every inner node's ensembles: one for each of its children and no other, their number of trees, whether any has split, and
    whether all keep within the depth."""
    db = _database(spark, sf)
    trees = ensembles.read_trees(spark, db).groupBy("level", "name", "class").agg(
        F.count_distinct("tree").cast("int").alias("trees"), (F.max("feature") >= 0).alias("grown"),
        (F.max("node") < 2**11).alias("shallow"),
    )
    kids = spark.read.parquet(f"{db}/labels").where(F.size("kids") > 1).select("level", "name", F.posexplode("kids").alias("class", "child"))
    return kids.join(trees, ["level", "name", "class"], "full").select("level", "name", "child", "trees", "grown", "shallow")


#: Shares of windows, of the genomes that a model has learnt, that go to their own child, and of reads to their own domain.
RIGHT = 0.8


@query("m3_predict", f"""with {SQL_BUILT} select level, name, count(*) * {MANY} as windows, true as one, true as own, true as right from pairs group by all""")
def m3(spark, sf):
    """Every window by the model of each of its own nodes: the number of windows, whether probabilities add up to 1 and belong to
    the node's children, and whether the highest is the own child's for a share of RIGHT at least."""
    db = _database(spark, sf)
    taxa, codes = tables.read_taxa(spark, db)
    rows = models.to_vector(tables.read_features(spark, db), K).withColumn("x", vector_to_array("features"))
    table, labels = spark.read.parquet(f"{db}/ensembles"), spark.read.parquet(f"{db}/labels")
    out = []
    for level, child in zip(fn.ALL_LEVELS, fn.LEVELS, strict=False):
        met = rows.withColumn("parent", F.lit("Root") if level == "root" else F.col(level)).withColumnRenamed(child, "child")
        met = met.select("path", "win_idx", "parent", "child", "x").join(ensembles.level_ensembles(table, level), "parent")
        p = ensembles.probabilities(met, ["path", "win_idx", "parent", "child"], 10)
        p = p.join(codes.where(F.col("level") == child).select(F.col("name").alias("child"), F.col("code").alias("label")), "child")
        p = p.join(labels.where(F.col("level") == level).select(F.col("name").alias("parent"), F.col("codes").alias("known")), "parent")
        total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
        out.append(p.groupBy(F.lit(level).alias("level"), F.col("parent").alias("name")).agg(
            F.count("*").alias("windows"), F.bool_and(F.abs(total - 1) < 1e-9).alias("one"), F.bool_and(F.col("codes") == F.col("known")).alias("own"),
            (F.avg((F.get("codes", argmax(F.col("p"))) == F.col("label")).cast("double")) >= RIGHT).alias("right"),
        ))
    return reduce(DataFrame.unionByName, out)


@query("p2_predict", f"""with {sql_dna()} select 'r' || d.doc_id as read_id, case when length(seq) < {SIZE} then 'REJECTED' end as status,
 length(seq) >= {SIZE} as voted, true as within, true as descends, case when length(seq) >= {SIZE} then true end as right from dna d""")
def p2(spark, sf):
    """Reads by the predict command: status, whether the root has votes, that votes are at most the windows, that only
    children that had votes are parents below, and whether of the reads of its language a share of RIGHT at least has most votes for it."""
    rows = pipelines.predict(spark, _database(spark, sf), _read_files(spark, sf), shared_path(spark, "report"), PARAMS)
    level = lambda i: F.element_at("levels", i + 1)
    votes = lambda m: F.flatten(F.transform(F.map_values(m), lambda v: F.map_values(v)))
    names = lambda m: F.flatten(F.transform(F.map_values(m), lambda v: F.map_keys(v)))
    below = lambda a, b: F.size(F.array_except(F.map_keys(b), names(a))) == 0
    most = [F.forall(F.transform(F.map_values(level(i)), lambda v: F.aggregate(F.map_values(v), F.lit(0).cast("long"), lambda a, x: a + x)), lambda n: n <= MANY) for i in range(5)]
    ok = lambda c: F.coalesce(c, F.lit(True))
    top = F.array_max(F.transform(F.map_entries(F.element_at(level(0), "Root")), lambda e: F.struct(e["value"].alias("n"), e["key"].alias("k"))))["k"]
    langs = docs(spark, sf).select(F.concat(F.lit("r"), "doc_id").alias("read_id"), "lang")
    rows = rows.join(langs, "read_id").withColumn("hit", F.when(F.col("status").isNull(), (top == F.col("lang")).cast("double")))
    share = rows.groupBy("lang").agg((F.avg("hit") >= RIGHT).alias("good"))
    return rows.join(share, "lang").select(
        "read_id", "status", F.coalesce(F.size(votes(level(0))) > 0, F.lit(False)).alias("voted"),
        ok(reduce(lambda a, b: a & b, most)).alias("within"), ok(reduce(lambda a, b: a & b, (below(level(i), level(i + 1)) for i in range(4)))).alias("descends"),
        F.when(F.col("status").isNull(), F.col("good")).alias("right"),
    )


def _reads(spark, sf):
    """Reads with their status: few bytes each, kept so that their texts are gone through once."""
    reads = w.reject_short_reads(dna(spark, sf), SIZE)
    return reads.select(F.lit("documents").alias("file"), F.col("doc_id").alias("read_id"), "status").checkpoint(eager=True)


def _report(spark, sf, reads=None):
    votes = _votes(spark, sf).withColumn("file", F.lit("documents"))
    return classify.report_levels(votes, _reads(spark, sf) if reads is None else reads)


def _flows(spark, sf, show_rejected=True):
    reads, taxa = _reads(spark, sf), taxonomy.taxa_tree(named(spark, sf))
    return report.flows(report.report_rows(_report(spark, sf, reads)), reads, taxa, cutoff=2, reads_per_sample=MANY, show_rejected=show_rejected), taxa


@query("p3_flows", f"with {SQL_FLOWS} select *, value / {MANY}.0::double * 100 as percent from flow")
def p3(spark, sf):
    return _flows(spark, sf)[0]


@query("p3_flows_accepted", f"with {SQL_FLOWS} select *, value / {MANY}.0::double * 100 as percent from flow where target <> 'REJECTED'")
def p3_accepted(spark, sf):
    return _flows(spark, sf, show_rejected=False)[0]


@query("a10_totals", f"with {SQL_FLOWS} select * from totals")
def a10(spark, sf):
    return report.taxon_totals(*_flows(spark, sf))


@query("j5_endpoints", f"""with {SQL_FLOWS} select read_id, f.level_idx, source, target, value, s.node_id as source_id, t.node_id as target_id from flow f
 left join tree s on s.name = f.source and s.level_idx = f.level_idx left join tree t on t.name = f.target and t.level_idx = f.level_idx + 1""")
def j5(spark, sf):
    flow, taxa = _flows(spark, sf)
    return report.flow_endpoints(flow.drop("percent"), taxa)


@query("j6_hierarchy", f"""with {SQL_FLOWS}, every as (select name as node, level_idx as depth, parent from tree where level_idx > 0 union all select 'REJECTED', 0, 'Root')
 select e.node, e.depth, e.parent, coalesce(t.value, 0)::bigint as value from every e left join totals t using (node, depth)""")
def j6(spark, sf):
    flow, taxa = _flows(spark, sf)
    return report.hierarchy_totals(taxa, report.taxon_totals(flow, taxa))

