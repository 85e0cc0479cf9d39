"""Operator 7: URL rules, and a path-template tree with smoothed labelled purity for what no rule decides.

Tree.  Per host, a path is its segments.  A segment is variable if it is mostly digits (ids, dates, hashes), or if at its place under its
parent the host has more than BRANCHES distinct values, none of which holds more than a SHARE of the parent's urls; variable
segments become `*`.  Segments are generalised from the root down, each level one aggregate, until no path goes on or all
that go on are at parents of at most BRANCHES paths, below which nothing can vary.

Merging.  Siblings are templates of a host that differ in one fixed segment, whichever it is.  In the order of their smoothed
purities each is held against the branch before it, with the branch's mean purity; they are alike if the difference lies within
MERGE_Z standard errors of the two, and then it belongs to that branch, else it begins one.  A branch of several siblings becomes one template with `*` at that place, `*2`, `*3` and so on for
further branches there.  A template goes with the place where the purities of its branch spread least, of these with the largest
branch, the last where equal.  Merged
templates are merged again until no two are alike.  Purities that are equal to PLACES decimals are one step of that order, so a
family of any number of siblings is at most 10^PLACES + 1 rows.

Purity.  Labels are 1 (block) or 0 (allow).  A template's purity is smoothed towards its host's, that towards the same
path template over all hosts, and that towards the overall share, each with PRIOR pseudo-labels.  A url is blocked if its template's purity is at least CUT.
Without labels of any kind all is allowed.

Everything is DataFrame functions.  Counts are aggregated per host, template and label before any join, so a hot host is
a few rows.  Null or malformed urls have empty host and path, and are judged by the empty template.  Equal urls are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_side, stored

#: Rules of the contract: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BRANCHES = 20
SHARE = 0.2
MERGE_Z = 1.0
PLACES = 3
PRIOR = 1.0
CUT = 0.5


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as `host + path`, and its verdict; null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in reversed(ordered):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _numeric(segment: Column) -> Column:
    """At least half of the segment, without its file extension, is digits."""
    stem = F.regexp_replace(segment, r"(?<=.)\.[A-Za-z]{1,5}$", "")
    return F.length(F.regexp_replace(stem, "[^0-9]", "")) * 2 >= F.length(stem)


def templates(urls: DataFrame) -> DataFrame:
    """urls(host, path, n, blocked, labelled), one row per host and path -> the same with template, an array of segments."""
    tree = urls.withColumn("__s", F.transform(_segments(F.col("path")), lambda s: F.when(_numeric(s), F.lit("*")).otherwise(s)))
    # One row per host and segments: what varies is found on these counts, from the root down.
    live = tree.groupBy("host", "__s").agg(F.sum("n").alias("n")).withColumn("__g", F.array().cast("array<string>"))
    live, done, i = stored(live, "paths"), [], 0
    while True:
        on = live.where(F.size("__s") > i)
        # First per value, then per parent: a parent of very many values is summed in parts.
        per_value = on.groupBy("host", "__g", F.get("__s", F.lit(i)).alias("__v")).agg(F.sum("n").alias("vn"), F.count("*").alias("paths"))
        per_parent = per_value.groupBy("host", "__g").agg(
            F.count("*").alias("kinds"), F.sum("vn").alias("all"), F.max("vn").alias("top"), F.sum("paths").alias("paths")
        )
        varies = (F.col("kinds") > BRANCHES) & (F.col("top") <= SHARE * F.col("all"))
        wide = per_parent.where(F.col("paths") > BRANCHES).select(F.col("host").alias("__h"), F.col("__g").alias("__p"), varies.alias("__varies"))
        wide = small_side(stored(wide, "wide-parents"), 64 * (i + 2))
        rows = live.join(wide, (live["host"] == wide["__h"]) & (live["__g"] == wide["__p"]), "left").drop("__h", "__p")
        going = F.col("__varies").isNotNull() & (F.size("__s") > i)
        step = F.concat("__g", F.array(F.when(F.col("__varies"), F.lit("*")).otherwise(F.get("__s", F.lit(i)))))
        rest = F.concat("__g", F.slice("__s", i + 1, F.greatest(F.size("__s"), F.lit(1))))
        rows = stored(rows.select("host", "__s", "n", going.alias("__going"), F.when(going, step).otherwise(rest).alias("__g")), "path-level")
        done.append(rows.where(~F.col("__going")))
        live = rows.where("__going").drop("__going")
        i += 1
        if live.isEmpty():
            break
    learned = reduce(DataFrame.unionByName, done).select(F.col("host").alias("__host"), F.col("__s").alias("__k"), F.col("__g").alias("template"))
    out = tree.join(learned, (tree["host"] == learned["__host"]) & (tree["__s"] == learned["__k"]))
    return out.select(*urls.columns, "template")


def _smooth(blocked: Column, labelled: Column, prior: Column) -> Column:
    return (blocked + PRIOR * prior) / (labelled + PRIOR)


def purities(found: DataFrame) -> DataFrame:
    """Rows of templates() -> stored table (host, template, merged, purity): merged is the template after merging."""
    leaf = found.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("n", "blocked", "labelled")))
    leaf = stored(leaf, "template-counts")
    total = leaf.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).first()
    overall = (total["b"] or 0) / total["l"] if total["l"] else 0.0
    by_path = leaf.groupBy("template").agg(F.sum("blocked").alias("pb"), F.sum("labelled").alias("pl"))
    by_host = leaf.groupBy("host").agg(F.sum("blocked").alias("hb"), F.sum("labelled").alias("hl"))
    path_p = _smooth(F.col("pb"), F.col("pl"), F.lit(overall))
    host_p = F.when(F.col("hl") > 0, _smooth(F.col("hb"), F.col("hl"), path_p)).otherwise(path_p)
    rated = leaf.join(by_path, "template").join(by_host, "host")
    rated = rated.withColumn("prior", host_p).withColumn("purity", _smooth(F.col("blocked"), F.col("labelled"), F.col("prior")))
    now = stored(rated.select("host", "template", "blocked", "labelled", "prior", "purity"), "rated")
    names = now.select("host", "template", F.col("template").alias("merged"))
    while True:
        pick = _branches(now)
        if pick.isEmpty():
            break
        to = pick.select(F.col("host").alias("__h"), F.col("template").alias("__t"), "general")
        renamed = lambda df, c: df.join(to, (df["host"] == to["__h"]) & (df[c] == to["__t"]), "left")
        names = stored(renamed(names, "merged").select("host", "template", F.coalesce("general", "merged").alias("merged")), "template-names")
        joined = renamed(now, "template").withColumn("template", F.coalesce("general", "template"))
        now = joined.groupBy("host", "template").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"), F.max("prior").alias("prior"))
        now = stored(now.withColumn("purity", _smooth(F.col("blocked"), F.col("labelled"), F.col("prior"))), "merged")
    got = now.select("host", F.col("template").alias("merged"), "purity")
    return stored(names.join(got, ["host", "merged"]).select("host", "template", "merged", "purity"), "purities")


def _branches(rated: DataFrame) -> DataFrame:
    """rated(host, template, blocked, labelled, prior, purity) -> stored (host, template, general) of templates that are merged."""
    places = rated.select("*", F.posexplode("template").alias("at", "segment")).where("segment not like '*%'").drop("segment")
    places = places.withColumn("family", F.transform("template", lambda s, i: F.when(i == F.col("at"), F.lit("*")).otherwise(s)))
    places = places.withColumn("step", F.round("purity", PLACES))
    family = ["host", "at", "family"]
    steps = places.groupBy(*family, "step").agg(F.count("*").alias("kin"), F.sum("labelled").alias("l"))
    # At most 10^PLACES + 1 steps of a family are folded into branches in their order.
    def fold(acc: Column, x: Column) -> Column:
        weight = x["l"] + PRIOR
        mean = acc["sum"] / acc["weight"]
        middle = (x["step"] + mean) / 2
        near = F.coalesce(x["step"] - mean <= MERGE_Z * F.sqrt(middle * (1 - middle) * (1 / weight + 1 / acc["weight"])), F.lit(False))
        branch = acc["branch"] + F.when(near, 0).otherwise(1)
        kept = lambda c: F.when(near, acc[c]).otherwise(0.0)
        row = F.struct(x["step"].alias("step"), x["kin"].alias("kin"), branch.alias("branch"))
        return F.struct(
            branch.alias("branch"), (kept("sum") + x["step"] * weight).alias("sum"), (kept("weight") + weight).alias("weight"),
            F.concat(acc["rows"], F.array(row)).alias("rows"),
        )

    none = F.struct(
        F.lit(0).alias("branch"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("weight"),
        F.array().cast("array<struct<step:double,kin:bigint,branch:int>>").alias("rows"),
    )
    steps = steps.groupBy(*family).agg(F.sort_array(F.collect_list(F.struct("step", "kin", "l"))).alias("s")).where("size(s) > 1 or s[0].kin > 1")
    steps = steps.select(*family, F.inline(F.aggregate("s", none, fold, lambda acc: acc["rows"])))
    mine = Window.partitionBy(*family, "branch")
    spread = F.round(F.max("step").over(mine) - F.min("step").over(mine), PLACES)
    steps = steps.withColumn("allies", F.sum("kin").over(mine)).withColumn("spread", spread).where("allies > 1")
    alike = places.join(steps.select(*family, "step", "branch", "allies", "spread"), [*family, "step"])
    mark = F.when(F.col("branch") == 1, F.lit("*")).otherwise(F.concat(F.lit("*"), F.col("branch").cast("string")))
    general = F.transform("family", lambda s, i: F.when(i == F.col("at"), mark).otherwise(s))
    best = alike.groupBy("host", "template").agg(F.max(F.struct((-F.col("spread")).alias("s"), "allies", "at", general.alias("general"))).alias("b"))
    # A branch of which all but one went elsewhere is no merge.
    best = stored(best.select("host", "template", "b.general"), "branches")
    real = best.groupBy("host", "general").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return stored(best.join(real, ["host", "general"], "left_semi").select("host", "template", "general"), "branch-picks")


def judge_urls(pages: DataFrame, labels: DataFrame | None = None, rules=RULES) -> DataFrame:
    """pages(page_id, url) with host, path, rule, template, purity and verdict (block or allow).

    labels(page_id, label): 1 for block, 0 for allow; without it, pages that a rule decides are the labelled ones.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("__verdict", verdict)
    if labels is None:
        rows = rows.withColumn("__label", F.when(F.col("__verdict").isNotNull(), (F.col("__verdict") == "block").cast("int")))
    else:
        known = labels.groupBy(F.col("page_id").alias("__page")).agg(F.max("label").cast("int").alias("__label"))
        rows = rows.join(known, rows["page_id"] == known["__page"], "left").drop("__page")
    rows = stored(rows, "urls")
    urls = rows.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("__label"), F.lit(0)).alias("blocked"), F.count("__label").alias("labelled")
    )
    found = stored(templates(urls), "url-templates")
    rated = purities(found)
    by_path = found.join(rated, ["host", "template"]).select(
        F.col("host").alias("__h"), F.col("path").alias("__p"), "merged", "purity"
    )
    out = rows.join(by_path, (rows["host"] == by_path["__h"]) & (rows["path"] == by_path["__p"]))
    learned = F.when(F.col("purity") >= CUT, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("__verdict", learned).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("merged", "/")).alias("template"), F.round("purity", 9).alias("purity"),
    )


def op7_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
