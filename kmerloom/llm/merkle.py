"""Operator 12: a Merkle manifest of a dataset, with a proof for every row.

A row's leaf is the SHA-256 (lowercase hex) of its fields, each `-` if null, else its number of UTF-8 bytes, `:` and its value as
text.  In each group the leaves stand in ascending order of the id; while several nodes are left, every FAN of them in a row (the last
run may be shorter, even one) become the digest of their digests in a row.  What is left is the group's subroot; the subroots, by
group, likewise give the root.

* Only ids, groups and digests are dealt, never texts.  A node's rank in its group is its place in a table sorted by range plus
  the counts of the ranges before.
* A rank's digits to the base FAN are its path.  In blocks of FAN^LEVELS nodes, dealt once, the digits are grouped away one after
  another, and every node holds its children as nested structs.  A block is one row of bounded size; its digest is a node of the next
  tier of blocks, so tiers are few and all alike.
* A block's row is opened from the top: transform gives every child what stands left and right of it, explode makes it a row,
  until the leaves are there with their whole paths; nothing is joined inside a block.  From tier to tier a block gets its own path,
  one row a block.

Nulls: a null group is a group of its own and the first; null ids come first.  Rows with equal ids stand in the order of their leaves;
equal rows are leaves of their own.  A lone leaf is its group's subroot, and a lone subroot the root; its path is empty.
An empty table gives no rows.  Texts of any length are hashed whole.  Columns that aren't named aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, ranked, small_side, stored

FAN = 8
#: Levels of a block: 512 leaves, about 100 kB.
LEVELS = 3
BLOCK = FAN**LEVELS


def field(value: Column) -> Column:
    """A field as it goes into a leaf."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest_of(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def several(level: int) -> Column:
    """Whether a key still has several nodes before this level of a tier, of whose nodes it has n."""
    return F.col("n") > FAN ** (level - 1)


def rolled(nodes: DataFrame) -> DataFrame:
    """nodes(key, rank, n, digest, item) -> key, block, n, digest, kids: one row per block, children nested in it."""
    digits = [F.expr(f"cast(rank div {FAN**i} % {FAN} as int)").alias(f"d{i}") for i in range(LEVELS)]
    rows = nodes.select("key", F.expr(f"rank div {BLOCK}").alias("block"), "n", *digits, "digest", F.col("item").alias("kids")).repartition("key", "block")
    for level in range(1, LEVELS + 1):
        above = [f"d{i}" for i in range(level, LEVELS)]
        kid = F.struct(F.col(f"d{level - 1}").alias("digit"), "digest", "kids")
        rows = rows.groupBy("key", "block", "n", *above).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        joined = F.array_join(F.transform("kids", lambda k: k["digest"]), "")
        rows = rows.withColumn("digest", F.when(several(level), F.sha2(joined, 256)).otherwise(F.get("kids", 0)["digest"]))
    return rows


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """Tables of blocks: the first one's leaves are the nodes, each further one's are the blocks before, until a key has one block."""
    out = []
    while True:
        blocks = stored(rolled(nodes), "merkle-blocks")
        out.append(blocks)
        if not (blocks.agg(F.max("block")).first()[0] or 0):
            return out
        n = F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n")
        nodes = blocks.select("key", F.col("block").alias("rank"), n, "digest", F.col("block").alias("item"))


def _beside(kid: Column, at: Column) -> Column:
    """A child with its siblings' digests, those before it and those behind it."""
    digests = F.transform("kids", lambda k: k["digest"])
    left, right = F.slice(digests, F.lit(1), at), F.slice(digests, at + 2, F.lit(FAN))
    return F.struct(kid["digest"].alias("digest"), kid["kids"].alias("kids"), F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def opened(blocks: DataFrame, others: list[str]) -> DataFrame:
    """blocks(key, block, n, kids, path, others) -> key, n, digest, item, path, others: a row per node, steps from the node upwards."""
    rows = blocks.select("key", "n", "kids", "path", *others)
    for level in range(LEVELS, 0, -1):
        rows = rows.select("key", "n", "path", *others, F.explode(F.transform("kids", _beside)).alias("k"))
        step = F.array(F.struct(F.col("k.left").alias("left"), F.col("k.right").alias("right")))
        rows = rows.select("key", "n", F.when(several(level), F.concat(step, "path")).otherwise(F.col("path")).alias("path"), *others, "k.digest", "k.kids")
    return rows.withColumnRenamed("kids", "item")


def descended(tables: list[DataFrame], top: DataFrame, others: list[str]) -> DataFrame:
    """Nodes of the first tier with their paths. top(key, path, others): a row per key."""
    rows = top.withColumn("block", F.lit(0).cast("long"))
    for i, blocks in enumerate(reversed(tables), 1):
        size = F.octet_length("key") + 200 + F.aggregate("path", F.lit(0), lambda a, s: a + F.octet_length(s["left"]) + F.octet_length(s["right"]) + 32)
        above = small_side(stored(rows.select("key", "block", "path", *others), "merkle-paths"), size)
        rows = opened(blocks.join(above, ["key", "block"]), others)
        if i < len(tables):
            rows = rows.withColumnRenamed("item", "block")
    return rows


def manifest(docs: DataFrame, columns: list[str], id: str, group: str, carried: dict[str, Column] | None = None) -> DataFrame:
    """id, carried columns, leaf, subroot, root, path: every row's place in the tree of its dataset.

    path: array of (left, right), digests in a row beside the node, level by level up to the root.
    """
    carried = carried or {}
    own = F.col(quoted(group))
    leaves = docs.select(
        # A null group is first and can't meet a value.
        F.when(own.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), own.cast("string"))).alias("key"),
        F.col(quoted(id)).alias("id"), digest_of(*(F.col(quoted(c)) for c in columns)).alias("digest"),
        F.struct(F.col(quoted(id)).alias("id"), *(c.alias(name) for name, c in carried.items())).alias("item"), F.monotonically_increasing_id().alias("tie"),
    )
    leaves = stored(leaves, "merkle-leaves")  # texts are read and hashed once
    low = tiers(ranked(leaves, ["id", "digest"]))
    # A key's row of the last tier holds its subroot.
    subroots = low[-1].select(F.lit("").alias("key"), F.col("key").alias("item"), "digest", F.lit(0).alias("tie"))
    high = tiers(ranked(stored(subroots, "merkle-subroots"), ["item"]))
    path = F.array().cast("array<struct<left:string,right:string>>").alias("path")
    groups = descended(high, high[-1].select("key", path, F.col("digest").alias("root")), ["root"])
    top = groups.select(F.col("item").alias("key"), "path", "root", F.col("digest").alias("subroot"))
    rows = descended(low, top, ["root", "subroot"])
    return rows.select("item.*", F.col("digest").alias("leaf"), "subroot", "root", "path")


def proof_digests(path: Column) -> Column:
    """The path's digests in a row, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest comes to along a path."""
    return F.aggregate(path, leaf, lambda a, s: F.sha2(F.concat(s["left"], a, s["right"]), 256))


#: Columns of a row of documents, in the order in which a leaf holds them.
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    picked = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    tampered = F.when(picked, digest_of(*(F.col(c) for c in COLUMNS[:-1]), F.translate("text", UPPER, LOWERED)))
    rows = manifest(docs, COLUMNS, "doc_id", "lang", {"tampered": tampered})
    rows = rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return rows.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(proof_digests(F.col("path")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


# ---- SQL ---------------------------------------------------------------------------------------------------------------
#: Levels that the SQL is written out for: 8^9 rows of a group, 8^3 groups.
SQL_LEVELS, SQL_GROUP_LEVELS = 9, 3


def _sql_tree(name: str, base: str, levels: int) -> str:
    """CTEs {name}0 (k, r, n, d) .. and {name}s0 ..: each node's left and right digests in its run."""
    out = [f"{name}0 as materialized ({base})"]
    for i in range(levels):
        at = f"{name}{i}"
        frame = "partition by k, r // 8 order by r rows between"
        out.append(f"""{name}s{i} as (select k, r, n, coalesce(string_agg(d, '') over ({frame} unbounded preceding and 1 preceding), '') as lft,
 coalesce(string_agg(d, '') over ({frame} 1 following and unbounded following), '') as rgt from {at})""")
        out.append(f"""{name}{i + 1} as materialized (select k, r // 8 as r, (n + 7) // 8 as n, case when n > 1 then sha256(string_agg(d, '' order by r)) else min(d) end as d
 from {at} group by k, r // 8, n)""")
    return ",\n ".join(out)


def _sql() -> str:
    def one(c):
        return f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end"

    fields = " || ".join(map(one, COLUMNS))
    lower = " || ".join([*map(one, COLUMNS[:-1]), one(f"translate(text, '{UPPER}', '{LOWERED}')")])
    bit = "xor(c >> 1, case when c & 1 = 1 then 3988292384::bigint else 0::bigint end)"
    byte = f"list_reduce(list_prepend(xor(a, b), [x::bigint for x in range(8)]), lambda c, z: {bit})"
    chars = "[ascii(x)::bigint for x in string_split(coalesce(doc_id::varchar, ''), '') if x <> '']"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, {chars}), lambda a, b: {byte}), 4294967295::bigint)"
    steps = [("t", i) for i in range(SQL_LEVELS)] + [("g", i) for i in range(SQL_GROUP_LEVELS)]
    joins, proof, fold = "", [], "coalesce(bad, leaf)"
    for name, i in steps:
        k, r = ("l.k", "l.r") if name == "t" else ("0", "h.r")
        joins += f"\n join {name}s{i} {name}{i}x on {name}{i}x.k = {k} and {name}{i}x.r = {r} // {8**i}"
        proof.append(f"case when {name}{i}x.n > 1 then {name}{i}x.lft || {name}{i}x.rgt else '' end")
    # Each step of the fold is a query of its own, so that its text stays short.
    cols = ", ".join(f"{n}{i}x.n as n_{n}{i}, {n}{i}x.lft as l_{n}{i}, {n}{i}x.rgt as r_{n}{i}" for n, i in steps)
    folds, last = "", "f"
    for n, i in steps:
        folds += f",\n f_{n}{i} as (select * exclude (acc), case when n_{n}{i} > 1 then sha256(l_{n}{i} || acc || r_{n}{i}) else acc end as acc from {last})"
        last = f"f_{n}{i}"
    return f"""with l as materialized (select doc_id, coalesce('=' || lang, '') as k, sha256({fields}) as leaf, case when {crc} % 3 = 0 then sha256({lower}) end as bad,
  row_number() over (partition by lang order by doc_id nulls first, sha256({fields})) - 1 as r, count(*) over (partition by lang) as n from documents),
 {_sql_tree("t", "select k, r, n, leaf as d from l", SQL_LEVELS)},
 h as materialized (select k, d as subroot, row_number() over (order by k) - 1 as r, count(*) over () as n from t{SQL_LEVELS}),
 {_sql_tree("g", "select 0 as k, r, n, subroot as d from h", SQL_GROUP_LEVELS)},
 f as (select doc_id, leaf, subroot, root.d as root, sha256({" || ".join(proof)}) as proof_sha256, {fold} as acc, {cols}
  from l join h on h.k = l.k cross join g{SQL_GROUP_LEVELS} root{joins}){folds}
select doc_id, leaf, subroot, root, proof_sha256, acc as folded_root, acc = root as verified from {last}"""


OP12_SQL = _sql()
