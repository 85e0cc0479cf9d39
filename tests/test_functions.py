"""Scalar functions and operators on literal rows, and the counter and the consensus against plain models."""

import random
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import names, scores, sequence
from kmerloom.operators import consensus, manifest, profile, taxonomy, windows
from kmerloom.plans.params import Params, accepted


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


def test_scalars(spark):
    assert one(spark, sequence.pattern_filter(F.col("k"), [1, 1, 0, 1, 1]), k="ATCAG") == "ATAG"
    assert one(spark, sequence.revcomp(F.col("k")), k="ACGTURYKMSWBVDHN") == "NDHBVSWKMRYAACGT"
    assert [one(spark, sequence.encode_kmer(F.col("k")), k=k) for k in ("TGCA", "AAAC", "ACGN")] == [3210, 1, None]
    assert sorted(one(spark, sequence.expand_iupac(F.col("k")), k="ARAC")) == ["AAAC", "AGAC"]
    assert len(one(spark, sequence.expand_iupac(F.col("k")), k="ANNA")) == 16
    assert one(spark, names.accession_of_header(F.col("h")), h=">NC_0001.2 some genome") == "NC_0001"
    assert one(spark, names.node_key(F.col("n"), F.lit(3)), n="Bact") == "Bact_3"
    assert one(spark, names.flow_percent(F.col("v"), 50), v=25) == 50.0
    words = sequence.encoder(spark, 3).orderBy("code_rank").collect()
    assert [(r.kmer, r.code, r.code_rank) for r in words[:2]] == [("AAA", 0, 0), ("AAC", 1, 1)] and len(words) == 64 and words[-1].code == 333
    with pytest.raises(ValueError):
        sequence.pattern_filter(F.col("k"), [1, 2])


def test_parse_taxonomy(spark):
    path = "x/Bacteria_RealBacteria_TrueBacteria_SomeBacteria_AmazingBacteria_sp.v2.fna"
    got = one(spark, names.parse_taxonomy(F.col("p")), p=path)
    assert tuple(got) == ("Bacteria", "RealBacteria", "TrueBacteria", "SomeBacteria", "AmazingBacteria")
    assert one(spark, names.parse_taxonomy(F.col("p"), "drop"), p="a_b_c.fna") is None
    with pytest.raises(Exception, match="five names"):
        one(spark, names.parse_taxonomy(F.col("p")), p="a_b_c.fna")


def test_windows(spark):
    for length, starts in ((1000, [70 * i for i in range(10)]), (305, [0] * 10), (300, [0] * 10)):
        frame = spark.createDataFrame([(1, "ACGT" * (length // 4) + "A" * (length % 4))], "id int, seq string")
        got = windows.windows(frame, 300, 10).orderBy("win_idx").collect()
        assert [r.start for r in got] == starts and all(len(r.win) == 300 for r in got)
    assert windows.windows(spark.createDataFrame([(1, "ACG")], "id int, seq string"), 300, 10).count() == 0
    kmers = windows.kmers(spark.createDataFrame([(1, bytearray(b"ACGTACGTAC"))], "id int, win binary"), 4)
    assert Counter(r.kmer for r in kmers.collect()) == {"ACGT": 2, "CGTA": 1, "GTAC": 1, "TACG": 1}
    assert windows.kmers(spark.createDataFrame([(1, bytearray(b"ACGTA"))], "id int, win binary"), 4).count() == 0


COMPLEMENT = dict(zip(sequence.LETTERS, sequence.COMPLEMENTS, strict=True))


def model_counter(win, k, mask, semantics):
    clean, w = semantics == "clean", len(mask)
    counts = Counter(win[i : i + w] for i in range(len(win) - w + 1 if clean else len(win) - w - 1))
    rc = lambda s: "".join(COMPLEMENT[c] for c in reversed(s))
    back = Counter()
    for s, n in counts.items():
        back[rc(s)] = back[rc(s)] + n if clean else n
    both = counts + back
    if 0 in mask:
        spaced = Counter()
        for s, n in both.items():
            key = "".join(c for c, m in zip(s, mask, strict=True) if m)
            spaced[key] = spaced[key] + n if clean else n
        both = spaced
    homo = {c * k for c in "ATCG"}
    out = Counter()
    for s, n in both.items():
        if s not in homo:
            plain = list(product(*(sequence.BASES.get(c, sequence.ANY_BASE) for c in s)))
            for p in plain:
                out["".join(p)] += n // len(plain)
    return {s: n for s, n in out.items() if not (clean and s in homo)}


@pytest.mark.parametrize("semantics", ["reference", "clean"])
@pytest.mark.parametrize("mask", [[1, 1, 1, 1], [1, 1, 0, 1, 1], [1, 0, 1, 1], [1, 0, 0, 1]])
def test_profile_against_a_model(spark, mask, semantics):
    rng, k = random.Random(sum(mask) * 10 + len(mask)), sum(mask)
    rows = [(i, "".join(rng.choice("ACGTACGTACGT" + "URYKMSWBVDHN" * (i % 3 == 0)) for _ in range(rng.choice([40, 120])))) for i in range(25)]
    frame = spark.createDataFrame([(i, bytearray(s.encode())) for i, s in rows], "id int, win binary")
    got = {}
    for r in profile.kmer_profile(frame, ["id"], k, mask, semantics).collect():
        got.setdefault(r.id, {})[r.kmer] = r.cnt
    assert got == {i: m for i, s in rows if (m := model_counter(s, k, mask, semantics))}


def test_profile_is_one_exchange(spark):
    """One for windows whose strands pair up, and one for those with U."""
    frame = spark.createDataFrame([(1, bytearray(b"ACGTACGTAC"))], "id int, win binary")
    plans = [profile.count_map(profile.with_codes(profile.kmer_profile(frame, ["id"], 4, p, s)), ["id"])._jdf.queryExecution().executedPlan().toString()
             for p, s in (([1, 1, 1, 1], "reference"), ([1, 1, 0, 1, 1], "clean"), ([1, 1, 0, 1, 1], "reference"))]
    assert [p.count("Exchange hashpartitioning") for p in plans] == [2, 2, 1]


@pytest.mark.parametrize("semantics", ["reference", "clean"])
def test_strands_counted_at_once(spark, semantics):
    """Windows with and without U give what the general way gives."""
    rng = random.Random(11)
    words = ["".join(rng.choice(letters) for _ in range(rng.choice([3, 6, 40, 60]))) for letters in ("ACGT", "ACGTRYKMSWBVDHN", "ACGTU", "ACGTURYN", "A") for _ in range(12)]
    frame = spark.createDataFrame([(i, bytearray(w.encode())) for i, w in enumerate(words)], "id int, win binary")
    for pattern in ([1, 1, 1, 1], [1, 1, 0, 1, 1]):
        got = profile.kmer_profile(frame, ["id"], 4, pattern, semantics)
        counted = profile.count_kmers(profile.kmers(frame, len(pattern), semantics), ["id"])
        want = profile.apply_pattern_counts(profile.merge_strands(counted, ["id"], semantics), ["id"], pattern, semantics)
        want = profile.sum_expanded(profile.drop_homopolymers(want, 4), ["id"])
        want = profile.drop_homopolymers(want, 4) if semantics == "clean" else want
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def total(p):
    """Added from left to right, as the engine does; sum() rounds otherwise."""
    out = 0.0
    for x in p:
        out += x
    return out


def model_consensus(rows, func, t):
    """Votes of one group, relaxing the threshold; None for a rejected window."""
    best = [p.index(max(p)) for p in rows]
    if t <= 0:
        return best
    t = min(t, 1.0)
    out = []
    for p, c in zip(rows, best, strict=True):
        top = max(p)
        if func == "delta_mean":
            ok = top - total(p) / len(p) > t
        elif func == "min_max":
            rest = [top - q for q in p if q != top]
            if not rest:
                return best
            ok = min(rest) > t
        else:
            ok = top > (total(p) - top) + t
        out.append(c if ok else None)
    return out if any(out) else model_consensus(rows, func, t - 0.05)


@pytest.mark.parametrize("func", ["delta_mean", "min_max", "delta_sum"])
def test_consensus_against_a_model(spark, func):
    rng = random.Random(8)
    groups, start = {}, {0.8: 0, 0.3: 0, 0.0: 0, 1.4: 0}
    for g in range(160):
        k = rng.choice([1, 2, 3, 6])
        rows = []
        for _ in range(rng.randrange(1, 7)):
            raw = [rng.choice([0, 1, 1, 2, 5, 40]) + 1 for _ in range(k)]
            rows.append([x / sum(raw) for x in raw])
        groups[g] = rows
    frame = spark.createDataFrame([(g, i, p) for g, rows in groups.items() for i, p in enumerate(rows)], "g int, win_idx int, p array<double>").cache()
    for t in start:
        got = {}
        for r in consensus.consensus(frame, ["g"], func, t).orderBy("win_idx").collect():
            got.setdefault(r.g, []).append(r.vote)
        assert got == {g: model_consensus(rows, func, t) for g, rows in groups.items()}
        votes = {}
        for r in consensus.count_votes(consensus.consensus(frame, ["g"], func, t), ["g"]).collect():
            votes.setdefault(r.g, {})[r.vote] = r.votes
        want = {}
        for g, rows in groups.items():
            counter, first = Counter(), {}
            for v in model_consensus(rows, func, t):
                first.setdefault(v or 0, v is not None)
                counter[v or 0] += 1
            want[g] = {c: n for c, n in counter.items() if first[c]}
        assert votes == {g: v for g, v in want.items() if v}


def test_votes_in_clean_semantics(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 1, 0), (1, 2, 3), (1, 3, 0)], "g int, win_idx int, vote int")
    got = {r.vote: r.votes for r in consensus.count_votes(rows, ["g"], "clean").collect()}
    assert got == {0: 2, 3: 1}
    assert {r.vote: r.votes for r in consensus.count_votes(rows, ["g"]).collect()} == {3: 1}


def test_keep_taxa_is_strict(spark):
    votes = spark.createDataFrame([(1, 0, 6), (1, 1, 4), (2, 0, 5), (2, 1, 5)], "g int, vote int, votes long")
    keep = lambda t: {(r.g, r.vote) for r in consensus.keep_taxa(votes, ["g"], t).collect()}
    assert keep(0.5) == {(1, 0)} and keep(1.0) == set() and len(keep(0.3)) == 4 and keep(0.6) == set()


def test_thresholds():
    assert [scores.clamp_threshold(t) for t in (-1, 0.5, 3)] == [0.01, 0.5, 1.0]
    with pytest.raises(ValueError):
        scores.clamp_threshold(None)
    assert len(scores.ladder(0.8)) == 16 and scores.ladder(0) == []


def test_params_guard():
    assert Params().read_size == 10000
    for bad in ({"pattern": [1, 1, 1]}, {"pattern": [2, 2]}, {"sampling": 0}, {"read_size": 5}, {"semantics": "x"}):
        with pytest.raises(ValueError):
            Params(**bad)


def test_params_of_a_table(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(12), rng.randrange(1, 5), [rng.choice([0, 1, 1, 1, 2][: 4 + i % 2]) for _ in range(rng.randrange(6))], rng.randrange(-1, 4)) for i in range(400)]
    rows += [(6, 4, [1, 1, 1, 1], 1), (5, 4, [1, 1, 1, 1], 1)]
    frame = spark.createDataFrame(rows, "read_size int, ksize int, pattern array<int>, sampling int")
    got = [r.ok for r in frame.select(accepted(*(frame[c] for c in frame.columns)).alias("ok")).collect()]

    def taken(read_size, ksize, pattern, sampling):
        try:
            Params(read_size=read_size, ksize=ksize, pattern=pattern, sampling=sampling)
        except ValueError:
            return False
        return True

    assert got == [taken(*r) for r in rows] and any(got)


def test_taxonomy_conflicts(spark):
    rows = [(0, "A", "P", "G", "O", "F"), (1, "B", "p", "G", "O2", "F2"), (2, "A", "Q", "H", "O3", "F3")]
    frame = spark.createDataFrame(rows, "file_ord int, domain string, phylum string, `group` string, order string, family string")
    tree = {r.node_id: (r.name, r.parent_id) for r in taxonomy.taxa_tree(frame).collect()}
    assert tree["p_phylum"] == ("P", "a_domain") and tree["g_group"] == ("G", "p_phylum") and tree["root_root"] == ("Root", None)
    clash = {(r.level, r.key): (r.spellings, r.parents) for r in taxonomy.conflicting_names(frame).collect()}
    assert clash == {("phylum", "p"): (2, 2)}
    codes = {(r.level, r.name): r.code for r in taxonomy.taxa_codes(frame).collect()}
    assert codes["phylum", "P"] == 0 and codes["phylum", "p"] == 1 and codes["phylum", "Q"] == 2
    with pytest.raises(Exception, match="no code for"):
        taxonomy.label_rows(frame, taxonomy.taxa_codes(frame.where("file_ord = 0")), "family").collect()


def test_manifest(spark):
    lines = spark.createDataFrame([(0, "GCF_1 representative genome https://h/a/GCF_1_v1"), (1, "GCF_2 representative genome https://h/a/GCF_2_v1 x"), (2, "GCF_3 na https://h/b")], "i long, line string")
    got = manifest.manifest_urls(manifest.representative_only(lines)).collect()
    assert [tuple(r) for r in got] == [(1, "GCF_2", "https://h/a/GCF_2_v1", "https://h/a/GCF_2_v1/GCF_2_v1_genomic.fna.gz")]
    with pytest.raises(Exception, match="no url"):
        manifest.manifest_urls(spark.createDataFrame([(1, "GCF_2 x")], "i long, line string")).collect()
    lineages = [("a", ["Bact", "Ph", "Grales", "x"], "Gen sp"), ("b", ["Bact", "Ph", "Gr", "none"], "Gen sp"), ("c", ["Bact", "Ph", "Gr", "Aales", "Bales"], "Gen sp x")]
    out = {r.accession: r.file_name for r in manifest.lineage_to_taxonomy(spark.createDataFrame(lineages, "accession string, lineage array<string>, organism string")).collect()}
    assert out == {"a": "Bact_Ph_Ph_Grales_Gen_sp.fna", "c": "Bact_Ph_Gr_Bales_Gen_sp.fna"}
