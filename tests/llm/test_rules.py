"""Operators 2, 7, 8, 9 and 10: brute force, held-out accuracy and SQL."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

pytest.importorskip("kmerloom.llm")
from pyspark.sql import functions as F  # noqa: E402

from kmerloom.llm import langid, licenses, lm, quality, urls  # noqa: E402

LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "12 34 !"), (5, "word " * 70), (5, "word " * 70), (None, "no id here"), (6, "Ab aB x"), (7, "é ü\nA\n\nA\nb c"),
       (8, " ".join(f"w{i}" for i in range(60)) + "\n" + "q r s t " * 2), (9, "x " * 30000)]


def table(spark, path, rows=ODD, empty=False):
    data = [(d, t, "en" if (d or 0) % 2 else None, "s", 1, 2) for d, t in rows]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, kept int, score int")
    (frame.limit(0) if empty else frame).write.parquet(f"{path}/documents.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_quality_matches_sql(spark, sf, tmp_path):
    table(spark, tmp_path)
    for folder in (sf, str(tmp_path)):
        con = duckdb.connect()
        source = f"{folder}/documents.parquet" + ("" if folder == sf else "/*.parquet")
        con.sql(f"create view documents as select * from '{source}'")
        want = sorted(map(str, con.sql(quality.OP9_SQL).fetchall()))
        got = quality.op9_quality_rules(spark, folder).select("doc_id", *quality.COUNTS, "base_failed", "kept").collect()
        assert sorted(str(tuple(r)) for r in got) == want


def test_quality_keeps_and_drops(spark, sf, tmp_path):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality.op9_quality_rules(spark, sf).join(labels, "doc_id")
    assert judged.where("quality = 1 and not base_failed and not kept").isEmpty()
    assert judged.where("quality = 0 and kept").isEmpty()
    kept = quality.apply_rules(docs)
    assert kept.columns == docs.columns and kept.count() == quality.op9_quality_rules(spark, sf).where("kept").count()
    own = table(spark, tmp_path)
    assert quality.apply_rules(own).count() == quality.op9_quality_rules(spark, str(tmp_path)).where("kept").count()
    assert quality.apply_rules(docs.limit(0)).count() == 0


def test_language_held_out(spark, sf, tmp_path):
    got = langid.op2_language_id(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = got.join(docs, "doc_id").where("held_out and lang is not null")
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count() > 0
    assert got.where("score < 0 or score > 1 or score is null").isEmpty()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.collect())
    table(spark, tmp_path)
    und = {r.doc_id for r in langid.op2_language_id(spark, str(tmp_path)).where("lang_pred = 'und'").collect()}
    assert und == {1, 2, 3, 4}


def test_language_nothing_to_learn(spark, tmp_path):
    table(spark, tmp_path, empty=True)
    assert langid.op2_language_id(spark, str(tmp_path)).count() == 0
    model = langid.fit(spark.createDataFrame([("abc", None)], "text string, lang string"))
    assert model.predict(["abc", None]) == (["und", "und"], [0.0, 0.0])


def test_language_kernel_is_the_set_kernel():
    texts = ["the cat. The dog", "le chat et le chien", "der hund", "cat"]
    m = langid.Model(texts, ["en", "fr", "de", "en"])

    def grams(t):
        t = "".join(c if c.isalpha() else " " for c in t.lower())
        t = " " + re.sub(" +", " ", t.strip()) + " "
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    order = [0, 2, 1, 3]
    want = [[len(grams(a) & grams(texts[b])) / math.sqrt(len(grams(a)) * len(grams(texts[b]))) for b in order] for a in texts]
    got = m.kernel([m.spectrum.slots(t) for t in texts])
    landmarks = sorted(map(tuple, got.T.astype(float).round(5).tolist()))
    assert landmarks == sorted(tuple(round(r[j], 5) for r in want) for j in range(4))


def brute_lm(docs, k2, k3, least=2):
    rows = [(d, (t or "").encode().translate(LOW).split() + [None]) for d, t in docs]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    train = [w for d, w in rows if not held(d)]
    one = Counter(x for w in train for x in w)
    two = Counter(p for w in train for p in zip([0, *w[:-1]], w, strict=True))
    three = Counter(p for w in train for p in zip([0, *w], w, w[1:]))  # noqa: B905
    before = Counter(p for w in train for p in [0, *w[:-1]])
    n, v = sum(one.values()), len(one)
    p1 = lambda x: (one[x] + 0.1) / (n + 0.1 * (v + 1))
    p2 = lambda v, x: (two[v, x] + k2 * p1(x)) / (before[v] + k2)
    for d, w in rows:
        base = sum(math.log10(p1(x)) for x in w)
        score, history = math.log10(p2(0, w[0])), [0, *w]
        for u, v_, x in zip(history, w, w[1:]):  # noqa: B905
            p, c = p2(v_, x), two[u, v_]
            score += math.log10((three[u, v_, x] + k3 * p) / (c + k3) if c >= least else p)
        yield d, held(d), len(w), sum(one[x] > 0 for x in w), n, base, score, score / len(w)


@pytest.mark.parametrize("part", [50, 1 << 20])
def test_lm_scores(spark, sf, tmp_path, part):
    own = table(spark, tmp_path)
    for folder in (sf, str(tmp_path)):
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
        if part == 50 and folder == sf:
            continue
        frame = spark.read.parquet(f"{folder}/documents.parquet").withColumn("train", lm.train_fold("doc_id", 10, 0))
        got = sorted((tuple(r) for r in lm.score_documents(frame, part_tokens=part).collect()), key=str)
        want = sorted(brute_lm(docs, *lm.PRIORS), key=str)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        for g, w in zip(got, want, strict=True):
            assert g[5:] == pytest.approx(w[5:], rel=1e-9)
    assert lm.score_documents(own.limit(0).select("doc_id", "text", F.lit(True).alias("train"))).count() == 0


def test_lm_beats_base_and_bigrams_on_held_out(spark, sf):
    total = lambda frame: frame.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    held = total(lm.op8_lm_scores(spark, sf))
    assert held[0] > held[1]
    frame = spark.read.parquet(f"{sf}/documents.parquet").withColumn("train", lm.train_fold("doc_id", 10, 0))
    assert held[0] > total(lm.score_documents(frame, least=1 << 40))[0]  # no pair of words is a state: bigrams alone


def test_url_rules(spark):
    cases = {
        "http://a.NET/x": ("a.net", "/x", "net/", "block"),
        "https://blog.example.net/en/1?q#f": ("blog.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net/fr/": ("example.net", "/fr/", "net/", "block"),
        "http://example.com/de/9": ("example.com", "/de/9", "example.com/de/", "block"),
        "http://x.org/fr/a": ("x.org", "/fr/a", "org/fr/", "allow"),
        "http://borg/fr/a": ("borg", "/fr/a", None, None),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, None),
        "no scheme": ("", "", None, None),
        "x://H?a/b": ("h", "", None, None),
        "http://a.b/c\nd": ("a.b", "/c\nd", None, None),
        None: ("", "", None, None),
        "": ("", "", None, None),
    }
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(cases)] + [(0, "http://a.NET/x", 1)], "page_id long, url string, host int")
    got = {r.page_id: r for r in urls.judge_urls(pages).collect()}
    assert urls.judge_urls(pages).count() == len(cases) + 1
    for i, want in enumerate(cases.values()):
        r = got[i]
        assert (r.host, r.path, r.rule) == want[:3] and r.verdict in ("allow", "block") and want[3] in (None, r.verdict)
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_url_templates_learn(spark):
    rows, labels = [], []
    for i in range(300):
        rows += [(2 * i, f"http://h.com/spam/{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{chr(97 + i // 100)}-slug/{i}"), (2 * i + 1, f"http://h.com/news/{i}.html")]
        if i % 3 == 0:
            labels += [(2 * i, 1), (2 * i + 1, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = urls.judge_urls(pages, spark.createDataFrame(labels, "page_id long, label int")).collect()
    assert {(r.template, r.verdict) for r in got} == {("/spam/*/*", "block"), ("/news/*", "allow")}


def test_licenses(spark, sf):
    texts = {
        "a/LICENSE": "Released under the MIT License.",
        "a/b/COPYING": "This work is licensed under the GNU General Public License,\nversion 3.",
        "a/b/c/x.txt": "plain",
        "a/y.txt": "plain text\nLicensed under the Apache License, Version 2.0.",
        "a/z.txt": "we like the license of this version",
        "q/r.txt": None,
        "root.txt": "",
        None: "x",
        "a/b/other.txt": "nothing",
    }
    files = spark.createDataFrame([(i, p, t, 1) for i, (p, t) in enumerate(texts.items())], "id long, path string, text string, score int")
    got = {r.path: (r.own_license, r.license, r.inherited_from) for r in licenses.scan(files).collect()}
    assert got == {
        "a/LICENSE": ("MIT", "MIT", None),
        "a/b/COPYING": ("GPL-3.0", "GPL-3.0", None),
        "a/b/c/x.txt": (None, "GPL-3.0", "a/b"),
        "a/y.txt": ("Apache-2.0", "Apache-2.0", None),
        "a/z.txt": (None, "MIT", "a"),
        "q/r.txt": (None, None, None),
        "root.txt": (None, None, None),
        None: (None, None, None),
        "a/b/other.txt": (None, "GPL-3.0", "a/b"),
    }
    assert licenses.scan(files.limit(0)).count() == 0
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    rows = {r.doc_id: r for r in licenses.op10_license_scan(spark, sf).collect()}
    assert rows.keys() == docs.keys()
    for d, text in docs.items():
        assert rows[d].own_license in ({lines[x] for x in text.split("\n") if x in lines} or {None})


def test_language_regression_by_brute_force():
    """Kernel by sets of n-grams, Nystroem features by a singular value decomposition, regression as stacked least squares."""
    import numpy as np

    rng = random.Random(12)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "klmnopqe"}
    make = lambda lang: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 12)))
    texts = [make(lang) for lang in letters for _ in range(14)]
    langs = [lang for lang in letters for _ in range(14)]
    new = [make(lang) for lang in letters for _ in range(10)] + ["E f G", "éa ß", "123", "", None]
    ridge = langid.RIDGE

    def grams(text):
        s = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)} if s.strip() else set()

    def kernel(a, b):
        return np.array([[len(x & y) / (max(1, len(x)) * max(1, len(y))) ** 0.5 for y in b] for x in a])

    sets = [grams(t) for t in texts]
    for landmarks in (len(texts), 9):
        model = langid.Model(texts, langs, landmarks=landmarks)
        order = [i for row in zip(*([i for i, x in enumerate(langs) if x == lang] for lang in letters), strict=True) for i in row][:landmarks]
        marks = [sets[i] for i in order]
        u, size, _ = np.linalg.svd(kernel(marks, marks), hermitian=True)
        ok = size > 1e-6 * size.max()
        root = u[:, ok] / np.sqrt(size[ok])
        z = np.hstack([kernel(sets, marks) @ root, np.ones((len(sets), 1))])
        y = np.array([[1.0 if x == lang else -1.0 for lang in letters] for x in langs])
        w = np.linalg.lstsq(np.vstack([z, np.sqrt(ridge * len(z)) * np.eye(z.shape[1])]), np.vstack([y, np.zeros((z.shape[1], 3))]), rcond=None)[0]
        seen = [grams(t or "") for t in new]
        f = np.hstack([kernel(seen, marks) @ root, np.ones((len(seen), 1))]) @ w
        got, scores = model.predict(new)
        for i, s in enumerate(seen):
            want = max(f[i]) if s else -1
            assert abs(scores[i] - min(1, max(0, (want + 1) / 2))) < 2e-3
            close = np.sort(f[i])[-1] - np.sort(f[i])[-2] < 4e-3
            assert got[i] == (list(letters)[int(f[i].argmax())] if s else "und") or (s and close)
