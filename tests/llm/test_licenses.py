"""Operator 10 against a plain version, and on the usual layouts of licence files."""

import math
import os
import shutil
import textwrap
from collections import Counter

import pytest

pytest.importorskip("kmerloom.llm")
from kmerloom.llm import licenses as lic  # noqa: E402


def brute_scan(files, licences=lic.LICENCES):
    """files (path, text) -> (path, own licence, score, licence, directory it is inherited from) of each."""
    vocab = {w for _, t in lic.TEMPLATES for w in lic.words(t)}
    bags = [lic.words(t or "") for _, t in files]
    df = Counter(w for b in bags for w in set(b) & vocab)
    idf = {w: math.log((len(files) + 1) / (df[w] + 1)) + 1 for w in vocab}
    other = sum(idf[w] for w in sorted(vocab)) / len(vocab)

    def weigh(ws, idf_of, other_of):
        c = Counter(ws)
        return {w: n * idf_of[w] for w, n in c.items() if w in idf_of}, sum(n for w, n in c.items() if w not in idf_of) * other_of**2

    def cosine(vector, template):
        inner, rest = vector
        norm = math.sqrt(sum(v * v for v in inner.values()) + rest)
        unit = math.sqrt(sum(v * v for v in template.values()))
        return round(sum(v * template.get(w, 0.0) for w, v in inner.items()) / norm / unit, 6) if norm else 0.0

    templates = [(k, name, len(lic.words(t)), weigh(lic.words(t), idf, other)[0]) for k, (name, t) in enumerate(lic.TEMPLATES)]
    whole_words = [lic.words(t) for _, t in licences]
    whole_idf = {w: math.log((len(whole_words) + 1) / (sum(w in set(v) for v in whole_words) + 1)) + 1 for v in whole_words for w in v}
    wholes = [(len(templates) + k, name, {w: n * whole_idf[w] for w, n in Counter(v).items()}) for k, ((name, _), v) in enumerate(zip(licences, whole_words, strict=True))]
    out, known = [], {}
    for (path, text), bag in zip(files, bags, strict=True):
        named = path is not None and path.rsplit("/", 1)[-1].lower().startswith(("license", "licence", "copying", "notice"))
        found = []
        units = [lic.words(x) for x in (text or "").split("\n")] + ([bag] if named else [])
        for u in units:
            if set(u) & vocab:
                v = weigh(u, idf, other)
                found += [(0, cosine(v, t), -k, name) for k, name, _, t in templates]
        for k, name, n, t in templates:
            for s in range(max(1, len(bag) - n + 1)):
                run = tuple(bag[s : s + n])
                if not t.keys().isdisjoint(run):  # others have cosine 0
                    if (k, run) not in known:
                        known[k, run] = cosine(weigh(run, idf, other), t)
                    found.append((0, known[k, run], -k, name))
        if named:
            c = Counter(bag)
            norm = math.sqrt(sum((n * whole_idf.get(w, 1.0)) ** 2 for w, n in c.items()))
            for k, name, t in wholes:
                unit = math.sqrt(sum(x * x for x in t.values()))
                found.append((1, round(sum(n * whole_idf.get(w, 1.0) * t.get(w, 0.0) for w, n in c.items()) / norm / unit, 6) if norm else 0.0, -k, name))
        _, score, _, own = max((f for f in found if f[1] >= lic.CUT), default=(0, 0.0, 0, None))
        out.append([path, *((own, score) if score >= lic.CUT else (None, None)), named])
    dirs = {}
    for path, own, score, named in out:
        if own and named:
            d = path.rpartition("/")[0]
            dirs[d] = min(dirs.get(d, (math.inf,)), (-score, path, own))
    rows = []
    for path, own, score, _ in out:
        near = None
        if own is None and path is not None:
            parts = path.split("/")[:-1]
            near = next(("/".join(parts[:n]) for n in range(len(parts), -1, -1) if "/".join(parts[:n]) in dirs), None)
        rows.append((path, own, score, own or (dirs[near][2] if near is not None else None), near))
    return rows


def check(spark, files, licences=lic.LICENCES):
    frame = spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "id long, path string, text string").repartition(3)
    got = {r.id: (r.path, r.own_license, r.score, r.license, r.inherited_from) for r in lic.scan(frame, licences=licences).collect()}
    want = brute_scan(files, licences)
    assert len(got) == len(files)
    for i, w in enumerate(want):
        assert got[i][:2] + got[i][3:] == w[:2] + w[3:] and got[i][2] == (None if w[2] is None else pytest.approx(w[2], abs=2e-6)), i
    return got


def test_documents(spark, sf):
    """Scores and inheritance of the query's own files."""
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id)
    rows = {r.doc_id: r for r in lic.op10_license_scan(spark, sf).collect()}
    want = brute_scan([(rows[d.doc_id].path, d.text) for d in docs])
    assert len(rows) == len(docs)
    for d, w in zip(docs, want, strict=True):
        r = rows[d.doc_id]
        assert (r.own_license, r.license, r.inherited_from) == (w[1], w[3], w[4])
        assert r.score == (None if w[2] is None else pytest.approx(w[2], abs=2e-6))


def test_layouts(spark):
    """Whole licences under a title and a copyright line, wrapped, indented, commented; ties, repeats, a very long text."""
    files = []
    for k, (name, text) in enumerate(lic.LICENCES):
        body = textwrap.fill(f"{name} License\n\nCopyright (c) 2019-2024 Some Person and others\n\n{text}", 60 + 7 * k)
        files += [(f"p{k}/LICENSE.txt", body), (f"p{k}/src/a.c", "int main;"), (f"q{k}/COPYING", textwrap.indent(body, " * "))]
    files += [("t/LICENSE-B", "Released under the MIT License."), ("t/LICENSE-A", "Released under the MIT License."), ("t/x", ""), ("t/x", ""), (None, None)]
    files += [("u/long.txt", "word and work of the license " * 20_000 + "\nReleased under the MIT License.\n" + "x y z " * 20_000)]
    got = check(spark, files)
    for k, (name, _) in enumerate(lic.LICENCES):
        a, b, c = (got[3 * k + j] for j in range(3))
        assert a[1] == c[1] == name and b[3:] == (name, f"p{k}")
    assert got[len(files) - 1][1] == "MIT"


SYSTEM = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(SYSTEM), reason="the system has no licence texts")
def test_licences_of_a_folder(spark, tmp_path):
    """Long licences, and those that share most of their words, are told apart by whole texts under any layout."""
    names = [("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0")]
    for k, (name, file) in enumerate(names):
        shutil.copyfile(f"{SYSTEM}/{file}", tmp_path / (name + ".txt" * (k % 2)))
    licences = (*lic.LICENCES, *lic.read_licences(spark, str(tmp_path)))
    assert [n for n, _ in licences[len(lic.LICENCES) :]] == sorted(n for n, _ in names)
    files = []
    for name, text in licences[len(lic.LICENCES) :]:
        files += [(f"{name}/LICENSE", textwrap.fill(text, 50)), (f"{name}/a.c", "int main;"), (f"{name}/part/COPYING", text[: len(text) * 9 // 10])]
    got = check(spark, files, licences)
    for i, (path, _) in enumerate(files):
        assert got[i][3] == path.split("/")[0]
