"""Operator 7's tree, merging and purities against a plain version."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("kmerloom.llm")
from kmerloom.llm import urls  # noqa: E402


def half_up(x):
    return math.floor(x * 10**urls.PLACES + 0.5 + 1e-9) / 10**urls.PLACES


def numeric(segment):
    stem = re.sub(r"(?<=.)\.[A-Za-z]{1,5}$", "", segment)
    return 2 * sum(c.isdigit() and c.isascii() for c in stem) >= len(stem)


def tree(paths):
    """(host, path) -> number of urls  ->  (host, path) -> template."""
    start = {(h, p): tuple("*" if numeric(s) else s for s in p.split("/") if s) for h, p in paths}
    n, now, done, i = Counter(), {}, {}, 0
    for key, segments in start.items():
        n[key[0], segments] += paths[key]
    live = dict.fromkeys(n, ())
    while live:
        values, seen = defaultdict(Counter), Counter()
        for (h, s), g in live.items():
            if len(s) > i:
                values[h, g][s[i]] += n[h, s]
                seen[h, g] += 1
        now = {}
        for (h, s), g in live.items():
            c = values.get((h, g))
            if len(s) > i and seen[h, g] > urls.BRANCHES:
                varies = len(c) > urls.BRANCHES and max(c.values()) <= urls.SHARE * sum(c.values())
                now[h, s] = (*g, "*" if varies else s[i])
            else:
                done[h, s] = (*g, *s[i:])
        live, i = now, i + 1
    return {(h, p): done[h, s] for (h, p), s in start.items()}


def smooth(b, n, prior):
    return (b + urls.PRIOR * prior) / (n + urls.PRIOR)


def brute(rows):
    """rows (host, path, label or None) -> (host, path) -> (template, purity)."""
    template = tree(Counter((h, p) for h, p, _ in rows))
    leaf, by_path, by_host, total = ({} for _ in range(4))
    for h, p, label in rows:
        for table, key in ((leaf, (h, template[h, p])), (by_path, template[h, p]), (by_host, h), (total, 0)):
            b, n = table.get(key, (0, 0))
            table[key] = (b + (label or 0), n + (label is not None))
    b, n = total[0]
    overall = b / n if n else 0.0

    def prior(h, t):
        path = smooth(*by_path[t], overall)
        return smooth(*by_host[h], path) if by_host[h][1] else path

    now = {k: (*v, prior(*k)) for k, v in leaf.items()}
    name = {k: k[1] for k in leaf}
    while True:
        families = defaultdict(list)
        for (h, t), (b, n, p) in now.items():
            for at, s in enumerate(t):
                if not s.startswith("*"):
                    families[h, at, (*t[:at], "*", *t[at + 1 :])].append((half_up(smooth(b, n, p)), n, t))
        choice = defaultdict(list)
        for (h, at, family), kin in families.items():
            steps = {}
            for step, n, t in kin:
                ts, labels = steps.get(step, ([], 0))
                steps[step] = ([*ts, t], labels + n)
            branches, lows, spread, total, weight = [], [], {}, 0.0, 0.0
            for step, (ts, n) in sorted(steps.items()):
                w, near = n + urls.PRIOR, False
                if weight:
                    m = (step + total / weight) / 2
                    near = step - total / weight <= urls.MERGE_Z * math.sqrt(m * (1 - m) * (1 / w + 1 / weight))
                if not near:
                    branches.append([])
                    lows.append(step)
                    total = weight = 0.0
                branches[-1] += ts
                spread[len(branches)] = step - lows[-1]
                total, weight = total + step * w, weight + w
            for k, ts in enumerate(branches, 1):
                general = (*family[:at], "*" if k == 1 else f"*{k}", *family[at + 1 :])
                for t in ts if len(ts) > 1 else ():
                    choice[h, t].append((-half_up(spread[k]), len(ts), at, general))
        pick = {k: max(v)[3] for k, v in choice.items()}
        many = Counter((h, g) for (h, _), g in pick.items())
        pick = {(h, t): g for (h, t), g in pick.items() if many[h, g] > 1}
        if not pick:
            return {(h, p): (name[h, t], smooth(*now[h, name[h, t]])) for (h, p), t in template.items()}
        name = {(h, t): pick.get((h, m), m) for (h, t), m in name.items()}
        merged = {}
        for (h, t), (b, n, p) in now.items():
            key = (h, pick.get((h, t), t))
            old = merged.get(key, (0, 0, 0.0))
            merged[key] = (old[0] + b, old[1] + n, max(old[2], p))
        now = merged


def check(got, rows):
    want = brute(rows)
    for r in got:
        template, purity = want[r.host, r.path]
        assert (r.template, r.purity) == ("/" + "/".join(template), pytest.approx(purity, abs=1e-8)), r
        if r.rule is None:
            assert r.verdict == ("block" if purity >= urls.CUT else "allow")


def test_labels_of_their_own(spark, monkeypatch):
    """Labels that follow the section, not the rules, on hosts with hot, deep, wide and few paths."""
    rng = random.Random(4)
    bad, pages = {"ads", "casino"}, []
    for i in range(1500):
        section = rng.choice(["news", "blog", "ads", "casino", "shop"])
        tail = rng.choice([str(i), f"item-{i}.html", rng.choice("abc"), f"{rng.choice('xyz')}/{rng.choice(['view', 'edit'])}"])
        url = f"http://{rng.choice(['hot.com', 'hot.com', 'b.com', 'c.org'])}/{rng.choice(['en', 'de', 'it'])}/{section}/{tail}"
        pages.append((i, url, int((section in bad) != (rng.random() < 0.05)) if rng.random() < 0.4 else None))
    pages += [(2000, None, None), (2001, "x", None), (2002, "http://hot.com", 1), (2003, "http://hot.com//", None)]
    frame = spark.createDataFrame([p[:2] for p in pages], "page_id long, url string")
    labels = spark.createDataFrame([(i, x) for i, _, x in pages if x is not None], "page_id long, label int")
    got = urls.judge_urls(frame, labels, rules=()).collect()
    assert len(got) == len(pages)
    by = {r.page_id: r for r in got}
    rows = [(by[i].host, by[i].path, x) for i, _, x in pages]
    check(got, rows)
    unlabelled = [(by[i], u.split("/")[4] in bad) for i, u, x in pages if x is None and i < 2000]
    right = sum((r.verdict == "block") == b for r, b in unlabelled)
    assert right >= 0.9 * len(unlabelled)
    monkeypatch.setattr(urls, "MERGE_Z", -1.0)  # nothing is alike but equal purities
    alone = brute(rows)
    assert right > sum((alone[r.host, r.path][1] >= urls.CUT) == b for r, b in unlabelled)


def test_pages(spark, sf):
    """The query on its table; the pages that a rule decides are the labelled ones."""
    got = urls.op7_url_templates(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/pages.parquet").count()
    check(got, [(r.host, r.path, None if r.rule is None else int(r.verdict == "block")) for r in got])
