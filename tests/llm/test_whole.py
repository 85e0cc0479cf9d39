"""The corpus operators on what they once left out."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from kmerloom.llm import langid, licenses, packing, urls  # noqa: E402


def test_license_rows_with_equal_or_null_ids(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [(1, "a/x", mit), (1, "a/x", apache), (1, "a/x", "none"), (None, "s/en", mit), (None, "s/en", "none"), (None, None, None), (None, None, None), (2, "a/LICENSE", mit)]
    got = licenses.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()
    want = [(1, "a/x", "MIT", "MIT"), (1, "a/x", "Apache-2.0", "Apache-2.0"), (1, "a/x", None, "MIT"), (None, "s/en", "MIT", "MIT"), (None, "s/en", None, None),
            (None, None, None, None), (None, None, None, None), (2, "a/LICENSE", "MIT", "MIT")]
    assert sorted(map(str, ((r.id, r.path, r.own_license, r.license) for r in got))) == sorted(map(str, want))


WRAPPED = {
    "bsd.c": ("BSD-3-Clause", "/* Copyright someone\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:\n * 1. Redistributions"),
    "gpl3.py": ("GPL-3.0", "# some words ahead\n#\n# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# any later one.\n\nimport os"),
    "gpl2.py": ("GPL-2.0", "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# any later one."),
    "narrow.txt": ("Apache-2.0", "Licensed\nunder\nthe Apache\nLicense,\nVersion\n2.0."),
    "d/LICENCE": ("MIT", "Copyright (c) 2024 someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\n" + "in the software without restriction and so on\n" * 30),
    "e/COPYING": ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\n" + "Everyone is permitted to copy and distribute verbatim copies of this document\n" * 20),
    "far.txt": ("BSD-3-Clause", "filler words here\n" * 2000 + "Redistribution and use in source and binary forms, with\nor without modification, are permitted provided that\nthe following conditions are met"),
    "none.txt": (None, "the source of this work is\nfree and the version\nof the program is public"),
}


def test_license_notices_over_line_ends(spark):
    files = spark.createDataFrame([(i, p, t) for i, (p, (_, t)) in enumerate(WRAPPED.items())], "id long, path string, text string")
    assert {r.path: r.own_license for r in licenses.scan(files).collect()} == {p: lic for p, (lic, _) in WRAPPED.items()}


def test_language_with_odd_lengths_or_copies(spark):
    import random

    rng = random.Random(4)
    letters = {"en": "abcdefgh", "sh": "ijklmn", "lo": "opqrst", "co": "uvwxyz"}
    text = lambda lang, n: " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(n))
    rows = [(text("en", 60), "en") for _ in range(60)] + [(text("sh", 8), "sh") for _ in range(60)] + [(text("lo", 3000), "lo") for _ in range(12)]
    copies = [text("co", 60) for _ in range(3)]
    rows += [(t, "co") for t in copies for _ in range(40000)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.langs == sorted(letters)
    assert model.predict([text(lang, 40) for lang in model.langs])[0] == model.langs


def test_url_templates_below_the_fourth_segment(spark):
    rows, labels = [], []
    for i in range(30):
        for kind in ("spam", "news"):
            rows.append((len(rows), f"http://h.test/2024/05/01/en/{kind}/{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'xy'[i // 26]}"))
            if i < 20:
                labels.append((rows[-1][0], int(kind == "spam")))
    deep = "/".join("abcdefgh")
    rows += [(1000 + i, f"http://h.test/{deep}/k{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'xy'[i // 26]}/end") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in urls.judge_urls(pages, spark.createDataFrame(labels, "page_id long, label int"), rules=()).collect()}
    assert len(got) == len(rows)
    assert {(got[p].template, got[p].verdict) for p, u in rows if "/spam/" in u} == {("/*/*/*/en/spam/*", "block")}
    assert {(got[p].template, got[p].verdict) for p, u in rows if "/news/" in u} == {("/*/*/*/en/news/*", "allow")}
    assert {got[p].template for p, _ in rows if p >= 1000} == {f"/{deep}/*/end"}


def test_url_templates_merge_at_any_segment(spark):
    rows, labels = [], []
    for lang in ("en", "de"):
        for leaf, label in (("list", 1), ("view", 0)):
            for i in range(12):
                rows.append((len(rows), f"http://m.test/{lang}/{leaf}?n={i}"))
                labels.append((len(rows) - 1, label))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = urls.judge_urls(pages, spark.createDataFrame(labels, "page_id long, label int"), rules=()).collect()
    assert {(r.path, r.template, r.verdict) for r in got} == {(f"/{g}/{leaf}", f"/*/{leaf}", v) for g in ("en", "de") for leaf, v in (("list", "block"), ("view", "allow"))}


def test_packing_keeps_every_source_a_queue(spark, monkeypatch):
    import public_tokenizers
    from test_tokens import check_pieces

    tok = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, "w x y z " * (1 + i * 7 % 40), f"host{i % 13}" if i % 14 else None) for i in range(90)] + [(90, "long text " * 6000, "host3"), (91, None, "host4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5, "doc_id")
    docs = docs.checkpoint()
    targets = {"host1": 0.5, "host2": 0.2, None: 0.1}
    key = lambda ps: sorted(map(str, ps))
    for given, bounds in ((None, (1, 4)), (targets, (12,))):  # no large queue, some of both kinds, few small ones
        want = packing.pack_documents(docs, tok, size=64, targets=given).collect()
        for most in bounds:
            with monkeypatch.context() as m:
                for name, value in (("MAX_QUEUES", most), ("BLOCK", 128), ("STRETCH", 32), ("WINDOWS", 4), ("GROUP", 8)):
                    m.setattr(packing, name, value)
                got = packing.pack_documents(docs, tok, size=64, targets=given).collect()
            check_pieces(docs.collect(), got, 64)
            assert {(p.doc_id, p.source) for p in got} == {(d, s) for d, _, s in rows}
            assert key(got) == key(want)


def test_small_queues_tokens_are_the_rows_that_are_sorted(spark, monkeypatch):
    """A hot source beside rare ones: no rows for its tokens; windows without a rare one are filled by it."""
    sizes = [("hot", 200_000), (None, 90_000), *((f"rare{i}", 1 + i % 3) for i in range(40))]
    totals = spark.createDataFrame(sizes, "queue string, n long")
    seen = []
    whole = packing._small_tokens
    monkeypatch.setattr(packing, "_small_tokens", lambda *a: seen.append(whole(*a)) or seen[-1])
    for name, value in (("MAX_QUEUES", 20), ("WINDOWS", 4), ("GROUP", 3)):
        monkeypatch.setattr(packing, name, value)
    runs = packing._queue_runs(totals, None, 64).collect()
    assert seen[0].count() == sum(n for q, n in sizes if q and q.startswith("rare"))
    order = sorted((q for q, _ in sizes), key=lambda q: (q is not None, q or ""))
    n = [dict(sizes)[q] for q in order]
    drr = packing.DeficitRoundRobin(n, n, 64)
    sent = drr.sent(np.arange(drr.windows() + 1))
    want = {(order[q], w): (sent[w, q], sent[w + 1, q] - sent[w, q]) for w, q in zip(*np.nonzero(np.diff(sent, axis=0)), strict=True)}
    assert {(r["queue"], r["window"]): (r["start"], r["count"]) for r in runs} == want
    assert all(r["offset"] == sum(c for (q, w), (_, c) in want.items() if w == r["window"] and order.index(q) < order.index(r["queue"])) for r in runs[:200])


def test_tokens_before_a_time():
    rng = np.random.default_rng(5)
    for queues, others in ((3, 2000), (300, 40), (0, 5)):
        n = rng.integers(1, 60, queues)
        drr = packing.DeficitRoundRobin(n, n, 64, float(n.sum()) + 100)
        every = [((t + 0.5) / drr.p[q], q) for q in range(queues) for t in range(n[q])]
        due = np.concatenate([rng.uniform(0, float(n.sum()) + 200, others), [d for d, _ in every[:: max(1, len(every) // 200)]]])
        place = rng.integers(0, queues + 1, len(due))
        want = [sum(d < v or (d == v and q < k) for d, q in every) for v, k in zip(due, place, strict=True)]
        assert drr.before(due, place).tolist() == want


def test_every_language_has_a_landmark():
    texts = [f"{c}{c}{d} {c}{d}{c} {d}{c}" * 3 for c in "abcdefgh" for d in "xyz"]
    langs = [t[0] for t in texts]
    model = langid.Model(texts, langs, landmarks=3)
    assert len(model.norms) == 8 and model.predict(texts)[0] == langs
