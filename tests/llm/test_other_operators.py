"""Toxicity, neighbours, licences, HTML, URLs and WARC."""

import collections
import hashlib
import random
import re
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stintmill.llm import html, licences, linking, neighbours, toxicity, urls, warc


def test_toxicity_separates_and_never_learns_from_held_out(spark):
    rng = random.Random(4)
    words = [f"n{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        text = rng.choices(words, k=rng.randrange(10, 60))
        if bad:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(["vile", "rotten", "vilest"]))
        rows.append((i, " ".join(text), 0.5))
        labels.append((i, int(bad)))
    rows += [(1000, None, 0.5), (1001, "", 0.5), (1002, "!!!", 0.5), (1003, "vile " * 20000, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    table = spark.createDataFrame([*labels, (None, 1), (3, None), (7, 5)], "doc_id long, toxic int")
    out = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, table)).collect()}
    held = {r.doc_id for r in docs.where(toxicity.held_out(F.col("doc_id"))).collect()}
    right = [(out[i] >= 0.5) == bool(y) for i, y in labels if i in held]
    assert np.mean(right) > 0.95
    assert out[1000] == out[1001] == out[1002] == 0.0 and out[1003] > 0.9
    flipped = spark.createDataFrame([(i, 1 - y if i in held else y) for i, y in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, flipped)).collect()}
    assert again == out


def test_neighbours_equal_brute_force_on_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(600, 8)).astype(float)
    v[100:300] = v[100]  # a large group of equal vectors
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, [None] * 8, 1), (904, [1.0], 1), (None, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")
    got = neighbours.nearest(df, df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id")), leaf_rows=60, block_rows=50).toPandas()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = total = 0
    for q in range(0, 600, 20):
        s = u @ u[q]
        s[q] = -2
        best = np.lexsort((np.arange(600), -np.round(s, 12)))[:5]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert list(mine["rank"]) == [1, 2, 3, 4, 5]
        hit, total = hit + len(set(best) & set(mine["vec_id"])), total + 5
        if 100 <= q < 300:
            assert list(mine["vec_id"]) == [i for i in range(100, 107) if i != q][:5]
        for r in mine.itertuples():
            assert r.score == pytest.approx(s[r.vec_id], abs=1e-12)
    assert hit / total >= 0.9
    assert not set(got["query_id"]) & {900}
    none = df.where("vec_id > 899")
    assert neighbours.nearest(none.where("vec_id < 904"), none.select(F.col("vec_id").alias("query_id"))).count() == 0


def test_licences_of_headers_files_and_directories(spark):
    files = [
        ("p/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        ("p/a.txt", "nothing"), ("p/q/b.txt", "nothing"), ("p/q/c.txt", "x\nLicensed under the Apache License, Version 2.0.\ny"),
        ("p/r/LICENSE-2", "Licensed under CC BY-NC 4.0."), ("p/r/s/d.txt", None), ("z/e.txt", "a licensee of nothing in particular was seen"), ("f.txt", ""), (None, "MIT"),
    ]
    df = spark.createDataFrame([(*f, 1.0) for f in files], "path string, text string, score double")
    got = {r.path: (r.licence, r.via, r.origin) for r in licences.scan(df, licences.templates(spark)).collect()}
    assert got["p/LICENSE"][:2] == ("MIT", "own")
    assert got["p/a.txt"] == got["p/q/b.txt"] == ("MIT", "inherited", "p/LICENSE")
    assert got["p/q/c.txt"][:2] == ("Apache-2.0", "own")
    assert got["p/r/s/d.txt"] == ("CC-BY-NC-4.0", "inherited", "p/r/LICENSE-2")
    assert got["z/e.txt"] == got["f.txt"] == got[None] == (None, None, None)
    assert licences.scan(df.limit(0), licences.templates(spark)).count() == 0


def test_licence_versions_tags_and_wrapped_texts(spark):
    gpl2 = "This program is free software; you can redistribute it and/or modify it under the terms of\nthe GNU General Public License as published by the Free Software Foundation; either version 2\nof the License, or (at your option) any later version."
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
    files = [
        ("a/1", f"x = 1\n\n{gpl2}\n\ny = 2"), ("a/2", "# SPDX-License-Identifier: GPL-2.0-or-later"), ("a/3", "// SPDX-License-Identifier: Apache-2.0"), ("a/4", isc),
        ("a/5", "Licensed under the GNU General Public License, version 2.\n" + "word " * 200_000), ("a/6", "Licensed under the GNU Lesser General Public License, version 2.1."),
        ("a/7", "the general public may use the version that it likes"), ("a/7", "Licensed under CC BY 4.0."), ("a/8", "Licensed under CC BY-SA 4.0."), ("a/9", None), ("a/9", ""),
    ]
    got = {r.path: r.licence for r in licences.scan(spark.createDataFrame(files, "path string, text string"), licences.templates(spark)).collect()}
    assert got == {"a/1": "GPL-2.0", "a/2": "GPL-2.0", "a/3": "Apache-2.0", "a/4": "ISC", "a/5": "GPL-2.0", "a/6": "LGPL-2.1", "a/7": "CC-BY-4.0", "a/8": "CC-BY-SA-4.0", "a/9": None}


def test_licence_scores_equal_brute_force(spark):
    rng = random.Random(8)
    words = sorted({w for _, t in licences.TEMPLATES for w in re.findall(licences.TERM, t.lower())}) + [f"q{c}" for c in "abcdefgh"]
    texts = ["\n".join(" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(3)) for _ in range(60)]
    texts += ["\n".join(" ".join(t.split()[: rng.randrange(4, 40)]) for _, t in rng.choices(licences.TEMPLATES, k=2)) for _ in range(60)]
    rows = licences.templates(spark).collect()
    lines = [x for t in texts for x in t.split("\n")]
    terms = lambda t: collections.Counter(re.findall(licences.TERM, t.lower()))
    df = collections.Counter(w for x in lines for w in terms(x))
    known = {w for r in rows for w in terms(r.text)}
    idf = {w: np.log(1 + len(lines) / max(1, df[w])) for w in known}
    mean = np.mean(list(idf.values()))
    vector = lambda t: {w: (1 + np.log(k)) * idf.get(w, mean) for w, k in terms(t).items()}
    norm = lambda v: np.sqrt(sum(x * x for x in v.values()))
    found, own = licences.line_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"), sorted(known)), {}
    assert found == ({w: n for w, n in df.items() if w in known}, len(lines))
    weights = licences.Weights(rows, *found, 0.6)
    for x in lines:
        v = vector(x)
        scores = [(sum(v[w] * u.get(w, 0) for w in v) / norm(v) / norm(u), -r.template, r.licence) for r in rows for u in [vector(r.text)]]
        said = set(licences._version(x))
        fits = [s for s in scores if s[0] >= 0.6 and not (said and (own_v := set(licences._version(rows[-s[1]].text))) and not said & own_v)]
        own[x] = max(fits)[2] if fits else None
        assert not any(s[0] >= 0.6 for s in scores) or set(v) & set(weights.needed)  # the filter loses nothing
    once = spark.createDataFrame([(k, x) for k, x in enumerate(dict.fromkeys(lines))], "s long, segment string")
    got = {r.s: r.licence for r in licences.matched(once, licences.templates(spark), weights, 0.6).collect()}
    assert [got.get(k) for k in range(len(own))] == list(own.values())
    assert sum(v is not None for v in own.values()) > 30


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><nav><a href=/>menu</a></nav><header>Site</header>
<div id="cookie-notice">We use cookies</div><aside>side</aside><article class=post><h1>Head &amp; line</h1><p>One <b>two</b>
  three<p>four<br>five <ul><li>six<li>seven</ul><div class="ad-box">buy</div><form><input>send</form>%s</article>
<section id=comments><p>first!</p></section><footer>foot</footer><script>if (a < b) "</p>"</script></body></html>"""


def test_main_text_of_mixed_templates_and_class_names(spark):
    pages = [
        ("http://m/1", "<body><article><p>In an article</p></article><div>beside</div></body>", "In an article"),
        ("http://m/2", "<body><nav>menu</nav><div><p>No article here</p></div></body>", "No article here"),
        ("http://n/1", "<html class='js no-sidebar'><body class='no-sidebar'><p>Plain</p></body></html>", "Plain"),
        ("http://o/1", "<body class='has-comments'><article class='post social-media'><p>Social</p><div class='comments'>c</div></article></body>", "Social"),
        ("http://p/1", "<body><main class='has-sidebar'><article class='post has-comments'>Nested</article></main></body>", "Nested"),
        ("http://q/1", "<body><article class='post'>Post</article><article class='comment'>Reply</article></body>", "Post"),
        ("http://r/1", "<body><article class='sponsored'>Paid</article><div>beside</div></body>", "Paid"),
        ("http://s/1", "<body><div id='main' class='with-sidebar'>Wide</div><div class='sidebar'>side</div></body>", "Wide"),
        (None, "<main>One</main>", "One"),
        (None, "<p>Two</p>", "Two"),
    ]
    df = spark.createDataFrame([(k, u, h) for k, (u, h, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got == {k: t for k, (_, _, t) in enumerate(pages)}


def test_main_text(spark):
    want = "Head & line\nOne two three\nfour five\nsix\nseven"
    rows = [(1, "http://h/1", PAGE % ""), (2, "http://h/2", PAGE % "<p>more</p>"), (3, "http://h/3", None), (4, None, "<p>alone</p>"), (5, "http://g/", ""), (6, "http://g/2", "<div>a < b &lt; c</div>"), (6, "http://g/2", "x" * 300000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = [(r.page_id, r.text, r.n_chars) for r in html.extract(df).orderBy("page_id", "n_chars").collect()]
    assert got[:3] == [(1, want, len(want)), (2, want + "\nmore", len(want) + 5), (3, "", 0)]
    assert got[3:] == [(4, "alone", 5), (5, "", 0), (6, "a < b < c", 9), (6, "x" * 300000, 300000)]
    assert html.extract(df.limit(0)).count() == 0


def test_deep_and_wide_pages(spark):
    deep = "<body><article>" + "<div><b>" * 2500 + "core<nav>menu</nav><p>more" + "</b></div>" * 2500 + "<p>end</article></body>"
    wide = "<body><article>" + "".join(f"<h2>t{i}</h2><p>x{i}</p>" + ("<ul><li>y</li></ul>" if i % 7 == 0 else "") for i in range(20_000)) + "</article></body>"
    pages = [(1, "http://a/1", deep), (2, "http://a/2", wide), (3, "http://a/3", wide.replace("<ul>", "<ol>").replace("</ul>", "</ol>")), (4, "http://b/", deep)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == got[4] == "core\nmore\nend"
    assert got[2] == got[3] and got[2].startswith("t0\nx0\ny\nt1\nx1\nt2") and got[2].count("\n") == 40_000 + 2857


def test_class_names_and_constant_slots(spark):
    body = "<body><div class='promo-claim'>Same on all</div><div class='text'><p>Story {0}</p></div><div class='x'>Terms apply</div></body>"
    pages = [(i, f"http://c/{i}", body.format(i)) for i in range(4)]
    pages += [
        (10, "http://d/1", "<body><article class='post social-science'><div class='tags-of-life'><p>Kept</p></div><div class='ad-box'>buy</div><div class='has-sidebar'>Too</div></article></body>"),
        (11, "http://e/1", "<body><div class='x'>One page only</div></body>"),
        (12, "http://f/1", "<body><div class='page-wrap'>Copy</div></body>"), (13, "http://f/2", "<body><div class='page-wrap'>Copy</div></body>"),
    ]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(4)] == [f"Story {i}" for i in range(4)]
    assert got[10] == "Kept\nToo" and got[11] == "One page only" and got[12] == got[13] == "Copy"


def test_wrapper_has_repeats_and_optionals():
    assert html.expression(html.tree("<dl><dt>a<dd>b<dt>c<dd>d</dl>")) == "dl((dt(#)dd(#))+)"
    one, two = html.tree("<ul><li>a<li>b</ul><p>x"), html.tree("<ul><li>a</ul><h2>t</h2><p>x")
    assert html.expression(html._align(one, two)) == "ul(li+(#))h2?(#)p(#)"


def test_url_rules_and_verdicts(spark):
    cases = [
        ("HTTP://Ex.Example.NET/en/x?y", "ex.example.net", "/en/x", "example.net/en/", "allow"), ("http://a.example.net/fr/", "a.example.net", "/fr/", "net/", "block"),
        ("http://b.example.com/de/", "b.example.com", "/de/", "example.com/de/", "block"), ("https://c.org/fr/p", "c.org", "/fr/p", "org/fr/", "allow"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, None), ("abc", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
        ("x?://b.org/fr/", "b.org", "/fr/", "org/fr/", "allow"), ("http://a\n.com/b\nc", "a\n.com", "/b\nc", None, None),
    ]
    rows = [(i, c[0], "clash") for i, c in enumerate(cases)] + [(100 + i, f"http://{'free-casino' if i % 2 else 'news'}{i}.example.com/en/{i}", "clash") for i in range(120)]
    out = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, label string"), trees=3).collect()}
    assert len(out) == len(rows)
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule)
        assert out[i].verdict == verdict if verdict else out[i].verdict in ("allow", "block")
    assert np.mean([(out[100 + i].verdict == "block") == bool(i % 2) for i in range(120)]) > 0.9
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_warc_round_trip_with_false_starts(spark):
    evil = "x" * 50 + "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" + "é" * 90 + "WARC/1.1\r\n"
    rows = [(i, f"http://a/{i}", f"p{i % 7} " * 60 if i % 3 else evil if i % 2 else None) for i in range(40)]
    rows += [(100, None, ""), (101, "u v", "tiny"), (102, "u", "tiny"), (103, "u", "WARC/1.1\r\n" * 30), (104, "u", "long " * 50000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    path = tempfile.mkdtemp(prefix="spark-") + "/w"
    warc.write_warc(df.repartition(3), path, records_per_file=10)
    got = {r.page_id: r for r in warc.read_warc(spark, path).collect()}
    first: dict[bytes, int] = {}
    for i, _, h in rows:
        first.setdefault((h or "").encode(), i)
    assert len(got) == len(rows)
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and first[raw] != i
        want = ("revisit" if again else "response", first[raw] if again else None, len(raw), hashlib.sha256(raw).hexdigest(), True)
        assert (got[i].record_type, got[i].refers_to, got[i].payload_bytes, got[i].payload_digest, got[i].intact) == want


def test_warc_of_a_payload_that_most_pages_share(spark, monkeypatch):
    monkeypatch.setattr(warc, "crowded", lambda sizes, key: linking.crowded(sizes, key, crowd=10))
    rows = [(i, "http://a/", "same " * 40 if i % 3 else f"page {i} " * 30) for i in range(5, 200)] + [(5, "http://a/", "same " * 40)]
    path = tempfile.mkdtemp(prefix="spark-") + "/w"
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_digest, r.intact) for r in warc.read_warc(spark, path).collect())
    digest = lambda h: hashlib.sha256(h.encode()).hexdigest()
    want = sorted((i, "revisit" if i % 3 and i > 5 else "response", 5 if i % 3 and i > 5 else None, digest(h), True) for i, _, h in rows)
    assert [tuple("" if v is None else v for v in g) for g in got] == [tuple("" if v is None else v for v in w) for w in want]


def test_licences_below_a_crowded_root(spark, monkeypatch):
    monkeypatch.setattr(licences, "crowded", lambda sizes, key: linking.crowded(sizes, key, crowd=10))
    known = licences.templates(spark)
    mit = next(r.text for r in known.collect() if r.licence == "MIT")
    header = "SPDX-License-Identifier: Apache-2.0"
    rows = [("LICENSE", mit)] + [(f"d{i % 5}/f{i}.txt", header if i % 3 == 0 else "nothing of the kind") for i in range(90)]
    got = {r.path: (r.licence, r.via, r.origin) for r in licences.scan(spark.createDataFrame(rows, "path string, text string"), known).collect()}
    assert got == {p: ("MIT", "own", p) if p == "LICENSE" else ("Apache-2.0", "own", p) if t == header else ("MIT", "inherited", "LICENSE") for p, t in rows}


def test_toxicity_of_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "vile word"), (1, "vile word"), (1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = [r.score for r in toxicity.score(docs, model).orderBy(F.desc("text")).collect()]
    assert got == [0.0] * 3  # nothing was learned, so nothing is toxic
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


@pytest.mark.parametrize("labelled", [[], [(3, 1)], [(3, 0), (4, 0)], [(k, 1) for k in range(20)]])
def test_toxicity_without_both_classes_calls_nothing_toxic(spark, labelled):
    docs = spark.createDataFrame([(i, f"clean words number {i}") for i in range(20)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labelled, "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}


def test_neighbours_of_multiples_are_ties(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=8)
    rows = [(100 + i, (base * (1 + (i * 7) % 20)).tolist()) for i in range(20)] + [(i, rng.normal(size=8).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    ask = df.where("vec_id in (100, 103, 119)").select(F.col("vec_id").alias("query_id"))
    got = neighbours.nearest(df, ask, leaf_rows=15, block_rows=4).orderBy("query_id", "rank").collect()
    for q in (100, 103, 119):
        assert [r.vec_id for r in got if r.query_id == q] == [i for i in range(100, 107) if i != q][:5]


def test_neighbours_of_repeated_ids_take_the_least_vector(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = spark.createDataFrame([(2,), (2,), (None,)], "query_id long")
    for d in (df, df.repartition(5)):
        assert [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(d, ask).orderBy("rank").collect()] == [(2, 1, 1, 1.0), (2, 2, 3, 0.0)]


def rule_by_hand(url, rules=urls.RULES):
    """Host, path, rule and verdict, character by character."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        while rest and rest[0] not in "/?#":
            host, rest = host + (rest[0].lower() if "A" <= rest[0] <= "Z" else rest[0]), rest[1:]
        while rest and rest[0] not in "?#":
            path, rest = path + rest[0], rest[1:]
    labels = host.split(".")
    fits = [(len(h + p), h + p, v) for h, p, v in rules if labels[-len(h.split(".")) :] == h.split(".") and path[: len(p)] == p]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def test_url_rules_equal_a_walk_over_characters(spark):
    rng = random.Random(6)
    parts = ["http", "://", "://", "/", "?", "#", ".", "example", "net", "com", "org", "EXAMPLE", "en/", "de/", "fr/", "a", "-", "é", "\n", "%20", ":80", "@", " "]
    every = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(300)]
    every += [f"http://{h}/{p}" for h in ("example.net", "x.example.net", "example.com", "q.org", "netx", "example.net.") for p in ("", "en/", "de/x", "fr/")]
    every += [None, "http://long.org/" + "fr/" * 30_000, "http://" + "a." * 20_000 + "net/en/"] + ["http://same.org/fr/"] * 3
    df = spark.createDataFrame([(k if k % 50 else None, u) for k, u in enumerate(every)], "page_id long, url string")
    got = collections.Counter((r.page_id, r.host, r.path, r.rule) for r in urls.judge(df, trees=2).collect())
    assert got == collections.Counter((k if k % 50 else None, *rule_by_hand(u)[:3]) for k, u in enumerate(every))


def test_urls_of_one_class(spark):
    df = spark.createDataFrame([(k, f"http://plain{k}.example/x") for k in range(30)], "page_id long, url string")
    assert {r.verdict for r in urls.judge(df).collect()} == {"allow"}


def test_warc_of_empty_null_and_repeated_ids(spark):
    def back(rows):
        path = tempfile.mkdtemp(prefix="spark-") + "/w"
        warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
        return collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_warc(spark, path).collect())

    assert back([]) == {}
    text = "y" * 200
    assert back([(None, "u", "z"), (3, "u", text), (3, "u", text), (4, "v", text), (4, "v", "short")]) == collections.Counter(
        [(None, "response", None, 1), (3, "response", None, 200), (3, "response", None, 200), (4, "revisit", 3, 200), (4, "response", None, 5)]
    )


def test_neighbours_visit_leaves_in_the_order_of_the_queue_and_routes_stay_small(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 16))
    tree = neighbours.Tree(neighbours._unit(pd.Series(list(v))), 20, 5, 1)
    asked = neighbours._unit(pd.Series(list(rng.normal(size=(40, 16)))))
    for visits in (1, 7, 60, tree.leaves, tree.leaves + 5):
        for u, leaves in zip(asked, tree.first(asked, visits), strict=True):
            walked = list(tree.walk(u))[:visits]
            assert leaves[0] == walked[0]
            assert sorted(leaves) == sorted(walked)
    # a query's vector is sent once a block, not once a leaf that it visits
    frames = type(spark.range(1))
    sent, route = [], frames.mapInPandas

    def watched(df, fn, schema):
        out = route(df, fn, schema)
        if "leaves" in str(schema):
            sent.append(out.count())
        return out

    monkeypatch.setattr(frames, "mapInPandas", watched)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    ask = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"))
    got = neighbours.nearest(df, ask, leaf_rows=20).collect()
    assert sent and sent[0] <= 60 * 4 + 60  # 3 blocks or 4, and the first leaf by itself; there are over 150 leaves
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    best = {q: set(np.argsort(-np.where(np.arange(3000) == q, -2, u @ u[q]))[:5].tolist()) for q in range(0, 3000, 50)}
    assert len(got) == 300 and sum(r.vec_id in best[r.query_id] for r in got) >= 0.9 * 300
