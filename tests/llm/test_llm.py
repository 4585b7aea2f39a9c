"""The corpus operators against brute-force versions, with nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import os
import random
import re
import string
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from genolith.llm import bpe, html, licenses, mixing, queries, shingles, tokenstore
from genolith.llm.embeddings import near_vectors
from genolith.llm.graph import components
from genolith.llm.lines import dedup_lines
from genolith.llm.neardup import near_duplicates
from genolith.llm.quality import quality
from genolith.llm.urls import RULES, rule_table, url_filter

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    base = words(120, 1)
    lines = [words(60, 50 + i) for i in range(3)]
    rows = [
        (1, base, "en", "a", 1), (2, base.upper(), None, "a", 1), (3, base.replace("w1 ", "x "), "en", None, 1), (4, None, "en", "b", None), (5, "", "de", "b", 0), (6, " \n\t", "de", "b", 3),
        (7, "one two three", "de", "c", 1), (8, "one two three", "de", "c", 1), (9, words(4000, 9, 5000), "fr", "c", 1), (10, "\n".join([*lines, "tail of ten"]), "en", "a", 1),
        (11, "\n".join(["head", *lines[1:], "other tail"]), "en", "a", 1), (12, "\n".join([lines[0], lines[0]]), "en", "a", 1), (None, base, "en", "a", 1), (13, "aaa bbb ccc ddd eee " * 30, "en", "a", 1),
        (14, "### $$$ %% | a & b <c>", "en", "a", 1), (15, "Released under the MIT License.\nAll rights reserved.", "en", "a", 1), (1, base, "en", "a", 1), (16, words(300, 16), "en", "a", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (9, 1, 0), (16, 1, 1), (14, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def rows_of(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_quality(spark, corpus, labels):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    odd = corpus.selectExpr("*", "1 as kept", "'x' as n_words")
    out = quality(odd, labels).collect()
    assert len(out) == 18
    for r in out:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        some = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(some) - len(set(some)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert tuple(r[n] for n in names) == want
        assert isinstance(r.kept, bool) and not (r.kept and r.base_failed)
    assert 9 in {r.doc_id for r in out if r.kept}
    assert quality(corpus.where("false"), labels).count() == 0
    assert all(r.score == 0 for r in quality(corpus, labels.where("false")).collect())


def test_quality_score_against_brute_force(spark, corpus, labels):
    """Bucket counts, log ratios, mean score and verdict, by plain dictionaries."""
    import math
    import struct

    import xxhash

    from genolith.llm.quality import BUCKETS, MIN_SCORE

    def grams(text):
        h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        pairs = [xxhash.xxh64(struct.pack("<Q", b), seed=xxhash.xxh64(struct.pack("<Q", a), seed=42).intdigest()).intdigest() for a, b in zip(h, h[1:], strict=False)]
        return [(x - (1 << 64) if x >> 63 else x) % BUCKETS for x in h + pairs]

    extra = spark.createDataFrame([(100 + i, words(80, 700 + i, 40 + 300 * (i % 2)), "en", "a", 1) for i in range(30)], DOCS)
    good = labels.unionByName(spark.createDataFrame([(100 + i, 1, 0) for i in range(0, 10, 2)], labels.schema))
    docs = corpus.unionByName(extra)
    rows, trusted = docs.collect(), {r.doc_id for r in good.collect() if r.quality == 1 and not r.toxic and r.doc_id is not None}
    raw, target = collections.Counter(), collections.Counter()
    for r in rows:
        raw.update(grams(r.text))
        if r.doc_id in trusted:
            target.update(grams(r.text))
    a, z = math.log(sum(raw.values()) + BUCKETS), math.log(sum(target.values()) + BUCKETS)
    ratio = [math.log(target[b] + 1) - z - math.log(raw[b] + 1) + a for b in range(BUCKETS)]
    verdicts = set()
    for r in quality(docs, good).collect():
        g = grams(r.text)
        score = sum(ratio[b] for b in g) / max(1, len(g))
        assert r.score == pytest.approx(score, abs=1e-9) and r.kept == (not r.base_failed and score >= MIN_SCORE)
        verdicts.add(r.kept)
    assert verdicts == {True, False}


def test_urls(spark):
    urls = ["http://A.example.org/es/x?q", "https://example.org/en/12#f", "http://m.shop.com/fr/", "http://x.com/de", "http://com/de/1", "nothing", None, "http://example.org", "ftp://badexample.org/es/", "http://host.net?x=/fr/"] + ["http://hot.org/a"] * 300
    pages = spark.createDataFrame([(i if i != 3 else None, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string")
    out = url_filter(pages, rule_table(spark, RULES), ranges=16, sample=64).collect()
    assert len(out) == len(urls)

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        host = "".join(c.lower() if c in string.ascii_uppercase else c for c in host)
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    want = collections.Counter((i if i != 3 else None, *judge(u)) for i, u in enumerate(urls))
    assert collections.Counter(tuple(r) for r in out) == want
    assert url_filter(pages.where("false"), rule_table(spark, RULES)).count() == 0
    assert {r.rule for r in url_filter(pages, rule_table(spark, RULES).where("false")).collect()} == {None}


def test_licenses(spark, corpus):
    got = {r.doc_id: r for r in licenses.scan(corpus).where("doc_id >= 14").collect()}
    assert got[15].licenses == "MIT,Proprietary" and got[15].n_known == 2 and got[14].licenses == ""
    s = licenses.SENTENCES
    notice = f"{s['mit-title']}.\n{s['mit-grant']}.\n{s['mit-keep']}. {s['asis']}."
    apart = f"{s['apache2-notice']}\nsomething else\n{s['apache2-comply']}"
    df = spark.createDataFrame([(1, notice), (2, apart), (None, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert out[1].licenses == "MIT" and out[1].n_known == 4
    assert out[2].sequence == "<apache2-notice>|<apache2-comply>" and out[None].licenses == ""
    assert licenses.scan(df.where("false")).count() == 0


def test_licenses_wrapped(spark):
    mit = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
    bsd = """All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
%s Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

%s Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
    gpl = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty"""
    isc = "Permission to use, copy, modify, and/or distribute this software for any\r\npurpose with or without fee is hereby granted, provided that the above\r\ncopyright notice and this permission notice appear in all copies."
    texts = [mit, bsd % ("1.", "2."), bsd % ("*", "*"), gpl, isc, mit.replace("\n\n", "|").replace("\n", " ").replace("|", "\n"), "released under\n\nthe mit license", "we are not released under the\nmit license", "Released under the MIT License\nand more text"]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].licenses for i in range(9)] == ["MIT", "BSD-2-Clause,Proprietary", "BSD-2-Clause,Proprietary", "GPL-3.0-or-later", "ISC", "MIT", "", "", "MIT"]
    assert got[0].sequence == got[5].sequence == "<mit-grant><mit-keep><asis>" and got[1].sequence == got[2].sequence == "<reserved><bsd-grant><bsd-source><bsd-binary>"


def test_licenses_of_real_notices(spark):
    free = "This %s is free software; you can redistribute it and/or\nmodify it under the terms of the GNU %s\nas published by the Free Software Foundation; either\nversion %s of the License, or (at your option) any later version."
    bsd3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the %s nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this file,\nYou can obtain one at http://mozilla.org/MPL/2.0/."
    cases = {
        "This project is licensed under the MIT License.": "MIT", "Distributed under the MIT License\n": "MIT", "This work is licensed under the GNU General Public License version 3": "GPL-3.0",
        "This tiny little tool is released under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under the BSD 3-Clause License": "BSD-3-Clause", "This is licensed under the ISC license": "",
        free % ("program", "General Public License", "2"): "GPL-2.0-or-later", free % ("program", "Affero General Public License", "3"): "AGPL-3.0-or-later", free % ("library", "Lesser General Public License", "2.1"): "LGPL-2.1-or-later",
        bsd3 % "copyright holder": "BSD-3-Clause", bsd3 % "University of Nowhere at\n   Large": "BSD-3-Clause", mpl: "MPL-2.0", "no licence " * 20_000: "", "the mit license is nice": "",
    }
    rows = [(i, t, "x") for i, t in enumerate(cases)] * 2  # repeated rows, a long text and a column with the name of a result
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, licenses string")).collect()
    assert len(got) == len(rows)
    want = list(cases.values())
    assert {r.doc_id: r.licenses for r in got} == dict(enumerate(want))


def page(body, cls="post-12 content"):
    return f'<html><body><nav><a href=x>menu</a></nav><div class="{cls}"><h2>T&eacute;st &lt;x&gt;</h2><p>{body} one<br>two &nbsp; three<p>four<ul><li>i1<li>i2</ul><div class="comments"><p>hi</p></div> tail a < b</div><div class="sidebar"><p>side text that is really rather long, longer than all the rest of this page taken together, so it is tempting</div><script>if(a<b){{}}</script></body>'


def test_html(spark):
    rows = [(i, f"http://h.org/{i}", page("body text " * 12, f"post-{i} content")) for i in range(5)] + [(5, None, page("x")), (6, "http://h.org/6", None), (None, "http://h.org/7", "<p>loose & text &amp; more &am"), (8, "http://h.org/8", "")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 9 and by[0].text.split("\n")[0] == "Tést <x>"
    for i in range(5):
        assert by[i].text.endswith("one two three\nfour\ni1\ni2\ntail a < b") and "menu" not in by[i].text and "hi" not in by[i].text and by[i].n_chars == len(by[i].text)
    assert by[6].text == by[8].text == "" and by[None].text == "loose & text & more &am"
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_keeps_the_whole_article(spark):
    long, lead = "a rather long sentence of the body " * 12, "the lead paragraph of this page"
    items = "".join(f"<li>{long}</li>" for _ in range(9))
    cells = "".join(f"<tr><td>{long}</td><td>{i}</td></tr>" for i in range(9))
    menu, foot = "<nav><ul><li><a href=x>menu</a></li></ul></nav>", '<div class="sidebar"><p>side text</p></div><footer>imprint of the host</footer>'
    bodies = {
        "list": f"<article><h1>head</h1><p>{lead}</p><ul>{items}</ul><p>the end</p></article>",
        "table": f"<main><h1>head</h1><p>{lead}</p><table>{cells}</table><p>the end</p></main>",
        "inner": f'<article><h1>head</h1><p>{lead}</p><div class="entry"><p>{long}</p><p>{long}</p></div><p>the end</p></article>',
        "entry": f'<div class="x"><h1>head</h1><p>{lead}</p><div class="entry"><p>{long}</p><p>{long}</p></div><div class="share">tweet</div><p>the end</p></div>',
        "sections": f'<div class="x"><h1>head</h1><section class="one"><p>{lead}</p><p>{long}{long}{long}</p></section><section class="two"><p>{long}{long}</p><p>the end</p></section></div>',
    }
    rows = [(i, f"http://{k}.org/{i}", f"<html><body>{menu}{b}{foot}</body></html>") for i, (k, b) in enumerate(bodies.items())]
    rows += [(10 + i, f"http://host.org/{i}", rows[3][2]) for i in range(4)] + [(20, None, rows[3][2])]
    for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got = r.text.split("\n")
        assert got[:2] == ["head", lead] and got[-1] == "the end", r.url
        assert long.strip() in r.text and not {"menu", "side text", "imprint of the host", "tweet"} & set(got)


def test_html_knows_boilerplate_by_whole_names(spark):
    text = "A sentence of the article that goes on for a while, with commas. "
    keep = ["related-work", "comment-on-law", "ad-free note", "relatedWork", "share-price-history", "entry-content", "story"]
    drop = ["comments", "comment-list", "cookie-banner", "cookieBanner", "ad-slot", "social_share", "site-footer", "post-comments", "sidebar", "newsletter-box", "related"]
    rows = []
    for i, name in enumerate([*keep, *drop]):
        rows.append((i, f"http://h{i}.org/", f'<html><body><article><h1>T</h1><p>{text * 4}</p><div class="{name}"><p>inside {text}</p></div></article></body></html>', "x", 5))
    rows += [rows[0], (90, "http://h90.org/", "<p>" + text * 20_000 + "</p>", "x", 5)]  # a repeated row, a long page, names of results as extra columns
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, path int")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert ("inside" in r.text) == (r.page_id < len(keep)) and r.n_chars == len(r.text)
    assert next(r.n_chars for r in got if r.page_id == 90) == len((text * 20_000).strip())


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(12, 8))
    x = [(b + rng.normal(size=8) * 0.12).tolist() for b in base for _ in range(12)]
    rows = [(i, v) for i, v in enumerate(x)] + [(500, x[0]), (501, [2 * c for c in x[0]]), (502, None), (503, [0.0] * 8), (504, [float("nan")] * 8), (505, [None, *x[1][1:]]), (506, []), (507, x[3][:5]), (None, x[0]), (508, [1e-30 * c for c in x[0]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: [j for j, b in good if i != j and len(a) == len(b) and (a / np.abs(a).max()) @ (b / np.abs(b).max()) / np.linalg.norm(a / np.abs(a).max()) / np.linalg.norm(b / np.abs(b).max()) >= 0.95 - 1e-15] for i, a in good}
    comp = {i: i for i, _ in rows if i is not None}
    for _ in range(len(rows)):
        for i, js in links.items():
            comp[i] = min([comp[i], *(comp[j] for j in js)])
    for cell, block in ((20, 7), (4096, 2048)):
        got = {r.vec_id: tuple(r)[1:] for r in near_vectors(df, cell=cell, block=block).collect()}
        assert got.pop(None) == (0, None, True)
        assert got == {i: (len(links.get(i, [])), comp[i], comp[i] == i) for i in comp}
    assert near_vectors(df.where("false")).count() == 0


def test_embedding_chains(spark):
    # 30 arcs in planes of their own, each a chain of 20 vectors of which only neighbours link; tiles have over 256 rows on side a
    order = np.random.default_rng(4).permutation(600).tolist()
    rows, want = [], {}
    for k in range(30):
        ids = order[20 * k : 20 * k + 20]
        for n, i in enumerate(ids):
            v = [0.0] * 60
            v[2 * k], v[2 * k + 1] = float(np.cos(0.16 * n)), float(np.sin(0.16 * n))
            rows.append((i, v))
            want[i] = (1 if n in (0, 19) else 2, min(ids), i == min(ids))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (2048, 300):  # one tile of its own rows; tiles with two sides
        assert {r.vec_id: tuple(r)[1:] for r in near_vectors(df, block=block).collect()} == want


def brute_lines(docs, least=50):
    """(key, text) in order -> text without later runs."""
    cut = {d: [(i, x.strip(" \t\r\x0b\x0c"), len(x.split())) for i, x in enumerate(t.split("\n"))] for d, t in docs}
    cut = {d: [x for x in v if x[2]] for d, v in cut.items()}
    first, out = {}, {}
    for d, t in docs:
        mine, gone, diagonals = cut[d], set(), set()
        for i in range(len(mine)):
            n, j = 0, i
            while j < len(mine) and n < least:
                n, j = n + mine[j][2], j + 1
            if n < least:
                break
            key = tuple(x[1] for x in mine[i:j])
            if key in first:
                diagonals.add((first[key][0], first[key][1] - i))
            else:
                first[key] = (d, i)
        for a, shift in diagonals:
            run = []
            for i in [*range(len(mine)), None]:
                if i is not None and 0 <= i + shift < len(cut[a]) and cut[a][i + shift][1] == mine[i][1]:
                    run.append(i)
                    continue
                if sum(mine[k][2] for k in run) >= least:
                    gone.update(range(mine[run[0]][0], mine[run[-1]][0] + 1))
                run = []
        out[d] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
    return out


def test_line_dedup(spark, corpus):
    docs = sorted({(r.doc_id, r.text) for r in corpus.collect() if r.doc_id is not None and r.text is not None})
    want = brute_lines(docs)
    got = dedup_lines(corpus.selectExpr("*", "7 as n_lines")).collect()
    assert len(got) == 18
    for r in got:
        if r.doc_id is not None and r.text is not None:
            assert r.text == want[r.doc_id]
    null = [r for r in got if r.doc_id == 4][0]
    assert null.text is None and (null.n_lines, null.n_removed) == (0, 0)
    assert [r.text for r in got if r.doc_id is None] == [""]  # a copy without a key comes last
    far = {(r.doc_id, r.text) for r in dedup_lines(corpus, max_broadcast=0).collect()}
    assert far == {(r.doc_id, r.text) for r in got}
    assert dedup_lines(corpus.where("false")).count() == 0


def brute_runs(docs, least=50):
    """(key, text) in order -> text without the runs of least words that occurred at any earlier place."""
    cut = {d: [(i, x.strip(" \t\r\x0b\x0c"), len(x.split())) for i, x in enumerate(t.split("\n")) if x.split()] for d, t in docs}
    starts = collections.defaultdict(list)  # line -> earlier places
    out = {}
    for d, t in docs:
        mine, gone = cut[d], set()
        for i, line in enumerate(mine):
            for a, j in starts[line[1]]:
                n = 0
                while i + n < len(mine) and j + n < len(cut[a]) and mine[i + n][1] == cut[a][j + n][1]:
                    n += 1
                if sum(x[2] for x in mine[i : i + n]) >= least:
                    gone.update(range(mine[i][0], mine[i + n - 1][0] + 1))
            starts[line[1]].append((d, i))
        out[d] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
    return out


def test_line_dedup_meets_every_earlier_document(spark):
    p, t, a, b, c = words(55, 201), words(40, 202), words(60, 203), words(60, 204), words(60, 205)
    docs = [(1, f"{p}\n{a}"), (2, f"{p}\n{t}\n{b}"), (3, f"{p}\n\n{t}\n{c}"), (4, f"{t}\n{p}\n \n{a}"), (5, f"{b}\n{t}\n{p}\n\n{a}\n{c}")]
    want = brute_runs(docs)
    assert want[3] == c and want[2] == f"{t}\n{b}"
    assert {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want
    rng = random.Random(8)
    pool = [words(n, 300 + n) for n in (1, 5, 9, 14, 20, 26, 33, 40, 48, 50, 55, 70)] + ["", " \t"]
    docs = [(i, "\n".join(rng.choices(pool, k=rng.randrange(1, 14)))) for i in range(150)]
    for least in (50, 90):
        got = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), min_words=least).collect()
        assert {r.doc_id: r.text for r in got} == brute_runs(docs, least)
        assert all(r.n_removed == r.n_lines - len(r.text.split("\n")) or r.text == "" for r in got)


def brute_near(docs):
    t = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    sets = {}
    for d, x in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {d: d for d in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return {d: (len(s), comp[d], comp[d] == d) for d, s in sets.items()}


def test_line_dedup_of_many_equal_lines(spark):
    same = "\n".join(["one line of six words here"] * 20_000)
    docs = [(1, same, 1, 2, 3, 4), (2, "\n".join(["head", *["one line of six words here"] * 20, "tail"]), 1, 2, 3, 4), (3, "unlike " * 60, 1, 2, 3, 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string, d int, _d int, _runs int, _left int")  # names used inside
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert got[1].text == "one line of six words here" and got[1].n_lines == 20_000  # a run may overlap the earlier one that it equals
    assert got[2].text == "head\ntail" and got[3].text == docs[2][1] and got[3]._left == 4 and got[3].d == 1


def test_near_duplicates_of_all_degrees(spark):
    """A large group whose members differ by little to much, against all pairs."""
    rng = random.Random(11)
    base = words(160, 77, 5000).split()
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w[: rng.choice([160, 160, 150, 130])])))
    rows += [(500, rows[3][1]), (501, rows[3][1])]

    def shingle(t):
        w = t.split()
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)}

    sets, parent = {k: shingle(t) for k, t in rows}, {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: find(k) for k in sets} and 3 < len(set(got.values())) < 160


def test_near_duplicates(spark, corpus):
    rng = random.Random(5)
    base = words(150, 77).split()
    near = []
    for i in range(60):  # a group of near copies of all degrees
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(150)] = f"z{rng.randrange(999)}"
        near.append((100 + i, " ".join(w)))
    df = corpus.select("doc_id", "text").where("doc_id is not null").dropDuplicates().unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    want = brute_near([tuple(r) for r in df.collect()])
    for limit in (1_000_000, 0):
        assert {r.doc_id: tuple(r)[1:] for r in near_duplicates(df, max_broadcast=limit).collect()} == want
    odd = near_duplicates(corpus.selectExpr("*", "1 as n", "2 as f1")).collect()
    assert len(odd) == 18 and [tuple(r)[2:] for r in odd if r.doc_id is None] == [(None, True)]
    assert [tuple(r)[2:] for r in odd if r.doc_id == 1] == [(1, True)] * 2
    assert near_duplicates(corpus.where("false")).count() == 0


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    pool = shingles.mix(np.arange(1, 4000, dtype=np.uint64))
    sets = [np.sort(pool[:n]) for n in (1, 2, 50, 1000)] + [np.zeros(0, np.uint64), np.sort(pool[250:1250])]
    s = shingles.sketches(sets, 256)
    assert (s[:4] != np.iinfo(np.uint64).max).all() and (s[4] == np.iinfo(np.uint64).max).all()
    assert abs((s[3] == s[5]).mean() - 0.6) < 0.12 and rng is not None


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 999), (5, 5), (None, 3), (7, 6)]
    got = dict(rows_of(components(spark.createDataFrame(chain, "a long, b long").repartition(5)), "node", "component"))
    assert got == {**{i: 0 for i in range(201)}, 999: 999, 1000: 999}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def raked(start, goals, rounds=500):
    """Iterative proportional fitting of {cell: weight} to {margin: {value: share}}, by hand."""
    w = {c: x / sum(start.values()) for c, x in start.items()}
    for _ in range(rounds if goals else 0):
        for m, goal in goals.items():
            now = collections.Counter()
            for c, x in w.items():
                now[c[m]] += x
            w = {c: x * goal.get(c[m], 0) / now[c[m]] if now[c[m]] else x for c, x in w.items()}
    return w


def all_targets(cells, named):
    """Named margins, and for the others those of the flattened cells raked to the named ones."""
    flat = raked({c: n**mixing.FLATTEN for c, n in cells.items()}, named)
    out = dict(named)
    for m in range(3):
        if m not in out:
            t = collections.Counter()
            for c, x in flat.items():
                t[c[m]] += x
            out[m] = dict(t)
    return out


def test_mixing(spark, corpus):
    out = mixing.mix(corpus.selectExpr("*", "'x' as topic"), keep=0.5).collect()
    assert len(out) == 18 and all(0 <= r.probability <= 1 for r in out) and not any(r.kept for r in out if not (r.text or "").split())
    assert mixing.mix(corpus.where("false")).count() == 0
    cells = [(s, g, t, n) for (s, g, t), n in zip(((s, g, t) for s in "abc" for g in "xy" for t in "pq"), (500, 20, 30, 400, 90, 10, 60, 200, 5, 70, 300, 15), strict=True)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    total = sum(c[3] for c in cells)

    def margins(p):
        got = {m: collections.Counter() for m in range(3)}
        for *cell, n in cells:
            for m in range(3):
                got[m][cell[m]] += n * p[tuple(cell)]
        kept = sum(got[0].values())
        return kept, {m: {v: x / kept for v, x in c.items()} for m, c in got.items()}

    for wanted, keep in (({"lang": {"x": 0.5, "y": 0.5}}, 0.4), ({"lang": {"x": 0.5, "y": 0.5}, "source": {"a": 0.2, "b": 0.5, "c": 0.3}, "topic": {"p": 0.3, "q": 0.7}}, 0.9), ({}, 0.8)):
        rows = mixing.calibrate(df, wanted, keep).collect()
        p = {tuple(r)[:3]: r.probability for r in rows}
        kept, got = margins(p)
        named = {m: {v: x / sum(wanted[n].values()) for v, x in wanted[n].items()} for m, n in enumerate(mixing.MARGINS) if n in wanted}
        for m, goal in all_targets({tuple(c[:3]): c[3] for c in cells}, named).items():
            assert all(abs(got[m][v] - x) < 2e-6 for v, x in goal.items())
        assert all(0 <= x <= 1 for x in p.values()) and abs(kept / total - rows[0].share) < 1e-6 and rows[0].share <= keep + 1e-9 and rows[0].miss < 2e-6
    even = spark.createDataFrame([(s, g, "p", a * b) for s, a in (("a", 3), ("b", 5)) for g, b in (("x", 20), ("y", 70))], df.schema)  # raked in one round
    near, far = ({tuple(r)[:3]: (r.probability, r.share) for r in mixing.calibrate(even, {"lang": {"x": 0.3, "y": 0.7}}, 0.6, limit).collect()} for limit in (mixing.MAX_LOCAL, 0))
    assert all(np.allclose(near[k], far[k], atol=1e-9) for k in near) and len(far) == 4
    # no table with these cells has such margins
    odd = spark.createDataFrame([("a", "x", "p", 10), ("b", "y", "p", 10)], df.schema)
    assert mixing.calibrate(odd, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}}).first().miss > 0.1
    clash = mixing.mix(corpus.selectExpr("*", "1 as _source", "2 as _lang", "3 as _topic", "4 as kept", "5 as _p"), keep=0.5)
    assert clash.count() == 18 and {"_source", "_lang", "_topic", "_p"} <= set(clash.columns)


def test_mixing_against_brute_force(spark):
    """Raking, scaling and the draw, done again by hand on rows whose topics are fixed by the fitted centres."""
    rng = random.Random(8)
    rows = [(i, words(rng.randrange(1, 60), i), rng.choice(["en", "de", None]), rng.choice("ab"), 1) for i in range(120)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df, {"lang": {"en": 0.4, "de": 0.4, "": 0.2}}, keep=0.5, topics=2)
    got = out.withColumn("draw", F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(17)), F.lit(1 << 52)) / float(1 << 52)).collect()
    cells = collections.Counter()
    for r in got:
        assert r.n_tokens == len(r.text.split()) and r.kept == (r.draw < r.probability)
        cells[r.source or "", r.lang or "", r.topic] += r.n_tokens
    goal = all_targets(cells, {1: {"en": 0.4, "de": 0.4, "": 0.2}})
    w = raked(cells, goal)
    p = {c: x * sum(cells.values()) / cells[c] for c, x in w.items()}
    if max(p.values()) <= 2:  # then no probability is capped at keep = 0.5
        assert all(abs(r.probability - p[r.source or "", r.lang or "", r.topic] / 2) < 1e-6 for r in got)
    else:
        lang = collections.Counter()
        for r in got:
            lang[r.lang or ""] += r.n_tokens * r.probability
        assert all(abs(lang[v] / sum(lang.values()) - x) < 2e-6 for v, x in goal[1].items())


def test_topics_are_fitted_on_all_documents(spark):
    import pyarrow as pa

    texts = [words(40, i) for i in range(60)] + [words(40, i).replace("w", "v") for i in range(12)] + ["", " "]
    rows = [(i % 50 if i % 7 else None, t) for i, t in enumerate(texts)]  # keys repeat or are null
    df = spark.createDataFrame([*rows, (99, None)], "doc_id long, text string")
    centres = mixing.fit_topics(df, topics=2, sample=5)
    x = np.concatenate([v for v, _ in mixing._vectors(pa.array(texts[:-2]))])
    nearest = (x @ centres.T).argmax(axis=1)
    for c in range(2):
        mean = x[nearest == c].sum(axis=0)
        assert np.abs(mean / np.sqrt((mean * mean).sum()) - centres[c]).max() < 1e-3
    assert (mixing.fit_topics(df.repartition(7), topics=2, sample=5) == centres).all()
    assert not mixing.fit_topics(df.where("text is null"), topics=2).any()


@pytest.fixture(scope="module")
def fuzz():
    rng = random.Random(3)
    bits = ["a", "th", "ing", " ", "  ", "'s", "Σ", "ΑΣ", "é", "é", "中", "1", "½", "!", "<|endoftext|>", "<|startoftext|>", " ", " ", "\x85", "\x1c", "\n", "\n\n", "😀", "İ", "ß", "_", "ﬁ", "한", "\u0000", "aaaa"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(1500)] + ["", "x" * 5000, "ab " * 3000]


def test_bpe_is_exact(spark, fuzz):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    df = spark.createDataFrame([(i if i else None, x) for i, x in enumerate(fuzz)] + [(-1, None)], "doc_id long, text string")
    for r in df.select("doc_id").join(bpe.encode(df, path, decode=True), "doc_id").collect():
        ids = t.encode(fuzz[r.doc_id] if r.doc_id >= 0 else "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and r.decoded == t.decode(ids, skip_special_tokens=False)


def test_bpe_is_exact_for_every_code_point():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    t, v = Tokenizer.from_file(path), bpe.Vocabulary(open(path).read())
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x33480), *range(0xE0000, 0xE0200)]]
    usual = [c for c in every if not bpe._UNUSUAL.search(c)]
    assert len(usual) > 30_000
    for form in ("{}", "ab{}1", "a{}\u0323\u0301", "A{0}{0} {0}b"):
        for some in (usual, every[:: 1 if form == "ab{}1" else 7]):
            texts = [form.format(c) for c in some]
            for x, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
                assert np.frombuffer(v.ids(x), "<u4").tolist() == e.ids, ascii(x)


def test_token_store(spark, fuzz, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = [(3 * i, x) for i, x in enumerate(fuzz)] + [(4, None), (None, "null key"), (6, fuzz[2])]
    random.Random(1).shuffle(rows)
    tokenstore.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), str(tmp_path / "s"), path)
    got = sorted(tokenstore.read_tokens(spark, str(tmp_path / "s")).collect(), key=lambda r: r.start)
    assert [r.key for r in got] == sorted((k for k, _ in rows), key=lambda k: -1 if k is None else k)
    at = 0
    texts = dict(rows)
    for r in got:
        ids = [*t.encode(texts[r.key] or "", add_special_tokens=False).ids, 0]
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.start == at and r.n_tokens == len(ids)
        at += len(ids)
    assert sorted(r.key for r in tokenstore.read_tokens(spark, str(tmp_path / "s"), [4, 30]).collect()) == [4, 30]
    tokenstore.write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e"), path)
    assert tokenstore.read_tokens(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    assert sorted(map(str, rows_of(df, *cols))) == sorted(map(str, c.sql(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()))


def test_pipeline_against_brute_force(spark, tmp_path, labels):
    import corpus_pipeline
    from tokenizers import Tokenizer

    lines = [words(70, 900 + i) for i in range(3)]
    near = words(200, 40)
    rows = [(i, words(80 + i, i), "en", "a", 1) for i in range(1, 15)] + [(20, "\n".join(lines), "en", "a", 1), (21, lines[1] + "\n" + words(90, 21), "en", "b", 1), (22, near, "en", "b", 1), (23, near + " end", "en", "b", 1), (24, "too short", "en", "b", 1), (25, None, "en", "b", 1), (26, lines[0], "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r.doc_id for r in quality(docs, labels).where("kept").collect()}
    assert not kept & {24, 25}
    texts = brute_lines(sorted((d, t) for d, t, *_ in rows if d in kept))
    texts = {d: t for d, t in texts.items() if t.split() or not dict((r[0], r[1]) for r in rows)[d].split()}
    verdict = brute_near(sorted(texts.items()))
    texts = {d: t for d, t in texts.items() if verdict[d][2]}
    left = spark.createDataFrame([(d, t, r[2], r[3], r[4]) for d, t in texts.items() for r in rows if r[0] == d], DOCS)
    chosen = {r.doc_id for r in mixing.mix(left).where("kept").collect()}
    t = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    want = {}
    for d in chosen:
        ids = t.encode(texts[d], add_special_tokens=False).ids
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and 26 not in got and 23 not in got and zlib is not None


def test_near_stage_keeps_the_rows_marked_kept(spark):
    import corpus_pipeline

    one, two, three, four = (words(80, 700 + i) for i in range(4))
    rows = [(1, one), (1, two), (2, one + " end"), (3, three), (3, three), (4, three + " end"), (5, four), (6, None), (6, four + " other words"), (None, one), (7, None), (7, "")]
    docs = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in rows], DOCS)
    verdict = near_duplicates(docs, tie="h").join(docs.selectExpr("doc_id as k", "xxhash64(text) as x", "text").distinct(), on=[F.col("doc_id").eqNullSafe(F.col("k")), F.col("h") == F.col("x")])
    want = collections.Counter((r.doc_id, r.text) for r in verdict.where("kept").collect())
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.near_stage(spark, docs, "").collect())
    assert got == want and sum(n for (k, _), n in got.items() if k == 1) == 1
    assert got[3, three] == 2 and got[None, one] == 1 and not {2, 4} & {k for k, _ in got} and sum(n for (k, _), n in got.items() if k == 7) == 1
