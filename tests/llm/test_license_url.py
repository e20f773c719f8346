"""Licence scan on planted notices; URL rules and propagation against DuckDB and plain Python."""

import random

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from cohorta.llm import license_scan as S
from cohorta.llm import url_filter as U
from tests.llm.conftest import SF

PLANTED = {"mit": "Released under the MIT License.", "apache": "Licensed under the Apache License, Version 2.0.",
           "gpl": "This work is licensed under the GNU General Public License, version 3.",
           "cc-by-nc": "Licensed under CC BY-NC 4.0.", "proprietary": "All rights reserved."}


def test_planted_notices_are_found(docs):
    rows = docs.select("doc_id", "text").collect()
    want = {(r.doc_id, f) for r in rows for f, line in PLANTED.items() if line in (r.text or "").split("\n")}
    got = {(r.doc_id, r.family) for r in S.license_scan(docs).collect()}
    assert got == want and want


def test_unknown_class_and_templates():
    rng = random.Random(0)
    prose = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(3, 40))) for _ in range(300)]
    model = S.fit(prose[:200])
    held = prose[200:] + ["Her fishing license expired in spring.", "The rights of all are reserved to the crown.", "The Apache river rose."]
    texts = held + [t for n in S.NOTICES.values() for t in n]
    line, gram = S._grams(pa.array(texts, pa.large_string()))
    p = model.probabilities(line, gram, len(texts))
    best = p.argmax(axis=1)
    templates = S.Templates()
    pairs = S._pairs(pa.array(texts, pa.large_string()))

    def family(i):
        f = S.FAMILIES[best[i]] if best[i] < len(S.FAMILIES) and p[i].max() >= S.MIN_PROBABILITY else None
        return f if f and templates.best(f, pairs[i]) >= S.MIN_TEMPLATE else None

    assert all(family(i) is None for i in range(len(held)))
    want = [f for f, n in S.NOTICES.items() for _ in n]
    assert [family(i) for i in range(len(held), len(texts))] == want


GPL = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:"""
ISC = """# Permission to use, copy, modify, and/or distribute this
# software for any purpose with or without fee is hereby
# granted, provided that the above copyright notice appears."""
TALK = " ".join(f"the w{i % 97} of this work under the general version" for i in range(600))
TEXTS = [
    ("Some words.\n\n" + GPL + "\n\nint main", {"gpl": 3}), (BSD, {"bsd": 0}), (ISC + "\n\nMore.", {"isc": 0}),
    (TALK + " Licensed under the MIT license. " + TALK, {"mit": 0}),
    (TALK + "\n" + GPL.replace("\n", " ") + " " + TALK, {"gpl": 1}),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", {"mit": 0, "apache": 0}),
    ("// SPDX-License-Identifier: (Apache-2.0 OR MIT) AND BSD-3-Clause", {"apache": 0, "mit": 0, "bsd": 0}),
    ("Licensed under the Apache License, Version 2.0 or the MIT license, as you like.", {"apache": 0, "mit": 0}),
    (TALK + "\n\nReleased under the\n\nMIT License.", {}), (TALK, {}),
    ("This program is licensed under the GNU Affero General Public\nLicense, version 3.", {"agpl": 0})]


def test_wrapped_embedded_and_dual_notices(spark, docs):
    own = [(i, text) for i, (text, _) in enumerate(TEXTS)]
    df = spark.createDataFrame(own, "doc_id long, text string").union(docs.select(-F.col("doc_id") - 1, "text"))
    got = {}
    for r in S.license_scan(df).filter("doc_id >= 0").collect():
        assert r.paragraphs == 1 and r.probability >= S.MIN_PROBABILITY and r.template_share >= S.MIN_TEMPLATE
        got.setdefault(r.doc_id, {})[r.family] = r.first_line
    assert [got.get(i, {}) for i in range(len(TEXTS))] == [want for _, want in TEXTS]


def test_license_odd_rows(odd, none):
    assert S.license_scan(odd).count() == 0 and S.license_scan(none).count() == 0


def test_verdicts_equal_duckdb(spark):
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in U.url_verdicts(
        spark.read.parquet(f"{SF}/pages.parquet")).collect())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    cur = con.execute(f"select page_id, host, path, coalesce(rule, ''), verdict from ({U.verdict_sql()})")
    assert got == sorted(cur.fetchall())


PAGES = [
    (1, "http://A.Good.com/x?q#f", '<a href="http://friend.org/a">x</a> <a href=//FRIEND.org>'), (2, "https://b.example.com/en/1", None),
    (3, "https://www.example.com/en/", ""), (4, "http://spam.org", '<a href="http://bad.net/es/1"><a href="http://bad.net/es/2">'),
    (5, "http://bad.net/es/", "<a href='/local'>"), (6, "http://bad.net/es/2", None), (7, None, "<a href='http://x.org/'>"),
    (8, "no scheme", None), (9, "http://x.org?q=/en/", None), (10, "http://com/", None), (11, "http://example.com#/en/", None),
    (12, "http://friend.org/", None), (12, "http://friend.org/", None), (None, "a://net/fr/", None), (13, "http://notexample.com/en/", None),
    (14, "x\ny://bad.net/es/\nz?", None)]


def test_rules_links_and_odd_pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("host", U.F.lit("clash"))
    rows = U.url_verdicts(df).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(PAGES)
    assert got[1] == ("a.good.com", "/x", "com/", "allow") and got[2] == ("b.example.com", "/en/1", "example.com/en/", "block")
    assert got[3][2:] == ("www.example.com/en/", "allow") and got[5][2:] == ("net/es/", "block")
    assert got[7] == ("", "", None, "allow") == got[8]
    assert got[9] == ("x.org", "", None, "allow") and got[10][2] == "com/" and got[11] == ("example.com", "", None, "allow")
    assert got[None][2:] == ("net/fr/", "block") and got[13][2] == "com/" and got[14][:2] == ("bad.net", "/es/\nz")
    assert got[4][2:] == (None, "block")                          # links to blocked hosts only
    assert got[12][2:] == (None, "allow")                         # linked from an allowed host
    assert U.url_verdicts(df.limit(0)).count() == 0


def test_edges_reach_the_domain_from_any_depth(spark):
    hosts = ["a.b.c.d.e.f.g.evil.net", "x.y.org", "y.org", "org", "p..q.r.s", ".l.m.n", "t.u.v.", "i\nj.k.l.m", "i.j\nk.l.m"]
    got = {(r.src, r.dst) for r in U.ancestors(spark.createDataFrame([(h,) for h in hosts], "src string")).collect()}
    deep = "a.b.c.d.e.f.g.evil.net".split(".")
    want = {(".".join(deep[k:]), ".".join(deep[k + 1:])) for k in range(7)}
    assert got == want | {("x.y.org", "y.org"), ("p..q.r.s", ".q.r.s"), ("t.u.v.", "u.v."), ("i\nj.k.l.m", "k.l.m"), ("k.l.m", "l.m")}


def test_distrust_reaches_deep_subdomains(spark):
    # the page without a rule is tied to its domain's blocked pages by its name only
    pages = [(1, "http://a.b.c.d.e.evil.net/", None), (2, "http://evil.net/es/1", None), (3, "http://evil.net/es/2", None),
             (4, "http://evil.net/fr/", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in U.url_verdicts(df).collect()}
    assert got[1].distrust > 0


def plain_rank(seeds, edges, rounds, damping):
    out = {}
    for s, d, n in edges:
        out[s] = out.get(s, 0) + n
    rank = dict(seeds)
    for _ in range(rounds):
        new = {h: (1 - damping) * v for h, v in seeds.items()}
        for s, d, n in edges:
            new[d] = new.get(d, 0) + damping * rank.get(s, 0) * n / out[s]
        rank = new
    return rank


def test_propagation_equals_plain_pagerank(spark):
    rng = random.Random(1)
    hosts = [f"h{i}" for i in range(30)]
    edges = list({(a, b): (a, b, rng.randrange(1, 5)) for a, b in ((rng.choice(hosts), rng.choice(hosts)) for _ in range(120)) if a != b}.values())
    pages = {h: rng.randrange(1, 9) for h in hosts}
    good = {h: rng.randrange(0, pages[h] + 1) for h in hosts}
    bad = {h: pages[h] - good[h] for h in hosts}
    got = {r.host: r for r in U.propagate(
        spark.createDataFrame([(h, pages[h], good[h], bad[h]) for h in hosts], "host string, pages long, allowed long, blocked long"),
        spark.createDataFrame([(a, b, float(n)) for a, b, n in edges], "src string, dst string, n double")).collect()}
    back = [(b, a, n) for a, b, n in edges]
    t, u = plain_rank(good, edges, U.ROUNDS, U.DAMPING), plain_rank(pages, edges, U.ROUNDS, U.DAMPING)
    d, v = plain_rank(bad, back, U.ROUNDS, U.DAMPING), plain_rank(pages, back, U.ROUNDS, U.DAMPING)
    for h in hosts:
        assert abs(got[h].trust - t[h] / u[h]) < 1e-9 and abs(got[h].distrust - d[h] / v[h]) < 1e-9


def test_addresses_have_no_domain_and_deep_hosts_reach_theirs(spark):
    hosts = spark.createDataFrame([("10.0.0.1",), ("8.0.0.1:8080",), ("a.b.c.d.e.net",), ("1.2.3.net",)], "src string")
    got = {(r.src, r.dst) for r in U.ancestors(hosts).collect()}
    assert got == {("a.b.c.d.e.net", "b.c.d.e.net"), ("b.c.d.e.net", "c.d.e.net"), ("c.d.e.net", "d.e.net"), ("d.e.net", "e.net"),
                   ("1.2.3.net", "2.3.net"), ("2.3.net", "3.net")}
