"""URL filters and license scans against plain definitions."""

import math
import pathlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from modalgraph.llm import licenses, url_filters

PAGES = "page_id bigint, url string, html string, host string, trust double"


def page_rows():
    link = lambda *to: "".join(f'<p><a class="x" href="{t}">t</a>' for t in to)
    return [
        (1, "http://GOOD.example.net/en/1?x=http://other", link("http://friend.example.com/a", "/own")),
        (2, "http://friend.example.com/fr/2", link("//Far.example.com/b")),
        (3, "https://bad.net/x", link("http://friend.example.com/a")),
        (4, "http://links-to-bad.com/de", link("http://bad.net/", "HTTP://bad.net/y")),
        (5, "http://sub.example.com/de/5#top", None),
        (6, "http://w.org/fr/", link("mailto:x@y", "#here")),
        (7, None, "<a href='/x'>"),
        (8, "no scheme", link("http://bad.net")),
        (9, "http://notexample.com/de/", ""),
        (10, "http://x.net", link("rel")),
        (10, "http://x.net", link("rel")),
        (None, "http://far.example.com/", ""),
    ]


def judged(spark, rows, **kw):
    return url_filters.judge(spark.createDataFrame([(*r, "clash", 1.0) for r in rows], PAGES), **kw).collect()


def fits(host, path, rule):
    name, _, rest = rule.partition("/")
    return (host == name or host.endswith("." + name)) and path.startswith("/" + rest)


def test_rules_and_parts(spark):
    got = judged(spark, page_rows())
    assert len(got) == 12
    for r in got:
        url = next(u for p, u, _ in page_rows() if p == r["page_id"])
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        rules = [(what, x) for what, x in url_filters.RULES if fits(host, path, x)]
        best = max(rules, key=lambda r: len(r[1]), default=(None, None))
        assert (r["host"], r["path"], r["rule"]) == (host, path, best[1])
        if best[0]:
            assert r["verdict"] == best[0]
    by_id = {r["page_id"]: r for r in got}
    assert by_id[7]["verdict"] == by_id[8]["verdict"] == by_id[9]["verdict"] == "allow"
    assert by_id[4]["distrust"] > 0 and by_id[2]["trust"] > 0


def test_spreading_is_personalised_pagerank(spark):
    links = {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1, ("d", "a"): 4, ("c", "c"): 1}
    edges = spark.createDataFrame([(s, t, n) for (s, t), n in links.items()], "source string, target string, links bigint")
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("c", 0.0, 0.5), ("alone", 0.2, 0.1)], "host string, trusted double, blocked double")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filters.spread(edges, seeds, 7).collect()}
    hosts = {"a": (1, 0), "b": (0, 0), "c": (0, 0.5), "d": (0, 0), "alone": (0.2, 0.1)}
    score = dict(hosts)
    out = {h: sum(n for (s, _), n in links.items() if s == h) for h in hosts}
    into = {h: sum(n for (_, t), n in links.items() if t == h) for h in hosts}
    for _ in range(7):
        score = {
            h: (
                hosts[h][0] + 0.85 * sum(n / out[s] * score[s][0] for (s, t), n in links.items() if t == h),
                hosts[h][1] + 0.85 * sum(n / into[t] * score[t][1] for (s, t), n in links.items() if s == h),
            )
            for h in hosts
        }
    assert set(got) == set(hosts)
    for h in hosts:
        assert got[h] == pytest.approx(score[h])


def test_a_host_among_blocked_ones_is_blocked(spark):
    rows = [(i, f"http://bad{i}.net/", "") for i in range(3)] + [(9, "http://farm.com/a", "".join(f'<a href="http://bad{i}.net/p">' for i in range(3)))] + [(10, "http://fine.com/a", "")]
    by_id = {r["page_id"]: r for r in judged(spark, rows)}
    assert by_id[9]["verdict"] == "block" and by_id[9]["rule"] is None
    assert by_id[10]["verdict"] == "allow"


def test_no_pages(spark):
    assert judged(spark, []) == []


# licenses


def nearest(text):
    """(name, score) of the window that explains most, by plain loops over templates and their telling terms."""
    idf, rare, known = licenses.templates()
    words, found = licenses.terms(text or ""), []
    for k, t in enumerate(known):
        for i, w in enumerate(words):
            for place, x in enumerate(t.terms):
                if w == x and x in t.telling(idf):
                    bag = Counter(words[max(0, i - place) : i - place + len(t.terms)])
                    norm = math.sqrt(sum((n * idf.get(u, rare)) ** 2 for u, n in bag.items()))
                    score = sum(n * idf[u] * t.weight.get(u, 0) for u, n in bag.items() if u in idf) / norm
                    if score >= licenses.SIMILARITY - 1e-9:
                        found.append((round(0 if t.name == licenses.RESERVATION else score * t.length, 6), round(score, 9), -k, t.name))
    return max(found)[3::-2] if found else (None, None)


LINES = [
    "Released under the MIT License.", "# released UNDER the mit license", "released under mit", "Licensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.", "we were released under a bridge", "mit der licht", "", "All rights reserved.", "all rights", "license license license", "public public domain",
    "Released under the MIT License. Released under the MIT License.", "version 2 0",
]


TEXTS = [
    *LINES, *(t for texts in licenses.TEMPLATES.values() for t in texts), "GNU GENERAL PUBLIC LICENSE\n    Version 3, 29 June 2007", "MIT License", "This code is released under the MIT License",
    "Copyright (c) 2020 Jane Doe. All rights reserved.", "A sentence of prose. Released under the MIT License.", "/* Licensed under the Apache\n * License, Version 2.0 (the\n * \"License\"); you may not use this file */",
    "word " * 300 + "released under the mit license" + " word" * 300, "license", "license version 2 0 license", None,
]


def test_scores_of_texts(spark):
    files = spark.createDataFrame([(i, f"d/{i}.c", t, "x", "y") for i, t in enumerate(TEXTS)], "doc_id bigint, path string, text string, license string, own string")
    got = {r["doc_id"]: r for r in licenses.scan(files).collect()}
    for i, text in enumerate(TEXTS):
        name, score = nearest(text)
        assert got[i]["own_license"] == name, text
        assert got[i]["own_score"] == (score if score is None else pytest.approx(score, abs=1e-8))


def test_wrapped_embedded_and_prefixed_headers(spark):
    header = licenses.TEMPLATES["GPL-3.0"][1].split()
    wrapped = "\n".join("# " + " ".join(header[i : i + 7]) for i in range(0, len(header), 7))
    bsd = "Copyright (c) 2020, A. Writer\nAll rights reserved.\n\n" + licenses.TEMPLATES["BSD-2-Clause"][0] + " provided that the following conditions are met:\n" + "* Redistributions must retain the notice.\n"
    third = "* Neither the name of A. Writer nor the names of other\n  contributors may be used to endorse or promote products derived\n  from this software without specific prior written permission.\n"
    rows = [(1, "a/x.py", wrapped), (2, "b/LICENSE", bsd), (3, "c/LICENSE", bsd + third), (4, "c/d.c", "code " * 50), (5, "e", "Some prose here. " + "All rights reserved. More prose.")]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
    assert got == {1: "GPL-3.0", 2: "BSD-2-Clause", 3: "BSD-3-Clause", 4: "BSD-3-Clause", 5: "All-Rights-Reserved"}


REAL = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


def test_real_licence_files(spark):
    folder = pathlib.Path("/usr/share/common-licenses")
    files = [(i, f"{n}/COPYING", (folder / n).read_text(errors="replace")) for i, n in enumerate(REAL) if (folder / n).is_file()]
    if not files:
        pytest.skip("this system has no licence files")
    got = {r["path"].split("/")[0]: r["license"] for r in licenses.scan(spark.createDataFrame(files, "doc_id bigint, path string, text string")).collect()}
    assert got == {n: REAL[n] for n in got}


def test_inheritance(spark):
    mit, apache = LINES[0], LINES[5]
    rows = [
        (1, "LICENSE", apache), (2, "a/license.txt", mit), (3, "a/b/c/x.c", "code"), (4, "a/y.c", "code\n" + apache + "\nmore"), (5, "z/q.c", None), (6, None, "text"), (7, "a/b/COPYING", "no licence here"),
        (8, "aa/x", "code"), (9, "a/LICENCE.2", apache.replace("the ", "")), (9, "a/LICENCE.2", apache.replace("the ", "")), (None, "a/b/n", ""), (11, "x" * 500 + "/y", "w " * 40_000 + "\n" + mit),
    ]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], r["license_source"], r["license_dir"]))
    assert got[1] == [("Apache-2.0", "own", None)]
    assert got[3] == got[7] == got[None] == [("MIT", "inherited", "a")]
    assert got[4] == [("Apache-2.0", "own", None)]
    assert got[5] == got[6] == got[8] == [("Apache-2.0", "inherited", "")]
    assert len(got[9]) == 2 and got[11] == [("MIT", "own", None)]


def test_no_licensed_directory(spark):
    files = spark.createDataFrame([(1, "a/b", "text"), (2, None, None)], "doc_id bigint, path string, text string")
    assert {r["license"] for r in licenses.scan(files).collect()} == {None}
    assert licenses.scan(files.limit(0)).collect() == []


def test_paths_of_documents(spark):
    docs = spark.createDataFrame([(1234, "w " * 50, "s", "en"), (1290, "few words", None, "en"), (1300, None, "s", "en"), (None, None, "s", None)], "doc_id bigint, text string, source string, lang string")
    got = {r["doc_id"]: r["path"] for r in licenses.document_paths(docs).orderBy(F.col("doc_id")).collect()}
    assert got == {1234: "s/1/12/1234.txt", 1290: "/1/12/LICENSE", 1300: "s/1/LICENSE", None: "s///.txt"}
