"""Corpus operators against brute force, with clean, damaged and skewed rows."""

import collections
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from regfeed.llm import curriculum, hyperplane_dedup, license_scan, line_rules, nbsvm, queries, quote_links, t_occurrence
from regfeed.llm.components import components

BLANK = "[\x20\x09-\x0d]+"


def words_of(text):
    return [w for w in re.split(BLANK, text or "") if w]


def grouped(ids, edges):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 480)] + [(500, k) for k in range(501, 900)]
    frame = spark.createDataFrame(edges + [(None, 3), (7, 7)], "a long, b long")
    want = grouped(range(1000), edges)
    assert {r.id: r.component for r in components(frame).collect()} == {i: c for i, c in want.items() if i != c}
    assert components(frame.limit(0)).count() == 0


# --- quotation linking ------------------------------------------------------------------------------------------------

MESSAGES = [
    (1, 0, "a", "Hello World\n\nsecond  para\nmore"),
    (1, 1, "b", "On Monday, x wrote:\n> hello world\nAnswer one"),
    (1, 2, "c", "> Answer one\n>> Hello world\nthird"),
    (1, 3, "d", "no quote"),
    (1, 4, "e", "> second para\n> more\n\nfour"),
    (1, 5, "f", "> unknown stuff\n>> answer one\nsix"),
    (1, 5, "f", "> unknown stuff\n>> answer one\nsix"),
    (2, 0, "a", None),
    (2, 1, "b", "> x"),
    (None, 0, "a", "hi"),
    (None, 1, "a", "> hi"),
    (3, None, "z", "> a"),
    (4, 0, "a", "> self\nself"),
]


def test_quotes_link_to_first_messages(spark):
    frame = spark.createDataFrame([(*m, "clash", 1) for m in MESSAGES], "conv_id long, turn long, role string, text string, body string, level int")
    got = collections.defaultdict(list)
    for r in quote_links.reply_order(frame).collect():
        got[r.conv_id].append(r)
    one = sorted(got[1], key=lambda r: r.position)
    assert [(r.turn, r.body, r.reply_to, r.thread, r.depth, r.n_quoted, r.n_linked, r.deepest) for r in one] == [
        (0, "Hello World\n\nsecond  para\nmore", None, 0, 0, 0, 0, 0),
        (1, "Answer one", 0, 0, 1, 1, 1, 1),
        (4, "four", 0, 0, 1, 1, 1, 1),
        (2, "third", 1, 0, 2, 2, 2, 2),
        (5, "six", 1, 0, 2, 2, 1, 2),
        (5, "six", 1, 0, 2, 2, 1, 2),
        (3, "no quote", None, 3, 0, 0, 0, 0),
    ]
    assert [r.position for r in one] == list(range(7))
    assert {(r.turn, r.n_linked, r.body) for r in got[None]} == {(0, 0, "hi"), (1, 0, "")}
    assert got[4][0].reply_to is None and len(got[2]) == 2 and len(got[3]) == 1
    assert quote_links.reply_order(frame.limit(0)).count() == 0


def test_long_reply_chains(spark):
    rows = [(1, 0, "a", "line 0")] + [(1, k, "a", f"> line {k - 1}\nline {k}") for k in range(1, 40)]
    got = quote_links.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.turn, r.depth, r.thread, r.position) for r in got} == {(k, k, 0, k) for k in range(40)}


def test_trimmed_quotes_link(spark):
    rows = [
        (1, 0, "b one\nx\nhi"), (1, 1, "a one\nb one"), (1, 2, "A one\nb  one\nc one\n\nlast"), (1, 3, "> a one\n> c one\nlines left out"),
        (1, 4, ">> b one\n>> c one\n> lines left out\nend cut"), (1, 5, "> c one\n> last\nover a gap"), (1, 6, "> c one\n> nowhere\nno such line"),
        (1, 7, "> hi\n> c one\nno message has both"), (1, 8, "> y\n> z\ncomes later"), (1, 9, "z\nq\ny"), (2, 0, "> c one\n> last"), (None, 0, "> c one\n> last"), (1, 10, "> b one\n> b one\n> a one"),
        (1, 11, "> y\n> z"),
    ]
    got = quote_links.reply_order(spark.createDataFrame([(c, t, "a", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    assert {r.turn: (r.reply_to, r.n_linked, r.thread, r.depth) for r in got if r.conv_id == 1 and r.turn > 2} == {
        3: (2, 1, 2, 1), 4: (3, 2, 2, 2), 5: (2, 1, 2, 1), 6: (None, 0, 6, 0), 7: (None, 0, 7, 0), 8: (None, 0, 8, 0), 9: (None, 0, 9, 0), 10: (1, 1, 1, 1), 11: (9, 1, 9, 1),
    }
    assert {r.n_linked for r in got if r.conv_id != 1} == {0}


# --- line rules -------------------------------------------------------------------------------------------------------


def brute_base(text):
    words = words_of(text)
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            dup += line in lines
            lines.add(line)
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), dup, len(inside)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab# |.é\n\t\x1c", max_size=60)), max_size=5))
def test_base_figures(texts):
    got = line_rules.judge(pa.array(texts, pa.string()))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert list(zip(*(got[n].to_pylist() for n in names), strict=True)) == [brute_base(t) for t in texts]


def clean(seed, lines=6):
    rnd = random.Random(seed)
    return "\n".join(" ".join(f"word{rnd.randrange(10**6)}" for _ in range(12)) + "." for _ in range(lines))


def test_lines_go_before_documents(spark):
    menu, shout = "home | about | contact | login | search", " ".join(["WOW!!"] * 20)
    rows = [
        (1, clean(1)), (2, clean(2) + "\n" + menu), (3, "\n".join([menu.replace("a", str(k)) for k in range(30)])), (4, None), (5, ""),
        (6, clean(3, 3) + "\n" + "\n".join(f"{shout} {k}" for k in range(9))), (7, "same words again " * 40), (8, clean(4) + "\nAll rights reserved. Cookie policy."),
    ]
    frame = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, kept boolean")
    got = {r.doc_id: r for r in line_rules.line_first(frame, with_text=True).collect()}
    assert {k for k, r in got.items() if r.kept} == {1, 2, 8}
    assert got[1].clean_text == clean(1) and got[2].clean_text == clean(2) and got[8].clean_text == clean(4)
    assert not got[3].base_failed and got[3].lost_words == got[3].n_words
    assert got[4].base_failed and got[4].clean_text == "" and got[7].base_failed
    assert line_rules.line_first(frame.limit(0)).count() == 0


# --- licences ---------------------------------------------------------------------------------------------------------


def test_licences(spark):
    files = [
        ("a/LICENSE", "x\nReleased under the MIT License.\n"), ("a/b/c.py", "code"), ("a/b/LICENSE.md", "Licensed under the Apache License, version 2.0"),
        ("d/e.py", "q"), (None, None), ("a/b/g.py", "# All Rights Reserved. \nblah"), ("a/x.py", "we ask how the license of the software they bought was a matter of dispute"),
        ("a/x.py", "we ask how the license of the software they bought was a matter of dispute"), ("a/z/y/w.py", ""),
    ]
    frame = spark.createDataFrame([(*f, "clash") for f in files], "path string, text string, licence string")
    got = sorted((str(r.path), str(r.licence), str(r.inherited_from)) for r in license_scan.scan(frame).collect())
    assert got == sorted([
        ("a/LICENSE", "MIT", "None"), ("a/b/c.py", "Apache-2.0", "a/b"), ("a/b/LICENSE.md", "Apache-2.0", "None"), ("d/e.py", "None", "None"),
        ("None", "None", "None"), ("a/b/g.py", "Proprietary", "None"), ("a/x.py", "MIT", "a"), ("a/x.py", "MIT", "a"), ("a/z/y/w.py", "MIT", "a"),
    ])
    assert license_scan.scan(frame.limit(0)).count() == 0


def test_licence_cosines(spark):
    """Scores against the same formula in plain Python."""
    texts = ["Licensed under CC BY-NC 4.0.", "the Apache license version 2.0 applies", "license", "nothing", None, "Released under MIT License\nLicensed under the Apache License, Version 2.0."]
    files = spark.createDataFrame([(f"f{k}", t) for k, t in enumerate(texts)], "path string, text string")
    terms = lambda t: re.findall(license_scan.TERM, (t or "").lower())
    idf = lambda w: math.log((len(texts) + 1) / (sum(w in terms(t) for t in texts) + 1)) + 1
    known = {w for _, t in license_scan.TEMPLATES for w in terms(t)}

    def vector(text):
        return {w: n * (idf(w) if w in known else math.log(len(texts) + 1) + 1) for w, n in collections.Counter(terms(text)).items()}

    def cosine(a, b):
        norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
        return sum(x * b.get(w, 0) for w, x in a.items()) / norm(a) / norm(b)

    want = {}
    for k, text in enumerate(texts):
        for line in (text or "").split("\n"):
            if re.search(license_scan.ANCHORS, line):
                for name, template in license_scan.TEMPLATES:
                    score = round(cosine(vector(line), vector(template)), 6)
                    if score >= license_scan.LEAST and score > want.get(f"f{k}", ("", 0))[1]:
                        want[f"f{k}"] = (name, score)
    got = {r.path: (r.own_licence, r.score) for r in license_scan.own_licences(files).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and len(got) >= 3
    assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in got)


def test_licences_hold_when_the_corpus_grows(spark):
    prose = ["this is for the software and its details", "see this file for what is in the software", "details of this are for those who see it", "nothing to see"]
    files = [("a.py", "This software is released under the MIT License, see LICENSE for details."), ("b.py", "the license of this software is for those who see it"), *((f"p{k}", t) for k, t in enumerate(prose * 3))]
    for times in (1, 60):
        frame = spark.createDataFrame([(f"{k}/{path}", text) for k in range(times) for path, text in files], "path string, text string")
        got = collections.Counter((r.path.split("/")[1], r.licence) for r in license_scan.scan(frame).collect() if r.path[-1] == "y")
        assert got == {("a.py", "MIT"): times, ("b.py", None): times}


def test_headers_and_licence_files(spark):
    gnu = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details."
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0'
    texts = dict(license_scan.TEXTS)
    hashed = lambda x: "\n".join(f"# {line}".rstrip() for line in x.split("\n"))
    prose = "one whole paragraph of the usual words that a text is made of, and as it is with them, any of these may be or not be in the other texts. " * 20
    files = {
        "g/a.py": ("#!/usr/bin/python\n" + hashed(gnu) + "\nimport os\n", "GPL-3.0"), "g/b.c": ("/*\n * Copyright 2024 J. Doe\n *\n" + gnu.replace("General", "Lesser General") + " */\nint x;", "LGPL-3.0"),
        "g/c.js": ("\n// " + apache.replace("\n", "\n// ") + "\nlet x = 1", "Apache-2.0"), "g/d.py": ("x = 1\n" + hashed(prose), None), "g/e.sql": ("-- Released under\n-- the MIT License.\nselect 1", "MIT"),
        "h/f.txt": (prose, None), "q/LICENSE": (prose, None), "g/open.c": ("/* never closed", None), "g/blank.py": ("\n" * 50_000 + "#" * 50_000 + "\n/*" + "x " * 50_000, None),
        **{f"{name}/COPYING": ("Copyright (c) 2024 Jane Doe\nAll rights reserved.\n\n" + text, name) for name, text in texts.items()},
    }
    frame = spark.createDataFrame([(path, text) for path, (text, _) in files.items()], "path string, text string")
    assert {r.path: r.licence for r in license_scan.scan(frame).collect()} == {path: licence for path, (_, licence) in files.items()}


def test_spdx_lines_and_unknown_licence_files(spark):
    files = {
        "LICENSE": ("Released under the MIT License.", "MIT", None), "a.py": ("x = 1", "MIT", ""), "b.py": ("# SPDX-License-Identifier: Apache-2.0\nx", "Apache-2.0", None),
        "c.c": ("// SPDX-License-Identifier: MIT\n", "MIT", None), "d.c": ("/* SPDX-License-Identifier: (GPL-2.0-or-later OR BSD-3-Clause) */", "BSD-3-Clause", None),
        "e.c": ("// SPDX-License-Identifier: BUSL-1.1", None, None), "f.c": ("// SPDX-License-Identifier: Nobody-1\n// Released under the MIT License.", "MIT", None),
        "g.c": ("// spdx-license-identifier: lgpl-2.1+ with Some-exception", "LGPL-2.1", None), "h.c": ("// SPDX-License-Identifier:", None, None),
        "i.c": ("// SPDX-License-Identifier: BSD-4-Clause", None, None), "own/LICENSE": ("Every copy costs ten crowns.", None, None), "own/x/a.py": ("x", None, None),
        "own/x/COPYING": ("", None, None), "own/y/LICENSE.txt": ("SPDX-License-Identifier: CC0-1.0", "CC0-1.0", None), "own/y/z/a.py": ("x", "CC0-1.0", "own/y"),
        "n/NOTICE": ("Thanks to all.", "MIT", ""), "n/a.py": (None, "MIT", ""), "two/LICENSE-A": ("words", None, None), "two/LICENSE-MIT": ("Released under the MIT License.", "MIT", None),
        "two/a.py": ("x", "MIT", "two"),
    }
    frame = spark.createDataFrame([(path, text) for path, (text, *_) in files.items()], "path string, text string")
    got = {r.path: (r.licence, r.inherited_from) for r in license_scan.scan(frame).collect()}
    assert got == {path: (licence, above) for path, (_, licence, above) in files.items()}


def test_licence_sql_meets_headers_and_spdx(spark, tmp_path):
    """The query beside its SQL on documents with headers, full texts, SPDX lines and files that nothing fits."""
    texts = dict(license_scan.TEXTS)
    hashed = lambda x: "\n".join(f"# {line}" for line in x.split("\n"))
    docs = [(texts["MIT"] + "\nThis is licensed so", "en", "a"), (hashed(license_scan.HEADERS[2][1]) + "\nx = 1", "de", "a"), ("# SPDX-License-Identifier: MPL-2.0-only\nx", "de", "a"),
        ("words\nlicensed to nobody at all", "en", "b"), ("nothing", "fr", "b"), ("// SPDX-License-Identifier: BUSL-1.1", "fr", "a"), ("plain", "fr", "a"), (None, "fr", "a"),
        ("/* Licensed under the Apache License,\n Version 2.0. */ int x;", "fr", "b"), ("#!/bin/sh\n# All rights\n# reserved.\n\nls", "en", "b"), ("-- not closed\n", "en", "c"), ("", "en", "c"),
        (texts["GPL-2.0"] + "\nlicensed as above", "es", "c"), ("hola", "es", "c")]
    rows = [(k, *d, 0) for k, d in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(str(x) for x in r) for r in queries.QUERIES["op4_license_scan"](spark, str(tmp_path)).select("doc_id", "path", "licence", "inherited_from").collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(tuple(str(x) for x in r) for r in con.execute(queries.ORACLES["op4_license_scan"]).fetchall())
    assert got == want
    licences = {int(r[0]): r[2] for r in got}
    assert (licences[0], licences[2], licences[3], licences[5], licences[8], licences[9]) == ("MIT", "MPL-2.0", "None", "None", "Apache-2.0", "Proprietary")


# --- vectors ----------------------------------------------------------------------------------------------------------


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(hyperplane_dedup, "BLOCK", 16)
    draw = np.random.default_rng(1)
    base = draw.standard_normal((60, 24))
    rows = [(k, base[k % 60] + draw.standard_normal(24) * 0.13, k % 2) for k in range(150)]
    rows += [(200 + k, base[0], 0) for k in range(40)] + [(300 + k, base[1] * (1 + k), 1) for k in range(5)] + [(400 + k, base[0] + draw.standard_normal(24) * 0.05, 0) for k in range(60)]
    rows = [(k, [float(np.float32(x)) for x in v], y) for k, v, y in rows]
    odd = [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("nan")] * 24, 0), (903, rows[0][1], None), (904, [1.0, None], 0), (905, [], 0), (906, rows[0][1][:12], 0), (907, [float("inf")] * 24, 0), (None, rows[0][1], 0)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows + odd], "vec_id long, embedding array<float>, label int, kept string")
    matrix = np.array([v for _, v, _ in rows])
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    labels, ids = np.array([y for *_, y in rows]), [k for k, *_ in rows]
    linked = (matrix @ matrix.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    part = grouped(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(linked), strict=True)])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hyperplane_dedup.near_copies(frame).collect()}
    assert {k: got[k] for k in ids} == {i: (int(linked[k].sum()), part[i], part[i] == i) for k, i in enumerate(ids)}
    assert linked.sum() > 4_000
    assert all(got[k] == (0, k, True) for k in range(900, 908)) and got[None] == (0, None, True)
    assert hyperplane_dedup.near_copies(frame.limit(0)).count() == 0


# --- Jaccard ----------------------------------------------------------------------------------------------------------


def shingles(text, width):
    words = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def brute_jaccard(texts, width, percent):
    sets = {k: shingles(t, width) for k, t in texts.items()}
    edges = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    links = collections.Counter(x for e in edges for x in e)
    part = grouped(list(texts), edges)
    return sorted((k, len(sets[k]), links[k], part[k]) for k in texts)


def corpus(seed):
    """Exact and near copies, a passage in many documents, and documents with nothing in common."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(400)}"
    passage, texts = [word() for _ in range(40)], []
    for _ in range(50):
        own = [word() for _ in range(rnd.randrange(1, 80))]
        texts.append(own + passage if rnd.random() < 0.6 else own)
    base = [word() for _ in range(60)]
    for _ in range(70):
        copy = list(base)
        for _ in range(rnd.choice((0, 0, 1, 1, 2, 3, 5))):
            copy[rnd.randrange(60)] = word()
        texts.append(copy)
    return {k: " ".join(t).upper() if k % 3 else "\n ".join(t) + "\t" for k, t in enumerate(texts)}


@pytest.mark.parametrize("limits", [(16, 1_024, 400_000, 3), (2, 8, 500, 2)])
def test_jaccard_groups(spark, monkeypatch, limits):
    for name, value in zip(("SHORT_LIST", "BLOCK_ENTRIES", "BLOCK_SHINGLES", "OFTEN"), limits, strict=True):
        monkeypatch.setattr(t_occurrence, name, value)
    texts = corpus(5) | {500: None, 501: "", 502: " \t", 503: "one two", 504: "One  TWO", 505: "two one"}
    frame = spark.createDataFrame([(k, t, "x", 1) for k, t in texts.items()], "doc_id long, text string, n string, cls int").repartition(3)
    for width, percent in ((4, 85), (5, 80)):
        got = t_occurrence.jaccard_groups(frame, width, percent).collect()
        assert sorted(map(tuple, got)) == brute_jaccard(texts, width, percent)
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(str, map(tuple, t_occurrence.jaccard_groups(odd).collect()))) == ["(1, 2, 0, 1)", "(1, 2, 0, 1)", "(None, 2, 0, None)"]
    assert t_occurrence.jaccard_groups(frame.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=12), st.sets(st.integers(0, 2**64 - 1), max_size=12))
def test_marks_never_rule_out_a_link(both, one, two):
    sets = [np.array(sorted(s), np.uint64) for s in (both | one, both | two) if s]
    if len(sets) < 2 or not len(sets[0]) or not len(sets[1]):
        return
    found = t_occurrence.may_link([t_occurrence.mark(s, 80) for s in sets], np.array([len(s) for s in sets]), 80)
    pairs = [tuple(sorted(p)) for x, y in found for p in zip(x.tolist(), y.tolist(), strict=True)]
    shared, united = len(np.intersect1d(*sets)), len(np.union1d(*sets))
    if 100 * shared >= 80 * united:
        assert pairs == [(0, 1)]


# --- mixing -----------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2)):
    """Shares by weight, the excess over twice the size dealt out again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2 * sizes[s]
            left -= 2 * sizes[s]
        free -= over
    return target


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(curriculum, "BUCKET_ROWS", 40)
    rnd = random.Random(2)
    rows = [(k, " ".join(["w"] * rnd.randrange(60)), rnd.choice(["big", "big", "b", "zé", "Z", None, "tiny"] if k > 10 else ["tiny"])) for k in range(600)]
    rows += [(None, "x y", "big"), (700, None, "only null"), (701, "a b", "big"), (701, "a b", "big")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, size string")
    got = curriculum.curriculum(frame).collect()
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(words_of(text))
    want = brute_targets(sizes)
    taken, largest = collections.Counter(), collections.Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.passes <= 2
        assert len(r.positions) == r.passes and all(0 <= p <= 1 for p in r.positions) and r.positions == sorted(r.positions)
        taken[r.source] += r.passes * r.size
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.passes)
    assert sorted(map(key, got)) == sorted(map(key, curriculum.curriculum(frame.repartition(7)).collect()))
    order = curriculum.training_order(curriculum.curriculum(frame)).collect()
    assert [r.position for r in order] == sorted(r.position for r in order) and len(order) == sum(r.passes for r in got)
    assert curriculum.curriculum(frame.limit(0)).count() == 0


def test_positions_invert_the_schedule(spark):
    for knots in curriculum.SCHEDULES:
        total = sum((b - a) * (v + w) / 2 for (a, v), (b, w) in itertools.pairwise(knots))
        frame = spark.range(101).select((F.col("id") / 100.0).alias("x"))
        for r in frame.select("x", curriculum._position(F.col("x"), curriculum._pieces(knots)).alias("t")).collect():
            area = 0.0
            for (a, v), (b, w) in itertools.pairwise(knots):
                e = min(max(r.t, a), b)
                area += (e - a) * (v + v + (w - v) * (e - a) / (b - a)) / 2
            assert abs(area / total - r.x) < 1e-9


# --- classifier -------------------------------------------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet")
    got = nbsvm.classify(docs, labels)
    again = {r.doc_id: r.score for r in nbsvm.classify(docs.repartition(5), labels).collect()}
    right = collections.Counter()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    for r in got.collect():
        assert again[r.doc_id] == r.score and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.held_out and r.doc_id in truth:
            right[truth[r.doc_id] == r.predicted] += 1
    assert right[True] >= 0.97 * sum(right.values()) and sum(right.values()) > 50


def test_classifier_never_reads_held_out_labels(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("quality", F.when(nbsvm.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda l: sorted((r.doc_id, r.score) for r in nbsvm.classify(docs, l).collect())
    assert score(labels) == score(turned)


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, "good text"), (2, None), (None, ""), (1, "good text"), (3, "x" * 100_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = nbsvm.classify(docs.withColumn("score", F.lit("clash")), none).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5}
    one = spark.createDataFrame([(k, 1) for k in range(1, 4)] + [(2, None)], "doc_id long, quality int")
    assert {r.predicted for r in nbsvm.classify(docs, one).collect()} == {1}
    assert nbsvm.classify(docs.limit(0), one).count() == 0


def plain_features(text):
    """Feature numbers by loops over words, in whole numbers modulo 2^64."""
    top, words = 1 << 64, words_of(text)

    def hashed(x):
        return int(nbsvm.pd.util.hash_array(np.array([x], object), categorize=False)[0])

    def mixed(x):
        x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 % top
        return (x ^ (x >> 32)) * int(nbsvm.MULTIPLIER) % top

    lower = [hashed(w.lower()) for w in words]
    shape = [hashed(nbsvm.shapes(pa.array([w]))[0].as_py()) for w in words]
    shape = [1 if k and words[k] == words[k - 1] else s for k, s in enumerate(shape)]
    out = set()
    for kind, (base, width) in enumerate(((lower, 1), (lower, 2), (shape, 1), (shape, 2), (shape, 3)), 1):
        for k in range(len(base) - width + 1):
            x = kind
            for b in base[k : k + width]:
                x = (x * int(nbsvm.MULTIPLIER) + b) % top
            out.add(mixed(x) >> (64 - 18))
    return sorted(out)


def test_model_against_plain_loops():
    """Features, ratios and scores, each by plain loops; texts longer than any cap that once was."""
    rnd = random.Random(8)
    long = " ".join(f"w{rnd.randrange(9_000)}" for _ in range(12_000))
    texts = [None, "", " \n ", "a", "Ab ab ab, 12 ab!", "x\ty\nz x y z", long]
    sets = nbsvm.features(pa.array(texts, pa.string()))
    assert [s.tolist() for s in sets] == [plain_features(t) for t in texts] and len(sets[-1]) > 15_000
    labels = np.array([1, -1, 1, -1, 1, -1, 1])
    ratio = nbsvm.log_count_ratio(sets, labels, nbsvm.DIMENSIONS)
    good, bad = ({}, {})
    for s, y in zip(sets, labels, strict=True):
        for f in s.tolist():
            (good if y > 0 else bad)[f] = (good if y > 0 else bad).get(f, 0) + 1
    totals = [nbsvm.DIMENSIONS + sum(c.values()) for c in (good, bad)]
    for f in set(good) | set(bad) | {0, 77}:
        assert abs(ratio[f] - math.log((1 + good.get(f, 0)) / totals[0]) + math.log((1 + bad.get(f, 0)) / totals[1])) < 1e-9
    model = nbsvm.Model(np.arange(nbsvm.DIMENSIONS, dtype=np.float32) % 7 - 3, 0.25, 0.5, -0.1)
    for s, got in zip(sets, model.scores(sets), strict=True):
        margin = sum(int(f) % 7 - 3 for f in s) / math.sqrt(max(1, len(s))) + 0.25
        assert abs(got - 1 / (1 + math.exp(-(0.5 * margin - 0.1)))) < 1e-5


def test_curve_is_fitted_on_rows_that_ratios_do_not_see(monkeypatch):
    seen = {}
    real = {n: getattr(nbsvm, n) for n in ("log_count_ratio", "logistic")}
    monkeypatch.setattr(nbsvm, "log_count_ratio", lambda sets, *a: seen.update(ratio=[s.tolist() for s in sets]) or real["log_count_ratio"](sets, *a))
    monkeypatch.setattr(nbsvm, "logistic", lambda margins, labels: seen.update(curve=len(margins)) or real["logistic"](margins, labels))
    sets = [np.array([k, 100 + k % 2], np.int32) for k in range(50)]
    nbsvm.fit(sets, np.where(np.arange(50) % 2, 1, -1), 128)
    assert seen["curve"] == 10 and seen["ratio"] == [s.tolist() for k, s in enumerate(sets) if k % 5]


def test_descent_reaches_the_optimum():
    draw = np.random.default_rng(0)
    rows = [np.flatnonzero(draw.random(12) < 0.4).astype(np.int32) for _ in range(60)]
    labels = np.where(draw.random(60) < 0.5, 1, -1)
    ratio = draw.standard_normal(12)
    w, bias = nbsvm.dual_descent(rows, labels, ratio, 1.0, 400, 1)

    def loss(w, bias):
        margins = np.array([float(w[r] @ ratio[r]) / np.sqrt(max(1, len(r))) + bias for r in rows])
        return (w @ w + bias * bias) / 2 + np.maximum(0, 1 - labels * margins).sum()

    best = loss(w, bias)
    for _ in range(300):
        assert best <= loss(w + draw.standard_normal(12) * 0.05, bias + draw.standard_normal() * 0.05) + 1e-3


# --- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes, kept = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == corpus_pipeline.COLUMNS
        rows = kept.collect()
        sizes.append(len(rows))
        kept = spark.createDataFrame(rows, kept.schema)
        ids = {r.doc_id for r in rows}
        assert ids <= set(before)
        if name == "quality classifier":
            model = nbsvm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            scores = model.scores(nbsvm.features(pa.array(list(before.values()), pa.string())))
            assert ids == {k for k, s in zip(before, scores, strict=True) if s >= nbsvm.CUT}
        if name == "quality rules":
            judged = line_rules.judge(pa.array(list(before.values()), pa.string()), with_text=True)
            want = {k: t for k, t, ok in zip(before, judged["clean_text"].to_pylist(), judged["kept"].to_pylist(), strict=True) if ok}
            assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
        if name == "n-gram Jaccard join":
            assert ids == {k for k, _, _, c in brute_jaccard(before, 5, 80) if k == c}
        if name == "mixing sources to target weights":
            assert max(collections.Counter(r.doc_id for r in rows).values()) <= 2
    packed = corpus_pipeline.STAGES[4][1](spark, kept, sf_dir)
    assert packed.agg(F.sum("length")).first()[0] > 0
    assert 0 < sizes[3] < sizes[0]


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_mix_takes_each_row_as_often_as_it_is_due(spark):
    """Rows without an id, one id in two sources, and rows that agree in everything: words taken per source are near the targets."""
    rnd = random.Random(2)
    text = lambda n: " ".join(f"w{rnd.randrange(99)}" for _ in range(n))
    rows = [(k, text(10), "en", "abc"[k % 3], 1) for k in range(90)] + [(None, text(10), "en", "a", 1) for _ in range(20)]
    rows += [(7, text(10), "en", "a", 1), (7, text(10), "en", "c", 1)] + [(None, "same words all over again", "en", "b", 1)] * 9
    docs = spark.createDataFrame(rows, DOCUMENTS).withColumn("_key", F.lit(1)).withColumn("positions", F.lit(2))
    sized = curriculum.word_counts(docs)
    mixed = curriculum.mix(sized, curriculum.source_targets(sized)).groupBy("source").agg(F.sum(F.col("passes") * F.col("size")).alias("n")).collect()
    got = corpus_pipeline.mix_sources(spark, docs, "").collect()
    words = collections.Counter()
    for r in got:
        words[r.source] += len(words_of(r.text))
    assert dict(words) == {r.source: r.n for r in mixed if r.n}
    assert max(collections.Counter((r.doc_id, r.text, r.source) for r in got).values()) <= 2 * 9


def test_stages_on_odd_rows(spark, sf_dir):
    """NULL and repeated ids, NULL and empty texts, an empty table and clashing columns pass through every stage."""
    good = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy(F.desc("n_chars")).limit(12).select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "a", 0), (1, " ", None, None, 1), (1, " ", None, None, 1)], DOCUMENTS)
    docs = good.unionByName(good.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(good.limit(3)).unionByName(odd)
    docs = docs.withColumn("score", F.lit("x")).withColumn("kept", F.lit("x")).withColumn("_key", F.lit("x"))
    for rows in (docs, docs.limit(0)):
        kept = rows
        for _, stage in corpus_pipeline.STAGES[:4]:
            kept = stage(spark, kept, sf_dir)
            assert kept.columns == corpus_pipeline.COLUMNS
            kept = spark.createDataFrame(kept.collect(), kept.schema).withColumn("position", F.lit(1)).withColumn("size", F.lit("x"))
        packed = corpus_pipeline.STAGES[4][1](spark, kept, sf_dir).collect()
        assert bool(packed) == bool(kept.count())
        assert not packed or None in {r.doc_id for r in packed}
