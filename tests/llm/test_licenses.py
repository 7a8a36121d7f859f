"""Licence scans: cosines against numpy, inheritance by hand."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from mercata.llm import licenses as lc

TEMPLATES = [("MIT", "Released under the MIT License."), ("GPL", "licensed under the GNU General Public License"), ("NIL", "...")]


def words(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]


def best(text, texts, line, file):
    vocab = {w for _, t in TEMPLATES for w in words(t)}
    n = len(texts)
    idf = lambda w: math.log((1 + n) / (1 + (sum(w in words(t) for t in texts) if w in vocab else 0))) + 1
    out = []
    passages = [("file", text or "")] + [("header", x) for x in (text or "").split("\n")]
    for origin, p in passages:
        v = {w: c * idf(w) for w, c in Counter(words(p)).items()}
        for name, t in TEMPLATES:
            u = {w: c * idf(w) for w, c in Counter(words(t)).items()}
            if u and v:
                dot = sum(v.get(w, 0) * x for w, x in u.items())
                c = round(dot / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in u.values())), 6)
                if c >= (file if origin == "file" else line):
                    out.append((origin, -c, name))
    return min(out, default=None)


def test_own_licences_match_brute_force(spark):
    texts = [
        "Released under the MIT License.", "prose here\nRELEASED under the mit license\nmore prose and more and more", "under the", None, "",
        "This work is licensed under the GNU General Public License, version 3.", "a b c " * 50 + "\nlicensed under GNU general public license x",
        "License license LICENSE", "Released under the MIT License. " + "filler é " * 20_000, "Released under the MIT License.", "\n\n", "the general public",
    ]
    df = spark.createDataFrame([(i, f"d{i}/f", t) for i, t in enumerate(texts)], "id long, path string, text string")
    tm = spark.createDataFrame(TEMPLATES, "license string, text string")
    out = lc.scan(df, templates=tm, threshold=0.6, file_threshold=0.5)
    got = {r.id: r for r in out.collect()}
    for i, t in enumerate(texts):
        want = best(t, [x or "" for x in texts], 0.6, 0.5)
        if want is None:
            assert got[i].origin is None and got[i].license is None
        else:
            assert (got[i].origin, got[i].license) == (want[0], want[2]) and abs(got[i].cosine + want[1]) < 2e-6
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_nearest_directory_gives_its_licence(spark):
    mit, gpl = TEMPLATES[0][1], TEMPLATES[1][1]
    rows = [
        (1, "LICENSE", gpl), (2, "src/LICENSE", mit), (3, "src/a/b/code", "text"), (4, "src/code", "text"), (5, "top", "text"),
        (6, "other/x/y", "text"), (7, "/src//a/z", None), (8, None, "text"), (9, "src/a/own", "prose of some length here\n" + gpl + "\nmore prose of some length"), (9, "src/code", "text"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, path string, text string, license string")
    out = lc.scan(df, templates=spark.createDataFrame(TEMPLATES, "license string, text string"))
    got = sorted(((r.id, r.license, r.origin, r.directory) for r in out.collect()), key=str)
    assert got == sorted(
        [(1, "GPL", "file", None), (2, "MIT", "file", None), (3, "MIT", "inherited", "src"), (4, "MIT", "inherited", "src"), (5, "GPL", "inherited", ""),
         (6, "GPL", "inherited", ""), (7, "MIT", "inherited", "src"), (8, "GPL", "inherited", ""), (9, "GPL", "header", None), (9, "MIT", "inherited", "src")],
        key=str,
    )


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", "Released under the MIT License.")], "id long, path string, text string")
    assert lc.scan(df.limit(0)).collect() == []
    none = spark.createDataFrame([], "license string, text string")
    assert lc.scan(df, templates=none).first().license is None
    assert lc.scan(df).first().license == "MIT"


def test_prefix_words_lose_no_passage():
    weights = {"x": {"rare": 5.0, "mid": 3.0, "the": 1.0}}
    assert lc.prefix_words(weights, 0.7) == ["rare"] and lc.prefix_words(weights, 0.1) == ["mid", "rare", "the"]


def test_common_words_beside_a_notice_weigh_little(spark):
    texts = [f"and it was so for w{i} as they are" for i in range(200)] + ["prose\nAnd so it was as they are released under the MIT License.\n" + "prose of q and r " * 40, "it", None]
    df = spark.createDataFrame([(i, f"d{i}/f", t) for i, t in enumerate(texts)], "id long, path string, text string")
    tm = spark.createDataFrame(TEMPLATES, "license string, text string")
    assert lc.scan(df, templates=tm).where("id = 200").first().license is None
    got = lc.scan(df, templates=tm, count_all=True).collect()
    held = Counter(w for t in texts for w in set(words(t)))
    idf = lambda w: math.log((1 + len(texts)) / (1 + held[w])) + 1
    u, v = ({w: idf(w) for w in words(x)} for x in (TEMPLATES[0][1], "And so it was as they are released under the MIT License."))
    want = sum(u[w] * v[w] for w in u) / math.sqrt(sum(x * x for x in u.values()) * sum(x * x for x in v.values()))
    (row,) = [r for r in got if r.license]
    assert (row.id, row.license, row.origin) == (200, "MIT", "header") and abs(row.cosine - want) < 2e-6
    assert lc.scan(df.limit(0), templates=tm, count_all=True).collect() == []


def test_only_words_of_passages_near_a_template_are_counted(spark, monkeypatch):
    """A passage that fails with words of the least weight is left before they travel, and no licence is lost by it."""
    rng = random.Random(5)
    notice = words(TEMPLATES[0][1])
    texts = [" ".join(rng.sample(notice, rng.randint(2, 5)) + [f"w{rng.randint(0, 12)}" for _ in range(rng.randint(0, 6))]) for _ in range(150)]
    texts += [f"the license of {i} " + " ".join(f"far{i}x{j}" for j in range(60)) for i in range(20)] + [None, ""]
    held, n = Counter(w for t in texts for w in set(words(t))), len(texts)
    idf = lambda w: math.log((1 + n) / (1 + held[w])) + 1
    u = {w: idf(w) for w in notice}
    want = {}
    for i, t in enumerate(texts):
        v = {w: c * idf(w) for w, c in Counter(words(t)).items()}
        dot, norm = sum(x * u.get(w, 0) for w, x in v.items()), sum(x * x for x in v.values()) * sum(x * x for x in u.values())
        if norm and dot / math.sqrt(norm) >= 0.6:
            want[i] = dot / math.sqrt(norm)
    assert 20 <= len(want) <= 130
    tables, plain = {}, lc.shared_table
    monkeypatch.setattr(lc, "shared_table", lambda df, name: tables.setdefault(name, plain(df, name)))
    df = spark.createDataFrame([(i, f"d{i}/f", t) for i, t in enumerate(texts)], "id long, path string, text string")
    tm = spark.createDataFrame(TEMPLATES[:1], "license string, text string")
    got = {r.id: r.cosine for r in lc.scan(df, templates=tm, threshold=0.6, file_threshold=0.6, count_all=True).collect() if r.license}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in want)
    assert {r.word for r in tables["passage-vocabulary"].collect()} <= {f"w{i}" for i in range(13)}


def test_headers_texts_and_tag_lines_are_found(spark):
    """Registered templates: the tag line, a notice in a sentence, file headers over several lines, whole texts, beside prose."""
    prose = "\n".join(f"prose of line {i} and of word w{i} it was" for i in range(40))
    header = dict(lc.HEADERS)["GPL-3.0"]
    comment = "\n".join(f" * {x}" for x in header.split("\n"))
    mit = "MIT License\n\nCopyright (c) 2024 Somebody\n\n" + dict(lc.TEXTS)["MIT"]
    cases = {
        1: ("// SPDX-License-Identifier: MIT\n" + prose, "MIT", "header"),
        2: (prose + "\nIt was released under the MIT License.\n" + prose, "MIT", "header"),
        3: (prose + "\n\n/*\n" + comment + "\n */\n\n" + prose, "GPL-3.0", "header"),
        4: (mit, "MIT", "file"),
        5: (dict(lc.TEXTS)["BSD-3-Clause"], "BSD-3-Clause", "file"),
        6: (prose + "\nSPDX-License-Identifier: Apache-2.0", "Apache-2.0", "header"),
        7: (prose, None, None),
    }
    rows = [(i, f"d{i}/f", t) for i, (t, _, _) in cases.items()] + [(100 + i, f"e{i}/f", prose + f" x{i}") for i in range(200)]
    out = lc.scan(spark.createDataFrame(rows, "id long, path string, text string"), count_all=True)
    got = {r.id: (r.license, r.origin) for r in out.collect()}
    assert {i: got[i] for i in cases} == {i: (name, origin) for i, (_, name, origin) in cases.items()}
    assert all(got[100 + i] == (None, None) for i in range(200))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
