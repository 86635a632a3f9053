"""The ten operators on small tables: edge cases, exactness, brute force."""

import hashlib
import math
import os
import re
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, common, decontaminate, graph, html_text, language, licenses, line_dedup, near_dup, quality_model, quality_rules, registry, token_store

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, node long, key string"
WORDS = "the of and licence sun river stone cloud tree house light water over under again".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) + f" end{seed}"


LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
ROWS = [(1, prose(1, 60)), (2, prose(1, 60)), (3, None), (4, ""), (5, "  \n \t"), (6, "Ünïcode ß 中文 \U0001f600 é"), (7, LONG), (None, prose(2, 40)), (8, prose(3, 30)), (8, prose(3, 30)), (9, "a b"), (10, "#" * 40 + " | |"), (11, "<|endoftext|> don't 'S")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None, None, "clash", 1, "k") for i, t in ROWS], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_oracles_are_sql():
    """No query is its own oracle: every oracle is the text of a SQL query, and of a registered one."""
    for name, sql in registry.oracle_sql().items():
        assert type(sql) is str and "select" in sql and name in registry.queries()


def test_licences(spark, docs, empty):
    got = licenses.licence_scan(docs).collect()
    assert len(got) == len(ROWS) and licenses.licence_scan(empty).count() == 0
    texts = [(1, "Copyright (c) 2020 A B. All rights reserved.\nPermission is hereby granted, free of charge, to any person obtaining a copy of it. The above copyright notice and this permission notice shall be included in all copies."), (2, "x. Licensed under the Apache License, Version 2.0. Released under the MIT License."), (3, "With permission of the owner."), (4, "Licensed under CC BY-NC 4.0.")]
    found = {r.doc_id: r for r in licenses.licence_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert found[1].licences == "MIT" and found[2].licences == "Apache-2.0,MIT" and found[4].licences == "CC-BY-NC"
    assert (found[3].licences, found[3].n_unknown) == ("", 1)


def test_licences_without_the_word(spark):
    """Sentences that hold none of licence, copyright, permission and the like."""
    want = ["Distributed under the GPL, version 2.", "Released under the GNU GPL.", "Released under CC0.", "Released under CC Zero.", "This work is available under CC BY-SA 4.0.", "Available under Creative Commons Attribution 4.0.", "Released into the\tpublic  domain.", "Proprietary and confidential.", "Unauthorised copying of this file is strictly prohibited.", "The software is provided by us as is and so on.", "Neither the name of A B may be used to endorse products."]
    ids = ["GPL2ref", "GPLref", "CC0ref", "CC0ref", "CCBYSAref", "CCBYref", "PublicDomain", "Proprietary", "Proprietary", "AsIs", "BSDendorse"]
    rows = licenses.licence_scan(spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")).collect()
    assert [r.sentences for r in sorted(rows)] == ids


def test_wrapped_licences(spark):
    """Texts wrapped at 72 columns say what they say in one line; notices of a line each stay apart."""
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation."
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0"
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    wrapped = ["Copyright (c) 2020 A B\n" + "\n\n".join(textwrap.fill(p, 72) for p in t.split("\n\n")) for t in (mit, bsd, apache, gpl)]
    lines = ["Copyright 2020 A B\nReleased under the MIT License", "Some title\nReleased under the MIT License\nReleased under the GPL"]
    rows = licenses.licence_scan(spark.createDataFrame(list(enumerate(wrapped + lines)), "doc_id long, text string")).collect()
    assert [r.licences for r in sorted(rows)] == ["MIT", "BSD-2-Clause", "Apache-2.0", "GPL-3.0", "MIT", "GPL,MIT"]


def brute_components(rows, size, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {(i, len(s)): root(i) for i, s in sets}


def test_near_duplicates_against_brute_force(spark, docs, empty):
    rng = np.random.default_rng(5)
    base = [f"t{k}" for k in range(200)]
    rows = list(ROWS)
    for n in range(60):  # a group of near copies, some of them linked only through others
        words = list(base)
        for k in rng.choice(200, n // 4, replace=False):
            words[k] = f"z{n}_{k}"
        rows.append((100 + n, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(table, size=4).collect()
    want = brute_components(rows, 4, 80)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id, r.n_shingles] and r.kept == (r.component_id == r.doc_id)
    assert near_dup.near_duplicates(docs).count() == len(ROWS)
    assert near_dup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("rounds", [0, 8])
def test_large_mixed_buckets_lose_no_link(spark, monkeypatch, rounds):
    """A dense group around the threshold, in blocks of eight: with and without rounds of new hubs all components are those of brute force."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "PARTNERS", 4)
    monkeypatch.setattr(near_dup, "ROUNDS", rounds)
    rng = np.random.default_rng(23)
    rows = []
    for n in range(150):  # variants of one text, most pairs on either side of the threshold
        words = [f"t{k}" for k in range(120)]
        for k in rng.choice(120, int(rng.integers(1, 6)), replace=False):
            words[k] = f"z{n}_{k}"
        rows.append((n, " ".join(words)))
    rows += [(200, rows[3][1]), (3, rows[70][1]), (201, None)]  # a copy, a second text of an id
    want = brute_components(rows, 3, 80)
    by_doc = {}
    for (i, _), c in want.items():
        by_doc.setdefault(i, set()).add(c)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3).collect()
    assert len(got) == len(rows) and len({r.component_id for r in got}) > 3
    joined = {}  # brute force has a component for each text; those of one doc_id are one
    for r in got:
        for c in by_doc[r.doc_id]:
            assert joined.setdefault(c, r.component_id) == r.component_id
    assert len(set(joined.values())) == len({min(joined[c] for c in cs) for cs in by_doc.values()})


def test_a_large_group_is_joined_by_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(150):
        words = list(base)
        for at in rng.choice(200, 2, replace=False).tolist():
            words[at] = f"x{k}-{at}"
        rows.append((k, " ".join(words)))
    counts = []
    real = near_dup._estimated
    monkeypatch.setattr(near_dup, "_estimated", lambda pairs, nodes, percent: (counts.append(pairs.count()), real(pairs, nodes, percent))[1])
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
    assert {r.component_id for r in got} == {0}
    assert sum(counts) <= 4 * len(rows)


def test_search_between_components_within_tasks(spark, monkeypatch):
    """With one hub pair ruled out, the complete search finds the link."""
    a = [f"a{k}" for k in range(100)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:95] + [f"b{k}" for k in range(5)])), (3, " ".join(a[:90] + [f"c{k}" for k in range(10)]))]
    monkeypatch.setattr(near_dup, "_estimated", lambda pairs, nodes, percent: pairs.where("a = 1 and b = 3"))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3).collect()}
    want = brute_components(rows, 3, 80)
    assert got == {i: c for (i, _), c in want.items()}


def test_components_either_way(spark, monkeypatch):
    """On the driver, in rounds of joins and joined to earlier ones, components are those of a plain search."""
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2)) if a != b] + [(1000 + k, 1001 + k) for k in range(40)]
    least = {x: x for e in edges for x in e}
    for _ in range(len(least)):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    table = spark.createDataFrame(edges, "a long, b long")
    parts = [spark.createDataFrame(edges[k::2], "a long, b long") for k in range(2)]
    for small in (graph.SMALL, 0):
        monkeypatch.setattr(graph, "SMALL", small)
        assert dict(map(tuple, graph.components(table).collect())) == least
        assert dict(map(tuple, graph.joined(graph.components(parts[0]), parts[1]).collect())) == least


def test_small_components_take_no_joins(spark, monkeypatch):
    """Rounds of joins over a few edges leave a file for each task and partition of every exchange."""
    sizes = []
    real = graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: (sizes.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange")), real(df))[1])
    graph.components(spark.createDataFrame([(k, k + 1) for k in range(500)], "a long, b long"))
    assert sizes == [0]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = np.unique(x[:3000]), np.unique(x[1000:])
    ra, rb = near_dup.registers(a), near_dup.registers(b)
    assert (near_dup.merged(ra, rb) == near_dup.registers(np.unique(x))).all()
    found, _ = near_dup.similarity(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([3000.0]), np.array([3000.0]), 0.8)
    assert abs(found[0] - 0.5) < 0.15


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


def agrees(library, texts):
    enc = bpe.encoder()
    for text, ids in zip(texts, enc.encode(texts)):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert enc.decode(ids) == library.decode(want, skip_special_tokens=False)
        assert enc.span((text or "").encode()) == ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n'sStT.!*ÄéßÇabcXYZ0123́\x1c\x85\xa0")), max_size=300), max_size=4))
def test_encoding_is_the_library_s(texts):
    from tokenizers import Tokenizer

    agrees(Tokenizer.from_file(bpe.default_tokenizer()), texts)


def test_encoding_of_seams(library):
    rng = np.random.default_rng(2)
    runs = ["".join(rng.choice(list("abcdefgh"), 5000)), "é" * 3000, "<|endoftext|>" * 200, "a <|startoftext|> b" * 100, LONG[:50_000], "!" * 4000 + " x"]
    agrees(library, runs + [r + " " + s for r in runs for s in runs])
    assert any(len(c) > 3 for c in bpe.cut([r.encode() for r in runs]))


def test_other_tokenizers():
    """A tokenizer that keeps white space goes through the library whole, both ways."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    want, enc = Tokenizer.from_file(path), bpe.Encoder(path)
    assert not enc.by_words and bpe.encoder().by_words
    for text in ("hello  world, a b", "", None, " x\n\n y", "Ünïcode 中文 <|endoftext|>", LONG[:5000]):
        ids = want.encode(text or "", add_special_tokens=False).ids
        got = enc.encode([text])[0]
        assert np.frombuffer(got, "<u4").tolist() == ids and enc.span((text or "").encode()) == got
        assert enc.decode(got) == want.decode(ids, skip_special_tokens=False)


def test_repairs_that_disagree_grow(library, monkeypatch):
    """Where a join doesn't agree with the words on its sides, the whole text is encoded."""
    enc = bpe.Encoder(bpe.default_tokenizer())
    text = prose(21, 400)
    want = library.encode(text, add_special_tokens=False).ids
    assert enc.document(bpe.cut([text.encode()])[0]) == enc.encode([text])[0] == np.array(want, "<u4").tobytes()
    monkeypatch.setattr(enc, "repairs", bpe.Generations(10, lambda span: b"\0\0\0\0"))
    assert enc.document(bpe.cut([text.encode()])[0]) is None
    assert enc.encode([text])[0] == np.array(want, "<u4").tobytes()


def test_shared_passages_are_cut_alike():
    passage = prose(11, 600)
    one, two = bpe.cut([("x " + passage + " tail").encode(), ("another beginning " + passage).encode()])
    assert len(set(one) & set(two)) >= len(one) - 4


def test_bpe_rows(docs, empty):
    got = bpe.bpe_encode_decode(docs).collect()
    assert len(got) == len(ROWS) and bpe.bpe_encode_decode(empty).count() == 0
    assert all((r.n_tokens, r.decoded) == (0, "") for r in got if r.doc_id in (3, 4, 5))
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)


def test_line_dedup(spark, docs, empty):
    shared = "one two three four five six seven eight nine ten"
    texts = [(1, f"alpha beta gamma delta first\n{shared}"), (2, f"{shared}\n{shared}\nonly here are these words"), (3, "user 123 logged in at 10:20 from home today"), (4, "user 777 logged in at 11:59 from home today"), (5, "a b"), (6, "a b"), (7, "one two three four five six seven eight nine else"), (None, shared)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1].n_dropped == 0 and got[2].text == "only here are these words" and got[2].n_dropped == 2
    assert got[3].n_dropped == 0 and got[4].text == ""  # numbers are variable fields
    assert got[5].n_dropped == got[6].n_dropped == 0  # too short
    assert got[None].text == shared
    rows = line_dedup.line_dedup(docs).collect()
    assert len(rows) == len(ROWS) and line_dedup.line_dedup(empty).count() == 0
    assert [r.text for r in rows if r.doc_id == 3] == [None]
    carried = line_dedup.line_dedup(docs, carry=True).where("doc_id = 1").first()
    assert carried.row.row == "clash" and carried.row.text == ROWS[0][1]


def test_line_dedup_of_spread_changes(spark):
    """Some changed words leave few runs of tokens alike, but 57 and 45 of 60 tokens; 44 are too few."""
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]

    def changed(at, to):
        return " ".join(to if k in at else w for k, w in enumerate(words))

    texts = [(1, " ".join(words)), (2, changed((9, 24, 39), "else")), (3, changed(range(4, 49, 3), "other")), (4, changed(range(5, 51, 3), "third"))]
    got = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}
    assert [r.n_dropped for r in line_dedup.line_dedup(spark.createDataFrame(texts, "doc_id long, text string"), min_docs=5).collect()] == [0] * 4


def _letters(k):
    return "".join(chr(97 + k // 26**j % 26) for j in range(3))


def test_line_dedup_links_lines_that_are_nobodys_hub(spark):
    """Lines 3 and 4 are alike, and every token they share stands first in line 1 or 2, which are not like them."""
    shared = [_letters(k) for k in range(40)]
    other = lambda tag, at: [f"{tag}{_letters(k)}" if k in at else w for k, w in enumerate(shared)]
    rows = [other("p", range(4, 40, 2)), other("q", range(5, 40, 2)), other("r", (8, 21)), other("s", (13, 30))]
    table = spark.createDataFrame([(k + 1, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(table).collect()} == {1: 0, 2: 0, 3: 0, 4: 1}


@pytest.mark.parametrize(("block", "rounds", "alike"), [(4, 2, 0.75), (256, 8, 0.75), (4, 0, 0.6)])
def test_line_dedup_against_all_pairs(spark, monkeypatch, block, rounds, alike):
    """Lines around the threshold, of many lengths: classes are those of comparing all pairs of a leaf."""
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    monkeypatch.setattr(line_dedup, "ROUNDS", rounds)
    rng = np.random.default_rng(17)
    rows = []
    for n in (9, 10, 14, 23, 40):
        for v in range(40):
            words = [_letters(k) for k in range(n)]
            for k in range(4, n):
                if rng.random() < 0.3:
                    words[k] = _letters(1000 + int(rng.integers(0, 3 if v % 2 else 9000)))
            rows.append((n, words))
    order = rng.permutation(len(rows)).tolist()
    lines = {" ".join(rows[k][1]): (rows[k], d) for d, k in reversed(list(enumerate(order)))}
    least = {line: d for line, (_, d) in lines.items()}
    alone = dict(least)
    for _ in range(len(lines)):
        was = dict(least)
        for a, ((n, x), _) in lines.items():
            for b, ((m, y), _) in lines.items():
                if n == m and least[b] < least[a] and sum(p == q for p, q in zip(x, y)) >= alike * n:
                    least[a] = least[b]
        if was == least:
            break
    texts = spark.createDataFrame([(k, n, line, d) for k, (line, ((n, _), d)) in enumerate(lines.items())], "rest long, n int, line string, first_doc long").selectExpr("cast(n as long) as leaf", "rest", "n", "line", "first_doc", "first_doc as last_doc")
    frequent = lambda of, *t: of.groupBy("leaf", *t).agg(line_dedup.F.min("first_doc").alias("d0"), line_dedup.F.max("last_doc").alias("d1")).where("d0 != d1").drop("d1")
    got = {r.rest: r.d0 for r in line_dedup._near(texts, frequent, alike).collect()}
    size = Counter(least.values())
    want = {k: least[line] for k, line in enumerate(lines) if size[least[line]] > 1}
    assert got == want and len(set(got.values())) > 1 and len(want) < len(alone)


def test_line_dedup_counts_documents(spark):
    """A template's documents are counted once each, however many of its lines they hold."""
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(30)]
    variant = lambda k: " ".join(words[:20] + [f"v{chr(97 + k)}"] + words[20:])
    texts = [(1, variant(0) + "\n" + variant(1)), (2, variant(2) + "\n" + variant(3)), (3, "none of this"), (5, variant(0)), (6, "same line of seven tokens here\nsame line of seven tokens here"), (7, "same line of seven tokens here")]
    of = lambda rows, n: {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=n).collect()}
    assert of(texts, 2) == {1: 0, 2: 2, 3: 0, 5: 1, 6: 0, 7: 1}
    assert of(texts, 3) == {1: 0, 2: 2, 3: 0, 5: 1, 6: 0, 7: 0}
    assert of(texts, 4) == {1: 0, 2: 0, 3: 0, 5: 0, 6: 0, 7: 0}
    assert of([t for t in texts if t[0] != 5], 3) == {1: 0, 2: 0, 3: 0, 6: 0, 7: 0}


def test_line_dedup_keeps_short_statements(spark):
    """Short lines that differ in a word are different statements; in a number they are the same template."""
    texts = [(1, "the price of gold rose\nwe sold 10 units of it"), (2, "the price of gold fell\nwe sold 12 units of it")]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: texts[0][1], 2: "the price of gold fell"}


def brute_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def brute_buckets(text):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    pair = [xxhash.xxh64_intdigest(int(b).to_bytes(8, "little"), xxhash.xxh64_intdigest(int(a).to_bytes(8, "little"), 42)) for a, b in zip(h, h[1:])]
    return [x & (quality_rules.BUCKETS - 1) for x in h + pair]


def test_quality_rules_against_brute_force(spark, docs, empty):
    rows = ROWS + [(20, prose(4, 50) + "\n" + prose(5, 12) * 3), (21, (prose(6, 10) + "\n") * 6), (22, "abc*** de&&& " * 30)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = {1, 8, 20}
    got = quality_rules.quality_rules(table, spark.createDataFrame([(i,) for i in trusted], "doc_id long")).collect()
    raw, good = Counter(), Counter()
    for i, t in rows:
        b = brute_buckets(t)
        raw.update(b)
        if i in trusted:
            good.update(b)
    n, m = sum(raw.values()), sum(good.values())
    k = quality_rules.SMOOTHING
    weight = {b: round(quality_rules.SCALE * math.log((good[b] + k) / (c * m / n + k))) for b, c in raw.items()}
    want = defaultdict(list)
    for i, t in rows:
        base = brute_rules(t)
        b = brute_buckets(t)
        score = sum(weight[x] for x in b) / (quality_rules.SCALE * len(b)) if b else 0.0
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        want[i].append((*base, failed, round(score, 9), not failed and score >= quality_rules.MIN_SCORE))
    found = defaultdict(list)
    for r in got:
        found[r.doc_id].append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, round(r.score, 9), r.kept))
    assert found == want
    none = spark.createDataFrame([], "doc_id long")
    assert quality_rules.quality_rules(empty, none).count() == 0
    assert {r.score for r in quality_rules.quality_rules(docs, none).collect()} == {0.0}
    assert quality_rules.quality_rules(docs, none, carry=True).select("row.row").first().row == "clash"


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(3)
    x = np.zeros((4000, len(quality_model.FEATURES)))
    x[:, :3] = rng.uniform(-1, 1, (4000, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.uniform(size=4000) < 0.05)).astype(float)
    model = quality_model.AdditiveModel(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert ((model.scores(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.85


def test_trees_of_pairs_against_all_cuts():
    """The step on a pair is the best of all trees of depth two, found by trying them."""
    rng = np.random.default_rng(9)
    for _ in range(40):
        shape = rng.integers(2, 7, 2)
        g, w = rng.normal(size=shape), rng.uniform(3, 9, shape)
        best = (0.0, None)
        for turned in (False, True):
            a, b = (g.T, w.T) if turned else (g, w)
            for cut in range(1, len(a)):
                gain, leaves = 0.0, []
                for rows in (slice(0, cut), slice(cut, None)):
                    options = [(0.0, None)]
                    for c in range(1, a.shape[1]):
                        sums = [(a[rows, s].sum(), b[rows, s].sum()) for s in (slice(0, c), slice(c, None))]
                        if min(x for _, x in sums) >= quality_model.LEAST / 4:
                            options.append((sum(x * x / (y + 1) for x, y in sums), c))
                    gain += max(options, key=lambda o: o[0])[0]
                    leaves.append((rows, max(options, key=lambda o: o[0])[1] or 1))
                if gain > best[0] + 1e-12:
                    best = (gain, (turned, leaves))
        want = np.zeros(shape)
        if best[1]:
            turned, leaves = best[1]
            view, a, b = (want.T, g.T, w.T) if turned else (want, g, w)
            for rows, c in leaves:
                for s in (slice(0, c), slice(c, None)):
                    view[rows, s] = a[rows, s].sum() / (b[rows, s].sum() + 1)
        assert np.allclose(quality_model._pair_tree(g, w), want)
        assert len(np.unique(want)) <= 4


def test_additive_scores_by_hand():
    """A score is the logistic of the intercept and one entry of each table, looked up value by value."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(600, len(quality_model.FEATURES)))
    model = quality_model.AdditiveModel(x[:500], (x[:500, 0] + x[:500, 1] * x[:500, 2] > 0).astype(float))
    for row, score in zip(x[500:], model.scores(x[500:])):
        total = model.intercept
        for j, table in enumerate(model.tables):
            total += table[sum(c <= row[j] for c in model.cuts[j])]
        for (a, b), grid in zip(model.pairs, model.grids):
            total += grid[sum(c <= row[a] for c in model.coarse[a])][sum(c <= row[b] for c in model.coarse[b])]
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-12


def test_quality_of_repeated_ids(spark, docs):
    """An id counts once in fitting, whatever its rows and labels."""
    labels = [(1, 1), (2, 1), (9, 0), (10, 0), (8, 1)]
    once = spark.createDataFrame(labels, "doc_id long, quality int")
    often = spark.createDataFrame(labels * 3, "doc_id long, quality int")
    scores = [sorted((r.doc_id or 0, r.score) for r in quality_model.quality_scores(d, x).distinct().collect()) for d, x in ((docs, once), (docs.union(docs), often))]
    assert scores[0] == scores[1]


def test_quality_scores(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, 1), (9, 0), (10, 0), (None, 1), (8, None)], "doc_id long, quality int")
    got = quality_model.quality_scores(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality_model.quality_scores(empty, labels).count() == 0
    assert len({r.score for r in quality_model.quality_scores(docs, labels.where("quality = 5")).collect()}) == 1
    held = {r.doc_id: r.held_out for r in got}
    import zlib

    assert all(held[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in held if i is not None)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_held_out_accuracy(spark):
    d = SF.replace("0.001", "0.01")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in quality_model.op6_quality(spark, d).collect() if r.held_out and r.doc_id in quality]
    assert sum(r.predicted == quality[r.doc_id] for r in rows) / len(rows) > 0.93
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in language.op7_language(spark, d).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) / len(rows) > 0.97


def test_language(spark, empty):
    rows = [(k, " ".join(np.random.default_rng(k).choice(("the and of with this that".split(), "der die und nicht auch ein".split())[k % 2], 30)), ("en", "de")[k % 2]) for k in range(60)] + [(100, None, "en"), (101, "123 !!", "en"), (102, "the and that", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(table)
    assert model.languages == ["de", "en"] and model.nonzero < 0.5
    got = {r.doc_id: r for r in language.identify(table, model).collect()}
    assert all(got[k].lang_pred == ("en", "de")[k % 2] for k in range(60)) and got[102].lang_pred == "en"
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[101].score == 0
    assert language.identify(empty, model).count() == 0
    nothing = language.fit(empty)
    assert {r.lang_pred for r in language.identify(table, nothing).collect()} == {"und"}


def simple_ftrl(rows):
    """Follow-the-regularised-leader, feature by feature, in plain Python: the languages, weights and biases."""
    languages, size = sorted({x for _, _, x in rows}), 2**language.BITS
    frequency = Counter(int(f) for fs, _, _ in rows for f in fs)
    idf = lambda f: math.log((1 + len(rows)) / (1 + frequency[f])) + 1
    z, n = defaultdict(float), defaultdict(float)

    def weight(f, j):
        if abs(z[f, j]) <= language.L1:
            return 0.0
        return -(z[f, j] - math.copysign(language.L1, z[f, j])) / ((language.BETA + math.sqrt(n[f, j])) / language.ALPHA + language.L2)

    kept = [r for k, r in enumerate(rows) if k % 10]
    for _ in range(language.PASSES):
        for fs, counts, lang in kept:
            x = {int(f): language.SCALE * idf(int(f)) * c / sum(counts) for f, c in zip(fs, counts)} | {size: 1.0}
            w = {(f, j): weight(f, j) for f in x for j in range(len(languages))}
            logits = [sum(v * w[f, j] for f, v in x.items()) for j in range(len(languages))]
            p = [math.exp(v - max(logits)) for v in logits]
            for j, q in enumerate(p):
                slope = q / sum(p) - (languages[j] == lang)
                for f, v in x.items():
                    g = v * slope
                    sigma = (math.sqrt(n[f, j] + g * g) - math.sqrt(n[f, j])) / language.ALPHA
                    z[f, j] += g - sigma * w[f, j]
                    n[f, j] += g * g
    return languages, {(f, j): language.SCALE * idf(f) * weight(f, j) for f, j in list(z) if f < size}, [weight(size, j) for j in range(len(languages))]


def test_language_model_against_plain_python():
    """Weights equal those of FTRL step by step; predictions equal sums of weights, n-gram by n-gram, calibrated."""
    rng = np.random.default_rng(12)
    vocabulary = {"en": "the and of with this that".split(), "de": "der die und nicht auch ein".split(), "fr": "le la et des avec pour".split()}
    texts = [(" ".join(rng.choice(vocabulary[x], 6)), x) for x in list(vocabulary) * 12]
    rows = []
    for text, lang in texts:
        grams, _, _ = language.ngrams(*language.letters([text]))
        f, c = np.unique(grams, return_counts=True)
        rows.append((f, c.astype(float), lang))
    model = language.LanguageModel(rows)
    languages, weights, bias = simple_ftrl(rows)
    assert model.languages == languages and np.allclose(model.bias, bias, atol=1e-5)
    dense = np.zeros_like(model.table)
    for (f, j), w in weights.items():
        dense[f, j] = w
    assert np.allclose(model.table, dense, atol=1e-4) and 0 < (dense != 0).mean() < 0.05
    for text in ("the die avec", "und", LONG[:3000]):
        grams, _, _ = language.ngrams(*language.letters([text]))
        logits = [(sum(dense[g][j] for g in grams) / len(grams) + bias[j]) / model.temperature for j in range(3)]
        p = np.exp(np.array(logits) - max(logits))
        got, score = model.predict([text])
        assert got == [languages[int(p.argmax())]] and abs(score[0] - p.max() / p.sum()) < 1e-4


def test_language_of_odd_rows(spark, docs, empty):
    rows = [(k, " ".join(np.random.default_rng(k).choice(("the and of with this that".split(), "der die und nicht auch ein".split())[k % 2], 30)), ("en", "de")[k % 2], "clash") for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language.fit(table)
    same = language.fit(table.union(table).union(table))
    assert (model.table == same.table).all() and model.temperature == same.temperature  # repeated rows count once
    got = language.identify(docs, model).collect()
    assert len(got) == len(ROWS) and {r.lang_pred for r in got if r.doc_id in (3, 4, 5, 10)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (7, None)} <= {"en", "de"}  # a very long text, a null id
    marks = language.letters(["\u0915\u093f\u0924\u093e\u092c", "\u0301 \u0301"])
    assert 32 not in marks[0][1:6].tolist() and language.has_letter(*marks).tolist() == [True, False]


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("a<br>b", "a\nb"), ("<ul><li>x<li>y</ul>", "- x\n- y"), ("<ol start=4><li>x<li>y", "4. x\n5. y"),
        ("<ul><li>a<ul><li>b</ul></ul>", "- a\n  - b"), ("<table><tr><td>aa<td>b<tr><td>c<td>dd</table>", "aa  b\nc   dd"), ("<div hidden>no</div>yes", "yes"), ('<p style="display:none">no</p>yes', "yes"),
        ("<script>var x = '</p>';</script>a &amp; b", "a & b"), ("<title>t</title><h1>H</h1>x", "H\n\nx"), ("<pre> a\n  b</pre>", " a\n  b"), ("<!-- c -->x<!-- open", "x"), ("a < b", "a < b"), ("<dl><dt>t<dd>d</dl>", "t\n  d"),
        ("<b>x</b> <i>y</i>", "x y"), ("<img alt='pic'>", "pic"), ("<blockquote><p>q</blockquote>", "  q"), ("<a title='a>b'>x</a>", "x"), ("<a 'open>x", "x"),
    ],
)
def test_html(page, text):
    assert html_text.render(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<tr>x", "x"), ("<thead>x", "x"), ("<td>a<td>b", "a b"), ("<td colspan='²'>a", "a"), ("<table><tr><td colspan='²'>a<td>b", "a  b"), ("<table><tr><td colspan=" + "9" * 5000 + ">a", "a"), ("<ol start='²'><li>x", "1. x"), ("<ol start='--5'><li>x", "1. x"), ("<ol start=-5><li>x<li value=9>y", "-5. x\n9. y"),
        ("<div>" * 250 + "<div hidden><p>SECRET", ""), ("<table>" * 300 + "<tr><td>x", "x"), ("<div>" * 100_000 + "x", "x"), ("<table><tr><td>" * 3_000 + "x", "x"), ("<p><button>" + "<div>" * 50_000 + "x", "x"), ("&#" + "9" * 5000 + ";x&#0000000065;", "\ufffdxA"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d</table>", "a  b\n   c\nd"), ("<table><tr><td colspan=2>long text<td>x<tr><td>a<td>b<td>c</table>", "long text  x\na  b       c"),
        ("<table><tr><td>a<td>b<tr><td colspan=1000>wide</table>", "a  b\nwide"), ("<ul><li><p>a<p>b<li>c</ul>", "- a\n\n  b\n- c"), ("<ul><li><ul><li>x</ul></ul>", "- - x"), ("<table><tr><td>" + "w" * 600 + "<td>x<br>y<tr><td>a<td>b</table>", "w" * 600 + "\nx\ny\na  b"),
    ],
)
def test_broken_html(page, text):
    assert html_text.render(page) == text


TAGS = "p div span ul ol li table tr td th thead tbody tfoot caption col dl dt dd pre b i a h1 h2 select option button form blockquote br hr center section".split()
ATTRIBUTES = ["", "", "", " colspan=2", " rowspan=3", " rowspan=0", " start=5", " class=x", " colspan='²'", " 'open"]


def test_tag_soup_loses_no_text():
    """10,000 pages of random start and end tags: all words are there, once; under a hidden element none is."""
    rng = np.random.default_rng(6)
    for n in range(10_000):
        soup, words = [], []
        for kind, tag, attributes in zip(rng.uniform(size=30), rng.integers(0, len(TAGS), 30), rng.integers(0, len(ATTRIBUTES), 30)):
            if kind < 0.4:
                soup.append(f"<{TAGS[tag]}{ATTRIBUTES[attributes]}>")
            elif kind < 0.65 and n % 2:
                soup.append(f"</{TAGS[tag]}>")
            else:
                words.append(f"w{len(words)}")
                soup.append(f" {words[-1]} ")
        page = "".join(soup)
        assert sorted(re.findall(r"w[0-9]+", html_text.render(page))) == sorted(words), page
        if n % 2 == 0:
            assert html_text.render(f"a<div style='display: none'>{page}") == "a", page


def simple_layout(tree) -> list[str]:
    """A plain recursive renderer of well-formed trees (tag, children): lists, quotations and cells get their lines by calls of their own."""
    events = []  # texts, gaps, and lists of finished lines

    def visit(tree):
        for child in tree[1]:
            if isinstance(child, str):
                events.append(child)
            elif child[0] == "b":
                visit(child)
            elif child[0] != "hidden":
                around = 1 if child[0] in ("p", "table", "blockquote") or child[0] == "ul" and tree[0] != "li" else 0
                events.append(around)
                if child[0] == "table":
                    cells = [[simple_layout(c) for c in row[1]] for row in child[1]]
                    width = [max(len(x) for row in cells for x in [*row[c], ""]) + 2 for c in range(len(cells[0]))]
                    events.append(["".join((cell[h] if h < len(cell) else "").ljust(w) for cell, w in zip(row, width)).rstrip() for row in cells for h in range(max(map(len, row)))])
                elif child[0] in ("li", "blockquote"):
                    mark = "- " if child[0] == "li" else "  "
                    events.append([(mark if k == 0 else "  " if x else "") + x for k, x in enumerate(simple_layout(child))])
                else:
                    visit(child)
                events.append(around)

    visit(tree)
    lines, inline, gap = [], "", 0
    for e in [*events, 0]:
        if isinstance(e, str):
            inline += e
            continue
        for new in (re.findall(r"\S.*\S", re.sub(" +", " ", inline)), e if isinstance(e, list) else []):
            if new:
                lines += [""] * (gap if lines else 0) + new
                gap = 0
        inline, gap = "", max(gap, e) if isinstance(e, int) else gap
    return lines


def test_html_against_a_simple_renderer():
    rng = np.random.default_rng(8)
    number = iter(range(10**9))

    def node(tag, depth):
        if tag == "b" or depth == 0:
            return ("div" if tag == "table" else tag, [f" w{next(number)} "])
        if tag == "ul":
            return (tag, [node("li", depth - 1) for _ in range(rng.integers(1, 4))])
        if tag == "table":
            columns = rng.integers(1, 4)
            return (tag, [("tr", [node("td", depth - 1) for _ in range(columns)]) for _ in range(rng.integers(1, 4))])
        return (tag, [f" w{next(number)} " if x == "text" else node(x, depth - 1) for x in rng.choice(["text", "text", "b", "div", "p", "ul", "table", "blockquote", "hidden"], rng.integers(1, 5)) if not (tag == "p" and x not in ("text", "b"))])

    def written(tree):
        if isinstance(tree, str):
            return tree
        tag = "div hidden" if tree[0] == "hidden" else tree[0]
        return f"<{tag}>" + "".join(map(written, tree[1])) + f"</{tag.split()[0]}>"

    for _ in range(2_000):
        tree = node("body", int(rng.integers(1, 5)))
        page = "".join(map(written, tree[1]))
        assert html_text.render(page).split("\n") == (simple_layout(tree) or [""]), page


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/abpdivtrl \"'=&;!-", max_size=200))
def test_html_never_fails(page):
    html_text.render(page)


def test_html_rows(spark):
    long = "<p>" + LONG + "<p>" + LONG
    pages = spark.createDataFrame([(1, "u", "<p>x", "clash"), (None, None, None, None), (1, "u", "<p>x", "clash"), (2, "u", long, "")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in html_text.html_text(pages).collect()) == [(0, ""), (1, "x"), (1, "x"), (2, LONG + "\n\n" + LONG)]
    assert html_text.html_text(pages.where("false")).count() == 0


def test_search_retrieves_what_full_scoring_does():
    rng = np.random.default_rng(4)
    vocabulary = [f"v{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary, rng.integers(6, 40)))) for k in range(90)]
    index = decontaminate.Index(items)
    texts = []
    for k in range(200):
        words = list(rng.choice(vocabulary, rng.integers(0, 120)))
        if k % 3 == 0:
            words[10:10] = items[k % 90][1].split()
        texts.append(words)
    least = 0.5
    got = index.search([index.term_ids(w) for w in texts], least)
    flat = index.impacts.reshape(len(index.term) + 1, -1)
    for t, words in enumerate(texts):
        want = set()
        for start in range(0, max(len(words), 1), index.width):
            terms = {index.term.get(w, 0) for w in words[start : start + 2 * index.width]} - {0}
            score = flat[sorted(terms)].sum(axis=0) if terms else np.zeros(flat.shape[1])
            want |= {k for k in np.flatnonzero(score >= least - 1e-6).tolist() if k < len(index.items)}
        assert got.get(t, set()) == want


def test_search_of_a_sliced_benchmark():
    """With the statistics of the whole benchmark, 1, 2 and 7 slices retrieve the same items, whatever the block."""
    rng = np.random.default_rng(14)
    vocabulary = [f"v{k}" for k in range(150)]
    items = [(k, " ".join(rng.choice(vocabulary, rng.integers(3, 30)))) for k in range(200)] + [(300, "v1 v1 v1"), (301, None), (302, "!")]
    texts = [[*rng.choice(vocabulary, rng.integers(0, 200)), *(items[k][1].split() if k % 2 else [])] for k in range(100)]
    statistics = decontaminate.Statistics([decontaminate.tokens(t) for _, t in items])
    width = max(len(decontaminate.tokens(t)) for _, t in items)

    def retrieved(slices):
        out = defaultdict(set)
        for s in range(slices):
            index = decontaminate.Index(items[s::slices], statistics)
            index.width = width
            for text, got in index.search([index.term_ids(w) for w in texts], 0.5).items():
                out[text] |= {index.items[k][0] for k in got}
        return out

    whole = retrieved(1)
    assert sum(map(len, whole.values())) > 50 and all(len(set(texts[t])) for t in whole)
    assert retrieved(2) == whole and retrieved(7) == whole


def test_index_of_a_large_benchmark():
    """100,000 items: the index is in proportion to the postings, and every item finds itself."""
    rng = np.random.default_rng(15)
    picked = rng.zipf(1.3, (100_000, 12)) % 200_000
    items = [(k, " ".join(f"t{x}" for x in row)) for k, row in enumerate(picked.tolist())]
    index = decontaminate.Index(items)
    postings = sum(len(set(row)) for row in picked.tolist())
    assert len(index.item) == len(index.impact) == postings
    assert sum(x.nbytes for x in (index.item, index.impact, index.begin, index.run, index.run_top, index.first_run, index.top)) < 48 * postings
    some = list(range(0, 100_000, 997))
    got = index.search([index.term_ids(items[k][1].split()) for k in some], 0.9)
    place = {i: k for k, (i, _) in enumerate(index.items)}
    assert all(place[k] in got[t] for t, k in enumerate(some))


def test_leaks(spark, docs, empty):
    item = prose(50, 40)
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "two words"), (None, item), (5, prose(51, 30))], "item_id long, text string")
    rows = [(1, prose(60, 100) + " " + item + " " + prose(61, 300)), (2, prose(62, 200)), (3, None), (4, ""), (None, item), (6, "x two words y"), (6, item), (6, item)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id) for r in decontaminate.leaks(table, items).collect())
    assert got == [(0, 1), (1, 1), (6, 1), (6, 1), (6, 4)]
    assert sorted(r.doc_id for r in decontaminate.without_leaks(table, items).collect()) == [2, 3, 4]
    assert decontaminate.leaks(empty, items).count() == 0 and decontaminate.leaks(docs, items.where("false")).count() == 0
    assert decontaminate.without_leaks(docs, items).columns == docs.columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=400), st.integers(0, 3))
def test_containers_round_trip(ids, extra):
    seq = np.array(ids * (1 + 3 * extra) + [7] * extra, np.uint32)
    c = token_store.Container(token_store.compress(seq, [len(seq)]))
    assert np.concatenate([*c.documents(), np.empty(0, np.uint32)]).tolist() == seq.tolist()
    for a in range(0, len(seq), max(1, len(seq) // 7)):
        assert c.read(a, min(len(seq), a + 13)).tolist() == seq[a : a + 13].tolist()


def test_large_symbols_round_trip():
    seq = np.random.default_rng(1).integers(0, 20, 50_000).astype(np.uint32) * 50_000
    data = token_store.compress(seq, [20_000, 30_000])
    c = token_store.Container(data)
    assert [len(d) for d in c.documents()] == [20_000, 30_000] and (c.read(12_345, 45_678) == seq[12_345:45_678]).all()
    assert len(data) < 4 * len(seq)


def test_token_store(spark, docs, empty, tmp_path, library):
    import zlib

    token_store.write_tokens(docs, str(tmp_path / "a"))
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in token_store.read_tokens(spark, str(tmp_path / "a")).collect())
    at = 0
    for (_, doc_id, start, n, crc), (i, t) in zip(got, sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert (doc_id, start, n, crc) == (i or 0, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += n
    token_store.write_tokens(empty, str(tmp_path / "b"))
    assert token_store.read_tokens(spark, str(tmp_path / "b")).count() == 0


def test_pairs_are_replaced_to_the_end():
    """No pair is left that occurs LEAST times, with 16-bit symbols and beyond; one repeated pair takes as many rules as it takes to halve it away."""
    data = token_store.compress(np.tile(np.array([5, 6], np.uint32), 200_000), [400_000])
    c = token_store.Container(data)
    assert c.n_symbols < 2 * token_store.LEAST and len(data) < 400
    rng = np.random.default_rng(3)
    for seq in (rng.zipf(1.2, 200_000) % 40_000, 49_000 + rng.integers(0, 300, 600_000)):
        seq = seq.astype(np.uint32)
        c = token_store.Container(token_store.compress(seq, [len(seq)]))
        symbols = c.symbols(0, c.n_symbols).astype(np.uint64)
        _, counts = np.unique(symbols[:-1] << np.uint64(32) | symbols[1:], return_counts=True)
        assert counts.max() < token_store.LEAST and (np.concatenate(list(c.documents())) == seq).all()


def test_starts_of_many_shards(spark, monkeypatch):
    """Starts are the sums of all shards before, also where these are added up in several steps and joined by a shuffle."""
    monkeypatch.setattr(token_store, "SHARDS", 7)
    tokens = np.random.default_rng(5).integers(1, 100, 60).tolist()
    rows = [(k // 2 * 3, k % 2, n) for k, n in enumerate(tokens)]
    got = {r.shard: r.start for r in token_store._starts(spark.createDataFrame(rows, "shard int, number int, tokens long")).collect()}
    assert got == {k // 2 * 3: sum(tokens[: k // 2 * 2]) for k in range(60)}


def test_token_store_cleans_up(spark, monkeypatch, tmp_path):
    """The query's files hold all documents as long as its rows may be read, and go with the process."""
    monkeypatch.setattr(token_store, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(token_store, "BROADCAST_SHARDS", 0)
    rows = sorted(token_store.op10_token_store(spark, SF).collect())
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows]).tolist()][:-1] and len({r.doc_id for r in rows}) == len(rows)
    assert list(tmp_path.iterdir())
    common.remove_all()
    assert not list(tmp_path.iterdir())


def test_workers_keep_the_caches_of_one_operator(monkeypatch):
    emptied = []
    monkeypatch.setattr(common, "_CACHES", {"a": lambda: emptied.append("a"), "b": lambda: emptied.append("b")})
    monkeypatch.setattr(common, "_AT_WORK", [""])
    for module in ("a", "a", "b", "c", "c", "a"):
        common.at_work(module)
    assert emptied == ["b", "a", "a", "b", "b"]
    enc = bpe.encoder()
    enc.encode(["some words"])
    bpe._ENCODERS.clear()
    assert bpe.encoder() is not enc


def test_digests(spark):
    got = bpe.op3_bpe(spark, SF).limit(3).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    enc = bpe.encoder()
    for r in got:
        ids = enc.encode([text[r.doc_id]])[0]
        assert r.ids_sha256 == hashlib.sha256(ids).hexdigest() and r.decoded_sha256 == hashlib.sha256(enc.decode(ids).encode()).hexdigest()


def test_spans_of_groups_are_the_librarys():
    enc = bpe.encoder()
    texts = [None, "", " \n", "It's a<b> <|endoftext|> <|STARTOFTEXT|>", "ÀÉß×÷ ÿÿ12x3 µ½ª", "日本 語a1 x\x1cy z\x00 \x0b\x0c\r\t é", "|||  a||b 0x1F", "A" * 5000 + " " + "9" * 50, "İstanbul ΑΣ", "a b c"]
    for group in (texts, [None], [""], [], ["same same"] * 3):
        pieces, sizes = enc.spans(pa.array(group, pa.string()), 1)
        want = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in group]
        assert [x for p in pieces for x in p.tolist()] == [x for w in want for x in w]
        assert sizes.tolist() == [len(w) for w in want]
