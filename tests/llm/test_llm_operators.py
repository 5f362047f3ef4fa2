"""Operators against plain Python on awkward rows, and on empty tables."""

import gzip
import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from kinlink.llm import decontaminate, langid, licences, mixing, near, quality, scoring, substrings, tokens, warc


def collected(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


# --- mixing --------------------------------------------------------------------------------------------------------
def test_mix_targets_and_sums(docs, rows):
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(brute.words_of(r[1]))
    want = brute.targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r.mix_size == len(brute.words_of(r.text)) and r.mix_source_size == sizes[r.source]
        assert r.mix_target == pytest.approx(want[r.source])
        assert 0 <= r.mix_taken <= 2 * r.mix_size
        taken[r.source] += r.mix_taken
    # Epochs are complete before the sample: documents differ by at most one take, and budgets are met to a word.
    for source, target in want.items():
        assert abs(taken[source] - target) <= 1
        epochs = int(target // sizes[source]) if sizes[source] else 0
        assert all(r.mix_taken >= epochs * r.mix_size for r in got if r.source == source)
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), abs=len(want))


def test_mix_reruns_agree_and_follow_keys(docs):
    first, again = (collected(mixing.mix(d), "doc_id", "text", "mix_taken") for d in (docs, docs.repartition(3)))
    assert first == again


def test_sampling_takes_smallest_keys_first(spark):
    frame = spark.createDataFrame([(i, "w " * (i % 7 + 1), "s") for i in range(300)], "doc_id long, text string, source string")
    got = mixing.mix(frame, share=0.5).collect()

    def key(r):
        u = (int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -np.log(u) / max(0.05, 1 / (1 + abs(np.log(max(len(r.text) / r.mix_size, 0.1) / 6))))

    whole = sorted(got, key=key)
    left = int(got[0].mix_target + 0.5)
    for r in whole:
        assert r.mix_taken == min(r.mix_size, left)
        left -= r.mix_taken
    assert left == 0


@pytest.mark.parametrize("letters", [6, 300])
def test_mix_cuts_full_slices_again(spark, letters):
    """Long words have low weights, and their keys lie in the last slices; these are cut until few rows are left to order."""
    frame = [(i, " ".join(["x" * letters] * (i % 5 + 1)), "s" if i % 3 else None, "clash") for i in range(3000)]
    frame = spark.createDataFrame(frame, "doc_id long, text string, source string, _low string")
    want = collected(mixing.mix(frame, share=0.7), "doc_id", "mix_taken", "mix_target")
    names, whole = [], mixing.cut
    mixing.cut = lambda df, name: names.append(name) or whole(df, name)
    try:
        fine = mixing.mix(frame, share=0.7, most_rows=3)
    finally:
        mixing.cut = whole
    assert collected(fine, "doc_id", "mix_taken", "mix_target") == want and fine.columns[:4] == frame.columns
    assert names.count("mix-finer-slices") >= 1


def test_mixed_documents_repeat_whole_rows(docs):
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    taken = {(r.doc_id, r.text): round(r.mix_taken / r.mix_size) if r.mix_size else 0 for r in mixing.mix(docs).collect()}
    copies = collected(got, "doc_id", "text")
    assert all(copies[k] % n == 0 if n else not copies[k] for k, n in taken.items())


# --- quality -------------------------------------------------------------------------------------------------------
def test_quality_statistics_and_base_rules(docs, rows):
    got = quality.judge_quality(docs).collect()
    want = Counter()
    for r in rows:
        s = brute.statistics(r[1])
        want[(r[0], *s, s[0] < 10 or 100 * s[4] > 20 * s[0])] += 1
    assert Counter((r.doc_id, *(r[n] for n in quality.STATISTICS), r.base_failed) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)


def test_quality_rejects_the_planted_outlier_only(spark):
    rnd = random.Random(3)
    prose = lambda: " ".join("".join(rnd.choice("abcdef") for _ in range(rnd.randint(3, 8))) for _ in range(rnd.randint(60, 160)))
    frame = [(i, prose(), "en", "a") for i in range(300)]
    frame += [(1000 + i, " ".join("#" * 30 + "<>|" * rnd.randint(20, 30) for _ in range(100)), "en", "a") for i in range(40)]
    got = quality.judge_quality(spark.createDataFrame(frame, "doc_id long, text string, lang string, source string")).collect()
    # A tenth of outliers alike would pull a plain covariance to themselves.
    assert {r.doc_id for r in got if not r.kept} == {i for i, *_ in frame if i >= 1000}


def test_small_groups_are_judged_by_wider_ones(spark):
    rnd = random.Random(4)
    prose = lambda: " ".join("".join(rnd.choice("abcdef") for _ in range(rnd.randint(3, 8))) for _ in range(rnd.randint(60, 160)))
    debris = lambda: " ".join(f"{rnd.randrange(10**6)}" + "#" * 30 + "<>|" * rnd.randint(20, 30) for _ in range(100))
    frame = [(i, prose(), "en", "a") for i in range(300)] + [(300 + i, prose(), "fr", f"{i % 10}") for i in range(60)]
    # Rare sources of a language, a rare language, and no language at all, each with a good document and an outlier.
    places = [("en", "rare"), ("en", None), ("fr", "3"), ("fr", "new"), ("it", "a"), (None, None), (None, "b")]
    frame += [(1000 + i, prose(), *p) for i, p in enumerate(places)] + [(2000 + i, debris(), *p) for i, p in enumerate(places)]
    columns = "doc_id long, text string, lang string, source string"
    got = quality.judge_quality(spark.createDataFrame(frame, columns)).collect()
    assert len(got) == len(frame) and not any(r.base_failed for r in got)
    assert {r.doc_id for r in got if not r.kept} == {f[0] for f in frame if f[0] >= 2000}
    few = quality.judge_quality(spark.createDataFrame(frame[-7:] + frame[:5], columns)).collect()
    assert all(r.kept and r.distance2 is None for r in few)


def test_quality_rejects_table_debris(spark):
    """Labelled documents: nearly all low-quality ones that pass the base rules go, nearly all good ones stay."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = Counter(tuple(r) for r in quality.judge_quality(docs).join(labels, "doc_id").where("NOT base_failed").select("quality", "kept").collect())
    assert got[0, True] <= 0.03 * got[0, False] and got[1, False] <= 0.003 * got[1, True]


def test_covariance_matches_numpy(spark):
    random_state = np.random.default_rng(2)
    factor = np.tril(random_state.normal(size=(5, 5))) + 3 * np.eye(5)
    points = random_state.normal(size=(4000, 5)) @ factor.T
    points[:400] += 60
    frame = spark.createDataFrame([("en", "a", *map(float, p)) for p in points], "lang string, source string, " + ", ".join(f"{n} double" for n in quality.NAMES))
    found = quality.covariance_estimates(frame, steps=6).first()
    lower = np.zeros((5, 5))
    for j in range(5):
        for k in range(j + 1):
            lower[j, k] = found[f"l_{j}_{k}"]
    center = np.array([found[f"m_{j}"] for j in range(5)])
    assert np.abs(center).max() < 0.6
    share = lower @ lower.T / (factor @ factor.T)
    assert 0.7 < share[np.eye(5, dtype=bool)].min() and share[np.eye(5, dtype=bool)].max() < 1.4


def test_chi_square():
    assert quality.chi_square_point(0.95, 5) == pytest.approx(11.0705, abs=1e-3)
    assert quality.chi_square_share(7.815, 3) == pytest.approx(0.95, abs=1e-4)


# --- licences ------------------------------------------------------------------------------------------------------
def test_licences_of_notices(spark):
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and\nassociated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software.\n"
    )
    parts = mit.split("\n\n")
    frame = [
        (1, "Some words\nReleased under the MIT License.", "MIT"), (2, mit, "MIT"), (3, parts[1] + "\n\n" + parts[0], ""),
        (4, None, ""), (5, "", ""), (6, "This work is licensed under the GNU General Public License, version 3. All rights reserved.", "GPL-3.0,Proprietary"),
        (7, "licensed under cc by-nc 4.0", "CC-BY-NC-4.0"), (8, "not released under the MIT license at all", ""),
    ]
    got = licences.scan_licences(spark.createDataFrame([f[:2] for f in frame], "doc_id long, text string"))
    assert {r.doc_id: r.licences for r in got.collect()} == {f[0]: f[2] for f in frame}


def gnu_notice(what, name, marks, version):
    one, two = marks
    return (
        f"This {what} is free software{one} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free "
        f"Software Foundation{two} either version {version} of the License, or (at your option) any later version.\n\nThis {what} is distributed "
        "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        f"PARTICULAR PURPOSE.  See the GNU {name} for more details."
    )


BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
    "the documentation and/or other materials provided with the distribution.",
    "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product "
    "includes software developed by the organization.",
    "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without "
    "specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.",
]
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
    "file, You can obtain one at {}://mozilla.org/MPL/2.0/."
)
GPL, LESSER, AFFERO = "General Public License", "Lesser General Public License", "Affero General Public License"
CANONICAL = [
    (gnu_notice("program", GPL, ":,", 3), "GPL-3.0-or-later"), (gnu_notice("program", GPL, ";;", 3), "GPL-3.0-or-later"),
    (gnu_notice("program", GPL, ";;", 2), "GPL-2.0-or-later"), (gnu_notice("library", LESSER, ";;", 2.1), "LGPL-2.1-or-later"),
    (gnu_notice("program", LESSER, ":,", 3), "LGPL-3.0-or-later"), (gnu_notice("library", "Library General Public License", ";;", 2), "LGPL-2.0-or-later"),
    (gnu_notice("program", AFFERO, ":,", 3), "AGPL-3.0-or-later"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "GPL-2.0"),
    ("\n\n".join([*BSD[:3], BSD[5]]), "BSD-2-Clause"), ("\n\n".join(BSD[:3]), "BSD-2-Clause"),
    ("\n\n".join([*BSD[:3], "3. " + BSD[4].format("the copyright holder"), BSD[5]]), "BSD-3-Clause"),
    ("\n\n".join([*BSD[:3], "* " + BSD[4].format("Example Inc."), BSD[5]]), "BSD-3-Clause"),
    ("\n\n".join([*BSD[:4], "4. " + BSD[4].format("the organization"), BSD[5]]), "BSD-4-Clause"),
    ("\n\n".join([*BSD[:3], BSD[4].format("A"), BSD[5], *BSD[:3], BSD[5]]), "BSD-3-Clause,BSD-2-Clause"),
    (ISC + ", provided that the above copyright notice and this permission notice appear in all copies.", "ISC"), (ISC + ".", "0BSD"),
    (MPL.format("https"), "MPL-2.0"), (MPL.format("http"), "MPL-2.0"),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy.", "Unlicense"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at", "Apache-2.0"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("This project is licensed under the MIT License.", "MIT"),
    ("This project is licensed under the MIT License - see the [LICENSE](LICENSE) file for details.", "MIT"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"),
    ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"), ("Licensed under CC0 1.0.", "CC0-1.0"),
    ("This software is licensed under the ISC License.", "ISC"), ("Released under the BSD 3-Clause License.", "BSD-3-Clause"),
    ("This project is licensed under the Mozilla Public License 2.0.", "MPL-2.0"), ("This project is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
]


def test_licences_of_canonical_texts(spark):
    """Each notice by paragraphs, wrapped, and wrapped in a comment; the same by SQL."""
    import duckdb

    frame = []
    for text, want in CANONICAL:
        wrapped = "\n\n".join(textwrap.fill(p, 70, break_on_hyphens=False) for p in text.split("\n\n"))
        for form in (text, wrapped, textwrap.indent(wrapped, " * ", lambda line: line.strip())):
            frame.append((len(frame), f"Some words.\n\n{form}\n\nOther words.", want))
    got = licences.scan_licences(spark.createDataFrame([f[:2] for f in frame], "doc_id long, text string")).collect()
    assert {r.doc_id: r.licences for r in got} == {f[0]: f[2] for f in frame}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [f[:2] for f in frame])
    assert sorted(con.execute(licences.scan_sql()).fetchall()) == sorted(tuple(r) for r in got)


def test_rights_reserved_and_spdx_tags(spark):
    import duckdb

    texts = []
    for text, name in CANONICAL:
        wrapped = "\n\n".join(textwrap.fill(p, 70, break_on_hyphens=False) for p in text.split("\n\n"))
        for mark in ("\n", ". "):
            texts += [(f"Copyright (c) 2012, Some Holder{mark}All rights reserved.\n\n{form}", name) for form in (text, wrapped)]
    texts += [
        ("// SPDX-License-Identifier: Apache-2.0\nint main", "Apache-2.0"), ("# SPDX-License-Identifier: MIT", "MIT"),
        ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0-or-later"), ("MIT", ""), ("SPDX-License-Identifier: own", ""),
        ("Copyright 2001 Some Firm. All rights reserved.", "Proprietary"),
        ("All rights reserved. Licensed under the MIT License. All rights reserved.", "MIT,Proprietary"),
    ]
    frame = [(k, text) for k, (text, _) in enumerate(texts)]
    got = licences.scan_licences(spark.createDataFrame(frame, "doc_id long, text string")).collect()
    assert {r.doc_id: r.licences for r in got} == {k: name for k, (_, name) in enumerate(texts)}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", frame)
    assert sorted(con.execute(licences.scan_sql()).fetchall()) == sorted(tuple(r) for r in got)


def test_licences_of_awkward_rows(docs, rows):
    assert licences.scan_licences(docs).count() == len(rows)


# --- language identification ---------------------------------------------------------------------------------------
def test_languages_of_awkward_rows(docs, rows):
    got = langid.languages(docs).collect()
    assert Counter((r.doc_id, r.text, r.held_out) for r in got) == Counter((r[0], r[1], brute.held_out(r[0])) for r in rows)
    plain = {(r[0], r[1]): r[2] for r in rows[:120]}
    for r in got:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "fr") and 0 <= r.score <= 1
        assert plain.get((r.doc_id, r.text), r.lang_pred) == r.lang_pred


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got) > 0


def test_ngram_counts_in_parts(monkeypatch):
    text = "Les élèves, d'été 12 à ñandú " * 40
    whole = langid.ngram_counts(text)
    want = Counter()
    folded = " " + re.sub(r"[^a-zàéèñú]+", " ", text.lower()).strip() + " "
    for n in (1, 2, 3):
        want.update(g for i in range(len(folded) - n + 1) if (g := folded[i : i + n]) != " " and g[1:-1] != " ")
    unpacked = {"".join(chr(c >> s & 0x1FFFFF) for s in (42, 21, 0) if c >> s & 0x1FFFFF): n for c, n in zip(*(x.tolist() for x in whole), strict=True)}
    assert unpacked == dict(want)
    monkeypatch.setattr(langid, "CHUNK", 17)
    assert all((a == b).all() for a, b in zip(whole, langid.ngram_counts(text), strict=True))


# --- near duplicates -----------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates_of_awkward_rows(docs, rows, n):
    got = collected(near.near_duplicates(docs, n), "doc_id", "n_shingles", "component_id", "kept")
    assert got == Counter(brute.near_components([(r[0], r[1]) for r in rows], n, 80))


def test_without_near_duplicates(docs, rows):
    got = near.without_near_duplicates(docs)
    assert got.columns == docs.columns
    judged = brute.near_components([(r[0], r[1]) for r in rows], 5, 80)
    kept = {r[0] for r in judged if r[3]}
    want = {(r[0], r[1]) for r in rows if r[0] in kept or r[0] is None}
    assert set(collected(got, "doc_id", "text")) == want
    assert max(n for k, n in collected(got, "doc_id", "text").items() if k[0] is not None) == 1


@pytest.mark.parametrize("block", [2048, 9])
def test_copies_without_an_original(spark, block):
    # Copies of a base that is not there: the leader links to few, so pairs of the open lists have to find the rest.
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    frame = []
    for k in range(60):
        words = list(base)
        for _ in range(rnd.randint(2, 7)):
            words[rnd.randrange(200)] = f"n{rnd.randrange(10**6)}"
        frame.append((k, " ".join(words)))
    frame += [(100 + k, text) for k, (_, text) in enumerate(frame[:5])]
    got = near.near_duplicates(spark.createDataFrame(frame, "doc_id long, text string"), 4, block=block)
    assert collected(got, "doc_id", "n_shingles", "component_id", "kept") == Counter(brute.near_components(frame, 4, 80))


def test_estimates_drop_links_as_rarely_as_the_lists():
    # Values of K that are common at similarity 0.8, and still rejected: the binomial tail.
    rejected = [m for m in range(near.K + 1) if m / near.K < 0.8 - near.SLACK - 1e-9]
    assert sum(math.comb(near.K, m) * 0.8**m * 0.2 ** (near.K - m) for m in rejected) < 1e-9


def test_union_estimates():
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 60, n).astype(np.uint64)) for n in (5, 12, 30, 50, 60, 3)]
    table = np.full((len(sets), near.K), near.NONE)
    for row, s in zip(table, sets, strict=True):
        row[: min(near.K, len(s))] = s[: near.K]
    i, j = np.triu_indices(len(sets), 1)
    want = []
    for x, y in zip(i, j, strict=True):
        union = sorted(set(sets[x].tolist()) | set(sets[y].tolist()))[: near.K]
        want.append(sum(v in sets[x] and v in sets[y] for v in union) / len(union))
    assert near.union_estimates(table, i, j) == pytest.approx(want)


# --- substrings ----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("hot", [4096, 1])
def test_substrings_of_awkward_rows(docs, rows, hot):
    got = substrings.remove_repeats(docs, hot=hot)
    want = Counter((r[0], *w) for r, w in zip(rows, brute.substring_removal([r[1] for r in rows], 200), strict=True))
    assert collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_substrings_in_parts(spark, monkeypatch):
    rnd = random.Random(4)
    block = "".join(rnd.choice("abc") for _ in range(700))
    texts = ["".join(rnd.choice("abc") for _ in range(5000)) + block + "xyz" + block, block[:450], "é" * 500 + block[20:330]]
    parts = [p for batch in substrings.in_parts(list(enumerate(texts)), 200) for p in batch]
    monkeypatch.setattr(substrings, "PART", 512)
    small = [p for batch in substrings.in_parts(list(enumerate(texts)), 200) for p in batch]

    def runs(parts):
        part, start, run, _ = substrings.anchored_runs([p[2] for p in parts], 200, 32)
        return Counter((parts[i][0], parts[i][1] + s + k) for i, s, n in zip(part, start, run, strict=True) for k in range(n))

    assert runs(parts) == runs(small) == Counter((k, i) for k, t in enumerate(texts) for i in range(len(t.encode()) - 199))


# --- decontamination -----------------------------------------------------------------------------------------------
def test_leaks_and_recall(spark):
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choice("abcdeorstu") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(prose(rnd.randint(12, 60)))) for i in range(60)] + [(90, None), (91, ""), (92, "single"), (None, "no id here at all")]
    docs, exact, edited = [], set(), set()
    for k, (item, text) in enumerate(items[:60]):
        words = text.split()
        for copy in range(2):
            new = list(words)
            for _ in range(copy * len(words) * 15 // 100):
                at = rnd.randrange(len(new))
                new[at : at + rnd.randint(0, 1)] = [f"x{rnd.randrange(99)}"] * rnd.randint(0, 1)
            docs.append((2 * k + copy, " ".join(prose(80) + new + prose(40)).upper().replace(" ", ",\n", 3)))
            (edited if copy else exact).add((2 * k + copy, item))
    docs += [(500 + i, " ".join(prose(300))) for i in range(100)] + [(700, None), (701, ""), (None, items[3][1]), (None, items[3][1])]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, distance long, best long").repartition(4)
    got = decontaminate.leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert exact <= found and len(edited & found) >= 0.9 * len(edited)
    assert found <= exact | edited | {(None, 3)} and (None, 3) in found
    at = {(r.doc_id, r.item_id): r for r in got}
    text = dict(docs)
    for pair in exact:
        words, r = decontaminate.normal_words(text[pair[0]]), at[pair]
        assert r.distance == 0 and words[r.position : r.position + r.n_item] == decontaminate.normal_words(items[pair[1]][1])
    rest = decontaminate.without_leaks(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert rest.columns == frame.columns and {r.doc_id for r in rest.collect()} == {d[0] for d in docs} - {p[0] for p in found} | {None}


@pytest.mark.parametrize("n", [10, 20, 37, 57])
def test_leaks_at_the_most_edits(n):
    """Passages with exactly 20 % of their words replaced: found as by a search of all windows, wherever the edits lie."""
    rnd = random.Random(n)
    vocabulary = ["".join(rnd.choice("abcdeorstu") for _ in range(rnd.randint(3, 8))) for _ in range(3000)]
    prose = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    items, k = [prose(n) for _ in range(200)], n // 5
    # Edits at the second and third, or second and fourth word leave no kept pair near the beginning.
    fixed = [[], [1, 2], [1, 3]]
    texts = []
    for i, item in enumerate(items):
        at = [*fixed[i % 3], *rnd.sample(range(4, n), k - len(fixed[i % 3]))] if i % 3 else rnd.sample(range(n), k)
        texts.append(prose(30) + ["changed" if p in at else w for p, w in enumerate(item)] + prose(30))
    block = decontaminate.ItemBlock([(i, " ".join(w)) for i, w in enumerate(items)], 80)
    found = {(t, i): d for t, i, _, _, d in sorted(block.search([" ".join(t) for t in texts], decontaminate.Vocabulary(block.words)), key=lambda r: -r[4])}
    code = {w: c for c, w in enumerate({w for ws in [*items, *texts] for w in ws})}
    best = {}
    for i, item in enumerate(items):
        for t in (i, (i + 1) % len(items)):
            words = np.array([code[w] for w in texts[t]] + [-9] * (n + k))
            windows = np.stack([words[s : s + n + k] for s in range(len(texts[t]))])
            best[t, i] = int(decontaminate.edit_distances([np.array([code[w] for w in item])] * len(windows), windows).min())
    want = {pair: d for pair, d in best.items() if d <= k}
    assert {(i, i) for i in range(len(items))} <= want.keys() and found.keys() <= want.keys()
    assert len(found) >= 0.97 * len(want)
    for kind in range(3):
        these = [pair for pair in want if pair[1] % 3 == kind]
        assert sum(pair in found for pair in these) >= 0.95 * len(these)


@pytest.mark.parametrize("kind", ["replaced", "inserted", "deleted", "mixed", "block"])
@pytest.mark.parametrize("n", [5, 10, 15, 20, 37, 57, 100, 200])
def test_leaks_of_every_kind_of_edit(n, kind):
    """Passages with a fifth of their words edited in one way: at least 0.95 found, at the distance and place of a full search."""
    rnd = random.Random(n)
    vocabulary = ["".join(rnd.choice("abcdeorstu") for _ in range(rnd.randint(3, 8))) for _ in range(3000)]
    prose = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    items, k, texts = [prose(n) for _ in range(100 if n < 60 else 2000 // n)], n // 5, []
    for item in items:
        new = list(item)
        if kind == "block":
            at = rnd.randrange(n - k + 1)
            del new[at : at + k]
        for at in sorted(rnd.sample(range(n), k), reverse=True) if kind != "block" else []:
            how = rnd.choice(["replaced", "inserted", "deleted"]) if kind == "mixed" else kind
            new[at : at + (how != "inserted")] = prose(how != "deleted")
        texts.append(prose(30) + new + prose(30))
    block = decontaminate.ItemBlock([(i, " ".join(w)) for i, w in enumerate(items)], 80)
    found = {}
    for t, i, position, _, d in block.search([" ".join(t) for t in texts], decontaminate.Vocabulary(block.words)):
        found[t, i] = min(found.get((t, i), (d, position)), (d, position))
    code = {w: c for c, w in enumerate(vocabulary)}
    for (t, i), (d, position) in found.items():
        words = np.array([code[w] for w in texts[t]] + [-9] * (n + k))
        windows = np.stack([words[s : s + n + k] for s in range(len(texts[t]))])
        each = decontaminate.edit_distances([np.array([code[w] for w in items[i]])] * len(windows), windows)
        assert (d, position) == (each.min(), each.argmin()) and d <= k
    assert sum((i, i) in found for i in range(len(items))) >= 0.95 * len(items)


def test_edit_distances_match_the_table():
    rnd = random.Random(1)
    items = [np.array([rnd.randrange(5) for _ in range(9)]) for _ in range(40)]
    windows = np.array([[rnd.randrange(5) for _ in range(12)] for _ in range(40)])

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        return min(row)

    assert decontaminate.edit_distances(items, windows).tolist() == [plain(a, b) for a, b in zip(items, windows, strict=True)]


# --- language-model scores -----------------------------------------------------------------------------------------
def test_scores_of_awkward_rows(docs, rows, monkeypatch):
    monkeypatch.setattr(scoring, "BUCKET_BYTES", 9_000)
    want = {}
    for r, score in zip(rows, brute.backoff_scores([r[1] for r in rows]), strict=True):
        want.setdefault((r[0], r[1]), []).append(score)
    got = defaultdict(list)
    for r in scoring.lm_scores(docs).collect():
        got[r.doc_id].append((r.n_words, r.log_score, r.mean_log_score))
    expected = defaultdict(list)
    for (number, text), scores in want.items():
        n = len((text or "").encode().split())
        expected[number] += [(n, s, s / n if n else None) for s in scores]
    assert got.keys() == expected.keys()
    for number, values in expected.items():
        for g, w in zip(sorted(got[number], key=str), sorted(values, key=str), strict=True):
            assert g == pytest.approx(w)


# --- tokens --------------------------------------------------------------------------------------------------------
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_token_shards_round_trip(spark, docs, rows):
    from kinlink.session import scratch_path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    manifest = tokens.write_shards(docs, vocabulary(), scratch_path(spark, "test-tokens"), most_ids=4_000)
    got = tokens.read_shards(manifest).collect()
    coded = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
    want = Counter((r[0], len(ids := coded(r[1])), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    in_order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in in_order] == [0, *np.cumsum([r.n_tokens for r in in_order])[:-1].tolist()]
    ids = [r.doc_id for r in in_order]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    first = manifest.orderBy("shard").first()
    shard = tokens.Shard(first.path)
    assert manifest.count() > 1 and shard.n == first.n_docs and sum(len(shard.document(i)) for i in range(shard.n)) == first.n_ids


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [0, 1, 2**50], sorted(random.Random(1).choices(range(10**9), k=3000))])
def test_elias_fano(values):
    sequence = tokens.EliasFano.from_bytes(tokens.EliasFano.of(np.array(values, np.int64)).to_bytes())
    assert sequence.values().tolist() == values
    assert [sequence.select(i) for i in range(min(200, len(values)))] == values[:200]
    if len(values) > 1000:
        bits = 8 * len(sequence.to_bytes())
        assert bits < len(values) * (3 + np.log2(values[-1] / len(values)))


# --- WARC ----------------------------------------------------------------------------------------------------------
PAGES = "page_id long, url string, html string, digest string, path string, offset long"


def page_rows():
    long = "<p>é</p>" * 300
    return [
        (1, "http://a/1", long), (2, "http://a/2", long), (7, "http://a/7\r\nX: y%0A", long), (3, None, "short"), (4, "u", "short"), (5, "u", None),
        (6, "u", ""), (None, "u", long), (None, "v", "x" * 2000), (9, "w", "y" * 3000), (9, "w", "y" * 3000), (8, "w", "y" * 3000),
    ]


def test_archives_round_trip(spark):
    rows = page_rows()
    frame = spark.createDataFrame([(*r, "d", "p", 5) for r in rows], PAGES).repartition(3)
    got = collected(warc.archive_round_trip(frame), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
    want = Counter()
    for number, url, html in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == data and r[0] is not None]
        top = max(same, default=None) if len(data) >= 1000 else None
        revisit = top is not None and number != top
        want[(number, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None, url)] += 1
    assert got == want


def test_selected_records_are_read_by_range(spark):
    from kinlink.llm.common import open_fs
    from kinlink.session import scratch_path

    frame = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 50) for i in range(50)], "page_id long, url string, html string").coalesce(1)
    index = warc.write_archives(warc.record_types(frame), scratch_path(spark, "test-warc"), most=4000)
    assert index.select("path").distinct().count() > 1
    some = warc.read_records(index.where("page_id % 7 = 0"), gap=0).collect()
    assert {(r.page_id, r.payload) for r in some} == {(i, f"page {i} " * 50) for i in range(0, 50, 7)}
    for path in {r.path for r in index.collect()}:
        system, inside = open_fs(path)
        data = system.open_input_file(inside).read()
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")  # members in a row are one gzip file


# --- empty tables --------------------------------------------------------------------------------------------------
def test_empty_tables(spark, empty):
    pages = spark.createDataFrame([], PAGES)
    items = spark.createDataFrame([], "item_id long, text string")
    for result in (
        mixing.mix(empty), mixing.mixed_documents(empty), quality.judge_quality(empty), licences.scan_licences(empty), langid.languages(empty),
        near.near_duplicates(empty), near.without_near_duplicates(empty), substrings.remove_repeats(empty), scoring.lm_scores(empty),
        decontaminate.leaks(empty, items), decontaminate.without_leaks(empty, items), tokens.token_rows(empty, vocabulary()), warc.archive_round_trip(pages),
    ):
        assert result.collect() == []


def test_no_benchmark_keeps_all(spark, docs, rows):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.without_leaks(docs, items).count() == len(rows)


def test_encoder_remembers_the_words_of_several_tasks():
    """5,000 documents of the check had 430,000 words to learn; forgetting them made the next task learn them again."""
    import public_tokenizers

    encoder = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), 2)
    letters = "abcdefghijklmnopqrstuvwx"
    text = " ".join(a + b + c + d for a in letters for b in letters for c in letters for d in letters[:22])
    first, _ = encoder.encode([text])
    assert len(encoder.slots) > 300_000
    again, _ = encoder.encode([text])
    assert len(encoder.slots) > 300_000 and (first == again).all()
    assert first[:-1].tolist()[:50] == encoder.whole(text[:1000])[:50]


def test_learned_words_go_with_their_stage(docs, spark):
    """The words of the 10,000 documents of sf0.1 take 154 MB of a worker, which later stages of a pipeline need."""
    import public_tokenizers
    from kinlink.llm.common import returning_memory

    tokens.token_rows(docs, public_tokenizers.path("word_bpe_49k.json")).count()

    def kept(batches):
        import sys

        import pyarrow as pa

        for batch in batches:
            held = vars(sys.modules["_kinlink_worker"]) if "_kinlink_worker" in sys.modules else {}
            found = [x for x in [*held.values(), *held.get("of_stage", {}).values()] if type(x).__name__ == "WordEncoder"]
            yield pa.RecordBatch.from_pydict({"n": [len(found)] * batch.num_rows})

    assert spark.range(0, 64, 1, 16).mapInArrow(returning_memory(kept), "n long").where("n > 0").count() == 0
