"""Language, quality, toxicity, licences: held-out accuracy and edge cases."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from loomspark.llm import langid, licences, ordinal, quality, toxicity

DATA = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, expected double, tails string"


def odd(spark):
    return spark.createDataFrame([(1, None), (2, ""), (None, "the words"), (4, "12 34 ..."), (5, "of the and " * 30_000), (5, "of the and " * 30_000)], "doc_id long, text string").selectExpr("*", "'xx' lang", "'s' source", "1L n_chars", "'clash' lang_pred", "0.5D expected", "'t' tails")


def test_forward_sums_all_segmentations():
    index = {"_": 0, "a": 1, "b": 2, "ab": 3, "_a": 4}
    lattice = langid.Lattice(["ab", "b", "aé"], index)
    import numpy as np

    p = np.array([[0.1], [0.2], [0.3], [0.4], [0.5], [0.01]])
    # the first character may stand alone as an unknown edge beside its own piece
    start = 0.01
    expected = [(start * 0.2 + 0.5) * 0.3 + start * 0.4, start * 0.3, (start * 0.2 + 0.5) * 0.01]
    assert np.allclose(np.exp(lattice.scores(p))[:, 0], expected)
    assert np.allclose(lattice.backward(p)[:, 0, 0], expected)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = {r.doc_id: r for r in langid.predict(docs, langid.train(docs, MODEL)).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [d for d in truth if found[d].held_out]
    assert len(found) == len(truth) and len(held) > 150
    assert sum(found[d].lang_pred == truth[d] for d in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in found.values())


def test_numerals_are_no_letters(spark):
    model = langid.fit([Row(text="the and of", lang="en"), Row(text="der und die", lang="de")], MODEL)
    langs = model.predict(["½ ②", "²", "㊀ ٣", "_ 12", "a²", "日本"])[0]
    assert langs[:4] == ["und"] * 4 and "und" not in langs[4:]
    import sys

    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha() != bool(langid._WORDS.fullmatch(c)):
            raise AssertionError(hex(i))


def brute_segmentations(word, index, p):
    """Sum over all segmentations of ``_word``, by recursion: the first character alone is the unknown edge too."""
    word = "_" + word

    def rest(at):
        if at == len(word):
            return 1.0
        total = p[len(index)] * rest(at + 1) if at == 0 or word[at] not in index else 0.0
        for end in range(at + 1, len(word) + 1):
            if end == 1:
                continue
            if (i := index.get(word[at:end])) is not None:
                total += p[i] * rest(end)
        return total

    return rest(0)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=7), min_size=1, max_size=4, unique=True), st.sets(st.text("_ab", min_size=1, max_size=4).filter(lambda x: "_" not in x[1:] and x != "_"), max_size=10))
def test_forward_equals_enumeration(words, pieces):
    import numpy as np

    index = {x: i for i, x in enumerate(sorted(pieces))}
    p = np.linspace(0.05, 0.9, len(index) + 1)
    got = np.exp(langid.Lattice(words, index).scores(p[:, None]))[:, 0]
    assert np.allclose(got, [brute_segmentations(w, index, p) for w in words])


def test_language_edge_cases(spark):
    model = langid.fit([Row(text="the and of", lang="en"), Row(text="der und die", lang="de"), Row(text=None, lang="fr")], MODEL)
    rows = langid.predict(odd(spark), model).collect()
    assert [(r.doc_id, r.lang_pred) for r in rows] == [(1, "und"), (2, "und"), (None, "en"), (4, "und"), (5, "en"), (5, "en")]
    assert langid.train(odd(spark).where("false"), MODEL) is None
    assert {r.lang_pred for r in langid.predict(odd(spark), None).collect()} == {"und"}
    kept = langid.keep(odd(spark), model)
    assert kept.columns == odd(spark).columns and [r.doc_id for r in kept.collect()] == [None, 5, 5]
    assert langid.predict(odd(spark).where("false"), model).count() == 0
    assert [r.doc_id for r in langid.keep(odd(spark), None).collect()] == [None, 5, 5] and langid.keep(odd(spark).where("false"), model).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    return docs, labels, {r.doc_id: r for r in labels.collect()}


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r for r in labels.where("doc_id % 3 = 0").collect()}
    rows = {r.doc_id: r for r in toxicity.severity(docs, toxicity.fit(docs, labels.where("doc_id % 3 <> 0"))).collect()}
    toxic = [rows[d].toxic for d in truth if truth[d].toxic]
    clean = [rows[d].toxic for d in truth if not truth[d].toxic]
    assert sum(toxic) / len(toxic) > 0.85 and sum(clean) / len(clean) < 0.02, (sum(toxic) / len(toxic), sum(clean) / len(clean))
    assert all(r.p_severe <= r.p_toxic + 1e-9 and 0 <= r.expected_severity <= 2 for r in rows.values())


def test_quality_held_out(spark, labelled):
    docs, labels, truth = labelled
    rows = {r.doc_id: r for r in quality.grade(docs, quality.fit(docs, labels.where("doc_id % 3 <> 0"))).collect()}
    held = [d for d in truth if d % 3 == 0]
    assert sum(rows[d].keep == bool(truth[d].quality) for d in held) / len(held) > 0.9


def test_ordinal_shares_weights_across_thresholds():
    rows = [Row(text=" ".join(["alpha"] * (3 * g) + ["omega"] * (3 * (2 - g)) + [f"w{i % 7}"]), grade=g) for g in (0, 1, 2) for i in range(30)]
    model = ordinal.fit(rows, ordinal.STYLE)
    assert model.grades == [0, 1, 2] and (model.thresholds[1:] > model.thresholds[:-1]).all()
    tails = model.tails(model.raw(["alpha " * 6, "alpha omega " * 3, "omega " * 6]))
    assert (tails[:, 0] >= tails[:, 1]).all() and tails[0, 1] > tails[1, 1] > tails[2, 1]
    assert ordinal.fit(rows[:30], ordinal.STYLE) is None


def test_scores_edge_cases(spark):
    rows = [Row(text=t, grade=g) for g, t in ((0, "bad worse"), (1, "good fine")) for _ in range(20)]
    model = ordinal.fit(rows, ordinal.TERMS)
    found = toxicity.severity(odd(spark), model).collect()
    assert [r.doc_id for r in found] == [1, 2, None, 4, 5, 5] and found[4] == found[5]
    assert toxicity.severity(odd(spark).where("false"), model).count() == 0
    assert [r.toxic for r in toxicity.severity(odd(spark), None).collect()] == [False] * 6
    assert all(r.keep for r in quality.grade(odd(spark), None).collect())
    kept = quality.keep(odd(spark), model)
    assert kept.columns == odd(spark).columns


def test_licence_rules():
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. The above copyright notice and this permission notice shall be included in all copies. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."
    assert licences.recognise(f"Some text.\n{mit}\nMore.")[1] == ["MIT"]
    assert licences.recognise("x\nReleased under the MIT License.\ny. Licensed under CC BY-NC 4.0.")[1] == ["MIT", "CC-BY-NC-4.0"]
    assert licences.recognise("This work is licensed under the GNU General Public\nLicense, version 3.")[1] == ["GPL-3"]
    assert licences.recognise("SPDX-License-Identifier: BSD-3-Clause")[0] == ["spdx"]
    assert licences.recognise("You may not use this file except in compliance with the License.")[1] == []
    assert licences.recognise("licence and warranty, but no known sentence") == ([], [])
    assert all(any(w in pattern for w in licences.WORDS) for _, pattern in licences.NOTICES if _ != "copyright")
    assert all(any(w in text.lower() for w in licences.WORDS) for texts in licences.TEXTS.values() for text in texts)


def whole(name, places, wrap=70):
    """A licence text as it stands in files: a copyright line, then the sentences, broken into lines."""
    import textwrap

    body = "\n\n".join(textwrap.fill(licences.TEXTS[n][i].replace("<x>", "Jane Doe"), wrap) for n, i in places)
    return f"Copyright (c) 2019 Jane Doe\n\n{body}\n"


@pytest.mark.parametrize(
    "places, licence",
    [
        ([("MIT", i) for i in range(4)], "MIT"),
        ([*[("MIT", i) for i in range(4)], ("X11", 0)], "X11"),
        ([("BSD", i) for i in (0, 1, 2, 5, 6, 7, 8)], "BSD-2-Clause"),
        ([("BSD", i) for i in (0, 1, 2, 3, 5, 6, 7, 8)], "BSD-3-Clause"),
        ([("BSD", i) for i in (0, 1, 2, 4, 3, 5, 6, 7, 8)], "BSD-4-Clause"),
        ([("ISC", i) for i in range(3)], "ISC"),
        ([("ISC", 3)], "0BSD"),
        ([("Apache-2.0", i) for i in range(5)], "Apache-2.0"),
        ([("Apache-2.0", i) for i in (5, 6, 7, 8)], "Apache-2.0"),
        ([("MPL-2.0", 0), ("MPL-2.0", 1)], "MPL-2.0"),
        ([("Zlib", i) for i in range(7)], "Zlib"),
        ([("Unlicense", 0), ("Unlicense", 1)], "Unlicense"),
        ([("BSL-1.0", 0), ("BSL-1.0", 1)], "BSL-1.0"),
        ([("EPL", 0)], "EPL-1.0"),
        ([("CC0-1.0", 0)], "CC0-1.0"),
    ],
)
def test_whole_licence_texts(places, licence):
    for wrap in (60, 78, 5000):
        assert licences.recognise("Some words before.\n\n" + whole("", places, wrap) + "\nAnd some behind.")[1] == [licence]


def test_spdx_expressions():
    found = lambda t: licences.recognise(t)[1]
    assert found("SPDX-License-Identifier: mit") == ["MIT"] and found("// SPDX-License-Identifier: Apache-2.0 OR MIT") == ["Apache-2.0", "MIT"]
    assert licences.spdx("(gpl-2.0-only WITH Classpath-exception-2.0) and bsd-3-clause") == ["GPL-2.0-only", "BSD-3-Clause"]
    assert licences.spdx("LGPL-2.1+ some other words") == ["LGPL-2.1+"] and licences.spdx("") == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["MIT/0", "MIT/1", "MIT/2", "MIT/3", "X11/0", "BSD/0", "BSD/1", "BSD/2", "BSD/3", "Apache-2.0/0", "Apache-2.0/1", "ISC/0", "copyright", "mit-line", "GPL/0"]), max_size=9))
def test_sequences_meet_rules_as_by_brute_force(ids):
    """Every rule at every place, tried by choosing places one after another."""

    def fits(at, rule):
        if ids[at] != rule[0]:
            return None
        for own in rule[1:]:
            at += 1
            while at < len(ids) and ids[at] != own and (ids[at] == "copyright" or ids[at].split("/")[0] == rule[0].split("/")[0]):
                at += 1
            if at >= len(ids) or ids[at] != own:
                return None
        return at

    expected, i = [], 0
    heads = {rule[0] for _, rule in [*licences.RULES, *licences.NOTICE_RULES]}
    while i < len(ids):
        ends = [(licence, rule, end) for licence, rule in [*licences.RULES, *licences.NOTICE_RULES] if (end := fits(i, rule)) is not None]
        if not ends:
            i += 1
            continue
        licence, rule, end = ends[0]
        end += 1
        while end < len(ids) and "/" in ids[end] and ids[end].split("/")[0] == rule[-1].split("/")[0] and ids[end] not in heads:
            end += 1
        expected.append((i, end - i, licence))
        i = end
    assert licences.match_rules(ids) == expected


def test_licences_edge_cases(spark):
    rows = licences.scan(odd(spark).union(odd(spark).where("false"))).collect()
    assert [r.licensed for r in rows] == [False] * 6
    assert licences.scan(odd(spark).where("false")).count() == 0


@pytest.mark.parametrize(
    "text, licence",
    [
        ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.", "GPL-3"),
        ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", "LGPL-2.1"),
        ("it under the terms of the GNU Affero General Public License", ""),
        ("You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License.", "AGPL-3"),
        ("Licensed under the GNU General Public License v3.0", "GPL-3"),
        ("This project is licensed under the MIT License.", "MIT"),
        ("This software is licensed under the MIT License", "MIT"),
        ("All the code here is licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("This program is made available under the terms of the Eclipse Public License v2.0", "EPL-2.0"),
        ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
        ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it", "Zlib"),
        ("This is free and unencumbered software released into the public domain.", "Unlicense"),
        ("This library is released under the BSD 3-Clause License", "BSD-3-Clause"),
        ("This is not licensed under the MIT License.", ""),
        ("He works under the bridge and signs no license.", ""),
    ],
)
def test_common_licence_notices(text, licence):
    assert licences.recognise(text)[1] == [licence] * bool(licence)
