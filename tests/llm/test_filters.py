import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import decontamination, language, licenses, toxicity, urls
from parley.llm.common import crc_mod
from parley.llm.queries import URL_RULES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(texts, items, window):
    wins = []
    for name, text in items:
        w = words(text)
        n = min(window, len(w))
        if n:
            wins.append((name, n, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}))
    out = []
    for t in texts:
        w = words(t)
        hit, found = [0] * len(w), set()
        for name, n, s in wins:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in s:
                    hit[i : i + n] = [1] * n
                    found.add(name)
        out.append((len(w), sum(hit), sorted(found - {None})))
    return out


@pytest.mark.parametrize("shard_words, shards", [(100_000, 4), (8, 2), (8, 1)])
def test_contamination(spark, shard_words, shards):
    """Also in several passes, for benchmarks of more shards than a worker holds."""
    rng = random.Random(3)
    make = lambda n: " ".join(rng.choice(["ab", "C", "dé", "x1"]) for _ in range(rng.randint(0, n)))
    items = [(i, make(9)) for i in range(8)] + [(8, None), (9, ""), (None, "x1 x1 x1"), (3, "ab, ab; AB")]
    texts = [make(40) for _ in range(40)] + [None, "", "...", "Dé-x1 " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for window in (2, 4):
        rows = {
            r.doc_id: (
                r.n_words, sum(s.end - s.begin for s in r.spans), r["items"],
            ) for r in decontamination.find_contamination(docs, bench, window, shard_words=shard_words, shards=shards).collect()
        }
        want = contaminated(texts, [(None if k is None else str(k), t) for k, t in items], window)
        assert [rows[i] for i in range(len(texts))] == want


def test_contamination_edges(spark, docs, no_docs, clashing):
    bench = spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")
    none = bench.limit(0)
    assert decontamination.find_contamination(docs, none).agg(F.sum(F.size("spans"))).first()[0] == 0
    assert decontamination.find_contamination(no_docs, bench).count() == 0
    assert decontamination.find_contamination(clashing, bench).count() == docs.count()
    assert decontamination.decontaminate(clashing, bench).count() <= docs.count()
    assert decontamination.decontaminate(no_docs, bench).count() == 0


def test_spans_are_removed(spark):
    passage = " ".join(f"q{i}" for i in range(12))
    docs = spark.createDataFrame(
        [(1, f"keep this,\nplease. {passage.upper()}! And this too."), (2, passage), (3, "clean\n text"), (4, None)],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    rows = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench, max_coverage=0.8).collect()}
    assert rows == {1: "keep this,\nplease. ! And this too.", 3: "clean\n text", 4: None}


def test_urls(spark):
    cases = {
        "http://A.Example.ORG/en/123?x#y": ("a.example.org", "/en/123", "example.org/en/1", "block"),
        "http://example.org/es/1": ("example.org", "/es/1", "example.org/es/", "block"),
        "http://example.org/es": ("example.org", "/es", "org/", "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "x://b.com/de/1#q": ("b.com", "/de/1", "com/de/", "block"),
        "x://b.com/fr/": ("b.com", "/fr/", "com/fr/", "allow"),
        "x://b.com/nl/": ("b.com", "/nl/", None, "allow"),
        "x://b.org": ("b.org", "", None, "allow"),
        "http://h?a://b/c": ("h", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*cases, None, None])], "page_id long, url string, host string")
    for most in (1000, 2):  # two ways: the trie, and the join for rules too many to broadcast
        rows = {r.page_id: tuple(r)[1:] for r in urls.judge(pages, URL_RULES, most_rules=most).collect()}
        assert [rows[i] for i in range(len(cases) + 2)] == [*cases.values(), ("", "", None, "allow"), ("", "", None, "allow")]
    assert urls.judge(pages.limit(0), URL_RULES).count() == 0
    # All names of results and of columns in between, and a null id.
    more = pages.withColumns({c: F.lit("clash") for c in ("path", "rule", "verdict", "_u", "_url", "_host", "_path", "_key", "_salt")})
    more = more.unionByName(more.where("page_id = 0").withColumn("page_id", F.lit(None).cast("long")))
    for most in (1000, 2):
        rows = {r.page_id: tuple(r)[1:] for r in urls.judge(more, URL_RULES, most_rules=most).collect()}
        assert [rows[i] for i in range(len(cases))] == list(cases.values()) and rows[None] == rows[0] and len(rows) == len(cases) + 3


def test_url_precedence(spark):
    rules = [("allow", "a.b", "/x/y"), ("block", "a.b", "/x/y"), ("block", "a.b", "/x/"), ("allow", "a.b", "/x/yy"), ("block", "b", "/x/yyyy")]
    frame = spark.createDataFrame(rules, "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "h://a.b/x/y/z"), (2, "h://a.b/x/yyyyy"), (3, "h://a.b/x/q"), (4, "h://c.b/x/yyyy")], "page_id long, url string")
    want = {1: ("a.b/x/y", "block"), 2: ("a.b/x/yy", "allow"), 3: ("a.b/x/", "block"), 4: ("b/x/yyyy", "block")}
    for most in (10, 1):
        assert {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, frame, most_rules=most).collect()} == want


def test_urls_in_many_rules(spark):
    """The join against the trie on random rules and pages: a hot host, very long paths, repeated rows."""
    rng = random.Random(11)
    hosts = ["com", "a.com", "b.a.com", "org", "x.org"]
    path = lambda n: "".join(rng.choice("/ab") for _ in range(rng.randint(0, n)))
    rules = [(rng.choice(["allow", "block"]), rng.choice(hosts), "/" + path(4)) for _ in range(60)]
    pages = [
        (i, f"h://{rng.choice(['', 'w.', 'v.w.'])}{rng.choice(hosts)}/{path(9)}") for i in range(400)
    ] + [(400, "h://a.com/" + "ab/" * 3000), (401, "h://a.com/a"), (401, "h://a.com/a")]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    one, two = (sorted(map(tuple, urls.judge(frame, rules, most_rules=most).collect()), key=str) for most in (1000, 5))
    assert one == two and len(one) == len(pages)


def test_licenses(spark, docs, no_docs, clashing):
    cases = {
        "Some text.\nReleased under the MIT License.": "MIT",
        "released UNDER  the mit-license": "MIT",
        "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.": "Apache-2.0,CC-BY-NC-4.0",
        "This work is licensed under the GNU General Public License, version 3. Bye.": "GPL-3.0-only",
        "Permission is hereby granted": "",
        "version 2.0. ": "",
        None: "",
        "": "",
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    rows = {r.doc_id: ",".join(r.licenses) for r in licenses.scan(frame).collect()}
    assert [rows[i] for i in range(len(cases))] == list(cases.values())
    for variants in licenses.SENTENCES.values():
        for v in variants:
            one = licenses.scan(spark.createDataFrame([(1, f"Before. {v}.\nAfter.")], "doc_id long, text string")).first()
            assert one.sentence_ids, v
    assert licenses.scan(no_docs).count() == 0 and licenses.scan(clashing).count() == docs.count()


#: Notices as they are published, wrapped as they are there.
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.
"""
BSD2 = """Copyright (c) 2001, Somebody

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""

MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
GPL2_ONLY = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation.
"""
GPL3_ONLY = GPL3.replace("either version 3 of the License, or\n(at your option) any later version.", "version 3.")
LGPL3_ONLY = GPL3_ONLY.replace("This program", "This library").replace("GNU General", "GNU Lesser General")
CC = "This work is licensed under the Creative Commons {} 4.0\nInternational License. To view a copy of this license, visit\nhttp://creativecommons.org/licenses/.\n"
CC0 = "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n    CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM\n"


def license_rows(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan(frame).collect()}
    return [rows[i] for i in range(len(texts))]


def test_wrapped_licenses(spark):
    cases = {APACHE: "Apache-2.0", GPL2: "GPL-2.0-or-later", BSD2: "BSD-2-Clause", BSD3: "BSD-3-Clause", MPL: "MPL-2.0"}
    # One word a line is the narrowest wrap; a line end of Windows or of old is one line end.
    for change in (
        lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: t.replace("\n", "\r"),
        lambda t: "".join(f" * {x}\n" for x in t.split("\n")), lambda t: "Heading\n" + "".join(f"# {x}\n" for x in t.split("\n")),
        lambda t: re.sub(r"(?<=\S) (?=\S)", "\n", t),
    ):
        assert [",".join(r.licenses) for r in license_rows(spark, [change(t) for t in cases])] == list(cases.values())
    wrapped = "Licensed under the Apache\n  // License, Version 2.0 (the\n// \"License\");"
    texts = [
        wrapped, "Licensed under\nLicensed under CC BY\n4.0", "Released under\n\nthe MIT License", "Released under\n#\n# the MIT License",
        "Released under. the MIT License", "All rights\nreserved\nAll rights reserved",
    ]
    got = [list(r.sentence_ids) for r in license_rows(spark, texts)]
    assert got == [["ApacheLicensed"], ["CcBy4"], [], [], [], ["AllRights", "AllRights"]]


def test_published_licenses(spark):
    cases = {
        MIT: ("MIT", "Title-MIT,MitPermission,MitNotice"),
        GPL3: ("GPL-3.0-or-later", "GplFree,GplFree,Gpl3OrLater"),
        GPL3.replace("version 3", "version 2"): ("GPL-2.0-or-later", "GplFree,GplFree,Gpl2OrLater"),
        GPL2: ("GPL-2.0-or-later", "GplFree,GplFree,Gpl2OrLater"),
        GPL3_ONLY: ("GPL-3.0-only", "GplFree,GplFree,Gpl3Licensed"),
        GPL2_ONLY: ("GPL-2.0-only", "GplFree,GplFree,Gpl2Licensed"),
        LGPL3_ONLY: ("LGPL-3.0-only", "Lgpl3Licensed"),
        CC.format("Attribution"): ("CC-BY-4.0", "CcBy4"),
        CC.format("Attribution-ShareAlike"): ("CC-BY-SA-4.0", "CcBySa4"),
        CC.format("Attribution-NonCommercial"): ("CC-BY-NC-4.0", "CcByNc4"),
        CC0: ("CC0-1.0", "Cc0"),
        APACHE: ("Apache-2.0", "ApacheLicensed,ApacheNotUse,ApacheCopy,AsIsBasis"),
        BSD3.replace("copyright holder nor", "University nor"): ("BSD-3-Clause", "BsdRedistribution,BsdNoEndorse"),
    }
    for change in (  # wrapped, a paragraph on a line, a word on a line
        lambda t: t, lambda t: re.sub(r"(?<=\S)\n(?=\S)", " ", t), lambda t: re.sub(r"(?<=\S) (?=\S)", "\n", t),
    ):
        got = license_rows(spark, [change(t) for t in cases])
        assert [(",".join(r.licenses), ",".join(r.sentence_ids)) for r in got] == list(cases.values())


def test_several_licenses_of_a_family(spark):
    gpl3, gpl2 = (f"This work is licensed under the GNU General Public License, version {n}." for n in (3, 2))
    notices = [
        GPL3.replace("GNU General", "GNU Affero General"), GPL3.replace("GNU General", "GNU Lesser General"),
        GPL2.replace("GNU General", "GNU Lesser General").replace("version 2", "version 2.1"),
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n",
        "This is free and unencumbered software released into the public domain.",
        "// Distributed under the Boost Software License, Version 1.0.\n//    (See accompanying file)",
        "  This program and the accompanying materials are made\n  available under the terms of the Eclipse Public License 2.0\n  which is available at https://www.eclipse.org/legal/epl-2.0/\n",
        "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n",
    ]
    texts = [f"{gpl2}\n{gpl3}", GPL3 + "\n" + gpl2, BSD3 + "\n" + BSD3, BSD3 + "\n" + BSD2, *notices]
    want = [
        "GPL-3.0-only,GPL-2.0-only", "GPL-3.0-or-later,GPL-2.0-only", "BSD-3-Clause", "BSD-3-Clause,BSD-2-Clause", "AGPL-3.0-or-later",
        "LGPL-3.0-or-later", "LGPL-2.1-or-later", "ISC", "Unlicense", "BSL-1.0", "EPL-2.0", "Zlib",
    ]
    assert [",".join(r.licenses) for r in license_rows(spark, texts)] == want


def test_own_sentences_and_rules(spark):
    frame = spark.createDataFrame([(1, "Use it\nfreely. Pay nothing!"), (2, "Pay nothing. Use it freely."), (3, None)], "doc_id long, text string")
    table = {licenses.normalised("Use it freely"): "Free", licenses.normalised("Pay nothing"): "Gratis"}
    rows = licenses.scan(frame, sentences=table, rules=[("own", "Both", ["Free", "Gratis"]), ("own", "One", ["Gratis"])]).orderBy("doc_id").collect()
    assert [(list(r.sentence_ids), list(r.licenses)) for r in rows] == [(["Free", "Gratis"], ["Both"]), (["Gratis", "Free"], ["One"]), ([], [])]


def test_very_long_texts(spark):
    """Operators 6, 7, 9 and 10 on texts of millions of bytes, ties and repeated rows among them."""
    long = "word " * 400_000
    frame = spark.createDataFrame(
        [(1, long + "\nReleased under the MIT License.", "en"), (2, long, "en"), (2, long, "en"), (3, "mot " * 9, "fr")],
        "doc_id long, text string, lang string",
    )
    assert {r.doc_id: list(r.licenses) for r in licenses.scan(frame).collect()} == {1: ["MIT"], 2: [], 3: []}
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    scores = toxicity.score(frame, toxicity.train(frame, marks)).collect()
    assert len(scores) == 4 and len({r.score for r in scores if r.doc_id == 2}) == 1
    assert [r.lang_pred for r in language.predict(frame, language.train(frame)).orderBy("doc_id").collect()] == ["en", "en", "en", "fr"]
    pages = spark.createDataFrame([(1, "h://a.org/" + "x/" * 100_000)], "page_id long, url string")
    assert urls.judge(pages, URL_RULES).first().rule == "org/"


def test_license_table():
    sentences = licenses.published()
    assert all(any(x in s for x in licenses.SIGNS) for s in sentences)
    shorter = {(sentences[a], sentences[b]) for a in sentences for b in sentences if b.startswith(a + " ")}
    assert all(a in b.split(",") for a, b in shorter)


def test_toxicity(spark, docs, no_docs, clashing):
    rng = random.Random(8)
    plain = [f"p{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        bad = rng.random() < 0.2
        rows.append((i, " ".join(rng.choice(plain) for _ in range(60)) + (" nasty" if bad else "")))
        labels.append((i, int(bad)))
    labels += [(1, None), (2, 7), (None, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(frame, marks, crc_mod(F.col("doc_id"), 5) != 0)
    held = toxicity.score(frame, model).where(crc_mod(F.col("doc_id"), 5) == 0).collect()
    truth = dict(labels[:600])
    assert all((r.score >= 0.5) == bool(truth[r.doc_id]) for r in held) and len(held) > 80
    assert toxicity.score(docs, model).where("score between 0 and 1").count() == docs.count() == toxicity.score(clashing, model).count()
    assert toxicity.score(no_docs, model).count() == 0
    # A key with a third of all rows and labels is learned from once for each text; the bounds hold.
    many = frame.unionByName(frame.where("doc_id = 3").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("n"))
    again = toxicity.train(many, marks.unionByName(marks.where("doc_id = 3")).unionByName(marks.where("doc_id = 3")), crc_mod(F.col("doc_id"), 5) != 0)
    assert again.place.tolist() == model.place.tolist() and again.weight.tolist() == model.weight.tolist()
    few = toxicity.train(frame, marks, sample=50, most_places=2000)
    assert few is not None and len(few.place) < len(model.place) + 100
    assert toxicity.train(frame, marks.limit(0)) is None and toxicity.score(docs, None).where("score = 0").count() == docs.count()


def test_ftrl_step_by_step():
    """The fit against the rule for one coordinate at a time."""
    rng = random.Random(2)
    rows = [(sorted(rng.sample(range(30), 4)), rng.randint(0, 1)) for _ in range(60)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.3, 1.0
    z, n = {}, {}

    def weight(i):
        free = 0.0 if i == "bias" else l1
        if abs(z.get(i, 0.0)) <= free:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * free) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(3):
        for places, label in rows:
            own = [*places, "bias"]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            for i in own:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    model = toxicity.fit(((np.array(p), y) for p, y in rows), alpha=alpha, beta=beta, l1=l1, l2=l2, rounds=3)
    want = {i: weight(i) for i in range(30) if weight(i)}
    assert model.place.tolist() == sorted(want) and np.allclose(model.weight, [want[i] for i in sorted(want)]) and abs(model.bias - weight("bias")) < 1e-9


def test_language_votes(spark):
    """Family first, then one vote for each pair of languages: against the rule written out for every text."""
    rng, texts = np.random.default_rng(5), ["der hund", "le chat noir", "x", "und und und", "die katze, das haus! " * 40]
    codes = ["de", "en", "nl", "fr", "es"]
    machine = lambda: language.Machine(rng.normal(size=1 << language.BITS).astype(np.float32), float(rng.normal()) / 10)
    families = language.families_of({c: np.ones(4) for c in codes})
    pairs = [(a, b) for own in families.values() for i, a in enumerate(own) for b in own[i + 1 :]]
    model = language.Model(families, {f: machine() for f in families}, {p: machine() for p in pairs})

    def counts(text):
        low = "  " + re.sub("[^a-z]", " ", text.lower()) + "   "
        out = np.zeros(1 << language.BITS)
        for i in range(len(low) - 2):
            value = int.from_bytes(low[i : i + 3].encode(), "little") * 2654435761 & 0xFFFFFFFF
            out[value >> 32 - language.BITS] += 1
        return out / out.sum()

    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.lang_pred for r in language.predict(frame, model).collect()}
    for i, text in enumerate(texts):
        margin = lambda m: float(counts(text) @ m.weight) + m.bias
        family = max(families, key=lambda f: margin(model.family[f]))
        votes = {c: [0, 0.0] for c in families[family]}
        for a, b in pairs:
            if a in votes:
                m = margin(model.pair[a, b])
                votes[a if m > 0 else b][0] += 1
                votes[a][1] += m
                votes[b][1] -= m
        assert found[i] == max(votes, key=lambda c: tuple(votes[c])), text


def test_many_languages(spark):
    """Large families are split, so the machines grow with the languages; too many are an error, none is left out unseen."""
    codes = [f"q{i:03}" for i in range(100)] + ["de", "en"]
    rng = np.random.default_rng(1)
    profiles = {c: rng.dirichlet(np.full(60, 0.3)) for c in codes}
    for i in range(50):  # far apart by name, with nearly the same trigrams
        profiles[codes[i + 50]] = 0.97 * profiles[codes[i]] + 0.03 * rng.dirichlet(np.full(60, 0.3))
    families = language.families_of(profiles)
    assert all(any({codes[i], codes[i + 50]} <= set(own) for own in families.values()) for i in range(50))
    assert sorted(c for own in families.values() for c in own) == sorted(codes) and max(map(len, families.values())) <= language.LARGEST
    frame = spark.createDataFrame([(i, f"{c} {c}x{c} " * 5, c) for i, c in enumerate(codes[:30] * 4)], "doc_id long, text string, lang string")
    assert sum(map(len, language.train(frame).families.values())) == 30
    with pytest.raises(ValueError):
        language.train(frame, languages=29)
    # A row with a third of all rows, and equal rows, are learned from once.
    many = frame.unionByName(frame.where("doc_id = 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(100)))).drop("n"))
    one, two = language.train(frame), language.train(many)
    assert all(np.array_equal(one.pair[p].weight, two.pair[p].weight) for p in one.pair)


def test_digests_of_the_learned_queries(spark, texts, tmp_path):
    from parley.llm import queries

    rng = random.Random(10)
    rows = [(i, t, "en", None, None) for i, t in enumerate(texts)]
    rows += [
        (
            i, " ".join(rng.choice(("the of and " if i % 2 else "le la et ").split()) for _ in range(20)) + (" nasty" if i % 3 else ""),
            "en" if i % 2 else "fr", None, None,
        ) for i in range(100, 300)
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 > 0)) for i in range(100, 300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    crc = lambda i, n: zlib.crc32(str(i).encode()) % n
    seven = queries.op7_toxicity(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.held_out, r.predicted) for r in seven) == sorted((r.doc_id, crc(r.doc_id, 5) == 0, int(r.score >= 0.5)) for r in seven)
    assert len(seven) == len(rows) and all(0 <= r.score <= 1 for r in seven)
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in seven if r.doc_id >= 100)
    ten = queries.op10_language_id(spark, str(tmp_path)).collect()
    blank = {i for i, t, *_ in rows if not any(map(str.isalpha, t or ""))}
    assert len(ten) == len(rows) and all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in ten)
    assert {r.doc_id for r in ten if r.lang_pred == "und"} == blank
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "fr") for r in ten if r.doc_id >= 100)


def test_language(spark, docs, no_docs, clashing):
    rng = random.Random(9)
    speak = {
        "en": "the and of that with which house", "de": "der und das nicht mit welche haus", "fr": "le et que avec dans une maison",
        "es": "el y que con los una casa", "xx": "zq qz zzq qqz zqz",
    }
    rows = [(i, " ".join(rng.choice(speak[k].split()) for _ in range(rng.randint(8, 50))), k) for i, k in enumerate(list(speak) * 60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language.train(frame, crc_mod(F.col("doc_id"), 4) != 2)
    assert model.families == {"germanic": ["de", "en"], "other": ["xx"], "romance": ["es", "fr"]}
    found = language.predict(frame, model, keep=("lang",)).where(crc_mod(F.col("doc_id"), 4) == 2).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found) and all(0 <= r.score <= 1 for r in found)
    edge = spark.createDataFrame([(1, None), (2, ""), (3, "12 ... \u0301"), (4, "漢字")], "doc_id long, text string")
    names = {r.doc_id: r.lang_pred for r in language.predict(edge, model).collect()}
    assert [names[i] for i in (1, 2, 3)] == ["und"] * 3 and names[4] != "und"
    assert language.predict(no_docs, model).count() == 0
    assert language.predict(clashing, model).count() == docs.count()
    assert language.train(no_docs) is None and {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}
    single = language.train(frame.where("lang = 'en'"))
    assert {r.lang_pred for r in language.predict(frame, single).collect()} == {"en"}


def test_declared_licenses(spark):
    """Tags, names in a project's words, titles; a notice isn't a license."""
    cases = {
        "// SPDX-License-Identifier: MIT\nint x;": "MIT",
        "/* spdx-license-identifier:Apache-2.0 */": "Apache-2.0",
        "# SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later",
        "# SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT",
        "mit\nSPDX-License-Identifier: Unknown-1": "",
        "This project is licensed under the MIT License - see the LICENSE file for details.": "MIT",
        "This project is licensed under the MIT License - see the [LICENSE.md](LICENSE.md) file for details": "",
        "This project is licensed under the Apache License 2.0 - see the [LICENSE](LICENSE) file\nfor details.": "Apache-2.0",
        "                                 Apache License\n                           Version 2.0, January 2004\n": "Apache-2.0",
        "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n": "GPL-3.0-only",
        "The MIT License (MIT)\n\nCopyright (c) 2020 Somebody": "MIT",
        "This file is licensed under the Creative Commons Attribution-Share Alike 4.0 International license.": "CC-BY-SA-4.0",
        "We licensed it. All rights reserved.": "",
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan(frame).collect()}
    assert {t: ",".join(rows[i].licenses) for i, t in enumerate(cases)} == cases
    assert [list(r.notices) for i, r in sorted(rows.items())][-1] == ["All-Rights-Reserved"] and not rows[0].notices
