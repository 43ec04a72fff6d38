"""Operator 13 against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from parley.llm import phrases
from parley.llm.queries import op13_phrase_collocations


def mined(rows, least, max_n=4, top=2000, percent=80):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, max_n + 1):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = set()
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            inside = (q for q in found if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if any(100 * found[q] >= percent * a for q in inside):
                continue
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return out


def rows_of(found):
    return {tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    pool = ["the", "The", "of", "a", "x\x01", "x", "x\x00y", "é", "École", "new", "York", "z" * 400, "b-c", "7", "　", "w\x1fv"]
    weights = [30, 5, 20, 10, 6, 6, 3, 4, 3, 8, 8, 1, 2, 3, 1, 2]
    out = []
    for i in range(150):
        words = rng.choices(pool, weights, k=rng.randrange(60))
        if i % 3 == 0:
            words += ["good", "old", "new", "York"] * rng.randrange(4)
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", " ! ", "\x0b"]) for w in words)
        out.append((rng.choice(["en", "en", "en", "fr", None, "und", ""]), text))
    out += [(None, None), ("de", None), ("de", ""), ("de", " .,\n"), ("en", "the of " * 5000), ("en", "same words again. " * 300)]
    return out + out[:20]


@pytest.mark.parametrize("bits, share", [(27, 1 / 512), (16, 1 / 512), (20, 1 / 20), (20, 1e-6)])
def test_collocations(spark, rows, monkeypatch, bits, share):
    """A full sketch, and all kinds of hot beginnings, give the same."""
    monkeypatch.setattr(phrases, "HOT_SHARE", share)
    monkeypatch.setattr(phrases, "COUNTED", 500)
    monkeypatch.setattr(phrases, "HELD", 50)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for least, max_n, top, percent in ((5, 4, 2000, 80), (3, 3, 7, 50), (40, 2, 5, 100)):
        if bits != 27 and least != 5:
            continue
        found = phrases.collocations(docs, least, max_n, top, percent, bits=bits)
        assert rows_of(found) == mined(rows, least, max_n, top, percent)


def test_hot_beginnings_are_split(spark):
    """Half of all text starts with one word, most of it with one pair: their suffixes go to many parts."""
    rng = random.Random(1)
    text = " ".join(f"hot pair w{rng.randrange(40)} v{rng.randrange(40)}." for _ in range(4000))
    docs = spark.createDataFrame([("en", text)], "lang string, text string")
    known = phrases.sketch(docs, 2, bits=20)
    parts = phrases.suffixes(docs, known).where(F.col("suffix").startswith("hot pair ")).select("part", "split").distinct().collect()
    assert len(parts) > 1000 and {r.split for r in parts} == {4}


def test_large_numbers(spark):
    """Products beyond 64 bits."""
    a = 6 * 10**12
    spark.createDataFrame([("p q", a, 3 * 10**18, 4 * 10**18)], "phrase string, a long, l long, r long").createOrReplaceTempView("large")
    score = spark.sql("SELECT floor(cast(a as decimal(38,0)) * 2000000 div (cast(l as decimal(38,0)) + r)) AS s FROM large").first()["s"]
    assert score == a * 2_000_000 // (7 * 10**18)


def test_edges(spark, docs, no_docs, clashing):
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    want = mined(rows, 3)
    assert rows_of(phrases.collocations(docs, 3, bits=18)) == want
    more = clashing.withColumns({c: F.lit("clash") for c in ("a", "l", "r", "n", "rank", "phrase", "score", "part", "suffix", "_lang")})
    assert rows_of(phrases.collocations(more, 3, bits=18)) == want
    assert phrases.collocations(no_docs).collect() == []


def test_query(spark, rows, tmp_path):
    numbered = [(i, *r) for i, r in enumerate(rows)]
    spark.createDataFrame(numbered, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = op13_phrase_collocations(spark, str(tmp_path))
    assert dict(found.dtypes) == {"lang": "string", "phrase": "string", **{c: "bigint" for c in ("rank", "a", "l", "r", "n", "score")}}
    assert rows_of(found) == mined(rows, 30)
