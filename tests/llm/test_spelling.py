"""Operator 11 against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from parley.llm import spelling
from parley.llm.queries import op11_spelling_variants


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def counted(rows, damage=None, min_chars=5, min_count=3):
    out = Counter()
    for name, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", lowered(text)):
            if damage:
                h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
                if h % damage == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= min_chars and n >= min_count}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(words):
    near = {a: [b for b in words if one_apart(a, b)] for a in words}
    form = {}
    for a, found in near.items():
        best = min(found, key=lambda b: (-words[b], b), default=None)
        if best is not None and words[best] >= 2 * words[a]:
            form[a] = best
    out = {}
    for a in words:
        root = a
        while root in form:
            root = form[root]
        out[a] = (form.get(a), root, words[a], len(near[a]), words[form[a]] if a in form else None)
    return out


def rows_of(found):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()}


def many_words(rng, letters, n):
    """Words of few letters (bigrams repeat in them), with edits of one another."""
    out = {"".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(n)}
    for w in list(out):
        at = rng.randrange(len(w))
        out.add(w[:at] + rng.choice(letters) + w[at + rng.randint(0, 1) :])
    return {w: rng.choice([3, 5, 6, 9, 40, 300]) for w in out if len(w) >= 4}


@pytest.mark.parametrize("letters, block", [("ab", 4096), ("ab", 8), ("abcé÷", 4096), ("abcé÷", 16), ("aab", 1)])
def test_variants(spark, letters, block):
    """Few letters crowd the places; small blocks split them by halves."""
    words = many_words(random.Random(len(letters) + block), letters, 250)
    words |= {"ab" * 40: 7, "ab" * 40 + "a": 3, "b" * 300: 3, "b" * 301: 9, "z" * 70 + "xyz": 4, "z" * 70 + "xz": 8}
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert rows_of(spelling.variants(table, block=block)) == grouped(words)


def test_ties_and_chains(spark):
    """Of equal counts the first in code-point order; a form with less than twice the count is none; chains lead to the last word."""
    words = {"stone": 10, "stond": 10, "stonc": 20, "stont": 20, "store": 40, "stork": 79, "spore": 90, "spoke": 180, "spoked": 360, "alone": 3, "ÿtone": 3}
    found = rows_of(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert found == grouped(words)
    assert found["stone"][:2] == ("store", "spoked")
    assert found["stond"][0] == "stonc"
    assert found["alone"] == (None, "alone", 3, 0, None)


def test_word_counts(spark, monkeypatch):
    """Damage, case, null keys and texts, other letters as borders; also where a task sends its words on in portions."""
    monkeypatch.setattr(spelling, "HELD", 4)
    rng = random.Random(8)
    pool = ["Straße", "ÀÉÎõü", "héllo", "hello", "×÷×÷×÷", "ĀĂabcdeĂ", "don't-stop", "x" * 3000, "under_score", "tab\tline\nword", "İstanbul", "ǅabcdef"]
    rows = [(i if i % 7 else None, " ".join(rng.choice(pool) for _ in range(30))) for i in range(60)] + [(1, None), (2, ""), (None, None), (3, "...")]
    rows += rows[:9]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for damage in (None, 2, 97):
        found = spelling.word_counts(docs, damage=damage)
        assert {r.word: r.n for r in found.collect()} == counted(rows, damage)


def test_edges(spark, docs, no_docs, clashing, texts):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for table in (docs, clashing.withColumn("word", clashing.fp).withColumn("n", clashing.fp)):
        found = spelling.variants(spelling.word_counts(table, damage=5, min_chars=4))
        assert rows_of(found) == grouped(counted(rows, 5, 4))
    assert spelling.variants(spelling.word_counts(no_docs)).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(spelling.word_counts(no_docs), factor=1)


def test_query(spark, tmp_path):
    rng = random.Random(4)
    pool = [w for w in many_words(rng, "abcde", 60)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(80)), "en") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = op11_spelling_variants(spark, str(tmp_path))
    assert dict(found.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert rows_of(found) == grouped(counted([r[:2] for r in rows], 97))
