"""The stages against brute-force versions of them."""

import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from parley.llm.common import cut
from tests.llm.test_duplicates import alike_groups, repeated, split
from tests.llm.test_filters import contaminated


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(12)
    passage = " ".join(f"item{i}" for i in range(30))
    shared = " ".join(f"s{i}" for i in range(50))
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    for i in range(100, 130):
        body = " ".join(rng.choice(["der", "und", "haus"] if i % 2 else ["the", "and", "house"]) + str(rng.randrange(900)) for _ in range(60))
        rows.append((i, body + (" " + shared if i % 5 == 0 else "") + (" " + passage if i % 7 == 0 else ""), "de" if i % 2 else "en", "src0", None))
    rows += [(200, "1234 ... 5678", "en", "src1", 13), (201, passage, "en", "src1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, "unseen words " * 6)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    held = {r.doc_id: r.text for r in docs.collect()}
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, folder), name)
        made[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == columns
    get = lambda name: {r.doc_id: r.text for r in made[name].collect()}

    one = get("language_id")
    assert one == {k: t for k, t in held.items() if t and any(map(str.isalpha, t))}
    keys = sorted(one)
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    label = alike_groups([shingles(split(one[k].lower())) for k in keys])
    two = get("simhash_near_dedup")
    assert sorted(two) == sorted({keys[g] for g in label})
    order = sorted(two)
    want = {}
    for k, (_, removed, kept) in zip(order, repeated([two[k] for k in order], 35)):
        text = kept if removed else two[k]
        if text:
            want[k] = text
    three = get("substring_dedup")
    assert three == want
    four = get("benchmark_decontamination")
    order = sorted(three)
    for k, (n, hit, _) in zip(
        order,
        contaminated(
            [three[k] for k in order],
            [("1", "item0"), *[(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]][1:], 10,
        ),
    ):
        if not hit:
            assert four[k] == three[k]
        elif hit > n / 2:
            assert k not in four
        else:
            assert "item5 " not in four[k] and len(four[k].split()) == n - hit
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = {}
    for r in made["best_fit_packing"].collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {k: len(library.encode(t, add_special_tokens=False).ids) + 1 for k, t in four.items()}


def test_stages_on_edge_tables(spark, folder, docs, no_docs, clashing):
    for frame in (no_docs, docs, clashing):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, frame, folder)
            assert made.count() == 0 or frame is not no_docs
            assert name == "best_fit_packing" or made.columns == no_docs.columns


def test_run_is_the_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert rows.selectExpr("count(distinct doc_id) n").first().n > 10 and corpus_pipeline.ORACLE_SQL is None


def test_near_copies_go(spark):
    """Against brute force over 5-word shingles; one word in 60 changed is far beyond two bits."""
    rng = random.Random(4)
    rows, sets = [], []
    for g in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(80, 300))]
        for c in range(6):
            words = [f"n{g}.{c}.{i}" if c and rng.random() < c / 150 else w for i, w in enumerate(base)]
            rows.append((len(rows), (" " * (c % 2 + 1)).join(words), "en", None, None))
            sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    label = alike_groups(sets)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == sorted(set(label)) and 30 < len(kept) < 150


def test_no_language_to_learn(spark):
    rows = [(1, "some words", None, "a", 10), (2, None, None, "a", None), (3, "12 ... 3", None, "a", 8), (4, "漢字", None, "a", 2), (5, "", None, "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(tuple(r) for r in corpus_pipeline.language_id(spark, docs, "").collect()) == [rows[0], rows[3]]


def test_the_language_that_is_found_is_told(spark):
    """The stage's rows follow the model: labels that are missing or wrong are set right."""
    rng = random.Random(6)
    speak = {"en": "the and of that with which house", "fr": "le et que avec dans une maison"}
    rows = [(i, " ".join(rng.choice(speak[k].split()) for _ in range(40)), k, None, None) for i, k in enumerate(["en", "fr"] * 40)]
    rows += [(100, rows[0][1], None, None, None), (101, rows[1][1], "en", None, None), (102, "...", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert found == {**{i: k for i, _, k, *_ in rows[:80]}, 100: "en", 101: "fr"}
