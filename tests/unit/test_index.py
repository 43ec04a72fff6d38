"""The stored search index: same results as a search in a corpus, fewer hits, no second look at the texts."""

import random

import pytest
from pyspark.sql import functions as F

from parley.operators import index as ix
from parley.operators import search
from parley.operators.index import SearchIndex
from tests.unit.test_threads import brute


def ranked(rows):
    found: dict = {}
    for r in rows.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 8)))
    return found


def corpus_of(spark, docs):
    return spark.createDataFrame([(i, i, t) for i, t in enumerate(docs)], "doc_id int, pos int, text string")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    make = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice(["", "", "é"]) for _ in range(n))
    docs = [make(rng.randint(0, 12)) for _ in range(60)] + ["a b", "a b", "b a", "", "..."]
    return docs, [make(5) for _ in range(15)] + ["", "zzz", "a b", "b a", "a a a a b c d e f g h i j"]


@pytest.mark.parametrize("scheme", ["bm25", "tfidf"])
@pytest.mark.parametrize("bounded", [False, True])
def test_same_as_brute_force(spark, texts, tmp_path, scheme, bounded, monkeypatch):
    monkeypatch.setattr(ix, "PART", 7)
    docs, queries = texts
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, text string")
    made = SearchIndex.build(corpus_of(spark, docs), str(tmp_path / "i"), scheme)
    for k in (1, 100):
        assert ranked(made.search(asked, k, bounded=bounded)) == brute(queries, docs, k, scheme)
    assert ranked(search.search(asked, made, 3, scheme)) == brute(queries, docs, 3, scheme)
    with pytest.raises(ValueError):
        search.search(asked, made, 3, "other")


def test_empty_corpus(spark, tmp_path):
    asked = spark.createDataFrame([(1, "a b")], "query_id int, text string")
    made = SearchIndex.build(corpus_of(spark, ["x"]).limit(0), str(tmp_path / "i"))
    assert [made.search(asked, 3, bounded=b).count() for b in (False, True)] == [0, 0]
    grown = made.add(corpus_of(spark, ["x", "b"]))
    assert ranked(grown.search(asked, 3)) == {1: [(1, 1.0)]} | {1: brute(["a b"], ["x", "b"], 3, "bm25")[0]}


def test_delta(spark, texts, tmp_path):
    """Added in three steps, some documents a second time with another text: as if built at once. Half-written versions aren't seen."""
    docs, queries = texts
    asked, folder = spark.createDataFrame(list(enumerate(queries)), "query_id int, text string"), str(tmp_path / "i")
    corpus = corpus_of(spark, docs)
    made = SearchIndex.build(corpus.where("doc_id < 20").withColumn("text", F.when(F.col("doc_id") % 4 == 0, "other words").otherwise(F.col("text"))), folder)
    made = made.add(corpus.where("doc_id % 4 = 0 or doc_id between 20 and 40")).add(corpus.where("doc_id > 30"))
    assert ranked(made.search(asked, 3)) == brute(queries, docs, 3, "bm25")
    assert (made.version, made.n) == (3, len(docs))
    made.table("raw").write.parquet(f"{folder}/v000004/raw")  # a run that was stopped
    assert SearchIndex.load(spark, folder).version == 3
    assert SearchIndex.load(spark, folder).add(corpus.limit(1)).version == 5
    assert SearchIndex.load(spark, str(tmp_path / "none")) is None


def test_delta_goes_on_from_counts(spark, tmp_path):
    """Terms are counted in what changes only, and added to the counts that the version before has: as if built at once."""
    docs = ["a b", "b c c", "c d", "", "a a e"]
    corpus, folder = corpus_of(spark, docs), tmp_path / "i"
    counts = lambda made: {r.term: (r.df, round(r.idf, 9)) for r in made.table("terms").collect()}
    first = SearchIndex.build(corpus.where("doc_id < 3").withColumn("text", F.when(F.col("doc_id") == 1, "a gone gone").otherwise(F.col("text"))), str(folder))
    assert set(counts(first)) == {"a", "b", "c", "d", "gone"}
    made = first.add(corpus.where("doc_id in (1, 3)")).add(corpus.where("doc_id in (0, 4)"))
    whole = SearchIndex.build(corpus, str(tmp_path / "whole"))
    assert counts(made) == counts(whole) and (made.n, made.mean, made.first, made.most) == (whole.n, whole.mean, whole.first, whole.most)
    assert sorted(map(str, made.documents().drop("change").collect())) == sorted(map(str, whole.documents().drop("change").collect()))
    twice = made.add(corpus.where("doc_id = 1").union(corpus.where("doc_id = 1")))  # both stay, for what was one
    assert {t: n for t, (n, _) in counts(twice).items()} == {"a": 2, "b": 3, "c": 3, "d": 1, "e": 1}
    more = made.table("terms").select("term", (F.col("df") + 7).alias("df"), "idf").collect()
    spark.createDataFrame(more, "term string, df long, idf double").write.mode("overwrite").parquet(f"{folder}/v000003/terms")
    assert {t: n for t, (n, _) in counts(made.add(corpus.where("doc_id = 2"))).items()} == {"a": 9, "b": 9, "c": 9, "d": 8, "e": 8}


def test_versions_of_earlier_releases(spark, texts, tmp_path):
    """Their documents don't say what changed."""
    docs, queries = texts
    asked, folder = spark.createDataFrame(list(enumerate(queries)), "query_id int, text string"), tmp_path / "i"
    rows = SearchIndex.build(corpus_of(spark, docs).where("doc_id < 30"), str(folder)).documents().drop("change").collect()
    schema = "doc int, pos int, len int, terms array<struct<term:string,tf:long>>"
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/v000001/raw")
    made = SearchIndex.load(spark, str(folder))
    assert ranked(made.search(asked, 3)) == brute(queries, docs[:30], 3, "bm25")
    assert ranked(made.add(corpus_of(spark, docs).where("doc_id > 20")).search(asked, 3)) == brute(queries, docs, 3, "bm25")


def test_texts_are_not_read_again(spark, texts, tmp_path):
    docs, queries = texts
    corpus_of(spark, docs).write.parquet(str(tmp_path / "texts"))
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, text string")
    made = SearchIndex.build(spark.read.parquet(str(tmp_path / "texts")), str(tmp_path / "i"))
    for bounded in (False, True):
        found = made.search(asked, 3, bounded=bounded)
        files = found.inputFiles()
        assert files and not any("/texts/" in f for f in files)


def test_few_hits_are_joined(spark, tmp_path):
    """A word stands in every document, others in many: at most a tenth of the hits are looked at, and the result is the same."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    docs = ["the " * rng.randint(1, 3) + " ".join(["my"] * rng.randint(0, 2) + rng.choices(words, [1 / (i + 1) for i in range(400)], k=rng.randint(5, 25))) for _ in range(3000)]
    queries = [f"the my {' '.join(rng.choices(words, [1 / (i + 5) for i in range(400)], k=6))}" for _ in range(40)] + ["the", "the my"]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, text string")
    made = SearchIndex.build(corpus_of(spark, docs), str(tmp_path / "i"))
    assert ranked(made.search(asked, 3, bounded=True)) == ranked(made.search(asked, 3, bounded=False)) == ranked(search.search(asked, corpus_of(spark, docs), 3))
    known = made.asked(asked).where("_q < 40").cache()
    listed = known.groupBy("_q").agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("qw", "at").alias("v")))).alias("_m"))
    every = known.join(made.table("terms").select("term", "df"), "term").agg(F.sum("df")).first()[0]
    assert made.candidates(known, listed, 3).count() < every / 10
