"""Search by cells: exact in many blocks, with copies and common words, and without a row for each pair of a query and a document."""

import random

import pytest

from parley.operators import cells, search
from parley.operators import index as ix
from parley.plans import QUERIES, catalogue
from tests.unit.test_index import corpus_of, ranked
from tests.unit.test_threads import brute

WORDS = [f"w{i}" for i in range(300)]


def make(rng, n):
    return " ".join(["the"] * rng.randint(0, 2) + ["my"] * rng.randint(0, 1) + rng.choices(WORDS, [1 / (i + 1) for i in range(300)], k=n))


def shuffled(spark):
    """Bytes that this session has written to shuffles so far."""
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


@pytest.mark.parametrize("scheme", ["bm25", "tfidf"])
@pytest.mark.parametrize("part", [60, 1000])
def test_same_as_brute_force(spark, scheme, part, monkeypatch):
    monkeypatch.setattr(cells, "PART", part)
    monkeypatch.setattr(cells, "ASKED", 11)
    rng = random.Random(6)
    docs = [make(rng, rng.randint(0, 20)) for _ in range(260)]
    docs += [docs[3]] * 40 + ["the my"] * 30 + ["", "the"]
    queries = [make(rng, rng.randint(1, 12)) for _ in range(30)] + [docs[3], docs[3], "the", "my the", "", "zzz"]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, text string")
    for k in (3, 500):
        assert ranked(search.search(asked, corpus_of(spark, docs), k, scheme)) == brute(queries, docs, k, scheme)


@pytest.fixture(scope="module")
def talks(spark, tmp_path_factory):
    """4,000 conversations, two words of which stand in all: 1.4 million pairs of a query and a document."""
    rng = random.Random(8)
    rows = [(i, j, role, f"the my {make(rng, 4)}") for i in range(4000) for j, role in enumerate(("user", "assistant"))]
    folder = tmp_path_factory.mktemp("talks")
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(4).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["bm25_top3_unstored", "retrieval_context", "tfidf_top1", "simple_agent", "bm25_top3_by_bounds", "agent_pipeline", "bm25_top3_extended", "bm25_top3"])
def test_hits_are_not_shuffled(spark, talks, name):
    """Nor with joins that can't be broadcast."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        assert len({r[0] for r in QUERIES[name](spark, talks).collect()}) == 400
        assert shuffled(spark) - before < 6_000_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize("name", ["bm25_top3", "agent_pipeline", "bm25_top3_extended"])
def test_blocks_are_shuffled_once(spark, talks, name, monkeypatch):
    """However many blocks there are on the other side: the same rows, and no copy of a block for each of them."""
    made = []
    for part, asked in ((cells.PART, cells.ASKED), (400, 50)):
        monkeypatch.setattr(cells, "PART", part)
        monkeypatch.setattr(ix, "PART", part)
        monkeypatch.setattr(cells, "ASKED", asked)
        catalogue._INDEXES.clear()
        before = shuffled(spark)
        made.append((sorted(map(str, QUERIES[name](spark, talks).collect())), shuffled(spark) - before))
    (rows, least), (again, most) = made
    assert rows == again and most < 2 * least
