"""What searches and agents put on disk: no texts that nobody asked for, and nothing of a table that is written."""

import os
import random

import pytest
from pyspark.sql import functions as F

from parley.operators import agents
from parley.operators import threads as th
from parley.operators.index import SearchIndex
from parley.plans import QUERIES, catalogue
from parley.session import kept
from tests.unit.test_cells import shuffled
from tests.unit.test_exchange import WORDS


def left(spark):
    """The shuffle files that are there now, and their bytes."""
    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return {f"{d}/{x}": os.path.getsize(f"{d}/{x}") for top in folders for d, _, names in os.walk(top) for x in names if x.startswith("shuffle_")}


@pytest.fixture(scope="module")
def replies(spark, tmp_path_factory):
    """3,000 short questions with long replies: 300 of them are asked, and find at most 300 replies of 1.2 KB."""
    rng = random.Random(5)
    rows = [(i, j, role, " ".join(rng.choices(WORDS, k=n))) for i in range(3000) for j, (role, n) in enumerate([("user", 5), ("assistant", 200)])]
    folder = tmp_path_factory.mktemp("replies")
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(2).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def test_only_the_best_replies_are_shuffled(spark, replies):
    """3.3 MB of replies: shuffled twice before."""
    catalogue._INDEXES.clear()
    before = shuffled(spark)
    rows = QUERIES["agent_pipeline"](spark, replies).collect()
    assert len(rows) == 300 and all(r.retrieved_thread_id for r in rows)
    assert shuffled(spark) - before < 2_000_000


def test_answered(spark):
    """Whether there is a reply, without the reply: with texts and turns that are null, and assistants that speak first."""
    rng = random.Random(3)
    rows = [
        (conv, None if rng.random() < 0.05 else turn, rng.choice(["user", "assistant", "assistant", "system"]), None if rng.random() < 0.2 else f"{conv} {turn}")
        for conv in range(500) for turn in range(rng.randint(1, 6))
    ]
    made = th.first_exchange(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5), answered=True)
    both = made.select(F.col("brand_text").isNotNull().alias("there"), "answered").collect()
    assert all(r.there == r.answered for r in both) and {r.there for r in both} == {True, False}
    assert "_answer" not in made.select("conv_id", "answered")._jdf.queryExecution().optimizedPlan().toString().replace("_answered", "")


def test_best_only(spark):
    """As with candidates; and what may have been found is never less than what was."""
    rng = random.Random(6)
    words = "wifi battery screen slow update refund charge drops low".split()
    corpus = spark.createDataFrame([(f"d{i}", i, " ".join(rng.choices(words, k=4)), f"reply {i}") for i in range(60)], "thread_id string, pos int, customer_text string, brand_text string")
    asked = spark.createDataFrame([(f"q{i}", " ".join(rng.choices([*words, "zzz"], k=3))) for i in range(25)] + [("none", "zzz"), ("empty", "")], "thread_id string, customer_text string")
    every = agents.full(asked, corpus).drop("candidates")
    best = agents.full(asked, corpus, candidates=False)
    assert sorted(map(str, best.select(every.columns).collect())) == sorted(map(str, every.collect()))
    assert agents.full(asked, corpus.limit(0), candidates=False).where("predicted_intent is null or retrieved_thread_id is not null").count() == 0
    ids = corpus.where("pos % 7 = 0").select("thread_id")
    found = {r[0] for r in corpus.where(agents.likely(F.col("thread_id"), ids, "thread_id")).select("thread_id").collect()}
    assert {r[0] for r in ids.collect()} <= found and len(found) < 12


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", left(spark)
    setting = spark.conf.get(key)
    rows = spark.range(200_000).repartition(3, "id")
    assert kept(rows, str(tmp_path / "x")).count() == 200_000
    assert sum(size for x, size in left(spark).items() if x not in before) < 10_000 and spark.conf.get(key) == setting


def test_extended_index_has_one_version_left(spark, replies, monkeypatch, tmp_path):
    monkeypatch.setattr(catalogue, "shared_dir", lambda spark: str(tmp_path))
    assert len({r.query_id for r in QUERIES["bm25_top3_extended"](spark, replies).collect()}) == 300
    assert [v.name for s in tmp_path.glob("search-*") for v in s.glob("v*")] == ["v000002"]


def test_each_step_of_the_extended_index_counts(spark, replies, monkeypatch):
    """As from an index that is built at once; not so if the delta leaves out what it has to replace, or if there is no delta."""
    add, there = SearchIndex.add, []
    hits = lambda name="bm25_top3_extended": sorted(map(str, QUERIES[name](spark, replies).select("query_id", "rank", "doc_id", "score").collect()))
    whole = hits("bm25_top3")

    def new_only(self, more):
        known = self.table("raw").select(F.col("doc").alias("doc_id"))
        there.append(more.join(known, "doc_id", "left_semi").count())
        return add(self, more.join(known, "doc_id", "left_anti"))

    assert hits() == whole
    monkeypatch.setattr(SearchIndex, "add", new_only)
    assert hits() != whole and there == [100]
    monkeypatch.setattr(SearchIndex, "add", lambda self, more: add(self, more.limit(0)))
    assert hits() != whole
