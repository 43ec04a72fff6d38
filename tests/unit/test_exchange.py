"""The first exchange of a conversation: exact wherever an assistant speaks first, and only first turns are shuffled."""

import random

import pytest

from parley.operators import threads as th
from parley.operators.index import SearchIndex
from parley.plans import QUERIES
from tests.unit.test_cells import shuffled

WORDS = [f"w{i}" for i in range(3000)]


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        users = sorted((r[1] is not None, r[1] or 0, r[3]) for r in own if r[2] == "user")
        if users:
            known, turn, text = users[0]
            later = sorted((r[1], r[3]) for r in own if r[2] == "assistant" and known and r[1] is not None and r[1] > turn)
            counts = [sum(r[2] == x for r in own) for x in ("user", "assistant")]
            out[conv] = (text, later[0][1] if later else None, sum(counts), *counts)
    return out


def test_any_order_of_speakers(spark):
    rng = random.Random(3)
    rows = [
        (conv, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 1]), rng.choice(["user", "assistant", "assistant", "system"]), f"{conv} {turn} {rng.random()}")
        for conv in range(400) for turn in range(rng.randint(1, 7))
    ]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(7)
    found = {r.conv_id: tuple(r)[1:] for r in th.first_exchange(turns).collect()}
    assert found == expected(rows)
    assert sum(v[1] is not None for v in found.values()) > 100


@pytest.fixture(scope="module")
def long_talks(spark, tmp_path_factory):
    """200 conversations of 30 turns, 40 words each: 1.5 MB of texts."""
    rng = random.Random(4)
    rows = [(i, j, ("user", "assistant")[j % 2], " ".join(rng.choices(WORDS, k=40))) for i in range(200) for j in range(30)]
    folder = tmp_path_factory.mktemp("talks")
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(2).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["retrieval_context", "simple_agent", "agent_pipeline", "bm25_top3"])
def test_only_first_turns_are_shuffled(spark, long_talks, name):
    before = shuffled(spark)
    assert len({r[0] for r in QUERIES[name](spark, long_talks).collect()}) == 20
    assert shuffled(spark) - before < 400_000


def test_deltas_rewrite_counts_only(spark, tmp_path):
    corpus = spark.createDataFrame([(i, i, f"w{i} the my") for i in range(20)], "doc_id int, pos int, text string")
    made = SearchIndex.build(corpus.where("pos < 9"), str(tmp_path / "i")).add(corpus.where("pos > 7"))
    assert {p.name for p in (tmp_path / "i" / f"v{made.version:06d}").iterdir()} == {"raw", "terms", "sums", "stats"}
