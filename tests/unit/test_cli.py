"""The command line on small files, from flat messages to reports."""

import json
import os

import pytest

from parley import cli
from parley.operators import errors
from parley.operators.index import SearchIndex
from parley.sources.batches import Batches, answered
from tests.unit.test_threads import CSV

def clients(model):
    """Stands for a language model that gives one label to all."""
    return [lambda prompt: json.dumps({"intent": "apps_feature_howto"}) if model == "howto" else ""]


GOLD = [
    {
        "thread_id": "g1", "customer_tweet_id": "1", "customer_text": "my battery drains", "brand_text": "check settings",
        "intent": "battery_power_issue", "escalate": False,
    },
    {
        "thread_id": "g2", "customer_tweet_id": "2", "customer_text": "i want a refund", "brand_text": "send us a dm", "intent": "other",
        "escalate": True, "escalate_reason": "channel_transition",
    },
]


def results(folder):
    return [json.loads(x) for f in os.listdir(folder / "results") if f.endswith(".json") for x in (folder / "results" / f).read_text().splitlines()]


@pytest.fixture
def run(spark, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda master: spark)
    return lambda *args: cli.main(list(map(str, args)))


def test_from_messages_to_reports(run, tmp_path, capsys):
    (tmp_path / "t.csv").write_text(CSV)
    run("subsample", "--input", tmp_path / "t.csv", "--output-dir", tmp_path / "sub", "--brand", "Brand")
    stats = json.loads((tmp_path / "sub/stats.json").read_text())
    assert stats["threads"] == 2 and stats["turn_histogram"] == {"2": 1, "5": 1}
    run(
        "sample-gold", "--input", tmp_path / "sub/threads", "--output-jsonl", tmp_path / "gold", "--output-holdout", tmp_path / "ids.txt",
        "--output-sampling-doc", tmp_path / "s.md",
    )
    assert len((tmp_path / "ids.txt").read_text().split()) == 2 and "of 2 threads" in (tmp_path / "s.md").read_text()

    (tmp_path / "gold.jsonl").write_text("\n".join(map(json.dumps, GOLD)))
    for kind in ("agent", "always_escalate"):
        run("eval-gold", "--gold-path", tmp_path / "gold.jsonl", "--corpus", tmp_path / "sub/threads", "--output-dir", tmp_path / "eval", "--baseline", kind)
        assert json.loads((tmp_path / f"eval/{kind}.json").read_text())["escalation"]["total"] == 2
    text = (tmp_path / "eval/agent.md").read_text()
    assert "battery_power_issue" in text and "MODE_" in text
    run("dump-errors", "--predictions", tmp_path / "eval/agent_predictions", "--output-dir", tmp_path / "err")
    assert "of 2 rows" in (tmp_path / "err/errors.md").read_text()

    out = tmp_path / "online"
    run("online-eval", "--gold-path", tmp_path / "gold.jsonl", "--corpus", tmp_path / "sub/threads", "--output-file", out, "--max-items", 1)
    run("online-eval", "--gold-path", tmp_path / "gold.jsonl", "--corpus", tmp_path / "sub/threads", "--output-file", out)
    lines = results(out)
    assert sorted(x["thread_id"] for x in lines) == ["g1", "g2"]
    assert len([x for x in os.listdir(out) if x.startswith("index-")]) == 1
    cached = [{k: x.get(k) for k in ("thread_id", "predicted_intent", "predicted_escalate", "predicted_reason", "predicted_reply")} for x in lines]
    (tmp_path / "cache.json").write_text(json.dumps({"predictions": cached}))
    run("eval-gold", "--gold-path", tmp_path / "gold.jsonl", "--output-dir", tmp_path / "eval", "--replay", tmp_path / "cache.json")
    assert (tmp_path / "eval/replay.md").exists()

    # A partial cache is scored for the rows that it has.
    (tmp_path / "part.jsonl").write_text(json.dumps(cached[0]))
    run("eval-gold", "--gold-path", tmp_path / "gold.jsonl", "--output-dir", tmp_path / "part", "--replay", tmp_path / "part.jsonl")
    assert json.loads((tmp_path / "part/replay.json").read_text())["escalation"]["total"] == 1

    (tmp_path / "held.txt").write_text("g2\ng1\n")
    with pytest.raises(errors.ValidationError, match="holdout_order"):
        run(
            "eval-gold", "--gold-path", tmp_path / "gold.jsonl", "--holdout-path", tmp_path / "held.txt", "--corpus",
            tmp_path / "sub/threads", "--output-dir", tmp_path / "eval",
        )
    (tmp_path / "held.txt").write_text("g1\n\n g2 \n")
    run(
        "run-baseline", "--gold-path", tmp_path / "gold.jsonl", "--holdout-path", tmp_path / "held.txt", "--corpus",
        tmp_path / "sub/threads", "--output-dir", tmp_path / "base", "--type", "trivial",
    )
    assert (tmp_path / "base/trivial.md").exists() and not (tmp_path / "base/agent.md").exists()
    with pytest.raises(SystemExit, match="breaches"):
        run("audit-gold", "--gold-path", tmp_path / "gold.jsonl", "--corpus", tmp_path / "sub/threads")
    said = capsys.readouterr().out
    assert "not_in_source: row 0, id g1" in said and "missing_notes" in said
    run("check-labels", "--gold-path", tmp_path / "gold.jsonl", "--dump", tmp_path / "dump")
    assert "2 of 2 rows are labelled, numbers 1 to 2" in capsys.readouterr().out
    run(
        "eval-gold", "--gold-path", tmp_path / "gold.jsonl", "--corpus", tmp_path / "sub/threads", "--output-dir", tmp_path / "llm",
        "--baseline", "agent", "--use-llm", "--provider", "tests.unit.test_cli:clients", "--model", "howto",
    )
    assert json.loads((tmp_path / "llm/agent.json").read_text())["intent"]["accuracy"] == 0.0

    capsys.readouterr()
    run("run-agent", "--corpus", tmp_path / "sub/threads", "--text", "the wifi is off")
    assert json.loads(capsys.readouterr().out)["predicted_intent"] == "connectivity_network_issue"
    run("run-agent", "--corpus", tmp_path / "sub/threads", "--gold-path", tmp_path / "gold.jsonl", "--samples", 1)
    assert json.loads(capsys.readouterr().out)["thread_id"] == "g1"
    run("run-agent", "--corpus", tmp_path / "sub/threads", "--gold-path", tmp_path / "gold.jsonl", "--samples", 5)
    assert [x in capsys.readouterr().out for x in ["g1"]] == [True]
    with pytest.raises(SystemExit, match="needed"):
        run("run-agent", "--corpus", tmp_path / "sub/threads")
    run("run-judge", "--query", "it broke", "--reply", "our fault")
    assert json.loads(capsys.readouterr().out)["overall"] == 1
    sample = {
        "customer_text": "c", "candidate_reply": "restart it", "predicted_escalate": False, "human_safety": True,
        **{f"human_{d}": 4 for d in ("overall", "relevance", "tone", "actionability")},
    }
    (tmp_path / "cal.jsonl").write_text("\n".join([json.dumps(sample)] * 3))
    run("run-judge", "--mode", "calibrate", "--calibration-file", tmp_path / "cal.jsonl", "--output-dir", tmp_path / "judge")
    assert "100.00% equal" in (tmp_path / "judge/agreement.md").read_text()


def test_stopped_between_rows_and_entry(run, tmp_path, monkeypatch):
    """Each row has one result, in a store given by a URI, however often a run was stopped; the index is built once."""
    gold = [{**GOLD[0], "thread_id": f"g{i}", "customer_text": f"my battery drains {i}"} for i in range(5)]
    (tmp_path / "gold.jsonl").write_text("\n".join(map(json.dumps, gold)))
    thread = {"thread_id": "t1", "customer_text": "battery drains", "brand_text": "check settings", "turn_count": 2}
    (tmp_path / "corpus.jsonl").write_text(json.dumps(thread))
    out = tmp_path / "online"
    ask = ("online-eval", "--gold-path", tmp_path / "gold.jsonl", "--corpus", tmp_path / "corpus.jsonl", "--output-file", f"file://{out}", "--batch", 2)
    commit, built = Batches.commit, []
    build = SearchIndex.build.__func__
    monkeypatch.setattr(SearchIndex, "build", classmethod(lambda cls, *a: built.append(1) or build(cls, *a)))

    def stop(self, batch):
        if len(self.done()) == 1:
            raise KeyboardInterrupt
        commit(self, batch)

    monkeypatch.setattr(Batches, "commit", stop)
    for _ in range(2):
        with pytest.raises(KeyboardInterrupt):
            run(*ask)
    assert len(os.listdir(out / "rows")) == 2 and not (out / "results").exists()
    monkeypatch.setattr(Batches, "commit", commit)
    run(*ask)
    assert sorted(x["thread_id"] for x in results(out)) == [f"g{i}" for i in range(5)]
    assert {x["retrieved_thread_id"] for x in results(out)} == {"t1"} and len(built) == 1
    run(*ask)
    assert len([x for x in os.listdir(out / "done") if not x.startswith(".")]) == 3
    run(*ask, "--no-resume")
    assert sorted(x["thread_id"] for x in results(out)) == [f"g{i}" for i in range(5)]


def test_batches(spark, tmp_path):
    """A later attempt replaces the rows of an earlier one; unfinished results are asked for again."""
    store = Batches(spark, str(tmp_path / "b"))
    made = lambda rows: spark.createDataFrame(rows, "thread_id string, predicted_intent string, predicted_reply string")
    todo = made([(x, None, None) for x in "abc"])
    assert store.read() is None and answered(store, todo).count() == 3
    assert store.write(made([("a", "other", "hi"), ("b", "other", "")]), 0) == "b000000000000-000000"
    assert sorted(r[0] for r in answered(store, todo).collect()) == ["b", "c"]
    assert store.write(made([("b", "other", "now"), ("c", "other", "hi")]), 0) == "b000000000000-000001"
    assert {r.thread_id: r.predicted_reply for r in store.read().collect()} == {"a": "hi", "b": "now", "c": "hi"}
    assert answered(store, todo).count() == 0
    store.clear()
    assert store.read() is None
