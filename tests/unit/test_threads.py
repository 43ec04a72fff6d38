"""Threads, samples, search, errors, validation, sources and streams on small tables."""

import json
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parley.functions import lexicon as lx
from parley.operators import agents, assisted, errors, provider, sampling, search, threads
from parley.sources import files
from parley.streaming import triage

CSV = '''tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id
1,100,True,Fri Dec 01 10:37:51 +0000 2017,"help, it ""broke""
twice",2,
2,Brand,False,Fri Dec 01 10:40:00 +0000 2017,try this,"3, 9",1
3,100,True,Fri Dec 01 10:41:00 +0000 2017,thanks,4,2
4,Brand,False,Fri Dec 01 10:42:00 +0000 2017,welcome,,3
5,200,TRUE,Mon Sep 04 01:00:00 +0000 2017,other,6,
6,Brand,False,Mon Sep 04 01:05:00 +0000 2017,first,,5
7,Brand,False,Mon Sep 04 01:06:00 +0000 2017,second,,5
8,300,True,Mon Sep 04 01:06:00 +0000 2017,nobody answers,,
9,100,True,Mon Sep 04 01:07:00 +0000 2017,more,,2
'''


@pytest.fixture(scope="module")
def tweets(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "t.csv"
    path.write_text(CSV)
    return files.read_tweets(spark, str(path)).cache()


def test_rebuild(spark, tweets):
    rows = {r.thread_id: r for r in threads.rebuild(tweets, "Brand").collect()}
    assert sorted(rows) == ["thread_00001", "thread_00002"]
    a, b = rows["thread_00001"], rows["thread_00002"]
    assert a.customer_text == 'help, it "broke"\ntwice' and a.brand_text == "try this"
    assert [t.tweet_id for t in a.turns] == ["1", "2", "3", "4", "9"] and a.turn_count == 5
    assert [t.role for t in a.turns] == ["customer", "agent", "customer", "agent", "customer"]
    assert b.brand_text == "first" and b.turn_count == 2
    assert threads.rebuild(tweets, "Brand", limit=1).count() == 1
    times = threads.date_range(tweets).first()
    assert times.first_text.startswith("Fri") and times.first_time < times.last_time and times.last_time.day == 1


def test_order_over_files(spark, tmp_path):
    """Spark reads large files first; positions go by the names of the files, without gaps."""
    head = CSV.splitlines()[0]
    (tmp_path / "a.csv").write_text(head + "\n1,100,True,,first,,\n")
    (tmp_path / "b.csv").write_text(head + "\n" + "".join(f"{i},100,True,,{'long ' * 50},,\n" for i in range(2, 40)))
    rows = {r.tweet_id: r.file_pos for r in files.read_tweets(spark, str(tmp_path / "*.csv")).collect()}
    assert rows == {str(i): i - 1 for i in range(1, 40)}
    (tmp_path / "a.txt").write_text("x\n\n  y \n")
    (tmp_path / "b.txt").write_text("z\n" * 5000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = files.read_lines(spark, str(tmp_path / "*.txt")).orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.pos for r in lines] == list(range(5002)) and [r.thread_id for r in lines[:3]] == ["x", "y", "z"]


def test_matched_predictions(spark):
    gold = spark.createDataFrame([(0, "a"), (1, "b")], "pos long, thread_id string")
    said = lambda rows: spark.createDataFrame([(i, k, f"p{i}") for i, k in enumerate(rows)], "pos long, thread_id string, predicted string")
    got = lambda rows: {r.thread_id: r.predicted for r in files.matched(gold, said(rows)).collect()}
    assert got(["b", "a"]) == {"b": "p0", "a": "p1"} and got(["x", None]) == {"a": "p0", "b": "p1"}
    assert got(["b"]) == {"b": "p0"} and got(["b", "b", "b"]) == {"b": "p2"} and files.matched(gold, said(["x", "y", "z"])).count() == 0
    with pytest.raises(ValueError, match="no cached prediction"):
        got(["a", "x"])
    assert {r.predicted for r in files.matched(gold, said(["x", "y"]).drop("thread_id")).collect()} == {"p0", "p1"}


def test_response_ids(tweets):
    assert sorted(tuple(r) for r in threads.response_ids(tweets).collect()) == [("1", "2"), ("2", "3"), ("2", "9"), ("3", "4"), ("5", "6")]


def test_round_robin(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 2, 2, 3, 5]), rng.choice("abc")) for i in range(900)]
    frame = sampling.regions(spark.createDataFrame(rows, "pos long, turn_count int, bucket string"), "pos")
    sizes = {r.region: r["count"] for r in frame.groupBy("region").count().collect()}
    assert sizes == {"start": 300, "middle": 300, "end": 300}
    sample = sampling.round_robin(frame, F.xxhash64(F.lit(1), "pos"), F.ascii("bucket")).collect()
    got = Counter((r.region, r.turn_type) for r in sample)
    assert got == {(k, t): n for k, (a, b) in lx.REGION_TARGETS.items() for t, n in (("2_turn", a), ("multi_turn", b))}
    by = Counter((r.region, r.turn_type, r.bucket) for r in sample)
    for (region, kind), n in got.items():
        parts = [by[region, kind, b] for b in "abc"]
        assert max(parts) - min(parts) <= 1 and sum(parts) == n


def test_sets(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,), ("",)], "thread_id string")
    b = spark.createDataFrame([("y",), ("z",)], "thread_id string")
    assert [r[0] for r in sampling.corpus_minus_holdout(a, b).collect()] == ["x"]
    assert sampling.corpus_minus_holdout(a, b, keep_null_ids=True).count() == 3
    assert sampling.leaked(a, b).count() == 1
    assert {tuple(r) for r in sampling.symmetric_difference(a.where("thread_id <> ''"), b).collect()} == {("x", "left"), ("z", "right")}
    assert sampling.shuffled(a, "thread_id", 1).count() == 4


def brute(queries, docs, k, scheme):
    """Scores as plain dictionaries."""
    split = lambda t: re.findall("[a-zA-Z0-9]+", t.lower())
    tokens = [split(t) for t in docs]
    n, mean = len(docs), sum(map(len, tokens)) / len(docs)
    df = Counter(w for t in tokens for w in set(t))
    idf = {w: math.log((n + 1) / (c + 1)) + 1 if scheme == "tfidf" else math.log((n - c + 0.5) / (c + 0.5) + 1) for w, c in df.items()}
    weights = []
    for t in tokens:
        tf = Counter(t)
        weights.append({w: (c if scheme == "tfidf" else c * 2.5 / (c + 1.5 * (0.25 + 0.75 * len(t) / mean))) * idf[w] for w, c in tf.items()})
    out = {}
    for q, text in enumerate(queries):
        asked = {w: c * idf[w] for w, c in Counter(split(text)).items() if w in idf}
        order = list(dict.fromkeys(split(text)))
        found = []
        for i, w in enumerate(weights):
            hit = [x for x in asked if x in w]
            if hit:
                score = sum(asked[x] * w[x] for x in hit) / math.sqrt(sum(v * v for v in w.values())) / math.sqrt(sum(v * v for v in asked.values()))
                found.append((-round(score, 10), min(order.index(x) for x in hit), i, score))
        out[q] = [(i, round(s, 8)) for _, _, i, s in sorted(found)[:k]] or [(0, 0.0)]
    return out


@pytest.mark.parametrize("scheme", ["bm25", "tfidf"])
def test_search(spark, scheme):
    rng = random.Random(4)
    make = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice(["", "", "é"]) for _ in range(n))
    docs = [make(rng.randint(0, 12)) for _ in range(40)] + ["a b", "a b", "b a"]
    queries = [make(5) for _ in range(15)] + ["", "zzz", "a b", "b a"]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, text string")
    corpus = spark.createDataFrame([(i, i, t) for i, t in enumerate(docs)], "doc_id int, pos int, text string")
    found: dict = {}
    for r in search.search(asked, corpus, 3, scheme).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 8)))
    assert found == brute(queries, docs, 3, scheme)
    assert search.search(asked, corpus.limit(0), 3, scheme).count() == 0
    assert "Example 1" in search.context(
        spark.createDataFrame([(1, 1, "c", "b")], "query_id int, rank int, customer_text string, brand_text string")
    ).first().context


def test_agents(spark):
    corpus = spark.createDataFrame(
        [("d1", 0, "wifi drops at home", "@123 Reset the router."), ("d2", 1, "battery is low", "We've received your DM")],
        "thread_id string, pos int, customer_text string, brand_text string",
    )
    asked = spark.createDataFrame([("q1", "wifi drops at home"), ("q2", "the battery is low"), ("q3", "zzz")], "thread_id string, customer_text string")
    rows = {r.thread_id: r for r in agents.full(asked, corpus).collect()}
    assert rows["q1"].predicted_reply == "Reset the router." and not rows["q1"].predicted_escalate and rows["q1"].candidates[0].score == 1.0
    assert rows["q2"].predicted_reason == "channel_transition" and rows["q2"].predicted_reply == lx.ESCALATE_REPLY
    assert rows["q3"].retrieved_thread_id == "d1" and rows["q3"].retrieval_score == 0
    plain = {r.thread_id: r for r in agents.simple(asked, corpus).collect()}
    assert plain["q1"].predicted_reply == "@123 Reset the router." and not plain["q2"].predicted_escalate
    empty = agents.simple(asked, corpus.limit(0)).first()
    assert empty.predicted_reply == lx.CANNED_REPLY and empty.retrieved_thread_id is None
    assert agents.full(asked, corpus.limit(0)).where("predicted_intent is null").count() == 0


def test_errors(spark):
    rows = [
        (0, "hola amigo", "other", "other", True, False, None, 0.5),
        (1, "it freezes after that", "software_update_glitch", "other", False, False, None, 0.5),
        (2, "plain words here", "other", "other", True, False, "channel_transition", 0.5),
        (3, "plain words here", "apps_feature_howto", "other", False, False, None, 0.5),
        (4, "plain words here", "other", "other", False, False, None, 0.1),
        (5, "plain words here", "other", "other", False, True, None, 0.5),
        (6, "plain words here", "other", "other", False, False, None, 0.5),
    ]
    scored = spark.createDataFrame(
        rows,
        "pos int, customer_text string, gold_intent string, predicted_intent string, gold_escalate boolean, predicted_escalate boolean, gold_reason string, rouge_1 double",
    )
    found = {r.pos: r for r in errors.records(scored).collect()}
    assert {k: r.failure_mode.split("_")[1] for k, r in found.items()} == {0: "5", 1: "1", 2: "2", 3: "3", 4: "4", 5: "4"}
    assert found[5].escalate_error_type == "false_positive" and all(r.root_cause for r in found.values())
    whole = errors.roll_up(scored).first()
    assert (whole.total, whole.errors, whole.intent_errors, whole.escalation_errors) == (7, 6, 2, 3)
    assert errors.top_pairs(scored, "pos").first().gold_intent == "software_update_glitch"
    assert errors.samples(scored, "pos", 1).count() == 5 and errors.roll_up(scored.limit(0)).first().errors_share == 0


def gold_rows(**change):
    row = {
        "pos": 0, "thread_id": "a", "customer_tweet_id": "1", "customer_text": "c", "brand_text": "b", "intent": "other", "escalate": False,
        "escalate_reason": None, "notes": "n",
    }
    return [{**row, **change}, {**row, "pos": 1, "thread_id": "b", "escalate": True, "escalate_reason": "channel_transition"}]


GOLD = "pos long, thread_id string, customer_tweet_id string, customer_text string, brand_text string, intent string, escalate boolean, escalate_reason string, notes string"
CORRUPT = [
    ({"thread_id": "b"}, "duplicate_id"),
    ({"thread_id": ""}, "missing_id"),
    ({"intent": None}, "missing_intent"),
    ({"intent": "bogus"}, "invalid_intent"),
    ({"escalate": None}, "escalate_not_boolean"),
    ({"escalate": True}, "reason_required"),
    ({"escalate": True, "escalate_reason": "odd"}, "invalid_reason"),
    ({"escalate_reason": "channel_transition"}, "reason_forbidden"),
    ({"brand_text": None}, "missing_brand_text"),
]


@pytest.mark.parametrize("change,rule", CORRUPT)
def test_violations(spark, change, rule):
    frame = spark.createDataFrame(gold_rows(**change), GOLD)
    assert rule in {r.rule for r in errors.violations(frame, None, 2).collect()}
    with pytest.raises(errors.ValidationError, match=rule):
        errors.require_valid(frame)


def test_valid(spark):
    frame = spark.createDataFrame(gold_rows(), GOLD)
    order = spark.createDataFrame([(0, "a"), (1, "b")], "pos long, thread_id string")
    assert errors.violations(frame, order, 2).count() == 0 and errors.require_valid(frame, order, 2).first().records == 2
    assert {r.rule for r in errors.violations(frame, order, 3).collect()} == {"record_count", "holdout_count"}
    swapped = order.withColumn("pos", 1 - F.col("pos"))
    assert errors.violations(frame, swapped, 2).where("rule = 'holdout_order'").count() == 2
    source = frame.withColumn("brand_text", F.when(F.col("pos") == 0, "changed").otherwise(F.col("brand_text"))).where("pos = 0")
    assert {r.rule for r in errors.audit(frame, source, frame).collect()} >= {"brand_text_differs", "not_in_source", "labelled_intent", "labelled_notes"}


def test_files(spark, tmp_path):
    (tmp_path / "ids.txt").write_text(" a \n\n b\n")
    assert [r.thread_id for r in files.read_lines(spark, str(tmp_path / "ids.txt")).orderBy("pos").collect()] == ["a", "b"]
    rows = [{"thread_id": "a", "predicted_intent": "other", "predicted_reply": "é"}, {"thread_id": "b", "predicted_intent": "", "predicted_reply": "x"}]
    (tmp_path / "list.json").write_text(json.dumps(rows))
    (tmp_path / "doc.json").write_text(json.dumps({"predictions": rows}))
    for name in ("list.json", "doc.json"):
        assert {r.thread_id for r in files.read_predictions(spark, str(tmp_path / name)).collect()} == {"a", "b"}
    (tmp_path / "gold.jsonl").write_text('{"thread_id": "a", "escalate": true}\n\n{"thread_id": "b"}\n')
    assert files.read_jsonl(spark, str(tmp_path / "gold.jsonl"), files.GOLD).where("thread_id is not null").count() == 2
    files.write_jsonl(files.read_jsonl(spark, str(tmp_path / "gold.jsonl"), files.GOLD), str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out"), files.GOLD, strict=True).count() == 2
    done = files.read_predictions(spark, str(tmp_path / "list.json")).withColumn("pos", F.monotonically_increasing_id())
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "thread_id string")
    assert {r.thread_id for r in files.pending(asked, done).collect()} == {"b", "c"}
    assert {r.thread_id: r.predicted_reply for r in files.replay(asked, done).collect()} == {"a": "é", "b": "x", "c": None}
    nested = spark.createDataFrame([("a", [1])], "thread_id string, turns array<int>")
    files.write_flat_csv(nested, str(tmp_path / "flat"))
    assert spark.read.option("header", True).csv(str(tmp_path / "flat")).columns == ["thread_id"]


def test_provider(spark):
    waits, calls = [], []

    def limited(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise RuntimeError("429 slow down")
        return "ok"

    assert provider.ask("p", [limited], sleep=waits.append) == "ok" and waits == [5, 10]
    with pytest.raises(ValueError):
        provider.ask("p", [lambda p: (_ for _ in ()).throw(ValueError("bad"))], sleep=waits.append)
    assert provider.ask("p", [lambda p: 1 / 0, lambda p: "second"]) == "second"
    rows = spark.createDataFrame([(1, "q"), (2, None)], "i int, prompt string")
    assert {r.i: r.answer for r in provider.answers(rows, "prompt").collect()} == {1: None, 2: None}
    assert {r.i: r.answer for r in provider.answers(rows, "prompt", lambda: [lambda p: p + "!"]).collect()} == {1: "q!", 2: None}


def test_assisted(spark):
    asked = spark.createDataFrame([("q1", "my battery drains")], "thread_id string, customer_text string")
    says = lambda answer: lambda: [lambda prompt: answer]
    assert assisted.classify(asked).first().predicted_intent == "battery_power_issue"
    assert assisted.classify(asked, says('{"intent": "other"}')).first().predicted_intent == "other"
    assert assisted.classify(asked, says("no idea")).first().predicted_intent == "battery_power_issue"
    decided = spark.createDataFrame(
        [("c", "other", None, "@1 past")], "customer_text string, predicted_intent string, predicted_reason string, top_reply string",
    )
    assert assisted.draft(decided).first().predicted_reply == "past"
    assert assisted.draft(decided, says('"@you  hello"')).first().predicted_reply == "hello"
    assert assisted.draft(decided, says('""')).first().predicted_reply == "past"
    reply = spark.createDataFrame([("c", "restart it", False)], "customer_text string, reply string, escalate boolean")
    plain, rated, broken = (assisted.rate(reply, p, 0).first() for p in (None, says('{"tone": 2, "overall_quality": 9, "safety_guardrail": false}'), says("{")))
    assert (plain.judged_by, rated.judged_by, broken.judged_by) == ("rules", "model", "rules")
    assert (rated.tone, rated.overall, rated.safe, rated.relevance) == (2, 5, False, 4) and broken.tone == plain.tone


def test_resolve(tmp_path):
    (tmp_path / "x.json").write_text("[]")
    assert files.resolve("gone/x.json", ["nowhere", str(tmp_path)]) == str(tmp_path / "x.json")
    with pytest.raises(FileNotFoundError):
        files.resolve("y.json", [str(tmp_path)])


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    texts = spark.createDataFrame(
        [("2024-01-01 00:00:00", "my lawyer"), ("2024-01-01 00:03:00", "charged twice"), ("2024-01-01 01:00:00", "fine")],
        "ts string, text string",
    ).withColumn("ts", F.to_timestamp("ts"))
    texts.write.parquet(source)
    stream = spark.readStream.schema(texts.schema).parquet(source)
    for _ in range(2):  # the second run has nothing left to do
        run = triage.run(stream, str(tmp_path / "out"), str(tmp_path / "check"))
        run.awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out")).where("escalate").count() == 2
    counted = triage.reasons_by_time(texts).where("reason is not null")
    assert counted.count() == 2
    live = triage.reasons_by_time(stream).writeStream.outputMode("complete").format("memory").queryName(f"r{int(time.time())}").start()
    live.processAllAvailable()
    assert spark.table(live.name).count() == 3
    live.stop()


def rebuilt(rows, brand):
    """The same by dictionaries, in the order of the messages."""
    own = [r for r in rows if r["author_id"] == brand]
    brand_ids = {r["tweet_id"] for r in own}
    referred = {r["in_response_to_tweet_id"] for r in own} | {x.strip() for r in own for x in (r["response_tweet_id"] or "").split(",")}
    answer: dict = {}
    for r in own:
        answer.setdefault(r["in_response_to_tweet_id"], r)
    customers = [r for r in rows if r["author_id"] != brand and r["tweet_id"] in referred]
    out = []
    for r in customers:
        if r["tweet_id"] not in answer or r["in_response_to_tweet_id"] in brand_ids:
            continue
        main = answer[r["tweet_id"]]
        turns = [r["tweet_id"], main["tweet_id"]]
        for c in customers:
            if c["in_response_to_tweet_id"] == main["tweet_id"]:
                turns += [c["tweet_id"]] + ([answer[c["tweet_id"]]["tweet_id"]] if c["tweet_id"] in answer else [])
        out.append(turns)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_rebuild_of_any_messages(spark, seed):
    """Random references, also to messages that aren't there, to oneself and in circles; a third of all have one parent."""
    rng = random.Random(seed)
    ids = [str(i) for i in range(120)]
    pick = lambda: rng.choice([None, "7", "8", rng.choice(ids), rng.choice(ids), "lost"])
    rows = [
        {
            "tweet_id": x, "author_id": rng.choice(["Brand", "Brand", "a", "b", None]), "inbound": None, "created_at": "t", "text": f"text {x}",
            "response_tweet_id": rng.choice([None, "", f"{pick()}, ,{pick()}"]), "in_response_to_tweet_id": pick(), "file_pos": i,
        } for i, x in enumerate(rng.sample(ids, len(ids)))
    ]
    for r in rows:
        r["author_id"] = r["author_id"] or "c"
    schema = ", ".join(f"{c} {'long' if c == 'file_pos' else 'string'}" for c in rows[0])
    table = spark.createDataFrame(rows, schema).repartition(3)
    made = threads.rebuild(table, "Brand").orderBy("thread_id").collect()
    want = rebuilt(rows, "Brand")
    assert [[t.tweet_id for t in r.turns] for r in made] == want
    assert [r.thread_id for r in made] == [f"thread_{i + 1:05d}" for i in range(len(want))]
    assert [r.customer_tweet_id for r in threads.rebuild(table, "Brand", 5).orderBy("thread_id").collect()] == [t[0] for t in want[:5]]


def test_linking_reads_messages_once(spark, tmp_path):
    rows = spark.createDataFrame([], "tweet_id string, author_id string, inbound boolean, created_at string, text string, response_tweet_id string, in_response_to_tweet_id string, file_pos long")
    rows.write.parquet(str(tmp_path / "m"))
    plan = threads.linked(spark.read.parquet(str(tmp_path / "m")), "Brand")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange ") <= 3
