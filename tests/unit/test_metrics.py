"""Hand-computed metrics and published statistics."""

import random

import pytest
from pyspark.sql import functions as F

from parley.operators import agents, metrics, windows

# Two raters' scores of 25 replies, a digit each.
HUMAN = {
    "overall": "5555554444543255115524455", "relevance": "5555555444543355215524555", "tone": "5555544444543244214514454",
    "actionability": "5555454444543255115424455",
}
MODEL = {
    "overall": "5455454525455345115425555", "relevance": "4454443425554355214434454", "tone": "5555555545455345225525555",
    "actionability": "5555554525555355115445555",
}
# The statistics published for them, in the order Pearson, Spearman, kappa, exact, within one, mean error.
PUBLISHED = {
    "overall": (0.7645, 0.431, 0.764, 0.48, 0.92, 0.6), "relevance": (0.7035, 0.507, 0.6637, 0.4, 0.92, 0.68),
    "tone": (0.8411, 0.5598, 0.7378, 0.4, 0.96, 0.64), "actionability": (0.792, 0.6962, 0.7595, 0.6, 0.88, 0.52),
}


def test_published_agreement(spark):
    rows = [(d, int(t), int(p)) for d in HUMAN for t, p in zip(HUMAN[d], MODEL[d])]
    found = metrics.agreement(spark.createDataFrame(rows, "dimension string, t int, p int"), ["dimension"]).collect()
    for r in found:
        assert r.n == 25 and tuple(round(x, 4) for x in (r.pearson, r.spearman, r.kappa, r.exact, r.within_one, r.mae)) == PUBLISHED[r.dimension]
    assert len(found) == 4


def one(spark, pairs, by=None):
    rows = spark.createDataFrame([("g", t, p) for t, p in pairs], "g string, t int, p int")
    return metrics.agreement(rows, ["g"]).first()


def test_degenerate_agreement(spark):
    assert one(spark, [(i, i) for i in range(1, 6)]).pearson == 1 and one(spark, [(i, 6 - i) for i in range(1, 6)]).spearman == -1
    same = one(spark, [(3, 3)] * 4)
    assert (same.pearson, same.spearman, same.kappa, same.exact) == (0, 0, 1, 1)
    assert one(spark, [(2, 3)]).kappa == 0 and one(spark, [(9, 0)]).mae == 9
    r = one(spark, list(zip([1, 2, 3, 4, 5] * 2, [1, 2, 3, 4, 4, 1, 2, 3, 4, 5])))
    assert round(r.kappa, 6) == 0.972973
    assert one(spark, [(1, 1), (2, 2), (3, 4), (4, 5)]).exact == 0.5 and one(spark, [(1, 3), (2, 2), (3, 3), (4, 4)]).within_one == 0.75
    assert one(spark, [(1, 2), (2, 2), (3, 4), (5, 3)]).mae == 1


def test_constant_ratings_in_many_parts(spark):
    """Of so many rows a part, the mean of equal values isn't that value once parts are merged."""
    for n in (47, 94, 173):
        rows = spark.range(0, 4 * n, 1, 4).selectExpr("'g' as g", "3 as t", "3 as p", "id % 5 as v")
        assert metrics.pearson(rows, ["g"]).first().pearson == metrics.pearson(rows, ["g"], "t", "v").first().pearson == metrics.pearson(rows, ["g"], "v", "p").first().pearson == 0
        assert metrics.pearson(rows, ["g"], "v", "v").first().pearson == pytest.approx(1)


def test_average_rank(spark):
    rows = spark.createDataFrame([("a", x) for x in (10, 20, 20, 30)], "g string, v int")
    assert sorted(r.k for r in metrics.average_rank(rows, ["g"], "v", "k").collect()) == [1, 2.5, 2.5, 4]


def test_multiclass(spark):
    rows = spark.createDataFrame(list(zip("AABBCC", "ABBBCA")), "actual string, predicted string")
    cells = {(r.actual, r.predicted): r.n for r in metrics.confusion(rows, list("ABC")).collect()}
    assert [[cells[a, b] for b in "ABC"] for a in "ABC"] == [[1, 1, 0], [0, 2, 0], [1, 0, 1]]
    f1 = {r.label: round(r.f1, 4) for r in metrics.per_class(rows, list("ABC")).collect()}
    assert f1 == {"A": 0.5, "B": 0.8, "C": 0.6667}
    r = metrics.multiclass(rows, list("ABC")).first()
    assert (round(r.accuracy, 4), round(r.macro_f1, 4)) == (0.6667, 0.6556)
    assert [x.label for x in metrics.label_set(rows).collect()] == ["A", "B", "C"]
    odd = rows.union(spark.createDataFrame([("A", "Z"), (None, "A")], rows.schema))
    assert metrics.confusion(odd, list("ABC")).agg(F.sum("n")).first()[0] == 6
    none = metrics.multiclass(rows.limit(0), list("ABC")).first()
    assert (none.accuracy, none.macro_f1, none.weighted_f1) == (0, 0, 0)


def test_binary(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "actual boolean, predicted boolean")
    r = metrics.binary(rows).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (1, 1, 1, 1) and (r.accuracy, r.precision, r.recall, r.f1) == (0.5,) * 4
    more = metrics.binary(rows.union(spark.createDataFrame([(None, True)], rows.schema))).first()
    assert more.total == 5 and more.accuracy == 0.4
    assert metrics.binary(rows.limit(0)).first().f1 == 0
    low, high = metrics.binary(rows).select(metrics.wilson(F.col("tp") + F.col("tn"), F.col("total")).alias("ci")).first().ci
    assert round(low, 4) == 0.15 and round(high, 4) == 0.85


def test_majority(spark):
    rows = spark.createDataFrame([(0, "h"), (1, "b"), (2, "b"), (3, "h"), (4, None)], "pos int, v string")
    assert metrics.majority(rows, "v", "pos").first().v == "h"
    gold = spark.createDataFrame(
        [(0, "b", True, "hw"), (1, "b", True, "hw"), (2, "h", False, None)],
        "pos int, intent string, escalate boolean, escalate_reason string",
    )
    r = agents.trivial(spark.createDataFrame([("t",)], "thread_id string"), gold).first()
    assert (r.predicted_intent, r.predicted_escalate, r.predicted_reason) == ("b", True, "hw")


def test_lexical(spark):
    pair = spark.createDataFrame(
        [(1, "we are here to help please dm us", "we want to help send us a dm"), (2, "", "x"), (3, "a", "a"), (4, None, None)],
        "id int, reference string, hypothesis string",
    )
    one_, two, longest = ({r.id: r for r in made.collect()} for made in (metrics.rouge_n(pair, 1), metrics.rouge_n(pair, 2), metrics.rouge_l(pair)))
    assert one_[1].f1 == 5 / 8 and two[1].f1 == pytest.approx(1 / 7) and longest[1].lcs == 4 and longest[1].f1 == 0.5
    assert one_[2].f1 == two[3].f1 == longest[4].f1 == 0 and one_[3].f1 == 1
    bleu = {r.id: r.bleu for r in metrics.bleu_1(pair).collect()}
    assert bleu[1] == 5 / 8 and bleu[2] == 0 and bleu[3] == 1
    means = metrics.reply_metrics(pair.where("id in (1, 3)")).first()
    assert means.rouge_1 == pytest.approx((5 / 8 + 1) / 2) and means.pairs == 2
    assert metrics.reply_metrics(pair.limit(0)).count() == 0


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            left, row[j + 1] = row[j + 1], left + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_lcs_is_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice("abcd") for _ in range(rng.randint(0, 90))], [rng.choice("abcde") for _ in range(rng.randint(0, 90))]) for i in range(150)]
    frame = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    assert {r.i: r.n for r in frame.select("i", metrics.lcs("a", "b").alias("n")).collect()} == {i: plain_lcs(a, b) for i, a, b in rows}


def test_running(spark):
    rng = random.Random(2)
    keys = rng.sample(range(10**9), 500)
    rows = [(k, rng.random() < 0.5) for k in keys]
    frame = spark.createDataFrame(rows, "k long, hit boolean").repartition(5)
    hits, want = 0, {}
    for n, (k, hit) in enumerate(sorted(rows)):
        hits += hit
        want[k] = (n, hits / (n + 1))
    share = {r.k: r.share for r in windows.running_share(frame, "k", "hit").collect()}
    place = {r.k: r.pos for r in windows.position(frame, "k").collect()}
    assert {k: (place[k], share[k]) for k in keys} == want


def exchanges(rows):
    return rows._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_overlap_of_multisets(spark):
    """Against counters, with repeated tokens, empty and null texts; nothing is shuffled, and a pair is read once."""
    from collections import Counter

    rng = random.Random(6)
    make = lambda: " ".join(rng.choice(["a", "b", "B", "é", "x_1"]) for _ in range(rng.randint(0, 12)))
    texts = [(make(), make()) for _ in range(60)] + [(None, "a"), ("a", None), ("", ""), ("a " * 3000, "a b " * 2000)]
    pairs = spark.createDataFrame([(i, *x) for i, x in enumerate(texts)], "id int, reference string, hypothesis string")
    for n in (1, 2, 3):
        found = metrics.rouge_n(pairs, n)
        assert exchanges(found) == 0
        for r in found.collect():
            split = [(x or "").lower().split() for x in texts[r.id]]
            a, b = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in split)
            o, na, nb = sum((a & b).values()), sum(a.values()), sum(b.values())
            assert (r.precision, r.recall) == (o / nb if nb else 0, o / na if na else 0)
    assert exchanges(metrics.bleu_1(pairs)) == exchanges(metrics.reply_scores(pairs)) == 0
    assert exchanges(metrics.reply_metrics(pairs)) == 1


def test_ranks_of_many_values(spark):
    """A continuous value in one group, ties, a skewed range and nulls, against pandas."""
    import pandas as pd

    rng = random.Random(7)
    rows = [("a", rng.random(), rng.choice([1.0, 2.0, 3.0])) for _ in range(3000)] + [("b", rng.lognormvariate(0, 3), rng.lognormvariate(0, 3)) for _ in range(500)]
    rows += [("c", 1.0, 2.0)] * 3 + [("d", 1.0, 5.0), ("d", 2.0, 4.0), ("e", -1e300, 1.0), ("e", 1e300, 2.0), ("f", 7.0, 7.0)]
    table = spark.createDataFrame(rows + [("a", None, 1.0), ("g", None, None)], "g string, t double, p double").repartition(3)
    frame = pd.DataFrame(rows, columns=["g", "t", "p"])
    want = sorted(zip(frame.g, frame.groupby("g").t.rank(), frame.t))
    assert sorted((r.g, r.k, r.t) for r in metrics.average_rank(table, ["g"], "t", "k").collect()) == want
    found = {r.g: r.spearman for r in metrics.spearman(table, ["g"]).collect()}
    for name, part in frame.groupby("g"):
        r = part.t.rank().corr(part.p.rank()) if len(part) > 1 else 0.0
        assert found[name] == pytest.approx(0.0 if r != r else r, abs=1e-12)
