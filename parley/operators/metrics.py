"""Classification and reply metrics, agreement statistics. Results are long tables of raw doubles."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import text as tx


def ratio(x: Column, y: Column) -> Column:
    """x / y, and 0 where y is 0 or nothing is there."""
    return F.coalesce(x.cast("double") / F.nullif(y.cast("double"), F.lit(0.0)), F.lit(0.0))


def _grid(spark, labels: list[str]) -> DataFrame:
    one = spark.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("actual"))
    return one.select("actual", F.explode(F.array(*map(F.lit, labels))).alias("predicted"))


def confusion(rows: DataFrame, labels: list[str]) -> DataFrame:
    """actual, predicted, n for every pair of labels; rows with another label are left out."""
    counted = rows.where(F.col("actual").isin(labels) & F.col("predicted").isin(labels)).groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return _grid(rows.sparkSession, labels).join(F.broadcast(counted), ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"),
    )


def per_class(rows: DataFrame, labels: list[str]) -> DataFrame:
    """label, precision, recall, f1, support; nothing divided by nothing is 0."""
    cells = confusion(rows, labels)
    both = cells.select(F.col("actual").alias("label"), "n", F.lit(0).alias("said"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("right")).unionByName(
        cells.select(F.col("predicted").alias("label"), F.lit(0).alias("n"), F.col("n").alias("said"), F.lit(0).alias("right"))
    )
    sums = both.groupBy("label").agg(F.sum("right").alias("_r"), F.sum("said").alias("_p"), F.sum("n").alias("support"))
    p, r = ratio(F.col("_r"), F.col("_p")), ratio(F.col("_r"), F.col("support"))
    return sums.select("label", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support")


def multiclass(rows: DataFrame, labels: list[str]) -> DataFrame:
    """accuracy over all rows, macro_f1 over all labels, weighted_f1 of f1 rounded to four digits."""
    score = per_class(rows, labels).agg(F.avg("f1").alias("macro_f1"), ratio(F.sum(F.round("f1", 4) * F.col("support")), F.sum("support")).alias("weighted_f1"))
    return rows.agg(F.coalesce(F.avg(F.col("actual").eqNullSafe(F.col("predicted")).cast("double")), F.lit(0.0)).alias("accuracy")).join(F.broadcast(score))


def label_set(rows: DataFrame) -> DataFrame:
    """The labels that occur, sorted."""
    return rows.select(F.col("actual").alias("label")).union(rows.select("predicted")).where("label is not null").distinct().orderBy("label")


def binary(rows: DataFrame) -> DataFrame:
    """tp, fp, tn, fn, accuracy, precision, recall, f1 of the booleans actual and predicted; nulls are in no cell."""
    a, p = F.col("actual"), F.col("predicted")
    cells = rows.agg(
        F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(~a & ~p).alias("tn"), F.count_if(a & ~p).alias("fn"),
        F.count(F.lit(1)).alias("total"),
    )
    c = {k: F.col(k) for k in ("tp", "fp", "tn", "fn", "total")}
    precision, recall = ratio(c["tp"], c["tp"] + c["fp"]), ratio(c["tp"], c["tp"] + c["fn"])
    return cells.select(
        "tp", "fp", "tn", "fn", "total", ratio(c["tp"] + c["tn"], c["total"]).alias("accuracy"), precision.alias("precision"),
        recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"),
    )


def wilson(successes: Column, n: Column, z: float = 1.96) -> Column:
    """(low, high) of the Wilson interval; 0 and 0 for nothing."""
    p, n = ratio(successes, n), n.cast("double")
    centre = ratio(p + z * z / (2 * F.nullif(n, F.lit(0.0))), 1 + z * z / F.nullif(n, F.lit(0.0)))
    reach = ratio(z * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0.0)) + z * z / (4 * F.nullif(n * n, F.lit(0.0)))), 1 + z * z / F.nullif(n, F.lit(0.0)))
    return F.struct(F.greatest(centre - reach, F.lit(0.0)).alias("low"), F.least(centre + reach, F.lit(1.0)).alias("high"))


def majority(rows: DataFrame, column: str, position: str) -> DataFrame:
    """The most frequent value; of equals the one that comes first."""
    counted = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"), F.min(position).alias("_first"))
    return counted.agg(F.max_by(F.col(column), F.struct(F.col("_n"), -F.col("_first"))).alias(column))


# Reply metrics.


def grams(tokens: Column, n: int) -> Column:
    """The n-grams of a token array, joined by a separator that no token has."""
    if n == 1:
        return tokens

    def windows_of(t: Column) -> Column:
        size = F.size(t)
        return F.when(
            size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(t, i, n), "\u0001")),
        ).otherwise(F.array().cast("array<string>"))

    return tx.let(tokens, windows_of)


def overlap(left: Column, right: Column) -> Column:
    """The size of the multiset intersection of two arrays of strings: both are sorted as one, and each run of equal ones adds the smaller of its two counts."""
    side = lambda values, own: F.transform(values, lambda g: F.struct(g.alias("g"), F.lit(own).alias("own")))
    state = lambda g, a, b, n: F.struct(g.alias("g"), a.alias("a"), b.alias("b"), n.alias("n"))
    none = F.lit(0)

    def step(acc: Column, x: Column) -> Column:
        same = acc["g"].eqNullSafe(x["g"])
        before = lambda c: F.when(same, acc[c]).otherwise(none)
        done = F.when(same, none).otherwise(F.least(acc["a"], acc["b"]))
        return state(x["g"], before("a") + x["own"], before("b") + 1 - x["own"], acc["n"] + done)

    both = F.array_sort(F.concat(side(left, 1), side(right, 0)))
    return F.aggregate(both, state(F.lit(None).cast("string"), none, none, none), step, lambda acc: acc["n"] + F.least(acc["a"], acc["b"]))


def _clipped(reference: Column, hypothesis: Column, n: int) -> Column:
    """o, r, h: the overlap of the n-grams of two token arrays, and how many there are."""
    sizes = lambda r, h: F.struct(overlap(r, h).alias("o"), F.size(r).alias("r"), F.size(h).alias("h"))
    return tx.let(F.struct(grams(reference, n).alias("r"), grams(hypothesis, n).alias("h")), lambda x: sizes(x["r"], x["h"]))


def _prf(o: Column, r: Column, h: Column) -> tuple[Column, Column, Column]:
    p, r = ratio(o, h), ratio(o, r)
    return p, r, ratio(2 * p * r, p + r)


def _bleu(c: Column) -> Column:
    """From the counts of unigrams."""
    penalty = F.when(c["h"] > c["r"], 1.0).otherwise(F.exp(1 - ratio(c["r"], c["h"])))
    return F.when((c["h"] == 0) | (c["r"] == 0), 0.0).otherwise(penalty * ratio(c["o"], c["h"]))


def _tokenised(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    return pairs.withColumns({"_r": tx.word_tokens(F.col(reference)), "_h": tx.word_tokens(F.col(hypothesis))})


def rouge_n(pairs: DataFrame, n: int, key: str = "id", reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """key, precision, recall, f1 of the clipped n-gram overlap; 0 where either has no n-gram. All within the row."""
    counted = _tokenised(pairs, reference, hypothesis).select(key, _clipped(F.col("_r"), F.col("_h"), n).alias("_c"))
    p, r, f1 = _prf(F.col("_c.o"), F.col("_c.r"), F.col("_c.h"))
    return counted.select(key, p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def bleu_1(pairs: DataFrame, key: str = "id", reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """key, bleu: clipped unigram precision with the brevity penalty."""
    counted = _tokenised(pairs, reference, hypothesis).select(key, _clipped(F.col("_r"), F.col("_h"), 1).alias("_c"))
    return counted.select(key, _bleu(F.col("_c")).alias("bleu"))


@F.pandas_udf(T.IntegerType())
def lcs(left: pd.Series, right: pd.Series) -> pd.Series:
    """The length of the longest common subsequence of two token arrays, by bit-parallel rows."""

    def length(a, b) -> int:
        places: dict = {}
        for i, x in enumerate(a):
            places[x] = places.get(x, 0) | 1 << i
        full = (1 << len(a)) - 1
        row = full
        for x in b:
            match = row & places.get(x, 0)
            row = (row + match | row - match) & full
        return len(a) - row.bit_count()

    return pd.Series([length(a, b) for a, b in zip(left, right)])


def rouge_l(pairs: DataFrame, key: str = "id", reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """key, lcs, precision, recall, f1."""
    made = _tokenised(pairs, reference, hypothesis).select(key, lcs("_r", "_h").alias("lcs"), F.size("_r").alias("_nr"), F.size("_h").alias("_nh"))
    p, r, f1 = _prf(F.col("lcs"), F.col("_nr"), F.col("_nh"))
    return made.select(key, "lcs", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def _scores(pairs: DataFrame, reference: str, hypothesis: str, *carried: str) -> DataFrame:
    """The carried columns, rouge_1, rouge_2, rouge_l (F1 each), bleu, _c and _t (characters and tokens of the hypothesis): one look at each pair."""
    r, h = F.col("_r"), F.col("_h")
    counted = _tokenised(pairs, reference, hypothesis).withColumns({"_one": _clipped(r, h, 1), "_two": _clipped(r, h, 2), "_l": lcs("_r", "_h")})
    f1 = lambda c: _prf(c["o"], c["r"], c["h"])[2]
    return counted.select(
        *carried, f1(F.col("_one")).alias("rouge_1"), f1(F.col("_two")).alias("rouge_2"), _prf(F.col("_l"), F.size(r), F.size(h))[2].alias("rouge_l"),
        _bleu(F.col("_one")).alias("bleu"), F.char_length(hypothesis).alias("_c"), F.size(h).alias("_t"),
    )


def reply_scores(pairs: DataFrame, key: str = "id", reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """key, rouge_1, rouge_l (F1 each) and bleu."""
    return _scores(pairs, reference, hypothesis, key).select(key, "rouge_1", "rouge_l", "bleu")


def reply_metrics(pairs: DataFrame, key: str = "id", reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """One row of means over pairs; no row for no pairs."""
    names = {"rouge_1": "rouge_1", "rouge_2": "rouge_2", "rouge_l": "rouge_l", "bleu": "bleu", "_c": "mean_chars", "_t": "mean_tokens"}
    return _scores(pairs, reference, hypothesis).agg(*(F.avg(k).alias(v) for k, v in names.items()), F.count(F.lit(1)).alias("pairs")).where("pairs > 0")


# Agreement of two raters; rows have `by` columns and the numbers t and p.


def pearson(rows: DataFrame, by: list[str], t: str = "t", p: str = "p", name: str = "pearson") -> DataFrame:
    """0 where a side doesn't vary."""
    return rows.groupBy(*by).agg(_pearson(t, p).alias(name))


def _pearson(t: str, p: str) -> Column:
    # Merged variances of equal values may come out a little above 0, so what varies is asked of the values.
    varies = (F.min(t) < F.max(t)) & (F.min(p) < F.max(p))
    r = F.when(varies, F.covar_pop(t, p) / F.nullif(F.sqrt(F.var_pop(t) * F.var_pop(p)), F.lit(0.0)))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(r, F.lit(0.0))))


#: Ranges of equal width that values are counted in, before the order within each.
RANGES = 1024


def _ranks(counted: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """by, value and the mean of the places from 1 of its rows, from counts `_c` of distinct values.

    Counts of ranges of values are added up first, at most RANGES + 1 for a group, then those within a range: a group of
    many distinct values is spread over as many tasks.
    """
    v = F.col(value).cast("double")
    span = counted.agg(F.min(v).alias("_low"), F.max(v).alias("_high"))  # one row
    place = F.coalesce(F.floor((v - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * RANGES), F.lit(0))
    ranged = counted.join(F.broadcast(span)).withColumn("_range", place).drop("_low", "_high")
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy(*by, "_range").agg(F.sum("_c").alias("_s")).select(*by, "_range", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_before"))
    within = F.sum("_c").over(Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    summed = ranged.withColumn("_upto", within).join(before, [*by, "_range"])
    return summed.select(*by, value, (F.col("_before") + F.col("_upto") - (F.col("_c") - 1) / F.lit(2.0)).alias(name))


def average_rank(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """The rank from 1 by value within a group; ties share the mean of their places. Rows without a value are left out."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    return rows.join(_ranks(counted, by, value, name), [*by, value])


def _pair_counts(rows: DataFrame, by: list[str], t: str, p: str) -> DataFrame:
    """by, t, p, _c: how often each pair of ratings stands in a group; all figures of agreement follow from that."""
    return rows.groupBy(*by, t, p).agg(F.count(F.lit(1)).alias("_c"))


def _spearman(pairs: DataFrame, by: list[str], t: str, p: str) -> DataFrame:
    """The correlation of ranks from counts of pairs. The mean rank is known, so the sums are of what differs from it."""
    whole = pairs.where(F.col(t).isNotNull() & F.col(p).isNotNull())
    ranked = whole
    for value, name in ((t, "_rt"), (p, "_rp")):
        ranked = ranked.join(_ranks(whole.groupBy(*by, value).agg(F.sum("_c").alias("_c")), by, value, name), [*by, value])
    c, x, y = F.col("_c"), F.col("_rt").cast("double"), F.col("_rp").cast("double")
    sums = ranked.groupBy(*by).agg(
        F.sum("_c").alias("_n"), F.sum(c * x * y).alias("_xy"), F.sum(c * x * x).alias("_xx"), F.sum(c * y * y).alias("_yy"),
    )
    square = F.col("_n") * (F.col("_n") + 1.0) * (F.col("_n") + 1.0) / 4
    xy, xx, yy = (F.col(k) - square for k in ("_xy", "_xx", "_yy"))
    # Ranks are halves of whole numbers, so where all are equal nothing is left.
    r = F.when((xx > 0) & (yy > 0), xy / F.sqrt(F.when(xx > 0, xx).otherwise(1.0) * F.when(yy > 0, yy).otherwise(1.0))).otherwise(0.0)
    return sums.select(*by, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("spearman"))


def spearman(rows: DataFrame, by: list[str], t: str = "t", p: str = "p") -> DataFrame:
    return _spearman(_pair_counts(rows, by, t, p), by, t, p)


def kappa(t: Column, p: Column, low: int = 1, high: int = 5, times: Column | None = None) -> Column:
    """Quadratic weighted kappa as an aggregate; ratings are clipped. 0 for no rows, 1 if nothing is expected and seen. times: how often a row counts."""
    t, p = (F.greatest(F.lit(low), F.least(F.lit(high), x)).cast("double") for x in (t, p))
    c = F.lit(1) if times is None else times
    n = F.sum(F.when(t.isNotNull(), c))
    seen = F.sum(c * (t - p) * (t - p))
    expected = F.sum(c * t * t) + F.sum(c * p * p) - 2 * F.sum(c * t) * F.sum(c * p) / F.nullif(n, F.lit(0))
    flat = F.abs(expected) < 1e-12
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).when(flat, F.when(seen == 0, 1.0).otherwise(0.0)).otherwise(
        1 - seen / F.nullif(F.when(flat, 0.0).otherwise(expected), F.lit(0.0))
    )


def agreement(rows: DataFrame, by: list[str]) -> DataFrame:
    """n, pearson, spearman, kappa, exact, within_one, mae of ratings (whole numbers) for each group, all from counts of pairs."""
    pairs = _pair_counts(rows, by, "t", "p")
    t, p, c = F.col("t").cast("double"), F.col("p").cast("double"), F.col("_c")
    d = F.abs(t - p)
    share = lambda x: F.sum(c * x) / F.sum(F.when(x.isNotNull(), c))
    both = F.when(t.isNotNull() & p.isNotNull(), c)
    n, x, y = F.sum(both), F.sum(both * t), F.sum(both * p)
    xx, yy = n * F.sum(both * t * t) - x * x, n * F.sum(both * p * p) - y * y
    r = F.coalesce((n * F.sum(both * t * p) - x * y) / F.nullif(F.sqrt(xx * yy), F.lit(0.0)), F.lit(0.0))
    plain = pairs.groupBy(*by).agg(
        F.sum("_c").alias("n"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("pearson"), kappa(F.col("t"), F.col("p"), times=c).alias("kappa"),
        share((d == 0).cast("double")).alias("exact"), share((d <= 1).cast("double")).alias("within_one"), share(d).alias("mae"),
    )
    return plain.join(_spearman(pairs, by, "t", "p"), by)


def safety_agreement(rows: DataFrame, one: str, other: str) -> DataFrame:
    """One row: the share of rows where both say the same of what either could have said; 0 for none."""
    return rows.agg(F.coalesce(F.avg((F.col(one) == F.col(other)).cast("double")), F.lit(0.0)).alias("agreement"))
