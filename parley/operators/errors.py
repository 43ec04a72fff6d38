"""Error records, their failure modes and roll-ups; validation of labelled sets as violation rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import lexicon as lx
from parley.functions import text as tx
from parley.operators import windows

LEAST_ROUGE = 0.15


def failure_mode(text: Column, gold: Column, said: Column, gold_escalate: Column, said_escalate: Column) -> Column:
    """The first failure mode whose rule fits."""
    low = F.lower(text)
    pair = lambda a, b: ((gold == a) & (said == b)) | ((gold == b) & (said == a))
    media = tx.contains_any(low, lx.MODE_FOREIGN) | (low.contains("http") & (tx.word_count(low) < 8))
    update = pair("software_update_glitch", "performance_crash_freeze") | ((gold == "software_update_glitch") & tx.contains_any(low, lx.MODE_PERFORMANCE))
    howto = pair("apps_feature_howto", "other") | pair("vague_complaint_unclear", "other")
    return F.when(media, lx.MODES["media"]).when(update, lx.MODES["update"]).when(
        gold_escalate & ~said_escalate, lx.MODES["under"],
    ).when(howto, lx.MODES["howto"]).otherwise(lx.MODES["lexical"])


def hypothesis(mode: Column, gold: Column, said: Column, reason: Column) -> Column:
    """A sentence on the likely cause, in our own words."""
    return (
        F.when(mode == lx.MODES["media"], "The text is foreign or leans on a linked picture.")
        .when(mode == lx.MODES["update"], F.concat(F.lit("Update and performance are mixed up: "), gold, F.lit(" against "), said, F.lit(".")))
        .when(mode == lx.MODES["under"], F.concat(F.lit("A person took over ("), F.coalesce(reason, F.lit("")), F.lit("), the rules did not.")))
        .when(mode == lx.MODES["howto"], F.concat(F.lit("Few telling words between "), gold, F.lit(" and "), said, F.lit(".")))
        .otherwise(F.concat(F.lit("The words of the reply differ, labels: "), gold, F.lit(" against "), said, F.lit(".")))
    )


def records(scored: DataFrame) -> DataFrame:
    """Rows that are wrong: in intent, in escalation, or with ROUGE-1 under 0.15; with the kind of error and the mode.

    scored has gold_intent, predicted_intent, gold_escalate, predicted_escalate, gold_reason, customer_text, rouge_1; its
    other columns, as metrics.reply_scores() gives them, stay.
    """
    intent = ~F.col("gold_intent").eqNullSafe(F.col("predicted_intent"))
    kind = F.when(
        F.col("predicted_escalate") & ~F.col("gold_escalate"), "false_positive",
    ).when(F.col("gold_escalate") & ~F.col("predicted_escalate"), "false_negative").otherwise("none")
    mode = failure_mode(F.col("customer_text"), F.col("gold_intent"), F.col("predicted_intent"), F.col("gold_escalate"), F.col("predicted_escalate"))
    wrong = scored.withColumns({"intent_error": intent, "escalate_error_type": kind}).where(
        "intent_error or escalate_error_type <> 'none'" + f" or rouge_1 < {LEAST_ROUGE}"
    )
    return wrong.withColumn("failure_mode", mode).withColumn(
        "root_cause", hypothesis(F.col("failure_mode"), F.col("gold_intent"), F.col("predicted_intent"), F.col("gold_reason")),
    )


def roll_up(scored: DataFrame) -> DataFrame:
    """One row: counts of all rows and of errors by kind, and their shares."""
    found = records(scored).agg(
        F.count(F.lit(1)).alias("errors"), F.count_if("intent_error").alias("intent_errors"), F.count_if(F.col("escalate_error_type") != "none").alias("escalation_errors"), F.count_if(
            F.col("escalate_error_type") == "false_positive"
        ).alias("false_positives"), F.count_if(F.col("escalate_error_type") == "false_negative").alias("false_negatives")
    )
    share = lambda c: F.coalesce(F.col(c) / F.nullif("total", F.lit(0)), F.lit(0.0)).alias(f"{c}_share")
    return scored.agg(F.count(F.lit(1)).alias("total")).join(F.broadcast(found)).select(
        "*", share("errors"), share("intent_errors"), share("escalation_errors"),
    )


def modes(scored: DataFrame) -> DataFrame:
    return records(scored).groupBy("failure_mode").agg(F.count(F.lit(1)).alias("n"))


def top_pairs(scored: DataFrame, position: str, k: int = 10) -> DataFrame:
    """The k most frequent (gold, predicted) pairs of labels that differ; of equals the one seen first."""
    pairs = scored.where("gold_intent <> predicted_intent").groupBy("gold_intent", "predicted_intent").agg(
        F.count(F.lit(1)).alias("n"), F.min(position).alias("first_pos"),
    )
    return pairs.orderBy(F.col("n").desc(), "first_pos").limit(k)


def samples(scored: DataFrame, position: str, n: int = 2) -> DataFrame:
    """The first n error records of each mode."""
    order = Window.partitionBy("failure_mode").orderBy(position)
    return records(scored).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


# Validation.


def violations(gold: DataFrame, holdout: DataFrame | None = None, expected: int | None = None) -> DataFrame:
    """pos, thread_id, rule: a row for each breach. gold has pos and the labelled fields; holdout pos and thread_id.

    Breaches of the whole set have a null pos.
    """
    c, blank = F.col, lambda x: F.coalesce(F.col(x), F.lit("")) == ""
    rules: list[tuple[str, Column]] = [
        ("missing_id", blank("thread_id")),
        *((f"missing_{f}", c(f).isNull()) for f in ("thread_id", "customer_tweet_id", "customer_text", "brand_text")),
        ("missing_intent", blank("intent")),
        ("invalid_intent", ~blank("intent") & ~c("intent").isin(lx.LABELS)),
        ("escalate_not_boolean", c("escalate").isNull()),
        ("reason_required", c("escalate") & blank("escalate_reason")),
        ("invalid_reason", c("escalate") & ~blank("escalate_reason") & ~c("escalate_reason").isin(lx.REASONS)),
        ("reason_forbidden", ~c("escalate") & ~blank("escalate_reason")),
    ]
    broken = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in rules)), lambda x: x.isNotNull())
    parts = [gold.select("pos", "thread_id", F.explode(broken).alias("rule"))]
    repeated = gold.where(~blank("thread_id")).groupBy("thread_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts.append(repeated.select(F.lit(None).cast("long").alias("pos"), "thread_id", F.lit("duplicate_id").alias("rule")))
    whole = lambda df, n, rule: df.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != n).select(
        F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("thread_id"), F.lit(rule).alias("rule"),
    )
    if expected is not None:
        parts.append(whole(gold, expected, "record_count"))
    if holdout is not None:
        if expected is not None:
            parts.append(whole(holdout, expected, "holdout_count"))
        other = holdout.select(c("pos").alias("_q"), c("thread_id").alias("_h"))
        both = gold.select("pos", "thread_id").join(other, c("pos") == c("_q"), "full_outer").where(~c("thread_id").eqNullSafe(c("_h")))
        parts.append(both.select(F.coalesce("pos", "_q").alias("pos"), F.coalesce("thread_id", "_h").alias("thread_id"), F.lit("holdout_order").alias("rule")))
    return reduce(DataFrame.unionByName, parts)


def audit(gold: DataFrame, source: DataFrame, unlabelled: DataFrame | None = None) -> DataFrame:
    """pos, thread_id, rule: labels that must escalate and don't, missing notes, texts that differ from the source's.

    unlabelled rows must have no label.
    """
    c = F.col
    other = source.select(c("thread_id").alias("_id"), c("customer_text").alias("_c"), c("brand_text").alias("_b"))
    joined = gold.join(other, c("thread_id") == c("_id"), "left")
    there = c("_id").isNotNull()
    rules = [
        ("mandatory_escalation", c("intent").isin(*lx.MANDATORY) & ~F.coalesce("escalate", F.lit(False))),
        ("missing_notes", F.coalesce(tx.strip(c("notes")), F.lit("")) == ""),
        ("not_in_source", ~there),
        ("customer_text_differs", there & ~c("customer_text").eqNullSafe(c("_c"))),
        ("brand_text_differs", there & ~c("brand_text").eqNullSafe(c("_b"))),
    ]
    broken = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in rules)), lambda x: x.isNotNull())
    out = joined.select("pos", "thread_id", F.explode(broken).alias("rule"))
    if unlabelled is not None:
        fields = ["intent", "escalate", "escalate_reason", "notes"]
        found = F.filter(F.array(*(F.when(c(f).isNotNull(), F.lit(f"labelled_{f}")) for f in fields)), lambda x: x.isNotNull())
        out = out.unionByName(unlabelled.select("pos", "thread_id", F.explode(found).alias("rule")))
    return out


def label_dump(gold: DataFrame, short: int = 90) -> DataFrame:
    """number (from 1, by pos), thread_id, status, and both texts on one line each, whole and cut to `short` characters."""
    line = {name: F.replace(F.col(c), F.lit("\n"), F.lit(" ")) for name, c in (("customer", "customer_text"), ("brand", "brand_text"))}
    cut = {f"{name}_short": F.substring(name, 1, short) for name in line}
    rows = windows.position(gold, "pos", "_at").withColumns(line)
    status = F.when(F.col("intent").isNull(), "EMPTY").otherwise("LABELED")
    return rows.select((F.col("_at") + 1).alias("number"), "thread_id", status.alias("status"), *line, *(c.alias(n) for n, c in cut.items()))


def label_counts(gold: DataFrame) -> DataFrame:
    """One row: rows with and without an intent, and the numbers (from 1) of the first and the last with one."""
    rows = windows.position(gold, "pos", "_at")
    number = F.when(F.col("intent").isNotNull(), F.col("_at") + 1)
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count("intent").alias("labelled"), F.count_if(F.col("intent").isNull()).alias("unlabelled"),
        F.min(number).alias("first_labelled"), F.max(number).alias("last_labelled"),
    )


def label_distribution(gold: DataFrame) -> DataFrame:
    """field, value, n and the share as text, of the rows with an intent; the values are a few labels."""
    fields = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in ("intent", "escalate", "escalate_reason")))
    counted = gold.where("intent is not null").select(F.explode(fields).alias("f")).groupBy("f.field", "f.value").agg(F.count(F.lit(1)).alias("n"))
    share = F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("field")), 2)
    return counted.withColumn("share", F.format_string("%.2f%%", share))


def summary(gold: DataFrame) -> DataFrame:
    """One row: records, unique ids, the intents found (sorted)."""
    return gold.agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("thread_id").alias("unique_ids"),
        F.array_sort(F.collect_set("intent")).alias("intents"),
    )


class ValidationError(ValueError):
    """A labelled set breaks its rules; the message names the first breaches."""


def require_valid(gold: DataFrame, holdout: DataFrame | None = None, expected: int | None = None, show: int = 20) -> DataFrame:
    """summary(), or ValidationError."""
    found = violations(gold, holdout, expected).orderBy(F.col("pos").asc_nulls_first(), "rule")
    first = found.limit(show).collect()
    if first:
        raise ValidationError("\n".join(f"{r.rule}: row {r.pos}, id {r.thread_id}" for r in first))
    return summary(gold)
