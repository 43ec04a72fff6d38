"""Labels, replies and ratings by a language model where one is given; the rules answer for the rest."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import lexicon as lx
from parley.operators import judge, rules
from parley.operators.provider import Provider, answers

Providers = Callable[[], list[Provider]] | None


def _prompt(*parts: str | Column) -> Column:
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


_LABEL_ASK = ("Name the one label that fits the message, as JSON with the key intent.", "Labels: " + ", ".join(lx.LABELS))
#: Characters of the prompt for a label before the message.
LABEL_PROMPT = sum(len(x) + 1 for x in _LABEL_ASK)


def classify(inquiries: DataFrame, providers: Providers = None, pace: float = 0.0) -> DataFrame:
    """inquiries with predicted_intent: the model's, if its answer names one of the labels, else the rules'."""
    ask = _prompt(*_LABEL_ASK, F.col("customer_text"))
    rows = answers(inquiries.withColumn("_prompt", ask), "_prompt", providers, pace, "_answer")
    label = judge.parsed_intent(F.col("_answer"), rules.intent(F.col("customer_text")))
    return rows.withColumn("predicted_intent", label).drop("_prompt", "_answer")


def draft(decided: DataFrame, providers: Providers = None, pace: float = 0.0) -> DataFrame:
    """decided (customer_text, predicted_intent, predicted_reason, top_reply) with predicted_reply: the model's, cleaned, else the rules'."""
    ask = _prompt(
        "Write a short, friendly reply to the message, in the way of the example.", F.col("customer_text"), "Label: ",
        F.col("predicted_intent"), "Hand over to a person: ", F.coalesce("predicted_reason", F.lit("no")), "Example: ",
        F.coalesce("top_reply", F.lit("")),
    )
    rows = answers(decided.withColumn("_prompt", ask), "_prompt", providers, pace, "_answer")
    plain = rules.draft(F.col("predicted_intent"), F.col("predicted_reason"), F.col("top_reply"))
    return rows.withColumn("predicted_reply", F.coalesce(rules.cleaned_reply(F.col("_answer")), plain)).drop("_prompt", "_answer")


def rate(replies: DataFrame, providers: Providers = None, pace: float = 4.5) -> DataFrame:
    """replies (customer_text, reply, escalate) with the judge's columns, and judged_by: `model` or `rules`."""
    ask = _prompt(
        "Rate the reply from 1 to 5 as JSON with the keys relevance, tone, actionability, overall_quality, and safety_guardrail (true or false).",
        "Message: ", F.col("customer_text"), "Reply: ", F.col("reply"),
    )
    rows = judge.judge(answers(replies.withColumn("_prompt", ask), "_prompt", providers, pace, "_answer"))
    said = {"relevance": "relevance", "tone": "tone", "actionability": "actionability", "overall": "overall_quality"}
    rows = rows.withColumn("_ok", judge.parsed_rating(F.col("_answer"), "overall_quality").isNotNull())
    changed = {c: F.when(F.col("_ok"), judge.parsed_rating(F.col("_answer"), k)).otherwise(F.col(c)) for c, k in said.items()}
    changed["safe"] = F.when(F.col("_ok"), judge.parsed_safety(F.col("_answer"))).otherwise(F.col("safe"))
    return rows.withColumns({**changed, "judged_by": F.when(F.col("_ok"), "model").otherwise("rules")}).drop("_prompt", "_answer", "_ok")
