"""The tables that the catalogue's queries start from, on the test tables.

Conversations are of made-up words, so each exchange gets an opening phrase and gold labels from a small table,
by its number. The SQL below does the same for the oracles.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import quote
from parley.operators import threads as th

#: text, gold intent, gold reason (null: not escalated)
PHRASES = [
    ("My battery drains within an hour.", "battery_power_issue", None),
    ("Since the last update my phone lags.", "software_update_glitch", None),
    ("The wifi drops all day long", "connectivity_network_issue", None),
    ("I cracked the screen, can you repair it?", "hardware_physical_accessory", "physical_hardware_safety"),
    ("I was charged twice, I want a refund!", "billing_purchases_subscriptions", "financial_billing_transaction"),
    ("My Apple ID is locked and no verification code comes", "account_access_security", "account_security_credentials"),
    ("The app keeps crashing and then freezes.", "performance_crash_freeze", None),
    ("How do I sort my photos by date?", "apps_feature_howto", None),
    ("This is the worst, fix this now", "vague_complaint_unclear", "channel_transition"),
    ("Hola, necesito ayuda por favor", "other", None),
    ("I already sent you a DM about this", "other", "channel_transition"),
    ("I will call my lawyer about this", "other", "legal_regulatory_dispute"),
    ("It gets hot to touch and I saw smoke", "hardware_physical_accessory", "physical_hardware_safety"),
    ("Thanks, it works again", "other", None),
    ("Why does it do that?", "vague_complaint_unclear", None),
    ("autocorrect turns the letter i into a box i️ ?x", "software_update_glitch", None),
    ("wi fi and bluetooth① are off", "connectivity_network_issue", None),
    ("@Helper https://t.co/abc", "other", "missing_context_screenshot"),
    ("My phone is slow and stuck after the upgrade", "software_update_glitch", None),
    ("Where can I find a store nearby", "other", None),
    ("cancel my subscription please", "billing_purchases_subscriptions", "financial_billing_transaction"),
    ("Someone hacked my iCloud password", "account_access_security", "account_security_credentials"),
    ("The alarm does not ring, what now", "apps_feature_howto", None),
    ("voici ma question http://x.y", "other", None),
    ("so so", "other", "channel_transition"),
]
BRAND_PHRASES = [
    "@115858 We're happy to help.", "We've received your DM.", "Let's check your Settings and restart.", "Please DM us your password.",
    "Which version are you on?",
]
#: Answers of a language model, well-formed and not.
ANSWERS = [
    '```json\n{"intent": "billing_purchases_subscriptions", "relevance": 4.7, "safety_guardrail": true}\n```',
    '{"intent": "nonsense", "relevance": "4"}',
    "no json at all",
    '{"relevance": 9, "safety_guardrail": "false"}',
    '{"intent": "other", "relevance": "4.7", "safety_guardrail": false}',
    '{"relevance": null, "safety_guardrail": null}',
    '{"intent": "other", "relevance": -2} and more',
    '{"relevance": true, "safety_guardrail": 0}',
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, number: Column) -> Column:
    """The value at a number from 0, by a literal array: no join."""
    return F.get(F.array(*(F.lit(v) for v in values)), number.cast("int"))


def thread_id(number: Column) -> Column:
    return F.format_string("conv_%05d", number)


def exchanges(spark: SparkSession, sf_dir: str, answered: bool = False) -> DataFrame:
    """thread_id, pos, customer_text, brand_text, turn_count, inbound, outbound, holdout and gold labels; answered: see first_exchange()."""
    rows = th.first_exchange(table(spark, sf_dir, "conversations"), answered)
    n = (F.col("conv_id") * 7 + F.floor(F.col("conv_id") / 10)) % len(PHRASES)
    text, intent, reason = (pick([p[i] for p in PHRASES], n) for i in range(3))
    return rows.select(
        thread_id(F.col("conv_id")).alias("thread_id"),
        F.col("conv_id").alias("pos"),
        F.concat_ws(" ", text, "customer_text").alias("customer_text"),
        F.concat(pick(BRAND_PHRASES, F.col("conv_id") % len(BRAND_PHRASES)), F.lit(" "), F.col("brand_text")).alias("brand_text"),
        "turn_count",
        "inbound",
        "outbound",
        (F.col("conv_id") % 10 == 0).alias("holdout"),
        intent.alias("gold_intent"),
        reason.isNotNull().alias("gold_escalate"),
        reason.cast("string").alias("gold_reason"),
        *(["answered"] if answered else []),
    )


def sql_pick(values: list, number: str) -> str:
    return "[" + ", ".join("NULL" if v is None else quote(v) for v in values) + f"][CAST({number} AS INT) + 1]"


_N = f"((conv_id * 7 + conv_id // 10) % {len(PHRASES)})"
#: CTEs: exchanges as above.
SQL = f"""
WITH opening AS (SELECT conv_id, min(turn) AS t0 FROM conversations WHERE role = 'user' GROUP BY conv_id),
spoken AS (
    SELECT c.conv_id, any_value(text) FILTER (turn = t0) AS customer, arg_min(text, turn) FILTER (role = 'assistant' AND turn > t0) AS brand,
        count(*) FILTER (role IN ('user', 'assistant')) AS turn_count, count(*) FILTER (role = 'user') AS inbound, count(*) FILTER (role = 'assistant') AS outbound
    FROM conversations c JOIN opening USING (conv_id) GROUP BY c.conv_id),
exchanges AS (
    SELECT printf('conv_%05d', conv_id) AS thread_id, conv_id AS pos, {sql_pick([p[0] for p in PHRASES], _N)} || coalesce(' ' || customer, '') AS customer_text,
        {sql_pick(BRAND_PHRASES, f'conv_id % {len(BRAND_PHRASES)}')} || ' ' || brand AS brand_text, turn_count, inbound, outbound, conv_id % 10 = 0 AS holdout,
        {sql_pick([p[1] for p in PHRASES], _N)} AS gold_intent, {sql_pick([p[2] for p in PHRASES], _N)} IS NOT NULL AS gold_escalate, {sql_pick([p[2] for p in PHRASES], _N)} AS gold_reason
    FROM spoken)
"""
