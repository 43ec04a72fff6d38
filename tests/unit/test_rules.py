"""Truth tables of the rule engines."""

import re

import pytest
from pyspark.sql import functions as F

from parley.functions import lexicon as lx
from parley.functions import text as tx
from parley.operators import rules
from parley.operators import judge as jd


def values(spark, column, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("t"))).collect()]


INTENTS = {
    "my battery drains fast": "battery_power_issue",
    "BATTERY and Apple   ID trouble": "account_access_security",
    "refund for a cracked screen": "billing_purchases_subscriptions",
    "the speaker is dead": "hardware_physical_accessory",
    "wi-fi is gone": "connectivity_network_issue",
    "after the update": "software_update_glitch",
    "it keeps crashing": "performance_crash_freeze",
    "how do i archive": "apps_feature_howto",
    "thank you": "other",
    "this sucks": "vague_complaint_unclear",
    "merci, my battery drains": "other",
    "nothing here": "other",
    "really?": "vague_complaint_unclear",
    "somehow odd": "vague_complaint_unclear",
    "an I️?x appears": "software_update_glitch",
    "an I️? appears": "vague_complaint_unclear",
    "wifi️": "connectivity_network_issue",
    "wifi①": "other",
    "": "other",
}


def test_intents(spark):
    assert values(spark, rules.intent, INTENTS) == list(INTENTS.values())


#: Two messages and more for each label, and for each rule of precedence, with the label that a person gives them.
SPOKEN = {
    "The percentage falls from 40 to 3 within minutes": "battery_power_issue",
    "Cable is in, yet it is not charging at all": "battery_power_issue",
    "Every app I open closes and the phone is frozen": "performance_crash_freeze",
    "So slow when I type": "performance_crash_freeze",
    "Since iOS 11 a box shows up instead of a letter": "software_update_glitch",
    "The new patch moved my icons": "software_update_glitch",
    "Bluetooth does not find my car": "connectivity_network_issue",
    "It says no sim five times a day": "connectivity_network_issue",
    "One AirPod is silent": "hardware_physical_accessory",
    "Water damage after a swim": "hardware_physical_accessory",
    "I forgot my passcode and the security questions": "account_access_security",
    "Someone compromised my account": "account_access_security",
    "There is an unauthorized charge on the card": "billing_purchases_subscriptions",
    "Where did my subscription money go": "billing_purchases_subscriptions",
    "How can I sort notes by name": "apps_feature_howto",
    "The podcast list has no search": "apps_feature_howto",
    "This is useless": "vague_complaint_unclear",
    "Can somebody tell me?": "vague_complaint_unclear",
    "thx, solved": "other",
    "gracias, la pantalla": "other",
    "The phone is dying and my Apple ID is locked": "account_access_security",
    "Dropped it, cracked, and it drains": "hardware_physical_accessory",
    "Want a refund for the broken speaker": "billing_purchases_subscriptions",
    "Worst update, the battery is dying": "battery_power_issue",
}
REASONED = {
    "I already sent a DM": "channel_transition",
    "pm'd you about the wifi": "channel_transition",
    "You will hear from my attorney": "legal_regulatory_dispute",
    "This is against consumer rights": "legal_regulatory_dispute",
    "The case is swollen": "physical_hardware_safety",
    "It is hot to touch": "physical_hardware_safety",
    "My two-factor code never comes": "account_security_credentials",
    "Fraudulent charge on my bill": "financial_billing_transaction",
    "@Someone https://pic.example/1": "missing_context_screenshot",
    "Which setting is it?": None,
    "The app crashes": None,
}


def test_messages_as_people_write_them(spark):
    assert dict(zip(SPOKEN, values(spark, rules.intent, SPOKEN))) == SPOKEN
    assert dict(zip(REASONED, values(spark, lambda t: rules.escalation_reason(t, rules.intent(t)), REASONED))) == REASONED


def test_borders_are_as_python_has_them(spark):
    texts = [
        "wifi", "wifis", "é wifi", "éwifi", "wifi_", "wifi️", "wifí", "i ?z", "i ?x", "i ? x", "wifi①", "x-wifi-x", "WİFI", "3g", "a3g",
        "no sim", "no\n sim",
    ]
    for name, terms in lx.INTENT_TERMS.items():
        pattern = re.compile(r"\b(?:" + "|".join(t.replace(r"\x{FE0E}", "︎").replace(r"\x{FE0F}", "️") for t in terms) + r")\b", re.IGNORECASE)
        assert values(spark, lambda t: tx.matches(F.lower(t), terms), texts) == [bool(pattern.search(t.lower())) for t in texts], name


ESCALATIONS = {
    "": "missing_context_screenshot",
    "@Helper @b https://t.co/x": "missing_context_screenshot",
    "@Helper look https://t.co/x": None,
    "I sent you a DM": "channel_transition",
    "my lawyer will hear": "legal_regulatory_dispute",
    "it is smoking": "physical_hardware_safety",
    "2fa fails": "account_security_credentials",
    "charged twice": "financial_billing_transaction",
    "check your dm, lawyer": "channel_transition",
    "the password": "account_security_credentials",
    "the receipt": "financial_billing_transaction",
    "the glass": "physical_hardware_safety",
    "my battery": None,
}


def test_escalations(spark):
    assert values(spark, lambda t: rules.escalation_reason(t, rules.intent(t)), ESCALATIONS) == list(ESCALATIONS.values())


def test_triage_reads_the_best_past_reply(spark):
    past = F.lit("We've GOT YOUR DM")
    assert values(spark, lambda t: rules.triage_reason(t, rules.intent(t), F.lit(0.6), past), ["my battery"]) == ["channel_transition"]
    assert values(spark, lambda t: rules.triage_reason(t, rules.intent(t), F.lit(0.5999), past), ["my battery"]) == [None]
    assert values(spark, lambda t: rules.triage_reason(t, rules.intent(t), F.lit(None).cast("double"), F.lit(None).cast("string")), ["my battery"]) == [None]


def test_drafts(spark):
    def draft(label, reason, past):
        return values(spark, lambda t: rules.draft(F.lit(label), F.lit(reason).cast("string"), F.lit(past).cast("string")), [""])[0]

    assert draft("vague_complaint_unclear", "channel_transition", "x") == lx.CLARIFY_REPLY
    assert draft("other", "financial_billing_transaction", "x") == lx.ACCOUNT_REPLY
    assert draft("other", "physical_hardware_safety", "x") == lx.HARDWARE_REPLY
    assert draft("other", "channel_transition", "x") == lx.ESCALATE_REPLY
    assert draft("other", None, " @1234  Try this. ") == "Try this."
    assert draft("other", None, "@name Try") == "@name Try"
    assert draft("other", None, "@12 ") == draft("other", None, None) == lx.DEFAULT_REPLY
    assert len(lx.ACCOUNT_REPLY) < 280 and "DM" in lx.ACCOUNT_REPLY


def test_cleaned_replies(spark):
    assert values(spark, rules.cleaned_reply, ['"hi"', "'@a_b  hi'", "@x", '""', "plain"]) == ["hi", "hi", None, None, "plain"]


def test_buckets(spark):
    texts = ["My Apple ID", "a bill", "glass", "simple", "hot", "bug", "lag", "mail", "zzz"]
    assert values(spark, rules.weak_bucket, texts) == [*lx.BUCKETS, lx.GENERAL_BUCKET]


def test_weak_labels(spark):
    rows = [
        (0, "refund please", "ok", None, None, None, "billing_purchases_subscriptions", True, "financial_billing_transaction"),
        (1, "hola screen", "x", None, None, None, "other", False, None),
        (2, "x", "send us a DM", "other", None, None, "other", True, "channel_transition"),
        (3, "x", "x", "other", False, None, "other", False, None),
        (4, "home screen odd", "x", None, None, None, "other", False, None),
        (5, "look t.co/abc", "x", None, None, None, "vague_complaint_unclear", True, "missing_context_screenshot"),
        (6, "lawsuit", None, None, None, None, "other", True, "legal_regulatory_dispute"),
        (99, "x", "x", "billing_purchases_subscriptions", True, "financial_billing_transaction", "other", False, None),
    ]
    frame = spark.createDataFrame(
        rows,
        "pos int, customer_text string, brand_text string, intent string, escalate boolean, escalate_reason string, a string, b boolean, c string",
    )
    for r in rules.weak_labels(frame).collect():
        assert (r.weak_intent, r.weak_escalate, r.weak_reason) == (r.a, r.b, r.c), r.pos


JUDGED = [
    # customer, reply, escalate -> relevance, tone, actionability, safe, overall
    ("My phone is slow", "Try a restart in Settings, then tell us the version.", False, (4, 5, 5, True, 5)),
    ("My battery is swollen", "Please keep charging it overnight.", False, (4, 5, 3, False, 1)),
    ("My battery is swollen", "Stop using it and unplug the charger now.", False, (4, 5, 3, True, 4)),
    ("Locked out", "Send us your password here.", False, (4, 5, 3, False, 1)),
    ("It broke", "That was our fault.", True, (2, 5, 2, False, 1)),
    ("It broke", "Join us in a DM", True, (2, 5, 5, True, 4)),
    ("update battery", "[link] see the battery update", False, (5, 2, 5, True, 4)),
    ("words words", "@user words are here?", False, (4, 4, 4, True, 4)),
]


def test_judge(spark):
    rows = [(i, *x[:3]) for i, x in enumerate(JUDGED)]
    frame = jd.judge(spark.createDataFrame(rows, "i int, customer_text string, reply string, escalate boolean")).orderBy("i")
    assert [(r.relevance, r.tone, r.actionability, r.safe, r.overall) for r in frame.collect()] == [x[3] for x in JUDGED]


ANSWERS = {
    '{"relevance": 4.7}': (4, True),
    '{"relevance": "4.7"}': (3, True),
    '{"relevance": " 5 "}': (5, True),
    '{"relevance": -3}': (1, True),
    '{"relevance": [4]}': (3, True),
    '```json\n{"tone": 2, "safety_guardrail": 0}\n```': (4, False),
    '{"safety_guardrail": "false"}': (4, True),
    '{"safety_guardrail": ""}': (4, False),
    '{"safety_guardrail": null, "relevance": null}': (3, False),
    '{"relevance": 5} trailing': (None, None),
    "oops": (None, None),
}


def test_answers(spark):
    assert values(spark, lambda t: F.struct(jd.parsed_rating(t, "relevance"), jd.parsed_safety(t)), ANSWERS) == [tuple(x) for x in ANSWERS.values()]
    assert values(
        spark, lambda t: jd.parsed_intent(t, F.lit("rule")),
        ['{"intent": "other"}', '{"intent": "x"}', "{", '```json {"intent":"other"} ```'],
    ) == ["other", "rule", "rule", "other"]


@pytest.mark.parametrize("n", [3, 4])
def test_terms_have_no_duplicates(n):
    for terms in (*lx.INTENT_TERMS.values(), *lx.ESCALATION_TERMS.values(), *lx.BUCKETS.values(), *lx.LABELLER_TERMS.values()):
        assert len(terms) == len(set(terms)) >= n


def test_term_lists(spark):
    """One scan finds what single searches find: overlapping and nested terms, empty and null texts, several lists for a term."""
    from parley.functions.termlists import TermLists

    lists = {"a": ["he", "hers", "é"], "b": ["she", "he"], "c": ["x y", "s"], **{f"n{i}": [f"#{i};"] for i in range(60)}}
    texts = [None, "", "ushers", "he", "h e", "x  y x y", "sécurité 漢字 she", "#7; #59;", "shehers" * 500, "\0he\0"]
    found = TermLists(lists)
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    out = rows.withColumn("_bits", found.scan(F.col("text"))).select("id", *(found.has(F.col("_bits"), x).alias(x) for x in lists), found.has(F.col("_bits"), "a", "c").alias("ac"))
    for r in out.collect():
        text = texts[r.id]
        want = {x: None if text is None else any(t in text for t in terms) for x, terms in lists.items()}
        assert {x: r[x] for x in lists} == want and r.ac == (None if text is None else want["a"] or want["c"])
    with pytest.raises(ValueError):
        TermLists({str(i): ["x"] for i in range(64)})
    with pytest.raises(ValueError):
        TermLists({"a": [""]})
