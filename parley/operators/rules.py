"""Rule engines as columns: intents, escalation, triage, drafting, weak buckets, the weak labeller."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import lexicon as lx
from parley.functions import text as tx
from parley.functions.termlists import TermLists


def first_of(cases: list[tuple[Column, Column | str | None]], default: Column | str | None) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default)


def intent(text: Column) -> Column:
    """The first label by priority whose pattern occurs; foreign texts are `other`, bare questions vague."""
    low = F.lower(text)
    asks = text.contains("?") | tx.contains_any(low, lx.QUESTION_WORDS)
    cases = [(tx.matches(low, lx.FOREIGN), "other"), *((tx.matches(low, lx.INTENT_TERMS[x]), x) for x in lx.PRIORITY), (asks, "vague_complaint_unclear")]
    return first_of(cases, "other")


def escalation_reason(text: Column, label: Column) -> Column:
    """The reason to hand over to a person, or null; a text of handles and a link only comes first."""
    low = F.lower(text)
    bare = tx.strip(text).rlike("(?iu)" + tx.template(lx.SCREENSHOT_ONLY))
    cases = [
        (bare, "missing_context_screenshot"), *((tx.matches(low, terms), reason) for reason, terms in lx.ESCALATION_TERMS.items()),
        *((label == x, reason) for x, reason in lx.MANDATORY.items()),
    ]
    return first_of(cases, None)


def triage_reason(text: Column, label: Column, top_score: Column, top_reply: Column) -> Column:
    """escalation_reason(), and a hand-over where the best past reply clearly was one; top_score has four digits."""
    was_dm = (top_score >= lx.DM_SCORE) & tx.contains_any(F.lower(top_reply), lx.DM_PHRASES)
    return F.coalesce(escalation_reason(text, label), F.when(was_dm, "channel_transition"))


def without_handle(reply: Column) -> Column:
    """A past reply without the number that stands for its addressee."""
    return tx.strip(F.regexp_replace(tx.strip(reply), rf"^@\p{{Nd}}+[{tx.SPACE}]*", ""))


def draft(label: Column, reason: Column, top_reply: Column) -> Column:
    """The reply text: a question back, a hand-over by reason, the best past reply, or a default."""
    past = without_handle(F.coalesce(top_reply, F.lit("")))
    cases = [
        (label == "vague_complaint_unclear", F.lit(lx.CLARIFY_REPLY)),
        (reason.isin("account_security_credentials", "financial_billing_transaction"), F.lit(lx.ACCOUNT_REPLY)),
        (reason == "physical_hardware_safety", F.lit(lx.HARDWARE_REPLY)),
        (reason.isNotNull(), F.lit(lx.ESCALATE_REPLY)),
        (past != "", past),
    ]
    return first_of(cases, F.lit(lx.DEFAULT_REPLY))


def cleaned_reply(raw: Column) -> Column:
    """A generated reply without a quotation mark at either end and without a leading handle; null if nothing is left."""
    bare = tx.strip(F.regexp_replace(raw, "^[\"']|[\"']$", ""))
    bare = tx.strip(F.regexp_replace(bare, rf"^@{tx.WORD}+[{tx.SPACE}]*", ""))
    return F.when(bare != "", bare)


_BUCKETS = TermLists(lx.BUCKETS)


def weak_bucket(text: Column) -> Column:
    return tx.let(_BUCKETS.scan(F.lower(text)), lambda bits: first_of([(_BUCKETS.has(bits, name), name) for name in lx.BUCKETS], lx.GENERAL_BUCKET))


#: What a customer's and the brand's text are scanned for, each once.
_CUSTOMER = TermLists(
    {
        **lx.LABELLER_TERMS, **lx.LABELLER_REASON_TERMS, "foreign": lx.LABELLER_FOREIGN, "not hardware": lx.LABELLER_NOT_HARDWARE, "legal": lx.LABELLER_LEGAL,
        "dm": lx.LABELLER_CUSTOMER_DM, "not media": lx.LABELLER_NOT_MEDIA, "link": ["t.co/"],
    }
)
_BRAND = TermLists({"foreign": lx.LABELLER_FOREIGN_BRAND, "dm": lx.LABELLER_BRAND_DM, "kept dm": lx.LABELLER_KEPT_DM})


def weak_labels(rows: DataFrame, position: str = "pos", customer: str = "customer_text", brand: str = "brand_text") -> DataFrame:
    """rows with weak_intent, weak_escalate and weak_reason.

    Labels that rows at the kept positions already have (columns intent, escalate, escalate_reason) stay; their
    missing escalation is read off the brand's reply.
    """
    scanned = rows.withColumns({"_c": _CUSTOMER.scan(F.lower(customer)), "_b": _BRAND.scan(F.lower(F.coalesce(brand, F.lit(""))))})
    has = lambda name: _CUSTOMER.has(F.col("_c"), name)
    said = lambda name: _BRAND.has(F.col("_b"), name)
    cases: list = [(said("foreign") | has("foreign"), "other")]
    for name in lx.LABELLER_TERMS:
        cases.append((has(name) & ~has("not hardware") if name == "hardware_physical_accessory" else has(name), name))
    words = tx.word_count(F.col(customer))
    cases.append((has("link") & (words <= 4), "vague_complaint_unclear"))
    label = F.col("_label")
    owed = [(label == name, F.when(said("dm") | has(reason), reason)) for name, reason in lx.MANDATORY.items()]
    reason = first_of(
        [
            *owed, (has("legal"), "legal_regulatory_dispute"), (said("dm") | has("dm"), "channel_transition"),
            (has("link") & (words <= 3) & ~has("not media"), "missing_context_screenshot"),
        ], None
    )
    kept = F.col(position).between(*lx.LABELLER_KEPT_ROWS) & F.col("intent").isNotNull()
    told = said("kept dm")
    made = scanned.withColumn("_label", first_of(cases, "other")).withColumn("_reason", reason)
    return made.withColumns(
        {
            "weak_intent": F.when(kept, F.col("intent")).otherwise(label),
            "weak_escalate": F.when(kept, F.coalesce("escalate", told)).otherwise(F.col("_reason").isNotNull()),
            "weak_reason": F.when(
                kept & F.col("escalate").isNotNull(), F.col("escalate_reason"),
            ).when(kept, F.when(told, "channel_transition")).otherwise(F.col("_reason")),
        }
    ).drop("_label", "_reason", "_c", "_b")


# DuckDB forms.


def sql_intent(text: str) -> str:
    low = f"lower({text})"
    whens = [f"WHEN {tx.sql_matches(low, lx.FOREIGN)} THEN 'other'"]
    whens += [f"WHEN {tx.sql_matches(low, lx.INTENT_TERMS[x])} THEN '{x}'" for x in lx.PRIORITY]
    return f"CASE {' '.join(whens)} WHEN contains({text}, '?') OR {tx.sql_contains_any(low, lx.QUESTION_WORDS)} THEN 'vague_complaint_unclear' ELSE 'other' END"


def sql_escalation(text: str, label: str) -> str:
    low = f"lower({text})"
    whens = [f"WHEN regexp_matches({tx.sql_strip(text)}, {tx.quote('(?i)' + tx.template(lx.SCREENSHOT_ONLY))}) THEN 'missing_context_screenshot'"]
    whens += [f"WHEN {tx.sql_matches(low, terms)} THEN '{reason}'" for reason, terms in lx.ESCALATION_TERMS.items()]
    whens += [f"WHEN {label} = '{x}' THEN '{reason}'" for x, reason in lx.MANDATORY.items()]
    return f"CASE {' '.join(whens)} END"


def sql_triage(text: str, label: str, score: str, reply: str) -> str:
    return f"coalesce({sql_escalation(text, label)}, CASE WHEN {score} >= {lx.DM_SCORE} AND {
        tx.sql_contains_any(f'lower({reply})', lx.DM_PHRASES)
    } THEN 'channel_transition' END)"


def sql_without_handle(reply: str) -> str:
    bare = f"regexp_replace({tx.sql_strip(reply)}, {tx.quote(rf'^@\p{{Nd}}+[{tx.SPACE}]*')}, '')"
    return tx.sql_strip(bare)


def sql_draft(label: str, reason: str, reply: str) -> str:
    past = sql_without_handle(f"coalesce({reply}, '')")
    q = tx.quote
    return f"""CASE WHEN {label} = 'vague_complaint_unclear' THEN {q(lx.CLARIFY_REPLY)} WHEN {reason} IN ('account_security_credentials', 'financial_billing_transaction') THEN {q(lx.ACCOUNT_REPLY)}
        WHEN {reason} = 'physical_hardware_safety' THEN {q(lx.HARDWARE_REPLY)} WHEN {reason} IS NOT NULL THEN {q(lx.ESCALATE_REPLY)} WHEN {past} <> '' THEN {past} ELSE {q(lx.DEFAULT_REPLY)} END"""


def sql_bucket(text: str) -> str:
    whens = " ".join(f"WHEN {tx.sql_contains_any(f'lower({text})', terms)} THEN '{name}'" for name, terms in lx.BUCKETS.items())
    return f"CASE {whens} ELSE '{lx.GENERAL_BUCKET}' END"


def sql_weak_labels(rows: str, position: str = "pos", customer: str = "customer_text", brand: str = "brand_text") -> str:
    c, b = f"lower({customer})", f"lower(coalesce({brand}, ''))"
    has = lambda terms: tx.sql_contains_any(c, terms)
    asked, words = tx.sql_contains_any(b, lx.LABELLER_BRAND_DM), tx.sql_word_count(customer)
    whens = [f"WHEN {tx.sql_contains_any(b, lx.LABELLER_FOREIGN_BRAND)} OR {has(lx.LABELLER_FOREIGN)} THEN 'other'"]
    for name, terms in lx.LABELLER_TERMS.items():
        but = f" AND NOT {has(lx.LABELLER_NOT_HARDWARE)}" if name == "hardware_physical_accessory" else ""
        whens.append(f"WHEN {has(terms)}{but} THEN '{name}'")
    label = f"CASE {' '.join(whens)} WHEN contains({c}, 't.co/') AND {words} <= 4 THEN 'vague_complaint_unclear' ELSE 'other' END"
    owed = " ".join(
        f"WHEN label_ = '{name}' THEN CASE WHEN {asked} OR {has(lx.LABELLER_REASON_TERMS[reason])} THEN '{reason}' END" for name,
        reason in lx.MANDATORY.items()
    )
    reason = f"CASE {owed} WHEN {has(lx.LABELLER_LEGAL)} THEN 'legal_regulatory_dispute' WHEN {asked} OR {
        has(lx.LABELLER_CUSTOMER_DM)
    } THEN 'channel_transition' WHEN contains({c}, 't.co/') AND {words} <= 3 AND NOT {has(lx.LABELLER_NOT_MEDIA)} THEN 'missing_context_screenshot' END"
    first, last = lx.LABELLER_KEPT_ROWS
    kept, told = f"({position} BETWEEN {first} AND {last} AND intent IS NOT NULL)", tx.sql_contains_any(b, lx.LABELLER_KEPT_DM)
    return f"""SELECT *, CASE WHEN {kept} THEN intent ELSE label_ END AS weak_intent, CASE WHEN {kept} THEN coalesce(escalate, {told}) ELSE reason_ IS NOT NULL END AS weak_escalate,
        CASE WHEN {kept} AND escalate IS NOT NULL THEN escalate_reason WHEN {kept} THEN CASE WHEN {told} THEN 'channel_transition' END ELSE reason_ END AS weak_reason
        FROM (SELECT *, {reason} AS reason_ FROM (SELECT *, {label} AS label_ FROM {rows}))"""
