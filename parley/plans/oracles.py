"""DuckDB SQL for the catalogue's queries."""

from parley.functions import lexicon as lx
from parley.functions import text as tx
from parley.operators import judge as jd
from parley.operators import rules
from parley.plans import base

BASE = base.SQL
_LABELS = ", ".join(f"'{x}'" for x in lx.LABELS)
_SAFETY = ", ".join(f"'{x}'" for x in lx.SAFETY_REASONS)
_ratio = "coalesce(CAST({0} AS DOUBLE) / nullif(CAST({1} AS DOUBLE), 0), 0)".format
_f1 = lambda p, r: _ratio(f"(2 * ({p}) * ({r}))", f"(({p}) + ({r}))")
_ascii = "regexp_extract_all(lower({0}), '[a-zA-Z0-9]+')".format
_unicode = lambda c: f"regexp_extract_all(lower({c}), {tx.quote(tx.WORD_TOKEN)})"

LABELLED = f"""{BASE},
labelled_ AS (SELECT *, {rules.sql_intent('customer_text')} AS predicted_intent FROM exchanges),
reasoned_ AS (SELECT *, {rules.sql_escalation('customer_text', 'predicted_intent')} AS predicted_reason FROM labelled_),
labelled AS (SELECT *, predicted_reason IS NOT NULL AS predicted_escalate FROM reasoned_)
"""

SAMPLE = f"""{BASE},
placed AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS place, count(*) OVER () // 3 AS third FROM exchanges),
regions AS (SELECT *, CASE WHEN place < third THEN 'start' WHEN place < 2 * third THEN 'middle' ELSE 'end' END AS region FROM placed),
bucketed AS (SELECT *, {rules.sql_bucket('customer_text')} AS bucket, CASE WHEN turn_count = 2 THEN '2_turn' WHEN turn_count >= 3 THEN 'multi_turn' END AS turn_type FROM regions),
drawn AS (SELECT *, row_number() OVER (PARTITION BY region, turn_type, bucket ORDER BY (pos * 7919) % 1009, pos) AS draw,
    list_position([{', '.join(f"'{x}'" for x in [*lx.BUCKETS, lx.GENERAL_BUCKET])}], bucket) AS spot FROM bucketed WHERE turn_type IS NOT NULL),
turns AS (SELECT *, row_number() OVER (PARTITION BY region, turn_type ORDER BY draw, spot) AS turn FROM drawn),
sample AS (SELECT * FROM turns WHERE turn <= CASE region {' '.join(f"WHEN '{k}' THEN CASE turn_type WHEN '2_turn' THEN {a} ELSE {b} END" for k, (a, b) in lx.REGION_TARGETS.items())} END)
"""


def _index(scheme: str) -> str:
    idf = "ln((n + 1.0) / (df + 1.0)) + 1" if scheme == "tfidf" else "ln((n - df + 0.5) / (df + 0.5) + 1)"
    weight = "tf * idf" if scheme == "tfidf" else "tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean)) * idf"
    return f"""
    sized AS (SELECT doc_id, {_ascii('text')} AS tokens, len({_ascii('text')}) AS len FROM corpus),
    whole AS (SELECT count(*) AS n, avg(len) AS mean FROM sized),
    tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len, unnest(tokens) AS term FROM sized) GROUP BY ALL),
    dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    idfs AS (SELECT term, df, mean, {idf} AS idf FROM dfs, whole),
    postings AS (SELECT doc_id, term, idf, {weight} AS w FROM tf JOIN idfs USING (term)),
    norms AS (SELECT c.doc_id, CASE WHEN sqrt(sum(w * w)) > 0 THEN sqrt(sum(w * w)) ELSE 1 END AS norm FROM corpus c LEFT JOIN postings p ON c.doc_id = p.doc_id GROUP BY c.doc_id)"""


def _search(scheme: str, k: int) -> str:
    return f"""{_index(scheme)},
    words AS (SELECT query_id, unnest({_ascii('text')}) AS term, generate_subscripts({_ascii('text')}, 1) AS spot FROM asked),
    terms AS (SELECT query_id, term, count(*) AS qtf, min(spot) AS spot FROM words GROUP BY ALL),
    weights AS (SELECT query_id, t.term, qtf * idf AS qw, spot FROM terms t JOIN idfs USING (term)),
    qnorms AS (SELECT query_id, sqrt(sum(qw * qw)) AS qnorm FROM weights GROUP BY query_id),
    dots AS (SELECT query_id, doc_id, sum(qw * w) AS dot, min(spot) AS first FROM weights JOIN postings USING (term) GROUP BY ALL),
    scored AS (SELECT query_id, doc_id, dot / (qnorm * norm) AS score, first FROM dots JOIN qnorms USING (query_id) JOIN norms USING (doc_id)),
    ranked AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, first, pos) AS rank FROM scored JOIN corpus USING (doc_id)),
    hits AS (SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= {k}
        UNION ALL SELECT query_id, 1, (SELECT arg_min(doc_id, pos) FROM corpus), 0.0 FROM asked WHERE query_id NOT IN (SELECT query_id FROM qnorms))"""


CORPUS = """
corpus AS (SELECT thread_id AS doc_id, pos, customer_text AS text FROM exchanges WHERE NOT holdout),
asked AS (SELECT thread_id AS query_id, customer_text AS text FROM exchanges WHERE holdout),
"""
#: The agents search among exchanges that the brand answered.
ANSWERED = CORPUS.replace("WHERE NOT holdout", "WHERE NOT holdout AND brand_text IS NOT NULL")
_HITS = "SELECT query_id, CAST(rank AS INT) AS rank, doc_id, round(score, 6) AS score FROM hits"

_AGENT = f"""
top AS (SELECT query_id AS thread_id, doc_id AS retrieved_thread_id, round(score, 4) AS retrieval_score, brand_text AS reply FROM hits JOIN exchanges ON doc_id = thread_id WHERE rank = 1),
held AS (SELECT l.thread_id, customer_text, predicted_intent, predicted_reason, retrieved_thread_id, retrieval_score, reply FROM labelled l LEFT JOIN top USING (thread_id) WHERE holdout)
"""

CELLS = f"""cells AS (
    SELECT a.label AS actual, p.label AS predicted, count(l.thread_id) AS n FROM (SELECT unnest([{_LABELS}]) AS label) a CROSS JOIN (SELECT unnest([{_LABELS}]) AS label) p
    LEFT JOIN labelled l ON l.gold_intent = a.label AND l.predicted_intent = p.label GROUP BY ALL),
sums AS (SELECT label, sum(CASE WHEN actual = label AND predicted = label THEN n ELSE 0 END) AS r, sum(CASE WHEN predicted = label THEN n ELSE 0 END) AS p, sum(CASE WHEN actual = label THEN n ELSE 0 END) AS support
    FROM cells, (SELECT unnest([{_LABELS}]) AS label) GROUP BY label),
classes AS (SELECT label, {_ratio('r', 'p')} AS precision, {_ratio('r', 'support')} AS recall, CAST(support AS BIGINT) AS support FROM sums),
scores AS (SELECT *, {_f1('precision', 'recall')} AS f1 FROM classes)"""

_BINARY = """cells AS (SELECT count(*) FILTER (gold_escalate AND predicted_escalate) AS tp, count(*) FILTER (NOT gold_escalate AND predicted_escalate) AS fp,
    count(*) FILTER (NOT gold_escalate AND NOT predicted_escalate) AS tn, count(*) FILTER (gold_escalate AND NOT predicted_escalate) AS fn, count(*) AS total FROM labelled)"""

PAIRS = "pairs AS (SELECT thread_id AS id, brand_text AS reference, customer_text AS hypothesis FROM exchanges WHERE brand_text IS NOT NULL)"


def _rouge(n: int, tag: str = "") -> str:
    """Counts of n-grams of the table pairs, and precision and recall of each; tag tells apart several n in one statement."""
    gram = lambda c: f"list_transform(range(1, greatest(len({c}) - {n - 1}, 0) + 1), lambda i: array_to_string({c}[i:i + {n - 1}], chr(1)))"
    return f"""
    toks{tag} AS (SELECT id, {_unicode('reference')} AS r, {_unicode('hypothesis')} AS h FROM pairs),
    rg{tag} AS (SELECT id, gram, count(*) AS n FROM (SELECT id, unnest({gram('r')}) AS gram FROM toks{tag}) GROUP BY ALL),
    hg{tag} AS (SELECT id, gram, count(*) AS n FROM (SELECT id, unnest({gram('h')}) AS gram FROM toks{tag}) GROUP BY ALL),
    shared{tag} AS (SELECT id, sum(least(r_.n, h_.n)) AS o FROM rg{tag} r_ JOIN hg{tag} h_ USING (id, gram) GROUP BY id),
    rouges{tag} AS (SELECT id, {_ratio('coalesce(o, 0)', f'greatest(len(h) - {n - 1}, 0)')} AS precision, {_ratio('coalesce(o, 0)', f'greatest(len(r) - {n - 1}, 0)')} AS recall, len(r) AS nr, len(h) AS nh FROM toks{tag} LEFT JOIN shared{tag} USING (id))"""


#: The longest common subsequence of r and h of toks, a row of the table of lengths after another: the next row is the running
#: maximum of what each place has from above or from above left by a match.
_ROW = """list_transform([list_transform(range(1, len(eq) + 1), lambda j: greatest(acc[j], CASE WHEN eq[j] = 1 THEN 1 + CASE WHEN j > 1 THEN acc[j - 1] ELSE 0 END ELSE 0 END))],
    lambda c: list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])))[1]"""
_LCS = f"""lcs AS (SELECT id, len(r) AS nr, len(h) AS nh, CASE WHEN len(r) = 0 OR len(h) = 0 THEN 0 ELSE
    list_reduce(list_transform(h, lambda w: list_transform(r, lambda x: CAST(x = w AS INT))), lambda acc, eq: {_ROW}, list_transform(r, lambda x: CAST(0 AS INT)))[len(r)] END AS lcs FROM toks),
longest AS (SELECT id, CAST(lcs AS INT) AS lcs, {_ratio('lcs', 'nh')} AS precision, {_ratio('lcs', 'nr')} AS recall FROM lcs)"""
_BLEU = "CASE WHEN nh = 0 OR nr = 0 THEN 0 ELSE precision * CASE WHEN nh > nr THEN 1 ELSE exp(1 - CAST(nr AS DOUBLE) / nh) END END"

_ROUGE_OUT = f"SELECT id, round(precision, 6) AS precision, round(recall, 6) AS recall, round({_f1('precision', 'recall')}, 6) AS f1 FROM rouges"

RATINGS = f"""WITH ratings AS (
    SELECT lang, unnest([
        {{'dimension': 'overall', 't': least(5, 1 + n_chars // 800), 'p': least(5, 1 + {tx.sql_word_count('text')} // 150)}},
        {{'dimension': 'relevance', 't': 1 + doc_id % 5, 'p': 1 + (doc_id * 3 + n_chars) % 5}},
        {{'dimension': 'tone', 't': CAST(3 AS BIGINT), 'p': CAST(3 AS BIGINT)}},
        {{'dimension': 'actionability', 't': 1 + (n_chars % 7) % 5, 'p': least(5, 1 + (n_chars % 7) // 2)}}], recursive := true)
    FROM documents)"""


def _pearson(t: str, p: str) -> str:
    return f"greatest(-1, least(1, coalesce(covar_pop({t}, {p}) / nullif(sqrt(var_pop({t}) * var_pop({p})), 0), 0)))"


_KAPPA = """CASE WHEN count(*) = 0 THEN 0 WHEN abs(sum(t * t) + sum(p * p) - 2.0 * sum(t) * sum(p) / count(*)) < 1e-12 THEN CASE WHEN sum((t - p) * (t - p)) = 0 THEN 1 ELSE 0 END
    ELSE 1 - sum((t - p) * (t - p)) / (sum(t * t) + sum(p * p) - 2.0 * sum(t) * sum(p) / count(*)) END"""


def _ranked(by: str) -> str:
    rank = lambda c: f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0 AS r{c}"
    return f"ranks AS (SELECT *, {rank('t')}, {rank('p')} FROM ratings)"


def _mode() -> str:
    pair = lambda a, b: f"((gold_intent = '{a}' AND predicted_intent = '{b}') OR (gold_intent = '{b}' AND predicted_intent = '{a}'))"
    low = "lower(customer_text)"
    return f"""CASE WHEN {tx.sql_contains_any(low, lx.MODE_FOREIGN)} OR (contains({low}, 'http') AND {tx.sql_word_count(low)} < 8) THEN '{lx.MODES['media']}'
        WHEN {pair('software_update_glitch', 'performance_crash_freeze')} OR (gold_intent = 'software_update_glitch' AND {tx.sql_contains_any(low, lx.MODE_PERFORMANCE)}) THEN '{lx.MODES['update']}'
        WHEN gold_escalate AND NOT predicted_escalate THEN '{lx.MODES['under']}'
        WHEN {pair('apps_feature_howto', 'other')} OR {pair('vague_complaint_unclear', 'other')} THEN '{lx.MODES['howto']}' ELSE '{lx.MODES['lexical']}' END"""


ERRORS = f"""{LABELLED},
drafted AS (SELECT *, {rules.sql_draft('predicted_intent', 'predicted_reason', "CAST(NULL AS VARCHAR)")} AS reply FROM labelled),
pairs AS (SELECT thread_id AS id, coalesce(brand_text, '') AS reference, reply AS hypothesis FROM drafted),
{_rouge(1)}, {_LCS},
scored AS (SELECT d.*, {_f1('rouges.precision', 'rouges.recall')} AS rouge_1, {_f1('longest.precision', 'longest.recall')} AS rouge_l, {_BLEU.replace('nh', 'rouges.nh').replace('nr', 'rouges.nr').replace('precision', 'rouges.precision')} AS bleu, gold_intent <> predicted_intent AS intent_error,
    CASE WHEN predicted_escalate AND NOT gold_escalate THEN 'false_positive' WHEN gold_escalate AND NOT predicted_escalate THEN 'false_negative' ELSE 'none' END AS escalate_error_type,
    {_mode()} AS failure_mode FROM drafted d JOIN rouges ON thread_id = rouges.id JOIN longest ON thread_id = longest.id),
records AS (SELECT * FROM scored WHERE intent_error OR escalate_error_type <> 'none' OR rouge_1 < 0.15)
"""

GOLD = f"""{BASE},
gold AS (SELECT pos, CASE WHEN pos % 37 = 5 THEN NULL WHEN pos % 41 = 7 THEN printf('conv_%05d', pos - 1) ELSE thread_id END AS thread_id,
    CASE WHEN pos % 43 <> 9 THEN CAST(pos AS VARCHAR) END AS customer_tweet_id, CASE WHEN pos % 47 = 8 THEN customer_text || '!' ELSE customer_text END AS customer_text, brand_text,
    CASE WHEN pos % 29 = 3 THEN NULL WHEN pos % 31 = 4 THEN 'bogus' ELSE gold_intent END AS intent, CASE WHEN pos % 23 <> 6 THEN gold_escalate END AS escalate,
    CASE WHEN pos % 19 = 2 THEN 'odd' WHEN pos % 17 = 1 THEN '' ELSE gold_reason END AS escalate_reason, CASE WHEN pos % 13 = 0 THEN '  ' ELSE 'seen' END AS notes FROM exchanges)
"""
_REASONS = ", ".join(f"'{x}'" for x in lx.REASONS)
_MANDATORY = ", ".join(f"'{x}'" for x in lx.MANDATORY)
_blank = "coalesce({0}, '') = ''".format
_row_rules = {
    "missing_id": _blank("thread_id"),
    **{f"missing_{f}": f"{f} IS NULL" for f in ("thread_id", "customer_tweet_id", "customer_text", "brand_text")},
    "missing_intent": _blank("intent"),
    "invalid_intent": f"NOT {_blank('intent')} AND intent NOT IN ({_LABELS})",
    "escalate_not_boolean": "escalate IS NULL",
    "reason_required": f"escalate AND {_blank('escalate_reason')}",
    "invalid_reason": f"escalate AND NOT {_blank('escalate_reason')} AND escalate_reason NOT IN ({_REASONS})",
    "reason_forbidden": f"NOT escalate AND NOT {_blank('escalate_reason')}",
}
_each = lambda rows, rules_: " UNION ALL ".join(
    f"SELECT pos, thread_id, '{name}' AS rule FROM {rows} WHERE {test}" for name, test in rules_.items()
)
_fidelity = {
    "not_in_source": "id_ IS NULL", "customer_text_differs": "id_ IS NOT NULL AND customer_text IS DISTINCT FROM c_",
    "brand_text_differs": "id_ IS NOT NULL AND brand_text IS DISTINCT FROM b_",
}
_SOURCED = ", sourced AS (SELECT g.*, e.thread_id AS id_, e.customer_text AS c_, e.brand_text AS b_ FROM gold g LEFT JOIN exchanges e ON g.thread_id = e.thread_id)"
_BARE = ", bare AS (SELECT pos, thread_id, CASE WHEN pos % 6 = 0 THEN intent END AS intent FROM gold WHERE pos % 2 = 0)"
_CACHED = """, cached AS (
    SELECT thread_id, pos, CASE WHEN pos % 5 <> 0 THEN predicted_intent ELSE '' END AS predicted_intent, 'reply' AS predicted_reply FROM labelled WHERE pos % 3 <> 0
    UNION ALL SELECT thread_id, pos + 1000000000, 'other', 'later' FROM labelled WHERE pos % 3 <> 0 AND pos % 7 = 0)"""

#: What the answers of base.ANSWERS give, worked out by hand.
_PARSED = "(VALUES (0, 'billing_purchases_subscriptions', 4, true), (1, 'fallback', 4, true), (2, 'fallback', NULL, NULL), (3, 'fallback', 5, true), (4, 'other', 3, false), (5, 'fallback', 3, false), (6, 'fallback', NULL, NULL), (7, 'fallback', 1, false)) AS v(i, intent, relevance, safe)"

_LANGUAGES = "[" + ", ".join(f"'{x}'" for x in ("en", "fr", "de", "es")) + "]"

SQL: dict[str, str] = {
    "thread_first_exchange": f"{BASE} SELECT thread_id, customer_text, brand_text, turn_count FROM exchanges",
    "reply_edges": """SELECT a.conv_id, a.turn, a.role, b.turn AS reply_turn, b.role AS reply_role FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    "turn_histogram": f"{BASE} SELECT turn_count, count(*) AS n FROM exchanges GROUP BY turn_count",
    "corpus_stats": f"""{BASE} SELECT count(*) AS threads, CAST(sum(turn_count) AS BIGINT) AS turns, round(avg(turn_count), 6) AS mean_turns, CAST(sum(inbound) AS BIGINT) AS inbound, CAST(sum(outbound) AS BIGINT) AS outbound,
        round(avg({tx.sql_word_count('customer_text')}), 6) AS mean_customer_words, round(avg({tx.sql_word_count('brand_text')}), 6) AS mean_brand_words, round(avg(CAST(brand_text IS NOT NULL AS INT)), 6) AS answered_share FROM exchanges""",
    "thread_turns_nested": "SELECT conv_id, string_agg(concat_ws(':', turn, role, length(text)), ',' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id",
    "region_tertiles": f"{SAMPLE} SELECT thread_id, region FROM regions",
    "weak_bucket": f"{SAMPLE} SELECT thread_id, bucket FROM bucketed",
    "round_robin_sample": f"{SAMPLE} SELECT thread_id, region, turn_type, bucket FROM sample",
    "strata_counts": f"{SAMPLE} SELECT region, turn_type, bucket, count(*) AS n FROM sample GROUP BY ALL",
    "corpus_minus_holdout": f"{BASE} SELECT thread_id, customer_text FROM exchanges WHERE NOT holdout",
    "leakage_check": f"{
        BASE
    } SELECT count(*) AS leaked FROM exchanges a WHERE NOT holdout AND EXISTS (SELECT 1 FROM exchanges b WHERE b.holdout AND a.thread_id = b.thread_id)",
    "sym_diff": f"{BASE} SELECT thread_id, CASE WHEN pos % 3 = 0 THEN 'left' ELSE 'right' END AS side FROM exchanges WHERE (pos % 3 = 0) <> (pos % 2 = 0)",
    "dup_ids": f"{GOLD} SELECT thread_id, count(*) AS n FROM gold WHERE thread_id IS NOT NULL GROUP BY thread_id HAVING count(*) > 1",
    "token_counts": f"SELECT doc_id, CAST(len({_ascii('text')}) AS BIGINT) AS n_tokens FROM documents",
    "unicode_tokens": f"SELECT doc_id, CAST(len({_unicode('text')}) AS BIGINT) AS n_tokens, CAST(len(list_distinct(regexp_extract_all(lower(text), {
        tx.quote(tx.LONG_WORD)
    }))) AS BIGINT) AS n_long_words FROM documents",
    "doc_freq": f"{BASE}, {CORPUS} {_index('bm25')} SELECT term, df FROM dfs",
    "tfidf_idf": f"{BASE}, {CORPUS} {_index('tfidf')} SELECT term, round(idf, 6) AS idf FROM idfs",
    "bm25_idf": f"{BASE}, {CORPUS} {_index('bm25')} SELECT term, round(idf, 6) AS idf FROM idfs",
    "doc_norms_tfidf": f"{BASE}, {CORPUS} {_index('tfidf')} SELECT doc_id, round(norm, 6) AS norm FROM norms",
    "doc_norms_bm25": f"{BASE}, {CORPUS} {_index('bm25')} SELECT doc_id, round(norm, 6) AS norm FROM norms",
    "tfidf_top1": f"{BASE}, {CORPUS} {_search('tfidf', 1)} {_HITS}",
    **dict.fromkeys(
        ["bm25_top3", "bm25_top3_by_bounds", "bm25_top3_unstored", "bm25_top3_extended"], f"{BASE}, {CORPUS} {_search('bm25', 3)} {_HITS}",
    ),
    "search_fallback": f"""{BASE}, {
        CORPUS.replace(
            "SELECT thread_id AS query_id, customer_text AS text",
            "SELECT thread_id AS query_id, CASE WHEN thread_id LIKE '%0' THEN '① éé' ELSE '' END AS text",
        )
    } {_search('bm25', 3)} {_HITS}""",
    "intent_rules": f"{LABELLED} SELECT thread_id, predicted_intent FROM labelled",
    "intent_distribution": f"{LABELLED} SELECT predicted_intent, count(*) AS n FROM labelled GROUP BY 1",
    "escalation_rules": f"{LABELLED} SELECT thread_id, predicted_escalate, predicted_reason FROM labelled",
    "triage_dm_signal": f"{LABELLED} SELECT thread_id, {
        rules.sql_triage('customer_text', 'predicted_intent', '((pos % 100) / 100.0)', 'brand_text')
    } AS reason FROM labelled",
    "draft_reply": f"{LABELLED} SELECT thread_id, {rules.sql_draft('predicted_intent', 'predicted_reason', 'brand_text')} AS reply FROM labelled",
    "weak_labels": f"""{BASE}, rows_ AS (SELECT *, CASE WHEN pos % 4 = 0 THEN gold_intent END AS intent, CASE WHEN pos % 8 = 0 THEN gold_escalate END AS escalate, CASE WHEN pos % 8 = 0 THEN gold_reason END AS escalate_reason FROM exchanges)
        SELECT thread_id, weak_intent, weak_escalate, weak_reason FROM ({rules.sql_weak_labels('rows_')})""",
    "agent_pipeline": f"""{LABELLED}, {ANSWERED} {_search('bm25', 3)}, {_AGENT}, decided AS (SELECT *, {rules.sql_triage('customer_text', 'predicted_intent', 'retrieval_score', 'reply')} AS reason FROM held)
        SELECT thread_id, predicted_intent, reason IS NOT NULL AS predicted_escalate, reason AS predicted_reason, {rules.sql_draft('predicted_intent', 'reason', 'reply')} AS predicted_reply, retrieved_thread_id, coalesce(round(retrieval_score, 6), 0) AS retrieval_score FROM decided""",
    "simple_agent": f"""{LABELLED}, {ANSWERED} {_search('tfidf', 1)}, {_AGENT}
        SELECT thread_id, predicted_intent, predicted_reason IS NOT NULL AS predicted_escalate, predicted_reason, CASE WHEN retrieved_thread_id IS NULL THEN {tx.quote(lx.CANNED_REPLY)} ELSE reply END AS predicted_reply, retrieved_thread_id, coalesce(round(retrieval_score, 6), 0) AS retrieval_score FROM held""",
    "trivial_agent": f"""{BASE}, counts AS (SELECT gold_intent, count(*) AS n, min(pos) AS p FROM exchanges GROUP BY 1), yes AS (SELECT gold_escalate, count(*) AS n, min(pos) AS p FROM exchanges GROUP BY 1),
        why AS (SELECT gold_reason, count(*) AS n, min(pos) AS p FROM exchanges WHERE gold_reason IS NOT NULL GROUP BY 1),
        model AS (SELECT (SELECT gold_intent FROM counts ORDER BY n DESC, p LIMIT 1) AS i, (SELECT gold_escalate FROM yes ORDER BY n DESC, p LIMIT 1) AS e, (SELECT gold_reason FROM why ORDER BY n DESC, p LIMIT 1) AS r)
        SELECT thread_id, i AS predicted_intent, e AS predicted_escalate, CASE WHEN e THEN r END AS predicted_reason, {tx.quote(lx.CANNED_REPLY)} AS predicted_reply FROM exchanges, model""",
    "majority_intent": f"""{BASE}, counts AS (SELECT gold_intent, count(*) AS n, min(pos) AS p FROM exchanges GROUP BY 1)
        SELECT thread_id, (SELECT gold_intent FROM counts ORDER BY n DESC, p LIMIT 1) AS predicted_intent, false AS predicted_escalate FROM exchanges""",
    "always_escalate": f"{BASE} SELECT thread_id, 'other' AS predicted_intent, true AS predicted_escalate FROM exchanges",
    "confusion_matrix": f"{LABELLED}, {CELLS} SELECT actual, predicted, CAST(n AS BIGINT) AS n FROM cells",
    "per_class_prf": f"{LABELLED}, {CELLS} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM scores",
    "multiclass_summary": f"{LABELLED}, {CELLS} SELECT (SELECT round(avg(CAST(gold_intent = predicted_intent AS INT)), 6) FROM labelled) AS accuracy, round(avg(f1), 6) AS macro_f1, round({
        _ratio('sum(round(f1, 4) * support)', 'sum(support)')
    }, 6) AS weighted_f1 FROM scores",
    "label_set": f"{LABELLED} SELECT gold_intent AS label FROM labelled UNION SELECT predicted_intent FROM labelled",
    "language_labels": f"""WITH low AS (SELECT lang, ' ' || lower(text) || ' ' AS t FROM documents), said AS (SELECT lang AS actual, CASE WHEN contains(t, ' der ') THEN 'de' WHEN contains(t, ' le ') THEN 'fr' WHEN contains(t, ' los ') THEN 'es' ELSE 'en' END AS predicted FROM low),
        sums AS (SELECT label, count(*) FILTER (actual = label AND predicted = label) AS r, count(*) FILTER (predicted = label) AS p, count(*) FILTER (actual = label) AS support FROM (SELECT unnest({_LANGUAGES}) AS label) LEFT JOIN said ON actual = label OR predicted = label
            WHERE actual IS NULL OR (list_contains({_LANGUAGES}, actual) AND list_contains({_LANGUAGES}, predicted)) GROUP BY label),
        classes AS (SELECT label, {_ratio('r', 'p')} AS precision, {_ratio('r', 'support')} AS recall, support FROM sums)
        SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round({_f1('precision', 'recall')}, 6) AS f1, support FROM classes""",
    "binary_escalation": f"""{LABELLED}, {_BINARY}, parts AS (SELECT *, {_ratio('tp + tn', 'total')} AS accuracy, {_ratio('tp', 'tp + fp')} AS precision, {_ratio('tp', 'tp + fn')} AS recall FROM cells)
        SELECT tp, fp, tn, fn, total, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round({_f1('precision', 'recall')}, 6) AS f1 FROM parts""",
    "escalation_d1_d2": f"""{LABELLED}, wide AS (SELECT 'D1' AS target, gold_escalate AS a, predicted_escalate AS p FROM labelled UNION ALL
            SELECT 'D2', gold_escalate AND coalesce(gold_reason IN ({_SAFETY}), false), predicted_escalate AND coalesce(predicted_reason IN ({_SAFETY}), false) FROM labelled),
        cells AS (SELECT target, count(*) FILTER (a AND p) AS tp, count(*) FILTER (NOT a AND p) AS fp, count(*) FILTER (NOT a AND NOT p) AS tn, count(*) FILTER (a AND NOT p) AS fn FROM wide GROUP BY target)
        SELECT *, round({_ratio('tp', 'tp + fp')}, 6) AS precision, round({_ratio('tp', 'tp + fn')}, 6) AS recall FROM cells""",
    "wilson_ci": f"""{LABELLED}, {_BINARY}, x AS (SELECT CAST(total AS DOUBLE) AS n, CAST(tp + tn AS DOUBLE) / total AS q FROM cells),
        y AS (SELECT q, (q + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) AS c, 1.96 * sqrt(q * (1 - q) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n) AS d FROM x)
        SELECT round(q, 6) AS accuracy, round(greatest(c - d, 0), 6) AS low, round(least(c + d, 1), 6) AS high FROM y""",
    "deflection_soft_dm": f"""{LABELLED}, drafted AS (SELECT *, {rules.sql_draft('predicted_intent', 'predicted_reason', 'brand_text')} AS reply FROM labelled)
        SELECT round({_ratio('count(*) FILTER (NOT gold_escalate AND NOT predicted_escalate)', 'count(*) FILTER (NOT gold_escalate)')}, 6) AS deflection,
            round({_ratio("count(*) FILTER (NOT predicted_escalate AND contains(lower(reply), 'dm'))", 'count(*) FILTER (NOT predicted_escalate)')}, 6) AS soft_dm FROM drafted""",
    "rouge1": f"{BASE}, {PAIRS}, {_rouge(1)} {_ROUGE_OUT}",
    "rouge2": f"{BASE}, {PAIRS}, {_rouge(2)} {_ROUGE_OUT}",
    "bleu1": f"{BASE}, {PAIRS}, {_rouge(1)} SELECT id, round({_BLEU}, 6) AS bleu FROM rouges",
    "rouge_l": f"{BASE}, {PAIRS}, {_rouge(1)}, {_LCS} SELECT id, lcs, round(precision, 6) AS precision, round(recall, 6) AS recall, round({
        _f1('precision', 'recall')
    }, 6) AS f1 FROM longest",
    "reply_metrics": f"""{BASE}, {PAIRS}, {_rouge(1)}, {_rouge(2, '2')}, {_LCS}
        SELECT round(avg({_f1('a.precision', 'a.recall')}), 6) AS rouge_1, round(avg({_f1('b.precision', 'b.recall')}), 6) AS rouge_2, round(avg({_f1('l.precision', 'l.recall')}), 6) AS rouge_l,
            round(avg({_BLEU.replace('nh', 'a.nh').replace('nr', 'a.nr').replace('precision', 'a.precision')}), 6) AS bleu, round(avg(length(hypothesis)), 6) AS mean_chars, round(avg(a.nh), 6) AS mean_tokens, count(*) AS pairs
        FROM rouges a JOIN rouges2 b USING (id) JOIN longest l USING (id) JOIN pairs USING (id)""",
    "pearson": f"{RATINGS} SELECT dimension, round({_pearson('t', 'p')}, 6) AS pearson FROM ratings GROUP BY dimension",
    "spearman": f"{RATINGS}, {_ranked('dimension')} SELECT dimension, round({_pearson('rt', 'rp')}, 6) AS spearman FROM ranks GROUP BY dimension",
    "qwk": f"{RATINGS} SELECT dimension, round({_KAPPA}, 6) AS kappa FROM ratings GROUP BY dimension",
    "agreement_report": f"""{RATINGS}, {_ranked('dimension, lang')} SELECT dimension, lang, count(*) AS n, round({_pearson('t', 'p')}, 6) AS pearson, round({_KAPPA}, 6) AS kappa, round(avg(CAST(t = p AS INT)), 6) AS exact,
        round(avg(CAST(abs(t - p) <= 1 AS INT)), 6) AS within_one, round(avg(abs(t - p)), 6) AS mae, round({_pearson('rt', 'rp')}, 6) AS spearman FROM ranks GROUP BY dimension, lang""",
    "safety_agreement": "SELECT round(coalesce(avg(CAST(quality = toxic AS INT)), 0), 6) AS agreement FROM labels",
    "judge_heuristic": f"""{LABELLED}, rows_ AS (SELECT *, brand_text AS reply, predicted_escalate AS escalate FROM labelled WHERE brand_text IS NOT NULL)
        SELECT thread_id, relevance, tone, actionability, safe, overall FROM ({jd.sql_judge('rows_')})""",
    "llm_json_parse": f"{BASE} SELECT thread_id, intent, CAST(relevance AS INT) AS relevance, safe FROM exchanges JOIN {_PARSED} ON pos % {
        len(base.ANSWERS)
    } = i",
    "error_records": f"{
        ERRORS
    } SELECT thread_id, intent_error, escalate_error_type, failure_mode, round(rouge_1, 6) AS rouge_1, round(rouge_l, 6) AS rouge_l, round(bleu, 6) AS bleu FROM records",
    "error_roll_up": f"""{ERRORS}, found AS (SELECT count(*) AS errors, count(*) FILTER (intent_error) AS intent_errors, count(*) FILTER (escalate_error_type <> 'none') AS escalation_errors, count(*) FILTER (escalate_error_type = 'false_positive') AS false_positives,
            count(*) FILTER (escalate_error_type = 'false_negative') AS false_negatives FROM records), n AS (SELECT count(*) AS total FROM scored)
        SELECT *, round(errors / total, 6) AS errors_share, round(intent_errors / total, 6) AS intent_errors_share, round(escalation_errors / total, 6) AS escalation_errors_share FROM n, found""",
    "failure_modes": f"{ERRORS} SELECT failure_mode, count(*) AS n FROM records GROUP BY 1",
    "top_confusion_pairs": f"{
        LABELLED
    } SELECT gold_intent, predicted_intent, count(*) AS n, min(pos) AS first_pos FROM labelled WHERE gold_intent <> predicted_intent GROUP BY 1, 2 ORDER BY n DESC, first_pos LIMIT 10",
    "error_samples": f"{
        ERRORS
    } SELECT failure_mode, thread_id FROM (SELECT *, row_number() OVER (PARTITION BY failure_mode ORDER BY pos) AS i FROM records) WHERE i <= 2",
    "validation_violations": f"""{GOLD}, two AS (SELECT coalesce(g.pos, e.pos) AS pos, coalesce(g.thread_id, e.thread_id) AS thread_id FROM gold g FULL JOIN exchanges e ON g.pos = e.pos WHERE g.thread_id IS DISTINCT FROM e.thread_id)
        {_each('gold', _row_rules)} UNION ALL SELECT NULL, thread_id, 'duplicate_id' FROM gold WHERE NOT {_blank('thread_id')} GROUP BY thread_id HAVING count(*) > 1
        UNION ALL SELECT NULL, NULL, 'record_count' FROM (SELECT count(*) AS n FROM gold) WHERE n <> 200 UNION ALL SELECT NULL, NULL, 'holdout_count' FROM (SELECT count(*) AS n FROM exchanges) WHERE n <> 200
        UNION ALL SELECT pos, thread_id, 'holdout_order' FROM two""",
    "mandatory_escalation_audit": f"""{GOLD} {_SOURCED} {_BARE}
        {_each('sourced', {'mandatory_escalation': f'intent IN ({_MANDATORY}) AND NOT coalesce(escalate, false)', 'missing_notes': "coalesce(trim(notes), '') = ''", **_fidelity})} UNION ALL {_each('bare', {'labelled_intent': 'intent IS NOT NULL'})}""",
    "source_fidelity": f"{GOLD} {_SOURCED} {_each('sourced', _fidelity)}",
    "validation_summary": f"{
        GOLD
    } SELECT count(*) AS records, count(DISTINCT thread_id) AS unique_ids, string_agg(DISTINCT intent, ',' ORDER BY intent) AS intents FROM gold",
    "holdout_order": f"{
        GOLD
    } SELECT coalesce(g.pos, e.pos) AS pos, g.thread_id AS left_id, e.thread_id AS right_id FROM gold g FULL JOIN exchanges e ON g.pos = e.pos WHERE g.thread_id IS DISTINCT FROM e.thread_id",
    "replay_join": f"{
        LABELLED
    } {_CACHED}, latest AS (SELECT thread_id, arg_max(predicted_intent, pos) AS predicted_intent, arg_max(predicted_reply, pos) AS predicted_reply FROM cached GROUP BY 1) SELECT e.thread_id, gold_intent, predicted_intent, predicted_reply FROM exchanges e LEFT JOIN latest USING (thread_id)",
    "resume_pending": f"{
        LABELLED
    } {_CACHED} SELECT thread_id FROM exchanges WHERE thread_id NOT IN (SELECT thread_id FROM cached WHERE predicted_intent <> '' AND predicted_reply <> '')",
    **dict.fromkeys(
        ["running_accuracy", "running_accuracy_stream"],
        f"{LABELLED} SELECT thread_id, round(avg(CAST(gold_intent = predicted_intent AS INT)) OVER (ORDER BY pos), 6) AS accuracy FROM labelled",
    ),
}
