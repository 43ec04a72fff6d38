"""Support agents as plans: label, search, decide, draft; and the plain baselines."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import lexicon as lx
from parley.operators import assisted, metrics, rules, search
from parley.operators.assisted import Providers
from parley.operators.index import SearchIndex
from parley.session import kept


def searchable(corpus: DataFrame) -> DataFrame:
    """The corpus as search takes it; an index for the agents is made of this."""
    return corpus.select(F.col("thread_id").alias("doc_id"), "pos", F.col("customer_text").alias("text"))


#: Bits for each key of the filter that tells which texts may have been found, and at most: 512 KB.
EACH, BITS = 64, 1 << 22


def likely(key: Column, of: DataFrame, name: str) -> Column:
    """True for every key that column `name` of `of` has, and for some others: as many as share a hash with one of them.

    One array of bounded size, so rows without a partner needn't be shuffled for a join. `of` is counted for that at once.
    """
    bits = min(BITS, EACH * max(of.count(), 64))
    bit = lambda x: F.pmod(F.xxhash64(x), F.lit(bits))
    word = lambda x: F.floor(x / 64).cast("int")
    set_ = of.select(bit(F.col(name)).alias("_bit")).select(word(F.col("_bit")).alias("_word"), F.expr("shiftleft(1L, cast(_bit % 64 as int))").alias("_set"))
    none = of.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("_word"), F.lit(0).cast("long").alias("_set"))
    words = set_.unionByName(none).groupBy("_word").agg(F.bit_or("_set").alias("_set"))
    # At most so many rows as the array has words.
    array = words.agg(F.array_sort(F.collect_list(F.struct("_word", "_set"))).alias("_all")).select(F.col("_all._set"))
    return F.getbit(F.get(array.scalar(), word(bit(key))), (bit(key) % 64).cast("int")) == 1


def full(
    inquiries: DataFrame, corpus: DataFrame, k: int = 3, providers: Providers = None, pace: float = 0.0, index: SearchIndex | None = None,
    candidates: bool = True,
) -> DataFrame:
    """inquiries (thread_id, customer_text) with predicted_intent, predicted_escalate, predicted_reason, predicted_reply,
    retrieved_thread_id, retrieval_score and the candidates. corpus: thread_id, pos, customer_text, brand_text.
    With providers, a language model labels and drafts; the rules answer where it doesn't. index: a stored BM25 index of
    searchable(corpus), so that only the texts that were found are read. candidates: whether the column is there. Without it what was
    found is written at once (parley.session.kept), and only the reply of the best, with which the rules decide and draft, is fetched.
    """
    asked = inquiries.select(F.col("thread_id").alias("query_id"), F.col("customer_text").alias("text"))
    hits = search.search(asked, index or searchable(corpus), k, "bm25")
    # Texts join only what was found.
    hits = hits if candidates else kept(hits.where("rank = 1"))
    texts = corpus.select(F.col("thread_id").alias("doc_id"), F.col("customer_text").alias("_c"), F.col("brand_text").alias("_b"))
    found = hits.join(texts if candidates else texts.where(likely(F.col("doc_id"), hits, "doc_id")), "doc_id")
    listed = F.array_sort(
        F.collect_list(
            F.struct(
                "rank", F.col("doc_id").alias("thread_id"), F.col("_c").alias("customer_text"), F.col("_b").alias("brand_text"),
                F.round("score", 4).alias("score"),
            )
        )
    )
    if candidates:
        best = found.groupBy(F.col("query_id").alias("thread_id")).agg(listed.alias("candidates"))
        rows = inquiries.join(best, "thread_id", "left").withColumn("_top", F.get("candidates", F.lit(0)))
    else:
        top = F.struct(F.col("doc_id").alias("thread_id"), F.col("_b").alias("brand_text"), F.round("score", 4).alias("score"))
        rows = inquiries.join(found.select(F.col("query_id").alias("thread_id"), top.alias("_top")), "thread_id", "left")
    label, reason = F.col("predicted_intent"), F.col("predicted_reason")
    rows = assisted.classify(rows, providers, pace) if providers else rows.withColumn("predicted_intent", rules.intent(F.col("customer_text")))
    rows = rows.withColumn("predicted_reason", rules.triage_reason(F.col("customer_text"), label, F.col("_top.score"), F.col("_top.brand_text")))
    rows = rows.withColumn("predicted_escalate", reason.isNotNull())
    if providers:
        rows = assisted.draft(rows.withColumn("top_reply", F.col("_top.brand_text")), providers, pace).drop("top_reply")
    else:
        rows = rows.withColumn("predicted_reply", rules.draft(label, reason, F.col("_top.brand_text")))
    return rows.withColumn("retrieved_thread_id", F.col("_top.thread_id")).withColumn("retrieval_score", F.coalesce("_top.score", F.lit(0.0))).drop("_top")


def simple(inquiries: DataFrame, corpus: DataFrame, index: SearchIndex | None = None) -> DataFrame:
    """Rules, and the brand's text of the best TF-IDF match as it is; the canned reply for an empty corpus. index: a stored TF-IDF one."""
    asked = inquiries.select(F.col("thread_id").alias("query_id"), F.col("customer_text").alias("text"))
    hits = search.search(asked, index or searchable(corpus), 1, "tfidf")
    best = hits.join(corpus.select(F.col("thread_id").alias("doc_id"), F.col("brand_text").alias("_b")), "doc_id").select(
        F.col("query_id").alias("thread_id"), F.col("doc_id").alias("retrieved_thread_id"), F.round("score", 4).alias("retrieval_score"),
        "_b",
    )
    label = rules.intent(F.col("customer_text"))
    rows = inquiries.join(best, "thread_id", "left").withColumn("predicted_intent", label)
    rows = rows.withColumn("predicted_reason", rules.escalation_reason(F.col("customer_text"), F.col("predicted_intent")))
    reply = F.when(F.col("retrieved_thread_id").isNull(), F.lit(lx.CANNED_REPLY)).otherwise(F.col("_b"))
    return rows.withColumns(
        {"predicted_escalate": F.col("predicted_reason").isNotNull(), "predicted_reply": reply, "retrieval_score": F.coalesce("retrieval_score", F.lit(0.0))}
    ).drop("_b")


def trivial(inquiries: DataFrame, gold: DataFrame) -> DataFrame:
    """The most frequent label, decision and reason of gold (pos, intent, escalate, escalate_reason) for all, and the canned reply."""
    reason = gold.where(F.coalesce("escalate_reason", F.lit("")) != "")
    model = metrics.majority(gold, "intent", "pos").join(F.broadcast(metrics.majority(gold, "escalate", "pos"))).join(
        F.broadcast(metrics.majority(reason, "escalate_reason", "pos"))
    )
    named = model.select(
        F.coalesce("intent", F.lit("other")).alias("predicted_intent"), F.coalesce("escalate", F.lit(True)).alias("predicted_escalate"),
        F.col("escalate_reason").alias("_r"),
    )
    decided = named.withColumn("predicted_reason", F.when(F.col("predicted_escalate"), F.coalesce("_r", F.lit("channel_transition")))).drop("_r")
    # One row: its size doesn't depend on the data.
    return inquiries.join(F.broadcast(decided)).withColumn("predicted_reply", F.lit(lx.CANNED_REPLY))


def majority_intent(inquiries: DataFrame, gold: DataFrame) -> DataFrame:
    model = metrics.majority(gold, "intent", "pos").select(F.coalesce("intent", F.lit("other")).alias("predicted_intent"))
    return inquiries.join(F.broadcast(model)).withColumn("predicted_escalate", F.lit(False))


def always_escalate(inquiries: DataFrame) -> DataFrame:
    return inquiries.withColumns({"predicted_intent": F.lit("other"), "predicted_escalate": F.lit(True)})


def targets(rows: DataFrame) -> DataFrame:
    """For the two escalation targets: D1 all escalations, D2 those for safety; rows with actual, predicted and target."""
    wide = F.explode(
        F.array(
            _target("D1", F.col("gold_escalate"), F.col("predicted_escalate")),
            _target(
                "D2", F.col("gold_escalate") & F.coalesce(F.col("gold_reason").isin(lx.SAFETY_REASONS), F.lit(False)),
                F.col("predicted_escalate") & F.coalesce(F.col("predicted_reason").isin(lx.SAFETY_REASONS), F.lit(False)),
            ),
        )
    )
    return rows.select(wide.alias("_t")).select("_t.*")


def _target(name: str, actual: Column, predicted: Column) -> Column:
    return F.struct(F.lit(name).alias("target"), actual.alias("actual"), predicted.alias("predicted"))


def hand_over_rates(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """One row: deflection, the share kept by the agent of what needed no person, and soft_dm, the share of kept ones whose reply still names a private message."""
    kept, soft = ~F.col("predicted_escalate"), F.lower(reply).contains("dm")
    return rows.agg(
        metrics.ratio(F.count_if(~F.col("gold_escalate") & kept), F.count_if(~F.col("gold_escalate"))).alias("deflection"),
        metrics.ratio(F.count_if(kept & soft), F.count_if(kept)).alias("soft_dm"),
    )
