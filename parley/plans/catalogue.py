"""The registered queries: each of the package's operators on the test tables."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import lexicon as lx
from parley.functions import text as tx
from parley.operators import agents, errors, metrics, rules, sampling, search, windows
from parley.operators import judge as jd
from parley.operators import threads as th
from parley.operators.index import SearchIndex
from parley.plans import base
from parley.session import share_code, shared_dir
from parley.sources import files
from parley.streaming import running

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[make.__name__] = make
    return make


def _rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c in columns})


# Threads.


@query
def thread_first_exchange(spark, sf_dir):
    return base.exchanges(spark, sf_dir).select("thread_id", "customer_text", "brand_text", "turn_count")


@query
def reply_edges(spark, sf_dir):
    return th.reply_edges(base.table(spark, sf_dir, "conversations"))


@query
def turn_histogram(spark, sf_dir):
    return th.turn_histogram(base.exchanges(spark, sf_dir))


@query
def corpus_stats(spark, sf_dir):
    return _rounded(th.corpus_stats(base.exchanges(spark, sf_dir)), "mean_turns", "mean_customer_words", "mean_brand_words", "answered_share")


@query
def thread_turns_nested(spark, sf_dir):
    said = F.array_join(F.transform("turns", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"], F.char_length(x["text"]).cast("string"))), ",")
    return th.nested(base.table(spark, sf_dir, "conversations")).select("conv_id", said.alias("turns"))


# Sampling and set operations.


def _bucketed(spark, sf_dir):
    rows = base.exchanges(spark, sf_dir).withColumn("bucket", rules.weak_bucket(F.col("customer_text")))
    return sampling.regions(rows, "pos")


def _sample(spark, sf_dir):
    order = F.array_position(F.array(*map(F.lit, [*lx.BUCKETS, lx.GENERAL_BUCKET])), F.col("bucket"))
    return sampling.round_robin(_bucketed(spark, sf_dir), F.struct((F.col("pos") * 7919) % 1009, "pos"), order)


@query
def region_tertiles(spark, sf_dir):
    return sampling.regions(base.exchanges(spark, sf_dir), "pos").select("thread_id", "region")


@query
def weak_bucket(spark, sf_dir):
    return base.exchanges(spark, sf_dir).select("thread_id", rules.weak_bucket(F.col("customer_text")).alias("bucket"))


@query
def round_robin_sample(spark, sf_dir):
    return _sample(spark, sf_dir).select("thread_id", "region", "turn_type", "bucket")


@query
def strata_counts(spark, sf_dir):
    return sampling.strata(_sample(spark, sf_dir))


def _holdout(rows):
    return rows.where("holdout").select("thread_id")


@query
def corpus_minus_holdout(spark, sf_dir):
    rows = base.exchanges(spark, sf_dir)
    return sampling.corpus_minus_holdout(rows, _holdout(rows)).select("thread_id", "customer_text")


@query
def leakage_check(spark, sf_dir):
    rows = base.exchanges(spark, sf_dir)
    return sampling.leaked(sampling.corpus_minus_holdout(rows, _holdout(rows)), _holdout(rows)).agg(F.count(F.lit(1)).alias("leaked"))


@query
def sym_diff(spark, sf_dir):
    rows = base.exchanges(spark, sf_dir)
    return sampling.symmetric_difference(rows.where("pos % 3 = 0"), rows.where("pos % 2 = 0"))


@query
def dup_ids(spark, sf_dir):
    return sampling.duplicates(_gold(spark, sf_dir).where("thread_id is not null"))


# Tokens and search.


@query
def token_counts(spark, sf_dir):
    return base.table(spark, sf_dir, "documents").select("doc_id", F.size(tx.ascii_tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query
def unicode_tokens(spark, sf_dir):
    tokens = tx.word_tokens(F.col("text"))
    return base.table(spark, sf_dir, "documents").select(
        "doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.size(tx.long_words(F.col("text"))).cast("long").alias("n_long_words"),
    )


def _corpus(spark, sf_dir):
    rows = base.exchanges(spark, sf_dir)
    return rows.where("not holdout").select(F.col("thread_id").alias("doc_id"), "pos", F.col("customer_text").alias("text"))


def _asked(spark, sf_dir):
    rows = base.exchanges(spark, sf_dir)
    return rows.where("holdout").select(F.col("thread_id").alias("query_id"), F.col("customer_text").alias("text"))


@query
def doc_freq(spark, sf_dir):
    return search.document_frequency(_corpus(spark, sf_dir))


@query
def tfidf_idf(spark, sf_dir):
    return _rounded(search.inverse_frequency(_corpus(spark, sf_dir), "tfidf"), "idf")


@query
def bm25_idf(spark, sf_dir):
    return _rounded(search.inverse_frequency(_corpus(spark, sf_dir), "bm25"), "idf")


@query
def doc_norms_tfidf(spark, sf_dir):
    return _rounded(search.norms(_corpus(spark, sf_dir), "tfidf"), "norm")


@query
def doc_norms_bm25(spark, sf_dir):
    return _rounded(search.norms(_corpus(spark, sf_dir), "bm25"), "norm")


_INDEXES: dict[tuple, SearchIndex] = {}


def stored(corpus: DataFrame, scheme: str, name: str) -> SearchIndex:
    """The index of a corpus (doc_id, pos, text), built the first time that a session asks for it. name tells corpora of the same files apart."""
    spark = corpus.sparkSession
    key = spark.sparkContext.applicationId, name, scheme, files.version(corpus)
    if key not in _INDEXES:
        _INDEXES[key] = SearchIndex.build(corpus, f"{shared_dir(spark)}/search-{uuid.uuid4().hex}", scheme)
    return _INDEXES[key]


@query
def tfidf_top1(spark, sf_dir):
    return _rounded(search.search(_asked(spark, sf_dir), stored(_corpus(spark, sf_dir), "tfidf", "all"), 1, "tfidf"), "score")


@query
def bm25_top3(spark, sf_dir):
    return _rounded(search.search(_asked(spark, sf_dir), stored(_corpus(spark, sf_dir), "bm25", "all"), 3, "bm25"), "score")


@query
def bm25_top3_by_bounds(spark, sf_dir):
    """By blocks and bounds, however common the terms are."""
    return _rounded(stored(_corpus(spark, sf_dir), "bm25", "all").search(_asked(spark, sf_dir), 3, bounded=True), "score")


@query
def bm25_top3_unstored(spark, sf_dir):
    """Without an index, in one plan after a count of the queries."""
    return _rounded(search.search(_asked(spark, sf_dir), _corpus(spark, sf_dir), 3, "bm25"), "score")


@query
def bm25_top3_extended(spark, sf_dir):
    """An index of a third of the corpus, to which the rest is added. A ninth of the third has its texts backwards at first, and the delta replaces them.
    Numbers are the ids meanwhile."""
    rows = _by_number(base.exchanges(spark, sf_dir))
    corpus = agents.searchable(rows.where("not holdout"))
    # Multiples of ten are held out, so what is replaced is among others.
    wrong = F.when(F.col("pos") % 30 == 3, F.reverse("text")).otherwise(F.col("text"))
    first = SearchIndex.build(corpus.where("pos % 3 = 0").withColumn("text", wrong), f"{shared_dir(spark)}/search-{uuid.uuid4().hex}", "bm25")
    whole = first.add(corpus.where("pos % 3 > 0 or pos % 30 = 3"))
    first.drop()
    hits = search.search(rows.where("holdout").select(F.col("thread_id").alias("query_id"), F.col("customer_text").alias("text")), whole, 3, "bm25")
    return _rounded(hits.withColumns({c: base.thread_id(F.col(c)) for c in ("query_id", "doc_id")}), "score")


@query
def search_fallback(spark, sf_dir):
    lost = F.when(F.col("query_id").endswith("0"), "① éé").otherwise("")
    return _rounded(search.search(_asked(spark, sf_dir).withColumn("text", lost), _corpus(spark, sf_dir), 3, "bm25"), "score")


# Rules and agents.


def _labelled(spark, sf_dir):
    rows = base.exchanges(spark, sf_dir).withColumn("predicted_intent", rules.intent(F.col("customer_text")))
    rows = rows.withColumn("predicted_reason", rules.escalation_reason(F.col("customer_text"), F.col("predicted_intent")))
    return rows.withColumn("predicted_escalate", F.col("predicted_reason").isNotNull())


@query
def intent_rules(spark, sf_dir):
    return _labelled(spark, sf_dir).select("thread_id", "predicted_intent")


@query
def intent_distribution(spark, sf_dir):
    return _labelled(spark, sf_dir).groupBy("predicted_intent").agg(F.count(F.lit(1)).alias("n"))


@query
def escalation_rules(spark, sf_dir):
    return _labelled(spark, sf_dir).select("thread_id", "predicted_escalate", "predicted_reason")


def _past(rows):
    return rows.where("answered").select("thread_id", "pos", "customer_text", "brand_text")


@query
def triage_dm_signal(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    score = (F.col("pos") % 100) / 100
    return rows.select(
        "thread_id",
        rules.triage_reason(F.col("customer_text"), F.col("predicted_intent"), score, F.coalesce("brand_text", F.lit(""))).alias("reason"),
    )


@query
def draft_reply(spark, sf_dir):
    return _labelled(spark, sf_dir).select("thread_id", rules.draft(F.col("predicted_intent"), F.col("predicted_reason"), F.col("brand_text")).alias("reply"))


@query
def weak_labels(spark, sf_dir):
    rows = base.exchanges(spark, sf_dir).withColumns(
        {
            "intent": F.when(F.col("pos") % 4 == 0, F.col("gold_intent")),
            "escalate": F.when(F.col("pos") % 8 == 0, F.col("gold_escalate")),
            "escalate_reason": F.when(F.col("pos") % 8 == 0, F.col("gold_reason")),
        }
    )
    return rules.weak_labels(rows).select("thread_id", "weak_intent", "weak_escalate", "weak_reason")


def _by_number(rows):
    """The exchanges with their numbers as ids: what was found meets its texts where their conversations were put together."""
    return rows.withColumn("thread_id", F.col("pos"))


def _answers(made):
    names = {c: base.thread_id(F.col(c)) for c in ("thread_id", "retrieved_thread_id")}
    named = made.withColumns({c: F.when(F.col(c).isNotNull(), x) for c, x in names.items()})
    return _rounded(
        named.select("thread_id", "predicted_intent", "predicted_escalate", "predicted_reason", "predicted_reply", "retrieved_thread_id", "retrieval_score"),
        "retrieval_score",
    )


@query
def agent_pipeline(spark, sf_dir):
    rows = _by_number(base.exchanges(spark, sf_dir, answered=True))
    past = _past(rows.where("not holdout"))
    index = stored(agents.searchable(past), "bm25", "answered")
    return _answers(agents.full(rows.where("holdout").select("thread_id", "customer_text"), past, index=index, candidates=False))


@query
def simple_agent(spark, sf_dir):
    rows = _by_number(base.exchanges(spark, sf_dir, answered=True))
    past = _past(rows.where("not holdout"))
    return _answers(agents.simple(rows.where("holdout").select("thread_id", "customer_text"), past, stored(agents.searchable(past), "tfidf", "answered")))


def _fitted(rows):
    return rows.select("pos", F.col("gold_intent").alias("intent"), F.col("gold_escalate").alias("escalate"), F.col("gold_reason").alias("escalate_reason"))


@query
def trivial_agent(spark, sf_dir):
    rows = base.exchanges(spark, sf_dir)
    return agents.trivial(rows.select("thread_id"), _fitted(rows))


@query
def majority_intent(spark, sf_dir):
    rows = base.exchanges(spark, sf_dir)
    return agents.majority_intent(rows.select("thread_id"), _fitted(rows))


@query
def always_escalate(spark, sf_dir):
    return agents.always_escalate(base.exchanges(spark, sf_dir).select("thread_id"))


# Metrics.


def _classes(spark, sf_dir):
    return _labelled(spark, sf_dir).select(F.col("gold_intent").alias("actual"), F.col("predicted_intent").alias("predicted"))


def _decisions(spark, sf_dir):
    return _labelled(spark, sf_dir).select(F.col("gold_escalate").alias("actual"), F.col("predicted_escalate").alias("predicted"))


@query
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_classes(spark, sf_dir), lx.LABELS)


@query
def per_class_prf(spark, sf_dir):
    return _rounded(metrics.per_class(_classes(spark, sf_dir), lx.LABELS), "precision", "recall", "f1")


@query
def multiclass_summary(spark, sf_dir):
    return _rounded(metrics.multiclass(_classes(spark, sf_dir), lx.LABELS), "accuracy", "macro_f1", "weighted_f1")


@query
def label_set(spark, sf_dir):
    return metrics.label_set(_classes(spark, sf_dir))


@query
def language_labels(spark, sf_dir):
    """Labels of documents against a rule on frequent words."""
    low = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    said = F.when(low.contains(" der "), "de").when(low.contains(" le "), "fr").when(low.contains(" los "), "es").otherwise("en")
    rows = base.table(spark, sf_dir, "documents").select(F.col("lang").alias("actual"), said.alias("predicted"))
    return _rounded(metrics.per_class(rows, ["en", "fr", "de", "es"]), "precision", "recall", "f1")


@query
def binary_escalation(spark, sf_dir):
    return _rounded(metrics.binary(_decisions(spark, sf_dir)), "accuracy", "precision", "recall", "f1")


@query
def escalation_d1_d2(spark, sf_dir):
    rows = agents.targets(_labelled(spark, sf_dir))
    a, p = F.col("actual"), F.col("predicted")
    cells = rows.groupBy("target").agg(
        F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(~a & ~p).alias("tn"), F.count_if(a & ~p).alias("fn"),
    )
    return _rounded(
        cells.withColumns(
            {"precision": metrics.ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": metrics.ratio(F.col("tp"), F.col("tp") + F.col("fn"))}
        ),
        "precision", "recall",
    )


@query
def wilson_ci(spark, sf_dir):
    cells = metrics.binary(_decisions(spark, sf_dir)).withColumn("ci", metrics.wilson(F.col("tp") + F.col("tn"), F.col("total")))
    return _rounded(cells.select("accuracy", F.col("ci.low").alias("low"), F.col("ci.high").alias("high")), "accuracy", "low", "high")


@query
def deflection_soft_dm(spark, sf_dir):
    rows = _labelled(spark, sf_dir).withColumn("reply", rules.draft(F.col("predicted_intent"), F.col("predicted_reason"), F.col("brand_text")))
    return _rounded(agents.hand_over_rates(rows), "deflection", "soft_dm")


def _pairs(spark, sf_dir):
    rows = base.exchanges(spark, sf_dir).where("brand_text is not null")
    return rows.select(F.col("thread_id").alias("id"), F.col("brand_text").alias("reference"), F.col("customer_text").alias("hypothesis"))


@query
def rouge1(spark, sf_dir):
    return _rounded(metrics.rouge_n(_pairs(spark, sf_dir), 1), "precision", "recall", "f1")


@query
def rouge2(spark, sf_dir):
    return _rounded(metrics.rouge_n(_pairs(spark, sf_dir), 2), "precision", "recall", "f1")


@query
def rouge_l(spark, sf_dir):
    return _rounded(metrics.rouge_l(_pairs(spark, sf_dir)), "precision", "recall", "f1")


@query
def bleu1(spark, sf_dir):
    return _rounded(metrics.bleu_1(_pairs(spark, sf_dir)), "bleu")


@query
def reply_metrics(spark, sf_dir):
    return _rounded(metrics.reply_metrics(_pairs(spark, sf_dir)), "rouge_1", "rouge_2", "rouge_l", "bleu", "mean_chars", "mean_tokens")


def _ratings(spark, sf_dir):
    clip = lambda x: F.least(F.lit(5), 1 + F.floor(x)).cast("int")
    pair = lambda name, t, p: F.struct(F.lit(name).alias("dimension"), t.cast("int").alias("t"), p.cast("int").alias("p"))
    c, d = F.col("n_chars"), F.col("doc_id")
    rows = F.explode(
        F.array(
            pair("overall", clip(c / 800), clip(tx.word_count(F.col("text")) / 150)), pair("relevance", 1 + d % 5, 1 + (d * 3 + c) % 5),
            pair("tone", F.lit(3), F.lit(3)), pair("actionability", 1 + (c % 7) % 5, clip((c % 7) / 2)),
        )
    )
    return base.table(spark, sf_dir, "documents").select("lang", rows.alias("r")).select("lang", "r.*")


@query
def pearson(spark, sf_dir):
    return _rounded(metrics.pearson(_ratings(spark, sf_dir), ["dimension"]), "pearson")


@query
def spearman(spark, sf_dir):
    return _rounded(metrics.spearman(_ratings(spark, sf_dir), ["dimension"]), "spearman")


@query
def qwk(spark, sf_dir):
    return _rounded(_ratings(spark, sf_dir).groupBy("dimension").agg(metrics.kappa(F.col("t"), F.col("p")).alias("kappa")), "kappa")


@query
def agreement_report(spark, sf_dir):
    return _rounded(metrics.agreement(_ratings(spark, sf_dir), ["dimension", "lang"]), "pearson", "spearman", "kappa", "exact", "within_one", "mae")


@query
def safety_agreement(spark, sf_dir):
    return _rounded(metrics.safety_agreement(base.table(spark, sf_dir, "labels"), "quality", "toxic"), "agreement")


# Judge and answers of models.


@query
def judge_heuristic(spark, sf_dir):
    rows = _labelled(spark, sf_dir).where("brand_text is not null").withColumns({"reply": F.col("brand_text"), "escalate": F.col("predicted_escalate")})
    return jd.judge(rows).select("thread_id", "relevance", "tone", "actionability", "safe", "overall")


@query
def llm_json_parse(spark, sf_dir):
    rows = base.exchanges(spark, sf_dir).withColumn("raw", base.pick(base.ANSWERS, F.col("pos") % len(base.ANSWERS)))
    raw = F.col("raw")
    return rows.select(
        "thread_id", jd.parsed_intent(raw, F.lit("fallback")).alias("intent"), jd.parsed_rating(raw, "relevance").alias("relevance"),
        jd.parsed_safety(raw).alias("safe"),
    )


# Errors.


def _scored(spark, sf_dir):
    rows = _labelled(spark, sf_dir).withColumn("reply", rules.draft(F.col("predicted_intent"), F.col("predicted_reason"), F.lit(None).cast("string")))
    pairs = rows.select(F.col("thread_id").alias("id"), F.coalesce("brand_text", F.lit("")).alias("reference"), F.col("reply").alias("hypothesis"))
    return rows.join(metrics.reply_scores(pairs).withColumnRenamed("id", "thread_id"), "thread_id")


@query
def error_records(spark, sf_dir):
    return _rounded(
        errors.records(_scored(spark, sf_dir)).select("thread_id", "intent_error", "escalate_error_type", "failure_mode", "rouge_1", "rouge_l", "bleu"),
        "rouge_1", "rouge_l", "bleu",
    )


@query
def error_roll_up(spark, sf_dir):
    return _rounded(errors.roll_up(_scored(spark, sf_dir)), "errors_share", "intent_errors_share", "escalation_errors_share")


@query
def failure_modes(spark, sf_dir):
    return errors.modes(_scored(spark, sf_dir))


@query
def top_confusion_pairs(spark, sf_dir):
    return errors.top_pairs(_labelled(spark, sf_dir), "pos")


@query
def error_samples(spark, sf_dir):
    return errors.samples(_scored(spark, sf_dir), "pos").select("failure_mode", "thread_id")


# Validation.


def _gold(spark, sf_dir):
    """Gold rows with planted breaches."""
    p = F.col("pos")
    rows = base.exchanges(spark, sf_dir)
    return rows.select(
        "pos",
        F.when(p % 37 == 5, None).when(p % 41 == 7, F.format_string("conv_%05d", p - 1)).otherwise(F.col("thread_id")).alias("thread_id"),
        F.when(p % 43 != 9, p.cast("string")).alias("customer_tweet_id"),
        F.when(p % 47 == 8, F.concat("customer_text", F.lit("!"))).otherwise(F.col("customer_text")).alias("customer_text"),
        "brand_text",
        F.when(p % 29 == 3, None).when(p % 31 == 4, "bogus").otherwise(F.col("gold_intent")).alias("intent"),
        F.when(p % 23 != 6, F.col("gold_escalate")).alias("escalate"),
        F.when(p % 19 == 2, "odd").when(p % 17 == 1, "").otherwise(F.col("gold_reason")).alias("escalate_reason"),
        F.when(p % 13 == 0, "  ").otherwise("seen").alias("notes"),
    )


@query
def validation_violations(spark, sf_dir):
    rows = base.exchanges(spark, sf_dir).select("pos", "thread_id")
    return errors.violations(_gold(spark, sf_dir), rows, 200)


@query
def mandatory_escalation_audit(spark, sf_dir):
    rows = base.exchanges(spark, sf_dir)
    bare = _gold(spark, sf_dir).where("pos % 2 = 0").select(
        "pos", "thread_id", F.when(F.col("pos") % 6 == 0, F.col("intent")).alias("intent"), F.lit(None).cast("boolean").alias("escalate"),
        F.lit(None).cast("string").alias("escalate_reason"), F.lit(None).cast("string").alias("notes"),
    )
    return errors.audit(_gold(spark, sf_dir), rows, bare)


@query
def source_fidelity(spark, sf_dir):
    return errors.audit(_gold(spark, sf_dir), base.exchanges(spark, sf_dir)).where(
        F.col("rule").isin("not_in_source", "customer_text_differs", "brand_text_differs")
    )


@query
def validation_summary(spark, sf_dir):
    return errors.summary(_gold(spark, sf_dir)).withColumn("intents", F.array_join("intents", ","))


@query
def holdout_order(spark, sf_dir):
    return sampling.same_order(_gold(spark, sf_dir), base.exchanges(spark, sf_dir))


# Replays.


def _cached(spark, sf_dir):
    """Predictions of two runs; in the first, some are empty."""
    rows = _labelled(spark, sf_dir).where("pos % 3 <> 0")
    one = rows.select(
        "thread_id", "pos", F.when(F.col("pos") % 5 != 0, F.col("predicted_intent")).otherwise("").alias("predicted_intent"),
        F.lit("reply").alias("predicted_reply"),
    )
    two = rows.where("pos % 7 = 0").select(
        "thread_id", (F.col("pos") + 1_000_000_000).alias("pos"), F.lit("other").alias("predicted_intent"),
        F.lit("later").alias("predicted_reply"),
    )
    return one.unionByName(two)


@query
def replay_join(spark, sf_dir):
    gold = base.exchanges(spark, sf_dir).select("thread_id", "gold_intent")
    return files.replay(gold, _cached(spark, sf_dir))


@query
def resume_pending(spark, sf_dir):
    return files.pending(base.exchanges(spark, sf_dir).select("thread_id"), _cached(spark, sf_dir))


@query
def running_accuracy(spark, sf_dir):
    rows = _labelled(spark, sf_dir).select("thread_id", "pos", (F.col("gold_intent") == F.col("predicted_intent")).alias("hit"))
    return _rounded(windows.running_share(rows, "pos", "hit", "accuracy").select("thread_id", "accuracy"), "accuracy")


@query
def running_accuracy_stream(spark, sf_dir):
    """The same over a stream whose rows come in no order; a last row, far later, lets all others go."""
    share_code(spark)
    folder = f"{shared_dir(spark)}/running-{uuid.uuid4().hex}"
    rows = _labelled(spark, sf_dir).select(
        "thread_id", F.lit("all").alias("run"), F.timestamp_seconds(F.col("pos") * 60 + 86_400).alias("at"), "pos", (F.col("gold_intent") == F.col("predicted_intent")).alias("hit"),
    )
    rows.repartition(4, F.xxhash64("pos")).write.parquet(f"{folder}/in")
    rows.agg(F.lit("").alias("thread_id"), F.lit("all").alias("run"), (F.max("at") + F.expr("interval 45000 days")).alias("at"), F.lit(-1).cast("long").alias("pos"), F.lit(True).alias("hit")).write.mode(
        "append",
    ).parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(f"{folder}/in")
    before = {k: spark.conf.get(k, None) for k in running.STORE}
    try:
        for k, v in running.STORE.items():
            spark.conf.set(k, v)
        # Whatever comes first, nothing is late: the order of the files has no say.
        made = running.running_share(stream, "run", "at", "pos", "hit", "40000 days", "accuracy")
        query = made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    found = spark.read.schema(made.schema).parquet(f"{folder}/out").where("pos >= 0")
    return _rounded(spark.read.parquet(f"{folder}/in").where("pos >= 0").join(found, "pos").select("thread_id", "accuracy"), "accuracy")
