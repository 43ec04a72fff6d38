"""Registered queries on flat messages, files, labels and replays, each with its DuckDB SQL.

The messages are made of the conversations: turns with ids, authors, replies and times as a message dump has them.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import lexicon as lx
from parley.functions import text as tx
from parley.operators import assisted, errors, metrics, rules, sampling, search
from parley.operators import threads as th
from parley.plans import base, oracles
from parley.session import shared_dir
from parley.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[make.__name__], SQL[make.__name__] = make, sql
        return make

    return register


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


BRAND = "Brand"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tweet_id, author_id, inbound, created_at, text, response_tweet_id, in_response_to_tweet_id (all text) and file_pos."""
    turns = base.table(spark, sf_dir, "conversations")
    own = Window.partitionBy("conv_id")
    order = own.orderBy("turn")
    known = turns.withColumns(
        {
            "_before": F.lag("turn").over(order), "_after": F.lead("turn").over(order),
            "_answer": F.min(F.when(F.col("role") == "assistant", F.col("turn"))).over(own),
        }
    )
    c, t = F.col("conv_id"), F.col("turn")
    number = lambda x: (c * 100 + x).cast("string")
    late = (c % 5 == 0) & (F.col("role") == "user") & (t > F.col("_answer"))
    parent = F.when(c % 11 != 3, F.when(late, number(F.col("_answer"))).otherwise(number(F.col("_before"))))
    after = F.when(F.col("_after").isNull(), F.when(c % 2 == 0, "")).when(
        c % 7 == 2, F.concat(number(F.col("_after")), F.lit(", ,"), number(F.lit(99))),
    ).otherwise(number(F.col("_after")))
    return known.select(
        number(t).alias("tweet_id"),
        F.when(F.col("role") == "assistant", BRAND).when(
            F.col("role") == "user", F.concat(F.lit("c"), (c % 40).cast("string")),
        ).otherwise("robot").alias("author_id"),
        F.when(F.col("role") == "assistant", "False").otherwise(base.pick(["True", "true", None], (c + t) % 3)).alias("inbound"),
        F.format_string("Fri Dec 01 %02d:%02d:00 +0000 2017", c % 24, t % 60).alias("created_at"),
        F.when(c % 3 == 0, F.concat(F.lit('say "hi", or\n'), "text")).otherwise(F.col("text")).alias("text"),
        after.alias("response_tweet_id"),
        parent.alias("in_response_to_tweet_id"),
        ((c * 7919) % 100003 * 100 + t).alias("file_pos"),
    )


_ID = "CAST(conv_id * 100 + {0} AS VARCHAR)".format
MESSAGES = f"""
WITH known AS (SELECT *, lag(turn) OVER w AS before_, lead(turn) OVER w AS after_, min(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS answer_ FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
messages AS (SELECT {_ID('turn')} AS tweet_id, CASE role WHEN 'assistant' THEN '{BRAND}' WHEN 'user' THEN 'c' || (conv_id % 40) ELSE 'robot' END AS author_id,
    CASE WHEN role = 'assistant' THEN 'False' ELSE ['True', 'true', NULL][CAST((conv_id + turn) % 3 AS INT) + 1] END AS inbound,
    printf('Fri Dec 01 %02d:%02d:00 +0000 2017', conv_id % 24, turn % 60) AS created_at, CASE WHEN conv_id % 3 = 0 THEN 'say "hi", or' || chr(10) || text ELSE text END AS text,
    CASE WHEN after_ IS NULL THEN CASE WHEN conv_id % 2 = 0 THEN '' END WHEN conv_id % 7 = 2 THEN {_ID('after_')} || ', ,' || {_ID('99')} ELSE {_ID('after_')} END AS response_tweet_id,
    CASE WHEN conv_id % 11 <> 3 THEN CASE WHEN conv_id % 5 = 0 AND role = 'user' AND turn > answer_ THEN {_ID('answer_')} ELSE {_ID('before_')} END END AS in_response_to_tweet_id,
    (conv_id * 7919) % 100003 * 100 + turn AS file_pos FROM known),
own AS (SELECT * FROM messages WHERE author_id = '{BRAND}'),
responses AS (SELECT tweet_id, author_id, trim(part) AS response_id FROM (SELECT tweet_id, author_id, unnest(string_split(response_tweet_id, ',')) AS part FROM messages) WHERE trim(part) <> ''),
customers AS (SELECT * FROM messages WHERE author_id <> '{BRAND}' AND tweet_id IN (SELECT in_response_to_tweet_id FROM own WHERE in_response_to_tweet_id IS NOT NULL UNION SELECT response_id FROM responses WHERE author_id = '{BRAND}')),
answers AS (SELECT in_response_to_tweet_id AS parent, arg_min(tweet_id, file_pos) AS answer_id, arg_min(author_id, file_pos) AS answer_author, arg_min(text, file_pos) AS answer_text FROM own WHERE in_response_to_tweet_id IS NOT NULL GROUP BY 1),
further AS (SELECT in_response_to_tweet_id AS to_, string_agg('customer:' || tweet_id || coalesce(',agent:' || answer_id, ''), ',' ORDER BY file_pos) AS more, count(*) + count(answer_id) AS n
    FROM customers LEFT JOIN answers ON tweet_id = parent WHERE in_response_to_tweet_id IS NOT NULL GROUP BY 1),
rebuilt AS (SELECT printf('thread_%05d', row_number() OVER (ORDER BY file_pos)) AS thread_id, row_number() OVER (ORDER BY file_pos) AS number, tweet_id AS customer_tweet_id, author_id AS customer_author_id, text AS customer_text,
    answer_id AS brand_tweet_id, answer_author AS brand_author_id, answer_text AS brand_text, created_at, CAST(2 + coalesce(n, 0) AS INT) AS turn_count, 'customer:' || tweet_id || ',agent:' || answer_id || coalesce(',' || more, '') AS turns
    FROM customers c JOIN answers ON tweet_id = parent LEFT JOIN further ON answer_id = to_ WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.tweet_id = c.in_response_to_tweet_id))
"""

# Threads out of messages.

def _spoken() -> Column:
    return F.array_join(F.transform("turns", lambda x: F.concat_ws(":", x["role"], x["tweet_id"])), ",")


_THREAD = "thread_id, customer_tweet_id, customer_author_id, customer_text, brand_tweet_id, brand_author_id, brand_text, created_at, turn_count, turns"


@query(f"{MESSAGES} SELECT {_THREAD} FROM rebuilt")
def thread_rebuild(spark, sf_dir):
    return th.rebuild(messages(spark, sf_dir), BRAND).withColumn("turns", _spoken()).select(*_THREAD.split(", "))


@query(f"{MESSAGES} SELECT {_THREAD} FROM rebuilt WHERE number <= 20")
def thread_rebuild_first(spark, sf_dir):
    """The first 20 threads, as a target number asks for."""
    return th.rebuild(messages(spark, sf_dir), BRAND, limit=20).withColumn("turns", _spoken()).select(*_THREAD.split(", "))


@query(f"{MESSAGES} SELECT tweet_id, response_id FROM responses")
def message_response_ids(spark, sf_dir):
    return th.response_ids(messages(spark, sf_dir))


@query(f"{MESSAGES} SELECT tweet_id FROM customers")
def message_needed_customers(spark, sf_dir):
    return th.needed_customers(messages(spark, sf_dir), BRAND).select("tweet_id")


@query(f"{MESSAGES} SELECT parent, answer_id FROM answers")
def message_first_replies(spark, sf_dir):
    return th.first_replies(messages(spark, sf_dir), BRAND).select("parent", F.col("answer.tweet_id").alias("answer_id"))


@query(f"{MESSAGES} SELECT c.tweet_id FROM customers c LEFT JOIN own o ON o.tweet_id = c.in_response_to_tweet_id WHERE o.tweet_id IS NULL")
def message_roots(spark, sf_dir):
    return th.roots(messages(spark, sf_dir), BRAND).select("tweet_id")


@query(f"{MESSAGES} SELECT tweet_id, lower(coalesce(inbound, 'true')) = 'true' AS inbound FROM messages")
def message_inbound(spark, sf_dir):
    return messages(spark, sf_dir).select("tweet_id", th.is_inbound(F.col("inbound")).alias("inbound"))


@query(
    f"{
        MESSAGES
    }, timed AS (SELECT *, CAST(epoch(strptime(created_at[5:], '%b %d %H:%M:%S %z %Y')) AS BIGINT) AS t FROM messages) SELECT min(created_at) AS first_text, max(created_at) AS last_text, min(t) AS first_time, max(t) AS last_time FROM timed"
)
def message_dates(spark, sf_dir):
    return th.date_range(messages(spark, sf_dir)).withColumns({c: F.unix_timestamp(c) for c in ("first_time", "last_time")})


# Files: each is written and read back.


@query(
    f"""{
        MESSAGES
    } SELECT tweet_id, author_id, inbound, created_at, text, nullif(response_tweet_id, '') AS response_tweet_id, in_response_to_tweet_id, row_number() OVER (ORDER BY file_pos) - 1 AS file_pos FROM messages"""
)
def csv_scan(spark, sf_dir):
    """All values as text, quoted line ends, empty values as null, the order of rows over several files."""
    path = _folder(spark, "messages")
    ordered = messages(spark, sf_dir).repartitionByRange(4, "file_pos").sortWithinPartitions("file_pos")
    ordered.drop("file_pos").write.option("header", True).option("escape", '"').csv(path)
    return files.read_tweets(spark, path)


@query(f"{MESSAGES} SELECT thread_id, customer_text, created_at, turn_count, turns FROM rebuilt")
def jsonl_round_trip(spark, sf_dir):
    path = _folder(spark, "threads")
    files.write_jsonl(th.rebuild(messages(spark, sf_dir), BRAND).select(*files.THREAD.fieldNames()), path)
    return files.read_jsonl(spark, path, files.THREAD).select("thread_id", "customer_text", "created_at", "turn_count", _spoken().alias("turns"))


@query(f"{MESSAGES} SELECT thread_id, brand_text, turn_count FROM rebuilt")
def flat_csv_round_trip(spark, sf_dir):
    """The scalar columns alone."""
    path = _folder(spark, "flat")
    files.write_flat_csv(th.rebuild(messages(spark, sf_dir), BRAND), path)
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if "turns" in rows.columns:
        raise ValueError("nested columns must stay out")
    return rows.select("thread_id", "brand_text", F.col("turn_count").cast("int"))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.exchanges(spark, sf_dir)
    return rows.select("pos", "thread_id", rules.intent(F.col("customer_text")).alias("predicted_intent"))


@query(f"{oracles.LABELLED} SELECT row_number() OVER (ORDER BY pos // 16, pos) - 1 AS pos, thread_id, predicted_intent FROM labelled")
def json_document(spark, sf_dir):
    """Documents with a list of predictions each, 16 at most, in the order of their names."""
    path = _folder(spark, "documents")
    listed = F.array_sort(F.collect_list(F.struct("pos", "thread_id", "predicted_intent")))
    made = _predicted(spark, sf_dir).groupBy(F.floor(F.col("pos") / 16).alias("part")).agg(
        F.transform(listed, lambda x: x.dropFields("pos")).alias("predictions")
    )
    made.select(
        F.format_string("%010d", "part").alias("part"), F.to_json(F.struct("predictions")).alias("value"),
    ).repartition("part").write.partitionBy("part").text(path)
    return files.read_predictions(spark, path).select("pos", "thread_id", "predicted_intent")


@query(f"{base.SQL} SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, thread_id FROM exchanges")
def text_lines(spark, sf_dir):
    """Lines with blanks around them and blank lines between, over several files."""
    path = _folder(spark, "ids")
    rows = base.exchanges(spark, sf_dir).repartitionByRange(3, "pos").sortWithinPartitions("pos")
    rows.select(F.concat(F.when(F.col("pos") % 4 == 0, " \n").otherwise(""), F.lit("  "), "thread_id", F.lit("\t")).alias("value")).write.text(path)
    return files.read_lines(spark, path)


@query(f"{oracles.SQL['multiclass_summary']}")
def metrics_json(spark, sf_dir):
    """Metrics as the commands write them, a JSON document, read back."""
    rows = base.exchanges(spark, sf_dir).select(F.col("gold_intent").alias("actual"), rules.intent(F.col("customer_text")).alias("predicted"))
    path = _folder(spark, "metrics")
    files.write_metrics(spark, path, "metrics.json", {"intent": metrics.multiclass(rows, lx.LABELS).first(), "replies": None})
    return spark.read.option("multiLine", True).json(f"{path}/metrics.json").select("intent.*").select(*(F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")))


# Labels.

_LABELS = f"{oracles.GOLD}, placed AS (SELECT *, row_number() OVER (ORDER BY pos) AS number FROM gold)"
_LINE = "replace({0}, chr(10), ' ')".format


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.plans.catalogue import _gold as gold

    return gold(spark, sf_dir)


@query(
    f"""{_LABELS} SELECT number, thread_id, CASE WHEN intent IS NULL THEN 'EMPTY' ELSE 'LABELED' END AS status, {
        _LINE('customer_text')
    } AS customer, {_LINE('brand_text')} AS brand, substr({_LINE('customer_text')}, 1, 90) AS customer_short, substr({_LINE('brand_text')}, 1, 90) AS brand_short FROM placed"""
)
def label_dump(spark, sf_dir):
    return errors.label_dump(_gold(spark, sf_dir))


@query(
    f"{
        _LABELS
    } SELECT count(*) AS total, count(intent) AS labelled, count(*) - count(intent) AS unlabelled, min(number) FILTER (intent IS NOT NULL) AS first_labelled, max(number) FILTER (intent IS NOT NULL) AS last_labelled FROM placed"
)
def label_counts(spark, sf_dir):
    return errors.label_counts(_gold(spark, sf_dir))


@query(f"""{_LABELS}, fields AS (SELECT 'intent' AS field, intent AS value FROM placed WHERE intent IS NOT NULL UNION ALL SELECT 'escalate', CAST(escalate AS VARCHAR) FROM placed WHERE intent IS NOT NULL UNION ALL SELECT 'escalate_reason', escalate_reason FROM placed WHERE intent IS NOT NULL)
    SELECT field, value, n, printf('%.2f%%', round(100.0 * n / sum(n) OVER (PARTITION BY field), 2)) AS share FROM (SELECT field, value, count(*) AS n FROM fields GROUP BY field, value)""")
def label_distribution(spark, sf_dir):
    return errors.label_distribution(_gold(spark, sf_dir))


@query(f"""{base.SQL} SELECT thread_id, row_number() OVER (ORDER BY md5('42:' || thread_id), thread_id) AS draw FROM exchanges QUALIFY draw <= 50""")
def seeded_sample(spark, sf_dir):
    """The first 50 of a repeatable random order."""
    drawn = sampling.shuffled(base.exchanges(spark, sf_dir).select("thread_id"), "thread_id", 42).limit(50)
    # 50 rows at most, so one task is enough for their numbers.
    return drawn.withColumn("draw", F.row_number().over(Window.orderBy(sampling.draw(F.col("thread_id"), 42), "thread_id")))


# Retrieval context and replies of models.


@query(f"""{base.SQL}, {oracles.CORPUS} {oracles._search('bm25', 3)}, blocks AS (SELECT query_id, rank, concat('Example ', rank, ':', chr(10), 'Customer: ', customer_text, chr(10), 'Reply: ', brand_text) AS block FROM hits JOIN exchanges ON doc_id = thread_id WHERE brand_text IS NOT NULL)
    SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM blocks GROUP BY query_id""")
def retrieval_context(spark, sf_dir):
    # By numbers: texts of the found exchanges are where their conversations were put together, and needn't move again.
    rows = base.exchanges(spark, sf_dir)
    corpus = rows.where("not holdout").select(F.col("pos").alias("doc_id"), "pos", F.col("customer_text").alias("text"))
    asked = rows.where("holdout").select(F.col("pos").alias("query_id"), F.col("customer_text").alias("text"))
    texts = rows.where("brand_text is not null").select(F.col("pos").alias("doc_id"), "customer_text", "brand_text")
    found = search.context(search.search(asked, corpus, 3, "bm25").join(texts, "doc_id"))
    return found.select(base.thread_id(F.col("query_id")).alias("query_id"), "context")


#: Replies as models write them, and what is left of each, worked out by hand.
REPLIES = [
    ('"Hello there"', "Hello there"), ("'@user42 We can help.'", "We can help."), ("  plain  ", "plain"), ('""', None),
    ("@only_handle", None), (None, None), ("It's fine", "It's fine"), ("@A  @B hi", "@B hi"),
]


@query(f"{base.SQL} SELECT thread_id, {base.sql_pick([x[1] for x in REPLIES], f'pos % {len(REPLIES)}')} AS reply FROM exchanges")
def reply_cleanup(spark, sf_dir):
    raw = base.pick([x[0] for x in REPLIES], F.col("pos") % len(REPLIES))
    return base.exchanges(spark, sf_dir).select("thread_id", rules.cleaned_reply(raw).alias("reply"))


def _model(prompt: str) -> str:
    """Stands for a model: its answer depends on the length of the prompt alone."""
    return base.ANSWERS[len(prompt) % len(base.ANSWERS)]


def _down(prompt: str) -> str:
    raise RuntimeError("not to be reached")


def _providers() -> list:
    return [_down, _model]


@query(f"""{oracles.LABELLED}, said AS (SELECT *, (length(customer_text) + {assisted.LABEL_PROMPT}) % {len(base.ANSWERS)} AS i FROM labelled)
    SELECT thread_id, CASE i WHEN 0 THEN 'billing_purchases_subscriptions' WHEN 4 THEN 'other' ELSE predicted_intent END AS predicted_intent FROM said""")
def model_labels(spark, sf_dir):
    """Labels by the second of two providers, where its answer names one; the rules' for the rest."""
    rows = base.exchanges(spark, sf_dir).select("thread_id", "customer_text")
    return assisted.classify(rows, _providers).select("thread_id", "predicted_intent")


# Replays.

_HALF = "(SELECT * FROM labelled WHERE pos % 2 = 0)"


@query(f"{oracles.LABELLED} SELECT thread_id, gold_intent, predicted_intent FROM {_HALF}")
def replay_subset(spark, sf_dir):
    """Predictions for a part of the rows: only those are scored."""
    gold = base.exchanges(spark, sf_dir).select("pos", "thread_id", "gold_intent")
    return files.matched(gold, _predicted(spark, sf_dir).where("pos % 2 = 0")).select("thread_id", "gold_intent", "predicted_intent")


@query(f"{oracles.LABELLED} SELECT thread_id, gold_intent, predicted_intent FROM labelled")
def replay_by_position(spark, sf_dir):
    """As many predictions as rows, without ids that tell them apart: matched by position."""
    gold = base.exchanges(spark, sf_dir).select("pos", "thread_id", "gold_intent")
    return files.matched(gold, _predicted(spark, sf_dir).withColumn("thread_id", F.lit("same"))).select("thread_id", "gold_intent", "predicted_intent")


@query(f"{oracles.LABELLED} SELECT thread_id, gold_intent, predicted_intent FROM labelled")
def replay_by_id(spark, sf_dir):
    gold = base.exchanges(spark, sf_dir).select("pos", "thread_id", "gold_intent")
    return files.matched(gold, _predicted(spark, sf_dir).withColumn("pos", -F.col("pos"))).select("thread_id", "gold_intent", "predicted_intent")
