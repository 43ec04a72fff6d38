"""Conversations: exchanges out of turns, threads out of flat reply data, corpus statistics."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import text as tx
from parley.operators import windows


#: Conversations in which an assistant speaks first are marked by a hash with so many values.
MARKS = 1024


def first_exchange(turns: DataFrame, answered: bool = False) -> DataFrame:
    """conv_id, customer_text (the first user turn), brand_text (the first later assistant turn, or null), turn_count, inbound, outbound.

    answered: with a column of that name, whether brand_text isn't null; without that text itself, none of an assistant is sent on.
    The counts are of user and assistant turns. Each task sends on only the first turns of a conversation. Where that of an assistant
    isn't after that of the user, all texts of assistants meet once more, of such conversations (and those with the same mark) alone.
    """
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    said, place, there = F.struct("turn", "text"), F.struct("turn"), F.struct("turn", F.col("text").isNotNull().alias("there"))
    spoken = assistant & F.col("turn").isNotNull()
    own = turns.groupBy("conv_id").agg(
        F.min(F.when(user, said)).alias("_opening"),
        F.min(F.when(user, place))["turn"].alias("_start"),
        F.min(F.when(spoken, said)).alias("_answer"),
        F.min(F.when(spoken, there)).alias("_there"),
        F.count_if(F.col("role").isin("user", "assistant")).alias("turn_count"),
        F.count_if(user).alias("inbound"),
        F.count_if(assistant).alias("outbound"),
    ).where("inbound > 0")
    # No texts here.
    places = turns.groupBy("conv_id").agg(F.min(F.when(user, place))["turn"].alias("_from"), F.min(F.when(assistant, F.col("turn"))).alias("_first"))
    early = places.where(F.col("_first") <= F.col("_from")).select("conv_id", "_from")
    mark = F.pmod(F.xxhash64("conv_id"), F.lit(MARKS)).cast("int")
    marked = F.array_contains(early.agg(F.collect_set(mark)).scalar(), mark)
    later = turns.where(assistant & marked).join(early, "conv_id").where(F.col("turn") > F.col("_from")).groupBy("conv_id").agg(
        F.min(said)["text"].alias("_later"), F.min(there)["there"].alias("_later_there"),
    )
    brand = F.when(F.col("_answer.turn") > F.col("_start"), F.col("_answer.text")).otherwise(F.col("_later"))
    flag = F.when(F.col("_there.turn") > F.col("_start"), F.col("_there.there")).otherwise(F.coalesce("_later_there", F.lit(False)))
    return own.join(later, "conv_id", "left").select(
        "conv_id", F.col("_opening.text").alias("customer_text"), brand.alias("brand_text"), "turn_count", "inbound", "outbound",
        *([flag.alias("answered")] if answered else []),
    )


def reply_edges(turns: DataFrame) -> DataFrame:
    """conv_id, turn, reply_turn, role, reply_role: each turn with the one that answers it, if any."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    after = F.lead(F.struct("turn", "role")).over(order)
    linked = F.when(F.col("_next.turn") == F.col("turn") + 1, F.col("_next"))
    return turns.withColumn("_next", after).withColumn("_next", linked).select(
        "conv_id", "turn", "role", F.col("_next.turn").alias("reply_turn"), F.col("_next.role").alias("reply_role"),
    )


def nested(turns: DataFrame) -> DataFrame:
    """conv_id and its turns as an ordered array of (turn, role, text)."""
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def turn_histogram(threads: DataFrame) -> DataFrame:
    return threads.groupBy("turn_count").agg(F.count(F.lit(1)).alias("n")).orderBy("turn_count")


def corpus_stats(threads: DataFrame) -> DataFrame:
    """One row over threads with turn_count, inbound, outbound, customer_text, brand_text."""
    return threads.agg(
        F.count(F.lit(1)).alias("threads"),
        F.sum("turn_count").alias("turns"),
        F.avg("turn_count").alias("mean_turns"),
        F.sum("inbound").alias("inbound"),
        F.sum("outbound").alias("outbound"),
        F.avg(tx.word_count(F.col("customer_text"))).alias("mean_customer_words"),
        F.avg(tx.word_count(F.col("brand_text"))).alias("mean_brand_words"),
        F.avg(F.col("brand_text").isNotNull().cast("double")).alias("answered_share"),
    )


def typed_time(created_at: Column) -> Column:
    """A time written as `Fri Dec 01 10:37:51 +0000 2017`."""
    return F.to_timestamp(F.substr(created_at, F.lit(5)), "MMM dd HH:mm:ss Z yyyy")


def date_range(rows: DataFrame, column: str = "created_at") -> DataFrame:
    """The least and greatest as strings, and as times."""
    return rows.agg(
        F.min(column).alias("first_text"), F.max(column).alias("last_text"), F.min(typed_time(F.col(column))).alias("first_time"),
        F.max(typed_time(F.col(column))).alias("last_time"),
    )


def response_ids(tweets: DataFrame) -> DataFrame:
    """tweet_id, response_id: the comma-separated answers of each message, blanks left out."""
    parts = F.transform(F.split("response_tweet_id", ","), tx.strip)
    return tweets.select("tweet_id", F.explode(F.filter(parts, lambda x: x != "")).alias("response_id"))


def needed_customers(tweets: DataFrame, brand: str) -> DataFrame:
    """Messages that brand messages answer or are answered by: a semi-join, read in one scan."""
    own = tweets.where(F.col("author_id") == brand)
    ids = own.select(F.col("in_response_to_tweet_id").alias("id")).unionByName(
        response_ids(own).select(F.col("response_id").alias("id"))
    ).where("id is not null").distinct()
    return tweets.where(F.col("author_id") != brand).join(ids, F.col("tweet_id") == F.col("id"), "left_semi")


def is_inbound(flag: Column) -> Column:
    """`true` in any case; a missing flag counts as true."""
    return F.lower(F.coalesce(flag, F.lit("true"))) == "true"


_SAID = ("tweet_id", "author_id", "text", "inbound", "created_at")


def first_replies(tweets: DataFrame, brand: str) -> DataFrame:
    """parent and answer (a struct): the brand's first message, by file_pos, to each message that it answers."""
    own = tweets.where((F.col("author_id") == brand) & F.col("in_response_to_tweet_id").isNotNull())
    return own.groupBy(F.col("in_response_to_tweet_id").alias("parent")).agg(F.min_by(F.struct(*_SAID), "file_pos").alias("answer"))


def roots(tweets: DataFrame, brand: str, customers: DataFrame | None = None) -> DataFrame:
    """Customers' messages that the brand's refer to (needed_customers, if given) and whose own parent, if any, is no message of the brand."""
    own = tweets.where(F.col("author_id") == brand).select(F.col("tweet_id").alias("_brand_id"))
    return (customers or needed_customers(tweets, brand)).join(own, F.col("in_response_to_tweet_id") == F.col("_brand_id"), "left_anti")


#: Messages with a common parent are dealt to so many groups where only one thing is asked of the parent.
SALT = 16


def linked(tweets: DataFrame, brand: str) -> DataFrame:
    """root (file_pos, said), reply (said) and follow, an array of (file_pos, said, reply) in order: each customer's message that opens a thread.

    Every message is read once and gives a row for each part it plays: itself, the answer to its parent, and a mention of the messages
    that it answers or is answered by. Grouped by the id that a row is about, that tells which messages the brand refers to and its first answer to
    each. Customers' messages then meet what has their parent's id: those with a parent of the brand go on after it, all others are
    roots, if they were answered. Last, roots and what goes on meet at the brand's answer. Three shuffles.
    """
    own, tweet, parent = F.col("author_id") == brand, F.col("tweet_id"), F.col("in_response_to_tweet_id")
    said = F.struct(*_SAID)
    message = F.struct("file_pos", said.alias("said"), parent.alias("parent"), own.alias("own"))
    answer = F.struct("file_pos", said.alias("said"))
    part = lambda key, m=None, a=None: F.struct(
        key.alias("key"), (F.lit(None) if m is None else m).cast(_type(tweets, message)).alias("m"), (F.lit(None) if a is None else a).cast(_type(tweets, answer)).alias("a"),
    )
    ids = F.filter(F.transform(F.split("response_tweet_id", ","), tx.strip), lambda x: x != "")
    parts = F.concat(
        F.array(part(tweet, m=message)), F.when(own, F.array(part(parent, a=answer))).otherwise(F.array()),
        F.when(own, F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: part(x))).otherwise(F.array()),
    )
    rows = tweets.select(F.explode(parts).alias("_p")).select("_p.*").where("key is not null")
    met = rows.groupBy("key").agg(
        F.collect_list("m").alias("m"), F.min_by("a", F.col("a.file_pos")).alias("a"), (F.count(F.lit(1)) > F.count("m")).alias("referred"),
    )
    # The brand's own messages, and the customers' that the brand refers to.
    known = met.select(F.explode("m").alias("m"), "a", "referred").where("m.own or referred").select(
        F.col("m.own").alias("own"), F.col("m.parent").alias("parent"), F.struct(F.col("m.file_pos").alias("file_pos"), F.col("m.said").alias("said"), F.col("a.said").alias("reply")).alias("c"),
    )
    # Only a message without a parent has its own id here; the brand's are at every salt of theirs.
    place = F.when(F.col("own"), F.col("c.said.tweet_id")).when(F.col("parent").isNotNull(), F.col("parent")).otherwise(F.col("c.said.tweet_id"))
    salts = F.when(F.col("own"), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.pmod(F.hash("c.said.tweet_id"), F.lit(SALT))))
    placed = known.select("own", "parent", "c", place.alias("_at"), F.explode(salts).alias("_salt"))
    after_brand = F.max(F.col("own")).over(Window.partitionBy("_at", "_salt"))
    judged = placed.withColumn("_on", F.col("parent").isNotNull() & after_brand).where(~F.col("own"))
    ends = judged.where("_on or c.reply is not null").select(F.when(F.col("_on"), F.col("_at")).otherwise(F.col("c.reply.tweet_id")).alias("_to"), "_on", "c")
    return ends.groupBy("_to").agg(
        F.collect_list(F.when(~F.col("_on"), F.col("c"))).alias("_roots"), F.array_sort(F.collect_list(F.when(F.col("_on"), F.col("c")))).alias("follow"),
    ).select(F.explode("_roots").alias("root"), "follow")


def _type(rows: DataFrame, column: Column) -> T.DataType:
    return rows.select(column.alias("_x")).schema["_x"].dataType


def rebuild(tweets: DataFrame, brand: str, limit: int | None = None, prefix: str = "thread") -> DataFrame:
    """Threads out of flat messages (file_pos is their order): thread_id and the exchange with its further turns.

    A root is a customer's message that the brand answers and whose parent is no brand message. Its main answer
    is the first by file_pos. Customers' messages that follow that answer come next, each with the brand's first
    answer to it. Threads are numbered by the roots' file_pos; limit keeps the first so many.
    """

    def turn(x: Column, role: str) -> Column:
        return F.struct(
            x["tweet_id"].alias("tweet_id"), x["author_id"].alias("author_id"), F.lit(role).alias("role"), x["text"].alias("text"),
            x["inbound"].alias("inbound"), x["created_at"].alias("created_at"),
        )

    said, reply = F.col("root.said"), F.col("root.reply")
    both = lambda x: F.array(turn(x["said"], "customer"), turn(x["reply"], "agent"))
    more = F.flatten(F.transform("follow", lambda x: F.when(x["reply"].isNotNull(), both(x)).otherwise(F.array(turn(x["said"], "customer")))))
    out = linked(tweets.withColumn("inbound", is_inbound(F.col("inbound"))), brand).select(
        F.col("root.file_pos").alias("file_pos"), said["tweet_id"].alias("customer_tweet_id"), said["author_id"].alias("customer_author_id"),
        said["text"].alias("customer_text"), reply["tweet_id"].alias("brand_tweet_id"), reply["author_id"].alias("brand_author_id"),
        reply["text"].alias("brand_text"), said["created_at"].alias("created_at"), F.concat(both(F.col("root")), more).alias("turns"),
    )
    if limit is None:
        return numbered(out, "file_pos", prefix).withColumn("turn_count", F.size("turns"))
    # At most limit rows, which a sort with a limit leaves in one task.
    number = F.row_number().over(Window.orderBy("file_pos"))
    return out.orderBy("file_pos").limit(limit).withColumn("thread_id", F.format_string(f"{prefix}_%05d", number)).withColumn("turn_count", F.size("turns"))


def numbered(rows: DataFrame, order: str, prefix: str) -> DataFrame:
    """thread_id as prefix and a running number from 1 by a numeric order without ties."""
    made = windows.position(rows, order, "_pos")
    return made.withColumn("thread_id", F.format_string(f"{prefix}_%05d", F.col("_pos") + 1)).drop("_pos")
