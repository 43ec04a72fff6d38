"""Triage of messages as they arrive, and windowed counts of reasons; results can be resumed after a failure."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.operators import rules


def labelled(messages: DataFrame, text: str = "text") -> DataFrame:
    """messages with intent, reason and escalate: columns only, so a stream works like a table."""
    rows = messages.withColumn("intent", rules.intent(F.col(text)))
    return rows.withColumn("reason", rules.escalation_reason(F.col(text), F.col("intent"))).withColumn("escalate", F.col("reason").isNotNull())


def reasons_by_time(messages: DataFrame, time: str = "ts", width: str = "10 minutes", late: str = "30 minutes", text: str = "text") -> DataFrame:
    """How often each reason comes in a window of time; what is later than `late` isn't counted."""
    rows = labelled(messages, text).withWatermark(time, late)
    return rows.groupBy(F.window(time, width).alias("w"), "reason").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "reason", "n")


def run(messages: DataFrame, path: str, checkpoint: str, text: str = "text") -> StreamingQuery:
    """Write labelled messages as Parquet, each once; a restart goes on where it ended."""
    return labelled(messages, text).writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint,
    ).trigger(availableNow=True).start()
