"""Sources and sinks: flat message CSV, JSON lines and documents, id lists, resumable results."""

import json
import os

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import text as tx
from parley.operators import windows

_S = T.StringType()
TWEET = T.StructType([T.StructField(c, _S) for c in ("tweet_id", "author_id", "inbound", "created_at", "text", "response_tweet_id", "in_response_to_tweet_id")])
TURN = T.StructType([T.StructField(c, T.BooleanType() if c == "inbound" else _S) for c in ("tweet_id", "author_id", "role", "text", "inbound", "created_at")])
THREAD = T.StructType(
    [
        *(
            T.StructField(c, _S) for c in (
                "thread_id", "customer_tweet_id", "customer_author_id", "customer_text", "brand_tweet_id", "brand_author_id", "brand_text",
                "created_at",
            )
        ),
        T.StructField("turn_count", T.IntegerType()), T.StructField("turns", T.ArrayType(TURN)),
    ]
)
GOLD = T.StructType(
    [
        *(T.StructField(c, _S) for c in ("thread_id", "customer_tweet_id", "customer_text", "brand_text")),
        T.StructField("turn_count", T.IntegerType()), *(T.StructField(c, _S) for c in ("created_at", "notes", "intent")),
        T.StructField("escalate", T.BooleanType()), T.StructField("escalate_reason", _S),
    ]
)


def version(rows: DataFrame) -> tuple:
    """The files that rows are read from, with length and time of change: equal ones have the same rows."""
    jvm, conf = rows.sparkSession.sparkContext._jvm, rows.sparkSession.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in sorted(rows.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


def resolve(path: str, folders: list[str]) -> str:
    """The path itself if it is there, else the first folder that has a file of that name."""
    for candidate in (path, *(os.path.join(folder, os.path.basename(path)) for folder in folders)):
        if os.path.exists(candidate):
            return candidate
    raise FileNotFoundError(path)


def read_tweets(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; quoted texts may hold line ends. file_pos is the order of the rows.

    A file whose quoted texts hold line ends can't be split: where files are large, write the result as Parquet once.
    """
    rows = spark.read.schema(TWEET).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return with_position(rows, "file_pos").select(*(_stripped(c) for c in TWEET.fieldNames()), "file_pos")


def _stripped(name: str):
    value = tx.strip(F.col(name)) if name.endswith("id") else F.col(name)
    return F.when(value != "", value).alias(name)


def with_position(rows: DataFrame, name: str = "pos") -> DataFrame:
    """The number of rows before, by the names of the files and the order of the rows in them; rows come straight from a file source.

    Spark reads the parts of files in an order of its own, so each part is counted first; the rows of a part are numbered
    without gaps. Only the counts, a row for each part, meet in one task.
    """
    own = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    placed = rows.select("*", own.alias("_part"), F.monotonically_increasing_id().alias("_id"))
    parts = placed.groupBy("_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    ahead = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begin = parts.select(F.col("_part").alias("_of"), (F.coalesce(ahead, F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(begin, F.col("_part") == F.col("_of")).select(*rows.columns, (F.col("_id") + F.col("_shift")).alias(name))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """pos, thread_id: the lines of a text file that aren't blank, stripped, in order; pos has no gaps."""
    rows = with_position(spark.read.text(path), "_line").select("_line", tx.strip(F.col("value")).alias("thread_id")).where("thread_id <> ''")
    return windows.position(rows, "_line", "pos").select("pos", "thread_id")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped. strict: a line that isn't JSON of the schema ends the read with an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (a name that ends in .jsonl) or a JSON document, which is a list of predictions or an object with such a list; pos is their order."""
    if path.rstrip("/").endswith(".jsonl"):
        return with_position(spark.read.json(path))
    rows = spark.read.option("multiLine", True).json(path)
    if "predictions" not in rows.columns:
        return with_position(rows)
    listed = with_position(rows, "_doc").select(
        "_doc", F.posexplode("predictions").alias("_at", "p"),
    ).withColumn("_order", F.col("_doc") * (1 << 31) + F.col("_at"))
    return windows.position(listed.select("_order", "p.*"), "_order", "pos").drop("_order")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_text(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """A small text file in any store that Spark writes to, replaced as a whole."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder or '.'}/{name}")
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    stream.write(bytearray(text.encode() + b"\n"))
    stream.close()


def write_metrics(spark: SparkSession, folder: str, name: str, found: dict) -> None:
    """A JSON document; rows become objects, and nothing an empty one."""
    plain = {k: {} if v is None else v.asDict() if isinstance(v, Row) else v for k, v in found.items()}
    write_text(spark, folder, name, json.dumps(plain, indent=2, ensure_ascii=False))


def write_flat_csv(threads: DataFrame, path: str) -> None:
    """The scalar columns."""
    flat = [f.name for f in threads.schema if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    threads.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def pending(inquiries: DataFrame, done: DataFrame, key: str = "thread_id") -> DataFrame:
    """Inquiries without a finished result: one whose intent and reply aren't empty."""
    finished = done.where((F.coalesce("predicted_intent", F.lit("")) != "") & (F.coalesce("predicted_reply", F.lit("")) != ""))
    return inquiries.join(finished.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def replay(gold: DataFrame, cached: DataFrame, key: str = "thread_id", position: str = "pos") -> DataFrame:
    """gold with its cached prediction; of several for an id the last. An id without one has nulls."""
    names = [c for c in cached.columns if c not in (key, position)]
    last = cached.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*names), position).alias("_p"))
    return gold.join(last, F.col(key) == F.col("_k"), "left").select(*gold.columns, *(F.col(f"_p.{c}").alias(c) for c in names if c not in gold.columns))


def matched(gold: DataFrame, cached: DataFrame, key: str = "thread_id", position: str = "pos") -> DataFrame:
    """gold with the cached predictions that are scored; both have key and position.

    With as many different ids as gold has rows, by id, and a gold row without a prediction is an error; else, with as
    many predictions as gold has rows, by position; else only the gold rows whose id has a prediction.
    """
    rows = gold.count()
    counts = cached.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("ids"),
    ).first() if key in cached.columns else cached.agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("ids")).first()
    if counts["ids"] != rows and counts["n"] == rows:
        names = [c for c in cached.columns if c not in gold.columns]
        return gold.join(cached.select(F.col(position).alias("_q"), *names), F.col(position) == F.col("_q")).drop("_q")
    found = replay(gold, cached.withColumn("_there", F.lit(True)), key, position)
    if counts["ids"] == rows:
        lost = found.where("_there is null").select(key).limit(1).collect()
        if lost:
            raise ValueError(f"no cached prediction for {lost[0][0]}")
    return found.where("_there").drop("_there")
