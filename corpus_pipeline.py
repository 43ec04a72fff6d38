"""A pipeline over documents: language, near-duplicates, repeated passages, test passages, packing.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and gives a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents, with n_chars as
the length of what is left of the text.

Defined cases, for every stage: a null text and one without a letter go in the first stage, and a later stage that meets
one loses it or counts it as empty; repeated rows are copies, of which one stays; of equals the least doc_id stays, null
counting as the greatest; an empty table gives an empty result; columns other than those of documents are left out.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from parley.llm import decontamination, language, packing, simhash, substrings
from parley.llm.common import cut, discard
from parley.llm.queries import SEQUENCE, VOCABULARY


#: The columns of documents; each stage but the last takes and returns these, other columns are left out.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """With the length of what is left of the text; a text that lost all its words is gone."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).where(F.col("n_chars") > 0).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what has no language, null texts and texts without a letter, and sets lang to the language found.

    Where no row has a language to learn from, lang stays as it is and only the rejection takes effect.
    """
    model = language.train(docs)
    if model is None:
        return language.lettered(docs.select(*COLUMNS))
    found = language.predict(docs, model, keep=tuple(COLUMNS[1:]))
    return found.where(F.col("lang_pred") != language.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of 0.8 (5-word shingles, Jaccard) connect, the one with the least id stays."""
    return simhash.keep_one(docs.select(*COLUMNS), shingle=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that occur more than once go."""
    return _documents(substrings.remove_repeated(docs.select(*COLUMNS), normalise=False))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of test passages go, and documents that are mostly such spans."""
    return _documents(decontamination.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), SEQUENCE)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: Language identification is a learned model, which SQL doesn't express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each stage's result is a table in the shared folder, and goes when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        made = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if i:
            discard(docs)
        docs = made
    return docs
