"""Ranked retrieval over an inverted index: TF-IDF and cosine-normalised BM25, top k for each query."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators import cells

if TYPE_CHECKING:
    from parley.operators.index import SearchIndex

K1, B = 1.5, 0.75


def term_counts(docs: DataFrame, key: str, text: str, *carried: str) -> DataFrame:
    """key, the carried columns, term, tf and len (the tokens of the document)."""
    tokens = docs.select(key, *carried, tx.ascii_tokens(F.col(text)).alias("_t")).select(
        key, *carried, F.size("_t").alias("len"), F.explode("_t").alias("term"),
    )
    return tokens.groupBy(key, *carried, "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def _runs(s: Column, term: Callable[[Column], Column], made: Callable[[Column, Column], Column]) -> Column:
    """For each run of equal terms in a sorted array what is made of its first element and its length."""
    starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (term(F.get(s, i)) != term(F.get(s, i - 1))))
    run = lambda b: F.transform(b, lambda x, j: made(F.get(s, x), F.coalesce(F.get(b, j + 1), F.size(s)) - x))
    return tx.let(starts, run)


def asked(queries: DataFrame, key: str, text: str) -> DataFrame:
    """_q, terms (term, n, at): how often a term occurs in the query, and its first place there. Counted within the row."""
    placed = F.array_sort(F.transform(tx.ascii_tokens(F.col(text)), lambda x, i: F.struct(x.alias("term"), i.alias("at"))))
    runs = lambda s: _runs(s, lambda x: x["term"], lambda x, n: F.struct(x["term"].alias("term"), n.cast("long").alias("n"), x["at"].alias("at")))
    tokens = queries.select(F.col(key).alias("_q"), placed.alias("_t"))
    none = F.array().cast("array<struct<term:string,n:bigint,at:int>>")
    return tokens.select("_q", F.when(F.size("_t") > 0, tx.let(F.col("_t"), runs)).otherwise(none).alias("terms"))


def vectors(docs: DataFrame, key: str, position: str, text: str) -> DataFrame:
    """doc, pos, len (tokens), terms (term, tf): counted within the row, as runs of its sorted tokens."""
    runs = lambda s: _runs(s, lambda x: x, lambda x, n: F.struct(x.alias("term"), n.cast("long").alias("tf")))
    tokens = docs.select(F.col(key).alias("doc"), F.col(position).alias("pos"), F.sort_array(tx.ascii_tokens(F.col(text))).alias("_t"))
    counted = F.when(F.size("_t") > 0, tx.let(F.col("_t"), runs)).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))
    return tokens.select("doc", "pos", F.size("_t").alias("len"), counted.alias("terms"))


def idf(documents: Column, df: Column, scheme: str) -> Column:
    return F.log((documents + 1) / (df + 1)) + 1 if scheme == "tfidf" else F.log((documents - df + 0.5) / (df + 0.5) + 1)


def weight(tf, idf, share, scheme: str):
    """The weight of a term in a document, from columns or arrays; share is the document's length by the mean length."""
    if scheme == "tfidf":
        return tf * idf
    return tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * share)) * idf


def _whole(corpus: DataFrame, text: str) -> DataFrame:
    """One row: _n documents, empty ones too, and their mean length."""
    return corpus.agg(F.count(F.lit(1)).alias("_n"), F.avg(F.size(tx.ascii_tokens(F.col(text)))).alias("_mean"))


def _terms(counts: DataFrame, corpus: DataFrame, scheme: str, text: str) -> DataFrame:
    """term, idf and _mean, the mean length of the documents.

    Document counts and mean length are over all documents, empty ones too. Two numbers go through the driver's
    plan as a one-row table.
    """
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # One row: its size doesn't depend on the data.
    return df.join(F.broadcast(_whole(corpus, text))).select("term", idf(F.col("_n"), F.col("df"), scheme).alias("idf"), "_mean")


def _postings(counts: DataFrame, terms: DataFrame, scheme: str, *names: str) -> DataFrame:
    return counts.join(terms, "term").select(*names, "term", "idf", weight(F.col("tf"), F.col("idf"), F.col("len") / F.col("_mean"), scheme).alias("w"))


def index(corpus: DataFrame, scheme: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings: key, term, idf, w (the weight of the term in the document)."""
    counts = term_counts(corpus, key, text)
    return _postings(counts, _terms(counts, corpus, scheme, text), scheme, key)


def document_frequency(corpus: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return term_counts(corpus, key, text).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def inverse_frequency(corpus: DataFrame, scheme: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    return _terms(term_counts(corpus, key, text), corpus, scheme, text).select("term", "idf")


def norms(corpus: DataFrame, scheme: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, norm: the length of the weight vector, 1 where it is 0 (documents without tokens too)."""
    found = index(corpus, scheme, key, text).groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return corpus.select(key).join(found, key, "left").select(key, F.when(F.col("_norm") > 0, F.col("_norm")).otherwise(1.0).alias("norm"))


def search(
    queries: DataFrame, corpus: DataFrame | SearchIndex, k: int, scheme: str = "bm25", query: str = "query_id", doc: str = "doc_id",
    position: str = "pos", text: str = "text",
) -> DataFrame:
    """query, rank, doc, score: the k best documents of each query.

    queries has (query, text), corpus (doc, position, text), or is a stored index (operators.index.SearchIndex), from which the same comes
    without a look at the corpus. Equal scores rank by the place in the query of its first term
    that the document has, then by position. Blocks of documents meet blocks of queries (operators.cells); queries are counted for that at once. A query without a hit gets the first document, with score 0.
    """
    if not isinstance(corpus, DataFrame):
        if corpus.scheme != scheme:
            raise ValueError(f"an index for {corpus.scheme}, not for {scheme}")
        return corpus.search(queries, k, query, doc, text)
    made = vectors(corpus, doc, position, text)
    terms = _terms(made.select(F.explode("terms.term").alias("term")), corpus, scheme, text).select("term", "idf")
    whole = _whole(corpus, text)
    docs = made.join(F.broadcast(whole)).select("doc", "pos", F.try_divide("len", "_mean").alias("share"), "terms")

    own = asked(queries, query, text)
    known = own.select("_q", F.explode("terms.term").alias("term")).join(terms, "term").select(F.col("_q").alias(query)).distinct()
    blocks = whole.select(cells.document_blocks(F.col("_n"), F.coalesce(F.col("_n") * F.col("_mean"), F.lit(0.0))).alias("_blocks"))
    placed = cells.best(docs, own, terms, blocks, cells.query_blocks(queries, text), k, partial(weight, scheme=scheme)).withColumnsRenamed({"_q": query, "doc": doc, "pos": position})
    order = Window.partitionBy(query).orderBy(F.round("score", 10).desc(), "_first", position)
    best = placed.where(F.col(doc).isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query, "rank", doc, "score")
    first = F.broadcast(corpus.agg(F.min_by(F.col(doc), F.col(position)).alias(doc)).where(F.col(doc).isNotNull()))
    missed = queries.select(query).join(known, query, "left_anti").join(first).select(
        query, F.lit(1).alias("rank"), doc, F.lit(0.0).alias("score"),
    )
    return best.unionByName(missed)


def context(hits: DataFrame) -> DataFrame:
    """query_id, context: the found exchanges as numbered blocks. hits has query_id, rank, customer_text, brand_text."""
    blocks = F.array_sort(F.collect_list(F.struct("rank", "customer_text", "brand_text")))
    block = lambda x: F.concat(
        F.lit("Example "), x["rank"].cast("string"), F.lit(":\nCustomer: "), x["customer_text"], F.lit("\nReply: "), x["brand_text"],
    )
    return hits.groupBy("query_id").agg(blocks.alias("_b")).select("query_id", F.array_join(F.transform("_b", block), "\n\n").alias("context"))
