"""The best documents of many queries without a row for each pair: blocks of documents meet blocks of queries.

A block of bounded size is one row, its words and how often they occur as Arrow bytes; documents' blocks have the idf of each different word too.
Blocks are shuffled once, as such rows, whatever there is on the other side: a Cartesian product reads those of documents anew for each block of
queries. A task takes one block of queries through a share of the documents, and only the k best of all that leave it. So what lies
on disk grows with queries plus documents; work grows with queries times documents.

Within a cell all documents get a score in single precision, for many queries at once: common terms by a product of matrices, rarer
ones by their documents. Its error is bounded, as no score is over 1, so only documents that reach the k best with that are
scored in double precision. The result is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.session import share_code

#: Documents of a block, entries (term and weight) of a block, queries of a block, and characters of their texts.
PART, ENTRIES, ASKED, CHARS = 16_384, 2_000_000, 32_768, 10_000_000
#: A term that one in so many documents of a block has is common; so many of them are taken at most. Queries of a product.
COMMON, DENSE, BATCH = 16, 512, 128
#: Partitions that blocks are made in, and tasks that pairs of blocks are dealt to, at least: they take long and are few.
DEALT = 96
#: Shares of the documents at least, each of which sends on the k best of every query.
SHARES = 8
#: Entries that are looked at together.
TOGETHER = 1_000_000
#: Scores are equal if they are after rounding to 10 digits.
SLACK = 1e-9
#: Maxima of so many documents each give a first threshold.
RUN = 64


def document_blocks(n: Column, tokens: Column, part: int | None = None) -> Column:
    """How many blocks n documents with so many tokens are dealt to."""
    return F.greatest(F.lit(1), F.ceil(n / (part or PART)), F.ceil(tokens / ENTRIES)).cast("int")


def query_blocks(queries: DataFrame, text: str) -> int:
    """How many blocks the queries are dealt to; runs a count of them."""
    sizes = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / ASKED), F.ceil(F.coalesce(F.sum(F.char_length(text)), F.lit(0)) / CHARS))
    return queries.agg(sizes.cast("int").alias("_asked")).first()["_asked"]


def best(docs: DataFrame, asked: DataFrame, terms: DataFrame, blocks: DataFrame, parts: int, k: int, weigh: Callable, bounded: bool = True) -> DataFrame:
    """_q, doc, pos, score, _first: the k best documents of each query in each share of the documents, among which are the k best of all.
    Where a share has none for a query, one row with score 0 and without a document, if the share has documents with terms.

    docs: doc, pos, share (length by mean length), terms (term, tf); asked: _q, terms (term, n, at), at
    being the term's first place in the query, terms that no document has too; terms: term, idf; blocks: one row, _blocks; parts: blocks of queries; weigh: a weight from tf, idf and
    share. Order is by score to 10 digits, the first place of a term that the document has (_first), pos.
    bounded: whether common terms are added up for all documents at once, and not for each that has them.
    """
    share_code(docs.sparkSession)
    of = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    # Terms are of letters and digits: as one text they take a third of the room.
    words = F.when(F.size("terms") > 0, F.array_join("terms.term", " ")).alias("words")
    numbers = lambda name: F.col(f"terms.{name}").cast("array<int>").alias(name)
    partitions = max(DEALT, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    plain = docs.where(F.size("terms") > 0).select("doc", "pos", F.col("share").cast("double").alias("share"), words, numbers("tf"))
    # One row: its size doesn't depend on the data.
    left = plain.crossJoin(F.broadcast(blocks)).select(of("doc", F.col("_blocks")).alias("_block"), *plain.columns).repartition(partitions, "_block")
    right = asked.select(of("_q", F.lit(parts)).alias("_block"), "_q", words, numbers("n"), numbers("at")).repartition(partitions, "_block")

    def blocked(rows: DataFrame, make: Callable, schema: str) -> DataFrame:
        own = rows.groupBy("_block").applyInArrow(_different, T.StructType([rows.schema["_block"], T.StructField("term", T.StringType())]))
        known = own.join(terms, "term").select("_block", "term", "idf").repartition(partitions, "_block")
        return rows.groupBy("_block").cogroup(known.groupBy("_block")).applyInArrow(make, schema)

    made, listed = blocked(left, _documents, "_block int, docs binary, known binary"), blocked(right, _queries, "_part int, asked binary")
    # One block of queries for each partition; what was made isn't made again for each pair.
    shares = max(SHARES, -(-DEALT // parts))
    pairs = made.repartitionById(shares, F.col("_block")).crossJoin(listed.repartitionById(parts, F.col("_part")).hint("shuffle_replicate_nl"))
    schema = T.StructType(
        [right.schema["_q"], *(T.StructField(c, left.schema[c].dataType) for c in ("doc", "pos")), T.StructField("score", T.DoubleType()), T.StructField("_first", T.IntegerType())]
    )

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Best] = {}
        for batch in batches:
            for part, asked, docs, known in zip(*(batch.column(x) for x in ("_part", "asked", "docs", "known"))):
                if part.as_py() not in found:
                    found[part.as_py()] = Best(_table(asked), k)
                rows = _table(docs)
                found[part.as_py()].add(rows, Block(rows, _table(known), k, weigh, bounded))
        for own in found.values():
            yield from own.rows().to_batches()

    return pairs.mapInArrow(within, schema)


def _bytes(rows: pa.Table) -> pa.Array:
    """A table as one value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows.combine_chunks())
    return pa.array([sink.getvalue().to_pybytes()], pa.binary())


def _table(value: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(value.as_buffer()).read_all()


def _documents(docs: pa.Table, known: pa.Table) -> pa.Table:
    """A block of documents as one row."""
    if not docs.num_rows:
        return pa.table({"_block": pa.array([], pa.int32()), "docs": pa.array([], pa.binary()), "known": pa.array([], pa.binary())})
    return pa.table({"_block": docs["_block"][:1], "docs": _bytes(docs.drop_columns("_block")), "known": _bytes(known.select(["term", "idf"]).sort_by("term"))})


def _queries(rows: pa.Table, known: pa.Table) -> pa.Table:
    """A block of queries as one row, each with the length of its vector (norm)."""
    if not rows.num_rows:
        return pa.table({"_part": pa.array([], pa.int32()), "asked": pa.array([], pa.binary())})
    codes = pc.fill_null(pc.index_in(_words(rows), value_set=known["term"].combine_chunks()), -1).to_numpy(zero_copy_only=False)
    # A term that no document has counts nothing.
    w = _numbers(rows, "n") * np.append(known["idf"].to_numpy(), 0.0)[codes]
    norm = np.sqrt(np.bincount(np.repeat(np.arange(rows.num_rows), np.diff(_starts(rows, "n"))), w * w, rows.num_rows))
    return pa.table({"_part": rows["_block"][:1], "asked": _bytes(rows.drop_columns("_block").append_column("norm", pa.array(norm, pa.float64())))})


def _different(docs: pa.Table) -> pa.Table:
    """The different words of a block's documents or queries."""
    found = pc.unique(_words(docs)).drop_null()
    return pa.table({"_block": pa.array(np.full(len(found), docs["_block"][0].as_py(), np.int32)), "term": found})


def _words(rows: pa.Table) -> pa.Array:
    return pc.list_flatten(pc.split_pattern(rows["words"].combine_chunks(), " "))


def _numbers(rows: pa.Table, name: str) -> np.ndarray:
    return pc.list_flatten(rows[name].combine_chunks()).to_numpy(zero_copy_only=False)


def _starts(rows: pa.Table, name: str) -> np.ndarray:
    """Where the entries of each row start, and the last end."""
    sizes = pc.fill_null(pc.list_value_length(rows[name].combine_chunks()), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


class Best:
    """The k best documents of a block of queries, of those that were added so far."""

    def __init__(self, queries: pa.Table, k: int):
        self.queries, self.k = queries, k
        self.found: pa.Table | None = None
        #: What a document must reach: the score of the kth.
        self.floor = np.zeros(queries.num_rows)

    def add(self, docs: pa.Table, block: Block) -> None:
        q, d, scores, first = block.best(self.queries, self.floor)
        d = pa.array(d, pa.int64())
        more = pa.table(
            {"q": pa.array(q, pa.int64()), "doc": docs["doc"].take(d), "pos": docs["pos"].take(d), "score": pa.array(scores, pa.float64()), "_first": pa.array(first, pa.int32())}
        )
        both = pa.concat_tables([self.found, more]) if self.found else more
        q, scores, first = (both[x].to_numpy() for x in ("q", "score", "_first"))
        order = np.lexsort((_places(both), first, -np.round(scores, 10), q))
        ranks = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        self.found = both.take(pa.array(order[ranks < self.k])).combine_chunks()
        last = order[ranks == self.k - 1]
        self.floor[q[last]] = scores[last]

    def rows(self) -> pa.Table:
        """_q, doc, pos, score, _first; for queries without a document a row without one."""
        lost = np.setdiff1d(np.arange(self.queries.num_rows), self.found["q"].to_numpy())
        none = {c: pa.nulls(len(lost), self.found.schema.field(c).type) for c in ("doc", "pos")}
        last = {"score": pa.array(np.zeros(len(lost))), "_first": pa.array(np.full(len(lost), np.iinfo(np.int32).max, np.int32))}
        both = pa.concat_tables([self.found, pa.table({"q": pa.array(lost, pa.int64()), **none, **last})])
        return both.select(["doc", "pos", "score", "_first"]).add_column(0, "_q", self.queries["_q"].take(both["q"].combine_chunks()))


def _places(rows: pa.Table) -> np.ndarray:
    """The place of each row in the order of pos."""
    return pc.rank(rows["pos"].combine_chunks(), sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()


class Block:
    """The documents of a block, by document and by term. known: term, idf of all their terms, in order of terms."""

    def __init__(self, docs: pa.Table, known: pa.Table, k: int, weigh: Callable, bounded: bool):
        self.k = k
        self.vocabulary, self.idf = known["term"].combine_chunks(), known["idf"].to_numpy()
        starts = _starts(docs, "tf")
        sizes = np.diff(starts)
        of = np.repeat(np.arange(len(sizes)), sizes)
        codes = pc.index_in(_words(docs), value_set=self.vocabulary).to_numpy(zero_copy_only=False)
        order = np.lexsort((codes, of))
        codes = codes[order].astype(np.int32)
        w = weigh(_numbers(docs, "tf")[order].astype(float), self.idf[codes], docs["share"].to_numpy()[of])
        norm = np.sqrt(np.bincount(of, w * w, len(sizes)))
        w /= np.where(norm > 0, norm, 1.0)[of]
        places = _places(docs)

        # Of documents with the same vector the first k are enough.
        seen: dict = {}
        kept = np.zeros(len(sizes), bool)
        for d in np.argsort(places):
            key = codes[starts[d] : starts[d + 1]].tobytes(), w[starts[d] : starts[d + 1]].tobytes()
            seen[key] = seen.get(key, 0) + 1
            kept[d] = seen[key] <= k
        there = np.repeat(kept, sizes)
        self.rows, self.places, self.codes, self.w = np.flatnonzero(kept), places[kept], codes[there], w[there]
        self.sizes = sizes[kept]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.n = len(self.rows)

        of = np.repeat(np.arange(self.n), self.sizes)
        by_term = np.argsort(self.codes, kind="stable")
        df = np.bincount(self.codes, minlength=len(self.vocabulary))
        self.docs_of, self.w_of, self.ends = of[by_term], self.w[by_term].astype(np.float32), np.concatenate([[0], np.cumsum(df)])
        most = np.argsort(-df, kind="stable")[:DENSE]
        most = most[df[most] > self.n / COMMON] if bounded else most[:0]
        self.column = np.full(len(df), -1)
        self.column[most] = np.arange(len(most))
        # Runs of zeros at the end, so that all have the same length.
        self.dense = np.zeros((len(most), -(-self.n // RUN) * RUN), np.float32)
        for i, t in enumerate(most):
            self.dense[i, self.docs_of[self.ends[t] : self.ends[t + 1]]] = self.w_of[self.ends[t] : self.ends[t + 1]]

    def best(self, queries: pa.Table, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query, document (both by place in the tables), score and first place of the best. floor: documents below that (for each query) aren't needed."""
        starts = _starts(queries, "n")
        codes = pc.fill_null(pc.index_in(_words(queries), value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)
        # A term that no document of the block has is left out below.
        norm = queries["norm"].to_numpy()
        qw = _numbers(queries, "n") * self.idf[codes] / np.repeat(np.where(norm > 0, norm, 1.0), np.diff(starts))
        at = _numbers(queries, "at")
        # Equal queries are answered once.
        known: dict = {}
        of = []
        for q in range(len(starts) - 1):
            own = slice(starts[q], starts[q + 1])
            has = np.flatnonzero(codes[own] >= 0) + starts[q]
            if len(has):
                has = has[np.argsort(codes[has])]
                key = codes[has].tobytes(), qw[has].tobytes(), at[has].tobytes()
                of.append((q, known.setdefault(key, (len(known), has))[0]))
        if not of:
            return (np.zeros(0, int),) * 4
        listed = [has for _, has in known.values()]
        least = np.full(len(listed), np.inf if floor is not None else 0.0)
        if floor is not None:
            np.minimum.at(least, [i for _, i in of], floor[[q for q, _ in of]])
        found: list = []
        for lo in range(0, len(listed), BATCH):
            found += self._batch([(codes[has], qw[has], at[has]) for has in listed[lo : lo + BATCH]], least[lo : lo + BATCH])
        sizes = [len(found[i][0]) for _, i in of]
        docs, scores, first = (np.concatenate([found[i][j] for _, i in of]) for j in range(3))
        return np.repeat([q for q, _ in of], sizes), self.rows[docs], scores, first

    def _batch(self, queries: list[tuple[np.ndarray, np.ndarray, np.ndarray]], least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each query (terms, weights, first places) the best documents that score `least`, their scores and first places."""
        common = np.zeros((len(queries), len(self.dense)), np.float32)
        for i, (c, v, _) in enumerate(queries):
            late = self.column[c] >= 0
            common[i, self.column[c[late]]] = v[late]
        total = common @ self.dense if len(self.dense) else np.zeros((len(queries), self.dense.shape[1]), np.float32)
        for i, (c, v, _) in enumerate(queries):
            own, rare = total[i], self.column[c] < 0
            for t, x in zip(c[rare].tolist(), v[rare].astype(np.float32)):
                lo, hi = self.ends[t], self.ends[t + 1]
                own[self.docs_of[lo:hi]] += self.w_of[lo:hi] * x
        # What k documents have at least: both that and each score may be off by the rounding of each of the query's terms.
        tops = total.reshape(len(queries), -1, RUN).max(axis=2)
        tops = tops if tops.shape[1] >= self.k else total
        reached = np.partition(tops, -self.k, axis=1)[:, -self.k].astype(float) if tops.shape[1] >= self.k else np.zeros(len(queries))
        sizes = np.array([len(c) for c, _, _ in queries])
        reached = np.maximum(reached, least) - (SLACK + 4 * (sizes + 8) * float(np.finfo(np.float32).eps))
        # At least the smallest number over 0: only documents with a term of the query.
        q, d = np.nonzero(total >= np.maximum(reached, np.finfo(np.float32).smallest_subnormal)[:, None].astype(np.float32))
        terms = np.concatenate([c for c, _, _ in queries]) + np.repeat(np.arange(len(queries)), sizes) * len(self.vocabulary)
        v, a = np.concatenate([x for _, x, _ in queries]), np.concatenate([x for _, _, x in queries])
        scores, first = np.zeros(len(q)), np.zeros(len(q), np.int32)
        ends = np.cumsum(self.sizes[d])
        lo = 0
        while lo < len(q):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TOGETHER, "right")))
            scores[lo:hi], first[lo:hi] = self._exact(q[lo:hi], d[lo:hi], terms, v, a)
            lo = hi
        order = np.lexsort((self.places[d], first, -np.round(scores, 10), q))
        ranks = np.arange(len(q)) - np.searchsorted(q, q)
        order = order[ranks < self.k]
        cuts = np.searchsorted(q[order], np.arange(1, len(queries)))
        return list(zip(*(np.split(x[order], cuts) for x in (d, scores, first))))

    def _exact(self, q: np.ndarray, d: np.ndarray, terms: np.ndarray, v: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and first places of pairs; terms: what the queries have (query and term as one number, in order), v and a: their weights and places."""
        sizes = self.sizes[d]
        heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at = np.repeat(self.starts[d] - heads, sizes) + np.arange(sizes.sum())
        asked = np.repeat(q * len(self.vocabulary), sizes) + self.codes[at]
        place = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
        there = terms[place] == asked
        scores = np.add.reduceat(np.where(there, v[place] * self.w[at], 0.0), heads)
        return scores, np.minimum.reduceat(np.where(there, a[place], np.iinfo(np.int32).max), heads)
