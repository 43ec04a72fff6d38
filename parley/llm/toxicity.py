"""Operator 7, toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features are the distinct words, the stems of longer words, pairs of neighbouring words and pairs with one word
between, hashed to 2 ** BITS places. Each place has its own learning rate, and the L1 term keeps the weights of most at zero, so the model is
a short list of places and weights that is broadcast. It is fitted on the driver on at most `sample` different labelled
texts with at most `most_places` features in all, chosen by a hash of their key (documented bounds: the rest of the
labels are left out); all rows are scored, whole texts.

Defined cases: null and empty texts have no feature and get the score of the bias alone; rows whose label is
null or not 0 or 1 aren't learned from; without usable labels every score is 0; rows that repeat a key, a label and a text are
learned from once, in an order that their hashes decide, and get equal scores; other
columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import chunks, cut, discard, share_code
from parley.llm.words import WORD_BYTES, Words, mix, pairs

BITS = 20
SAMPLE, MOST_PLACES = 10_000, 20_000_000
#: The L1 penalty, the best of 2, 4, 6, 8 and 12 in a five-fold comparison on learning rows alone.
PENALTY = 8.0
_PARTS = 10**9
#: Beyond so many weights the model isn't broadcast but refused (8 bytes each); it has a few hundred.
MOST_WEIGHTS = 100_000
#: Inflected words also count by their first bytes, so many of them.
STEMS = (4, 6)
_GAP = np.uint64(0x5851F42D4C957F2D)


@dataclass
class Model:
    """place: ascending; weight: of the same length."""

    place: np.ndarray
    weight: np.ndarray
    bias: float


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every word, pair and skip-pair of a chunk, with repetitions."""
    words = Words(column, WORD_BYTES)
    if not len(words.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, h = words.row().astype(np.int64), words.hashes()
    near, far = row[1:] == row[:-1], row[2:] == row[:-2]
    two, skip = pairs(h[:-1], h[1:])[near], pairs(h[:-2] ^ _GAP, h[2:])[far]
    rows, found = [row, row[:-1][near], row[:-2][far]], [mix(h), two, skip]
    for size in STEMS:
        longer = words.end - words.start > size
        rows.append(row[longer])
        found.append(mix(words.heads(size)[longer] ^ _GAP ^ np.uint64(size)))
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def fit(rows: Iterator[tuple[np.ndarray, int]], alpha: float = 0.5, beta: float = 1.0, l1: float = PENALTY, l2: float = 1.0, rounds: int = 4) -> Model:
    """FTRL-proximal over (distinct places, label), in the given order, `rounds` times."""
    rows = list(rows)
    size = (1 << BITS) + 1  # the last place is the bias, which has no penalty
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(rounds):
        for places, label in rows:
            at = np.append(places, size - 1)
            za, na = z[at], n[at]
            root = np.sqrt(na)
            penalty = np.full(len(at), l1)
            penalty[-1] = 0
            w = np.where(np.abs(za) <= penalty, 0, -(za - np.sign(za) * penalty) / ((beta + root) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            z[at] = za + g - (np.sqrt(na + g * g) - root) / alpha * w
            n[at] = na + g * g
    root = np.sqrt(n)
    penalty = np.full(size, l1)
    penalty[-1] = 0
    w = np.where(np.abs(z) <= penalty, 0, -(z - np.sign(z) * penalty) / ((beta + root) / alpha + l2))
    place = np.flatnonzero(w[:-1])
    return Model(place, w[place], float(w[-1]))


def train(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic",
    sample: int = SAMPLE, most_places: int = MOST_PLACES, l1: float = PENALTY,
) -> Model | None:
    """A model from at most sample labelled texts; usable: a condition over the key column of labels."""
    share_code(docs.sparkSession)
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    # A hash takes about twice the sample before any row is sorted, however many labels there are.
    share = 2 * sample * _PARTS // max(1, rows.agg(F.approx_count_distinct(key)).first()[0]) + 1
    thin = rows.where(F.pmod(F.xxhash64(key), F.lit(_PARTS)) < share)
    mixed = F.xxhash64(F.xxhash64("_k"))
    chosen = thin.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).distinct().orderBy(mixed, "_k", "_y").limit(sample)
    plain = docs.select(F.col(key).alias("_key"), F.xxhash64(F.col(text)).alias("_h"), F.col(text).alias("_text"))
    marked = plain.join(F.broadcast(chosen), F.col("_key") == F.col("_k"))  # at most sample rows are broadcast
    # A key may have many texts: of the pairs of them at most `sample` again.
    pairs = marked.select("_k", "_y", "_h").distinct().orderBy(mixed, "_k", "_y", "_h").limit(sample)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            row, place = features(batch.column(3))
            both = np.unique(row << BITS | place)
            cuts = np.searchsorted(both >> BITS, np.arange(1, batch.num_rows))
            low = (both & (1 << BITS) - 1).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([x.tobytes() for x in np.split(low, cuts)], pa.binary())], names=["k", "y", "h", "places"],
            )

    told = F.broadcast(pairs.select(F.col("_k").alias("_k2"), F.col("_y").alias("_y2"), F.col("_h").alias("_h2")))
    texts = marked.join(told, (F.col("_k") == F.col("_k2")) & (F.col("_y") == F.col("_y2")) & (F.col("_h") == F.col("_h2"))).dropDuplicates(["_k", "_y", "_h"])
    made = cut(
        texts.select(F.xxhash64("_k").alias("k"), "_y", F.col("_h").alias("h"), "_text").mapInArrow(places, "k long, y int, h long, places binary"),
        "places",
    )
    order = made.select("k", "y", "h", F.octet_length("places").alias("n")).toArrow().sort_by([(c, "ascending") for c in ("k", "y", "h")])
    if not order.num_rows:
        return None
    # From the start of that order, as many as have most_places places together.
    fits = max(1, int(np.searchsorted(np.cumsum(order.column("n").to_numpy()), 4 * most_places, side="right")))
    last = [order.column(c)[min(fits, order.num_rows) - 1].as_py() for c in ("k", "y", "h")]
    own = F.struct("k", "y", "h") <= F.struct(F.lit(last[0]).cast("long"), F.lit(last[1]).cast("int"), F.lit(last[2]).cast("long"))
    taken = made.where(own).toArrow().sort_by([(c, "ascending") for c in ("k", "y", "h")])
    model = fit(((np.frombuffer(p, "<u4"), y) for p, y in zip(taken.column("places").to_pylist(), taken.column("y").to_pylist())), l1=l1)
    discard(made)
    return model


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score double: from 0 to 1, higher where the label 1 is likelier."""
    share_code(docs.sparkSession)
    if model is None:
        return docs.select(F.col(key), F.lit(0.0).alias("score"))
    if len(model.place) > MOST_WEIGHTS:
        raise ValueError("the model is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast((model.place.astype(np.int32), model.weight.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, weight, bias = shared.value
        table = np.zeros(1 << BITS, np.float32)
        table[place] = weight
        for batch in chunks(batches, "_text"):
            row, at = features(batch.column(1))
            live = np.flatnonzero(table[at])
            both = np.unique(row[live] << BITS | at[live])  # a feature counts once in a document
            total = np.bincount(both >> BITS, table[both & (1 << BITS) - 1], batch.num_rows) + bias
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=[key, "score"])

    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, T.StructType([docs.schema[key], T.StructField("score", T.DoubleType())]))
