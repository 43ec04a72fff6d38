"""Operator 4, SimHash near-dedup by anchor-point covering.

Fingerprints have 64 bits, each the majority of that bit over the hashes of a text's word shingles. Two
fingerprints link if at most `threshold` bits differ (two; fewer can be asked for). The anchors are the words of a covering code: the perfect Hamming
code over 63 bits (radius 1), once for either value of the 64th bit. Linked fingerprints have a point midway, at
most one bit from both; the anchor that covers it is at most radius + 1 bits from both. So each distinct
fingerprint is copied to every anchor within the radius plus half the threshold, 33 of them at most, and links
are looked for per anchor: any link meets at an anchor. A ball of that size holds at most 2,081 fingerprints, so
no group at an anchor can be large whatever the data: exact copies are one fingerprint before that.

Per anchor only a forest that connects the linked fingerprints goes on, no list of pairs. Components come from
rounds of contraction: each fingerprint takes the least neighbour in a pseudo-random order, and the edges are
drawn between those; a constant share of the fingerprints goes in each round. Every round is a written table.

With `similarity` given, texts link by the Jaccard index of their shingles instead of by bits (see similar.py): what the
anchors bring together is a candidate then, and bands of minimum hashes bring the candidates that two bits can't reach.

Defined cases: texts without words, null ones too, have fingerprint zero and link like any other; an empty table
gives an empty result; repeated rows are copies; other columns of the input, whatever their names, are ignored.
A null key is kept in its row and never names a component unless all keys of the component are null. Texts of fewer
words than a shingle are one shingle; very long ones are hashed whole.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import similar
from parley.llm.common import byte_rows, chunks, cut, discard, share_code

SEED = 42
#: The widest link that the anchors cover: twice the radius of the code.
THRESHOLD = 2
#: Fingerprints with more than this share of the rows are joined by broadcast, at most its inverse of them.
HOT_SHARE = 1 / 1000


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """The unsigned hashes of a text's shingles, repeats included."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(line, SEED)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - shingle] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(line)]
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint, as a signed 64-bit integer: the bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(most, bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, shingle: int) -> int:
    """The fingerprint of a text's bytes."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """key, fp long, text_hash long."""
    share_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            made = [fingerprint(x or b"", shingle) for x in byte_rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64()), batch.column(2)], names=[key, "fp", "text_hash"])

    chosen = docs.select(F.col(key), F.col(text).alias("_text"), F.xxhash64(F.col(text)).alias("text_hash"))
    return chosen.mapInArrow(run, T.StructType([docs.schema[key], T.StructField("fp", T.LongType()), T.StructField("text_hash", T.LongType())]))


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Of the low 63 bits, under the check matrix whose column for bit i is i + 1: the place of the error, or 0."""
    out = np.zeros(x.shape, np.uint64)
    for k in range(6):
        mask = np.uint64(sum(1 << i for i in range(63) if (i + 1) >> k & 1))
        out |= (np.bitwise_count(x & mask).astype(np.uint64) & np.uint64(1)) << np.uint64(k)
    return out


def anchors(fp: np.ndarray) -> np.ndarray:
    """A row for each fingerprint: the anchors of all points at most one bit away, with repetitions (65 columns)."""
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    columns = np.concatenate([[0], np.arange(1, 64), [0]]).astype(np.uint64)
    wrong = _syndrome(fp)[:, None] ^ columns
    mend = np.where(wrong > 0, np.uint64(1) << (np.maximum(wrong, np.uint64(1)) - np.uint64(1)), np.uint64(0))
    return fp[:, None] ^ flips ^ mend


def _forest(fp: np.ndarray, threshold: int) -> Iterator[tuple[int, int]]:
    """(fingerprint, least one), signed, for those of one anchor that links connect."""
    signed = fp.view(np.int64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= threshold
    label = np.arange(len(fp))
    while True:
        least = np.where(near, label[None, :], len(fp)).min(axis=1)
        if (least == label).all():
            break
        label = least
    for i in np.flatnonzero(label != np.arange(len(fp))).tolist():
        yield int(signed[i]), int(signed[label[i]])


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """a, b long: edges that connect exactly the fingerprints (column fp, distinct) that links connect."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"the anchors cover links of up to {THRESHOLD} bits")
    share_code(distinct.sparkSession)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fp), 20_000):
                part = fp[at : at + 20_000]
                found = np.sort(anchors(part), axis=1)
                new = np.ones(found.shape, bool)
                new[:, 1:] = found[:, 1:] != found[:, :-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[new].view(np.int64)), pa.array(np.repeat(part, new.sum(axis=1)).view(np.int64))],
                    names=["anchor", "fp"],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by anchor. The edges of a task are thinned to a forest before they leave it."""
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.get(root, root) != root:
                root = parent[root]
            while parent.get(x, x) != root:
                parent[x], x = root, parent[x]
            return root

        def flush() -> pa.RecordBatch:
            rows = [(x, r) for x in parent if (r := find(x)) != x]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], names=["a", "b"])

        def groups(anchor: np.ndarray, fp: np.ndarray) -> None:
            edges = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]])
            size = np.diff(edges)
            two = edges[:-1][size == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= threshold]
            found = [(int(a), int(b)) for a, b in zip(fp[two].view(np.int64).tolist(), fp[two + 1].view(np.int64).tolist())]
            for a, n in zip(edges[:-1][size > 2].tolist(), size[size > 2].tolist()):
                found.extend(_forest(fp[a : a + n], threshold))
            for a, b in found:
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    parent.setdefault(min(x, y), min(x, y))

        rest_anchor, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = np.concatenate([rest_anchor, batch.column(0).to_numpy()])
            fp = np.concatenate([rest_fp, batch.column(1).to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(anchor, anchor[-1]))  # the last group may go on
            groups(anchor[:whole], fp[:whole])
            rest_anchor, rest_fp = anchor[whole:], fp[whole:]
            if len(parent) > 500_000:
                yield flush()
        if len(rest_anchor):
            groups(rest_anchor, rest_fp)
        yield flush()

    met = distinct.select("fp").mapInArrow(spread, "anchor long, fp long").repartition("anchor").sortWithinPartitions("anchor")
    return met.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> list[DataFrame]:
    """Contraction maps (node long, to long), in order: following them from any node ends at one node per component."""
    maps, current = [], cut(edges, "edges")
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    while not current.isEmpty():
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        step = cut(least.select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["n"].alias("to")), "step")
        maps.append(step)
        left = current.join(
            step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a",
        ).join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        after = cut(left.where("ta <> tb").select(F.greatest("ta", "tb").alias("a"), F.least("ta", "tb").alias("b")).distinct(), "edges")
        discard(current)
        current = after
    return maps


def follow(nodes: DataFrame, maps: list[DataFrame]) -> DataFrame:
    """nodes with _root moved to the node that stands for its component."""
    for step in maps:
        nodes = nodes.join(step.withColumnRenamed("node", "_root"), "_root", "left").withColumn("_root", F.coalesce("to", "_root")).drop("to")
    return nodes


def marks(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """key, node long (one for each set of shingles), text_hash long, size long, buckets array of long: anchors and bands."""
    share_code(docs.sparkSession)
    count = similar.bands_for(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            hashes = [shingle_hashes(x or b"", shingle) for x in byte_rows(batch.column(1))]
            at = anchors(np.array([majority(x) for x in hashes], np.int64).view(np.uint64)).view(np.int64)
            sets = [np.unique(x) for x in hashes]
            nodes = [xxhash.xxh64_intdigest(x.tobytes(), SEED) - (1 << 63) for x in sets]
            # Texts without words are one set: nothing else can be like them.
            buckets = [[*similar.bands(x, count), *np.unique(a).tolist()] if len(x) else [] for x, a in zip(sets, at)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(nodes, pa.int64()), batch.column(2), pa.array(list(map(len, sets)), pa.int64()),
                    pa.array(buckets, pa.list_(pa.int64())),
                ],
                names=[key, "node", "text_hash", "size", "buckets"],
            )

    schema = T.StructType(
        [docs.schema[key], *(T.StructField(c, T.LongType()) for c in ("node", "text_hash", "size")), T.StructField("buckets", T.ArrayType(T.LongType()))]
    )
    return docs.select(F.col(key), F.col(text).alias("_text"), F.xxhash64(F.col(text)).alias("text_hash")).mapInArrow(run, schema)


def _named(docs: DataFrame, key: str, text: str, shingle: int, threshold: int, similarity: float | None, most: int) -> tuple[DataFrame, DataFrame]:
    """(key, node, text_hash) of every row, and of every node _first (the least key and text hash of its component) and _copies."""
    least = F.min(F.struct(F.col(key).isNull().alias("no"), F.col(key).alias("key"), F.col("text_hash").alias("hash")))
    if similarity is None:
        marked = cut(fingerprints(docs, key, text, shingle).withColumnRenamed("fp", "node"), "fingerprints")
        distinct = cut(marked.groupBy("node").agg(least.alias("_least"), F.count(F.lit(1)).alias("_copies")), "distinct")
        edges = links(distinct.withColumnRenamed("node", "fp"), threshold)
    else:
        marked = cut(marks(docs, key, text, shingle, similarity), "fingerprints")
        distinct = cut(
            marked.groupBy("node").agg(
                least.alias("_least"), F.count(F.lit(1)).alias("_copies"), F.first("size").alias("size"),
                F.first("buckets").alias("buckets"),
            ),
            "distinct",
        )
        edges = similar.links(docs, distinct, key, text, lambda x: shingle_hashes(x, shingle), similarity, components, follow, most)
    # Where nothing was linked, a node is its own component.
    maps = components(edges)
    root = cut(follow(distinct.select("node", "_least", "_copies", F.col("node").alias("_root")), maps), "roots")
    named = cut(root.join(root.groupBy("_root").agg(F.min("_least").alias("_first")), "_root").select("node", "_first", "_copies"), "components")
    for table in (distinct, root, *maps):
        discard(table)
    return marked.select(key, "node", "text_hash"), named


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, threshold: int = THRESHOLD, similarity: float | None = None,
    most: int = similar.MOST,
) -> DataFrame:
    """key, fp long, text_hash long, component_id, representative boolean.

    component_id is the least key reachable over links of at most threshold differing bits; the representative rows
    are those with that key and, if different texts have it, the least text hash. With similarity, links are those of
    similar.py (most: sets in a block there), and instead of fp there is node, a hash of the set of shingles.
    """
    marked, named = _named(docs, key, text, shingle, threshold, similarity, most)
    # One node may have a third of the rows: the few with so many are told to every task, the others are joined.
    hot_at = max(1, int((named.agg(F.sum("_copies")).first()[0] or 0) * HOT_SHARE))
    hot = named.where(F.col("_copies") > hot_at).select("node", F.col("_first").alias("_hot"))
    cold = named.where(F.col("_copies") <= hot_at).select("node", "_first")
    known = marked.join(F.broadcast(hot), "node", "left")
    both = known.where(F.col("_hot").isNotNull()).withColumnRenamed("_hot", "_first").unionByName(
        known.where(F.col("_hot").isNull()).drop("_hot").join(cold, "node")
    )
    chosen = F.col("_first.key").eqNullSafe(F.col(key)) & F.col("_first.hash").eqNullSafe(F.col("text_hash"))
    name = F.col("node").alias("fp" if similarity is None else "node")
    return both.select(key, name, "text_hash", F.col("_first.key").alias("component_id"), chosen.alias("representative"))


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, threshold: int = THRESHOLD, similarity: float | None = None,
    most: int = similar.MOST,
) -> DataFrame:
    """One row of docs for each component of near_duplicates(): that of its least key, and of repeated such rows one.

    Columns of docs named _k, _h or _many are left out.
    """
    docs = docs.drop("_k", "_h", "_many")
    marked, named = _named(docs, key, text, shingle, threshold, similarity, most)
    discard(marked)
    kept = cut(named.groupBy(F.col("_first.key").alias("_k"), F.col("_first.hash").alias("_h")).agg((F.sum("_copies") > 1).alias("_many")), "kept")
    discard(named)
    rows = docs.join(kept, F.col(key).eqNullSafe(F.col("_k")) & (F.xxhash64(F.col(text)) == F.col("_h")))
    # Only of copies can the row itself be repeated: the other texts aren't shuffled once more.
    once = rows.where("_many").dropDuplicates(["_k", "_h"])
    return rows.where("not _many").unionByName(once).select(*docs.columns)
