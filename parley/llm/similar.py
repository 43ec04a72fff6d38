"""The similarity rule of operator 4: texts link if their word shingles have a Jaccard index of at least `similarity`.

Two bits of SimHash are a narrow rule: at an index of 0.8 fingerprints differ in about ten of 64 bits, and no covering
code reaches that far with a bearable number of copies. So the anchors of simhash.py are one source of candidates here
(fingerprints within two bits) and bands of minimum hashes the other, as many bands as leave a pair at that very index
unmet in one case of 10,000 (fewer above it). Every candidate is judged by the whole sets of shingle hashes (64 bits), so
no link is wrong.

Anchors and bands are buckets. In a bucket all that could connect two components is compared. A bucket of more than
`most` sets, or of more hashes than HASHES, is dealt into blocks, differently in each bucket, and each block is
compared on its own. Where the members of such a bucket aren't in one component after that, the pairs of its blocks are
compared too, in tasks of two blocks each. So a task never holds more than two blocks, and no link is lost.
"""

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import byte_rows, chunks, cut, discard, share_code

ROWS, MISSED, SEED = 5, 1e-4, 43
#: Sets in a block, and hashes in one (8 bytes each), on average.
MOST, HASHES = 250, 1 << 20
#: Bits of the bitmap that tells which texts are candidates at all: 8 MB, whatever the input.
BITS = 26
#: Bits of one of Spark's bitmaps.
_PART = 1 << 15


def bands_for(similarity: float) -> int:
    return 1 if similarity >= 1 else ceil(log(MISSED) / log(1 - similarity**ROWS))


@lru_cache(maxsize=4)
def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    turn, add = np.random.default_rng(SEED).integers(0, 1 << 63, (2, count * ROWS), np.uint64)
    return turn | np.uint64(1), add


def bands(hashes: np.ndarray, count: int) -> list[int]:
    """A signed number for each band of minimum hashes."""
    if not len(hashes):
        return []
    turn, add = _permutations(count)
    least = np.full(count * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):  # small blocks, however long the text
        mixed = hashes[at : at + 2048, None] * turn + add
        np.minimum(least, (mixed ^ mixed >> np.uint64(32)).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least.reshape(count, ROWS))]


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Of two sorted sets."""
    low, high = sorted((len(a), len(b)))
    if low < similarity * high:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (low + high - common) - 1e-9


def connect(sets: list[tuple[int, int, int, np.ndarray]], similarity: float, cross: bool = False) -> Iterator[tuple[int, int]]:
    """Edges that connect exactly what links connect, for (name, label, block, set); those that had most links are tried first.

    Equal labels are connected already. cross: only sets of different blocks are compared.
    """
    groups: list[tuple[set, list[list]]] = []  # labels; [links, name, block, set]
    for name, label, block, own in sets:
        labels, mine, rest = {label}, [[0, name, block, own]], []
        for group in groups:
            has, members = group
            if label not in has:
                hit = next((i for i, (_, _, place, other) in enumerate(members) if not (cross and place == block) and alike(own, other, similarity)), None)
                if hit is None:
                    rest.append(group)
                    continue
                members[hit][0] += 1
                yield name, members[hit][1]
                if hit and members[hit][0] > members[0][0]:
                    members[0], members[hit] = members[hit], members[0]
            labels |= has
            mine = members + mine if len(members) >= len(mine) else mine + members
        groups = [*rest, (labels, mine)]


def _candidate_texts(docs: DataFrame, names: DataFrame, key: str, text: str) -> tuple[DataFrame, Broadcast]:
    """node and _text of the texts that names (node, _k, _h) tells, and the bitmap of fixed size that keeps others out of the shuffle."""
    cell = F.pmod(F.col("_h"), F.lit(1 << BITS)) + 1  # Spark's bitmaps count from 1
    parts = names.select(cell.alias("c")).groupBy(F.bitmap_bucket_number("c").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("bits")
    ).collect()
    bitmap = bytearray((1 << BITS) // 8)
    for r in parts:  # of at most 2 ** BITS / _PART parts
        start = (r["part"] - 1) * _PART // 8
        bitmap[start : start + _PART // 8] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(bytes(bitmap))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            cells = batch.column(1).to_numpy() & ((1 << BITS) - 1)
            yield batch.filter(pa.array(bits[cells >> 3] >> (cells & 7).astype(np.uint8) & 1, pa.uint8()).cast(pa.bool_()))

    plain = docs.select(F.col(key).alias("_key"), F.xxhash64(F.col(text)).alias("_hash"), F.col(text).alias("_text"))
    found = plain.mapInArrow(told, plain.schema).join(names, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")))
    return found.select("node", "_text"), shared


def links(
    docs: DataFrame, distinct: DataFrame, key: str, text: str, hashes_of: Callable[[bytes], np.ndarray], similarity: float,
    components: Callable[[DataFrame], list[DataFrame]], follow: Callable[[DataFrame, list[DataFrame]], DataFrame], most: int = MOST,
) -> DataFrame:
    """a, b long: edges between the sets of distinct (node, size, buckets, and _least with a text of each), as a written table."""
    met = distinct.select("node", "size", F.explode("buckets").alias("bucket"))
    counted = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("who"), F.sum("size").alias("hashes")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / most), F.ceil(F.col("hashes") / HASHES)).cast("int")
    # Small buckets with the same members are looked at once.
    once = counted.withColumn("blocks", F.greatest(blocks, F.lit(1))).groupBy(
        "n", "who", "blocks", F.when(F.col("blocks") > 1, F.col("bucket")).alias("own"),
    ).agg(F.min("bucket").alias("bucket"))
    block = F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int")
    pairs = cut(met.join(once.select("bucket", "blocks"), "bucket").select("bucket", "blocks", block.alias("block"), "node"), "candidates")
    names = cut(
        distinct.join(pairs.select("node").distinct(), "node", "left_semi").select("node", F.col("_least.key").alias("_k"), F.col("_least.hash").alias("_h")),
        "named",
    )

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([np.unique(hashes_of(x or b"")).tobytes() for x in byte_rows(batch.column(1))], pa.binary())],
                names=["node", "hashes"],
            )

    texts, bitmap = _candidate_texts(docs, names, key, text)
    sets = cut(texts.mapInArrow(sets_of, "node long, hashes binary").dropDuplicates(["node"]), "sets")
    bitmap.destroy()

    def compare(cross: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sorted by bucket and part."""
            at, held = None, []

            def flush() -> pa.RecordBatch:
                found = list(connect(held, similarity, cross))
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

            for batch in batches:
                for bucket, part, node, label, block, body in zip(*(c.to_pylist() for c in batch.columns)):
                    if (bucket, part) != at and held:
                        yield flush()
                    at = bucket, part
                    held.append((node, label, block, np.frombuffer(body, np.uint64)))
            yield flush()

        return run

    def compared(rows: DataFrame, cross: bool) -> DataFrame:
        """rows: bucket, part, node, label, block."""
        dealt = rows.join(sets, "node").select(
            "bucket", "part", "node", "label", "block", "hashes",
        ).repartition("bucket", "part").sortWithinPartitions("bucket", "part")
        return dealt.mapInArrow(compare(cross), "a long, b long").distinct()

    edges = cut(compared(pairs.select("bucket", F.col("block").cast("string").alias("part"), "node", F.col("node").alias("label"), "block"), False), "edges")
    dealt = pairs.where("blocks > 1")
    if not dealt.isEmpty():
        root = follow(dealt.select("node").distinct().withColumn("_root", F.col("node")), components(edges)).select("node", F.col("_root").alias("label"))
        marked = cut(dealt.join(root, "node"), "dealt")
        apart = marked.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
        rest = marked.join(apart, "bucket").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block")
        part = F.concat_ws("-", F.least("block", "other"), F.greatest("block", "other"))
        edges = cut(edges.unionByName(compared(rest.select("bucket", part.alias("part"), "node", "label", "block"), True)), "edges")
        discard(marked)
    for table in (pairs, names, sets):
        discard(table)
    return edges
