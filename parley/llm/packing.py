"""Operator 2, best-fit packing by sums of squares.

Texts are encoded, cut into pieces of at most `limit` tokens and placed into sequences, the longest first. Of the
open bins with room, a piece goes to the one that makes the sum over all residual gaps of (number of open bins
with that gap) squared smallest. A piece of the full length is a sequence by itself and isn't dealt at all; of the
others a document has one at most, so that their number, which sets the number of groups, is bounded by that of the
documents. They are dealt by a hash of their place in a written table, so that equal rows are spread too, into
groups of about `group` pieces, each packed on its own. The bins that stay partly open are then packed once more, as
units and in larger groups, by the same rule, so that the groups of the first round cost next to no fill.

Defined cases: a null text is an empty one (its only token is the end token). Repeated rows are packed as often
as they occur; an empty table gives an empty result; other columns are ignored; a null key is carried along.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.bpe import encoder
from parley.llm.common import chunks, cut, share_code

#: Pieces in a group of the first round, on average, and bins in one of the second.
GROUP = 8192


def pieces(docs: DataFrame, path: str, limit: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """key, piece int, start long, length long, ids_crc32 long, and with keep_ids ids binary (little-endian, 32 bits each).

    A document is its ids and then the end token. Only one longer than limit is cut; its first piece takes the
    remainder and all others have limit tokens.
    """
    share_code(docs.sparkSession)
    kind = docs.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField(key, kind), T.StructField("piece", T.IntegerType()),
            *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")),
            *([T.StructField("ids", T.BinaryType())] if keep_ids else []),
        ]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, tail, size = encoder(path), int(end).to_bytes(4, "little"), 4 * limit
        for batch in chunks(batches, "_text"):
            rows, out = [], ([], [], [], [], [])
            for row, value in enumerate(batch.column(1).to_pylist()):
                ids = (codec.encode(value) if value else b"") + tail
                first = len(ids) % size or min(size, len(ids))
                for n, (a, b) in enumerate(zip([0, *range(first, len(ids), size)], range(first, len(ids) + 1, size))):
                    rows.append(row)
                    for column, x in zip(out, (n, a // 4, (b - a) // 4, zlib.crc32(ids[a:b]), ids[a:b])):
                        column.append(x)
            made = [pa.array(x, k) for x, k in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))][: 5 if keep_ids else 4]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *made], names=schema.fieldNames())

    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(encode, schema)


def place(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each size, in the given order; the rule of sums of squares decides.

    Into a bin of level h: the number of bins at h falls by one and that at h + s rises by one, which changes
    the sum of squares by 2 * (n[h + s] - n[h]) + 2, or by 1 - 2 * n[h] if that fills it (a full bin isn't open).
    Ties go to the fullest bin. A new bin is opened only where no open one has room: sizes come in descending
    order, so any room that is left must be used by what is still to come.
    """
    levels = np.zeros(limit + 1, np.int64)  # bins by level
    at: list[list[int]] = [[] for _ in range(limit + 1)]
    bins, offsets, used = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    none = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        if s >= limit:
            bins[i], offsets[i] = used, 0
            used += 1
            continue
        top = limit - s
        here, there = levels[1 : top + 1], levels[s + 1 : limit + 1]
        change = np.where(here > 0, 2 * (there - here) + 2, none)
        change[-1] = 1 - 2 * here[-1] if here[-1] else none
        best = top - int(np.argmin(change[::-1]))
        if change[best - 1] == none:
            where, level = used, 0
            used += 1
        else:
            where, level = at[best].pop(), best
            levels[level] -= 1
        bins[i], offsets[i] = where, level
        if level + s < limit:
            levels[level + s] += 1
            at[level + s].append(where)
    return bins, offsets


def pack(docs: DataFrame, path: str, limit: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """pieces() with sequence_id long and offset long: where each piece stands."""
    parts = cut(pieces(docs, path, limit, end, key, text), "pieces")
    names = parts.columns
    # The files of a written table are always read in the same parts, so this number doesn't change if a task runs again.
    numbered = parts.withColumn("_at", F.monotonically_increasing_id())
    groups = max(1, -(-parts.where(F.col("length") < limit).count() // group))
    dealt = numbered.where(F.col("length") < limit).withColumn("_group", F.pmod(F.xxhash64("_at"), F.lit(groups)).cast("long"))

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "ids_crc32", "_at"], ascending=[False, True, True], kind="stable")
        bins, offsets = place(rows["length"].to_numpy(), limit)
        return rows.assign(_bin=bins, _offset=offsets)[[*names, "_group", "_bin", "_offset"]]

    schema = T.StructType([*parts.schema.fields, *(T.StructField(c, T.LongType()) for c in ("_group", "_bin", "_offset"))])
    placed = cut(dealt.groupBy("_group").applyInPandas(first, schema), "packed")

    # Bins with room, as units of the second round.
    units = placed.groupBy("_group", "_bin").agg(F.sum("length").alias("_fill")).where(F.col("_fill") < limit)
    larger = max(1, groups // 64)
    units = units.withColumn("_second", F.pmod(F.xxhash64("_group", "_bin"), F.lit(larger)).cast("long"))

    def second(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_fill", "_group", "_bin"], ascending=[False, True, True], kind="stable")
        bins, offsets = place(rows["_fill"].to_numpy(), limit)
        return rows.assign(_new=bins, _base=offsets)[["_group", "_bin", "_second", "_new", "_base"]]

    moved = units.groupBy("_second").applyInPandas(second, "_group long, _bin long, _second long, _new long, _base long")
    out = placed.join(moved, ["_group", "_bin"], "left")
    # Numbers of the first round are even, those of the second odd; a group has fewer than 2^31 bins. Full pieces count down from -1.
    one = F.shiftleft(F.shiftleft(F.col("_group"), 31) + F.col("_bin"), 1)
    two = F.shiftleft(F.shiftleft(F.col("_second"), 31) + F.col("_new"), 1) + 1
    shared = out.select(*names, F.coalesce(two, one).alias("sequence_id"), (F.coalesce("_base", F.lit(0)) + F.col("_offset")).alias("offset"))
    full = numbered.where(F.col("length") >= limit).select(*names, (-1 - F.col("_at")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared.unionByName(full)
