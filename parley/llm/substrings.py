"""Operator 8, substring dedup: remove words covered by windows that occur more than once.

A window is `window` consecutive words. It is keyed by the smallest hash among its grams of `gram` words, so
neighbouring windows share a key and equal windows have equal keys. First pass: each task counts the occurrences
of key grams into a count-min sketch of fixed size; merged, the sketches never say less than the true count of
a key gram, which is never less than that of a window with that key. Second pass: only windows whose estimate is
two or more are grouped, exactly, by key and hash of all their words. Where a key gram is very frequent, a second
sketch counts its windows whole, and only those that may repeat go on, each in a group of its own. A task first settles the windows that
repeat within what it has read, and sends a different window on twice at most (its first place, and that it
repeats), so a passage in a third of all documents arrives a few times from each task. The sketch has a fixed size:
where it fills up, more windows go to the exact pass and the result stays the same.

Windows are judged on the input. Equality is that of word sequences, by two 64-bit hashes that must both be equal:
that of all words of the window, and its key.

Defined cases: a null text has no words; an empty table gives an empty result; a repeated row is a second place
of all its windows; texts shorter than a window lose nothing; other columns of the input are ignored, whatever
their names, and a null key is kept. Very long texts are looked at whole.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import BATCH_BYTES, chunks, share_code
from parley.llm.words import Words, mix, pairs

#: Cells in a row of the sketch, as a power of two, and rows. A merged row is a bit for each cell: twice or more.
BITS, ROWS = 26, 2
BLOCK = 16
#: So many keys of a task, or its last ones, are sent on together: a portion. A cell counts twice at most in a portion.
EMITTED = 1 << 16
#: A key gram is hot if its count, of two at most from each portion, comes to this.
HOT = 32
#: As a power of two, the cells that share a bit in what tells the hot ones.
FOLD = 4
#: Text bytes, or bytes of hashes, that are looked at together.
WINDOW_BYTES = BATCH_BYTES // 2
#: At most this many windows that a task has sent are remembered (16 bytes each), so that a passage goes on once from a task.
MEMORY = 1 << 18
_SEEDS = [np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)]


def _slide(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over values[i : i + width], for each i where that fits."""
    span, out = 1, values
    while span * 2 <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def _sequence(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of width consecutive words, at each place where they fit (over row borders too)."""
    n = len(hashes) - width + 1
    span, level, out, done = 1, hashes, None, 0
    while True:
        if width & span:
            part = level[done : done + n]
            out = part if out is None else pairs(out, part)
            done += span
        if span * 2 > width:
            return out
        level = pairs(level[:-span], level[span:])
        span *= 2


class Windows:
    """The windows of a chunk: valid[i] tells that words i to i + window - 1 are of one row; key[i] is the least gram."""

    def __init__(self, column: pa.Array, window: int, gram: int):
        self.words = Words(column)
        self.window, self.n = window, max(0, len(self.words.start) - window + 1)
        if not self.n:
            return
        self.hashes = self.words.hashes()
        self.row = self.words.row()
        self.valid = self.row[: self.n] == self.row[window - 1 :]
        self.grams = _sequence(self.hashes, gram)
        self.span = window - gram + 1
        self.key = _slide(self.grams, self.span, np.minimum)

    def key_grams(self) -> np.ndarray:
        """The hashes of the grams that are the least of some valid window, an entry for each occurrence."""
        wide = np.zeros(self.n + 2 * (self.span - 1), np.uint64)
        wide[self.span - 1 : self.span - 1 + self.n] = np.where(self.valid, self.key, np.uint64(0))
        return self.grams[self.grams == _slide(wide, self.span, np.maximum)]


def _cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(keys ^ _SEEDS[row]) >> np.uint64(64 - bits)).astype(np.int64)


def _all_set(maps: list[np.ndarray], keys: np.ndarray, bits: int, fold: int = 0) -> np.ndarray:
    """Whether the cells of a key are set in every row; 2 ** fold neighbouring cells share a bit."""
    out = np.ones(len(keys), bool)
    for row, bitmap in enumerate(maps):
        cells = _cells(keys, row, bits) >> fold
        out &= (bitmap[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)
    return out


def _distinct(whole: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (whole, key): the first place of each different one, which one each is, and how often it occurs."""
    order = np.lexsort((key, whole))
    new = np.ones(len(order), bool)
    new[1:] = (whole[order[1:]] != whole[order[:-1]]) | (key[order[1:]] != key[order[:-1]])
    starts = np.flatnonzero(new)
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[starts], inverse, np.diff(np.append(starts, len(order)))


class Seen:
    """Windows (whole, key) that were met; at most MEMORY of them, after that it begins anew. No window is met that wasn't added."""

    def __init__(self):
        self.whole, self.key = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def has(self, whole: np.ndarray, key: np.ndarray) -> np.ndarray:
        if not len(self.whole):
            return np.zeros(len(whole), bool)
        at = np.minimum(np.searchsorted(self.whole, whole), len(self.whole) - 1)
        return (self.whole[at] == whole) & (self.key[at] == key)

    def add(self, whole: np.ndarray, key: np.ndarray) -> None:
        if len(self.whole) + len(whole) > MEMORY:
            self.whole, self.key = self.whole[:0], self.key[:0]
        both = np.concatenate([self.whole, whole])
        self.whole, first = np.unique(both, return_index=True)
        self.key = np.concatenate([self.key, key])[first]


def merged_sketch(
    docs: DataFrame, counted: Callable[["Windows"], np.ndarray], text: str = "text", window: int = 35, gram: int = 8, bits: int = BITS,
    hot_count: int = HOT, rows: int = ROWS,
) -> tuple[list[bytes], list[bytes] | None]:
    """Bitmaps for each row of the sketch of what `counted` gives for a chunk: cells counted twice or more, and hot ones.

    A cell's count in a portion goes up to two; hot are cells with hot_count or more over all chunks (None if there are
    none), and their neighbours. The bitmaps of a row have 2 ** bits / 8 bytes, and 2 ** FOLD times less.
    """
    share_code(docs.sparkSession)

    def emitted(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        for row in range(rows):
            cells, counts = np.unique(_cells(keys, row, bits), return_counts=True)
            cells = np.repeat(cells, np.minimum(counts, 2))
            blocks = cells >> BLOCK
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            low = (cells & (1 << BLOCK) - 1).astype("<u2")
            names = blocks[np.concatenate([[0], cuts])]
            columns = [pa.array(names * rows + row, pa.int64()), pa.array([x.tobytes() for x in np.split(low, cuts)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "cells"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chunks(batches, "_text", WINDOW_BYTES):
            found = Windows(batch.column(0), window, gram)
            if not found.n:
                continue
            held.append(counted(found))
            size += len(held[-1])
            if size >= EMITTED:
                yield from emitted(np.concatenate(held))
                held, size = [], 0
        if size:
            yield from emitted(np.concatenate(held))

    def marked(block: int, count: np.ndarray) -> pa.RecordBatch:
        marks = (count >= 2, (count >= hot_count).reshape(-1, 1 << FOLD).any(axis=1))
        made = [np.packbits(x, bitorder="little").tobytes() if x.any() else None for x in marks]
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array(made[:1], pa.binary()), pa.array(made[1:], pa.binary())],
            names=["block", "twice", "hot"],
        )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block; one block's counts are held at a time."""
        current, count = None, np.zeros(1 << BLOCK, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            names, cells = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            edges = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)]
            for a, b in zip(edges, edges[1:]):
                if names[a] != current:
                    if current is not None:
                        yield marked(current, count)
                    current, count = int(names[a]), np.zeros(1 << BLOCK, np.int64)
                count += np.bincount(np.frombuffer(b"".join(cells[a:b]), "<u2"), minlength=1 << BLOCK)
        if current is not None:
            yield marked(current, count)

    parts = docs.select(F.col(text).alias("_text")).mapInArrow(partial, "block long, cells binary")
    size = (1 << BLOCK) // 8
    small = size >> FOLD
    twice, hot, any_hot = [bytearray((1 << bits) // 8) for _ in range(rows)], [bytearray((1 << bits - FOLD) // 8) for _ in range(rows)], False
    # At most rows * 2 ** (bits - BLOCK) blocks of fixed size.
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block long, twice binary, hot binary")
    blocks = merged.where("twice is not null").toArrow()
    for name, more, most in zip(*(blocks.column(c).to_pylist() for c in ("block", "twice", "hot"))):
        block, row = divmod(name, rows)
        twice[row][block * size : block * size + size] = more
        if most is not None:
            hot[row][block * small : block * small + small], any_hot = most, True
    return [bytes(x) for x in twice], [bytes(x) for x in hot] if any_hot else None


def repeated_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, gram: int = 8, bits: int = BITS, hot_count: int = HOT,
) -> DataFrame:
    """key, _text_hash, _start, _n: _n windows from word _start on whose sequences start elsewhere too."""
    spark = docs.sparkSession.sparkContext
    twice, hot = merged_sketch(docs, Windows.key_grams, text, window, gram, bits, hot_count)
    # A passage in very many texts is a key of as many different windows, half in and half out of it: those are
    # counted whole, so that only the ones that may repeat go on.
    whole, fewer = None, max(BLOCK, bits - 2)
    if hot is not None:
        hot_keys = spark.broadcast(hot)

        def whole_windows(found: Windows) -> np.ndarray:
            at = np.flatnonzero(found.valid)
            at = at[_all_set([np.frombuffer(x, np.uint8) for x in hot_keys.value], found.key[at], bits, FOLD)]
            return _sequence(found.hashes, window)[at] if len(at) else np.zeros(0, np.uint64)

        whole = merged_sketch(docs, whole_windows, text, window, gram, fewer)[0]
        hot_keys.destroy()
    shared = spark.broadcast((twice, hot, whole))  # of fixed size
    kind = docs.schema[key].dataType
    fields = T.StructType(
        [
            T.StructField("_group", T.LongType()), T.StructField(key, kind),
            *(T.StructField(c, T.LongType()) for c in ("_text_hash", "_start", "_n")), T.StructField("_hashes", T.BinaryType()),
        ]
    )

    def runs(*changes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of stretches in which no array changes."""
        new = np.logical_or.reduce([x[1:] != x[:-1] for x in changes])
        starts = np.concatenate([[0], np.flatnonzero(new) + 1]) if len(changes[0]) else np.zeros(0, np.int64)
        return starts, np.diff(np.append(starts, len(changes[0])))

    def rows_of(batch: pa.RecordBatch, found: Windows, at: np.ndarray, group: np.ndarray, hashes: np.ndarray | None) -> pa.RecordBatch:
        """A row for each run of consecutive windows (at, ascending) of one text and group."""
        row = found.row[at]
        starts, lengths = runs(at - np.arange(len(at)), row, group)
        take = pa.array(row[starts], pa.int64())
        raw = hashes.astype("<u8").tobytes() if hashes is not None else b""
        packed = [raw[8 * a : 8 * (a + n)] for a, n in zip(starts.tolist(), lengths.tolist())] if hashes is not None else [None] * len(starts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(group[starts].view(np.int64), pa.int64()), batch.column(0).take(take), batch.column(1).take(take),
                pa.array(at[starts] - found.words.first[row[starts]], pa.int64()), pa.array(lengths, pa.int64()),
                pa.array(packed, pa.binary()),
            ],
            names=fields.fieldNames(),
        )

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeat, popular, exact_repeat = ([np.frombuffer(x, np.uint8) for x in maps or ()] for maps in shared.value)
        once, told = Seen(), Seen()  # windows that this task has sent on with their place, and those it has said to repeat
        for batch in chunks(batches, "_text", WINDOW_BYTES):
            found = Windows(batch.column(2), window, gram)
            if not found.n:
                continue
            at = np.flatnonzero(found.valid)
            at = at[_all_set(repeat, found.key[at], bits)]
            if not len(at):
                continue
            whole, gram_key = _sequence(found.hashes, window)[at], found.key[at]
            hot_here = np.zeros(len(at), bool)
            if popular:
                hot_here = _all_set(popular, gram_key, bits, FOLD)
                keep = ~hot_here | _all_set(exact_repeat, whole, fewer)
                at, whole, gram_key, hot_here = at[keep], whole[keep], gram_key[keep], hot_here[keep]
                if not len(at):
                    continue
            # Grouped by the key, with the other hash beside it; where the key is frequent, the other way round.
            group, beside = np.where(hot_here, whole, gram_key), np.where(hot_here, gram_key, whole)
            first, inverse, counts = _distinct(whole, gram_key)
            known = told.has(whole[first], gram_key[first])
            again = known | (counts > 1) | once.has(whole[first], gram_key[first])
            # Settled in this task; dealt by a group of their own, a different one for each run of a text.
            settled = at[again[inverse]]
            spread = mix(found.hashes[found.words.first[found.row[settled]]] + found.row[settled].astype(np.uint64))
            yield rows_of(batch, found, settled, spread, None)
            # One row for each different window, with its place; where it is settled here it only tells the others
            # (its place is -1 then), once.
            single, tell = np.sort(first[~again]), np.sort(first[again & ~known])
            yield rows_of(batch, found, at[single], group[single], beside[single])
            said = rows_of(batch, found, at[tell], group[tell], beside[tell])
            yield said.set_column(3, "_start", pa.array(np.full(said.num_rows, -1), pa.int64()))
            once.add(whole[single], gram_key[single])
            told.add(whole[tell], gram_key[tell])

    def settle(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(tables).combine_chunks()
        n = table.column("_n").to_numpy()
        start = table.column("_start").to_numpy()
        whole = np.frombuffer(b"".join(table.column("_hashes").to_pylist()), "<u8")
        _, inverse, counts = _distinct(whole, np.repeat(table.column("_group").to_numpy().view(np.uint64), n))
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        keep = np.flatnonzero((counts[inverse] > 1) & (start[row] >= 0))
        row, place = row[keep], place[keep]
        starts, lengths = runs(place - np.arange(len(place)), row)
        take = pa.array(row[starts], pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                table.column(key).combine_chunks().take(take), table.column("_text_hash").combine_chunks().take(take),
                pa.array(start[row[starts]] + place[starts], pa.int64()), pa.array(lengths, pa.int64()),
            ],
            names=[key, "_text_hash", "_start", "_n"],
        )

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; as many groups as fit are settled together, and a group never in parts."""
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            done = batch.filter(pa.compute.is_null(batch.column(5)))
            yield done.select([1, 2, 3, 4])
            batch = batch.filter(pa.compute.is_valid(batch.column(5)))
            if not batch.num_rows:
                continue
            if size > WINDOW_BYTES:
                groups = batch.column(0).to_numpy()
                cut = int(np.searchsorted(groups, held[-1].column(0)[-1].as_py(), side="right"))
                if cut < batch.num_rows:
                    yield settle([*held, batch.slice(0, cut)])
                    held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.nbytes
        if held:
            yield settle(held)

    chosen = docs.select(F.col(key), F.xxhash64(F.col(text)).alias("_text_hash"), F.col(text).alias("_text"))
    dealt = chosen.mapInArrow(candidates, fields).repartition("_group").sortWithinPartitions("_group")
    return dealt.mapInArrow(exact, T.StructType([fields[key], fields["_text_hash"], fields["_start"], fields["_n"]]))


def remove_repeated(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, gram: int = 8, bits: int = BITS, hot_count: int = HOT,
    normalise: bool = True,
) -> DataFrame:
    """All columns of docs, text being the kept words joined by one space, and n_words long, n_removed long.

    Texts that lose nothing are normalised to single spaces too if normalise is set; null stays null. Columns of docs
    that have the names of result columns or of _text_hash, _runs, _k, _h are left out.
    """
    docs = docs.drop("n_words", "n_removed", "_text_hash", "_runs", "_k", "_h")
    found = repeated_runs(docs, key, text, window, gram, bits, hot_count)
    places = found.groupBy(F.col(key).alias("_k"), F.col("_text_hash").alias("_h")).agg(F.collect_set(F.struct("_start", "_n")).alias("_runs"))
    names = docs.columns
    marked = docs.withColumn("_text_hash", F.xxhash64(F.col(text)))
    joined = marked.join(places, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_text_hash") == F.col("_h")), "left").select(*names, "_runs")
    where = names.index(text)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            out, words, removed = [], [], []
            for value, places in zip(batch.column(where).to_pylist(), batch.column(len(names)).to_pylist()):
                parts = value.encode().split() if value is not None else []
                words.append(len(parts))
                if places:
                    depth = np.zeros(len(parts) + 1, np.int32)
                    begin = np.array([x["_start"] for x in places])
                    np.add.at(depth, begin, 1)
                    np.add.at(depth, begin + np.array([x["_n"] for x in places]) + window - 1, -1)
                    parts = [parts[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
                removed.append(words[-1] - len(parts))
                out.append(None if value is None else b" ".join(parts) if places or normalise else value.encode())
            columns = [batch.column(i) for i in range(len(names))]
            columns[where] = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.int64()), pa.array(removed, pa.int64())], names=[*names, "n_words", "n_removed"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.mapInArrow(strip, schema)
