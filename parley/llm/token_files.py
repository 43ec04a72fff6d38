"""Operator 12, token ids in binary files, with an index by a minimal perfect hash.

write() makes a folder of three parts. `payload` has the documents in ascending order of their key (equal keys by the
hash of the text, then the text), dealt by ranges of both, so that a key that repeats very often is spread as well. Its files are
written by Spark, so they can be in any store; one is closed after FILE_BLOCKS blocks, whatever the texts' lengths:

    block   b"TKID", version (1 byte), bytes of an id (1), 0 (2), bytes of the records (8), the records, a line break
    record  bytes of the key as text (4, or 2^32 - 1 for a null), number of ids (8), the key, the ids

Numbers are little-endian, ids have two bytes if the vocabulary allows that, else four. `files` numbers the payload files
and has the records and ids before each. `index` maps (key, repeat) to file, offset, number of ids and start, repeat being 0
for the first record with a key, 1 for the next and so on. It is dealt into buckets of some KEYS keys by a hash; a bucket is one row: a minimal perfect hash (levels of bits;
a key is at the first level where no other one of those left falls on its bit; its slot is the number of bits before) and an
entry for each slot, with a fingerprint of 32 bits, so that absent keys are told before any payload is read. The record has its key,
which is compared when it is read. get() reads one row of the index and one range of bytes, whatever the size.

Defined cases: a null text is empty (its only id is the end), a null key is a key like any other, a repeated row is a record of its own. An
empty table gives no records. Other columns are ignored, whatever their names. A text is encoded whole, however long; a
file is read as one value of 2 GB at most, which only a single text of some 500 MB could pass.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.bpe import encoder
from parley.llm.common import chunks, cut, discard, share_code
from parley.llm.words import mix

MAGIC, VERSION = b"TKID", 1
BLOCK_HEAD, RECORD_HEAD = "<4sBBHQ", "<IQ"
BLOCK_HEAD_BYTES, RECORD_HEAD_BYTES = struct.calcsize(BLOCK_HEAD), struct.calcsize(RECORD_HEAD)
NO_KEY = 2**32 - 1
#: Bytes after which a block is closed, and blocks of a file.
BLOCK_BYTES, FILE_BLOCKS = 2 << 20, 8
#: Keys of a bucket of the index, on average; bits of a level for each key that is left; levels at most.
KEYS, GAMMA, LEVELS = 50_000, 2, 64
#: Up to so many places that are asked for are broadcast to where the files are read; more are joined by shuffles.
BROADCAST = 1_000_000
_STEP = 0x9E3779B97F4A7C15
#: What an entry of the index has, by slot.
ENTRY = {"fingerprint": "<u4", "file": "<u4", "offset": "<u8", "n_ids": "<u8", "start": "<u8"}


def _payload(docs: DataFrame, path: str, vocabulary: str, end: int, key: str, text: str) -> None:
    """The payload files."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(vocabulary)
        width = 2 if max(codec.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
        kind, tail, held, size = f"<u{width}", int(end).to_bytes(width, "little"), [], 0

        def block() -> pa.RecordBatch:
            raw = struct.pack(BLOCK_HEAD, MAGIC, VERSION, width, 0, size) + b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["block"])

        for batch in chunks(batches, "_text"):
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(codec.encode(value), "<u4").astype(kind).tobytes() if value else b""
                raw = b"" if name is None else name.encode()
                record = [struct.pack(RECORD_HEAD, NO_KEY if name is None else len(raw), len(ids) // width + 1), raw, ids, tail]
                held += record
                size += sum(map(len, record))
                if size >= BLOCK_BYTES:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    rows = docs.select(F.col(key).alias("_order"), F.xxhash64(text).alias("_tie"), F.col(text).alias("_text"))
    ordered = rows.repartitionByRange("_order", "_tie").sortWithinPartitions("_order", "_tie", "_text")
    blocks = ordered.select(F.col("_order").cast("string").alias("_key"), "_text").mapInArrow(pack, "block binary")
    # A string column can hold any bytes, and the text writer writes them as they are.
    blocks.select(F.col("block").cast("string")).write.option("maxRecordsPerFile", FILE_BLOCKS).option("lineSep", "\n").text(f"{path}/payload")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """name, content of each payload file."""
    raw = spark.read.format("binaryFile").load(f"{path}/payload")
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def records(content: memoryview) -> Iterator[tuple[str | None, int, int, int]]:
    """Key, offset, number of ids and bytes of an id of each record in a file."""
    at = 0
    while at < len(content):
        magic, version, width, _, size = struct.unpack_from(BLOCK_HEAD, content, at)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a file of token ids")
        at += BLOCK_HEAD_BYTES
        stop = at + size
        while at < stop:
            length, n = struct.unpack_from(RECORD_HEAD, content, at)
            begin = at + RECORD_HEAD_BYTES
            length, name = (0, None) if length == NO_KEY else (length, str(content[begin : begin + length], "utf-8"))
            yield name, at, n, width
            at = begin + length + n * width
        at += 1  # the line break


def ids_at(content: memoryview, at: int, width: int) -> tuple[str | None, np.ndarray]:
    """The key and the ids of the record at an offset."""
    length, n = struct.unpack_from(RECORD_HEAD, content, at)
    begin = at + RECORD_HEAD_BYTES
    length, name = (0, None) if length == NO_KEY else (length, str(content[begin : begin + length], "utf-8"))
    return name, np.frombuffer(content, f"<u{width}", n, begin + length)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The directory of each file: run counts the records before with the same key, in this file."""
    for batch in batches:
        for row in range(batch.num_rows):
            found, last, run, before = [], None, 0, 0
            for pos, (name, at, n, width) in enumerate(records(memoryview(batch.column(1)[row].as_buffer()))):
                run = run + 1 if pos and name == last else 0
                found.append((name, pos, run, at, n, before, width))
                last, before = name, before + n
            columns = list(zip(*found)) or [()] * 7
            kinds = (pa.string(), *[pa.int64()] * 5, pa.int32())
            names = ["key", "pos", "run", "offset", "n_ids", "ids_before", "width"]
            files = pa.array([batch.column(0)[row].as_py()] * len(found), pa.string())
            yield pa.RecordBatch.from_arrays([files, *(pa.array(x, k) for x, k in zip(columns, kinds))], names=["name", *names])


def _numbered(directory: DataFrame) -> DataFrame:
    """name, file (its number), first_record, first_id, and repeats: records with the file's first key in the files before.

    One row for each file meets in a single task.
    """
    by = directory.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_ids").alias("ids"), F.min_by("key", "pos").alias("first"), F.max_by("key", "pos").alias("last"), F.max_by("run", "pos").alias("run"),
    )
    part, piece = (F.regexp_extract("name", rf"part-(\d+)-.*-c(\d+)", i).cast("long") for i in (1, 2))
    order = Window.orderBy(part, piece)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    goes_on = (F.row_number().over(order) > 1) & F.col("first").eqNullSafe(F.lag("last").over(order))
    placed = by.select(
        "*", (F.row_number().over(order) - 1).cast("long").alias("file"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first_record"),
        F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("first_id"), goes_on.alias("goes_on"), part.alias("_p"), piece.alias("_c"),
    )
    # Where the last key's records begin, unless that is in an earlier file.
    whole = F.col("run") + 1 == F.col("n")
    begun = placed.withColumn("begin", F.when(~(whole & F.col("goes_on")), F.col("first_record") + F.col("n") - F.col("run") - 1))
    held = F.last("begin", ignorenulls=True).over(Window.orderBy("_p", "_c").rowsBetween(Window.unboundedPreceding, -1))
    return begun.select("name", "file", "first_record", "first_id", F.when(F.col("goes_on"), F.col("first_record") - held).otherwise(0).alias("repeats"))


class PerfectHash:
    """Slots 0 to n - 1 for n different pairs of 64-bit hashes; -1, or some slot, for others."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits.view("<u8")).astype(np.int64))])
        self.bases = np.cumsum(sizes) - sizes

    @staticmethod
    def _spot(one: np.ndarray, two: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(one ^ mix(two + np.uint64(level * _STEP & 2**64 - 1))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, one: np.ndarray, two: np.ndarray) -> PerfectHash:
        sizes, maps = [], []
        while len(one):
            if len(sizes) == LEVELS:
                raise ValueError("two keys have the same 128 bits")
            size = max(64, -(-GAMMA * len(one) // 64) * 64)
            spots = cls._spot(one, two, len(sizes), size)
            alone = np.bincount(spots, minlength=size) == 1
            sizes.append(size)
            maps.append(np.packbits(alone, bitorder="little"))
            left = ~alone[spots]
            one, two = one[left], two[left]
        return cls(np.array(sizes, np.int64), np.concatenate(maps) if maps else np.zeros(0, np.uint8))

    def slots(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out, left, words = np.full(len(one), -1, np.int64), np.arange(len(one)), self.bits.view("<u8")
        for level, (base, size) in enumerate(zip(self.bases.tolist(), self.sizes.tolist())):
            if not len(left):
                break
            spots = self._spot(one[left], two[left], level, size) + base
            word, bit = words[spots >> 6], (spots & 63).astype(np.uint64)
            there = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[there]] = (self.ranks[spots >> 6] + below)[there]
            left = left[~there]
        return out


def _hashes(key: str, repeat: str) -> list[Column]:
    return [F.xxhash64(key, repeat).alias("one"), F.xxhash64(F.lit("TKID"), repeat, key).alias("two")]


def _bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """One row of the index from the rows of its keys."""
    one, two = (rows[c].to_numpy(np.int64).view(np.uint64) for c in ("one", "two"))
    made = PerfectHash.of(one, two)
    order = np.empty(len(rows), np.int64)
    order[made.slots(one, two)] = np.arange(len(rows))
    values = rows.assign(fingerprint=(two >> np.uint64(32)).astype(np.int64))
    entries = {c: [values[c].to_numpy()[order].astype(kind).tobytes()] for c, kind in ENTRY.items()}
    head = {"bucket": rows["bucket"].iloc[:1], "width": rows["width"].iloc[:1].to_numpy(), "sizes": [made.sizes.astype("<i8").tobytes()], "bits": [made.bits.tobytes()]}
    return pd.DataFrame(head | entries)


_INDEX = "bucket long, width int, sizes binary, bits binary, " + ", ".join(f"{c} binary" for c in ENTRY)


def write(docs: DataFrame, path: str, vocabulary: str, end: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Encode every text, with the end id after it, and write payload, files and index below path."""
    spark = docs.sparkSession
    share_code(spark)
    _payload(docs, path, vocabulary, end, key, text)
    directory = cut(_files(spark, path).mapInArrow(_walk, "name string, key string, pos long, run long, offset long, n_ids long, ids_before long, width int"), "directory")
    _numbered(directory).write.parquet(f"{path}/files")
    files = spark.read.parquet(f"{path}/files")
    buckets = max(1, -(-directory.count() // KEYS))
    repeat = F.col("run") + F.when(F.col("run") == F.col("pos"), F.col("repeats")).otherwise(0)
    entries = directory.join(files, "name").select("key", repeat.alias("repeat"), "file", "offset", "n_ids", (F.col("first_id") + F.col("ids_before")).alias("start"), "width")
    hashed = entries.select("*", *_hashes("key", "repeat")).withColumn("bucket", F.pmod("one", F.lit(buckets)))
    index = hashed.groupBy("bucket").applyInPandas(_bucket, _INDEX).withColumn("buckets", F.lit(buckets).cast("long"))
    # Small row groups, so that one bucket can be read by itself.
    index.write.option("parquet.block.size", 1 << 20).parquet(f"{path}/index")
    discard(directory)


_PLACE = pa.schema([("key", pa.string()), *((c, pa.int64()) for c in ("repeat", "width", "file", "offset", "n_ids", "start"))])


def _locate(rows: pa.Table, index: pa.Table) -> pa.Table:
    """Where the keys of a bucket are, for those whose fingerprint is that of their slot."""
    if not rows.num_rows or not index.num_rows:
        return _PLACE.empty_table()
    row = {c: index.column(c)[0].as_py() for c in index.column_names}
    one, two = (rows.column(c).to_numpy().view(np.uint64) for c in ("one", "two"))
    slots = PerfectHash(np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["bits"], np.uint8)).slots(one, two)
    prints = np.frombuffer(row["fingerprint"], "<u4")
    fits = np.flatnonzero((slots >= 0) & (prints[slots] == (two >> np.uint64(32)).astype(np.uint32)))
    found = rows.select(["key", "repeat"]).take(pa.array(fits))
    values = [np.frombuffer(row[c], kind)[slots[fits]].astype(np.int64) for c, kind in list(ENTRY.items())[1:]]
    return pa.table([*found.columns, pa.array(np.full(len(fits), row["width"], np.int64)), *map(pa.array, values)], _PLACE)


def find(keys: DataFrame, path: str, key: str = "doc_id", repeat: str | None = None, keep_ids: bool = True) -> DataFrame:
    """key, repeat, start, n_tokens, ids_crc32 long, file, offset long, and with keep_ids ids binary (32 bits each, little-endian).

    keys: the keys that are asked for, each once whatever their number; repeat names the column that tells which record of an equal key is meant (the first if
    left out). Keys without a record give no row.
    """
    spark = keys.sparkSession
    share_code(spark)
    kind = keys.schema[key].dataType
    index, files = spark.read.parquet(f"{path}/index"), spark.read.parquet(f"{path}/files")
    asked = keys.select(F.col(key).cast("string").alias("key"), (F.col(repeat) if repeat else F.lit(0)).cast("long").alias("repeat")).distinct()
    first = index.select("buckets").limit(1).collect()
    hashed = asked.select("*", *_hashes("key", "repeat")).withColumn("bucket", F.pmod("one", F.lit(first[0][0] if first else 1)))
    located = cut(
        hashed.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(_locate, "key string, " + ", ".join(f"{c} long" for c in _PLACE.names[1:])), "located",
    )
    wanted = located.join(files.select("name", "file"), "file").groupBy("name", "file").agg(F.collect_list(F.struct("key", "repeat", "width", "offset", "start")).alias("asked"))
    if located.limit(BROADCAST + 1).count() <= BROADCAST:
        wanted = F.broadcast(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                file, content = batch.column(1)[row].as_py(), memoryview(batch.column(2)[row].as_buffer())
                places, out, size = batch.column(0)[row].values.flatten(), [], 0
                for name, again, width, at, start in zip(*(c.to_pylist() for c in places)):
                    own, ids = ids_at(content, at, width)
                    if own != name:
                        continue  # another key with the same fingerprint
                    raw = ids.astype("<u4").tobytes()
                    out.append((name, again, start, len(ids), zlib.crc32(raw), file, at, raw if keep_ids else None))
                    size += len(raw) if keep_ids else 0
                    if size >= BLOCK_BYTES:
                        yield made(out)
                        out, size = [], 0
                yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 8
        arrays = [pa.array(x, k) for x, k in zip(columns, (pa.string(), *[pa.int64()] * 6, pa.binary()))]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "repeat", "start", "n_tokens", "ids_crc32", "file", "offset", "ids"])

    rows = _files(spark, path).join(wanted, "name").select("asked", "file", "content")
    found = rows.mapInArrow(read, "key string, repeat long, start long, n_tokens long, ids_crc32 long, file long, offset long, ids binary")
    out = found.select(F.col("key").cast(kind).alias(key), "repeat", "start", "n_tokens", "ids_crc32", "file", "offset", "ids")
    return out if keep_ids else out.drop("ids")


def repeats(keys: DataFrame, key: str = "doc_id", step: int = 4096) -> DataFrame:
    """key and repeat long, from 0 on for each row with an equal key; those of a frequent key are spread, step at a time."""
    counted = keys.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    starts = counted.select(key, "_n", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / step))).alias("_s"))
    begin = F.col("_s") * step
    return starts.repartition(key, "_s").select(key, F.explode(F.sequence(begin, F.least(begin + step, F.col("_n")) - 1)).alias("repeat"))


def get(spark: SparkSession, path: str, key: object, repeat: int = 0) -> np.ndarray | None:
    """The ids of one record, or None: one row of the index and one range of a payload file are read."""
    index, files = spark.read.parquet(f"{path}/index"), spark.read.parquet(f"{path}/files")
    first = index.select("buckets").limit(1).collect()
    if not first:
        return None
    name = None if key is None else str(key)
    asked = spark.range(1).select(F.lit(name).cast("string").alias("key"), F.lit(repeat).cast("long").alias("repeat"))
    row = asked.select("*", *_hashes("key", "repeat")).withColumn("bucket", F.pmod("one", F.lit(first[0][0]))).toArrow()
    found = _locate(row, index.where(F.col("bucket") == row.column("bucket")[0].as_py()).toArrow()).to_pylist()
    if not found:
        return None
    place = found[0]
    file = files.where(F.col("file") == place["file"]).first()["name"]
    size = RECORD_HEAD_BYTES + (len(name.encode()) if name is not None else 0) + place["n_ids"] * place["width"]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/payload/{file}")
    stream = where.getFileSystem(conf).open(where)
    try:
        stream.seek(place["offset"])
        raw = memoryview(bytes(stream.readNBytes(size)))
    finally:
        stream.close()
    own, ids = ids_at(raw, 0, place["width"])
    return ids.astype(np.uint32) if own == name else None
