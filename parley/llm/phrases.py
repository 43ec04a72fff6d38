"""Operator 13, phrase collocation mining by suffix-sigma.

Every word position gives its suffix, cut to `max_n` words and to its piece of text. Suffixes are shuffled by language
and first word and sorted in reverse lexicographic order, so that a single stack counts all their prefixes; what
the parts of a phrase occur is joined afterwards.

Two things keep this small. First pass: a sketch of fixed size (2 ** BITS cells, a bit of each is kept) counts all runs of
one to max_n words. A cell never says less than the true count of a run, and a longer phrase is never more frequent than
its beginning, so a suffix ends before the first word that makes it too rare. Where the sketch fills up, suffixes
stay longer and the result is the same. Second: tasks add up equal suffixes before they send them on, and each reads 128 MB if
there is enough for all cores, as most suffixes of a task are those of any other. A first word that
starts a large share of the text is dealt by its first two words, and where those are such a pair, by whole
suffixes; the counts of such beginnings are partial ones, added up after the stack. Joins on single words are salted.

Defined cases: a null text is empty, a null language is `und`. An empty table gives an empty result. A repeated row
counts again. Other columns of the input are ignored, whatever their names; no key is needed. Whole texts are taken,
however long. Words hold any characters but those that part words and pieces. Equal scores go by count, then phrase.
"""

import functools
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import chunks, cut, input_bytes, share_code
from parley.llm.words import Words, mix, pairs

#: Cells of the sketch, as a power of two; cells of a block that are merged together.
BITS, BLOCK = 27, 16
#: Entries that a task counts together before it sends cells on, and suffixes that it holds.
COUNTED, HELD = 1 << 22, 1 << 20
#: Input bytes that a task which adds up suffixes should read, where that leaves no core idle: Spark's own default.
TASK_BYTES = 128 << 20
#: A word or pair is hot with this share of all words; of each block so many of the largest cells are looked at.
HOT_SHARE, LARGEST = 1 / 512, 8
#: Each single word stands so often in the table that parts are looked up in.
SALT = 16
CHUNK = 8 << 20
#: A-Z in lower case, and the signs that end a piece as line breaks.
TABLE = np.array([b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?" else b for b in range(256)], np.uint8)
_ONE = np.uint64(0xD1B54A32D192ED03)


class Pieces:
    """The words of a chunk, by number of each different one. keys[m]: a hash of (language, m + 1 words from there), whole[m]: whether
    they are in one piece."""

    def __init__(self, langs: pa.Array, texts: pa.Array, max_n: int):
        words = Words(texts, TABLE)
        data, self.n = words.data, len(words.start)
        if not self.n:
            return
        kept = (data != 32) & ((data < 9) | (data > 13))
        offsets = np.concatenate([[0], np.cumsum(words.end - words.start)]).astype(np.int64)
        bytes_, n = data[kept].tobytes(), self.n
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(bytes_)]).dictionary_encode()
        self.names, self.word = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        row = words.row()
        piece = np.cumsum((data >= 10) & (data <= 13))[words.start]
        joined = np.zeros(n, bool)
        joined[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
        coded = langs.dictionary_encode()
        self.langs, self.lang = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)[row]
        salt = mix(np.array([zlib.crc32(x.encode()) for x in self.langs], np.uint64) + _ONE)
        own = mix(words.hashes() ^ salt[self.lang])
        self.keys, self.whole = [mix(own ^ _ONE)], [np.ones(n, bool)]
        for m in range(1, max_n):
            key, whole = np.zeros(n, np.uint64), np.zeros(n, bool)
            if m < n:
                key[:-m] = pairs(self.keys[-1][:-m], own[m:])
                whole[:-m] = self.whole[-1][:-m] & joined[m - 1 : n - 1]
            self.keys.append(key)
            self.whole.append(whole)


def _cells(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.uint32)


class Sketch:
    """often: a bit for each cell, set where the count is large enough; hot: the cells with a large share of all words."""

    def __init__(self, often: bytes, hot: np.ndarray, bits: int):
        self.often, self.hot, self.bits = np.frombuffer(often, np.uint8), hot, bits

    def may(self, keys: np.ndarray) -> np.ndarray:
        cells = _cells(keys, self.bits)
        return (self.often[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)

    def is_hot(self, keys: np.ndarray) -> np.ndarray:
        return np.isin(_cells(keys, self.bits), self.hot)


def _rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    share_code(docs.sparkSession)
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("_lang"), F.col(text).alias("_text"))


def sketch(docs: DataFrame, least: int, max_n: int = 4, text: str = "text", lang: str = "lang", bits: int = BITS) -> Sketch:
    """Counts of runs of one to max_n words by cells. What comes to the driver is of fixed size: a bit for each cell and a few cells of each block."""
    low, side = (1 << BLOCK) - 1, 1 << BLOCK

    def sent(cells: np.ndarray) -> Iterator[pa.RecordBatch]:
        cells = np.sort(cells)
        first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        counts, cells = np.diff(np.append(first, len(cells))), cells[first]
        blocks = cells >> BLOCK
        cuts = np.flatnonzero(np.diff(blocks)) + 1
        parts = [[x.tobytes() for x in np.split(part, cuts)] for part in ((cells & low).astype("<u2"), np.minimum(counts, 65_535).astype("<u2"))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks[np.concatenate([[0], cuts])].astype(np.int64)), *(pa.array(x, pa.binary()) for x in parts)], names=["block", "cells", "counts"],
        )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chunks(batches, "_text", CHUNK):
            found = Pieces(batch.column(0), batch.column(1), max_n)
            if not found.n:
                continue
            made = [_cells(key[whole], bits) for key, whole in zip(found.keys, found.whole)]
            held += made
            size += sum(map(len, made))
            if size >= COUNTED:
                yield from sent(np.concatenate(held))
                held, size = [], 0
        if size:
            yield from sent(np.concatenate(held))

    def merged(block: int, count: np.ndarray) -> pa.RecordBatch:
        top = np.argpartition(count, -LARGEST)[-LARGEST:]
        often = np.packbits(count >= least, bitorder="little").tobytes()
        made = [[block], [often], [(top + (block << BLOCK)).tolist()], [count[top].tolist()], [int(count.sum())]]
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made, kinds)], names=["block", "often", "top", "top_n", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block; the counts of one block are held at a time."""
        current, count = None, np.zeros(side, np.int64)
        for batch in batches:
            for block, cells, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if block != current:
                    if current is not None:
                        yield merged(current, count)
                    current, count = block, np.zeros(side, np.int64)
                count[np.frombuffer(cells, "<u2")] += np.frombuffer(counts, "<u2")  # a cell stands once in a portion
        if current is not None:
            yield merged(current, count)

    parts = _rows(docs, text, lang).mapInArrow(partial, "block long, cells binary, counts binary")
    blocks = parts.repartition("block").sortWithinPartitions("block").mapInArrow(
        merge, "block long, often binary, top array<long>, top_n array<long>, n long",
    ).toArrow().to_pylist()
    often, size = bytearray((1 << bits) // 8), side // 8
    for row in blocks:
        often[row["block"] * size : (row["block"] + 1) * size] = row["often"]
    enough = max(least, HOT_SHARE * sum(row["n"] for row in blocks) / 2)
    hot = [cell for row in blocks for cell, n in zip(row["top"], row["top_n"]) if n >= enough]
    return Sketch(bytes(often), np.array(hot, np.int64), bits)


def suffixes(docs: DataFrame, known: Sketch, max_n: int = 4, text: str = "text", lang: str = "lang") -> DataFrame:
    """part long, split int, lang, suffix string, n long: suffixes (each word with a space after it) and how often a task met them.

    Equal (lang, first word) have equal part and split. split: so many words at the beginning of a suffix, or fewer, are a beginning that
    other parts have as well. The empty suffix has the words that start nothing frequent.
    """
    spark = docs.sparkSession
    head = functools.partial(struct.pack, "<qBI")
    held_everywhere = spark.sparkContext.broadcast((known.often.tobytes(), known.hot, known.bits))

    def sent(held: Counter, langs: list[str]) -> pa.RecordBatch:
        # A key is part (8 bytes), split (1), language (4) and suffix.
        heads = np.frombuffer(b"".join([k[:13] for k in held]), [("part", "<i8"), ("split", "u1"), ("lang", "<u4")])
        names = pa.array(langs, pa.string()).take(pa.array(heads["lang"]))
        words = pa.array([k[13:] for k in held], pa.binary()).cast(pa.string())
        columns = [pa.array(heads["part"]), pa.array(heads["split"].astype(np.int32)), names, words, pa.array(held.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["part", "split", "lang", "suffix", "n"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch_, held, codes = Sketch(*held_everywhere.value), Counter(), {}
        for batch in chunks(batches, "_text", CHUNK):
            found = Pieces(batch.column(0), batch.column(1), max_n)
            if not found.n:
                continue
            n, names = found.n, found.names
            numbers = [codes.setdefault(x, len(codes)) for x in found.langs]
            length, alive = np.ones(n, np.int64), np.ones(n, bool)
            for key, whole in zip(found.keys[1:], found.whole[1:]):
                alive &= whole
                alive[alive] = sketch_.may(key[alive])
                length += alive
            alone = (length == 1) & ~sketch_.may(found.keys[0])
            for code, count in enumerate(np.bincount(found.lang[alone], minlength=len(numbers)).tolist()):
                if count:
                    held[head(0, 0, numbers[code])] += count
            # Equal suffixes get equal numbers, word by word.
            at = np.flatnonzero(~alone)
            if not len(at):
                continue
            number = found.lang[at]
            for k in range(max_n):
                inside = length[at] > k
                word = np.where(inside, found.word[np.minimum(at + k, n - 1)] + 1, 0)
                _, number = np.unique(number * (len(names) + 1) + word, return_inverse=True)
            _, first, counts = np.unique(number, return_index=True, return_counts=True)
            at = at[first]
            single, pair = found.keys[0][at], found.keys[min(1, max_n - 1)][at]
            hot = sketch_.is_hot(single)
            hotter = hot & (length[at] > 1) & sketch_.is_hot(pair)
            part = np.where(hot & (length[at] > 1), pair, single).view(np.int64)
            split = np.where(hotter, max_n, hot)
            for i, size, p, s, code, count in zip(at.tolist(), length[at].tolist(), part.tolist(), split.tolist(), found.lang[at].tolist(), counts.tolist()):
                suffix = b" ".join([names[w] for w in found.word[i : i + size].tolist()]) + b" "
                if s == max_n:
                    p = zlib.crc32(suffix, p & 0xFFFFFFFF)
                held[head(p, s, numbers[code]) + suffix] += count
            if len(held) >= HELD:
                yield sent(held, list(codes))
                held = Counter()
        if held:
            yield sent(held, list(codes))

    tasks = max(spark.sparkContext.defaultParallelism, -(-input_bytes(docs) // TASK_BYTES))
    return _rows(docs, text, lang).coalesce(min(tasks, 1 << 30)).mapInArrow(emit, "part long, split int, lang string, suffix string, n long")


def prefix_counts(sorted_rows: DataFrame, least: int) -> DataFrame:
    """lang, phrase string, f long, from rows of suffixes() that are sorted by (lang, suffix) descending within partitions.

    A phrase below least is left out, unless other parts may have more of it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # [the prefix so far, its count] of each length; the first is the empty one
        current, out = None, []

        def fall(depth: int) -> None:
            """Take off what is longer than depth words; each count goes to the prefix below as well."""
            while len(stack) > depth + 1:
                prefix, n, split = stack.pop()
                stack[-1][1] += n
                if n >= least or len(stack) <= split:
                    out.append((current, prefix[:-1], n))

        def closed() -> None:
            if current is not None:
                fall(0)
                out.append((current, "", stack[0][1]))

        def made() -> pa.RecordBatch:
            columns = list(zip(*out)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["lang", "phrase", "f"])

        for batch in batches:
            for split, lang, suffix, n in zip(*(c.to_pylist() for c in batch.columns)):
                if lang != current:
                    closed()
                    current, stack = lang, [["", 0, 0]]
                depth = len(stack) - 1
                while depth and not suffix.startswith(stack[depth][0]):
                    depth -= 1
                fall(depth)
                begin = len(stack[-1][0])
                while begin < len(suffix):
                    begin = suffix.index(" ", begin) + 1
                    stack.append([suffix[:begin], 0, split])
                stack[-1][1] += n
            if len(out) >= 50_000:
                yield made()
                out.clear()
        closed()
        yield made()

    return sorted_rows.select("split", "lang", "suffix", "n").mapInArrow(count, "lang string, phrase string, f long")


def phrase_counts(docs: DataFrame, least: int = 30, max_n: int = 4, text: str = "text", lang: str = "lang", bits: int = BITS) -> DataFrame:
    """lang, phrase string, f long: every phrase of up to max_n words that occurs least times; the empty phrase has the words of the language."""
    rows = suffixes(docs, sketch(docs, least, max_n, text, lang, bits), max_n, text, lang)
    ordered = rows.repartition("part").sortWithinPartitions(F.desc("lang"), F.desc("suffix"))
    counted = prefix_counts(ordered, least).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return counted.where((F.col("f") >= least) | (F.col("phrase") == ""))


def _wide(column: Column | str) -> Column:
    """Room for products that 64 bits don't hold."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(38,0)")


def _inner(words: Column, size: Column) -> Column:
    """All phrases of two words or more within a longer one, itself left out."""
    lengths = F.sequence(F.lit(2), size - 1)
    runs = F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice(words, i, m), " ")))
    return F.array_distinct(F.flatten(runs))


def collocations(
    docs: DataFrame, least: int = 30, max_n: int = 4, top: int = 2000, percent: int = 80, text: str = "text", lang: str = "lang", bits: int = BITS,
) -> DataFrame:
    """lang, rank long, phrase string, a, l, r, n, score long: the top phrases of each language.

    A phrase of two to max_n words that occurs a >= least times is cut where floor(2000000 * a / (l + r)) is lowest, l and r
    being the counts of its two parts (the shortest first part among equals). Phrases inside a longer one that has at least percent % of their count are dropped.
    """
    counts = cut(phrase_counts(docs, least, max_n, text, lang, bits), "phrases")
    words = F.split("phrase", " ")
    candidates = counts.where(F.col("phrase").contains(" ")).select("lang", "phrase", F.col("f").alias("a"), words.alias("_w"), F.size(words).alias("_m"))

    # Both parts of each cut, looked up among the counts. A single word may be part of very many phrases, so it is salted.
    cuts = candidates.select("lang", "phrase", "a", "_w", F.explode(F.sequence(F.lit(1), F.col("_m") - 1)).alias("k"), "_m")
    joined = lambda a, b: F.array_join(F.slice("_w", a, b), " ")
    left = F.struct(F.lit(True).alias("first"), joined(F.lit(1), F.col("k")).alias("part"))
    right = F.struct(F.lit(False).alias("first"), joined(F.col("k") + 1, F.col("_m") - F.col("k")).alias("part"))
    asked = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(left, right)).alias("_p")).select("lang", "phrase", "a", "k", "_p.first", "_p.part")
    salt = lambda part, value, other: F.when(part.contains(" "), other).otherwise(value)
    asked = asked.withColumn("_salt", salt(F.col("part"), F.pmod(F.hash("phrase"), F.lit(SALT)), F.lit(0)))
    salts = salt(F.col("phrase"), F.sequence(F.lit(0), F.lit(SALT - 1)), F.array(F.lit(0)))
    known = counts.where("phrase <> ''").select("lang", F.col("phrase").alias("part"), F.col("f").alias("_f"), F.explode(salts).alias("_salt"))
    one = lambda side: F.max(F.when(side, F.col("_f")))
    scored = (
        asked.join(known, ["lang", "part", "_salt"])
        .repartition("lang", "phrase")
        .groupBy("lang", "phrase", "a", "k").agg(one(F.col("first")).alias("l"), one(~F.col("first")).alias("r"))
        .withColumn("score", F.floor(F.expr("cast(a as decimal(38,0)) * 2000000 div (cast(l as decimal(38,0)) + r)")))
        .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_best"))
    )

    inside = candidates.where("_m > 2").select("lang", F.explode(_inner(F.col("_w"), F.col("_m"))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    alone = scored.join(inside, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (_wide("_longer") * 100 < _wide("a") * percent))
    flat = alone.select("lang", "phrase", "a", "_best.l", "_best.r", "_best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = flat.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
