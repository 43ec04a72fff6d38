"""Operator 11, spelling variant grouping: words that differ by one code point, found by a rare-first bigram filter.

Words are counted over whole texts, a task sends each word on with its count so far. Bigrams are ordered by the
number of words that have them, rare ones first. One edit destroys two bigrams of a word at most and moves the others by
one place at most, so two near words share one of the three rarest bigrams of each, at places that differ by one
at most. Of the two words, let x be the one whose third bigram is rarer: one of x's three stays, and it is no more
frequent than the third of the other word. That holds if a bigram that repeats in a word isn't cut off in the middle,
so further places of the third one count as well. A word is sent to the place of each of these bigrams ("home") and to
the next one, and compared there with the words that are at home: with those of its length for one replaced code
point, with those of the next length for one inserted.

A place with more than `block` words is split: words that are near share their first or their last half (of the
shorter one's length), so each goes to the parts by the hashes of its halves, three at most. What is broadcast is bounded by
the alphabet: 90 letters, so 8,100 bigrams, and CELLS places of each.

Forms lead to a word of at least twice the count, so that a chain has no circle and fewer than 64 steps; the last
word of each chain is found by doubling the steps, with only those chains joined that still go on.

Defined cases: a null or empty text has no words, a null key is empty text in the hash of `damage`. An empty table
gives an empty result. A repeated row counts again. Other columns of the input are ignored, whatever their names.
Very long texts are taken in whole, as are very long words.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import chunks, cut, discard, share_code

#: Runs of letters, after A-Z became a-z; every code point of one fits in a byte of Latin-1.
RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Different words that a task holds before it sends their counts on.
HELD = 200_000
#: Words at a place before it is split, and places of a bigram that are counted one by one (the rest together).
BLOCK, CELLS = 4096, 64
#: Comparisons made at once, and rows of whole places that are looked at together.
AT_ONCE, ROWS = 1 << 20, 1 << 16


def word_counts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 5, min_count: int = 3, damage: int | None = None,
) -> DataFrame:
    """word, n long: words of at least min_chars code points that occur at least min_count times.

    damage: a word with crc32("<key>:<word>") divisible by it loses one code point, at that crc32 modulo its length;
    made-up misspellings, by which the grouping can be judged.
    """
    share_code(docs.sparkSession)

    def sent(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in chunks(batches, "_text"):
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not value:
                    continue
                found = Counter(RUN.findall(value.encode().translate(LOWER).decode()))
                base = zlib.crc32(f"{name}:".encode())
                for word, n in found.items():
                    if damage:
                        h = zlib.crc32(word.encode(), base)
                        if h % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                    if len(word) >= min_chars:
                        held[word] += n
                if len(held) >= HELD:
                    yield sent(held)
                    held = Counter()
        if held:
            yield sent(held)

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_name"), F.col(text).alias("_text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Grams:
    """The bigrams of a batch of words: whose, where and which, in the order of words and places."""

    def __init__(self, words: list[bytes]):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        if len(words) and self.size.min() < 4:
            raise ValueError("a word of fewer than four code points may be near another without a bigram in common")
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
        start = np.cumsum(self.size) - self.size
        inner = np.ones(max(0, len(data) - 1), bool)
        inner[start[1:] - 1] = False
        self.code = (data[:-1] << 8 | data[1:])[inner]
        self.word = np.repeat(np.arange(len(words)), self.size - 1)
        self.at = np.arange(len(self.code)) - np.repeat(np.cumsum(self.size - 1) - (self.size - 1), self.size - 1)

    def rarest(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, place and code of the three rarest bigrams, and of further places of the third."""
        ranks = rank[self.code]
        order = np.lexsort((self.at, ranks, self.word))
        first = np.cumsum(self.size - 1) - (self.size - 1)
        third = ranks[order[first + 2]]
        kept = order[ranks[order] <= third[self.word[order]]]
        return self.word[kept], self.at[kept], self.code[kept]


def _halves(word: bytes) -> set[int]:
    """Hashes of the halves that the word shares with a near one: by its own length, or by a length less than that."""
    a, b = len(word) // 2, (len(word) - 1) // 2
    parts = (b"<" + word[:a], b"<" + word[:b], b">" + word[a:], b">" + word[b + 1 :])
    return set(map(zlib.crc32, parts))


def _replaced(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (the first below the second) that differ in exactly one column."""
    m, width = a.shape
    columns, step = np.ascontiguousarray(a.T), max(1, AT_ONCE // m)
    left, right = [], []
    for start in range(0, m, step):
        rows = slice(start, start + step)
        differ = np.zeros((len(a[rows]), m - start), np.uint8 if width < 255 else np.int32)
        for c in columns:
            differ += c[rows, None] != c[None, start:]
        i, j = np.nonzero(differ == 1)
        left.append(i[i < j] + start)
        right.append(j[i < j] + start)
    return np.concatenate(left), np.concatenate(right)


def _inserted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row of a and one of b, which has a column more, that are equal without some column of b's."""
    m, width = a.shape
    ours, theirs, step = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), max(1, AT_ONCE // len(b))
    left, right = [], []
    for start in range(0, m, step):
        rows = slice(start, start + step)
        shape = (len(a[rows]), len(b))
        equal = np.zeros(shape, np.int16 if width < 1 << 14 else np.int64)
        for shift in (0, 1):
            alive = np.ones(shape, bool)
            for p in range(width) if not shift else range(width - 1, -1, -1):
                alive &= ours[p, rows, None] == theirs[p + shift, None]
                equal += alive
                if p % 4 == 0 and not alive.any():
                    break
        i, j = np.nonzero(equal >= width)
        left.append(i + start)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _compared(places: np.ndarray, home: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near words of each place, as numbers of rows, one of which is at home; each pair once."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.lexsort((size, places))
    edges = np.flatnonzero(np.diff(places[order]) | np.diff(size[order])) + 1
    runs, left, right, before = np.split(order, edges), [], [], None
    for run in runs:
        width = size[run[0]]
        grid = np.frombuffer(b"".join(words[run]), np.uint8).reshape(len(run), width)
        if len(run) > 1:
            i, j = _replaced(grid)
            left.append(run[i])
            right.append(run[j])
        if before is not None and places[before[0][0]] == places[run[0]] and before[1].shape[1] == width - 1:
            i, j = _inserted(before[1], grid)
            left.append(before[0][i])
            right.append(run[j])
        before = run, grid
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate(left), np.concatenate(right)
    kept = home[i] | home[j]
    return i[kept], j[kept]


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, near, near_n: every word of words (word, n; each once, four code points at least) with every near one, both ways."""
    share_code(words.sparkSession)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                counts = np.bincount(Grams([x.encode("latin-1") for x in batch.column(0).to_pylist()]).code)
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(counts)), pa.array(counts[counts > 0])], names=["code", "n"])

    # 8,100 rows at most: pairs of 90 letters.
    counted = words.select("word").mapInArrow(grams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    rank = np.zeros(1 << 16, np.int32)
    rank[counted.sort_values(["n", "code"])["code"].to_numpy(np.int64)] = np.arange(len(counted))

    def crowds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, at, code = Grams([x.encode("latin-1") for x in batch.column(0).to_pylist()]).rarest(rank)
                cells, counts = np.unique(code.astype(np.int64) * CELLS + np.minimum(at, CELLS - 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts)], names=["cell", "n"])

    # 8,100 * CELLS rows at most, and only the crowded ones.
    crowded = words.select("word").mapInArrow(crowds, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > block // 2).toPandas()
    at_home = dict(zip(crowded["cell"].tolist(), crowded["n"].tolist()))

    def parts(code: int, at: int) -> int:
        own, last = (at_home.get(code * CELLS + min(x, CELLS - 1), 0) for x in (at, max(0, at - 1)))
        return min(1 << 20, -(-(own + last) // block))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = [x.encode("latin-1") for x in batch.column(0).to_pylist()]
            whose, at, code = Grams(raw).rarest(rank)
            rows, keys, homes = [], [], []
            for w, p, c in zip(whose.tolist(), at.tolist(), code.tolist()):
                for home in (True, False):
                    spot = p + (not home)
                    n = parts(c, spot)
                    for part in {h % n for h in _halves(raw[w])} if n > 1 else (0,):
                        rows.append(w)
                        keys.append(c << 45 | min(spot, (1 << 25) - 1) << 20 | part)
                        homes.append(home)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(homes), *taken.columns], names=["place", "home", "word", "n"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by place; those of a place are compared when the last one is there."""
        def found(rows: pd.DataFrame) -> pa.RecordBatch:
            word, n = rows["word"].to_numpy(), rows["n"].to_numpy()
            raw = np.array([x.encode("latin-1") for x in word], object)
            i, j = _compared(rows["place"].to_numpy(), rows["home"].to_numpy(), raw)
            i, j = np.concatenate([i, j]), np.concatenate([j, i])
            return pa.RecordBatch.from_arrays([pa.array(word[i], pa.string()), pa.array(word[j], pa.string()), pa.array(n[j], pa.int64())], names=["word", "near", "near_n"])

        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < ROWS:
                continue
            rows = pa.Table.from_batches(held).to_pandas()
            last = int(np.searchsorted(rows["place"].to_numpy(), rows["place"].iloc[-1]))
            if last:
                yield found(rows.iloc[:last])
            held, size = pa.Table.from_batches(held).slice(last).to_batches(), size - last
        if held:
            yield found(pa.Table.from_batches(held).to_pandas())

    spread = words.select("word", "n").mapInArrow(placed, "place long, home boolean, word string, n long")
    pairs = spread.repartition("place").sortWithinPartitions("place").mapInArrow(compared, "word string, near string, near_n long")
    return pairs.repartition("word").dropDuplicates(["word", "near"])


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root: where the steps from word to form end, for each word of forms (word, form)."""
    whose = forms.select(F.col("word").alias("form"), F.lit(True).alias("_more"))
    now = cut(forms.join(whose, "form", "left").select("word", F.col("form").alias("root"), F.coalesce("_more", F.lit(False)).alias("more")), "forms")
    while now.where("more").limit(1).count():
        on = now.select(F.col("word").alias("root"), F.col("root").alias("_next"), F.col("more").alias("_goes"))
        moved = now.where("more").join(on, "root").select("word", F.col("_next").alias("root"), F.col("_goes").alias("more"))
        before, now = now, cut(now.where("not more").unionByName(moved), "forms")
        discard(before)
    return now.select("word", "root")


def variants(words: DataFrame, factor: int = 2, block: int = BLOCK) -> DataFrame:
    """word, form, root string; n, n_near, form_n long, for each row of words (word, n).

    A word's form is its near word of largest n (of several the first in code-point order), if that n is at least
    factor times the word's own; root is where the forms lead.
    """
    if factor < 2:
        raise ValueError("forms need at least twice the count, or they could go in a circle")
    words = cut(words.select("word", "n"), "words")
    best = near_words(words, block).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("_best"))
    joined = words.join(best, "word", "left")
    fits = -F.col("_best.col1") >= factor * F.col("n")
    near = cut(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("_best.near")).alias("form"), F.when(fits, -F.col("_best.col1")).alias("form_n"),
        ),
        "near",
    )
    roots = last_forms(near.where("form is not null").select("word", "form"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
