"""Operator 5, benchmark decontamination with a generalised suffix automaton.

The words of all test items make one automaton. Texts stream through it word by word; the state and the length
of the longest match at a word tell whether a window of an item ends there: a window is `window` consecutive
item words, or a whole item that has fewer. Words inside an occurrence are hit. Only stretches of known words
that are long enough for the shortest window go through the automaton.

The items are read to the driver in shards of at most `shard_words` words each (a parameter with a fixed
default), one automaton for each, and at most `shards` automata are on the driver, broadcast and held by a worker at a
time. A larger benchmark is scanned for in several passes: what a pass found is written with the texts, and the next one adds
to it. Hits of all shards are united, so the result is the same whatever the shards.

Defined cases: null or empty texts have no words and no hits; an item without words has no window; rows repeated
in the items count once per item id; a null item id marks hits but is no item to be listed; an empty benchmark
hits nothing; other columns, whatever their names, are ignored. A null key is kept. Texts of any length are
looked at whole.
"""

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import byte_rows, chunks, cut, discard, share_code
from parley.llm.words import WORD_BYTES

SHARD_WORDS, SHARDS = 50_000, 4
#: A-Z in lower case; what isn't in a word as a space. Words are digits, letters and all that isn't ASCII.
_TO_WORDS = WORD_BYTES.tobytes()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class Automaton:
    """A generalised suffix automaton over word numbers, with the items of each window at the state that holds it."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.window, self.number = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        whole: list[tuple[int, int, str | None]] = []
        for name, text in items:
            symbols = [self.number.setdefault(w, len(self.number)) for w in words_of(text)]
            last = 0
            for symbol in symbols:
                last = self._extend(last, symbol)
            if symbols and len(symbols) < window:
                whole.append((last, len(symbols), name))
        self.shortest = min([n for _, n, _ in whole], default=window)
        self.short: list[tuple[tuple[int, str | None], ...]] = [()] * len(self.length)
        own: dict[int, set] = {}
        for state, n, name in whole:
            own.setdefault(self._holding(state, n), set()).add((n, name))
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        for state in order[1:]:  # a link is shorter, so its list is ready
            self.short[state] = (*self.short[self.link[state]], *own.get(state, ()))
        self.at_window = [0] * len(self.length)
        for state in order[1:]:
            up = self.link[state]
            if self.length[state] >= window > self.length[up]:
                self.at_window[state] = state
            elif self.length[up] >= window:
                self.at_window[state] = self.at_window[up]
        # The windows of each item, walked again now that no state splits any more.
        self.items: dict[int, set[str]] = {}
        for name, text in items:
            state = 0
            for i, word in enumerate(words_of(text)):
                state = self.next[state][self.number[word]]
                if i + 1 >= window:
                    found = self.items.setdefault(self.at_window[state], set())
                    if name is not None:
                        found.add(name)

    def _holding(self, state: int, n: int) -> int:
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _state(self, length: int, after: dict[int, int], link: int) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, state: int, symbol: int, target: int) -> int:
        """The state for state's longest word and then symbol, where target also holds longer ones."""
        copy = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        """Append a symbol to what ends in last; other items may have gone this way before."""
        target = self.next[last].get(symbol)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, symbol, target)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and symbol not in self.next[last]:
            self.next[last][symbol] = new
            last = self.link[last]
        if last >= 0:
            target = self.next[last][symbol]
            self.link[new] = target if self.length[target] == self.length[last] + 1 else self._split(last, symbol, target)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [from, to) of hit words, ascending and apart, and the items whose windows occur."""
        known = self.number.get
        symbols = list(map(known, words))
        strange = [-1, *(i for i, x in enumerate(symbols) if x is None), len(symbols)]
        spans: list[list[int]] = []
        states, short = set(), set()
        shortest, window, follow, link, length = self.shortest, self.window, self.next, self.link, self.length
        for before, after in zip(strange, strange[1:]):
            if after - before <= shortest:
                continue
            state, n = 0, 0
            for i in range(before + 1, after):
                symbol = symbols[i]
                while state and symbol not in follow[state]:
                    state = link[state]
                    n = length[state]
                if symbol in follow[state]:
                    state = follow[state][symbol]
                    n += 1
                if n < shortest:
                    continue
                best = 0
                if n >= window:
                    best = window
                    states.add(self.at_window[state])
                for m, name in self.short[state]:
                    if m <= n:
                        best = max(best, m)
                        short.add(name)
                if best:
                    begin = i + 1 - best
                    while spans and spans[-1][0] >= begin:
                        spans.pop()
                    if spans and spans[-1][1] >= begin:
                        spans[-1][1] = i + 1
                    else:
                        spans.append([begin, i + 1])
        found = set().union(*(self.items[x] for x in states)) | short if states or short else set()
        found.discard(None)
        return [(a, b) for a, b in spans], found


def _shards(benchmark: DataFrame, item: str, text: str, shard_words: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items in shards of at most shard_words words (or a single item); one shard at a time is on the driver."""
    held, size = [], 0
    for name, value in benchmark.select(F.col(item).cast("string"), F.col(text)).distinct().toLocalIterator():
        raw = (value or "").encode()
        n = len(words_of(raw))
        if not n:
            continue
        if held and size + n > shard_words:
            yield held
            held, size = [], 0
        held.append((name, raw))
        size += n
    if held:
        yield held


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", keep: tuple[str, ...] = (), shard_words: int = SHARD_WORDS, shards: int = SHARDS,
) -> DataFrame:
    """key, the kept columns, n_words long, spans array of (begin, end) word numbers, items array of strings (sorted)."""
    spark = docs.sparkSession
    share_code(spark)
    pair = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    found = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(pair)), T.StructField("items", T.ArrayType(T.StringType()))]
    column = text if text in keep else "_text"  # the text goes once
    current = docs.select(F.col(key), *(F.col(c) for c in keep), *([] if text in keep else [F.col(text).alias("_text")]))
    whole = current.schema
    where, kind = current.columns.index(column), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def scan(automata: list, width: int, first: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded = [x.value for x in automata]
            for batch in chunks(batches, column):
                counts, spans, items = [], [], []
                before = [None] * batch.num_rows if first else zip(batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist())
                for value, past in zip(byte_rows(batch.column(where)), before):
                    words = words_of(value) if value else []
                    counts.append(len(words))
                    hits = [x.scan(words) for x in loaded]
                    if past:
                        hits.append(([(y["begin"], y["end"]) for y in past[0]], set(past[1])))
                    spans.append([{"begin": a, "end": b} for a, b in (hits[0][0] if len(hits) == 1 else unite(y for x, _ in hits for y in x))])
                    items.append(sorted(set().union(*(x for _, x in hits))))
                kept = batch.columns[: len(keep) + 1] if last else batch.columns[:width]
                names = [*batch.schema.names[: len(kept)], *(f.name for f in found)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], names=names,
                )

        return run

    parts, passes = _shards(benchmark, item, item_text, shard_words), 0
    ahead = list(islice(parts, shards))
    while True:
        automata = [spark.sparkContext.broadcast(Automaton(x, window)) for x in ahead]
        ahead = list(islice(parts, shards))
        kept = whole.fields if ahead else whole.fields[: len(keep) + 1]
        made = current.mapInArrow(scan(automata, len(whole), passes == 0, not ahead), T.StructType([*kept, *found]))
        if not ahead:
            return made
        before, current, passes = current, cut(made, "scanned"), passes + 1
        if passes > 1:
            discard(before)
        for x in automata:
            x.destroy()


def unite(spans: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, ascending and apart."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def digest(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated in place of the spans and items."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])
    return found.withColumns(
        {"n_hit": hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256)}
    ).withColumn("contaminated", F.col("n_hit") > 0).drop("spans", "items")


def _without(text: str, spans: list[dict]) -> str:
    """The text without the hit words and what stands between them; the rest stays as it is, joined by one space."""
    raw = text.encode()
    plain = np.frombuffer(raw.translate(_TO_WORDS), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], plain.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    parts, at = [], 0
    for span in spans:
        parts.append(raw[at : begin[span["begin"]]])
        at = end[span["end"] - 1]
    parts.append(raw[at:])
    return b" ".join(x for x in (y.strip() for y in parts) if x).decode()


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", shard_words: int = SHARD_WORDS, shards: int = SHARDS,
) -> DataFrame:
    """docs without the spans that are hit; a document of which more than max_coverage of the words are hit goes.

    Columns of docs named n_words, spans, items or _text are left out.
    """
    docs = docs.drop("n_words", "spans", "items", "_text")
    names = docs.columns
    kept = tuple(c for c in names if c != key)
    found = find_contamination(docs, benchmark, window, key, text, item, item_text, kept, shard_words, shards)
    share = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])
    found = found.where((F.col("n_words") == 0) | (share <= F.col("n_words") * F.lit(max_coverage)))
    where = names.index(text)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(names)).to_pylist()
            texts = batch.column(where).to_pylist()
            columns = [batch.column(i) for i in range(len(names))]
            columns[where] = pa.array([_without(t, s) if s else t for t, s in zip(texts, spans)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return found.select(*names, "spans").mapInArrow(strip, docs.schema)
