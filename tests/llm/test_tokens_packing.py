import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parley.llm import packing, tokens
from parley.llm.bpe import Encoder, PrefixCounter, Vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_every_prefix_is_exact(library):
    rng = random.Random(1)
    parts = [
        "a", "th", " ", "  ", "\n", "\t", "'", "'re", "'ll", "'s", "1", "23", "_", "-", "é", "ß", "漢", "😀", "\u0301", "ing",
        "<|endoftext|>", "<|", "\u00a0", "²", "!", "...", "\x1c", "\u3000",
    ]
    counter, encoder = PrefixCounter(PATH), Encoder(PATH)
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        deltas = counter.differences(text)
        counts = [0, *np.cumsum(np.frombuffer(deltas, np.int8)).tolist()]
        assert counts == [len(ids_of(library, text[:i])) for i in range(len(text) + 1)], text
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids_of(library, text)


def test_neighbours_agree_as_merging_says():
    vocabulary, counter, rng = Vocabulary(PATH), PrefixCounter(PATH), random.Random(2)
    some = [i for i in range(2000) if i in vocabulary.token]
    for _ in range(3000):
        a, b = rng.choice(some), rng.choice(some)
        assert counter.agrees[a << 24 | b] == (vocabulary.merge(vocabulary.token[a] + vocabulary.token[b]) == [a, b])


def test_long_pieces(library):
    text = "ab" * 3000 + " " * 2000 + "é" * 700
    assert np.frombuffer(Encoder(PATH).encode(text), "<u4").tolist() == ids_of(library, text)
    assert sum(np.frombuffer(PrefixCounter(PATH).differences(text), np.int8).tolist()) == len(ids_of(library, text))


def test_prefix_counts(docs, no_docs, clashing, library):
    rows = tokens.prefix_counts(docs, PATH).withColumn("cut", tokens.cut_points("prefixes", 50)).collect()
    given = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect())
    assert sorted(
        (r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_chars, r.n_tokens) for r in rows
    ) == sorted((k, len(t.encode()), len(t), len(ids_of(library, t))) for k, t in given)
    by = dict(given)
    for r in rows:
        text = by[r.doc_id if r.doc_id is not None else -1]
        assert len(r.prefixes) == len(text) and tokens.tokens_at(r.prefixes, len(text)) == r.n_tokens
        assert len(ids_of(library, text[: r.cut])) <= 50
        assert r.cut == len(text) or r.n_tokens > 50
    assert tokens.prefix_counts(no_docs, PATH).count() == 0
    assert tokens.prefix_counts(clashing, PATH).count() == len(rows)


def test_pieces_and_places(docs, no_docs, clashing, library):
    rows = packing.pack(docs, PATH, 64, group=10).collect()
    want = []
    for r in docs.collect():
        ids = [*ids_of(library, r.text), 0]
        cuts = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)] if len(ids) > 64 else [0, len(ids)]
        want += [(r.doc_id or -1, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(no_docs, PATH, 64).count() == 0
    assert packing.pack(clashing, PATH, 64).count() == len(rows)


def test_place_minimises_the_sum_of_squares():
    rng = random.Random(3)
    limit, sizes = 20, sorted((rng.randint(1, 20) for _ in range(300)), reverse=True)
    bins, offsets = packing.place(np.array(sizes), limit)
    fill: dict[int, int] = {}
    for size, where, offset in zip(sizes, bins.tolist(), offsets.tolist()):
        def squares(target):
            after = {**fill, target: fill.get(target, 0) + size}
            open_bins = [x for x in after.values() if x < limit]
            return sum(open_bins.count(x) ** 2 for x in set(open_bins))

        fits = [b for b, x in fill.items() if x + size <= limit]
        if size < limit:
            assert squares(where) == min(squares(b) for b in fits) if fits else where not in fill
        assert fill.get(where, 0) == offset
        fill[where] = offset + size
    assert len(fill) <= 1.03 * sum(sizes) / limit + 2


def test_packing_fill(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 900)) for i in range(1500)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 2048, group=200)
    n, total = packed.selectExpr("count(distinct sequence_id)", "sum(length)").first()
    assert n <= total / 2048 * 1.005 + 2


def test_many_special_strings(library):
    """Ten thousand of them, apart and adjacent: no recursion, the library's ids."""
    mark = "<|endoftext|>"
    counter, encoder = PrefixCounter(PATH), Encoder(PATH)
    for text in (mark * 10_000, "ab " + f" x{mark}yz"  * 10_000, mark + "a" + mark[:-1] + mark):
        ids = ids_of(library, text)
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids
        assert sum(np.frombuffer(counter.differences(text), np.int8).tolist()) == len(ids)


def test_full_pieces_and_equal_rows(spark, library):
    """One long document next to many equal rows: full pieces stand alone, equal rows are spread over the groups."""
    rows = [(None, "same words again")] * 400 + [(1, "word " * 5000)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 64, group=50).collect()
    bins: dict = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(n for b in bins.values() for _, n in b) == 400 * (len(ids_of(library, rows[0][1])) + 1) + len(ids_of(library, rows[-1][1])) + 1
    assert all(sum(n for _, n in b) <= 64 and sorted(b)[0][0] == 0 for b in bins.values())
    assert sum(b == [(0, 64)] for b in bins.values()) >= 5000 // 64


def test_digests_of_the_queries(spark, texts, library, tmp_path):
    """Every column of the contract, recomputed."""
    from parley.llm import queries

    rows = [(i, t, "en", None, None) for i, t in enumerate(texts)] + [(90, "w " * 1500, "en", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: ids_of(library, t) for i, t, *_ in rows}
    found = queries.op1_token_counts(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert sorted(map(tuple, found)) == [(i, len((t or "").encode()), len(want[i]), len(want[i]) > 1024) for i, t, *_ in rows]
    assert {r.over_limit for r in found} == {True, False}
    pieces: dict = {}
    for r in queries.op2_best_fit_packing(spark, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        part = [*want[r.doc_id], 0][r.start : r.start + r.length]
        assert r.length == len(part) <= 2048 and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for i, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(want[i]) + 1
        assert all(a.start + a.length == b.start for a, b in zip(own, own[1:])) and all(r.length == 2048 for r in own[1:])
    assert len(pieces) == len(rows)
