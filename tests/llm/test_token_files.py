"""Operator 12: exact round trips, and every key of the index."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from parley.llm import token_files
from parley.llm.queries import op12_token_files
from parley.llm.token_files import PerfectHash

PATH = public_tokenizers.path("byte_bpe_50k.json")
NAMES = ("doc_id", "repeat", "start", "n_tokens", "ids_crc32", "ids")


def hash_of(*values):
    return np.array([zlib.crc32(repr(v).encode()) << 32 | zlib.crc32(repr(v).encode()[::-1]) for v in values], np.uint64)


def packed(tokenizer, text, end=0):
    return struct.pack(f"<{len(ids)}I", *ids) if (ids := [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]) else b""


def by_key(docs):
    """Raw ids of all texts with a key, by key."""
    tokenizer, out = Tokenizer.from_file(PATH), {}
    for r in docs.select("doc_id", "text").collect():
        out.setdefault(r.doc_id, []).append(packed(tokenizer, r.text))
    return out


def checked(found, docs):
    """Records come in ascending order of keys, nulls first, without gaps; each has its own text's ids."""
    want, rows = by_key(docs), sorted(found, key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [k for k in sorted(want, key=lambda k: (k is not None, k or 0)) for _ in want[k]]
    start, repeat, last = 0, 0, object()
    for r in rows:
        repeat = repeat + 1 if r.doc_id == last else 0
        last = r.doc_id
        assert (r.start, r.repeat, r.n_tokens * 4, r.ids_crc32) == (start, repeat, len(r.ids), zlib.crc32(r.ids))
        start += r.n_tokens
        want[r.doc_id].remove(bytes(r.ids))
    assert not any(want.values())


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 5000, 60_000])
def test_perfect_hash(n):
    one, two = hash_of(*range(n)), hash_of(*range(-n, 0))
    made = PerfectHash.of(one, two)
    assert sorted(made.slots(one, two).tolist()) == list(range(n))
    if n >= 5000:
        assert made.sizes.sum() < 4 * n
    others = made.slots(two, one)
    assert ((others >= -1) & (others < max(1, n))).all()


def test_same_hashes_are_told():
    with pytest.raises(ValueError):
        PerfectHash.of(hash_of(1, 1), hash_of(2, 2))


def test_round_trip(spark, docs, clashing, tmp_path, monkeypatch):
    """Small blocks, files and buckets; keys that repeat run over many files."""
    for name, value in (("BLOCK_BYTES", 300), ("FILE_BLOCKS", 2), ("KEYS", 7)):
        monkeypatch.setattr(token_files, name, value)
    rng = random.Random(2)
    more = [(rng.choice([3, 3, 3, None, -20, 10**15]), "w " * rng.randrange(300), None, None, None) for _ in range(120)]
    for name, table in (("plain", docs), ("clashing", clashing.withColumns({c: F.lit("x") for c in ("key", "repeat", "name", "content", "_order", "_tie", "_key")}))):
        table = table.unionByName(spark.createDataFrame(more, docs.schema), allowMissingColumns=True)
        path = f"{tmp_path}/{name}"
        token_files.write(table, path, PATH)
        found = token_files.find(token_files.repeats(table, step=16), path, repeat="repeat").select(*NAMES, "file").collect()
        checked(found, table)
        assert len({r.file for r in found}) > 20 and len({r.file for r in found if r.doc_id == 3}) > 3


def test_joined_by_shuffle(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BROADCAST", 3)
    token_files.write(docs, str(tmp_path / "a"), PATH)
    checked(token_files.find(token_files.repeats(docs), str(tmp_path / "a"), repeat="repeat").collect(), docs)


def test_single_keys(spark, docs, no_docs, tmp_path):
    path, want = str(tmp_path / "a"), by_key(docs)
    token_files.write(docs, path, PATH)
    for key in (0, 1, 11, 25, None):
        for repeat, _ in enumerate(want[key]):
            assert token_files.get(spark, path, key, repeat).astype("<u4").tobytes() in want[key]
        assert token_files.get(spark, path, key, len(want[key])) is None
    assert token_files.get(spark, path, -1) is None
    asked = spark.createDataFrame([(4,), (4,), (-9,), (None,), (10**14,)], "doc_id long")
    assert {r.doc_id for r in token_files.find(asked, path).collect()} == {4, None}
    assert token_files.find(no_docs, path).collect() == []
    assert {f for f, in token_files._files(spark, path).select("name").collect()} == {r.name for r in spark.read.parquet(f"{path}/files").collect()}


def test_text_keys_and_other_ids(spark, tmp_path):
    """Keys of text, an end id beyond 16 bits."""
    rows = [("b", "one"), ("", "two"), ("é ü", None), ("a", "three four"), ("a", "three"), (None, "")]
    docs, path, tokenizer = spark.createDataFrame(rows, "name string, body string"), str(tmp_path / "a"), Tokenizer.from_file(PATH)
    token_files.write(docs, path, PATH, end=70_000, key="name", text="body")
    found = token_files.find(token_files.repeats(docs, "name"), path, "name", "repeat").collect()
    assert sorted((r.name or "", bytes(r.ids)) for r in found) == sorted((k or "", packed(tokenizer, t, 70_000)) for k, t in rows)
    assert token_files.get(spark, path, "é ü").tolist() == [70_000]


def test_empty(spark, no_docs, tmp_path):
    path = str(tmp_path / "a")
    token_files.write(no_docs, path, PATH)
    assert token_files.find(spark.createDataFrame([(4,)], "doc_id long"), path).collect() == []
    assert token_files.get(spark, path, 4) is None


def test_query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = op12_token_files(spark, str(tmp_path))
    assert {c: k for c, k in found.dtypes if c in NAMES[2:5]} == dict.fromkeys(NAMES[2:5], "bigint")
    want = [(k, len(x) // 4, zlib.crc32(x)) for k, texts in by_key(docs).items() for x in texts]
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in found.collect()))) == sorted(map(str, want))
