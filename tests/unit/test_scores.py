"""Scores of a cell: exact, though only few documents are scored in double precision."""

import math
import random
from functools import partial

import numpy as np
import pyarrow as pa

from parley.operators import cells, search

LISTS = pa.list_(pa.int32())


def test_few_documents_are_scored_twice(monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    texts = [["the"] * rng.randint(1, 3) + ["my"] * rng.randint(0, 2) + rng.choices(words, [1 / (i + 1) for i in range(500)], k=rng.randint(5, 25)) for _ in range(3000)]
    asked = [["the", "my", *rng.choices(words, [1 / (i + 5) for i in range(500)], k=6)] for _ in range(60)]
    idf = {w: math.log(1 + 3000 / sum(w in t for t in texts[:200] + [[w]])) for w in {w for t in texts for w in t}}
    counted = lambda t: [(w, t.count(w), t.index(w)) for w in sorted(set(t)) if w in idf]
    share = [len(t) / 15 for t in texts]
    docs = pa.table(
        {"_cell": np.zeros(3000, np.int32), "doc": range(3000), "pos": range(3000), "share": share, "words": [" ".join(w for w, _, _ in counted(t)) for t in texts], "tf": pa.array([[n for _, n, _ in counted(t)] for t in texts], LISTS)}
    )
    norm = [math.sqrt(sum((n * idf[w]) ** 2 for w, n, _ in counted(t))) for t in asked]
    queries = pa.table(
        {"_q": range(60), "norm": norm, "words": [" ".join(w for w, _, _ in counted(t)) for t in asked], "n": pa.array([[x[1] for x in counted(t)] for t in asked], LISTS), "at": pa.array([[x[2] for x in counted(t)] for t in asked], LISTS)}
    )
    looked: list[int] = []
    exact = cells.Block._exact
    monkeypatch.setattr(cells.Block, "_exact", lambda self, q, d, *a: looked.append(len(d)) or exact(self, q, d, *a))
    known = pa.table({"term": sorted(idf), "idf": [idf[w] for w in sorted(idf)]})
    q, d, scores, _ = cells.Block(docs, known, 3, partial(search.weight, scheme="bm25"), True).best(queries)
    for i, (text, length) in enumerate(zip(asked, norm)):
        own = []
        for j, t in enumerate(texts):
            w = {x: search.weight(n, idf[x], share[j], "bm25") for x, n, _ in counted(t)}
            own.append(sum(n * idf[x] / length * w.get(x, 0.0) for x, n, _ in counted(text)) / math.sqrt(sum(v * v for v in w.values())))
        assert np.allclose(scores[q == i], sorted(own)[:-4:-1], rtol=0, atol=1e-12)
    assert 180 <= sum(looked) < 60 * 3000 / 50
