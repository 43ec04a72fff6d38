import random
import re

import numpy as np
import pytest
import xxhash

from parley.llm import simhash, sketches, substrings


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_hand(text, shingle=3):
    words = split(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def groups(prints, threshold=2):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_components(docs, no_docs, clashing):
    given = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [by_hand(t) for _, t in given]
    label = groups(prints)
    want = []
    for (key, _), fp, g in zip(given, prints, label):
        keys = [k for (k, _), other in zip(given, label) if other == g and k is not None]
        want.append((key, f"{fp:016x}", min(keys, default=None)))
    order = lambda r: tuple(-1 if x is None else x for x in (r[0], r[2]))
    found = [(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(found, key=order) == sorted(want, key=order)
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.near_duplicates(clashing).count() == len(found)
    kept = simhash.keep_one(docs).collect()
    assert len(kept) == len(set(label)) == simhash.keep_one(clashing).count() and simhash.keep_one(no_docs).count() == 0


def test_links_at_every_distance(spark):
    """Chains and stars of fingerprints at one to four bits, and a dense ball: components as brute force has them."""
    rng = random.Random(7)
    prints = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints.add(x)
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << bit
    center = rng.getrandbits(64)
    for _ in range(300):
        x = center
        for bit in rng.sample(range(12), rng.randint(0, 4)):
            x ^= 1 << bit
        prints.add(x)
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    end = {x: x for x in signed}
    for step in simhash.components(edges):
        to = {r.node: r.to for r in step.collect()}
        end = {x: to.get(y, y) for x, y in end.items()}
    label = groups(prints)
    ours = [end[x] for x in signed]
    assert len(set(zip(ours, label))) == len(set(label)) == len(set(ours))


def test_anchors_cover():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [set(x) for x in simhash.anchors(fp).tolist()]
    assert max(map(len, sets)) <= 33
    for x, own in zip(fp.tolist(), sets):
        assert all((x ^ a).bit_count() <= 2 for a in own)
        i, j = rng.integers(0, 64, 2).tolist()
        other = np.array([x ^ 1 << i ^ 1 << j if i != j else x ^ 1 << i], np.uint64)
        assert own & set(simhash.anchors(other)[0].tolist())


def alike_groups(sets, similarity=0.8):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return label


def test_similarity_in_blocks(spark):
    """Large groups of near copies, chains of them, and texts that share much but not enough, in blocks of a few sets."""
    rng = random.Random(14)
    texts = []
    for g in range(4):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for c in range(25):
            words = [*base]
            if g % 2:  # a chain: each differs from the one before
                base[rng.randrange(120)] = f"n{g}.{c}"
            else:
                words[rng.randrange(120)] = f"n{g}.{c}"
            texts.append(" ".join(words))
        texts += [" ".join([*base[:70], *(f"x{rng.randrange(5000)}" for _ in range(50))]) for _ in range(10)]
    texts += ["", None, " ", "a b", "A b", *texts[:2]]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := split((t or "").lower())) else set() for t in texts]
    label = alike_groups([s or {()} for s in sets])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for most in (1000, 3):
        rows = {r.doc_id: r for r in simhash.near_duplicates(frame, shingle=5, similarity=0.8, most=most).collect()}
        assert [rows[i].component_id for i in range(len(texts))] == label
        assert sorted(r.doc_id for r in simhash.keep_one(frame, shingle=5, similarity=0.8, most=most).collect()) == sorted(set(label))


def test_narrower_links(spark):
    prints = [0, 1, 3, 1 << 63, 7 << 40]
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    for threshold in (0, 1, 2):
        edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), threshold).collect()
        label = groups(prints, threshold)
        assert len(prints) - len({frozenset(e) for e in map(tuple, edges)}) == len(set(label))
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_similarity_edges(docs, no_docs, clashing):
    assert simhash.near_duplicates(no_docs, similarity=0.8).count() == 0 and simhash.keep_one(no_docs, similarity=0.8).count() == 0
    assert simhash.near_duplicates(clashing, similarity=0.8).count() == docs.count()
    assert simhash.keep_one(clashing, similarity=0.8).count() == simhash.keep_one(docs, similarity=0.8).count() < docs.count()


def repeated(texts, window):
    count: dict = {}
    for t in texts:
        w = split(t)
        for i in range(len(w) - window + 1):
            s = tuple(w[i : i + window])
            count[s] = count.get(s, 0) + 1
    out = []
    for t in texts:
        w = split(t)
        hit = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                hit[i : i + window] = [True] * window
        out.append((len(w), sum(hit), " ".join(x for x, h in zip(w, hit) if not h)))
    return out


def test_substrings(docs, no_docs, clashing):
    given = [(r.doc_id, r.text) for r in docs.collect()]
    want = [(k, *x) for (k, _), x in zip(given, repeated([t for _, t in given], 35))]
    order = lambda r: (-1 if r[0] is None else r[0], r[1:])
    for bits, hot in ((26, 64), (16, 64), (26, 2)):  # a full sketch lets more through, hot keys less: nothing changes
        rows = [(r.doc_id, r.n_words, r.n_removed, r.text or "") for r in substrings.remove_repeated(docs, bits=bits, hot_count=hot).collect()]
        assert sorted(rows, key=order) == sorted(want, key=order)
    assert substrings.remove_repeated(no_docs).count() == 0
    assert substrings.remove_repeated(clashing).count() == len(given)


def test_substrings_random(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["a " * 50, "b", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for window, gram, hot in ((6, 3, 64), (9, 2, 3), (5, 5, 2)):
        rows = {r.doc_id: (r.n_words, r.n_removed, r.text or "") for r in substrings.remove_repeated(frame, window=window, gram=gram, hot_count=hot).collect()}
        assert [rows[i] for i in range(len(texts))] == repeated(texts, window)


def test_sketches(spark, docs, no_docs, clashing):
    plain = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    given = sorted((r.doc_id, r.text or "") for r in plain.collect())
    rows = {r.doc_id: r for r in sketches.edited_likeness(plain).collect()}
    assert len(rows) == len(given)
    prints = {r.doc_id: r.sketch for r in sketches.fingerprints(plain).collect()}
    for i, (key, text) in enumerate(given):
        after_key, after = given[(i + 1) % len(given)]
        half = len(text) // 2
        assert rows[key].edited == text[: len(text) - half] + after[:half] and rows[key].n_chars == len(text)
        assert rows[key].next_sketch == prints[after_key] and rows[key].sketch == prints[key]
        n = len(set(zip(*(split(text)[k:] for k in range(5)))))
        if n > 200:
            assert abs(len(prints[key]) - n / sketches.SCALED) < 5 * (n / sketches.SCALED) ** 0.5
    assert bool(prints[1]) is False and prints[3] and prints[7] == prints[8]
    assert sketches.edited_likeness(no_docs).count() == 0
    assert sketches.edited_likeness(clashing).count() == docs.count()


def test_next_over_many_ranges(spark):
    keys = random.Random(2).sample(range(-(10**6), 10**6), 5000)
    frame = spark.createDataFrame([(k, str(k)) for k in keys], "doc_id long, t string").repartition(7)
    rows = {r.doc_id: r.next_t for r in sketches.with_next(frame, ["t"]).collect()}
    order = sorted(keys)
    assert rows == {a: str(b) for a, b in zip(order, [*order[1:], order[0]])}


def test_likeness_estimates_the_jaccard_index(spark):
    rng = random.Random(3)
    words = [f"v{rng.randrange(10**6)}" for _ in range(6000)]
    a, b = " ".join(words[:4000]), " ".join(words[2000:])
    frame = sketches.fingerprints(spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string"))
    s = {r.doc_id: r.sketch for r in frame.collect()}
    assert s[1] == s[3]
    row = frame.alias("x").join(frame.alias("y"), on=None, how="cross").where("x.doc_id = 1 and y.doc_id = 2").selectExpr("x.sketch a", "y.sketch b")
    got = row.select(sketches.likeness(row.a, row.b), sketches.containment(row.a, row.b)).first()
    assert abs(got[0] - 1 / 3) < 0.08 and abs(got[1] - 0.5) < 0.1


def test_sketch_recomputed_and_merged(spark):
    rng = random.Random(21)
    some = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    texts = ["", "one", some(4), some(5), some(7), some(9), some(30), some(3000)]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(
        [(i, t, [w[k : k + 5] for k in range(max(1, len(w) - 4))] if (w := t.split()) else []) for i, t in enumerate(texts)],
        "doc_id long, text string, grams array<array<string>>",
    )
    rows = frame.select(
        "doc_id", sketches.sketch(F.col("text")).alias("s"), F.transform("grams", lambda g: F.xxhash64(g)).alias("h"),
    ).orderBy("doc_id").collect()
    least = (1 << 64) // sketches.SCALED
    keep = lambda h: sorted({x for x in h if 0 <= x < least}) or sorted(h)[:1]
    assert [r.s for r in rows] == [keep(r.h) for r in rows]
    # The merged sketch is that of the shingles of both, also of very unequal texts.
    pairs = spark.createDataFrame(
        [(i, j, rows[i].s, rows[j].s) for i in range(len(rows)) for j in range(len(rows))], "i int, j int, a array<long>, b array<long>",
    )
    for r in pairs.select("i", "j", sketches.merge(F.col("a"), F.col("b")).alias("m"), sketches.containment(F.col("a"), F.col("b")).alias("c")).collect():
        assert r.m == keep(rows[r.i].h + rows[r.j].h)
        a, b = set(rows[r.i].s), set(rows[r.j].s)
        assert r.c == (len(a & b) / len(a) if a else 1.0)


def test_digests_of_the_queries(spark, texts, tmp_path):
    """Every column of the contracts of operators 3, 4, 5 and 8, recomputed."""
    import hashlib

    from parley.llm import queries
    from tests.llm.test_filters import contaminated

    rows = [(i, t, "en", None, None) for i, t in enumerate(texts)]
    spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long",
    ).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    words = split(texts[10])
    items = [(i, " ".join(words[3 * i : 3 * i + 14])) for i in range(12)] + [(90, "a"), (91, None), (92, " ".join(split(texts[7])[5:18]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    plain = [t or "" for t in texts]

    three = {r.doc_id: r for r in queries.op3_document_fingerprints(spark, str(tmp_path)).collect()}
    prints = {t: three[i].fingerprint for i, t in enumerate(plain)}
    numbers = lambda s: {s[k : k + 16] for k in range(0, len(s), 16)}
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, text in enumerate(plain):
        after = plain[(i + 1) % len(plain)]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own = numbers(three[i].fingerprint)
        assert three[i].n_chars == len(text) and three[i].edited_sha256 == sha(edited) and three[i].fingerprint == prints[text]
        assert three[i].near_next == near(own, numbers(prints[after])) and three[i].near_edited == near(own, numbers(three[i].edited_fingerprint))

    four = {r.doc_id: r for r in queries.op4_simhash_near_dedup(spark, str(tmp_path)).collect()}
    fps = [by_hand(t) for t in texts]
    assert [(four[i].fingerprint, four[i].component_id) for i in range(len(texts))] == [(f"{x:016x}", g) for x, g in zip(fps, groups(fps))]

    five = {r.doc_id: r for r in queries.op5_benchmark_decontamination(spark, str(tmp_path)).collect()}
    want = contaminated(texts, [(str(k), t) for k, t in items], 10)
    assert [tuple(five[i])[1:] for i in range(len(texts))] == [(n, hit, len(found), sha(",".join(found)), hit > 0) for n, hit, found in want]
    assert sum(hit > 0 for _, hit, _ in want) > 3

    eight = {r.doc_id: r for r in queries.op8_substring_dedup(spark, str(tmp_path)).collect()}
    assert [tuple(eight[i])[1:] for i in range(len(texts))] == [(n, gone, sha(kept)) for n, gone, kept in repeated(texts, 35)]


def test_a_passage_in_every_chunk(spark, monkeypatch):
    """Single occurrences that a later chunk of the same task, or another task, meets again; memory of few windows."""
    rng = random.Random(17)
    passage = [f"p{i}" for i in range(20)]
    texts = [
        " ".join([*(f"u{rng.randrange(10**6)}" for _ in range(12)), *(passage if i % 3 == 0 else []), *(passage[:9] if i % 7 == 0 else [])]) for i in range(90)
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for parts, size, memory in ((1, 300, 1 << 18), (3, 300, 1 << 18), (2, 300, 8), (1, 1 << 20, 4)):
        monkeypatch.setattr(substrings, "WINDOW_BYTES", size)
        monkeypatch.setattr(substrings, "MEMORY", memory)
        rows = {
            r.doc_id: (r.n_words, r.n_removed, r.text or "") for r in substrings.remove_repeated(
                frame.repartition(parts), window=6, gram=3, hot_count=4,
            ).collect()
        }
        assert [rows[i] for i in range(len(texts))] == repeated(texts, 6)
