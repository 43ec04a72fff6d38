import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def texts() -> list[str | None]:
    """Null, empty, blank, tiny, very long, repeated and nearly repeated texts, and passages that several share."""
    rng = random.Random(5)
    passage, base = words(rng, 60), words(rng, 300)
    near = [*base]
    near[150] = "changed"
    out = [None, "", " \t\n", "a", "É b\x1cc don't 12ab", "word " * 90, "x" * 5000, " ".join(base), " ".join(base), " ".join(near).upper()]
    out += [" ".join(words(rng, 40) + passage + words(rng, 40)) for _ in range(3)]
    out += ["\n".join(words(rng, 20 + 7 * i)) for i in range(12)]
    out += [" ".join(words(rng, 30_000, 5000))]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", None, None) for i, t in enumerate(texts)]
    rows.append((None, "a null key", None, None, None))
    rows.append((11, texts[11], "en", None, None))  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Columns with the names of results and of intermediate columns."""
    from pyspark.sql import functions as F

    names = "n_words n_removed spans items fp component_id representative text_hash sketch score lang_pred n_tokens prefixes piece start length sequence_id offset _text _k _h host path rule verdict edited licenses"
    return docs.withColumns({n: F.lit("clash") for n in names.split()})
