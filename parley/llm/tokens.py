"""Operator 1, token counts: exact counts at every prefix of every text.

Prefix dynamic programming (see bpe.PrefixCounter) leaves, for each document, one signed byte for each code
point: the change of the token count from the prefix before. Truncation and budget questions are sums over
these bytes; no text is encoded again.

Defined cases: a null text counts as empty (no bytes, no tokens, empty prefixes). Repeated rows give repeated
results. An empty table gives an empty result. Other columns of the input, whatever their names, are ignored;
the key column may hold nulls. Whole texts are counted, however long.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.bpe import prefix_counter
from parley.llm.common import chunks, share_code


def prefix_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes long, n_chars long, n_tokens long, prefixes binary (a signed byte for each code point)."""
    share_code(docs.sparkSession)
    kind = docs.schema[key].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(path)
        for batch in chunks(batches, "_text"):
            texts = batch.column(1).to_pylist()
            made = [counter.differences(x) if x else b"" for x in texts]
            columns = [
                batch.column(0),
                pa.array([len(x.encode()) if x else 0 for x in texts], pa.int64()),
                pa.array([len(x) if x else 0 for x in texts], pa.int64()),
                pa.array([int(np.frombuffer(x, np.int8).sum(dtype=np.int64)) for x in made], pa.int64()),
                pa.array(made, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_bytes", "n_chars", "n_tokens", "prefixes"])

    schema = T.StructType(
        [T.StructField(key, kind), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_chars", "n_tokens")), T.StructField("prefixes", T.BinaryType())]
    )
    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(count, schema)


def tokens_at(prefixes: bytes, n_chars: int) -> int:
    """The exact token count of the first n_chars code points."""
    return int(np.frombuffer(prefixes, np.int8)[: max(0, n_chars)].sum(dtype=np.int64))


def longest_within(prefixes: bytes, budget: int) -> int:
    """The length in code points of the longest prefix of at most budget tokens."""
    counts = np.cumsum(np.frombuffer(prefixes, np.int8), dtype=np.int64)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def cut_points(prefixes: Column | str, budget: int) -> Column:
    """longest_within() as a column: where to truncate to a budget."""

    @F.pandas_udf(T.LongType())
    def cuts(values: pd.Series) -> pd.Series:
        return values.map(lambda x: longest_within(x, budget) if x is not None else None)

    return cuts(F.col(prefixes) if isinstance(prefixes, str) else prefixes)
