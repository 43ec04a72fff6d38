"""Text columns: tokens, white space, and word-bounded patterns for Spark, with their DuckDB forms for the oracles."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python counts as a word character and as white space.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"\t-\r\x{1C}-\x{1F} \x{85}\p{Z}"
ASCII_TOKEN = "[a-zA-Z0-9]+"
WORD_TOKEN = r"[\p{L}\p{N}_]+"
LONG_WORD = r"[\p{L}\p{N}_]{4,}"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: a function over array elements would compute it again for each."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ascii_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case: accents and underscores split."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(ASCII_TOKEN), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores of any script, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_TOKEN), F.lit(0))


def long_words(text: Column) -> Column:
    """The set of words of four and more characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LONG_WORD), F.lit(0)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def word_count(text: Column) -> Column:
    """Words between white space, of any kind."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE}]+"), lambda x: x != "")).cast("long")


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether any term stands in the text, in a word or not."""
    return reduce(lambda a, b: a | b, [text.contains(t) for t in terms])


def bounded(terms: list[str]) -> str:
    """A Java pattern: any of the terms between word borders, whatever the case.

    A border is where a word character meets something else. Java's own border takes other characters for
    words than these rules do.
    """
    border = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
    return f"(?iu){border}(?:{'|'.join(_spaced(t) for t in terms)}){border}"


def matches(text: Column, terms: list[str]) -> Column:
    return text.rlike(bounded(terms))


def _spaced(term: str) -> str:
    return term.replace(r"\s", f"[{SPACE}]")


def template(pattern: str) -> str:
    """A pattern with {W} for a word character and {S} for white space ([^{S}] for all else)."""
    return pattern.replace("[^{S}]", f"[^{SPACE}]").replace("{S}", f"[{SPACE}]").replace("{W}", WORD)


# The same for DuckDB, whose patterns know no look-around: existence is all that is asked for.


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_matches(column: str, terms: list[str]) -> str:
    odd = [_spaced(t) for t in terms if t.endswith("[?]")]
    even = [_spaced(t) for t in terms if not t.endswith("[?]")]
    ends = [f"(?:{'|'.join(even)})(?:{NOT_WORD}|$)"] + ([f"(?:{'|'.join(odd)}){WORD}"] if odd else [])
    return f"regexp_matches({column}, {quote(f'(?i)(?:^|{NOT_WORD})(?:' + '|'.join(ends) + ')')})"


def sql_contains_any(column: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quote(t)})" for t in terms) + ")"


def sql_word_count(column: str) -> str:
    return f"CAST(len(list_filter(string_split_regex(coalesce({column}, ''), {quote(f'[{SPACE}]+')}), lambda x: x <> '')) AS BIGINT)"


def sql_strip(column: str) -> str:
    return f"regexp_replace({column}, {quote(rf'^[{SPACE}]+|[{SPACE}]+$')}, '', 'g')"
