"""Operator 9, URL filters by a trie over reversed host labels and path segments.

A rule (verdict, host, path) fits its host and all subdomains, for paths that begin with its path. The trie has
the labels of the host from the last to the first, then the segments of the path; the last segment of a rule may
be the beginning of a segment. Of the rules that fit, the one with more host labels wins, then the one with the
longer path; of an allow and a block entry for the same place, the block. Without a rule, the default holds.

The trie is broadcast. Its size is checked: beyond `most_rules` entries, rules are joined instead, on host suffix and
beginning of the path, so nothing large is sent.

Host: after the first :// up to /, ? or #, A-Z in lower case; path: from there up to ? or #. Defined cases: null
urls and those without :// have an empty host and path, and no rule fits an empty host; an empty table gives an
empty result; repeated rows get equal results; other columns of the pages, whatever their names, are ignored; a null
page id is carried along; a url is judged whole, however long.
"""

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import ascii_lower, share_code

MOST_RULES, SALT = 200_000, 16
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or #, A-Z in lower case."""
    found = ascii_lower(F.regexp_extract(_after(url), "(?s)^[^/?#]*", 0))
    return F.when(F.instr(url, "://") > 0, found).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to ? or #."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(_after(url), "(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def _after(url: Column) -> Column:
    return F.substr(url, F.instr(url, "://") + 3)


class Trie:
    """Nodes are (children by label or segment, path root or None, {ending of a path: rule})."""

    def __init__(self, rules: Iterable[Rule]):
        self.root = self._node()
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node["next"].setdefault(label, self._node())
            node = node.setdefault("paths", self._node())
            *whole, last = path.split("/")
            for segment in whole:
                node = node["next"].setdefault(segment, self._node())
            if node["ends"].get(last, ("",))[0] != "block":
                node["ends"][last] = (verdict, host + path)

    @staticmethod
    def _node() -> dict:
        return {"next": {}, "ends": {}}

    @staticmethod
    def _longest(node: dict, path: str) -> tuple[str, str] | None:
        best, segments = None, path.split("/")
        for i, segment in enumerate(segments):
            ends = node["ends"]
            for n in range(len(segment) + 1) if len(segment) < len(ends) else ():
                best = ends.get(segment[:n], best)
            if len(segment) >= len(ends):
                fit = [x for x in ends if segment.startswith(x)]
                best = ends[max(fit, key=len)] if fit else best
            node = node["next"].get(segment)
            if node is None or i + 1 == len(segments):
                return best
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the entry that wins."""
        if not host:
            return None
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node["next"].get(label)
            if node is None:
                return best
            if "paths" in node:
                best = self._longest(node["paths"], path) or best
        return best


def judge(
    pages: DataFrame, rules: DataFrame | list[Rule], default: str = "allow", key: str = "page_id", url: str = "url",
    most_rules: int = MOST_RULES,
) -> DataFrame:
    """key, host, path, rule string (host and path, or null), verdict string. rules: (verdict, host, path)."""
    spark = pages.sparkSession
    share_code(spark)
    whole = pages.select(F.col(key), F.col(url).alias("_u")).select(F.col(key), host_of(F.col("_u")).alias("host"), path_of(F.col("_u")).alias("path"))
    if isinstance(rules, list):
        if len(rules) > most_rules:
            return _joined(whole, spark.createDataFrame(rules, "verdict string, host string, path string"), default, key)
        small = rules
    else:
        few = rules.select("verdict", "host", "path").limit(most_rules + 1).collect()
        if len(few) > most_rules:
            return _joined(whole, rules, default, key)
        small = [tuple(r) for r in few]
    trie = spark.sparkContext.broadcast(Trie(small))
    schema = T.StructType([pages.schema[key], *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for batch in batches:
            found = list(map(find, batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            rule = pa.array([x[1] if x else None for x in found], pa.string())
            verdict = pa.array([x[0] if x else default for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=schema.fieldNames())

    return whole.mapInArrow(run, schema)


def _joined(pages: DataFrame, rules: DataFrame, default: str, key: str) -> DataFrame:
    """The same for rules too many to broadcast: an equi-join of distinct hosts and paths with the rules.

    A page meets only rules that fit it: it is looked up by each suffix of its host with each beginning of its path that
    is as long as some rule's path (lengths are small numbers, no more than the longest path). Rules are one for each
    place, and each is copied SALT times, so that a rule that a third of all pages fit is SALT keys.
    """
    named = rules.groupBy(F.col("host").alias("_rh"), F.col("path").alias("_rp")).agg(F.max("verdict").alias("_v"))  # block comes after allow
    sizes = sorted(r[0] for r in named.select(F.length("_rp")).distinct().collect())
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    begins = F.transform(F.filter(F.lit(sizes), lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n))
    salt = F.pmod(F.xxhash64("host", "path"), F.lit(SALT)).cast("int")
    places = pages.where("host <> ''").select("host", "path").distinct().select(
        "host", "path", salt.alias("_s"), F.explode(suffixes).alias("_suffix"), begins.alias("_b"),
    )
    places = places.select("host", "path", "_s", "_suffix", F.explode("_b").alias("_begin"))
    copies = named.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    fits = places.join(copies, (F.col("_suffix") == F.col("_rh")) & (F.col("_begin") == F.col("_rp")) & (F.col("_s") == F.col("_c")))
    best = F.max_by(F.struct(F.concat("_rh", "_rp").alias("rule"), F.col("_v").alias("verdict")), F.struct(F.length("_rh"), F.length("_rp")))
    won = fits.groupBy(F.col("host").alias("_h"), F.col("path").alias("_p")).agg(best.alias("_best"))
    out = pages.join(won, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return out.select(key, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
