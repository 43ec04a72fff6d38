"""Operator 3, document fingerprints by threshold-scaled sketches, with DataFrame functions only.

A sketch keeps every hash of a shingle of `shingle` words that lies in the lowest 1/scaled of the hash range, so it grows with its
document; sketches of parts merge by union, and containment can be estimated between documents of very
different lengths. Where no hash is that low, the least one (of the signed numbers) stands in: no text with words has an
empty sketch. merge() drops a stand-in where the other part has a hash that is low enough, so that a merged sketch is always
that of all shingles of both.

Shingles are of words as they are, [^\\x20\\x09-\\x0D]+; a text of fewer words is one shingle. Defined cases: a
null text is an empty one; texts without words have an empty sketch, and two empty sketches are alike (1.0);
repeated rows have equal sketches; other columns, whatever their names, are ignored; an empty table gives an empty result. Very long
texts are sketched whole.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE, SCALED = 5, 4
#: At most this many ranges of keys; their bounds are told to every task.
MOST_RANGES = 1 << 16
RANGE_ROWS = 1000
_BLANK = r"[\x20\x09-\x0D]+"


def sketch(text: Column, shingle: int = SHINGLE, scaled: int = SCALED) -> Column:
    """The sorted distinct hashes (array of long) of a text that is not null."""
    words = F.filter(F.split(text, _BLANK), lambda w: w != "")

    def of(w: Column) -> Column:
        n = F.size(w)
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n <= shingle, F.array(F.xxhash64(w))).otherwise(
            F.transform(F.sequence(F.lit(1), n - shingle + 1), lambda i: F.xxhash64(F.slice(w, i, shingle)))
        )

    return _let(_let(words, of), lambda h: _retained(h, scaled))


def _retained(hashes: Column, scaled: int) -> Column:
    """Of hashes those in the lowest 1/scaled of the range, or else the least; sorted and distinct."""
    # Hashes that are negative as signed numbers are the upper half of the range.
    low = F.filter(hashes, lambda x: (x >= 0) & (x < F.lit((1 << 64) // scaled)))
    return _let(
        low,
        lambda x: F.when(F.size(x) > 0, F.array_sort(F.array_distinct(x))).when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(hashes),
    )


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def merge(a: Column, b: Column, scaled: int = SCALED) -> Column:
    """The sketch of two texts' shingles together."""
    return _let(F.concat(a, b), lambda h: _retained(h, scaled))


def likeness(a: Column, b: Column) -> Column:
    """The share of the hashes of both that are in either's (an estimate of the Jaccard index)."""
    common = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - common
    return F.when(either == 0, F.lit(1.0)).otherwise(common / F.greatest(either, F.lit(1)))


def containment(a: Column, b: Column) -> Column:
    """The share of a's hashes that b has."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def as_text(hashes: Column) -> Column:
    """16 hexadecimal digits for each hash, in ascending order."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, scaled: int = SCALED) -> DataFrame:
    """key, sketch array of long."""
    return docs.select(F.col(key), sketch(F.coalesce(F.col(text), F.lit("")), shingle, scaled).alias("sketch"))


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id", order: tuple[str, ...] = (), made: dict[str, Column] | None = None) -> DataFrame:
    """docs with next_<column> of the row that follows in ascending order of a numeric key; after the last, the first.

    made: further columns, which are computed after the shuffle, so that they don't take part in it.

    The rows are dealt to ranges of keys of about RANGE_ROWS rows each, and the first row of each range is also
    dealt to the range before, so that no order over all rows is needed. Ties stand by the columns in order.
    Null keys come first. The ranges' bounds and first keys are on the driver, MOST_RANGES at most.
    """
    spark = docs.sparkSession
    keys = docs.select(F.col(key).cast("long").alias("k"))
    rows = keys.count()
    ranges = int(min(MOST_RANGES, max(1, rows // RANGE_ROWS)))
    bounds: list[int] = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        found = keys.agg(F.percentile_approx("k", shares, max(10_000, 20 * ranges)).alias("q")).first()["q"]
        bounds = sorted(set(found or []))
    number = _range_of(F.col("k"), bounds)
    firsts = keys.select(number.alias("r"), F.coalesce("k", F.lit(-(1 << 63))).alias("k")).groupBy("r").agg(F.min("k").alias("k")).collect()
    firsts = sorted((r["r"], r["k"]) for r in firsts)
    before = [(firsts[i - 1][0], k) for i, (_, k) in enumerate(firsts)]  # the range before the first is the last

    keyed = docs.withColumn("_k", F.col(key).cast("long"))
    own = keyed.withColumn("_r", _range_of(F.col("_k"), bounds)).withColumn("_end", F.lit(0))
    small = F.broadcast(spark.createDataFrame(before, "_r int, _f long"))
    ends = keyed.join(small, F.coalesce("_k", F.lit(-(1 << 63))) == F.col("_f")).drop("_f").withColumn("_end", F.lit(1))
    window = Window.partitionBy("_r").orderBy("_end", F.col("_k").asc_nulls_first(), *order)
    dealt = own.unionByName(ends).repartition("_r").withColumns(made or {})
    led = dealt.withColumn("_next", F.lead(F.struct(*columns)).over(window))
    return led.where("_end = 0").select(*docs.columns, *(made or {}), *(F.col(f"_next.{c}").alias(f"next_{c}") for c in columns))


def _range_of(key: Column, bounds: list[int], width: int = 256) -> Column:
    """How many bounds are at most key, found in two steps; null counts as less than all."""
    if not bounds:
        return F.lit(0)
    every, some = F.lit(bounds), F.lit(bounds[::width])
    block = F.size(F.filter(some, lambda b: b <= key))  # the bound at (block - 1) * width is at most key
    inner = F.when(block > 0, (block - 1) * width + F.size(F.filter(F.slice(every, F.greatest(block - 1, F.lit(0)) * width + 1, width), lambda b: b <= key)))
    return F.coalesce(inner, F.lit(0)).cast("int")


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, scaled: int = SCALED) -> DataFrame:
    """Each document against an edited copy, whose second half gives way to the beginning of the next document.

    key, n_chars long, edited string, sketch, edited_sketch, next_sketch arrays of long. The last floor(n_chars /
    2) code points give way to as many of the next document, or all it has.
    """
    plain = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    led = with_next(plain.withColumn("_hash", F.xxhash64("_text")), ["_text", "sketch"], key, ("_hash",), {"sketch": sketch(F.col("_text"), shingle, scaled)})
    n = F.length("_text").cast("long")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next__text", F.lit(1), half))
    out = led.withColumn("n_chars", n).withColumn("edited", edited)
    return out.select(key, "n_chars", "edited", "sketch", sketch(F.col("edited"), shingle, scaled).alias("edited_sketch"), "next_sketch")
