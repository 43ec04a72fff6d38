"""Operator 10, language identification by hierarchical discrimination.

The family of languages comes first (a linear support vector machine for each family against the others), then
the language: one machine for each pair of languages of that family, the most wins decide, and the sum of
margins where wins are equal. Features are the relative frequencies of byte trigrams of the text, in lower case for A-Z and
with all ASCII that isn't a letter taken as a space, hashed to 2 ** BITS places. Machines are fitted on the
driver on at most `sample` rows of each language and about `total` rows in all, chosen by a hash of their key
(documented bounds: with n languages each has at most max(20, total / n) rows); every whole text is judged. Every value of
lang is learned; more than `languages` different ones are an error, so that none is left out unseen.

Languages that FAMILIES doesn't name form a family of their own ("other"). A family of more than LARGEST languages becomes
several, by likeness: the languages with the most similar trigrams are put together first, so those that are easily mixed up have a machine
for their pair. The number of pair machines grows with the languages, not with their square; the model that
is broadcast has at most languages * (LARGEST + 1) / 2 machines of 2 ** BITS weights (100 MB at the default). Rows that repeat
a key, a text and a language are learned from once. Of equal votes and margins the first language in order wins. Defined cases: text that is null or
has no letter is `und` with score 0; so is all if nothing was learned. A single family or language needs no machine and
has score 1. Repeated rows get equal results; an empty table an empty one; other columns, whatever their names, are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import chunks, share_code
from parley.llm.words import buffer_of

BITS = 12
SAMPLE, TOTAL = 1500, 12_000
LANGUAGES, LARGEST = 500, 24
#: No larger model is broadcast: so many machines are what `languages` at its default can come to.
MACHINES = LANGUAGES * (LARGEST + 1) // 2 + LANGUAGES
_PARTS = 10**9
UNKNOWN = "und"
#: ISO 639-1 codes by family.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nb nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "hellenic": "el",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "semitic": "am ar he mt",
    "indo-iranian": "bn fa gu hi ku mr ne pa ps si ur",
    "dravidian": "kn ml ta te",
    "sinitic": "yue zh",
    "japonic": "ja",
    "koreanic": "ko",
    "austronesian": "id jv mg ms su tl",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTERS = np.array([b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256)], np.uint8)


def family_of(language: str) -> str:
    return _FAMILY.get(language.lower().replace("_", "-").split("-")[0], "other")


@dataclass
class Machine:
    weight: np.ndarray
    bias: float


@dataclass
class Model:
    families: dict[str, list[str]]
    family: dict[str, Machine] = field(default_factory=dict)
    pair: dict[tuple[str, str], Machine] = field(default_factory=dict)


def places(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The place of each trigram of a chunk and the n + 1 bounds of its rows in it; a row stands between spaces, so that no trigram has letters of two rows."""
    data, offsets = buffer_of(column)
    n = len(offsets) - 1
    wide = np.full(len(data) + 3 * n + 2, 32, np.uint8)
    shift = np.repeat(3 * np.arange(n) + 2, np.diff(offsets))
    wide[np.arange(len(data)) + shift] = _LETTERS[data]
    wide = wide.astype(np.uint32)
    grams = (wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16) * np.uint32(2654435761)
    return (grams >> np.uint32(32 - BITS)).astype(np.uint16), offsets + 3 * np.arange(n + 1)


def has_letter(column: pa.Array) -> np.ndarray:
    data, offsets = buffer_of(column)
    low = data | 32
    ascii_letters = np.concatenate([[0], np.cumsum((low >= 0x61) & (low <= 0x7A))])
    found = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
    for i in np.flatnonzero(~found).tolist():
        found[i] = any(map(str.isalpha, column[i].as_py() or ""))
    return found


def lettered(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text has a letter."""
    share_code(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            yield batch.filter(pa.array(has_letter(batch.column(at))))

    return docs.mapInArrow(run, docs.schema)


def _machine(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 150) -> Machine:
    """A linear support vector machine with squared hinge loss, by Nesterov's accelerated gradient; y: 1 or -1."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)  # both sides weigh the same
    w, b, v, d = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    length = np.einsum("ij,ij->i", x, x) + 1
    step = 1 / (1e-3 + 2 * c * min(float(length.max()), float((share * length).mean())))
    for t in range(rounds):
        short = np.maximum(0, 1 - y * (x @ v + d))
        pull = (2 * c * share * y * short / len(y)).astype(np.float32)
        w2, b2 = v + step * (x.T @ pull - 1e-3 * v), d + step * float(pull.sum())
        m = t / (t + 3)
        v, d = w2 + m * (w2 - w), b2 + m * (b2 - b)
        w, b = w2, b2
    return Machine(w, b)


def alike(profiles: np.ndarray, largest: int) -> list[list[int]]:
    """Groups of at most largest rows: again and again the two groups with the most similar members (on average) that fit into one are joined."""
    roots = np.sqrt(profiles)
    like = roots @ roots.T / np.maximum(1e-12, np.outer(*[np.linalg.norm(roots, axis=1)] * 2))
    groups: list[list[int]] = [[i] for i in range(len(profiles))]
    near = like.copy()
    np.fill_diagonal(near, -np.inf)
    while True:
        size = np.array([len(g) for g in groups])
        open_ = np.where(size[:, None] + size[None, :] <= largest, near, -np.inf)
        i, j = sorted(np.unravel_index(int(open_.argmax()), open_.shape)) if len(groups) > 1 else (0, 0)
        if i == j or open_[i, j] == -np.inf:
            return [sorted(g) for g in groups]
        row = (near[i] * size[i] + near[j] * size[j]) / (size[i] + size[j])
        groups[i] += groups.pop(j)
        near[i], near[:, i] = row, row
        near = np.delete(np.delete(near, j, 0), j, 1)
        np.fill_diagonal(near, -np.inf)


def families_of(profiles: dict[str, np.ndarray], largest: int = LARGEST) -> dict[str, list[str]]:
    """The languages by family, in order; a family of more than largest becomes numbered ones of languages with similar profiles."""
    whole: dict[str, list[str]] = {}
    for code in sorted(profiles):
        whole.setdefault(family_of(code), []).append(code)
    out: dict[str, list[str]] = {}
    for family, codes in whole.items():
        if len(codes) <= largest:
            out[family] = codes
            continue
        for i, group in enumerate(sorted(alike(np.stack([profiles[c] for c in codes]), largest))):
            out[f"{family}-{i + 1}"] = [codes[j] for j in group]
    return out


def fit(x: np.ndarray, languages: list[str], largest: int = LARGEST) -> Model:
    """x: a row of relative frequencies for each text; it is scaled in place."""
    named = np.array(languages)
    families = families_of({code: x[named == code].mean(axis=0, dtype=np.float64) for code in sorted(set(languages))}, largest)
    spread = np.concatenate([x[:, at : at + 256].std(axis=0) for at in range(0, x.shape[1], 256)])
    scale = (1 / (spread + 1e-4)).astype(np.float32) / np.float32(np.sqrt(x.shape[1]))
    x *= scale
    model = Model(families)
    family = {code: name for name, codes in families.items() for code in codes}
    own = np.array([family[code] for code in languages])

    def machine(rows: np.ndarray | None, yes: np.ndarray) -> Machine:
        made = _machine(x if rows is None else x[rows], np.where(yes if rows is None else yes[rows], 1, -1).astype(np.float32))
        return Machine((made.weight * scale).astype(np.float32), made.bias)

    if len(families) > 1:
        for name in families:
            model.family[name] = machine(None, own == name)
    for codes in families.values():
        for a, b in combinations(codes, 2):
            model.pair[a, b] = machine(np.flatnonzero((named == a) | (named == b)), named == a)
    return model


def train(
    docs: DataFrame, usable: Column | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE,
    total: int = TOTAL, languages: int = LANGUAGES,
) -> Model | None:
    """A model from at most sample rows of each language, about total in all; usable: a condition over the columns of docs."""
    share_code(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    rows = rows.select(F.col(lang).alias("_l"), F.xxhash64(F.col(key), F.col(text)).alias("_h"), F.col(text).alias("_text"))
    counts = rows.groupBy("_l").agg(F.approx_count_distinct("_h").alias("n")).orderBy("_l").limit(languages + 1).collect()
    if not counts:
        return None
    if len(counts) > languages:
        raise ValueError(f"more than {languages} languages: raise `languages`, or merge rare values of {lang}")
    sample = min(sample, max(20, total // len(counts)))
    # A hash takes about twice the sample of each language before any row is sorted, however large the table.
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["_l"], min(_PARTS, 2 * sample * _PARTS // max(1, r["n"]) + 1))))
    thin = rows.select(F.col("_l").alias("_lang"), F.col("_h").alias("_k")).where(
        F.pmod(F.xxhash64("_k"), F.lit(_PARTS)) < F.try_element_at(share, F.col("_lang"))
    ).distinct()
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64(F.xxhash64("_k")), "_k"))
    chosen = thin.withColumn("_n", rank).where(F.col("_n") <= sample).drop("_n")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            at, bounds = places(batch.column(1))
            made = [np.bincount(at[a:b], minlength=1 << BITS).astype("<u4") for a, b in zip(bounds, bounds[1:])]
            live = [np.flatnonzero(x).astype("<u2") for x in made]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array([x.tobytes() for x in live], pa.binary()),
                    pa.array([x[i].tobytes() for x, i in zip(made, live)], pa.binary()),
                ],
                names=["k", "lang", "place", "count"],
            )

    # At most sample rows of a hash and a code for each of at most `languages` languages: small enough to broadcast.
    joined = rows.join(F.broadcast(chosen), (F.col("_h") == F.col("_k")) & (F.col("_l") == F.col("_lang"))).dropDuplicates(["_h", "_l"])
    made = joined.select(
        F.col("_h").alias("k"), "_text", F.col("_l").alias("_lang"),
    ).mapInArrow(counted, "k long, lang string, place binary, count binary").toArrow().to_pylist()
    if not made:
        return None
    made.sort(key=lambda r: (r["k"], r["lang"], r["place"], r["count"]))
    x = np.zeros((len(made), 1 << BITS), np.float32)
    for i, r in enumerate(made):
        n = np.frombuffer(r["count"], "<u4")
        x[i, np.frombuffer(r["place"], "<u2")] = n / max(1, n.sum())
    return fit(x, [r["lang"] for r in made])


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the kept columns, lang_pred string, score double (0 to 1)."""
    share_code(docs.sparkSession)
    schema = T.StructType(
        [docs.schema[key], *(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    if model is not None and len(model.family) + len(model.pair) > MACHINES:
        raise ValueError("the model is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(F.col(key), *(F.col(c) for c in keep), *([] if text in keep else [F.col(text).alias("_text")]))  # the text goes once
    names_in, column = chosen.columns, text if text in keep else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in chunks(batches, column):
            body = batch.column(names_in.index(column))
            letters = has_letter(body)
            names, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            if model is not None and letters.any():
                at, bounds = places(body)
                size = np.maximum(1, np.diff(bounds))

                def margin(machine: Machine) -> np.ndarray:
                    return np.add.reduceat(machine.weight[at], bounds[:-1], dtype=np.float64) / size + machine.bias

                families = list(model.families)
                best, sure = np.zeros(batch.num_rows, np.int64), np.ones(batch.num_rows)
                if len(families) > 1:
                    margins = np.stack([margin(model.family[f]) for f in families])
                    best = margins.argmax(axis=0)
                    sure = _sure(margins.max(axis=0))
                for f, family in enumerate(families):
                    codes = model.families[family]
                    wins, total, least = (np.zeros((len(codes), batch.num_rows)) for _ in range(3))
                    least += np.inf
                    for i, j in combinations(range(len(codes)), 2):
                        m = margin(model.pair[codes[i], codes[j]])
                        for k, side in ((i, m), (j, -m)):
                            wins[k] += side > 0
                            total[k] += side
                            least[k] = np.minimum(least[k], side)
                    order = wins + 0.5 * (1 + np.tanh(total / 10))  # the sum of margins only where wins are equal
                    chosen = order.argmax(axis=0)
                    mine = letters & (best == f)
                    names[mine] = np.array(codes, object)[chosen[mine]]
                    score[mine] = (sure * np.where(np.isinf(least[0]), 1, _sure(least[chosen, np.arange(batch.num_rows)])))[mine]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep) + 1], pa.array(names.tolist(), pa.string()), pa.array(score)], names=schema.fieldNames(),
            )

    return chosen.mapInArrow(run, schema)


def _sure(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-2 * np.clip(margin, -15, 15)))
