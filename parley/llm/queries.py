"""The registered queries of this subpackage: each applies an operator to its whole table."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from parley.llm import (
    decontamination, language, licenses, packing, phrases, simhash, sketches, spelling, substrings, token_files, tokens, toxicity, urls,
)
from parley.llm.common import crc_mod
from parley.session import shared_dir

#: The vocabulary that the queries use; the operators take a path.
VOCABULARY = "byte_bpe_50k.json"
BUDGET = 1024
SEQUENCE = 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.prefix_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > BUDGET).alias("over_limit"), "n_chars", "prefixes")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), SEQUENCE)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketches.edited_likeness(_table(spark, sf_dir, "documents"))
    own, edited, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        sketches.as_text(own).alias("fingerprint"),
        sketches.as_text(edited).alias("edited_fingerprint"),
        sketches.likeness(own, edited).alias("near_edited"),
        sketches.likeness(own, after).alias("near_next"),
        sketches.containment(own, edited).alias("contained_edited"),
    )


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontamination.digest(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), F.array_join("notices", ",").alias("notices"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, crc_mod(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeated(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: (verdict, host, path)
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs, crc_mod(F.col("doc_id"), 4) != 2)
    found = language.predict(docs, model)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


#: One word in so many loses a letter, in each document anew.
DAMAGE = 97


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(_table(spark, sf_dir, "documents"), damage=DAMAGE))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = _table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write(docs, path, public_tokenizers.path(VOCABULARY))
    return token_files.find(token_files.repeats(docs), path, repeat="repeat", keep_ids=False)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


_ALL = (
    op1_token_counts,
    op2_best_fit_packing,
    op3_document_fingerprints,
    op4_simhash_near_dedup,
    op5_benchmark_decontamination,
    op6_license_scan,
    op7_toxicity,
    op8_substring_dedup,
    op9_url_filter,
    op10_language_id,
    op11_spelling_variants,
    op12_token_files,
    op13_phrase_collocations,
)
QUERIES = {f.__name__: f for f in _ALL}

_URL_SQL = """
    WITH parts AS (
        SELECT page_id, coalesce(url LIKE '%://%', false) AS ok, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    split AS (
        SELECT page_id,
            translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
    fits AS (
        SELECT *, host = 'org' OR ends_with(host, '.org') AS o, host = 'example.org' OR ends_with(host, '.example.org') AS e, host = 'com' OR ends_with(host, '.com') AS c FROM split)
    SELECT page_id, host, path,
        CASE WHEN e AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN e AND starts_with(path, '/es/') THEN 'example.org/es/' WHEN o AND starts_with(path, '/') THEN 'org/'
             WHEN c AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN c AND starts_with(path, '/de/') THEN 'com/de/' END AS rule,
        CASE WHEN e AND (starts_with(path, '/en/1') OR starts_with(path, '/es/')) THEN 'block' WHEN o AND starts_with(path, '/') THEN 'allow' WHEN c AND starts_with(path, '/de/') THEN 'block' ELSE 'allow' END AS verdict
    FROM fits
"""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
_ITEM_WORDS = rf"regexp_extract_all({_LOWER('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_CONTAMINATION_SQL = f"""
    WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(len(w), 10) AS n FROM (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS body FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
    docs AS (SELECT doc_id, coalesce({_ITEM_WORDS}, []) AS w FROM documents),
    starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM items) WHERE len(w) >= n),
    found AS (SELECT doc_id, i, s.n, item FROM starts s JOIN windows v ON s.n = v.n AND array_to_string(s.w[i:i + s.n - 1], ' ') = v.body),
    hit AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM found) GROUP BY doc_id),
    named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM found GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
_SUBSTRING_SQL = r"""
    WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^ 	-
]+'), []) AS w FROM documents),
    starts AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS body FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)),
    repeated AS (SELECT body FROM starts GROUP BY body HAVING count(*) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS spot FROM starts JOIN repeated USING (body)),
    words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS spot FROM docs),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY spot) AS text FROM words ANTI JOIN gone USING (doc_id, spot) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)
"""

# The crc32 is computed byte by byte, from a table made of its polynomial; near words share what is left without some letter.
_SPELLING_SQL = """
    WITH RECURSIVE table8 AS (SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
    runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
    counted AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS name, run, count(*) AS n FROM runs GROUP BY ALL),
    letters AS (SELECT *, list_transform(string_split(name || ':' || run, ''), lambda x: unicode(x)) AS codes FROM counted),
    bytes AS (SELECT name, run, n, flatten(list_transform(codes, lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + (u >> 6), 128 + (u & 63)] END)) AS b FROM letters),
    hashed AS (SELECT run, n, xor(list_reduce([4294967295::BIGINT] || b, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS h FROM bytes, table8),
    words AS (
        SELECT word, CAST(sum(n) AS BIGINT) AS n
        FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed)
        WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    shorter AS (SELECT DISTINCT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS left_over FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
    linked AS (
        SELECT a.word, b.word AS near FROM shorter a JOIN shorter b ON a.i = b.i AND a.left_over = b.left_over AND a.word <> b.word
        UNION SELECT word, left_over FROM shorter WHERE left_over IN (SELECT word FROM words)
        UNION SELECT left_over, word FROM shorter WHERE left_over IN (SELECT word FROM words)),
    best AS (SELECT word, count(*) AS n_near, arg_min({'near': near, 'n': n}, (-n, near)) AS top FROM (SELECT l.word, near, w.n FROM linked l JOIN words w ON w.word = l.near) GROUP BY word),
    formed AS (
        SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top.n >= 2 * w.n THEN top.near END AS form, CASE WHEN top.n >= 2 * w.n THEN top.n END AS form_n
        FROM words w LEFT JOIN best b ON b.word = w.word),
    steps AS (SELECT word, word AS root FROM formed UNION SELECT s.word, f.form FROM steps s JOIN formed f ON f.word = s.root WHERE f.form IS NOT NULL),
    ends AS (SELECT s.word, s.root FROM steps s JOIN formed f ON f.word = s.root WHERE f.form IS NULL)
    SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN ends e ON e.word = f.word
"""

_PHRASE_SQL = r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang,
            unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
    phrases AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM worded, range(1, 5) s(m) WHERE len(w) >= m)),
    counts AS (SELECT lang, m, phrase, count(*) AS f FROM phrases GROUP BY ALL HAVING count(*) >= 30),
    candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1),
    cuts AS (SELECT *, unnest(range(1, m)) AS k FROM candidates),
    scored AS (
        SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, CAST(c.a::HUGEINT * 2000000 // (x.f::HUGEINT + y.f) AS BIGINT) AS score
        FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ') JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:c.m], ' ')),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inner_ AS (SELECT lang, a, array_to_string(w[i:i + s - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM candidates, range(2, 4) q(s) WHERE s < m)),
    longer AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY ALL),
    kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.most IS NULL OR o.most::HUGEINT * 100 < b.a::HUGEINT * 80),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT r.lang, rank, phrase, a, l, r.r, n, score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""

#: DuckDB SQL where it can express the query.
SQL: dict[str, str] = {
    "op5_benchmark_decontamination": _CONTAMINATION_SQL,
    "op6_license_scan": licenses.oracle_sql(),
    "op8_substring_dedup": _SUBSTRING_SQL,
    "op9_url_filter": _URL_SQL,
    "op11_spelling_variants": _SPELLING_SQL,
    "op13_phrase_collocations": _PHRASE_SQL,
}
