"""One thin query for each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, forest, kneser, licenses, lmscore, ngramjoin, packing, phrases, secrets, simhash, toxicity, urlrules, vafile, whitening

URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` has no paths: a layout of three levels under each source gives them, with every eighth text as a licence file."""
    doc = F.col("doc_id")
    root, folder = F.coalesce("source", F.lit("none")), F.concat(F.lit("b"), F.expr("doc_id div 64").cast("string"))
    path = (
        F.when(doc % 16 == 0, F.concat_ws("/", root, F.concat(F.lit("LICENSE-"), doc)))
        .when(doc % 16 == 8, F.concat_ws("/", root, folder, F.concat(F.lit("LICENSE-"), doc)))
        .otherwise(F.concat_ws("/", root, folder, F.coalesce("lang", F.lit("none")), F.concat(doc, F.lit(".txt"))))
    )
    files = _read(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select(path.alias("path"), "text")
    found = licenses.scan(files)
    return found.select(F.regexp_extract("path", "([0-9]+)([.]txt)?$", 1).cast("long").alias("doc_id"), *found.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.decontaminate(docs, _read(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return urlrules.judge(pages, urlrules.rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lmscore.lm_scores(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "tokens", "log_likelihood", "mean_log_likelihood")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vafile.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("path"))
    return secrets.scan(docs).select("doc_id", "start", "finish", "candidate", *secrets.FEATURES, F.round("score", 6).alias("score"), "secret")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = toxicity.learn(docs, _read(spark, sf_dir, "labels").filter(~held))
    found = toxicity.classify(docs, model)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.col("evidence.doc_id").alias("evidence"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kneser.classify(_read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), _read(spark, sf_dir, "labels"))
    return found.select("doc_id", "lang", "perplexity", "threshold", "keep")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents").select("lang", "text"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_join(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scans": op1_license_scans,
        "op2_decontamination": op2_decontamination,
        "op3_url_filters": op3_url_filters,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_exact_top_k": op5_exact_top_k,
        "op6_simhash_dedup": op6_simhash_dedup,
        "op7_secret_scans": op7_secret_scans,
        "op8_toxicity": op8_toxicity,
        "op9_quality": op9_quality,
        "op10_packing": op10_packing,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_phrase_collocations": op12_phrase_collocations,
        "op13_ngram_jaccard_join": op13_ngram_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scans": _op1_sql(), "op7_secret_scans": _op7_sql(), "op3_url_filters": OP3_SQL, "op5_exact_top_k": OP5_SQL, "op2_decontamination": OP2_SQL, "op12_phrase_collocations": OP12_SQL, "op13_ngram_jaccard_join": OP13_SQL}


def _op1_sql() -> str:
    rows, idf, unseen = licenses.template_weights(licenses.TEMPLATES)
    quoted = ", ".join(f"('{a}', {i}, '{w}', CAST({x!r} AS DOUBLE))" for a, i, w, x in rows)
    known = ", ".join(f"('{w}', CAST({x!r} AS DOUBLE))" for w, x in idf.items())
    texts = lambda values: "CAST([" + ", ".join(f"'{v}'" for v in values) + "] AS VARCHAR[])"
    marks = ", ".join(f"({i}, {texts(need)}, {texts(own)}, {name == licenses.GENERIC})" for i, (name, text) in enumerate(licenses.TEMPLATES) for need, own in [licenses.decisive(text)])
    case = lambda table: "CASE word " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"
    within = " OR ".join(f"license = '{small}' AND regexp_matches(names, '(^| )({larger})( |$)')" for small, larger in licenses.LARGER.items())
    return rf"""
WITH weights(license, template, word, weight) AS (VALUES {quoted}),
idf(word, idf) AS (VALUES {known}),
marks(template, need, own, generic) AS (VALUES {marks}),
files AS (
  SELECT doc_id, text, CASE
      WHEN doc_id % 16 = 0 THEN coalesce(source, 'none') || '/LICENSE-' || doc_id
      WHEN doc_id % 16 = 8 THEN coalesce(source, 'none') || '/b' || (doc_id // 64) || '/LICENSE-' || doc_id
      ELSE coalesce(source, 'none') || '/b' || (doc_id // 64) || '/' || coalesce(lang, 'none') || '/' || doc_id || '.txt' END AS path
  FROM documents WHERE doc_id IS NOT NULL),
bare AS (SELECT path, text, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '{licenses.MARKS}', '\1', 'g') AS plain FROM files WHERE regexp_matches(text, '{licenses.CUE}')),
passages AS (
  SELECT path, text AS passage FROM bare
  UNION ALL SELECT path, regexp_replace(paragraph, '[ \t\n]+', ' ', 'g') FROM (SELECT path, unnest(string_split_regex(plain, '\n\n+')) AS paragraph FROM bare)),
sentences AS (
  SELECT path, notice
  FROM (SELECT path, unnest(string_split(regexp_replace(passage, '([.!?])[ \t\r\n]+', '\1' || chr(10), 'g'), chr(10))) AS notice FROM passages)
  WHERE regexp_matches(notice, '{licenses.CUE}')),
said AS (
  SELECT DISTINCT path, unnest(string_split(CASE WHEN contains(notice, 'SPDX') THEN regexp_replace(notice, '{licenses.OPERATORS}', chr(10) || 'SPDX-License-Identifier: ', 'g') ELSE notice END, chr(10))) AS notice
  FROM sentences WHERE NOT regexp_matches(notice, '{licenses.NEGATED}')),
counted AS (
  SELECT path, notice, word, count(*) AS n
  FROM (SELECT path, notice, unnest(regexp_extract_all(lower(notice), '{licenses._WORD}')) AS word FROM said) GROUP BY ALL),
weighed AS (SELECT path, notice, word, n * coalesce(idf, CAST({unseen!r} AS DOUBLE)) AS w FROM counted LEFT JOIN idf USING (word)),
told AS (
  SELECT path, notice, sqrt(sum(w * w)) AS norm, list_distinct(list(regexp_replace(regexp_replace(word, '^v', ''), '[.]0$', '')) FILTER (WHERE regexp_matches(word, '{licenses.VERSION}'))) AS versions,
    list({case(licenses.MODIFIERS)}) AS always, list({case(licenses.BESIDE)}) AS beside, bool_or(word IN ({", ".join(f"'{w}'" for w in licenses.COMPANY)})) AS company
  FROM weighed GROUP BY path, notice),
norms AS (
  SELECT path, notice, norm, coalesce(versions, []) AS versions,
    list_sort(list_distinct(list_filter(list_concat(always, CASE WHEN company THEN beside ELSE [] END), lambda x: x IS NOT NULL))) AS modifiers FROM told),
dots AS (SELECT path, notice, license, template, sum(w * weight) AS dot FROM weighed JOIN weights USING (word) GROUP BY ALL),
scored AS (SELECT path, notice, license, round(dot / norm, 6) AS score
  FROM dots JOIN norms USING (path, notice) JOIN marks USING (template)
  WHERE round(dot / norm, 6) >= {licenses.THRESHOLD} AND list_has_all(versions, need) AND own = modifiers AND NOT (generic AND len(versions) > 0)),
best AS (SELECT * FROM scored QUALIFY score = max(score) OVER (PARTITION BY path, notice)),
named AS (SELECT *, (SELECT string_agg(DISTINCT b.license, ' ') FROM best b WHERE b.path = g.path) AS names FROM (SELECT path, license, max(score) AS score FROM best GROUP BY path, license) g),
every AS (SELECT path, license, score FROM named WHERE NOT ({within})),
own AS (SELECT path, arg_min(license, ROW(-score, license)) AS license, max(score) AS score, string_agg(license, ',' ORDER BY license) AS licenses FROM every GROUP BY path),
held AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS folder, license, score, path FROM every WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '{licenses.LICENCE_FILE}')),
grants AS (SELECT folder, arg_min(license, ROW(-score, license, path)) AS license, max(score) AS score, arg_min(path, ROW(-score, license, path)) AS source, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM held GROUP BY folder),
inherited AS (
  SELECT f.path, g.license, g.score, g.licenses, g.source FROM files f JOIN grants g ON g.folder = '' OR starts_with(f.path, g.folder || '/')
  WHERE f.path NOT IN (SELECT path FROM own)
  QUALIFY row_number() OVER (PARTITION BY f.path ORDER BY length(g.folder) DESC) = 1)
SELECT f.doc_id, f.path, coalesce(o.license, i.license) AS license, coalesce(o.score, i.score) AS score, coalesce(o.licenses, i.licenses) AS licenses,
  CASE WHEN o.license IS NOT NULL THEN 'own' WHEN i.license IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN o.license IS NOT NULL THEN f.path ELSE i.source END AS source
FROM (SELECT DISTINCT doc_id, path FROM files) f LEFT JOIN own o USING (path) LEFT JOIN inherited i USING (path)
"""


def _op7_sql() -> str:
    bare = "lower_ascii"
    for word in secrets.DICTIONARY:
        bare = f"replace({bare}, '{word}', '')"
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    among = lambda x, words: f"CAST(regexp_matches({x}, '{secrets.whole(words)}') AS DOUBLE)"
    pattern, value, issued, password = secrets.PATTERN.replace("'", "''"), secrets.VALUE.replace("'", "''"), secrets.ISSUED, secrets.PASSWORD
    return rf"""
WITH RECURSIVE found AS (SELECT row_number() OVER () AS row, doc_id, text, coalesce(source, '') AS path, regexp_extract_all(text, '{pattern}') AS m FROM documents WHERE text IS NOT NULL),
walk AS (
  SELECT row, doc_id, text, path, m, 0 AS i, CAST(0 AS BIGINT) AS s, CAST(1 AS BIGINT) AS pos FROM found WHERE len(m) > 0
  UNION ALL
  SELECT row, doc_id, text, path, m, i + 1, pos - 1 + strpos(substr(text, pos), m[i + 1]), pos - 1 + strpos(substr(text, pos), m[i + 1]) + length(m[i + 1]) FROM walk WHERE i < len(m)),
cut AS (
  SELECT doc_id, path, m[i] AS match, s, regexp_matches(m[i], '{issued}') AS known,
    {low("substr(text, greatest(s - 48, 1), least(48, s - 1)) || ' ' || substr(text, s + length(m[i]), 48)")} AS around
  FROM walk WHERE i > 0),
told AS (
  SELECT *, CAST(regexp_matches(match, '{password}') AS INTEGER) AS tail,
    CASE WHEN regexp_matches(match, '{password}') THEN regexp_extract(match, '{password}', 1) WHEN known THEN match
      ELSE regexp_extract(match, '{value}', 1) || regexp_extract(match, '{value}', 2) || regexp_extract(match, '{value}', 3) END AS candidate
  FROM cut),
plain AS (
  SELECT *, {low("candidate")} AS lower_ascii,
    regexp_replace(candidate, '[^0-9a-zA-Z]', '', 'g') AS bare_text,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(candidate, '[^0-9a-zA-Z]', '', 'g'), '[0-9]+', '0', 'g'), '[a-z]+', 'a', 'g'), '[A-Z]+', 'A', 'g') AS runs
  FROM told),
features AS (
  SELECT doc_id, s - 1 + length(match) - length(candidate) - tail AS start, s - 1 + length(match) - tail AS finish, candidate, CAST(length(candidate) AS DOUBLE) AS length,
    greatest(0, length(runs) - 1) / greatest(1, length(bare_text) - 1) AS transitions, 1 - length({bare}) / greatest(1, length(candidate)) AS coverage,
    {among(low("path"), secrets.PATHS)} AS doubtful_path, {among("around", secrets.DOUBTFUL)} AS doubtful_words, CAST(known AS DOUBLE) AS issued
  FROM plain),
scored AS (SELECT *, {forest.sql(list(secrets.default_forest()))} AS vote FROM features)
SELECT * EXCLUDE (vote), round(vote, 6) AS score, vote >= {secrets.THRESHOLD} AS secret FROM scored
"""


OP2_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP3_SQL = r"""
WITH rules(rule, action) AS (VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'allow'), ('example.net/de/8', 'block'), ('org/es/', 'block')),
r AS (SELECT rule, action, split_part(rule, '/', 1) AS rhost, substr(rule, strpos(rule, '/')) AS rpath FROM rules),
p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id)
"""

OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 100 = 0),
s AS (
  SELECT q.vec_id AS query_id, q.e AS own, c.vec_id, CASE WHEN len(q.e) = 0 THEN 0 ELSE CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) END AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

OP12_SQL = r"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, (VALUES (1), (2), (3), (4), (5)) AS lengths(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
candidates AS (
  SELECT * FROM f AS c WHERE k > 1 AND NOT EXISTS (
    SELECT 1 FROM f AS x WHERE x.lang = c.lang AND x.k > c.k AND 100 * x.a >= 100 * c.a AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT *, unnest(range(1, k)) AS j, string_split(phrase, ' ') AS w FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.j, x.a AS l, y.a AS r, n, CAST(CAST(1000 AS HUGEINT) * c.a * n // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cuts AS c JOIN totals USING (lang)
  JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.j], ' ')
  JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.j + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

OP13_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets AS x JOIN sets AS y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM both_ AS p JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b WHERE 100 * p.n >= 85 * (x.n + y.n - p.n)),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached AS r JOIN links AS l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS b FROM reached GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""
