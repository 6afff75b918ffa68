"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlens.llm.byte_bpe import round_trip
from turnlens.llm.clustering import cluster_vectors
from turnlens.llm.common import table
from turnlens.llm.decontaminate import UNITS, contaminated
from turnlens.llm.html_text import extract_text
from turnlens.llm.license_scan import PHRASES, SIZES, TEMPLATES, THRESHOLD as LICENSE_THRESHOLD, license_report, needed, plain_words
from turnlens.llm.ngram_join import similar_classes
from turnlens.llm.registry import register
from turnlens.llm.secret_scan import secret_report
from turnlens.llm.sharding import shard_rows
from turnlens.llm.spelling import spelling_variants
from turnlens.llm.token_counts import token_counts
from turnlens.llm.topk_search import top_k
from turnlens.llm.toxicity import THRESHOLD, held_out, score_documents, train
from turnlens.llm.url_filter import judge_urls

WORD_VOCAB = "word_bpe_49k.json"
BYTE_VOCAB = "byte_bpe_multi_50k.tiktoken"


@register("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), WORD_VOCAB)


@register("op2_ring_shards")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_rows(table(spark, sf_dir, "documents"), 24)
    return rows.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


WINDOW_SQL = r"""
WITH texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT 'b', item_id, text FROM benchmark WHERE item_id IS NOT NULL),
raw AS (SELECT row_number() OVER () AS k, side, id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws FROM texts),
each AS (SELECT k, side, id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM raw),
words AS (SELECT k, side, id, i, regexp_replace(regexp_replace(w, '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', '') AS word,
  coalesce(regexp_matches(lag(w) OVER (PARTITION BY k ORDER BY i), '[.!?:][^\p{L}\p{N}_]*$'), true) AS first FROM each),
low AS (SELECT *, lower(word) AS lit, regexp_full_match(lower(word),
    '[+-]?\p{L}?[0-9][0-9.,:/%-]*(?:st|nd|rd|th)?|[0-9]+\p{L}{1,4}') AS number FROM words WHERE word <> ''),
kinds AS (SELECT *, lit IN ($units) AND coalesce(lag(number) OVER (PARTITION BY k ORDER BY i), false) AS unit,
  regexp_matches(word, '^\p{Lu}') AND NOT first AND NOT number AND lit NOT IN ($units) AS name FROM low),
texted AS (SELECT k, side, id, list(lit ORDER BY i) AS lits, list(number OR unit OR name ORDER BY i) AS slots,
  list(CASE WHEN number THEN '<number>' WHEN unit THEN '<unit>' WHEN name THEN '<name>' ELSE lit END ORDER BY i) AS tmpl FROM kinds GROUP BY k, side, id),
wins AS (SELECT side, id, len(lits) - 4 AS n_windows, j, lits[j:j + 4] AS lits, slots[j:j + 4] AS slots, tmpl[j:j + 4] AS tmpl
  FROM (SELECT *, unnest(range(1, len(lits) - 3)) AS j FROM texted)),
forms AS (SELECT side, id, n_windows, j, lits, list_transform(slots, lambda x: false) AS slots, 'literal ' || array_to_string(lits, ' ') AS h FROM wins
  UNION ALL SELECT side, id, n_windows, j, lits, slots, 'template ' || array_to_string(tmpl, ' ') FROM wins
  WHERE len(list_filter(slots, lambda x: x)) BETWEEN 1 AND 2),
met AS (SELECT d.id AS doc_id, b.id AS item_id, d.j AS pos, b.j AS place, b.n_windows, d.lits AS words, b.lits AS item_words, b.slots
  FROM forms d JOIN (SELECT DISTINCT * FROM forms WHERE side = 'b') b ON d.side = 'd' AND d.h = b.h),
held AS (SELECT DISTINCT doc_id, item_id, n_windows, place, pos - place AS shift FROM met),
shares AS (SELECT doc_id, item_id, max(s) AS share FROM (SELECT doc_id, item_id, count(DISTINCT place) / n_windows AS s FROM held
  GROUP BY doc_id, item_id, n_windows) GROUP BY doc_id, item_id),
ordered AS (SELECT doc_id, item_id, max(n) AS in_order FROM (SELECT doc_id, item_id, shift, count(*) AS n FROM held GROUP BY doc_id, item_id, shift)
  GROUP BY doc_id, item_id),
slots AS (SELECT doc_id, item_id, sum(same) / sum(n) AS consistency FROM (
  SELECT doc_id, item_id, value, max(c) AS same, sum(c) AS n FROM (
    SELECT doc_id, item_id, value, other, count(*) AS c FROM (
      SELECT doc_id, item_id, unnest(slots) AS slot, unnest(item_words) AS value, unnest(words) AS other FROM met) WHERE slot GROUP BY ALL)
  GROUP BY doc_id, item_id, value) GROUP BY doc_id, item_id)
SELECT s.doc_id, s.item_id, s.share, o.in_order, coalesce(t.consistency, 1.0) AS consistency
FROM shares s JOIN ordered o USING (doc_id, item_id) LEFT JOIN slots t USING (doc_id, item_id)
WHERE (s.share >= 0.8 OR o.in_order >= 9) AND coalesce(t.consistency, 1.0) >= 0.8""".replace(
    "$units", ", ".join(f"'{u}'" for u in sorted(UNITS)))


@register("op3_decontaminate", WINDOW_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SECRET_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT k, 1 AS place, 'assign' AS kind, string_split_regex(t, $assign) AS gaps,
         regexp_extract_all(t, $assign, 0) AS hits, regexp_extract_all(t, $assign, 2) AS body, 6 AS least FROM docs
  UNION ALL
  SELECT k, 2, 'access', string_split_regex(t, $access), regexp_extract_all(t, $access, 0),
         regexp_extract_all(t, $access, 0), 20 FROM docs
  UNION ALL
  SELECT k, 3, 'hex', string_split_regex(t, $hex), regexp_extract_all(t, $hex, 0),
         regexp_extract_all(t, $hex, 0), 24 FROM docs),
each AS (SELECT k, place, kind, least, gaps, hits, body, unnest(range(1, len(hits) + 1)) AS i FROM found),
sized AS (SELECT k, place, kind, i, length(body[i]) >= least AS keep, length(hits[i]) AS size,
                 length(gaps[i]) + length(hits[i]) AS step FROM each),
spans AS (SELECT k, place, kind, keep, size,
                 sum(step) OVER (PARTITION BY k, place ORDER BY i)::BIGINT AS stop FROM sized),
lists AS (SELECT k, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                 count(*) FILTER (kind = 'hex') AS n_hex,
                 string_agg(kind || ':' || (stop - size) || ':' || stop, ',' ORDER BY stop - size, place) AS spans
          FROM spans WHERE keep GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN lists USING (k)"""
for _name, _pattern in (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
                        ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")):
    SECRET_SQL = SECRET_SQL.replace(f"${_name}", "'" + _pattern.replace("'", "''") + "'")


@register("op4_secret_scan", SECRET_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


@register("op5_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), BYTE_VOCAB)


@register("op6_html_text")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@register("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out())
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return score_documents(docs, model).select("doc_id", held_out().alias("held_out"), "score", predicted, "sentences")


CLASS_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
sides AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(node, root) AS (SELECT doc_id, doc_id FROM sets UNION SELECT l.v, r.root FROM reach r JOIN sides l ON l.u = r.node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id, coalesce(n.n, 0) AS n_links
FROM sets s JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) r ON r.node = s.doc_id
LEFT JOIN (SELECT u, count(*) AS n FROM sides GROUP BY u) n ON n.u = s.doc_id"""


@register("op8_ngram_join", CLASS_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"), 3, 90, links=True)


URL_SQL = r"""
WITH parts AS (
  SELECT row_number() OVER () AS k, page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '\?([^#]*)', 1) ELSE NULL END AS query FROM pages),
tokens AS (
  SELECT k, page_id, host, path,
    CASE WHEN query IS NULL THEN [] ELSE list_sort(list_distinct(list_concat(
      list_transform(list_filter(list_concat(string_split(host, '.'), flatten(list_transform(string_split(host, '.'), lambda x: string_split(x, '-')))),
        lambda x: x <> ''), lambda x: 'h:' || x),
      list_transform(regexp_extract_all(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z][a-z0-9_-]*'), lambda x: 'p:' || x),
      list_transform(regexp_extract_all(query, '(?:^|&)([^=&]+)', 1), lambda x: 'q:' || x)))) END AS items,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts),
judged AS (SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS listed FROM tokens),
baskets AS (SELECT k, items, listed FROM judged WHERE listed IS NOT NULL AND len(items) > 0),
subsets AS (SELECT listed, list_filter(items, lambda x, i: (m >> CAST(i - 1 AS BIGINT)) & 1 = 1) AS t FROM
  (SELECT listed, items, unnest(range(1, CAST(1 AS BIGINT) << len(items))) AS m FROM baskets)),
counted AS (SELECT t, listed, count(*) AS n, sum(count(*)) OVER (PARTITION BY t) AS of_all FROM subsets GROUP BY t, listed),
rules AS (SELECT t, listed, n / of_all AS confidence, n / (SELECT count(*) FROM baskets) AS support FROM counted
  WHERE n / of_all >= 0.8 AND n >= 0.01 * (SELECT count(*) FROM baskets)),
kept AS (SELECT * FROM rules a WHERE NOT EXISTS (SELECT 1 FROM rules b WHERE b.listed = a.listed AND len(b.t) < len(a.t)
  AND b.confidence >= a.confidence AND list_has_all(a.t, b.t))),
mined AS (SELECT k, listed AS verdict FROM (
  SELECT j.k, r.listed, row_number() OVER (PARTITION BY j.k ORDER BY r.confidence DESC, r.support DESC, len(r.t), array_to_string(r.t, ' '), r.listed) AS place
  FROM judged j JOIN kept r ON j.listed IS NULL AND list_has_all(j.items, r.t)) WHERE place = 1)
SELECT page_id, host, path, rule, coalesce(listed, verdict, 'allow') AS verdict FROM judged LEFT JOIN mined USING (k)"""


@register("op9_url_filter", URL_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""


@register("op10_topk_search", TOP_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)), 10)


# The hash is built from bits: one step of the polynomial for each bit, eight for a byte of a table.
VARIANT_SQL = r"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, [0, 1, 2, 3, 4, 5, 6, 7]),
    lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS t),
runs AS (SELECT d, w, count(*) AS c FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(
    coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{7,}')) AS w FROM documents) GROUP BY d, w),
bytes AS (SELECT w, c, hex(encode(d || ':' || w)) AS x FROM runs),
coded AS (SELECT w, c, list_transform(range(0, len(x) // 2), lambda i: (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16
    + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1) AS b FROM bytes),
hashed AS (SELECT w, c, xor(list_reduce(list_prepend(4294967295, b), lambda h, v: xor(h // 256, t[1 + (xor(h % 256, v))])), 4294967295) AS h
    FROM coded, tab),
words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT c, CASE WHEN h % 31 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:]
    ELSE w END AS word FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
cuts AS MATERIALIZED (SELECT word, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.rest = w.word),
near AS (SELECT p.a AS word, b AS best, n AS best_n, count(*) OVER (PARTITION BY p.a) AS n_near,
    row_number() OVER (PARTITION BY p.a ORDER BY n DESC, b) AS place FROM pairs p JOIN words w ON w.word = p.b),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form,
    CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n FROM words w LEFT JOIN near p ON p.word = w.word AND p.place = 1),
chain(word, root, step) AS (SELECT word, form, 1 FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, coalesce(r.root, f.word) AS root, f.n, f.n_near, f.form_n FROM forms f LEFT JOIN roots r USING (word)"""


@register("op11_spelling_variants", VARIANT_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def _cluster_sql(clusters: int, rounds: int) -> str:
    """The rounds one after another: nearest centroid, then floors of the means."""
    ctes = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INT) AS j, v AS c
    FROM (SELECT v, sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM kept) ORDER BY h, v LIMIT {clusters})"""]
    for i in range(rounds + 1):
        ctes.append(f"""d{i} AS (SELECT k, vec_id, v, j, list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS d
    FROM kept, c{i})""")
        ctes.append(f"a{i} AS MATERIALIZED (SELECT k, vec_id, v, j, d FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, j) AS p FROM d{i}) WHERE p = 1)")
        if i < rounds:
            ctes.append(f"""s{i} AS (SELECT j, p, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, unnest(range(64)) AS p FROM a{i}) GROUP BY j, p),
m{i} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY p) AS c FROM s{i} GROUP BY j),
c{i + 1} AS MATERIALIZED (SELECT c{i}.j, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON m{i}.j = c{i}.j)""")
    return f"""WITH {", ".join(ctes)}
SELECT vec_id, a.j AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.j = a.j"""


@register("op12_centroid_clusters", _cluster_sql(16, 3))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings")).drop("n_distances")


def _license_sql() -> str:
    """Places of the phrases, and every block against every template, without filters."""
    places = []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        test = " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(parts))
        places.append(f"list_transform(list_filter(range(0, len(w) - {len(parts) - 1}), lambda i: {test}), lambda i: {{'at': i, 'label': '{label}'}})")
    rows = []
    for label, text in TEMPLATES:
        words = plain_words(text)
        distinct = sorted(set(words))
        size = next(s for s in SIZES if 2 * len(words) <= s)
        rows.append(f"({len(rows)}, '{label}', {size}, {distinct!r}, {needed(len(distinct), LICENSE_THRESHOLD)})")
    blocks = " UNION ALL ".join(f"SELECT k, {s} AS size, unnest(range(0, greatest(len(w) - {s // 2}, 1), {s // 2})) AS at FROM docs" for s in SIZES)
    return rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
places AS (SELECT k, flatten([{", ".join(places)}]) AS p FROM docs),
templates(n, label, size, words, least) AS (VALUES {", ".join(rows)}),
blocks AS (SELECT b.k, b.size, b.at, list_distinct(w[b.at + 1:b.at + b.size]) AS words FROM ({blocks}) b JOIN docs USING (k)),
found AS (SELECT k, list(DISTINCT label) AS labels, max(o / len(t)) AS share, count(*) AS n_blocks FROM (
  SELECT k, label, least, t.words AS t, len(list_intersect(b.words, t.words)) AS o FROM blocks b JOIN templates t ON t.size = b.size) WHERE o >= least GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, CAST(list_min(list_transform(p, lambda x: x.at)) AS BIGINT) AS first_word,
  CAST(list_max(list_transform(p, lambda x: x.at)) AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(p, lambda x: x.label), coalesce(labels, [])))), ',') AS labels,
  CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score, coalesce(n_blocks, 0) AS n_blocks
FROM docs JOIN places USING (k) LEFT JOIN found USING (k)"""


@register("op13_license_scan", _license_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))
