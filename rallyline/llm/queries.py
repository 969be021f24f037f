"""The registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyline.llm import audit, langid, licences, lines, mixing, packing, passages, perplexity, recipes, search, simhash, sketches, urls
from rallyline.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_components(table(spark, sf_dir, "documents"), width=3, radius=2)
    return rows.select("doc_id", "fingerprint", "component_id")


def op2_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.exact_groups(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.line_dedup(table(spark, sf_dir, "documents"), least=10)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op4_differencing_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), end_id=2, capacity=4096)


def op5_licence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.labelled(table(spark, sf_dir, "documents"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row")


def op7_family_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(table(spark, sf_dir, "documents"))


def op8_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op9_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op10_lookup_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprinted(table(spark, sf_dir, "documents"))


def op11_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_documents(search.indexed(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=10)


def op12_parity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.removals(table(spark, sf_dir, "documents")).drop("spans")


def text_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of operator 8's result, what SQL can tell: host, path, rule, and the rule's verdict."""
    rows = urls.judged(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def text_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of operator 9's result, what SQL can tell: sizes and targets."""
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target")


def text_edit_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of operator 10's result, all but the fingerprints themselves."""
    rows = sketches.fingerprinted(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next")


def queries() -> dict[str, Query]:
    every = (
        op1_simhash, op2_chunk_recipes, op3_line_dedup, op4_differencing_packs, op5_licence_index, op6_kneser_ney,
        op7_family_svm, op8_url_templates, op9_sainte_lague_mix, op10_lookup_sketches, op11_block_max_search, op12_parity_audit, op13_super_kmers,
        text_url_rules, text_mix_targets, text_edit_likeness,
    )
    return {f.__name__: f for f in every}


#: As regular expressions of DuckDB.
_SPACES = r"[\x20\x09-\x0D]"

_OP2 = rf"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACES}+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256,
       strlen(t) AS n_bytes
FROM n
"""

_OP3 = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(regexp_replace(line, '^{_SPACES}+|{_SPACES}+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT doc_id, pos, line, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""


_URL_RULES = """
WITH h AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), l AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h),
rules AS (
  SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) AS v(said, h, p)
), fits AS (
  SELECT page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.said, length(r.h || r.p)) AS ruled
  FROM l JOIN rules r ON (l.host = r.h OR suffix(l.host, '.' || r.h)) AND starts_with(l.path, r.p) GROUP BY page_id
)
SELECT l.page_id, host, path, rule, ruled FROM l LEFT JOIN fits ON fits.page_id = l.page_id
"""

_MIX_TARGETS = rf"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACES}+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][nth % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE * 1.5 AS words FROM s),
l AS (
  SELECT *, (words - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM w
), f AS (SELECT *, (SELECT arg_min(level, (cap / weight, nth)) FROM l WHERE level * weight <= cap) AS free FROM l)
SELECT doc_id, size, source_size, least(cap, coalesce(free * weight, cap))::DOUBLE AS target FROM d JOIN f ON f.source IS NOT DISTINCT FROM d.source
"""

_EDIT_LIKENESS = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS o FROM t WINDOW w AS (ORDER BY doc_id DESC)),
e AS (SELECT doc_id, t, o, substr(t, 1, length(t) - length(t) // 2) || substr(o, 1, length(t) // 2) AS e FROM n),
p AS (SELECT *, list_distinct(string_split(t, chr(10))) AS lt, list_distinct(string_split(o, chr(10))) AS lo, list_distinct(string_split(e, chr(10))) AS le FROM e)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(e) AS edited_sha256,
       len(list_intersect(lt, le))::DOUBLE / (len(lt) + len(le) - len(list_intersect(lt, le))) AS near_edited,
       len(list_intersect(lt, lo))::DOUBLE / (len(lt) + len(lo) - len(list_intersect(lt, lo))) AS near_next
FROM p
"""

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP11 = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_TERMS}') AS terms FROM documents),
i AS MATERIALIZED (SELECT row_number() OVER () AS q, item_id, regexp_extract_all({_LOWER}, '{_TERMS}') AS terms FROM benchmark),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS length FROM d WHERE len(terms) > 0),
f AS (SELECT r, doc_id, term, count(*)::BIGINT AS tf, any_value(n)::BIGINT AS n
      FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY r, doc_id, term),
a AS (SELECT q, item_id, term, count(*)::BIGINT AS times FROM (SELECT q, item_id, unnest(terms) AS term FROM i) GROUP BY q, item_id, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM f, s WHERE term IN (SELECT term FROM a) GROUP BY term, n_docs),
g AS (
  SELECT q, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // length))))::BIGINT AS score
  FROM a JOIN w USING (term) JOIN f USING (term), s GROUP BY q, r
)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM g WHERE score > 0 QUALIFY rank <= 10
"""

_OP12 = rf"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACES}+'), lambda x: x <> '') AS words
  FROM documents
), f AS (
  SELECT doc_id, part,
         len(words) < 100 AS a,
         100 * len(list_distinct(words)) < 80 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS e
  FROM t
), m AS (
  SELECT part, [a, b, c, d, e] AS fails,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id AND quality = 1) AS good,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id AND toxic = 1) AS toxic
  FROM f
), cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, fails
), l AS (SELECT unnest(range(1, 6)) AS i), orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o
  FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (
  SELECT array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, s.i AS step, o[s.i] AS own, o[1:s.i - 1] AS earlier
  FROM orders, l s
), r AS (
  SELECT part, filter_order, step, fails[own] AS fits, len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone,
         len(list_filter(fails, lambda x: x)) AS j, n, good, toxic
  FROM cells, steps
)
SELECT part, filter_order, step::INT AS step,
       coalesce(sum(n) FILTER (NOT fits AND NOT gone), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (fits AND NOT gone), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (fits AND gone), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (fits AND j = 1), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (fits AND NOT gone), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER (fits AND NOT gone), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * (120 // greatest(j, 1))) FILTER (fits), 0)::BIGINT AS shapley
FROM r GROUP BY part, filter_order, step
"""

_OP13 = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACES}+'), lambda x: x <> '') AS words
  FROM documents
), p AS (
  SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS j,
         unnest(list_transform(range(1, len(words) + 1), lambda k: CASE WHEN k + 34 <= len(words) THEN array_to_string(words[k:k + 34], ' ') END)) AS win
  FROM d
), f AS (SELECT r, j, word, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS starts FROM p),
g AS (SELECT r, j, word, bool_or(starts) OVER (PARTITION BY r ORDER BY j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS kept FROM g GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.r = d.r
"""


def oracle_sql() -> dict[str, str]:
    more = {"text_url_rules": _URL_RULES, "text_mix_targets": _MIX_TARGETS, "text_edit_likeness": _EDIT_LIKENESS}
    return more | {"op2_chunk_recipes": _OP2, "op3_line_dedup": _OP3, "op5_licence_index": licences.oracle(), "op11_block_max_search": _OP11, "op12_parity_audit": _OP12, "op13_super_kmers": _OP13}
