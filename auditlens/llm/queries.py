"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditlens.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


@register("op1_html_extraction")
def op1(spark, sf):
    from auditlens.llm.html_extract import extract_main_text
    return extract_main_text(read(spark, sf, "pages"))


@register("op2_token_files")
def op2(spark, sf):
    from auditlens.llm.token_files import token_file_digest
    return token_file_digest(read(spark, sf, "documents"))


@register("op6_token_attribution")
def op6(spark, sf):
    from auditlens.llm.token_attribution import count_tokens
    return count_tokens(read(spark, sf, "documents"))


@register("op5_line_quality")
def op5(spark, sf):
    from auditlens.llm.line_quality import judge_documents
    return judge_documents(read(spark, sf, "documents"), read(spark, sf, "labels"))


@register("op4_substring_dedup", """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
n AS (SELECT doc_id, words, CAST(len(words) AS BIGINT) AS n_words FROM w),
s AS (SELECT doc_id, words, unnest(range(1, n_words - 48)) AS p FROM n WHERE n_words >= 50),
k AS (SELECT doc_id, p, array_to_string(words[p:p + 49], ' ') AS win FROM s),
f AS (SELECT win, min(doc_id) AS lo FROM k GROUP BY win),
h AS (SELECT k.doc_id, k.p FROM k JOIN f ON k.win = f.win WHERE f.lo < k.doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM h),
r AS (SELECT doc_id, list(q) AS gone, count(*) AS n_removed FROM c GROUP BY doc_id)
SELECT n.doc_id, n.n_words, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN r.gone IS NULL THEN array_to_string(words, ' ')
    ELSE array_to_string(list_filter(words, lambda x, i: NOT list_contains(r.gone, i)), ' ') END) AS kept_sha256
FROM n LEFT JOIN r ON n.doc_id = r.doc_id
""")
def op4(spark, sf):
    from auditlens.llm.substring_dedup import remove_repeats
    return remove_repeats(read(spark, sf, "documents")).drop("kept_text")


@register("op8_pii")
def op8(spark, sf):
    from auditlens.llm.pii import find_pii
    return find_pii(read(spark, sf, "documents"))


@register("op9_decontamination", """
WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
bs AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 9], ' ') AS win, least(len(w), 10) AS size FROM bs),
sizes AS (SELECT DISTINCT size FROM win),
ds AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size),
hit AS (SELECT ds.doc_id, ds.p, ds.size, win.item_id FROM ds JOIN win ON win.size = ds.size AND win.win = array_to_string(ds.w[ds.p:ds.p + ds.size - 1], ' ')),
pos AS (SELECT DISTINCT doc_id, unnest(range(p, p + size)) AS q FROM hit),
n AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(it.items, '')) AS items_sha256, n.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
""")
def op9(spark, sf):
    from auditlens.llm.decontamination import find_contamination
    return find_contamination(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@register("op3_sharding")
def op3(spark, sf):
    from auditlens.llm.sharding import shard_documents
    return shard_documents(read(spark, sf, "documents"))


@register("op10_best_fit_packing")
def op10(spark, sf):
    from auditlens.llm.packing import pack_documents
    return pack_documents(read(spark, sf, "documents"))


@register("op7_jaccard_join")
def op7(spark, sf):
    from auditlens.llm.jaccard_join import similar_documents
    return similar_documents(read(spark, sf, "documents"))


@register("op11_periodic_runs")
def op11(spark, sf):
    from auditlens.llm.periodic_runs import run_digest
    return run_digest(read(spark, sf, "documents"))


@register("op12_spelling_variants", """
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w
  FROM documents WHERE text IS NOT NULL),
many AS (SELECT doc_id, w, count(*) AS k FROM runs GROUP BY doc_id, w),
bytes AS (SELECT w, k, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), CAST(128 + (unicode(x) & 63) AS BIGINT)] END)) AS b FROM many),
crc AS (SELECT w, k, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], b), lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) AS INT) + 1])), 4294967295) AS h FROM bytes, tab),
vocab AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word FROM crc)
  GROUP BY word HAVING length(word) >= 6 AND sum(k) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab),
cut AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM places),
wild AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS d FROM places),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM wild a JOIN wild b ON a.d = b.d AND a.word <> b.word
  UNION ALL SELECT c.word, c.n, v.word, v.n FROM cut c JOIN vocab v ON c.d = v.word
  UNION ALL SELECT v.word, v.n, c.word, c.n FROM cut c JOIN vocab v ON c.d = v.word),
ranked AS (SELECT word, n, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS r FROM near),
forms AS (SELECT v.word, v.n, coalesce(x.n_near, 0) AS n_near, CASE WHEN x.m >= 5 * v.n THEN x.other END AS form, CASE WHEN x.m >= 5 * v.n THEN x.m END AS form_n
  FROM vocab v LEFT JOIN ranked x ON x.word = v.word AND x.r = 1),
walk AS (SELECT word, word AS root FROM forms UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.root WHERE f.form IS NOT NULL),
roots AS (SELECT walk.word, walk.root FROM walk JOIN forms f ON f.word = walk.root WHERE f.form IS NULL)
SELECT f.word, f.form, r.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM forms f JOIN roots r ON r.word = f.word
""")
def op12(spark, sf):
    from auditlens.llm.spelling_variants import variant_groups
    return variant_groups(read(spark, sf, "documents"))


@register("op13_language_mixture")
def op13(spark, sf):
    from auditlens.llm.language_mixture import identify_languages
    return identify_languages(read(spark, sf, "documents"))
