"""Registered queries: symbol lookup over the path-filtered file list."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlens.operators.symbols import CLASS_RE, DEF_RE
from auditlens.plans import oracle as O
from auditlens.plans.catalog import register
from auditlens.sources.tables import fixture, with_fixtures

WS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}\x0b]"


def _all_files(spark, sf):
    from auditlens.operators.paths import list_all_files
    return list_all_files(fixture(spark, sf, "fx_files")).select("repo_id", "path", "file_ord", "content")


def _requests(spark, sf):
    return fixture(spark, sf, "fx_requests")


BASE = with_fixtures("fx_files", "fx_requests") + f""",
allf AS (SELECT repo_id, path, file_ord, content FROM fx_files WHERE {O.keep_path_sql('path')}),
lines AS (SELECT repo_id, path, file_ord, CAST(generate_subscripts(arr, 1) AS BIGINT) AS line_no, unnest(arr) AS line
          FROM (SELECT repo_id, path, file_ord, string_split(content, chr(10)) AS arr FROM allf)),
lw AS (SELECT *, length(regexp_extract(line, '^{WS}*')) AS ind, regexp_replace(line, '^{WS}+|{WS}+$', '', 'g') = '' AS blank FROM lines),
defs AS (SELECT repo_id, path, file_ord, line_no, 'class' AS kind, regexp_extract(line, {O.q(CLASS_RE)}, 1) AS name, ind FROM lw
           WHERE regexp_extract(line, {O.q(CLASS_RE)}, 1) <> ''
         UNION ALL
         SELECT repo_id, path, file_ord, line_no, 'def' AS kind, regexp_extract(line, {O.q(DEF_RE)}, 1) AS name, ind FROM lw
           WHERE regexp_extract(line, {O.q(DEF_RE)}, 1) <> ''),
req AS (SELECT request_id, repo_id, name, string_split(name, '.') AS parts FROM fx_requests),
tgt AS (SELECT request_id, repo_id, 'class' AS kind, parts[1] AS target, 1 AS pat_ord FROM req WHERE len(parts) IN (1, 2)
        UNION ALL SELECT request_id, repo_id, 'def', parts[1], 2 FROM req WHERE len(parts) = 1
        UNION ALL SELECT request_id, repo_id, 'def', parts[2], 2 FROM req WHERE len(parts) = 2),
hits AS (SELECT t.request_id, d.path, d.file_ord, d.line_no, d.kind, t.pat_ord, d.repo_id,
                row_number() OVER (PARTITION BY t.request_id ORDER BY d.file_ord, t.pat_ord, d.line_no) AS rk
         FROM tgt t JOIN defs d ON d.repo_id = t.repo_id AND d.kind = t.kind AND d.name = t.target),
rdef AS (SELECT request_id, repo_id, path AS file_path, line_no, kind FROM hits WHERE rk = 1),
blk AS (SELECT r.*, (SELECT min(l.line_no) FROM lw l WHERE l.repo_id = r.repo_id AND l.path = r.file_path AND l.line_no > r.line_no
                     AND l.line_no <= r.line_no + 150 AND NOT l.blank
                     AND l.ind <= (SELECT ind FROM lw x WHERE x.repo_id = r.repo_id AND x.path = r.file_path AND x.line_no = r.line_no)) AS stop,
               (SELECT max(l.line_no) FROM lw l WHERE l.repo_id = r.repo_id AND l.path = r.file_path) AS last
        FROM rdef r),
dsrc AS (SELECT b.request_id, b.file_path, b.line_no, string_agg(l.line, chr(10) ORDER BY l.line_no) AS source
         FROM blk b JOIN lw l ON l.repo_id = b.repo_id AND l.path = b.file_path AND l.line_no BETWEEN b.line_no
              AND coalesce(b.stop - 1, least(b.last, b.line_no + 150))
         GROUP BY ALL),
left_req AS (SELECT * FROM req WHERE request_id NOT IN (SELECT request_id FROM rdef)),
rh AS (SELECT q.request_id, l.repo_id, l.path, l.line_no, row_number() OVER (PARTITION BY q.request_id ORDER BY l.file_ord, l.line_no) AS rk
       FROM left_req q JOIN lw l ON l.repo_id = q.repo_id AND contains(l.line, q.parts[len(q.parts)])),
rfirst AS (SELECT request_id, repo_id, path AS file_path, line_no FROM rh WHERE rk = 1),
rsrc AS (SELECT f.request_id, f.file_path, f.line_no, string_agg(l.line, chr(10) ORDER BY l.line_no) AS source
         FROM rfirst f JOIN lw l ON l.repo_id = f.repo_id AND l.path = f.file_path
              AND l.line_no BETWEEN greatest(1, f.line_no - 20) AND f.line_no + 29
         GROUP BY ALL)
"""


@register("definition_index", BASE + "SELECT repo_id, path, line_no, kind, name, CAST(ind AS INTEGER) AS indent FROM defs")
def q_def_index(spark, sf):
    from auditlens.operators.symbols import definition_index
    return definition_index(_all_files(spark, sf)).select("repo_id", "path", "line_no", "kind", "name", "indent")


@register("definition_block", BASE + """,
db AS (SELECT d.*, (SELECT min(l.line_no) FROM lw l WHERE l.repo_id = d.repo_id AND l.path = d.path AND l.line_no > d.line_no
                    AND l.line_no <= d.line_no + 150 AND NOT l.blank AND l.ind <= d.ind) AS stop,
              (SELECT max(l.line_no) FROM lw l WHERE l.repo_id = d.repo_id AND l.path = d.path) AS last FROM defs d)
SELECT d.repo_id, d.path, d.line_no, d.kind, string_agg(l.line, chr(10) ORDER BY l.line_no) AS source
FROM db d JOIN lw l ON l.repo_id = d.repo_id AND l.path = d.path
     AND l.line_no BETWEEN d.line_no AND coalesce(d.stop - 1, least(d.last, d.line_no + 150))
GROUP BY ALL""")
def q_def_block(spark, sf):
    from auditlens.operators.symbols import definition_blocks
    return definition_blocks(_all_files(spark, sf)).select("repo_id", "path", "line_no", "kind", "source")


@register("resolve_definition", BASE + "SELECT request_id, file_path, line_no, kind FROM rdef")
def q_resolve_def(spark, sf):
    from auditlens.operators.symbols import definition_index, resolve_definition
    return resolve_definition(_requests(spark, sf), definition_index(_all_files(spark, sf)))


@register("resolve_reference", BASE + "SELECT request_id, file_path, line_no, source FROM rsrc")
def q_resolve_ref(spark, sf):
    from auditlens.operators.symbols import definition_index, resolve_definition, resolve_reference
    files = _all_files(spark, sf)
    req = _requests(spark, sf)
    left = req.join(resolve_definition(req, definition_index(files)).select("request_id"), "request_id", "left_anti")
    return resolve_reference(left, files)


@register("resolve_symbols_batch", BASE + """,
found AS (SELECT request_id, file_path, line_no, source, 'definition' AS how FROM dsrc
          UNION ALL SELECT request_id, file_path, line_no, source, 'reference' FROM rsrc)
SELECT q.request_id, q.repo_id, q.name, f.how IS NOT NULL AS found, coalesce(f.how, 'none') AS how,
       coalesce(f.file_path, '') AS file_path, f.line_no, coalesce(f.source, '') AS source
FROM req q LEFT JOIN found f USING (request_id)""")
def q_batch(spark, sf):
    from auditlens.operators.symbols import resolve_symbols_batch
    res, _ = resolve_symbols_batch(_requests(spark, sf), _all_files(spark, sf))
    return res.select("request_id", "repo_id", "name", "found", "how", "file_path", "line_no", "source")


@register("resolve_symbols_counts", BASE + """,
found AS (SELECT request_id FROM rdef UNION ALL SELECT request_id FROM rfirst)
SELECT q.repo_id, count(f.request_id) AS resolved, count(*) AS total FROM req q LEFT JOIN found f USING (request_id) GROUP BY q.repo_id""")
def q_batch_counts(spark, sf):
    from auditlens.operators.symbols import resolve_symbols_batch
    return resolve_symbols_batch(_requests(spark, sf), _all_files(spark, sf))[1]
