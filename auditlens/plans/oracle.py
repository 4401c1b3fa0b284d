"""DuckDB SQL fragments generated from the same fixed tables as the engine.

Used only to write the independent oracle queries (tests / correctness
gate); the engine itself never builds SQL text.
"""

from __future__ import annotations

from auditlens.functions import dims


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def keep_path_sql(p: str = "path", strict_root: bool = False, suffix: str = ".py") -> str:
    rel = f"('/' || lower({p}))"
    name = f"regexp_extract({p}, '[^/]*$')"
    path_bad = " OR ".join([f"contains({rel}, {q(x)})" for x in dims.EXCLUDE_PATHS]
                           + [f"regexp_matches({p}, '(^|/)\\.[^/]*/')"])
    name_bad = " OR ".join(f"contains({name}, {q(x)})" for x in dims.EXCLUDE_NAMES)
    root = "FALSE" if strict_root else f"NOT contains({p}, '/')"
    return f"(ends_with({p}, {q(suffix)}) AND NOT ({name_bad}) AND ({root} OR NOT ({path_bad})))"


def network_sql(c: str = "content", rules=None) -> str:
    pats = []
    for _, p in rules or dims.NETWORK_PATTERNS:
        if p not in pats:
            pats.append(p)
    return "coalesce((" + " OR ".join(f"regexp_matches({c}, {q(p)})" for p in pats) + "), FALSE)"


def family_hits_sql(src: str, id_cols: list[str], text_col: str, rules, label: str = "family") -> str:
    """UNION ALL per family of (ids, label, n) with n > 0."""
    fams: dict[str, list[str]] = {}
    for fam, p in rules:
        fams.setdefault(fam, []).append(p)
    ids = ", ".join(id_cols)
    parts = []
    for fam, pats in fams.items():
        n = " + ".join(f"(CASE WHEN regexp_matches({text_col}, {q(p)}) THEN 1 ELSE 0 END)" for p in pats)
        parts.append(f"SELECT {ids}, {q(fam)} AS {label}, CAST({n} AS BIGINT) AS n FROM {src}")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n > 0"


def severity_case(c: str = "confidence") -> str:
    return (f"CASE WHEN {c} >= 9 THEN 'CRITICAL' WHEN {c} >= 7 THEN 'HIGH' WHEN {c} >= 5 THEN 'MEDIUM' "
            f"WHEN {c} >= 3 THEN 'LOW' ELSE 'INFO' END")


def bucket_case(c: str = "confidence") -> str:
    return f"CASE WHEN {c} >= 8 THEN 'high' WHEN {c} >= 5 THEN 'medium' ELSE 'low' END"


def sev_score_case(c: str = "severity") -> str:
    return "CASE " + " ".join(f"WHEN {c} = {q(s)} THEN {sc}" for s, sc, _ in dims.SEVERITIES) + " ELSE 0 END"


def sev_rank_case(c: str = "severity") -> str:
    return "CASE " + " ".join(f"WHEN {c} = {q(s)} THEN {r}" for s, _, r in dims.SEVERITIES) + " ELSE -1 END"


def rule_values() -> str:
    names = dict(dims.CWE_NAMES)
    rows = ", ".join(f"({q(t)}, {q(c)}, {q(names[c])}, {i})" for i, (t, c) in enumerate(dims.VULN_CWE))
    return f"(VALUES {rows}) AS rd(vuln_type, cwe, cwe_name, type_ord)"


def pricing_values() -> str:
    rows = ", ".join(f"({i}, {q(m)}, {int(round(a * 1e6))}, {int(round(b * 1e6))})"
                     for i, (m, a, b) in enumerate(dims.PRICING))
    return f"(VALUES {rows}) AS pr(ord, model, in_nano, out_nano)"


def pricing_ctes(calls: str = "fx_calls") -> str:
    """CTEs ``c`` (calls + key) and ``p`` (key, in_nano, out_nano, match)."""
    price = {m: (int(round(a * 1e6)), int(round(b * 1e6))) for m, a, b in dims.PRICING}
    fb_in = " ".join(f"WHEN contains(lower(k.key), {q(s)}) THEN {price[e][0]}" for s, e in dims.PRICE_FALLBACKS)
    fb_out = " ".join(f"WHEN contains(lower(k.key), {q(s)}) THEN {price[e][1]}" for s, e in dims.PRICE_FALLBACKS)
    fb_m = " ".join(f"WHEN contains(lower(k.key), {q(s)}) THEN 'provider'" for s, e in dims.PRICE_FALLBACKS)
    d_in, d_out = int(round(dims.DEFAULT_PRICE[0] * 1e6)), int(round(dims.DEFAULT_PRICE[1] * 1e6))
    tier = "(CASE WHEN k.key = pr.model THEN 0 ELSE 1 END)"
    return f"""c AS (SELECT *, regexp_replace(model, '^[^/]*/', '') AS key FROM {calls}),
k AS (SELECT DISTINCT key FROM c),
m AS (SELECT k.key, arg_min(in_nano, {tier} * 1000 + ord) AS i, arg_min(out_nano, {tier} * 1000 + ord) AS o,
             arg_min({tier}, {tier} * 1000 + ord) AS tier
      FROM k JOIN {pricing_values()} ON k.key = pr.model OR contains(lower(pr.model), lower(k.key)) OR contains(lower(k.key), lower(pr.model))
      GROUP BY k.key),
p AS (SELECT k.key, CAST(coalesce(m.i, CASE {fb_in} ELSE {d_in} END) AS BIGINT) AS in_nano,
             CAST(coalesce(m.o, CASE {fb_out} ELSE {d_out} END) AS BIGINT) AS out_nano,
             CASE WHEN m.tier = 0 THEN 'exact' WHEN m.tier = 1 THEN 'partial' ELSE CASE {fb_m} ELSE 'default' END END AS match
      FROM k LEFT JOIN m USING (key)),
cc AS (SELECT c.*, p.in_nano, p.out_nano, c.input_tokens * p.in_nano + c.output_tokens * p.out_nano AS cost_nano FROM c JOIN p USING (key))"""


def tag_sql(name: str, body: str) -> str:
    return f"'<{name}>' || {body} || '</{name}>'"


def file_code_sql(path: str = "path", content: str = "content") -> str:
    return f"'<file_code><file_path>' || {path} || '</file_path>' || chr(10) || '<file_source>' || {content} || '</file_source></file_code>'"


def prompt_values() -> str:
    rows = ", ".join(f"({q(t)}, {q(txt)}, {q(chr(10).join(b))}, {i})" for i, (t, txt, b) in enumerate(dims.PROMPT_TYPES))
    return f"(VALUES {rows}) AS pd(vuln_type, template, bypass_text, type_ord)"


def nl_join(*parts: str) -> str:
    """Blank-line join of SQL string expressions (text may hold chr(10))."""
    return " || chr(10) || chr(10) || ".join(parts)


def lit_nl(s: str) -> str:
    """SQL literal for text that may contain newlines (no backslashes)."""
    return " || chr(10) || ".join(q(x) for x in s.split("\n"))
