"""Model-reply ingestion: repair → strict parse → findings.

All steps are built-in string/JSON expressions: regex rewrites for repair and
Spark's VARIANT type (``try_parse_json`` + ``schema_of_variant``) for strict
JSON type checks, so a reply table of any size is one map-only pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.functions import dims
from auditlens.operators.findings import to_findings

# JavaScript's whitespace set (String.prototype.trim / \s): ASCII whitespace
# plus the Unicode spaces, line/paragraph separators and BOM.
JS_WS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_WORD = "[A-Za-z0-9_]"  # ASCII word boundary (Java's \b is Unicode-aware on JDK 17)


def repair_text(raw: Column, use_prefill: Column) -> Column:
    """The repair chain on one text column."""
    s = F.when(use_prefill & ~F.regexp_replace(raw, "^" + JS_WS + "+", "").startswith("{"),
               F.concat(F.lit(dims.PREFILL), raw)).otherwise(raw)
    s = F.regexp_replace(s, r"(?i)```json" + JS_WS + "*", "")
    s = F.regexp_replace(s, r"```" + JS_WS + "*", "")
    obj = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    s = F.when(obj != "", obj).otherwise(s)
    s = F.regexp_replace(s, r'(?<!\\)\\(?!["\\/bfnrtu])', "")
    for word, rep in (("None", "null"), ("True", "true"), ("False", "false")):
        s = F.regexp_replace(s, f"(?<!{_WORD}){word}(?!{_WORD})", rep)
    return F.regexp_replace(s, f"^{JS_WS}+|{JS_WS}+$", "")


def repair_responses(raw: DataFrame, text_col: str = "raw", provider_col: str | None = "provider",
                     provider: str = "anthropic", out_col: str = "repaired") -> DataFrame:
    """Add the repaired reply.  The prefill is restored only for replies of the
    provider that used it (per-row ``provider_col`` when present)."""
    prov = F.col(provider_col) if provider_col and provider_col in raw.columns else F.lit(provider)
    use = F.lower(prov) == F.lit("anthropic")
    return raw.withColumn(out_col, repair_text(F.col(text_col), use))


def _vtype(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.variant_get(v, path, "variant"))


RESPONSE_TYPE = ("struct<scratchpad:string,analysis:string,poc:string,confidence_score:double,"
                 "vulnerability_types:array<string>,"
                 "context_code:array<struct<name:string,reason:string,code_line:string>>>")


def parse_text(text: Column) -> Column:
    """Strict schema parse → struct with an ``ok`` flag; any violation gives the
    fallback reply (scratchpad = the text, fixed analysis, score 0)."""
    types = [t for t, _ in dims.VULN_CWE]
    return F.element_at(F.transform(F.array(F.try_parse_json(text)), lambda v: _parse_variant(v, text, types)), 1)


def _parse_variant(v: Column, text: Column, types) -> Column:
    is_obj = F.schema_of_variant(v).startswith("OBJECT")
    t_scr, t_ana, t_poc = _vtype(v, "$.scratchpad"), _vtype(v, "$.analysis"), _vtype(v, "$.poc")
    t_conf = _vtype(v, "$.confidence_score")
    conf = F.try_variant_get(v, "$.confidence_score", "double")
    vts = F.try_variant_get(v, "$.vulnerability_types", "array<variant>")
    ccs = F.try_variant_get(v, "$.context_code", "array<variant>")
    numeric = t_conf.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | t_conf.startswith("DECIMAL")
    types_ok = F.forall(vts, lambda x: (F.schema_of_variant(x) == "STRING")
                        & F.variant_get(x, "$", "string").isin(*types))
    cc_ok = F.forall(ccs, lambda x: (_vtype(x, "$.name") == "STRING") & (_vtype(x, "$.reason") == "STRING")
                     & (_vtype(x, "$.code_line") == "STRING"))
    ok = F.coalesce(is_obj & (t_scr == "STRING") & (t_ana == "STRING")
                    & (t_poc.isNull() | t_poc.isin("STRING", "VOID"))
                    & numeric & (conf >= 0) & (conf <= 10)
                    & vts.isNotNull() & types_ok & ccs.isNotNull() & cc_ok, F.lit(False))
    good = F.struct(
        F.variant_get(v, "$.scratchpad", "string").alias("scratchpad"),
        F.variant_get(v, "$.analysis", "string").alias("analysis"),
        F.try_variant_get(v, "$.poc", "string").alias("poc"),
        conf.alias("confidence_score"),
        F.transform(vts, lambda x: F.variant_get(x, "$", "string")).alias("vulnerability_types"),
        F.transform(ccs, lambda x: F.struct(F.variant_get(x, "$.name", "string").alias("name"),
                                            F.variant_get(x, "$.reason", "string").alias("reason"),
                                            F.variant_get(x, "$.code_line", "string").alias("code_line"))
                    ).alias("context_code"))
    bad = F.struct(text.alias("scratchpad"), F.lit(dims.PARSE_FAILED).alias("analysis"),
                   F.lit(None).cast("string").alias("poc"), F.lit(0.0).alias("confidence_score"),
                   F.array().cast("array<string>").alias("vulnerability_types"),
                   F.array().cast("array<struct<name:string,reason:string,code_line:string>>").alias("context_code"))
    return F.struct(ok.alias("ok"), F.when(ok, good).otherwise(bad).cast(RESPONSE_TYPE).alias("r"))


def parse_responses(repaired: DataFrame, text_col: str = "repaired", keep=None) -> tuple[DataFrame, DataFrame]:
    """(all rows with the parsed reply fields, quarantine rows that failed)."""
    keep = [c for c in (keep or repaired.columns) if c != text_col]
    p = repaired.select(*keep, F.col(text_col), parse_text(F.col(text_col)).alias("_p"))
    out = p.select(*keep, F.col("_p.ok").alias("ok"), "_p.r.*")
    quarantine = p.filter(~F.col("_p.ok")).select(*keep, F.col(text_col))
    return out, quarantine


def responses_to_findings(responses: DataFrame, run_ts=None, prefix: str = dims.RULE_PREFIX,
                          path_col: str = "file_path", min_confidence: float | None = None,
                          extra=()) -> DataFrame:
    """Parsed replies → findings, one per (reply, vulnerability type).

    Uses a ``vuln_type`` column when present (secondary replies), else the
    reply's own type list.  Unknown types map to CWE-0 / Unknown.
    """
    df = responses
    if "vuln_type" not in df.columns:
        df = df.withColumn("vuln_type", F.explode("vulnerability_types"))
    df = (df.withColumnRenamed("confidence_score", "confidence")
          .withColumn("context_code", F.lit("")))
    if min_confidence is not None:
        df = df.filter(F.col("confidence") >= min_confidence)
    return to_findings(df, run_ts=run_ts, prefix=prefix, path_col=path_col, extra=extra)
