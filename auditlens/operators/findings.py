"""Findings: construction, filters, counts, summary, ordering and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlens.functions import dims
from auditlens.functions.slices import Term, rank_two_level, sort_order

FINDING_COLS = ["finding_ord", "repo_id", "rule_id", "title", "file_path", "start_line", "end_line",
                "start_column", "end_column", "description", "analysis", "scratchpad", "poc",
                "confidence", "severity", "vuln_type", "cwe", "cwe_name", "context_code",
                "discovered_at"]


def to_findings(df: DataFrame, run_ts=None, prefix: str = dims.RULE_PREFIX,
                path_col: str = "file_path", extra=(), rules: DataFrame | None = None) -> DataFrame:
    """Scored rows → finding rows.

    Needs ``vuln_type`` and ``confidence``; ``analysis``/``scratchpad``/``poc``
    default to empty/null.  CWE id and name come from the 7-row rule table
    (a CASE over the fixed table, or a left join with a user rule table
    ``rules``, whose strategy is left to the measured size; unknown type →
    CWE-0 / Unknown); severity follows the confidence thresholds; line/column
    fields are 0; the discovery time is a run parameter so output is
    reproducible.  A ``metadata`` column passes through.  ``with_ordinals``
    adds the input order where the source has none.
    """
    cols = df.columns
    opt = lambda c, default: F.col(c) if c in cols else default
    ts = F.lit(run_ts).cast("timestamp_ntz") if run_ts is not None else F.lit(None).cast("timestamp_ntz")
    if rules is not None:
        rule = rules.select(F.col("vuln_type").alias("_vt"), "cwe", "cwe_name")
        base = df.join(rule, F.col("vuln_type") == F.col("_vt"), "left")
        cwe, cwe_name = F.col("cwe"), F.col("cwe_name")
    else:
        base = df
        cwe, cwe_name = dims.cwe_of(F.col("vuln_type")), dims.cwe_name_of(F.col("vuln_type"))
    name = F.substring_index(F.col(path_col), "/", -1)
    return base.select(
        *[c for c in ("finding_ord", "repo_id", *extra) if c in cols],
        F.concat(F.lit(prefix + "/"), F.col("vuln_type")).alias("rule_id"),
        F.concat(F.col("vuln_type"), F.lit(" vulnerability in "), name).alias("title"),
        F.col(path_col).alias("file_path"),
        F.lit(0).cast("bigint").alias("start_line"), F.lit(0).cast("bigint").alias("end_line"),
        F.lit(0).cast("bigint").alias("start_column"), F.lit(0).cast("bigint").alias("end_column"),
        opt("analysis", F.lit("")).alias("description"),
        opt("analysis", F.lit("")).alias("analysis"),
        opt("scratchpad", F.lit("")).alias("scratchpad"),
        opt("poc", F.lit(None).cast("string")).alias("poc"),
        F.col("confidence").cast("double").alias("confidence"),
        dims.severity_of(F.col("confidence")).alias("severity"),
        "vuln_type",
        F.coalesce(cwe, F.lit(dims.UNKNOWN_CWE)).alias("cwe"),
        F.coalesce(cwe_name, F.lit(dims.UNKNOWN_CWE_NAME)).alias("cwe_name"),
        opt("context_code", F.lit("")).alias("context_code"),
        ts.alias("discovered_at"),
        *[c for c in ("metadata",) if c in cols],
    )


def with_ordinals(findings: DataFrame, by=("repo_id",)) -> DataFrame:
    """Adds ``finding_ord`` (1-based per repository) where it is missing.

    The order comes from the findings' own keys (path, type, confidence, a
    digest of the texts), so it does not depend on partitioning; equal rows
    are interchangeable.  Numbered by the two-level rank, so a hot repository
    takes many tasks.
    """
    if "finding_ord" in findings.columns:
        return findings
    texts = [F.coalesce(F.col(c), F.lit("")) for c in ("analysis", "scratchpad", "poc", "context_code") if c in findings.columns]
    order = [F.col("file_path"), F.col("vuln_type"), (F.col("confidence"), False), F.xxhash64(*texts)]
    return rank_two_level(findings, [c for c in by if c in findings.columns], order, "finding_ord")


# ---------------------------------------------------------------------------
# Filters
# ---------------------------------------------------------------------------

def filter_requested_types(findings: DataFrame, types=(), known=None) -> DataFrame:
    """Empty request = all types; else only requested ones.  Types absent from
    the prompt table are dropped (``known`` defaults to the 7 types)."""
    known = [t for t, *_ in dims.PROMPT_TYPES] if known is None else list(known)
    allowed = [t for t in (types or known) if t in known]
    return findings.filter(F.col("vuln_type").isin(allowed))


def filter_min_confidence(findings: DataFrame, minimum: float = 5) -> DataFrame:
    return findings.filter(F.col("confidence") >= F.lit(minimum))


def filter_min_severity(findings: DataFrame, minimum: str | None = None) -> DataFrame:
    """Keep rank(severity) >= rank(minimum).  No minimum, or an unknown one
    (rank -1), keeps everything."""
    if not minimum:
        return findings
    r = dims.rank_of_name(minimum)
    return findings.filter(dims.severity_rank(F.col("severity")) >= F.lit(r))


# ---------------------------------------------------------------------------
# Counts and summary
# ---------------------------------------------------------------------------

def count_by_vuln_type(findings: DataFrame, by=("repo_id",)) -> DataFrame:
    return findings.groupBy(*by, "vuln_type").agg(F.count(F.lit(1)).alias("n"))


def count_by_confidence(findings: DataFrame, by=("repo_id",)) -> DataFrame:
    return (findings.select(*by, dims.confidence_bucket(F.col("confidence")).alias("bucket"))
            .groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n")))


def count_by_severity(findings: DataFrame, by=("repo_id",)) -> DataFrame:
    """Non-zero severities with their fixed display order (CRITICAL first)."""
    order = F.lit(99)
    for i, (s, _, _) in enumerate(dims.SEVERITIES):
        order = F.when(F.col("severity") == s, F.lit(i)).otherwise(order)
    return (findings.groupBy(*by, "severity").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("sev_ord", order))


def _map_text(arr: Column) -> Column:
    """Array<struct(k, n)> → 'k1=n1;k2=n2' sorted by key (stable text form)."""
    srt = F.array_sort(arr)
    return F.array_join(F.transform(srt, lambda s: F.concat(s["k"], F.lit("="), s["n"].cast("string"))), ";")


def scan_summary(findings: DataFrame, all_files: DataFrame, calls: DataFrame | None = None,
                 as_text: bool = True) -> DataFrame:
    """Per repository: total_files (all listed files), total_findings and the
    by-type / by-confidence-bucket / by-severity counts, plus total cost.

    One GROUPING SETS aggregation (partial + final, one shuffle of tiny
    partials) gives every breakdown; a per-repo collect folds at most
    (#types + 3 + 5) rows into maps.
    """
    f = findings.select("repo_id", "vuln_type", "severity",
                        dims.confidence_bucket(F.col("confidence")).alias("bucket"))
    g = (f.groupingSets([["repo_id", "vuln_type"], ["repo_id", "bucket"], ["repo_id", "severity"], ["repo_id"]],
                        "repo_id", "vuln_type", "bucket", "severity")
         .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid")))
    ent = lambda col, gid: F.collect_list(F.when(F.col("gid") == gid, F.struct(F.col(col).alias("k"), F.col("n").alias("n"))))
    # grouping_id bits: (vuln_type, bucket, severity) → 1 = aggregated away
    per = g.groupBy("repo_id").agg(
        F.max(F.when(F.col("gid") == 7, F.col("n"))).alias("total_findings"),
        ent("vuln_type", 3).alias("_t"), ent("bucket", 5).alias("_b"), ent("severity", 6).alias("_s"))
    files = all_files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_files"))
    out = files.join(per, "repo_id", "full")
    if as_text:
        out = out.select("repo_id",
                         F.coalesce("total_files", F.lit(0)).cast("bigint").alias("total_files"),
                         F.coalesce("total_findings", F.lit(0)).cast("bigint").alias("total_findings"),
                         F.coalesce(_map_text(F.col("_t")), F.lit("")).alias("by_vuln_type"),
                         F.coalesce(_map_text(F.col("_b")), F.lit("")).alias("by_confidence"),
                         F.coalesce(_map_text(F.col("_s")), F.lit("")).alias("by_severity"))
    else:
        mk = lambda c: F.map_from_entries(F.array_sort(F.coalesce(F.col(c), F.array().cast("array<struct<k:string,n:bigint>>"))))
        out = out.select("repo_id", F.coalesce("total_files", F.lit(0)).cast("bigint").alias("total_files"),
                         F.coalesce("total_findings", F.lit(0)).cast("bigint").alias("total_findings"),
                         mk("_t").alias("by_vuln_type"), mk("_b").alias("by_confidence"),
                         mk("_s").alias("by_severity"))
    if calls is not None and "cost_nano" in calls.columns:
        # the ledger's calls carry the scan; a scan id that names no repository adds no cost
        key = "repo_id" if "repo_id" in calls.columns else "scan_id"
        cost = calls.groupBy(F.col(key).try_cast(findings.schema["repo_id"].dataType).alias("repo_id")).agg(F.sum("cost_nano").alias("_c"))
        out = out.join(cost, "repo_id", "left").withColumn(
            "total_cost_usd", F.coalesce(F.col("_c"), F.lit(0)).cast("double") / F.lit(1e9)).drop("_c")
    return out


# ---------------------------------------------------------------------------
# Ordering, numbering, top-k
# ---------------------------------------------------------------------------

def report_order() -> list[Term]:
    """Severity score desc, confidence desc, then input order (stable)."""
    return [(dims.severity_score(F.col("severity")), False), (F.col("confidence"), False), F.col("finding_ord")]


def sort_findings(findings: DataFrame) -> DataFrame:
    """Global order; a range-partitioned sort (no single-task collect)."""
    return findings.orderBy(*sort_order(report_order()))


def number_findings(findings: DataFrame, by=("repo_id",)) -> DataFrame:
    """1-based report position per repository in report order (two-level
    rank, so one giant repository is numbered by many tasks)."""
    return rank_two_level(findings, by, report_order())


def top_findings(findings: DataFrame, k: int, by=("repo_id",)) -> DataFrame:
    """Top k per repository by severity score only (ties keep input order),
    plus how many more there are.

    ``row_number() <= k`` is planned as a WindowGroupLimit, which keeps only
    k rows per group in each task before the shuffle; the overflow count is a
    separate partial aggregate, so no group is ever collected whole.
    """
    score = dims.severity_score(F.col("severity"))
    w = Window.partitionBy(*by).orderBy(score.desc(), F.col("finding_ord").asc())
    top = findings.withColumn("pos", F.row_number().over(w).cast("bigint")).filter(F.col("pos") <= k)
    tot = findings.groupBy(*by).agg(F.count(F.lit(1)).alias("n_total"))
    return (top.join(tot, list(by))
            .withColumn("n_more", F.greatest(F.col("n_total") - F.lit(k), F.lit(0)))
            .drop("n_total"))
