"""Flagship plan: findings per repository by type and severity.

files → path exclusions → endpoint filter → built-in sink scorer →
findings → counts per (repo, type, severity).  Map-only until the final
aggregation (partial aggregate per task, one shuffle of counts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.operators.findings import to_findings
from auditlens.operators.paths import filter_excluded_paths
from auditlens.operators.patterns import filter_network_files, sink_rule_scores


def findings_by_type_severity(files: DataFrame, min_confidence: float = 0) -> DataFrame:
    cand = filter_network_files(filter_excluded_paths(files.select("repo_id", "path", "content")))
    scored = sink_rule_scores(cand).withColumnRenamed("path", "file_path")
    f = to_findings(scored)
    if min_confidence:
        f = f.filter(F.col("confidence") >= min_confidence)
    return (f.groupBy("repo_id", "vuln_type", "severity")
            .agg(F.count(F.lit(1)).alias("n_findings"),
                 F.sum("confidence").cast("bigint").alias("sum_confidence")))
