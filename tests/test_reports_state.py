import json

from pyspark.sql import functions as F

from auditlens.operators.delivery import dedupe_issues, issue_rows, sign_payloads
from auditlens.operators.findings import scan_summary
from auditlens.operators.reports import assemble, csv_report, sarif_report, json_report, markdown_report
from auditlens.operators.state import normalize_state, progress_summary, resolve_scan_options

FIND = [(1, "r", "src/a.py", "LFI", 9.0, "CRITICAL", 3, 0, 'say "hi", <b>', None, "", "2024-01-01 00:00:00"),
        (2, "r", "src/b.py", "RCE", 5.0, "MEDIUM", 0, 0, "plain", "poc x", "ctx\nline", "2024-01-01 00:00:00"),
        (3, "r", "src/a.py", "LFI", 9.0, "CRITICAL", 0, 0, "again", None, "", "2024-01-01 00:00:00")]
SCHEMA = ("finding_ord long, repo_id string, file_path string, vuln_type string, confidence double, severity string, "
          "start_line long, end_line long, analysis string, poc string, context_code string, discovered_at string")


def _findings(spark):
    return spark.createDataFrame(FIND, SCHEMA).withColumn("discovered_at", F.col("discovered_at").cast("timestamp_ntz"))


def test_csv_escaping(spark):
    lines = assemble(csv_report(_findings(spark))).collect()[0].document.split("\n")
    assert lines[0].startswith("rule_id,title,file_path")
    assert '"say ""hi"", <b>"' in lines[1]


def test_documents_are_valid_json(spark):
    f = _findings(spark)
    files = spark.createDataFrame([("r", "src/a.py"), ("r", "src/b.py")], "repo_id string, path string")
    summ = scan_summary(f, files)
    sarif = json.loads(assemble(sarif_report(f, "2024-01-01T00:00:00Z")).collect()[0].document)
    res = sarif["runs"][0]["results"]
    assert [r["level"] for r in res] == ["error", "error", "warning"]
    assert res[0]["locations"][0]["physicalLocation"]["region"] == {"startLine": 3, "endLine": 3}
    assert "region" not in res[1]["locations"][0]["physicalLocation"] and "codeFlows" in res[2]
    js = json.loads(assemble(json_report(f, summ, "t")).collect()[0].document)
    assert js["metadata"]["total_findings"] == 3 and len(js["findings"]) == 3
    md = assemble(markdown_report(f, summ, "t")).collect()[0].document
    assert "### 1. LFI in `src/a.py` (L3–L3)" in md and "| 🔴 CRITICAL | 2 |" in md


def test_issue_dispositions(spark):
    issues = issue_rows(_findings(spark))
    existing = spark.createDataFrame([("[audit] RCE vulnerability in src/b.py",)], "title string")
    d = {r.finding_ord: r.disposition for r in dedupe_issues(issues, existing).collect()}
    assert d == {1: "to_create", 2: "duplicate", 3: "duplicate"}
    d = {r.finding_ord: r.disposition for r in dedupe_issues(issues, existing, min_severity="HIGH", dry_run=True).collect()}
    assert d == {1: "skipped", 2: "skipped", 3: "duplicate"}


def test_signature_matches_hmac(spark):
    import hashlib
    import hmac
    df = spark.createDataFrame([("{\"a\": 1}",), ("héllo",)], "payload string")
    for r in sign_payloads(df, "k3y").collect():
        assert r.signature == "sha256=" + hmac.new(b"k3y", r.payload.encode(), hashlib.sha256).hexdigest()


def test_progress_and_state(spark):
    st = spark.createDataFrame([("r", "a", "complete"), ("r", "b", "complete"), ("r", "c", "pending"), ("r", "d", "pending")],
                               "repo_id string, path string, status string")
    p = progress_summary(st).collect()[0]
    assert (p.status, p.total_files, p.progress_percent) == ("in_progress", 4, 50.0)
    recs = spark.createDataFrame([(1, '{"completed_files": ["a"], "pending_files": ["b"], "repo_path": "/x"}'),
                                  (2, '{"completedFiles": ["a", "c"], "repoPath": "/y", "version": "2"}')], "id long, json string")
    n = {r.id: r for r in normalize_state(recs).collect()}
    assert n[1].completed_files == ["a"] and n[1].version == "1.0.0" and n[2].pending_files == [] and n[2].repo_path == "/y"


def test_option_precedence(spark):
    o = spark.createDataFrame([("a", None, None, "", "budget: 3\nmax_iterations: 4\nconfidence_threshold: 6"),
                               ("b", 9.0, 2, "LFI", "budget: 3\nbudget: 5\nmodel: ~"),
                               ("c", None, None, "", '{"cost": {"budget": 7}, "budget": 1, "analysis": {"max_iterations": 2}}')],
                              "repo_id string, in_budget double, in_min_confidence int, in_types string, cfg_text string")
    r = {x.repo_id: x for x in resolve_scan_options(o).collect()}
    assert (r["a"].budget, r["a"].max_iterations, r["a"].min_confidence) == (3.0, 4.0, 6.0)
    assert (r["b"].budget, r["b"].min_confidence, r["b"].vuln_types, r["b"].model) == (9.0, 2.0, "LFI", None)
    assert (r["c"].budget, r["c"].max_iterations) == (7.0, 2.0)  # nested section beats flat key


def test_same_title_in_two_repositories_is_no_duplicate(spark):
    from auditlens.operators.delivery import dedupe_issues
    issues = spark.createDataFrame([(1, "r1", "HIGH", "t"), (2, "r2", "HIGH", "t"), (3, "r1", "HIGH", "t"), (4, "r3", "HIGH", "u")],
                                   "finding_ord long, repo_id string, severity string, title string")
    existing = spark.createDataFrame([("r3", "u")], "repo_id string, title string")
    got = {r.finding_ord: r.disposition for r in dedupe_issues(issues, existing).collect()}
    assert got == {1: "to_create", 2: "to_create", 3: "duplicate", 4: "duplicate"}


def test_named_state_versions_are_kept(spark):
    from auditlens.operators.state import mark_complete
    one = spark.createDataFrame([("r", "a", "pending", "1")], "repo_id string, path string, status string, updated_at string")
    first = mark_complete(one, one.where("false"), name="versions")
    second = mark_complete(first, one.selectExpr("repo_id", "path", "'complete' AS status", "'2' AS updated_at"), name="versions")
    assert [r.status for r in first.collect()] == ["pending"] and [r.status for r in second.collect()] == ["complete"]


def _read_documents(spark, path, key="repo_id"):
    """Documents per repository from written report lines, files in name order."""
    rows = spark.read.text(path).select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"),
                                        key, "value").collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.f, r.i)):
        out.setdefault(r[key], []).append(r.value)
    return {k: "\n".join(v) for k, v in out.items()}


def test_replies_to_reports(spark, tmp_path):
    from auditlens.operators.reports import write_all_reports
    from auditlens.operators.responses import parse_responses, repair_responses, responses_to_findings
    reply = json.dumps({"scratchpad": "s", "analysis": "found", "poc": None, "confidence_score": 8,
                        "vulnerability_types": ["LFI", "RCE"], "context_code": []})
    raw = spark.createDataFrame([("r", "a.py", reply), ("r", "b.py", reply)], "repo_id string, path string, raw string")
    files = spark.createDataFrame([("r", "a.py"), ("r", "b.py"), ("clean", "c.py")], "repo_id string, path string")
    calls = spark.createDataFrame([("r", "a.py", "m", 10, 5, 25_000_000, "2024-01-01 00:00:00")],
                                  "scan_id string, file_path string, model string, input_tokens long, output_tokens long, cost_nano long, called_at string")
    parsed, bad = parse_responses(repair_responses(raw, text_col="raw"))
    assert bad.count() == 0
    found = responses_to_findings(parsed.withColumnRenamed("path", "file_path"), run_ts="2024-01-01 00:00:00")
    found = found.withColumn("metadata", F.create_map(F.lit("k"), F.lit("v")))
    from auditlens.operators.findings import scan_summary, with_ordinals
    assert sorted(r.finding_ord for r in with_ordinals(found).collect()) == [1, 2, 3, 4]
    cost = {r.repo_id: r.total_cost_usd for r in scan_summary(with_ordinals(found), files, calls).collect()}
    assert cost == {"r": 0.025, "clean": 0.0}
    paths = write_all_reports(found, files, str(tmp_path), "2024-01-01T00:00:00")
    docs = {k: _read_documents(spark, p) for k, p in paths.items()}
    assert all(set(d) == {"r", "clean"} for d in docs.values())
    js = json.loads(docs["json"]["r"])
    assert js["summary"]["by_vuln_type"] == {"LFI": 2, "RCE": 2} and len(js["findings"]) == 4
    assert json.loads(docs["json"]["clean"])["summary"]["by_severity"] == {}
    assert len(json.loads(docs["sarif"]["r"])["runs"][0]["results"]) == 4
    assert json.loads(docs["sarif"]["clean"])["runs"][0]["results"] == []
    assert len(docs["csv"]["clean"].split("\n")) == 1 and len(docs["csv"]["r"].split("\n")) == 5
    assert "<th>Severity</th>" in docs["html"]["r"] and "<th>Severity</th>" not in docs["html"]["clean"]


def test_cost_document_holds_every_file_and_model(spark, tmp_path):
    from auditlens.operators.reports import cost_document, write_document
    rows = [("s1", f"d/{k % 7}'\"\n.py", f"m{k % 2}", 10, 5, 25_000_000, f"2024-01-01 00:00:{k:02d}") for k in range(20)]
    rows += [("s1", None, "m0", 1, 1, 100_000, "2024-01-01 00:01:00"), ("s2", None, "m0", 1, 1, 100_000, "2024-01-01 00:01:00")]
    costs = spark.createDataFrame(rows, "scan_id string, file_path string, key string, input_tokens long, output_tokens long, cost_nano long, ts string")
    write_document(cost_document(costs.withColumn("ts", F.col("ts").cast("timestamp"))), str(tmp_path / "c"), key="scan_id")
    docs = {k: json.loads(v) for k, v in _read_documents(spark, str(tmp_path / "c"), "scan_id").items()}
    assert docs["s1"]["costs_by_model"] == {"m0": 0.2501, "m1": 0.25} and docs["s2"]["costs_by_file"] == {}
    assert docs["s1"]["costs_by_file"] == {f"d/{k}'\"\n.py": round(0.025 * (3 if k < 6 else 2), 4) for k in range(7)}
    assert docs["s1"]["api_calls"] == 21 and docs["s1"]["total_cost_usd"] == 0.5001


def test_reports_are_in_order_over_many_files_and_texts_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Three repositories of uneven size, many findings a file; rendered findings are written by a map."""
    from auditlens.operators import reports
    monkeypatch.setattr(reports, "ROWS_PER_FILE", 40)
    n = 600
    found = spark.range(n).selectExpr(
        "id AS finding_ord", "CASE WHEN id % 10 < 7 THEN 'big' WHEN id % 10 < 9 THEN 'mid' ELSE 'small' END AS repo_id", "'a/' || id || '.py' AS file_path",
        "CASE WHEN id % 3 = 0 THEN 'LFI' ELSE 'RCE' END AS vuln_type", "CAST(id % 11 AS INT) AS confidence",
        "CASE WHEN id % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity", "'found ' || id AS analysis", "CAST('2024-01-01' AS timestamp_ntz) AS discovered_at").repartition(5)
    files = spark.createDataFrame([("big", "a.py"), ("clean", "c.py")], "repo_id string, path string")
    plain = reports.write_all_reports(found, files, str(tmp_path / "plain"), "t")
    packed = reports.write_all_reports(found, files, str(tmp_path / "packed"), "t", compression="gzip")
    shuffled = []
    write = reports._write_sorted

    def seen(lines, *rest):
        shuffled.append(lines._jdf.queryExecution().optimizedPlan().toString())
        return write(lines, *rest)
    monkeypatch.setattr(reports, "_write_sorted", seen)
    reports.write_all_reports(found, files, str(tmp_path / "again"), "t")
    assert len(shuffled) == 5 and all(p.splitlines()[0].startswith("Union") for p in shuffled)  # only its ends are dealt out
    summary, numbered = None, reports.number_findings(found)
    from auditlens.operators.findings import scan_summary
    summary = scan_summary(found, files, as_text=False)
    want = {"sarif": reports.sarif_report(numbered, "t", summary), "json": reports.json_report(numbered, summary, "t"),
            "markdown": reports.markdown_report(numbered, summary, "t"), "html": reports.html_report(numbered, summary, "t"),
            "csv": reports.csv_report(numbered, summary)}
    for name, lines in want.items():
        whole = {r.repo_id: r.document for r in reports.assemble(lines).collect()}
        assert set(whole) == {"big", "mid", "small", "clean"}
        assert _read_documents(spark, plain[name]) == whole and _read_documents(spark, packed[name]) == whole
    assert spark.read.text(packed["csv"]).inputFiles()[0].endswith(".gz") and len(spark.read.text(plain["csv"] + "/repo_id=big").inputFiles()) >= 5
