import json

from pyspark.sql import functions as F

from auditlens.operators.responses import parse_responses, repair_responses, responses_to_findings

OK = '{"scratchpad": "s", "analysis": "a", "poc": null, "confidence_score": 7, "vulnerability_types": ["LFI"], "context_code": []}'


def _repair(spark, rows):
    df = spark.createDataFrame(rows, "id long, provider string, raw string")
    return {r.id: r.repaired for r in repair_responses(df).collect()}


def test_repair_cases(spark):
    got = _repair(spark, [
        (1, "openai", "```json\n" + OK + "\n```"),
        (2, "openai", "Sure: " + OK + " bye"),
        (3, "anthropic", ' s", "analysis": "a", "poc": null, "confidence_score": 1, "vulnerability_types": [], "context_code": []}'),
        (4, "openai", '{"a": "it\\\'s \\\\ ok \\n"}'),
        (5, "openai", '{"a": None, "b": True, "c": False, "d": "NoneX"}'),
        (6, "openai", OK),
    ])
    assert json.loads(got[1]) == json.loads(OK)
    assert json.loads(got[2]) == json.loads(OK)
    assert got[3].startswith('{"scratchpad": "1. s"')
    assert json.loads(got[4]) == {"a": "it's \\ ok \n"}
    assert json.loads(got[5]) == {"a": None, "b": True, "c": False, "d": "NoneX"}
    assert got[6] == OK  # clean JSON is left alone (idempotent)


def test_parse_strict(spark):
    rows = [(1, OK), (2, OK.replace(": 7", ": 11")), (3, OK.replace('"LFI"', '"BOGUS"')),
            (4, OK.replace(', "context_code": []', "")), (5, OK.replace(": 7", ': "7"')), (6, "not json"),
            (7, OK.replace(": 7", ": 7.5").replace("[]", '[{"name": "f", "reason": "r", "code_line": "c"}]'))]
    df = spark.createDataFrame(rows, "id long, repaired string")
    parsed, quarantine = parse_responses(df)
    got = {r.id: r for r in parsed.collect()}
    assert got[1].ok and got[1].confidence_score == 7.0 and got[1].vulnerability_types == ["LFI"]
    for i in (2, 3, 4, 5, 6):
        assert not got[i].ok and got[i].analysis == "Failed to parse structured response" and got[i].confidence_score == 0.0
    assert got[7].ok and got[7].context_code[0].name == "f"
    assert {r.id for r in quarantine.collect()} == {2, 3, 4, 5, 6}
    f = responses_to_findings(parsed.filter("ok").withColumn("file_path", F.lit("src/x/v.py")), run_ts="2024-01-01 00:00:00")
    r = {x.vuln_type: x for x in f.collect()}
    assert r["LFI"].severity == "HIGH" and r["LFI"].cwe == "CWE-22" and r["LFI"].title == "LFI vulnerability in v.py"
