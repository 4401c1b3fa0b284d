from pyspark.sql import functions as F

from auditlens.operators.paths import discover_files, filter_excluded_paths
from auditlens.operators.patterns import filter_network_files, pattern_family_hits, sink_rule_scores


def _files(spark, rows):
    return spark.createDataFrame([("r", p, c) for p, c in rows], "repo_id string, path string, content string")


def test_exclusions(spark):
    paths = ["setup.py", "app.py", "pkg/setup.py", "tests/t.py", "src/testing.py", "testing.py", "Docs/c.py",
             ".hidden/m.py", "src/.cache/x.py", "src/test_a.py", "src/conftest.py", "src/b_test.py", "src/ok.py",
             "README.md", "venv/lib/virtualenv/x.py", "src/Examples/e.py", "node_modules/a.py", "pkg/__init__.py"]
    kept = {r.path for r in filter_excluded_paths(_files(spark, [(p, "") for p in paths])).collect()}
    # root files are checked by name only: root setup.py / testing.py stay
    assert kept == {"setup.py", "app.py", "testing.py", "src/ok.py", "pkg/__init__.py"}


def test_strict_root(spark):
    kept = {r.path for r in filter_excluded_paths(_files(spark, [("setup.py", ""), ("a.py", "")]), strict_root=True).collect()}
    assert kept == {"a.py"}


def test_network_patterns(spark):
    pos = ["@app.route('/x')", "from fastapi import FastAPI\napp = FastAPI()", "class UserView(APIView):",
           "cursor.execute(q)", "x = requests.get(u)", "class ApiRequestHandler(Base):", "ws = WEBSOCKET",
           "tpl|safe", "urlpatterns = []", "def lambda_handler(event, ctx):"]
    neg = ["x = 1", "print('hello')", "# a comment about routes", "tpl|safety", "def handler_x(y):",
           "class V(APIView):"]  # the class name itself must end in View
    df = _files(spark, [(f"f{i}.py", c) for i, c in enumerate(pos + neg)] + [("null.py", None)])
    hit = {r.path for r in filter_network_files(df).collect()}
    assert hit == {f"f{i}.py" for i in range(len(pos))}


def test_single_file_target_bypasses_filters(spark):
    df = _files(spark, [("tests/t.py", "x = 1"), ("tests/u.py", "@app.route('/')"), ("src/a.py", "@app.route('/')")])
    one = {r.path for r in discover_files(df, analyze_path="tests/t.py").collect()}
    assert one == {"tests/t.py"}
    # a directory target: exclusions are relative to it, so tests/u.py is kept
    d = {r.path for r in discover_files(df, analyze_path="tests").collect()}
    assert d == {"tests/u.py"}


def test_family_hits_and_sinks(spark):
    df = _files(spark, [("a.py", "@app.route('/')\ncursor.execute(q)\neval(x)"), ("b.py", "x = 1")])
    fam = {(r.path, r.family): r.n for r in pattern_family_hits(df, ["path"], "content").collect()}
    assert fam[("a.py", "Flask")] == 2  # app.route and @...route
    assert ("b.py", "Flask") not in fam
    s = {(r.path, r.vuln_type): r.confidence for r in sink_rule_scores(df, keys=("path",)).collect()}
    assert s[("a.py", "SQLI")] == 5 and s[("a.py", "RCE")] == 5
