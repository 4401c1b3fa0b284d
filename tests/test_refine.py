from pyspark.sql import functions as F

from auditlens.operators.scoring import context_scorer
from auditlens.plans.refine import refine

A = "from lib import load_user\n\ndef view(request):\n    return open(load_user(request.args['id'])).read()\n"
B = "def load_user(uid):\n    return uid\n"
C = "x = eval('1')\n"


def test_refine_stops_on_repeated_names(spark):
    files = spark.createDataFrame([("r", "app.py", 1, A), ("r", "lib.py", 2, B), ("r", "c.py", 3, C)],
                                  "repo_id string, path string, file_ord long, content string")
    initial = spark.createDataFrame([("r", "app.py", "LFI", "{}"), ("r", "c.py", "RCE", "{}")],
                                    "repo_id string, path string, vuln_type string, previous string")
    out = {(r.path, r.vuln_type): r for r in refine(files, initial, context_scorer, max_iterations=7, run_name="t").collect()}
    lfi = out[("app.py", "LFI")]
    # round 0 asks for load_user/open/read/view-externals; round 1 resolves them and asks the same again → stop
    assert lfi.stop_reason == "same_names" and lfi.last_round == 1
    assert lfi.n_context >= 1 and lfi.confidence_score == 8.0  # the scorer raises confidence once context arrived
    rce = out[("c.py", "RCE")]
    # c.py calls only eval (a builtin, unresolved but still requested) → same names again at round 2
    assert rce.stop_reason == "same_names" and rce.last_round == 1


def test_failed_call_keeps_the_last_reply_and_runs_do_not_share_folders(spark):
    files = spark.createDataFrame([("r", "app.py", 1, A), ("r", "lib.py", 2, B)], "repo_id string, path string, file_ord long, content string")
    initial = spark.createDataFrame([("r", "app.py", "LFI", "{}")], "repo_id string, path string, vuln_type string, previous string")
    def second_call_fails(texts):
        if any("<context_code><code>" in t for t in texts):
            raise RuntimeError("no answer")
        return context_scorer(texts)

    failed = refine(files, initial, second_call_fails)
    again = refine(files, initial, context_scorer)
    def no_call_works(texts):
        raise RuntimeError("no answer")

    previous = '{"scratchpad": "s", "analysis": "first", "poc": null, "confidence_score": 4, "vulnerability_types": ["LFI"], "context_code": []}'
    (never,) = refine(files, initial.withColumn("previous", F.lit(previous)), no_call_works).collect()
    assert (never.stop_reason, never.last_round, never.analysis, never.confidence_score) == ("call_failed", -1, "first", 4.0)
    (r,) = failed.collect()
    assert r.stop_reason == "call_failed" and r.confidence_score == 7.0 and r.ok
    assert again.collect()[0].stop_reason == "same_names"


def test_a_short_reply_is_an_error_column(spark):
    from auditlens.operators.scoring import score_prompts
    prompts = spark.createDataFrame([("r", "a", "x"), ("r", "b", "y")], "repo_id string, path string, prompt string")
    got = score_prompts(prompts, lambda texts: []).collect()
    assert len(got) == 2 and all(r.raw is None and r.error for r in got)


def test_cost_limits_stop_pairs_and_keep_their_reply(spark):
    from auditlens.plans.refine import Limits
    files = spark.createDataFrame([("r", "app.py", 1, A), ("r", "lib.py", 2, B), ("s", "app.py", 1, A), ("s", "lib.py", 2, B)],
                                  "repo_id string, path string, file_ord long, content string")
    first = '{"scratchpad": "s", "analysis": "first", "poc": null, "confidence_score": 4, "vulnerability_types": ["LFI"], "context_code": []}'
    initial = spark.createDataFrame([("r", "app.py", "LFI", first), ("s", "app.py", "LFI", first), ("s", "app.py", "RCE", first)],
                                    "repo_id string, path string, vuln_type string, previous string")
    prior = spark.createDataFrame([("r", None, 900_000_000), ("r", "app.py", 200_000_000), ("s", "app.py", 1)],
                                  "repo_id string, file_path string, cost_nano long")
    run = lambda limits, **k: {(r.repo_id, r.vuln_type): r for r in refine(files, initial, context_scorer, limits=limits, **k).collect()}
    out = run(Limits("gpt-4o", budget_usd=1.0, escalation=None), prior=prior)
    # the calls before, one of them without a file, have used up r's budget: no call, the initial reply stays
    r, s = out[("r", "LFI")], out[("s", "LFI")]
    assert (r.stop_reason, r.last_round, r.analysis, r.cost_nano) == ("budget", -1, "first", 0)
    assert (s.stop_reason, s.last_round) == ("same_names", 1) and s.cost_nano > 0
    out = run(Limits("gpt-4o", budget_usd=1e-9))
    assert all((x.stop_reason, x.last_round) == ("budget", 0) and x.ok for x in out.values())
    out = run(Limits("gpt-4o", iteration_usd=1e-9), types=["LFI"])
    assert set(out) == {("r", "LFI"), ("s", "LFI")} and all(x.stop_reason == "iteration_cost" for x in out.values())


def test_escalation_needs_two_steep_steps(spark):
    from auditlens.plans.refine import Limits
    rows = spark.createDataFrame([([10, 20, 40],), ([10, 12, 40],), ([5, 10, 20, 21],), ([10, 20],), ([],)], "h array<bigint>")
    got = rows.select(Limits("gpt-4o").reason(F.lit(0), F.lit(0), F.col("h"))).collect()
    assert [r[0] for r in got] == ["escalation", None, None, None, None]


def test_rounds_hold_open_pairs_only(spark):
    """Pairs stop in different rounds; each round's table has the pairs still open, and each prompt is scored once."""
    import json

    from auditlens.session import checkpoint_dir
    n = 40
    files = spark.createDataFrame([("r", f"f{i}.py", i, f"def name_{i}():\n    pass\n# stop {i % 5}\n") for i in range(n)],
                                  "repo_id string, path string, file_ord long, content string")
    initial = spark.createDataFrame([("r", f"f{i}.py", "LFI", "{}") for i in range(n)], "repo_id string, path string, vuln_type string, previous string")
    calls = spark.sparkContext.accumulator(0)

    def scorer(texts):
        """Asks for one more name every round until round ``stop``, then for nothing."""
        import re
        out = []
        for t in texts:
            calls.add(1)
            stop = int(re.search(r"# stop (\d)", t).group(1))
            had = len(re.findall("<context_name_requested>", t))
            seen = re.search(r'"analysis":"(\d+)', t)
            now = int(seen.group(1)) + 1 if seen else 0
            names = [f"name_{k}" for k in range(now + 1)] if now < stop else []
            out.append(json.dumps({"scratchpad": "", "analysis": str(now), "poc": None, "confidence_score": min(10, had), "vulnerability_types": ["LFI"],
                                   "context_code": [{"name": x, "reason": "", "code_line": ""} for x in names]}))
        return out

    got = refine(files, initial, scorer, max_iterations=4, run_name="rounds-test").collect()
    assert len(got) == n
    for r in got:
        stop = int(r.path[1:-3]) % 5
        assert (r.last_round, r.stop_reason) == ((stop, "no_context") if stop < 3 else (3, "max_iterations")), r
    folder = f"{checkpoint_dir(spark).rstrip('/')}/tables/rounds-test"
    sizes = [spark.read.parquet(f"{folder}/round{i}").count() for i in range(4)]
    assert sizes == [n, n, n * 4 // 5, n * 3 // 5]  # pairs closed at a round's check are written by that round, then never again
    assert calls.value == n + n * 4 // 5 + n * 3 // 5 + n * 2 // 5


def test_initial_replies_are_evaluated_once(spark):
    """Whatever is made of the pairs, the step that scored them first runs once."""
    import json
    files = spark.createDataFrame([("r", f"f{i}.py", i, f"def h{i}():\n    open(x)\n") for i in range(3)], "repo_id string, path string, file_ord long, content string")
    reply = json.dumps({"scratchpad": "", "analysis": "a", "poc": None, "confidence_score": 5, "vulnerability_types": ["LFI"], "context_code": []})
    rows, seen = [("r", f"f{i}.py", "LFI", reply) for i in range(3)], spark.sparkContext.accumulator(0)

    def score(it):
        for pdf in it:
            seen.add(len(pdf))
            yield pdf
    schema = "repo_id string, path string, vuln_type string, previous string"
    out = refine(files, spark.createDataFrame(rows, schema).mapInPandas(score, schema), context_scorer, max_iterations=2)
    assert {(r.path, r.vuln_type) for r in out.collect()} == {(f"f{i}.py", "LFI") for i in range(3)}
    assert seen.value == 3
