from auditlens.operators.symbols import definition_index, resolve_symbols_batch

A = "import os\n\nclass Loader:\n    def load(self, p):\n\n        return open(p).read()\n\n    def other(self):\n        pass\nx = 1\n"
B = "def helper(x):\n    return x\n\n@deco\nasync def fetch(u):\n    return u\n"
C = "from a import Loader\nvalue = Loader().load(name)\n"


def _files(spark):
    rows = [("r", "a.py", 1, A), ("r", "b.py", 2, B), ("r", "c.py", 3, C)]
    return spark.createDataFrame(rows, "repo_id string, path string, file_ord long, content string")


def test_definition_index(spark):
    d = {(r.kind, r.name, r.path, r.line_no, r.indent) for r in definition_index(_files(spark)).collect()}
    assert ("class", "Loader", "a.py", 3, 0) in d
    assert ("def", "load", "a.py", 4, 4) in d
    assert ("def", "fetch", "b.py", 5, 0) in d


def test_resolve_batch(spark):
    req = spark.createDataFrame([(1, "r", "Loader"), (2, "r", "Loader.load"), (3, "r", "helper"), (4, "r", "a.b.value"),
                                 (5, "r", "nothing_here"), (6, "r", "fetch")], "request_id long, repo_id string, name string")
    res, counts = resolve_symbols_batch(req, _files(spark))
    got = {r.request_id: r for r in res.collect()}
    # class body: blank lines kept, stops at the first dedented non-blank line
    assert got[1].how == "definition"
    assert got[1].source.split("\n") == A.split("\n")[2:9]
    assert got[2].how == "definition" and got[2].file_path == "a.py" and got[2].line_no == 3  # Class.method → class first
    assert got[3].source == "def helper(x):\n    return x\n"
    assert got[4].how == "reference" and got[4].file_path == "c.py" and got[4].line_no == 2  # ≥3 parts: reference only
    assert got[5].how == "none" and not got[5].found
    assert got[6].line_no == 5 and got[6].source.startswith("async def fetch")
    c = counts.collect()[0]
    assert (c.resolved, c.total) == (5, 6)


def test_block_cap(spark):
    body = "def big():\n" + "\n".join(f"    x{i} = {i}" for i in range(400)) + "\n"
    files = spark.createDataFrame([("r", "big.py", 1, body)], "repo_id string, path string, file_ord long, content string")
    req = spark.createDataFrame([(1, "r", "big")], "request_id long, repo_id string, name string")
    res, _ = resolve_symbols_batch(req, files)
    assert len(res.collect()[0].source.split("\n")) == 151  # the definition line + 150


def _plain_blocks(content, cap=150):
    """Bodies line by line, as the audited tool reads them."""
    import re

    from auditlens.operators.symbols import CLASS_RE, DEF_RE, WS_CHARS
    lines = content.split("\n")
    indent = [len(x) - len(x.lstrip(WS_CHARS)) for x in lines]
    out = []
    for i, x in enumerate(lines):
        for kind, pattern in (("class", CLASS_RE), ("def", DEF_RE)):
            if m := re.match(pattern, x, re.ASCII):
                j = i + 1
                while j < len(lines) and j <= i + cap and (not lines[j].strip(WS_CHARS) or indent[j] > indent[i]):
                    j += 1
                out.append((i + 1, kind, m.group(1), "\n".join(lines[i:j])))
    return sorted(out)


def _random_code(rng, n):
    kinds = ["def f{}(x):", "class C{}:", "async def g{}():", "x = {}", "", "   ", "# class def {}", "return {}"]
    return "\n".join(" " * rng.choice([0, 0, 2, 4, 4, 8, 12]) + rng.choice(kinds).format(rng.randrange(9)) for _ in range(n))


def test_blocks_against_a_plain_scan(spark):
    import random

    from auditlens.operators.symbols import definition_block, definition_blocks
    rng = random.Random(4)
    texts = [_random_code(rng, rng.randrange(1, 60)) for _ in range(60)]
    texts += ["def big():\n" + "    y\n" * 400 + "class Z:\n  pass", "\u00a0def a():\n\u00a0\u00a0x\n\ny", "", "def only():", "\n\n  \n"]
    files = spark.createDataFrame([("r", f"f{i}.py", i, t) for i, t in enumerate(texts)] + [("r", "none.py", 999, None)],
                                  "repo_id string, path string, file_ord long, content string")
    want = sorted((f"f{i}.py", *b) for i, t in enumerate(texts) for b in _plain_blocks(t))
    blocks = definition_blocks(files)
    assert sorted((r.path, r.line_no, r.kind, r.name, r.source) for r in blocks.collect()) == want
    joined = definition_block(definition_index(files), files)
    assert sorted((r.path, r.line_no, r.kind, r.name, r.source) for r in joined.collect()) == want
    assert "Exchange" not in blocks._jdf.queryExecution().executedPlan().toString()  # map-only


def _plain_reference(base, files):
    for _, path, _, content in sorted(files, key=lambda f: f[2]):
        for i, line in enumerate(content.split("\n")):
            if base in line:
                lines = content.split("\n")
                return path, i + 1, "\n".join(lines[max(0, i - 20):i + 30])
    return None


def test_references_against_a_plain_scan(spark):
    """Names inside longer words, short names, names with marks, blanks and line ends; hot and rare grams."""
    import random

    from auditlens.operators.symbols import resolve_reference
    rng = random.Random(8)
    words = ["alpha", "alphabet", "be", "b", "get_user()", "x[i]", "é_name", "a", "zz", "the", "other", "self", "value_1"]
    files = [("r", f"p{i}.py", i, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 40))))
             for i in range(30)]
    files.append(("r", "last.py", 40, "def unique_name(arg):\n    say = 'two words'\n\ttab\tname = unique_name_2"))
    names = ["alpha", "lphabe", "b", "be", "et_u", "user()", "x[i", "_name", "é", "zz", "q", "nothing", "two words", "two  words", "unique_name", "name_2", "que_name(arg)",
             "", "\n", "a\nb", "tab\tname", "e v", ")", "'", "selfx", "the"]
    req = spark.createDataFrame([(i, "r", n) for i, n in enumerate(names)] + [(500, "r", "a.b.alpha"), (501, "s", "alpha"), (502, "r", None), (503, "r", "alpha")],
                                "request_id long, repo_id string, name string")
    f = spark.createDataFrame(files + [("r", "none.py", 50, None)], "repo_id string, path string, file_ord long, content string")
    got = {r.request_id: (r.file_path, r.line_no, r.source) for r in resolve_reference(req, f).collect()}
    want = {i: w for i, n in [*enumerate(names), (500, "alpha"), (503, "alpha")] if (w := _plain_reference(n, files))}
    assert got == want


def test_symbol_plans_at_a_hot_repository(spark):
    """90 % of the files in one repository: no file text is shuffled, and the index is dealt by word, not by repository."""
    from pyspark.sql import functions as F

    from auditlens.operators.symbols import reference_index, resolve_symbols_batch
    repo = F.when(F.col("id") % 10 < 9, F.lit("hot")).otherwise(F.concat(F.lit("r"), F.col("id")))
    files = spark.range(400).select(repo.alias("repo_id"), F.concat(F.lit("f"), F.col("id"), F.lit(".py")).alias("path"), F.col("id").alias("file_ord"),
                                    F.concat(F.lit("def only_"), F.col("id"), F.lit("():\n    return other_"), F.col("id"), F.lit(" + shared")).alias("content"))
    req = spark.range(400).select(F.col("id").alias("request_id"), repo.alias("repo_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("only_"), F.col("id"))).otherwise(
        F.concat(F.lit("ther_"), F.col("id"))).alias("name"))
    res, counts = resolve_symbols_batch(req, files)
    plan = res._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in line and "content" in line for line in plan.split("\n")) and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert counts.agg(F.sum("resolved"), F.sum("total")).first()[:] == (400, 400)
    rows = {r.request_id: r for r in res.collect()}
    assert rows[2].source == "def only_2():\n    return other_2 + shared" and rows[2].how == "definition"
    assert rows[3].how == "reference" and rows[3].line_no == 2
    sizes = [r["n"] for r in reference_index(files).repartition(8, "repo_id", "unit").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 2 * min(sizes)


def test_many_answers_in_one_file(spark, monkeypatch):
    from auditlens.operators import symbols as S
    monkeypatch.setattr(S, "ANSWERS_PER_SPLIT", 7)
    text = "\n".join(f"def f{i}():\n    use{i}" for i in range(100))
    files = spark.createDataFrame([("r", "a.py", 1, text)], "repo_id string, path string, file_ord long, content string")
    req = spark.createDataFrame([(i, "r", f"f{i}") for i in range(100)] + [(1000 + i, "r", f"use{i}") for i in range(100)], "request_id long, repo_id string, name string")
    got = {r.request_id: r for r in S.resolve_symbols_batch(req, files)[0].collect()}
    assert all(got[i].source == f"def f{i}():\n    use{i}" and got[i].line_no == 2 * i + 1 for i in range(100))
    assert got[1005].line_no == 12 and got[1005].how == "reference"


def test_references_of_repositories_and_name_lengths(spark):
    """Names of every gram length and beyond; a name another repository holds is not found in one that lacks it."""
    import random

    from auditlens.operators.symbols import resolve_reference
    rng = random.Random(3)
    letters = "ab_1é😀"
    long = ["".join(rng.choice(letters) for _ in range(60)) for _ in range(4)] + ["".join(rng.choice("ab") for _ in range(50)) for _ in range(4)]
    files = [(repo, f"p{i}.py", i, "\n".join(" ".join(rng.sample(long, 2) + [rng.choice(long)[:rng.randrange(1, 40)]]) for _ in range(4))) for repo in "rst" for i in range(5)]
    files += [("u", "only.py", 0, "word_in_u = 1 😀"), ("r", "none.py", 9, None)]
    names = sorted({w[at:at + n] for w in long for n in (1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 40) for at in (0, 7, 20)} | {"ababababababababababababababababab", "word_in_u", "rd_in", "😀"})
    wanted = [(repo, n) for repo in "rstuv" for n in names]
    req = spark.createDataFrame([(i, *w) for i, w in enumerate(wanted)], "request_id long, repo_id string, name string")
    f = spark.createDataFrame(files, "repo_id string, path string, file_ord long, content string")
    got = {r.request_id: (r.file_path, r.line_no, r.source) for r in resolve_reference(req, f).collect()}
    want = {i: w for i, (repo, n) in enumerate(wanted) if (w := _plain_reference(n, [x for x in files if x[0] == repo and x[3] is not None]))}
    assert got == want and {repo for i in got for repo in wanted[i][0]} == set("rstu")


def test_reference_search_does_not_repeat_the_vocabulary_by_repository(spark, monkeypatch):
    """Postings follow the distinct words of all files; what is indexed by repository holds a wanted name."""
    from pyspark.sql import functions as F

    from auditlens.operators import symbols as S
    written, indexed, write, index = {}, [], S._written, S.reference_index
    monkeypatch.setattr(S, "_written", lambda df, name: written.setdefault(name, write(df, name)))
    monkeypatch.setattr(S, "reference_index", lambda *a, **k: indexed.append(index(*a, **k)) or indexed[-1])

    def postings(repos):
        written.clear()
        words = F.concat_ws(" ", *[F.concat(F.lit(f"other_{i}_"), F.col("id") % 5) for i in range(20)], F.lit("wanted_name"))
        repo = (F.col("id") % repos).cast("string")
        files = spark.range(10 * repos).select(repo.alias("repo_id"), F.concat(F.lit("f"), F.col("id")).alias("path"), F.col("id").alias("file_ord"), words.alias("content"))
        req = spark.range(repos).select(F.col("id").alias("request_id"), repo.alias("repo_id"), F.lit("a.b.wanted_name").alias("name"))
        _, counts = S.resolve_symbols_batch(req, files)
        assert counts.agg(F.sum("resolved"), F.sum("total"), F.count("*")).first()[:] == (repos, repos, repos)
        return written["postings-identifier"].count()

    assert postings(3) == postings(30)
    assert sorted(r.unit for r in indexed[-1].collect()) == ["wanted_name"] * 30
