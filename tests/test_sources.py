import os
import tempfile

from pyspark.sql import functions as F

from auditlens.sources.files import file_line_stats, pick_readme, repo_ref_rollup, scan_source_tree


def _tree():
    root = tempfile.mkdtemp(prefix="auditlens-tree-", dir="/tmp")
    files = {"repoA/pkg/__init__.py": "x = 1\n", "repoA/pkg/_priv.py": "y = 2\n", "repoA/pkg/mod.py": "z = 3\n",
             "repoA/.hidden/h.py": "h = 1\n", "repoA/README.md": "# A\n", "repoB/main.py": "b = 1\nc = 2",
             "repoB/notes.txt": "not python"}
    for rel, text in files.items():
        full = os.path.join(root, rel)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8") as fh:
            fh.write(text)
    return root


def test_scan_includes_names_spark_hides(spark):
    root = _tree()
    got = {(r.repo_id, r.path): r.content for r in scan_source_tree(spark, root).collect()}
    assert set(got) == {("repoA", "pkg/__init__.py"), ("repoA", "pkg/_priv.py"), ("repoA", "pkg/mod.py"),
                        ("repoA", ".hidden/h.py"), ("repoB", "main.py")}
    assert got[("repoA", "pkg/__init__.py")] == "x = 1\n"
    stats = {r.repo_id: (r.n_files, r.n_lines) for r in file_line_stats(scan_source_tree(spark, root)).collect()}
    assert stats["repoB"] == (1, 2)
    one = {r.path for r in scan_source_tree(spark, {"only": os.path.join(root, "repoA")}).collect()}
    assert "pkg/__init__.py" in one and "pkg/mod.py" in one


def test_readme_and_refs(spark):
    root = _tree()
    files = scan_source_tree(spark, root, glob="*")
    r = {x.repo_id: (x.readme_path, x.found) for x in pick_readme(files).collect()}
    assert r == {"repoA": ("README.md", True), "repoB": ("none", False)}
    refs = spark.createDataFrame([("https://github.com/o/r.git",), ("o/r",), ("https://gitlab.com/a/b",), ("/x/y",), ("o/r\n",)],
                                 "ref string")
    rows = {(x.owner, x.repo, x.clone_url): x.n for x in repo_ref_rollup(refs).collect()}
    assert rows[("o", "r", "https://github.com/o/r.git")] == 2 and rows[(None, None, None)] == 2
    assert rows[("o", "r\n", "https://github.com/o/r\n.git")] == 1  # [^/]+ takes the newline, as in the audited tool


def test_invalid_utf8_is_replaced(spark, tmp_path):
    from auditlens.sources.files import scan_source_tree
    (tmp_path / "repo").mkdir()
    (tmp_path / "repo" / "latin.py").write_bytes(b"# caf\xe9\nx = 1\n")
    (tmp_path / "repo" / "__init__.py").write_bytes(b"# caf\xe9\n")
    got = {r.path: r.content for r in scan_source_tree(spark, str(tmp_path)).collect()}
    assert got == {"latin.py": "# caf�\nx = 1\n", "__init__.py": "# caf�\n"}


def test_roots_with_and_without_scheme_agree(spark, tmp_path):
    names = ["a.py", "_metadata.py", "_x=y.py", "_p.py", "d/e/f/g/__init__.py", "d/e/f/g/h.py", ".h/i.py", "_metadata/j.py",
             "empty.py"]
    text = lambda repo, name: "" if name == "empty.py" else f"{repo}/{name}"
    for repo in ("r1", "_r2"):
        for name in names:
            full = tmp_path / "with space" / repo / name
            full.parent.mkdir(parents=True, exist_ok=True)
            full.write_text(text(repo, name))
    (tmp_path / "with space" / "loose.py").write_text("above every repository")
    root = str(tmp_path / "with space")
    want = sorted((repo, name, text(repo, name)) for repo in ("r1", "_r2") for name in names)
    for given in (root, root + "/", "file://" + root, "file:" + root):
        assert sorted(map(tuple, scan_source_tree(spark, given).collect())) == want
    given = {"one": root + "/r1", "two": "file://" + root + "/_r2", "again": root + "/r1/", "inner": root + "/r1/d"}
    got = sorted((r.repo_id, r.path) for r in scan_source_tree(spark, given).collect())
    assert got == sorted([(rid, n) for rid in ("one", "two", "again") for n in names]
                         + [("inner", "e/f/g/__init__.py"), ("inner", "e/f/g/h.py")])
    assert scan_source_tree(spark, {}).count() == 0


def test_many_files_in_one_deep_directory_are_read_by_many_tasks(spark, tmp_path):
    """2 000 hidden files of uneven size eight levels down: batches of about equal bytes."""
    from auditlens.sources.files import _listed, read_batches
    deep = tmp_path / "repo" / "a" / "b" / "c" / "d" / "e" / "f" / "g"
    deep.mkdir(parents=True)
    for i in range(2000):
        (deep / f"_m{i:04}.py").write_text("x" * (20_000 if i % 100 == 0 else 10))
    (deep / "up").symlink_to(tmp_path / "repo")  # a loop
    root = spark.createDataFrame([("", f"file:{tmp_path}")], "repo_id string, uri string")
    found = _listed(spark, root, "*.py", 1)
    assert found.count() == 2000
    sizes = [r.b for r in read_batches(found).groupBy(F.spark_partition_id()).agg(F.sum(F.col("size") + 4096).alias("b")).collect()]
    assert len(sizes) >= 4 and max(sizes) < 1.2 * sum(sizes) / len(sizes)
    got = scan_source_tree(spark, str(tmp_path))
    assert got.where("repo_id = 'repo' AND path LIKE 'a/b/c/d/e/f/g/_m%'").count() == 2000


def test_thousands_of_given_roots(spark, tmp_path):
    """A join finds the roots of a file; nested roots own it as well."""
    roots = {}
    for i in range(1200):
        d = tmp_path / f"g{i % 30}" / f"r{i}"
        d.mkdir(parents=True)
        (d / "m.py").write_text(f"x = {i}")
        if i % 100 == 0:
            (d / "__init__.py").write_text("")
        roots[f"repo{i}"] = str(d)
    roots["outer"] = str(tmp_path / "g0")
    out = scan_source_tree(spark, roots)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "map_contains_key" not in plan and "repo1199" not in plan.split("LocalRelation")[0]
    got = sorted((r.repo_id, r.path, r.content) for r in out.collect())
    want = [(f"repo{i}", "m.py", f"x = {i}") for i in range(1200)] + [(f"repo{i}", "__init__.py", "") for i in range(0, 1200, 100)]
    want += [("outer", f"r{i}/m.py", f"x = {i}") for i in range(0, 1200, 30)] + [("outer", f"r{i}/__init__.py", "") for i in range(0, 1200, 300)]
    assert got == sorted(want)


def _odd_documents(spark, tmp_path):
    rows = [(i, f"text {i}\nline") for i in range(130)] + [(7, "again"), (7, "again"), (51, None), (None, "a"), (None, "b"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_files_projection_has_the_rows_of_its_sql(spark, tmp_path):
    """Repeated and null doc_ids included; among rows of one path the numbers are interchangeable."""
    from auditlens.sources.tables import FX_SQL, fixture, table
    sf = _odd_documents(spark, tmp_path)
    got = fixture(spark, sf, "fx_files")
    table(spark, sf, "documents").createOrReplaceTempView("documents")
    want = spark.sql(FX_SQL["fx_files"])
    assert got.columns == want.columns and dict(got.dtypes)["file_ord"] == "bigint"
    for cols in (["doc_id", "repo_id"], ["repo_id", "path", "file_ord"]):
        assert sorted(map(repr, got.select(*cols).collect())) == sorted(map(repr, want.select(*cols).collect()))
    alone = "doc_id IS NOT NULL AND doc_id NOT IN (7, 51)"
    assert sorted(map(repr, got.where(alone).collect())) == sorted(map(repr, want.where(alone).collect()))
    odd = ["doc_id", "repo_id", "content"]
    assert sorted(map(repr, got.select(*odd).collect())) == sorted(map(repr, want.select(*odd).collect()))


def test_files_projection_moves_texts_once_and_sorts_none(spark, tmp_path):
    from auditlens.sources.tables import _files_projection, table
    docs = table(spark, _odd_documents(spark, tmp_path), "documents")
    plan = _files_projection(docs)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    nodes = [n for n in plan.split("\n\n") if n.lstrip().startswith("(")]
    with_text = [n.split(")")[1].split()[0] for n in nodes if "text#" in n]
    assert "Sort" not in with_text and "Window" not in with_text and with_text.count("Exchange") == 1


def test_map_projection_of_a_wide_read_is_not_dealt_out_again(spark, tmp_path):
    """As many tasks read the table as there are cores: each writes its rows as they come."""
    from auditlens.sources.tables import fixture
    cores = spark.sparkContext.defaultParallelism
    spark.range(4000).selectExpr("id AS c_custkey", "id % 25 AS c_nationkey").repartition(2 * cores).write.parquet(str(tmp_path / "customer.parquet"))
    tasks = spark.read.parquet(str(tmp_path / "customer.parquet")).rdd.getNumPartitions()
    assert cores <= tasks < 2 * cores
    got = fixture(spark, str(tmp_path), "fx_refs")
    assert got.count() == 4000 and len(got.inputFiles()) == tasks


def test_files_are_listed_by_executors_alone(spark, tmp_path):
    """No file source whose index (a status a file) stands in the driver; globs as Spark reads them; numbers from the listing."""
    root = _tree()
    out = scan_source_tree(spark, root, glob="*.{py,txt}", with_ord=True)
    assert not [f for f in out.inputFiles() if not f.endswith(".parquet")]
    got = {(r.repo_id, r.path): (r.file_ord, r.content) for r in out.collect()}
    assert got == {("repoA", ".hidden/h.py"): (1, "h = 1\n"), ("repoA", "pkg/__init__.py"): (2, "x = 1\n"), ("repoA", "pkg/_priv.py"): (3, "y = 2\n"),
                   ("repoA", "pkg/mod.py"): (4, "z = 3\n"), ("repoB", "main.py"): (1, "b = 1\nc = 2"), ("repoB", "notes.txt"): (2, "not python")}
    inner = scan_source_tree(spark, {"all": root, "below": os.path.join(root, "repoA", ".hidden")})
    assert ("below", "h.py") in {(r.repo_id, r.path) for r in inner.collect()} and inner.where("repo_id = 'all'").count() == 5
