"""File-tree sources: scan, target selection, line stats, README pick, repo refs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlens.functions import dims
from auditlens.functions.slices import prefix_sum, rank_two_level
from auditlens.functions.text import line_count


#: Directories listed by one task of a round.
DIRS_PER_TASK = 200
#: Bytes of a read batch, and what opening a file counts.
READ_BYTES, OPEN_BYTES = 64 << 20, 4096


def _qualified(spark: SparkSession, root: str) -> str:
    """``root`` with scheme and authority, in the form Spark's ``path`` column has."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(path).toString().rstrip("/")


def _store(uri: str):
    """(file system, path in it) for a qualified path; used inside tasks."""
    from urllib.parse import quote

    from pyarrow import fs as pafs

    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    return pafs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}")


def _listed(spark: SparkSession, roots: DataFrame, glob: str, repo_depth: int) -> DataFrame:
    """(repo_id, path, uri, size) of the files that match ``glob``, by a frontier of directories.

    ``roots``: (repo_id, uri), repo_id '' where the first ``repo_depth`` levels
    name it.  A round lists the directories found by the round before, one
    directory per row, dealt out anew, until no directory is left; its result is
    written, so no directory is listed twice.  One round per level of depth.
    """
    import re
    import uuid

    from auditlens.functions.plan import cut_lineage
    from auditlens.session import ship_package

    ship_package(spark)
    run = f"listing/{uuid.uuid4().hex[:12]}"
    schema = "repo_id string, path string, uri string, is_dir boolean, size long"
    columns = ["repo_id", "path", "uri", "is_dir", "size"]
    # the glob as Spark's pathGlobFilter reads it
    matches = re.compile(spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern(), re.DOTALL)

    def lister(naming: bool):
        def work(it):
            import os

            import pandas as pd
            from pyarrow import fs as pafs

            for pdf in it:
                rows = []
                for rid, path, uri in pdf[["repo_id", "path", "uri"]].itertuples(index=False):
                    store, base = _store(uri)
                    for info in store.get_file_info(pafs.FileSelector(base, recursive=False)):
                        rel = info.path[len(base.rstrip("/")) + 1:]
                        at, below = f"{uri}/{rel}", info.type == pafs.FileType.Directory
                        if below and isinstance(store, pafs.LocalFileSystem) and os.path.islink(info.path) \
                                and (base + "/").startswith(os.path.realpath(info.path).rstrip("/") + "/"):
                            continue  # a link to a directory above it
                        full = f"{path}/{rel}" if path else rel
                        if naming:
                            if below:
                                rows.append((f"{rid}/{rel}" if rid else rel, "", at, True, 0))
                        elif below:
                            rows.append((rid, full, at, True, 0))
                        elif info.type == pafs.FileType.File and matches.fullmatch(info.base_name):
                            rows.append((rid, full, at, False, info.size))
                yield pd.DataFrame(rows, columns=columns)
        return work

    frontier, parts, level = roots.select("repo_id", F.lit("").alias("path"), "uri"), [], 0
    waiting = frontier.count()
    while waiting:
        tasks = max(spark.sparkContext.defaultParallelism, -(-waiting // DIRS_PER_TASK))
        round_ = cut_lineage(frontier.repartition(tasks, "repo_id", "uri").mapInPandas(lister(level < repo_depth), schema), f"{run}/level{level}")
        parts.append(round_.where(~F.col("is_dir")).select("repo_id", "path", "uri", "size"))
        frontier = round_.where(F.col("is_dir")).select("repo_id", "path", "uri")
        waiting, level = frontier.count(), level + 1
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "repo_id string, path string, uri string, size long")


def read_batches(files: DataFrame, batch_bytes: int = READ_BYTES) -> DataFrame:
    """``files`` (.., uri, size) dealt out in batches of about equal bytes, whatever directories they are in.

    The batch follows from the running sum of the sizes, so it is fixed by the
    rows themselves.  A file counts some bytes for being opened.
    """
    weighed = files.withColumn("_weight", F.col("size") + F.lit(OPEN_BYTES)).withColumn("_at", F.concat_ws("\0", "uri", "repo_id"))
    total = weighed.agg(F.sum("_weight")).first()[0] or 0
    batches = max(files.sparkSession.sparkContext.defaultParallelism, -(-total // batch_bytes))
    run = prefix_sum(weighed, [], "_at", "_weight", "_run", inclusive=False)
    return run.repartitionById(batches, F.floor(F.col("_run") * batches / F.lit(max(1, total))).cast("int")).drop("_weight", "_at", "_run")


def _read_files(listed: DataFrame) -> DataFrame:
    """``content`` in place of (uri, size), read by a map over rows; invalid UTF-8 is replaced."""
    kept = [c for c in listed.columns if c not in ("uri", "size")]

    def reader(it):
        for pdf in it:
            texts = []
            for uri in pdf["uri"]:
                store, path = _store(uri)
                with store.open_input_stream(path) as fh:
                    texts.append(fh.read())
            yield pdf[kept].assign(content=texts)

    schema = ", ".join(f"{c} {dict(listed.dtypes)[c]}" for c in kept)
    return (read_batches(listed).mapInPandas(reader, f"{schema}, content binary")
            .withColumn("content", F.make_valid_utf8(F.col("content").cast("string"))))


def scan_source_tree(spark: SparkSession, root: str | dict, glob: str = "*.py",
                     repo_depth: int = 1, with_ord: bool = False) -> DataFrame:
    """Recursive scan of source files into ``files(repo_id, path, content)``.

    ``root`` is either one directory whose first ``repo_depth`` path levels
    name the repository, or a small ``{repo_id: dir}`` dict, on any store that
    ``pyarrow.fs`` opens; both are qualified first, and every path is taken
    relative to that.  Executors list the directories and read the files, those
    included that Spark's own listing skips (a leading '_' or '.', such as
    ``__init__.py``, and empty ones).  Spark's file sources keep the status of
    every file in the driver; here the listing is a written table, so the driver
    holds counts alone.  A file belongs to every given directory above it.
    Invalid UTF-8 is replaced.  ``file_ord`` (rank by path) is optional: all
    "first file" logic orders by ``path``, which needs no window over a possibly
    giant repository.
    """
    if isinstance(root, dict):
        if not root:
            return spark.createDataFrame([], "repo_id string, path string, content string" + (", file_ord bigint" if with_ord else ""))
        roots, repo_depth = [(rid, _qualified(spark, d)) for rid, d in root.items()], 0
    else:
        roots = [("", _qualified(spark, root))]
    listed = _listed(spark, spark.createDataFrame(roots, "repo_id string, uri string"), glob, repo_depth)
    if with_ord:  # numbered before any text is read
        listed = rank_two_level(listed, ["repo_id"], [F.col("path")], out="file_ord")
    out = _read_files(listed)
    return out.select("repo_id", "path", "content", *(["file_ord"] if with_ord else []))


def materialize_tree(files: DataFrame, root: str) -> None:
    """Write ``files(repo_id, path, content)`` as a directory tree under
    ``root`` (test inputs), from the executors, on the store of ``root``."""
    from auditlens.session import ship_package

    spark = files.sparkSession
    base = _qualified(spark, root)

    def write(it):
        store, top = _store(base)
        for pdf in it:
            for rid, path, content in zip(pdf["repo_id"], pdf["path"], pdf["content"]):
                full = f"{top}/{rid}/{path}"
                store.create_dir(full.rpartition("/")[0], recursive=True)
                with store.open_output_stream(full) as fh:
                    fh.write((content or "").encode("utf-8"))
            yield pdf.iloc[0:0][["repo_id"]]

    ship_package(spark)
    files.select("repo_id", "path", "content").mapInPandas(write, "repo_id string").count()


def scan_target(files: DataFrame, analyze_path: str | None = None) -> DataFrame:
    """Restrict to a sub-path.

    Adds ``is_single`` (the target names one file: it bypasses every later
    filter) and ``rel_path`` (path relative to the target directory, which is
    what exclusion rules look at).  No target keeps everything.
    """
    if not analyze_path:
        return files.withColumn("is_single", F.lit(False)).withColumn("rel_path", F.col("path"))
    t = analyze_path.strip("/")
    single = F.col("path") == F.lit(t)
    under = F.col("path").startswith(t + "/")
    return (files.filter(single | under)
            .withColumn("is_single", single)
            .withColumn("rel_path", F.when(single, F.col("path"))
                        .otherwise(F.expr(f"substring(path, {len(t) + 2})"))))


def file_line_stats(files: DataFrame, by=("repo_id",), content_col: str = "content") -> DataFrame:
    """Line count per file rolled up to files, lines and longest file per group.

    Lines are pieces between '\\n' (so '' is one line), counted as
    newlines + 1: no array is materialised.  A partial aggregate per task
    keeps the shuffle to one row per group per task.
    """
    n = line_count(F.col(content_col))
    return (files.select(*by, n.alias("_n"))
            .groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n_files"),
                 F.sum("_n").cast("bigint").alias("n_lines"),
                 F.max("_n").cast("bigint").alias("max_lines")))


def explode_lines(files: DataFrame, keys=("repo_id", "path"), content_col: str = "content") -> DataFrame:
    """File → one row per line: ``(*keys, line_no 1-based, line)``."""
    return files.select(*keys, F.posexplode(F.split(F.col(content_col), "\n", -1)).alias("_pos", "line")) \
        .select(*keys, (F.col("_pos") + 1).cast("bigint").alias("line_no"), "line")


def pick_readme(all_files: DataFrame) -> DataFrame:
    """One README per repository by candidate priority, else 'none'.

    Candidates sit at the repository root, so this is an equi-join of the
    file list with the 5-row priority table (broadcast), then ``min_by`` per
    repository; repositories without one come from a left join.
    """
    spark = all_files.sparkSession
    cand = F.broadcast(dims.readme_dim(spark))
    hits = (all_files.select("repo_id", "path", "content")
            .join(cand, F.col("path") == F.col("name"))
            .groupBy("repo_id")
            .agg(F.min_by(F.struct("path", "content"), F.col("prio")).alias("_r")))
    repos = all_files.select("repo_id").distinct()
    return (repos.join(hits, "repo_id", "left")
            .select("repo_id",
                    F.coalesce(F.col("_r.path"), F.lit("none")).alias("readme_path"),
                    F.col("_r.path").isNotNull().alias("found"),
                    F.coalesce(F.col("_r.content"), F.lit("")).alias("content")))


# Repository reference forms (fixed): URL containing github.com/<owner>/<repo>
# (repo stops at '/' or '.'), or a bare "<owner>/<repo>".
URL_RE = r"(?:https?://)?github\.com/([^/]+)/([^/.]+)(?:\.git)?"
SHORT_RE = r"^([^/]+)/([^/]+)\z"


def parse_repo_ref(ref) -> tuple:
    """Column expressions (owner, repo, clone_url); null when not a reference."""
    u_owner = F.nullif(F.regexp_extract(ref, URL_RE, 1), F.lit(""))
    u_repo = F.regexp_extract(ref, URL_RE, 2)
    s_owner = F.nullif(F.regexp_extract(ref, SHORT_RE, 1), F.lit(""))
    s_repo = F.regexp_extract(ref, SHORT_RE, 2)
    owner = F.coalesce(u_owner, s_owner)
    repo = F.when(u_owner.isNotNull(), u_repo).when(s_owner.isNotNull(), s_repo)
    url = F.when(owner.isNotNull(), F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo, F.lit(".git")))
    return owner, repo, url


def repo_ref_rollup(df: DataFrame, ref_col: str = "ref") -> DataFrame:
    """Parse repository references and count per (owner, repo, clone_url)."""
    owner, repo, url = parse_repo_ref(F.col(ref_col))
    return (df.select(owner.alias("owner"), repo.alias("repo"), url.alias("clone_url"))
            .groupBy("owner", "repo", "clone_url").agg(F.count(F.lit(1)).alias("n")))
