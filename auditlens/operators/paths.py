"""Path filters: exclusions, the plain file list, and discovery."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.functions import dims
from auditlens.sources.files import scan_target


def _any(cols):
    cols = list(cols)
    return reduce(or_, cols) if cols else F.lit(False)


def excluded_predicate(path_col: str = "rel_path", exclude=None, exclude_names=None,
                       include=None, strict_root: bool = False, suffix: str | None = ".py"):
    """Boolean column: True when the file is kept.

    * substrings of the lower-cased ``/path`` drop the file;
    * a directory component starting with '.' drops it;
    * case-sensitive substrings of the file name drop it;
    * files at the root are checked by name only (unless ``strict_root``);
    * ``include`` (optional) keeps only paths containing one of its substrings.
    All are string built-ins in one Catalyst predicate; directory exclusion is
    implied by substring on the full path, so no tree walk is needed.
    """
    exclude = dims.EXCLUDE_PATHS if exclude is None else exclude
    exclude_names = dims.EXCLUDE_NAMES if exclude_names is None else exclude_names
    p = F.col(path_col)
    rel = F.concat(F.lit("/"), F.lower(p))
    name = F.substring_index(p, "/", -1)
    is_root = ~p.contains("/")
    path_bad = _any([rel.contains(x) for x in exclude]) | p.rlike(r"(^|/)\.[^/]*/")
    name_bad = _any([name.contains(x) for x in exclude_names])
    keep = ~name_bad & ((is_root & F.lit(not strict_root)) | ~path_bad)
    if suffix:
        keep = p.endswith(suffix) & keep
    if include:
        keep = keep & _any([p.contains(x) for x in include])
    return keep


def filter_excluded_paths(files: DataFrame, exclude=None, exclude_names=None, include=None,
                          strict_root: bool = False, suffix: str | None = ".py",
                          path_col: str | None = None) -> DataFrame:
    """Keep source files that pass the path/name exclusions."""
    col = path_col or ("rel_path" if "rel_path" in files.columns else "path")
    return files.filter(excluded_predicate(col, exclude, exclude_names, include, strict_root, suffix))


def list_all_files(files: DataFrame, **kw) -> DataFrame:
    """The path-filtered list without content filter (feeds symbol lookup)."""
    return filter_excluded_paths(files, **kw)


def count_files(files: DataFrame, by=("repo_id",)) -> DataFrame:
    return files.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))


def discover_files(files: DataFrame, network_only: bool = True, analyze_path: str | None = None,
                   patterns=None) -> DataFrame:
    """Target → exclusions → optional network filter.

    A single-file target bypasses both the path and the content filter.
    Paths stay relative to the repository; exclusions look at the path
    relative to the target directory.
    """
    from auditlens.operators.patterns import network_predicate

    t = scan_target(files, analyze_path)
    keep = F.col("is_single") | excluded_predicate("rel_path")
    out = t.filter(keep)
    if network_only:
        out = out.filter(F.col("is_single") | network_predicate("content", patterns))
    return out.drop("rel_path")
