"""Resume state as tables: pending set, latest-wins upserts, progress,
resumable scans, state-record normalisation and option precedence."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.functions.plan import cut_lineage
from auditlens.operators.responses import JS_WS

NOT_STARTED = "not_started"


def recorded(state: DataFrame) -> DataFrame:
    """The entries of files that a scan has begun with; 'not_started' says the same as no entry."""
    return state.filter(F.col("status") != NOT_STARTED)


def pending_files(files: DataFrame, state: DataFrame, keys=("repo_id", "path")) -> DataFrame:
    """Files still to analyse: the list minus completed entries (anti-join)."""
    done = state.filter(F.col("status") == "complete").select(*keys)
    return files.join(done, list(keys), "left_anti")


def mark_complete(state: DataFrame, updates: DataFrame, keys=("repo_id", "path"),
                  name: str | None = None) -> DataFrame:
    """Idempotent upsert: latest ``updated_at`` wins per key, 'complete' beats
    'pending' at equal times.  Updates for files skipped by the budget or
    unreadable simply carry status 'pending'.  With ``name`` the new state is
    written to a version folder of its own below ``name`` in the shared
    checkpoint folder; the version it was read from is never touched."""
    both = recorded(state).select(*keys, "status", "updated_at").unionByName(updates.select(*keys, "status", "updated_at"))
    rank = F.when(F.col("status") == "complete", F.lit(1)).otherwise(F.lit(0))
    out = (both.groupBy(*keys)
           .agg(F.max_by(F.struct("status", "updated_at"), F.struct("updated_at", rank.alias("r"))).alias("_w"))
           .select(*keys, "_w.status", "_w.updated_at"))
    return cut_lineage(out, f"{name}/{uuid.uuid4().hex}") if name else out


def progress_summary(state: DataFrame, repos: DataFrame | None = None, by=("repo_id",)) -> DataFrame:
    """not_started / in_progress / complete, totals and percent (1 decimal, half up)."""
    agg = recorded(state).groupBy(*by).agg(F.count(F.lit(1)).alias("total_files"),
                                           F.count_if(F.col("status") == "complete").alias("completed_files"),
                                           F.count_if(F.col("status") != "complete").alias("pending_files"))
    if repos is not None:
        agg = repos.select(*by).distinct().join(agg, list(by), "left")
    tot = F.coalesce("total_files", F.lit(0))
    pct = F.when(tot > 0, F.expr("(completed_files * 2000 + total_files) div (2 * total_files)").cast("double") / 10.0) \
        .otherwise(F.lit(0.0))
    status = (F.when(F.col("total_files").isNull(), F.lit(NOT_STARTED))
              .when(F.col("pending_files") > 0, F.lit("in_progress")).otherwise(F.lit("complete")))
    return agg.select(*by, status.alias("status"), tot.cast("bigint").alias("total_files"),
                      F.coalesce("completed_files", F.lit(0)).cast("bigint").alias("completed_files"),
                      F.coalesce("pending_files", F.lit(0)).cast("bigint").alias("pending_files"),
                      pct.alias("progress_percent"))


def resumable_scans(state: DataFrame, by=("repo_id",)) -> DataFrame:
    """Scans with at least one pending file."""
    return (recorded(state).groupBy(*by).agg(F.count_if(F.col("status") != "complete").alias("pending"))
            .filter(F.col("pending") > 0))


STATE_SCHEMA = ("completedFiles array<string>, completed_files array<string>, pendingFiles array<string>, "
                "pending_files array<string>, currentFile string, current_file string, repoPath string, "
                "repo_path string, model string, startedAt string, started_at string, lastUpdated string, "
                "last_updated string, version string, results string, costTrackerData string, cost_tracker_data string")


def normalize_state(records: DataFrame, text_col: str = "json", legacy_version_keys: tuple[str, ...] = ()) -> DataFrame:
    """camelCase or snake_case state records → one schema with defaults.

    ``results`` (default '[]') and ``cost_tracker_data`` stay JSON text.
    ``legacy_version_keys``: names under which older writers kept the version.
    """
    s = F.from_json(F.col(text_col), ", ".join([STATE_SCHEMA, *(f"`{k}` string" for k in legacy_version_keys)]))
    pick = lambda a, b: F.coalesce(s[a], s[b])
    keep = [c for c in records.columns if c != text_col]
    return records.select(
        *keep,
        F.coalesce(pick("completedFiles", "completed_files"), F.array().cast("array<string>")).alias("completed_files"),
        F.coalesce(pick("pendingFiles", "pending_files"), F.array().cast("array<string>")).alias("pending_files"),
        pick("currentFile", "current_file").alias("current_file"),
        pick("repoPath", "repo_path").alias("repo_path"),
        s["model"].alias("model"),
        pick("startedAt", "started_at").alias("started_at"),
        pick("lastUpdated", "last_updated").alias("last_updated"),
        F.coalesce(s["results"], F.lit("[]")).alias("results"),
        pick("costTrackerData", "cost_tracker_data").alias("cost_tracker_data"),
        F.coalesce(s["version"], *[s[k] for k in legacy_version_keys], F.lit("1.0.0")).alias("version"))


# ---------------------------------------------------------------------------
# Options
# ---------------------------------------------------------------------------

DEFAULTS = {"budget": None, "min_confidence": 5.0, "max_iterations": 7.0, "model": None, "provider": None}


def config_entries(text: Column) -> Column:
    """'key: value' lines → array<struct(k, v)>; comments and blank lines
    skipped, 'null'/'~' → null value."""
    trim = lambda x: F.regexp_replace(x, f"^{JS_WS}+|{JS_WS}+$", "")
    lines = F.transform(F.split(text, "\n", -1), trim)
    kv = F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & (F.instr(x, ":") > 0))
    return F.transform(kv, lambda x: F.struct(
        trim(F.substring_index(x, ":", 1)).alias("k"),
        F.when(trim(F.substring(x, F.instr(x, ":") + 1, F.lit(1 << 30))).isin("null", "~"), F.lit(None))
         .otherwise(trim(F.substring(x, F.instr(x, ":") + 1, F.lit(1 << 30)))).alias("v")))


def config_get(entries: Column, key: str) -> Column:
    """Value of the last line with ``key`` (later lines win)."""
    return F.try_element_at(F.filter(entries, lambda e: e["k"] == key), F.lit(-1))["v"]


def _num(v: Column) -> Column:
    """Numeric text ('12', '0.5') → double; anything else → null."""
    return F.when(v.rlike(r"^\d+(\.\d+)?$"), v.cast("double"))


def _json_list(v: Column) -> Column:
    """JSON array text → array<string>; anything else → null."""
    return F.when(F.ltrim(v).startswith("["), F.from_json(v, "array<string>"))


def resolve_scan_options(options: DataFrame, cfg_col: str = "cfg_text") -> DataFrame:
    """Per repository: input > config (nested section > flat key) > default.

    Input columns (nullable): in_budget, in_min_confidence, in_max_iterations,
    in_types (comma list; empty does not override), in_provider, in_model.
    The config is 'key: value' text or a JSON object with optional
    cost/llm/analysis sections; lists (vuln_types, exclude_paths,
    include_paths) need the JSON form.  An empty provider or model does not
    override, an empty list does.  Later duplicate keys win, as in a plain
    key/value parse.  ``vuln_types`` is a comma list, '' for all types.
    """
    c = F.col(cfg_col)
    is_json = F.regexp_replace(c, f"^{JS_WS}+", "").startswith("{")
    m = config_entries(c)
    j = lambda path: F.get_json_object(c, path)
    flat = lambda k: F.when(is_json, j(f"$.{k}")).otherwise(config_get(m, k))
    nested = lambda sec, k: F.when(is_json, j(f"$.{sec}.{k}"))
    cols = options.columns
    inp = lambda k: F.col(k) if k in cols else F.lit(None)
    text = lambda v: F.nullif(v.cast("string"), F.lit(""))
    names = lambda k: F.coalesce(_json_list(nested("analysis", k)), F.when(is_json, _json_list(j(f"$.{k}"))),
                                 F.array().cast("array<string>"))
    budget = F.coalesce(inp("in_budget").cast("double"), _num(nested("cost", "budget")), _num(flat("budget")))
    minc = F.coalesce(inp("in_min_confidence").cast("double"), _num(nested("analysis", "confidence_threshold")),
                      _num(flat("confidence_threshold")), F.lit(DEFAULTS["min_confidence"]))
    maxi = F.coalesce(inp("in_max_iterations").cast("double"), _num(nested("analysis", "max_iterations")),
                      _num(flat("max_iterations")), F.lit(DEFAULTS["max_iterations"]))
    provider = F.coalesce(text(inp("in_provider")), text(nested("llm", "provider")), text(flat("provider")))
    model = F.coalesce(text(inp("in_model")), text(nested("llm", "model")), text(flat("model")))
    types = F.coalesce(text(inp("in_types")), F.array_join(names("vuln_types"), ","))
    dry_run = F.coalesce(~flat("dry_run").isin("false", "0", ""), F.lit(False))
    return options.select(
        "repo_id", budget.alias("budget"), minc.alias("min_confidence"), maxi.alias("max_iterations"),
        provider.alias("provider"), model.alias("model"), types.alias("vuln_types"), dry_run.alias("dry_run"),
        names("include_paths").alias("include_paths"), names("exclude_paths").alias("exclude_paths"))
