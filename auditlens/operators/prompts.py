"""Prompt tables: XML-tagged text built by projection and ordered string
aggregation; conversation history by a bounded row-frame window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlens.functions import dims
from auditlens.functions.slices import rank_two_level
from auditlens.operators.responses import JS_WS


#: Messages of one conversation in a window at a time.
HISTORY_BLOCK = 8192


def tag(name: str, body: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>"))


def file_code(path: Column, source: Column) -> Column:
    return tag("file_code", F.concat(F.lit("<file_path>"), path, F.lit("</file_path>\n<file_source>"),
                                     source, F.lit("</file_source>")))


def build_initial_prompts(files: DataFrame, instructions: str = dims.INITIAL_INSTRUCTIONS,
                          approach: str = dims.ANALYSIS_APPROACH, guidelines: str = dims.GUIDELINES,
                          response_format: str = dims.RESPONSE_FORMAT) -> DataFrame:
    """One prompt per file: code, instructions, approach, empty previous
    analysis, guidelines and response format, blank-line separated."""
    parts = [file_code(F.col("path"), F.col("content")),
             tag("instructions", F.lit(instructions)), tag("analysis_approach", F.lit(approach)),
             tag("previous_analysis", F.lit("")), tag("guidelines", F.lit(guidelines)),
             tag("response_format", F.lit(response_format))]
    keep = [c for c in files.columns if c != "content"]
    return files.select(*keep, F.concat_ws("\n\n", *parts).alias("prompt"))


def context_block(defs: Column) -> Column:
    """Ordered definitions → <context_code> text (empty tag when none)."""
    items = F.transform(defs, lambda d: F.concat(
        F.lit("<code>\n<name>"), d["name"], F.lit("</name>\n<context_name_requested>"), d["requested"],
        F.lit("</context_name_requested>\n<file_path>"), d["file_path"], F.lit("</file_path>\n<source>"),
        d["source"], F.lit("</source>\n</code>")))
    return F.when(F.size(defs) > 0, tag("context_code", F.array_join(items, "\n"))).otherwise(F.lit("<context_code></context_code>"))


def build_secondary_prompts(pairs: DataFrame, files: DataFrame, contexts: DataFrame | None = None,
                            approach: str = dims.ANALYSIS_APPROACH, guidelines: str = dims.GUIDELINES,
                            response_format: str = dims.RESPONSE_FORMAT) -> DataFrame:
    """One prompt per (file, vuln_type) pair.

    ``pairs``: repo_id, path, vuln_type, previous (JSON text of the last reply)
    and optionally ``ctx`` - the pair's own ordered definitions.
    ``contexts``: repo_id, path, ord, name, requested, file_path, source -
    the definitions gathered so far, in order.  Type template and example
    inputs come from the prompt table (broadcast); a type it lacks yields an
    error row instead of failing the job.
    """
    spark = pairs.sparkSession
    pd_ = F.broadcast(dims.prompt_dim(spark))
    base = pairs.join(files.select("repo_id", "path", "content"), ["repo_id", "path"])
    if "ctx" in pairs.columns:  # per-pair context already gathered (refinement rounds)
        base = base.withColumn("_defs", F.array_sort(F.col("ctx"))).drop("ctx")
    elif contexts is not None:
        ctx = (contexts.groupBy("repo_id", "path")
               .agg(F.array_sort(F.collect_list(F.struct("ord", "name", "requested", "file_path", "source"))).alias("_defs")))
        base = base.join(ctx, ["repo_id", "path"], "left")
    else:
        base = base.withColumn("_defs", F.lit(None))
    defs = F.coalesce(F.col("_defs"), F.array().cast(
        "array<struct<ord:int,name:string,requested:string,file_path:string,source:string>>"))
    b = base.join(pd_, "vuln_type", "left")
    prompt = F.concat_ws("\n\n", file_code(F.col("path"), F.col("content")), context_block(defs),
                         tag("example_bypasses", F.array_join(F.col("bypasses"), "\n")),
                         tag("instructions", F.col("template")), tag("analysis_approach", F.lit(approach)),
                         tag("previous_analysis", F.coalesce(F.col("previous"), F.lit(""))),
                         tag("guidelines", F.lit(guidelines)), tag("response_format", F.lit(response_format)))
    ok = F.col("template").isNotNull()
    return b.select("repo_id", "path", "vuln_type",
                    F.when(ok, prompt).alias("prompt"),
                    F.when(~ok, F.concat(F.lit("Unknown vulnerability type: "), F.col("vuln_type"))).alias("error"))


def build_readme_prompts(readmes: DataFrame, instructions: str = dims.README_INSTRUCTIONS) -> DataFrame:
    """README text + instruction, for repositories that have one."""
    return (readmes.filter(F.col("found"))
            .select("repo_id", F.concat_ws("\n\n", tag("readme_content", F.col("content")),
                                           tag("instructions", F.lit(instructions))).alias("prompt")))


def build_system_prompts(repos: DataFrame, summaries: DataFrame | None = None,
                         instructions: str = dims.SYSTEM_INSTRUCTIONS) -> DataFrame:
    """Per repository: instruction + README summary ('No README available.')."""
    r = repos.select("repo_id").distinct()
    if summaries is not None:
        r = r.join(summaries.select("repo_id", "summary"), "repo_id", "left")
    else:
        r = r.withColumn("summary", F.lit(None).cast("string"))
    return r.select("repo_id", F.concat_ws("\n\n", tag("instructions", F.lit(instructions)),
                                           tag("readme_summary", F.coalesce("summary", F.lit(dims.NO_README))))
                    .alias("system_prompt"))


def readme_summaries(replies: DataFrame, text_col: str = "reply", tag_name: str = "summary",
                     keys=("repo_id",)) -> DataFrame:
    """First <tag>…</tag> (across lines, trimmed), else the whole reply; a
    missing reply (failed call) gives the fixed failure text."""
    t = F.col(text_col)
    inner = F.regexp_extract(t, f"(?s)<{tag_name}>(.*?)</{tag_name}>", 1)
    inner = F.regexp_replace(inner, f"^{JS_WS}+|{JS_WS}+$", "")
    s = F.when(t.isNull(), F.lit(dims.README_FAILED)).when(inner != "", inner).otherwise(t)
    return replies.select(*keys, s.alias("summary"))


def history_window(messages: DataFrame, depth: int = 5, chars: int = 2000, keys=("conv_id",),
                   order: str = "turn", prefill_hint: bool = False) -> DataFrame:
    """Prompt with conversation context for each user turn.

    History = the conversation's user/assistant messages.  When it holds more
    than two messages (the current one included), the up-to-``depth``
    preceding ones, each cut to ``chars`` characters and wrapped in
    <role>…</role>, are prefixed inside <conversation_context>.

    Positions come from the two-level rank.  Blocks of ``HISTORY_BLOCK``
    positions are windows of their own; the last ``depth`` messages of a block
    are copied to the next one (the halo), so a frame of ``depth`` rows finds
    everything it needs and no conversation is one window partition.  ``order``
    must be unique within a conversation.
    """
    keys, size = list(keys), max(HISTORY_BLOCK, depth)
    h = rank_two_level(messages.filter(F.col("role").isin("user", "assistant")), keys, [F.col(order)], out="_n")
    item = F.concat(F.lit("<"), F.col("role"), F.lit(">"), F.substring(F.col("text"), 1, chars),
                    F.lit("</"), F.col("role"), F.lit(">"))
    own = F.floor((F.col("_n") - 1) / size)
    edge = F.pmod(F.col("_n") - 1, F.lit(size)) >= size - depth
    blocks = h.withColumn("_m", item).withColumn("_own", own).withColumn("_block", F.explode(
        F.when(edge, F.array(own, own + 1)).otherwise(F.array(own))))
    frame = Window.partitionBy(*keys, "_block").orderBy("_n").rowsBetween(-depth, -1)
    users = (blocks.withColumn("_prev", F.collect_list("_m").over(frame))
             .filter((F.col("_block") == F.col("_own")) & (F.col("role") == "user")))
    prev = F.col("_prev")
    base = F.col("text")
    if prefill_hint:
        base = F.concat(base, F.lit("\n\nIMPORTANT: Begin your JSON response starting with: " + dims.PREFILL))
    ctx_txt = F.when((F.col("_n") > 2) & (F.size(prev) > 0), F.array_join(prev, "\n"))
    full = F.when(ctx_txt.isNotNull(), F.concat(F.lit("<conversation_context>\n"), ctx_txt,
                                                F.lit("\n</conversation_context>\n\n"), base)).otherwise(base)
    return users.select(*keys, order, ctx_txt.alias("context"), full.alias("prompt"))
