"""Symbol lookup: definition index, definition blocks, request resolution.

The audited tool answers each request by scanning every file in order.
Here the work is set-oriented:

* ``definition_index`` finds every ``class X`` / ``[async] def x`` line once
  (one pass over exploded lines, pipelined in codegen; only the path and
  the matching lines survive);
* ``definition_blocks`` finds the ends of all blocks of a file together, in one
  pass over its lines with a monotonic stack: map-only, each file split once;
* ``resolve_definition`` is an equi-join of request targets with the index
  on (repo, kind, name) plus ``min_by`` (file order, pattern order, line);
* ``resolve_reference`` answers the leftovers: wanted names meet the distinct
  words of all files by the rarest gram of each name, verified by ``contains``;
  the words that hold a name then have an inverted index of each repository with
  the first file they stand in.

Both kinds of answers are first decided on narrow tables (ids, file order, line
numbers).  These are written once, so the planner knows their size when they meet
the file texts: it streams the texts past them, and each file that holds an
answer is split once for all of its answers.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.functions.plan import cut_lineage
from auditlens.functions.text import grams
from auditlens.operators.responses import JS_WS

CLASS_RE = r"^\s*class\s+([^\s:(]+)\s*[:(]"
DEF_RE = r"^\s*(?:async\s+)?def\s+([^\s(]+)\s*\("
BLOCK_CAP = 150
REF_BEFORE, REF_AFTER = 20, 30
#: The characters of ``JS_WS``, for trimming.
WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Gram lengths.  A name is looked up by the longest that fits: over half of it,
#: so few words share it (up to twice the last length).
GRAMS = (1, 2, 4, 8, 16)
#: Answers taken from one split of a file.
ANSWERS_PER_SPLIT = 256


def _order_col(files: DataFrame) -> str:
    return "file_ord" if "file_ord" in files.columns else "path"


def _written(df: DataFrame, name: str) -> DataFrame:
    return cut_lineage(df, f"symbols/{name}-{uuid.uuid4().hex[:12]}")


def _bind(value: Column, fn) -> Column:
    """``fn`` of a value that is evaluated once, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def definition_index(files: DataFrame) -> DataFrame:
    """(repo_id, path, file_ord, line_no, kind, name, indent) for definition lines.

    One scan and one ``posexplode``; only lines containing 'class' or 'def'
    reach the regexes, and each kind found on a line becomes a row.
    """
    ordc = _order_col(files)
    keep = ["repo_id", "path"] + (["file_ord"] if ordc == "file_ord" else [])
    lines = (files.select(*keep, F.posexplode(F.split("content", "\n", -1)).alias("_pos", "line"))
             .filter(F.col("line").contains("class") | F.col("line").contains("def")))
    kinds = F.filter(F.array(F.struct(F.lit("class").alias("kind"), F.regexp_extract("line", CLASS_RE, 1).alias("name")),
                             F.struct(F.lit("def").alias("kind"), F.regexp_extract("line", DEF_RE, 1).alias("name"))),
                     lambda k: k["name"] != "")
    return (lines.select(*keep, (F.col("_pos") + 1).cast("bigint").alias("line_no"), "line", F.explode(kinds).alias("_k"))
            .select(*keep, "line_no", "_k.kind", "_k.name",
                    F.length(F.regexp_extract("line", "^" + JS_WS + "*", 0)).alias("indent")))


def _marks(lines: Column) -> Column:
    """Per non-blank line: number, indent, and kind and name of the definition on it ('' if none)."""
    def mark(line, i):
        return _bind(F.ltrim(line, F.lit(WS_CHARS)), lambda t: F.struct(
            (i + 1).cast("bigint").alias("line_no"), (F.length(line) - F.length(t)).alias("indent"), (t == "").alias("blank"),
            F.when(t.startswith("class"), F.lit("class")).otherwise(F.lit("def")).alias("kind"),
            F.when(t.startswith("class"), F.regexp_extract(line, CLASS_RE, 1))
             .when(t.startswith("def") | t.startswith("async"), F.regexp_extract(line, DEF_RE, 1)).otherwise(F.lit("")).alias("name")))
    return F.filter(F.transform(lines, mark), lambda m: ~m["blank"])


def _block_ends(lines: Column) -> Column:
    """Definitions of a file with ``stop``, the next non-blank line indented no deeper (null: none).

    Lines are taken from the last to the first.  The stack holds, by ascending
    depth in the file, the lines that may still end a block: one that is indented
    deeper than the line at hand ends no block above it and leaves.
    """
    start = F.struct(F.array().cast("array<struct<line_no:bigint,indent:int>>").alias("stack"),
                     F.array().cast("array<struct<line_no:bigint,kind:string,name:string,indent:int,stop:bigint>>").alias("found"))

    def step(state, m):
        return _bind(F.filter(state["stack"], lambda e: e["indent"] <= m["indent"]), lambda stack: F.struct(
            F.concat(F.array(F.struct(m["line_no"].alias("line_no"), m["indent"].alias("indent"))), stack).alias("stack"),
            F.when(m["name"] != "", F.concat(state["found"], F.array(F.struct(
                m["line_no"].alias("line_no"), m["kind"].alias("kind"), m["name"].alias("name"), m["indent"].alias("indent"),
                F.get(stack, F.lit(0))["line_no"].alias("stop"))))).otherwise(state["found"]).alias("found")))

    return F.aggregate(F.reverse(_marks(lines)), start, step, lambda state: state["found"])


def _block_text(lines: Column, line_no: Column, stop: Column, cap: int) -> Column:
    """The definition line and what follows up to ``stop`` (blank lines kept), at most ``cap`` lines after the first."""
    last = F.when(stop.isNotNull() & (stop <= line_no + cap), stop - 1).otherwise(F.least(F.size(lines), line_no + cap))
    return F.array_join(F.slice(lines, line_no.cast("int"), (last - line_no + 1).cast("int")), "\n")


def definition_blocks(files: DataFrame, cap: int = BLOCK_CAP) -> DataFrame:
    """Every definition with its body: repo_id, path, line_no, kind, name, indent, source.

    Map-only; each file is split once whatever its number of definitions.
    """
    keep = [c for c in ("repo_id", "path", "file_ord") if c in files.columns]
    blocks = _bind(F.split("content", "\n", -1), lambda lines: F.transform(_block_ends(lines), lambda d: F.struct(
        d["line_no"].alias("line_no"), d["kind"].alias("kind"), d["name"].alias("name"), d["indent"].alias("indent"),
        _block_text(lines, d["line_no"], d["stop"], cap).alias("source"))))
    return files.select(*keep, F.explode(blocks).alias("_b")).select(*keep, "_b.*")


def definition_block(defs: DataFrame, files: DataFrame, cap: int = BLOCK_CAP) -> DataFrame:
    """Attach ``source`` (the body) to rows of the definition index of ``files``."""
    wanted = defs.select("repo_id", F.col("path").alias("_o"), F.lit("definition").alias("how"), "line_no", F.lit("").alias("base"))
    found = _sources(files, wanted, "path", cap=cap).select("repo_id", "path", "line_no", "source")
    return defs.join(found, ["repo_id", "path", "line_no"])


def request_parts(requests: DataFrame, name_col: str = "name") -> DataFrame:
    """Split names on '.' (empty parts kept, like a plain string split)."""
    return requests.withColumn("_parts", F.split(F.col(name_col), r"\.", -1))


def _targets(req: DataFrame) -> DataFrame:
    """(request, kind, target, pat_ord): one part → class p1, def p1;
    two parts → class p1, def p2; three or more → none."""
    n = F.size("_parts")
    p1, p2 = F.element_at("_parts", 1), F.element_at("_parts", 2)
    t = F.when(n == 1, F.array(F.struct(F.lit("class").alias("kind"), p1.alias("target"), F.lit(1).alias("pat_ord")),
                               F.struct(F.lit("def").alias("kind"), p1.alias("target"), F.lit(2).alias("pat_ord"))))
    t = t.when(n == 2, F.array(F.struct(F.lit("class").alias("kind"), p1.alias("target"), F.lit(1).alias("pat_ord")),
                               F.struct(F.lit("def").alias("kind"), p2.alias("target"), F.lit(2).alias("pat_ord"))))
    return req.select("request_id", "repo_id", F.explode(t).alias("_t")).select("request_id", "repo_id", "_t.*")


def _first_definitions(requests: DataFrame, defs: DataFrame) -> DataFrame:
    """(request_id, repo_id, _o, path, line_no, kind) of the first definition of each request that has one."""
    ordc = _order_col(defs)
    first = (defs.groupBy("repo_id", "kind", F.col("name").alias("target"))
             .agg(F.min_by(F.struct("path", "line_no", F.col(ordc).alias("o")),
                           F.struct(F.col(ordc).alias("o"), F.col("line_no"))).alias("_d"))
             .select("repo_id", "kind", "target", "_d.*"))
    hits = _targets(request_parts(requests)).join(first, ["repo_id", "kind", "target"])
    key = F.struct(F.col("o"), F.col("pat_ord"), F.col("line_no"))
    return (hits.groupBy("request_id", "repo_id").agg(F.min_by(F.struct(F.col("o").alias("_o"), "path", "line_no", "kind"), key).alias("_w"))
            .select("request_id", "repo_id", "_w.*"))


def resolve_definition(requests: DataFrame, defs: DataFrame) -> DataFrame:
    """First definition per request by (file order, pattern order, line).

    The pattern order is fixed by the kind (class before def), so the index
    is first reduced to the earliest definition per (repo, kind, name) - a
    partial+final aggregate - and each request then meets at most two
    candidates: no (request x definition) pairs for popular names.
    Exact for names whose parts hold no whitespace, ':' or '(' (every Python
    identifier): such a name matches a definition line's pattern iff it
    equals the line's extracted name.
    """
    return _first_definitions(requests, defs).select("request_id", F.col("path").alias("file_path"), "line_no", "kind")


# -- references ------------------------------------------------------------------
# A name is looked for among the units it cannot reach beyond: maximal runs of
# identifier characters if it has only such, else runs without a blank, else lines.
_UNITS = {
    "identifier": (r"^[A-Za-z0-9_]+$", lambda c: F.regexp_extract_all(c, F.lit("[A-Za-z0-9_]+"), F.lit(0))),
    "run": (r"^[^ \t\n]+$", lambda c: F.split(c, "[ \t\n]+", -1)),
    "line": (r"^[^\n]+$", lambda c: F.split(c, "\n", -1)),
}


def _unit_kind(base: Column) -> Column:
    return reduce(lambda c, k: c.when(base.rlike(_UNITS[k][0]), F.lit(k)), list(_UNITS)[1:],
                  F.when(base.rlike(_UNITS["identifier"][0]), F.lit("identifier")))


def _unit_rows(files: DataFrame, kind: str, least: int, *keep) -> DataFrame:
    """The units of each file, of ``least`` characters and more, beside ``keep``; distinct inside a file before they are exploded."""
    units = F.array_distinct(_UNITS[kind][1](F.col("content")))
    return files.select(*keep, F.explode(units).alias("unit")).where(F.length("unit") >= least)


def reference_index(files: DataFrame, kind: str = "identifier", least: int = 1, among: DataFrame | None = None) -> DataFrame:
    """(repo_id, unit, _o): distinct units, of ``least`` characters and more, of each repository with the first file they stand in.

    ``among`` (unit) names the units to index; all by default.  The others are
    dropped as they are read, where ``among`` is small enough to broadcast.
    Units are aggregated in part before the shuffle, so what moves is vocabulary, not text.
    """
    units = _unit_rows(files, kind, least, "repo_id", F.col(_order_col(files)).alias("_o"))
    if among is not None:
        units = units.join(among, "unit", "left_semi")
    return units.groupBy("repo_id", "unit").agg(F.min("_o").alias("_o"))


def _first_references(names: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, base, _o): first file that holds each wanted (repo_id, base) on one of its lines.

    Which unit holds which name does not depend on the repository: it is found on
    the distinct units of all files together, a small part of the text.  Only
    units that hold a name are then indexed by repository.
    """
    wanted = _written(names.select("repo_id", "base", F.coalesce(_unit_kind(F.col("base")), F.when(F.col("base") == "", F.lit("empty"))).alias("kind"),
                                   reduce(lambda c, n: F.when(F.length("base") >= n, n).otherwise(c), GRAMS, F.lit(0)).alias("size")), "names")
    ordc = _order_col(files)
    found = [files.select("repo_id", F.lit("").alias("base"), F.col(ordc).alias("_o")).where(F.lit(False))]
    # at most 3 kinds x 5 sizes, and the empty name, which is found at once
    shapes = wanted.where("kind is not null").groupBy("kind", "size").agg(F.min(F.length("base")).alias("least")).collect()
    if any(r["kind"] == "empty" for r in shapes):
        found.append(wanted.where("kind = 'empty'").join(files.where("content is not null").groupBy("repo_id").agg(F.min(ordc).alias("_o")), "repo_id")
                     .select("repo_id", "base", "_o"))
    for kind in sorted({r["kind"] for r in shapes} - {"empty"}):
        sizes = sorted(r["size"] for r in shapes if r["kind"] == kind)
        least = min(r["least"] for r in shapes if r["kind"] == kind)
        mine = wanted.where(F.col("kind") == kind).select("repo_id", "base", "size")
        parts = (mine.select("base", "size").distinct()
                 .select("base", F.explode(reduce(lambda c, n: F.when(F.col("size") == n, grams(F.col("base"), n)).otherwise(c), sizes, F.array().cast("array<string>"))).alias("gram")))
        # postings of the wanted grams alone: one pass over the files, and one over the vocabulary
        postings = _written(_unit_rows(files, kind, least).distinct().select("unit", F.explode(F.concat(*[grams(F.col("unit"), n) for n in sizes])).alias("gram"))
                            .join(parts.select("gram").distinct(), "gram"), f"postings-{kind}")
        seen = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        # the rarest gram; a name with a gram that no unit has meets nothing
        probe = (parts.join(seen, "gram", "left").groupBy("base")
                 .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("_g"))
                 .where("_g.n > 0").select("base", F.col("_g.gram").alias("gram")))
        held = _written(postings.join(probe, "gram").where(F.col("unit").contains(F.col("base"))).select("unit", "base"), f"held-{kind}")
        # the second pass over the files: units that hold a name, wherever they stand
        index = reference_index(files, kind, least, held.select("unit").distinct())
        found.append(index.join(held, "unit").join(mine.select("repo_id", "base"), ["repo_id", "base"])
                     .groupBy("repo_id", "base").agg(F.min("_o").alias("_o")))
    return reduce(DataFrame.unionByName, found)


def _sources(files: DataFrame, wanted: DataFrame, ordc: str, before: int = REF_BEFORE, after: int = REF_AFTER, cap: int = BLOCK_CAP) -> DataFrame:
    """Text around each distinct answer: repo_id, _o, path, how, base, at (line of a definition, else 0), line_no, source.

    ``wanted`` (repo_id, _o, how, line_no, base) is narrow.
    The answers of a file travel as an array (in chunks where one file has
    very many), so its text is split once a chunk.
    """
    narrow = wanted.select("repo_id", "_o", "how", F.coalesce("line_no", F.lit(0)).cast("bigint").alias("at"), "base").distinct()
    chunks = narrow.groupBy("repo_id", "_o").agg(F.count(F.lit(1)).alias("n"))
    grouped = _written(narrow.join(chunks, ["repo_id", "_o"])
                       .withColumn("chunk", F.pmod(F.xxhash64("how", "at", "base"), F.ceil(F.col("n") / ANSWERS_PER_SPLIT)))
                       .groupBy("repo_id", "_o", "chunk").agg(F.collect_list(F.struct("how", "at", "base")).alias("_items")), "answers")
    text = F.col("content")

    def line_of(base):
        head = F.substring(text, F.lit(1), F.instr(text, base) - 1)
        return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("bigint")

    def around(lines, line_no):
        first, last = F.greatest(F.lit(1), line_no - F.lit(before)), F.least(F.size(lines), line_no + F.lit(after - 1))
        return F.array_join(F.slice(lines, first.cast("int"), (last - first + 1).cast("int")), "\n")

    def answers(lines):
        items = F.col("_items")
        heads = F.transform(F.filter(items, lambda i: i["how"] == "definition"), lambda i: i["at"])
        blocks = F.when(F.size(heads) > 0, F.filter(_block_ends(lines), lambda d: F.array_contains(heads, d["line_no"])))
        defined = F.transform(F.coalesce(blocks, F.array().cast("array<struct<line_no:bigint,kind:string,name:string,indent:int,stop:bigint>>")),
                              lambda d: F.struct(F.lit("definition").alias("how"), F.lit("").alias("base"), d["line_no"].alias("at"), d["line_no"].alias("line_no"),
                                                 _block_text(lines, d["line_no"], d["stop"], cap).alias("source")))
        used = F.transform(F.filter(items, lambda i: i["how"] == "reference"), lambda i: _bind(line_of(i["base"]), lambda n: F.struct(
            F.lit("reference").alias("how"), i["base"].alias("base"), F.lit(0).cast("bigint").alias("at"), n.alias("line_no"), around(lines, n).alias("source"))))
        return F.concat(defined, used)

    return (files.select("repo_id", F.col(ordc).alias("_o"), "path", "content").join(grouped, ["repo_id", "_o"])
            .select("repo_id", "_o", "path", F.explode(_bind(F.split(text, "\n", -1), answers)).alias("_a")).select("repo_id", "_o", "path", "_a.*"))


def _reference_winners(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(request_id, repo_id, _o, how, line_no, base) for every request whose last part stands on some line."""
    req = _written(request_parts(requests).select("request_id", "repo_id", F.element_at("_parts", -1).alias("base")), "requests")
    # one search per distinct (repo, name): requests repeating a name share it
    best = _first_references(req.where("base is not null").select("repo_id", "base").distinct(), files)
    return req.join(best, ["repo_id", "base"]).select("request_id", "repo_id", "_o", F.lit("reference").alias("how"),
                                                     F.lit(None).cast("bigint").alias("line_no"), "base")


def _answers(winners: DataFrame, files: DataFrame, **options) -> DataFrame:
    """request_id, how, file_path, line_no, source for written winners."""
    found = _sources(files, winners, _order_col(files), **options)
    return (winners.withColumn("at", F.coalesce("line_no", F.lit(0)).cast("bigint")).drop("line_no")
            .join(found, ["repo_id", "_o", "how", "at", "base"])
            .select("request_id", "how", F.col("path").alias("file_path"), "line_no", "source"))


def resolve_reference(requests: DataFrame, files: DataFrame, before: int = REF_BEFORE, after: int = REF_AFTER) -> DataFrame:
    """First line (file order, then line) containing the name's last part;
    returns lines i-before .. i+after-1 around it.

    The first file comes from the inverted index (see ``reference_index``), the
    line from that file's text.  Work follows the vocabulary and the units that
    share a name's rarest gram, not files x names.
    """
    winners = _written(_reference_winners(requests, files), "references")
    return _answers(winners, files, before=before, after=after).drop("how")


def resolve_symbols_batch(requests: DataFrame, files: DataFrame, defs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Resolve every request: definition first, then reference, else not found.

    ``defs`` is the definition index of ``files`` where the caller has it
    already (refinement asks in every round).

    Returns (results, counts): results keep one row per request with
    ``found``/``how``/``file_path``/``source``; counts give resolved/total per
    repository.
    """
    defined = _written(_first_definitions(requests, definition_index(files) if defs is None else defs).select(
        "request_id", "repo_id", "_o", F.lit("definition").alias("how"), "line_no", F.lit("").alias("base")), "definitions")
    left = requests.join(defined.select("request_id"), "request_id", "left_anti")
    winners = _written(defined.unionByName(_reference_winners(left, files)), "winners")
    found = _answers(winners, files)
    res = (requests.join(found, "request_id", "left")
           .select("request_id", "repo_id", F.col("name").alias("context_name_requested"), "name",
                   F.col("how").isNotNull().alias("found"), F.coalesce("how", F.lit("none")).alias("how"),
                   F.coalesce("file_path", F.lit("")).alias("file_path"), "line_no",
                   F.coalesce("source", F.lit("")).alias("source")))
    # the counts need the winners only, no text
    counts = (requests.join(winners.select("request_id", "how"), "request_id", "left")
              .groupBy("repo_id").agg(F.count("how").alias("resolved"), F.count(F.lit(1)).alias("total")))
    return res, counts
