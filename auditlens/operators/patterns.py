"""Regex rules applied to text columns.

Fixed rules, and rules given as a list, become native ``rlike`` expressions -
one predicate or one per-row count per family - so the work is a map-only pass:
no UDF, no explode before aggregation, no join against the rules.

Rules given as a DataFrame (family, pattern) may be any number.  They stay rows,
behind an index of the literals that their matches must contain: each rule waits
at one trigram of its literal, the one that fewest rules share, and a text meets
only the rules whose trigram it has.  ``contains`` then asks for the whole
literal, and only what passes is matched.  Rules without a usable literal wait at
the empty gram, which every text has.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from functools import reduce
from operator import add, or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.functions import dims
from auditlens.functions.plan import cut_lineage
from auditlens.functions.regex import guard_for
from auditlens.functions.text import grams
from auditlens.session import ship_package

GRAM = 3
#: Rules are broadcast in blocks of this size; each block is a pass over the texts.
RULE_BLOCK_BYTES = 16 << 20


def _rules(rules) -> list[tuple[str, str]]:
    """The fixed rules, or a list of (family, pattern)."""
    return list(dims.NETWORK_PATTERNS if rules is None else rules)


def rule_index(rules: DataFrame) -> DataFrame:
    """(family, pattern, times, literal, lowered, gram), written once, from rows of (family or vuln_type, pattern).

    ``gram`` is the trigram of the literal that the fewest literals share, in
    lower case; '' where a rule has no ASCII literal of three characters.
    """
    ship_package(rules.sparkSession)
    cols = rules.columns
    fam = "family" if "family" in cols else ("vuln_type" if "vuln_type" in cols else cols[0])

    def literals(frames):
        for frame in frames:
            found = [guard_for(p) or ("", False) for p in frame["pattern"]]
            found = [(lit, low) if lit.isascii() and len(lit) >= GRAM else ("", False) for lit, low in found]
            yield frame.assign(literal=pd.Series([x[0] for x in found], dtype=object), lowered=pd.Series([x[1] for x in found], dtype=bool))

    one = (rules.where("pattern is not null").groupBy(F.col(fam).alias("family"), "pattern").agg(F.count(F.lit(1)).alias("times"))
           .mapInPandas(literals, "family string, pattern string, times long, literal string, lowered boolean"))
    parts = one.where("literal <> ''").select("literal").distinct().select("literal", F.explode(grams(F.lower("literal"), GRAM)).alias("gram"))
    shared = parts.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = parts.join(shared, "gram").groupBy("literal").agg(F.min(F.struct("n", "gram")).alias("_g")).select("literal", F.col("_g.gram").alias("gram"))
    return cut_lineage(one.join(rarest, "literal", "left").select("family", "pattern", "times", "literal", "lowered", F.coalesce("gram", F.lit("")).alias("gram")),
                       f"rules/{uuid.uuid4().hex[:12]}")


def rule_matches(df: DataFrame, keep: list[Column | str], text_col: str, rules: DataFrame) -> DataFrame:
    """(keep.., family, pattern, times) for every rule that matches a text; no text is shuffled.

    The grams of a text are looked up in a hash table of the rules inside the
    scan's own stage.  The rules' bytes are summed first; beyond
    ``RULE_BLOCK_BYTES`` they are broadcast block by block.
    """
    index = rule_index(rules)
    size = F.length("family") + F.length("pattern") + F.length("literal") + F.lit(100)
    blocks = -(-int(index.agg(F.sum(size)).first()[0] or 1) // RULE_BLOCK_BYTES)
    text = F.col("_text")
    texts = (df.select(*keep, F.col(text_col).alias("_text")).where("_text is not null")
             .withColumn("gram", F.explode(F.concat(F.array(F.lit("")), grams(F.lower(text), GRAM)))))
    has = F.when(F.col("lowered"), F.contains(F.lower(text), F.col("literal"))).otherwise(F.contains(text, F.col("literal")))
    parts = []
    for b in range(blocks):
        block = index.where(F.pmod(F.xxhash64("family", "pattern"), F.lit(blocks)) == b)
        parts.append(texts.join(F.broadcast(block), "gram").where(has).where(F.rlike(text, F.col("pattern"))).drop("_text", "gram", "literal", "lowered"))
    return reduce(DataFrame.unionByName, parts)


def rule_match(c: Column, pattern: str) -> Column:
    """``rlike`` behind a literal guard where it pays: the regex only runs on
    texts containing the rule's required literal.  Rules starting with a
    4+ character literal are left alone (the JVM regex scan is already a
    Boyer-Moore search); case-insensitive rules are guarded on lower(text)."""
    g = guard_for(pattern)
    m = c.rlike(pattern)
    if not g:
        return m
    lit, lower = g
    return ((F.lower(c) if lower else c).contains(lit)) & m


def bind_text(c: Column, fn) -> Column:
    """Evaluate ``fn(x)`` with ``x`` bound to the value of ``c``.

    Catalyst substitutes a projected expression into every reference when it
    pushes a filter down; with ~250 rule references to one text that means
    re-deriving the text (decode, concat, ...) per rule and generated code
    beyond the JVM's 64 KB method limit.  Binding it to a lambda variable
    evaluates the text once per row; the rule checks themselves (byte search,
    regex) cost the same evaluated or generated.
    """
    return F.element_at(F.transform(F.array(c), fn), 1)


def network_predicate(text_col: str = "content", rules=None) -> Column:
    """True when any rule matches (null text → False)."""
    pats = [p for _, p in _rules(rules)]
    seen = list(OrderedDict.fromkeys(pats))  # 126 rules, 125 distinct
    pred = bind_text(F.col(text_col), lambda x: reduce(or_, [rule_match(x, p) for p in seen]))
    return F.coalesce(pred, F.lit(False))


def filter_network_files(files: DataFrame, rules=None, text_col: str = "content") -> DataFrame:
    """Keep files where any endpoint/sink pattern matches; unreadable (null) drop.

    With a DataFrame of rules the matching rows are named by a digest of all
    their columns, and the files are met with the distinct digests.
    """
    if isinstance(rules, DataFrame):
        named = files.withColumn("_row", F.sha2(F.to_json(F.struct(*files.columns)), 256))
        return named.join(rule_matches(named, ["_row"], text_col, rules).select("_row").distinct(), "_row", "left_semi").drop("_row")
    return files.filter(network_predicate(text_col, rules))


def family_counts(text_col: str, rules, label: str = "family") -> Column:
    """Array<struct(label, n)> of matched-rule counts per family (n > 0 only)."""
    fams: "OrderedDict[str, list[str]]" = OrderedDict()
    for fam, p in _rules(rules):
        fams.setdefault(fam, []).append(p)

    def counts(x):
        entries = []
        for fam, pats in fams.items():
            n = reduce(add, [F.when(rule_match(x, p), F.lit(1)).otherwise(F.lit(0)) for p in pats])
            entries.append(F.struct(F.lit(fam).alias(label), n.alias("n")))
        return F.filter(F.array(*entries), lambda s: s["n"] > 0)

    return F.coalesce(bind_text(F.col(text_col), counts), F.array())


def pattern_family_hits(df: DataFrame, id_cols, text_col: str, rules=None, label: str = "family") -> DataFrame:
    """(id.., family, n): number of the family's rules that match each text.

    One pass per row computes every family count; only rows with hits are
    emitted.  No shuffle.  With a DataFrame of rules the hits alone are summed by
    (id.., family), so the ids must name a text.
    """
    id_cols = list(id_cols)
    if isinstance(rules, DataFrame):
        hits = rule_matches(df, id_cols, text_col, rules)
        return hits.groupBy(*id_cols, F.col("family").alias(label)).agg(F.sum("times").cast("bigint").alias("n"))
    return (df.select(*id_cols, F.explode(family_counts(text_col, rules, label)).alias("_h"))
            .select(*id_cols, F.col("_h")[label].alias(label), F.col("_h.n").cast("bigint").alias("n")))


def family_rollup(hits: DataFrame, label: str = "family") -> DataFrame:
    """Per family: texts hit and rule hits (partial aggregation per task)."""
    return hits.groupBy(label).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").cast("bigint").alias("n_hits"))


def sink_rule_scores(files: DataFrame, rules=None, keys=("repo_id", "path"), text_col: str = "content") -> DataFrame:
    """Deterministic built-in scorer.

    (file, vuln_type, n) for every type whose sink rules match, with
    confidence = least(10, 3 + 2 n).  Same single-pass shape as
    ``pattern_family_hits``.
    """
    rules = dims.SINK_RULES if rules is None else rules
    hits = pattern_family_hits(files, keys, text_col, rules, label="vuln_type")
    return hits.withColumn("confidence", F.least(F.lit(10), F.lit(3) + F.lit(2) * F.col("n")).cast("int"))
