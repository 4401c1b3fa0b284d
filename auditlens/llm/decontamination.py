"""Benchmark decontamination by a prefix-filtered join (operator 9, DataFrame functions only).

Every run of 10 item words is a window (an item with fewer words is one
window).  Words are ordered by rarity in the whole corpus; a document that
holds a window holds the window's rarest word, so that word alone is the
necessary prefix of the containment join.  Each document word that equals a
prefix word proposes one window position; length and position bounds cut
proposals that do not fit into the document, and the rest is verified word for
word over the window's length while the document's word array is still in
the same generated stage.  Documents are never shuffled: only verified hits
and word counts are.

Windows are broadcast in blocks of ``BLOCK_BYTES`` (measured before); a larger
benchmark makes more blocks, each one more pass over the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.llm.common import written

ITEM_WINDOW = 10
#: Largest broadcast of one pass.
BLOCK_BYTES = 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Array of words: A-Z lowered, then runs of letters, digits and everything beyond ASCII."""
    t = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(t) == F.char_length(t)
    return F.array_remove(F.split(F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER)), _BETWEEN, -1), "")


def item_windows(items: DataFrame, size: int = ITEM_WINDOW) -> DataFrame:
    """(item_id, window): distinct windows of every item with a word."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.expr(f"sequence(0, greatest(size(w) - {size}, 0))")
    return w.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.expr(f"slice(w, at + 1, {size})").alias("window")).distinct()


def _blocks(df: DataFrame, row_bytes: Column, limit: int) -> int:
    """How many hash blocks keep each broadcast below ``limit`` bytes."""
    total = df.agg(F.sum(row_bytes)).first()[0] or 0
    return max(1, -(-int(total) // limit))


def prefix_windows(docs: DataFrame, items: DataFrame, size: int = ITEM_WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """(token, at, window, item_id): each window under its rarest word, which stands at place ``at`` (from 0).

    Rarity is the word's count over all documents; ties go to the lesser word.
    """
    windows = written(item_windows(items, size), "windows")
    vocabulary = windows.select(F.explode("window").alias("token")).distinct()
    n = _blocks(vocabulary, F.octet_length("token") + 64, limit)
    counts = None
    for b in range(n):
        block = vocabulary.where(F.pmod(F.xxhash64("token"), F.lit(n)) == b)
        seen = (docs.select(F.explode(words(F.col("text"))).alias("token")).join(F.broadcast(block), "token")
                .groupBy("token").agg(F.count("*").alias("n")))
        counts = seen if counts is None else counts.unionByName(seen)
    counts = written(counts, "counts")
    rarest = (windows.select("item_id", "window", F.posexplode("window").alias("at", "token")).join(counts, "token")
              .groupBy("item_id", "window").agg(F.count("*").alias("known"), F.min(F.struct("n", "token", "at")).alias("r")))
    # a window with a word that no document has cannot occur
    return rarest.where("known = size(window)").select(F.col("r.token").alias("token"), F.col("r.at").alias("at"), "window", "item_id")


def window_hits(docs: DataFrame, items: DataFrame, size: int = ITEM_WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text_key, start, len, item_id): verified occurrences of item windows in documents."""
    probe = written(prefix_windows(docs, items, size, limit), "probe")
    n = _blocks(probe, F.expr("aggregate(window, 96L, (s, x) -> s + octet_length(x) + 24)"), limit)
    w = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))
    tokens = w.select("doc_id", "text_key", "w", F.posexplode("w").alias("pos", "token"))
    out = None
    for b in range(n):
        block = probe.where(F.pmod(F.xxhash64("window"), F.lit(n)) == b)
        hits = (tokens.join(F.broadcast(block), "token")
                .where("pos >= at AND pos - at + size(window) <= size(w)")  # position and length bounds
                .where("slice(w, pos - at + 1, size(window)) = window")     # exact containment
                .select("doc_id", "text_key", (F.col("pos") - F.col("at")).alias("start"), F.size("window").alias("len"), "item_id"))
        out = hits if out is None else out.unionByName(hits)
    return out


def find_contamination(docs: DataFrame, items: DataFrame, size: int = ITEM_WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every document row.

    Null or empty texts have no words; a document without hits gets 0, 0 and
    the hash of the empty string.  Repeated rows give repeated results; a null
    item_id marks hits but is no item in the list; null doc_ids keep their own
    hits (by text).  Empty documents give an empty result, an empty benchmark
    no hits.  Only doc_id, item_id and text are read.
    """
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    return _with_hits(base, window_hits(docs, items, size, limit))


def _with_hits(base: DataFrame, hits: DataFrame) -> DataFrame:
    per_doc = (hits.groupBy(F.col("doc_id").alias("hit_doc"), F.col("text_key").alias("hit_key"))
               .agg(F.collect_set(F.struct("start", "len")).alias("at"), F.collect_set(F.col("item_id").cast("string")).alias("items")))
    covered = F.expr("size(array_distinct(flatten(transform(at, h -> sequence(h.start, h.start + h.len - 1)))))")
    joined = base.join(per_doc, base.doc_id.eqNullSafe(F.col("hit_doc")) & (base.text_key == F.col("hit_key")), "left")
    items = F.coalesce(F.array_sort("items"), F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), F.col("at").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = ITEM_WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` (all columns) without any occurrence of an item window.  Rows keep their text: no row is merged."""
    hits = window_hits(docs.select("doc_id", "text"), items.select("item_id", "text"), size, limit)
    bad = hits.select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__doc"]) & (F.xxhash64(docs["text"]) == bad["__key"]), "left_anti")
