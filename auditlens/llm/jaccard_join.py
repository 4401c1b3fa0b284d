"""Similarity join on word five-grams by MinHash banding (operator 7).

1. Texts with the same word sequence form one *class* (a copy is a count, not
   a row of a pair).  Each class gets a MinHash signature cut into bands; the
   number of bands follows from the rows per band and the target recall at
   the threshold.
2. Classes that share a band hash meet through the bucket's least class (a
   star, linear in the bucket).  Connected components of these stars hold
   every candidate pair.
3. Each component is verified on full shingle sets: members are dealt into
   blocks of ``BLOCK``, every pair of blocks is one task, and a task counts
   intersections through an inverted index.  Pairs are never rows: a task
   returns, per member, its number of links and its root within the task.
4. Components of the verified links are the groups.

A component larger than ``BLOCK`` only makes more block tasks, so none holds
an unbounded group; but each member meets every block, so rows moved and work grow
with the square of a component's *different* texts over ``BLOCK`` (copies are one
class).  The number of links asks for that; groups alone (``connect_classes``, for
the pipeline) are verified against bucket representatives first, which is linear
where near copies resemble their representative.  Members are pulled by a class key, so no link between
different texts is lost beyond the banding's miss rate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm import kernels as K
from auditlens.llm.common import WORD_CLASS, components, drop, ready, written

SHINGLE, THRESHOLD = 5, 0.8
ROWS, TARGET_RECALL = 4, 0.99999
#: Members of one side of a verification task.
BLOCK = 1_500


def bands_for(threshold: float = THRESHOLD, rows: int = ROWS, recall: float = TARGET_RECALL) -> int:
    """Least number of bands so that a pair at the threshold shares one with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _multipliers(n: int) -> np.ndarray:
    return K.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the word ``size``-grams; a shorter text with a word is one shingle, one without has none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return K.hash_spans(words, np.array([0]), np.array([len(words)]))
    return K.hash_windows(words, size)


def _class_key(words: np.ndarray) -> tuple[int, int]:
    if not len(words):
        return 0, 0
    ends = np.array([0]), np.array([len(words)])
    return tuple(int(K.hash_spans(words, *ends, s)[0].astype(np.int64)) for s in (1, 2))


def _row_name():
    """(doc_id, or 0 and a flag where it is null, and two hashes of the text)."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("id"),
                    F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))


def signatures(docs: DataFrame, size: int, bands: int, rows: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(``keep`` columns, k1, k2, bands array<long>) for every document row; no bands without a word."""
    ready(docs.sparkSession)
    docs = docs.select(*keep, "text")
    factors = _multipliers(bands * rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            for i, j in K.chunks(offsets):
                words, _, _, bounds = K.words_of(data, offsets, i, j)
                sets = [shingles(words[a:b], size) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                keys = [_class_key(words[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                lengths = np.array([len(s) for s in sets])
                full = np.flatnonzero(lengths)
                column = pa.nulls(j - i, pa.list_(pa.int64()))
                if len(full):
                    flat = np.concatenate([sets[k] for k in full])
                    starts = np.concatenate([[0], np.cumsum(lengths[full])[:-1]])
                    band = np.zeros((len(full), bands), np.uint64)
                    buffer = np.empty_like(flat)
                    for h, factor in enumerate(factors):
                        np.multiply(flat, factor, out=buffer)
                        least = np.minimum.reduceat(buffer, starts)
                        band[:, h // rows] = K.mix(band[:, h // rows] + least)
                    band = K.mix(band + np.arange(bands, dtype=np.uint64))
                    which = np.full(j - i, -1)
                    which[full] = np.arange(len(full))
                    column = pa.array([None if w < 0 else band[w].view(np.int64) for w in which], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(i, j - i) for c in keep], pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), column],
                    [*keep, "k1", "k2", "bands"])

    return docs.mapInArrow(work, ", ".join([*[f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep], "k1 long, k2 long, bands array<long>"]))


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, copies: np.ndarray, threshold: float, same: bool):
    """Links between members ``left`` and ``right`` of a task: (weighted link count per member, root per member)."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, posting = flat[order], owner[order]
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    ends = np.append(first[1:], len(flat))
    term = np.empty(len(flat), np.int64)
    term[order] = np.repeat(np.arange(len(first)), ends - first)
    at = np.concatenate([[0], np.cumsum(sizes)])
    many = ends - first > 1
    degree = np.zeros(len(sets), np.int64)
    root = np.arange(len(sets))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    allowed = np.zeros(len(sets), bool)
    allowed[right] = True
    for x in left:
        mine = term[at[x]:at[x + 1]]
        mine = mine[many[mine]]
        if not len(mine):
            continue
        common = np.bincount(np.concatenate([posting[first[t]:ends[t]] for t in mine]), minlength=len(sets))
        y = np.flatnonzero(common)
        y = y[allowed[y] & (y > x if same else y != x)]
        # |a & b| / |a | b| >= threshold, on integers scaled to avoid rounding
        inter = common[y]
        y = y[inter * 1_000_000 >= round(threshold * 1_000_000) * (sizes[x] + sizes[y] - inter)]
        degree[x] += copies[y].sum()
        degree[y] += copies[x]
        for other in y:
            a, b = find(x), find(other)
            if a != b:
                root[max(a, b)] = min(a, b)
    return degree, np.array([find(x) for x in range(len(sets))])


def _stars(buckets: DataFrame) -> DataFrame:
    """(a, b): every class of a bucket (band, h) with the bucket's least class."""
    least = buckets.groupBy("band", "h").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi").drop("hi")
    return buckets.join(least, ["band", "h"]).where("k <> lo").select(F.col("k").alias("a"), F.col("lo").alias("b")).distinct()


def link_classes(docs: DataFrame, classes: DataFrame, threshold: float, size: int, block: int) -> DataFrame:
    """Verified links of ``classes`` (k, source row, copies, bands): (k, n_links, root) per class and task."""
    groups = components(_stars(classes.select("k", F.posexplode("bands").alias("band", "h"))), "candidates")
    return _block_links(docs, classes, groups, threshold, size, block)


def connect_classes(docs: DataFrame, classes: DataFrame, threshold: float, size: int, block: int) -> DataFrame:
    """Like ``link_classes``, for groups alone: (node, root) rows that connect what is linked, without link counts.

    Components of at most ``block`` classes are one task each.  In larger ones
    every class is verified against the least class of each of its buckets
    first, which is linear.  Only buckets whose classes this leaves apart go to the
    blocks: a linked pair that shares a band is either connected by now, or in
    such a bucket.
    """
    buckets = classes.select("k", F.posexplode("bands").alias("band", "h"))
    stars = written(_stars(buckets), "stars")
    groups = components(stars, "candidates")
    large = groups.groupBy("root").agg(F.count("*").alias("m")).where(F.col("m") > block).select("root")
    in_large = written(groups.join(large, "root").select("node"), "large")
    first = written(_star_links(docs, classes, stars.join(in_large, stars.a == in_large.node, "left_semi"), threshold, size, block), "firsts")
    sub = components(first, "parts").withColumnRenamed("node", "k")
    apart = buckets.join(in_large.withColumnRenamed("node", "k"), "k").join(sub, "k", "left").withColumn("root", F.coalesce("root", "k"))
    open_ = apart.groupBy("band", "h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band", "h")
    rest = components(_stars(apart.select("k", "band", "h").join(open_, ["band", "h"])), "open")
    small = groups.join(large, "root", "left_anti").select("node", "root")
    found = _block_links(docs, classes, small.unionByName(rest.select("node", "root")), threshold, size, block)
    out = written(found.select("node", "root").unionByName(first.select(F.col("a").alias("node"), F.col("b").alias("root"))), "connected")
    for table in (stars, in_large, first):
        drop(table)
    return out


def _star_links(docs: DataFrame, classes: DataFrame, stars: DataFrame, threshold: float, size: int, block: int) -> DataFrame:
    """The stars (a, b) whose two classes are linked; at most ``block`` members of one b are a task."""
    counts = stars.groupBy("b").agg(F.expr(f"(count(*) + {block - 1}) div {block}").cast("int").alias("salts"))
    salted = stars.join(counts, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"))
    heads = counts.select("b", F.col("b").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rows = salted.select("b", F.col("a").alias("node"), "salt").unionByName(heads)
    rows = rows.join(classes.select(F.col("k").alias("node"), "source"), "node").join(docs.select(_row_name().alias("source"), "text"), "source")
    key = "struct<k1:long,k2:long>"

    def check(table: pa.Table) -> pa.Table:
        head = table.column("b")[0].as_py()
        nodes, sets = table.column("node").to_pylist(), table.column("shingles").to_pylist()
        whole = np.frombuffer(next(s for n, s in zip(nodes, sets, strict=True) if n == head), np.uint64)
        keep = []
        for r, (n, s) in enumerate(zip(nodes, sets, strict=True)):
            mine = np.frombuffer(s, np.uint64)
            inter = len(np.intersect1d(mine, whole, assume_unique=True))
            if n != head and inter * 1_000_000 >= round(threshold * 1_000_000) * (len(mine) + len(whole) - inter):
                keep.append(r)
        linked = table.take(pa.array(keep, pa.int64()))
        return pa.table({"a": linked.column("node"), "b": linked.column("b")})

    sets = rows.select("b", "salt", "node", "text").mapInArrow(_to_sets(["b", "salt", "node"], size), f"b {key}, salt int, node {key}, shingles binary")
    return sets.groupBy("b", "salt").applyInArrow(check, f"a {key}, b {key}").distinct()


def _to_sets(keep: list[str], size: int):
    """``keep`` columns and the sorted shingle set of the text, of rows whose text is that of class ``node``."""
    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            keys, kept, sets = batch.column("node").to_pylist(), [], []
            for i, j in K.chunks(offsets):
                words, _, _, bounds = K.words_of(data, offsets, i, j)
                for r in range(i, j):
                    w = words[bounds[r - i]:bounds[r - i + 1]]
                    if _class_key(w) == (keys[r]["k1"], keys[r]["k2"]):  # else another text under the same name
                        kept.append(r)
                        sets.append(np.unique(shingles(w, size)).tobytes())
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(n) for n in keep] + [pa.array(sets, pa.binary())], [*keep, "shingles"])
    return to_sets


def _block_links(docs: DataFrame, classes: DataFrame, groups: DataFrame, threshold: float, size: int, block: int) -> DataFrame:
    """Verified links inside the given groups (node, root), block against block: (node, n_links, root) per class and task."""
    sizes = groups.groupBy("root").agg(F.count("*").alias("m"))
    members = (groups.join(sizes, "root").join(classes.select(F.col("k").alias("node"), "source", "copies"), "node")
               .withColumn("blocks", F.expr(f"(m + {block - 1}) div {block}").cast("int"))
               .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    # one task per pair of blocks: a member meets every block once
    members = (members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
               .select("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "source", "copies"))
    # the text of a class is that of one of its rows, named by doc_id and text, so rows without an id are told apart too
    texts = docs.select(_row_name().alias("source"), "text")
    rows = members.join(texts, "source").select("root", "lo", "hi", "own", "node", "copies", "text")

    key = "struct<k1:long,k2:long>"
    ready(docs.sparkSession)
    rows = rows.mapInArrow(_to_sets(["root", "lo", "hi", "own", "node", "copies"], size), f"root {key}, lo int, hi int, own int, node {key}, copies long, shingles binary")

    def verify(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        seen, rows_ = set(), []
        for r, k in enumerate(nodes):  # repeated rows of one class
            if (k["k1"], k["k2"]) not in seen:
                seen.add((k["k1"], k["k2"]))
                rows_.append(r)
        rows_.sort(key=lambda r: (nodes[r]["k1"], nodes[r]["k2"]))
        table = table.take(pa.array(rows_, pa.int64()))
        sets = [np.frombuffer(s.as_py(), np.uint64) for s in table.column("shingles")]
        own, copies = np.asarray(table.column("own")), np.asarray(table.column("copies"))
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        degree, root = _links(sets, np.flatnonzero(own == lo), np.flatnonzero(own == hi), copies, threshold, lo == hi)
        node = table.column("node").combine_chunks()
        return pa.table({"node": node, "n_links": pa.array(degree), "root": node.take(pa.array(root))})

    return rows.groupBy("root", "lo", "hi").applyInArrow(verify, f"node {key}, n_links long, root {key}")


def _grouped(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, recall: float = TARGET_RECALL,
             rows: int = ROWS, block: int = BLOCK, keep: tuple[str, ...] = ("doc_id",), count: bool = True) -> tuple[DataFrame, DataFrame]:
    """Document rows (``keep`` columns, bands, class key k), and classes (k, least doc_id, root, and n_links if they are to be counted)."""
    docs = docs.withColumn("source", _row_name())
    signed = written(signatures(docs, size, bands_for(threshold, rows, recall), rows, (*keep, "source")), "signatures")
    with_key = signed.withColumn("k", F.struct("k1", "k2"))
    classes = written(with_key.where("bands IS NOT NULL").groupBy("k")
                      .agg(F.min("doc_id").alias("doc_id"), F.min("source").alias("source"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "classes")
    if not count:
        found = connect_classes(docs.select("doc_id", "text"), classes, threshold, size, block)
        roots = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "groups").withColumnRenamed("node", "k")
        grouped = written(classes.select("k", "doc_id").join(roots, "k", "left").select("k", "doc_id", F.coalesce("root", "k").alias("root")), "grouped")
        drop(found)
        return with_key, grouped
    found = written(link_classes(docs.select("doc_id", "text"), classes, threshold, size, block), "links")
    edges = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(edges, "groups").withColumnRenamed("node", "k")
    degree = found.groupBy(F.col("node").alias("k")).agg(F.sum("n_links").alias("links"))
    grouped = (classes.select("k", "doc_id", "copies").join(degree, "k", "left").join(roots, "k", "left")
               .select("k", "doc_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "k").alias("root")))
    return with_key, written(grouped, "grouped")


def similar_documents(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, n_links) for every document row.

    class_id is the least doc_id of the document's group (connected by links);
    n_links counts the other document rows with an equal word sequence or a
    shingle Jaccard similarity of at least ``threshold``.  Texts without a
    word (null, empty, white space) link to nothing: class_id is their doc_id.
    A group without any doc_id has a null class_id.  Only doc_id and text are read.
    """
    with_key, grouped = _grouped(docs.select("doc_id", "text"), **options)
    least = grouped.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    per_class = grouped.join(least, "root").select("k", "class_id", "n_links")
    linked = with_key.where("bands IS NOT NULL").select("doc_id", "k").join(per_class, "k").select("doc_id", "class_id", "n_links")
    alone = with_key.where("bands IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return linked.unionByName(alone)


def keep_one_per_group(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (all columns) that stand for their group: the least by doc_id, then by a hash of the text.

    Rows are told apart by doc_id and text, so another text under the doc_id of
    a copy stays, and so does one row only of different copies under one doc_id
    and of equal rows.  Rows without a doc_id stay beside the named row of their
    group, one a group.  Rows without a word all stay.
    """
    named = lambda c: F.coalesce(c, F.lit(0))
    hashes = {"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")}
    rows, grouped = _grouped(docs.select("doc_id", "text", *[h.alias(c) for c, h in hashes.items()]), keep=("doc_id", "t1", "t2"), count=False, **options)
    rows = rows.where("bands IS NOT NULL").select("k", F.col("doc_id").isNull().alias("unnamed"), F.struct("doc_id", "t1", "t2").alias("row"))
    of_class = rows.groupBy("k", "unnamed").agg(F.min("row").alias("least")).join(grouped.select("k", "root"), "k")
    of_group = of_class.groupBy("root", "unnamed").agg(F.min("least").alias("best"))
    best = of_class.join(of_group, ["root", "unnamed"]).select("k", "unnamed", "best")
    gone = (rows.join(best, ["k", "unnamed"]).where("NOT (row <=> best)")
            .select("unnamed", named(F.col("row.doc_id")).alias("id"), F.col("row.t1").alias("t1"), F.col("row.t2").alias("t2")).distinct())
    worded = F.coalesce(F.col("text").rlike(WORD_CLASS), F.lit(False))
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("__row"), F.col("doc_id").isNull().alias("unnamed"), named(F.col("doc_id")).alias("id"),
                        *[h.alias(c) for c, h in hashes.items()], F.when(worded, -1).otherwise(F.monotonically_increasing_id()).alias("own"))
    key = ["unnamed", "id", "t1", "t2"]
    return whole.join(gone, key, "left_anti").dropDuplicates([*key, "own"]).select("__row.*")
