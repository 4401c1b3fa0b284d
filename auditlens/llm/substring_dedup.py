"""Removal of repeated 50-word passages by De Bruijn compaction (operator 4).

A word of document d goes if some window of 50 words that covers it also
starts in a document with a smaller doc_id.  The windows of a text form a path
through the De Bruijn graph; handling every window would shuffle one row per
word, so the path is compacted in two steps.

1. **Edges.**  Each window belongs to its least k-mer (15 words, by hash; the
   first one on a tie), which depends on the window's words alone.  Windows in
   a row with the same k-mer make an *edge*: about one row per 18 words, keyed
   by the k-mer's hash ``a`` and the hash ``c`` of all its words (128 bits
   together).  Equal keys mean equal windows.
2. **Paths.**  Edges seen in more than one document, followed and preceded by
   one and the same edge wherever they occur, join into paths by pointer
   doubling (Spark joins on the edge hash).  Only path heads are joined back
   to the documents: their source coordinates give the repeated spans.

Where a k-mer has several edges (the graph branches: passage ends, edited
copies), the windows of one source occurrence of each edge are hashed from the
text at its coordinates (with the k-mer 128 bits) and matched one by one, which verifies the
part of a span that two documents share.  Along a nonbranching path equality of
edges is by their 128-bit keys.  The result is exact but for 128-bit
hash collisions.

No step gathers a group.  Aggregates combine before the shuffle.  Joins of all
occurrences with keys are split: keys with more than one in ``HOT_PARTS`` of the
occurrences, of which there can be no more than ``HOT_PARTS``, are broadcast, and
only the others are dealt out by key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm import kernels as K
from auditlens.llm.common import drop, ready, written

WINDOW, KMER = 50, 15
#: A key is hot with more than this part of all occurrences.
HOT_PARTS = 1000
_FULL = np.int64(-1)

_EDGE = "struct<a:long,c:long,start:int,n:int>"
_FACTS = f"doc_id long, key binary, n_words long, words_sha256 string, edges array<{_EDGE}>"
_EDGE_TYPE = pa.struct([("a", pa.int64()), ("c", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])


def _least_kmers(words: np.ndarray, bounds: np.ndarray, window: int, kmer: int):
    """Per valid window start: position of its least k-mer.  Returns (starts, kmer positions, kmer hashes)."""
    hashes = K.hash_windows(words, kmer)
    span = window - kmer + 1  # k-mers in a window
    starts = np.concatenate([np.arange(a, b - window + 1) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b - a >= window]
                            or [np.zeros(0, np.int64)])
    if not len(starts):
        return starts, starts, hashes
    # order by hash, then position: the position goes into the low bits
    low = max(1, int(len(hashes)).bit_length())
    key = ((K.mix(hashes) >> np.uint64(low)) << np.uint64(low)) | np.arange(len(hashes), dtype=np.uint64)
    least, width = key, 1
    while width * 2 <= span:  # least of `width` k-mers, doubled
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = span - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    return starts, (least[starts] & np.uint64((1 << low) - 1)).astype(np.int64), hashes


def edges_of(words: np.ndarray, bounds: np.ndarray, window: int = WINDOW, kmer: int = KMER):
    """Edges of several documents: (document, a, c, start in document, windows)."""
    starts, at, kmers = _least_kmers(words, bounds, window, kmer)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(starts)))
    lo = starts[first]
    hi = lo + n + window - 1
    shape = (at[first] - lo).astype(np.uint64) * np.uint64(1 << 20) + n.astype(np.uint64)
    a = kmers[at[first]]
    c = K.mix(K.hash_spans(words, lo, hi, 2) + shape * np.uint64(5))
    doc = np.searchsorted(bounds, lo, side="right") - 1
    return doc, a.view(np.int64), c.view(np.int64), lo - bounds[doc], n


def text_key():
    """128-bit key of the text, which tells rows of one doc_id apart."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def document_edges(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """One row per document row: doc_id, key, n_words, words_sha256, edges."""
    ready(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(1))
            for i, j in K.chunks(offsets):
                words, _, _, bounds = K.words_of(data, offsets, i, j)
                doc, a, c, start, n = edges_of(words, bounds, window, kmer)
                cells = pa.StructArray.from_arrays([pa.array(a), pa.array(c), pa.array(start, pa.int32()), pa.array(n, pa.int32())],
                                                   fields=list(_EDGE_TYPE))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(j - i + 1)), pa.int32()), cells)
                sha = [hashlib.sha256(b" ".join(data[offsets[r]:offsets[r + 1]].tobytes().split())).hexdigest() for r in range(i, j)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(np.diff(bounds)), pa.array(sha), lists],
                    ["doc_id", "key", "n_words", "words_sha256", "edges"])

    return docs.select("doc_id", "text", text_key().alias("key")).mapInArrow(work, _FACTS)


def written_edges(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """``document_edges``, written, with a number for each row."""
    return written(document_edges(docs, window, kmer).withColumn("row", F.monotonically_increasing_id()), "edges")


def _meet(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with written ``keys`` (distinct by ``on``, with their number of rows ``times``), hot keys broadcast.

    A key is hot with more than 1 in ``HOT_PARTS`` of the rows that any key
    stands for, so there are fewer hot keys than ``HOT_PARTS``.
    """
    total = keys.agg(F.sum("times")).first()[0] or 0
    hot = keys.where(F.col("times") * HOT_PARTS > total)
    rest = keys.where(F.col("times") * HOT_PARTS <= total)
    few = F.broadcast(hot.drop("times"))  # fewer than HOT_PARTS rows
    return rows.join(few, on, how).unionByName(rows.join(few, on, "left_anti").join(rest.drop("times"), on, how))


def shared_edges(facts: DataFrame) -> DataFrame:
    """Edge occurrences whose k-mer stands in more than one document, written: doc_id, row, a, c, start, n, p, q.

    p and q are the hashes of the edges before and after it (0 at the ends).
    Only the k-mer and the doc_id go through the first shuffle.
    """
    edges = facts.where("doc_id IS NOT NULL AND size(edges) > 0")
    kmers = written(edges.select("doc_id", F.explode("edges.a").alias("a")).groupBy("a")
                    .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("times")).where("lo < hi").select("a", "times"), "kmers")
    chained = F.expr("transform(edges, (e, i) -> struct(e.a, e.c, e.start, e.n, "
                     "if(i > 0, edges[i - 1].c, 0L) AS p, if(i + 1 < size(edges), edges[i + 1].c, 0L) AS q))")
    shared = written(_meet(edges.select("doc_id", "row", F.explode(chained).alias("e")).select("doc_id", "row", "e.*"), kmers, ["a"], "left_semi"), "shared")
    drop(kmers)
    return shared


def _classes(shared: DataFrame) -> DataFrame:
    """One row per distinct edge: first and last document, a source occurrence in the first, and the edges before and after it if always the same."""
    return (shared.groupBy("a", "c")
            .agg(F.min(F.struct("doc_id", "row", "start", "n")).alias("src"), F.max("doc_id").alias("last"), F.count("*").alias("times"),
                 F.min("p").alias("p"), F.max("p").alias("p_max"), F.min("q").alias("q"), F.max("q").alias("q_max"))
            .select("a", "c", F.col("src.doc_id").alias("first"), "last", "times", F.col("src.row").alias("row"), F.col("src.start").alias("start"),
                    F.col("src.n").alias("n"), F.when(F.col("p") == F.col("p_max"), F.col("p")).alias("p"),
                    F.when(F.col("q") == F.col("q_max"), F.col("q")).alias("q")))


def _paths(classes: DataFrame, name: str = "paths") -> DataFrame:
    """Heads of the repeated nonbranching paths, written: a, c, times, first, windows of the whole path."""
    rep = written(classes.where("first < last").select("a", "c", "first", "n", "p", "q", "times"), name)
    before = rep.select(F.col("a").alias("ba"), F.col("c").alias("bc"), F.col("q").alias("bq"))
    # the edge before is repeated too, is always the one before, and is always followed by this one
    linked = rep.join(before, (F.col("p") == F.col("bc")) & (F.col("bq") == F.col("c")), "left")
    now = written(linked.select("a", "c", F.coalesce("ba", "a").alias("ha"), F.coalesce("bc", "c").alias("hc")), name)
    while True:  # pointer doubling: as many rounds as the logarithm of the longest path
        up = now.select(F.col("a").alias("ha"), F.col("c").alias("hc"), F.col("ha").alias("ua"), F.col("hc").alias("uc"))
        moving = now.where("a <> ha OR c <> hc").join(up, ["ha", "hc"])
        nxt = written(moving.select("a", "c", F.col("ua").alias("ha"), F.col("uc").alias("hc"), F.expr("ua <> ha OR uc <> hc").alias("moved"))
                      .unionByName(now.where("a = ha AND c = hc").withColumn("moved", F.lit(False))), name)
        moved = not nxt.where("moved").isEmpty()
        drop(now)
        now = nxt.drop("moved")
        now._scratch = nxt._scratch
        if not moved:
            break
    sums = rep.join(now, ["a", "c"]).groupBy("ha", "hc").agg(F.sum("n").cast("int").alias("n"), F.min("first").alias("first"), F.max("times").alias("times"))
    heads = written(sums.select(F.col("ha").alias("a"), F.col("hc").alias("c"), "first", "n", "times"), "heads")
    for table in (rep, now):
        drop(table)
    return heads


def _branch_masks(docs: DataFrame, facts: DataFrame, classes: DataFrame, window: int) -> DataFrame:
    """For edges of branching k-mers, written: which of their windows start in an earlier document (bit mask by window)."""
    many = classes.groupBy("a").agg(F.count("*").alias("edges"), F.min("first").alias("lo"), F.max("last").alias("hi")).where("edges > 1 AND lo < hi")
    picked = classes.join(many.select("a"), "a", "left_semi")
    wanted = _by_text(facts, picked.groupBy("row").agg(F.collect_list(F.struct("a", "c", "start", "n")).alias("at")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(1))
            ats = batch.column(2)
            for r in range(batch.num_rows):
                words = K.words_of(data, offsets, r, r + 1)[0]
                at = ats[r].values
                start, n = np.asarray(at.field("start")), np.asarray(at.field("n"))
                bit = np.concatenate([np.arange(k) for k in n])
                pos = np.repeat(start, n) + bit
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.asarray(at.field("a")), n)), pa.array(K.hash_windows(words, window)[pos].view(np.int64)),
                     pa.array(np.full(len(pos), batch.column(0)[r].as_py(), np.int64)),
                     pa.array(np.repeat(np.asarray(at.field("c")), n)), pa.array(bit, pa.int8())],
                    ["a", "w", "first", "c", "bit"])

    rows = _texts(docs, wanted).mapInArrow(work, "a long, w long, first long, c long, bit byte")
    windows = written(rows, "windows")
    earliest = windows.groupBy("a", "w").agg(F.min("first").alias("lo"), F.max("first").alias("hi")).where("lo < hi").drop("hi")
    hit = windows.join(earliest, ["a", "w"]).where("lo < first")
    masks = written(hit.groupBy("a", "c").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")), "masks")
    drop(windows)
    return masks


def _by_text(facts: DataFrame, by_row: DataFrame) -> DataFrame:
    """(doc_id, key, at) from (row, at); equal rows of one doc_id have equal places, so one of them stands for all."""
    return (facts.select("row", "doc_id", "key").join(by_row, "row").groupBy("doc_id", "key").agg(F.min_by("at", "row").alias("at")))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text, at, key) of the rows with something wanted, one by one."""
    return docs.select("doc_id", "text", text_key().alias("key")).join(wanted, ["doc_id", "key"]).select("doc_id", "text", "at", "key")


def repeated_spans(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, facts: DataFrame | None = None) -> DataFrame:
    """Where windows that start in an earlier document begin, written: row, start, n, mask.

    ``row`` numbers the rows of ``facts`` (``written_edges``).  A row covers the
    ``n`` windows from word ``start`` on (all when ``mask`` is -1, else those whose
    bit is set), so words ``start`` to ``start + n + window - 1``.
    """
    if window - kmer + 1 > 62:
        raise ValueError("window - kmer must be at most 61: windows of an edge are bits of a long")
    facts = facts if facts is not None else written_edges(docs, window, kmer)
    shared = shared_edges(facts)
    classes = written(_classes(shared), "classes")
    heads = _paths(classes)
    masks = _branch_masks(docs, facts, classes, window)
    # later documents share a path whole; in the first document of an edge only its masked windows are earlier elsewhere
    later = _meet(shared.select("doc_id", "row", "a", "c", "start"), heads, ["a", "c"]).where("first < doc_id").select(
        "row", "start", "n", F.lit(-1).cast("bigint").alias("mask"))
    # the source occurrence itself, and what else stands in its document
    masked = written(classes.select("a", "c", "first", "n", "times").join(masks, ["a", "c"]), "masked")
    own = _meet(shared.select("doc_id", "row", "a", "c", "start"), masked, ["a", "c"]).where("first = doc_id").select("row", "start", "n", "mask")
    spans = written(later.unionByName(own), "spans")
    for table in (shared, classes, heads, masks, masked):
        drop(table)
    return spans


def remove_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) for every document row; kept words joined by one space.

    kept_text is null where nothing was removed (the input text stands).  Null
    or empty text: no words, hash of the empty string.  Rows with one doc_id
    are not earlier than each other; a null doc_id is neither earlier nor later
    than any, so such rows stay whole.  Texts under ``window`` words stay whole.
    An empty table gives an empty table; only doc_id and text are read, so further
    columns of any name do not clash.
    """
    docs = docs.select("doc_id", "text")
    facts = written_edges(docs, window, kmer)
    spans = repeated_spans(docs, window, kmer, facts)
    plan = _by_text(facts, spans.groupBy("row").agg(F.collect_list(F.struct("start", "n", "mask")).alias("at")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(1))
            ats, out = batch.column(2), []
            for r in range(batch.num_rows):
                hashes, starts, ends, _ = K.words_of(data, offsets, r, r + 1)
                at = ats[r].values
                start, n, mask = (np.asarray(at.field(f)).astype(np.int64) for f in ("start", "n", "mask"))
                delta = np.zeros(len(hashes) + 1, np.int64)
                whole = mask == _FULL
                np.add.at(delta, start[whole], 1)
                np.add.at(delta, start[whole] + n[whole] + window - 1, -1)
                for s, m in zip(start[~whole], mask[~whole], strict=True):
                    for b in range(int(m).bit_length()):
                        if m >> b & 1:
                            delta[s + b] += 1
                            delta[s + b + window] -= 1
                keep = np.cumsum(delta[:-1]) == 0
                raw, base = data.tobytes()[offsets[r]:offsets[r + 1]], offsets[r]
                text = b" ".join(raw[s - base:e - base] for s, e in zip(starts[keep], ends[keep], strict=True))
                out.append((batch.column(0)[r].as_py(), batch.column(3)[r].as_py(), int((~keep).sum()), hashlib.sha256(text).hexdigest(), text.decode()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()), strict=True)],
                    ["doc_id", "key", "n_removed", "kept_sha256", "kept_text"])

    cut = (_texts(docs, plan).mapInArrow(work, "doc_id long, key binary, n_removed long, kept_sha256 string, kept_text string")
           .dropDuplicates(["doc_id", "key"]))
    base = facts.select("doc_id", "key", "n_words", "words_sha256")
    return (base.join(cut, ["doc_id", "key"], "left")
            .select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
                    F.coalesce("kept_sha256", "words_sha256").alias("kept_sha256"), "kept_text"))
