"""Periodic runs of words by a dictionary of basic factors (operator 11).

A *run* is a longest stretch of words with smallest period q and a length of at
least 2 q.  For every power of two m the words of a document are named by the
m words that start there (equal names mean equal words: level 2 m pairs two
names of level m, so names are exact, not hashes).  A run of period q with
m <= q < 2 m shows the same name at two places q apart, hence within 2 m.

Per name, occurrences are taken in order.  Successors at most m / 2 apart make
an arithmetic progression, whose step p is the period of the factor; the others
stand more than m / 2 apart, so a progression meets at most four others within
2 m.  Two progressions A and B of one name propose

* the distance of their first and of their last members (a run of period q
  carries an end of A's stretch of period p over to B's, unless the two
  stretches touch), and
* where the stretches touch, every step between that leaves a run of two
  periods; each of these is a run of its own.

Looking at the next occurrence alone would not do: in ``0101010 0101010`` every
factor of 4 letters comes again before 7 letters are over.

Proposals are extended both ways by comparing names from the largest power
down, and equal stretches keep their smallest period.  Time is in proportion
to words times levels; a factor that occurs once leaves the dictionary, so
plain prose needs three or four levels.  Each document is handled on its own
inside a map; tasks take documents in batches of about ``kernels.CHUNK_BYTES``,
and memory follows that or the longest single text (4 bytes a word and level).

Defined results: null and empty texts have no words and no runs; a null doc_id
is kept; equal rows are judged each on its own, ties do not matter (every run is
given); an empty table gives an empty table; only the id and text columns are
read, so further columns of any name do not clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.llm import kernels as K
from auditlens.llm.common import ready

#: A run has at least this many words, and two periods.
MIN_LENGTH = 12

_RUN = "struct<start:long,length:long,period:long>"
_OUT = f"doc_id long, n_words long, runs array<{_RUN}>, collapsed string"
_ARROW = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _names(keys: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of the places ``at`` by key, for keys seen twice or more.

    Returns the name of every place (-1: occurs once or not at all; one more at
    the end, for places out of the text), the places left, and these in the
    order of (name, place) with their names.
    """
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    name = np.cumsum(new) - 1
    many = np.bincount(name)[name] > 1 if len(k) else new
    places, name = at[order][many], name[many]
    out = np.full(size + 1, -1, np.int32)
    out[places] = name
    return out, np.sort(places), places, name


def _reach(levels: list[np.ndarray], at: np.ndarray, gap: np.ndarray, step: int) -> np.ndarray:
    """Words that places ``at`` and ``at + gap`` have in common, to the right (step 1, from ``at``) or left (step -1, before it)."""
    n = len(levels[0]) - 1
    got = np.zeros(len(at), np.int64)
    for k in reversed(range(len(levels))):
        names, size, live = levels[k], 1 << k, np.arange(len(at))
        while len(live):
            x = at[live] + got[live] if step > 0 else at[live] - got[live] - size
            y = x + gap[live]
            inside = (x >= 0) & (y < n)
            a, b = names[np.where(inside, x, n)], names[np.where(inside, y, n)]
            live = live[(a == b) & (a >= 0)]
            got[live] += size
    return got


def _proposals(levels: list[np.ndarray], k: int, places: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) proposals of the level with factors of 2**k words, from its occurrences in (name, place) order."""
    m = 1 << k
    gap = np.diff(places)
    same = name[1:] == name[:-1]
    linked = same & (2 * gap <= m)
    head = np.flatnonzero(np.concatenate(([True], ~linked)))
    last = np.concatenate((head[1:] - 1, [len(places) - 1]))
    first_at, last_at, of = places[head], places[last], name[head]
    step = np.where(last > head, places[np.minimum(head + 1, len(places) - 1)] - places[head], 0)
    found_at, found = [], []
    for t in range(1, 5):
        a = np.arange(len(head) - t)
        a = a[(of[a] == of[a + t]) & (first_at[a + t] - last_at[a] < 2 * m)]
        if not len(a):
            break
        b = a + t
        for x, y in ((first_at[a], first_at[b]), (last_at[a], last_at[b])):
            ok = (y - x >= m) & (y - x < 2 * m)
            found_at.append(x[ok])
            found.append((y - x)[ok])
        p = np.maximum(step[a], step[b])
        many = p > 0
        a, b, p = a[many], b[many], p[many]
        if not len(a):
            continue
        # the stretches of period p around the two progressions
        xa, xb = first_at[a], first_at[b]
        left_a, right_a = xa - _reach(levels, xa, p, -1), xa + p + _reach(levels, xa, p, 1)
        left_b, right_b = xb - _reach(levels, xb, p, -1), xb + p + _reach(levels, xb, p, 1)
        low = m + (xb - xa - m) % p
        high = np.minimum.reduce([right_a - left_a, right_b - left_b, (right_b - left_a) // 2, np.full(len(a), 2 * m - 1)])
        count = np.where(right_a >= left_b, np.maximum(0, (high - low) // p + 1), 0)
        which = np.repeat(np.arange(len(a)), count)
        q = low[which] + p[which] * (np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count))
        found_at.append(np.maximum(left_a[which], left_b[which] - q))
        found.append(q)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_at), np.concatenate(found)


def find_runs(words: np.ndarray, bounds: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and then period.

    ``words`` holds word ids of several documents in a row, ``bounds`` where
    each starts and the last ends; runs never cross documents.
    """
    n = len(words)
    none = np.zeros(0, np.int64)
    if n == 0:
        return none, none, none
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    names, at, places, name = _names(doc * (int(words.max()) + 1) + words, np.arange(n), n)
    levels, orders = [names], [(places, name)]
    while len(at):
        size = 1 << (len(levels) - 1)
        names = levels[-1]
        after = names[np.minimum(at + size, n)]
        at = at[after >= 0]
        if not len(at):
            break
        names, at, places, name = _names(names[at].astype(np.int64) * n + after[after >= 0], at, n)
        if not len(at):
            break
        levels.append(names)
        orders.append((places, name))
    got_at, got = [], []
    for k, (places, name) in enumerate(orders):
        if len(places):
            x, q = _proposals(levels, k, places, name)
            # neighbouring proposals of one period belong to one run
            order = np.lexsort((x, q))
            x, q = x[order], q[order]
            lead = np.ones(len(x), bool)
            lead[1:] = (q[1:] != q[:-1]) | (x[1:] > x[:-1] + 1)
            got_at.append(x[lead])
            got.append(q[lead])
    x, q = (np.concatenate(got_at), np.concatenate(got)) if got else (none, none)
    start, end = x - _reach(levels, x, q, -1), x + q + _reach(levels, x, q, 1)
    ok = end - start >= np.maximum(min_length, 2 * q)
    start, end, q = start[ok], end[ok], q[ok]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    # one stretch, several periods: multiples of the smallest
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[keep], end[keep], q[keep]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def _word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Exact ids of the words at [starts, ends) of the bytes."""
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    packed = data[np.cumsum(inside[:-1]) > 0]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(packed))])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def _batches(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            data, offsets = K.text_bytes(batch.column(1))
            for i, j in K.chunks(offsets):
                _, starts, ends, bounds = K.words_of(data, offsets, i, j)
                base = offsets[i]
                words = _word_ids(data[base:offsets[j]], starts - base, ends - base) if len(starts) else np.zeros(0, np.int64)
                s, e, q = find_runs(words, bounds, min_length)
                first = np.searchsorted(s, bounds)
                # a word goes if it stands in a run after its first period
                delta = np.zeros(len(words) + 1, np.int64)
                np.add.at(delta, s + q, 1)
                np.add.at(delta, e, -1)
                gone = np.cumsum(delta[:-1]) > 0
                texts, counts = [], np.diff(bounds)
                for d in range(j - i):
                    kept = data[offsets[i + d]:offsets[i + d + 1]].tobytes().split()
                    if first[d + 1] > first[d]:
                        kept = [kept[x] for x in np.flatnonzero(~gone[bounds[d]:bounds[d + 1]])]
                    texts.append(b" ".join(kept))
                own = np.repeat(bounds[:-1], np.diff(first))
                runs = pa.StructArray.from_arrays([pa.array(s - own), pa.array(e - s), pa.array(q)], fields=list(_ARROW))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), runs),
                     pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_length: int = MIN_LENGTH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, runs (start, length, period; by start, then period) and the text collapsed.

    ``collapsed`` has the words joined by one space, each run cut to its first
    period.  One map, no shuffle.
    """
    ready(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_batches(min_length), _OUT)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a run planted in one document of ten, by the crc32 h of its id.

    From word a = floor(h / 10) % n on, the words repeat with period
    1 + floor((n - a) / (3 + floor(h / 10) % 8)).  A null doc_id plants nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def rewrite(words: Column) -> Column:
        n = F.size(words)
        return F.transform(F.array(F.struct(n.alias("n"), F.pmod(g, n).cast("int").alias("a"))), lambda x: F.transform(
            F.array(F.struct(x["a"].alias("a"), (1 + F.floor((x["n"] - x["a"]) / (3 + g % 8))).cast("int").alias("p"))),
            lambda y: F.array_join(F.transform(words, lambda w, i: F.when(i < y["a"], w).otherwise(
                F.get(words, y["a"] + F.pmod(i - y["a"], y["p"])))), " "))[0])[0]

    # the words are bound once, through a lambda variable
    planted = F.transform(F.array(split), lambda w: F.when(F.size(w) > 0, rewrite(w)))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(planted, F.col("text"))).otherwise(F.col("text")).alias("text"))


def run_digest(docs: DataFrame) -> DataFrame:
    """Digest of the runs of every document, the planted ones included (see the module for odd rows)."""
    runs = periodic_runs(with_planted_runs(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                                r["period"].cast("string"), F.lit("\n"))), "")
    return runs.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.l").alias("length"),
        (-F.col("best.p")).alias("period"), F.expr("(1000 * best.l) div (-best.p)").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
