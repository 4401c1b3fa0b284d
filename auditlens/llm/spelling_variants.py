"""Spelling variants by Bloom-guided neighbourhoods (operator 12).

Two words are *near* if one inserted, deleted or replaced code point turns one
into the other.  The vocabulary (distinct words with their counts, made by one
shuffle with partial counts) is far smaller than the corpus; the neighbourhoods
of its words are not, so they are never shuffled:

1. The vocabulary is written once.  Per word length it gives blocked Bloom
   filters: a key sets one bit in each of the 8 words (64 bits) of one block.
   A length is cut into as many shards as keep each shard under
   ``SHARD_BYTES``; shards are built in tasks of their own.
2. Filters are broadcast in rounds of at most ``ROUND_BYTES`` (the sizes follow
   from the counts by length, so the bound holds before anything is built).
   Each word generates its deletions (shorter words) and its replacements by
   greater code points (same length) as hashes that follow from the word's own
   hash, and probes them.  Insertions and replacements by smaller code points
   are the same pairs seen from the other word.
3. Only positives become strings and are shuffled to an exact join with the
   vocabulary, which removes the false ones.

One more round is one more pass over the vocabulary (not over the corpus); a
vocabulary of 25 million words takes one round.  Forms are then followed to the
last by pointer doubling; a form has ``RATIO`` times the count of its word, so
chains have at most log5 of the largest count as length.

Defined results: null and empty texts have no words; a null doc_id counts as an
empty one for the planted deletions; equal rows count twice; ties between forms go to the least
in code-point order; an empty table gives an empty table; only the id and text
columns are read, so further columns of any name do not clash.  Very long runs of
letters are words like others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.llm import kernels as K
from auditlens.llm.common import drop, ready, written

MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
#: Letters that words are made of once A-Z are lower-cased.
ALPHABET = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))
WORD = r"[A-Za-zÀ-ÿ]+"
#: Filter bytes a key (of 8 bits in a block of 64 bytes), a shard, and a round of shards.
KEY_BYTES, SHARD_BYTES, ROUND_BYTES = 2.5, 8 << 20, 64 << 20
#: Edits in memory at a time.
EDITS = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n + 1, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def _values(codes: np.ndarray) -> np.ndarray:
    """A spread 64-bit value per code point."""
    return K.mix((codes.astype(np.uint64) + _U(1)) * _U(_BASE))


def _codes(words: list[str], length: int) -> np.ndarray:
    """(word, position) code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def _raw(codes: np.ndarray) -> np.ndarray:
    """Polynomial hash of each word."""
    return (_values(codes) * _powers(_BASE, codes.shape[1])[:codes.shape[1]]).sum(axis=1, dtype=np.uint64)


def _split(keys: np.ndarray, n_shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of a key, and the mixed key that chooses block and bits in it."""
    h = K.mix(keys)
    return (h >> _U(40)) % _U(n_shards), K.mix(h ^ _U(0x5851F42D4C957F2D))


def _bit(h: np.ndarray, i: int) -> np.ndarray:
    """Bit of word i of the block (six bits of a second mix each)."""
    return _U(1) << ((K.mix(h + _U(7)) >> _U(6 * i)) & _U(63))


def _set(filter_words: np.ndarray, h: np.ndarray) -> None:
    block = (h % _U(len(filter_words) // 8)).astype(np.int64) * 8
    for i in range(8):
        np.bitwise_or.at(filter_words, block + i, _bit(h, i))


def _holds(filter_words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of ``h`` that the filter may hold; each word of the block is looked at for what is left only."""
    at = np.arange(len(h))
    block = (h % _U(len(filter_words) // 8)).astype(np.int64) * 8
    for i in range(8):
        bit = _bit(h[at], i)
        at = at[filter_words[block[at] + i] & bit == bit]
    return at


def _plan(lengths: dict[int, int]) -> list[dict[int, tuple[int, int, list[int]]]]:
    """Rounds of {length: (shards of the length, blocks a shard, shards of this round)} within the bounds."""
    rounds, used = [{}], 0
    for length, n in sorted(lengths.items()):
        total = max(64, math.ceil(n * KEY_BYTES))
        shards = -(-total // SHARD_BYTES)
        blocks = -(-total // (64 * shards))
        for s in range(shards):
            if used and used + 64 * blocks > ROUND_BYTES:
                rounds.append({})
                used = 0
            rounds[-1].setdefault(length, (shards, blocks, []))[2].append(s)
            used += 64 * blocks
    return rounds


def _by_length(words: list[str]) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for w in words:
        out.setdefault(len(w), []).append(w)
    return out


def _build(plan: dict[int, tuple[int, int, list[int]]]):
    """Filter bytes of one shard, from all its words (batch by batch)."""
    def build(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, shard = key[0].as_py(), key[1].as_py()
        shards, blocks, _ = plan[length]
        words = np.zeros(8 * blocks, np.uint64)
        for batch in batches:
            found = batch.column("word").to_pylist()
            if found:
                of, h = _split(_raw(_codes(found, length)), shards)
                _set(words, h[of == shard])
        yield pa.RecordBatch.from_pylist([{"length": length, "shard": shard, "bits": words.tobytes()}],
                                         pa.schema([("length", pa.int32()), ("shard", pa.int32()), ("bits", pa.binary())]))
    return build


def _shard_column(plan: dict[int, tuple[int, int, list[int]]]):
    """(word, length, shard) of words in the shards of a round."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, words in _by_length(batch.column("word").to_pylist()).items():
                if length in plan:
                    shards, _, here = plan[length]
                    of = _split(_raw(_codes(words, length)), shards)[0].astype(np.int32)
                    keep = np.isin(of, here)
                    yield pa.RecordBatch.from_arrays([pa.array(words).filter(pa.array(keep)), pa.array(np.full(int(keep.sum()), length, np.int32)),
                                                      pa.array(of[keep])], names=["word", "length", "shard"])
    return deal


def _edits(codes: np.ndarray, letters: np.ndarray) -> Iterator[tuple[int, str, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, kind, hashes, word rows, detail) of the edits of words of one length, a position at a time.

    ``detail`` is the position for deletions, and position and letter for replacements.
    """
    n, length = codes.shape
    power, value = _powers(_BASE, length), _values(codes)
    parts = value * power[:length]
    total = parts.sum(axis=1, dtype=np.uint64)
    before = np.cumsum(parts, axis=1, dtype=np.uint64) - parts
    shift, new, rows = _U(_INVERSE), _values(letters), np.arange(n)
    for i in range(length):
        # in a stretch of equal letters every deletion gives the same word: its last one stands for all
        one = rows if i + 1 == length else np.flatnonzero(codes[:, i] != codes[:, i + 1])
        gone = before[one, i] + (total[one] - before[one, i] - parts[one, i]) * shift
        yield length - 1, "delete", gone, one, np.full(len(one), i)
        greater = letters[None, :] > codes[:, i:i + 1]
        r, x = np.nonzero(greater)
        yield length, "replace", (total - parts[:, i])[r] + new[x] * power[i], r, i * len(letters) + x


def _probe(plan: dict[int, tuple[int, int, list[int]]], filters, alphabet: str):
    """(word, other) for the edits that a filter of the round may hold."""
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {k: np.frombuffer(v, np.uint64) for k, v in filters.value.items()}
        letters = np.array(sorted(map(ord, alphabet)), np.uint32)
        for batch in batches:
            for length, words in _by_length(batch.column("word").to_pylist()).items():
                for at in range(0, len(words), step := max(1, EDITS // len(letters))):
                    some = words[at:at + step]
                    for target, kind, hashes, rows, detail in _edits(_codes(some, length), letters):
                        if target not in plan:
                            continue
                        shards, _, here = plan[target]
                        of, h = _split(hashes, shards)
                        found = []
                        for s in here:
                            mine = np.flatnonzero(of == s) if shards > 1 else np.arange(len(h))
                            found.append(mine[_holds(bits[target, s], h[mine])])
                        near, near_of = [], []
                        for e in np.concatenate(found):
                            w, d = some[rows[e]], int(detail[e])
                            i, x = (d, None) if kind == "delete" else divmod(d, len(letters))
                            near_of.append(w)
                            near.append(w[:i] + ("" if x is None else chr(letters[x])) + w[i + 1:])
                        if near:
                            yield pa.RecordBatch.from_arrays([pa.array(near_of), pa.array(near)], names=["word", "other"])
    return probe


def near_pairs(vocabulary: DataFrame, alphabet: str = ALPHABET) -> tuple[DataFrame, DataFrame]:
    """(word, n, other, n_other) for every ordered pair of near words; and the written candidates behind it.

    ``vocabulary`` (word, n) has distinct words over ``alphabet``; it is read
    once a round and twice by the exact join.
    """
    spark = vocabulary.sparkSession
    ready(spark)
    by_length = {r["length"]: r["n"] for r in vocabulary.groupBy(F.char_length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    words = vocabulary.select("word")
    tasks = max(spark.sparkContext.defaultParallelism, -(-sum(by_length.values()) // 20_000))
    spread = words.repartition(tasks, "word")
    parts = []
    for plan in _plan(by_length):
        if not plan:
            continue
        rows = (words.mapInArrow(_shard_column(plan), "word string, length int, shard int")
                .groupBy("length", "shard").applyInArrow(_build(plan), "length int, shard int, bits binary"))
        # at most ROUND_BYTES by the plan
        filters = spark.sparkContext.broadcast({(r["length"], r["shard"]): bytes(r["bits"]) for r in rows.collect()})
        parts.append(written(spread.mapInArrow(_probe(plan, filters, alphabet), "word string, other string"), "variants"))
        filters.destroy()
    if not parts:
        parts = [written(spark.createDataFrame([], "word string, other string"), "variants")]
    candidates = parts[0]
    for p in parts[1:]:
        candidates = candidates.unionByName(p)
    candidates._parts = parts
    left = vocabulary.select("word", "n")
    right = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("n_other"))
    pairs = candidates.join(right, "other").join(left, "word").select("word", "n", "other", "n_other")
    back = F.explode(F.array(F.struct("word", "n", "other", "n_other"), F.struct(
        F.col("other").alias("word"), F.col("n_other").alias("n"), F.col("word").alias("other"), F.col("n").alias("n_other"))))
    return pairs.select(back.alias("p")).select("p.*"), candidates


def _last_forms(forms: DataFrame, largest: int) -> DataFrame:
    """(word, root): forms followed to the last, from (word, form) rows.

    Counts grow by ``RATIO`` with every step, so doubling the reach
    log2(log5(largest count)) times covers every chain.
    """
    steps = max(1, math.ceil(math.log(max(largest, RATIO), RATIO)))
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) + 1):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return now


def spelling_variants(vocabulary: DataFrame, alphabet: str = ALPHABET, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of a written ``vocabulary`` (word, n).

    ``form`` is the near word of largest n (ties: least in code-point order)
    with at least ``ratio`` times the word's n; ``root`` the last form reached.
    """
    pairs, candidates = near_pairs(vocabulary, alphabet)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best"))
    near = written(best.select("word", "n_near", F.col("best.other").alias("other"), (-F.col("best.less")).alias("n_other")), "near")
    for p in candidates._parts:
        drop(p)
    known = written(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(F.col("n_other") >= ratio * F.col("n"), F.col("other")).alias("form"),
        F.when(F.col("n_other") >= ratio * F.col("n"), F.col("n_other")).alias("form_n")), "forms")
    drop(near)
    largest = known.agg(F.max("n")).first()[0] or 0
    roots = _last_forms(known.where("form is not null"), largest)
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def count_words(words: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """Vocabulary (word, n), written: words of at least ``min_letters`` code points that occur ``min_count`` times."""
    counted = words.where(F.char_length("word") >= min_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    return written(counted, "vocabulary")


def letter_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, word): every run of letters of the whole texts, A-Z lower-cased."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", upper, lower), F.lit(WORD), F.lit(0))).alias("word"))


def with_planted_deletions(words: DataFrame) -> DataFrame:
    """The runs with one code point deleted where 199 divides the crc32 h of ``doc_id:word``: the one at h % length."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))

    def without(word: Column) -> Column:
        at = F.pmod(h, F.char_length(word)).cast("int")
        return F.concat(F.substring(word, F.lit(1), at), F.substr(word, at + 2))

    return words.select(F.when(h % 199 == 0, without(F.col("word"))).otherwise(F.col("word")).alias("word"))


def variant_groups(docs: DataFrame) -> DataFrame:
    """Spelling variants of all words of ``docs`` (doc_id, text), the planted deletions included."""
    return spelling_variants(count_words(with_planted_deletions(letter_runs(docs))))
