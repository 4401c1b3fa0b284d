"""Language identification by multilingual mixture inference (operator 13).

A document is seen as n-grams drawn from a mixture of languages.  Each language
has a distribution over n-grams (lower-cased UTF-8 bytes, everything in ASCII
but letters is a space), counted over all labelled rows by Spark; per document
expectation-maximisation estimates the language proportions, and the set of
languages is chosen by penalised likelihood:

1. EM over all languages gives the proportions and a likelihood that no subset
   can exceed.  If the best single language comes within one penalty of it (or
   within half of one after a few rounds, which is most documents), the
   document has that one language.
2. Otherwise the language of least share leaves, EM runs again on the rest, and
   so on; the set of best penalised likelihood wins.

A further language costs ``PENALTY`` times log(number of n-grams) / 2, the BIC price
of a parameter times the n-grams that share a letter, since overlapping n-grams
are not independent, times a margin for words that look foreign.

The model has ``BUCKETS`` hashed n-grams a language (halved until it fits
``MODEL_BYTES``), so what is broadcast does not grow with the corpus.  Training
sums counts inside tasks and by one shuffle of (language, bucket); prediction is
a map.  Memory follows ``kernels.CHUNK_BYTES`` or the longest text, of which
only distinct n-grams stay.

Defined results: null texts and texts without a letter are ``und`` with score 0,
as is everything if no language was learned; letters without any n-gram known
get the alphabetically first language at an even score; equal shares go to the
alphabetically first; a null doc_id counts as an empty one for the split; equal rows are judged
alike, each on its own; an empty table gives an empty table; only the id, text and
language columns are read, so further columns of any name do not clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.llm import kernels as K
from auditlens.llm.common import ready

GRAM = 3
BUCKETS = 1 << 16
MODEL_BYTES = 64 << 20
SMOOTHING = 0.5
PENALTY = 6.0
ROUNDS = 20
#: EM rounds after which documents that one language explains within half a penalty go no further.
FIRST_ROUNDS = 6
#: Likelihoods (n-gram, language) in memory at a time, one document at least.
CELLS = 8 << 20
#: Prediction of texts without a letter.
UNKNOWN = "und"

_OUT = "doc_id long, held_out boolean, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
_SHARE = [pa.field("lang", pa.string()), pa.field("share", pa.float64())]

_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[:128] = 32
_CLEAN[97:123] = np.arange(97, 123)


def _grams(column: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after, row of every n-gram in the range, bucket), text chunk by text chunk.

    A space stands before and after each text; n-grams with two spaces in a
    row tell nothing and are left out.
    """
    data, offsets = K.text_bytes(pc.utf8_lower(column))
    for i, j in K.chunks(offsets):
        cuts = offsets[i:j + 1] - offsets[i]
        n = len(cuts) - 1
        clean = np.full(int(cuts[-1]) + n + 1, 32, np.uint8)
        row = np.repeat(np.arange(n), np.diff(cuts))
        clean[np.arange(int(cuts[-1])) + row + 1] = _CLEAN[data[offsets[i]:offsets[j]]]
        # text r stands at cuts[r] + r + 1, between spaces shared with its neighbours
        count = max(0, len(clean) - GRAM + 1)
        code, gap = np.zeros(count, np.uint64), np.zeros(count, bool)
        for k in range(GRAM):
            code = code * np.uint64(256) + clean[k:k + count]
            if k:
                gap |= (clean[k:k + count] == 32) & (clean[k - 1:k - 1 + count] == 32)
        owner = np.repeat(np.arange(n), np.diff(cuts) + 1)[:count]
        inner = np.flatnonzero(~gap)
        # an n-gram that reaches over the space between two texts holds a space inside
        inner = inner[inner + GRAM - 1 <= (cuts[1:] + np.arange(n) + 1)[owner[inner]]]
        yield i, j, owner[inner], (K.mix(code[inner] + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)


def _counter(buckets: int):
    """(lang, bucket, n) of a partition's labelled texts, summed before they leave the task."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            of = langs.indices.to_numpy()
            for name in langs.dictionary.to_pylist():
                sums.setdefault(name, np.zeros(buckets, np.int64))
            for i, _, row, bucket in _grams(batch.column(1), buckets):
                lang = of[i + row]
                for x, name in enumerate(langs.dictionary.to_pylist()):
                    sums[name] += np.bincount(bucket[lang == x], minlength=buckets)
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])
    return count


def learn_languages(labelled: DataFrame, lang: str = "lang", text: str = "text", buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Languages and their n-gram log probabilities (bucket, language) from all rows with a language and a text."""
    ready(labelled.sparkSession)
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    n_langs = rows.select("lang").distinct().count()
    while buckets * n_langs * 4 > MODEL_BYTES:
        buckets //= 2
        if buckets < 1024:
            raise ValueError(f"{n_langs} values of {lang}: not a language column")
    # at most buckets x languages rows
    found = rows.mapInArrow(_counter(buckets), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    counts = np.zeros((buckets, len(names)))
    where = {x: i for i, x in enumerate(names)}
    counts[found.column("bucket").to_numpy(), [where[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    return names, np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * buckets)).astype(np.float32)


def _mix(p: np.ndarray, c: np.ndarray, first: np.ndarray, doc: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM: proportions by document, and the log likelihood relative to the scale of ``p``.

    ``p`` (n-gram, language) holds likelihoods, ``c`` counts, ``first`` where
    each document's n-grams start; languages of share 0 stay out.
    """
    total = np.add.reduceat(c, first)[:, None]
    for _ in range(rounds):
        weight = c / np.einsum("ij,ij->i", p, share[doc])
        share = share * np.add.reduceat(p * weight[:, None], first, axis=0) / total
    return share, np.add.reduceat(c * np.log(np.einsum("ij,ij->i", p, share[doc])), first)


def infer_mixture(logp: np.ndarray, doc: np.ndarray, bucket: np.ndarray, n_docs: int, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(share of each language, score) by document, from its n-grams.

    Languages that are not selected have share 0.  The score is the share of
    the largest language; in documents of one language, its posterior
    against each other one.  Documents without n-grams get even shares.
    """
    langs = logp.shape[1]
    if len(doc) * langs > CELLS and n_docs > 1:
        half = n_docs // 2
        low = doc < half
        parts = [infer_mixture(logp, doc[low], bucket[low], half, penalty, rounds),
                 infer_mixture(logp, doc[~low] - half, bucket[~low], n_docs - half, penalty, rounds)]
        return np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
    shares, scores = np.full((n_docs, langs), 1.0 / langs), np.full(n_docs, 1.0 / langs)
    if not len(doc):
        return shares, scores
    key, count = np.unique(doc * len(logp) + bucket, return_counts=True)
    owner, c = key // len(logp), count.astype(np.float64)
    here, first, at = np.unique(owner, return_index=True, return_inverse=True)
    lp = logp[key % len(logp)].astype(np.float64)
    top = lp.max(axis=1, keepdims=True)
    p = np.exp(lp - top)
    single = np.add.reduceat((lp - top) * c[:, None], first, axis=0)
    price = penalty * np.log(np.maximum(2, np.add.reduceat(c, first))) / 2
    best_one = single.max(axis=1)
    early = min(FIRST_ROUNDS, rounds)
    share, ll = _mix(p, c, first, at, np.full((len(here), langs), 1.0 / langs), early)
    pick = np.zeros_like(share)
    pick[np.arange(len(here)), single.argmax(axis=1)] = 1.0
    value = best_one.copy()
    score = 1.0 / np.exp(single - best_one[:, None]).sum(axis=1)
    def again(docs: np.ndarray, start: np.ndarray, rounds: int):
        """EM on some documents only."""
        rows = np.flatnonzero(np.isin(at, docs))
        sub = np.searchsorted(docs, at[rows])
        return _mix(p[rows], c[rows], np.searchsorted(sub, np.arange(len(docs))), sub, start, rounds)

    open_ = np.flatnonzero(ll - price / 2 > best_one)
    if len(open_):
        share[open_], ll[open_] = again(open_, share[open_], rounds - early)
        open_ = open_[ll[open_] - price[open_] > best_one[open_]]
    now = share
    for size in range(langs, 1, -1):
        if not len(open_):
            break
        if size < langs:
            # the least share leaves
            start = now[open_].copy()
            start[np.arange(len(open_)), np.where(start > 0, start, np.inf).argmin(axis=1)] = 0
            start /= start.sum(axis=1, keepdims=True)
            found, gain = again(open_, start, rounds)
            now[open_] = found
        else:
            found, gain = now[open_], ll[open_]
        gain = gain - price[open_] * (size - 1)
        better = gain > value[open_]
        chosen = open_[better]
        value[chosen], pick[chosen], score[chosen] = gain[better], found[better], found[better].max(axis=1)
    shares[here], scores[here] = pick, score
    return shares, scores


def _predictor(model, penalty: float):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logp = model.value
        langs = len(names)
        for batch in batches:
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            for i, j, row, bucket in _grams(batch.column("text"), max(1, len(logp))):
                n = j - i
                if langs:
                    share, score = infer_mixture(logp, row, bucket, n, penalty)
                known = letters[i:j] & bool(langs)
                pred, lists, scores = [], [], np.zeros(n)
                for d in range(n):
                    if known[d]:
                        order = np.argsort(-share[d], kind="stable")
                        pred.append(names[order[0]])
                        lists.append([{"lang": names[x], "share": float(share[d, x])} for x in order if share[d, x] > 0])
                        scores[d] = min(1.0, score[d])
                    else:
                        pred.append(UNKNOWN)
                        lists.append([])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, n), batch.column("held_out").slice(i, n), pa.array(pred, pa.string()), pa.array(scores),
                     pa.array(lists, pa.list_(pa.struct(_SHARE)))], names=["doc_id", "held_out", "lang_pred", "score", "languages"])
    return predict


def held_out(doc_id: str = "doc_id") -> Column:
    """True where the crc32 of the id as text leaves 2 by 4."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify_languages(docs: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """doc_id, held_out, lang_pred, score and languages (lang, share; largest first) of every row of ``docs``.

    Learns from text and lang of the rows that are not held out; a prediction
    sees the text alone.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn_languages(docs.where(~held_out())))  # at most MODEL_BYTES
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"),
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(_predictor(model, penalty), _OUT)
