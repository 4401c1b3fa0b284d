"""Line sequence labelling with a linear-chain conditional random field (operator 5).

Each line that has a word is described by bucketed features; a two-label CRF
(content / boilerplate) scores the line sequence and Viterbi decoding labels
it.  A document stays if enough of its words are in content lines and it
passes the fixed base rules.  The CRF is trained here, on a bounded sample of
labelled documents; scoring is one map over whole texts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm import kernels as K
from auditlens.llm.common import ready

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PCT = 20, 8, 30
#: Share of words in content lines from which a document stays.
MIN_CONTENT_SHARE = 0.5
#: Added to the content score of every line: dropping a clean document costs more than keeping a poor one.
CONTENT_BIAS = 2.0
#: Bound of the training sample: documents per quality label, and lines of each.
SAMPLE_DOCS, SAMPLE_LINES = 1_000, 32

#: Bucket edges of the line features, in the order of `line_features`.
EDGES: list[list[float]] = [
    [20, 40, 80, 160, 320, 640],          # characters
    [2, 4, 8, 16, 32, 64, 128],           # words
    [2.5, 3.5, 4.5, 5.5, 7, 9, 12],       # characters per word
    [0.0001, 0.02, 0.05, 0.1, 0.2, 0.3],  # share of symbols
    [0.02, 0.05, 0.1, 0.2, 0.4, 0.7],     # share of capital letters
    [0.01, 0.03, 0.06, 0.1, 0.2],         # share of other punctuation
    [0.0001, 0.02, 0.1, 0.3],             # share of digits
    [0.0001, 0.1, 0.3, 0.6],              # share of words in repeated windows of the document
    [0.0001, 0.05, 0.1, 0.2, 0.4],        # share of words equal to the word before
    [0.5],                                # equal to an earlier line
    [0.5],                                # ends like a sentence
]
WIDTH = max(map(len, EDGES)) + 1

_CLASS = np.zeros(256, np.uint8)
for _c in SYMBOLS:
    _CLASS[_c] = 1
_CLASS[ord("A"):ord("Z") + 1] = 2
for _c in b"!\"'()+,-./:;=?@[\\]^_`{}~":
    _CLASS[_c] = 3
_CLASS[ord("0"):ord("9") + 1] = 4
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[list(b".!?\"')")] = True


@dataclass
class LineModel:
    """CRF weights: a content score per feature bucket, and label transitions (0 boilerplate, 1 content)."""
    weights: np.ndarray      # (features, WIDTH)
    start: np.ndarray        # (2,)
    step: np.ndarray         # (2, 2) from, to
    bias: float = CONTENT_BIAS

    def emissions(self, buckets: np.ndarray) -> np.ndarray:
        return self.weights[np.arange(buckets.shape[1]), buckets].sum(axis=1) + self.bias


@dataclass
class Lines:
    """Lines with a word of some documents, and per-document figures."""
    buckets: np.ndarray      # (lines, features)
    words: np.ndarray        # words per line
    duplicate: np.ndarray    # equal to an earlier line of its document
    bounds: np.ndarray       # document r owns lines bounds[r]:bounds[r+1]
    base: dict[str, np.ndarray]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def line_features(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> Lines:
    """Lines and base figures of rows i..j."""
    hashes, starts, ends, of = K.words_of(data, offsets, i, j)
    base, text = offsets[i], data[offsets[i]:offsets[j]]
    cuts = offsets[i:j + 1] - base
    starts, ends = starts - base, ends - base
    n_docs = j - i
    repeated = np.zeros(len(hashes), bool)
    for r in range(n_docs):
        a, b = of[r], of[r + 1]
        if b - a > WINDOW:
            w = K.hash_windows(hashes[a:b], WINDOW)
            order = np.argsort(w, kind="stable")
            same = w[order][1:] == w[order][:-1]
            if same.any():
                marks = np.zeros(len(w), bool)
                marks[order[1:][same]] = True
                marks[order[:-1][same]] = True
                repeated[a:b] = K.covered(marks, WINDOW, b - a)
    # line bounds: document starts and what follows a line feed
    begins = np.unique(np.concatenate([cuts[:-1], np.flatnonzero(text == 10) + 1]))
    begins = begins[begins < len(text)]
    stops = np.append(begins[1:], len(text))
    line_of_word = np.searchsorted(begins, starts, side="right") - 1
    n_words = np.bincount(line_of_word, minlength=len(begins))
    kind = _CLASS[text]
    points = (text & 0xC0) != 0x80
    solid = ~K._IS_SPACE[text]
    edges = np.append(begins, len(text))
    count = {k: _sums(kind == k, edges) for k in (1, 2, 3, 4)} if len(begins) else {k: np.zeros(0) for k in (1, 2, 3, 4)}
    chars = _sums(points & solid, edges) if len(begins) else np.zeros(0)
    rep = np.bincount(line_of_word, weights=repeated, minlength=len(begins))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    echo = np.bincount(line_of_word, weights=again, minlength=len(begins))
    doc_of_line = np.searchsorted(cuts, begins, side="right") - 1
    with_word = np.flatnonzero(n_words > 0)
    dup = np.zeros(len(begins), bool)
    raw = text.tobytes()
    seen: set[bytes] = set()
    at = -1
    for k in with_word:
        if doc_of_line[k] != at:
            at, seen = doc_of_line[k], set()
        line = raw[begins[k]:stops[k]].removesuffix(b"\n")
        if line in seen:
            dup[k] = True
        else:
            seen.add(line)
    last_word = np.zeros(len(begins), np.int64)
    last_word[line_of_word] = ends  # the last word of a line wins
    k = with_word
    total = np.maximum(chars[k], 1)
    values = [chars[k], n_words[k], chars[k] / np.maximum(n_words[k], 1), count[1][k] / total, count[2][k] / total,
              count[3][k] / total, count[4][k] / total, rep[k] / np.maximum(n_words[k], 1), echo[k] / np.maximum(n_words[k], 1), dup[k],
              _SENTENCE_END[text[np.maximum(last_word[k] - 1, 0)]] if len(text) else np.zeros(0)]
    buckets = np.stack([np.digitize(v, e) for v, e in zip(values, EDGES, strict=True)], axis=1) if len(k) else np.zeros((0, len(EDGES)), np.int64)
    bounds = np.searchsorted(doc_of_line[k], np.arange(n_docs + 1))
    figures = {"n_words": np.diff(of), "word_chars": _sums(points & solid, cuts), "n_symbols": _sums(kind == 1, cuts),
               "n_dup_lines": _sums(dup[k], bounds), "n_repeat_words": _sums(repeated, of)}
    return Lines(buckets, n_words[k], dup[k], bounds, figures)


def viterbi(model: LineModel, emissions: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Best label of every line; all documents advance together, longest first.  A tie goes to content."""
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    labels = np.zeros(len(emissions), np.int8)
    if not len(order):
        return labels
    first, size = bounds[:-1][order], lengths[order]
    back = np.zeros((len(emissions), 2), np.int8)
    score = np.stack([np.full(len(order), model.start[0]), model.start[1] + emissions[first]], axis=1)
    for t in range(1, int(size[0])):
        n = int(np.searchsorted(-size, -t, side="left"))  # documents with more than t lines
        at = first[:n] + t
        options = score[:n, :, None] + model.step[None]
        pick = (options[:, 1] >= options[:, 0]).astype(np.int8)
        back[at] = pick
        score[:n] = np.where(pick == 1, options[:, 1], options[:, 0])
        score[:n, 1] += emissions[at]
    state = (score[:, 1] >= score[:, 0]).astype(np.int8)
    for t in range(int(size[0]) - 1, -1, -1):
        n = int(np.searchsorted(-size, -t, side="left"))
        at = first[:n] + t
        labels[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return labels


def train(buckets: list[np.ndarray], labels: list[np.ndarray], rounds: int = 150, rate: float = 0.5, l2: float = 1e-5) -> LineModel:
    """Maximum-likelihood CRF by gradient ascent (Adam) with forward-backward over all sequences at once."""
    order = sorted(range(len(buckets)), key=lambda s: -len(buckets[s]))
    size = np.array([len(buckets[s]) for s in order])
    n_seq, steps, k = len(order), int(size[0]), len(EDGES)
    grid = np.zeros((n_seq, steps, k), np.int64)
    gold = np.zeros((n_seq, steps), np.int8)
    for r, s in enumerate(order):
        grid[r, :size[r]], gold[r, :size[r]] = buckets[s], labels[s]
    mask = np.arange(steps)[None] < size[:, None]
    cells = (grid + np.arange(k)[None, None] * WIDTH)[mask]
    theta = np.zeros(k * WIDTH + 6)
    gold_cells = np.bincount(cells[gold[mask] == 1].ravel(), minlength=k * WIDTH)
    pair = mask[:, 1:]
    gold_step = np.array([[np.sum(pair & (gold[:, :-1] == a) & (gold[:, 1:] == b)) for b in (0, 1)] for a in (0, 1)])
    gold_start = np.bincount(gold[:, 0], minlength=2)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        weights, start, trans = theta[:k * WIDTH], theta[k * WIDTH:k * WIDTH + 2], theta[k * WIDTH + 2:].reshape(2, 2)
        e = np.zeros((n_seq, steps))
        e[mask] = weights[cells].sum(axis=1)
        emit = np.stack([np.zeros_like(e), e], axis=2)
        alpha, beta = np.zeros((n_seq, steps, 2)), np.zeros((n_seq, steps, 2))
        alpha[:, 0] = start + emit[:, 0]
        for t in range(1, steps):
            nxt = np.logaddexp(alpha[:, t - 1, 0, None] + trans[0], alpha[:, t - 1, 1, None] + trans[1]) + emit[:, t]
            alpha[:, t] = np.where(mask[:, t, None], nxt, alpha[:, t - 1])
        for t in range(steps - 2, -1, -1):
            ahead = emit[:, t + 1] + beta[:, t + 1]
            nxt = np.logaddexp(trans[:, 0][None] + ahead[:, 0, None], trans[:, 1][None] + ahead[:, 1, None])
            beta[:, t] = np.where(mask[:, t + 1, None], nxt, beta[:, t])
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None])
        expected = np.bincount(cells.ravel(), weights=np.repeat(p1[mask], k), minlength=k * WIDTH)
        joint = alpha[:, :-1, :, None] + trans[None, None] + (emit + beta)[:, 1:, None, :] - z[:, None, None, None]
        exp_step = np.where(pair[:, :, None, None], np.exp(joint), 0).sum(axis=(0, 1)) if steps > 1 else np.zeros((2, 2))
        exp_start = np.array([(1 - p1[:, 0]).sum(), p1[:, 0].sum()])
        grad = np.concatenate([gold_cells - expected, gold_start - exp_start, (gold_step - exp_step).ravel()]) / mask.sum() - l2 * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        theta = theta + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return LineModel(theta[:k * WIDTH].reshape(k, WIDTH), theta[k * WIDTH:k * WIDTH + 2], theta[k * WIDTH + 2:].reshape(2, 2))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> LineModel | None:
    """Train on at most ``sample_docs`` documents per quality label (first by a hash of doc_id) and ``sample_lines`` lines of each.

    The lines are a run from a place that follows from the text's length; of several rows of one
    doc_id one text is taken.  Lines take the label of their document; a line equal to an earlier one of
    its document counts as boilerplate.  None when a label has no document:
    then no line can be told apart and all count as content.
    """
    ready(docs.sparkSession)
    picked = [labels.where((F.col("quality") == q) & F.col("doc_id").isNotNull()).select("doc_id", "quality").distinct()
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs) for q in (0, 1)]
    chosen = picked[0].unionByName(picked[1])  # at most 2 * sample_docs rows

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(1))
            quality = batch.column(0).to_pylist()
            for i, j in K.chunks(offsets):
                lines = line_features(data, offsets, i, j)
                for r in range(j - i):
                    n = lines.bounds[r + 1] - lines.bounds[r]
                    size = int(offsets[i + r + 1] - offsets[i + r])
                    a = lines.bounds[r] + int(K.mix(np.array([size], np.uint64))[0]) % max(1, int(n) - sample_lines + 1)
                    b = min(lines.bounds[r + 1], a + sample_lines)
                    if b > a:
                        y = np.where(lines.duplicate[a:b], 0, quality[i + r])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([quality[i + r]], pa.int32()), pa.array([lines.buckets[a:b].astype(np.uint8).tobytes()]), pa.array([y.astype(np.uint8).tobytes()])],
                            ["quality", "buckets", "labels"])

    # one row a label and doc_id, made in part before the shuffle: a doc_id may stand for any number of rows
    rows = (docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
            .select(F.col("quality").cast("int"), "text")
            .mapInArrow(describe, "quality int, buckets binary, labels binary").collect())
    if len({r.quality for r in rows}) < 2:
        return None
    rows.sort(key=lambda r: (r.quality, bytes(r.buckets)))  # the sum order, and so the model, does not depend on partitions
    return train([np.frombuffer(r.buckets, np.uint8).reshape(-1, len(EDGES)).astype(np.int64) for r in rows],
                 [np.frombuffer(r.labels, np.uint8) for r in rows])


VERDICT = ("struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,base_failed:boolean,"
           "kept:boolean,n_lines:long,n_content_lines:long,content_share:double>")


def verdict(docs: DataFrame, model: LineModel | None, min_share: float = MIN_CONTENT_SHARE):
    """Column with the figures and the verdict for ``docs.text`` (whole texts)."""
    ready(docs.sparkSession)

    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            data, offsets = K.text_bytes(column)
            out: dict[str, list[np.ndarray]] = {}
            for i, j in K.chunks(offsets):
                lines = line_features(data, offsets, i, j)
                b = lines.base
                label = viterbi(model, model.emissions(lines.buckets), lines.bounds) if model else np.ones(len(lines.words), np.int8)
                share = _sums(lines.words * label, lines.bounds) / np.maximum(_sums(lines.words, lines.bounds), 1)
                failed = (b["n_words"] < MIN_WORDS) | (100 * b["n_repeat_words"] > MAX_REPEAT_PCT * b["n_words"])
                part = b | {"base_failed": failed, "kept": ~failed & (share >= min_share), "n_lines": np.diff(lines.bounds),
                            "n_content_lines": _sums(label, lines.bounds), "content_share": share}
                for name, values in part.items():
                    out.setdefault(name, []).append(values)
            yield pa.StructArray.from_arrays(
                [pa.array(np.concatenate(out[f]) if out else [], t) for f, t in _FIELDS], names=[f for f, _ in _FIELDS])

    return F.arrow_udf(_typed(judge), VERDICT)(F.col("text"))


_FIELDS = [(f.split(":")[0], {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[f.split(":")[1]]) for f in VERDICT[7:-1].split(",")]


def _typed(fn):
    """Real annotations: the UDF kind is read from them."""
    fn.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return fn


def judge_documents(docs: DataFrame, labels: DataFrame, min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """(doc_id, figures, verdict) for every document row.

    Null or empty text: zero words, base_failed, not kept.  Repeated rows give
    repeated results; other columns are not read.  An empty labels table, or
    one without both labels, leaves the base rules alone to decide.
    """
    docs = docs.select("doc_id", "text")
    model = fit(docs, labels)
    return docs.select("doc_id", verdict(docs, model, min_share).alias("__v")).select("doc_id", "__v.*")


def keep_documents(docs: DataFrame, corpus: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all their columns) that stay; the CRF is fitted on the labelled rows of ``corpus``."""
    model = fit(corpus.select("doc_id", "text"), labels)
    return docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("__row"), verdict(docs, model).alias("__v")).where("__v.kept").select("__row.*")
