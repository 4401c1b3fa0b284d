"""Token counts by section from one encoding of the whole document (operator 6).

A document is encoded once, whole.  Every id stands for a known run of UTF-8
bytes, so the ids give the token spans; the spans are interval-joined to the
document's sections by a merge of two sorted lists.  Sections need not cover
the text and may be given from outside (fields of a rendered record) or be
the text's lines.  Rule for a token that crosses a boundary:

* ``majority`` (default): the section with most of the token's bytes; the
  earlier one on a tie;
* ``start``: the section that holds its first byte;
* bytes outside all sections count for section null, which competes last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm.common import ready
from auditlens.llm.tokenizing import DEFAULT_TOKENIZER, encoder, text_chunks, tokenizer_path

RULES = ("majority", "start")


def line_sections(text: str) -> list[tuple[int, int]]:
    """Character spans of the lines, each with its line break; none for an empty text."""
    out, at = [], 0
    while at < len(text):
        nl = text.find("\n", at)
        end = len(text) if nl < 0 else nl + 1
        out.append((at, end))
        at = end
    return out


def byte_bounds(text: str, chars: np.ndarray) -> np.ndarray:
    """UTF-8 byte offsets of character offsets."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    if len(data) == len(text):
        return chars
    first = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    return first[chars]


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Token counts of the cells ``bounds[i]:bounds[i+1]`` for tokens that end at ``ends`` (contiguous from 0)."""
    n = len(bounds) - 1
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    lo = np.clip(np.searchsorted(bounds, starts, side="right") - 1, 0, n - 1)
    if rule == "start":
        return np.bincount(lo, minlength=n)
    hi = np.clip(np.searchsorted(bounds, ends, side="left") - 1, 0, n - 1)
    best = lo.copy()
    for t in np.flatnonzero(hi > lo):  # only tokens that cross a boundary
        a, b = starts[t], ends[t]
        share = [min(b, bounds[c + 1]) - max(a, bounds[c]) for c in range(lo[t], hi[t] + 1)]
        best[t] = lo[t] + int(np.argmax(share))
    return np.bincount(best, minlength=n)


def count_tokens(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, rule: str = "majority", spans: str | None = None) -> DataFrame:
    """(doc_id, section, char_start, char_end, n_tokens): one row per section of each document row.

    ``spans`` names an ``array<struct<start long, end long>>`` column of
    ascending, disjoint character spans; by default the lines are the
    sections.  Text outside the given spans is reported under section null,
    once per document, if any token falls there.  A null or empty text has no
    sections and gives no row; repeated rows give repeated results; other
    columns are not read.  The sum over sections is the document's token count.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ready(docs.sparkSession)
    where = tokenizer_path(tokenizer)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(where)
        sizes = enc.byte_lengths()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            given = batch.column(2).to_pylist() if spans else None
            ids, at = batch.column(0), 0
            for part in text_chunks(texts):
                out: list[tuple] = []
                for text, got in zip(part, enc.encode(part), strict=True):
                    if given is not None:
                        sections = [(min(s["start"], len(text)), min(s["end"], len(text))) for s in given[at] or []]
                    else:
                        sections = line_sections(text)
                    doc, at = ids[at].as_py(), at + 1
                    if not text:
                        continue
                    ends = np.cumsum(sizes[np.frombuffer(got, "<u4")])
                    cells, names = [0], []  # the sections with the gaps between them
                    for k, (a, b) in enumerate(sections):
                        if a > cells[-1]:
                            cells.append(a)
                            names.append(None)
                        cells.append(b)
                        names.append(k)
                    if cells[-1] < len(text):
                        cells.append(len(text))
                        names.append(None)
                    counts = attribute(ends, byte_bounds(text, np.asarray(cells, np.int64)), rule)
                    gap = 0
                    for k, name in enumerate(names):
                        if name is None:
                            gap += int(counts[k])
                        else:
                            out.append((doc, name, cells[k], cells[k + 1], int(counts[k])))
                    if gap:
                        out.append((doc, None, None, None, gap))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                        ["doc_id", "section", "char_start", "char_end", "n_tokens"])

    cols = ["doc_id", "text", *([spans] if spans else [])]
    return docs.select(*[F.col(c) for c in cols]).mapInArrow(
        work, "doc_id long, section long, char_start long, char_end long, n_tokens long")
