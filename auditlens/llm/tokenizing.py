"""Byte-level BPE encoding inside tasks, with a bounded cache of encoded pieces.

A byte-level pre-tokenizer never puts a non-space character and a following
space into one piece, nor a letter and a following mark, so a text cut there
encodes piece by piece to exactly the ids of the whole text.  Texts are cut and their pieces made
distinct on Arrow and numpy arrays; only distinct pieces are looked up, new ones
are encoded by the ``tokenizers`` library many at a time, and ids (or just their
counts) are gathered.

Texts with a space after a non-ASCII white space or a control character, or with
a special string of the tokenizer, are one piece, which the library encodes as it
is.  So does any text of a tokenizer of another kind.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from auditlens.llm import kernels as K

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: Bytes of a worker's cache (keys, ids and their places); it starts anew beyond that.  Longer pieces are not kept.
CACHE_BYTES, CACHED_PIECE = 80 << 20, 64
#: Bytes that one kept piece takes besides its own and its ids'.
PIECE_BYTES = 130
#: Bytes of text whose pieces are made distinct at a time (one text at least).
CHUNK = 4 << 20
#: ASCII marks that the pre-tokenizer always cuts from a letter before them (apostrophes may start a contraction).
_IS_MARK, _IS_LETTER = np.zeros(256, bool), np.zeros(256, bool)
_IS_MARK[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: A space after one of these may belong to the piece before it.
_UNCLEAR = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """Place of a public vocabulary file; a path is used as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


class PieceEncoder:
    """Encodes whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.cuttable = self._byte_level()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._sizes: np.ndarray | None = None
        self._start_anew()

    def _start_anew(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.kept = self.used = self.n_slots = self.key_bytes = 0
        self.ids, self.at, self.size = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def cache_bytes(self) -> int:
        """Bytes that the kept pieces take."""
        return self.key_bytes + 4 * self.kept + PIECE_BYTES * len(self.slots)

    def _byte_level(self) -> bool:
        """Whether cutting before spaces is known to be exact for this tokenizer."""
        import json
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        return (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
                and bool(pre.get("use_regex", True)) and all(a.get("special") for a in spec.get("added_tokens", [])))

    def _encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        # the same ids without character offsets, where the library has it
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.asarray(e.ids, "<u4") for e in encode(texts, add_special_tokens=False)]

    def _encode_joined(self, pieces: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per piece) of pieces that start with a space and end solid: encoded as one text, cut by bytes."""
        if self._sizes is None:
            self._sizes = self.byte_lengths()
        ids = np.concatenate(self._encode_batch([b"".join(pieces[i:i + 4000]).decode() for i in range(0, len(pieces), 4000)]))
        ends = np.cumsum(lengths)
        place = np.cumsum(self._sizes[ids])
        cut = np.searchsorted(place, ends)
        if not (cut < len(place)).all() or not (place[cut] == ends).all():  # never for the cuts made here
            single = self._encode_batch([p.decode() for p in pieces])
            return np.concatenate(single), np.array([len(x) for x in single])
        return ids, np.diff(cut + 1, prepend=0)

    def _add(self, pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Slots of new pieces; their ids go behind those held."""
        n, m = self.n_slots, len(pieces)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + m > len(self.at):
            self.at, self.size = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.size, np.zeros_like(self.size)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.at[n:n + m] = self.used + np.cumsum(sizes) - sizes
        self.size[n:n + m] = sizes
        self.used, self.n_slots = self.used + len(ids), n + m
        return np.arange(n, n + m)

    def _slots(self, distinct: pa.LargeBinaryArray) -> np.ndarray:
        """Slot of each distinct piece; long pieces stand behind the kept ones until the next call."""
        self.used, self.n_slots = self.kept, len(self.slots)
        if self.cache_bytes() > CACHE_BYTES:
            self._start_anew()
        pieces = distinct.to_pylist()
        slots = np.fromiter(map(self.slots.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(slots < 0)
        if not len(new):
            return slots
        offsets = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset:distinct.offset + len(distinct) + 1]
        data = np.frombuffer(distinct.buffers()[2], np.uint8)
        lengths = np.diff(offsets)[new]
        short = lengths <= CACHED_PIECE
        joined = short & (lengths > 1) & (data[offsets[new]] == 32) & (data[offsets[new + 1] - 1] > 32) & self.cuttable
        for group, keep in ((joined, True), (short & ~joined, True), (~short, False)):
            at, size = new[group], lengths[group]
            # a long piece may be a whole text
            for i in range(0, len(at), step := 40_000 if keep else 64):
                part, n = [pieces[k] for k in at[i:i + step].tolist()], size[i:i + step]
                if group is joined:
                    ids, counts = self._encode_joined(part, n)
                else:
                    single = self._encode_batch([p.decode() for p in part])
                    ids, counts = np.concatenate(single), np.array([len(x) for x in single])
                slots[at[i:i + step]] = got = self._add(part, ids, counts)
                if keep:
                    self.slots.update(zip(part, got.tolist(), strict=True))
                    self.kept, self.key_bytes = self.used, self.key_bytes + int(n.sum())
        return slots

    def _whole(self, column: pa.Array) -> np.ndarray:
        """Texts that are not cut."""
        if not self.cuttable:
            return np.ones(len(column), bool)
        odd = pc.match_substring_regex(column, _UNCLEAR)
        for x in self.specials:
            odd = pc.or_(odd, pc.match_substring(column, x))
        return odd.to_numpy(zero_copy_only=False)

    def _parts(self, column: pa.Array):
        """Chunk by chunk: (texts, slot of every piece, pieces before each text)."""
        column = column.cast(pa.large_string()).fill_null("")
        data, offsets = K.text_bytes(column)
        whole = self._whole(column)
        for i, j in K.chunks(offsets, CHUNK):
            cuts = offsets[i:j + 1] - offsets[i]
            part = data[offsets[i]:offsets[j]]
            first = np.zeros(len(part) + 1, bool)
            if len(part):
                before, at = part[:-1], part[1:]
                first[1:-1] = ((at == 32) & ~K._IS_SPACE[before]) | (_IS_MARK[at] & _IS_LETTER[before])
                del before, at
            for t in np.flatnonzero(whole[i:j]):
                first[cuts[t]:cuts[t + 1]] = False
            first[cuts[:-1]] = True
            first[-1] = False
            starts = np.flatnonzero(first)
            del first
            pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [
                None, pa.py_buffer(np.append(starts, len(part)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(part))]).dictionary_encode()
            slots = self._slots(pieces.dictionary)[pieces.indices.to_numpy()]
            bounds = np.searchsorted(starts, cuts)
            del pieces, starts, part
            yield j - i, slots, bounds

    def encode_flat(self, column: pa.Array):
        """Chunk by chunk: (ids, ids before each text of the chunk and behind the last)."""
        for _, slots, bounds in self._parts(column):
            sizes = self.size[slots]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            place = np.repeat(self.at[slots] - ends[:-1], sizes) + np.arange(ends[-1])
            yield self.ids[place], ends[bounds]

    def count(self, column: pa.Array) -> np.ndarray:
        """Ids of each text."""
        out = []
        for _, slots, bounds in self._parts(column):
            ends = np.concatenate([[0], np.cumsum(self.size[slots])])
            out.append(np.diff(ends[bounds]))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        out = []
        for ids, at in self.encode_flat(pa.array(texts, pa.large_string())):
            out += [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        return out

    def byte_lengths(self) -> np.ndarray:
        """UTF-8 bytes that each id stands for (byte-level vocabularies: one character per byte)."""
        size = self.tokenizer.get_vocab_size()
        out = np.zeros(size, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            out[i] = len(token)
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def text_chunks(texts: list[str], limit: int = 2 << 20):
    """Consecutive lists of texts with about ``limit`` characters each (one text at least)."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > limit:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part
