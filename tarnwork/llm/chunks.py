"""Encoding texts by their distinct chunks.

A batch of texts is cut, with array operations on its bytes, at places where every
tokenizer of this package ends a pre-token whatever stands around it. Equal chunks are
encoded once, and the ids are gathered back in order.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut and encoded at once.
SLICE_BYTES = 2_000_000
#: Distinct chunks whose ids are remembered from batch to batch. Beyond that, the half
#: that most batches had is kept.
MEMO_CHUNKS = 250_000
#: Chunks given to the tokenizers library at once; each costs it about a kilobyte.
LIBRARY_CHUNKS = 4096

_KIND = np.zeros(256, np.uint8)  # 1 letter, 2 other visible ASCII, 3 lead of U+00C0 to U+07FF
_KIND[33:127] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[0xC3:0xE0] = 3


def cut(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where chunks start in UTF-8 ``data``, given where the texts in it start.

    - Before a blank that a visible character follows: the blank belongs to that word,
      and white space before it ends at this place anyway.
    - Before and after a newline between two visible characters.
    - Between a letter and a following visible ASCII character that is none.
    """
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[starts] = True
    marks = first[:n].copy()
    if n < 3:
        return np.flatnonzero(marks)
    kind = _KIND[data]
    visible_next = np.zeros(n, bool)
    visible_next[:-1] = (kind[1:] > 0) & ~first[1:n]
    seen = (kind == 1) | (kind == 2)  # a visible character ends with this byte
    seen[1:] |= (data[1:] >= 0x80) & (data[1:] < 0xC0) & (kind[:-1] == 3)
    seen_before = np.zeros(n, bool)
    seen_before[1:] = seen[:-1] & ~first[1:n]
    marks |= (data == 0x20) & visible_next
    newline = (data == 0x0A) & visible_next & seen_before
    marks |= newline
    marks[1:] |= newline[:-1]
    letter = kind == 1
    latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    letter[1:] |= latin
    marks[1:] |= letter[:-1] & (kind[1:] == 2)
    return np.flatnonzero(marks)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array without nulls, and where each text starts and ends."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], (at - at[0]).astype(np.int64)


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold some ``SLICE_BYTES`` each, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    begin = 0
    while begin < len(texts):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
        yield begin, end
        begin = end


def _gathered(starts: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places of all items of runs, run by run; ``ends`` are the lengths added up."""
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class ChunkCoder:
    """Encodes batches of texts; ``encode`` maps distinct chunks to lists of ids.

    ``fold`` lets chunks that differ in the case of A-Z share their ids, for
    vocabularies that lower-case. ``cut`` says where chunks start.
    """

    def __init__(
        self,
        encode: Callable[[list[str]], list[list[int]]],
        fold: bool = False,
        cut: Callable[[np.ndarray, np.ndarray], np.ndarray] = cut,
    ):
        self.encode, self.fold, self.cut = encode, fold, cut
        self._forget()

    def _forget(self) -> None:
        self.chunks = pa.array([], pa.string())
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.batches = np.zeros(0, np.int32)  # how many batches had the chunk

    def _keep_half(self) -> None:
        order = np.sort(np.argsort(-self.batches, kind="stable")[: MEMO_CHUNKS // 2])
        lengths = self.lengths[order]
        ends = np.cumsum(lengths)
        self.ids = self.ids[_gathered(self.starts[order], lengths, ends)]
        self.starts, self.lengths = ends - lengths, lengths
        self.chunks = self.chunks.take(pa.array(order))
        self.batches = self.batches[order] // 2

    def _places(self, distinct: pa.Array) -> np.ndarray:
        """Where each chunk stands in the memo, which gets those it lacks."""
        if len(self.chunks) > MEMO_CHUNKS:
            self._keep_half()
        at = pc.index_in(distinct, value_set=self.chunks)
        missing = distinct.filter(pc.is_null(at))
        places = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(missing):
            lengths, flat = self._encoded(missing)
            begin = len(self.ids) + np.cumsum(lengths) - lengths
            places[places < 0] = np.arange(len(self.chunks), len(self.chunks) + len(missing))
            self.chunks = pa.concat_arrays([self.chunks, missing])
            self.ids = np.concatenate([self.ids, flat])
            self.starts = np.concatenate([self.starts, begin])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.batches = np.concatenate([self.batches, np.zeros(len(missing), np.int32)])
        self.batches[places] += 1
        return places

    def _encoded(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each chunk has, and all ids."""
        lengths, ids = [], []
        for begin in range(0, len(chunks), LIBRARY_CHUNKS):
            found = self.encode(chunks.slice(begin, LIBRARY_CHUNKS).to_pylist())
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(lengths[-1].sum())))
        return np.concatenate(lengths), np.concatenate(ids)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has. Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        data, at = _bytes_of(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if self.fold:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        first = self.cut(data, at[:-1][at[:-1] < len(data)])
        offsets = np.append(first, len(data)).astype(np.int32)
        chunks = pa.StringArray.from_buffers(
            len(first), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))
        ).dictionary_encode()
        places = self._places(chunks.dictionary)[chunks.indices.to_numpy()]
        lengths = self.lengths[places]
        ends = np.cumsum(lengths)
        gather = _gathered(self.starts[places], lengths, ends)
        upto = np.concatenate([[0], ends])[np.searchsorted(first, at)]
        del chunks
        pa.default_memory_pool().release_unused()
        return self.ids[gather], np.diff(upto)


# What vocabulary files of the tokenizers library may do to a text, so that
# ``cut`` is right for them: nothing, or NFC, one blank for white space and lower case; then
# the usual pattern of byte-level vocabularies, or this one.
NORMALIZERS = frozenset("NFC Replace Lowercase".split())
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _parts(spec: dict | None, inner: str) -> list[dict]:
    if spec is None:
        return []
    return spec[inner] if spec["type"] == "Sequence" else [spec]


def folds(path: str) -> bool:
    """Whether a vocabulary file lower-cases texts; one that ``cut`` may not fit is refused."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    normal = _parts(spec["normalizer"], "normalizers")
    before = _parts(spec["pre_tokenizer"], "pretokenizers")
    byte_level = [x for x in before if x["type"] == "ByteLevel"]
    splits = [x for x in before if x["type"] == "Split"]
    known = (
        {x["type"] for x in normal} <= NORMALIZERS
        and all(x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in normal if x["type"] == "Replace")
        and len(byte_level) == 1
        and not byte_level[0]["add_prefix_space"]
        and len(byte_level) + len(splits) == len(before)
        and all(x["pattern"] == {"Regex": SPLIT} and x["invert"] and x["behavior"] == "Removed" for x in splits)
        and (len(splits) == 1) != byte_level[0]["use_regex"]
    )
    if not known:
        raise ValueError(f"texts cannot be cut into chunks for {path}: unknown normalizer or pre-tokenizer")
    return any(x["type"] == "Lowercase" for x in normal)


@functools.cache  # once for each Python worker, which keeps its memo from task to task
def library_coder(path: str) -> ChunkCoder:
    """A coder for a vocabulary file of the tokenizers library."""
    return ChunkCoder(library_encoder(path), folds(path))


def library_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """A vocabulary file of the tokenizers library; special tokens' names are plain text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    def encode(chunks: list[str]) -> list[list[int]]:
        found = tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [x.ids for x in found]

    return encode
