"""Token ids of whole texts by the tokenizers library, with a cache of space-led chunks."""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOADED: dict[str, ChunkEncoder] = {}  # noqa: F821  one per worker process and file


class ChunkEncoder:
    """Encodes texts as Tokenizer.encode(text, add_special_tokens=False) does.

    Both kinds of vocabulary used here split a text before a single space that a non-space
    follows, whatever stands before it, and before a single newline between non-spaces; neither
    merges nor normalises across such a point. So a text is cut there, each distinct chunk is
    encoded once, and the ids of a text are those of its chunks. A text with a zero, or where a
    space is followed by white space or nothing, is encoded whole. The strings of special
    tokens count as ordinary text. Texts are taken in slices of SLICE bytes (or one longer
    text). Distinct chunks of a slice are found and looked up by Arrow; the store of known ones
    is Arrow and NumPy arrays. Between slices, chunks of over LONG bytes leave it, and when it
    holds over `limit` bytes it goes back to the half that came first, where the common ones
    are: so memory is bounded in bytes, whatever the texts are.
    """

    WHOLE = r" ([\s\v\p{Z}\x{85}\x1c-\x1f]|\z)|\x00"  # RE2
    LINE = r"([^\s\v\p{Z}\x{85}\x1c-\x1f])\n([^\s\v\p{Z}\x{85}\x1c-\x1f])"
    LED = "\0"  # before the keys of chunks without a space before them
    SLICE = 6_000_000  # bytes of text at once
    BATCH = 8192, 500_000  # chunks encoded at once, and their code points
    LONG = 64

    def __init__(self, vocabulary: str, limit: int = 40_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.lowers = "Lowercase" in str(self.tokenizer.normalizer)
        self.limit, self.keys, self.kept = limit, pa.array([], pa.string()), 0
        self.ids, self.start, self.size = np.empty(0, np.uint32), np.empty(0, np.int32), np.empty(0, np.int32)

    @classmethod
    def of(cls, vocabulary: str) -> ChunkEncoder:
        if vocabulary not in _LOADED:
            _LOADED[vocabulary] = cls(vocabulary)
        return _LOADED[vocabulary]

    def _raw(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        most, points = self.BATCH  # an encoding is many times the size of its ids
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and end - at < most and size + len(texts[end]) <= points:
                size += len(texts[end])
                end += 1
            out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[at:end], add_special_tokens=False)]
            at = end
        return out

    def _store(self, keys: pa.Array, values: list) -> None:
        sizes = np.fromiter(map(len, values), np.int32, len(values))
        ids = np.fromiter(chain.from_iterable(values), np.uint32, int(sizes.sum()))
        self.keys = pa.concat_arrays([self.keys, keys])
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes, dtype=np.int32) - sizes])
        self.size, self.ids = np.concatenate([self.size, sizes]), np.concatenate([self.ids, ids])

    def _trim(self) -> None:
        """Long chunks that came since the last call go, and half of all if there are too many."""
        stay = np.ones(len(self.keys), bool)
        stay[self.kept :] = np.asarray(pc.binary_length(self.keys.slice(self.kept))) <= self.LONG
        if self.keys.nbytes + self.ids.nbytes + self.size.nbytes + self.start.nbytes > self.limit:
            stay[len(stay) // 2 :] = False
        if not stay.all():
            self.ids = self.ids[np.repeat(stay, self.size)]
            self.keys, self.size = self.keys.filter(pa.array(stay)), self.size[stay]
            self.start = np.cumsum(self.size, dtype=np.int32) - self.size
        self.kept = len(self.keys)

    def _places(self, keys: pa.Array) -> np.ndarray:
        """The places of distinct chunks in the store; those that it lacks are encoded."""
        if self.lowers:
            coded = pc.if_else(pc.string_is_ascii(keys), pc.ascii_lower(keys), keys).dictionary_encode()
            return self._find(coded.dictionary)[coded.indices.to_numpy()]
        return self._find(keys)

    def _find(self, keys: pa.Array) -> np.ndarray:
        at = pc.index_in(keys, value_set=self.keys)
        lack = keys.filter(at.is_null())
        if not len(lack):
            return at.to_numpy()
        plain = pc.if_else(pc.starts_with(lack, self.LED), pc.utf8_slice_codeunits(lack, 1), pc.binary_join_element_wise(" ", lack, ""))
        self._store(lack, self._raw(plain.to_pylist()))
        out = at.fill_null(0).to_numpy().copy()
        out[at.is_null().to_numpy(zero_copy_only=False)] = np.arange(len(self.keys) - len(lack), len(self.keys))
        return out

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, end, ids, numbers): of texts first .. end - 1, the ids of all and the number of
        ids of each; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        size, at = np.asarray(pc.binary_length(texts)).cumsum(dtype=np.int64), 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + self.SLICE, side="right")))
            gc.disable()  # nothing here makes cycles, and there are many objects to visit
            try:
                ids, n = self._some(texts.slice(at, end - at))
                self._trim()
            finally:
                gc.enable()
                pa.default_memory_pool().release_unused()
            yield at, end, ids, n
            at = end

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and the number of ids of each, at once: for few texts."""
        out = [(np.empty(0, np.uint32), np.empty(0, np.int64)), *((ids, n) for _, _, ids, n in self.slices(texts))]
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = pc.match_substring_regex(texts, self.WHOLE).to_numpy(zero_copy_only=False)
        lines = pc.replace_substring_regex(pc.if_else(pa.array(whole), "", texts), self.LINE, "\\1 \0\n\\2")
        cut = pc.split_pattern(lines, " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        flat, first = cut.flatten(), offsets[:-1]
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy()
        later = np.ones(len(codes), bool)
        later[first] = False
        used = np.zeros(len(coded.dictionary), bool)  # words that only stand first aren't led by a space
        used[codes[later]] = True
        led = pc.binary_join_element_wise(self.LED, flat.take(pa.array(first)), "").dictionary_encode()
        n = int(used.sum())
        found = self._places(pa.concat_arrays([coded.dictionary.filter(pa.array(used)), led.dictionary]))
        place = np.zeros(len(used), found.dtype)
        place[used] = found[:n]
        at = place[codes]
        at[first] = found[n:][led.indices.to_numpy()]
        sizes = self.size[at]
        full = sizes > 0
        starts, n = self.start[at[full]], sizes[full]
        ends = np.cumsum(n, dtype=np.int32)
        steps = np.ones(int(ends[-1]) if len(ends) else 0, np.int32)  # from id to id: 1, or a jump to the next chunk
        steps[ends - n] = starts - np.concatenate([np.zeros(1, np.int32), (starts + n)[:-1] - 1])
        ids = self.ids[np.cumsum(steps, dtype=np.int32)]
        lengths = np.add.reduceat(sizes, first).astype(np.int64)
        if whole.any():
            ids, lengths = self._put_whole(texts, np.flatnonzero(whole), ids, lengths)
        return ids, lengths

    def _put_whole(self, texts: pa.Array, whole: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(lengths)
        parts, last = [], 0
        for i, x in zip(whole.tolist(), self._raw(texts.take(pa.array(whole)).to_pylist()), strict=True):
            end = int(ends[i] - lengths[i])
            parts += [ids[last:end], np.array(x, np.uint32)]
            last, lengths[i] = int(ends[i]), len(x)
        return np.concatenate([*parts, ids[last:]]), lengths
