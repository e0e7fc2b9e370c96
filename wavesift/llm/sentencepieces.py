"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a
Viterbi search for the segmentation of the greatest sum of piece scores."""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Iterator
from itertools import islice
from math import inf

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "\u2581"
CHUNK = re.compile(f"{SPACE}*[^{SPACE}\\n]+|{SPACE}+|\\n")
PENALTY = 10.0  # an unknown character scores so much less than the worst piece

_LOADED: dict[str, Pieces] = {}  # noqa: F821  one per worker process and file


class Pieces:
    """A model file's pieces, as a unigram vocabulary.

    Pieces are matched in the normalised text; control, unknown, unused and byte pieces are
    not. A character that no piece covers is an unknown, given out as the pieces of its bytes
    (or, in models without them, as the unknown piece). Among segmentations of equal score the
    one whose last piece is longest wins, and so on backwards. Where no piece holds a space
    mark after another character or a line end, as is usual, a text is cut there, each
    distinct chunk is searched once and remembered, up to `limit` of them.
    """

    def __init__(self, model: str, limit: int = 500_000):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        self.unknown = sp.unk_id()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.worst = min((sp.get_score(i) for i in plain), default=0.0) - PENALTY
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(self.text[i], (len(self.text[i]), sp.get_score(i), i))
        self.automaton.make_automaton()
        self.cuts = not any(SPACE in self.text[i].lstrip(SPACE) or "\n" in self.text[i] for i in plain)
        self.limit, self.known = limit, {}

    @classmethod
    def of(cls, model: str) -> Pieces:
        if model not in _LOADED:
            _LOADED[model] = cls(model)
        return _LOADED[model]

    def search(self, text: str) -> tuple[float, list[int]]:
        """(score, ids) of the best segmentation of a normalised text, in one pass: while the
        automaton runs, its outputs at each place, the pieces that end there, relax the best
        score. Nothing but that, and the last piece there, is held for a character."""
        n, worst, unknown = len(text), self.worst, self.unknown
        best = array("d", [-inf]) * (n + 1)
        sizes, pieces = array("i", [0]) * (n + 1), array("i", [unknown]) * (n + 1)
        best[0], at, single = 0.0, 0, True  # single: whether a piece of one character ends at `at`

        def settle() -> None:
            """An unknown character, where no piece covers the one before this place."""
            if best[at - 1] + worst > best[at]:
                best[at], sizes[at], pieces[at] = best[at - 1] + worst, 1, unknown

        for last, (size, score, i) in self.automaton.iter(text):  # at a place, the longest first
            while at <= last:
                if not single:
                    settle()
                at, single = at + 1, False
            single |= size == 1
            if best[at - size] + score > best[at]:
                best[at], sizes[at], pieces[at] = best[at - size] + score, size, i
        while at < n:
            if not single:
                settle()
            at, single = at + 1, False
        if not single:
            settle()
        ids: list[int] = []
        at = n
        while at:
            size, i = sizes[at], pieces[at]
            if i == self.unknown and self.byte:
                ids += [self.byte[b] for b in reversed(text[at - size : at].encode())]
            elif not (i == self.unknown and ids and ids[-1] == i):  # unknowns in a row are one
                ids.append(i)
            at -= size
        return best[n], ids[::-1]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, null as ''."""
        whole = self.sp.normalize(text or "")
        if not self.cuts or not self.byte:  # unknowns in a row are one piece, also across marks
            return self.search(whole)[1]
        out: list[int] = []
        known = self.known
        for part in CHUNK.findall(whole):
            got = known.get(part)
            if got is None:
                got = known[part] = self.search(part)[1]
            out += got
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces with their marks as spaces, runs of byte pieces as UTF-8,
        less the one space that the model puts before a text."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.value:
                held.append(self.value[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i not in self.silent:
                out.append(" \u2047 " if i == self.unknown else self.text[i])
        out.append(held.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def trim(self) -> None:
        if len(self.known) > self.limit:  # the half that came first holds the common chunks
            self.known = dict(islice(self.known.items(), self.limit // 2))


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded) for each row of docs (doc_id, text), without a shuffle.
    Null and empty texts have no ids and decode to ''; repeated rows come out alike."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                some = b.slice(k, 512)
                gc.disable()
                try:
                    ids = [pieces.encode(t) for t in some.column(1).to_pylist()]
                    texts = [pieces.decode(x) for x in ids]
                    pieces.trim()
                finally:
                    gc.enable()
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
