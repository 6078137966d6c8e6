"""Ids of whole texts by a public tokenizer, at the speed of its distinct pieces.

Texts are cut where the tokenizer's own pre-splitting always cuts, so that the
ids of a text are the ids of its pieces laid end to end. Each distinct piece of
a slice is encoded once by the tokenizers library; a bounded table in the
Python worker remembers pieces across slices.
"""

import os
from array import array

import numpy as np

from archgraph.llm.text import LOWER, byte_table, hash_spans, ragged, row_offsets, text_slices

REMEMBERED_PIECES = 300_000
TOKEN_SLICE_BYTES = 1 << 19

# Classes of bytes whose change always ends a piece. All that is not surely one of them is OPEN: no cut
# is made beside it, and pieces that hold it are split by the library itself. Apostrophes are open, as
# contractions depend on what follows them.
OPEN, LETTER, DIGIT, SIGN, BLANK = range(5)
_CLASS = np.full(256, OPEN, dtype=np.uint8)
_CLASS[0x21:0x7F] = SIGN
_CLASS[ord("'")] = OPEN
_CLASS[byte_table((ord("0"), ord("9")))] = DIGIT
_CLASS[byte_table((ord("A"), ord("Z")), (ord("a"), ord("z")))] = LETTER
_CLASS[byte_table((0x09, 0x0D), (0x1C, 0x20))] = BLANK


def _printable_bytes():
    """The byte alphabet of byte-level vocabularies: printable Latin-1 stands for itself, the rest for characters from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = (x for x in range(256) if x not in plain)
    return {x: x for x in plain} | {x: 256 + i for i, x in enumerate(moved)}


_ALPHABET = np.array([_printable_bytes()[x] for x in range(256)], dtype="<u2")


def _classes(data):
    """Class of every byte; both bytes of a Latin-1 letter are letters, Unicode blanks are BLANK."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    if len(lead):
        second = data[lead + 1]
        lead = lead[(second >= 0x80) & (second != 0x97) & (second != 0xB7)]
        kind[lead] = kind[lead + 1] = LETTER
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        second = data[np.minimum(lead + 1, len(data) - 1)]
        first = data[lead]
        unsafe = lead[
            ((first == 0xC2) & ((second == 0x85) | (second == 0xA0)))
            | ((first == 0xE1) & (second == 0x9A))
            | ((first == 0xE2) & ((second == 0x80) | (second == 0x81)))
            | ((first == 0xE3) & (second == 0x80))
        ]
        for step in range(3):
            kind[np.minimum(unsafe + step, len(data) - 1)] = BLANK
    return kind


def _changes(kind):
    """Positions where a letter, digit or sign follows another of these classes."""
    known = (kind != OPEN) & (kind != BLANK)
    return (kind[1:] != kind[:-1]) & known[1:] & known[:-1]


def _held(kind, what, start, end):
    """How many bytes of the class each span holds."""
    sums = np.concatenate(([0], np.cumsum(kind == what)))
    return sums[end] - sums[start]


def byte_level_cuts(data, offsets):
    """Spans that cover all bytes, for splitters that keep blanks and put one space before the next word.

    A space or line break is cut off only between two characters that are not
    blank; longer blanks stay inside a span. The last value tells which spans
    are one piece of the vocabulary's own splitting.
    """
    kind = _classes(data)
    blank = kind == BLANK
    alone = (data == 0x20) | (data == 0x0A)
    alone[1:] &= ~blank[:-1]
    alone[:-1] &= ~blank[1:]
    lengths = np.diff(offsets)
    filled = lengths > 0
    alone[offsets[:-1][filled]] = False
    alone[offsets[1:][filled] - 1] = False
    begins = alone.copy()
    begins[np.flatnonzero(alone & (data == 0x0A)) + 1] = True
    begins[1:] |= _changes(kind)
    begins[offsets[:-1][filled]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(data))
    single = (_held(kind, OPEN, start, end) == 0) & (_held(kind, BLANK, start, end) == (data[start] == 0x20))
    single &= (end - start > 1) | (data[start] != 0x20)
    return data, start, end, single


def word_level_cuts(data, offsets):
    """Spans of lower-cased characters other than blanks, for splitters that drop blanks and part digits."""
    data = LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    upper = lead[(data[lead + 1] <= 0x9E) & (data[lead + 1] != 0x97)]
    data[upper + 1] += 0x20
    kind = _classes(data)
    plain = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    begins = ~plain
    begins[1:] &= plain[:-1] | _changes(kind) | ((kind[1:] == DIGIT) & (kind[:-1] == DIGIT))
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] = ~plain[first]
    start = np.flatnonzero(begins)
    stop = np.flatnonzero(plain | begins)
    after = np.searchsorted(stop, start, side="right")
    end = np.append(stop, len(data))[after]
    single = (_held(kind, OPEN, start, end) == 0) & (_held(kind, BLANK, start, end) == 0)
    return data, start, end, single


class Encoder:
    """Ids of Arrow text columns; one per Python worker and vocabulary file."""

    _made = {}

    def __init__(self, path, cuts):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.cuts = cuts
        self.known = {}

    @classmethod
    def of(cls, path, cuts):
        if (path, cuts) not in cls._made:
            cls._made[path, cuts] = cls(path, cuts)
        return cls._made[path, cuts]

    def encode(self, column):
        """``(first_row, ids, counts)`` of consecutive rows: ids laid end to end, and their number per row."""
        for first, data, offsets in text_slices(column, TOKEN_SLICE_BYTES):
            yield first, *self._slice(data, offsets)

    def _slice(self, data, offsets):
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(rows, dtype=np.int64)
        data, start, end, single = self.cuts(data, offsets)
        row = np.searchsorted(offsets, start, side="right") - 1
        distinct, where, back = np.unique(hash_spans(data, start, end), return_index=True, return_inverse=True)
        keys = distinct.tolist()
        found = list(map(self.known.get, keys))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            self._learn(data, start[where], end[where], single[where], keys, found, missing)
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) >> 2
        flat = np.frombuffer(b"".join(found), dtype=np.uint32)
        each = lengths[back]
        ids = flat[ragged((row_offsets(lengths)[:-1])[back], each)]
        return ids, np.bincount(row, weights=each, minlength=rows).astype(np.int64)

    def _learn(self, data, start, end, single, keys, found, missing):
        """Fill in the ids of the missing pieces and remember them."""
        if len(self.known) + len(missing) > REMEMBERED_PIECES:
            self.known.clear()
        raw = data.tobytes()
        letters = _ALPHABET[data].tobytes().decode("utf-16-le")
        start, end, single = start.tolist(), end.tolist(), single.tolist()
        tokenize = self.model.tokenize
        whole = [i for i in missing if not single[i]]
        for i in missing:
            if single[i]:
                found[i] = array("I", [token.id for token in tokenize(letters[start[i] : end[i]])]).tobytes()
        pieces = [raw[start[i] : end[i]].decode() for i in whole]
        for i, encoding in zip(whole, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)):
            found[i] = array("I", encoding.ids).tobytes()
        self.known.update((keys[i], found[i]) for i in missing)
