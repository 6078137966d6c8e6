"""Vectorised work on the bytes of whole text columns inside Arrow tasks.

A text column arrives as one byte buffer and offsets. Words, shingles and
their hashes are computed for many texts at once with prefix sums, in slices of
a bounded number of bytes, so memory does not follow the size of a batch. A
single longer text is a slice of its own. Null texts count as empty ones.
"""

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
KEPT_POWERS = SLICE_BYTES + 1

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_WRAP = (1 << 64) - 1
_powers = {}


def byte_table(*spans):
    """A table of 256 booleans that is true in the given inclusive spans of byte values."""
    table = np.zeros(256, dtype=bool)
    for low, high in spans:
        table[low : high + 1] = True
    return table


BLANK = byte_table((0x20, 0x20), (0x09, 0x0D))
NOT_BLANK = ~BLANK

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def text_slices(column, most=SLICE_BYTES):
    """``(first_row, bytes, offsets)`` of consecutive rows; offsets start at 0 and have one more entry than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    rows = len(column)
    if not rows:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + rows + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(rows, max(last, first + 1))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def spans(data, offsets, inside):
    """Starts, ends and row numbers of the runs of bytes that ``inside`` marks; no run crosses two rows."""
    member = inside[data]
    begins = member.copy()
    begins[1:] &= ~member[:-1]
    ends = member.copy()
    ends[:-1] &= ~member[1:]
    inner = offsets[1:-1]
    cut = inner[(inner > 0) & (inner < len(data))]
    begins[cut] = member[cut]
    ends[cut - 1] = member[cut - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def mix64(values):
    """A bijective scrambling of 64-bit numbers."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(32))


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64))


def _power_tables(length):
    if length <= KEPT_POWERS:
        if "kept" not in _powers:
            _powers["kept"] = _powers_up_to(KEPT_POWERS)
        return _powers["kept"]
    return _powers_up_to(length)


def _powers_up_to(length):
    forward = np.full(length, _MULTIPLIER, dtype=np.uint64)
    backward = np.full(length, pow(_MULTIPLIER, -1, 1 << 64), dtype=np.uint64)
    forward[0] = backward[0] = 1
    return np.cumprod(forward), np.cumprod(backward)


def hash_spans(data, start, end):
    """A 64-bit hash of the bytes of every span, the same wherever the span stands."""
    forward, backward = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * forward[: len(data)], out=sums[1:])
    raw = (sums[end] - sums[start]) * backward[start]
    return mix64(raw ^ ((end - start).astype(np.uint64) << np.uint64(40)))


def word_counts(row, rows):
    return np.bincount(row, minlength=rows)


def shingles(hashes, counts, size):
    """Hashes of runs of ``size`` words per row, and their number per row.

    A row with fewer words gives its whole sequence as one shingle; a row
    without words gives none. Repeated shingles are kept.
    """
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    number = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    total = int(number.sum())
    begin = np.repeat(first, number) + np.arange(total) - np.repeat(np.cumsum(number) - number, number)
    width = np.minimum(np.repeat(counts, number), size)
    padded = np.concatenate((hashes, np.zeros(size, dtype=np.uint64)))
    out = width.astype(np.uint64) * np.uint64(_MULTIPLIER)
    for step in range(size):
        word = padded[begin + step]
        if step:
            word = np.where(step < width, word, np.uint64(0))
        out = mix64(out + word * np.uint64((_MULTIPLIER * (2 * step + 3)) & _WRAP))
    return out, number


def row_offsets(counts):
    return np.concatenate(([0], np.cumsum(counts)))


def ragged(values_start, lengths):
    """Positions of ragged rows laid end to end: row i covers ``values_start[i]`` and the ``lengths[i] - 1`` after it."""
    total = int(lengths.sum())
    return np.repeat(values_start - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
