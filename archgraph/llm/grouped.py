"""Whole groups of rows in Arrow tasks, many small groups at a time."""

import numpy as np
import pyarrow as pa

GROUP_ROWS = 1 << 15
GROUP_BYTES = 32 << 20


def dealt(df, keys):
    """Rows of a group together and in one task; groups are bounded by the caller."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def whole_groups(batches, keys):
    """``(table, begins)`` of consecutive whole groups; ``begins`` has the first row of each group and the number of rows."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        size += batch.nbytes
        if rows < GROUP_ROWS and size < GROUP_BYTES:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        begins = _begins(table, keys)
        if len(begins) > 1:
            last = int(begins[-1])
            yield table.slice(0, last).combine_chunks(), np.append(begins[:-1], last)
            table = table.slice(last).combine_chunks()
        held, rows, size = table.to_batches(), 0, 0
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.append(_begins(table, keys), table.num_rows)


def _begins(table, keys):
    change = np.zeros(table.num_rows, dtype=bool)
    change[0] = True
    for key in keys:
        values = table.column(key).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def spanning_links(number, linked):
    """Links ``(i, j)`` that join the members 0 .. number - 1 exactly as all links would.

    ``linked(i, others)`` tells which of the others are linked with i. A member
    that is joined already is not compared again.
    """
    ones, others = [], []
    left = np.arange(number)
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            one = frontier.pop()
            hit = linked(one, left)
            new = left[hit]
            if len(new):
                ones.append(np.full(len(new), one))
                others.append(new)
                frontier.extend(new.tolist())
                left = left[~hit]
    if not ones:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty
    return np.concatenate(ones), np.concatenate(others)


def fixed_binary_matrix(column, dtype, width):
    """A binary column whose values all have the same length, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, width), dtype=dtype)
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view(dtype).reshape(len(column), width)
