"""Where the lines of a text start, built once per text and probed in constant time.

A text's index is an array: the character offset of each line's start and,
last, the text's length.  Line widths come from one split of the text (JVM),
their running sums from one vector operation over an Arrow batch; the text
itself never leaves the JVM.  Later uses are array look-ups, so any number
of (line, column) positions costs one pass over the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from codelake.functions.text import line_widths


def running_sums(widths: pa.Array) -> pa.Array:
    """For each list of numbers: 0, and the sum of the first 1, 2, ... of them; null stays null."""
    flat = widths.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    counts = np.asarray(pc.fill_null(pc.list_value_length(widths), 0)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[0], np.cumsum(flat)])
    row = np.repeat(np.arange(len(counts)), counts + 1)
    sums = total[np.arange(len(row)) - row] - total[first[row]]
    edges = pa.array((first + np.arange(len(counts) + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(edges, pa.array(sums), mask=widths.is_null() if widths.null_count else None)


def line_starts(text) -> Column:
    """The line index of a text, ``array<bigint>`` (lines as ``str.splitlines(keepends=True)`` has them)."""

    @F.arrow_udf("array<bigint>")
    def sums(widths: pa.Array) -> pa.Array:
        return running_sums(widths)

    return sums(line_widths(text))


def offset_of(starts, line) -> Column:
    """Offset of 1-based ``line``; the line after the last one starts at the text's end; null beyond."""
    starts = F.col(starts) if isinstance(starts, str) else starts
    return F.get(starts, (F.col(line) if isinstance(line, str) else line) - 1)


def position(starts, line, col) -> Column:
    """Offset of 1-based ``col`` on 1-based ``line``."""
    return (offset_of(starts, line) + (F.col(col) if isinstance(col, str) else col) - 1).cast("bigint")
