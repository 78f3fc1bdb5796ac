"""Python on texts, some at a time.

A batch of rows that Spark sends has up to 10,000 texts; what Python makes of them all
at once (strings, lists of rows, then Arrow again) is several times as much in each of
an executor's tasks. A function that is made here gets some hundred KB of text at a time,
and what it gives goes back before the next are looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of the first column's texts, and rows, that are in Python at once; one text is always whole.
BYTES, ROWS = 1 << 18, 512


def cuts(texts: pa.Array, most: int = BYTES, rows: int = ROWS) -> list[int]:
    """Where to cut texts: pieces of at most ``rows`` texts which end with the text that fills ``most`` bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out = [0]
    while out[-1] < len(texts):
        before = int(size[out[-1] - 1]) if out[-1] else 0
        out.append(min(int(np.searchsorted(size, before + most)) + 1, out[-1] + rows, len(texts)))
    return out


def by_pieces(kind: str, arrow: pa.DataType, work: Callable[..., list]) -> Callable[..., Column]:
    """A column function of type ``kind`` (``arrow`` as Arrow has it): ``work`` takes lists of the columns' values, texts first, and gives a list."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)
            edges = cuts(columns[0])
            for a, b in zip(edges, edges[1:]):
                yield pa.array(work(*(c.slice(a, b - a).to_pylist() for c in columns)), arrow)

    return run
