"""Arrow helpers for stored steps whose row-wise arithmetic is numpy's: lists as flat values with lengths.

Texts are split, lower-cased and matched by the JVM before; what comes here are
arrays of strings, so no regular expression or case rule has a second form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Rows of a piece that is worked on at once.
PIECE_ROWS = 256


def by_pieces(df: DataFrame, fn: Callable[[pa.RecordBatch], list], schema: T.StructType, rows: int = PIECE_ROWS) -> DataFrame:
    """``mapInArrow`` where ``fn`` turns at most ``rows`` rows into the columns of ``schema``; no row is moved."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                yield pa.RecordBatch.from_arrays(fn(whole.slice(start, rows)), names=names)

    return df.mapInArrow(run, schema)


def lengths(lists: pa.Array) -> np.ndarray:
    """Length of each list, 0 for a null one."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def coded(strings: pa.Array) -> tuple[np.ndarray, list[str]]:
    """(codes, values): every string as the number of its value among the distinct ones."""
    found = strings.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()


def as_lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    """Lists of the given sizes over ``values``."""
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), values)
